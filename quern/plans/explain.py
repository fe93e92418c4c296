"""What a query on a managed table will read: files, bytes and columns, and which conditions prune."""

from __future__ import annotations

from dataclasses import dataclass

from quern.tables.conditions import conjuncts, terms_of


@dataclass(frozen=True)
class ScanReport:
    table: str
    files: int
    of_files: int
    bytes: int
    of_bytes: int
    columns: int
    of_columns: int
    pushed: tuple[str, ...]
    unpushed: tuple[str, ...]

    def __str__(self) -> str:
        return "\n".join(
            [
                f"scan of {self.table}",
                f"  files: {self.files} of {self.of_files}, bytes: {self.bytes} of {self.of_bytes}",
                f"  columns: {self.columns} of {self.of_columns}",
                f"  prunes files: {'; '.join(self.pushed) or '-'}",
                f"  only filters rows: {'; '.join(self.unpushed) or '-'}",
            ]
        )


def scan_report(session, name: str, condition: str | None = None, columns: list[str] | None = None) -> ScanReport:
    """The report for rows of a managed table under a condition (SQL text) and a choice of columns."""
    where = session.resolve(name)
    table = session.store.load(where)
    schema = table.metadata.schema()
    text = None
    if condition:
        text = session.spark._jsparkSession.sessionState().sqlParser().parseExpression(condition).sql()
    parts = [p.strip() for p in conjuncts(text)] if text else []
    pushed = tuple(p for p in parts if terms_of(p, schema))
    every = table.files()
    files = table.pruned(terms_of(text, schema))
    wanted = len(schema) if columns is None else len({c.lower() for c in columns} & {n.lower() for n in schema.names})
    return ScanReport(str(where), len(files), len(every), sum(f.size for f in files), sum(f.size for f in every), wanted, len(schema), pushed, tuple(p for p in parts if p not in pushed))
