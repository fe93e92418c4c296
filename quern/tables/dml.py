"""DELETE, UPDATE and MERGE, copy-on-write: files that hold an affected row are written anew, all others stay.

Each statement plans against one snapshot: files are pruned by the condition, a narrow scan finds those with an affected
row, only they are rewritten, and one commit swaps them. If another writer commits meanwhile, it is planned again.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import AnalysisException, UnsupportedFeatureError
from quern.tables.conditions import terms_of
from quern.tables.format import DataFile, Metadata
from quern.tables.store import Name, Table, TableStore

#: Source keys up to which a MERGE prunes the target's files by an IN list.
MERGE_KEYS = 1000
_FILE, _ROW = "__file", "__row"


def _rows(table: Table, files: list[DataFile]) -> DataFrame:
    """The rows of some files with their file and place."""
    return table.store.scan(files, table.metadata.schema(), place=True)


def _plain(path: str) -> str:
    """A listed path with one slash after its scheme."""
    head, _, rest = path.partition(":")
    return f"{head}:/{rest.lstrip('/')}"


def _own(path: str) -> str:
    """A path of _metadata, which is an encoded URI, as listings spell it."""
    return _plain(unquote(path))


def _is(condition: Column) -> Column:
    """True or false: what isn't known to be true isn't."""
    return F.coalesce(condition, F.lit(False))


def _touched(affected: DataFrame, files: list[DataFile]) -> list[DataFile]:
    """The files among some that affected rows (with _FILE) lie in; their number is bounded by the file list."""
    found = {_own(r[0]) for r in affected.select(_FILE).distinct().collect()}
    return [f for f in files if _plain(f.path) in found]


def delete(store: TableStore, name: Name, condition: str | None, alias: str | None = None) -> Table:
    """Remove the rows for which the condition is true; a file of which all rows go isn't read for it again."""

    def change(table: Table) -> Metadata | None:
        files = table.pruned(terms_of(condition, table.metadata.schema()))
        if condition is None:
            return store.append_snapshot(table.metadata, "delete", [], {f.path for f in files}) if files else None
        rows = _rows(table, files).alias(alias or name.table)
        hit = {_own(r[0]): r[1] for r in rows.where(_is(F.expr(condition))).groupBy(_FILE).count().collect()}
        touched = [f for f in files if _plain(f.path) in hit]
        if not touched:
            return None
        part = [f for f in touched if hit[_plain(f.path)] < f.rows]
        stay = _rows(table, part).alias(alias or name.table).where(~_is(F.expr(condition))).drop(_FILE, _ROW)
        written = store.write_files(table, stay) if part else []
        return store.append_snapshot(table.metadata, "overwrite" if written else "delete", written, {f.path for f in touched})

    return store.commit(name, change)


def update(store: TableStore, name: Name, assignments: dict[str, str], condition: str | None, alias: str | None = None) -> Table:
    """Set columns, by name, to expressions over the old row, where the condition is true."""

    def change(table: Table) -> Metadata | None:
        schema = table.metadata.schema()
        sets = _assigned(assignments, schema.names)
        files = table.pruned(terms_of(condition, schema))
        test = _is(F.expr(condition)) if condition else F.lit(True)
        touched = _touched(_rows(table, files).alias(alias or name.table).where(test), files)
        if not touched:
            return None
        rows = _rows(table, touched).alias(alias or name.table)
        columns = [F.when(test, F.expr(sets[f.name]).cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in sets else F.col(f"`{f.name}`") for f in schema]
        return store.append_snapshot(table.metadata, "overwrite", store.write_files(table, rows.select(*columns)), {f.path for f in touched})

    return store.commit(name, change)


def _assigned(assignments: dict[str, str], names: list[str]) -> dict[str, str]:
    by_lower = {n.lower(): n for n in names}
    out = {}
    for column, text in assignments.items():
        parts = [p.strip("`") for p in column.split(".")]
        own = by_lower.get(parts[-1].lower())
        if own is None or len(parts) > 2 or (len(parts) == 2 and parts[0].lower() in by_lower):
            raise (UnsupportedFeatureError("SET of a nested field", "withField") if len(parts) > 1 and own is None else AnalysisException(f"no column {column}"))
        if own in out:
            raise AnalysisException(f"column {own} is set twice")
        out[own] = text
    return out


@dataclass
class Clause:
    """One WHEN clause. kind: update, delete or insert; values: by target column; star: SET * or INSERT *."""

    kind: str
    condition: str | None = None
    values: dict[str, str] = field(default_factory=dict)
    star: bool = False


def merge(
    store: TableStore,
    name: Name,
    source: DataFrame,
    on: str,
    matched: list[Clause] = (),
    not_matched: list[Clause] = (),
    by_source: list[Clause] = (),
    target_alias: str | None = None,
    source_alias: str | None = None,
) -> Table:
    """MERGE: matched rows by an inner join, the others of either side by anti joins, all in one commit.

    In each group of clauses the first whose condition is true acts. A target row that several source rows match is an
    error if anything could happen to target rows. Insert-only merges append.
    """
    t, s = target_alias or name.table, source_alias or "source"

    def change(table: Table) -> Metadata | None:
        schema = table.metadata.schema()
        names = schema.names
        src = source.alias(s)
        condition = F.expr(on)
        files = table.files() if by_source else _scope(table, source, on, t, s)
        target = _rows(table, files).alias(t)
        written: list[DataFile] = []
        removed: set[str] = set()
        if matched or by_source:
            pairs = target.join(src, condition, "inner")
            again = pairs.groupBy(f"{t}.{_FILE}", f"{t}.{_ROW}").count().where("count > 1")
            if again.limit(1).count():
                raise AnalysisException("MERGE: a target row matches several source rows")
            alone = target.join(src, condition, "left_anti") if by_source else None
            acts = [_fires(pairs, matched)] + ([_fires(alone, by_source)] if by_source else [])
            hit = None
            for df in acts:
                part = df.select(_FILE)
                hit = part if hit is None else hit.union(part)
            touched = _touched(hit, files)
            if touched:
                rows = _rows(table, touched).alias(t)
                out = _after(rows.join(src, condition, "inner"), matched, schema, names, t, s, source.columns)
                rest = rows.join(src, condition, "left_anti")
                out = out.union(_after(rest, by_source, schema, names, t, None, []))
                written = store.write_files(table, out)
                removed = {f.path for f in touched}
        if not_matched:
            fresh = src.join(_rows(table, files).alias(t), condition, "left_anti")
            new = _inserts(fresh, not_matched, schema, s, source.columns)
            written = written + store.write_files(table, new)
        if not written and not removed:
            return None
        return store.append_snapshot(table.metadata, "overwrite" if removed else "append", written, removed)

    return store.commit(name, change)


def _scope(table: Table, source: DataFrame, on: str, t: str, s: str) -> list[DataFile]:
    """The target files that ON lets match: by its conjuncts over literals, and by the source's keys if they are few."""
    import re

    schema = table.metadata.schema()
    parts = [p for p in _conjuncts(on) if not re.search(rf"(?<![\w`]){re.escape(s)}\.", p)]
    terms = terms_of(" AND ".join(parts), schema) if parts else []
    files = table.pruned(terms)
    if len(files) < 2:
        return files
    for part in _conjuncts(on):
        m = re.match(rf"^\(?{re.escape(t)}\.(\w+) = {re.escape(s)}\.(\w+)\)?$", part) or re.match(rf"^\(?{re.escape(s)}\.(?P<b>\w+) = {re.escape(t)}\.(?P<a>\w+)\)?$", part)
        if not m:
            continue
        own, other = (m["a"], m["b"]) if "a" in m.groupdict() else (m[1], m[2])
        kinds = [f for f in schema if f.name.lower() == own.lower() and f.dataType.typeName() in ("integer", "long", "string", "date")]
        if not kinds:
            continue
        keys = [r[0] for r in source.select(F.col(f"`{other}`").cast(kinds[0].dataType)).distinct().limit(MERGE_KEYS + 1).collect()]
        if len(keys) <= MERGE_KEYS:
            from quern.tables.format import field_id

            return table.pruned([*terms, (field_id(kinds[0]), "in", [k for k in keys if k is not None])])
    return files


def _conjuncts(text: str) -> list[str]:
    from quern.tables.conditions import conjuncts

    return [p.strip() for p in conjuncts(text)]


def _which(clauses: list[Clause]) -> Column:
    """The number of the first clause whose condition is true; null if none."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(clauses))):
        test = _is(F.expr(clauses[k].condition)) if clauses[k].condition else F.lit(True)
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def _fires(rows: DataFrame, clauses: list[Clause]) -> DataFrame:
    return rows.where(_which(clauses).isNotNull()) if clauses else rows.limit(0)


def _values(clause: Clause, names: list[str], source_columns: list[str], s: str | None) -> dict[str, str]:
    if not clause.star:
        return _assigned(clause.values, names)
    have = {c.lower(): c for c in source_columns}
    missing = [n for n in names if n.lower() not in have]
    if missing:
        raise AnalysisException(f"* needs every target column in the source; missing: {', '.join(missing)}")
    return {n: f"{s}.`{have[n.lower()]}`" for n in names}


def _after(rows: DataFrame, clauses: list[Clause], schema, names: list[str], t: str, s: str | None, source_columns: list[str]) -> DataFrame:
    """Target rows as the clauses leave them."""
    which = _which(clauses)
    gone = [k for k, c in enumerate(clauses) if c.kind == "delete"]
    columns = []
    for f in schema:
        value = F.col(f"{t}.`{f.name}`")
        for k, c in enumerate(clauses):
            if c.kind == "update" and f.name in (sets := _values(c, names, source_columns, s)):
                value = F.when(which == k, F.expr(sets[f.name]).cast(f.dataType)).otherwise(value)
        columns.append(value.alias(f.name))
    stay = rows.where(which.isNull() | ~which.isin(gone)) if gone else rows
    return stay.select(*columns)


def _inserts(rows: DataFrame, clauses: list[Clause], schema, s: str, source_columns: list[str]) -> DataFrame:
    which = _which(clauses)
    sets = [_values(c, schema.names, source_columns, s) for c in clauses]
    columns = []
    for f in schema:
        value = F.lit(None).cast(f.dataType)
        for k, own in enumerate(sets):
            if f.name in own:
                value = F.when(which == k, F.expr(own[f.name]).cast(f.dataType)).otherwise(value)
        columns.append(value.alias(f.name))
    return rows.where(which.isNotNull()).select(*columns)
