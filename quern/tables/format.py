"""The metadata of a versioned table: schemas with field ids, partition specs, sort orders, snapshots and manifests."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, NumericType, StructField, StructType

from quern.errors import AnalysisException

FORMAT_VERSION = 1
#: The key under which Spark's Parquet reader and writer look for a column's number.
FIELD_ID = "parquet.field.id"


@dataclass(frozen=True)
class Transform:
    """One partition field: identity, years, months, days, hours, bucket or truncate of a column (by number)."""

    source_id: int
    kind: str
    width: int
    name: str

    def column(self, source: Column, data_type: DataType) -> Column:
        """The partition value of a column of that type, as text in the folder's name."""
        if self.kind == "bucket":
            return F.pmod(F.hash(source), F.lit(self.width))
        if self.kind == "truncate" and isinstance(data_type, NumericType):
            # The multiple of the width at or below a number; of a decimal, in units of its last digit.
            step = F.lit(Decimal(self.width).scaleb(-data_type.scale) if isinstance(data_type, DecimalType) else self.width)
            return (source - F.pmod(source, step)).cast(data_type)
        if self.kind == "truncate":
            return F.substring(source.cast("string"), 1, self.width)
        if self.kind in TIME_FORMATS:
            return F.date_format(source.cast("timestamp_ntz"), TIME_FORMATS[self.kind])
        return source


#: Time transforms as text that sorts like time.
TIME_FORMATS = {"years": "yyyy", "months": "yyyy-MM", "days": "yyyy-MM-dd", "hours": "yyyy-MM-dd-HH"}
_TERM = re.compile(r"^\s*(?:(\w+)\s*\(\s*(?:(\d+)\s*,\s*)?([`\w.]+)\s*(?:,\s*(\d+)\s*)?\)|([`\w.]+))\s*$")
_KINDS = {"year": "years", "month": "months", "day": "days", "hour": "hours", "date": "days"}


def parse_transform(term: str, schema: StructType, name: str | None = None) -> Transform:
    """`c`, `days(c)`, `bucket(8, c)`, `truncate(c, 4)` ... as a Transform over a schema with field ids."""
    if not (m := _TERM.match(term)):
        raise AnalysisException(f"not a partition term: {term}")
    kind = _KINDS.get((m[1] or "identity").lower(), (m[1] or "identity").lower())
    if kind not in (*TIME_FORMATS, "identity", "bucket", "truncate"):
        raise AnalysisException(f"not a partition transform: {kind}")
    column = find(schema, (m[3] or m[5]).strip("`"))
    width = int(m[2] or m[4] or 0)
    if (kind in ("bucket", "truncate")) != bool(width):
        raise AnalysisException(f"{kind} takes {'a width' if not width else 'no width'}: {term}")
    default = column.name if kind == "identity" else f"{column.name}_{kind.rstrip('s') if kind in TIME_FORMATS else kind}"
    return Transform(field_id(column), kind, width, name or default)


def find(schema: StructType, name: str) -> StructField:
    """A top-level field by name, case-insensitively."""
    for f in schema:
        if f.name.lower() == name.lower():
            return f
    raise AnalysisException(f"no column {name} among {', '.join(schema.names)}")


def field_id(f: StructField) -> int:
    return f.metadata[FIELD_ID]


def with_id(f: StructField, number: int) -> StructField:
    return StructField(f.name, f.dataType, f.nullable, {**f.metadata, FIELD_ID: number})


@dataclass
class DataFile:
    """A Parquet file: its partition values (text, null or absent) under a spec, rows, bytes and column bounds."""

    path: str
    spec_id: int
    partition: dict[str, str | None]
    rows: int
    size: int
    columns: dict[str, dict]  # by field id: nulls, lower, upper
    snapshot_id: int = 0


@dataclass
class Snapshot:
    snapshot_id: int
    parent_id: int | None
    timestamp_ms: int
    operation: str
    manifests: list[str]
    schema_id: int
    summary: dict[str, str] = field(default_factory=dict)


@dataclass
class Metadata:
    """One version of a table; versions are written once and never changed."""

    table_uuid: str
    location: str
    last_field_id: int
    schemas: list[dict]  # {"id", "schema" (StructType JSON)}
    schema_id: int
    specs: list[dict]  # {"id", "fields" (Transforms)}
    spec_id: int
    sort_orders: list[dict]  # {"id", "fields" ([field id, ascending, nulls first])}
    order_id: int
    properties: dict[str, str]
    snapshots: list[Snapshot]
    snapshot_id: int | None
    snapshot_log: list[tuple[int, int]]  # (ms, snapshot id)
    metadata_log: list[tuple[int, str]]  # (ms, file)
    updated_ms: int
    version: int = 0

    def schema(self, schema_id: int | None = None) -> StructType:
        wanted = self.schema_id if schema_id is None else schema_id
        return StructType.fromJson(next(s["schema"] for s in self.schemas if s["id"] == wanted))

    def spec(self, spec_id: int | None = None) -> list[Transform]:
        wanted = self.spec_id if spec_id is None else spec_id
        return [Transform(**f) for f in next(s["fields"] for s in self.specs if s["id"] == wanted)]

    def order(self) -> list[tuple[int, bool, bool]]:
        return [tuple(f) for f in next(s["fields"] for s in self.sort_orders if s["id"] == self.order_id)]

    def snapshot(self, snapshot_id: int | None = None) -> Snapshot | None:
        wanted = self.snapshot_id if snapshot_id is None else snapshot_id
        found = [s for s in self.snapshots if s.snapshot_id == wanted]
        if snapshot_id is not None and not found:
            raise AnalysisException(f"no snapshot {snapshot_id}")
        return found[0] if found else None

    def set_schema(self, schema: StructType) -> None:
        known = [s["id"] for s in self.schemas if s["schema"] == schema.jsonValue()]
        self.schema_id = known[0] if known else max((s["id"] for s in self.schemas), default=-1) + 1
        if not known:
            self.schemas.append({"id": self.schema_id, "schema": schema.jsonValue()})

    def set_spec(self, fields: list[Transform]) -> None:
        plain = [asdict(f) for f in fields]
        known = [s["id"] for s in self.specs if s["fields"] == plain]
        self.spec_id = known[0] if known else max((s["id"] for s in self.specs), default=-1) + 1
        if not known:
            self.specs.append({"id": self.spec_id, "fields": plain})

    def set_order(self, fields: list[tuple[int, bool, bool]]) -> None:
        plain = [list(f) for f in fields]
        known = [s["id"] for s in self.sort_orders if s["fields"] == plain]
        self.order_id = known[0] if known else max((s["id"] for s in self.sort_orders), default=-1) + 1
        if not known:
            self.sort_orders.append({"id": self.order_id, "fields": plain})

    def to_json(self) -> str:
        return json.dumps({"format-version": FORMAT_VERSION, **asdict(self)})

    @staticmethod
    def from_json(text: str) -> Metadata:
        raw = json.loads(text)
        if raw.pop("format-version") != FORMAT_VERSION:
            raise AnalysisException("this table was written by another version of the format")
        raw["snapshots"] = [Snapshot(**s) for s in raw["snapshots"]]
        return Metadata(**raw)
