"""Python functions in queries: by row, or by pandas Series."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _guarded(f: Callable) -> Callable:
    """f, not called where every argument is null: null then."""

    @functools.wraps(f)
    def call(*args):
        return None if args and all(a is None for a in args) else f(*args)

    return call


def udf(f: Callable | None = None, returnType="string", *, vectorised: bool = False, callOnNull: bool = False):
    """A Python function as a column function; usable as a decorator, with or without arguments.

    By row, with Arrow between: f isn't called where all its arguments are null, unless callOnNull. vectorised: pandas
    Series in, Series out, nulls seen as missing.
    """
    if f is None or not callable(f):
        kind = f if f is not None else returnType
        return lambda g: udf(g, kind, vectorised=vectorised, callOnNull=callOnNull)
    if vectorised:
        return F.pandas_udf(f, returnType)
    return F.udf(f if callOnNull else _guarded(f), returnType, useArrow=True)


def pandas_udf(f: Callable | None = None, returnType="string", *, callOnNull: bool = False):
    return udf(f, returnType, vectorised=True, callOnNull=callOnNull)


#: Names registered through UDFRegistration, by application.
_registered: dict[str, set[str]] = {}


class UDFRegistration:
    """`session.udf`: functions by SQL name, on both surfaces; a name registered again is replaced."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark

    def register(self, name: str, f: Callable, returnType=None, *, vectorised: bool = False, callOnNull: bool = False):
        made = f if hasattr(f, "evalType") else udf(f, returnType or "string", vectorised=vectorised, callOnNull=callOnNull)
        self._spark.udf.register(name, made)
        _registered.setdefault(self._spark.sparkContext.applicationId, set()).add(name.lower())
        return made

    def registerVectorised(self, name: str, f: Callable, returnType=None, *, callOnNull: bool = False):
        return self.register(name, f, returnType, vectorised=True, callOnNull=callOnNull)

    def unregister(self, name: str) -> None:
        self._spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS `{name}`")
        _registered.get(self._spark.sparkContext.applicationId, set()).discard(name.lower())

    @property
    def registered(self) -> list[str]:
        """Names of the functions that are registered now."""
        return sorted(_registered.get(self._spark.sparkContext.applicationId, ()))
