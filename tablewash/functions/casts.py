"""Type names and guarded casts.

Conversions accept the SQL type names the cleaning UI offers plus a few more,
and map them to Spark types. A cast never fails the job: a value that does
not convert becomes NULL (``try_cast``). Guards close the gaps where Spark's
text parsing accepts inputs a SQL engine rejects, or the reverse:

* ``1d`` / ``2F``: Java number suffixes, rejected before a numeric cast.
* ``1.5`` to an integer: parsed as a number and rounded half away from zero.
* ``2020/01/01`` to a date or timestamp: slashes become dashes; a bare ``2020``
  is refused.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import is_floating, is_numeric, is_text

_DECIMAL = re.compile(r"^\s*(?:DECIMAL|NUMERIC)\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)\s*$", re.I)

# Accepted type names (upper case) and their Spark types.
_TYPES: dict[str, T.DataType] = {
    "VARCHAR": T.StringType(), "TEXT": T.StringType(), "STRING": T.StringType(),
    "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(), "REAL": T.FloatType(),
    "INTEGER": T.IntegerType(), "INT": T.IntegerType(),
    "BIGINT": T.LongType(), "SMALLINT": T.ShortType(), "TINYINT": T.ByteType(),
    "BOOLEAN": T.BooleanType(), "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMPTZ": T.TimestampType(),
}

# Text patterns used by the guards.
_JAVA_SUFFIX = r"(?i)[0-9.][df]\s*$"
_SLASH_DATE = r"^(\s*\d{4})/(\d{1,2})/(\d{1,2})"
_DASH_DATE = r"^\s*\d{4}-\d{1,2}-\d{1,2}"


def parse_type(name: str) -> T.DataType:
    """Map an allowed SQL type name to a Spark type; raise on anything else."""
    if not isinstance(name, str):
        raise ValueError(f"type name must be a string, got {name!r}")
    key = name.strip().upper()
    if key in _TYPES:
        return _TYPES[key]
    m = _DECIMAL.match(key)
    if m:
        p, s = int(m.group(1)), int(m.group(2))
        if 1 <= p <= 38 and 0 <= s <= p:
            return T.DecimalType(p, s)
    raise ValueError(f"unsupported type {name!r}; allowed: "
                     f"{sorted(set(_TYPES))} and DECIMAL(p,s)")


def type_label(dt: T.DataType) -> str:
    """SQL-style label of a Spark type (``VARCHAR``, ``DOUBLE``, ``INTEGER``...)."""
    if is_text(dt):
        return "VARCHAR"
    simple = {
        T.DoubleType: "DOUBLE", T.FloatType: "FLOAT", T.IntegerType: "INTEGER",
        T.LongType: "BIGINT", T.ShortType: "SMALLINT", T.ByteType: "TINYINT",
        T.BooleanType: "BOOLEAN", T.DateType: "DATE",
        T.TimestampType: "TIMESTAMP WITH TIME ZONE", T.TimestampNTZType: "TIMESTAMP",
        T.BinaryType: "BLOB",
    }
    for cls, label in simple.items():
        if isinstance(dt, cls):
            return label
    if isinstance(dt, T.DecimalType):
        return f"DECIMAL({dt.precision},{dt.scale})"
    if isinstance(dt, T.ArrayType):
        return type_label(dt.elementType) + "[]"
    return dt.simpleString().upper()


def text_to_double(c: Column) -> Column:
    """Text to DOUBLE with the Java-suffix guard; ``inf``/``NaN`` still parse."""
    return F.when(~c.rlike(_JAVA_SUFFIX), c).try_cast(T.DoubleType())


def guarded_cast(c: Column, source: T.DataType, target: T.DataType) -> Column:
    """Cast ``c`` (of type ``source``) to ``target``; failures become NULL."""
    if isinstance(target, (T.StringType, T.VarcharType, T.CharType)):
        return c.cast(T.StringType())
    if is_text(source):
        if isinstance(target, (T.DoubleType, T.FloatType)):
            return text_to_double(c).try_cast(target)
        if isinstance(target, T.IntegralType):
            exact = c.try_cast(target)                       # big integers stay exact
            rounded = F.round(text_to_double(c)).try_cast(target)
            return F.coalesce(exact, rounded)
        if isinstance(target, T.DecimalType):
            return F.when(~c.rlike(_JAVA_SUFFIX), c).try_cast(target)
        if isinstance(target, T.DateType):
            dashed = F.regexp_replace(c, _SLASH_DATE, "$1-$2-$3")
            return F.when(dashed.rlike(_DASH_DATE), dashed).try_cast(T.DateType())
        if isinstance(target, (T.TimestampType, T.TimestampNTZType)):
            dashed = F.regexp_replace(c, _SLASH_DATE, "$1-$2-$3")
            return F.when(dashed.rlike(_DASH_DATE), dashed).try_cast(target)
        return c.try_cast(target)
    if is_floating(source) and isinstance(target, T.IntegralType):
        # a SQL engine rounds half to even here; a plain cast truncates
        return F.rint(c).try_cast(target)
    if is_numeric(source) and isinstance(target, T.IntegralType):
        return F.round(c).try_cast(target)
    return c.try_cast(target)
