"""Column types: canonical form, casts, names, and logical families."""

from __future__ import annotations

import contextlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANNOTATION_TYPE = T.ArrayType(
    T.StructType([T.StructField("provider", T.StringType()), T.StructField("annotation", T.StringType())])
)
NARROW_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType)


def col(name: str) -> Column:
    """A column by exact name, also when it holds dots."""
    return F.col(f"`{name}`")


def normalise_types(df: DataFrame) -> tuple[DataFrame, list[dict[str, str]]]:
    """Widen integers and floats and put timestamps in UTC; also list the changes."""
    plan: dict[type, tuple[T.DataType, str]] = {
        **{t: (T.LongType(), "narrow integer widened") for t in NARROW_INTEGERS},
        T.FloatType: (T.DoubleType(), "single precision widened"),
        T.TimestampNTZType: (T.TimestampType(), "timestamp without zone taken as UTC"),
    }
    changes, out = [], []
    for field in df.schema.fields:
        target = plan.get(type(field.dataType))
        if target is None:
            out.append(col(field.name))
            continue
        wanted, reason = target
        value = col(field.name)
        if isinstance(wanted, T.TimestampType):
            value = as_utc(value)
        out.append(value.cast(wanted).alias(field.name, metadata=field.metadata))
        changes.append(
            {
                "column": field.name,
                "from": field.dataType.simpleString(),
                "to": wanted.simpleString(),
                "reason": reason,
            }
        )
    return (df.select(*out) if changes else df), changes


def as_utc(naive: Column) -> Column:
    """A timestamp without zone read as UTC, whatever the session zone is."""
    return F.to_timestamp_ltz(F.concat(naive.cast("timestamp_ntz").cast("string"), F.lit("Z")))


# Strftime directives and the Spark pattern letters for them.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss",
    "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD",
    "z": "xx", ":z": "xxx", "%": "%", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm",
}
ZONE_DIRECTIVES = ("%z", "%:z", "%#z")


def spark_pattern(strftime: str) -> str:
    """Translate a strftime format to a Spark datetime pattern."""
    out = []
    for directive, literal in re.findall(r"%(:z|#z|.)|([^%]+)", strftime):
        if directive:
            name = "z" if directive == "#z" else directive
            if name not in STRFTIME:
                raise ValueError(f"unsupported directive %{directive}")
            out.append(STRFTIME[name])
        else:
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m.group()}'", literal))
    return "".join(out)


def cast_column(
    df: DataFrame, name: str, target: str, fmt: str | None = None, strict: bool = False
) -> DataFrame:
    """Cast one column to datetime, string, integer, float or categorical.

    Values that do not fit become null; for datetime and float ``strict`` makes
    them an error.
    """
    source = df.schema[name].dataType
    value = col(name)
    kind = target.lower()
    if kind == "datetime":
        if isinstance(source, T.TimestampType):
            cast = value
        elif isinstance(source, T.TimestampNTZType):
            cast = as_utc(value)
        else:
            cast = _parse_datetime(value, fmt, strict)
    elif kind in ("string", "text"):
        if isinstance(source, (T.TimestampType, T.TimestampNTZType, T.DateType)) and fmt:
            cast = F.date_format(value, spark_pattern(fmt))
        else:
            cast = value.cast("string")
    elif kind == "integer":
        if isinstance(source, T.StringType):
            # Whole numbers only: a text with a decimal part does not parse.
            cast = F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), value.try_cast("bigint"))
        else:
            cast = value.try_cast("bigint")
    elif kind == "float":
        cast = value.cast("double") if strict else value.try_cast("double")
    elif kind == "categorical":
        cast = value.cast("string")
    else:
        raise ValueError(f"cannot cast to {target!r}")
    return df.withColumn(name, cast)


def _parse_datetime(value: Column, fmt: str | None, strict: bool) -> Column:
    parse = F.to_timestamp if strict else F.try_to_timestamp
    if fmt is None:
        zoned = value.rlike(r"(Z|[+-]\d{2}:?\d{2})\s*$")
        text = F.when(zoned, value).otherwise(F.concat(value, F.lit("Z")))
        return parse(text)
    pattern = spark_pattern(fmt)
    if any(d in fmt for d in ZONE_DIRECTIVES):
        return parse(value, F.lit(pattern) if parse is F.try_to_timestamp else pattern)
    pattern += " xxx"
    return parse(
        F.concat(value, F.lit(" +00:00")),
        F.lit(pattern) if parse is F.try_to_timestamp else pattern,
    )


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns:
        raise ValueError(f"no column {old!r}")
    if new in df.columns and new != old:
        raise ValueError(f"column {new!r} already exists")
    return df.withColumnRenamed(old, new)


def drop_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise ValueError(f"no column {name!r}")
    return df.drop(name)


def logical_type(data_type: T.DataType) -> str:
    """The user-facing family of a type."""
    if data_type == ANNOTATION_TYPE:
        return "annotation"
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, T.FractionalType) and not isinstance(data_type, T.DecimalType):
        return "float"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, T.StringType):
        return "list_string"
    return "object" if isinstance(data_type, T.StructType) else "unknown"


def logical_types(df: DataFrame) -> DataFrame:
    """One row per column: name, Spark type and family."""
    rows = [
        (f.name, f.dataType.simpleString(), logical_type(f.dataType)) for f in df.schema.fields
    ]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, family string")


def axis_report(df: DataFrame) -> DataFrame:
    """``column, axis, filled`` for every column that a trend can run along, and its values that count.

    One pass over the table; null, NaN and infinite values have no place on an axis.
    """
    axes: dict[str, str] = {}
    for name in df.columns:
        for axis in ("numeric", "datetime"):
            with contextlib.suppress(ValueError):
                check_axis_type(df, name, axis)
                axes[name] = axis

    def placed(name: str) -> Column:
        kind = df.schema[name].dataType
        if isinstance(kind, T.DoubleType | T.FloatType):
            return F.abs(col(name)) < F.lit(float("inf"))
        return col(name).isNotNull()

    if not axes:
        return df.sparkSession.createDataFrame([], "column string, axis string, filled bigint")
    counts = df.agg(
        F.array(
            *[
                F.struct(F.lit(n).alias("column"), F.lit(a).alias("axis"), F.count_if(placed(n)).alias("filled"))
                for n, a in axes.items()
            ]
        ).alias("rows")
    )
    return counts.select(F.inline("rows"))


def check_axis_type(df: DataFrame, name: str, axis: str) -> None:
    """Raise if a trends axis does not suit the column's type."""
    family = logical_type(df.schema[name].dataType)
    numeric = family in ("integer", "float") or isinstance(df.schema[name].dataType, T.DecimalType)
    if axis == "numeric" and not numeric:
        raise ValueError(f"column {name!r} is not numeric")
    if axis == "datetime" and family != "datetime":
        raise ValueError(f"column {name!r} is not a date or time")
