"""Counts over time or over numeric bins."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.predicates import literal
from textloom.operators.schema import check_axis_type, col

# Bucket names with their unit and label, units of custom buckets.
FREQUENCIES = {
    "second": ("second", "yyyy-MM-dd HH:mm:ss"),
    "minute": ("minute", "yyyy-MM-dd HH:mm"),
    "hourly": ("hour", "yyyy-MM-dd HH:mm"),
    "daily": ("day", "yyyy-MM-dd"),
    "weekly": ("week", None),
    "monthly": ("month", "yyyy-MM"),
    "quarterly": ("quarter", None),
    "yearly": ("year", "yyyy"),
}
COARSE = ("day", "week", "month", "quarter", "year")
CUSTOM_UNITS = {
    "seconds": (1, "yyyy-MM-dd HH:mm:ss"),
    "minutes": (60, "yyyy-MM-dd HH:mm"),
    "hours": (3600, "yyyy-MM-dd HH:'00'"),
    "days": (86_400, "yyyy-MM-dd"),
    "weeks": (604_800, "yyyy-MM-dd"),
}
MONDAY = 4 * 86_400  # 1970-01-05
FILTERED_PERIODS = 32  # periods tested one by one; more are joined


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def time_bucket(ts: Column, frequency: str) -> Column:
    """Start of the bucket: a date from days on, a timestamp below."""
    unit = FREQUENCIES.get(frequency, FREQUENCIES["daily"])[0]
    if unit == "day":
        return ts.cast("date")
    start = F.date_trunc(unit, ts)
    return start.cast("date") if unit in COARSE else start.cast("timestamp_ntz")


def custom_bucket(ts: Column, every: int, unit: str) -> Column:
    """Start of the bucket of ``every`` units, counted from 1970 (weeks: Mondays)."""
    if every is None or every <= 0:
        raise ValueError("the interval is positive")
    if unit not in CUSTOM_UNITS:
        raise ValueError(f"unit {unit!r}; use one of {sorted(CUSTOM_UNITS)}")
    width = every * CUSTOM_UNITS[unit][0] * 1_000_000
    origin = MONDAY * 1_000_000 if unit == "weeks" else 0
    at = _micros(ts)
    return F.timestamp_micros(at - F.pmod(at - origin, F.lit(width))).cast("timestamp_ntz")


def time_label(bucket: Column, frequency: str, unit: str | None = None) -> Column:
    if frequency == "custom":
        return F.date_format(bucket, CUSTOM_UNITS[unit][1])
    unit_name, pattern = FREQUENCIES.get(frequency, FREQUENCIES["daily"])
    if unit_name == "week":
        # Weeks of the year counted from its first Monday.
        week = F.floor((F.dayofyear(bucket) - 1 + 7 - F.weekday(bucket)) / 7)
        return F.concat(
            F.date_format(bucket, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0")
        )
    if unit_name == "quarter":
        return F.concat(
            F.date_format(bucket, "yyyy"), F.lit("-Q"), F.quarter(bucket).cast("string")
        )
    return F.date_format(bucket, pattern)


def significant(value: Column, digits: int = 6) -> Column:
    """A number with ``digits`` significant digits and no trailing zeros."""
    parts = F.split(F.call_function("format_string", F.lit(f"%.{digits - 1}e"), value), "e")
    mantissa, exponent = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    power = exponent.cast("int")

    def trim(text: Column) -> Column:
        return F.when(
            text.contains("."), F.regexp_replace(text, r"\.?0+$", "")
        ).otherwise(text)

    fixed = F.call_function(
        "format_string",
        F.concat(
            F.lit("%."), F.greatest(F.lit(0), digits - 1 - power).cast("string"), F.lit("f")
        ),
        value,
    )
    return F.when(
        power.between(-4, digits - 1), trim(fixed)
    ).otherwise(F.concat(trim(mantissa), F.lit("e"), exponent))


def _group_value(name: str, case_sensitive: bool) -> Column:
    return col(name) if case_sensitive else F.lower(col(name).cast("string"))


def _count_groups(
    df: DataFrame, axis: Column, bucket: Column, groups: list[str], case_sensitive: bool
) -> DataFrame:
    keys = [_group_value(g, case_sensitive).alias(g) for g in groups]
    return df.groupBy(bucket.alias("time_period"), *keys).agg(
        F.count(F.lit(1)).alias("sequential_count"),
        F.min(axis).alias("period_start"),
        F.max(axis).alias("period_end"),
    )


def time_trend(
    df: DataFrame,
    time_col: str,
    frequency: str = "monthly",
    groups: list[str] | None = None,
    every: int | None = None,
    unit: str | None = None,
    case_sensitive: bool = True,
) -> DataFrame:
    """Rows per time bucket and group, with first and last time and a label."""
    check_axis_type(df, time_col, "datetime")
    ts = col(time_col)
    if frequency == "custom":
        bucket = custom_bucket(ts, every, unit)
    else:
        bucket = time_bucket(ts, frequency)
    counted = _count_groups(df, ts, bucket, groups or [], case_sensitive)
    return counted.withColumn(
        "time_period_formatted", time_label(F.col("time_period"), frequency, unit)
    )


def numeric_trend(
    df: DataFrame,
    value_col: str,
    width: float,
    origin: float | None = None,
    groups: list[str] | None = None,
    case_sensitive: bool = True,
) -> DataFrame:
    """Rows per numeric bin and group; bins start at ``origin`` or the minimum."""
    check_axis_type(df, value_col, "numeric")
    if width is None or width <= 0:
        raise ValueError("the bin width is positive")
    x = col(value_col).cast("double")
    start = F.lit(float(origin)) if origin is not None else df.agg(F.min(x)).scalar()
    size = F.lit(float(width))
    bucket = start + F.floor((x - start) / size) * size
    counted = _count_groups(df, col(value_col), bucket, groups or [], case_sensitive)
    period = F.round("time_period", 6)
    return counted.withColumns(
        {
            "time_period": period,
            "time_period_formatted": F.concat(
                F.lit("["),
                significant(period),
                F.lit(", "),
                significant(period + size),
                F.lit(")"),
            ),
        }
    )


def ordered(trend: DataFrame, groups: list[str] | None = None) -> DataFrame:
    return trend.orderBy("time_period", *(groups or []))


def coarsen(trend: DataFrame, frequency: str, groups: list[str] | None = None) -> DataFrame:
    """Merge a fine trend into wider buckets without reading the rows again."""
    bucket = time_bucket(F.col("time_period"), frequency)
    merged = trend.groupBy(bucket.alias("time_period"), *(groups or [])).agg(
        F.sum("sequential_count").cast("bigint").alias("sequential_count"),
        F.min("period_start").alias("period_start"),
        F.max("period_end").alias("period_end"),
    )
    return merged.withColumn("time_period_formatted", time_label(F.col("time_period"), frequency))


def min_group_size(trend: DataFrame, groups: list[str], least: int) -> DataFrame:
    """Drop the series whose total count is below ``least``."""
    totals = trend.groupBy(*groups).agg(F.sum("sequential_count").alias("__total"))
    t, k = trend.alias("t"), totals.filter(F.col("__total") >= least).alias("k")
    same = reduce(
        lambda a, b: a & b, [F.col(f"t.{g}").eqNullSafe(F.col(f"k.{g}")) for g in groups]
    )
    return t.join(k, same, "left_semi")


def fill_missing(
    trend: DataFrame,
    groups: list[str],
    frequency: str | None = None,
    width: float | None = None,
    every: int | None = None,
    unit: str | None = None,
) -> DataFrame:
    """Every series gets every bucket between the first and the last, empty ones 0.

    Name the buckets as for the trend: a ``frequency``, the ``width`` of numeric
    bins, or ``every`` and ``unit`` of a custom interval. Buckets are matched by
    their number counted from the first one, so rounded starts of bins meet. The
    numbers are a range that Spark spreads over tasks.
    """
    custom = frequency == "custom" or every is not None
    if custom and (every is None or every <= 0 or unit not in CUSTOM_UNITS):
        raise ValueError("a custom interval needs a positive every and a known unit")
    if width is None and not custom and frequency not in FREQUENCIES:
        raise ValueError(f"frequency {frequency!r}; use one of {sorted(FREQUENCIES)}")
    if width is not None and width <= 0:
        raise ValueError("the width is positive")
    spark = trend.sparkSession
    span = trend.agg(F.min("time_period"), F.max("time_period")).first()
    low, high = span
    if low is None:
        return trend.select("time_period", *groups, "sequential_count")
    at = F.col("time_period")
    kind = trend.schema["time_period"].dataType
    if width is not None:
        number = lambda x: F.round((x - F.lit(low)) / F.lit(width))
        start = F.round(F.lit(low) + F.col("__n") * F.lit(width), 6)
    elif custom:
        size = every * CUSTOM_UNITS[unit][0] * 1_000_000
        number = lambda x: F.round((_micros(x) - _micros(F.lit(low))) / size)
        start = F.timestamp_micros(_micros(F.lit(low)) + F.col("__n") * size)
    else:
        name = FREQUENCIES[frequency][0]
        months = {"month": 1, "quarter": 3, "year": 12}.get(name)
        if months:
            number = lambda x: F.round(F.months_between(x, F.lit(low)) / months)
            start = F.add_months(F.lit(low), (F.col("__n") * months).cast("int"))
        elif name in COARSE:
            days = {"day": 1, "week": 7}[name]
            number = lambda x: F.date_diff(x, F.lit(low)) / days
            start = F.date_add(F.lit(low), (F.col("__n") * days).cast("int"))
        else:
            size = {"second": 1, "minute": 60, "hour": 3600}[name] * 1_000_000
            number = lambda x: F.round((_micros(x) - _micros(F.lit(low))) / size)
            start = F.timestamp_micros(_micros(F.lit(low)) + F.col("__n") * size)
    last = spark.range(1).select(number(F.lit(high)).cast("bigint")).first()[0]
    grid = spark.range(last + 1).select(F.col("id").alias("__n"))
    if groups:  # a row per bucket and series is the result itself
        grid = grid.crossJoin(trend.select(*groups).distinct())
    numbered = trend.select(
        number(at).cast("bigint").alias("__n"), at.alias("__at"), *groups, "sequential_count"
    )
    g, c = grid.alias("g"), numbered.alias("c")
    same = F.col("g.__n") == F.col("c.__n")
    for name in groups:
        same = same & F.col(f"g.{name}").eqNullSafe(F.col(f"c.{name}"))
    begin = start.cast("timestamp_ntz") if isinstance(kind, T.TimestampNTZType) else start.cast(kind)
    named = g.withColumn("__start", begin).alias("g")
    return named.join(c, same, "left").select(
        F.coalesce("c.__at", "g.__start").alias("time_period"),
        *[F.col(f"g.{name}") for name in groups],
        F.coalesce("c.sequential_count", F.lit(0)).alias("sequential_count"),
    )


def _merged(periods: Iterable[tuple[Any, Any]]) -> list[tuple[Any, Any]]:
    """Overlapping periods joined, so that the filter tests each stretch once."""
    out: list[tuple[Any, Any]] = []
    for low, high in sorted(periods):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _comparable(value: Any) -> Any:
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if isinstance(value, date) and not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    return value


def _period_rows(
    df: DataFrame, data_type: T.DataType, periods: list[tuple[Any, Any]]
) -> DataFrame:
    """The periods as rows ``low, high`` of the axis' type."""
    spark = df.sparkSession
    if isinstance(data_type, T.NumericType):
        return spark.createDataFrame(periods, "low double, high double")

    def wall(value: datetime) -> str:
        text = value.replace(tzinfo=None).isoformat(sep=" ")
        if isinstance(data_type, T.TimestampType):
            return text + (value.strftime("%:z") if value.tzinfo else "+00:00")
        return text

    rows = spark.createDataFrame([(wall(a), wall(b)) for a, b in periods], "low string, high string")
    return rows.select(*[F.col(c).cast(data_type) for c in ("low", "high")])


def within_periods(df: DataFrame, axis_col: str, periods: DataFrame) -> DataFrame:
    """Rows of ``df`` whose value lies in a period ``low, high`` (both ends count).

    Rows and periods meet on the number of a bucket, so the join has an equality
    and works for any number of periods. A bucket is as wide as the larger of
    the mean length of a period and the whole span over the number of periods;
    so the periods make at most three rows each on average. Rows outside the whole
    span are filtered at the scan. Every row comes once; null values, and periods
    with a null or with the ends reversed, match nothing.
    """
    kind = df.schema[axis_col].dataType

    def number(c: Column) -> Column:
        """Grows with the value, whatever the time zone of the session."""
        if isinstance(kind, T.DateType):
            c = F.unix_date(c)
        elif isinstance(kind, T.TimestampNTZType):
            c = (c - F.lit("1970-01-01").cast(kind)).cast("decimal(20,6)")
        elif isinstance(kind, T.TimestampType):
            c = F.unix_micros(c)
        return c.cast("double")

    def carried(c: Column) -> Column:
        """A form in which a value passes through the driver unchanged."""
        return F.unix_micros(c) if isinstance(kind, T.TimestampType) else c.cast("string") if timed else c

    def constant(value: Any) -> Column:
        if isinstance(kind, T.TimestampType):
            return F.timestamp_micros(F.lit(value))
        return F.lit(value).cast(kind) if timed else F.lit(value)

    timed = isinstance(kind, (T.DateType, T.TimestampNTZType, T.TimestampType))
    if timed:
        periods = periods.select(F.col("low").cast(kind), F.col("high").cast(kind))
    usable = periods.filter(F.col("low") <= F.col("high"))
    low, high = number(F.col("low")), number(F.col("high"))
    finite = F.abs(low) + F.abs(high) < F.lit(float("inf"))
    begin, end, first, last, total, count = usable.agg(
        carried(F.min("low")), carried(F.max("high")),
        F.min(F.when(finite, low)), F.max(F.when(finite, high)),
        F.sum(F.when(finite, high - low)), F.count(F.lit(1)),
    ).first()
    if not count:
        return df.limit(0)
    first, last = (0.0, 0.0) if first is None else (first, last)
    width = max(last - first, total or 0.0) / count or 1.0

    def bucket(c: Column) -> Column:
        # Ends without a bound, and rows beyond the finite ones, go to the outermost buckets.
        place = F.floor(F.least(F.greatest((number(c) - first) / width, F.lit(-1.0)), F.lit(count + 1.0)))
        return place.cast("bigint")

    numbers = F.sequence(bucket(F.col("low")), bucket(F.col("high")))
    spread = usable.select("low", "high", F.explode(numbers).alias("n"))
    axis = F.col(f"r.{_quoted(axis_col)}")
    near = df.filter(col(axis_col).between(constant(begin), constant(end))).alias("r")
    same = bucket(axis) == F.col("p.n")
    inside = axis.between(F.col("p.low"), F.col("p.high"))
    return near.join(spread.alias("p"), same & inside, "left_semi")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def detach_periods(
    df: DataFrame,
    time_col: str,
    periods: list[tuple[Any, Any]] | DataFrame,
    groups: list[dict[str, Any]] | None = None,
    case_sensitive: bool = True,
) -> DataFrame:
    """Source rows inside any of the closed periods and in any visible group.

    ``periods`` is a list, or a table whose first two columns are the ends. A short
    list becomes a filter that the scan can use, a long one or a table a join.
    """
    data_type = df.schema[time_col].dataType
    axis = col(time_col)
    if isinstance(periods, DataFrame):
        ends = periods.toDF("low", "high", *periods.columns[2:]).select("low", "high")
        kept = within_periods(df, time_col, ends)
    elif not periods:
        raise ValueError("no period is selected")
    else:
        if isinstance(data_type, T.NumericType):
            pairs = [(float(a), float(b)) for a, b in periods]
        else:
            pairs = [(_comparable(a), _comparable(b)) for a, b in periods]
        pairs = _merged(pairs)
        if len(pairs) > FILTERED_PERIODS:
            kept = within_periods(df, time_col, _period_rows(df, data_type, pairs))
        else:
            tests = [axis.between(literal(a, data_type), literal(b, data_type)) for a, b in pairs]
            kept = df.filter(reduce(lambda a, b: a | b, tests))
    series = []
    for selection in groups or []:
        parts = []
        for name, value in selection.items():
            if name not in df.columns:
                raise ValueError(f"no group column {name!r}")
            if value is None:
                parts.append(col(name).isNull())
            elif not case_sensitive and isinstance(value, str):
                parts.append(F.lower(col(name).cast("string")) == value.lower())
            else:
                parts.append(col(name) == F.lit(value))
        if parts:
            series.append(reduce(lambda a, b: a & b, parts))
    return kept.filter(reduce(lambda a, b: a | b, series)) if series else kept
