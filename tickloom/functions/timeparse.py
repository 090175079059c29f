"""Timestamp parsing: numbers, numeric strings and ISO text become UTC instants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Magnitudes from here on are milliseconds, and the accepted names of a time column.
MILLIS_FROM = 1e12
TIME_COLUMNS = ["timestamp", "time", "datetime", "date", "time_period_start"]

NUMERIC = r"^[+-]*(?=[0-9_.]*[0-9])[0-9_]*\.?[0-9_]*$"
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?)?([Zz]|[+-]\d{2}(:?\d{2})?)?$"


def epoch_to_ts(value: Column) -> Column:
    """Seconds, or milliseconds when the magnitude says so."""
    micros = F.when(F.abs(value) >= MILLIS_FROM, value * F.lit(1e3)).otherwise(value * F.lit(1e6))
    return F.timestamp_micros(F.when(F.abs(micros) < 2e17, F.round(micros).cast("long")))


def iso_to_ts(text: Column) -> Column:
    """ISO text with Z, an offset or none (then UTC); longer fractions are cut to 6 digits."""
    cut = F.regexp_replace(F.translate(text, "z,", "Z."), r"(\.\d{6})\d+", "$1")
    colon = F.regexp_replace(cut, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(text.rlike(ISO), colon.try_cast("timestamp"))


def parse_ts(value: str | Column) -> Column:
    """Any supported text or number; what cannot be parsed is NULL."""
    text = F.trim((F.col(value) if isinstance(value, str) else value).cast("string"))
    # ISO text has a dash inside, numbers only in front
    iso = F.substring(text, 5, 1) == "-"
    number = F.when(text.rlike(NUMERIC), F.translate(text, "_", "").try_cast("double"))
    return F.when(iso, iso_to_ts(text)).otherwise(epoch_to_ts(number))


def with_parsed_ts(df: DataFrame, source: str, name: str = "ts") -> DataFrame:
    """Add the parsed instant and ``is_bad`` for values that are present but unusable."""
    parsed = df.withColumn(name, parse_ts(source))
    return parsed.withColumn("is_bad", F.col(source).isNotNull() & F.col(name).isNull())


def ensure_ts(df: DataFrame, name: str = "ts", candidates: Sequence[str] = tuple(TIME_COLUMNS)) -> DataFrame:
    """Rename the first known time column, parse it, drop rows without a time."""
    source = next((c for c in candidates if c in df.columns), None)
    if source is None:
        raise KeyError(f"no time column among {list(candidates)}")
    others = [c for c in df.columns if c != source]
    return df.select(parse_ts(source).alias(name), *others).filter(F.col(name).isNotNull())


def epoch_unit(df: DataFrame, column: str) -> DataFrame:
    """One row: is the column in seconds or milliseconds, judged by its median magnitude?

    Where the median lies follows from counts; only if exactly half of the values are large
    do the two middle values (largest small, smallest large one) decide. No sort is needed.
    """
    size = F.abs(F.col(column))
    big = size >= MILLIS_FROM
    facts = df.agg(
        F.count(size).alias("values"),
        F.sum(big.cast("long")).alias("_big"),
        F.max(F.when(~big, size)).alias("_below"),
        F.min(F.when(big, size)).alias("_above"),
    )
    twice = F.col("_big") * 2
    millis = (twice > F.col("values")) | ((twice == F.col("values")) & (F.col("_below") + F.col("_above") >= 2 * MILLIS_FROM))
    return facts.select("values", F.when(millis, "ms").otherwise("s").alias("unit"))


def to_ts_by_unit(df: DataFrame, column: str, name: str = "ts") -> DataFrame:
    unit = epoch_unit(df, column).select("unit").scalar()
    value = F.col(column).cast("double")
    return df.withColumn(name, F.timestamp_micros(F.when(unit == "ms", value * 1e3).otherwise(value * 1e6).cast("long")))


def on_boundary(ts: str | Column, minutes: int) -> Column:
    """Is the minute of ``ts`` a multiple of ``minutes`` since the epoch?"""
    return F.pmod(F.floor(F.unix_seconds(ts) / 60), F.lit(minutes)) == 0


def month_chunks(start: Column, end: Column) -> Column:
    """Array of (chunk_start, chunk_end) dates that split [start, end] at month starts."""
    s, e = start.cast("date"), end.cast("date")
    months = F.sequence(F.trunc(s, "MM"), F.trunc(e, "MM"), F.make_ym_interval(months=F.lit(1)))
    return F.transform(
        months,
        lambda m: F.struct(F.greatest(s, m).alias("chunk_start"), F.least(e, F.last_day(m)).alias("chunk_end")),
    )
