"""How the values of one column are distributed.

A profile is derived from the column's value frequencies: one scan of one column, counted
per value with a map-side combine. What is exact stays exact at any size: quartiles are found by
narrowing an interval around each rank, scan by scan, so the values are not shuffled and only the
last few thousand are sorted.
"""

from __future__ import annotations

import dataclasses
import functools
import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import InvalidRequestError
from tessera.functions.boxes import BoundingBox
from tessera.functions.paths import column_path, is_numeric, path_type
from tessera.operators.aggregate import top, within
from tessera.plans.staging import measured, stage

QUARTILES = (0.25, 0.5, 0.75)
# Buckets an interval is counted in, and the rows from which on it is narrowed further.
BUCKETS = 4096
LAST_ROWS = 10_000
_MOST = sys.float_info.max


def headline(df: DataFrame, column: str) -> DataFrame:
    """Rows, non-NULL rows, NULL rows and exact distinct values of a column."""
    path_type(df, column)
    value = column_path(column)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(value).alias("non_null_count"),
        F.count(F.when(value.isNull(), 1)).alias("null_count"),
        F.count_distinct(value).alias("distinct_values"),
    )


def _require_numeric(df: DataFrame, column: str) -> Column:
    data_type = path_type(df, column)
    if not is_numeric(data_type):
        raise InvalidRequestError(f"{column} is {data_type.simpleString()}, not a number")
    return column_path(column)


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """Minimum, maximum, mean and sample standard deviation."""
    value = _require_numeric(df, column)
    return df.agg(
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("stddev"),
    )


def text_bounds(df: DataFrame, column: str) -> DataFrame:
    """Smallest and largest value in the column's own order, as text."""
    path_type(df, column)
    value = column_path(column)
    return df.agg(
        F.min(value).cast("string").alias("minimum"), F.max(value).cast("string").alias("maximum")
    )


def value_frequencies(df: DataFrame, column: str) -> DataFrame:
    """``(value, n)`` per distinct value, NULL included."""
    path_type(df, column)
    return df.groupBy(column_path(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@dataclass
class _Interval:
    """Where a rank is known to lie: the smallest and largest value, and the rows around."""

    low: object
    high: object
    below: int
    rows: int
    linear: bool = True


def _position(value: Column, interval: _Interval) -> Column | None:
    """Number of the equal-width bucket of a value, growing with it; None if doubles cannot tell them apart.

    The width is taken on the values or, where one bucket held most of the rows, on their logarithms.
    """
    def number(x: Column) -> Column:
        return F.least(F.greatest(x.cast("double"), F.lit(-_MOST)), F.lit(_MOST))

    def plain(x: object) -> float:
        return min(max(float(x), -_MOST), _MOST)

    low, high = plain(interval.low), plain(interval.high)
    place = number(value)
    if not interval.linear:
        place = F.signum(place) * F.log1p(F.abs(place))
        low, high = (math.copysign(math.log1p(abs(x)), x) for x in (low, high))
    span = high / 2 - low / 2
    if not span > 0:
        return None
    place = F.floor((place / 2 - F.lit(low / 2)) / F.lit(span) * F.lit(float(BUCKETS)))
    return F.greatest(F.lit(0), F.least(place, F.lit(BUCKETS - 1)))


def _narrowed(values: DataFrame, intervals: list[_Interval], ranks: list[int]) -> list[_Interval]:
    """Each rank's bucket within its interval: one scan, counts combined before the shuffle."""
    value = F.col("value")
    distinct = {(i.low, i.high): i for i in intervals}
    place = F.lit(None).cast("struct<which:int,bucket:bigint>")
    for which, interval in enumerate(distinct.values()):
        inside = (value >= F.lit(interval.low)) & (value <= F.lit(interval.high))
        own = F.struct(F.lit(which).alias("which"), _position(value, interval).alias("bucket"))
        place = F.when(inside, own).otherwise(place)
    counted = values.groupBy(place.alias("place")).agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    held: dict[int, list] = {}
    for row in counted.where("place is not null").collect():
        held.setdefault(row["place"]["which"], []).append(row)
    for rows in held.values():
        rows.sort(key=lambda r: r["place"]["bucket"])
    numbers = {key: which for which, key in enumerate(distinct)}
    out = []
    for rank, interval in zip(ranks, intervals):
        below = interval.below
        for row in held[numbers[interval.low, interval.high]]:
            if rank < below + row["n"]:
                break
            below += row["n"]
        crowded = 2 * row["n"] > interval.rows
        out.append(_Interval(row["low"], row["high"], below, row["n"], interval.linear != crowded))
    return out


def _at_ranks(values: DataFrame, ranks: list[int], whole: _Interval) -> list[float]:
    """The values at some ranks, by narrowing an interval around each of them.

    Every scan counts each interval's rows in ``BUCKETS`` buckets and keeps the bucket that holds the
    rank, with its own smallest and largest value. Only an interval of at most ``LAST_ROWS`` rows, or one
    that doubles cannot divide, is sorted. The column itself is never shuffled.
    """
    found = [whole] * len(ranks)
    while True:
        open_ = [k for k, i in enumerate(found) if i.low < i.high and i.rows > LAST_ROWS]
        split = []
        for k in open_:
            if _position(F.col("value"), found[k]) is None and not found[k].linear:
                found[k] = dataclasses.replace(found[k], linear=True)
            if _position(F.col("value"), found[k]) is not None:
                split.append(k)
        if not split:
            break
        for k, interval in zip(split, _narrowed(values, [found[k] for k in split], [ranks[k] for k in split])):
            found[k] = interval
    last = {(i.low, i.high): i for i in found if i.low < i.high}
    at: dict[tuple, list] = {key: [] for key in last}
    if last:
        value = F.col("value")
        inside = functools.reduce(lambda a, b: a | b, ((value >= F.lit(i.low)) & (value <= F.lit(i.high)) for i in last.values()))
        for row in values.where(inside).groupBy("value").agg(F.sum("n").alias("n")).orderBy("value").collect():
            for low, high in last:
                if low <= row["value"] <= high:
                    at[low, high].append(row)
    out = []
    for rank, interval in zip(ranks, found):
        chosen, below = interval.low, interval.below
        for row in at.get((interval.low, interval.high), []):
            chosen = row["value"]
            below += row["n"]
            if rank < below:
                break
        out.append(float(chosen))
    return out


def quantiles(frequencies: DataFrame, fractions: Sequence[float] = QUARTILES) -> list[float | None]:
    """Exact interpolated quantiles of ``(value, n)`` rows; NULL and NaN are in none."""
    numbers = frequencies.where(F.col("value").isNotNull())
    if isinstance(frequencies.schema["value"].dataType, (T.DoubleType, T.FloatType)):
        numbers = numbers.where(~F.isnan("value"))
    facts = measured(numbers, rows=F.coalesce(F.sum("n"), F.lit(0)), low=F.min("value"), high=F.max("value"))
    if not facts["rows"]:
        return [None] * len(fractions)
    positions = [f * (facts["rows"] - 1) for f in fractions]
    ranks = sorted({rank for p in positions for rank in (math.floor(p), math.ceil(p))})
    whole = _Interval(facts["low"], facts["high"], 0, facts["rows"])
    values = dict(zip(ranks, _at_ranks(numbers, ranks, whole)))
    out = []
    for position in positions:
        low, high = values[math.floor(position)], values[math.ceil(position)]
        out.append(low if low == high else low + (high - low) * (position - math.floor(position)))
    return out


def quartiles(df: DataFrame, column: str) -> DataFrame:
    """``p25, median, p75`` of a numeric column, exact and interpolated."""
    value = _require_numeric(df, column)
    q = quantiles(df.select(value.alias("value"), F.lit(1).cast("bigint").alias("n")))
    return df.sparkSession.range(1).select(*(F.lit(v).cast("double").alias(n) for n, v in zip(("p25", "median", "p75"), q)))


def frequency_histogram(frequencies: DataFrame, buckets: int = 10) -> DataFrame:
    """Equal-width buckets over ``(value, n)``: bounds, count and share of **all** rows.

    NULL, NaN and infinity are in no bucket but count in the share's denominator. Empty buckets are
    absent; a column with fewer than two distinct numbers has no buckets.
    """
    if not 2 <= buckets <= 100:
        raise InvalidRequestError(f"a histogram has 2 to 100 buckets, got {buckets}")
    number = F.col("value").cast("double")
    real = F.when(F.abs(number) < F.lit(float("inf")), number)
    facts = measured(frequencies, low=F.min(real), high=F.max(real), rows=F.sum("n"))
    low, high = facts["low"], facts["high"]
    if low is None or not low < high:
        width, kept = 1.0, frequencies.where(F.lit(False))
    else:
        width, kept = (high - low) / buckets, frequencies.where(real.isNotNull())
    first, step = F.lit(low).cast("double"), F.lit(width)
    bucket = F.least(F.floor((real - first) / step), F.lit(buckets - 1).cast("bigint"))
    counted = kept.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("count"))
    return counted.select(
        "bucket",
        (first + F.col("bucket") * step).alias("lower_bound"),
        (first + (F.col("bucket") + 1) * step).alias("upper_bound"),
        "count",
        F.round(F.col("count") / F.lit(facts["rows"]), 6).alias("share"),
    )


def histogram(df: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """`frequency_histogram` straight from the rows: two scans, and no per-value grouping."""
    value = _require_numeric(df, column)
    return frequency_histogram(df.select(value.alias("value"), F.lit(1).cast("bigint").alias("n")), buckets)


def frequency_top(frequencies: DataFrame, rows: Column, k: int | None = 25) -> DataFrame:
    """The k most frequent values as text, with their share of all `rows`; NULL is a value."""
    if k is not None and not 1 <= k <= 200:
        raise InvalidRequestError(f"top_k must be 1 to 200, got {k}")
    as_text = frequencies.groupBy(F.col("value").cast("string").alias("value")).agg(F.sum("n").alias("count"))
    return top(as_text, k, F.col("count").desc(), F.col("value").asc_nulls_last()).select(
        "value", "count", F.round(F.col("count") / rows, 6).alias("share")
    )


def top_values(df: DataFrame, column: str, k: int | None = 25) -> DataFrame:
    """`frequency_top` of any column."""
    rows = df.agg(F.count(F.lit(1)).alias("rows")).scalar()
    return frequency_top(value_frequencies(df, column), rows, k)


@dataclass(frozen=True)
class ColumnProfile:
    """The parts of a column's summary, each a DataFrame."""

    column: str
    column_type: str
    kind: str
    headline: DataFrame
    summary: DataFrame
    distribution: DataFrame

    def long(self) -> DataFrame:
        """One table ``(section, name, value, count, share)`` of text and numbers."""

        def unpivoted(df: DataFrame, section: str) -> DataFrame:
            pairs = [
                F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in df.columns
            ]
            return df.select(F.explode(F.array(*pairs)).alias("pair")).select(
                F.lit(section).alias("section"),
                "pair.name",
                "pair.value",
                F.lit(None).cast("bigint").alias("count"),
                F.lit(None).cast("double").alias("share"),
            )

        if self.kind == "numeric":
            rows = self.distribution.select(
                F.lit("distribution").alias("section"),
                F.col("lower_bound").cast("string").alias("name"),
                F.col("upper_bound").cast("string").alias("value"),
                "count",
                "share",
            )
        else:
            rows = self.distribution.select(
                F.lit("distribution").alias("section"), F.lit("value").alias("name"), "value", "count", "share"
            )
        return unpivoted(self.headline, "headline").unionByName(unpivoted(self.summary, "summary")).unionByName(rows)


def column_stats(
    df: DataFrame,
    column: str,
    box: BoundingBox | None = None,
    top_k: int = 25,
    buckets: int = 10,
    bbox: str = "bbox",
) -> ColumnProfile:
    """Summarise a column; its type decides between a numeric and a categorical summary.

    The data is scanned once: the value frequencies are staged and the rest is computed
    from them.
    """
    data_type = path_type(df, column)
    frequencies = stage(value_frequencies(within(df, box, bbox), column), "values")
    value, n = F.col("value"), F.col("n")
    counts = frequencies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(value.isNotNull(), n)), F.lit(0)).alias("non_null_count"),
        F.coalesce(F.sum(F.when(value.isNull(), n)), F.lit(0)).alias("null_count"),
        F.count(value).alias("distinct_values"),
    )
    if not is_numeric(data_type):
        bounds = frequencies.agg(
            F.min(value).cast("string").alias("minimum"), F.max(value).cast("string").alias("maximum")
        )
        return ColumnProfile(
            column,
            data_type.simpleString(),
            "categorical",
            counts,
            bounds,
            frequency_top(frequencies, frequencies.agg(F.sum("n")).scalar(), top_k),
        )
    number = value.cast("double")
    real = frequencies.where(number.isNotNull())
    total = F.sum(number * n) / F.sum(n)
    # The squares are taken around the mean, so a large mean does not swamp the spread.
    mean = F.lit(measured(real, mean=total)["mean"]).cast("double")
    spread = F.sum(n * (number - mean) * (number - mean))
    q = quantiles(frequencies)
    summary = real.agg(
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
        total.alias("mean"),
        F.when(F.sum(n) > 1, F.sqrt(spread / (F.sum(n) - 1))).alias("stddev"),
    ).select(
        "*",
        *(F.lit(v).cast("double").alias(name) for name, v in zip(("p25", "median", "p75"), q)),
    )
    return ColumnProfile(
        column, data_type.simpleString(), "numeric", counts, summary, frequency_histogram(frequencies, buckets)
    )
