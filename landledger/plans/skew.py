"""Join and ranking shapes that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# A key with more rows than this is spread over several tasks. There can be at
# most rows / HOT_ROWS such keys, which bounds every broadcast in this module.
HOT_ROWS = 500_000
# Pairs that one task compares.
PAIRS = 25_000_000_000


def _parts(left: DataFrame, right: DataFrame, on: list[str], hot_rows: int, among: DataFrame | None) -> DataFrame:
    """Keys whose rows have to be cut, with the number of parts of each side.

    A part pair has at most PAIRS pairs (hot_rows squared, if that is less) and hot_rows rows of a side. Such a key has
    more than the root of that many rows on one side, so there are at most rows / root of them.
    """
    pairs = float(min(PAIRS, hot_rows**2))
    side = pairs**0.5

    def counted(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(*on) if among is None else df.select(*on).join(F.broadcast(among), among.columns, "left_semi")
        return rows.groupBy(*on).agg(F.count("*").cast("double").alias(name))

    def parts(rows: Column, others: Column) -> Column:
        return F.ceil(F.greatest(rows * F.least(others, F.lit(side)) / pairs, rows / hot_rows)).cast("int")

    sizes = counted(left, "_l").join(counted(right, "_r"), on)
    cut = sizes.select(*on, parts(F.col("_l"), F.col("_r")).alias("_lefts"), parts(F.col("_r"), F.col("_l")).alias("_rights"))
    return cut.filter((F.col("_lefts") > 1) | (F.col("_rights") > 1))


def split_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_by: str,
    right_by: str,
    hot_rows: int = HOT_ROWS,
    among: DataFrame | None = None,
) -> DataFrame:
    """Inner equi join in which both sides of a hot key are cut into parts, and every part meets every other.

    Rows are dealt to parts by the hash of ``left_by`` and ``right_by`` and repeated once per part of the other side; rows
    of other keys travel once. ``among`` names some of the keys' columns and the only values that can be hot.
    """
    hot = F.broadcast(_parts(left, right, on, hot_rows, among))

    def dealt(df: DataFrame, by: str, own: str, other: str, at: str, across: str) -> DataFrame:
        parted = df.join(hot, on, "left")
        parted = parted.withColumn(at, F.coalesce(F.pmod(F.xxhash64(by), F.col(own)), F.lit(0)).cast("int"))
        return parted.withColumn(across, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))).drop(own, other)

    lefts = dealt(left, left_by, "_lefts", "_rights", "_i", "_j")
    rights = dealt(right, right_by, "_rights", "_lefts", "_j", "_i")
    return lefts.join(rights, [*on, "_i", "_j"]).drop("_i", "_j")


def attach(
    rows: DataFrame,
    keys: list[str],
    values: dict[str, Column],
    spread_by: list[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add per-group aggregates to every row without a window over the whole group.

    The aggregate is combined map-side. Rows of hot groups take their values from a
    broadcast of the hot groups alone and are spread over the shuffle; the rest join by key.
    """
    grouped = rows.groupBy(*keys).agg(F.count("*").alias("_rows"), *[v.alias(k) for k, v in values.items()])
    hot = grouped.filter(F.col("_rows") > hot_rows).select(
        *keys, F.lit(True).alias("_hot"), *[F.col(k).alias(f"_hot_{k}") for k in values]
    )
    # always 0, but not a literal: the optimizer would drop that from the join's keys and spread nothing
    none = F.greatest(F.col("_rows") - hot_rows, F.lit(0).cast("bigint"))
    cold = grouped.filter(F.col("_rows") <= hot_rows).withColumn("_part", none).drop("_rows")
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_by), F.lit(4096)) + 1).otherwise(F.lit(0))
    joined = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_part", spread.cast("bigint"))
        .join(cold, [*keys, "_part"], "left")
    )
    return joined.select(
        *[F.col(c) for c in rows.columns],
        *[F.coalesce(F.col(f"_hot_{k}"), F.col(k)).alias(k) for k in values],
    )


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str = "rank") -> DataFrame:
    """The first k rows of each group under a total order.

    Spark limits each group to k rows before the shuffle, so a hot key sends k rows per task.
    """
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


def share_of_total(grouped: DataFrame, part: str) -> Column:
    """100 * part / total of an already grouped table, the total as a scalar subquery."""
    total = grouped.agg(F.sum(part)).scalar()
    return F.lit(100.0) * F.col(part) / total


def dense_rank(values: DataFrame, keys: list[str], value: str, out: str = "position", buckets: int = 256) -> DataFrame:
    """Distinct (keys, value) with their dense rank from 0, without sorting a group in one task.

    Approximate quantiles only choose the bucket borders; the ranks are exact.
    """
    distinct = values.select(*keys, value).distinct()
    fractions = [i / buckets for i in range(1, buckets)]
    borders = distinct.agg(F.percentile_approx(value, fractions)).scalar()
    bucketed = distinct.withColumn("_borders", borders).withColumn(
        "_bucket", F.size(F.filter("_borders", lambda c: c < F.col(value)))
    ).drop("_borders")
    sizes = bucketed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value)
    return (
        bucketed.withColumn("_local", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_bucket"])
        .select(*keys, value, (F.col("_offset") + F.col("_local")).alias(out))
    )


def exact_median(rows: DataFrame, keys: list[str], value: str, out: str, buckets: int = 256) -> DataFrame:
    """(keys, out): the median of each group's values, the mean of the middle two where they are even in number.

    Equal values are one row with a count first. Approximate quantiles of all values only choose the borders of buckets;
    counts of buckets tell which one holds the middle, and only that one's values are ordered.
    """
    # a struct of keys, because a struct of nulls equals itself in a join
    counted = rows.filter(F.col(value).isNotNull()).groupBy(F.struct(*keys).alias("_key"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    borders = counted.agg(F.percentile_approx("_v", [i / buckets for i in range(1, buckets)])).scalar()
    # the added zero keeps the optimizer from putting this expression, with its lambda, in the place of the other side's column
    bucket = F.size(F.filter("_borders", lambda b: b < F.col("_v"))) + F.monotonically_increasing_id() * 0
    dealt = counted.withColumn("_borders", borders).withColumn("_bucket", bucket).drop("_borders")
    group = Window.partitionBy("_key")
    sizes = dealt.groupBy("_key", "_bucket").agg(F.sum("_n").alias("_size"))  # at most `buckets` rows a group
    sizes = sizes.withColumns({
        "_all": F.sum("_size").over(group),
        "_before": F.coalesce(F.sum("_size").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = sizes.filter((F.col("_before") <= high) & (F.col("_before") + F.col("_size") > low)).select("_key", "_bucket", "_all", "_before")
    ranked = dealt.join(middle, ["_key", "_bucket"])
    last = F.col("_before") + F.sum("_n").over(Window.partitionBy("_key", "_bucket").orderBy("_v"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_last") - F.col("_n") <= place) & (place < F.col("_last")), F.col("_v")))

    found = ranked.withColumn("_last", last).groupBy("_key").agg(((at(low) + at(high)) / 2).alias(out))
    return found.select("_key.*", out)
