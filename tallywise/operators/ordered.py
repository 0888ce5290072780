"""Order-dependent building blocks that never put a whole group or table into one task.

* ``value_counts`` / ``quantiles_of_counts``: exact quantiles per key from counted values. A key
  with few distinct values takes Spark's ``percentile``; one with many is cut into value ranges.
* ``running_totals``: cumulative sums over the distinct values of a column, split into value ranges.
* ``split_lag``: the previous row of an entity, with the entity split into time buckets.
* ``rank_cuts`` / ``rank_part``: exact n-tiles of a total order, by their boundary rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallywise.functions.scalars import count_true
from tallywise.session import cut_lineage

BUCKETS = 1024
ACCURACY = 10_000
# A group with up to this many distinct values may be held by one task.
SMALL_GROUP = 1_000_000


def _not_null(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(names)) if names else df


# ---------------------------------------------------------------- exact quantiles

def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Stored table ``(keys, v, c)``: how often each value occurs in each group.

    The input is read once. Equal values meet on the map side, and the exchange is by key and
    value, so a group with most of the rows is spread over all tasks. NULLs are left out.
    """
    base = _not_null(df, [*keys, value]).select(*keys, F.col(value).cast("double").alias("v"))
    return cut_lineage(base.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c")))


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], probs: Sequence[float],
                        name: str = "quantiles", small_group: int = SMALL_GROUP) -> DataFrame:
    """Per key the row count ``n`` and an array of linearly interpolated quantiles."""
    keys = list(keys)
    probs = [float(p) for p in probs]
    sizes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d"))
    largest = sizes.agg(F.max("_d")).first()[0] or 0

    def held_by_one_task(part: DataFrame) -> DataFrame:
        return part.groupBy(*keys).agg(F.sum("c").alias("n"), F.percentile("v", probs, F.col("c")).alias(name))

    if largest <= small_group:
        found = held_by_one_task(counts)
        return found if keys else found.where(F.col("n").isNotNull())
    if not keys:
        return _quantiles_by_range(counts, keys, probs, name)
    large = sizes.where(F.col("_d") > small_group).select(*keys)
    return held_by_one_task(counts.join(large, keys, "left_anti")).unionByName(
        _quantiles_by_range(counts.join(large, keys, "left_semi"), keys, probs, name))


def _quantiles_by_range(counts: DataFrame, keys: list[str], probs: Sequence[float], name: str) -> DataFrame:
    """Quantiles of groups too large for one task.

    Values are cut into ranges of about equal numbers of distinct values; the totals of the ranges
    tell which of them hold a wanted rank, and only those are put in order.
    """
    if keys:
        per_key = counts.groupBy(*keys).agg(_even_cuts("v", BUCKETS).alias("_edges"))
        ranged = counts.join(per_key, keys)
    else:
        ranged = counts.withColumn("_edges", range_edges(counts, "v").scalar())
    ranged = ranged.withColumn("_b", range_bucket(F.col("v"), F.col("_edges"))).drop("_edges")
    along = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_b").agg(F.sum("c").alias("_size")).withColumns({
        "_off": F.coalesce(F.sum("_size").over(along), F.lit(0)),
        "n": F.sum("_size").over(Window.partitionBy(*keys)),
    })
    position = [F.lit(p) * (F.col("n") - 1) for p in probs]
    ranks = [f(x) for x in position for f in (F.floor, F.ceil)]
    wanted = totals.withColumn("_ranks", F.array(*ranks)).withColumn(
        "_hit", F.exists("_ranks", lambda r: (r >= F.col("_off")) & (r < F.col("_off") + F.col("_size"))))
    inside = Window.partitionBy(*keys, "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.join(wanted.where("_hit").select(*keys, "_b", "_off", "n", "_ranks"), [*keys, "_b"])
        .withColumn("_to", F.col("_off") + F.sum("c").over(inside))
    )
    at_ranks = placed.select(*keys, "n", "v", "c", "_to", F.posexplode("_ranks").alias("_i", "_r")).where(
        (F.col("_r") < F.col("_to")) & (F.col("_r") >= F.col("_to") - F.col("c")))
    # Two entries per probability and key.
    by_rank = at_ranks.groupBy(*keys).agg(
        F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_i", "v"))).alias("_m"))

    def between(i: int, p: float) -> Column:
        low, high = F.col("_m")[2 * i], F.col("_m")[2 * i + 1]
        at = F.lit(p) * (F.col("n") - 1)
        return low + (high - low) * (at - F.floor(at))

    return by_rank.select(*keys, "n", F.array(*[between(i, p) for i, p in enumerate(probs)]).alias(name))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    name: str = "quantiles") -> DataFrame:
    return quantiles_of_counts(value_counts(df, keys, value), keys, probs, name)


# ---------------------------------------------------------------- value ranges

def range_edges(df: DataFrame, value: str, buckets: int = BUCKETS) -> DataFrame:
    """One row with ``buckets - 1`` increasing edges that cut the values into about equal parts."""
    return df.agg(_even_cuts(value, buckets).alias("edges"))


def _even_cuts(value: str, buckets: int) -> Column:
    # Written as one expression text: a thousand literal columns take longer to build than to run.
    cuts = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))
    return F.expr(f"percentile_approx(`{value}`, array({cuts}), {max(ACCURACY, 4 * buckets)})")


def range_bucket(value: Column, edges: Column, buckets: int = BUCKETS) -> Column:
    """Number of edges at or below the value, by binary search; ``buckets`` is a power of two."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(buckets.bit_length() - 1))])
    return F.aggregate(
        steps, F.lit(0),
        lambda at, step: F.when(value >= F.get(edges, at + step - 1), at + step).otherwise(at),
    )


def running_totals(df: DataFrame, value: str, sums: dict[str, Column], descending: bool = False,
                   buckets: int = BUCKETS) -> DataFrame:
    """One row per distinct value with ``name``, ``cum_name`` and ``total_name`` for each sum.

    Equal values are added up and stored first, then each value range is summed on its own and
    shifted by the totals of the ranges before it (at most ``buckets`` rows, hence the broadcast).
    """
    per_value = cut_lineage(_not_null(df, [value]).groupBy(value).agg(*[F.sum(c).alias(n) for n, c in sums.items()]))
    ranged = (
        per_value.withColumn("_edges", range_edges(per_value, value, buckets).scalar())
        .withColumn("_bucket", range_bucket(F.col(value), F.col("_edges"), buckets)).drop("_edges")
    )
    by = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    before = Window.orderBy(by("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_bucket").agg(*[F.sum(n).alias(n) for n in sums])
    offsets = offsets.select(
        "_bucket",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in sums],
        *[F.sum(n).over(Window.partitionBy()).alias(f"total_{n}") for n in sums],
    )
    inside = (
        Window.partitionBy("_bucket").orderBy(by(value))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        ranged.withColumns({f"_run_{n}": F.sum(n).over(inside) for n in sums})
        .join(F.broadcast(offsets), "_bucket")
        .select(
            value, *sums,
            *[(F.col(f"_off_{n}") + F.col(f"_run_{n}")).alias(f"cum_{n}") for n in sums],
            *[f"total_{n}" for n in sums],
        )
    )


# ---------------------------------------------------------------- previous row

def split_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str,
              name: str, number: str | None = None) -> DataFrame:
    """``value`` of the entity's previous row in ``order``, NULL for its first row.

    ``bucket`` must not decrease along the order. It splits an entity over tasks; the first row of
    a bucket takes the last value of the entity's bucket before, from a table of bucket ends.
    ``number`` names a column for the position of the row in its entity, from 1.
    """
    keys, order = list(keys), list(order)
    spread = _not_null(df, [*keys, order[0]]).withColumn("_b", bucket)
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    buckets = Window.partitionBy(*keys).orderBy("_b")
    # Flat values, where they do, keep the aggregate in a hash table; a struct would be sorted.
    if value == order[0]:
        newest = F.max(value)
    elif len(order) == 1:
        newest = F.max_by(value, order[0])
    else:
        newest = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).alias("v")))["v"]
    # One row per entity and bucket leaves the map side.
    ends = (
        spread.groupBy(*keys, "_b").agg(newest.alias("_end"), F.count(F.lit(1)).alias("_cnt"))
        .select(
            *keys, "_b", F.lag("_end").over(buckets).alias("_carry"),
            F.coalesce(F.sum("_cnt").over(buckets.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        )
    )
    placed = spread.withColumns({"_prev": F.lag(value).over(inside), "_at": F.row_number().over(inside)})
    out = placed.join(ends, [*keys, "_b"]).withColumn(
        name, F.when(F.col("_at") == 1, F.col("_carry")).otherwise(F.col("_prev")))
    if number:
        out = out.withColumn(number, F.col("_off") + F.col("_at"))
    return out.drop("_b", "_prev", "_at", "_carry", "_off")


# ---------------------------------------------------------------- exact n-tiles

Cut = tuple[int, float, int | float | str | None]


def sortable(value: Column, kind: T.DataType) -> Column:
    """A number or text that is never NULL and in the order of ``value``: what ``rank_cuts`` can take as tie-break."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(value.cast("double"), F.lit(float("-inf")))
    if isinstance(kind, T.NumericType):
        return F.coalesce(value.cast("decimal(38,10)") if isinstance(kind, T.DecimalType) else value.cast("bigint"),
                          F.lit(-2**63))
    if isinstance(kind, T.DateType):
        return F.coalesce(F.unix_date(value).cast("bigint"), F.lit(-2**63))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.unix_micros(value.cast("timestamp")), F.lit(-2**63))
    return F.coalesce(value.cast("string"), F.lit(""))


def _tie_order(tie: Column, is_number: bool) -> Column:
    # Text has no value ranges: it is ordered by its hash, then by itself.
    return tie if is_number else F.xxhash64(tie)


def rank_cuts(df: DataFrame, score: str, tie: str, parts: int = 10) -> list[Cut]:
    """First row of each part but part 0, in the order score descending, tie-break ascending.

    Part k starts at row ``ceil(k * n / parts)``. At most ``parts - 1`` rows reach the driver. The
    boundary scores come from running totals; only where equal scores lie on both sides of a
    boundary are the tie-breaks ranked, again split into value ranges.
    """
    rows = _not_null(df, [score, tie]).select(
        F.col(score).cast("double").alias("_s"), F.col(tie).alias("_t"))
    totals = running_totals(rows, "_s", {"n": F.lit(1)}, descending=True)
    first = F.col("cum_n") - F.col("n")
    starts = F.array(*[F.struct(F.lit(k).alias("k"), F.ceil(F.col("total_n") * k / parts).alias("row"))
                       for k in range(1, parts)])
    found = (
        totals.select("_s", first.alias("_from"), "cum_n", F.explode(starts).alias("p"))
        .where((F.col("p.row") >= F.col("_from")) & (F.col("p.row") < F.col("cum_n")))
        .select("p.k", "_s", (F.col("p.row") - F.col("_from")).alias("skip"))
        .orderBy("k").collect()
    )
    open_cuts = [(r["k"], r["_s"], r["skip"]) for r in found if r["skip"] > 0]
    tie_at = _tie_positions(rows, open_cuts) if open_cuts else {}
    return [(r["k"], r["_s"], tie_at.get(r["k"])) for r in found]


def _tie_positions(rows: DataFrame, cuts: list[tuple[int, float, int]]) -> dict[int, int | float | str]:
    """For each (part, score, position): the tie-break at that position among equal scores."""
    spark = rows.sparkSession
    scores = sorted({s for _, s, _ in cuts})
    tied = rows.where(F.col("_s").isin(*scores))
    is_number = isinstance(rows.schema["_t"].dataType, T.NumericType)
    tied = tied.withColumn("_h", _tie_order(F.col("_t"), is_number))
    edges = tied.groupBy("_s").agg(_even_cuts("_h", BUCKETS).alias("_e"))
    # One row per boundary score: at most parts - 1 rows.
    ranged = tied.join(F.broadcast(edges), "_s").select(
        "_s", "_t", "_h", range_bucket(F.col("_h"), F.col("_e")).alias("_b"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    wanted = spark.createDataFrame(cuts, "_k int, _s double, _pos long")
    hit = (
        starts.join(F.broadcast(wanted), "_s")
        .where((F.col("_pos") >= F.col("_start")) & (F.col("_pos") < F.col("_start") + F.col("_cnt")))
        .select("_k", "_s", "_b", (F.col("_pos") - F.col("_start")).alias("_in"))
    )
    at = F.row_number().over(Window.partitionBy("_k").orderBy("_h", "_t"))
    picked = (
        ranged.join(F.broadcast(hit), ["_s", "_b"]).withColumn("_at", at)
        .where(F.col("_at") == F.col("_in") + 1).select("_k", "_t")
    )
    return {r["_k"]: r["_t"] for r in picked.collect()}


def rank_part(score: Column, tie: Column, cuts: Sequence[Cut]) -> Column:
    """Part number of a row, from the boundary rows."""
    past = []
    for _, s, t in cuts:
        if t is None:
            at_cut = score == s
        elif isinstance(t, str):
            behind = F.struct(F.xxhash64(tie), tie) >= F.struct(F.xxhash64(F.lit(t)), F.lit(t))
            at_cut = (score == s) & behind
        else:
            at_cut = (score == s) & (tie >= t)
        past.append((score < s) | at_cut)
    return count_true(past) if past else F.lit(0)
