"""Ordered operations per key that stay balanced when one key holds a large part of all rows.

A window over a hot key would sort all its rows in one task. Here each hot key is cut into ranges of its order
column, every range is worked on by itself, and only one short summary row per range is ordered per key
afterwards. The cut points are a plain list, collected once: at most `4 * max_buckets` numbers however large the
data is, since a key gets cut points in proportion to its rows and only keys above `rows_per_bucket` get any.
Because they are literals, a recomputed task sees the same ranges as the lost one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"
MIN_ROWS = 250_000


@dataclass
class Ranges:
    """Cut points of the hot keys of one data set: (key values, ascending cut points)."""

    keys: list[str]
    order: str
    cuts: DataFrame | None = field(default=None)

    @property
    def split(self) -> bool:
        return self.cuts is not None

    def assign(self, df: DataFrame, at: str | Column | None = None) -> DataFrame:
        """Adds the range number; 0 for every key that isn't hot. Rows with a null order value get range 0."""
        if self.cuts is None:
            return df.withColumn(BUCKET, F.lit(0))
        at = F.col(self.order) if at is None else (F.col(at) if isinstance(at, str) else at)
        number = F.size(F.filter("_cuts", lambda c: c <= at.cast("double")))
        joined = df.join(F.broadcast(self.cuts), self.keys, "left")
        return joined.withColumn(BUCKET, F.when(F.col("_cuts").isNull() | at.isNull(), 0).otherwise(number)).drop("_cuts")


def find_ranges(df: DataFrame, keys: list[str], order: str, min_rows: int = MIN_ROWS, max_buckets: int | None = None) -> Ranges:
    """Looks for hot keys and cuts them at approximate quantiles of `order` (numeric).

    Runs one counting job, and another one over the hot keys only, if there are any. `rows_per_bucket` is `min_rows`, or the total
    divided by `max_buckets` (twice the shuffle partitions, 256 at least) where that is more.
    """
    spark = df.sparkSession
    if max_buckets is None:
        max_buckets = max(256, 2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    slim = df.select(*keys, order).filter(F.col(order).isNotNull())
    seen = Observation()
    counts = slim.groupBy(*keys).count().observe(seen, F.sum("count").alias("total"))
    top = counts.filter(F.col("count") > min_rows).orderBy(F.desc("count")).limit(max_buckets).collect()  # a key over the bound is among them
    total = seen.get["total"] or 0
    per_bucket = max(min_rows, -(-total // max_buckets))
    hot = [r for r in top if r["count"] > per_bucket]
    if not hot:
        return Ranges(keys, order)
    by_parts: dict[int, list] = {}
    for row in hot:
        parts = 2
        while parts * per_bucket < row["count"]:
            parts *= 2
        by_parts.setdefault(parts, []).append(tuple(row[k] for k in keys))
    types = slim.select(*keys).schema
    cuts = []
    for parts, members in by_parts.items():
        wanted = F.broadcast(spark.createDataFrame(members, types))
        points = F.percentile_approx(F.col(order).cast("double"), [i / parts for i in range(1, parts)], 10 * parts if parts > 1000 else 10_000)
        cuts += [(*[r[k] for k in keys], sorted(set(r["_cuts"]))) for r in slim.join(wanted, keys).groupBy(*keys).agg(points.alias("_cuts")).collect()]
    schema = T.StructType([*types.fields, T.StructField("_cuts", T.ArrayType(T.DoubleType()))])
    return Ranges(keys, order, spark.createDataFrame(cuts, schema))


def ranked(df: DataFrame, ranges: Ranges, order: list, name: str = "_rank") -> DataFrame:
    """Row number per key over all ranges: the number inside the range plus the rows of the ranges before it.

    `df` must carry the range number. The offsets are one row per range of a hot key, so they are broadcast.
    """
    keys = ranges.keys
    local = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys, BUCKET).orderBy(*order)))
    if not ranges.split:
        return local
    hot = df.join(F.broadcast(ranges.cuts.select(*keys)), keys, "left_semi")
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = hot.groupBy(*keys, BUCKET).count().select(*keys, BUCKET, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(offsets), [*keys, BUCKET], "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before")


def collapse_runs(df: DataFrame, ranges: Ranges, order: list[str], value: str, at: str, max_gap, aggs: dict[str, tuple[Column, callable]]) -> DataFrame:
    """Runs of neighbouring rows of one key with the same `value`, neighbours at most `max_gap` apart in `at`.

    Row number within the key minus row number within key and value is constant along a run. That is done inside
    each range; a run that touches the edge of its range is then joined with its continuation in the next one.

    `aggs` maps an output name to (aggregate over rows, function that makes the aggregate merging the partial
    results from a column). The result has the keys, `value`, `first_at`, `last_at`, `n` and those outputs.
    Values must not be null. Ties in `order` must be broken by the caller.
    """
    keys = ranges.keys
    w = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    by_value = Window.partitionBy(*keys, BUCKET, value).orderBy(*order)
    numbered = (
        df.withColumn("_rn", F.row_number().over(w))
        .withColumn("_far", (F.col(at) - F.lag(at).over(w) > F.lit(max_gap)).cast("int"))
        .withColumn("_stretch", F.sum(F.coalesce("_far", F.lit(0))).over(w))
        .withColumn("_diff", F.col("_rn") - F.row_number().over(by_value))
    )
    if ranges.split:
        numbered = numbered.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys, BUCKET)))
    else:
        numbered = numbered.withColumn("_rows", F.lit(0).cast("long"))
    runs = numbered.groupBy(*keys, BUCKET, value, "_diff", "_stretch").agg(
        F.min(at).alias("first_at"),
        F.max(at).alias("last_at"),
        F.count(F.lit(1)).alias("n"),
        F.min("_rn").alias("_from"),
        F.max("_rn").alias("_to"),
        F.max("_rows").alias("_rows"),
        *[a.alias(name) for name, (a, _) in aggs.items()],
    )
    out = [*keys, value, "first_at", "last_at", "n", *aggs]
    if not ranges.split:
        return runs.select(*out)
    edge = (F.col("_from") == 1) | (F.col("_to") == F.col("_rows"))
    hot = F.broadcast(ranges.cuts.select(*keys))
    runs = runs.join(hot.withColumn("_hot", F.lit(True)), keys, "left")
    is_edge = edge & F.col("_hot").isNotNull()
    order_edges = Window.partitionBy(*keys).orderBy(BUCKET, "_from")
    linked = (
        (F.col("_from") == 1)
        & F.lag(F.col("_to") == F.col("_rows")).over(order_edges)
        & (F.lag(value).over(order_edges) == F.col(value))
        & (F.col("first_at") - F.lag("last_at").over(order_edges) <= F.lit(max_gap))
    )
    edges = (  # two rows for each range of a hot key at most
        runs.filter(is_edge)
        .withColumn("_new", F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(order_edges))
        .groupBy(*keys, "_run", value)
        .agg(
            F.min("first_at").alias("first_at"),
            F.max("last_at").alias("last_at"),
            F.sum("n").alias("n"),
            *[merge(F.col(name)).alias(name) for name, (_, merge) in aggs.items()],
        )
    )
    return runs.filter(~is_edge).select(*out).unionByName(edges.select(*out))


def stretches(df: DataFrame, ranges: Ranges, order: list[str], at: str, max_gap, name: str) -> DataFrame:
    """Numbers the stretches of a key's rows, from 0; a new one begins where `at` has grown by more than `max_gap`.

    Each range numbers its own stretches; how many came before is read off one row for each range of a hot key.
    """
    keys = ranges.keys
    w = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    broken = df.withColumn("_break", F.coalesce((F.col(at) - F.lag(at).over(w) > F.lit(max_gap)).cast("int"), F.lit(0)))
    local = broken.withColumn(name, F.sum("_break").over(w))
    if not ranges.split:
        return local.drop("_break")
    by_range = Window.partitionBy(*keys).orderBy(BUCKET)
    hot = broken.join(F.broadcast(ranges.cuts.select(*keys)), keys, "left_semi")
    edge = F.coalesce((F.col("_low") - F.lag("_high").over(by_range) > F.lit(max_gap)).cast("int"), F.lit(0))
    sums = hot.groupBy(*keys, BUCKET).agg(F.sum("_break").alias("_n"), F.min(at).alias("_low"), F.max(at).alias("_high")).withColumn("_edge", edge)
    before = F.coalesce(F.sum("_n").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.sum("_edge").over(by_range)
    offsets = sums.select(*keys, BUCKET, before.alias("_before"))
    return local.join(F.broadcast(offsets), [*keys, BUCKET], "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before", "_break")


def across(df: DataFrame, ranges: Ranges, order: list[str], sums: dict | None = None, ahead: dict | None = None, after: dict | None = None, before: dict | None = None) -> DataFrame:
    """Adds what a row takes from the others of its key, over all ranges: `sums`, running aggregates up to and with each
    row; `ahead`, aggregates of all rows after it; `after` and `before`, values of the next row and of the one before it,
    null where there is none.

    Aggregates map a name to ('sum', 'min' or 'max', column), a sum over no rows being 0; neighbours map it to a column.
    Each range works by itself, and what it takes from the others is added from one row a range of a hot key. All of them
    come from one such summary, as each summary works out `df` once more: what can be asked for at once should be.
    """
    keys = ranges.keys
    of = {"sum": F.sum, "min": F.min, "max": F.max}
    both = {"min": F.least, "max": F.greatest, "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}
    sums, ahead, after, before = (x or {} for x in (sums, ahead, after, before))
    aggregates, neighbours = sums | ahead, after | before
    up = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    # Looking ahead, rows are taken backwards: a frame that grows is summed as it grows, one that shrinks anew for each row.
    down = Window.partitionBy(*keys, BUCKET).orderBy(*[F.desc(c) for c in order])
    frames = dict.fromkeys(sums, up.rowsBetween(Window.unboundedPreceding, 0)) | dict.fromkeys(ahead, down.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumns({f"_v_{n}": c for n, (_, c) in aggregates.items()})
    steps = dict.fromkeys(after, F.lead) | dict.fromkeys(before, F.lag)
    local = df.withColumns({n: of[f](f"_v_{n}").over(frames[n]) for n, (f, _) in aggregates.items()} | {n: steps[n](c).over(up) for n, c in neighbours.items()} | {f"_edge_{n}": steps[n](F.lit(1)).over(up).isNull() for n in neighbours if ranges.split})
    extra = [f"_v_{n}" for n in aggregates]
    if ranges.split:
        hot = df.join(F.broadcast(ranges.cuts.select(*keys)), keys, "left_semi")
        ends = {n: (F.min_by if n in after else F.max_by)(c, F.struct(*order)) for n, c in neighbours.items()}
        each = hot.groupBy(*keys, BUCKET).agg(*[of[f](f"_v_{n}").alias(f"_v_{n}") for n, (f, _) in aggregates.items()], *[c.alias(f"_v_{n}") for n, c in ends.items()])
        by_range = Window.partitionBy(*keys).orderBy(BUCKET)
        earlier, later = by_range.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys).orderBy(F.desc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
        others = {n: of[f](f"_v_{n}").over(later if n in ahead else earlier) for n, (f, _) in aggregates.items()} | {n: steps[n](f"_v_{n}").over(by_range) for n in neighbours}
        local = local.join(F.broadcast(each.select(*keys, BUCKET, *[c.alias(f"_o_{n}") for n, c in others.items()])), [*keys, BUCKET], "left")
        local = local.withColumns({n: both[f](F.col(n), F.col(f"_o_{n}")) for n, (f, _) in aggregates.items()} | {n: F.when(F.col(f"_edge_{n}"), F.col(f"_o_{n}")).otherwise(F.col(n)) for n in neighbours})
        extra += [f"_o_{n}" for n in others] + [f"_edge_{n}" for n in neighbours]
    return local.withColumns({n: F.coalesce(n, F.lit(0)) for n, (f, _) in aggregates.items() if f == "sum"}).drop(*extra)


def following(df: DataFrame, ranges: Ranges, order: list[str], value: str, name: str, back: bool = False) -> DataFrame:
    """Adds `value` of the key's next row (of the one before if `back`), null where there is none (see across)."""
    return across(df, ranges, order, **{"before" if back else "after": {name: value}})


def running(df: DataFrame, ranges: Ranges, order: list[str], outputs: dict[str, tuple[str, Column]], ahead: bool = False) -> DataFrame:
    """Adds running aggregates of a key's rows up to and with each row, or of all rows after it (`ahead`; see across)."""
    return across(df, ranges, order, **{"ahead" if ahead else "sums": outputs})


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, number from 0) of the different keys in their order. Only keys are moved: they are sorted into ranges, which
    are kept (checkpoint), as the ranges come from a sample and are read twice; the ranges' counts are one row each."""
    from dialoom.session import checkpointed

    placed = checkpointed(df.select(key).distinct().repartitionByRange(key).withColumn("_b", F.spark_partition_id()))
    local = placed.withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy(key)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_b").count().select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(offsets), "_b").select(key, (F.col("_rn") + F.col("_before") - 1).alias(name))
