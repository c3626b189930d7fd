"""Continuous periods and gaps of intervals that overlap, nest or leave holes (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.labels import side_of, to_ms, without_repeats
from dialoom.operators.sequence import BUCKET, MIN_ROWS, find_ranges, ranked


def periods_and_gaps(
    df: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    join_below: int = 200,
    gap_up_to: int = 60_000,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Periods and gaps per entity; columns: keys, kind ('period' or 'gap'), from_ms, to_ms.

    Starts and ends are ranked independently. If the start of rank r+1 lies after the end of rank r, the first r
    intervals have all ended before the next begins, so there is a hole. Holes under `join_below` are bridged;
    holes up to `gap_up_to` are listed; longer ones only divide periods.

    Rows with a null key, start or end, or an end before the start, take no part. Ties and repeated intervals
    change nothing. An empty input gives an empty result. Other columns of the input are ignored. `start` and
    `end` are whole numbers (milliseconds).

    A hot entity is ranked in ranges of time (see sequence.py). Starts and ends meet by (entity, rank), a key with
    two rows, so that shuffle has no hot key.
    """
    ok = df.select(*keys, F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"))
    for c in (*keys, "_s", "_e"):
        ok = ok.filter(F.col(c).isNotNull())
    ok = ok.filter("_e >= _s")
    ranges = find_ranges(ok, keys, "_s", min_rows)
    starts = ranked(ranges.assign(ok.select(*keys, F.col("_s").alias("_at")), "_at"), ranges, ["_at"])
    ends = ranked(ranges.assign(ok.select(*keys, F.col("_e").alias("_at")), "_at"), ranges, ["_at"])
    pairs = (
        starts.select(*keys, (F.col("_rank") - 1).alias("_rank"), F.col("_at").alias("_next"), F.lit(None).cast("long").alias("_end"))
        .unionByName(ends.select(*keys, "_rank", F.lit(None).cast("long").alias("_next"), F.col("_at").alias("_end")))
        .groupBy(*keys, "_rank")
        .agg(F.max("_next").alias("_next"), F.max("_end").alias("_end"))
    )
    # Rank 0 opens the first period, the last rank closes the last one, holes do both.
    breaks = pairs.filter(F.col("_end").isNull() | F.col("_next").isNull() | (F.col("_next") - F.col("_end") >= join_below))
    if not ranges.split:  # no entity has more ranks than a task should order
        opened = breaks.withColumn("_from", F.lag("_next").over(Window.partitionBy(*keys).orderBy("_rank")))
    else:
        breaks = breaks.withColumn(BUCKET, F.floor(F.col("_rank") / F.lit(min_rows)))
        w = Window.partitionBy(*keys, BUCKET).orderBy("_rank")
        # The opening that each range hands on to the next one: one row for each `min_rows` ranks.
        carried = Window.partitionBy(*keys).orderBy(BUCKET)
        handed = (
            breaks.groupBy(*keys, BUCKET)
            .agg(F.max_by("_next", "_rank").alias("_last"))
            .select(*keys, BUCKET, F.lag("_last").over(carried).alias("_carried"))
            .filter(F.col(BUCKET) > 0)
        )
        opened = breaks.withColumn("_from", F.lag("_next").over(w)).join(handed, [*keys, BUCKET], "left").withColumn("_from", F.coalesce("_from", "_carried"))
    kinds = F.array(
        F.when(F.col("_end").isNotNull(), F.struct(F.lit("period").alias("kind"), F.col("_from").alias("from_ms"), F.col("_end").alias("to_ms"))),
        F.when(
            F.col("_next").isNotNull() & F.col("_end").isNotNull() & (F.col("_next") - F.col("_end") <= gap_up_to),
            F.struct(F.lit("gap").alias("kind"), F.col("_end").alias("from_ms"), F.col("_next").alias("to_ms")),
        ),
    )
    return opened.select(*keys, F.explode(F.array_compact(kinds)).alias("_x")).select(*keys, "_x.kind", "_x.from_ms", "_x.to_ms")


def speech_intervals(words: DataFrame) -> DataFrame:
    """Rows of `words` as (dialogue_id, side, start_ms, end_ms), each row once."""
    slim = without_repeats(words.select("dialogue_id", "word_idx", "speaker", "start_s", "end_s"), ["dialogue_id", "word_idx"])
    return slim.select("dialogue_id", side_of(F.col("speaker")).alias("side"), to_ms(F.col("start_s")).alias("start_ms"), to_ms(F.col("end_s")).alias("end_ms"))


def speech_periods(words: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Problem 2 over the words table: periods of speech and the gaps between them for each side of a dialogue."""
    return periods_and_gaps(speech_intervals(words), ["dialogue_id", "side"], "start_ms", "end_ms", min_rows=min_rows)
