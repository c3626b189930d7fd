"""Splitting oversized examples at pauses (problem 5)."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.operators.frames import given_events, in_order, moved

TEXT_SILENT = (3, 0)  # text pad, end-of-text pad
LIMIT, OVERLAP, PAUSE = 512, 25, 13


def silence_table(silence: DataFrame) -> list[list[int]]:
    """Silence codes of the codebooks 0 to 7. The table has a few codes for each codebook and doesn't grow; a
    larger one is refused."""
    rows = silence.select("codebook", "code").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more silence codes than a codec has")
    return [sorted(r.code for r in rows if r.codebook == k) for k in range(8)]


def silent_frames(streams: str, table: list[list[int]]) -> Column:
    """Numbers of the silent frames of a stream matrix, counted from 0. A frame is one column: its text id and its 16
    codes as they stand. The checks stop at the first row that isn't silent, so most frames cost one or two."""
    codes = [F.array(*[F.lit(c) for c in row]).cast("array<int>") for row in table]
    row = lambda k: F.get(F.col(streams), k)

    def silent(i: Column) -> Column:
        ok = F.get(row(0), i).isin(*TEXT_SILENT)
        for k in range(16):
            ok = ok & F.array_contains(codes[k % 8], F.get(row(1 + k), i))
        return F.coalesce(ok, F.lit(False))

    n = F.size(row(0))
    return F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), silent)).otherwise(F.array().cast("array<int>"))


def stretches(quiet: list[int], least: int = PAUSE) -> list[tuple[int, int]]:
    """(first, last) of the stretches of at least `least` consecutive numbers in an ascending list."""
    import numpy as np

    q = np.asarray(quiet, dtype=np.int64)
    if not len(q):
        return []
    new = np.flatnonzero(np.diff(q) != 1)
    firsts, lasts = q[np.r_[0, new + 1]], q[np.r_[new, len(q) - 1]]
    keep = lasts - firsts + 1 >= least
    return list(zip(firsts[keep].tolist(), lasts[keep].tolist()))


def cut_points(n: int, pauses: list[tuple[int, int]], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces [from, to) of n frames: at most `limit` frames each, each repeating the last `overlap` of the one before.

    Always the fewest pieces that fit. Equal-length targets are placed, and each may move as far as the limit leaves
    room for (the frames that the pieces have to spare); a cut lies within a pause if the frames on both its sides are
    silent. Of all divisions the one is taken with the most cuts within pauses, then with the longest pauses, then with
    cuts nearest to the middle of the pause or, outside pauses, to the target. The even targets always fit, so no piece
    has to be added.

    With the fewest pieces, cut i lies in the window [low_i, low_i + spare], and no piece breaks the limit if and only
    if the cuts' offsets in their windows don't grow. So the best division is found by one pass over the targets: best
    score up to a cut at each offset, from the best at this or any larger offset of the cut before.
    """
    import numpy as np

    if limit <= overlap:
        raise ValueError("the limit must be larger than the overlap")
    if n <= limit:
        return [(0, n)] if n else []
    step = limit - overlap
    count = -(-(n - overlap) // step)
    spare = count * step - (n - overlap)
    offset, at, picked, score = np.arange(spare + 1), 0, [], np.zeros(spare + 1)
    for i in range(1, count):
        low = n - (count - i) * step
        here = low + offset
        target = overlap + i * (n - overlap) / count
        worth = -np.abs(here - target) / limit
        while at < len(pauses) and pauses[at][1] < low:
            at += 1
        for first, last in pauses[at:]:
            if first >= low + spare:
                break
            a, b = max(first + 1 - low, 0), min(last - low, spare) + 1
            if a < b:
                middle = (first + last + 1) / 2
                worth[a:b] = 1e4 + min(last - first + 1, limit) * 4 - np.abs(here[a:b] - middle) / limit
        best = np.maximum.accumulate(score[::-1])[::-1]
        # The offset that the best comes from: the nearest one not below, of those that reach it.
        source = np.minimum.accumulate(np.where(score == best, offset, spare)[::-1])[::-1]
        picked.append(source)
        score = best + worth
    j, cuts = int(np.argmax(score)), []
    for i in range(count - 1, 0, -1):
        cuts.append(n - (count - i) * step + j)
        j = int(picked[i - 1][j])
    ends = [*reversed(cuts), n]
    return [(0 if i == 0 else ends[i - 1] - overlap, e) for i, e in enumerate(ends)]


DIVISION = "struct<pauses:array<struct<first:int,last:int>>,pieces:array<struct<a:int,b:int>>>"


def division(streams: str, table: list[list[int]], limit: int = LIMIT, overlap: int = OVERLAP, least: int = PAUSE) -> Column:
    """Pauses and pieces of a stream matrix. The silent frames are found by built-in functions; only their numbers go
    through Python, which pairs them to pauses and cuts at them."""

    @F.pandas_udf(DIVISION)
    def divided(n: pd.Series, quiet: pd.Series) -> pd.DataFrame:
        rows = []
        for k, q in zip(n, quiet):
            pauses = stretches(q, least)
            rows.append(([{"first": a, "last": b} for a, b in pauses], [{"a": a, "b": b} for a, b in cut_points(int(k), pauses, limit, overlap)]))
        return pd.DataFrame(rows, columns=["pauses", "pieces"])

    return divided(F.size(F.get(streams, 0)), silent_frames(streams, table))


def oversized(examples: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows that really have more than `limit` frames, whatever num_frames says. Null streams have no frames."""
    return examples.filter((F.size(F.get("streams", 0)) > limit) & F.col("example_id").isNotNull())


def example_pauses(examples: DataFrame, silence: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, least: int = PAUSE) -> DataFrame:
    """One row per oversized example: example_id, n_frames, pauses, pieces (see division). Repeated rows are dropped
    after the division, so the wide streams are never shuffled."""
    cut = oversized(examples, limit).select("example_id", F.size(F.get("streams", 0)).alias("n_frames"), division("streams", silence_table(silence), limit, overlap, least).alias("d"))
    return cut.dropDuplicates(["example_id"]).select("example_id", "n_frames", "d.pauses", "d.pieces")


def pause_list(examples: DataFrame, silence: DataFrame, limit: int = LIMIT, least: int = PAUSE) -> DataFrame:
    """(example_id, pause_frame): the boundaries at which oversized examples may be cut. explode_outer, as for explode
    the optimizer would run the division a second time in a filter below."""
    found = example_pauses(examples, silence, limit, least=least)
    return found.select("example_id", F.explode_outer("pauses.first").alias("pause_frame")).filter("pause_frame is not null")


def one_copy(examples: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Each example once, without shuffling its streams where that can be avoided.

    Rows read from files know their file and number: the copies to leave out are found by ids alone, and at most
    `most` of them (checked) are broadcast. Beyond that, or for rows that don't come from files, rows are shuffled by
    example_id; the result is the same, as copies are equal.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", "_metadata.row_index")
    try:
        x = examples.withColumn("_place", place)
        ids = x.select("example_id", "_place")
    except AnalysisException:
        return examples.dropDuplicates(["example_id"])
    twice = ids.groupBy("example_id").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("example_id", "_first")
    if twice.limit(most + 1).count() > most:
        return examples.dropDuplicates(["example_id"])
    return x.join(F.broadcast(twice), "example_id", "left").filter("_first is null or _first = _place").drop("_place", "_first")


def pieces(examples: DataFrame, silence: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, least: int = PAUSE) -> DataFrame:
    """Pieces of the oversized examples: example_id, piece, frame_from, frame_to, streams, labels, events.

    An event belongs to the piece in which its frame first comes up (the repeated frames belong to the earlier piece);
    it keeps its fields, and its `pos` is counted from the piece's start. Events out of the example's range have no
    piece. Null positions are no events; equal ones keep the table's order. An empty table gives an empty result, extra
    columns are ignored.

    Streams are sliced by built-in functions where they lie. posexplode_outer, as for posexplode the optimizer would
    run the division again in a filter below.
    """
    x = one_copy(oversized(examples, limit))
    x = given_events(x.withColumn("_d", division("streams", silence_table(silence), limit, overlap, least)), "example_id", "streams", "labels", "_d")
    x = x.select("example_id", "streams", "labels", "events", F.posexplode_outer("_d.pieces").alias("piece", "_b")).filter("_b is not null")
    a, b = F.col("_b.a"), F.col("_b.b")
    own = F.when(F.col("piece") == 0, 0).otherwise(a + overlap)
    part = lambda c: F.transform(c, lambda r: F.slice(r, a + 1, b - a))
    return x.select(
        "example_id",
        "piece",
        a.alias("frame_from"),
        b.alias("frame_to"),
        part("streams").alias("streams"),
        part("labels").alias("labels"),
        moved(in_order(F.filter("events", lambda e: (e.pos >= own) & (e.pos < b))), -a).alias("events"),
    )
