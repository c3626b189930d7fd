"""Word transcripts: coercion, units, speakers, merged streams, runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.labels import side_of, strip, without_repeats
from dialoom.operators.sequence import MIN_ROWS, Ranges, across, find_ranges, ranked, stretches


def transcript(words: DataFrame, call_gap_s: float | None = None, min_rows: int = MIN_ROWS) -> DataFrame:
    """Rows of `words` as a transcript: did, idx, speaker, word, start, end.

    Repeated rows count once; rows without a known side, or with no end or one before the start, are left out. `did` is
    the unit of all further operators: the dialogue, or with `call_gap_s` a call of it, where it is cut if no word starts
    for longer than that. What grows with the square of a unit's length, as the contexts of its ticks do, wants calls on
    lines that record call after call. `idx` is the list order inside the unit, which need not be the order in time.

    Dialogues too long for one task are numbered in ranges; the ranges found here go along (see in_ranges).
    """
    key = ["dialogue_id", "word_idx"]
    rows = words.select(*key, side_of(F.col("speaker")).alias("speaker"), strip(F.col("word")).alias("word"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), F.col("word").isNotNull().alias("_has"))
    ok = rows.filter("speaker is not null and end >= start and _has and dialogue_id is not null and word_idx is not null").drop("_has")
    once = without_repeats(ok, key)
    ranges = find_ranges(ok, ["dialogue_id"], "word_idx" if call_gap_s is None else "start", min_rows)
    if call_gap_s is None:
        units = ranked(ranges.assign(once), ranges, ["word_idx"], "_n").withColumn("did", F.col("dialogue_id"))
        found = Ranges(["did"], "idx", ranges.cuts and ranges.cuts.withColumnRenamed("dialogue_id", "did"))
    else:
        in_calls = lambda x: stretches(ranges.assign(x), ranges, ["start", "word_idx"], "start", call_gap_s, "_call").withColumn("did", F.concat_ws("#", "dialogue_id", F.col("_call").cast("string"))).drop("_bucket")
        named = in_calls(once)
        within = Ranges(["did"], "word_idx")
        if ranges.split:  # a long call is of a long dialogue; repeated rows don't matter for where it is cut
            within = find_ranges(in_calls(ok.join(F.broadcast(ranges.cuts.select("dialogue_id")), "dialogue_id", "left_semi")), ["did"], "word_idx", min_rows)
        units = ranked(within.assign(named), within, ["word_idx"], "_n")
        found = Ranges(["did"], "idx", within.cuts)
    t = units.select("did", (F.col("_n") - 1).cast("int").alias("idx"), "speaker", "word", "start", "end")
    t._ranges = found
    return t


def in_ranges(t: DataFrame, min_rows: int = MIN_ROWS) -> tuple[DataFrame, Ranges]:
    """A transcript with the range of each row, by list order: the ranges that transcript() found, or looked for now.
    Cut points of the table's word numbers serve for the unit's too, as they only have to divide it."""
    ranges = t.__dict__.get("_ranges") or find_ranges(t, ["did"], "idx", min_rows)
    return ranges.assign(t, "idx"), ranges


def from_alignments(alignments: DataFrame, speaker: str) -> DataFrame:
    """Alignments of one speaker (did, idx, text, span struct<start, end>, tag) as a transcript; the tag is ignored."""
    return alignments.select("did", "idx", F.lit(speaker).alias("speaker"), F.col("text").cast("string").alias("word"), F.col("span.start").cast("double").alias("start"), F.col("span.end").cast("double").alias("end"))


def merged_streams(*streams: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Words of several transcripts in one stream: did, pos, speaker, word, end, ordered by end, then by the number of
    their stream, then by list order (O2, U4). Of a single transcript, A's words are the first stream."""
    parts = [s.withColumn("_s", F.lit(i)) for i, s in enumerate(streams)] if len(streams) > 1 else [streams[0].withColumn("_s", F.when(F.col("speaker") == "A", 0).otherwise(1))]
    flat = reduce(DataFrame.unionByName, parts)
    hot = any(s.__dict__["_ranges"].split if "_ranges" in s.__dict__ else True for s in streams)
    ranges = find_ranges(flat, ["did"], "end", min_rows) if hot else Ranges(["did"], "end")
    return ranked(ranges.assign(flat), ranges, ["end", "_s", "idx"], "_n").select("did", (F.col("_n") - 1).cast("int").alias("pos"), "speaker", "word", "end")


def speaker_coverage(t: DataFrame) -> DataFrame:
    """Words and speakers of each unit; `complete` if both sides speak."""
    sides = [F.max((F.col("speaker") == s).cast("int")) for s in "AB"]
    g = t.groupBy("did").agg(F.count(F.lit(1)).alias("n_words"), (sides[0] + sides[1]).cast("long").alias("n_speakers"), F.max("end").alias("max_end"))
    return g.withColumn("complete", F.col("n_speakers") == 2)


def require_speakers(t: DataFrame, strict: bool = True) -> DataFrame:
    """Units in which both sides speak. Strict: a unit with one side is an error naming it; else it is left out."""
    lacking = speaker_coverage(t).filter("not complete").select("did", F.lit(True).alias("_lacking"))
    x = t.join(lacking, "did", "left")
    if strict:
        return x.withColumn("word", F.when(F.col("_lacking"), F.raise_error(F.concat(F.lit("a speaker is missing in "), F.col("did")))).otherwise(F.col("word"))).drop("_lacking")
    return x.filter("_lacking is null").drop("_lacking")


def run_columns(t: DataFrame, gap: float = 1.0, piece: Column | None = None, arrives: Column | None = None) -> tuple[DataFrame, Ranges]:
    """Adds to each word, in list order: run_no (from 1), starts (a run begins), run_from (first idx of its run),
    last_of_run, and fwd, how many of the following words continue the utterance, until the speaker changes or the ends
    lie `gap` seconds apart (W1-W3). One pass forwards, one backwards.

    `piece`, made from `starts`, and `arrives` are columns that the same passes sum up: `upto`, the bytes of the
    pieces up to and with the word, and `earliest`, the least `arrives` of the words listed later.
    """
    x, ranges = in_ranges(t)
    x = across(x.withColumn("_both", F.struct("speaker", "end")), ranges, ["idx"], after={"_next": "speaker"}, before={"_before": "_both"})
    x = x.withColumn("starts", F.col("_before").isNull() | (F.col("_before.speaker") != F.col("speaker")))
    brk = F.when((F.col("_before.speaker") != F.col("speaker")) | (F.col("end") - F.col("_before.end") >= gap), F.col("idx"))
    back = {"run_no": ("sum", F.col("starts").cast("int")), "run_from": ("max", F.when(F.col("starts"), F.col("idx")))}
    ahead = {"_brk": ("min", brk), "_rest": ("sum", F.lit(1))}
    if piece is not None:
        x, back["upto"] = x.withColumn("piece", piece), ("sum", F.octet_length(piece))
    if arrives is not None:
        x, ahead["earliest"] = x.withColumn("ka", arrives), ("min", arrives)
    x = across(x, ranges, ["idx"], sums=back, ahead=ahead)
    x = x.withColumn("fwd", F.coalesce(F.col("_brk") - F.col("idx") - 1, F.col("_rest"))).withColumn("last_of_run", F.coalesce(F.col("_next") != F.col("speaker"), F.lit(True)))
    return x.drop("_next", "_both", "_before", "_brk", "_rest"), ranges


def speaker_runs(t: DataFrame) -> DataFrame:
    """Consecutive words of one speaker in list order: did, run_no, speaker, n_words, run_text."""
    words = F.array_sort(F.collect_list(F.struct("idx", "word")))
    return run_columns(t)[0].groupBy("did", "run_no", "speaker").agg(F.count(F.lit(1)).alias("n_words"), F.array_join(words.getField("word"), " ").alias("run_text"))


def spoken_ratio(t: DataFrame) -> DataFrame:
    """Share of its utterance spoken at each word: did, idx, run_len, fwd, ratio (W2-W4). Looking back, only a
    change of speaker ends the utterance; looking ahead, a gap does too."""
    back = run_columns(t)[0].withColumn("run_len", F.col("idx") - F.col("run_from") + 1)
    return back.select("did", "idx", "run_len", "fwd", (F.col("run_len") / (F.col("run_len") + F.col("fwd"))).alias("ratio"))


def frame_of(seconds: Column, rate: float = 12.5) -> Column:
    """Frame of a time as floor division of doubles gives it (T6); not the same as seconds times rate."""
    y = F.lit(1 / rate)
    return F.round((seconds - (seconds % y)) / y).cast("int")
