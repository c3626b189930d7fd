"""Runs of events that say the same (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.labels import without_repeats
from dialoom.llm.text import HESITATION, is_empty, tokens
from dialoom.operators.sequence import BUCKET, MIN_ROWS, Ranges, collapse_runs, find_ranges
from dialoom.session import checkpointed


def canonical(text: Column) -> Column:
    """Words without case, punctuation, apostrophes and hesitation sounds."""
    words = F.filter(tokens(text), lambda w: ~w.rlike(HESITATION) & ~w.isin("um", "er"))
    return F.transform(words, lambda w: F.translate(w, "'", ""))


def joined(words: Column) -> Column:
    """The value that is compared: words without the blanks between them; numbers stay apart."""
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"^\d"), F.concat(F.lit("#"), w, F.lit("#"))).otherwise(w)), "")


def slip(a: Column, b: Column) -> Column:
    """One letter more, less or other, or two neighbouring letters swapped; not in words with digits."""
    swapped = (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2) & (F.array_join(F.array_sort(F.split(a, "")), "") == F.array_join(F.array_sort(F.split(b, "")), ""))
    return (F.greatest(F.length(a), F.length(b)) >= 4) & ~a.rlike(r"\d") & ~b.rlike(r"\d") & ((F.levenshtein(a, b) == 1) | swapped)


def _pairs(events: DataFrame, ranges: Ranges, max_gap: int) -> DataFrame:
    """Neighbouring events with equally many words of which each differing one may be a slip's or two slips' work
    away from the other: dialogue, both texts' hashes and the differing words."""
    cols = ["_at", "_words", "_value", "_text"]
    w = Window.partitionBy(*ranges.keys, BUCKET).orderBy("_at", "ord")
    near = events.select("*", F.lag(F.struct(*cols)).over(w).alias("_p"), F.row_number().over(w).alias("_rn"))
    found = near.select("dialogue_id", *cols, "_p")
    if ranges.split:  # the last event of a range and the first of the next: two rows for each range
        edge = near.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*ranges.keys, BUCKET))).filter("_rn = 1 or _rn = _rows")
        e = Window.partitionBy(*ranges.keys).orderBy(BUCKET, "_rn")
        edge = edge.withColumn("_p", F.lag(F.struct(*cols)).over(e)).filter("_rn = 1").select("dialogue_id", *cols, "_p")
        found = found.unionByName(edge)
    close = (F.col("_at") - F.col("_p._at") <= max_gap) & (F.col("_value") != F.col("_p._value")) & (F.size("_words") == F.size("_p._words"))
    zipped = F.transform(F.arrays_zip(F.col("_words").alias("a"), F.col("_p._words").alias("b")), lambda x, i: F.struct(i.alias("at"), x.a.alias("a"), x.b.alias("b")))
    found = found.filter(close).withColumn("_diff", F.filter(zipped, lambda x: x.a != x.b))
    found = found.filter(F.forall("_diff", lambda x: ~x.a.rlike(r"\d") & ~x.b.rlike(r"\d") & (F.greatest(F.length(x.a), F.length(x.b)) >= 4) & (F.levenshtein(x.a, x.b, 4) >= 0)))
    return found.select("dialogue_id", F.col("_text").alias("text_a"), F.col("_p._text").alias("text_b"), F.explode("_diff").alias("d")).select("dialogue_id", "text_a", "text_b", "d.at", "d.a", "d.b")


def _text(words: Column) -> Column:
    return F.xxhash64(F.array_join(words, " "))


def _corrections(asked: DataFrame, texts: DataFrame, rarer: int) -> DataFrame:
    """The words that each asked word may be a misspelling of: word, right, hits (texts that exist corrected), n.

    `texts` holds each distinct text once: _text, _words, c (its events, at most `rarer` of a dialogue), dialogues.
    A text counts against a correction unless the corrected text exists and is at least `rarer` times as frequent;
    a word is one of its own if two such texts stand in several dialogues each, or one whose corrected text is unknown.
    """
    words = texts.select("c", F.explode(F.array_distinct("_words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"))
    words = words.filter((F.length("word") >= 3) & ~F.col("word").rlike(r"\d"))
    left_out = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, F.length("word"))))
    keys = words.withColumn("key", F.explode(F.array_distinct(F.concat(F.array("word"), left_out))))
    right = keys.select("key", F.col("word").alias("right"), F.col("n").alias("n_right"), F.col("c").alias("c_right"))
    may = keys.join(asked, "word", "left_semi").join(right, "key").filter((F.col("word") != F.col("right")) & ((F.col("n") * rarer <= F.col("n_right")) | (F.col("c") * rarer <= F.col("c_right"))))
    may = may.select("word", "right", "n_right").distinct().filter(slip(F.col("word"), F.col("right")))
    used = texts.select("*", F.explode(F.array_distinct("_words")).alias("word")).join(may, "word")
    used = used.select("word", "right", "n_right", "c", "dialogues", F.expr("xxhash64(array_join(transform(_words, x -> if(x = word, right, x)), ' '))").alias("_text"))
    used = used.join(texts.select("_text", F.col("c").alias("c_other")), "_text", "left")
    own = F.coalesce(F.col("c_other") < F.col("c") * rarer, F.lit(True))
    kept = used.groupBy("word", "right", "n_right").agg(F.count("c_other").alias("hits"), F.count(F.when(own, 1)).alias("n_own"), F.sum(F.when(own & (F.col("dialogues") > 1), F.when(F.col("c_other").isNull(), 2).otherwise(1)).otherwise(0)).alias("n_kept"))
    kept = kept.filter((F.col("n_own") * rarer <= F.col("n_right")) & (F.col("n_kept") < 2))
    return kept.join(kept.select(F.col("word").alias("right")), "right", "left_anti").select("word", "right", "hits", F.col("n_right").alias("n"))


def repeated_events(events: DataFrame, max_gap_ms: int = 60_000, rarer: int = 4, min_rows: int = MIN_ROWS, checkpoint=checkpointed) -> DataFrame:
    """Runs of two or more neighbouring events of a dialogue and channel that say the same: dialogue_id, channel,
    first_ms, last_ms, n_events.

    Events are ordered by time, then `ord`; a null channel is 0; events without a time or without a word are left
    out first; repeated rows count once; an empty table gives an empty result; extra columns are ignored.

    A misspelt word is told from another word by the corpus: where neighbouring texts differ in a word, each of the
    two is looked up by itself among the words of all distinct texts that are one slip away (_corrections), and both
    are written as the word that both may stand for. Only those few words are looked up. Then runs are found by the
    difference of row numbers on the canonical texts (collapse_runs), in ranges of time for a hot dialogue.
    """
    key = ["dialogue_id", "ord"]
    raw = events.select(*key, F.col("timestamp_ms").alias("_at"), F.coalesce("channel", F.lit(0)).alias("channel"), "prediction")
    raw = raw.filter(F.col("_at").isNotNull() & F.col("dialogue_id").isNotNull() & ~is_empty(F.col("prediction")))
    ranges = find_ranges(raw, ["dialogue_id", "channel"], "_at", min_rows)
    once = without_repeats(raw, key).withColumn("_words", canonical(F.col("prediction"))).drop("prediction")
    once = checkpoint(ranges.assign(once.withColumns({"_value": joined(F.col("_words")), "_text": _text(F.col("_words"))})))  # read three times
    pairs = checkpoint(_pairs(once, ranges, max_gap_ms))
    by_dialogue = once.groupBy("_text", "dialogue_id").agg(F.count(F.lit(1)).alias("c"), F.first("_words").alias("_words"))
    texts = checkpoint(by_dialogue.groupBy("_text").agg(F.sum(F.least("c", F.lit(rarer))).alias("c"), F.count(F.lit(1)).alias("dialogues"), F.first("_words").alias("_words")))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("word")).distinct()
    known = _corrections(asked, texts, rarer)
    itself = asked.select("word", F.col("word").alias("right"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("n"))
    may = checkpoint(known.unionByName(itself))  # read twice
    a = may.select(F.col("word").alias("a"), "right", F.col("hits").alias("hits_a"), F.col("n").alias("n_a"))
    b = may.select(F.col("word").alias("b"), "right", F.col("hits").alias("hits_b"), F.col("n").alias("n_b"))
    best = pairs.select("a", "b").distinct().join(a, "a").join(b, ["b", "right"]).groupBy("a", "b")
    best = best.agg(F.max(F.struct(F.col("right").isin(F.col("a"), F.col("b")), F.col("hits_a") + F.col("hits_b"), F.greatest("n_a", "n_b"), "right"))["right"].alias("right"))
    known = pairs.join(best, ["a", "b"])
    changed = F.filter(F.array(F.struct(F.col("text_a").alias("text"), F.col("a").alias("word")), F.struct(F.col("text_b").alias("text"), F.col("b").alias("word"))), lambda x: x.word != F.col("right"))
    fixes = (
        known.select("dialogue_id", "at", "right", F.explode(changed).alias("f"))
        .groupBy("dialogue_id", F.col("f.text").alias("_text"), "at")
        .agg(F.max("right").alias("right"))
        .groupBy("dialogue_id", "_text")
        .agg(F.map_from_entries(F.collect_list(F.struct("at", "right"))).alias("_fix"))  # words of one text at most
    )
    fixed = once.join(fixes, ["dialogue_id", "_text"], "left")
    words = F.transform("_words", lambda w, i: F.coalesce(F.try_element_at("_fix", i), w))
    fixed = fixed.withColumn("_value", F.when(F.col("_fix").isNull(), F.col("_value")).otherwise(joined(words))).select("dialogue_id", "channel", "ord", "_at", "_value", BUCKET)
    runs = collapse_runs(fixed, ranges, ["_at", "ord"], "_value", "_at", max_gap_ms, {})
    return runs.filter("n >= 2").select("dialogue_id", "channel", F.col("first_at").alias("first_ms"), F.col("last_at").alias("last_ms"), F.col("n").alias("n_events"))
