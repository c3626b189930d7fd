"""Broken prompt and response pairs (problem 1)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.labels import without_repeats
from dialoom.llm.text import FUNCTION_WORDS, HESITATION, STAND_IN
from dialoom.session import checkpointed, spread

# Ways of declining, as a statement about the speaker's rules or as inability followed by a verb of
# answering. Inability with another verb ("not able to hold the room", "can't find a table") is an answer.
REFUSALS = [
    r"(?:can't|cannot|can not|won't|will not|am not able to|am unable to|not going to|not permitted to|not allowed to|must decline to|have to decline to|rather not|appropriate for me to|refuse to|decline to)(?: \w+)? (?:assist|help|respond|reply|engage|continue with|comment|discuss|answer|provide an answer|provide an? response)\b",
    r"\bas an? (?:large )?(?:language model|ai)\b|\ban ai assistant should\b",
    r"\bmy (?:guidelines|policies|policy|instructions|rules|programming)\b",
    r"\bpass on this one\b|^no comment\b|\bmust decline\b",
    r"\b(?:kann|darf|möchte|werde|will)(?: ich)?(?: \w+){0,5} nicht (?:\w+ ){0,2}(?:kommentieren|beantworten|antworten|helfen|weiterhelfen|eingehen)\b",
    r"\b(?:frage|anfrage|bitte|thema)(?: \w+){0,3} (?:kann|darf|möchte|werde) ich (?:leider |lieber )?nicht\b|\bals (?:ki|sprachmodell)\b|\bmeine (?:richtlinien|regeln|vorgaben|anweisungen)\b",
    r"\b(?:no puedo|no podré|prefiero no|no me es posible|no debo|no voy a|no me permiten)(?: \w+)? ?(?:comentar|responder|ayudar|contestar|continuar|hablar)\w*\b",
    r"\bmodelo de lenguaje\b|\bmis (?:normas|reglas|instrucciones|directrices|políticas)\b",
]


_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS))
_TOKEN = re.compile(r"[^\W_]+(?:[':][^\W_]+)*")
_HESITATION = re.compile(HESITATION)
_STAND_IN = re.compile(STAND_IN)
_LEAD = re.compile(r"^\s*(?:>+\s*|(?:[AB]|you said|question|q)\s*:\s*)+", re.I)
_SPEAKER = re.compile(r"^\s*\w+\s*:")
_LANGUAGES: dict[str, list[str]] = {}
for _x, _known in FUNCTION_WORDS.items():
    for _w in _known:
        _LANGUAGES.setdefault(_w, []).append(_x)


def words_of(text: str) -> list[str]:
    """Lower-case words without hesitation sounds."""
    return [w for w in _TOKEN.findall(text.lower().replace("’", "'")) if not _HESITATION.match(w)]


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two word lists, a row of the table at a time."""
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def copies(line: list[str], words: list[str]) -> bool:
    """Whether the words of a response give back the words of the last context line.

    Whole (with something added, up to about as much again), nearly whole (a fifth of the words may differ), or
    the beginning of it, the last word perhaps cut. Lines of under five words must come back whole, as many
    answers begin like them.
    """
    n, m = len(line), len(words)
    if n < 2 or not m:
        return False
    if line == words:
        return True
    if m > 2 * n + 4:
        return False
    a, b = " ".join(line), " ".join(words)
    if n >= 5 and f" {a} " in f" {b} ":
        return True
    if m >= 4 and m >= 0.5 * n and a.startswith(b):
        return True
    return n >= 5 and m >= 0.7 * n and common_words(line, words) >= 0.8 * n


def language(words: list[str]) -> dict[str, int]:
    """How many of the words are function words of each language."""
    out = dict.fromkeys(FUNCTION_WORDS, 0)
    for w in words:
        for x in _LANGUAGES.get(w, ()):
            out[x] += 1
    return out


def is_empty_text(text: str | None) -> bool:
    if not isinstance(text, str):
        return True
    plain = re.sub(r"[\W_]+", " ", text.lower()).strip()
    return not plain or bool(_STAND_IN.match(plain))


def row_defect(context: str | None, prediction: str | None) -> tuple[str | None, str]:
    """The defect that one event shows by itself, if any, and the words of the prediction."""
    if is_empty_text(prediction):
        return "empty", ""
    words = words_of(_LEAD.sub("", prediction))
    plain = " ".join(words)
    context = context if isinstance(context, str) else ""
    line = words_of(_SPEAKER.sub("", context.rstrip().rpartition("\n")[2]))
    if copies(line, words):
        return "copied", plain
    if _REFUSAL.search(plain):
        return "refusal", plain
    theirs, mine = language(context.lower().split()), language(words)
    home = max(theirs, key=theirs.get)
    best = max(mine, key=mine.get)
    if theirs[home] and best != home and mine[best] >= mine[home] + 2:
        return "other_language", plain
    return None, plain


def strong_end(raw: Column) -> Column:
    return raw.rlike(r"[^.…][.!?][\"'”»)\s\p{Z}]*$") & ~raw.rlike(r"(?:\.\.|…)[\"'”»)\s\p{Z}]*$")


def _windows(k: int) -> Column:
    """All stretches of k words of the array `w`: their text and the number of their last word."""
    size = F.size("w")
    one = lambda i: F.struct(F.when(i <= size, F.array_join(F.slice("w", i - (k - 1), k), " ")).alias("gram"), i.alias("at"))
    return F.transform(F.sequence(F.lit(k), F.greatest(size, F.lit(k))), one)


def shortened(texts: DataFrame, least_mid: int = 3, least_rate: float = 0.02, checkpoint=checkpointed) -> DataFrame:
    """Texts that break off. Input: text (lower-case words joined by blanks), strong (ends like a sentence), spiked (its
    length is one at which far more texts stop than around), n. Output: one column, text.

    The distinct texts are sorted (by a range shuffle, so equal beginnings spread over tasks) and compared with
    their neighbours: a text that shares everything before its last word with one of them is likely a shortened
    version, as the last word may be cut. Slots like names and prices make many texts the only ones of their
    beginning, so the endings of all texts are judged, those of shared beginnings and those at a length limit on less
    evidence (one case instead of `least_mid`). A text breaks off if its ending is one at which the texts of this corpus go on and
    don't end: the last three words are looked up among the endings of complete texts; where too few cases are
    known, the last two, then one. A last word unknown to the corpus counts as cut if, after the word before it,
    it begins a known one. A text seen once with a strong end is complete.
    """
    one = texts.groupBy("text").agg(F.max("strong").alias("strong"), F.max("spiked").alias("spiked"), F.sum("n").alias("n"))
    spread = one.repartitionByRange("text").withColumn("_b", F.spark_partition_id())
    spread = checkpoint(spread)  # the ranges come from a sample; fixed here, so that a recomputed task keeps them
    w = Window.partitionBy("_b").orderBy("text")
    edges = spread.groupBy("_b").agg(F.min("text").alias("_first"), F.max("text").alias("_last"))  # a row a range
    by_range = Window.orderBy("_b")
    edges = edges.select("_b", F.lag("_last").over(by_range).alias("_above"), F.lead("_first").over(by_range).alias("_below"))
    placed = spread.join(F.broadcast(edges), "_b").select(
        "text", "strong", "spiked", F.coalesce(F.lag("text").over(w), "_above").alias("_above"), F.coalesce(F.lead("text").over(w), "_below").alias("_below")
    )
    head = F.regexp_replace("text", r"[^ ]+$", "")
    shared = F.coalesce(F.col("_above").startswith(head), F.lit(False)) | F.coalesce(F.col("_below").startswith(head), F.lit(False))
    words = F.split("text", " ")
    grams = lambda k: F.when(F.size(words) >= k, F.array_join(F.slice(words, -k, k), " "))
    candidates = placed.filter(~F.col("strong") & (F.col("text") != "")).select("text", (shared | F.col("spiked")).alias("shared"), *[grams(k).alias(f"g{k}") for k in (1, 2, 3)])
    candidates = checkpoint(candidates)  # read five times below
    # Endings and continuations of every text, counted before anything is shuffled.
    t = spread.filter("text <> ''").select(words.alias("w"), "strong", "n")
    each = t.select(
        "strong",
        "n",
        F.size("w").alias("size"),
        F.explode(F.flatten(F.array(*[_windows(k) for k in (1, 2, 3)]))).alias("x"),
    ).filter("x.gram is not null")
    counts = each.groupBy(F.col("x.gram").alias("gram")).agg(
        F.sum(F.when(F.col("x.at") < F.col("size"), F.col("n")).otherwise(0)).alias("mid"),
        F.sum(F.when((F.col("x.at") == F.col("size")) & F.col("strong"), F.col("n")).otherwise(0)).alias("end"),
    )
    needed = candidates.select(F.explode(F.array("g1", "g2", "g3")).alias("gram")).filter("gram is not null").distinct()
    counts = checkpoint(counts)
    found = counts.join(needed, "gram")
    judged = candidates
    for k in (3, 2, 1):
        judged = judged.join(found.select(F.col("gram").alias(f"g{k}"), F.col("mid").alias(f"mid{k}"), F.col("end").alias(f"end{k}")), f"g{k}", "left")
    least = F.when(F.col("shared"), 1).otherwise(least_mid)
    end, mid, rate = {}, {}, {}
    for k in (1, 2, 3):
        end[k], mid[k] = F.coalesce(f"end{k}", F.lit(0)), F.coalesce(f"mid{k}", F.lit(0))
        rate[k] = end[k] / F.greatest(end[k] + mid[k], F.lit(1))
    # Ends that the shorter ending leads to expect, of which the longer one shows none.
    missed = lambda k: (end[k] == 0) & (mid[k] >= least) & ((rate[k - 1] < least_rate) | (mid[k] * rate[k - 1] >= 4))
    by_one = F.when(end[1] + mid[1] >= least_mid, rate[1] < least_rate)
    verdict = (
        F.when((end[3] >= 1) & (rate[3] >= least_rate), False)
        .when(missed(3), True)
        .when((end[2] >= 1) & (rate[2] >= least_rate), False)
        .when(missed(2), True)
        .otherwise(by_one)
    )
    judged = judged.withColumn("_cut", verdict)
    # Known pairs of words, the second cut anywhere.
    known = counts.filter(F.col("gram").rlike("^[^ ]+ [^ ]+$") & (F.col("mid") + F.col("end") >= least_mid)).select("gram", F.locate(" ", "gram").alias("gap"))
    begun = known.select(F.explode(F.transform(F.sequence(F.col("gap") + 1, F.greatest(F.length("gram") - 1, F.col("gap") + 1)), lambda i: F.substring("gram", F.lit(1), i))).alias("g2")).distinct()
    unknown = judged.filter("_cut is null").select("text", "g2").join(begun, "g2", "left_semi")
    return judged.filter("_cut").select("text").unionByName(unknown.select("text"))


def events_once(events: DataFrame) -> DataFrame:
    key = ["dialogue_id", "ord"]
    return without_repeats(spread(events.select(*key, "conversation_context", "prediction"), *key), key)


def defects(events: DataFrame, checkpoint=checkpointed) -> DataFrame:
    """Defective predictions: dialogue_id, ord, defect.

    Checked in this order, as an event has one defect at most: empty, copied, refusal, other_language, truncated.
    The language is told from function words of the prediction and of the context; it takes two more of another
    language than of the context's. A null or empty context can't be copied and has no language. An empty table
    gives an empty result; extra columns are ignored; a repeated row counts once.

    Copy, refusal and language look at one row; their result is kept (checkpoint), as it is read twice. Only the search for shortened texts shuffles, each
    different text once.
    """
    def judge(batches):
        for pdf in batches:
            found = [row_defect(c, p) for c, p in zip(pdf["conversation_context"], pdf["prediction"])]
            yield pd.DataFrame({"dialogue_id": pdf["dialogue_id"], "ord": pdf["ord"].astype("Int64"), "defect": [x[0] for x in found], "text": [x[1] for x in found], "strong": pdf["strong"], "n_chars": pdf["n_chars"]})

    once = events_once(events).withColumns({"strong": F.coalesce(strong_end(F.col("prediction")), F.lit(False)), "n_chars": F.coalesce(F.length(F.rtrim("prediction")), F.lit(0))})
    rowwise = checkpoint(once.mapInPandas(judge, "dialogue_id string, ord int, defect string, text string, strong boolean, n_chars int"))
    limits = F.broadcast(spikes(rowwise.filter("not strong and n_chars > 0").select("text", "n_chars")).select("n_chars", F.lit(True).alias("spiked")))  # a row for a length
    sound = rowwise.filter("defect is null and text <> ''")
    lengths = sound.groupBy("text", "strong", "n_chars").agg(F.count(F.lit(1)).alias("n")).join(limits, "n_chars", "left")
    cut = shortened(lengths.select("text", "strong", F.coalesce("spiked", F.lit(False)).alias("spiked"), "n"), checkpoint=checkpoint)
    truncated = sound.filter("not strong").join(cut, "text", "left_semi").select("dialogue_id", "ord", F.lit("truncated").alias("defect"))
    return rowwise.filter("defect is not null").select("dialogue_id", "ord", "defect").unionByName(truncated)


def spikes(open_ended: DataFrame, window: int = 8, times: float = 4.0, least: int = 20) -> DataFrame:
    """Lengths at which far more different texts stop than at each of the lengths around, on average: n_chars, n, usual. A
    spike shows a length limit. Input: text, n_chars. A row for each length, so the window runs over few rows."""
    counts = open_ended.distinct().groupBy("n_chars").agg(F.count(F.lit(1)).alias("n"))
    around = Window.orderBy("n_chars").rangeBetween(-window, window)
    usual = (F.sum("n").over(around) - F.col("n")) / F.lit(2 * window)
    return counts.withColumn("usual", usual).filter((F.col("n") >= least) & (F.col("n") >= times * F.col("usual")))


def length_spikes(events: DataFrame, window: int = 8, times: float = 4.0, least: int = 20) -> DataFrame:
    """Length limits of the predictions: lengths of texts without an end that are spikes. The same lengths count as
    evidence in `defects`."""
    open_ended = events_once(events).filter("prediction is not null").filter(~strong_end(F.col("prediction")))
    return spikes(open_ended.select(F.col("prediction").alias("text"), F.length(F.rtrim("prediction")).alias("n_chars")), window, times, least)
