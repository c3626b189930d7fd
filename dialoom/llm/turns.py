"""Speech transcripts into clean speaker turns (problem 4)."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.labels import side_of
from dialoom.llm.text import FUNCTION_WORDS, HESITATION, HESITATION_NOT_GERMAN, bare, is_in
from dialoom.operators.sequence import BUCKET, MIN_ROWS, collapse_runs, find_ranges
from dialoom.session import sized_broadcast

# The marks that a transcript row may hold besides a word, as the states of a small automaton:
# whole annotations, full time stamps, the two halves of an annotation over two rows, marks of speaker or turn.
WHOLE = r"\[[^\[\]]*\]|\(+[^()]*\)+|\{[^{}]*\}|<[^<>]*>|\*[^*]+\*"
STAMP = r"\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,3})?"
OPENED = r"[\[({<][^\])}>]*$|(?<=^|[\p{L}\p{N}])\*[^*]+$"
CLOSED = r"^[^\[({<]*[\])}>]|^[^*]+\*(?=$|[\p{L}\p{N}])"
NOTES = r"[♩♪♫♬]+"
MARK = r"^(?:>{1,3}|-{1,2}(?=\p{L}|$)|#+(?=\p{L}|$))|^(?i:(?:speaker|spk|sprecher|hablante|turn)[ _.-]?(?:[ab]|\d+)?\s*:|[ab]\s*:|(?:speaker|spk)[ _.-]?[ab]$)"


# A row of this form is a word as it stands: none of the patterns above can occur in it.
PLAIN = r"^(?!(?i:speaker|spk|sprecher|hablante|turn))[\p{L}\p{N}][\p{L}\p{N}'’-]*[.,!?;…]*$"


def said(word: Column) -> Column:
    """The word of a transcript row as written, without annotations, time stamps and marks; '' if none is left.

    A time of day (9:15) is a word, a stamp with seconds is not.
    """
    x = F.coalesce(word, F.lit(""))
    for pattern in (NOTES, WHOLE, STAMP, OPENED, CLOSED, MARK):
        x = F.regexp_replace(x, pattern, "")
    x = F.regexp_replace(x, r"^[\s\p{Z}\x{200B}\x{FEFF}]+|[\s\p{Z}\x{200B}\x{FEFF}]+$", "")
    return F.when(word.rlike(PLAIN), word).when(x.rlike(r"[\p{L}\p{N}]"), x).otherwise("")


LANGUAGES = ("de", "en", "es", "fr")


def german_around(rows: DataFrame, minutes: int = 2) -> DataFrame:
    """(dialogue_id, minute) in which German is spoken: its function words are more than those of each other language in
    the minutes up to `minutes` before and after. Counted by minute, so it doesn't depend on how rows are split."""
    plain = F.lower(F.translate("word", ".,!?;:", ""))
    counts = rows.groupBy("dialogue_id", F.floor(F.col("start_s") / 60).alias("minute")).agg(*[F.sum(is_in(plain, x).cast("int")).alias(x) for x in LANGUAGES])
    around = counts.filter("de + en + es + fr > 0").withColumn("minute", F.explode(F.transform(F.sequence(F.lit(-minutes), F.lit(minutes)), lambda d: F.col("minute") + d)))
    sums = around.groupBy("dialogue_id", "minute").agg(*[F.sum(x).alias(x) for x in LANGUAGES])
    return sums.filter(F.col("de") > F.greatest("en", "es", "fr")).select("dialogue_id", "minute")


def turns(
    words: DataFrame,
    dialogue: str = "dialogue_id",
    index: str = "word_idx",
    speaker: str = "speaker",
    word: str = "word",
    start: str = "start_s",
    max_gap_ms: int = 60_000,
    min_rows: int = MIN_ROWS,
    most: int = 1_000_000,
) -> DataFrame:
    """Clean turns: dialogue_id, side, start_ms, turn_text.

    Rows are ordered by start and index inside their dialogue; a row that arrived twice has the same start and
    index and is dropped beside its twin. Rows without a known side, a start or a dialogue take no part, nor do
    rows that hold no word. The two halves of an annotation go, wherever they come; a row between them is kept, as both
    sides' and late rows come between. 'um' and 'er' are words in German (german_around), else hesitation. An empty table
    gives an empty result; extra columns are ignored.

    A hot dialogue is worked on in ranges of time (sequence.py), so no task gets it whole. A turn's text is made
    in one task, as it is one value.
    """
    slim = words.select(
        F.col(dialogue).alias("dialogue_id"),
        F.col(index).alias("word_idx"),
        side_of(F.col(speaker)).alias("side"),
        F.col(word).alias("word"),
        F.nanvl(F.col(start), F.lit(None).cast("double")).alias("start_s"),
    ).filter("dialogue_id is not null and start_s is not null")
    ranges = find_ranges(slim, ["dialogue_id"], "start_s", min_rows)
    order = Window.partitionBy("dialogue_id", BUCKET).orderBy("start_s", "word_idx")
    rows = (
        ranges.assign(slim)
        .filter("side is not null")
        .withColumn("_twin", F.lag("word_idx").over(order).eqNullSafe(F.col("word_idx")) & F.col("word_idx").isNotNull())
        .filter("not _twin")
        .withColumn("_said", said(F.col("word")))
        .filter("_said <> ''")
        .withColumn("_bare", bare(F.col("_said")))
        .filter(~F.col("_bare").rlike(HESITATION))
        .withColumns({"_ms": F.round(F.col("start_s") * 1000).cast("long"), "_doubt": F.when(F.col("_bare").rlike(HESITATION_NOT_GERMAN), F.floor(F.col("start_s") / 60))})
    )
    german = german_around(slim.filter("side is not null")).withColumnRenamed("minute", "_doubt").withColumn("_german", F.lit(True))
    # Few minutes (counted) are sent with the tasks, and the rows stay where they are; else they are joined by a shuffle, in
    # which a key that is never met stands in for rows without doubt, so that these don't gather in one task.
    key = F.coalesce("_doubt", -1 - F.pmod(F.xxhash64("word_idx", "_ms"), F.lit(1024)))
    german = sized_broadcast(german.withColumnRenamed("_doubt", "_doubt_key"), most)
    kept = rows.withColumn("_doubt_key", key).join(german, ["dialogue_id", "_doubt_key"], "left").filter("_doubt is null or _german")
    kept = kept.select("dialogue_id", BUCKET, "side", "start_s", "word_idx", "_ms", "_said")
    piece = F.array_sort(F.collect_list(F.struct("start_s", "word_idx", F.col("_said").alias("w"))))
    merge = lambda c: F.array_sort(F.flatten(F.collect_list(c)))
    runs = collapse_runs(kept, ranges, ["start_s", "word_idx"], "side", "_ms", max_gap_ms, {"_words": (piece, merge)})
    return runs.select("dialogue_id", "side", F.col("first_at").alias("start_ms"), F.array_join("_words.w", " ").alias("turn_text"))


# ---- transcripts as text -------------------------------------------------------------------------------------

_GERMAN, _ENGLISH = frozenset(FUNCTION_WORDS["de"]), frozenset(FUNCTION_WORDS["en"])
_STAMP_LINE = re.compile(r"^\s*(?:\d{1,2}:)?\d{1,2}:\d{2}[.,]\d{3}\s*-->\s*(?:\d{1,2}:)?\d{1,2}:\d{2}[.,]\d{3}")
_LEAD_STAMP = re.compile(r"^\s*[\[(<]?(?:(\d{1,2}):)?(\d{1,2}):(\d{2})(?:[.,](\d{1,3}))?[\])>]?\s*(?=\S*\s*(?:\[|\(|<|\w+\s*:|-))")
_VOICE = re.compile(r"^\s*(?:<v\s+([^>]+)>|\[([^\]\d][^\]]{0,30})\](?=\s)|\(([AB])\)(?=\s)|(Speaker[ _]?\w+|SPK_\w+|Caller|Agent|[AB])\s*:)\s*", re.I)
_NAMED = re.compile(r"^\s*([A-ZÀ-Þ][\w.'-]*(?: [A-ZÀ-Þ][\w.'-]*){0,2})\s*:(?!\d|//)\s*")
_ANNOTATION = re.compile(r"\[[^\[\]]*\]|\([^()]*\)|\{[^{}]*\}|<[^<>]*>|\*[^*]+\*|[♩♪♫♬]+")
_FILLER = re.compile(r"(?<![\w'])(?:u+h+m*|u+m{2,}|h+m+|m{2,}|äh+m*|ääh|öh+m*|e+h+m*|e+r+m+)(?:\.{2,}|,)?(?![\w'])\s*", re.I)
_FILLER_NOT_GERMAN = re.compile(_FILLER.pattern.replace("u+h+m*|", "u+h+m*|um|er|"), re.I)
_SIDES = {"caller": "A", "agent": "B", "left": "A", "right": "B", "0": "A", "1": "B"}


def parse_lines(text: str) -> list[tuple[int, str | None, int | None, str]]:
    """Turns (number, speaker, start in ms, text) of a transcript in one of the known layouts.

    Layouts: SubRip and WebVTT captions; lines led by 'A:', '[A]', 'Caller:', 'Speaker A:' or '<v A>', with or
    without a time before; lines led by a dash that change the speaker each time. The automaton's states are
    'outside', 'number' (of a caption), 'cue' (inside a caption) and 'line'. A line without a speaker belongs to
    the turn before it. Other names before a colon are speakers if they lead two lines. 'um' and 'er' go unless the text
    is German.
    """
    lines = re.split(r"\r\n|\n|\r", text)
    named = Counter(m[1] for m in map(_NAMED.match, lines) if m)
    people = {name for name, n in named.items() if n >= 2}  # names before a colon that come again
    state, speaker, at, out = "outside", None, None, []
    heard = text.lower().split()
    german = sum(w in _GERMAN for w in heard) > sum(w in _ENGLISH for w in heard)
    filler = _FILLER if german else _FILLER_NOT_GERMAN
    dash = 0
    for raw in lines:
        line = raw.strip("﻿ \t ")
        if not line:
            state = "outside"
            continue
        if state == "outside" and (line.upper().startswith("WEBVTT") or line.isdigit()):
            state = "number"
            continue
        if m := _STAMP_LINE.match(line):
            h = re.findall(r"\d+", line.split("-->")[0])
            parts = [0] * (4 - len(h)) + [int(x) for x in h]
            at, state = ((parts[0] * 60 + parts[1]) * 60 + parts[2]) * 1000 + parts[3], "cue"
            continue
        if state != "cue":
            state = "line"
        if m := _LEAD_STAMP.match(line):
            at = ((int(m[1] or 0) * 60 + int(m[2])) * 60 + int(m[3])) * 1000 + int((m[4] or "0").ljust(3, "0"))
            line = line[m.end() :]
        if m := _VOICE.match(line):
            name = next(g for g in m.groups() if g).strip()
            short = re.sub(r"^(?:speaker|spk)[ _]?", "", name, flags=re.I)
            speaker, line = _SIDES.get(short.lower(), short.upper() if len(short) == 1 else short), line[m.end() :]
        elif (m := _NAMED.match(line)) and m[1] in people:
            speaker, line = m[1], line[m.end() :]
        elif re.match(r"^[-–]\s+\S", line):
            speaker, dash, line = "AB"[dash % 2], dash + 1, line[1:].strip()
        clean = re.sub(r"\s+", " ", filler.sub("", _ANNOTATION.sub(" ", line))).strip()
        if not clean:
            continue
        if out and out[-1][1] == speaker:
            out[-1] = (*out[-1][:3], f"{out[-1][3]} {clean}")
        else:
            out.append((len(out), speaker, at, clean))
    return out


def is_transcript(text: str) -> bool:
    """Whether a text is a transcript: two lines or more, and at least half of them, are led by a speaker or are stamps,
    numbers and words of captions."""
    lines = [x for x in re.split(r"\r\n|\n|\r", text) if x.strip()]
    stamps = sum(bool(_STAMP_LINE.match(x)) for x in lines)
    led = sum(bool(_VOICE.match(x) or _NAMED.match(x)) for x in (_LEAD_STAMP.sub("", x) for x in lines)) if not stamps else 0
    return stamps >= 2 or stamps == 1 and len(lines) <= 4 or led >= 2 and 2 * led >= len(lines)


def text_turns(df: DataFrame, key: str, text: str) -> DataFrame:
    """Turns of the texts that are transcripts (is_transcript): key, turn_no, speaker, start_ms, turn_text. Texts are
    independent, so nothing is shuffled. A null or empty text has no turns, nor has one of another kind."""

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(k, *t) for k, x in zip(pdf[key], pdf[text]) if isinstance(x, str) and is_transcript(x) for t in parse_lines(x)]
            out = pd.DataFrame(rows, columns=[key, "turn_no", "speaker", "start_ms", "turn_text"])
            out["start_ms"] = out["start_ms"].astype("Int64")
            yield out

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(parse, f"{key} {kind}, turn_no int, speaker string, start_ms long, turn_text string")
