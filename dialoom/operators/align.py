"""Alignment of words and events with frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.labels import channel_map, strip, without_repeats
from dialoom.functions.tokenize import LONGEST, piece_id, pieces, text_ids
from dialoom.operators.batch import dense, speaker_spec
from dialoom.operators.frames import packed
from dialoom.operators.sequence import MIN_ROWS, find_ranges, following
from dialoom.operators.transcripts import frame_of

RATE = 12.5


def spaced_words(t: DataFrame, spaces: bool = True) -> DataFrame:
    """Adds `_text`, the word as it stands in its speaker's text (F2): words are stripped and all but the first are led
    by a blank; without `spaces` (scripts that need none) they are left as they are."""
    if not spaces:
        return t.withColumn("_text", F.col("word"))
    w = Window.partitionBy("did", "speaker").orderBy("start", "idx")
    return t.withColumn("_text", F.concat(F.when(F.row_number().over(w) == 1, "").otherwise(" "), strip(F.col("word"))))


def character_times(t: DataFrame, spaces: bool = True) -> DataFrame:
    """Each character of a word with its start, a word's time divided evenly."""
    chars = spaced_words(t, spaces).filter("length(_text) > 0").select("did", "speaker", "idx", "start", "end", F.length("_text").alias("len"), F.posexplode(F.filter(F.split("_text", ""), lambda c: c != "")).alias("at", "ch"))
    return chars.select("did", "speaker", "idx", "at", "ch", (F.col("start") + F.col("at") * (F.col("end") - F.col("start")) / F.col("len")).alias("ch_start"))


def place_fold(frames: list[int], ids: list[int], n: int, pad: int = 3, end: int = 0, strict: bool = True) -> list[int]:
    """The general form of the placement, for frames in any order."""
    out = [pad] * n
    for token, (p, mark) in zip(ids, slots_of(frames, n, strict)):
        out[p] = token
        if mark:
            out[p - 1] = end
    return out


def slots_of(frames: list[int], n: int, strict: bool = True) -> list[tuple[int, bool]]:
    """The slot of each token and whether it put the end-of-text mark before it; a marked slot is no longer free."""
    out, taken, after = [], [False] * n, {}
    for f in frames:
        if f < 0:
            raise ValueError("a word starts before 0")
        p, passed = f, []
        while p < n and taken[p]:  # jumps over what earlier tokens found taken
            passed.append(p)
            p = after.get(p, p + 1)
        if p >= n:
            if strict:
                raise ValueError("no slot is left for a token")
            break
        after.update(dict.fromkeys(passed, p))
        taken[p] = True
        mark = p > 0 and not taken[p - 1]
        if mark:
            taken[p - 1] = True
        out.append((p, mark))
    return out


def token_frames(t: DataFrame, strict: bool = False) -> DataFrame:
    """Frames of the subword tokens of each speaker: did, speaker, idx, part, token_id, frame, slot, end_mark, num_frames, folded.

    A token takes the first free slot from its frame on; the slot before it gets the end-of-text mark if free;
    num_frames comes from the last token's end. A token for which no slot is left is an error if `strict`; else its
    row stays, with a null slot. Speakers whose frames never fall back are placed in closed form
    (p_i = i + max(f_j - j)), others by the fold (`folded`), which takes the tokens of one speaker of a unit.
    """
    by = Window.partitionBy("did", "speaker")
    run = by.orderBy("ord")
    x = token_times(t).withColumn("frame", frame_of(F.col("tok_start")))
    x = x.withColumn("ord", (F.row_number().over(by.orderBy("start", "idx", "part")) - 1)).withColumn("_back", F.col("frame") < F.lag("frame").over(run))
    x = x.withColumns({"folded": F.coalesce(F.max("_back").over(by), F.lit(False)), "num_frames": ((F.max_by("tok_end", "ord").over(by) + 1) * RATE).cast("int")})
    x = x.select("did", "speaker", "idx", "part", "token_id", "frame", "ord", "num_frames", "folded")
    cols = ["did", "speaker", "idx", "part", "token_id", "frame", "slot", "end_mark", "num_frames", "folded"]
    f = x.filter("not folded").withColumn("slot", F.col("ord") + F.max(F.col("frame") - F.col("ord")).over(run))
    f = f.withColumn("end_mark", (F.col("slot") > 0) & (F.col("slot") - 1 > F.lag("slot", 1, -1).over(run)))
    kept = F.col("slot") < F.col("num_frames")
    f = f.withColumns({"end_mark": F.when(kept, F.col("end_mark")), "slot": F.when(kept, F.col("slot"))})

    def fold(g):
        import pandas as pd

        g = g.sort_values("ord")
        at = slots_of(g.frame.tolist(), int(g.num_frames.iloc[0]), strict=False)
        lost = [None] * (len(g) - len(at))
        return g.assign(slot=pd.array([p for p, _ in at] + lost, dtype="Int32"), end_mark=pd.array([m for _, m in at] + lost, dtype="boolean"))[cols]

    folded = x.filter("folded").groupBy("did", "speaker").applyInPandas(fold, "did string, speaker string, idx int, part int, token_id int, frame int, slot int, end_mark boolean, num_frames int, folded boolean")
    out = f.select(*cols).unionByName(folded)
    if strict:
        out = out.withColumn("slot", F.when(F.col("slot").isNotNull(), F.col("slot")).otherwise(F.raise_error(F.concat(F.lit("no frame is left for a token of "), "did", F.lit(" "), "speaker")).cast("int")))
    return out


def text_streams(t: DataFrame, pad: int = 3, end: int = 0) -> DataFrame:
    """Text streams (DM6): did, speaker, ids, one for each frame, from the placed tokens of token_frames."""
    placed = token_frames(t).groupBy("did", "speaker").agg(
        F.max("num_frames").alias("n"),
        F.collect_list(F.when(F.col("slot").isNotNull(), F.struct(F.col("slot").alias("frame"), F.lit(0).alias("late"), F.col("token_id").alias("tok")))).alias("_own"),
        F.collect_list(F.when(F.col("end_mark"), F.struct((F.col("slot") - 1).alias("frame"), F.lit(0).alias("late"), F.lit(end).alias("tok")))).alias("_marks"),
    )
    return placed.withColumn("_w", F.array_sort(F.concat("_own", "_marks"))).select("did", "speaker", dense("_w", F.col("n"), pad).alias("ids"))


def event_frames(raw: DataFrame, num_frames: int | DataFrame | None = None, min_rows: int = MIN_ROWS, ids: Callable[[Column], Column] = text_ids) -> DataFrame:
    """Events on the frame grid: dialogue_id, channel, ord, frame_pos, ratio, skip_forbid, pred_ids, hint_ids (T11: P5, W8, P6, T10, P7-P10, T9, P8).

    `num_frames` is the length of speaker A's audio, which bounds both channels: one number, or a table of dialogue_id
    and num_frames (a dialogue without a row has no bound). skip_forbid marks the last entry of a run of one channel
    in the raw order, before anything is dropped. A null channel is 0, a missing or unreadable ratio 0; events without
    a time, outside the audio or without prediction and hint are dropped. Repeated rows count once. A hot dialogue is
    worked on in ranges of `ord`. `ids` makes the ids of a text column: the built-in tokenizer's, or plugins.event_ids.
    """
    cols = ["dialogue_id", "ord", "timestamp_ms", "prediction", "hint", "current_spoken_ratio"]
    slim = raw.select(*cols, F.coalesce("channel", F.lit(0)).alias("channel"))
    ranges = find_ranges(slim, ["dialogue_id"], "ord", min_rows)
    once = following(ranges.assign(without_repeats(slim, ["dialogue_id", "ord"])), ranges, ["ord"], "channel", "_next")
    flagged = once.withColumn("skip_forbid", F.coalesce(F.col("_next") != F.col("channel"), F.lit(True)).cast("int"))
    placed = flagged.filter("timestamp_ms is not null").withColumn("frame_pos", (F.col("timestamp_ms") / F.lit(1000.0) * F.lit(RATE)).cast("int")).filter("frame_pos >= 0")
    if isinstance(num_frames, DataFrame):
        placed = placed.join(num_frames.select("dialogue_id", F.col("num_frames").alias("_bound")), "dialogue_id", "left").filter("_bound is null or frame_pos < _bound")
    elif num_frames is not None:
        placed = placed.filter(F.col("frame_pos") < num_frames)
    ratio = F.coalesce(F.col("current_spoken_ratio").try_cast("float"), F.lit(0.0).cast("float")).cast("double")
    out = placed.select("dialogue_id", "channel", "ord", "frame_pos", ratio.alias("ratio"), "skip_forbid", ids(strip(F.col("prediction"))).alias("pred_ids"), ids(strip(F.col("hint"))).alias("hint_ids"))
    return out.filter((F.size("pred_ids") > 0) | (F.size("hint_ids") > 0))


def packed_events(placed: DataFrame, speakers: dict[str, int] | None = None) -> DataFrame:
    """The 14 event columns of each dialogue (DM8), in the order of `ord`, from event_frames. One row holds a dialogue's
    events, as the format asks; a dialogue without events on a channel has empty arrays there."""
    sides = []
    for side, channel in channel_map(speakers or {"A": 0, "B": 1}).items():
        e = F.struct("ord", F.col("frame_pos").alias("pos"), F.col("ratio").cast("float").alias("ratio"), F.col("skip_forbid").cast("tinyint").alias("forbid"), F.col("pred_ids").alias("pred"), F.col("hint_ids").alias("hint"))
        sides.append(F.array_sort(F.collect_list(F.when(F.col("channel") == channel, e)), lambda a, b: F.when(a.ord < b.ord, -1).when(a.ord > b.ord, 1).otherwise(0)).alias(side))
    x = placed.groupBy("dialogue_id").agg(*sides)
    return x.select("dialogue_id", *[c.alias(f"{s}_{k}") for s in "AB" for k, c in packed(F.col(s)).items()])


def token_times(t: DataFrame, spaces: bool = True) -> DataFrame:
    """Tokens with the times of their first and last characters: did, speaker, idx, part, token_id, tok_start, tok_end, start.

    A word's time is divided evenly over its characters, the leading blank included, which the mark of its first
    piece stands for; the very first word of a speaker has no blank, so there the mark takes no time. A piece that
    is only that mark is skipped. Without `spaces` words lead with no blank and their pieces with no mark, but for
    the speaker's first.
    """
    first = F.row_number().over(Window.partitionBy("did", "speaker").orderBy("start", "idx")) == 1
    word = strip(F.col("word")) if spaces else F.col("word")
    marked = F.lit(True) if spaces else first  # whether the first piece has the mark, which takes time or not
    x = t.withColumns({"_word": word, "_mark": marked.cast("int"), "_lead": F.when(first | ~marked, 0).otherwise(1)}).filter("length(_word) > 0")
    x = x.withColumn("_len", F.length("_word") + F.col("_lead"))
    x = x.select("*", F.posexplode(pieces(F.col("_word"), F.col("_mark") == 1)).alias("part", "_p"))
    free = F.col("_mark") - F.col("_lead")  # characters of the pieces that take no time: the mark of the first word
    low = F.greatest(F.col("part") * LONGEST - free, F.lit(0))
    high = F.col("part") * LONGEST + F.length("_p") - 1 - free
    step = (F.col("end") - F.col("start")) / F.col("_len")
    return x.filter(high >= low).select("did", "speaker", "idx", "part", piece_id(F.col("_p")).alias("token_id"), (F.col("start") + low * step).alias("tok_start"), (F.col("start") + (high + 1) * step).alias("tok_end"), "start")


def by_file_speakers(df: DataFrame, file: str, speakers: dict[str, str], default: str) -> DataFrame:
    """One row per requested speaker of each row's file (U3, P13); `speakers` maps a file to 'A', 'B' or 'A,B'."""
    chosen = F.lit(None).cast("array<string>")
    wanted = F.array(*[F.lit(s) for s in speaker_spec(default)])
    for name, spec in speakers.items():
        chosen = F.when(F.col(file) == name, F.array(*[F.lit(s) for s in speaker_spec(spec)])).otherwise(chosen)
    return df.withColumn("main_speaker", F.explode(F.coalesce(chosen, wanted)))
