"""Frame streams: delay, chunks, labels, ragged values (D1-D10, E5, E6, P11). All narrow: a row stays a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELAYS = (0, *(0, 1, 1, 1, 1, 1, 1, 1) * 2)
TEXT_PAD, TEXT_INIT, AUDIO_INIT, IGNORED = 3, 32000, 2048, -1


def _ints(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def _init(k: int) -> Column:
    return _ints([TEXT_INIT, *[AUDIO_INIT] * (k - 1)])


def merge_text_audio(text: Column, audio: Column, pad: int = TEXT_PAD) -> Column:
    """Text cut or padded to the audio's length, as row 0 over the audio rows."""
    n = F.size(F.get(audio, 0))
    fit = F.slice(F.concat(text, F.array_repeat(F.lit(pad), F.greatest(n - F.size(text), F.lit(0)))), F.lit(1), n)
    return F.concat(F.array(fit), audio)


def main_streams(main: Column, other: Column, codebooks: int = 8) -> Column:
    """The main speaker's rows, then the other side's audio rows (D3)."""
    return F.concat(main, F.slice(other, 2, codebooks))


def delayed(streams: Column, delays=DELAYS) -> Column:
    """Initial id, initial id for each frame of delay, the row, pad up to the largest delay."""
    most, d, init = max(delays), _ints(delays), _init(len(delays))
    pad = _ints([TEXT_PAD, *[AUDIO_INIT] * (len(delays) - 1)])
    return F.transform(streams, lambda x, i: F.concat(F.array_repeat(F.get(init, i), F.get(d, i) + 1), x, F.array_repeat(F.get(pad, i), F.lit(most) - F.get(d, i))))


def undelayed(streams: Column, delays=DELAYS) -> Column:
    """Rows moved back by their delay; null where no frame is left (D10). The initial column stays."""
    most, d = max(delays), _ints(delays)
    n = F.size(F.get(streams, 0))
    return F.when(n >= most + 1, F.transform(streams, lambda x, i: F.slice(x, F.get(d, i) + 1, n - most)))


def labels(streams: Column, rows: int = 17) -> Column:
    """Ids below the row's initial id; all others are ignored."""
    init = _init(rows)
    return F.transform(streams, lambda x, i: F.transform(x, lambda v: F.when(v < F.get(init, i), v).otherwise(F.lit(IGNORED))))


def chunk_bounds(n: Column, most: int) -> Column:
    """array<struct<chunk, start, len>> of near-equal chunks (D6): the first n mod k are one frame longer."""
    k = ((n + (most - 1)) / most).cast("int")
    q, r = (n / k).cast("int"), n % k
    return F.transform(F.sequence(F.lit(0), k - 1), lambda c: F.struct(c.alias("chunk"), (c * q + F.least(c, r)).alias("start"), (q + F.when(c < r, 1).otherwise(0)).alias("len")))


def chunked(df: DataFrame, most: int, streams: str = "streams", positions: str = "oracle_event_frame_pos") -> DataFrame:
    """One row per chunk with its slice of the streams and its events, counted from its start."""
    x = df.filter(F.size(F.get(streams, 0)) > 0).withColumn("_c", F.explode(chunk_bounds(F.size(F.get(streams, 0)), most)))
    start, n = F.col("_c.start"), F.col("_c.len")
    events = F.transform(F.array_sort(F.filter(positions, lambda p: (p >= start) & (p < start + n))), lambda p: p - start)
    return x.withColumns({streams: F.transform(streams, lambda r: F.slice(r, start + 1, n)), positions: events, "chunk": F.col("_c.chunk"), "num_frames": n}).drop("_c")


def given_events(df: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and `events`: the seven event columns as array<struct<pos, i, ratio, forbid, pred, hint>> in
    the table's order, `i` its number, the ids unpacked (E2). Null positions are no events."""
    lists = {k: unpacked(F.col(f"oracle_{k}_values"), F.col(f"oracle_{k}_offsets")) for k in ("pred", "hint")}
    x = df.withColumns({f"_{k}": c for k, c in lists.items()})
    e = F.transform("oracle_event_frame_pos", lambda p, i: F.struct(p.alias("pos"), i.alias("i"), F.get("oracle_event_ratio", i).alias("ratio"), F.get("oracle_event_skip_forbid", i).alias("forbid"), F.get("_pred", i).alias("pred"), F.get("_hint", i).alias("hint")))
    return x.select(*keep, F.filter(e, lambda z: z.pos.isNotNull()).alias("events"))


def in_order(events: Column) -> Column:
    """Events (structs whose first fields are pos and their number) by position, equal ones as given (O3)."""
    return F.array_sort(events, lambda a, b: F.when(a.pos != b.pos, F.when(a.pos < b.pos, -1).otherwise(1)).when(a.i < b.i, -1).when(a.i > b.i, 1).otherwise(0))


def moved(events: Column, by: Column) -> Column:
    """Events with their positions moved."""
    return F.transform(events, lambda e: e.withField("pos", e.pos + by))


def packed(events: Column) -> dict[str, Column]:
    """The seven event columns of an array of events."""
    out = {"oracle_event_frame_pos": events.getField("pos"), "oracle_event_ratio": events.getField("ratio"), "oracle_event_skip_forbid": events.getField("forbid")}
    for k in ("pred", "hint"):
        lists = events.getField(k)
        out |= {f"oracle_{k}_values": F.flatten(lists), f"oracle_{k}_offsets": packed_offsets(lists)}
    return out


def aligned(events: Column, length: Column, text_delay: int = DELAYS[0]) -> Column:
    """Events (structs with `pos`) on the delayed timeline: moved past the initial column and the text's delay, those beyond it dropped."""
    moved = F.transform(events, lambda e: e.withField("pos", e.pos + (1 + text_delay)))
    return F.filter(moved, lambda e: (e.pos >= 0) & (e.pos < length))


def training_examples(df: DataFrame, most: int | None = None, least: int | None = None, delays=DELAYS) -> DataFrame:
    """Main-speaker streams and their `events` (structs with pos) as training examples (D4-D8, P11, D9): the streams
    delayed, the events aligned, both cut into chunks of at most `most` frames, chunks under `least` left out,
    labels made. Events are in order of their frame, then as given, where they are cut."""
    x = df.withColumn("streams", delayed(F.col("streams"), delays))
    x = x.withColumn("events", aligned(F.col("events"), F.size(F.get("streams", 0)), delays[0])).withColumn("chunk", F.lit(0))
    if most is not None:
        x = x.withColumn("_c", F.explode(chunk_bounds(F.size(F.get("streams", 0)), most)))
        start, n = F.col("_c.start"), F.col("_c.len")
        tagged = F.transform("events", lambda e, i: F.struct(e.pos.alias("pos"), i.alias("i"), e.alias("e")))
        inside = F.filter(tagged, lambda e: (e.pos >= start) & (e.pos < start + n))
        ordered = F.array_sort(inside, lambda a, b: F.when(a.pos != b.pos, F.when(a.pos < b.pos, -1).otherwise(1)).otherwise(F.when(a.i < b.i, -1).when(a.i > b.i, 1).otherwise(0)))
        x = x.withColumns({"streams": F.transform("streams", lambda r: F.slice(r, start + 1, n)), "events": F.transform(ordered, lambda e: e.e.withField("pos", e.pos - start)), "chunk": F.col("_c.chunk")}).drop("_c")
    x = x.withColumns({"num_streams": F.size("streams"), "num_frames": F.size(F.get("streams", 0))})
    if least is not None:
        x = x.filter(F.col("num_frames") >= least)
    return x.withColumn("labels", labels(F.col("streams"), len(delays)))


def unpacked(values: Column, offsets: Column) -> Column:
    """Lists of a packed ragged pair (E6); an end not beyond the start gives an empty list."""
    n = F.size(offsets) - 1
    at = lambda i: F.get(offsets, i)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(values, at(i) + 1, F.greatest(at(i + 1) - at(i), F.lit(0))))).otherwise(F.array().cast("array<array<int>>"))


def packed_offsets(lists: Column) -> Column:
    """Running sums of the lists' sizes, from 0 (E5)."""
    return F.aggregate(lists, _ints([0]), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.size(x))))
