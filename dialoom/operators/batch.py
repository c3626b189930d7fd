"""Batches and augmentation with keyed hashes instead of random streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.operators.sequence import numbered

START, PAD = 32000, 3


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) that depends on the key only: the same in every run and partition."""
    text = F.concat_ws("|", *[k.cast("string") if isinstance(k, Column) else F.lit(k) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long") / F.lit(2.0**28)


@dataclass(frozen=True)
class Augmentation:
    """Settings of the augmentation; all off in evaluation."""

    seed: str = "0"
    shift_prob: float = 0.0
    shift_right: tuple[int, int] = (1, 10)
    shift_left: tuple[int, int] = (1, 15)
    skip: tuple[float, float] = (0.0, 0.0)
    jitter: int = 0

    def __post_init__(self) -> None:
        if not 0 <= self.shift_prob <= 1 or self.jitter < 0 or min(self.skip) < 0 or max(self.skip) > 1:
            raise ValueError("augmentation out of range")


TRAIN = Augmentation(shift_prob=1.0, skip=(0.1, 0.7))
EVAL = Augmentation()


def batches(examples: DataFrame, size: int, by: str = "example_id") -> DataFrame:
    """Adds batch_id and pos_in_batch in the order of `by`; the last batch may be short (B12). Only the ids are put in
    order (see numbered); the examples meet their number by id. Rows without an id are in no batch."""
    n = F.col("_n")
    at = numbered(examples.filter(F.col(by).isNotNull()), by, "_n")
    return examples.join(at, by).withColumn("batch_id", F.floor(n / size).cast("int")).withColumn("pos_in_batch", (n % size).cast("int")).drop("_n")


def shuffled(examples: DataFrame, seed: str, by: str = "example_id") -> DataFrame:
    """Adds `order_key`, by which the examples of an epoch come in another order for each seed (O6); evaluation keeps the
    order of `by`. Ties of the 28-bit hash go by id."""
    return examples.withColumn("order_key", F.concat(F.lpad(F.hex((uniform(seed, F.col(by), "order") * F.lit(2.0**28)).cast("long")), 7, "0"), F.lit("|"), F.col(by).cast("string")))


def remaining(batched: DataFrame, steps: int, accumulate: int, n_batches: int) -> DataFrame:
    """Batches left in the epoch after `steps` updates."""
    return batched.filter(F.col("batch_id") >= resume_offset(steps, accumulate, n_batches))


def padded(ids: Column, n: Column, longest: Column, zero: int) -> Column:
    """Rows padded to the batch's longest (B1)."""
    return F.transform(ids, lambda r: F.concat(r, F.array_repeat(F.lit(zero), longest - n)))


def mask(n: Column, longest: Column, zero: int) -> Column:
    """1 for real frames; padded ones hold the zero id (B2)."""
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(zero), longest - n))


def hint_only(step: Column | int, start: int | None, end: int | None, u: Column, on: bool = True) -> Column:
    """Whether an example shows hints only at a step of the curriculum."""
    step = F.lit(step) if isinstance(step, int) else step
    if not on:
        return F.lit(False)
    if start is None or end is None:
        return F.lit(True)
    p = F.lit(1.0) - (step - start) / F.lit(float(max(end - start, 1)))
    return F.when(step <= start, True).when(step >= end, False).otherwise(u < p)


def frame_writes(events: Column, t: Column, example: Column, hints_only: Column | bool = False, aug: Augmentation = EVAL) -> Column:
    """What the events of a row write, as array<struct<frame, late, tok>> by frame, the latest event first.

    `events` are structs with pos, ratio, forbid, pred and hint in the order of their frames; later ones overwrite
    earlier ones frame by frame, by that order also where jitter moves them. A row stays a row.
    """
    hints_only = F.lit(hints_only) if isinstance(hints_only, bool) else hints_only
    low, high = min(aug.skip), max(aug.skip)
    p = F.lit(low) + uniform(aug.seed, example, "p") * (high - low)

    def one(e: Column, i: Column) -> Column:
        n = i.cast("string")
        tok = F.when(hints_only, e.hint).when((e.ratio >= 1.0) & (F.size(e.hint) > 0), e.hint).otherwise(e.pred)
        use = (e.pos >= 0) & (e.pos < t) & (F.size(tok) > 0)
        if high > 0:
            use = use & ((e.forbid != 0) | (uniform(aug.seed, example, n, "skip") >= p))
        at = e.pos
        if aug.jitter:
            at = at + F.floor(uniform(aug.seed, example, n, "jitter") * (aug.jitter + 1)).cast("int")
        written = F.transform(F.concat(F.array(F.lit(START)), tok), lambda v, o: F.struct((at + o).alias("frame"), (-i).alias("late"), v.alias("tok")))
        return F.when(use, F.filter(written, lambda w: w.frame < t)).otherwise(F.array().cast("array<struct<frame:int,late:int,tok:int>>"))

    every = F.array_sort(F.flatten(F.transform(events, one)))
    return every


def latest(writes: Column | str) -> Column:
    """Of the sorted writes the first of each frame, which is the latest event's."""
    w = F.col(writes) if isinstance(writes, str) else writes
    return F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1).frame != x.frame, F.lit(True)))


def dense(writes: Column | str, t: Column, pad: int = PAD) -> Column:
    """The frame stream of `t` frames that the writes of `latest` leave behind, pad elsewhere."""
    w = F.col(writes) if isinstance(writes, str) else writes
    until = lambda i: F.coalesce(F.get(w, i + 1).frame, t)
    lead = F.array_repeat(F.lit(pad), F.coalesce(F.get(w, F.lit(0)).frame, t))
    return F.concat(lead, F.flatten(F.transform(w, lambda x, i: F.concat(F.array(x.tok), F.array_repeat(F.lit(pad), until(i) - x.frame - 1)))))


def event_writes(examples: DataFrame, n: Column, hints_only: bool = False, aug: Augmentation = EVAL) -> DataFrame:
    """One row per frame an event writes: example_id, frame, tok (frame_writes in long form). `examples` has example_id
    and events array<struct<pos, ratio, forbid, pred, hint>>."""
    w = examples.select("example_id", frame_writes(F.col("events"), n, F.col("example_id"), hints_only, aug).alias("w"))
    return w.select("example_id", F.explode(latest("w")).alias("x")).select("example_id", "x.frame", "x.tok")


def shifted(row: Column, right: Column, by: Column, pad: int = PAD) -> Column:
    """A row moved right or left by `by` frames, clamped to [1, length - 1]."""
    n = F.size(row)
    s = F.greatest(F.lit(1), F.least(by, n - 1))
    gap = F.array_repeat(F.lit(pad), s)
    return F.when(n <= 1, row).when(right, F.concat(gap, F.slice(row, F.lit(1), n - s))).otherwise(F.concat(F.slice(row, s + 1, n - s), gap))


def maybe_shifted(row: Column, aug: Augmentation, example: Column, pad: int = PAD) -> Column:
    """The event stream, moved with probability shift_prob: right or left by a fair coin, by a number of frames from that
    side's own range, both ends included (B7)."""
    if aug.shift_prob <= 0:
        return row
    u = lambda salt: uniform(aug.seed, example, salt)
    amount = lambda r: F.lit(min(r)) + F.floor(u("shift by") * (abs(r[1] - r[0]) + 1)).cast("int")
    right = u("shift side") < 0.5
    by = F.when(right, amount(aug.shift_right)).otherwise(amount(aug.shift_left))
    return F.when(u("shift") < aug.shift_prob, shifted(row, right, by, pad)).otherwise(row)


def collated(examples: DataFrame, size: int, zero: int = -1, aug: Augmentation = EVAL, hints_only: Column | bool = False) -> DataFrame:
    """Examples as rows of their batch (B10): batch_id, pos_in_batch, example_id, longest, input_ids, text_mask, labels,
    and oracle_tokens if there are `events` (in the order of their frames).

    Ids and labels are padded with the zero id to the batch's longest example, the mask is 1 on real frames, the event
    stream is padded with the event pad. The longest one is found from ids and lengths; the wide rows are moved once, to
    meet their number.
    """
    n = F.size(F.get("streams", 0))
    where = batches(examples.select("example_id", n.alias("_n0")), size)
    where = where.withColumn("longest", F.max("_n0").over(Window.partitionBy("batch_id"))).drop("_n0")
    x = examples.join(where, "example_id").withColumn("_t", n)
    t, longest = F.col("_t"), F.col("longest")
    out = {"input_ids": padded(F.col("streams"), t, longest, zero), "text_mask": mask(t, longest, zero), "labels": padded(F.col("labels"), t, longest, zero)}
    if "events" in examples.columns:
        x = x.withColumn("_w", frame_writes(F.col("events"), t, F.col("example_id"), hints_only, aug)).withColumn("_w", latest("_w"))
        x = x.withColumn("_o", maybe_shifted(dense("_w", t), aug, F.col("example_id")))
        out["oracle_tokens"] = F.concat("_o", F.array_repeat(F.lit(PAD), longest - t))
    return x.select("batch_id", "pos_in_batch", "example_id", "longest", *[c.alias(k) for k, c in out.items()])


def dropout(row: Column, p: float, keep: tuple[int, ...], seed: str, example: Column, pad: int = PAD) -> Column:
    """Each token outside `keep` becomes pad with probability p."""
    return F.transform(row, lambda v, i: F.when(~v.isin(*keep) & (uniform(seed, example, i, "drop") < p), pad).otherwise(v))


def updates_per_epoch(n_batches: int, accumulate: int) -> int:
    if n_batches < 0 or accumulate <= 0:
        raise ValueError("batches must not be negative, accumulation must be positive")
    return -(-n_batches // accumulate)


def resume_offset(steps: int, accumulate: int, n_batches: int) -> int:
    if steps < 0 or accumulate <= 0:
        raise ValueError("steps must not be negative, accumulation must be positive")
    return steps * accumulate % n_batches if n_batches > 0 else 0


def speaker_spec(spec: str) -> list[str]:
    """'A', 'B' or 'A,B' in the order given."""
    parts = [s.strip() for s in spec.split(",")]
    if not parts or any(s not in ("A", "B") for s in parts) or len(set(parts)) != len(parts):
        raise ValueError(f"not a list of speakers: {spec!r}")
    return parts
