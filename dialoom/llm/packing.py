"""Filling containers of fixed capacity with documents (problem 6)."""

from __future__ import annotations

import base64
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.session import checkpointed, spread

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to the public vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DIMENSIONS, BITS = 4, 10


def load_tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def hilbert_key(point: list[int], bits: int = BITS) -> int:
    """Place of a point of a grid with 2**bits cells a side on the Hilbert curve: neighbours on the curve are
    neighbours in the grid. The cell numbers are turned level by level (exclusive-or and exchange of the lower
    bits with the first axis), coded by Gray code, and their bits interleaved."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= low
            else:
                t = (x[0] ^ x[i]) & low
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    key = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | (v >> b & 1)
    return key


def projected(ids: list[int]) -> list[int]:
    """A document as a cell of the grid: the signed sums of its hashed tokens on a few axes, by the document's
    length, squeezed into the grid."""
    import numpy as np

    side = 1 << BITS
    if not ids:
        return [side // 2] * DIMENSIONS
    tokens, counts = np.unique(np.asarray(ids, dtype=np.uint64), return_counts=True)
    weight = np.sqrt(counts)
    out = []
    for d in range(DIMENSIONS):
        with np.errstate(over="ignore"):  # the products are meant to wrap
            h = (tokens + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(zlib.crc32(b"axis %d" % d)) * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        sign = (h >> np.uint64(63)).astype(np.int64) * 2 - 1
        z = float((sign * weight).sum() / np.sqrt((weight**2).sum()))
        out.append(min(side - 1, int((np.tanh(z / 2) + 1) / 2 * side)))
    return out


def pack(sizes: list[int], capacity: int, open_at_once: int = 16) -> list[int]:
    """Container numbers for sizes in the order given: each goes to the fullest open container that it fits; if
    none, a new one is opened, and beyond `open_at_once` the fullest is closed. Few open ones keep neighbours in the order
    together, more of them leave less space unused (README has figures)."""
    import bisect

    room: list[tuple[int, int]] = []  # (free space, container), ascending
    out, made = [], 0
    for n in sizes:
        at = bisect.bisect_left(room, (n, -1))
        if at < len(room):
            free, c = room.pop(at)
        else:
            free, c, made = capacity, made, made + 1
        out.append(c)
        if free > n:
            bisect.insort(room, (free - n, c))
            if len(room) > open_at_once:
                room.pop(0)
    return out


def containers(documents: DataFrame, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, rows_per_range: int = 20_000, open_at_once: int = 16, checkpoint=checkpointed) -> DataFrame:
    """(container, doc_id, piece, token_from, token_to, place): every document in containers of `capacity` tokens; `place`
    is the text's number along the curve in its range, null in a container that one text fills.

    A text larger than a container is cut into full containers and a rest, the only texts that are divided. Texts
    are ordered along a Hilbert curve over their projected token vectors, by a range shuffle on (curve key, doc
    id), so that copies, which share a key, spread over ranges too. Each range is packed by itself in the curve's
    order; a task holds the ids and sizes of about `rows_per_range` texts, no text.

    Null texts are left out; an empty text takes a place of size 0. The ids should be unique; a repeated row is
    placed again. The tokenizer is public and its path a parameter; every executor must have it there.
    """
    kind = documents.schema[doc].dataType.simpleString()

    def measure(batches):
        import pandas as pd

        enc = load_tokenizer(tokenizer)
        for pdf in batches:
            rows = []
            for d, t in zip(pdf[doc], pdf[text]):
                ids = enc.encode_ordinary(t)
                key = hilbert_key(projected(ids))
                starts = range(0, max(1, len(ids)), capacity)
                rows += [(d, k, a, min(a + capacity, len(ids)), key) for k, a in enumerate(starts)]
            yield pd.DataFrame(rows, columns=[doc, "piece", "token_from", "token_to", "_key"])

    sized = spread(documents.select(doc, text).filter(f"{text} is not null"), doc).mapInPandas(measure, f"{doc} {kind}, piece int, token_from int, token_to int, _key long")
    sized = checkpoint(sized)  # small rows; keeps the tokenizer from running again for the sample of the ranges
    ranges = max(1, -(-sized.count() // rows_per_range))
    whole = F.col("token_to") - F.col("token_from") == capacity
    # A full container needs no packing.
    full = sized.filter(whole).select(doc, "piece", "token_from", "token_to", F.concat_ws("-", F.lit("f"), doc, "piece").alias("container"), F.lit(None).cast("int").alias("place"))
    rest = sized.filter(~whole).repartitionByRange(ranges, "_key", doc, "piece").sortWithinPartitions("_key", doc, "piece")

    def fill(batches):
        import pandas as pd
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        parts = list(batches)  # ids and numbers of at most about `rows_per_range` texts
        if parts:
            pdf = pd.concat(parts)
            at = pack((pdf["token_to"] - pdf["token_from"]).tolist(), capacity, open_at_once)
            yield pdf.drop(columns="_key").assign(container=[f"{number}-{c}" for c in at], place=range(len(at)))

    packed = rest.mapInPandas(fill, f"{doc} {kind}, piece int, token_from int, token_to int, container string, place int")
    return packed.select("container", doc, "piece", "token_from", "token_to", "place").unionByName(full)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_containers, fill (share of their space that is used) and neighbour_distance, how many places along the
    curve lie between a text and the next one in its container, on average."""
    used = F.col("token_to") - F.col("token_from")
    apart = (F.max("place") - F.min("place")).alias("apart")
    each = packed.groupBy("container").agg(F.sum(used).alias("n"), apart, F.count(F.lit(1)).alias("k"))
    return each.agg(F.count(F.lit(1)).alias("n_containers"), (F.sum("n") / (F.count(F.lit(1)) * capacity)).alias("fill"), (F.sum("apart") / F.sum(F.col("k") - 1)).alias("neighbour_distance"))
