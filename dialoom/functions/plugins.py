"""Plug-in points: tokenizers and audio codecs, made in each Python worker by a factory.

A factory is a function without arguments that returns the object, so that models are loaded where they run and are
not pickled. The built-in ones need no files: BuiltinTokenizer gives what functions/tokenize.py gives as column
expressions, SyntheticCodec codes that depend on frame and codebook only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions.tokenize import LONGEST, MARK, NEWLINE, RESERVED, VOCABULARY


class Tokenizer(Protocol):
    """What a subword model has to offer; SentencePiece's processor fits as it is."""

    def encode_as_pieces(self, text: str) -> list[str]: ...
    def decode_pieces(self, pieces: list[str]) -> str: ...
    def piece_to_id(self, piece: str) -> int: ...


class Codec(Protocol):
    """What an audio codec has to offer: codes [codebook][frame] of one channel of samples at `sample_rate`."""

    sample_rate: int
    frame_rate: float
    num_codebooks: int

    def encode(self, samples) -> list[list[int]]: ...


class BuiltinTokenizer:
    def encode_as_pieces(self, text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK)
        out, word = [], ""
        for ch in marked:
            if word and (ch == MARK or len(word) == LONGEST):
                out.append(word)
                word = ""
            word += ch
        return [*out, word] if text else []

    def decode_pieces(self, pieces: list[str]) -> str:
        return "".join(pieces).replace(MARK, " ")

    def piece_to_id(self, piece: str) -> int:
        if piece == "\n":
            return NEWLINE
        return int(hashlib.md5(piece.encode()).hexdigest()[:7], 16) % (VOCABULARY - RESERVED) + RESERVED


def whole_pieces(model: Tokenizer, text: str) -> list[str]:
    """Pieces of a text in which byte pieces (<0x..>) are joined to the characters they stand for.

    Byte pieces are gathered until together they decode to what comes next in the text; bytes that never do are one
    piece at the end.
    """
    done, pending, at = [], [], 0
    for piece in model.encode_as_pieces(text):
        if piece.startswith("<0x"):
            pending.append(piece)
            piece = model.decode_pieces(pending)
            if not text.startswith(piece, at):
                continue
            pending = []
        done.append(piece)
        at += len(piece)
    return done + (["".join(pending)] if pending else [])


def timed_tokens(model: Tokenizer, words: list[tuple[str, float, float]], spaces: bool = True) -> tuple[list[tuple[str, float, float]], list[str]]:
    """Tokens (piece, start, end) of one speaker's words (text, start, end) in order of their start, and what didn't fit."""
    if spaces:
        words = [((" " if i else "") + w.strip(), a, b) for i, (w, a, b) in enumerate(words)]
    chars = [(a + i * (b - a) / len(w), a + (i + 1) * (b - a) / len(w)) for w, a, b in words for i in range(len(w))]
    tokens, issues, at = [], [], 0
    for i, piece in enumerate(whole_pieces(model, "".join(w for w, _, _ in words))):
        n = len(piece) - (i == 0 and piece.startswith(MARK))
        if i == 0 and not n:
            continue
        own = chars[at : at + n]
        if not own:
            issues.append(f"no characters are left for the token {piece!r}")
            continue
        tokens.append((piece, own[0][0], own[-1][1]))
        at += len(own)
    if at < len(chars):
        issues.append(f"{len(chars) - at} characters are left over")
    return tokens, issues


STREAM = "struct<ids:array<int>,issues:array<string>>"


def aligned_text(t: DataFrame, factory: Callable[[], Tokenizer], strict: bool = True, spaces: bool = True, rate: float = 12.5, pad: int = 3, end: int = 0) -> DataFrame:
    """Text streams by any tokenizer: did, speaker, ids, issues.

    Strict: a token without characters, characters left over or tokens without a frame are an error naming the unit;
    else they are in `issues` and the rest is placed. The words of one speaker of a unit are worked on together.
    """
    from dialoom.operators.align import slots_of

    @F.pandas_udf(STREAM)
    def stream(rows):
        import pandas as pd

        model, out = factory(), []
        for words in rows:
            tokens, issues = timed_tokens(model, [(w["word"], w["start"], w["end"]) for w in words], spaces)
            n = int((tokens[-1][2] + 1) * rate) if tokens else 0
            places = slots_of([int(a // (1 / rate)) for _, a, _ in tokens], n, strict=False)
            if len(places) < len(tokens):
                issues.append(f"no frame is left for {len(tokens) - len(places)} of {len(tokens)} tokens")
            ids = [pad] * n
            for (piece, _, _), (p, mark) in zip(tokens, places):
                ids[p] = model.piece_to_id(piece)
                if mark:
                    ids[p - 1] = end
            out.append((ids, issues))
        return pd.DataFrame(out, columns=["ids", "issues"])

    each = t.groupBy("did", "speaker").agg(F.array_sort(F.collect_list(F.struct("start", "idx", "end", "word"))).alias("_w"))
    x = each.withColumn("_s", stream("_w")).select("did", "speaker", "_s.ids", "_s.issues")
    if strict:
        wrong = F.raise_error(F.concat(F.lit("tokens don't fit the words of "), "did", F.lit(" "), "speaker", F.lit(": "), F.get("issues", F.lit(0)))).cast("array<int>")
        x = x.withColumn("ids", F.when(F.size("issues") == 0, F.col("ids")).otherwise(wrong))
    return x


def event_ids(text: Column, factory: Callable[[], Tokenizer], newline: bool = True) -> Column:
    """Ids of a text by any tokenizer, its lines one by one, joined by the newline's piece (T9); null is an empty text."""

    @F.pandas_udf("array<int>")
    def ids(texts):
        import pandas as pd

        model, out = factory(), []
        for text in texts:
            row: list[int] = []
            for i, line in enumerate((text or "").split("\n")):
                row += [model.piece_to_id("\n")] if i and newline else []
                row += [model.piece_to_id(p) for p in model.encode_as_pieces(line)]
            out.append(row)
        return pd.Series(out)

    return ids(text)


class SyntheticCodec:
    """Codes made of frame and codebook numbers, in place of a trained codec."""

    sample_rate, frame_rate, num_codebooks = 24_000, 12.5, 8

    def encode(self, samples) -> list[list[int]]:
        frames = -(-len(samples) // int(self.sample_rate / self.frame_rate))
        return [[(f * 31 + k * 17) % 2048 for f in range(frames)] for k in range(self.num_codebooks)]


def channel_codes(codec: Codec, samples, chunk_s: int = 1200) -> list[list[int]]:
    """Codes [codebook][frame] of one channel, in chunks of `chunk_s` seconds put together in time; their number must be
    that of the samples' frames (T8)."""
    size = chunk_s * codec.sample_rate
    rows: list[list[int]] = [[] for _ in range(codec.num_codebooks)]
    for a in range(0, len(samples), size):
        codes = codec.encode(samples[a : a + size])
        if len(codes) != codec.num_codebooks:
            raise ValueError(f"{len(codes)} codebooks instead of {codec.num_codebooks}")
        for row, more in zip(rows, codes):
            row.extend(int(c) for c in more)
    want = int(-(-len(samples) // (codec.sample_rate / codec.frame_rate)))
    if any(len(r) != want for r in rows):
        raise ValueError(f"{[len(r) for r in rows]} frames instead of {want}")
    return rows
