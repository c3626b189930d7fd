"""The built-in tokenizer, as column expressions; a real one plugs in as a pandas UDF with the same results.

Pieces are up to four characters of a word led by the mark of a word's start, so that pieces keep the length of
the text. Ids lie in [4, 31999] and never meet the reserved ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK, LONGEST, RESERVED, VOCABULARY = "▁", 4, 4, 32000
NEWLINE = 13


def pieces(word: Column, marked: Column | bool = True) -> Column:
    """Pieces of one word, led by the mark unless it is not `marked`."""
    lead = F.lit(MARK) if marked is True else F.when(marked, MARK).otherwise("")
    return F.regexp_extract_all(F.concat(lead, word), F.lit(f"(?s).{{1,{LONGEST}}}"), F.lit(0))


def piece_id(piece: Column) -> Column:
    return (F.conv(F.substring(F.md5(piece), 1, 7), 16, 10).cast("long") % (VOCABULARY - RESERVED) + RESERVED).cast("int")


def text_ids(text: Column, newline: int | None = NEWLINE) -> Column:
    """Ids of a text: its lines one by one, joined by the newline's id if the tokenizer has one."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    words = lambda line: F.filter(F.split(line, " "), lambda w: w != "")
    ids = lambda line: F.flatten(F.transform(words(line), lambda w: F.transform(pieces(w), piece_id)))
    if newline is None:
        return F.flatten(F.transform(lines, ids))
    join = F.array(F.lit(newline))
    return F.flatten(F.transform(lines, lambda line, i: F.when(i == 0, ids(line)).otherwise(F.concat(join, ids(line)))))
