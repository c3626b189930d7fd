"""Tokenised arrays in npz files, and tensors that were saved in shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_npz(spark: SparkSession, folder: str) -> DataFrame:
    """dialogue_id, name, shape, values (as doubles) of every array in the folder's npz files; nothing pickled is
    loaded, and an unreadable file has one row with a null name, so that it can be made again (S11)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder).select("path", "content")

    def load(batches):
        import io
        import zipfile

        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        rows += [(stem, k, list(z[k].shape), z[k].ravel().astype(float).tolist()) for k in z.files]
                except (ValueError, OSError, zipfile.BadZipFile):
                    rows.append((stem, None, None, None))
            yield pd.DataFrame(rows, columns=["dialogue_id", "name", "shape", "values"])

    return raw.mapInPandas(load, "dialogue_id string, name string, shape array<int>, values array<double>")


def write_npz(rows: DataFrame, folder: str, key: str = "dialogue_id") -> DataFrame:
    """Writes one compressed npz file per row, named by its key, with the row's other columns as arrays (K2), and gives
    key and path of each. The folder must be one that all executors share. A file gets its name when it is whole, so a
    failure leaves no part of one; an attempt that is repeated writes the same file again."""
    names = [c for c in rows.columns if c != key]
    kinds = {f.name: "i4" if "int" in f.dataType.simpleString() else "f8" for f in rows.schema}

    def save(batches):
        import os
        import uuid

        import numpy as np
        import pandas as pd

        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            done = []
            for row in pdf.to_dict("records"):
                path, temp = f"{folder}/{row[key]}.npz", f"{folder}/.{row[key]}.{uuid.uuid4().hex}.part"
                try:
                    with open(temp, "wb") as f:
                        np.savez_compressed(f, **{n: np.array([np.asarray(x) for x in row[n]] if kinds[n] and len(row[n]) and hasattr(row[n][0], "__len__") else row[n], dtype=kinds[n]) for n in names})
                    os.replace(temp, path)
                except BaseException:
                    if os.path.exists(temp):
                        os.remove(temp)
                    raise
                done.append((row[key], path))
            yield pd.DataFrame(done, columns=[key, "path"])

    return rows.mapInPandas(save, f"{key} {rows.schema[key].dataType.simpleString()}, path string")


# The arrays of a tokenised event file.
EVENT_ARRAYS = [f"{s}_{c}" for s in "AB" for c in ("event_frame_pos", "event_ratio", "event_skip_forbid", "pred_values", "pred_offsets", "hint_values", "hint_offsets")]


def valid_event_files(npz: DataFrame) -> DataFrame:
    """Ids whose file is readable and has all 14 event arrays, the offsets one longer than the positions (S11). `npz` is
    what read_npz gives."""
    size = lambda k: F.max(F.when(F.col("name") == k, F.size("values")))
    fits = [(size(f"{s}_{p}_offsets") == size(f"{s}_event_frame_pos") + 1).alias(f"{s}{p}") for s in "AB" for p in ("pred", "hint")]
    x = npz.groupBy("dialogue_id").agg(F.count_distinct(F.when(F.col("name").isin(*EVENT_ARRAYS), F.col("name"))).alias("_n"), *fits)
    return x.filter((F.col("_n") == len(EVENT_ARRAYS)) & F.col("Apred") & F.col("Ahint") & F.col("Bpred") & F.col("Bhint")).select("dialogue_id")


def reassembled(shards: DataFrame, ranks: int, alignment: int | None = None) -> DataFrame:
    """Parameters from shards of flat values: param, values (R1). A missing or extra rank is an error naming the
    parameter; so are values that are too few.

    Without `alignment`, `shards` has param, rank, n (true length) and values: each rank holds ceil(n / ranks) values of
    every parameter, the last ones padded. With it, `shards` has group, rank and values, where the ranks of a group put
    together hold its parameters one after the other; `params_of` cuts them.
    """
    key = "param" if alignment is None else "group"
    parts = shards.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "values"))).alias("p"), F.max("n" if alignment is None else F.lit(0)).alias("n"), F.countDistinct("rank").alias("k"), F.count(F.lit(1)).alias("m"))
    whole = (F.col("k") == ranks) & (F.col("m") == ranks)
    flat = F.flatten("p.values")
    fits = F.size(flat) >= F.col("n") if alignment is None else F.size(flat) % (alignment * ranks) == 0
    values = F.slice(flat, F.lit(1), F.col("n")) if alignment is None else flat
    return parts.select(key, F.when(whole & fits, values).otherwise(F.raise_error(F.concat(F.lit("shards don't fit: "), F.col(key).cast("string"))).cast("array<double>")).alias("values"))


def params_of(groups: DataFrame, params: DataFrame, alignment: int) -> DataFrame:
    """Parameters cut from whole groups one after the other: param, values. `groups` has group and values, `params` group,
    ord, param and n. What the parameters leave over must be less than the alignment pads to, else it is an error."""
    w = Window.partitionBy("group").orderBy("ord")
    at = params.withColumns({"_at": F.sum("n").over(w) - F.col("n"), "_all": F.sum("n").over(Window.partitionBy("group"))})
    x = at.join(groups, "group")
    padded = F.ceil(F.col("_all") / alignment) * alignment
    return x.select("param", F.when(F.size("values") == padded, F.slice("values", (F.col("_at") + 1).cast("int"), F.col("n"))).otherwise(F.raise_error(F.concat(F.lit("values left over or lacking in group "), F.col("group").cast("string"))).cast("array<double>")).alias("values"))


def natural_order(name: str) -> list:
    """Sort key of a file name in which digit runs count as numbers."""
    import re

    return [(0, int(x)) if x.isdigit() else (1, x) for x in re.split(r"(\d+)", name) if x]
