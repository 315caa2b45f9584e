"""Shared helpers of the training-data operators: the folder that all executors share, and word columns in Arrow."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only in local mode, where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="plantlens-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and rereads it: lineage ends here, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of columns has, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*columns: str) -> list[Column]:
    """uid and vid, together 128 bits that depend on the columns; neither is ever null."""
    return [F.xxhash64(*columns).alias("uid"), F.xxhash64(F.lit(1), *columns).alias("vid")]


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose texts have at most max_bytes bytes together, or a single row."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row, code and dictionary of the words of some texts, A-Z lower-cased; null counts as empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    rows, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    keep = pc.greater(pc.binary_length(words), 0)
    rows, words = rows.filter(keep), words.filter(keep)
    coded = words.dictionary_encode()
    return rows.to_numpy(zero_copy_only=False).astype(np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hashes_of(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
