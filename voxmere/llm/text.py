"""Small helpers that the text operators share.

A word is a run of characters other than ASCII white space (0x20, 0x09-0x0D); a null text has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = "[ \\t-\\r]+"
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)


def words(text: Column) -> Column:
    """Array of words, in Catalyst expressions."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares, as the session names it in spark.checkpoint.dir; an error where it names none, as a
    folder of this machine would not be seen by the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over unsigned 64-bit values; works on its argument."""
    h ^= h >> np.uint64(30)
    h *= MIX_A
    h ^= h >> np.uint64(27)
    h *= MIX_B
    h ^= h >> np.uint64(31)
    return h


def slices(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about most_bytes; one long text stays whole."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=texts.offset + len(texts) + 1)[texts.offset :]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most_bytes, side="right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and for each text the index of its first word (one more at the end)."""
    black = ~_IS_WHITE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before, after = np.empty_like(black), np.empty_like(black)
    if len(black):
        before[0], before[1:] = False, black[:-1]
        after[-1], after[:-1] = False, black[1:]
    starts = np.flatnonzero(black & (~before | cut[:-1]))
    ends = np.flatnonzero(black & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, the same in every process."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    left = ends - starts
    h = mix64(left.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    h ^= lanes[starts] & _MASKS[np.minimum(left, 8)]
    h = mix64(h)
    more, at = np.flatnonzero(left > 8), 8
    while len(more):
        h[more] = mix64(h[more] ^ (lanes[starts[more] + at] & _MASKS[np.minimum(left[more] - at, 8)]))
        at += 8
        more = more[left[more] > at]
    return h


def cut_chunks(texts: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """(key, idx, total, text) from rows (key, text): the stretches of `size` characters of each text, numbered from 0, with
    `before` characters ahead of them and `after` behind, and the whole length. A text is read once, whatever its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key, text = batch.column(0).slice(row, 1), batch.column(1)[row].as_py()
                for idx in range((len(text) - 1) // size + 1):
                    part = text[max(0, idx * size - before) : (idx + 1) * size + after]
                    yield pa.RecordBatch.from_arrays([key, pa.array([idx], pa.int64()), pa.array([len(text)], pa.int64()), pa.array([part], pa.string())], ["key", "idx", "total", "text"])

    return texts.select("key", "text").mapInArrow(cut, "key string, idx long, total long, text string").repartition(F.col("key"), F.col("idx"))
