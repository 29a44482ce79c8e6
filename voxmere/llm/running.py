"""Running sums over a table of any size that is dealt by range, with hot keys spread over many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmere.llm.text import shared_checkpoint


def _starts(column: pa.Array, last: object, first: bool) -> np.ndarray:
    """True where a row's key differs from the row before; last is the key before the batch."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    new = np.empty(len(codes), dtype=bool)
    new[1:] = codes[1:] != codes[:-1]
    new[0] = first or column[0].as_py() != last
    return new


def _before(values: np.ndarray, new: np.ndarray, carry: int, xor: bool) -> tuple[np.ndarray, int]:
    """What came before each row within its key, and what the next batch's first row has before it if its key goes on."""
    run = np.bitwise_xor.accumulate(values) if xor else np.cumsum(values)
    at = np.maximum.accumulate(np.where(new, np.arange(len(values)), -1))
    ahead = np.concatenate([np.zeros(1, np.int64), run])  # of all earlier rows of the batch
    base = ahead[np.maximum(at, 0)]
    upto = run ^ base if xor else run - base
    went_on = at < 0
    upto[went_on] = upto[went_on] ^ carry if xor else upto[went_on] + carry
    return (upto ^ values if xor else upto - values), int(upto[-1])


def running(dealt: DataFrame, key: str | None, sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """The rows with `before_<c>` for each long column c of sums (or xors): the sum (or exclusive or) of c over the earlier
    rows of the same key.

    dealt must be dealt by range and sorted within its partitions, by key first (null is a key too; no key: one sequence
    of all rows). A key may fill any number of partitions: each task adds up its own stretch, and what earlier partitions
    hold of a partition's first key is added afterwards, from one row per partition. The rows are written once to the
    shared folder, so that both passes see the same stretches. No value may be null. An empty table stays empty.
    """
    columns, both = dealt.columns, [*sums, *xors]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, carry, last, leading = TaskContext.get().partitionId(), 0, dict.fromkeys(both, 0), None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            new = _starts(batch.column(key), last, not seen) if key else np.arange(n) == (-1 if seen else 0)
            more = {}
            for c in both:
                more[f"before_{c}"], carry[c] = _before(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64), new, carry[c], c in xors)
            lead = np.zeros(n, dtype=bool)
            if leading:
                later = np.flatnonzero(new[(1 if not seen else 0) :])
                end = int(later[0]) + (1 if not seen else 0) if len(later) else n
                lead[:end], leading = True, end == n
            arrays = [*batch.columns, *(pa.array(x, pa.int64()) for x in more.values())]
            arrays += [pa.array(np.full(n, part, np.int64)), pa.array(np.arange(seen, seen + n)), pa.array(lead)]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, *more, "part_", "seq_", "lead_"])
            seen += n
            last = batch.column(key)[n - 1].as_py() if key else None

    schema = T.StructType([*dealt.schema.fields, *(T.StructField(f"before_{c}", T.LongType()) for c in both), T.StructField("part_", T.LongType()), T.StructField("seq_", T.LongType()), T.StructField("lead_", T.BooleanType())])
    made = shared_checkpoint(dealt.mapInArrow(add, schema))
    upto = [F.col(f"before_{c}").bitwiseXOR(F.col(c)).alias(c) if c in xors else (F.col(f"before_{c}") + F.col(c)).alias(c) for c in both]
    row = F.struct(F.col(key).alias("key") if key else F.lit(0).alias("key"), *upto)
    ends = made.groupBy("part_").agg(F.min_by(row, "seq_").alias("first"), F.max_by(row, "seq_").alias("last"), F.bool_and("lead_").alias("whole")).orderBy("part_").collect()
    offsets, ahead, before = [], dict.fromkeys(both, 0), None
    for end in ends:  # one for each partition
        if before is None or before["key"] != end["first"]["key"]:
            ahead = dict.fromkeys(both, 0)
        offsets.append((end["part_"], *(ahead[c] for c in both)))
        upto_here = {c: end["last"][c] for c in both}
        ahead = {c: ahead[c] ^ upto_here[c] if c in xors else ahead[c] + upto_here[c] for c in both} if end["whole"] else upto_here
        before = end["last"]
    table = dealt.sparkSession.createDataFrame(offsets, T.StructType([T.StructField("part_", T.LongType()), *(T.StructField(f"ahead_{c}", T.LongType()) for c in both)]))
    fixed = made.join(F.broadcast(table), "part_", "left")

    def whole(c: str):
        mine, others = F.col(f"before_{c}"), F.when(F.col("lead_"), F.col(f"ahead_{c}")).otherwise(F.lit(0))
        return (mine.bitwiseXOR(others) if c in xors else mine + others).alias(f"before_{c}")

    return fixed.select(*columns, *(whole(c) for c in both))
