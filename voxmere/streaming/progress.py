"""Progress of jobs from two streams: blocks as they are finished, and how many each job has."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


class Progress(StatefulProcessor):
    """Per job its finished blocks, each once, and their total; forgotten `keep` milliseconds after the last news of it."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "block_id long", "seen boolean")
        self.counts = handle.getValueState("counts", "done long, total long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done, total = self.counts.get() if self.counts.exists() else (0, None)
        for frame in rows:
            now = int(frame["at"].max().timestamp() * 1000)
            for block, said in zip(frame["block_id"], frame["total"], strict=True):
                if not pd.isna(said):
                    total = int(said)
                if not pd.isna(block) and not self.blocks.containsKey((int(block),)):
                    self.blocks.updateValue((int(block),), (True,))
                    done += 1
        self.counts.update((done, total))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.keep)
        ratio = None if total is None else min(1.0, done / total) if total else 1.0
        yield pd.DataFrame({"job_id": [key[0]], "done": [done], "total": pd.array([total], "Int64"), "progress": pd.array([ratio], "Float64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.blocks.clear()
        self.counts.clear()
        yield from ()

    def close(self) -> None:
        pass


def job_progress(finished: DataFrame, totals: DataFrame, keep: int = 7 * 24 * 3_600_000) -> DataFrame:
    """Streams (job_id, block_id) and (job_id, total) to updates (job_id, done, total, progress), in any order of either.

    A block that is told twice counts once. progress is null until the total is known, and reaches 1 with the last block.
    """
    both = finished.select("job_id", "block_id", F.lit(None).cast("long").alias("total")).unionByName(totals.select("job_id", F.lit(None).cast("long").alias("block_id"), "total"))
    timed = both.withColumn("at", F.current_timestamp()).withWatermark("at", "0 seconds")
    return timed.groupBy("job_id").transformWithStateInPandas(Progress(keep), "job_id long, done long, total long, progress double", "Update", "eventTime")
