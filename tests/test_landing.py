"""Landed uploads: waves, restarts, late parts, archives, jobs without a note, and jobs that can't be converted."""

import io
import time
import zipfile
from pathlib import Path

import numpy as np
import pytest

from voxmere.sources.images import png
from voxmere.sources.paths import scratch
from voxmere.streaming import landing


class Land:
    def __init__(self, spark, root):
        self.spark, self.root = spark, root
        self.blocks, self.checkpoint = scratch(spark), scratch(spark)

    def put(self, job, name, content):
        (self.root / job).mkdir(parents=True, exist_ok=True)
        (self.root / job / f".{name}").write_bytes(content)
        (self.root / job / f".{name}").rename(self.root / job / name)

    def run(self, quiet=60_000):
        landing.convert_landed(self.spark, str(self.root), self.blocks, self.checkpoint, quiet=quiet)

    def volumes(self):
        out = {}
        for r in landing.converted(self.spark, self.blocks).collect():
            out.setdefault(r["volume_id"], {})[r["x"], r["y"], r["z"]] = r["v"]
        return out

    def states(self):
        return {r["job_id"]: (r["status"], r["n_files"], r["nz"]) for r in landing.states(self.spark, self.blocks).collect()}


def image(k):
    return png(np.full((2, 3), k, "u1"))


def slices(*values):
    return {(x, y, z): v for z, v in enumerate(values) for x in range(3) for y in range(2)}


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name.replace("__", "/") + ".png", content)
    return out.getvalue()


@pytest.fixture
def land(spark, tmp_path):
    return Land(spark, tmp_path / "landed")


def test_waves_restart_and_late_part(land):
    land.put("a", "s2.png", image(2))
    land.put("a", "job.json", b'{"files": 3}')
    land.put("zip", "one.zip", archive(in__b=image(7), in__a=b"broken", MACOSX=image(1)))
    land.put("mixed", "x.png", image(1))
    land.put("mixed", "x.dcm", b"DICM")
    for job, n in (("zip", 1), ("mixed", 2), ("never", 1)):
        land.put(job, "job.json", f'{{"files": {n}}}'.encode())
    land.run()
    assert set(land.volumes()) == {"zip"} and land.states()["mixed"] == ("convert_error", 2, None)
    assert land.volumes()["zip"] == slices(1, 0, 7)
    land.put("a", "s1.png", image(1))
    land.put("a", "s3.png", image(3))
    land.run()
    assert land.volumes()["a"] == slices(1, 2, 3) and land.states()["a"] == ("converted", 3, 3)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in Path(land.blocks).rglob("*.parquet")}
    before = files()
    land.run()  # the same checkpoint, nothing new: nothing is read or written again
    assert files() == before
    land.put("a", "s0.png", image(9))  # a late part changes the places of all
    land.run()
    assert land.volumes() == {"a": slices(9, 1, 2, 3), "zip": slices(1, 0, 7)}


def test_without_a_note_quiet_decides(land):
    land.put("q", "1.png", image(5))
    land.run(quiet=300)
    time.sleep(0.5)
    land.put("other", "job.json", b'{"files": 9}')
    land.run(quiet=300)
    assert land.volumes() == {"q": slices(5)}


def test_a_batch_that_runs_twice(land):
    """A failure after the blocks were written, before the batch was noted: it runs again and leaves the same."""
    land.put("a", "1.png", image(5))
    land.put("a", "job.json", b'{"files": 1}')
    land.run()
    for note in Path(land.checkpoint).glob("commits/*"):
        if note.name.startswith(".") or note.name.isdigit():
            note.unlink()
    land.run()
    assert land.volumes() == {"a": slices(5)} and land.states() == {"a": ("converted", 1, 1)}


def test_a_job_is_converted_once_a_run(land, monkeypatch):
    """Its files come in six batches, five of which make it whole; the state has as many parts as the session says."""
    for k in range(6):
        land.put("a", f"{k}.png", image(k))
    land.put("a", "job.json", b'{"files": 2}')
    seen, real = [], landing.convert
    monkeypatch.setattr(landing, "convert", lambda files: seen.append(files) or real(files))
    before = land.spark.conf.get("spark.sql.shuffle.partitions")
    land.spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        landing.convert_landed(land.spark, str(land.root), land.blocks, land.checkpoint, files_a_batch=1)
    finally:
        land.spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1 and land.volumes() == {"a": slices(0, 1, 2, 3, 4, 5)} and land.states() == {"a": ("converted", 6, 6)}
    assert land.spark.getActiveSession()._jsparkSession.equals(land.spark._jsparkSession)  # the query's own session stays its own
    assert len([p for p in (Path(land.checkpoint) / "state" / "0").iterdir() if p.name.isdigit()]) == 2


def test_a_conversion_that_fails_is_made_up_for(land, monkeypatch):
    """The batches are over and noted, the conversion isn't: the next run does it though no file came since."""
    land.put("a", "1.png", image(5))
    land.put("a", "job.json", b'{"files": 1}')

    def fails(files):
        raise OSError("full")

    with monkeypatch.context() as m, pytest.raises(Exception, match="full"):
        m.setattr(landing, "convert", fails)
        land.run()
    land.run()
    assert land.volumes() == {"a": slices(5)} and land.states() == {"a": ("converted", 1, 1)}


def test_groups_go_over_batches():
    import pyarrow as pa

    from voxmere.sources.grouped import grouped

    rows = [(a, b, k) for k, (a, b) in enumerate([(1, 1), (1, 1), (1, 2), (2, 2), (2, 2), (2, 2), (2, 2), (3, 2)])]
    table = pa.table({n: [r[k] for r in rows] for k, n in enumerate("abk")})
    for size in range(1, 9):
        batches = [b for batch in table.to_batches(size) for b in (batch, batch.slice(0, 0))]
        assert [t.column("k").to_pylist() for t in grouped(iter(batches), ["a", "b"])] == [[0, 1], [2], [3, 4, 5, 6], [7]]
