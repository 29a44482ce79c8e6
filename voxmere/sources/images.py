"""Image stacks: a folder of image files, one for each z, and the same as a landed table (name, content).

Folders of 8-bit images of any kind are read by Spark's image source; tables by a reader for PNG of 8 or 16 bits.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from voxmere.operators.region import volume
from voxmere.sources.grouped import grouped
from voxmere.sources.paths import opened, qualified, scratch

#: colour type of a PNG: how many channels a pixel has
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def png(pixels: np.ndarray) -> bytes:
    """A PNG of 8 or 16 bits: gray from (height, width), colour from (height, width, 3)."""
    height, width = pixels.shape[:2]
    depth, colour = pixels.dtype.itemsize * 8, 2 if pixels.ndim == 3 else 0
    raw = b"".join(b"\0" + row.astype(f">u{depth // 8}").tobytes() for row in pixels)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Bytes of an image whose rows each begin with the kind of their filter; step is the width of a pixel in bytes."""
    out = np.zeros((len(raw), raw.shape[1] - 1), np.uint8)
    above = np.zeros(raw.shape[1] - 1, np.uint8)
    for k, row in enumerate(raw):
        kind, line = row[0], row[1:].copy()
        if kind == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            got, up = line.tolist(), above.tolist()
            for i in range(len(got)):
                left, over, corner = (got[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
                near = min((abs(over - corner), 0, left), (abs(left - corner), 1, over), (abs(left + over - 2 * corner), 2, corner))[2]
                got[i] = (got[i] + (near if kind == 4 else (left + over) // 2)) % 256
            line = np.array(got, np.uint8)
        elif kind > 4:
            raise ValueError("unknown filter")
        out[k] = above = line
    return out


def decode(content: bytes) -> np.ndarray | None:
    """First channel of a PNG of 8 or 16 bits that isn't interlaced and has no palette, None if it can't be read."""
    try:
        width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", content[16:29])
        if depth not in (8, 16) or colour not in CHANNELS or interlaced:
            return None
        at, data = 8, b""
        while at < len(content):
            (size,), kind = struct.unpack(">I", content[at : at + 4]), content[at + 4 : at + 8]
            data += content[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
            at += size + 12
        step = CHANNELS[colour] * depth // 8
        rows = unfiltered(np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * step), step)
        return rows.view(f">u{depth // 8}").reshape(height, width, -1)[:, :, 0].astype(np.int64)
    except (struct.error, zlib.error, ValueError):
        return None


#: Rows that a task makes one by one go on in batches of so many, or of so many bytes.
ROWS, BYTES = 4096, 1 << 20


def together(rows: Iterable[tuple[object, int]]) -> Iterator[list]:
    """Rows, each given with its bytes, in lists of bounded size; a large row is passed on at once."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if len(held) >= ROWS or size >= BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def gray(image: np.ndarray, z: int) -> np.ndarray:
    return image


def png_rows(voxels: DataFrame, dtype: str = "u1", name: str = "{:09d}.png", paint: Callable[[np.ndarray, int], np.ndarray] = gray) -> DataFrame:
    """(name, z, content): one encoded image for each slice; x runs along a row. paint(image, z) may add colours.

    Where rows have a volume_id, so does the result, and its names lie in a folder of that name.
    """
    keys = [*volume(voxels), "z"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[dict, int]]:
            for rows in grouped(batches, keys):
                x, y, v = (rows.column(k).to_numpy() for k in "xyv")
                own = {k: rows.column(k)[0].as_py() for k in keys}
                image = np.zeros((y.max() + 1, x.max() + 1), dtype)
                image[y, x] = v
                folder = "".join(f"{own[k]}/" for k in keys[:-1])
                content = png(paint(image, own["z"]))
                yield {**own, "name": folder + name.format(own["z"]), "content": content}, len(content)

        for some in together(each()):
            yield pa.RecordBatch.from_pylist(some, schema)

    kept = "".join(f"{k} {voxels.schema[k].dataType.simpleString()}, " for k in keys[:-1])
    result = f"{kept}name string, z long, content binary"
    schema = to_arrow_schema(StructType.fromDDL(result))
    return voxels.select(*keys[:-1], "x", "y", "z", "v").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(encode, result)


def broken(rows: DataFrame, every: int) -> DataFrame:
    """rows with every so many files cut short."""
    return rows.withColumn("content", F.when(F.col("z") % every == 0, F.substring("content", 1, 20)).otherwise(F.col("content")))


def write_files(rows: DataFrame, folder: str) -> None:
    """Each row (name, content) as one file of the folder, or of a folder below it that its name gives.

    A file is written under a hidden name and moved when it is whole, so who watches the folder never sees half of one; a task
    that runs again writes the same files once more.
    """
    target = qualified(rows.sparkSession, folder)

    def written(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = opened(target)
        for frame in frames:
            for below in {posixpath.dirname(name) for name in frame["name"]}:
                system.create_dir(posixpath.join(path, below))
            for name, content in zip(frame["name"], frame["content"], strict=True):
                whole = posixpath.join(path, name)
                part = posixpath.join(posixpath.dirname(whole), f".{uuid.uuid4().hex}")
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, whole)
            yield pd.DataFrame({"n": [len(frame)]})

    rows.select("name", "content").mapInPandas(written, "n long").agg(F.sum("n")).collect()


def spread(images: DataFrame, read: Callable[[pd.Series], np.ndarray | None], width: int | None = None, height: int | None = None) -> DataFrame:
    """Pixels (stack, name, z, x, y, v) of images; one that can't be read is a slice of zeros of the given size, or of the size in
    its own columns w and h, or else an error."""

    def pixels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each() -> Iterator[tuple[tuple, int]]:
            for frame in frames:
                for row in frame.itertuples():
                    image = read(row)
                    if image is None:
                        size = (height, width) if width is not None else (getattr(row, "h", None), getattr(row, "w", None))
                        if size[0] is None:
                            raise ValueError(f"{row.name} can't be read")
                        image = np.zeros(tuple(map(int, size)), np.int64)
                    y, x = np.indices(image.shape)
                    yield (row.stack, row.name, row.z, x.ravel(), y.ravel(), image.ravel()), 8 * image.size

        for some in together(each()):
            *names, xs, ys, vs = zip(*some, strict=True)
            sizes = [len(v) for v in vs]
            own = {k: np.repeat(np.array(c, object if k != "z" else np.int64), sizes) for k, c in zip(("stack", "name", "z"), names, strict=True)}
            yield pd.DataFrame({**own, "x": np.concatenate(xs), "y": np.concatenate(ys), "v": np.concatenate(vs)})

    return images.mapInPandas(pixels, "stack string, name string, z long, x long, y long, v long")


def placed(images: DataFrame, names: DataFrame) -> DataFrame:
    """images with z, a file's rank by name in its stack. Only names are ranked, and images are joined before they spread."""
    order = names.select("stack", "name").withColumn("z", (F.row_number().over(Window.partitionBy("stack").orderBy("name")) - 1).cast("long"))
    return images.join(order, ["stack", "name"])


def write_stack(voxels: DataFrame, broken_every: int = 0) -> str:
    """Slices as rows of a Parquet table (name, content), as an upload folder is landed; some can be cut short."""
    rows = png_rows(voxels)
    path = scratch(voxels.sparkSession)
    (broken(rows, broken_every) if broken_every else rows).select("name", "content").write.parquet(path)
    return path


def read_stack(spark: SparkSession, path: str, width: int | None = None, height: int | None = None) -> DataFrame:
    """Voxels of landed images; rows of several stacks have a column volume_id. A broken file is zeros of the given size."""
    files = spark.read.parquet(path)
    keys = volume(files)
    named = files.select((F.col(keys[0]).cast("string") if keys else F.lit("")).alias("stack"), "name", "content")
    found = spread(placed(named, named), lambda row: decode(bytes(row.content)), width, height)
    kept = [F.col("stack").cast(files.schema[k].dataType).alias(k) for k in keys]
    return found.select(*kept, "x", "y", "z", "v")


def first_of(row) -> np.ndarray | None:
    """First channel of an image as Spark's source gives it: blue, green, red where there are three or more."""
    if row.height < 0:
        return None
    image = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)
    return image[:, :, 2 if row.nChannels >= 3 else 0].astype(np.int64)


def read_folder(spark: SparkSession, folder: str, width: int | None = None, height: int | None = None, glob: str = "*") -> DataFrame:
    """Voxels (stack, name, x, y, z, v) of image files of 8 bits; stack is the whole path of the folder that holds a file, so folders
    of one name stay apart, and name is the file's name there."""
    place = lambda c: (F.regexp_extract(F.regexp_replace(c, "^file:/+", "file:/"), "^(.*)/[^/]*$", 1).alias("stack"), F.regexp_extract(c, "([^/]*)$", 1).alias("name"))
    images = spark.read.format("image").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    origin = F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B")))  # the image source gives an encoded URI
    named = images.select(*place(origin), "image.height", "image.width", "image.nChannels", "image.data")
    names = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return spread(placed(named, names.select(*place(F.col("path")))), first_of, width, height).select("stack", "name", "x", "y", "z", "v")
