"""SimHash near-duplicates with pivot distance tables.

Two fingerprints link if at most `distance` of 64 bits differ. Cut into distance + 3 blocks, such a pair agrees in three
blocks at least, so every fingerprint is dealt to one group for each choice of three blocks. In a group, distances to
fixed reference fingerprints are computed once for each member; by the triangle inequality a pair whose distances to any
reference differ by more than `distance` can't link, and only pairs that no reference rules out are compared. A group
gives a spanning forest of its links, not all pairs. Groups over a size limit are dealt again by blocks of the bits that
are still free, where linked pairs must again agree in one of distance + 1.

Similarities of 0.8 leave fingerprints ten bits apart, too far for blocks. There (keep_one) groups come from bands of the
least hashes of the shingles; within a group the pivot table and the fingerprints discard pairs as before, at a wider
distance, and the survivors are verified by the sets of their shingles. Groups over a size in bytes are dealt in blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmere.llm.components import components
from voxmere.llm.text import mix64, shared_checkpoint, shared_folder, slices, word_bounds, word_hashes

PIVOTS = mix64(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
ALIKE = 3
LEVELS = 3
BANDS, BAND_ROWS = 16, 5
FAR = 24
GROUP_BYTES = 64 << 20
COMMON = 256
_ODD = mix64(np.arange(101, 101 + BANDS * BAND_ROWS, dtype=np.uint64)) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of a text in UTF-8: a bit is set if it is in over half of the shingles' hashes."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(found) - shingle + 1)
    starts, ends = starts[:n], ends[min(shingle, len(found)) - 1 :]
    of, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        part = starts[k : k + (1 << 15)].tolist()
        hashes = np.fromiter([of(joined[a:b], 42) for a, b in zip(part, ends[k : k + (1 << 15)].tolist(), strict=True)], np.uint64, len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a long; 0 for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(t, shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, fp long")


def _blocks(bits: list[int], n: int) -> list[int]:
    """Masks of n blocks of nearly equal size over the given bits."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), n)]


def _rows(of: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(of ^ bits)


def _forest(distance: int, verify=None):
    """A function that gives the places (a, b) of spanning forests of the links in runs of fingerprints."""

    def links(fps: np.ndarray, end: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """fps sorted within runs by the distance to the first reference; end: where each member's run ends; known: the first
        member that each is known to be connected with. Pairs that the references and the fingerprints leave are passed to
        verify(a, b), if there is one."""
        table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int16)
        root = np.arange(len(fps)) if known is None else known.copy()
        out_a, out_b = [], []
        left, step = np.arange(len(fps)), 0
        while True:
            step += 1
            left = left[left + step < end[left]]
            left = left[table[left + step, 0] - table[left, 0] <= distance]
            if not len(left):
                break
            a = left[root[left] != root[left + step]]
            for k in range(1, len(PIVOTS)):
                if not len(a):
                    break
                a = a[np.abs(table[a, k] - table[a + step, k]) <= distance]
            a = a[np.bitwise_count(fps[a] ^ fps[a + step]) <= distance]
            if verify is not None and len(a):
                a = a[verify(a, a + step)]
            for x in a.tolist():
                y = x + step
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out_a.append(x)
                    out_b.append(y)
            if len(a):
                while True:
                    up = root[root]
                    if (up == root).all():
                        break
                    root = up
        return np.array(out_a, np.int64), np.array(out_b, np.int64)

    return links


def _run_links(distance: int, most: int):
    """Spanning forests of the links in runs of equal (mask, key); members of runs over `most` come out with b null."""
    links = _forest(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        huge = None

        def give(mask: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(mask), pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], ["mask", "a", "b"])

        def solve(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            change = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate([[0], change])
            sizes = np.diff(np.concatenate([starts, [len(fp)]]))
            end = np.repeat(starts + sizes, sizes)
            a, b = links(fp.view(np.uint64), end)
            if len(a):
                yield give(np.zeros(len(a), np.int64), fp[a], fp[b])

        for batch in batches:
            mask, key, fp = (np.concatenate([old, new.to_numpy()]) for old, new in zip(kept, (batch.column(k) for k in range(3)), strict=True))
            if huge is not None:
                same = (mask == huge[0]) & (key == huge[1])
                if same.any():
                    yield give(mask[same], fp[same], None)
                mask, key, fp = mask[~same], key[~same], fp[~same]
            if not len(fp):
                kept = (mask, key, fp)
                continue
            last = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from _sized(solve, give, most, mask[:cut], key[:cut], fp[:cut])
            kept = (mask[cut:], key[cut:], fp[cut:])
            if len(kept[2]) > most:
                huge = (kept[0][0], kept[1][0])
                yield give(kept[0], kept[2], None)
                kept = tuple(x[:0] for x in kept)
        if len(kept[2]):
            yield from _sized(solve, give, most, *kept)

    return run


def _sized(solve, give, most: int, mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Solve all runs but those over the limit, which are given back."""
    change = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
    starts = np.concatenate([[0], change])
    sizes = np.diff(np.concatenate([starts, [len(fp)]]))
    sizes = np.repeat(sizes, sizes)
    if (over := sizes > most).any():
        yield give(mask[over], fp[over], None)
    small = (sizes <= most) & (sizes > 1)
    if small.any():
        yield from solve(mask[small], key[small], fp[small])


def link_fingerprints(fps: DataFrame, distance: int = ALIKE, most: int = 1 << 15) -> DataFrame:
    """(a, b): links whose components are those of all pairs within `distance` among the distinct longs in column fp."""
    blocks = _blocks(list(range(64)), distance + 3)
    masks = [sum(c) for c in combinations(blocks, 3)]
    rows = fps.select("fp").distinct().select(F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"), "fp")
    pivot = F.lit(_signed(int(PIVOTS[0])))
    out = None
    for level in range(LEVELS + 1):
        near: Column = F.bit_count(F.col("fp").bitwiseXOR(pivot))
        dealt = rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", near)
        limit = most if level < LEVELS else 1 << 62
        found = shared_checkpoint(dealt.mapInArrow(_run_links(distance, limit), "mask long, a long, b long"))
        edges = found.filter("b is not null").select("a", "b")
        out = edges if out is None else out.unionByName(edges)
        again = found.filter("b is null")
        if level == LEVELS or again.isEmpty():
            return out
        finer = {m: [m | b for b in _blocks([k for k in range(64) if not m >> k & 1], distance + 1)] for m in masks}
        masks = sorted({x for xs in finer.values() for x in xs})
        table = F.create_map(*(x for m, xs in finer.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(y)) for y in xs)))))
        rows = again.select(F.explode(table[F.col("mask")]).alias("mask"), F.col("a").alias("fp")).distinct()
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = ALIKE) -> DataFrame:
    """(id, fingerprint, component_id), one row for each row of docs.

    Texts without words, null texts too, have fingerprint zero and link like any others. component_id is the smallest id
    that links reach, null only if all of these ids are null. Copies share a fingerprint and meet only there, never as
    pairs.
    """
    marked = shared_checkpoint(fingerprints(docs, id_col, text_col, shingle))
    each = marked.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(link_fingerprints(each, distance))
    rooted = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = shared_checkpoint(rooted)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grams(texts: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, rows): hashes of all shingles of consecutive texts, and the text that each is from."""
    for lo, hi, data, offsets in slices(texts):
        data = _LOWER[data]
        starts, ends, firsts = word_bounds(data, offsets)
        words = word_hashes(data, starts, ends)
        text = np.repeat(np.arange(hi - lo), np.diff(firsts))
        grams = np.zeros(len(words), np.uint64)
        left = firsts[1:][text] - np.arange(len(words))
        for k in range(shingle):
            some = np.flatnonzero(left > k)
            grams[some] = grams[some] * PIVOTS[1] + words[some + k]
        whole = (left >= shingle) | (np.arange(len(words)) == firsts[text])
        yield lo, hi, mix64(grams[whole]), text[whole]


def _draw(shingle: int):
    """(key, fp, bands, mark_a, mark_b, size) of texts: fingerprint, keys of the bands, 128 bits that tell the shingles with
    their numbers, and how many there are. A row of a band is the least hash under one of BANDS * BAND_ROWS multipliers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, grams, text in _grams(batch.column(1), shingle):
                n = hi - lo
                ones, marks, least = np.zeros((n, 64), np.int64), np.zeros((2, n), np.uint64), np.full((len(_ODD), n), ~np.uint64(0))
                for k in range(0, len(grams), 1 << 15):
                    part, some = text[k : k + (1 << 15)], grams[k : k + (1 << 15)]
                    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                    at = part[begin]
                    bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
                    ones[at] += np.add.reduceat(bits, begin, axis=0)
                    for row, salt in enumerate(PIVOTS[2:4]):
                        marks[row, at] += np.add.reduceat(mix64(some ^ salt), begin)
                    for row, odd in enumerate(_ODD):
                        least[row, at] = np.minimum(least[row, at], np.minimum.reduceat(some * odd, begin))
                sizes = np.bincount(text, minlength=n)
                fps = np.packbits(ones * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()
                bands = np.zeros((n, BANDS), np.uint64)
                for k in range(BANDS):
                    for row in least[k * BAND_ROWS : (k + 1) * BAND_ROWS]:
                        bands[:, k] = mix64(bands[:, k] + row + np.uint64(k + 1))
                places = pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32))
                columns = [pa.array(fps.view(np.int64)), pa.ListArray.from_arrays(places, pa.array(bands.ravel().view(np.int64))), *(pa.array(m.view(np.int64)) for m in marks), pa.array(sizes)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), *columns], ["key", "fp", "bands", "mark_a", "mark_b", "size"])

    return run


def _sets(shingle: int):
    """(node, fp, grams) of rows (node, fp, text): the different shingles as rising hashes of 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, grams, text in _grams(batch.column(2), shingle):
                both = np.unique(text.astype(np.uint64) << np.uint64(32) | grams >> np.uint64(32))
                cuts = np.searchsorted(both, np.arange(hi - lo + 1, dtype=np.uint64) << np.uint64(32))
                low = (both & np.uint64(0xFFFFFFFF)).astype("<u4")
                cells = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((cuts * 4).astype(np.int32).tobytes()), pa.py_buffer(low.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), cells], ["node", "fp", "grams"])

    return run


def _verifier(sets: list[np.ndarray], least: float):
    """A function that says which pairs of places (a, b) have sets with a Jaccard similarity of `least` or more.

    Sizes, and how many hashes both have in each of 256 ranges, bound the common part from above, so they discard no pair
    that is alike; what they leave is intersected.
    """
    sizes = np.array([len(x) for x in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    ranges = np.bincount(rows * 256 + (np.concatenate(sets) >> 24 if sets else 0), minlength=len(sets) * 256).astype(np.int32).reshape(-1, 256)
    alike = lambda common, both: common * (1 + least) >= least * both - 1e-9

    def verify(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = sizes[a] + sizes[b]
        ok = alike(np.minimum(sizes[a], sizes[b]), both)
        some = np.flatnonzero(ok)
        for k in range(0, len(some), 1 << 12):
            at = some[k : k + (1 << 12)]
            ok[at] = alike(np.minimum(ranges[a[at]], ranges[b[at]]).sum(axis=1), both[at])
        for k in np.flatnonzero(ok).tolist():
            ok[k] = alike(len(np.intersect1d(sets[a[k]], sets[b[k]], assume_unique=True)), both[k])
        return ok

    return verify


def _set_links(distance: int, least: float):
    """Spanning forests (a, b) of the links in runs of equal task, beside the links known by equal `comp`; rows (task, node,
    comp, fp, grams) come sorted by task and the distance to the first reference."""

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        task, node, comp, fp = (rows.column(k).to_numpy() for k in range(4))
        starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(task)]]))
        run_of = np.repeat(np.arange(len(starts)), sizes)
        _, first, inverse = np.unique(np.stack([run_of, comp]), axis=1, return_index=True, return_inverse=True)
        sets = [np.frombuffer(x.as_buffer(), "<u4") for x in rows.column(4)]
        a, b = _forest(distance, _verifier(sets, least))(fp.view(np.uint64), np.repeat(starts + sizes, sizes), first[inverse.ravel()])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column(0).to_numpy()
            last = np.flatnonzero(task != task[-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and (cut or held[-1].column(0)[-1].as_py() != task[-1]):
                yield from solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from solve(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def link_sets(nodes: DataFrame, texts: DataFrame, shingle: int, least: float, distance: int = FAR, most_bytes: int = GROUP_BYTES, common: int = COMMON) -> DataFrame:
    """(a, b): links whose components are those of all pairs of nodes that share a band and have a similarity of `least`.

    nodes has rows (node, key, fp, bands, size), node being different longs; texts has (key, text). A pair of that
    similarity shares one of BANDS bands with probability 1 - (1 - least**BAND_ROWS)**BANDS, 0.998 at 0.8. Bands with the
    same members count once, and only their members' sets are made. A band whose sets are over `most_bytes` is dealt in
    blocks that all hold about `common` of its members too, so most of it is connected at once; then the nodes outside its
    largest part meet all others, again in blocks.
    """
    spark = nodes.sparkSession
    weight = (F.col("size") * 4 + 1024).alias("weight")
    rows = nodes.select(F.explode(F.array_distinct("bands")).alias("band"), "node", weight)
    # told by members, so that bands with the same ones are one
    members = (F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    groups = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("bytes"), *members).filter("n > 1")
    groups = shared_checkpoint(groups.groupBy("n", "x", "y").agg(F.min(F.struct("band", "bytes")).alias("g")).select("g.band", "g.bytes", "n"))
    met = shared_checkpoint(rows.join(groups, "band"))
    # a written table, so that Spark knows its size when it plans the join with the texts
    folder = f"{shared_folder(spark)}/near-{uuid.uuid4().hex}"
    nodes.join(met.select("node").distinct(), "node", "left_semi").select("key", "node", "fp").write.parquet(folder)
    wanted = texts.join(spark.read.parquet(folder), "key").select("node", "fp", "text")
    sets = shared_checkpoint(wanted.mapInArrow(_sets(shingle), "node long, fp long, grams binary").dropDuplicates(["node"]))
    near: Column = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(PIVOTS[0])))))

    def linked(dealt: DataFrame) -> DataFrame:
        full = dealt.join(sets, "node").select("task", "node", "comp", "fp", "grams").repartition("task").sortWithinPartitions("task", near)
        return shared_checkpoint(full.mapInArrow(_set_links(distance, least), "a long, b long"))

    parts = lambda size: F.greatest(F.ceil(size / most_bytes), F.lit(1))
    each = lambda n, task: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), task)
    place = lambda n: F.pmod(F.xxhash64("node", F.lit(2)), n)
    met = met.withColumn("blocks", parts(F.col("bytes")))
    shown = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(3)), F.col("n")) < common)
    task = F.when(shown, each(F.col("blocks"), lambda i: F.xxhash64("band", i))).otherwise(F.array(F.xxhash64("band", place(F.col("blocks")))))
    out = linked(met.select(F.explode(task).alias("task"), "node", F.col("node").alias("comp")))
    huge = met.filter("blocks > 1")
    if huge.isEmpty():
        return out
    roots = components(out)
    huge = shared_checkpoint(huge.join(roots, "node", "left").select("band", "node", "weight", F.coalesce("root", "node").alias("comp")))
    tops = huge.groupBy("band", "comp").agg(F.sum("weight").alias("w")).groupBy("band").agg(F.max(F.struct("w", "comp")).alias("top"), F.sum("w").alias("all"))
    tops = shared_checkpoint(tops.filter("all > top.w").select("band", "top.comp", parts(F.col("top.w")).alias("inner"), parts(F.col("all") - F.col("top.w")).alias("outer")).withColumnRenamed("comp", "top"))
    i, j = place(F.col("inner")), place(F.col("outer"))
    inside = each(F.col("outer"), lambda k: F.xxhash64("band", F.lit("in"), i, k))
    outside = F.concat(each(F.col("inner"), lambda k: F.xxhash64("band", F.lit("in"), k, j)), each(F.col("outer"), lambda k: F.xxhash64("band", F.lit("out"), F.least(j, k), F.greatest(j, k))))
    rest = huge.join(tops, "band").select(F.explode(F.when(F.col("comp") == F.col("top"), inside).otherwise(outside)).alias("task"), "node", "comp")
    return out.unionByName(linked(rest))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each group of near-duplicates, the one with the smallest id, with all its columns.

    Texts are near-duplicates if the sets of their shingles, words lower-cased, have a Jaccard similarity of `similarity`
    or more; the sets are compared themselves. Texts without words, null ones too, are copies of each other. Null ids come
    last, equal ids go by a hash of the text, and of equal rows one stays. Texts of any length are read whole; an empty
    table gives no rows.
    """
    key = F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"))
    packed = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = packed.schema["key"].dataType.simpleString()
    drawn = packed.select("key", "text").mapInArrow(_draw(shingle), f"key {kind}, fp long, bands array<long>, mark_a long, mark_b long, size long")
    nodes = drawn.groupBy("mark_a", "mark_b").agg(F.min("key").alias("key"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("size").alias("size"))
    # numbers are those of the one written copy
    nodes = shared_checkpoint(nodes.withColumn("node", F.monotonically_increasing_id()))
    roots = components(link_sets(nodes, packed.select("key", "text"), shingle, similarity))
    rooted = nodes.select("node", "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min("key").alias("kept")).select("kept")
    return packed.join(kept, F.col("key") == F.col("kept"), "left_semi").dropDuplicates(["key"]).select("row.*")
