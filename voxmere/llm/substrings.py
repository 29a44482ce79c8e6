"""Substring dedup by seed and extend.

Seeds: among the hashes of `gram` consecutive words in each window the least is its anchor (winnowing), so equal windows
have equal anchors; consecutive windows with the same anchor form one seed. Documents meet on anchors. Extension: seeds
that agree in all words of their windows are one class, whose first member keeps its words and whose others repeat it.
Where an anchor has several classes, the seeds share only a part; their windows are then compared one by one, which
gives the maximal common stretches of `window` words or more. Equal seeds are combined before each shuffle, so a hot
passage sends one row for each task and not one for each copy. Anchors that stand among very many different words are
dealt by class: which ones is learned from a sample of the texts and changes only where rows go, not what is found.

A row is known by its id and 64 bits of hash of its text; a stretch of it by its first window, one bit that says whether
it repeats an earlier one, and its number of windows, packed into one long as `place`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmere.llm.text import mix64, shared_checkpoint, slices, word_bounds, word_hashes

WINDOW, GRAM = 20, 6
FLUSH = 1 << 20
BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
NO_ID = -(1 << 63)
COUNT_BITS = 20
REPEATS = 1 << COUNT_BITS
FIRST = COUNT_BITS + 1
HOT_SHARE, HOT_SAMPLE = 1024, 0.01
_U = np.uint64


def _rolled(hashes: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of every run of `length` words, by doubling."""
    times = lambda a, b: np.uint64(int(a) * int(b) & 0xFFFFFFFFFFFFFFFF)
    out, have, power, block, size = None, 0, base, hashes, 1
    while size <= length:
        if length & size:
            if out is None:
                out, have, out_power = block, size, power
            else:
                n = len(hashes) - have - size + 1
                out = block[: max(n, 0)] * out_power + out[size : size + max(n, 0)] if n > 0 else hashes[:0]
                have += size
                out_power = times(out_power, power)
        if size * 2 <= length:
            n = len(block) - size
            block = block[: max(n, 0)] * power + block[size : size + max(n, 0)] if n > 0 else hashes[:0]
            power = times(power, power)
        size *= 2
    return out


def _window_hashes(hashes: np.ndarray, window: int, lane: int) -> np.ndarray:
    return mix64(_rolled(hashes, window, BASES[lane]).copy())


def _seeds(hashes: np.ndarray, firsts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, class, text index, first window, number of windows) of all seeds; firsts: each text's first word."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    n = len(hashes) - window + 1
    if n < 1:
        return none
    grams = mix64(_rolled(hashes, gram, BASES[1]).copy())
    size, span = 1, window - gram + 1
    at = np.arange(len(grams))
    while size * 2 <= span:
        a, b = at[:-size], at[size:]
        at = np.where(grams[b] <= grams[a], b, a)
        size *= 2
    if size < span:
        a, b = at[: len(at) - (span - size)], at[span - size :]
        at = np.where(grams[b] <= grams[a], b, a)
    at = at[:n]
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))[:n]
    whole = np.arange(n) + window <= firsts[text + 1]
    begins = whole.copy()
    begins[1:] &= ~whole[:-1] | (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    lo = np.flatnonzero(begins)
    if not len(lo):
        return none
    count = np.add.reduceat(whole.astype(np.int64), lo)
    windows = _window_hashes(hashes, window, 0)
    kind = mix64(windows[lo] * BASES[0] + windows[lo + count - 1] * BASES[1] + count.astype(np.uint64))
    return grams[at[lo]], kind, text[lo], lo - firsts[text[lo]], count


def _equal(columns: list[np.ndarray], before: tuple | None = None) -> np.ndarray:
    """Which rows equal the one before them in all columns; `before` is the row ahead of the first."""
    out = np.zeros(len(columns[0]), bool)
    if len(out):
        out[0] = before is not None and all(x == c[0] for x, c in zip(before, columns, strict=True))
        out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


_NAMES = ["a", "b", "key", "mark", "place"]
_DDL = "a long, b long, key long, mark long, place long"
_ROWS = ["key", "mark", "place"]
_ROWS_DDL = "key long, mark long, place long"


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)


def _combined(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Rows of a flush, equal ones once; those with an earlier equal seed are marked as repeats and dealt by their document."""
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    once = ~_equal(columns)
    a, b, key, mark, place = columns = [c[once] for c in columns]
    old = _equal(columns[:2])
    place[old] |= REPEATS
    a[old] = mix64(key[old].view(np.uint64) * BASES[0] + mark[old].view(np.uint64)).view(np.int64)
    return _batch(columns, _NAMES)


def _deal_seeds(window: int, gram: int):
    """Rows (a, b, key, mark, place) of all seeds: their anchor, their class, and where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            keys, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, _, data, offsets in slices(batch.column(2)):
                starts, ends, firsts = word_bounds(data, offsets)
                anchor, kind, text, first, count = _seeds(word_hashes(data, starts, ends), firsts, window, gram)
                if not len(anchor):
                    continue
                text = text + lo
                parts.append((anchor.view(np.int64), kind.view(np.int64), keys[text], marks[text], first << FIRST | count))
                rows += len(anchor)
                if rows >= FLUSH:
                    yield _combined(parts)
                    parts, rows = [], 0
        if parts:
            yield _combined(parts)

    return run


def _split_classes(hot: np.ndarray | None):
    """Over rows sorted by _NAMES: repeats (flag set), and the first of each class where its anchor `a` has several
    classes or is one of the sorted `hot` ones (flag clear). Without `hot` only the repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row: tuple | None = None
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        alone = True
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            old = (columns[4] & REPEATS) != 0
            out = [[c[old]] for c in columns[2:]]
            columns = [c[~old] for c in columns]
            again = _equal(columns, row)
            ends = None if row is None else row[:2]
            row = tuple(c[-1] for c in columns) if len(again) else row
            columns = [c[~again] for c in columns]
            if len(columns[0]):
                new_a, new = ~_equal(columns[:1], ends and ends[:1]), ~_equal(columns[:2], ends)
                for k, c in enumerate(columns[2:]):
                    out[k].append(c[~new] | REPEATS if k == 2 else c[~new])
                if hot is not None and new.any():
                    rows = [np.concatenate([h, c[new]]) for h, c in zip(held, columns[2:], strict=True)]
                    known = np.isin(columns[0][new], hot) if len(hot) else np.zeros(int(new.sum()), bool)
                    begins = np.concatenate([np.full(len(held[0]), alone), new_a[new] & ~known])
                    shared = ~begins
                    shared[:-1] |= ~begins[1:] & ~np.concatenate([np.zeros(len(held[0]), bool), known])[1:]
                    for k, c in enumerate(rows):
                        out[k].append(c[:-1][shared[:-1]])
                    held, alone = [c[-1:] for c in rows], bool(begins[-1])
            yield _batch([np.concatenate(x) for x in out], _ROWS)
        if hot is not None and len(held[0]) and not alone:
            yield _batch(held, _ROWS)

    return run


def _deal_windows(window: int):
    """Single windows of the seeds in the list column, as rows like those of _deal_seeds with one window each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            keys, marks, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for lo, hi, data, offsets in slices(batch.column(2)):
                starts, ends, firsts = word_bounds(data, offsets)
                hashes = word_hashes(data, starts, ends)
                if len(hashes) < window:
                    continue
                one, two = (_window_hashes(hashes, window, lane).view(np.int64) for lane in (0, 1))
                for k in range(lo, hi):
                    places = lists[k].values.to_numpy()
                    count = places & (REPEATS - 1)
                    first = np.repeat(places >> FIRST, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    at = first + firsts[k - lo]
                    parts.append((one[at], two[at], np.full(len(at), keys[k]), np.full(len(at), marks[k]), first << FIRST | 1))
                    rows += len(at)
                if rows >= FLUSH:
                    yield _combined(parts)
                    parts, rows = [], 0
        if parts:
            yield _combined(parts)

    return run


def _without(window: int, texts: bool):
    """Each text without the words of its repeated windows: counts, digest and, if asked for, the words kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = text.split()
                n_words.append(len(found))
                places = places.values
                if places is not None and len(places):
                    places = places.to_numpy()
                    first, count = places >> FIRST, places & (REPEATS - 1)
                    depth = np.zeros(len(found) + 1, np.int64)
                    np.add.at(depth, first, 1)
                    np.add.at(depth, first + count + (window - 1), -1)
                    stays = np.cumsum(depth[:-1]) == 0
                    n_removed.append(len(found) - int(stays.sum()))
                    found = list(compress(found, stays.tolist()))
                else:
                    n_removed.append(0)
                kept = b" ".join(found)
                digests.append(hashlib.sha256(kept).hexdigest())
                if texts:
                    kept_texts.append(kept.decode())
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept_texts, pa.string())] if texts else []), names + (["kept"] if texts else []))

    return run


def _hot_anchors(rows: DataFrame, window: int, gram: int) -> np.ndarray:
    """Sorted anchors that a sample of the rows has in several classes and in 1/HOT_SHARE of its seeds or more, so at most HOT_SHARE."""
    seeds = rows.sample(HOT_SAMPLE, 7).mapInArrow(_deal_seeds(window, gram), _DDL).filter(F.col("place").bitwiseAND(F.lit(REPEATS)) == 0)
    counts = seeds.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("least"), F.max("b").alias("most"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)))
    often = counts.crossJoin(F.broadcast(total.toDF("total"))).filter(f"least <> most and n >= 8 and n * {HOT_SHARE} >= total")
    return np.sort(np.array([r["a"] for r in often.select("a").collect()], np.int64))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]), one row for each row of docs, over whole texts.

    A word goes if it lies in a window of `window` words that also starts earlier: in a text with a smaller id, or earlier
    in the same text. All is judged on the input. Ids are integers; a null id counts as smaller than any other, rows with
    equal ids go by a hash of the text, and equal rows keep the same words. A null text has no words, an empty table gives
    no rows, other columns are not read. Windows are compared by 128 bits of hash.
    """
    if not gram <= window < REPEATS:
        raise ValueError(f"a window has gram ({gram}) words at least and fewer than {REPEATS}")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    narrow = base.select("key", "mark", "text")
    hot = _hot_anchors(narrow, window, gram)
    seeds = narrow.mapInArrow(_deal_seeds(window, gram), _DDL)
    salt = F.when(F.col("a").isin(hot.tolist()), F.col("b")).otherwise(F.lit(0).cast("long")) if len(hot) else F.lit(0)
    met = seeds.repartition("a", salt).sortWithinPartitions(*_NAMES)
    found = shared_checkpoint(met.mapInArrow(_split_classes(hot), _ROWS_DDL))
    flag = F.col("place").bitwiseAND(F.lit(REPEATS))
    listed = lambda rows: rows.groupBy("key", "mark").agg(F.collect_list("place").alias("places"))
    # id goes along so that this join and the last one read one shuffle of the texts
    partly = base.join(listed(found.filter(flag == 0)), ["key", "mark"]).dropDuplicates(["key", "mark"])
    windows = partly.select("key", "mark", "text", "places", "id").mapInArrow(_deal_windows(window), _DDL).repartition("a", "b").sortWithinPartitions(*_NAMES)
    repeats = found.filter(flag != 0).unionByName(windows.mapInArrow(_split_classes(None), _ROWS_DDL))
    joined = base.join(listed(repeats), ["key", "mark"], "left").select("id", F.col("text").cast("binary").alias("text"), F.coalesce("places", F.array().cast("array<long>")).alias("places"))
    kind = base.schema["id"].dataType.simpleString()
    out = joined.mapInArrow(_without(window, texts), f"id {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else ""))
    return out.withColumnRenamed("id", id_col)
