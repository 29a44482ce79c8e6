"""Benchmark decontamination by latent semantic retrieval.

Passages of documents and benchmark items are TF-IDF vectors over the items' terms. A distributed randomised SVD finds
the latent space: one pass over all documents counts document frequencies and the product of the Gram matrix of the
passages of all of them with a random test matrix (a diagonal weight can be applied to both afterwards, as any test matrix
of full rank will do). The items, at unit length, are added to the passages with ITEM_SHARE of their weight; of the singular vectors of
the weighted product, RANK at most, those that hold ENERGY of the whole stay. Terms that many items have are coordinates of their
own. A second pass projects half-overlapping windows of every text, whose length follows that of the items, and searches
the items by their product with the window in that space, cosine times lengths. A window is a candidate if the product is at least SLACK of
what the least words of the item that make up the share asked for give, so a window is missed only where the space has lost more of the
item. Measured against all pairs, with 250 items of 8 to 400 words and 1,000 planted copies and paraphrases: 100% are candidates at ranks 256 and 128, 85% at 32. Candidates are verified on words: first the words that both have in any order are
counted, then the longest common subsequence with the item must be long enough. A text that holds nearly all of an item leaks it; a
paraphrase, with less, leaks it if it also has words of the item's answer, its last words.

Items go in blocks of bounded size, and blocks in rounds; a round's blocks share one pass that gathers and one that searches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmere.llm.text import slices, word_bounds, word_hashes

BLOCK = 32
RANK = 256
BLOCK_ITEMS, BLOCK_WORDS, ROUND_BLOCKS = 224, 1 << 13, 8
ENERGY, SLACK, ITEM_SHARE = 0.99, 0.7, 4.0
FAN = 32
COMMON = 128
LEAST_STRIDE = 8
ANSWER = 5
PART = 512
PASSAGES = 1 << 14

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[128:] = np.arange(128, 256)
for _lo, _hi, _to in ((48, 58, 48), (97, 123, 97), (65, 91, 97)):
    _PLAIN[_lo:_hi] = np.arange(_hi - _lo) + _to


def plain_words(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, firsts): words as runs of letters, digits and non-ASCII bytes, A-Z lower-cased."""
    for lo, hi, data, offsets in slices(texts, most_bytes):
        data = _PLAIN[data]
        starts, ends, firsts = word_bounds(data, offsets)
        yield lo, hi, word_hashes(data, starts, ends), firsts


@dataclass
class Items:
    """One block of benchmark items with the vocabulary and, once fitted, the latent space.

    Terms have numbers: first those of the latent space, then the `n_common` that are coordinates of their own.
    """

    ids: list
    words: list[np.ndarray]
    terms: np.ndarray
    numbers: np.ndarray
    n_common: int
    counts: np.ndarray
    singular: np.ndarray | None = None
    basis: np.ndarray | None = None
    latent: np.ndarray | None = None
    norms: np.ndarray | None = None
    weight: np.ndarray | None = None
    classes: list[tuple[int, np.ndarray, np.ndarray]] | None = None
    lookup: np.ndarray = field(init=False)

    def __post_init__(self):
        size = 1 << max(10, int(np.ceil(np.log2(max(len(self.terms), 1) * 8))))
        self.lookup = np.full(size, -1, np.int32)
        self.lookup[(self.terms & np.uint64(size - 1)).astype(np.int64)] = np.arange(len(self.terms))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word's term, or -1; the few terms that share a slot are looked up by search."""
        slot = self.lookup[(hashes & np.uint64(len(self.lookup) - 1)).astype(np.int64)]
        hit = slot >= 0
        found = np.where(hit & (self.terms[np.maximum(slot, 0)] == hashes), slot, -1)
        again = np.flatnonzero(hit & (found < 0))
        if len(again):
            at = np.minimum(np.searchsorted(self.terms, hashes[again]), len(self.terms) - 1)
            found[again] = np.where(self.terms[at] == hashes[again], at, -1)
        return np.where(found >= 0, self.numbers[found], -1)


def _rounds(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[Items]]:
    """Lists of at most ROUND_BLOCKS blocks of about BLOCK_ITEMS items, or BLOCK_WORDS words, each; items without words are
    left out.

    Items are dealt to blocks by a hash; the driver holds the items of one round at a time.
    """
    rows = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropDuplicates()
    n_items, n_words = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(F.split("text", " "))), F.lit(0))).first()
    n_blocks = max(-(-n_items // BLOCK_ITEMS), min(n_items, -(-n_words // BLOCK_WORDS)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(max(1, n_blocks))))
    for first in range(0, n_blocks, ROUND_BLOCKS):
        held: dict[int, list] = {}
        for row in dealt.filter(F.col("block").between(first, first + ROUND_BLOCKS - 1)).collect():
            ((_, _, hashes, _),) = plain_words(pa.array([row["text"]]))
            if len(hashes):
                held.setdefault(row["block"], []).append((row["text"], row["id"] is not None, row["id"], hashes))
        blocks = [_block([x[2] for x in items], [x[3] for x in items]) for items in (sorted(held[k], key=lambda x: x[:3]) for k in sorted(held))]
        if blocks:
            yield blocks


def _block(ids: list, words: list[np.ndarray]) -> Items:
    """Vocabulary: all terms of the items; those in over a thirtieth of them, COMMON at most, stay out of the latent space."""
    terms, spread = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True)
    order = np.argsort(spread, kind="stable")
    n_common = min(COMMON, int((spread > max(2, len(words) // 30)).sum()), len(terms) - 1)
    numbers = np.empty(len(terms), np.int64)
    numbers[order] = np.arange(len(terms))
    counts = np.zeros((len(words), len(terms)), np.int32)
    for k, w in enumerate(words):
        np.add.at(counts[k], numbers[np.searchsorted(terms, w)], 1)
    return Items(ids, words, terms, numbers, n_common, counts)


def _test_matrix(n_terms: int, rank: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((n_terms, rank))


def sum_rows(matrix: np.ndarray, rows: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sums of matrix[rows] by group, groups numbered from 0 to n - 1 and those without rows zero.

    Groups are added up FAN rows at a time, the k-th rows of all of them at once, until one sum of each is left.
    """
    out = np.zeros((n, matrix.shape[1]), matrix.dtype)
    order = np.argsort(groups, kind="stable")
    rows, groups = rows[order], groups[order]
    while len(rows):
        begin = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        part = np.flatnonzero((np.arange(len(groups)) - np.repeat(begin, np.diff(np.append(begin, len(groups))))) % FAN == 0)
        size = np.diff(np.append(part, len(groups)))
        order = np.argsort(-size, kind="stable")
        longest, least = part[order], -size[order]
        sums = matrix[rows[longest]]
        for k in range(1, -least[0]):
            more = np.searchsorted(least, -k)
            sums[:more] += matrix[rows[longest[:more] + k]]
        if len(part) == len(begin):
            out[groups[longest]] = sums
            break
        rows, matrix, groups = np.argsort(order), sums, groups[part]
    return out


def _gather(blocks: list[Items], rank: int):
    """Of each task and block: document frequencies and the Gram product, in parts of PART terms; and its number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = [_test_matrix(len(x.terms) - x.n_common, rank).astype(np.float32) for x in blocks]
        sums = [(np.zeros(len(t)), np.zeros(t.shape), np.zeros(x.n_common)) for x, t in zip(blocks, tests, strict=True)]
        texts = 0
        for batch in batches:
            texts += batch.num_rows
            for _, _, hashes, firsts in plain_words(batch.column(0)):
                for items, test, (seen, product, usual) in zip(blocks, tests, sums, strict=True):
                    _count(items.find(hashes), firsts, test, seen, product, usual)
        names, columns = ["block", "part", "blob"], [[], [], []]
        for block, (seen, product, usual) in enumerate(sums):
            parts = [(k // PART, np.concatenate([[texts], seen[k : k + PART], product[k : k + PART].ravel()])) for k in range(0, len(seen), PART)]
            for part, values in [*parts, (-1, usual)]:
                for column, x in zip(columns, (block, part, values.astype(np.float32).tobytes()), strict=True):
                    column.append(x)
        kinds = (pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _count(term: np.ndarray, firsts: np.ndarray, test: np.ndarray, seen: np.ndarray, product: np.ndarray, usual: np.ndarray) -> None:
    """Add the texts of a slice, by the numbers of their words' terms, to the sums of a block."""
    n, own = len(seen), len(usual)
    at = np.flatnonzero(term >= n)
    if len(at):
        doc = np.searchsorted(firsts, at, side="right") - 1
        usual += (np.bincount(doc * own + term[at] - n, minlength=(len(firsts) - 1) * own).reshape(-1, own) > 0).sum(0)
    at = np.flatnonzero((term >= 0) & (term < n))
    if not len(at):
        return
    term = term[at]
    doc = np.searchsorted(firsts, at, side="right") - 1
    seen += np.bincount(np.unique(doc * n + term) % n, minlength=n)
    passage = doc * (1 << 32) + (at - firsts[doc]) // BLOCK
    begin = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    which, begin = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(term)))), np.append(begin, len(term))
    for k in range(0, len(begin) - 1, PASSAGES):
        last = min(k + PASSAGES, len(begin) - 1)
        inside = slice(begin[k], begin[last])
        total = sum_rows(test, term[inside], which[inside] - k, last - k)
        product += sum_rows(total, which[inside] - k, term[inside], n)


def _sum(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(frame["blob"].iloc[0]) // 4)
    for blob in frame["blob"]:
        total += np.frombuffer(blob, np.float32)
    return pd.DataFrame({"block": [frame["block"].iloc[0]], "part": [frame["part"].iloc[0]], "salt": [frame["salt"].iloc[0] // FAN], "blob": [total.astype(np.float32).tobytes()]})


def fit(docs: DataFrame, blocks: list[Items], text_col: str, rank: int, least_common: float) -> list[Items]:
    """The latent space of each block of items among all documents, from one pass over them: frequencies and the passages
    for the decomposition are those of all documents.

    Sums of tasks are added up in a tree, FAN at a time (three levels and the last, for up to a million tasks), so no task
    holds more; what comes to the driver has the size of the vocabularies.
    """
    partial = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_gather(blocks, rank), "block int, part int, blob binary")
    sums = partial.withColumn("salt", F.floor(F.spark_partition_id() / FAN).cast("int"))
    for _ in range(3):
        sums = sums.groupBy("block", "part", "salt").applyInPandas(lambda x: _sum(x), "block int, part int, salt int, blob binary")
    sums = sums.withColumn("salt", F.lit(0)).groupBy("block", "part", "salt").applyInPandas(lambda x: _sum(x), "block int, part int, salt int, blob binary")
    texts = 0.0
    seen = [np.zeros(len(x.terms)) for x in blocks]
    product = [np.zeros((len(x.terms) - x.n_common, rank)) for x in blocks]
    for row in sums.collect():
        block, n = row["block"], len(product[row["block"]])
        blob = np.frombuffer(row["blob"], np.float32)
        if row["part"] < 0:
            seen[block][n:] = blob
            continue
        lo = row["part"] * PART
        size = min(PART, n - lo)
        texts = float(blob[0])
        seen[block][lo : lo + size] = blob[1 : 1 + size]
        product[block][lo : lo + size] = blob[1 + size :].reshape(size, rank)
    for block, items in enumerate(blocks):
        _settle(items, texts, seen[block], product[block], least_common)
    return blocks


def singular(sketch: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and left singular vectors of a matrix A, largest first, from sketch = A A' test, without a second
    look at A: A A' is taken as sketch (test' sketch)^-1 sketch', which is exact where its rank is that of test at most."""
    core = test.T @ sketch
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values[-1], 1e-30) * 1e-10
    root = sketch @ (vectors[:, good] / np.sqrt(values[good]))
    space, found, _ = np.linalg.svd(root, full_matrices=False)
    return found, space


def _settle(items: Items, texts: float, seen: np.ndarray, product: np.ndarray, least_common: float) -> None:
    """Weights, truncated SVD, the items in the latent space, and the bound and window of each. What of the items lies outside
    the space is lost to the search."""
    n, rank = product.shape
    items.weight = np.log((texts + 1) / (seen + 1)) + 0.05
    told = items.counts[:, :n] * items.weight[:n]
    unit = told / np.maximum(np.linalg.norm(told, axis=1, keepdims=True), 1e-9)
    scale = ITEM_SHARE * np.sqrt((product**2).sum() + 1) / np.sqrt((unit**2).sum() + 1)
    test = _test_matrix(n, rank) / items.weight[:n, None]
    sketch = product * items.weight[:n, None] + scale * (unit.T @ (unit @ test))
    items.singular, space = singular(sketch, test)
    if len(items.singular):
        held = np.cumsum(items.singular**2)
        kept = int(np.searchsorted(held, held[-1] * ENERGY)) + 1
        items.singular, space = items.singular[:kept], space[:, :kept]
    inside = told @ space
    items.basis = (space * items.weight[:n, None]).astype(np.float32)
    items.latent = np.concatenate([inside, items.counts[:, n:] * items.weight[n:] ** 2], axis=1).astype(np.float32)
    items.norms = np.maximum(np.linalg.norm(np.concatenate([inside, items.counts[:, n:] * items.weight[n:]], axis=1), axis=1), 1e-9)
    least, strides = np.zeros(len(items.ids)), np.zeros(len(items.ids), np.int64)
    for k, w in enumerate(items.words):
        given = np.sort((items.counts[k] * items.weight**2)[items.find(w)])
        least[k] = given[: int(np.ceil(len(w) * least_common - 1e-9))].sum() * SLACK
        strides[k] = LEAST_STRIDE << max(0, int(np.ceil(np.log2(1.5 * len(w) / LEAST_STRIDE))))
    items.classes = [(int(s), np.flatnonzero(strides == s), least[strides == s].astype(np.float32)) for s in np.unique(strides)]


def common_length(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, with a bit for each word of the item."""
    bits: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        bits[w] = bits.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in text.tolist():
        m = bits.get(w, 0)
        if m:
            row = ((row + (row & m)) | (row & ~m)) & full
    return len(item) - row.bit_count()


def _shared(items: Items, term: np.ndarray, places: np.ndarray, name: np.ndarray, stride: int, window: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Number of words that each pair of window and item has in common, in any order."""
    used, window = np.unique(window, return_inverse=True)
    first = (name[used] >> 32 << 32) + (name[used] & 0xFFFFFFFF) * stride
    lo, hi = np.searchsorted(places, first), np.searchsorted(places, first + 2 * stride)
    spread = lambda start, count: np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
    keys, many = np.unique(np.repeat(np.arange(len(used)), hi - lo) * len(items.terms) + term[spread(lo, hi - lo)], return_counts=True)
    bounds = np.searchsorted(keys, np.arange(len(used) + 1) * len(items.terms))
    keys %= len(items.terms)
    out = np.zeros(len(window), np.int64)
    for k in range(0, len(window), 1 << 14):
        begin, count = bounds[window[k : k + (1 << 14)]], np.diff(bounds)[window[k : k + (1 << 14)]]
        at = spread(begin, count)
        both = np.minimum(items.counts[np.repeat(item[k : k + (1 << 14)], count), keys[at]], many[at])
        out[k : k + (1 << 14)] = np.add.reduceat(both, np.cumsum(count) - count)
    return out


def _matches(items: Items, hashes: np.ndarray, firsts: np.ndarray, least_common: float) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(text, item): best (share in common, share of the answer, cosine) of verified candidates in a slice of texts.

    A window is two strides long and a stride 1.5 to 3 times the item, so each stretch of 1.5 times the item lies in one.
    """
    out: dict[tuple[int, int], tuple[float, float, float]] = {}
    term = items.find(hashes)
    at = np.flatnonzero(term >= 0)
    if not len(at):
        return out
    term, own = term[at], items.n_common
    n, rank = len(items.terms) - own, items.basis.shape[1]
    doc = np.searchsorted(firsts, at, side="right") - 1
    stride = items.classes[0][0]
    places = doc * (1 << 32) + at - firsts[doc]
    sizes = np.array([len(x) * least_common - 1e-9 for x in items.words])
    passage = doc * (1 << 32) + (at - firsts[doc]) // stride
    new = np.concatenate([[True], passage[1:] != passage[:-1]])
    name, block = passage[new], np.cumsum(new) - 1
    sums = np.zeros((len(name), rank + own), np.float32)
    told = np.flatnonzero(term < n)
    if len(told):
        sums[:, :rank] = sum_rows(items.basis, term[told], block[told], len(name))
    usual = np.flatnonzero(term >= n)
    if len(usual):
        sums[:, rank:] = np.bincount(block[usual] * own + term[usual] - n, minlength=len(name) * own).reshape(-1, own)
    for wide, which, least in items.classes:
        while stride < wide:
            name = name >> 32 << 32 | (name & 0xFFFFFFFF) >> 1
            new = np.concatenate([[True], name[1:] != name[:-1]])
            name, sums, stride = name[new], sum_rows(sums, np.arange(len(sums)), np.cumsum(new) - 1, int(new.sum())), stride * 2
        windows = sums.copy()
        pairs = np.flatnonzero(name[1:] == name[:-1] + 1)
        windows[pairs] += sums[pairs + 1]
        for k in range(0, len(windows), 1 << 13):
            along = windows[k : k + (1 << 13)] @ items.latent[which].T
            w, i = np.nonzero(along >= least)
            if not len(w):
                continue
            enough = _shared(items, term, places, name[k : k + len(along)], stride, w, which[i]) >= sizes[which[i]]
            for w, i in zip(w[enough], i[enough], strict=True):
                window, text, item = windows[k + w], int(name[k + w] >> 32), items.words[which[i]]
                first = firsts[text] + int(name[k + w] & 0xFFFFFFFF) * stride
                words = hashes[first : min(firsts[text + 1], first + 2 * stride)]
                if common_length(item, words) / len(item) < least_common:
                    continue
                size, step = (3 * len(item) + 1) // 2, max(1, len(item) // 16)
                found = max(_verdict(item, words[a : a + size], least_common) for a in range(0, max(1, len(words) - size + step), step))
                if not found[0]:
                    continue
                norm = np.sqrt((window[:rank] ** 2).sum() + ((window[rank:] * items.weight[n:]) ** 2).sum())
                cosine = along[w, i] / max(norm * items.norms[which[i]], 1e-9)
                found = (*found[1:], float(cosine))
                out[text, which[i]] = max(out.get((text, which[i]), found), found)
    return out


LEAST_COMMON, WHOLE_COMMON, LEAST_ANSWER = 0.6, 0.8, 0.2


def _verdict(item: np.ndarray, words: np.ndarray, least_common: float) -> tuple[bool, float, float]:
    """(whether words leak the item, share of the item in common, share of its answer in common)."""
    share = common_length(item, words) / len(item)
    if share < least_common:
        return False, share, 0.0
    answer = item[-ANSWER:]
    told = common_length(answer, words) / len(answer)
    return share >= WHOLE_COMMON or told >= LEAST_ANSWER, share, told


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", rank: int = RANK, least_common: float = LEAST_COMMON) -> DataFrame:
    """(id, item_id, common, answer, cosine): each row of docs with each item that it leaks.

    common is the longest common subsequence as a share of the item, answer that of its last ANSWER words, cosine the best
    of the windows. A text leaks an item if a stretch of 1.5 times the item's length has WHOLE_COMMON of its words in
    order, or least_common of them with LEAST_ANSWER of the answer among them; of stretches of 32 words or more all within
    1.4 times are found, of shorter ones all. Null texts match nothing; repeated rows are found each; items without words
    are left out, items without ids are not; texts and items of any length are read whole. Other columns are not read. An
    empty table on either side gives no rows.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind, item_kind = base.schema["id"].dataType.simpleString(), benchmark.schema[item_id_col].dataType.simpleString()
    schema = f"id {kind}, item_id {item_kind}, common double, answer double, cosine double"
    out = docs.sparkSession.createDataFrame([], schema)
    for blocks in _rounds(benchmark, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(fit(docs, blocks, text_col, rank, least_common))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: list[tuple] = []
                for lo, _, hashes, firsts in plain_words(batch.column(1)):
                    for items in shared.value:
                        found = _matches(items, hashes, firsts, least_common)
                        rows += [(lo + t, items.ids[i], *best) for (t, i), best in found.items()]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64() if item_kind == "bigint" else None), *(pa.array(c, pa.float64()) for c in columns[2:])], ["id", "item_id", "common", "answer", "cosine"])

        out = out.unionByName(base.mapInArrow(search, schema))
    return out.withColumnsRenamed({"id": id_col, "item_id": item_id_col})


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", rank: int = RANK, least_common: float = LEAST_COMMON) -> DataFrame:
    """The rows of docs in which find_leaks finds nothing, in the same pass, with all their columns."""
    out = docs
    for blocks in _rounds(benchmark, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(fit(docs, blocks, text_col, rank, least_common))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for lo, _, hashes, firsts in plain_words(batch.column(batch.schema.get_field_index(text_col))):
                    for items in shared.value:
                        for text, _ in _matches(items, hashes, firsts, least_common):
                            clean[lo + text] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(keep, docs.schema)
    return out
