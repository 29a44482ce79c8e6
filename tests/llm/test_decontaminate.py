import random

import numpy as np
import pyarrow as pa
import pytest

from voxmere.llm import decontaminate as D
from voxmere.llm.decontaminate import common_length, drop_leaks, find_leaks


def lcs(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    return int(best[-1, -1])


def test_common_length_equals_the_table():
    r = np.random.default_rng(1)
    for _ in range(60):
        a, b = r.integers(0, 6, r.integers(1, 30)).astype(np.uint64), r.integers(0, 6, r.integers(0, 40)).astype(np.uint64)
        assert common_length(a, b) == lcs(a.tolist(), b.tolist())


def corpus(spark):
    random.seed(5)
    vocabulary = [f"w{k}" for k in range(4000)]
    text = lambda n: " ".join(random.choice(["the", "of", "and", *random.choices(vocabulary, k=4)]) for _ in range(n))
    items = [(k, text(35)) for k in range(40)]
    rows = [(k, text(200)) for k in range(200)]
    planted = {}
    for k, (item, words) in enumerate(items):
        kept = [w for w in words.split() if random.random() > (0.2 if k % 2 else 0)]
        rows.append((1000 + k, text(80) + " " + " ".join(kept).upper() + ". " + text(50)))
        planted[1000 + k] = item
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), planted


def test_finds_copies_and_paraphrases_and_nothing_else(spark):
    docs, items, planted = corpus(spark)
    assert {r["doc_id"]: r["item_id"] for r in find_leaks(docs, items).collect()} == planted
    assert {r["doc_id"] for r in drop_leaks(docs, items).collect()} == set(range(200))


def test_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "one two three four"), (2, None), (3, ""), (None, "x"), (4, "word word word")], "item_id long, text string")
    found = find_leaks(edge_docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(5, 4), (6, 4), (7, None)} and len(found) == 4
    assert find_leaks(no_docs, items).count() == 0
    assert find_leaks(edge_docs, items.filter("item_id < 0")).count() == 0
    assert drop_leaks(edge_docs, items).count() == edge_docs.count() - 4


def brute(rows, items):
    """All pairs by the definition: a stretch of 1.5 times the item, anywhere in the text, with its words in order."""
    code = {}
    number = lambda t: np.array([code.setdefault(w, len(code)) for w in t.split()], np.uint64)
    out = set()
    items = [(k, number(t)) for k, t in items]
    for i, t in rows:
        words = number(t)
        for k, item in items:
            if common_length(item, words) / len(item) < D.LEAST_COMMON:
                continue
            size = (3 * len(item) + 1) // 2
            if any(D._verdict(item, words[a : a + size], D.LEAST_COMMON)[0] for a in range(0, max(1, len(words) - size + 1), max(1, len(item) // 50))):
                out.add((i, k))
    return out


def test_items_of_any_length_are_found_wherever_they_lie(spark, monkeypatch):
    """Copies and paraphrases of items of 8 to 2,000 words, in several blocks and rounds."""
    monkeypatch.setattr(D, "BLOCK_ITEMS", 8)
    monkeypatch.setattr(D, "ROUND_BLOCKS", 2)
    r = random.Random(11)
    common, rare = ["the", "of", "and", "to", "in", "a"], [f"v{k}" for k in range(9000)]
    text = lambda n: " ".join(r.choice(common) if r.random() < 0.5 else r.choice(rare) for _ in range(n))
    lengths = [8, 9, 12, 16, 25, 40, 64, 100, 160, 270, 400, 640, 1000, 2000]
    items = [(k, text(n)) for k, n in enumerate(lengths * 2)]
    rows, planted = [(k, text(1500)) for k in range(40)], set()
    for k, item in items:
        words = item.split()
        for j in range(6):
            most = int(len(words) * 0.4) if j % 2 else 0
            gone = set(r.sample(range(len(words)), most)) if j < 5 else set(range(len(words) - most, len(words)))
            changed = [f"z{r.randrange(9999)}" if i in gone else w for i, w in enumerate(words)]
            rows.append((len(rows), f"{text(r.randrange(90))} {' '.join(changed)} {text(r.randrange(90))}"))
            if j < 5:
                planted.add((len(rows) - 1, k))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]) for x in find_leaks(docs, table).collect()}
    want = brute(rows, items)
    assert found <= want and len(found & want) >= 0.98 * len(want) and len(want & planted) >= 0.9 * len(planted)
    assert all((i, k) in found for i, k in planted if (i - 40) % 6 % 2 == 0)
    assert {x["doc_id"] for x in drop_leaks(docs, table).collect()} == {k for k, _ in rows} - {k for k, _ in found}


def test_the_answer_decides_on_paraphrases():
    item = np.arange(100, 140, dtype=np.uint64)
    most, answer = item[:30].copy(), item[-D.ANSWER :]
    assert D._verdict(item, item[:32], 0.6)[0] and not D._verdict(item, most, 0.6)[0]
    assert D._verdict(item, np.concatenate([most, answer[2:3]]), 0.6)[0] and not D._verdict(item, item[:20], 0.6)[0]


def test_items_without_ids_count(spark):
    words = " ".join(f"q{k}" for k in range(30))
    docs = spark.createDataFrame([(None, f"so {words} end"), (2, "clean text of other words")], "doc_id long, text string")
    items = spark.createDataFrame([(None, words), (None, None)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in find_leaks(docs, items).collect()] == [(None, None)]
    assert [r["doc_id"] for r in drop_leaks(docs, items).collect()] == [2]


@pytest.mark.parametrize("rank", [12, 40])
def test_singular_values_equal_the_full_decomposition(rank):
    r = np.random.default_rng(2)
    a = r.standard_normal((60, 12)) * np.geomspace(10, 0.1, 12) @ r.standard_normal((12, 300))
    test = r.standard_normal((60, rank))
    values, space = D.singular(a @ (a.T @ test), test)
    left, want, _ = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(values[:10], want[:10], rtol=1e-3)
    assert np.allclose(np.abs((space[:, :6] * left[:, :6]).sum(0)), 1, atol=1e-3)


def planted(r, n_items):
    """Items, rows and planted pairs: a copy and three paraphrases of each item between random words."""
    common, rare = ["the", "of", "and", "to", "in", "a"], [f"v{k}" for k in range(6000)]
    text = lambda n: " ".join(r.choice(common) if r.random() < 0.5 else r.choice(rare) for _ in range(n))
    items = [(k, text((8, 12, 25, 60, 150)[k % 5])) for k in range(n_items)]
    rows, pairs = [(k, text(400)) for k in range(60)], set()
    for k, item in items:
        words = item.split()
        for most in (0, 0.1, 0.2, 0.3):
            gone = set(r.sample(range(len(words) - D.ANSWER), min(int(len(words) * most), len(words) - D.ANSWER)))
            changed = [f"z{r.randrange(9999)}" if i in gone else w for i, w in enumerate(words)]
            pairs.add((len(rows), k))
            rows.append((len(rows), f"{text(r.randrange(60))} {' '.join(changed)} {text(r.randrange(60))}"))
    return items, rows, pairs


def test_the_latent_space_decides(spark):
    """Two blocks of items: with the default rank planted pairs are found, with one dimension most are lost."""
    items, rows, pairs = planted(random.Random(15), D.BLOCK_ITEMS + 40)
    docs, table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    want = brute([x for x in rows if x[0] >= 60], items) & pairs
    assert len(want) >= 0.99 * len(pairs)
    found = lambda rank: {(x["doc_id"], x["item_id"]) for x in find_leaks(docs, table, rank=rank).collect()}
    assert len(found(D.RANK) & want) >= 0.98 * len(want)
    assert len(found(1) & want) < 0.9 * len(want)


def test_sums_of_rows_equal_plain_addition():
    r = np.random.default_rng(4)
    for n, m in ((1, 0), (1, 1), (7, 300), (1000, 5000), (3, 20000)):
        matrix, rows, groups = r.standard_normal((50, 4)), r.integers(0, 50, m), r.integers(0, n, m)
        want = np.zeros((n, 4))
        np.add.at(want, groups, matrix[rows])
        assert np.allclose(D.sum_rows(matrix, rows, groups, n), want)


def test_the_space_is_fitted_on_all_texts(spark, monkeypatch):
    """More texts than one could take as a sample: frequencies, singular values and space equal those of all passages."""
    monkeypatch.setattr(D, "PASSAGES", 1000)
    r = random.Random(21)
    items = [" ".join(f"t{r.randrange(60)}" for _ in range(20)) for _ in range(6)]
    texts = [" ".join(f"t{min(r.randrange(90), r.randrange(90))}" for _ in range(r.randrange(3) and 5 or 40)) for _ in range(24000)]
    words = [h for t in items for _, _, h, _ in D.plain_words(pa.array([t]))]
    found, want = D._block(list(range(6)), words), D._block(list(range(6)), words)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    D.fit(docs, [found], "text", 16, D.LEAST_COMMON)
    n, seen, passages = len(want.terms) - want.n_common, np.zeros(len(want.terms)), []
    for _, _, hashes, firsts in D.plain_words(pa.array(texts)):
        for lo, hi in zip(firsts[:-1], firsts[1:], strict=True):
            term = want.find(hashes[lo:hi])
            seen[np.unique(term[term >= 0])] += 1
            passages += [np.bincount(x[(x >= 0) & (x < n)], minlength=n) for x in (term[: D.BLOCK], term[D.BLOCK :])]
    passages = np.array(passages, float)
    D._settle(want, len(texts), seen, passages.T @ (passages @ D._test_matrix(n, 16)), D.LEAST_COMMON)
    assert np.allclose(found.weight, want.weight, rtol=1e-5) and np.allclose(found.singular, want.singular, rtol=1e-3)
    assert np.allclose(found.basis[:, :4] @ found.basis[:, :4].T, want.basis[:, :4] @ want.basis[:, :4].T, atol=1e-2)
