import random

import numpy as np
import xxhash

from voxmere.llm.components import components
from voxmere.llm.simhash import fingerprint, keep_one, link_fingerprints, near_duplicates


def slow_fingerprint(text, n=3):
    found = text.encode().lower().split()
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[k : k + n]), 42) for k in range(max(1, len(found) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, distance=3):
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_fingerprints(edge_rows):
    for _, text in edge_rows:
        assert fingerprint((text or "").encode(), 3) == slow_fingerprint(text or "")


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 60), (60, 50), (70, 70), (60, 80)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {k: 0 for k in range(31)} | {50: 50, 60: 50, 80: 50}
    assert components(edges.filter("a < 0")).count() == 0


def test_links_are_exact_in_dense_groups(spark):
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 62, 2)
    values = np.unique(np.concatenate([base[0] ^ r.integers(0, 1 << 9, 250), base[1] ^ (r.integers(0, 1 << 8, 150) << 40), r.integers(0, 1 << 62, 300)])).tolist()
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    want = slow_components(values)
    for most in (20, 1 << 15):
        found = {row["node"]: row["root"] for row in components(link_fingerprints(fps, 3, most)).collect()}
        assert {v: found.get(v, v) for v in values} == want


def test_near_duplicates(edge_docs, no_docs):
    rows = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in near_duplicates(edge_docs).collect()}
    by_id = {i: c for i, _, c in rows if i is not None}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[6] == 5 and by_id[9] == 9
    assert near_duplicates(no_docs).count() == 0
    assert sorted(r["doc_id"] for r in keep_one(edge_docs).collect() if r["doc_id"] is not None) == [1, 4, 5, 7, 8, 9]


def test_rows_without_ids_are_kept_apart(spark):
    rows = [(None, "first text without an id"), (None, "second one about other things"), (None, "second one about other things"), (3, "first text without an id"), (4, None), (None, "")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(None, "second one about other things"), (3, "first text without an id"), (4, None)], key=str)


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def similar(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def varied(r, words, share):
    return " ".join(f"n{r.randrange(10**6)}" if r.random() < share else w for w in words)


def slow_groups(texts, least=0.8):
    """The ids that a comparison of all pairs keeps: the smallest of each component of similar texts."""
    ids, sets = sorted(texts), {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = len(sets[i]), len(sets[j])
            if min(a, b) >= least * max(a, b) and similar(sets[i], sets[j]) >= least:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in ids}


def test_keep_one_against_all_pairs(spark):
    """Copies with words replaced, from 10 words on: pairs at 0.8 or more go, those below stay, to the last one."""
    r = random.Random(2)
    rows, near, lost, just = [], 0, 0, 0
    for k in range(600):
        words = [f"b{r.randrange(3000)}" for _ in range(r.choice([10, 30, 45, 60, 100, 300]))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, varied(r, words, r.choice([0.0, 0.005, 0.01, 0.02, 0.03, 0.05])))]
    kept = {x["doc_id"] for x in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert all(2 * k in kept for k in range(600))
    for k in range(600):
        s = similar(shingles(texts[2 * k]), shingles(texts[2 * k + 1]))
        assert s >= 0.8 or 2 * k + 1 in kept
        near, just, lost = near + (s >= 0.8), just + (0.7 <= s < 0.8), lost + (s >= 0.8 and 2 * k + 1 in kept)
    assert near > 200 and just > 30 and lost <= 0.01 * near


def test_keep_one_in_a_large_group(spark):
    """Many near copies of one text, some near to a few of them only, and texts that share three quarters with each other:
    the same groups whether bands are held whole or dealt in many blocks."""
    from pyspark.sql import functions as F

    from voxmere.llm.simhash import _draw, link_sets

    r = random.Random(3)
    base, other = [f"b{k}" for k in range(200)], [f"c{k}" for k in range(200)]
    rows = [(k, varied(r, base, r.choice([0.004, 0.02]))) for k in range(300)] + [(1000 + k, varied(r, base, 1.0)) for k in range(20)]
    rows += [(2000 + k, " ".join(other[:170] + [f"t{k}_{x}" for x in range(35)])) for k in range(60)]
    texts = dict(rows)
    want = slow_groups(texts)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"] for x in keep_one(docs).collect()} == want
    nodes = docs.selectExpr("doc_id as key", "text").mapInArrow(_draw(5), "key long, fp long, bands array<long>, mark_a long, mark_b long, size long").withColumn("node", F.col("key"))
    for most_bytes, common in ((20_000, 3), (100_000, 0)):
        roots = {x["node"]: x["root"] for x in components(link_sets(nodes, docs.selectExpr("doc_id as key", "text"), 5, 0.8, most_bytes=most_bytes, common=common)).collect()}
        assert {roots.get(i, i) for i in texts} == want
