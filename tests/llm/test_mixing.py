import hashlib
import math
import random
import re

from voxmere.llm.mixing import fair_queue, mix_documents, mix_report, weigh_sources

WEIGHTS = (5, 2, 1)


def shares(sizes, weights, budget, repeats=3):
    """Targets by sharing the excess again and again."""
    targets, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = float(budget)
    while open_ and left > 1e-9:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if targets[s] + unit * weights[s] >= repeats * sizes[s] - 1e-9}
        if not full:
            for s in open_:
                targets[s] += unit * weights[s]
            break
        for s in full:
            left -= repeats * sizes[s] - targets[s]
            targets[s] = float(repeats * sizes[s])
        open_ -= full
    return targets


def brute(rows):
    """(doc_id, size, source_size, target, taken) by standing in line: each queue's documents one by one, served in order of their finish."""
    order = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(order)}
    size = {s: sum(n for _, t, n in rows if t == s) for s in order}
    budget = sum(size.values())
    target = shares(size, weight, budget)
    packets = []
    for k, s in enumerate(order):
        line = sorted(((hashlib.md5(f"42:{'' if i is None else i}".encode()).hexdigest()[:16], (i is not None, i or 0), n, i) for i, t, n in rows if t == s))
        at = 0
        for turn in range(3):
            for place, (_, _, n, i) in enumerate(line):
                stop = min(max(math.floor(target[s] + 1e-7) - at, 0), n)
                for part, m in enumerate([stop, n - stop] if 0 < stop < n else [n]):
                    end = at + (stop if part == 0 and 0 < stop < n else n)
                    packets.append((end / weight[s], k, place, turn, part, m, i, n))
                at += n
    taken, served = {}, 0
    for finish, k, place, turn, part, m, i, n in sorted(packets):
        taken[k, place] = (i, n, taken.get((k, place), (0, 0, 0))[2] + max(0, min(m, budget - served)))
        served += m
    return sorted(((i, n, size[order[k]], round(target[order[k]], 4), t) for (k, _), (i, n, t) in taken.items()), key=str)


def test_against_brute_force(spark):
    r = random.Random(9)
    sources = ["b", "a", None, "ü", "zz", "tiny", ""]
    rows = [(k, r.choice(sources[:-2] + ["a"] * 6), r.choice([0, 1, 3, 50, 400])) for k in range(400)] + [(900, "tiny", 2), (901, "tiny", 1), (902, "", 0), (None, "a", 7), (903, "b", 5), (903, "b", 5)]
    docs = spark.createDataFrame([(i, s, "w " * n if n else None) for i, s, n in rows], "doc_id long, source string, text string").repartition(5)
    found = sorted(((x["doc_id"], x["size"], x["source_size"], round(x["target"], 4), x["taken"]) for x in mix_report(docs).collect()), key=str)
    assert found == brute(rows)
    assert sum(x[4] for x in found) == sum(n for _, _, n in rows)
    assert all(x[4] <= 3 * x[1] for x in found)


def test_each_source_comes_near_its_target(spark):
    """A source of few large documents is met as closely as one of many small ones."""
    rows = [(k, "big", 5000) for k in range(4)] + [(10 + k, "small", 10) for k in range(3000)] + [(5000 + k, "other", 100) for k in range(300)]
    queue = fair_queue(spark.createDataFrame(rows, "doc_id long, source string, size long"))
    got = {r["source"]: (r["t"], r["w"]) for r in queue.groupBy("source").agg({"target": "max", "words": "sum"}).toDF("source", "t", "w").collect()}
    assert len(got) == 3 and all(abs(t - w) <= 3 for t, w in got.values())
    again = fair_queue(spark.createDataFrame(rows[::-1], "doc_id long, source string, size long").repartition(3))
    key = ["source", "place", "turn", "position"]
    assert queue.orderBy(*key).collect() == again.orderBy(*key).collect()


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 400, None: 90}
    weights = {"a": 5, "b": 2, "c": 1, None: 5}
    found = {r["source"]: r["target"] for r in weigh_sources(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = shares(sizes, weights, 1500)
    assert all(math.isclose(found[s], want[s], rel_tol=1e-12) for s in sizes)
    wide = [(f"s{k:04}", (k * 7919) % 500) for k in range(3000)]
    found = {r["source"]: r["target"] for r in weigh_sources(spark.createDataFrame(wide, "source string, size long").repartition(7)).collect()}
    want = shares(dict(wide), {s: WEIGHTS[k % 3] for k, (s, _) in enumerate(wide)}, sum(n for _, n in wide))
    assert all(math.isclose(found[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s, _ in wide)


def test_mix_in_order(spark):
    docs = spark.createDataFrame([(k, f"s{k % 3}", " ".join(f"w{k}.{j}" for j in range(20 + k))) for k in range(30)], "doc_id long, source string, text string")
    rows = mix_documents(docs).collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    assert sum(len(r["text"].split()) for r in rows) == sum(20 + k for k in range(30))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(texts[r["doc_id"]].startswith(r["text"]) for r in rows)


def test_edges(spark, edge_docs, edge_rows, no_docs):
    sourced = edge_docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS source", "key", "ids", "'q' AS place", "1 AS budget")
    found = mix_report(sourced).collect()
    want = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in edge_rows)
    assert sorted(r["size"] for r in found) == want and all(r["taken"] == r["size"] for r in found)
    assert mix_report(no_docs.selectExpr("doc_id", "text", "'x' AS source")).count() == 0
    blank = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert sorted((r["doc_id"], r["target"], r["taken"]) for r in mix_report(blank).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]
