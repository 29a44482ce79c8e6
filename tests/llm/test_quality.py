import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from voxmere.llm.quality import DOUBT, START, filter_quality, fit, rate_quality, votes, with_signals


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places, covered = defaultdict(list), set()
    for k in range(len(words) - 7):
        places[tuple(words[k : k + 8])].append(k)
    for at in places.values():
        if len(at) > 1:
            covered.update(x for k in at for x in range(k, k + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, edge_docs, edge_rows):
    more = [(200, "a b c d e f g h " * 3 + "x\nsame\nsame\n \nsame"), (201, "#|<>" * 9 + " & " * 5), (202, "p q r s t u v w x p q r s t u v w")]
    docs = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    found = rate_quality(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *(r[n] for n in names)) for r in found) == sorted((-1 if i is None else i, *brute(t or "")) for i, t in [*edge_rows, *more])
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in found)


def test_verdicts_agree_with_labels(spark):
    """Held-out check: the labels take no part in the fit, and no estimate sits on a limit."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rated = rate_quality(docs).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    good, bad = [r["kept"] for r in rated if r["quality"] == 1], [r["kept"] for r in rated if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)
    prior, passed, failed = fit(with_signals(docs).select(votes(F.col("signals")).alias("votes")))
    assert 0 < prior < 4 and all(0 < x < 3 for x in passed) and all(-12 < x < -1 for x in failed)
    assert len({round(x, 9) for x in passed + failed}) == 16


def brute_fit(patterns, rounds=40):
    """The same rounds over a list of votes, one document after the other."""
    prior, good, bad = START[0], [START[1]] * 8, [START[2]] * 8
    for _ in range(rounds):
        q = []
        for v in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(g / b) if x > 0 else math.log((1 - g) / (1 - b)) if x < 0 else 0 for x, g, b in zip(v, good, bad))
            q.append(1 / (1 + math.exp(-odds)))
        prior = (sum(q) + 1.6) / (len(q) + 2)
        rate = lambda share, j: (lambda cast, passed: (passed + (cast * DOUBT + 4) / 2) / (cast + cast * DOUBT + 4))(sum(s for s, v in zip(share, patterns) if v[j]), sum(s for s, v in zip(share, patterns) if v[j] > 0))
        good, bad = [rate(q, j) for j in range(8)], [rate([1 - x for x in q], j) for j in range(8)]
    return math.log(prior / (1 - prior)), [math.log(g / b) for g, b in zip(good, bad)], [math.log((1 - g) / (1 - b)) for g, b in zip(good, bad)]


def test_fit_equals_brute_force(spark):
    r = random.Random(3)
    patterns = [[r.choice([1, 1, 1, 0, -1] if k % 5 == 0 else [1, 1, 1, 1, 0]) for _ in range(8)] for k in range(300)]
    found = fit(spark.createDataFrame([(p,) for p in patterns], "votes array<int>").repartition(3))
    want = brute_fit(patterns)
    assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) for a, b in zip([found[0], *found[1], *found[2]], [want[0], *want[1], *want[2]]))


def test_length_makes_no_switch(spark):
    """Shuffled words from a small stock are bad at any length, and so is a long text alike at every length."""
    r = random.Random(4)
    stock = [f"w{k}x" for k in range(30)]
    rows = [(n, " ".join(r.choice(stock) for _ in range(n))) for n in (60, 100, 149, 500, 4999, 5000, 5001, 20_000)]
    rows += [(-n, " ".join(f"u{r.randrange(4000)}x" for _ in range(n))) for n in (60, 100, 149, 500, 4999, 5000, 5001, 20_000)]
    found = {r["doc_id"]: r["v"] for r in with_signals(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", votes(F.col("signals"))[3].alias("v")).collect()}
    assert {v for k, v in found.items() if k > 99} == {-1} and {v for k, v in found.items() if k < 0} == {1}


def test_main_path_is_native(spark):
    plan = with_signals(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("PythonUDF|EvalPython|InPandas|InArrow", plan)


def test_filter_keeps_columns(edge_docs, no_docs):
    kept = filter_quality(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() <= edge_docs.count()
    assert filter_quality(no_docs).count() == 0 and rate_quality(no_docs).count() == 0
    assert len(fit(with_signals(no_docs).select(votes(F.col("signals")).alias("votes")))[1]) == 8
    assert rate_quality(edge_docs).count() == edge_docs.count()
    assert set(with_signals(edge_docs).columns) == set(edge_docs.columns)
