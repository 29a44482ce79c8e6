import random
import re
import zlib
from collections import Counter

from voxmere.llm import spelling
from voxmere.llm.spelling import follow, near_words, spelling_groups, word_counts


def counts(rows, typo=97):
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if typo and h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    out = set()
    form = {}
    for w, n in words.items():
        around = [x for x in words if x != w and near(w, x)]
        best = min(around, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out.add((w, n, len(around), form[w], words[best] if form[w] else None))
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(*r, root(r[0])) for r in out}


def found(df):
    return {tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()}


def test_groups_against_all_pairs(spark):
    r = random.Random(3)
    words = {}
    while len(words) < 900:
        w = "".join(r.choice("aabcéÉ×") for _ in range(r.randrange(5, 8)))
        words[w] = r.choice([3, 3, 4, 6, 12, 25, 100])
    words |= {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "aaaaaaaaa": 48, "lonely": 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    assert found(spelling_groups(df)) == brute(words)
    assert near_words(df).count() == len(words)


def test_from_texts(spark, monkeypatch):
    """Texts are read in stretches that end between words, and words are passed on in parts."""
    monkeypatch.setattr(spelling, "STRETCH", 11)
    monkeypatch.setattr(spelling, "HELD", 5)
    r = random.Random(6)
    stock = ["Working", "WORKİNG", "tréßor", "trésor", "naïveté", "thing", "things", "a×b÷cde", "œuvres"]
    rows = [(k, "".join(r.choice(stock) + r.choice([" ", ", ", "-", "1", "\n"]) for _ in range(r.randrange(60)))) for k in range(120)] + [(None, "things thing"), (1, None), (2, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string").repartition(3)
    assert {r["word"]: r["n"] for r in word_counts(docs).collect()} == counts(rows)
    assert {r["word"]: r["n"] for r in word_counts(docs, typo=None).collect()} == counts(rows, None)
    assert found(spelling_groups(word_counts(docs))) == brute(counts(rows))


def test_edges(spark, edge_docs, edge_rows, no_docs):
    assert found(spelling_groups(word_counts(edge_docs))) == brute(counts(edge_rows))
    assert spelling_groups(word_counts(no_docs)).count() == 0
    one_run = spark.createDataFrame([(1, "é" * 300_000), (2, "é" * 300_000), (3, "é" * 300_000)], "doc_id long, text string")
    assert word_counts(one_run).collect()[0]["n"] <= 3


def test_long_chains_of_forms(spark):
    links = [(f"w{k:03}", f"w{k + 1:03}") for k in range(40)]
    roots = {r["word"]: r["root"] for r in follow(spark.createDataFrame(links, "word string, form string")).collect()}
    assert roots == {f"w{k:03}": "w040" for k in range(40)}
