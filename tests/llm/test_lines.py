import random

from voxmere.llm.lines import common_blocks, dedup_lines, line_report, patience, repeated_lines


def longest_rising(pairs):
    """Length of the longest run that rises in both places, by the quadratic table."""
    pairs = sorted(pairs)
    best = []
    for k, (_, q) in enumerate(pairs):
        best.append(1 + max((best[j] for j in range(k) if pairs[j][1] < q), default=0))
    return max(best, default=0)


def test_patience_is_common_and_rising():
    random.seed(4)
    for _ in range(200):
        a, b = ([random.randint(0, 12) for _ in range(random.randint(0, 20))] for _ in range(2))
        found = patience(a, b)
        assert all(a[p] == b[q] for p, q in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
        both = set(a) & set(b)
        assert bool(found) == bool(both)
        once = [(a.index(x), b.index(x)) for x in both if a.count(x) == b.count(x) == 1]
        if not (set(a[:1]) & set(b[:1]) or set(a[-1:]) & set(b[-1:])) and once:
            assert len(found) >= longest_rising(once)
    assert patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert common_blocks([2, 4, 5], [2, 4, 7]) == [] and common_blocks([2, 5, 4], [2, 5, 4]) == [0, 1, 2]


def block(k, n=4):
    return [f"line {j} of block number {k} with words" for j in range(n)]


def test_later_documents_lose_common_blocks(spark):
    rows = [(1, "\n".join([*block(1), "only in the first one here"])), (2, "\n".join(["a new head line of the second", *block(1), "ok", *block(2)])), (3, "\n".join([*block(2), "", "its own long line in the third"])), (4, "\n".join(block(1))), (5, "short\nshort"), (6, "short\nshort")]
    docs = spark.createDataFrame([(i, t, len(t), "z") for i, t in rows], "doc_id long, text string, n_chars long, _gone string")
    kept = {r["doc_id"]: r for r in dedup_lines(docs).collect()}
    assert set(kept) == {1, 2, 3, 5, 6}
    assert kept[1]["text"] == rows[0][1]
    assert kept[2]["text"] == "\n".join(["a new head line of the second", "ok", *block(2)]) and kept[2]["n_chars"] == len(kept[2]["text"])
    assert kept[3]["text"] == "\nits own long line in the third"
    assert kept[5]["text"] == kept[6]["text"] == "short\nshort"


def test_every_repeated_line_of_a_large_group_goes(spark):
    shared = "\n".join(block(7, 6))
    rows = [(k, f"{shared}\nown line of document {k} and no other") for k in range(300)]
    found = {r["doc_id"]: r["n_removed"] for r in line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert found == {k: 6 if k else 0 for k in range(300)}


def test_edges(edge_docs, no_docs):
    found = line_report(edge_docs).collect()
    assert len(found) == edge_docs.count()
    assert {r["doc_id"]: r["n_removed"] for r in found}[6] == 1
    assert dedup_lines(edge_docs).columns == edge_docs.columns and dedup_lines(no_docs).count() == 0


def brute(rows):
    """Places of the long lines that stand in an earlier document, by ids."""
    texts = sorted({(i, t) for i, t in rows})
    out = {}
    for i, t in texts:
        earlier = {x.strip() for j, u in texts if j < i for x in u.split("\n")}
        out[i] = {k for k, x in enumerate(t.split("\n")) if len(x.strip()) >= 20 and x.strip() in earlier}
    return out


def test_moved_and_doubled_lines_go(spark):
    long = [f"long line number {k} with enough letters" for k in range(12)]
    rows = [(1, long[:6]), (2, long[5::-1]), (3, long[3:6] + long[:3]), (4, [long[0], "x", long[0], "y", long[0]]), (5, [long[7], long[8]]), (6, [long[8], "between", long[7], long[7]]), (7, ["q", long[9], long[9]])]
    found = {r["doc_id"]: r["n_removed"] for r in line_report(spark.createDataFrame([(i, "\n".join(x)) for i, x in rows], "doc_id long, text string")).collect()}
    assert found == {1: 0, 2: 6, 3: 6, 4: 3, 5: 0, 6: 3, 7: 0}


def test_long_lines_go_as_by_brute_force(spark):
    random.seed(6)
    pool = [f"shared line {k} that many documents may hold" for k in range(60)]
    rows = []
    for k in range(220):
        lines = random.choices([*pool[:3] * 10, *pool], k=random.randint(0, 8)) + [f"line of document {k} alone, number {j}" for j in range(random.randint(0, 3))] + random.choices(["", "ok", " short one "], k=2)
        random.shuffle(lines)
        rows.append((k, "\n".join(lines)))
    want = brute(rows)
    for r in repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), salts=4).collect():
        gone, lines = set(r["_gone"] or ()), r["text"].split("\n")
        assert {k for k in gone if len(lines[k].strip()) >= 20} == want[r["doc_id"]]
        assert bool(gone) == bool(want[r["doc_id"]])


def test_very_long_texts(spark):
    """A text of many lines against itself in reverse and with a new head."""
    lines = [f"line number {k} of a long text" for k in range(20_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[::-1])), (3, "\n".join(["new head of the third document", *lines]))]
    found = {r["doc_id"]: r["n_removed"] for r in line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 0, 2: 20_000, 3: 20_000}
