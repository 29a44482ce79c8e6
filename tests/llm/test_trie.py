import hashlib
import random
import re
import zlib
from collections import defaultdict

from voxmere.llm import trie
from voxmere.llm.trie import conversation_trie, ordered_turns, prefix_trie, share_heads

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The contract word by word, over paths held whole."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out, sums = set(), {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        below = [sums[p] for p in children[path]]
        sums[path] = (own + sum(b[0] for b in below), sum(b[1] for b in below) if below else 1)
    for path, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(path)))
        out.add((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(children[path]), sums[path][1], sums[path][0], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(df):
    rows = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert len(rows) == len({tuple(r) for r in rows})
    return {tuple(r) for r in rows}


def test_against_brute_force(spark):
    """Shared heads, copies, ties, nulls, negative ids, an absent base, and conversations longer than several blocks."""
    r = random.Random(5)
    rows = []
    for c in [*range(0, 65), *range(103, 131), -1, -20, -23]:
        style, n = r.random(), r.choice([1, 1, 2, 3, 5, 8, 9])
        if style < 0.4:
            rows += [(c, t, ("user", "assistant")[t % 2], f"same {t}") for t in range(n)]
        else:
            rows += [(c, r.choice([None, t]), r.choice(["user", "assistant", None]), r.choice(["a b", "c", "", None, "d e f"])) for t in range(n)]
    long = [f"turn {k} of many" for k in range(70)]
    rows += [(c, t, "user", x if t < n else f"{c} goes on") for c, n in ((200, 70), (201, 70), (202, 41), (203, 16), (220, 64)) for t, x in enumerate(long)]
    rows += [(7, 1, "user", "x"), (7, 1, "user", "x"), (None, 0, "user", "no id"), (None, None, None, None)]
    assert found(conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_turns_of_one_conversation_fill_many_tasks(spark, monkeypatch):
    """Most turns belong to one conversation, and many conversations end in one node; lists are packed in short stretches."""
    monkeypatch.setattr(trie, "PACKED", 7)
    rows = [(40, t, "user", f"t{t} word") for t in range(3000)] + [(c, 0, "user", "hi") for c in range(1000, 1400)] + [(41, t, "user", f"t{t} word") for t in range(2999)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert found(conversation_trie(df)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversation_trie(none).count() == 0
    only = spark.createDataFrame([(1, None, None, None, "x", 1)], SCHEMA + ", ts string, k int")
    assert found(conversation_trie(only)) == brute([(1, None, None, None)])
    big = [(0, 0, "user", "word " * 200_000), (1, 0, "user", "word " * 200_000)]
    assert found(conversation_trie(spark.createDataFrame(big, SCHEMA))) == brute(big)


def test_plain_trie_without_shared_heads(spark):
    rows = [(c, t, "user", f"{t}") for c in (1, 2, 3) for t in range(c)]
    turns = ordered_turns(spark.createDataFrame(rows, SCHEMA))
    n = turns.groupBy("conv_id").count().withColumnsRenamed({"count": "len"}).selectExpr("conv_id", "len", "len AS total")
    nodes = {r["depth"]: r for r in prefix_trie(turns.join(n, "conv_id"), n).collect()}
    assert [nodes[d]["n_convs"] for d in range(4)] == [3, 3, 2, 1] and nodes[0]["saved_tokens"] == 2 + 1
    assert share_heads(ordered_turns(spark.createDataFrame([], SCHEMA)))[1].count() == 0
