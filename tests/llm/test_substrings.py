import hashlib
import random
import re

import xxhash

from voxmere.llm.substrings import remove_repeats


def brute(rows, size=20):
    """First places of all windows by (id, hash of the text, place); rows with the same id and text count once."""
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)
    texts = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    first, out = {}, {}
    words = {r: re.findall(r"[^\x20\x09-\x0D]+", r[1]) for r in texts}
    for r in texts:
        for k in range(len(words[r]) - size + 1):
            first.setdefault(tuple(words[r][k : k + size]), (r, k))
    for r in texts:
        gone = set()
        for k in range(len(words[r]) - size + 1):
            if first[tuple(words[r][k : k + size])] != (r, k):
                gone.update(range(k, k + size))
        kept = [w for k, w in enumerate(words[r]) if k not in gone]
        out[r] = (len(words[r]), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def check(spark, rows, size=20):
    want = brute(rows, size)
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), window=size).collect()
    assert sorted((-99 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == sorted((-99 if i is None else i, *want[i, t or ""]) for i, t in rows)


def test_random_repeats(spark):
    random.seed(3)
    base = [" ".join(random.choice("abc") for _ in range(60)) for _ in range(6)]
    piece = lambda: random.choice(base)[random.randint(0, 40) * 2 :][: random.randint(1, 120)].strip()
    noise = lambda: " ".join(random.choice([f"x{random.randint(0, 50)}", "a"]) for _ in range(random.randint(0, 20)))
    check(spark, [(k * 3 - 50, "  ".join(piece() + " " + noise() for _ in range(random.randint(0, 5)))) for k in range(120)])


def test_edges(spark, edge_rows, no_docs):
    check(spark, [r for r in edge_rows])
    assert remove_repeats(no_docs).count() == 0


def test_kept_text(spark):
    text = " ".join(f"w{k}" for k in range(25))
    rows = remove_repeats(spark.createDataFrame([(1, text), (2, "new " + text + " end")], "doc_id long, text string"), texts=True).collect()
    assert {r["doc_id"]: r["kept"] for r in rows} == {1: text, 2: "new end"}


def test_repeated_rows_keep_their_words_once(spark):
    words = [f"u{k}" for k in range(60)]
    text = lambda lo, hi: " ".join(words[lo:hi])
    rows = [(1, text(0, 30))] * 2 + [(2, "so " + text(0, 30))] * 3 + [(3, text(5, 60))] * 2 + [(4, text(30, 60) + " " + text(30, 60))] * 2 + [(None, text(28, 58))] * 2
    check(spark, rows)
    check(spark, [(7, text(0, 30))] * 40)


def test_rows_with_equal_or_no_ids_keep_their_own_words(spark):
    """Among so many texts of one id some share 24 bits of hash, and their words must not be mixed up."""
    random.seed(9)
    shared = [" ".join(f"s{j}x{k}" for k in range(40)) for j in range(20)]
    rows = [(None if k % 2 else 5, f"{random.choice(shared)} own{k} " + " ".join(f"t{k % 50}y{j}" for j in range(k % 33))) for k in range(9000)]
    check(spark, rows)


def test_any_window_length(spark):
    random.seed(10)
    base = [f"q{random.randint(0, 3000)}" for _ in range(900)]
    rows = [(k, " ".join(base[lo : lo + random.randint(100, 600)])) for k, lo in enumerate(random.choices(range(500), k=12))]
    for size in (6, 133, 134, 200, 450):
        check(spark, rows, size)


def test_hot_anchors_only_move_rows(spark, monkeypatch):
    """One run of six words among different words in most texts."""
    random.seed(12)
    hot = "h1 h2 h3 h4 h5 h6"
    rows = [(k, " ".join([*(f"c{random.randint(0, 30)}" for _ in range(17)), hot, *(f"c{random.randint(0, 30)}" for _ in range(17))]) + (f" {hot}" * (k % 7))) for k in range(400)]
    rows += [(1000 + k, rows[k][1] + " tail") for k in range(50)]
    monkeypatch.setattr("voxmere.llm.substrings.HOT_SAMPLE", 1.0)
    check(spark, rows)


def test_other_columns(edge_docs, edge_rows):
    assert remove_repeats(edge_docs).count() == len(edge_rows)
