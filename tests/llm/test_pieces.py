import random

import pandas as pd
import public_tokenizers
import pytest
import sentencepiece

from voxmere.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.Model(PATH)


def scan(model, text, n):
    """The scan without Spark."""
    whole, around = " " + text.replace(pieces.SPACE, " "), pieces.AROUND
    count = (len(whole) - 1) // n + 1
    chunks = []
    for i in range(count):
        lo = around if i else 0
        begin = max(0, i * n - around)
        chunks.append((whole[begin : begin + n + (2 if i else 1) * around].replace(" ", pieces.SPACE), lo, lo + min(n, len(whole) - i * n), (i + 1) * n >= len(whole)))
    rows = [pieces._matrix(model, *c) for c in chunks]
    states = pieces._combine(pd.DataFrame({"key": "k", "idx": range(count), "a": [[x for x, _ in r] for r in rows], "b": [[y for _, y in r] for r in rows], "enter": pieces.START, "leave": pieces.END}))
    return [i for c, a, b in zip(chunks, states["state_in"], states["state_out"], strict=True) for i in pieces._trace(model, *c, a, b)]


def test_scan_and_units_equal_the_library(model, library):
    random.seed(2)
    parts = ["the", "tion", "   ", " ", "é", "漢", "x", "\n", "er", "heit", "ing", " of", "aaaa", " " * 12, "▁", "0", "1999", "ß", "\x01"]
    for _ in range(150):
        text = "".join(random.choice(parts) for _ in range(random.randint(1, 90)))
        want = library.encode(text)
        assert model.encode(text) == want
        assert scan(model, text, random.choice([40, 64, 100])) == want


def test_encode_edges(edge_docs, no_docs, library):
    rows = pieces.encode(edge_docs, PATH, chunk_chars=1000).collect()
    assert len(rows) == edge_docs.count()
    assert all(r["ids"] == (library.encode(r["text"]) if r["text"] else []) for r in rows)
    assert pieces.encode(no_docs, PATH).count() == 0


def test_round_trip(edge_docs, edge_rows):
    rows = pieces.round_trip(edge_docs, PATH, chunk_chars=1000).collect()
    assert len(rows) == len(edge_rows) and all(r["round_trip"] for r in rows)
    decoded = pieces.decode(pieces.encode(edge_docs, PATH, out_col="coded"), PATH, "coded").collect()
    assert all(r["decoded"] == (r["text"] or "") for r in decoded)


def test_tree_of_products_equals_the_library(spark, library):
    """Many chunks, so that products go through several levels."""
    random.seed(8)
    texts = ["".join(random.choices(["the", "tion", " ", "é", "xx", "\n", "ing "], k=n)) for n in (60, 300, 2500)] + ["ab" * 3000, " " * 700]
    rows = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, chunk_chars=64, fan=3).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {k: library.encode(t) for k, t in enumerate(texts)}


def test_long_units_are_not_remembered(model):
    model.encode("x" * 5000 + " short")
    assert all(len(k) <= 64 for k in model.unit)
