import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voxmere.llm.tokens import _PROVEN, count_tokens, units

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["a  b\n c<|endoftext|> d'll we're    x", "foo  bar\n " * 900, "word " * 3000, "漢字" * 3000 + "<|endoftext|> " * 300, "".join(chr(97 + i % 26) + (" " if i % 1500 == 0 else "") for i in range(9000)), " lead  trail ", "  x \x1c y"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(spark, edge_docs, edge_rows, library):
    more = [(100 + k, t) for k, t in enumerate(TEXTS)]
    docs = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = sorted((-1 if i is None else i, len((t or "").encode()), size(t), size(t) > 1024) for i, t in [*edge_rows, *more])
    found = count_tokens(docs, PATH, chunk_chars=1024, overlap=64).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found) == want


def test_units_join_to_the_text():
    for text in TEXTS:
        first, rest = units(text)
        assert first + "".join(" " + u for u in rest) == text


def test_empty(no_docs):
    assert count_tokens(no_docs, PATH).count() == 0


def test_proven_places_begin_tokens(library):
    """Cut anywhere at a proven place, the two sides encode as the whole does."""
    random.seed(4)
    parts = ["don't", "I'll", "x1", "42", "a.b", "...", "漢字", "é", "\n", "\t ", "  ", " ", "!1", "e\u0301", "'s", "3rd", "#", "\xa0", "\x1c", "²"]
    for _ in range(300):
        text = "".join(random.choices(parts, k=12))
        whole = library.encode(text, add_special_tokens=False).ids
        for m in _PROVEN.finditer(text):
            cut = m.start()
            assert library.encode(text[:cut], add_special_tokens=False).ids + library.encode(text[cut:], add_special_tokens=False).ids == whole, (text, cut)


def test_texts_without_spaces_are_spliced(spark, library):
    random.seed(5)
    texts = ["".join(random.choices("abc0123456789+/", k=9000)), "\n".join("漢字仮名" * 9 for _ in range(300)), "漢字。" * 3000]
    found = count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, chunk_chars=1024, overlap=64).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in found} == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_other_columns(edge_docs, edge_rows):
    assert count_tokens(edge_docs, PATH).count() == len(edge_rows)
