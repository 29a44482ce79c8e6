import re

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_lines import brute as repeated
from tests.llm.test_simhash import shingles, similar
from voxmere.llm import registry
from voxmere.llm.quality import rate_quality

D = "/root/testdata/sf0.001"


def plain(text):
    """The words that decontamination compares, as text."""
    return " ".join(re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text)))


def test_run_equals_slow_stages(spark):
    """Every stage on its own input against a plain twin: rules by the report, lines, near copies and leaks by all pairs."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    before = {r["doc_id"]: r["text"] for r in docs.collect()}

    def stage(name, docs):
        out = stages[name](spark, docs, D)
        rows = out.collect()
        assert out.columns == columns, name
        return spark.createDataFrame(rows, out.schema), {r["doc_id"]: r["text"] for r in rows}

    want = {r["doc_id"] for r in rate_quality(docs).collect() if r["kept"]}
    docs, kept = stage("quality_rules", docs)
    assert kept == {i: before[i] for i in want}

    gone, before = repeated(list(kept.items())), kept
    docs, kept = stage("line_dedup", docs)
    for i, text in before.items():
        lines = text.split("\n")
        left = [x for k, x in enumerate(lines) if k not in gone[i] and len(x.strip()) >= 20]
        assert [x for x in kept.get(i, "").split("\n") if len(x.strip()) >= 20] == left
        assert gone[i] or kept[i] == text

    before = kept
    docs, kept = stage("simhash_near_dedup", docs)
    sets = {i: shingles(t) for i, t in before.items()}
    for i in before:
        best = max((similar(sets[i], sets[j]) for j in before if j < i), default=0)
        assert best >= 0.8 if i not in kept else best < 0.8
    assert {i: before[i] for i in kept} == kept

    items = [(r["item_id"], plain(r["text"])) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    bad = {i for i, _ in leaks([(i, plain(t)) for i, t in kept.items()], items)}
    before = kept
    docs, kept = stage("benchmark_decontamination", docs)
    assert kept == {i: t for i, t in before.items() if i not in bad}

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    final = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, D).collect()}
    assert final == {i: library.encode(t) for i, t in kept.items()}


def test_stages_bear_odd_rows_and_columns(spark, edge_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, edge_docs, D).columns == edge_docs.columns, name
        stage(spark, edge_docs, D).count()
        assert stage(spark, no_docs, D).count() == 0, name
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, edge_docs, D).count() == edge_docs.count() and stage(spark, no_docs, D).count() == 0


def test_registry():
    assert [k.split("_")[0] for k in registry.QUERIES] == [*(f"op{n}" for n in range(1, 14)), "pipeline"]
