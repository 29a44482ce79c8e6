"""Token counts with overlap resynchronisation.

Byte-level BPE first splits a text with a pattern in which a piece can start with one space but never holds a space
after another character. So a place where a space follows a character that isn't white space begins a new piece whatever
stands around it: it is a proven boundary, and the texts between such places encode alike alone and in company.

Texts up to chunk_chars are counted as sums over such units, each encoded by the library and remembered. Longer ones are
dealt to the cluster in overlapping chunks, each encoded with offsets; neighbours are spliced at the first boundary that
is proven and starts a token in both encodings. For splices more boundaries are proven: any white space behind another
character, and where letters, digits and signs meet, but for a letter behind a sign, which may be a contraction. Where an
overlap holds none it is widened eightfold, and at last the text is encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmere.llm.text import cut_chunks, shared_checkpoint

_UNSAFE = re.compile(r"\s ")
_UNITS = re.compile(r"(?<=\S)(?= )")
_PROVEN = regex.compile(r"(?<=\S)(?=[ \t-\r])|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}])(?=\p{N})")
REMEMBERED, REMEMBERED_CHARS = 1 << 18, 64
MARGIN = 32


def units(text: str) -> tuple[str, list[str]]:
    """(text before the first proven boundary, the later units without their first space)."""
    if _UNSAFE.search(text):
        first, *rest = _UNITS.split(text)
        return first, [u[1:] for u in rest]
    first, *rest = text.split(" ")
    return first, rest


class Remembered(dict):
    """Function values by argument, those of long arguments not kept, all forgotten when there are too many."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = value
        return value


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def _count_short(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        inner = Remembered(lambda unit: len(tokenizer.encode(" " + unit, add_special_tokens=False).ids))
        of = inner.__getitem__
        for batch in batches:
            counts = []
            for text in batch.column(2).to_pylist():
                if not text:
                    counts.append(0)
                    continue
                first, rest = units(text)
                counts.append(sum(map(of, rest)) + (len(tokenizer.encode(first, add_special_tokens=False).ids) if first else 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return count


def _encode_chunks(path: str, overlap: int):
    """For each chunk its number of tokens, and the places in both overlaps where a splice is allowed."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            out = []
            for key, idx, begin, size, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                encoding = tokenizer.encode(text, add_special_tokens=False)
                at: dict[int, int] = {}
                for k, (start, _) in enumerate(encoding.offsets):
                    at.setdefault(start, k)
                cuts = [m.start() for m in _PROVEN.finditer(text) if m.start() in at]
                head = [(begin + p, at[p]) for p in cuts if p < overlap] if idx else []
                tail = [(begin + p, at[p]) for p in cuts if size <= p < len(text) - MARGIN] if len(text) > size else []
                out.append((key, idx, len(encoding.ids), [p for p, _ in head], [k for _, k in head], [p for p, _ in tail], [k for _, k in tail]))
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "idx", "n", "head_at", "head_k", "tail_at", "tail_k"), r, strict=True)) for r in out], schema=_CHUNK)

    return encode


_CHUNK = pa.schema([("key", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), *((f"{x}_{y}", pa.list_(pa.int64())) for x in ("head", "tail") for y in ("at", "k"))])
_CHUNK_DDL = "key string, idx long, n long, head_at array<long>, head_k array<long>, tail_at array<long>, tail_k array<long>"


def _count_long(huge: DataFrame, path: str, chunk_chars: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of texts that are longer than a chunk; n_tokens is null where some overlap held no splice."""
    chunks = cut_chunks(huge, chunk_chars, 0, overlap).select("key", "idx", (F.col("idx") * chunk_chars).alias("begin"), F.lit(chunk_chars).cast("long").alias("size"), "text")
    coded = chunks.mapInArrow(_encode_chunks(path, overlap), _CHUNK_DDL)
    order = Window.partitionBy("key").orderBy("idx")
    after = F.lead("head_at").over(order)
    spliced = coded.withColumn("next_at", after).withColumn("splice", F.array_min(F.array_intersect("tail_at", "next_at")))
    spliced = spliced.withColumn("from_at", F.lag("splice").over(order)).withColumn("last", F.col("next_at").isNull())
    k_of = lambda side, place: F.element_at(F.col(f"{side}_k"), F.array_position(f"{side}_at", place).cast("int"))
    begin = F.when(F.col("idx") == 0, F.lit(0).cast("long")).otherwise(k_of("head", F.col("from_at")))
    end = F.when(F.col("last"), F.col("n")).otherwise(k_of("tail", F.col("splice")))
    whole = spliced.select("key", F.when((F.col("last") | F.col("splice").isNotNull()) & ((F.col("idx") == 0) | F.col("from_at").isNotNull()), end - begin).alias("part"))
    return whole.groupBy("key").agg(F.when(F.count("part") == F.count(F.lit(1)), F.sum("part")).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, chunk_chars: int = 1 << 16, overlap: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row for each row of docs, of whole texts.

    A null or empty text has no bytes and no tokens. Null ids and repeated rows are kept as they are. Other columns of
    docs are not read. No text is cut: chunks are joined again exactly.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    short = base.filter(F.length("text") <= chunk_chars).mapInArrow(_count_short(path), f"id {kind}, n_bytes long, n_tokens long")
    huge = shared_checkpoint(
        base.filter(F.length("text") > chunk_chars).withColumn("key", F.sha2("text", 256)).groupBy("id", "n_bytes", "key").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    )
    texts, counted = huge.dropDuplicates(["key"]).select("key", "text"), None
    while not texts.isEmpty():
        if overlap >= chunk_chars:
            found = texts.withColumn("id", F.col("key")).select("id", F.lit(0).cast("long"), "text").mapInArrow(_count_short(path), "id string, n_bytes long, n_tokens long").select(F.col("id").alias("key"), "n_tokens")
        else:
            found = shared_checkpoint(_count_long(texts, path, chunk_chars, overlap))
        done = found.filter("n_tokens is not null")
        counted = done if counted is None else counted.unionByName(done)
        if overlap >= chunk_chars:
            break
        texts = texts.join(found.filter("n_tokens is null"), "key", "left_semi")
        overlap *= 8
    out = short
    if counted is not None:
        out = out.unionByName(huge.join(counted, "key").select("id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
