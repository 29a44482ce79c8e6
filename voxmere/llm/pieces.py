"""SentencePiece encoding and decoding, with a max-plus scan over giant documents.

No piece holds a space mark behind another character, so a text falls into units, each a run of space marks and what
follows it, that encode alike alone and in company. Ordinary texts are encoded unit by unit through the library.

A giant text is split into chunks at fixed places. Its encoding is the path through the lattice of pieces in which every
two neighbours, taken together, encode to just these two; such a step weighs 0, any other minus infinity, and the one
finite path is the library's result. The state at a cut is the piece that crosses or ends at it. Each chunk yields the
matrix of states at its first cut by states at its last (finite entries only; a chunk with a unit's start in it has rank
one). Max-plus products are associative: matrices of up to FAN neighbours are multiplied in one task, the products again,
until one matrix stands for the document; then the states at the cuts are chosen back down the tree, and every chunk is
traced on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmere.llm.text import cut_chunks, shared_checkpoint
from voxmere.llm.tokens import Remembered, units

SPACE = "▁"
LONGEST = 16
AROUND = 2 * LONGEST
START = END = 0
ROWS = 256
FAN = 64


class Model:
    """The library's processor with the few lookups that the scan needs."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        p = self.processor
        self.scores = {p.id_to_piece(i): p.get_score(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))}
        if max(map(len, self.scores)) > LONGEST or any(SPACE in piece.lstrip(SPACE) for piece in self.scores):
            raise ValueError("pieces must be short and hold space marks only at their start")
        self.unit = Remembered(self._unit)
        self.split = Remembered(self._split)

    def _unit(self, unit: str) -> tuple[int, ...]:
        """Ids of a space mark followed by unit."""
        return tuple(self.processor.encode(unit)) if unit else (self.processor.piece_to_id(SPACE),)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        first, rest = units(" " + text.replace(SPACE, " "))
        heads = (self.unit[first[1:]],) if first else ()
        return list(chain.from_iterable(chain(heads, map(self.unit.__getitem__, rest))))

    def _split(self, text: str) -> tuple[str, ...]:
        """Pieces of a short text by repeated best merges, leftmost first among equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda k: (self.scores.get(parts[k] + parts[k + 1], -np.inf), -k))
            if parts[best] + parts[best + 1] not in self.scores:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return tuple(parts)

    def fits(self, left: str, right: str) -> bool:
        return self.split[left + right] == (left, right)

    def steps(self, text: str, at: int) -> list[int]:
        """Ends of the pieces that start at a place and encode to themselves."""
        return [e for e in range(at + 1, min(at + LONGEST, len(text)) + 1) if self.split[text[at:e]] == (text[at:e],)]

    def ids(self, piece: str) -> list[int]:
        if piece in self.scores:
            return [self.processor.piece_to_id(piece)]
        return [self.processor.piece_to_id(f"<0x{b:02X}>") for b in piece.encode()]


def _cross(model: Model, text: str, cut: int) -> list[tuple[int, int]]:
    """All edges of the lattice that cross the cut or end at it."""
    return [(s, e) for s in range(max(0, cut - LONGEST), cut) for e in model.steps(text, s) if e >= cut]


def _reach(model: Model, text: str, first: dict[tuple[int, int], int], begin: int, stop: int) -> dict[tuple[int, int], tuple[int, list]]:
    """Edges before stop with the set of first edges (as bits) that lead to them, and their predecessors."""
    found = {edge: (bits, []) for edge, bits in first.items()}
    ending: dict[int, list] = {}
    for edge in found:
        ending.setdefault(edge[1], []).append(edge)
    for at in range(begin, stop):
        if at not in ending:
            continue
        for e in model.steps(text, at):
            before = [x for x in ending[at] if x[0] == x[1] or model.fits(text[x[0] : x[1]], text[at:e])]
            bits = 0
            for x in before:
                bits |= found[x][0]
            if bits:
                found[at, e] = (bits, before)
                ending.setdefault(e, []).append((at, e))
    return found


def _unit_starts(text: str, lo: int, hi: int) -> tuple[int, int] | None:
    """First and last place in [lo, hi] where a unit begins."""
    is_start = lambda k: text[k : k + 1] == SPACE and text[k - 1 : k] != SPACE
    first = next((k for k in range(lo, hi + 1) if is_start(k)), None)
    return None if first is None else (first, next(k for k in range(hi, lo - 1, -1) if is_start(k)))


def _code(edge: tuple[int, int], cut: int) -> int:
    return (cut - edge[0]) * 64 + (edge[1] - cut)


def _edge(code: int, cut: int) -> tuple[int, int]:
    return cut - code // 64, cut + code % 64


def _matrix(model: Model, text: str, lo: int, hi: int, last: bool) -> list[tuple[int, int]]:
    """Finite entries (state at lo, state at hi) of a chunk's transfer matrix; lo is 0 in the first chunk."""
    enter = _cross(model, text, lo) if lo else [(0, 0)]
    code_in = (lambda x: _code(x, lo)) if lo else (lambda x: START)
    code_out = (lambda x: END) if last else (lambda x: _code(x, hi))
    leaves = (lambda x: x[1] == hi) if last else (lambda x: x[0] < hi <= x[1])
    starts = _unit_starts(text, max(lo, 1), hi - 1)
    bits = {edge: 1 << k for k, edge in enumerate(enter)}
    if starts is None:
        found = _reach(model, text, bits, lo, hi)
        return [(code_in(x), code_out(y)) for y, (b, _) in found.items() if leaves(y) for k, x in enumerate(enter) if b >> k & 1]
    head = _reach(model, text, bits, lo, starts[0])
    into = 0
    for edge, (b, _) in head.items():
        into |= b if edge[1] == starts[0] else 0
    tail = _reach(model, text, {(starts[1], starts[1]): 1}, starts[1], hi)
    return [(code_in(x), code_out(y)) for k, x in enumerate(enter) if into >> k & 1 for y in tail if y[0] != y[1] and leaves(y)]


def _trace(model: Model, text: str, lo: int, hi: int, last: bool, state_in: int, state_out: int) -> list[int]:
    """Ids of the pieces that start in a chunk, given the states at both its cuts."""

    def back(found: dict, edge: tuple[int, int], first: tuple[int, int]) -> list[int]:
        path = []
        while edge != first:
            path.append(edge)
            edge = found[edge][1][0]
        return list(chain.from_iterable(model.ids(text[s:e]) for s, e in reversed(path)))

    def out_of(found: dict, but: tuple[int, int]) -> tuple[int, int]:
        if not last:
            return _edge(state_out, hi)
        return next(x for x in found if x[1] == hi and (x != but or but[1] == hi))

    first = _edge(state_in, lo) if lo else (0, 0)
    starts = _unit_starts(text, max(lo, 1), hi - 1)
    if starts is None:
        found = _reach(model, text, {first: 1}, lo, hi)
        return back(found, out_of(found, first), first)
    head = _reach(model, text, {first: 1}, lo, starts[0])
    ids = back(head, next(x for x in head if x[1] == starts[0]), first)
    between = text[starts[0] : starts[1]].replace(SPACE, " ")
    if between:
        ids += model.encode(between[1:]) if between != " " else list(model.unit[""])
    tail_start = (starts[1], starts[1])
    tail = _reach(model, text, {tail_start: 1}, starts[1], hi)
    return ids + back(tail, out_of(tail, tail_start), tail_start)


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(path)
        for batch in batches:
            out = []
            for key, idx, lo, hi, last, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entries = _matrix(model, text.replace(" ", SPACE), lo, hi, last)
                out.append({"key": key, "idx": idx, "a": [x for x, _ in entries], "b": [y for _, y in entries]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("idx", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    return run


def _relations(entries: pd.DataFrame) -> list[set[tuple[int, int]]]:
    return [set(zip(a, b, strict=True)) for a, b in zip(entries["a"], entries["b"], strict=True)]


def _product(entries: pd.DataFrame, fan: int) -> pd.DataFrame:
    """The max-plus product of neighbouring matrices: which states at the first cut lead to which at the last."""
    entries = entries.sort_values("idx")
    first, *rest = _relations(entries)
    for pairs in rest:
        onward: dict[int, list[int]] = {}
        for x, y in pairs:
            onward.setdefault(x, []).append(y)
        first = {(x, z) for x, y in first for z in onward.get(y, ())}
    found = sorted(first)
    return pd.DataFrame({"key": [entries["key"].iloc[0]], "idx": [int(entries["idx"].iloc[0]) // fan], "a": [[x for x, _ in found]], "b": [[y for _, y in found]]})


def _combine(entries: pd.DataFrame) -> pd.DataFrame:
    """The states on the finite path through neighbouring matrices from state `enter` to state `leave`."""
    entries = entries.sort_values("idx")
    rows = _relations(entries)
    reached = [{int(entries["enter"].iloc[0])}]
    for pairs in rows:
        reached.append({y for x, y in pairs if x in reached[-1]})
    state, chosen = int(entries["leave"].iloc[0]), []
    for k in range(len(rows) - 1, -1, -1):
        before = min(x for x, y in rows[k] if y == state and x in reached[k])
        chosen.append((before, state))
        state = before
    chosen.reverse()
    return pd.DataFrame({"key": entries["key"], "idx": entries["idx"], "state_in": [x for x, _ in chosen], "state_out": [y for _, y in chosen]})


_MATRIX_DDL = "key string, idx long, a array<int>, b array<int>"


def _states(matrices: DataFrame, fan: int) -> DataFrame:
    """(key, idx, state_in, state_out) of every chunk: products up a tree of groups of `fan`, choices back down."""
    levels, group = [shared_checkpoint(matrices)], F.floor(F.col("idx") / fan).alias("group")
    while levels[-1].filter(F.col("idx") >= fan).limit(1).count():
        levels.append(shared_checkpoint(levels[-1].groupBy("key", group).applyInPandas(lambda entries: _product(entries, fan), _MATRIX_DDL)))
    states = None
    for level in reversed(levels):
        below = level.withColumn("up", F.floor(F.col("idx") / fan))
        if states is None:
            below = below.withColumns({"enter": F.lit(START), "leave": F.lit(END)})
        else:
            below = below.join(states.select("key", F.col("idx").alias("up"), F.col("state_in").alias("enter"), F.col("state_out").alias("leave")), ["key", "up"])
        states = below.groupBy("key", "up").applyInPandas(lambda entries: _combine(entries), "key string, idx long, state_in int, state_out int")
    return states


def _traces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(path)
        for batch in batches:
            out = []
            for key, idx, lo, hi, last, text, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append({"key": key, "idx": idx, "ids": _trace(model, text.replace(" ", SPACE), lo, hi, last, a, b)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("idx", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return run


def _id_lists(each: list[list[int]]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(each), np.int32, offsets[-1])))


def _encode_short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), _id_lists([model.encode(t) for t in part.column(1).to_pylist()])], ["row", "ids"])

    return run


def _encode_long(huge: DataFrame, path: str, chunk_chars: int, fan: int) -> DataFrame:
    n = chunk_chars
    marked = huge.select("key", F.concat(F.lit(" "), F.replace(F.col("text"), F.lit(SPACE), F.lit(" "))).alias("text"))
    chunks = cut_chunks(marked, n, AROUND, AROUND).select(
        "key",
        "idx",
        F.expr(f"if(idx = 0, 0L, {AROUND}L)").alias("lo"),
        F.expr(f"if(idx = 0, 0L, {AROUND}L) + least({n}L, total - idx * {n})").alias("hi"),
        F.expr(f"(idx + 1) * {n} >= total").alias("last"),
        "text",
    )
    chunks = shared_checkpoint(chunks)
    states = _states(chunks.mapInArrow(_matrices(path), _MATRIX_DDL), fan)
    traced = chunks.join(states, ["key", "idx"]).select(*chunks.columns, "state_in", "state_out").mapInArrow(_traces(path), "key string, idx long, ids array<int>")
    return traced.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "ids"))), lambda x: x["ids"])).alias("ids"))


def _long_ids(rows: DataFrame, path: str, chunk_chars: int, fan: int = FAN) -> DataFrame | None:
    """(row, ids) of the rows (row struct, text) with more than chunk_chars characters; None if there are none."""
    long = shared_checkpoint(rows.filter(F.length("text") > chunk_chars).withColumn("key", F.sha2("text", 256)))
    if long.isEmpty():
        return None
    ids = _encode_long(long.select("key", "text").dropDuplicates(["key"]), path, chunk_chars, fan)
    return long.join(ids, "key").select("row", "text", "ids")


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids", chunk_chars: int = 1 << 16, fan: int = FAN) -> DataFrame:
    """docs with the library's ids of each whole text in out_col (array of int, empty for a null or empty text).

    Rows, their other columns and repeated rows are kept as they are; an older column named out_col is replaced. Texts
    of more than chunk_chars characters pass through the scan, each distinct one once.
    """
    kept = [F.col(c) for c in docs.columns if c != out_col]
    packed = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = packed.schema["row"].dataType.simpleString()
    short = packed.filter(F.length("text") <= chunk_chars).mapInArrow(_encode_short(path), f"row {kind}, ids array<int>")
    long = _long_ids(packed, path, chunk_chars, fan)
    out = short if long is None else short.unionByName(long.select("row", "ids"))
    return out.select("row.*", F.col("ids").alias(out_col))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """docs with the text that ids_col stands for (empty for null or no ids)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Model(path)
        for batch in batches:
            yield pd.Series([model.processor.decode(x.tolist()) if x is not None and len(x) else "" for x in batch])

    return docs.withColumn(out_col, F.pandas_udf(run, "string")(F.col(ids_col)))


def _checked(model: Model, ids: pa.Array, each: list[list[int]], coded: pa.ListArray, texts: list[str]) -> pa.RecordBatch:
    back = [model.processor.decode(x) if x else "" for x in each]
    same = [a == b for a, b in zip(back, texts, strict=True)]
    hashes = [hashlib.sha256(t.encode()).hexdigest() for t in back]
    columns = [ids, pa.array([len(x) for x in each], pa.int64()), coded, pa.array(hashes, pa.string()), pa.array(same, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids", "decoded_sha256", "round_trip"])


def _round_short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(1).to_pylist()
                each = [model.encode(t) for t in texts]
                yield _checked(model, part.column(0), each, _id_lists(each), texts)

    return run


def _round_long(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(path)
        for batch in batches:
            for at in range(batch.num_rows):
                part = batch.slice(at, 1)
                each = part.column(2).to_pylist()
                yield _checked(model, part.column(0), each, _id_lists(each), part.column(1).to_pylist())

    return run


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 1 << 16) -> DataFrame:
    """(id, n_tokens, ids, decoded_sha256, round_trip): each text encoded, decoded again and compared.

    round_trip is false only for texts that hold the model's own space mark, which it reads as a space.
    """
    base = docs.select(F.col(id_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {base.schema['row'].dataType.simpleString()}, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean"
    out = base.filter(F.length("text") <= chunk_chars).mapInArrow(_round_short(path), schema)
    long = _long_ids(base, path, chunk_chars)
    if long is not None:
        out = out.unionByName(long.mapInArrow(_round_long(path), schema))
    return out.withColumnRenamed("id", id_col)
