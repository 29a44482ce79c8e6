"""Prefix trie of conversations: every distinct beginning is a node with what it shares.

A turn is known by 128 bits of hash of its role, text and place. Conversations are laid out in blocks of eight turn-id
columns; Spark SQL's ROLLUP over the columns of a block makes all its prefixes at once, and grouping_id tells their depth.
Longer conversations go on in further blocks, keyed by the node in which the block before ended, so all blocks of all
conversations are rolled up together, whatever their number.

Sums over subtrees need no walk along the tree. A node is counted by its smallest member; a conversation is the smallest
member of its prefixes from some depth on. So a second ROLLUP over the conversations that are smallest anywhere adds up,
for every node, what the nodes below it hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmere.llm.running import running
from voxmere.llm.text import shared_checkpoint, words

BLOCK = 8
#: Conversation ids in one packed stretch of a node's list.
PACKED = 8192


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, words): the turns of each conversation from 0, null turn numbers first, equal numbers by role and
    text; a and b are hashes of role and text, null of either counts as empty. Turns without a conv_id belong to no
    conversation and are left out. A conversation may fill any number of tasks."""
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role"]
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    numbered = dealt.select("conv_id", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "role", "text").alias("b"), F.size(words(F.col("text"))).cast("long").alias("words"), F.lit(1).cast("long").alias("one"))
    return running(numbered, "conv_id", sums=("one",)).select("conv_id", F.col("before_one").alias("pos"), "a", "b", "words")


def share_heads(rows: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The conversations with heads taken over from the first of their group, as (turns, members).

    Conversation c becomes the first h turns of conversation c - c % group (none if it is absent, all if it is shorter) and its
    own turns after its first h; h is the unsigned crc32 of the decimal c, modulo `most`. turns are like those of
    ordered_turns, with length and total words of the conversation; members has all conversations: conv_id, len, total.
    """
    conv, h = F.col("conv_id"), F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = F.col("pos") >= h
    heads = rows.filter((conv % group == 0) & (F.col("pos") < most - 1)).groupBy(conv.alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "words"))).alias("head"))
    lengths = rows.groupBy("conv_id").agg(F.sum(own.cast("long")).alias("n_own"), F.sum(F.when(own, F.col("words")).otherwise(0)).alias("own_words"))
    based = lengths.withColumn("base", conv - conv % group).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,a:bigint,b:bigint,words:bigint>>")), F.lit(1), h.cast("int"))
    taken = based.select("conv_id", "n_own", "own_words", head.alias("head"))
    members = shared_checkpoint(taken.select("conv_id", (F.col("n_own") + F.size("head")).alias("len"), F.aggregate("head", F.col("own_words"), lambda s, x: s + x["words"]).alias("total"), "head"))
    moved = rows.filter(own).join(members.select("conv_id", "len", "total", F.size("head").alias("n_head")), "conv_id").select("conv_id", (F.col("pos") - h + F.col("n_head")).alias("pos"), "a", "b", "words", "len", "total")
    first = members.select("conv_id", "len", "total", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.a", "t.b", "t.words", "len", "total")
    return moved.unionByName(first), members.drop("head")


def _digest(ends: DataFrame) -> DataFrame:
    """(na, nb, ends_sha256) from (na, nb, conv_id): SHA-256 of the decimal ids in numeric order, joined by commas.

    The ids are sorted by range over all tasks and packed there; a node's packed stretches are then hashed one after the
    other as they come, so no list is ever held, however many conversations end in one node.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["na", "nb", "first", "ids"])
            out.clear()
            return batch

        for batch in batches:
            for a, b, c in zip(*(x.to_pylist() for x in batch.columns)):
                if (a, b) != node or len(ids) == PACKED:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                        if len(out) >= 4096 or len(ids) == PACKED:
                            yield flushed()
                    node, ids = (a, b), []
                ids.append(c)
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
        if out:
            yield flushed()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ids"))):
                if (a, b) == node:
                    state.update(b"," + text.encode())
                    continue
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["na", "nb", "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], ["na", "nb", "ends_sha256"])

    dealt = ends.repartitionByRange("na", "nb", "conv_id").sortWithinPartitions("na", "nb", "conv_id")
    packed = dealt.mapInArrow(pack, "na long, nb long, first long, ids string").repartition("na", "nb").sortWithinPartitions("na", "nb", "first")
    return packed.mapInArrow(chain, "na long, nb long, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each node of the trie: conv_id (its smallest member), depth, parent_conv_id (null at the root), n_convs
    (members), n_children, n_leaves (nodes without children in its subtree, itself included), saved_tokens (over its
    subtree, words of a node's last text times members but one) and ends_sha256 (of the members that end there).

    turns: (conv_id, pos, a, b, words, len, total), members: (conv_id, len, total) with those of length 0. The smallest
    member and the depth tell a node's text: the first `depth` turns of that conversation. Without members no node.
    """
    spark = turns.sparkSession
    place = [F.xxhash64("pos", "a", "b").alias("ga"), F.xxhash64(F.lit(1), "pos", "a", "b").alias("gb")]
    laid = turns.select("conv_id", F.expr(f"pos DIV {BLOCK}").alias("k"), "len", "total", F.struct("pos", *place, "words").alias("t")).groupBy("conv_id", "k", "len", "total").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    laid = laid.unionByName(members.filter("len = 0").select("conv_id", F.lit(0).cast("long").alias("k"), "len", "total", F.array().cast("array<struct<pos:bigint,ga:bigint,gb:bigint,words:bigint>>").alias("ts")))
    over = lambda c: F.aggregate("ts", F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x[c]))
    laid = laid.withColumns({"xa": over("ga"), "xb": over("gb"), "xw": F.aggregate("ts", F.lit(0).cast("long"), lambda s, x: s + x["words"])})
    blocks = running(laid.repartitionByRange("conv_id", "k").sortWithinPartitions("conv_id", "k"), "conv_id", sums=("xw",), xors=("xa", "xb"))
    names = [f"t{j}" for j in range(BLOCK)]
    column = lambda j: F.struct(F.get("ts", F.lit(j))["ga"].alias("ga"), F.get("ts", F.lit(j))["gb"].alias("gb"), F.get("ts", F.lit(j))["words"].alias("w"))
    rows = blocks.select("conv_id", "k", "len", "total", F.col("before_xa").alias("pa"), F.col("before_xb").alias("pb"), F.col("before_xw").alias("pw"), "xa", "xb", *(F.when(F.size("ts") > j, column(j)).alias(names[j]) for j in range(BLOCK)))

    def rolled(df: DataFrame, aggregates: str) -> DataFrame:
        """The nodes of all blocks: their hash (na, nb), depth, that of the node above, words up to the node and in its last text."""
        found = spark.sql(f"SELECT pa, pb, pw, k, {', '.join(names)}, {BLOCK} - bit_count(grouping_id()) AS d, {aggregates} FROM {{df}} GROUP BY pa, pb, pw, k, ROLLUP({', '.join(names)})", df=df)
        own = F.when(F.col("d") > 0, F.get(F.array(*names), F.col("d") - 1))
        xor = lambda c, p: reduce(Column.bitwiseXOR, (F.coalesce(F.col(f"{x}.{c}"), F.lit(0)) for x in names), F.col(p))
        kept = found.filter((F.col("d") > 0) & own.isNotNull() | (F.col("d") == 0) & (F.col("k") == 0))
        out = kept.withColumns({"na": xor("ga", "pa"), "nb": xor("gb", "pb"), "depth": F.col("k") * BLOCK + F.col("d"), "w": F.coalesce(own["w"], F.lit(0)), "ua": F.coalesce(own["ga"], F.lit(0)), "ub": F.coalesce(own["gb"], F.lit(0)), "upto": reduce(Column.__add__, (F.coalesce(F.col(f"{x}.w"), F.lit(0)) for x in names), F.col("pw"))})
        return out.withColumns({"ua": F.col("na").bitwiseXOR(F.col("ua")), "ub": F.col("nb").bitwiseXOR(F.col("ub")), "above": F.col("upto") - F.col("w")}).drop(*names, "pa", "pb", "pw", "upto", "w")

    nodes = shared_checkpoint(rolled(rows, "count(*) AS n_convs, min(conv_id) AS conv_id, max(len) AS longest, sum(total) AS total").drop("k", "d"))
    firsts = shared_checkpoint(nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "above", "ua", "ub")).alias("f"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf")).select("conv_id", F.col("f.depth").alias("f"), F.col("f.above").alias("ahead"), "f.ua", "f.ub", "leaf"))
    branches = ", ".join(f"count_if(f = k * {BLOCK} + {j + 1})" for j in range(BLOCK + 1))
    below = rolled(rows.join(firsts.select("conv_id", "f", "ahead", "leaf"), "conv_id"), f"sum(total - ahead) AS tails, sum(leaf) AS n_leaves, min(struct(conv_id, ahead, len)) AS m, array({branches}) AS branches")
    below = below.select("na", "nb", "depth", "tails", "n_leaves", "m", F.get("branches", F.col("d")).alias("branch"))
    parents = firsts.filter("f > 0").select("conv_id", F.col("f").alias("depth"), F.col("ua").alias("na"), F.col("ub").alias("nb")).join(nodes.select("na", "nb", F.col("conv_id").alias("up")), ["na", "nb"]).select("conv_id", "depth", "up")
    ends = _digest(rows.filter(f"k = greatest(len - 1, 0L) DIV {BLOCK}").select(F.col("pa").bitwiseXOR(F.col("xa")).alias("na"), F.col("pb").bitwiseXOR(F.col("xb")).alias("nb"), "conv_id"))
    whole = nodes.join(below, ["na", "nb", "depth"]).join(ends, ["na", "nb"], "left").join(parents, ["conv_id", "depth"], "left")
    all_words = F.col("total") - F.col("n_convs") * F.col("above")
    once = F.col("tails") - F.col("above") + F.col("m.ahead")
    return whole.select(
        "conv_id", "depth",
        F.when(F.col("depth") > 0, F.coalesce("up", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        (F.col("branch") + (F.col("m.len") > F.col("depth")).cast("long")).alias("n_children"),
        "n_leaves",
        (all_words - once).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the conversations with shared heads, from (conv_id, turn, role, text) and any further columns.

    Null role or text: empty; rows without a conv_id are left out; repeated rows are turns of their own; no rows, no nodes.
    """
    return prefix_trie(*share_heads(ordered_turns(turns)))
