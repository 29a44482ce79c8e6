"""Line dedup by pairwise alignment.

Lines of `least` characters or more are counted first. A line that few documents hold (RARE at most) links each of them to
the one before it; these shared rare lines are what shows that two documents overlap. A line that more documents hold is
linked in salts: each document to the one before it in its salt, the first of a salt to the first of another. So a line in
n documents gives n - 1 links and not all pairs, and each document meets, for each of its repeated lines, an earlier
document that holds it. Linked documents are aligned with patience diff on line hashes, and the aligned common blocks that
hold such a line go from the later one. Long lines that both hold but that cross the alignment, or that the later one has
more often, are aligned after it one by one: in the end a long line goes exactly if an earlier document holds it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmere.llm.text import shared_checkpoint

NO_ID = -(1 << 63)
SALTS = 64
RARE = 16


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that rises in both places; pairs rise in the first."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        before[k] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[at], piles[at] = b, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _numbered(lines: list[int]) -> list[tuple[int, int]]:
    """Each line with how often it stood before, so that no two are equal."""
    seen: Counter = Counter()
    out = []
    for x in lines:
        out.append((x, seen[x]))
        seen[x] += 1
    return out


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b): equal heads and tails, then the lines that both sides hold once, again between them.

    Where no line stands once on both sides, equal lines are told apart by their number, so that what both hold is pinned.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            out.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            out.append((hi, high))
        if lo == hi or low == high:
            continue
        in_a, in_b = Counter(a[lo:hi]), Counter(b[low:high])
        place = {x: k for k, x in enumerate(b[low:high], low) if in_b[x] == 1}
        pins = _rising([(k, place[x]) for k, x in enumerate(a[lo:hi], lo) if in_a[x] == 1 and x in place])
        if not pins and in_a.keys() & in_b.keys():
            twin = {x: k for k, x in enumerate(_numbered(b[low:high]), low)}
            pins = _rising([(k, twin[x]) for k, x in enumerate(_numbered(a[lo:hi]), lo) if x in twin])
        for p, q in pins:
            todo.append((lo, p, low, q))
            out.append((p, q))
            lo, low = p + 1, q + 1
        if pins:
            todo.append((lo, hi, low, high))
    return sorted(out)


def common_blocks(a: list[int], b: list[int]) -> list[int]:
    """Places in a of aligned blocks with a long line, and of long lines of b elsewhere; hashes of long lines are odd."""
    out: set[int] = set()
    block: list[int] = []
    last = None
    for p, q in [*patience(a, b), (-9, -9)]:
        if last is None or p != last[0] + 1 or q != last[1] + 1:
            if any(a[k] & 1 for k in block):
                out.update(block)
            block = []
        block.append(p)
        last = (p, q)
    held = {x for x in b if x & 1}
    out.update(k for k, x in enumerate(a) if x in held)
    return sorted(out)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = [common_blocks(x.values.to_pylist(), y.values.to_pylist()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in gone])]).astype(np.int32)
        flat = pa.array(np.fromiter((k for x in gone for k in x), np.int32, offsets[-1]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["key", "mark", "gone"])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, salts: int = SALTS) -> DataFrame:
    """docs with two more columns: _lines, the lines of the text, and _gone, the places of those to delete (null: none).

    Lines are compared without white space at their ends. Earlier means a smaller id, then a smaller hash of the text; a
    null id comes first. Equal rows are one document and lose the same lines; a null text is one empty line. Columns of
    docs named _key, _mark, _lines or _gone are overwritten; dedup_lines and line_report pack rows first.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    line = lambda x: F.trim(F.regexp_replace(x, "\\s+$", ""))
    keyed = {"_key": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "_mark": F.xxhash64(text)}
    base = docs.withColumns(keyed)
    hashed = lambda x: F.xxhash64(line(x)).bitwiseAND(F.lit(-2)).bitwiseOR((F.length(line(x)) >= least).cast("long"))
    coded = shared_checkpoint(base.select(F.col("_key").alias("key"), F.col("_mark").alias("mark"), F.transform(F.split(text, "\\n"), hashed).alias("lines")))
    longs = coded.select("key", "mark", F.explode(F.array_distinct(F.filter("lines", lambda h: h.bitwiseAND(F.lit(1)) == 1))).alias("h"))
    # written first, so that the join below has no aggregate on its own shuffle and a line of many documents can be split
    often = shared_checkpoint(longs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", (F.col("n") <= RARE).alias("rare")))
    salt = F.when(F.col("rare"), F.lit(0)).otherwise(F.pmod(F.xxhash64("key", "mark"), F.lit(salts)))
    # dealt anew by salt: else the window would stay where the join has put all rows of a line
    met = longs.join(often, "h").withColumn("salt", salt).repartition("h", "salt")
    me = F.struct("key", "mark")
    met = met.withColumn("partner", F.lag(me).over(Window.partitionBy("h", "salt").orderBy("key", "mark")))
    firsts = met.filter("partner is null and not rare").withColumn("partner", F.lag(me).over(Window.partitionBy("h").orderBy("key", "mark")))
    links = met.filter("partner is not null").unionByName(firsts.filter("partner is not null"))
    pairs = links.select("key", "mark", F.col("partner.key").alias("other_key"), F.col("partner.mark").alias("other_mark")).filter("key <> other_key or mark <> other_mark").distinct()
    lists = coded.dropDuplicates(["key", "mark"])
    others = lists.select(F.col("key").alias("other_key"), F.col("mark").alias("other_mark"), F.col("lines").alias("other_lines"))
    both = pairs.join(others, ["other_key", "other_mark"]).join(lists, ["key", "mark"]).select("key", "mark", "lines", "other_lines")
    gone = both.mapInArrow(_align, "key long, mark long, gone array<int>").filter(F.size("gone") > 0)
    gone = gone.groupBy("key", "mark").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("_gone"))
    out = base.join(gone.withColumnsRenamed({"key": "_key", "mark": "_mark"}), ["_key", "_mark"], "left")
    return out.drop("_key", "_mark").withColumn("_lines", F.split(text, "\\n"))


def _kept():
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    return F.array_join(F.transform(left, lambda k: F.get("_lines", k)), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20) -> DataFrame:
    """docs with the repeated lines deleted from text_col (n_chars follows); texts that lose all their words go.

    Rows without repeated lines stay as they are, null texts too. Other columns may have any names. Texts of any length
    are read whole, of rows equal in id and text each loses the same lines, and an empty table gives no rows.
    """
    packed = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = repeated_lines(packed, "id", "text", least)
    out = found.withColumn("kept", F.when(F.col("_gone").isNotNull(), _kept())).filter(F.col("_gone").isNull() | F.col("kept").rlike("[^ \\t-\\r]"))
    untouched, columns = F.col("_gone").isNull(), []
    for c in docs.columns:
        old = F.col("row")[c]
        if c == text_col:
            old = F.when(untouched, old).otherwise(F.col("kept"))
        elif c == "n_chars":
            old = F.when(untouched, old).otherwise(F.length("kept").cast(docs.schema[c].dataType))
        columns.append(old.alias(c))
    return out.select(*columns)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20) -> DataFrame:
    """(id, n_lines, n_removed, kept_chars, kept_sha256): one row for each row of docs, null texts as empty ones.

    Other columns are not read; texts of any length are read whole; an empty table gives no rows.
    """
    found = repeated_lines(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "id", "text", least)
    kept = found.withColumn("kept", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(_kept()))
    return kept.select(
        F.col("id").alias(id_col),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.length("kept").cast("long").alias("kept_chars"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
