"""Spelling variants: words one edit apart, found by sorting rotations.

A word w is marked by a terminator and rotated, as in a permuterm index. Rotated until the edited character is last, two words that
differ in that character alone begin with the same range, and a word that lacks the character is that range itself. So
all rotations are sorted by what comes before their last character, and each range is scanned once. A range holds at most one word for
each letter, and one without, whatever the table holds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmere.llm.text import shared_checkpoint

RUN, BETWEEN = re.compile("[A-Za-zÀ-ÿ]+"), re.compile("[^A-Za-zÀ-ÿ]")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
LEAST_LENGTH, LEAST_COUNT, TYPO = 5, 3, 97
#: Characters read at once of a long text, and words counted in a task before they are passed on.
STRETCH, HELD = 1 << 20, 200_000


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo: int | None = TYPO) -> DataFrame:
    """(word, n): the words of (doc_id, text) with at least that many code points and occurrences.

    Words are runs of Latin letters, A-Z lower-cased. Where `typo` divides the unsigned crc32 of "<doc_id>:<word>", the code
    point at that crc modulo the word's length is left out, which plants misspellings by a fixed rule (None: none). A null
    text has no words, a null id is the empty string. Tasks add up what they read and pass on at most 200,000 words at once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for row in range(batch.num_rows):
                doc_id, text = batch.column(0)[row].as_py(), batch.column(1)[row].as_py() or ""
                seed, at = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), 0
                while at < len(text):
                    gap = BETWEEN.search(text, at + STRETCH)
                    end = gap.start() if gap else len(text)
                    for word, n in Counter(RUN.findall(text[at:end].translate(LOWER))).items():
                        if typo:
                            h = zlib.crc32(word.encode(), seed)
                            if h % typo == 0:
                                k = h % len(word)
                                word = word[:k] + word[k + 1 :]
                        if len(word) >= least_length:
                            held[word] = held.get(word, 0) + n
                    at = end
                    if len(held) >= HELD:
                        yield flushed()
        if held:
            yield flushed()

    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best_n, best) for each of the distinct words of (word, n): how many differ from it by one code point inserted,
    deleted or replaced, and of these the one of largest n (ties: the smallest by code points); nulls where there is none.

    Words must not hold a line feed, which serves as the terminator. An empty table gives no rows.
    """
    place, word = F.col("i"), F.col("word")
    size = F.char_length(word)
    turned = words.select("word", "n", F.explode(F.sequence(F.lit(1), size + 1)).alias("i"))
    head = word.substr(F.lit(1), place - 1)
    #: The rotation whose last character is the i-th, without it; and the whole rotation that starts with the i-th.
    edited = F.struct(F.concat(word.substr(place + 1, size), F.lit("\n"), head).alias("range"), F.lit(False).alias("bare"), ((place == 1) | (word.substr(place, F.lit(1)) != word.substr(place - 1, F.lit(1)))).alias("first"))
    bare = F.struct(F.concat(word.substr(place, size), F.lit("\n"), head).alias("range"), F.lit(True).alias("bare"), F.lit(False).alias("first"))
    rotations = turned.select("word", "n", F.explode(F.when(place <= size, F.array(edited, bare)).otherwise(F.array(bare))).alias("r")).select("r.*", "word", "n")
    ranges = Window.partitionBy("range").orderBy(F.desc("n"), "word")
    whole = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    item = F.struct("n", "word")
    scanned = rotations.repartitionByRange("range").select(
        "word", "bare", "first", F.count(F.lit(1)).over(whole).alias("all"), F.sum(F.col("bare").cast("long")).over(whole).alias("bares"), F.sum(F.col("first").cast("long")).over(whole).alias("firsts"),
        F.nth_value(item, 1).over(whole).alias("top"), F.nth_value(item, 2).over(whole).alias("next"),
    ).filter("all > 1")
    #: An inserted character meets the bare word once for each of a run of its like; only the run's first counts.
    met = F.when(F.col("bare"), F.col("firsts")).otherwise(F.col("all") - F.col("bares") - 1 + F.when(F.col("first"), F.col("bares")).otherwise(0))
    best = F.when(F.col("top.word") == word, F.col("next")).otherwise(F.col("top"))
    found = scanned.select("word", F.lit(0).cast("long").alias("n"), met.alias("near"), F.struct((-best["n"]).alias("m"), best["word"].alias("word")).alias("best"))
    none = F.lit(None).cast("struct<m:bigint,word:string>")
    return words.select("word", "n", F.lit(0).cast("long").alias("near"), none.alias("best")).unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best")).select("word", "n", "n_near", (-F.col("best.m")).alias("best_n"), F.col("best.word").alias("best"))


def follow(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form) without circles: root is the last that forms lead to. Each round doubles the steps, so
    a chain of k forms takes about log2(k) rounds; forms at least double their counts, so chains are short."""
    now = shared_checkpoint(links.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = shared_checkpoint(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not now.agg(F.bool_or("moved")).first()[0]:
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_groups(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root for (word, n): form is the near word of largest n if that is at least twice the word's
    own, else null; root is where forms lead from the word, itself if it has none. Words are distinct and not null."""
    near = near_words(shared_checkpoint(words))
    leads = F.col("best_n") >= 2 * F.col("n")
    rated = shared_checkpoint(near.select("word", "n", "n_near", F.when(leads, F.col("best")).alias("form"), F.when(leads, F.col("best_n")).alias("form_n")))
    roots = follow(rated.filter("form IS NOT NULL").select("word", "form"))
    return rated.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
