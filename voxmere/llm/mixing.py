"""Mixing sources to target weights by weighted fair queueing.

The documents of a source wait in a shuffled order, up to three times over. A document's virtual finish time is the words
of its source up to its end, divided by the source's weight. All queues are merged by one global sort by finish time, and
the merged queue is cut where the budget of words ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmere.llm.running import running
from voxmere.llm.text import shared_checkpoint

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: How often a document may be taken.
REPEATS = 3
SEED = 42


def weigh_sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, share: float = 1.0) -> DataFrame:
    """(source, source_size, weight, budget, target) of each source of (source, size), null being a source, too.

    Sources share `share` times all words by weight; none gets more than `repeats` times its size, and what is over is shared
    again by weight until none is above. With sources sorted by that limit over weight, the common virtual time at which the
    budget ends is the largest of (budget - limits of those before) / (weights of the rest): running sums tell it, for any number of sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    ranked = running(totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()), None, sums=("one",))
    weighed = ranked.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col("before_one") % len(weights) + 1).cast("int")).cast("long").alias("weight"), (F.col("source_size") * repeats).alias("most"))
    order = [F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()]
    filled = running(weighed.repartitionByRange(*order).sortWithinPartitions(*order), None, sums=("most", "weight"))
    whole = filled.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).select(F.floor(F.coalesce("words", F.lit(0)) * share).alias("budget"), "weights")
    left, rest = F.col("budget") - F.col("before_most"), F.col("weights") - F.col("before_weight")
    level = filled.crossJoin(F.broadcast(whole)).agg(F.max(F.struct((left / rest).alias("v"), left.alias("left"), rest.alias("rest"))).alias("m"), F.max("budget").alias("budget"))  # one row on either side
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.col("m.left") / F.col("m.rest"))
    return filled.crossJoin(F.broadcast(level)).select("source", "source_size", "weight", "budget", target.alias("target"))


def _clamp(value: Column, most: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0)), most)


def fair_queue(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, share: float = 1.0, seed: int = SEED) -> DataFrame:
    """The whole merged queue of (doc_id, source, size): a row for each time that a document stands in it.

    doc_id, source, size, source_size, target, place (of the document in its source), turn (0 for the first time), finish
    (virtual time), position (words ahead of it in the mix), words (taken of it; 0 behind the end). Within a source the order
    is that of a hash of seed and doc_id, so reruns agree. A document that is being served when the budget ends
    stands in the queue as two packets, so that no source is off its target by a large document; the end falls where the
    running sum of the sorted queue reaches the budget. Ties go by source, place and turn; a null size counts as 0.
    """
    rows = docs.select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"))
    rows = shared_checkpoint(rows.withColumn("dealt", F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 16)).withColumn("one", F.lit(1).cast("long")))
    sources = weigh_sources(rows, weights, repeats, share)
    order = [F.col("source").asc_nulls_last(), "dealt", "doc_id", "size"]
    lines = running(rows.repartitionByRange(*order).sortWithinPartitions(*order), "source", sums=("size", "one")).withColumnsRenamed({"before_one": "place", "source": "s"})
    placed = lines.join(sources, F.col("s").eqNullSafe(F.col("source"))).drop("s", "dealt", "one").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    ahead = F.col("turn") * F.col("source_size") + F.col("before_size")
    served = _clamp(F.floor("target") - ahead, F.col("size"))
    packet = lambda part, words, upto: F.struct(F.lit(part).alias("part"), words.alias("packet"), (upto / F.col("weight")).alias("finish"))
    first, second = packet(0, served, ahead + served), packet(1, F.col("size") - served, ahead + F.col("size"))
    cut = placed.withColumn("p", F.explode(F.when((served > 0) & (served < F.col("size")), F.array(first, second)).otherwise(F.array(packet(0, F.col("size"), ahead + F.col("size"))))))
    keys = ["finish", F.col("source").asc_nulls_last(), "place", "turn", "part"]
    packets = cut.select("doc_id", "source", "size", "source_size", "budget", "target", "place", "turn", "p.*")
    queue = running(packets.repartitionByRange(*keys).sortWithinPartitions(*keys), None, sums=("packet",))
    words = _clamp(F.col("budget") - F.col("before_packet"), F.col("packet"))
    return queue.select("doc_id", "source", "size", "source_size", "target", "place", "turn", "finish", F.col("before_packet").alias("position"), words.alias("words"))


def mix_report(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, source, text): doc_id, size (words of the text, null: 0), source_size, target and taken words."""
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("size"))
    taken = fair_queue(sized).groupBy("source", "place").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("words").alias("taken"))
    return taken.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, share: float = 1.0, seed: int = SEED) -> DataFrame:
    """The mix itself, in order of `position`: doc_id, source, turn, position and text, for each time that a document is taken.

    A document cut by the end of the budget has its first words, joined by a space; the others have their text as it is.
    Documents are found again by doc_id, which must be unique here; a null id, or a text without words, is not in the mix.
    """
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("size"))
    taken = fair_queue(sized, weights, repeats, share, seed).filter("words > 0").groupBy("doc_id", "source", "turn", "size").agg(F.min("position").alias("position"), F.sum("words").alias("words"))
    texts = docs.select("doc_id", "text")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    found = taken.join(texts, "doc_id").select("doc_id", "source", "turn", "position", F.when(F.col("words") < F.col("size"), first).otherwise(F.col("text")).alias("text"))
    return found.repartitionByRange("position").sortWithinPartitions("position")
