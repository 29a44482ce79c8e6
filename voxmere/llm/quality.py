"""Quality rules as weak supervision, in DataFrame expressions only.

Every rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of vote patterns estimates
how often each rule votes good on good and on bad documents; the posterior probability of good quality decides instead of
all rules having to pass.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmere.llm.text import WHITE, shared_checkpoint, shared_folder, words

WINDOW = 8
ROUNDS = 40
STRETCH = 100
COUNTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def with_signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with struct column `signals` of counts over the whole text; a null text has no words.

    n_repeat_words counts the words in windows of eight words that the text holds twice or more, the first included:
    the windows' hashes are sorted with their places, and the union of the places of equal ones is measured. n_judged is
    the number of words in stretches of STRETCH words (a last one of half that length counts), n_fresh the sum of the
    different words of each, so texts of any length are measured alike. The struct passes through an explode of one
    element, so that what reads it doesn't compute it again for each use. A column `signals` of docs is replaced.
    """
    kept = [c for c in docs.columns if c != "signals"]
    parts = docs.select(F.struct(*(F.col(c) for c in kept)).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = parts.withColumns({"hash": F.transform(words(F.col("text")), lambda w: F.xxhash64(w)), "lines": F.filter(F.split("text", "\\n"), lambda x: x.rlike("[^ \\t-\\r]"))})
    n = F.size("hash")
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("hash", i, WINDOW))))
    stretches = F.filter(F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / STRETCH).cast("int")), lambda k: F.slice("hash", k * STRETCH + 1, STRETCH)), lambda x: F.size(x) * 2 >= STRETCH)
    parts = parts.withColumns({"grams": grams, "stretches": stretches})
    paired = F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    parts = parts.withColumn("sorted", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), paired))
    twice = F.filter("sorted", lambda x, k: (F.get("sorted", k - 1)["g"] == x["g"]) | (F.get("sorted", k + 1)["g"] == x["g"]))
    parts = parts.withColumn("at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    only = lambda pattern: F.length(F.regexp_replace("text", pattern, "")).cast("long")
    summed = lambda size: F.aggregate(F.transform("stretches", size), F.lit(0), lambda a, b: a + b).cast("long")
    signals = F.struct(
        n.cast("long").alias("n_words"),
        only(WHITE).alias("word_chars"),
        only("[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        only("[^\\p{L}]+").alias("n_letters"),
        only("[^\\p{Lu}]+").alias("n_upper"),
        summed(lambda x: F.size(x)).alias("n_judged"),
        summed(lambda x: F.size(F.array_distinct(x))).alias("n_fresh"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x.rlike("[.!?:;…»”\"')]\\s*$"))).cast("long").alias("n_ended"),
    )
    return parts.select("row", F.explode(F.array(signals)).alias("signals")).select("row.*", "signals")


def votes(s: Column) -> Column:
    """Array of the rules' votes from a signals struct; each rule votes either way or, between its two limits or on a text
    that is too short for it, abstains."""
    n, chars, letters, upper, lines = s["n_words"], s["word_chars"], s["n_letters"], s["n_upper"], s["n_lines"]
    judged, fresh, again, doubled, ended = s["n_judged"], s["n_fresh"], s["n_repeat_words"], s["n_dup_lines"], s["n_ended"]

    def vote(enough: Column, bad: Column, good: Column) -> Column:
        return F.when(enough & bad, -1).when(enough & good, 1).otherwise(0)

    return F.array(
        vote(n > 0, s["n_symbols"] * 20 > n, s["n_symbols"] * 100 <= n),
        vote(n > 0, letters * 100 < chars * 88, letters * 100 >= chars * 94),
        vote(letters > 0, upper * 10 > letters * 3, upper * 10 < letters),
        vote(judged > 0, fresh * 100 < judged * 45, fresh * 100 >= judged * 60),
        vote(n >= 50, again * 100 > n * 20, again * 100 <= n * 2),
        vote(lines >= 4, doubled * 10 > lines * 4, doubled == 0),
        vote(lines >= 2, ended * 100 < lines * 50, ended * 100 >= lines * 85),
        vote(n > 0, (chars * 10 < n * 22) | (chars > n * 12), (chars >= n * 3) & (chars <= n * 8)),
    )


RULES = 8
#: Before the first round: a good document passes a rule 999 times of 1,000, a bad one fails it once in ten.
START = (0.8, 0.999, 0.9)
#: Each rule's votes are joined by this share of themselves, half of it good and half bad, and by four votes.
DOUBT = 0.003


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 20) | (s["n_repeat_words"] * 100 > s["n_words"] * 30)


Model = tuple[float, list[float], list[float]]


def fit(voted: DataFrame, rounds: int = ROUNDS) -> Model:
    """(log odds of good quality, weight of each rule's good vote, of its bad vote) from all rows' `votes`.

    The table of vote patterns has at most 3**RULES rows whatever the input, and the rounds run inside one expression
    over it. What each rule votes is estimated for good and bad documents apart, as a rule that nearly every document
    passes says little by passing. No estimate is bounded; DOUBT keeps them off 0 and 1. An empty table gives the
    starting values.
    """
    patterns = voted.select(F.col("votes").alias("v")).groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    table = patterns.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("patterns"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    prior, in_good, in_bad = START

    def said(v: Column, good: Column, bad: Column) -> Column:
        return F.when(v > 0, F.log(good / bad)).when(v < 0, F.log((1 - good) / (1 - bad))).otherwise(0.0)

    def step(state: Column, _: Column) -> Column:
        def posterior(p: Column) -> Column:
            each = F.zip_with(p["v"], F.arrays_zip(state["good"].alias("good"), state["bad"].alias("bad")), lambda v, r: said(v, r["good"], r["bad"]))
            odds = F.log(state["prior"] / (1 - state["prior"])) + total(each)
            return F.struct(p["v"].alias("v"), p["n"].alias("n"), (1 / (1 + F.exp(-odds))).alias("q"))

        def update(post: Column) -> Column:
            def rates(share) -> Column:
                def rate(j: Column) -> Column:
                    cast = total(F.transform(post, lambda p: F.when(F.get(p["v"], j) != 0, p["n"] * share(p)).otherwise(0.0)))
                    passed = total(F.transform(post, lambda p: F.when(F.get(p["v"], j) > 0, p["n"] * share(p)).otherwise(0.0)))
                    return (passed + (cast * DOUBT + 4) / 2) / (cast + cast * DOUBT + 4)

                return F.transform(F.sequence(F.lit(0), F.lit(RULES - 1)), rate)

            good, rows = total(F.transform(post, lambda p: p["n"] * p["q"])), total(F.transform(post, lambda p: p["n"]))
            return F.struct(((good + 1.6) / (rows + 2)).alias("prior"), rates(lambda p: p["q"]).alias("good"), rates(lambda p: 1 - p["q"]).alias("bad"))

        return _let(F.transform("patterns", posterior), update)

    start = F.struct(F.lit(prior).alias("prior"), F.array_repeat(F.lit(in_good), RULES).alias("good"), F.array_repeat(F.lit(in_bad), RULES).alias("bad"))
    begun = F.when(F.size("patterns") == 0, F.sequence(F.lit(1), F.lit(1))).otherwise(F.sequence(F.lit(1), F.lit(rounds)))
    found = table.select(F.aggregate(begun, start, lambda a, k: F.when(F.size("patterns") == 0, a).otherwise(step(a, k))).alias("s")).first()["s"]
    odds = lambda p: math.log(p / (1 - p))
    pairs = list(zip(found["good"], found["bad"], strict=True))
    return odds(found["prior"]), [math.log(g / b) for g, b in pairs], [math.log((1 - g) / (1 - b)) for g, b in pairs]


def posterior(v: Column, model: Model) -> Column:
    prior, passed, failed = model
    odds = F.lit(prior)
    for j, (good, bad) in enumerate(zip(passed, failed, strict=True)):
        odds = odds + F.when(F.get(v, F.lit(j)) > 0, F.lit(good)).when(F.get(v, F.lit(j)) < 0, F.lit(bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(voted: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """voted, with its columns votes and base_failed, and p_good and kept."""
    return voted.withColumn("p_good", posterior(F.col("votes"), model)).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


def filter_quality(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs, whatever their names.

    Texts are measured once: rows go with their votes to a table in the shared folder, which is fitted and filtered. Null
    and empty texts fail the base rules (they have no 20 words), repeated rows are judged each, and an empty table gives
    no rows. Texts of any length are read whole.
    """
    packed = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))
    s = F.col("signals")
    folder = f"{shared_folder(docs.sparkSession)}/quality-{uuid.uuid4().hex}"
    with_signals(packed).select("row", votes(s).alias("votes"), base_failed(s).alias("base_failed")).write.parquet(folder)
    voted = docs.sparkSession.read.parquet(folder)
    kept = judge(voted, fit(voted), least).filter("kept").select("row.*")
    return kept.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in docs.schema))


def rate_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, the counts of COUNTED, base_failed, kept, p_good): one row for each row of docs.

    Null ids and repeated rows are kept and judged each, null texts as empty ones, which fail the base rules. Other
    columns are not read, and an empty table gives no rows.
    """
    s = F.col("signals")
    narrow = with_signals(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    voted = shared_checkpoint(narrow.select("id", F.struct(*(s[c].alias(c) for c in COUNTED)).alias("counts"), votes(s).alias("votes"), base_failed(s).alias("base_failed")))
    return judge(voted, fit(voted), least).select(F.col("id").alias(id_col), "counts.*", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))
