import random

from pyspark.sql import functions as F

from voxmere.llm.running import running


def brute(rows):
    out, sums, xors = [], {}, {}
    for key, k, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        out.append((key, k, v, sums.get(key, 0), xors.get(key, 0)))
        sums[key], xors[key] = sums.get(key, 0) + v, xors.get(key, 0) ^ v
    return out


def test_keys_over_many_partitions(spark):
    """One key fills several partitions, others lie inside one, and null is a key."""
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None, "z"]), k, r.randrange(-(10**9), 10**9)) for k in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        df = spark.createDataFrame(rows, "key string, k long, v long").withColumn("w", F.col("v"))
        dealt = df.repartitionByRange(9, F.col("key").asc_nulls_first(), "k").sortWithinPartitions(F.col("key").asc_nulls_first(), "k")
        found = running(dealt, "key", sums=("v",), xors=("w",)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    key = lambda t: (t[0] is not None, t[0] or "", t[1])
    assert sorted(((x["key"], x["k"], x["v"], x["before_v"], x["before_w"]) for x in found), key=key) == brute(rows)


def test_no_key_and_no_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("v"))
    found = running(df.repartitionByRange(7, "v").sortWithinPartitions("v"), None, sums=("v",)).collect()
    assert all(r["before_v"] == r["v"] * (r["v"] - 1) // 2 for r in found) and len(found) == 1000
    assert running(df.filter("v < 0").repartitionByRange("v").sortWithinPartitions("v"), None, sums=("v",)).count() == 0
