"""Difference hashes make the samples of a row once."""

from pyspark.sql import functions as F

from lumenlake.operators import grouping


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_samples_are_made_once_a_row(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return [(x * i * i) % 251 for i in range(72)]

    own = F.udf(counted, "array<int>").asNondeterministic()
    rows = spark.range(20).select("id", own("id").alias("s"))
    got = {r.id: r.h for r in rows.select("id", grouping.difference_hash(F.col("s")).alias("h")).collect()}
    bits = lambda s: "".join("1" if s[i // 8 * 9 + i % 8] > s[i // 8 * 9 + i % 8 + 1] else "0" for i in range(64))
    assert got == {k: f"{int(bits([(k * i * i) % 251 for i in range(72)]), 2):016x}" for k in range(20)}
    samples = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: (F.col("id") * (i + 1) * 37) % 256)
    text = plan(spark.range(20).select(grouping.difference_hash(samples).alias("h")))
    assert text.count("sequence(0, 71") + text.count("[0,1,2,3") <= 2  # in the plan's tree once, at most again in its details
    short = spark.range(1).select(grouping.difference_hash(F.array(F.lit(1))).alias("h"), grouping.difference_hash(F.lit(None).cast("array<int>")).alias("n")).first()
    assert short.h is None and short.n is None
