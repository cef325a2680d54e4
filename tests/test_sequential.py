"""The permutation test as a stream: any order, repeated values, an early end."""

import math
import random

from popspark.streaming import permutations


def run(spark, tmp_path, batches, alpha=0.05):
    schema = "test string, iter long, value double, observed double"
    folder = str(tmp_path / "in")
    spark.createDataFrame([], schema).write.parquet(folder)
    q = permutations.running(spark.readStream.schema(schema).parquet(folder), alpha).writeStream.outputMode("update").format("memory").queryName("seq" + tmp_path.name.replace("-", "_")).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for b in batches:
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(folder)
            q.processAllAvailable()
        return spark.table(q.name).collect()
    finally:
        q.stop()


def test_order_and_repeats_do_not_matter(spark, tmp_path):
    rng = random.Random(1)
    values = [(t, i, rng.random(), 0.97) for t in ("a", "b") for i in range(60)]
    shuffled = rng.sample(values, len(values))
    got = run(spark, tmp_path, [shuffled[:50], shuffled[30:90], shuffled[80:]], alpha=-1.0)
    for t in "ab":
        mine = [r for r in got if r.test == t]
        last = max(mine, key=lambda r: r.done)
        exceed = sum(v >= o for x, _, v, o in values if x == t)
        assert (last.done, last.exceed) == (60, exceed) and math.isclose(last.p_value, (exceed + 1) / 61) and not last.decided


def test_a_decided_test_ends_and_keeps_no_state_of_later_values(spark, tmp_path):
    far = [("t", i, 0.0, 1.0) for i in range(400)]
    got = run(spark, tmp_path, [far[:100], far[100:300], far[300:], [("t", 5, math.nan, 1.0)]])
    last = max(got, key=lambda r: r.done)
    n = next(k for k in range(1, 400) if permutations.is_decided(0, k, 0.05, 3.0))
    assert last.decided and (last.done, last.exceed) == (n, 0) and permutations.LEAST <= n < 400


def test_later_permutations_are_not_worked_out(spark):
    asked = []

    def values(first, count):
        asked.append(first)
        return spark.createDataFrame([(i, 2.0) for i in range(first, first + count)], "iter int, value double")

    out = permutations.sequential_test(1.0, values, spark, iterations=500, every=50).collect()
    assert out[-1].decided and out[-1].p_value == 1.0 and asked == [0]


def test_intervals():
    assert not permutations.is_decided(0, 5, 0.05, 3.0) and permutations.is_decided(400, 999, 0.05, 3.0) and permutations.is_decided(0, 999, 0.05, 3.0) and not permutations.is_decided(50, 999, 0.05, 3.0)
