"""A permutation test as a stream that stops once its outcome is decided (R9, R10 over streams).

Values of permutations arrive in any order and any batches, some perhaps twice. The
state of a test holds how many are done and how many are at least as extreme, and which
permutation is next; values wait in it until all before them have come, so the running
p-value (exceed + 1) / (done + 1) is that of the permutations in order, and a value that
comes again changes nothing. A test is decided where an interval of `z` standard errors
about its p-value lies wholly above or below `alpha`, after LEAST permutations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from popspark.operators.stages import shared_folder, unique

#: Permutations before a test may be decided.
LEAST = 20
OUTPUT = "test string, done long, exceed long, p_value double, decided boolean"
STATE = "next long, exceed long, waiting array<struct<iter:long,extreme:boolean>>, decided boolean"


def is_decided(exceed: int, done: int, alpha: float, z: float) -> bool:
    """Whether the score interval of the share lies on one side of alpha."""
    if done < LEAST:
        return False
    p, n = (exceed + 1) / (done + 1), done + 1
    middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return alpha >= 0 and (middle + half < alpha or middle - half > alpha)


def running(values: DataFrame, alpha: float = 0.05, z: float = 3.0) -> DataFrame:
    """test, done, exceed, p_value and decided, for each test and batch that moved it on; update output.

    values: a stream of test, iter (0, 1, ... for each test), value and observed. A
    value is as extreme where it is a number and at least the observed one.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, exceed, held, decided = state.get if state.exists else (0, 0, [], False)
        waiting = {r["iter"]: r["extreme"] for r in held}
        for f in frames:
            waiting.update((i, bool(x)) for i, x in zip(f["iter"].tolist(), f["extreme"].tolist(), strict=True) if i >= at)
        start = at
        while at in waiting and not decided:
            exceed += waiting.pop(at)
            at += 1
            decided = is_decided(exceed, at, alpha, z)
        # Once decided nothing is kept, and what still comes is ignored.
        state.update((at, exceed, [] if decided else [{"iter": i, "extreme": x} for i, x in sorted(waiting.items())], decided))
        if at > start:
            yield pd.DataFrame({"test": [key[0]], "done": [at], "exceed": [exceed], "p_value": [(exceed + 1) / (at + 1)], "decided": [decided]})

    rows = values.select("test", F.col("iter").cast("long").alias("iter"), (~F.isnan("value") & (F.col("value") >= F.col("observed"))).alias("extreme")).where("iter is not null and extreme is not null")
    return rows.groupBy("test").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def sequential_test(observed: float, values: Callable[[int, int], DataFrame], spark, iterations: int = 999, every: int = 100, alpha: float = 0.05, z: float = 3.0) -> DataFrame:
    """done, exceed, p_value and decided after each batch of `every` permutations, which ends with the one that decides the test, or with the last.

    values(first, count) gives iter and value of that many permutations. Each batch is
    written to the folder that the stream reads, so permutations after the decision are
    never worked out. Undecided, the last p-value is the whole test's.
    """
    folder = f"{shared_folder(spark)}/permutations-{unique()}"
    name = f"permutations_{unique()}"
    schema = "test string, iter long, value double, observed double"
    spark.createDataFrame([], schema).write.parquet(f"{folder}/values")
    stream = spark.readStream.schema(schema).parquet(f"{folder}/values")
    query = running(stream, alpha, z).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").start()
    try:
        for first in range(0, iterations, every):
            part = values(first, min(every, iterations - first)).select(F.lit("test").alias("test"), F.col("iter").cast("long").alias("iter"), F.col("value").cast("double").alias("value"), F.lit(float(observed)).alias("observed"))
            part.write.mode("append").parquet(f"{folder}/values")
            query.processAllAvailable()
            if spark.table(name).where("decided").count():
                break
        return spark.createDataFrame(spark.table(name).drop("test").orderBy("done").collect(), OUTPUT.partition(", ")[2])
    finally:
        query.stop()
