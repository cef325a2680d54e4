import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from popspark.llm import sharding


def documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    return rows + [(5001, None, None), (5001, None, None), (None, "é", None), (5002, "", "src1"), (7, "tie", "lone")]


@pytest.mark.parametrize("bin_rows,most_sources", [(20_000, 256), (17, 256), (17, 1)])
def test_interleaving(spark, sf, bin_rows, most_sources):
    rows = documents(spark, sf)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.assign(df, 7, bin_rows=bin_rows, most_sources=most_sources).collect()
    assert sorted(map(str, [(r.doc_id, r.text, r.source) for r in got])) == sorted(map(str, rows))
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    # In sequence, the j-th row of a source of n stands where its fraction (2j + 1) / 2n says.
    sequence = sorted(got, key=lambda r: (r.shard, r.slot))
    sizes, seen, fractions = Counter(r.source for r in got), Counter(), []
    for r in sequence:
        fractions.append(((2 * seen[r.source] + 1) / (2 * sizes[r.source]), r.source is None, r.source or ""))
        seen[r.source] += 1
    assert fractions == sorted(fractions)


def test_same_result_by_counting_and_by_sorting(spark, sf):
    df = spark.createDataFrame([r for r in documents(spark, sf) if r[0] != 5001], "doc_id long, text string, source string")
    place = lambda **k: sorted(((r.doc_id, r.shard, r.slot) for r in sharding.assign(df, **k).collect()), key=str)
    assert place(bin_rows=10) == place(bin_rows=33, most_sources=1) == place()


def test_digest_and_edge_cases(spark, sf):
    rows = documents(spark, sf)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, shard int")
    got = sharding.digest(df).collect()
    want = sorted(str((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))) for d, t, _ in rows)
    assert sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in got) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert sharding.digest(df.limit(0)).count() == 0
    few = sharding.assign(df.select("doc_id", "text", "source").limit(3), 24).collect()
    assert sorted(r.shard for r in few) == [0, 1, 2]
    clash = sharding.assign(df.withColumnRenamed("size", "_rank").withColumn("_source", df["doc_id"])).collect()
    assert sorted(str(r["_rank"]) for r in clash) == ["1"] * len(rows) and all(r["_source"] == r.doc_id and 0 <= r.shard < 24 for r in clash)


def test_same_places_for_any_order_of_the_rows(spark):
    rows = [(i % 40 if i % 3 else None, f"text {i % 150}", f"s{i % 3}") for i in range(600)]
    places = []
    for seed in (1, 2, 3):
        shuffled = random.Random(seed).sample(rows, len(rows))
        df = spark.createDataFrame(shuffled, "doc_id long, text string, source string").repartition(seed)
        places.append(sorted(map(str, (tuple(r) for r in sharding.digest(df).collect()))))
        places.append(sorted(map(str, ((r.doc_id, len(r.text) + 8, zlib.crc32(r.text.encode()), "rows", r.shard, r.slot, None) for r in sharding.assign(df).collect()))))
    assert all(p == places[0] for p in places)


def test_copies_stand_apart(spark):
    df = spark.createDataFrame([(i // 3, f"text {i // 3}", f"s{i // 3 % 2}") for i in range(600)], "doc_id long, text string, source string")
    rows = sorted(sharding.assign(df, 4).collect(), key=lambda r: (r.shard, r.slot))
    assert not any(a.doc_id == b.doc_id for a, b in zip(rows, rows[2:])) and not any(a.doc_id == b.doc_id for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 77, 1000, 2**20])
def test_strides_are_bijections(spark, n):
    ranks = spark.range(n).select(F.col("id").alias("_rank"), F.lit(n).cast("long").alias("_n"))
    for total in (n, 3_000_000_000):
        out = ranks.select(sharding._spread(total).alias("r")).agg(F.count_distinct("r").alias("k"), F.min("r").alias("lo"), F.max("r").alias("hi")).first()
        assert (out.k, out.lo, out.hi) == (n, 0, n - 1)


def test_written_shards(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    sharding.write_shards(df, str(tmp_path / "shards"), shards=3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == df.count() and back.select("shard").distinct().count() == 3
