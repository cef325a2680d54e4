import random
import re

import pytest
from pyspark.sql import functions as F

from popspark.llm import decontam


def plain(docs, items, span=10):
    fold = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    windows = {}
    for item, text in items:
        w = words(text)
        if item is None or not w:
            continue
        n = min(span, len(w))
        for i in range(len(w) - n + 1):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(map(str, found)), bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in df.collect()], key=str)


def rows(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    passage = re.findall(r"\S+", items[0][1])
    docs += [
        (9001, None), (9002, ""), (9003, " ".join(passage[:9])), (9004, "Xx " + " ".join(passage[:10]).upper() + " yy"), (9005, " ".join(passage[:10])),
        (9006, "z " * 495 + " ".join(passage[3:14]) + " z" * 700), (9007, "alpha beta gamma"), (9008, "alpha beta"), (9009, "the ALPHA, beta"), (None, items[1][1]), (None, "clean"),
        (9010, "r r r r r r r r r r r r r"), docs[0], docs[0],
    ]
    items += [(500, "alpha beta"), (501, "r r r r r r r r r r"), (502, None), (503, "..."), (None, "alpha"), (504, items[0][1]), (505, "beta")]
    return docs, items


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_against_all_windows(spark, sf, broadcast_rows):
    docs, items = rows(spark, sf)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hash", F.lit(1)).withColumn("words", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string")
    found = got(decontam.contamination(d, b, broadcast_rows=broadcast_rows))
    assert found == plain(docs, items)
    assert sum(x[4] for x in found) > 5


def test_short_segments_and_empty_tables(spark, sf):
    docs, items = rows(spark, sf)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(decontam.contamination(d, b, segment=7)) == plain(docs, items)
    assert got(decontam.contamination(d, b.limit(0))) == plain(docs, [])
    assert decontam.contamination(d.limit(0), b).count() == 0


def test_long_items(spark):
    rng = random.Random(8)
    item = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    docs = [(i, " ".join(["x"] * i + item[a : a + n])) for i, (a, n) in enumerate([(0, 9), (0, 10), (491, 18), (495, 14), (990, 30), (19_985, 15), (7000, 3000)])]
    items = [(1, " ".join(item)), (2, " ".join(item[498:509])), (3, "w1 w2 w3")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, words string")
    assert got(decontam.contamination(d, b)) == plain(docs, items)


def test_drop_contaminated(spark, sf):
    docs, items = rows(spark, sf)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    kept = decontam.drop_contaminated(d, b)
    clean = {str(x[0]) for x in plain(docs, items) if not x[4]}
    assert {str(r.doc_id) for r in kept.collect()} == clean and kept.columns == d.columns
    assert kept.where("doc_id is null").count() == 1
