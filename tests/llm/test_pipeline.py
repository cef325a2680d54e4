"""Each stage of the pipeline against a brute-force version of its own."""

import hashlib
import math
import os
import subprocess
import sys
from collections import Counter

import corpus_pipeline
from popspark.llm import langid

from .test_decontam import plain as plain_hits
from .test_mixing import plain_targets
from .test_similar import plain_kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_turn(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(70001, None, None, "src1", 0), (70002, "12 34 ...", None, None, 9)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.quality)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontaminate", "mix_sources", "shard"]

    def run(name, df):
        out = stages[name](spark, df, sf)
        path = str(tmp_path / name)
        out.write.parquet(path)
        back = spark.read.parquet(path)
        assert name == "shard" or back.columns == COLUMNS
        return back, [r.asDict() for r in back.collect()]

    given = [r.asDict() for r in docs.collect()]
    model = langid.train(docs)
    told, bounds = {r.doc_id: r for r in langid.predict(docs, model, ("lang_pred", "score", "fit")).collect()}, langid.least_fits(docs, model)
    df, rows = run("language_id", docs)
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in given if told[r["doc_id"]].lang_pred != "und" and told[r["doc_id"]].score >= langid.LEAST_SCORE and told[r["doc_id"]].fit >= bounds[told[r["doc_id"]].lang_pred])
    assert {r["doc_id"] for r in given} - {r["doc_id"] for r in rows} == {70001, 70002}

    ids = [r["doc_id"] for r in rows]
    want = plain_kept([(r["doc_id"], r["text"]) for r in rows])
    df, rows = run("near_dedup", df)
    assert sorted(r["doc_id"] for r in rows) == sorted(want) and len(want) < len(ids)

    clean = {x[0] for x in plain_hits([(r["doc_id"], r["text"]) for r in rows], items) if not x[4]}
    df, rows = run("decontaminate", df)
    assert {r["doc_id"] for r in rows} == clean and len(clean) < len(want)

    size = {r["doc_id"]: len((r["text"] or "").split()) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += size[r["doc_id"]]
    target, copies = plain_targets(dict(sizes)), {}
    for source in sizes:
        mine = []
        for r in rows:
            if r["source"] == source:
                digest = hashlib.md5(f"mix-1|{r['doc_id']}|{hashlib.md5(r['text'].encode()).hexdigest()}".encode()).hexdigest()
                weight = {None: 1.0, 0: 0.5, 1: 2.0}[labels.get(r["doc_id"])]
                mine.append((-math.log((int(digest[:12], 16) + 0.5) / 16.0**12) / weight, r["doc_id"]))
        whole, before = math.floor(target[source] / sizes[source] + 1e-12), 0
        rest = target[source] - whole * sizes[source]
        for _, d in sorted(mine):
            copies[d] = whole + (rest > 0 and before + size[d] / 2 <= rest)
            before += size[d]
    df, rows = run("mix_sources", df)
    assert Counter(r["doc_id"] for r in rows) == Counter({d: n for d, n in copies.items() if n})

    _, shards = run("shard", df)
    counts = Counter(r["shard"] for r in shards)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(shards) == len(rows)
    assert all(sorted(r["slot"] for r in shards if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    n = Counter(r["source"] for r in shards)
    seen, fractions = Counter(), []
    for r in sorted(shards, key=lambda r: (r["shard"], r["slot"])):
        fractions.append(((2 * seen[r["source"]] + 1) / (2 * n[r["source"]]), r["source"] is None, r["source"] or ""))
        seen[r["source"]] += 1
    assert fractions == sorted(fractions)


def test_run_equals_its_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"shard", "slot"} <= set(out.columns) and corpus_pipeline.ORACLE_SQL is None


def test_rest_of_the_library_stands_alone():
    """Without this subpackage and the pipeline the driver's entry still imports."""
    code = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "popspark.llm"):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert len(e.queries()) > 50 and not any(q.startswith("op1_") or q == "pipeline" for q in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)
