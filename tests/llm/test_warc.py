import base64
import gzip
import hashlib
import os
import random
import re

import pytest

from popspark.llm import common, warc


def pages(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows += [(9000, "http://a", None), (9001, None, ""), (9002, "http://b\r\nX: y", rows[0][2]), (9003, "http://c", rows[0][2]), (9004, "u", "é😀\r\n\r\nWARC/1.1\r\n"), (None, "n", "x"), (9005, "big", "z" * 2_000_000), (9006, "dup", "same"), (9006, "dup", "same")]
    return rows


def plain(rows):
    top = {}
    for page, _, html in rows:
        if page is not None:
            top[html or ""] = max(top.get(html or "", -1), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        keeper = top.get(html or "")
        revisit = keeper is not None and page != keeper
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, sf):
    rows = pages(spark, sf)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = common.scratch(spark, "warc-test")
    manifest = warc.write(df, folder, roll_bytes=20_000).collect()
    assert len(manifest) > 3 and sum(m.records for m in manifest) == len(rows)
    got = warc.read(spark, folder).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == plain(rows)
    html = {p: h for p, _, h in rows}
    assert all(bytes(r.payload).decode() == (html[r.page_id] or "") for r in got if r.payload is not None)
    local = folder.removeprefix("file://")
    names = sorted(os.listdir(local))
    assert sum(n.endswith(".warc.gz") for n in names) == len(manifest) and "manifest.json" in names and not [n for n in names if n.startswith("_temporary")]
    for m in manifest:
        raw = open(f"{local}/{m.file}", "rb").read()
        assert len(raw) == m.bytes and hashlib.sha256(raw).hexdigest() == m.sha256
        assert len(re.findall(rb"WARC-Type: ", gzip.decompress(raw))) >= m.records


def test_same_rows_same_files(spark, sf):
    """Whatever the partitions, their order and the settings; a large page_id and null ids are cut by digest."""
    rows = pages(spark, sf) + [(7777, f"u{i}", f"<p>{i}</p>" * 200) for i in range(300)] + [(None, f"v{i}", f"<q>{i}</q>" * 200) for i in range(300)]
    manifests = []
    for seed, parts, adaptive in ((1, 3, "true"), (2, 7, "true"), (3, 1, "false")):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", str(parts + 1))
        df = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "page_id long, url string, html string").repartition(parts)
        folder = common.scratch(spark, "warc-test").removeprefix("file://")
        manifests.append([tuple(m) for m in warc.write(df, folder if seed == 1 else f"file:{folder}", roll_bytes=20_000).collect()])
        assert warc.read(spark, folder).count() == len(rows)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert manifests[0] == manifests[1] == manifests[2] and len(manifests[0]) > 8
    assert len({m[0][:18] for m in manifests[0] if m[0].startswith("part-0000000-")}) > 3  # null ids


class Dead(Exception):
    pass


def test_written_twice_and_refused_for_other_pages(spark, sf):
    df = spark.createDataFrame(pages(spark, sf), "page_id long, url string, html string")
    folder = common.scratch(spark, "warc-test")
    once = warc.write(df, folder, roll_bytes=20_000).collect()
    assert warc.write(df.repartition(5), folder, roll_bytes=20_000).collect() == once
    with pytest.raises(FileExistsError):
        warc.write(df.limit(10), folder, roll_bytes=20_000)


@pytest.mark.parametrize("step", ["reported", "renamed", "published", "cleared", "half renamed"])
def test_run_again_after_a_crash_at_any_step(spark, sf, monkeypatch, step):
    df = spark.createDataFrame(pages(spark, sf), "page_id long, url string, html string").repartition(3)
    want = [tuple(m) for m in warc.write(df, common.scratch(spark, "warc-test"), roll_bytes=20_000).collect()]
    folder = common.scratch(spark, "warc-test")
    local = folder.removeprefix("file://")

    def dies(*args, **more):
        raise Dead

    with monkeypatch.context() as m:
        if step == "reported":
            m.setattr(warc, "MANIFEST_SCHEMA", "file string, first_page long, records long, bytes long, sha256 no_such_type")
        elif step in ("renamed", "half renamed"):
            m.setattr(warc, "put_if_absent", dies)
        elif step == "published":
            m.setattr(warc, "clear_lost_runs", dies)
        else:
            m.setattr(warc, "manifest_of", dies)
        with pytest.raises(Exception):  # noqa: B017
            warc.write(df, folder, roll_bytes=20_000)
    if step == "half renamed":  # of the files, one lost and one cut short
        files = sorted(n for n in os.listdir(local) if n.endswith(".warc.gz"))
        os.remove(f"{local}/{files[0]}")
        with open(f"{local}/{files[1]}", "r+b") as f:
            f.truncate(100)
    got = [tuple(m) for m in warc.write(df.repartition(2), folder, roll_bytes=20_000).collect()]
    assert got == want and warc.read(spark, folder).count() == df.count()
    assert [n for n in os.listdir(local) if n.startswith("_temporary")] == [] and sum(n.startswith("_manifest") for n in os.listdir(local)) == 1
    for file, *_, sha in got:
        assert hashlib.sha256(open(f"{local}/{file}", "rb").read()).hexdigest() == sha


def test_empty(spark):
    assert warc.digest(spark.createDataFrame([], "page_id long, url string, html string, extra int")).count() == 0
