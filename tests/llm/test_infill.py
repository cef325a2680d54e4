"""Fill-in-middle rearrangement against plain slices of lists, and its exact inverse."""

import hashlib
import random
import re

import pytest

from popspark.llm import infill

LINE = re.compile(infill.LINES)
MARKS = infill.Sentinels()


def texts(seed=1, n=200):
    rng = random.Random(seed)
    bits = ["\n", "\n\n", "word ", "é😀", "\r", "x" * 50, "last line", "<P", "S>", " "]
    return ["".join(rng.choice(bits) for _ in range(rng.choice((0, 1, 3, 30, 900)))) for _ in range(n)]


def plainly(text, draws, spm=50):
    u = re.findall(infill.LINES, text)
    low, high = sorted((draws[0] % (len(u) + 1), draws[1] % (len(u) + 1)))
    p, m, s = "".join(u[:low]), "".join(u[low:high]), "".join(u[high:])
    if not text or any(x in text for x in MARKS):
        return (text, len(u), "plain", None, None)
    return (f"<S>{s}<P>{p}<M>{m}", len(u), "spm", len(p), len(m)) if draws[3] % 100 < spm else (f"<P>{p}<S>{s}<M>{m}", len(u), "psm", len(p), len(m))


def test_splits_keep_counts_and_text():
    rng = random.Random(2)
    for t in texts(3, 120):
        r = infill.rope(t, LINE)
        u = LINE.findall(t)
        assert (r.units, r.chars, infill.written(r)) == (len(u), len(t), t)
        k, c = rng.randint(0, len(u)), rng.randint(0, len(t))
        one, two = infill.split(r, k)
        assert (infill.written(one), infill.written(two)) == ("".join(u[:k]), "".join(u[k:])) and (one.units, two.chars) == (k, sum(map(len, u[k:])))
        assert tuple(map(infill.written, infill.split(r, c, by_units=False))) == (t[:c], t[c:])


def test_ropes_are_balanced():
    depth = lambda r: 1 + max(depth(r.left), depth(r.right)) if isinstance(r, infill.Node) else 0
    assert depth(infill.rope("line\n" * 64 * 1024, LINE)) == 10


def test_rearranged_texts_equal_slices_and_come_back():
    rng = random.Random(4)
    for t in texts():
        draws = tuple(rng.randrange(2**32) for _ in range(4))
        cut = infill.rearrange(t, draws, LINE, MARKS, 100, 50)
        assert tuple(cut) == plainly(t, draws)
        assert infill.restored(cut.text, cut.form, MARKS) == t


def test_units_that_leave_gaps_are_refused():
    with pytest.raises(ValueError):
        infill.rope("a b", re.compile(r"\w"))


@pytest.mark.parametrize("unit", [infill.LINES, r"\s*\S+|\s+", r"(?s)."])
def test_round_trip_over_columns(spark, unit):
    rows = [(i, t, i, "x", None) for i, t in enumerate(texts(7, 80))] + [(None, None, 1, "y", {"k": 1}), (None, "some\ntext\n", 1, "y", None), (3, "a <M> b", 0, "z", None), (3, "a <M> b", 0, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form int, n_units string, extra map<string,int>")
    out = infill.transform(docs, unit=unit, rate=70, spm=30)
    assert out.columns == ["doc_id", "text", "form", "n_units", "extra", "_n_units", "_form", "prefix_chars", "middle_chars"]
    forms = {r[0] for r in out.select("_form").distinct().collect()}
    assert forms == {"plain", "psm", "spm"}
    back = infill.restore(out, form="_form")
    key = lambda r: (str(r.doc_id), r.text, str(r.form), r.n_units, str(r.extra))
    assert sorted(map(key, back.collect())) == sorted(map(key, docs.fillna({"text": ""}).collect()))


def test_forms_are_drawn_by_id_alone(spark):
    docs = spark.createDataFrame([(i, f"one {i}\ntwo\nthree\n") for i in range(300)], "doc_id long, text string")
    got = sorted(map(tuple, infill.transform(docs).collect()))
    assert got == sorted(map(tuple, infill.transform(docs.repartition(7)).collect()))
    h = hashlib.sha256(b"7:12").hexdigest()
    assert got[12][1:] == plainly("one 12\ntwo\nthree\n", [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)])
    assert {r[3] for r in got} == {"psm", "spm"} and infill.transform(docs, rate=0).where("form <> 'plain'").isEmpty()


def test_empty_tables_and_clashing_sentinels(spark):
    assert infill.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        infill.transform(spark.createDataFrame([(1, "a")], "doc_id long, text string"), marks=infill.Sentinels("<P>", "<P>>", "<M>"))
