import textwrap
from collections import defaultdict

from popspark.llm import chat, licenses


def plain_chat(rows, size=64):
    """Whole dialogues, then cut where blocks of turn numbers or of `size` turns begin."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn if turn is not None else -(1 << 62), role or "unknown", text or ""))
    out = []
    for conv, said in convs.items():
        said.sort()
        for me in {role for _, role, _ in said} - {"system"}:
            text, cuts, seen = "", {}, defaultdict(int)
            for turn, role, words in said:
                name = role.replace("<|", "< |").replace("|>", "| >").replace("\n", " ").replace("\r", " ")
                head = "<|system|>" if role == "system" else "<|assistant|>" if role == me else f"<|user:{name}|>"
                text += "\n" if text else ""
                key = turn // size, seen[turn // size] // size
                seen[turn // size] += 1
                cut = cuts.setdefault(key, [len(text), 0, []])
                text += head + "\n"
                body = words.replace("<|", "< |") + "<|end|>"
                cut[1] += 1
                if role == me:
                    cut[2].append(f"{len(text)}:{len(text) + len(body)}")
                text += body
            starts = [c[0] for c in cuts.values()] + [len(text) + 1]
            for part, (start, n, masks) in enumerate(cuts.values()):
                out.append((conv, me, part, n, start, text[start : starts[part + 1] - 1], ",".join(masks)))
    return sorted(out)


def test_perspectives(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(900, 0, "system", "be kind"), (900, 1, "ann", "hi <|end|> é😀"), (900, 2, "bob", None), (900, 2, "bob", None), (900, 3, None, "?"), (900, None, "cy", "yes"), (900, None, "cy", "yes"), (900, 70, "ann", "late"), (900, 71, "a|>\n<|b", "odd"), (901, 0, "system", "alone"), (None, 0, "ann", "lost")]
    rows += [(902, 5, "ann" if i % 3 else "bob", f"t{i % 90}") for i in range(200)] + [(902, i, "bob", "long") for i in range(60, 300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    got = sorted(tuple(r) for r in chat.digest(df).collect())
    assert got == plain_chat(rows)
    assert {r[1] for r in got if r[0] == 900} == {"ann", "bob", "cy", "unknown", "a|>\n<|b"} and not [r for r in got if r[0] == 901]
    dialogues = defaultdict(list)
    for r in sorted(chat.rotate(df).where("conv_id >= 900").collect(), key=lambda r: (r.conv_id, r.perspective, r.part)):
        assert r.n_turns <= 64
        dialogues[r.conv_id, r.perspective].append(r)
    for parts in dialogues.values():
        text = "\n".join(r.text for r in parts)
        assert all(text[m.start : m.end].endswith("<|end|>") and text[: m.start].endswith("<|assistant|>\n") for r in parts for m in r.masks)
    assert chat.digest(df.limit(0)).count() == 0


def plain_notice(text):
    return [lic for lic, notice in licenses.TEMPLATES if notice in text]


def test_license_findings(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    found = defaultdict(list)
    for r in licenses.scan(docs).collect():
        found[r.doc_id].append(r)
    for d in docs.collect():
        want = set(plain_notice(d.text))
        assert want <= {r.license for r in found[d.doc_id]}, d.doc_id
        for r in found[d.doc_id]:
            if not r.n_differ:
                assert r.license in want
    assert len(found) > 10


def test_license_wording(spark):
    mit, apache = licenses.TEMPLATES[0][1], licenses.TEMPLATES[6][1]
    prose = "Some words of prose that say nothing of the kind stand here.\n" * 5
    lines = textwrap.fill(mit, 70)
    data = [
        (1, None), (2, ""), (3, prose), (4, prose + lines + "\n" + prose), (5, mit.replace("free of charge", "at no cost") + "\n" + prose + apache), (6, "copyright me " * 2000), (7, "Licensed under CC BY-NC 4.0."),
        (8, "Licensed under CC BY 4.0."), (9, "The driver's license and the warranty ran out."), (None, "Released under the MIT License."), (10, "x " * 30000 + "Released under the MIT License. " + "y " * 30000), (11, "no license here, MIT or otherwise, is granted"),
    ]
    got = defaultdict(list)
    for r in licenses.scan(spark.createDataFrame([(*x, 0) for x in data], "doc_id long, text string, start int")).collect():
        got[r.doc_id].append((r.license, r.n_differ))
    assert not any(got[i] for i in (1, 2, 3, 6, 9, 11))
    assert got[4][0][0] == "MIT" and len(got[4]) == 1
    assert {x[0] for x in got[5]} == {"MIT", "Apache-2.0"} and 0 < dict(got[5])["MIT"] <= 6
    assert got[7] == [("CC-BY-NC-4.0", 0)] and got[8] == [("CC-BY-4.0", 0)] and got[None] == [("MIT", 0)] and got[10] == [("MIT", 0)]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
