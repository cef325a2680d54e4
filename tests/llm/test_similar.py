"""The pipeline's near-dedup against all pairs of five-word shingle sets."""

import random

from popspark.llm import similar, simhash


def plain_set(text):
    fold = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "").translate(fold)).split(" ") if w]
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_kept(rows):
    """The smallest doc_id of each component of the pairs with a similarity of 0.8 or more."""
    sets, parent = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), d), d)
    return sorted(first.values())


def test_shingles_match_sets():
    texts = [None, "", " \t", "One", "one TWO", "a b c d e", "A b c d e f g a b c d e", "x " * 400, "é É ñ a b c", "a\x0bb\x0cc\rd e f"]
    sets = [similar.shingles(t) for t in texts]
    for t, a in zip(texts, sets, strict=True):
        assert len(a) == len(plain_set(t)) and (a >= 0).all()
        for u, b in zip(texts, sets, strict=True):
            assert len(set(a) & set(b)) == len(plain_set(t) & plain_set(u))


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    for n in (1, 7, 60, 3000):
        text = [rng.choice(words) for _ in range(n)]
        other = [rng.choice(words) if rng.random() < 0.05 else w for w in text]
        a, b = similar.shingles(" ".join(text)), similar.shingles(" ".join(other))
        for x, y in ((similar.sketch(a), similar.sketch(b)), (similar.folded(similar.sketch(a)), similar.folded(similar.sketch(b)))):
            assert len(x) == len(y) and sum((int(p) ^ int(q)).bit_count() for p, q in zip(x.view("u8"), y.view("u8"), strict=True)) <= len(set(a) ^ set(b))


def test_keep_first_against_all_pairs(spark, sf):
    rng = random.Random(3)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").limit(300).collect()]
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, base = words(9), words(60)
    for i in range(90):
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(60)] = f"e{i}"
        rows.append((50_000 + i, " ".join(text)))
    for i in range(60):
        rows.append((60_000 + i, " ".join(line + words(rng.randrange(1, 12)))))
    for i in range(0, 40, 2):
        text = words(rng.randrange(20, 60))
        rows += [(70_000 + i, " ".join(text)), (70_001 + i, " ".join(text[: rng.randrange(len(text) * 7 // 10, len(text))]))]
    rows += [(80_000 + i, t) for i, t in enumerate([None, "", "one two", "One  TWO", "one"])]
    kept = sorted(r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == plain_kept(rows)
    # Edited copies go that the fingerprints of three-word shingles at two bits keep.
    assert len(kept) < len({r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()})


def test_rows_with_repeated_or_no_id(spark):
    long = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"]
    near = long[1].replace("b29", "other")
    rows = [(1, long[0], "x"), (1, long[1], "x"), (2, near, "x"), (3, long[2], "x"), (3, long[3], "x"), (0, long[3], "y"), (None, long[4], "x"), (None, long[4], "y"), (None, long[4] + " tail", "z"), (None, long[0], "x"), (9, long[5], "x"), (9, long[5], "x")]
    for part in (1, 5):
        got = [tuple(r) for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(part)).collect()]
        assert sorted(r for r in got if r[0] is not None) == sorted([rows[0], rows[1], rows[3], rows[5], rows[10]])
        assert len([r for r in got if r[0] is None]) == 1 and got[[r[0] for r in got].index(None)][1].startswith(long[4])
