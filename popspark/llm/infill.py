r"""Fill-in-middle rearrangement of documents by ropes (operator 13).

A text is a rope: a balanced tree over its pieces, whose leaves know how many units
and code points they hold and whose nodes know the sums. Two splits at unit ranks cut
it into prefix, middle and suffix; the subtrees are joined in another order with
sentinels between. The inverse finds the sentinels, splits at their code-point ranks
and joins the subtrees in the first order. No step copies a text; it is written out once.

Units are runs that a regular expression matches from left to right and that cover the
text without gaps (lines by default). Prefix and middle end after the smaller and the
larger of h1 % (n + 1) and h2 % (n + 1) of n units; h1 to h4 are the first four groups
of eight digits of the sha256 of `<seed>:` and the document's id. They depend on nothing
else, so a document's form is the same in any run, partitioning and corpus.

Results: null counts as the empty text and an id that is null as the empty string. A
text that is empty or holds a sentinel stays as it is (form plain, its lengths null), as
do the documents outside `rate`. Repeated rows, also with null or repeated ids, have a
row each, and rows of equal id are cut by the same draws. An empty table gives no rows.
Other columns are kept; where one has the name of a new column, the new one gets an
underscore in front. The text column holds the new text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name

LINES = r"[^\n]*\n|[^\n]+"
SEED, RATE, SPM = "7", 100, 50
#: Units of a leaf.
LEAF = 64


class Sentinels(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class Leaf(NamedTuple):
    """A run of whole units: its text, and their ends in it (`ends` is None for a text without units, such as a sentinel)."""

    text: str
    ends: tuple[int, ...] | None

    @property
    def units(self) -> int:
        return len(self.ends or ())

    @property
    def chars(self) -> int:
        return len(self.text)

    def parts(self, rank: int, by_units: bool) -> tuple[Leaf, Leaf]:
        if not by_units:
            if self.ends is None:
                return Leaf(self.text[:rank], None), Leaf(self.text[rank:], None)
            return Leaf(self.text[:rank], tuple(e for e in self.ends if e <= rank)), Leaf(self.text[rank:], tuple(e - rank for e in self.ends if e > rank))
        ends = self.ends or ()
        cut = ends[rank - 1] if rank else 0
        return Leaf(self.text[:cut], ends[:rank]), Leaf(self.text[cut:], tuple(e - cut for e in ends[rank:]))


class Node(NamedTuple):
    left: Rope
    right: Rope
    units: int
    chars: int


type Rope = Leaf | Node

EMPTY = Leaf("", ())


def join(*ropes: Rope) -> Rope:
    """The ropes in a row; empty ones leave no node."""
    out: Rope = EMPTY
    for r in ropes:
        out = r if not out.chars else out if not r.chars else Node(out, r, out.units + r.units, out.chars + r.chars)
    return out


def _balanced(leaves: list[Rope]) -> Rope:
    while len(leaves) > 1:
        leaves = [join(*leaves[i : i + 2]) for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else EMPTY


def rope(text: str, unit: re.Pattern[str] | None = None) -> Rope:
    """A balanced rope of text, in leaves of LEAF units; without a unit, one leaf."""
    if unit is None:
        return Leaf(text, None)
    spans = [m.span() for m in unit.finditer(text)]
    ends = [e for _, e in spans]
    if [b for b, _ in spans] != [0, *ends][: len(ends)] or (text and ends[-1:] != [len(text)]):
        raise ValueError("units must cover the text")
    leaves: list[Rope] = []
    start = 0
    for i in range(0, len(ends), LEAF):
        some = ends[i : i + LEAF]
        leaves.append(Leaf(text[start : some[-1]], tuple(e - start for e in some)))
        start = some[-1]
    return _balanced(leaves)


def split(r: Rope, rank: int, by_units: bool = True) -> tuple[Rope, Rope]:
    """What stands before and after the first `rank` units (or code points), by one walk from the root to a leaf."""
    before: list[Rope] = []
    after: list[Rope] = []
    size = (lambda x: x.units) if by_units else (lambda x: x.chars)
    while isinstance(r, Node):
        if rank <= size(r.left):
            after.append(r.right)
            r = r.left
        else:
            before.append(r.left)
            rank -= size(r.left)
            r = r.right
    one, two = r.parts(rank, by_units)
    return join(*before, one), join(two, *reversed(after))


def written(r: Rope) -> str:
    out: list[str] = []
    todo: list[Rope] = [r]
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            todo += (x.right, x.left)
        else:
            out.append(x.text)
    return "".join(out)


class Cut(NamedTuple):
    """A text after its rearrangement."""

    text: str
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None


def rearrange(text: str, draws: tuple[int, int, int, int], unit: re.Pattern[str], marks: Sentinels, rate: int, spm: int) -> Cut:
    whole = rope(text, unit)
    h1, h2, h3, h4 = draws
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return Cut(text, whole.units, "plain", None, None)
    low, high = sorted((h1 % (whole.units + 1), h2 % (whole.units + 1)))
    head, suffix = split(whole, high)
    prefix, middle = split(head, low)
    p, s, m = (Leaf(x, None) for x in marks)
    form = "spm" if h4 % 100 < spm else "psm"
    out = join(s, suffix, p, prefix, m, middle) if form == "spm" else join(p, prefix, s, suffix, m, middle)
    return Cut(written(out), whole.units, form, prefix.chars, middle.chars)


def restored(text: str, form: str, marks: Sentinels) -> str:
    """The text that was rearranged into this one. A sentinel stands only once, since texts that hold one are left plain."""
    if form == "plain":
        return text
    order = (marks.suffix, marks.prefix, marks.middle) if form == "spm" else (marks.prefix, marks.suffix, marks.middle)
    rest, parts = rope(text), []
    for mark in reversed(order):  # what stands behind the last sentinel, then without it, and so on
        rest, part = split(rest, text.index(mark), by_units=False)
        parts.append(split(part, len(mark), by_units=False)[1])
    middle, second, first = parts
    prefix, suffix = (second, first) if form == "spm" else (first, second)
    return written(join(prefix, middle, suffix))


def draws(key: Column, seed: str = SEED) -> Column:
    """Four whole numbers under 2^32 from the sha256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


NEW = {"n_units": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64()}


def new_names(docs: DataFrame) -> list[str]:
    """The names of the new columns beside those of docs."""
    names: list[str] = []
    for name in NEW:
        names.append(fresh_name(name, docs.columns + names))
    return names


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", unit: str = LINES, marks: Sentinels = Sentinels(), rate: int = RATE, spm: int = SPM, seed: str = SEED) -> DataFrame:  # noqa: B008
    """docs with the text rearranged, and the columns n_units, form, prefix_chars and middle_chars (see `new_names`).

    rate is the percentage of documents that are rearranged, spm that of them with the suffix first.
    """
    overlaps = any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b))))
    if len({*marks}) < 3 or not all(marks) or overlaps or any(a in b for a in marks for b in marks if a != b):
        raise ValueError("three sentinels, none part of another, and none beginning as one ends")
    drawn = fresh_name("draws", docs.columns)
    names = new_names(docs)
    # The text is replaced in its place; a null stays apart from other columns by position, not by name.
    at = docs.columns.index(text)
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if i == at else F.col(f"`{c}`") for i, c in enumerate(docs.columns)], draws(F.col(f"`{key}`"), seed).alias(drawn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                cuts = [rearrange(t, h, pattern, marks, rate, spm) for t, h in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True)]
                texts, *more = zip(*cuts, strict=True)
                columns = [pa.array(texts, pa.string()) if j == at else c for j, c in enumerate(part.columns[:-1])]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x, k) for x, k in zip(more, NEW.values(), strict=True)]], names=[*part.schema.names[:-1], *names])

    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType()]
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])
    return rows.mapInArrow(run, schema)


def restore(rows: DataFrame, text: str = "text", form: str = "form", marks: Sentinels = Sentinels()) -> DataFrame:  # noqa: B008
    """rows with the text as it was before `transform`."""
    at, forms = rows.columns.index(text), rows.columns.index(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = [restored(t, f, marks) for t, f in zip(part.column(at).to_pylist(), part.column(forms).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if j == at else c for j, c in enumerate(part.columns)], names=part.schema.names)

    return rows.mapInArrow(run, rows.schema)


def digest(docs: DataFrame) -> DataFrame:
    """What query op13 returns: digests of the rearranged texts and of the texts restored from them."""
    out = transform(docs.select("doc_id", "text")).withColumn("output_sha256", F.sha2("text", 256))
    back = restore(out)
    return back.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("text", 256).alias("restored_sha256"))
