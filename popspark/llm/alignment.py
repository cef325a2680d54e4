"""Alignment of two tokenizers' tokens over the same bytes (operator 12).

Tokens of A and B are byte ranges of one text. B's ranges are put into a static
interval index (`Index`); a bisect stabbing query for each A token lists the B tokens
it overlaps. A gap between neighbouring B tokens that no A token spans is the border of
a group: there tokens of both end.

Words are aligned once and remembered. A text is cut before each single space between
characters that are no white space (CUT). Both vocabularies are shown to end a token
there: A's pattern lets a space stand only at a word's start or in a run of white space
of its own; B has no piece with a word mark after another character, which `Aligner`
checks when it loads. So a text's alignment is that of its pieces in a row. Texts where
that does not hold (a literal U+2581, which B can't tell from a space) are encoded whole.

How many documents hold an id pair linked is counted over the whole corpus. Each
document's different pairs and their times are written once, pairs are counted, and the
counts go back: to the commonest pairs, of which there are MOST_COMMON at most, by
broadcast; to all others by a shuffle, in which no pair has more than a 2 / MOST_COMMON
share of all rows. Memory of a task is bounded by the longest piece without such a
space and by the links of one document.

Results: a text that is null, empty, or that either vocabulary does not give back byte
for byte has no tokens: zeros and the empty string. Repeated rows, also with null or
repeated ids, have a row each and count as documents each. An empty table gives no
rows. Other columns of the documents are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, materialise
from .tokencount import sliced, vocabulary_file

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: An id pair is one number of PAIR_BITS: A's id in the upper, B's in the lower ID_BITS.
ID_BITS, PAIR_BITS = 20, 40
#: Pieces remembered by a worker, about 300 bytes each (their pairs are bounded by the eightfold), and characters encoded as one run.
REMEMBERED, RUN = 300_000, 4000
#: Pairs that are broadcast with their counts, at most (17 bytes each).
MOST_COMMON = 200_000
#: A space with no white space beside it. Python's white space includes that of both vocabularies.
CUT = re.compile(r"(?<=\S) (?=\S)")
MARK = "▁"
SCHEMA = "row long, id {}, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<pair:long,times:long>>"


class Index:
    """A static index of intervals [start, end) in order of their starts; ends are made monotone by a running maximum."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.starts, self.reach = starts, np.maximum.accumulate(ends) if len(ends) else ends

    def stab(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query [start, end) the first and the last interval that it overlaps; last < first where it overlaps none.

        All intervals between overlap too where, as among tokens, none lies inside another.
        """
        return np.searchsorted(self.reach, starts, "right"), np.searchsorted(self.starts, ends, "left") - 1


def links_and_borders(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each A token the first and last B token it overlaps, and whether each B token is the last of its group.

    Both sides cover the same bytes from 0 on without gaps, given by the ends of their tokens.
    """
    start = lambda ends: np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first, last = Index(start(b_ends), b_ends).stab(start(a_ends), a_ends)
    spans = np.zeros(len(b_ends) + 1, np.int64)  # how many A tokens span the gap after B token i: +1 from first on, -1 from last on
    np.add.at(spans, first, 1)
    np.add.at(spans, last, -1)
    return first, last, np.cumsum(spans)[:-1] == 0 if len(b_ends) else np.zeros(0, bool)


class Pieces(NamedTuple):
    """Alignments of pieces of text: whether both vocabularies give a piece's bytes back, counts, where its id pairs end in `pairs`, and its groups as text."""

    valid: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray
    groups: list[str]


def _joined(parts: list[Pieces]) -> Pieces:
    return Pieces(*[np.concatenate(x) for x in list(zip(*parts, strict=True))[:-1]], [g for p in parts for g in p.groups])


class Aligner:
    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        own = _byte_letters()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(own[c] for c in t) if all(c in own for c in t) else t.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        conf = json.loads(Path(a).read_text())
        known = conf["normalizer"] is None and conf["pre_tokenizer"]["type"] == "ByteLevel" and conf["pre_tokenizer"]["use_regex"] and not conf["pre_tokenizer"]["add_prefix_space"]
        #: Whether pieces may be encoded apart.
        self.local = known and not any(MARK in n.lstrip(MARK) for n in names)
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.known = self.pieces([])
        self.starts = np.zeros(0, np.int64)

    def pieces(self, texts: list[str]) -> Pieces:
        """The alignment of each text, encoded as one: a space and the text by A, the text by B, which adds the space.

        Texts that neither begin nor end with white space are encoded in runs, with
        the space between them at which both vocabularies cut. A run that does not
        come back byte for byte, or is not cut there, is encoded text by text.
        """
        runs: list[list[int]] = [[]]
        size = RUN
        for i, t in enumerate(texts):
            clean = self.local and t and not t[0].isspace() and not t[-1].isspace() and MARK not in t
            if size + len(t) >= RUN or not clean:
                runs.append([])
                size = 0
            runs[-1].append(i)
            size = size + len(t) + 1 if clean else RUN
        runs = [r for r in runs if r]
        fine, odd = self._encoded(texts, runs)
        again, void = self._encoded(texts, [[i] for r in odd for i in r])
        order = [i for r, *_ in (*fine, *again) for i in r]
        at = np.empty(len(texts), np.int64)
        at[order + [i for r in void for i in r]] = np.arange(len(texts))
        done = self._aligned(texts, order, [x for _, x, _ in (*fine, *again)], [x for *_, x in (*fine, *again)], len(void))
        ends = np.cumsum(done.n_links)
        pairs = done.pairs[_ranges(ends[at] - done.n_links[at], done.n_links[at])]
        return Pieces(*[x[at] for x in done[:5]], pairs, [done.groups[i] for i in at.tolist()])

    def _encoded(self, texts: list[str], runs: list[list[int]]) -> tuple[list[tuple[list[int], np.ndarray, np.ndarray]], list[list[int]]]:
        """The runs with their ids by A and B, and the runs that do not come back or are not cut between their texts."""
        if not runs:
            return [], []
        joined = [" ".join([texts[i] for i in r]) for r in runs]
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in joined], add_special_tokens=False)]
        ids_b = self.b.encode(joined, num_threads=1)
        fine, odd = [], []
        for r, t, a, b in zip(runs, joined, ids_a, ids_b, strict=True):
            whole = (" " + t).encode()
            ok = t and b"".join([self.a_bytes[x] for x in a]) == whole == b"".join([self.b_bytes[x] for x in b])
            if ok and len(r) > 1:
                cuts = np.cumsum([len(texts[i].encode()) + 1 for i in r])
                ok = np.isin(cuts, np.cumsum(self.a_sizes[a])).all() and np.isin(cuts, np.cumsum(self.b_sizes[b])).all()
            if ok:
                fine.append((r, np.array(a, np.int64), np.array(b, np.int64)))
            else:
                odd.append(r)
        return fine, odd

    def _aligned(self, texts: list[str], order: list[int], ids_a: list[np.ndarray], ids_b: list[np.ndarray], void: int) -> Pieces:
        """The alignments of the texts in this order, whose ids stand in a row, and of `void` texts without tokens."""
        n = len(order)
        none = np.zeros(void, np.int64)
        if not n:
            return Pieces(none.astype(bool), none, none, none, none, np.zeros(0, np.int64), [""] * void)
        # One index over all: their bytes stand in a row, so no token of one text overlaps those of another.
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        first, last, border = links_and_borders(ends_a, ends_b)
        cuts = np.cumsum([len(texts[i].encode()) + 1 for i in order])
        of_a, of_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        count = lambda x: np.concatenate([np.bincount(x, minlength=n), none])
        times = last - first + 1
        pairs = np.repeat(a, times) << ID_BITS | b[_ranges(first, times)]
        # Tokens of both sides in order of their groups, A's first, each with the mark that follows it.
        group_b = np.cumsum(border) - border
        group = np.concatenate([group_b[first], group_b])
        side, owner = np.repeat([0, 1], [len(a), len(b)]), np.concatenate([of_a, of_b])
        sort = np.argsort(2 * group + side, kind="stable")
        group, side, owner = group[sort], side[sort], owner[sort]
        mark = np.where(owner[1:] != owner[:-1], 3, np.where(group[1:] != group[:-1], 2, (side[1:] != side[:-1]).astype(int)))
        words = pa.compute.binary_join_element_wise(pa.array(np.concatenate([a, b])[sort]).cast(pa.string()), pa.array([",", "|", ";", ""]).take(pa.array(np.append(mark, 3))), "")
        stops = np.append(0, np.cumsum(np.bincount(owner, minlength=n)))
        texts_of = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), words), "").to_pylist()
        return Pieces(np.arange(n + void) < n, count(of_a), count(of_b), count(of_b[border]), count(np.repeat(of_a, times)), pairs, texts_of + [""] * void)

    def look_up(self, pieces: list[str]) -> np.ndarray:
        """The place of each piece in `known`; new ones are aligned first."""
        new = list(set(pieces).difference(self.memo))
        if new:
            self.memo.update(zip(new, range(len(self.known.valid), len(self.known.valid) + len(new)), strict=True))
            self.known = _joined([self.known, self.pieces(new)])
            self.starts = np.cumsum(self.known.n_links) - self.known.n_links
        return np.fromiter(map(self.memo.__getitem__, pieces), np.int64, len(pieces))

    def documents(self, texts: list[str]) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text n_a, n_b, n_groups, n_links and the groups' digest; then the different (text, pair, times)."""
        if len(self.memo) > REMEMBERED or len(self.known.pairs) > 8 * REMEMBERED:
            self.forget()
        split = [CUT.split(t) if t and self.local and MARK not in t else [t] for t in texts]
        place = self.look_up([p for ps in split for p in ps])
        sizes = np.array([len(ps) for ps in split])
        ends = np.cumsum(sizes)
        whole = np.logical_and.reduceat(self.known.valid[place], ends - sizes)
        for i in np.flatnonzero(~whole).tolist():
            if sizes[i] > 1:  # as a whole, the last word on what comes back
                split[i] = [texts[i]]
        if any(len(ps) != n for ps, n in zip(split, sizes.tolist(), strict=True)):
            place = self.look_up([p for ps in split for p in ps])
            sizes = np.array([len(ps) for ps in split])
            ends = np.cumsum(sizes)
        sums = [np.add.reduceat(x[place], ends - sizes) for x in self.known[1:5]]
        groups, strings, at = self.known.groups, [], place.tolist()
        for a, z, n in zip((ends - sizes).tolist(), ends.tolist(), sums[0].tolist(), strict=True):
            strings.append(hashlib.sha256(";".join([groups[i] for i in at[a:z]]).encode()).hexdigest() if n else "")
        links = self.known.n_links[place]
        owner = np.repeat(np.repeat(np.arange(len(texts)), sizes), links)
        pairs = self.known.pairs[_ranges(self.starts[place], links)]
        keys, times = np.unique(owner << PAIR_BITS | pairs, return_counts=True)
        return sums, strings, keys >> PAIR_BITS, keys & ((1 << PAIR_BITS) - 1), times


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then from starts[1], and so on."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable Latin-1, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def aligner(a: str, b: str) -> Aligner:
    """A worker keeps its aligner between tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(("aligner", a, b), lambda: Aligner(vocabulary_file(a), vocabulary_file(b)))


def aligned(docs: DataFrame, a: str = BYTE_VOCABULARY, b: str = PIECE_VOCABULARY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """row, id and each document's counts, groups' digest, and its different id pairs (`links`) with their times."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(a, b)
        for batch in batches:
            for part, texts in sliced(batch):
                counts, groups, owner, pairs, times = al.documents(texts)
                links = pa.StructArray.from_arrays([pa.array(pairs), pa.array(times, pa.int64())], names=["pair", "times"])
                ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(texts))))
                columns = [*[pa.array(c, pa.int64()) for c in counts], pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), links)]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), *columns], names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    return rows.mapInArrow(run, SCHEMA.format(rows.schema["id"].dataType.simpleString()))


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and best: whether no pair of the same A id has more. links has a row for each document and pair."""
    counts = links.groupBy("pair").agg(F.count("*").alias("n"))
    # At most as many rows as A has ids.
    most = counts.groupBy(F.shiftright("pair", ID_BITS).alias("a")).agg(F.max("n").alias("most"))
    return counts.join(most, F.shiftright("pair", ID_BITS) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def common_from(counts: DataFrame, most: int = MOST_COMMON) -> int:
    """The least power of two that at most `most` pairs reach, from a histogram of 64 bins."""
    bins = {r.bin: r.pairs for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("bin")).agg(F.count("*").alias("pairs")).collect()}
    total, least = 0, max(bins, default=0) + 1
    for k in range(max(bins, default=-1), -1, -1):
        total += bins.get(k, 0)
        if total > most:
            break
        least = k
    return 1 << least


def align(docs: DataFrame, a: str = BYTE_VOCABULARY, b: str = PIECE_VOCABULARY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each document: key, n_a, n_b, n_groups, n_links, n_best, count_sum and the groups' digest."""
    rows = materialise(aligned(docs, a, b, text, key), "alignment")
    links = rows.select("row", F.explode("links").alias("l")).select("row", "l.pair", "l.times")
    counts = materialise(pair_counts(links), "pair-counts")
    least = common_from(counts)
    common, rare = counts.where(F.col("n") >= least), counts.where(F.col("n") < least)
    sums = lambda joined: joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    mostly = sums(links.join(F.broadcast(common), "pair"))
    others = sums(links.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(rare.hint("merge"), "pair"))
    both = mostly.unionByName(others).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.drop("links").join(both, "row", "left").select(F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), F.col("groups").alias("groups_sha256"))
