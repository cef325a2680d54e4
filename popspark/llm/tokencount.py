"""Token counts of whole texts, huge ones in overlapping chunks that are spliced (operator 11).

A text of up to `chunk` code points is encoded at once. A longer one is cut into
windows, each a chunk and the first `overlap` code points of the next. Windows are
rows of their own, so one document's windows are encoded all over the cluster.

Where two neighbours are spliced is proven, not guessed. The vocabulary cuts a text
into words by a regular expression without lookbehind, after context-free steps, and
merges inside words alone. So from a word's first character on, what it does depends
on what follows only: once the true cutting and a window's cutting begin a word at the
same place, they agree from there on. The first window is true from its start; of its
words that begin in the overlap, it shares one with the next window, which is true
from there on, and so forth. A place counts only if it is out of reach of the window's
cut end (`Encoder.guard`) and its character neither composes with nor is reordered
before an earlier one (`settled`).

Where neighbours share no such place, the document is cut anew into chunks of twice the
length with up to four times the overlap, by merging its windows in pairs, until all
its windows align or one window holds it whole; that is at most log2(length / chunk)
rounds, and only the documents concerned take part. A word without end is a window
without end: the vocabulary itself has to see it whole.

Results: null counts as the empty text (0 bytes, 0 tokens). Repeated rows, also with
null or repeated ids, have a row each. An empty table gives no rows. Other columns of
the documents are not read. A vocabulary whose steps are not known to be context-free
(`Encoder.local`) is never cut; its texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, materialise

VOCABULARY = "word_bpe_49k.json"
CHUNK, OVERLAP, LIMIT = 32_768, 512, 2048
#: Words remembered by a worker, and the longest of them; about 100 bytes each.
REMEMBERED, MOST_WORD = 400_000, 32
#: Code points of texts that a task encodes at once.
SLICE = 1_000_000
#: White space that no word of a local vocabulary holds, and beside which nothing composes.
BLANKS = str.maketrans("\t\n\r", "   ")


def vocabulary_file(name: str) -> str:
    """A path as it is; a bare name among the installed public vocabularies."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def composing() -> frozenset[str]:
    """Characters that may join an earlier one under NFC: the second parts of canonical pairs, Hangul vowels and finals."""
    return kept(("composing",), _composing)


def _composing() -> frozenset[str]:
    pairs = (unicodedata.decomposition(chr(i)).split() for i in range(0x110000))
    seconds = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    return frozenset(seconds | {chr(i) for i in range(0x1161, 0x1176)} | {chr(i) for i in range(0x11A8, 0x11C3)})


def settled(c: str) -> bool:
    """Whether normalisation treats what begins with c alike, whatever stands before."""
    return c.isascii() or (not unicodedata.combining(c) and c not in composing())


class Encoder:
    """A vocabulary file of the tokenizers library, without begin, end, truncation and padding; special strings in texts as the library has them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        conf = json.loads(Path(path).read_text())
        added = conf.get("added_tokens") or []
        self.special = np.array(sorted(t["id"] for t in added), np.int64)
        #: A word's cut end reaches so far back: the longest added string, or three letters of a contraction.
        self.guard = max([len(t["content"]) for t in added], default=0) + 8
        normal, split = (self._steps(conf.get(k), inner) for k, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in added)
        #: Words by white space are encoded apart, so that a window's words are those of the whole text.
        self.local = (
            plain and all(s["type"] in ("NFC", "Lowercase") or (s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " ") for s in normal)
            and [s["type"] for s in split] == ["Split", "ByteLevel"] and split[0]["behavior"] == "Removed" and split[0]["invert"] and "(?<" not in json.dumps(split[0]["pattern"])
            and not split[1]["use_regex"] and not split[1]["add_prefix_space"]
        )
        self.memo: dict[str, int] = {"": 0}

    @staticmethod
    def _steps(conf: dict | None, inner: str) -> list[dict]:
        return [] if conf is None else conf[inner] if conf["type"] == "Sequence" else [conf]

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; each different word of a local vocabulary is encoded once."""
        if not self.local:
            return self.lengths(texts)
        split = [t.translate(BLANKS).split(" ") for t in texts]
        new = list({w for words in split for w in words}.difference(self.memo))
        self.memo.update(zip(new, self.lengths(new), strict=True))
        out = [sum(map(self.memo.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > MOST_WORD:
                del self.memo[w]
        if len(self.memo) > REMEMBERED:
            self.memo = {"": 0}
        return out

    def words(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """The tokens of text, the settled places where words begin, and the tokens before each."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        if not len(e):
            return 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        spans, ids = np.array(e.offsets, np.int64), np.array(e.ids, np.int64)
        word, own = np.array(e.word_ids, float), np.isin(ids, self.special)
        # The first token of a window is no place: whether it begins a word is for the window before to say.
        begins = ((word[1:] != word[:-1]) | own[1:] | own[:-1]) & (spans[:-1, 1] <= spans[1:, 0])
        at = np.flatnonzero(begins) + 1
        first = np.array([0]) if spans[0, 0] == 0 else np.zeros(0, np.int64)
        at = np.concatenate([first, at])
        at = at[[settled(text[i]) for i in spans[at, 0].tolist()]] if len(at) else at
        return len(e), spans[at, 0], at


def encoder(name: str) -> Encoder:
    """A worker keeps its encoders between tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(("encoder", name), lambda: Encoder(vocabulary_file(name)))


def _windows(text: str, chunk: int, overlap: int) -> list[str]:
    """The text's windows; the last has no overlap, and no chunk but the first is shorter than an overlap needs."""
    n = max(1, -(-len(text) // chunk))
    return [text[i * chunk : (i + 1) * chunk + (overlap if i + 1 < n else 0)] for i in range(n)]


def _first_pass(rows: DataFrame, vocabulary: str, chunk: int, overlap: int) -> DataFrame:
    """row, id and n_bytes with the tokens of a text that needs no cutting; else its windows, of which the first has n_bytes."""
    kinds = {"n_bytes": pa.int64(), "tokens": pa.int64(), "chunk": pa.int64(), "last": pa.bool_(), "window": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for part, texts in sliced(batch):
                short = [i for i, t in enumerate(texts) if len(t) <= chunk or not enc.local]
                counts = dict(zip(short, enc.counts([texts[i] for i in short]), strict=True))
                sizes = part.column("n_bytes").to_pylist()
                at, out = [], []
                for i, t in enumerate(texts):
                    parts = [None] if i in counts else _windows(t, chunk, overlap)
                    for k, w in enumerate(parts):
                        at.append(i)
                        out.append((sizes[i] if not k else None, counts.get(i), *((None, None) if w is None else (k, k + 1 == len(parts))), w))
                keys = [part.column(c).take(pa.array(at, pa.int64())) for c in ("row", "id")]
                yield pa.RecordBatch.from_arrays([*keys, *_columns(out, kinds)], names=["row", "id", *kinds])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, id {kind}, n_bytes long, tokens long, chunk long, last boolean, window string")


def sliced(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in slices of about SLICE code points, each with its texts."""
    texts: list[str] = []
    size = 0
    for i, value in enumerate(batch.column("text")):
        texts.append(value.as_py())
        size += len(texts[-1])
        if size > SLICE or i + 1 == batch.num_rows:
            yield batch.slice(i + 1 - len(texts), len(texts)), texts
            texts, size = [], 0


def _columns(rows: list[tuple], kinds: dict[str, pa.DataType]) -> list[pa.Array]:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return [pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)]


PLACES = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
ENCODED = {"row": pa.int64(), "chunk": pa.int64(), "last": pa.bool_(), "tokens": pa.int64(), "head": PLACES, "tail": PLACES}


def _encode(windows: DataFrame, vocabulary: str, chunk: int, overlap: int) -> DataFrame:
    """row, chunk, last, tokens, and the places shared with the windows before (head) and after (tail), counted from the overlap's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for r in batch.to_pylist():
                n, at, before = enc.words(r["window"])
                head = at <= overlap - enc.guard if r["chunk"] else np.zeros(len(at), bool)
                tail = (at >= chunk) & (at <= chunk + overlap - enc.guard) & (not r["last"])
                places = lambda keep, start: [{"at": a - start, "before": b} for a, b in zip(at[keep].tolist(), before[keep].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(_columns([(r["row"], r["chunk"], r["last"], n, places(head, 0), places(tail, chunk))], ENCODED), names=list(ENCODED))

    kind = "array<struct<at:long,before:long>>"
    return windows.repartition("row", "chunk").mapInArrow(run, f"row long, chunk long, last boolean, tokens long, head {kind}, tail {kind}")


def _splice(encoded: DataFrame) -> DataFrame:
    """row, chunk, tokens: what each window adds up to its splice with the next; null where they share no place.

    Summed over a document: the tokens of the windows before each splice, less those of
    the next window before the same place, and all of the last window.
    """
    left = encoded.where("not last").select("row", "chunk", "tail")
    right = encoded.where("chunk > 0").select("row", (F.col("chunk") - 1).alias("chunk"), "head")
    both = left.join(right, ["row", "chunk"])
    place = F.array_min(F.array_intersect("tail.at", "head.at"))
    before = lambda side: F.element_at(F.map_from_entries(side), place)
    pairs = both.select("row", "chunk", (before("tail") - before("head")).alias("tokens"))
    return pairs.unionByName(encoded.where("last").select("row", "chunk", "tokens"))


def _merged(windows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Windows of twice the chunk: chunks 2j and 2j + 1, and the first `overlap` (at most chunk) code points of what follows."""
    core = F.substring("window", 1, chunk)
    last, j = F.col("last"), F.floor(F.col("chunk") / 2).cast("long")
    own = windows.select("row", j.alias("to"), F.col("chunk").alias("place"), "last", core.alias("piece"))
    after = windows.where("chunk > 0 and chunk % 2 = 0").select("row", (j - 1).alias("to"), F.col("chunk").alias("place"), F.lit(False).alias("last"), F.substring("window", 1, overlap).alias("piece"))
    # Three pieces at most a group.
    groups = own.unionByName(after).groupBy("row", "to").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("p"), F.bool_or(last).alias("last"))
    return groups.select("row", F.col("to").alias("chunk"), "last", F.array_join("p.piece", "").alias("window"))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", key: str = "doc_id", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """A row for each document: key, n_bytes (UTF-8) and n_tokens of its whole text."""
    if not 64 <= overlap <= chunk:
        raise ValueError("an overlap has 64 code points at least, and no more than a chunk")
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # Numbered in the pass that is written, so that a row's number is as stable as the table.
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "n_bytes": F.octet_length("text").cast("long")})
    first = materialise(_first_pass(rows, vocabulary, chunk, overlap), "tokens")
    names = (F.col("id").alias(key), "n_bytes", F.col("tokens").alias("n_tokens"))
    out = first.where("chunk is null").select(*names)
    windows = first.where("chunk is not null").select("row", "chunk", "last", "window")
    ids = first.where("chunk = 0").select("row", "id", "n_bytes")
    more = not windows.isEmpty()
    while more:
        encoded = materialise(_encode(windows, vocabulary, chunk, overlap), "encoded")
        sums = _splice(encoded).groupBy("row").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens").isNull()).alias("apart"))
        out = out.unionByName(ids.join(sums.where("apart = 0"), "row").select(*names))
        open_rows = sums.where("apart > 0").select("row")
        more = not open_rows.isEmpty()
        if more:
            wider = min(4 * overlap, chunk)
            windows = materialise(_merged(windows.join(open_rows, "row", "left_semi"), chunk, wider), "windows")
            chunk, overlap = 2 * chunk, wider
    return out


def digest(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """What query op11 returns."""
    return count_tokens(docs, vocabulary).withColumn("over_limit", F.col("n_tokens") > limit)

