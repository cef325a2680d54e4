"""Language identification by segmentation-marginalised unigrams.

A text is its runs of letters (Unicode's categories L), lower-cased. Over a fixed public vocabulary of
pieces each language has a probability for each piece. The probability of a word
is the sum over all its segmentations into pieces of the product of their
probabilities, by a forward pass over the word's positions; a text's log
probability is the sum over its words. The score is the posterior of the best
language, all being as likely beforehand.

Training: expectation-maximisation. The forward and backward passes give each
piece's expected count in a language's words; counts plus `smoothing` are the
next probabilities. The words come from a sample of about `train_rows` rows of
each language (whole texts), chosen by a hash of doc_id, so its bound is a
parameter. The vocabulary is read on the driver; pieces with their probabilities
(at most the vocabulary's size) go to the executors.

`accept` also rejects texts that fit no learned language: of all texts that may be
learned from, not only the sample, those told as the language they are labelled with
give the mean log probability a letter that all but MISFITS of them exceed, and a text
more than MARGIN below that of its best language goes. Each text is scored once.

Nulls and edge cases: null text and text without a letter are `und`, score 0; a
null lang is not learned from; with nothing to learn from every text is `und`,
score 0; a null doc_id is neither held out nor learned from; ties of languages go
to the first by name; repeated rows are scored alike; very long words are scored and learned from
whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popspark.operators import quantiles

from .common import fresh_name, materialise

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TRAIN_ROWS, ROUNDS, SMOOTHING, MOST_PIECE = 400, 4, 0.05, 12
#: Under this posterior a text counts as undecided: about as likely in three languages or more.
LEAST_SCORE = 0.3
#: A training text in so many fits worse than the bound that a language keeps, and a text may fit worse by so much (nats a letter).
MISFITS, MARGIN = 0.01, 2.5
#: Runs of letters and of numerals that are no digits; `count_words` takes the numerals out.
LETTERS = re.compile(r"[^\W\d_]+")
#: Words remembered by a worker; a word costs about 150 bytes.
REMEMBERED = 300_000


def read_vocabulary(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces made of letters alone, lower-cased, without word marks; single letters are added while training."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).replace("▁", "").lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in pieces if len(p) <= MOST_PIECE and LETTERS.fullmatch(p))


def count_words(text: str | None) -> Counter:
    """The words of a text, runs of letters in lower case, and how often each stands there."""
    out = Counter(LETTERS.findall(text.lower())) if text else Counter()
    for w in [w for w in out if not w.isalpha()]:
        n = out.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            out[part] += n
    return out


class Model:
    """Piece probabilities of each language: names, pieces, probs[piece, language]."""

    def __init__(self, names: list[str], pieces: list[str], probs: np.ndarray):
        self.names, self.pieces, self.probs = names, pieces, probs
        self._tables: dict[int, tuple[np.ndarray, np.ndarray]] | None = None
        self._rows: dict[str, int] = {}
        self._logs = np.zeros((0, len(names)), np.float32)

    def tables(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length: sorted pieces (as fixed-width text) and their rows in probs."""
        if self._tables is None:
            by: dict[int, list[int]] = {}
            for i, p in enumerate(self.pieces):
                by.setdefault(len(p), []).append(i)
            self._tables = {}
            for n, rows in by.items():
                words = _codes([self.pieces[i] for i in rows], n)
                keys = _fold(words)
                order = np.argsort(keys, kind="stable")
                self._tables[n] = (keys[order], np.array(rows)[order])
        return self._tables

    def matches(self, codes: np.ndarray, start: int, n: int) -> np.ndarray:
        """For each word (a row of codes) the piece in [start, start + n), or -1; single unknown letters are row len(pieces)."""
        out = np.full(len(codes), -1)
        if n in self.tables():
            keys, rows = self.tables()[n]
            want = _fold(codes[:, start : start + n])
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = keys[at] == want
            out[hit] = rows[at[hit]]
        if n == 1:
            out[out < 0] = len(self.pieces)
        return out

    def table(self) -> np.ndarray:
        """probs with a last row for a letter that is no piece."""
        return np.vstack([self.probs, np.full((1, len(self.names)), 1e-9)])

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, list]:
        """Log probability of each word by language, and the pieces found, for words of one length."""
        count, length = codes.shape
        probs = self.table()
        alpha = np.zeros((length + 1, count, len(self.names)))
        alpha[0] = 1.0
        scale = np.zeros((count, len(self.names)))
        found = []
        for end in range(1, length + 1):
            for n in range(1, min(MOST_PIECE, end) + 1):
                piece = self.matches(codes, end - n, n)
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    found.append((end - n, end, hit, piece[hit]))
                    alpha[end, hit] += alpha[end - n, hit] * probs[piece[hit]]
            if end % 16 == 0:  # keep very long words within a double's range
                lo = max(0, end - MOST_PIECE)
                top = alpha[lo : end + 1].max(axis=0)
                alpha[lo : end + 1] /= top
                scale += np.log(top)
        return np.log(alpha[length]) + scale, found

    def words(self, words: list[str]) -> np.ndarray:
        """Log probability of each distinct word by language."""
        out = np.empty((len(words), len(self.names)))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            step = max(1, 400_000 // (int(n) * len(self.names)))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                out[part] = self.forward(_codes([words[j] for j in part], int(n)))[0]
        return out

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None]]:
        """The best language, its score and its mean log probability a letter for each text."""
        counts = [count_words(t) for t in texts]
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
        rows = self._rows
        missing = list({w for c in counts for w in c if w not in rows})
        if len(rows) + len(missing) > REMEMBERED:
            rows.clear()
            self._logs = self._logs[:0]
            missing = list({w for c in counts for w in c})
        if missing:
            rows.update(zip(missing, range(len(rows), len(rows) + len(missing)), strict=True))
            self._logs = np.concatenate([self._logs, self.words(missing).astype(np.float32)])
        langs, scores, fits = [], [], []
        for c in counts:
            if not c:
                langs.append("und")
                scores.append(0.0)
                fits.append(None)
                continue
            n = np.fromiter(c.values(), np.float64, len(c))
            total = n @ self._logs[np.fromiter(map(rows.__getitem__, c), np.int64, len(c))]
            best = int(np.argmax(total))
            langs.append(self.names[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            fits.append(float(total[best]) / sum(len(w) * k for w, k in c.items()))
        return langs, scores, fits


def _codes(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)


def _fold(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row."""
    out = np.full(len(codes), 1469598103934665603, np.uint64)
    for i in range(codes.shape[1]):
        out = (out ^ codes[:, i]) * np.uint64(1099511628211)
        out ^= out >> np.uint64(29)
    return out


def fit(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> Model:
    """EM over each language's words and their counts."""
    names = sorted(counts)
    words = sorted({w for c in counts.values() for w in c})
    pieces = sorted({*pieces, *(ch for w in words for ch in w)})
    times = np.array([[counts[n].get(w, 0) for n in names] for w in words], np.float64).reshape(len(words), len(names))
    model = Model(names, pieces, np.full((len(pieces), len(names)), 1.0 / max(1, len(pieces))))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for _ in range(rounds if names else 0):
        expected = np.zeros((len(pieces) + 1, len(names)))
        probs = model.table()
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            step = max(1, 800_000 // int(n))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                _expect(model, probs, _codes([words[j] for j in part], int(n)), times[part], expected)
        counted = expected[:-1] + smoothing
        model.probs = counted / counted.sum(axis=0)
    return model


def _expect(model: Model, probs: np.ndarray, codes: np.ndarray, times: np.ndarray, expected: np.ndarray) -> None:
    """Add the words' expected piece counts: forward times backward over the whole, in logarithms, so that a word of any length counts."""
    found = model.forward(codes)[1]
    count, length = codes.shape
    ahead, back = np.zeros((length + 1, count, probs.shape[1])), np.zeros((length + 1, count, probs.shape[1]))
    by_end: dict[int, list] = {}
    by_start: dict[int, list] = {}
    for x in found:
        by_end.setdefault(x[1], []).append(x)
        by_start.setdefault(x[0], []).append(x)
    for end in range(1, length + 1):  # each letter is a piece, so the place before has been reached
        total = np.zeros((count, probs.shape[1]))
        for start, _, hit, piece in by_end[end]:
            total[hit] += np.exp(ahead[start, hit] - ahead[end - 1, hit]) * probs[piece]
        ahead[end] = ahead[end - 1] + np.log(total)
    for start in range(length - 1, -1, -1):
        total = np.zeros((count, probs.shape[1]))
        for _, end, hit, piece in by_start[start]:
            total[hit] += np.exp(back[end, hit] - back[start + 1, hit]) * probs[piece]
        back[start] = back[start + 1] + np.log(total)
    for start, end, hit, piece in found:
        share = np.exp(ahead[start, hit] + back[end, hit] - ahead[length, hit]) * probs[piece] * times[hit]
        if len(hit) < 1000:
            np.add.at(expected, piece, share)
            continue
        for lang in range(probs.shape[1]):
            expected[:, lang] += np.bincount(piece, share[:, lang], minlength=len(expected))


def _held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def _learnable() -> F.Column:
    return F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id"))


def _sample(docs: DataFrame, train_rows: int) -> tuple[DataFrame | None, list[str]]:
    """lang and text of about train_rows learnable rows of each language; the languages."""
    # Counting reads no text; rows without text only make the sample a little smaller.
    usable = docs.where(_learnable())
    per = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not per:
        return None, []
    spread = 1 << 30
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in per.items() for x in (k, min(spread, round(spread * train_rows / n)))]), F.col("lang"))
    sample = usable.where(F.col("text").isNotNull()).where(F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(spread)) < share)
    return sample.select("lang", F.col("text").cast("string").alias("text")), sorted(per)


def train(docs: DataFrame, vocabulary: str = VOCABULARY, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from about train_rows learnable rows of each language."""
    sample, names = _sample(docs, train_rows)
    if sample is None:
        return Model([], [], np.zeros((0, 0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = Counter()
            for lang, t in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                c.update({(lang, w): n for w, n in count_words(t).items()})
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in c], pa.string()), pa.array([k[1] for k in c], pa.string()), pa.array(c.values(), pa.int64())], names=["lang", "word", "n"])

    words = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[str, int]] = {k: {} for k in names}
    for lang, word, n in zip(*(words.column(i).to_pylist() for i in range(3)), strict=True):
        counts[lang][word] = n
    return fit({k: v for k, v in counts.items() if v}, read_vocabulary(vocabulary))


def least_fits(docs: DataFrame, model: Model) -> dict[str, float]:
    """For each language the fit that all but MISFITS of the learnable texts labelled and told as it exceed, less MARGIN."""
    slim = docs.where(_learnable()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    told = predict(slim, model, ("told", "told_score", "fit")).where("told = lang").select("lang", "fit")
    return _bounds(materialise(told, "langid-fits"))


def _bounds(fits: DataFrame) -> dict[str, float]:
    """From lang and fit of the texts that count; exact, in memory that doesn't grow with them."""
    return {r.lang: r.q[0] - MARGIN for r in quantiles.quantiles(fits, ["lang"], "fit", [MISFITS]).collect()}  # a row a language


def predict(docs: DataFrame, model: Model, names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """docs with columns for language and score, and a third for the mean log probability a letter if it is named."""
    shared = docs.sparkSession.sparkContext.broadcast({"parts": (model.names, model.pieces, model.probs)})
    kinds = [(pa.string(), T.StringType()), (pa.float64(), T.DoubleType()), (pa.float64(), T.DoubleType())][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value  # a worker keeps it between tasks, and with it the words it has scored
        m = held.setdefault("model", None) or Model(*held["parts"])
        held["model"] = m
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                found = m.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x, k) for x, (k, _) in zip(found, kinds, strict=False)]], names=[*part.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, (_, k) in zip(names, kinds, strict=True)]])
    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """What query op1 returns."""
    model = train(docs, vocabulary)
    out = predict(docs.select("doc_id", F.col("text").cast("string").alias("text"), _held_out(F.col("doc_id")).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def accept(docs: DataFrame, vocabulary: str = VOCABULARY, least: float = LEAST_SCORE) -> DataFrame:
    """docs without the rows whose language can't be told: `und`, a score under `least`, or a fit under that of its language's texts."""
    model = train(docs, vocabulary)
    names: list[str] = []
    for name in ("told", "told_score", "fit"):
        names.append(fresh_name(name, docs.columns + names))
    told, score, fits = map(F.col, names)
    # Written with its scores: the bounds need all of them before the first row can go.
    scored = materialise(predict(docs, model, tuple(names)), "langid-scored")
    bounds = _bounds(scored.where(_learnable() & (told == F.col("lang"))).select("lang", fits.alias("fit")))
    marked = scored.where((told != "und") & (score >= least))
    if bounds:
        bound = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(bounds.items()) for x in kv]), told)
        marked = marked.where(F.coalesce(fits >= bound, F.lit(True)))
    return marked.select(*[marked[f"`{c}`"] for c in docs.columns])
