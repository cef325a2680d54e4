"""Secret scans: trigram postings choose the documents that a rule's regex must look at.

Each rule's regex is parsed on the driver into a Boolean trigram query: an AND of
groups, each an OR of alternatives, each an AND of trigrams that any match must
contain (letters folded to lower case, so the query may only be too wide). The
rows are numbered by a 64-bit hash of doc_id and text and dealt into blocks of about
BLOCK_ROWS; the inverted index holds, for each trigram and block, the sorted row
numbers of the texts that contain it. A block's postings are intersected and united
as each rule's query says, which gives (row number, rules) candidates; a text meets
the regexes of its candidate rules alone. Numbers that collide only make a candidate
more, as the regex decides. A rule without mandatory trigrams scans all texts.

Candidates are broadcast if there are at most BROADCAST_ROWS of them (16 bytes each),
else joined by row number, which moves the texts.

Spans are code points, end exclusive, leftmost and not overlapping within a rule.
Their places are running sums of the lengths of the matches and of the pieces
between them, worked out in chunks of the square root of their number.

Nulls and edge cases: a null text is empty and has no spans; equal rows each get
their row; a null doc_id stays; extra columns are ignored; an empty table gives
no rows; long texts are scanned whole.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialise

#: More alternatives than this end a run of exact strings.
MOST_ALTERNATIVES = 64
#: Rows of a block of the index, about; candidates that are broadcast at most.
BLOCK_ROWS, BROADCAST_ROWS = 1 << 16, 1_000_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret. least: how many characters `group` must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base kinds, in order, then the kinds that this scan adds.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # runs are maximal, so this is AKIA[A-Z0-9]+ of 20 or more
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_host", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

Group = frozenset[frozenset[str]]


def _strings(node) -> set[str] | None:
    """All strings that a parsed piece can match, in lower case, if they are few."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                out.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < MOST_ALTERNATIVES:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 3:
        inner = _sequence(arg[2])
        return None if inner is None else {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(inner, repeat=n)}
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > MOST_ALTERNATIVES:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(pattern: str) -> list[Group]:
    """An AND of ORs of ANDs of trigrams that every match has; [] if none is mandatory."""
    query: list[Group] = []

    def close(strings: set[str]) -> None:
        if strings and min(map(len, strings)) >= 3:
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            query.append(frozenset(a for a in sets if not any(b < a for b in sets)))  # A or (A and B) is A

    def walk(nodes) -> None:
        held = {""}
        for node in nodes:
            more = _strings(node)
            if more is not None and len(held) * len(more) <= MOST_ALTERNATIVES:
                held = {a + b for a in held for b in more}
                continue
            close(held)
            held = more if more is not None else {""}
            if more is None and node[0] is sre.SUBPATTERN:
                walk(node[1][3])
            elif more is None and node[0] in (sre.MAX_REPEAT, sre.MIN_REPEAT) and node[1][0] >= 1:
                walk(node[1][2])
        close(held)

    walk(parser.parse(pattern))
    return query


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and the row's number."""
    slim = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slim.withColumn("row", F.xxhash64("doc_id", "text"))


def index(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The inverted index over the rules' trigrams: block, trigram and rows, a sorted array of row numbers."""
    trigrams = sorted({t for r in rules for g in trigram_query(r.pattern) for a in g for t in a})
    blocks = -(-docs.count() // block_rows) or 1
    lowered = _numbered(docs).select("row", lower_ascii(F.col("text")).alias("lowered"))
    held = F.array_compact(F.array(*[F.when(F.contains("lowered", F.lit(t)), F.lit(t)) for t in trigrams])) if trigrams else F.array().cast("array<string>")
    each = lowered.select("row", F.pmod("row", F.lit(blocks)).alias("block"), F.explode(held).alias("trigram"))
    return each.groupBy("block", "trigram").agg(F.sort_array(F.collect_set("row")).alias("rows"))


def _rows_of(query: list[Group]) -> Column:
    """The rows of a block for which the query holds, from its postings by trigram."""
    none = F.array().cast("array<bigint>")
    posting = lambda t: F.coalesce(F.try_element_at("postings", F.lit(t)), none)
    ands = lambda lists: reduce(F.array_intersect, lists)
    return ands([reduce(F.array_union, [ands([posting(t) for t in sorted(a)]) for a in sorted(group, key=sorted)]) for group in query])


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """row and found, whose bit i says that the row is a candidate of rule i, for the rules with mandatory trigrams."""
    by_block = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("postings"))
    each = [F.struct(F.lit(1 << i).cast("long").alias("bit"), _rows_of(q).alias("rows")) for i, q in enumerate(trigram_query(r.pattern) for r in rules) if q]
    if not each:
        each = [F.struct(F.lit(0).cast("long").alias("bit"), F.array().cast("array<bigint>").alias("rows"))]
    found = by_block.select(F.explode(F.array(*each)).alias("rule")).select("rule.bit", F.explode("rule.rows").alias("row"))
    return found.groupBy("row").agg(F.bit_or("bit").alias("found"))


def _running(sizes: Column) -> Column:
    """The running sums of an array, each with its own element."""
    n = F.size(sizes)
    chunk = F.ceil(F.sqrt(n)).cast("int")

    def sums(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")), lambda acc: acc["out"])

    def placed(inner: Column) -> Column:
        ends = sums(F.transform(inner, lambda x: F.element_at(x, -1)))
        return F.flatten(F.zip_with(inner, ends, lambda x, end: F.transform(x, lambda v: v + end - F.element_at(x, -1))))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), lambda c: sums(F.slice(sizes, c * chunk + 1, chunk)))
    # An array of one element binds the chunks' sums, which are used twice.
    return F.when(n > 0, F.flatten(F.transform(F.array(chunks), placed))).otherwise(F.array().cast("array<int>"))


def _measured(text: Column, rule: Rule) -> Column:
    """An array of (gap, len, ok) for the rule's matches: the length of the piece before, of the match, and if it counts."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    wanted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.least else matches
    both = F.zip_with(matches, wanted, lambda m, w: F.struct(F.length(m).alias("len"), (F.length(w) >= rule.least).alias("ok")))
    pieces = F.slice(F.split(text, rule.pattern, -1), 1, F.size(matches))
    return F.zip_with(both, pieces, lambda m, p: F.struct(F.length(p).alias("gap"), m["len"].alias("len"), m["ok"].alias("ok")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, block_rows: int = BLOCK_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id and spans, an array of (start, order, end, kind) sorted so, a row for each row of docs."""
    known = materialise(candidates(index(docs, rules, block_rows), rules), "secret-candidates").withColumnRenamed("row", "known")
    small = known.limit(broadcast_rows + 1).count() <= broadcast_rows
    rows = _numbered(docs)
    rows = rows.join(F.broadcast(known) if small else known, rows["row"] == known["known"], "left")
    # A candidate meets the regex once as a test; places are worked out only where it matches.
    for i, rule in enumerate(rules):
        given = F.lit(True) if not trigram_query(rule.pattern) else F.coalesce(F.col("found").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(False))
        rows = rows.withColumn(f"match_{i}", given & F.col("text").rlike(rule.pattern))
    rows = rows.select("doc_id", *[F.when(F.col(f"match_{i}"), _measured(F.col("text"), rule)).alias(f"measured_{i}") for i, rule in enumerate(rules)])
    ends = [_running(F.transform(f"measured_{i}", lambda m: m["gap"] + m["len"])).alias(f"ends_{i}") for i in range(len(rules))]
    rows = rows.select("*", *ends)

    def placed(i: int, kind: str) -> Column:
        places = F.zip_with(f"measured_{i}", f"ends_{i}", lambda m, end: F.struct((end - m["len"]).alias("start"), F.lit(i).alias("order"), end.alias("end"), F.lit(kind).alias("kind"), m["ok"].alias("ok")))
        kept = F.transform(F.filter(places, lambda s: s["ok"]), lambda s: F.struct(*[s[x].alias(x) for x in ("start", "order", "end", "kind")]))
        return F.coalesce(kept, F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>"))

    spans = [placed(i, rule.kind) for i, rule in enumerate(rules)]
    return rows.select("doc_id", F.array_sort(F.flatten(F.array(*spans))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The counts, hash and span list that query op7 returns."""
    found = scan(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["order"] < len(BASE_RULES))
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
