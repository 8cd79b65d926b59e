"""Secret scans: a trigram inverted index narrows the documents of each rule, and only those are verified. Native columns only.

Each rule's regular expression is turned into a Boolean query of trigrams, some of which any match must hold. The index has a posting
(gram, doc_id) for each trigram of the queries and each document that holds it. A rule whose expression forces no trigram scans all.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .common import documents, materialize, small, text_or_empty

#: Strings that a part of an expression may stand for before it counts as anything, and trigrams kept of each.
STRINGS, GRAMS = 64, 3


@dataclass(frozen=True)
class Rule:
    """A match counts if its group has at least ``least`` characters. base: one of the contract's kinds."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", 0, 16, True),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


class _Shape:
    """Reads a regular expression. An element becomes the set of strings, in lower case, that it may stand for; None if they are too many."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def more(self, text: str = "") -> bool:
        return self.at < len(self.pattern) if not text else self.pattern.startswith(text, self.at)

    def take(self, n: int = 1) -> str:
        self.at += n
        return self.pattern[self.at - n : self.at]

    def upto(self, mark: str) -> str:
        end = self.pattern.index(mark, self.at)
        return self.take(end + len(mark) - self.at)[: -len(mark)]

    def branches(self) -> list[list[set[str] | None]]:
        out = [self.sequence()]
        while self.more("|"):
            self.take()
            out.append(self.sequence())
        return out

    def sequence(self) -> list[set[str] | None]:
        out = []
        while self.more() and not self.more("|") and not self.more(")"):
            out.append(self.repeated(self.element()))
        return out

    def repeated(self, one: set[str] | None) -> set[str] | None:
        low, high = 1, 1
        if self.more("*") or self.more("+") or self.more("?"):
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[self.take()]
        elif self.more("{"):
            self.take()
            first, _, last = (bounds := self.upto("}")).partition(",")
            low, high = int(first), (int(last) if last else None) if "," in bounds else int(first)
        else:
            return one
        if self.more("?") or self.more("+"):
            self.take()
        if one is None or high is None or high > 4 or len(one) ** high > STRINGS:
            return None
        return {"".join(x) for n in range(low, high + 1) for x in itertools.product(one, repeat=n)}

    def element(self) -> set[str] | None:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.set()
        if c == "\\":
            return self.escape()
        return None if c == "." else {""} if c in "^$" else _one(c)

    def group(self) -> set[str] | None:
        look = False
        if self.more("?"):
            self.take()
            if self.more("P<") or (self.more("<") and not self.more("<=") and not self.more("<!")):
                self.upto(">")
            else:
                look = self.more("=") or self.more("!") or self.more("<")
                while not self.more(":") and not self.more(")") and not self.more(">") and not look:
                    self.take()
                if self.more("<"):
                    self.take()
                if not self.more(")"):
                    self.take()
        found = [joined_strings(x) for x in self.branches()]
        self.take()
        return {""} if look else None if any(x is None for x in found) else set().union(*found)

    def set(self) -> set[str] | None:
        out: set[str] | None = set()
        if self.more("^"):
            out = None
            self.take()
        first = True
        while first or not self.more("]"):
            first = False
            if self.more("[") or self.more("&&"):
                raise ValueError("nested sets aren't read")
            low = self.escape() if self.take() == "\\" else _one(self.pattern[self.at - 1])
            if self.more("-") and not self.more("-]"):
                self.take()
                high = self.escape() if self.take() == "\\" else _one(self.pattern[self.at - 1])
                a, b = (ord(next(iter(x))) if x else 0 for x in (low, high))
                low = {chr(i) for i in range(a, b + 1)} if low and high and b - a < 8 else None
            out = None if out is None or low is None else out | low
        self.take()
        return out if out and len(out) <= 8 else None

    def escape(self) -> set[str] | None:
        c = self.take()
        if c == "x":
            return _one(chr(int(self.take(2), 16)))
        if c == "u":
            return _one(chr(int(self.take(4), 16)))
        if c == "Q":
            return {self.upto("\\E").lower()}
        if c in "pP":
            self.upto("}") if self.more("{") else self.take()
            return None
        if c in "bBAzZG":
            return {""}
        return _one({"n": "\n", "t": "\t", "r": "\r", "f": "\f"}[c]) if c in "ntrf" else None if c.isalnum() else _one(c)


def _one(c: str) -> set[str] | None:
    """A character in lower case, as the index holds it; other letters than ASCII's may have several forms."""
    return {c.lower()} if c.isascii() else None


def joined_strings(items: list[set[str] | None]) -> set[str] | None:
    out = {""}
    for more in items:
        if more is None or len(out) * len(more) > STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that all hold for a text with a match; a clause holds if the (lower-case) text has all trigrams of one of its sets.

    No clause: the expression forces no trigram.
    """
    runs: list[set[str]] = [{""}]
    found = _Shape(pattern).branches()
    both = [joined_strings(x) for x in found]
    for more in found[0] if len(found) == 1 else [None if None in both else set().union(*both)]:
        if more is None:
            runs.append({""})
        elif len(runs[-1]) * len(more) <= STRINGS:
            runs[-1] = {a + b for a in runs[-1] for b in more}
        else:
            runs.append(more)
    clauses = []
    for run in runs:
        if all(len(s) >= 3 for s in run):
            least = {s for s in run if not any(t != s and t in s for t in run)}
            sets = {frozenset(s[i : i + 3] for i in _spread(len(s) - 2)) for s in least}
            clauses.append(sorted(sets, key=sorted))
    return clauses


def _spread(n: int) -> list[int]:
    """Up to GRAMS of the first n numbers, from first to last."""
    return sorted({i * (n - 1) // max(1, min(n, GRAMS) - 1) for i in range(min(n, GRAMS))})


def build_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (gram, doc_id) of the given trigrams, written to the shared folder. Rows with a null doc_id have none."""
    low = docs.filter("doc_id IS NOT NULL").select("doc_id", F.lower(text_or_empty()).alias("low"))
    held = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("low"), g))
    return materialize(low.select(F.explode(held).alias("gram"), "doc_id"), "secret-index")


def candidates(index: DataFrame, queries: dict[int, list[list[frozenset[str]]]], grams: list[str]) -> DataFrame:
    """doc_id, rules (the rules whose queries hold) for the documents with any. Postings meet by doc_id in bit sets of 62 trigrams each."""
    at = {g: divmod(i, 62) for i, g in enumerate(grams)}
    place = lambda of: F.element_at(F.create_map(*[F.lit(x) for g in grams for x in (g, of(*at[g]))]), F.col("gram"))
    posted = index.select("doc_id", place(lambda word, _: word).alias("word"), place(lambda _, bit: 1 << bit).cast("bigint").alias("bit"))
    words = [f"held{w}" for w in range(-(-len(grams) // 62))]
    held = posted.groupBy("doc_id").agg(*[F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("bigint"))).alias(name) for w, name in enumerate(words)])

    def holds(query: list[list[frozenset[str]]]) -> Column:
        every = F.lit(True)
        for clause in query:
            some = F.lit(False)
            for one in clause:
                masks: dict[int, int] = {}
                for g in one:
                    masks[at[g][0]] = masks.get(at[g][0], 0) | 1 << at[g][1]
                all_ = F.lit(True)
                for w, mask in masks.items():
                    all_ = all_ & (F.col(words[w]).bitwiseAND(F.lit(mask).cast("bigint")) == mask)
                some = some | all_
            every = every & some
        return every

    rules = F.array_compact(F.array(*[F.when(holds(query), i) for i, query in queries.items()]))
    return held.select("doc_id", rules.alias("rules")).filter(F.size("rules") > 0)


SPANS = "array<struct<start:int,rule:int,kind:string,end:int,value:string>>"


def _verified(i: int, r: Rule) -> Column:
    kept = F.filter(spans.matches(F.col("text"), r.pattern, r.group), lambda s: F.length(s["part"]) >= r.least)
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rule"), F.lit(r.kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans for each row of docs (doc_id, text; other columns are ignored).

    spans: array<struct<start, rule, kind, end, value>> by start, then rule. A null text counts as empty and, like any without
    hits, has an empty array. A row with a null doc_id isn't in the index and is scanned by all rules; rows that repeat a doc_id
    are candidates together and verified each for itself.
    """
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for clause in q for one in clause for g in one})
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    some = F.array(*[F.lit(i) for i in queries]).cast("array<int>")
    if queries:
        found = materialize(candidates(build_index(docs, grams), queries, grams), "secret-candidates")
        rows = rows.join(small(found, 32 + 4 * len(queries)), "doc_id", "left").withColumn("rules", F.when(F.col("doc_id").isNull(), some).otherwise(F.col("rules")))
    else:
        rows = rows.withColumn("rules", some)
    rows = rows.select("doc_id", "text", F.coalesce("rules", F.array().cast("array<int>")).alias("rules"))
    kinds = []
    for i, r in enumerate(rules):
        scan = F.array_contains("rules", i) if i in queries else F.lit(True)
        kinds.append(F.when(scan & F.col("text").rlike(r.pattern), _verified(i, r)).otherwise(F.array().cast(SPANS)))
    return rows.select("doc_id", F.array_sort(F.concat(*kinds)).alias("spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: secrets in all documents."""
    found = find_secrets(documents(spark, sf_dir))
    base = [r.kind for r in RULES if r.base]
    counts = [F.size(spans.of_kind(F.col("spans"), k)).cast("bigint").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(spans.joined(spans.of_kind(F.col("spans"), *base)).cast("binary"), 256).alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"))


#: The rules' expressions as DuckDB's engine reads them: hexadecimal runs are whole without a look behind, as a match takes all of one.
_SQL_PATTERNS = {r.kind: r.pattern.replace("(?<![0-9a-f])", "").replace("'", "''") for r in RULES}
_SQL_HITS = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS rule, '{r.kind}' AS kind, unnest(v) AS v, unnest(p) AS p, unnest(g[: len(v)]) AS g, generate_subscripts(v, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{_SQL_PATTERNS[r.kind]}') AS v, regexp_extract_all(t, '{_SQL_PATTERNS[r.kind]}', {r.group}) AS p, regexp_split_to_array(t, '{_SQL_PATTERNS[r.kind]}') AS g FROM texts)"
    for i, r in enumerate(RULES)
)
_SQL_KEPT = " OR ".join(f"(rule = {i} AND length(p) >= {r.least})" for i, r in enumerate(RULES))
_SQL_BASE = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
#: DuckDB runs every rule over every text; a match starts after the gaps and matches before it.
OP8_SQL = f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({_SQL_HITS}),
placed AS (SELECT *, (sum(length(g)) OVER w + sum(length(v)) OVER w - length(v))::BIGINT AS start FROM hits WINDOW w AS (PARTITION BY doc_id, rule ORDER BY i)),
shown AS (SELECT *, kind || ':' || start || ':' || (start + length(v)) AS span FROM placed WHERE {_SQL_KEPT}),
found AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)}, string_agg(span, ',' ORDER BY start, rule) FILTER (WHERE kind IN ({_SQL_BASE})) AS base, string_agg(span, ',' ORDER BY start, rule) AS spans FROM shown GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in RULES if r.base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts t LEFT JOIN found f USING (doc_id)"""
