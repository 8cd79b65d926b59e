"""Personal data: regular expressions propose spans, validators confirm them, words nearby adjust the score. Native columns only.

The patterns are those of the contract in forms that don't backtrack: quantifiers that nothing after them can need back are possessive,
and an address may start only where a run of its characters starts or the last match ended, as it would fail anywhere later in the
run for the same reason. So a text takes time in proportion to its length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .common import documents, fresh, text_or_empty

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"

BASE = ("email", "ip", "card", "phone")
#: Code points before and after a span that are searched for context words.
NEAR = 48


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of ten."""

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces has remainder 1: the first four characters go to the end, letters count from 10."""
    turned = F.split(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4)), "")
    digit = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + digit(c)) % 97) == 1


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small_parts(value: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return value.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _digit_count(value: Column, least: int, most: int) -> Column:
    return F.length(_digits(value)).between(least, most)


@dataclass(frozen=True)
class Kind:
    """hint: a cheap necessary condition; near: context words that raise the score from base to base + 0.2."""

    name: str
    pattern: str
    hint: str
    base: float
    near: str


KINDS = (
    Kind("email", EMAIL, "@", 0.8, "mail|contact|write|adresse|correo"),
    Kind("ip", IP, r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", 0.6, r"\bip\b|server|host|address|network"),
    Kind("card", CARD, r"[0-9](?:[\x20-]?[0-9]){12}", 0.7, "card|credit|visa|payment|carte|karte|tarjeta"),
    Kind("phone", PHONE, r"\+[0-9]", 0.6, r"call|phone|tel|mobile|fax|num"),
    Kind("iban", IBAN, r"[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{8}", 0.8, "iban|bank|account|konto|compte|cuenta"),
)


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return _small_parts(value)
    if kind == "card":
        return F.when(_digit_count(value, 13, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return _digit_count(value, 9, 15)
    if kind == "iban":
        compact = F.replace(value, F.lit(" "), F.lit(""))
        return F.when(F.length(compact).between(15, 34), mod97(compact)).otherwise(False)
    return F.lit(True)


SPANS = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def _scored(k: Kind, text: Column) -> Column:
    def span(s: Column) -> Column:
        around = F.lower(F.substring(text, F.greatest(s["start"] - NEAR + 1, F.lit(1)), s["end"] - s["start"] + 2 * NEAR))
        score = F.lit(k.base) + F.when(around.rlike(k.near), 0.2).otherwise(0.0)
        return F.struct(F.lit(k.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), score.alias("score"))

    return F.transform(F.filter(spans.matches(text, k.pattern), lambda s: _confirmed(k.name, s["value"])), span)


def _with_spans(docs: DataFrame, out: str) -> DataFrame:
    """docs with its spans as out."""
    names = fresh(docs.withColumn(out, F.lit(0)), *[f"_{k.name}" for k in KINDS])
    text = text_or_empty()
    rows = docs
    for k, name in zip(KINDS, names, strict=True):
        hint = F.contains(text, F.lit("@")) if k.hint == "@" else text.rlike(k.hint)
        rows = rows.withColumn(name, F.when(hint, _scored(k, text)).otherwise(F.array().cast(SPANS)))
    return rows.withColumn(out, F.concat(*names)).drop(*names)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, spans for each row of docs (doc_id, text; other columns are ignored).

    spans: array<struct<kind, start, end, value, score>>, by kind (email, ip, card, phone, iban), then start. A null text counts as
    empty and, like any text without hits, has an empty array; rows that repeat and null doc_ids are kept as they are.
    """
    return _with_spans(docs.select("doc_id", text_or_empty().alias("text")), "spans").select("doc_id", "spans")


def redact(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """docs with each span of at least that score replaced by its kind in angle brackets; spans inside others vanish with them.

    Each row for itself, whatever its doc_id; a null text stays null.
    """
    (found_,) = fresh(docs, "_spans")
    rows = _with_spans(docs, found_)
    order = F.array_sort(F.transform(F.filter(found_, lambda s: s["score"] >= least_score), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = text_or_empty()

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.when(inside, acc["at"]).otherwise(s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit("<"), s["kind"], F.lit(">"))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(order, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return rows.withColumn("text", F.when(F.size(found_) > 0, clean).otherwise(F.col("text"))).drop(found_)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: personal data in all documents."""
    found = find_pii(documents(spark, sf_dir))
    counts = [F.size(spans.of_kind(F.col("spans"), k)).cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(spans.joined(spans.of_kind(F.col("spans"), *BASE)).cast("binary"), 256).alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"))


#: The contract's expressions, and the IBAN's with word boundaries for looks around; DuckDB's engine knows neither possessive forms nor looks.
_SQL_PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"), ("iban", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b"),
)
_SQL_HITS = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS rule, '{kind}' AS kind, unnest(v) AS v, unnest(g[: len(v)]) AS g, generate_subscripts(v, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{shape}') AS v, regexp_split_to_array(t, '{shape}') AS g FROM texts)"
    for i, (kind, shape) in enumerate(_SQL_PATTERNS)
)
OP6_SQL = f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({_SQL_HITS}),
placed AS (SELECT *, (sum(length(g)) OVER w + sum(length(v)) OVER w - length(v))::BIGINT AS start, regexp_replace(v, '[^0-9]', '', 'g') AS d, replace(v, ' ', '') AS c FROM hits WINDOW w AS (PARTITION BY doc_id, rule ORDER BY i)),
read AS (SELECT *, array_to_string(list_transform(string_split(substr(c, 5) || substr(c, 1, 4), ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN x ELSE (ascii(x) - 55)::VARCHAR END), '') AS m FROM placed),
shown AS (SELECT *, kind || ':' || start || ':' || (start + length(v)) AS span FROM read WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(nullif(ltrim(x, '0'), '') AS BIGINT), 0) > 255)) = 0
  WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse(d), ''), lambda x, k: CASE WHEN k % 2 = 1 THEN x::INT WHEN x::INT > 4 THEN 2 * x::INT - 9 ELSE 2 * x::INT END)) % 10 = 0
  WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
  ELSE length(c) BETWEEN 15 AND 34 AND ((((substr(m, 1, 30)::HUGEINT % 97) || substr(m, 31, 30))::HUGEINT % 97) || substr(m, 61, 30))::HUGEINT % 97 = 1 END),
found AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)}, string_agg(span, ',' ORDER BY rule, start) FILTER (WHERE kind <> 'iban') AS base, string_agg(span, ',' ORDER BY rule, start) AS spans FROM shown GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts t LEFT JOIN found f USING (doc_id)"""
