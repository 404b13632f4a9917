"""Operator 13: personal data by patterns, checksums and context words, with built-in functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: The patterns of the base kinds, in the order in which kinds are listed.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Lengths of bank account numbers (IBAN) by country.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24}
#: Patterns of the kinds that the method adds; a letter or digit may stand at neither side.
ADDED = {
    "iban": "(?:" + "|".join(rf"{c}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items()) + ")",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local_phone": r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}",
}
KINDS = [*BASE, *ADDED]
#: The same matches for the JVM's engine without its recursion and backtracking, which long runs exhaust: possessive, and begun only where a run does.
_SAME = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": BASE["phone"],
} | ADDED
#: What must stand in a text before its pattern is tried at all.
_NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Scores of a confirmed span, what a context word adds or a contrary word takes, and the least score of an added kind.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "local_phone": 0.3}
STEP, LEAST = 0.35, 0.5
#: Characters before and after a span that are searched for those words, which letters may not touch.
BEFORE, AFTER = 40, 20
WORDS = {
    "email": "e-?mail|mail|courriel|correo|contact|write to",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|cell|telefon|handy|téléphone|teléfono|llame|whatsapp",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|social sec|tax id|taxpayer",
    "local_phone": "phone|tel|call|fax|mobile|cell|telefon|handy|téléphone|teléfono|llame|whatsapp",
}
CONTRARY = {
    "email": "example|noreply",
    "ip": "version|section|chapter|release",
    "card": "order|invoice|isbn|tracking|serial|part",
    "phone": "order|invoice|isbn|tracking|serial|part",
    "iban": "example|sample",
    "ssn": "order|invoice|serial|part",
    "local_phone": "order|invoice|serial|part",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK = 64


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _before(lengths: Column) -> Column:
    """What stands before each of some lengths. Sums of blocks, then in blocks, so that many matches in a text don't cost their square."""

    def of(x):
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(x) - 1) / _BLOCK).cast("int")), lambda b: F.slice(x, b * _BLOCK + 1, _BLOCK))
        inside = lambda v, first: F.transform(v, lambda _, i: first + _sum(F.slice(v, F.lit(1), i)))
        firsts = lambda sums: F.transform(sums, lambda _, i: _sum(F.slice(sums, F.lit(1), i)))
        return _let(blocks, lambda b: _let(F.transform(b, _sum), lambda s: F.flatten(F.zip_with(b, firsts(s), inside))))

    return F.when(F.size(lengths) > 0, _let(lengths, of)).otherwise(F.array().cast("array<int>"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The checksum of card numbers: every second digit from the right doubled, sums of digits divisible by ten."""
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int"))
    return _sum(F.transform(F.split(F.reverse(digits), ""), value)) % 10 == 0


def _mod97(iban: Column) -> Column:
    """The checksum of bank accounts: the first four characters last, letters as 10 to 35, remainder 1 by 97."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    step = lambda a, c: F.when(c < "A", (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _confirmed(kind: str, x: Column) -> Column:
    """What a validator says of a proposed span: text, and the texts between it and the kind's others."""
    text = x["text"]
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return text.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return _let(F.when(F.length(text) <= 40, _digits(text)).otherwise(""), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(text)).between(9, 15)
    free = ~x["touched"] & ~x["before"].rlike("[A-Za-z0-9]$") & ~x["after"].rlike("^[A-Za-z0-9]")
    return free & _mod97(F.replace(text, F.lit(" "))) if kind == "iban" else free


def _score(kind: str, x: Column) -> Column:
    near = F.translate(F.concat_ws(" ", x["before"], x["after"]), _UPPER, _LOWER)
    says = lambda words: F.when(near.rlike(rf"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)"), STEP).otherwise(0.0)
    return F.round(F.lit(SCORES[kind]) + says(WORDS[kind]) - says(CONTRARY[kind]), 2)


def _spans(kind: str, found: Column, between: Column) -> Column:
    """Confirmed spans of a kind, from its matches and the texts between them."""
    count = F.size(found)
    steps = F.zip_with(found, F.slice(between, F.lit(1), count), lambda m, p: F.length(m) + F.length(p))

    def placed(before):
        def one(m, i):
            left, right = F.get(between, i), F.get(between, i + 1)
            start = F.get(before, i) + F.length(left)
            touched = ((left == "") & (i > 0)) | ((right == "") & (i < count - 1))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text"), F.substring(left, -BEFORE, BEFORE).alias("before"), F.substring(right, 1, AFTER).alias("after"), touched.alias("touched"))

        return F.transform(found, one)

    rank = F.lit(KINDS.index(kind))
    good = F.filter(_let(_before(steps), placed), lambda x: _confirmed(kind, x))
    return F.transform(good, lambda x: F.struct(x["start"].alias("start"), rank.alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["text"].alias("text"), _score(kind, x).alias("score")))


def find_pii(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = LEAST, always: tuple = tuple(BASE)) -> DataFrame:
    """Personal data in whole texts: one row per document with its spans in order.

    Patterns propose spans, leftmost and without overlap within a kind. Validators confirm them: parts of an address up to 255, the Luhn sum of
    12 to 19 digits of a card, 9 to 15 digits of a phone, the remainder by 97 of a bank account (iban), free ends of the added kinds. What fails
    is dropped, and nothing is tried again inside it. Each kind has a score, which a context word near the span raises and a
    contrary word lowers: kinds of ``always`` stay with any score, the others with ``least`` or more (ssn and local_phone need a context word).

    Places are code points from 0, ends exclusive. Kinds may overlap. Spans go by start, then by kind: email, ip, card, phone, iban, ssn,
    local_phone. A null or empty text has none. Rows repeat as they come, a null key stays null, other columns play no part, an
    empty table gives no rows. All is built-in functions on a row's own text: no shuffle, and time in proportion to the text.
    Returns key and spans: array of (start, rank, end, kind, text, score).
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.select(F.col(key), t.alias("_text"))
    # digits are needed by every kind but email
    has = {k: F.contains("_text", F.lit(_NEEDS[k])) if k in _NEEDS else F.lit(True) for k in KINDS}
    none = F.array().cast("array<string>")
    out = out.select(key, "_text", *[F.when(has[k], F.regexp_extract_all("_text", F.lit(_SAME[k]), F.lit(0))).otherwise(none).alias(f"_m_{k}") for k in KINDS])
    out = out.select(key, *[f"_m_{k}" for k in KINDS], *[F.when(F.size(f"_m_{k}") > 0, F.split("_text", _SAME[k], -1)).otherwise(none).alias(f"_p_{k}") for k in KINDS])
    spans = {k: _spans(k, F.col(f"_m_{k}"), F.col(f"_p_{k}")) for k in KINDS}
    spans = [s if k in always else F.filter(s, lambda x: x["score"] >= least) for k, s in spans.items()]
    return out.select(key, F.sort_array(F.concat(*spans)).alias("spans"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(C.table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    named = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def _sql() -> str:
    """Matches and the texts between them, numbered; places by running sums; validators and scores as SQL."""
    near = f"translate(left_text || ' ' || right_text, '{_UPPER}', '{_LOWER}')"
    says = lambda words: f"CASE WHEN regexp_matches({near}, '(?:^|[^a-z])(?:{words})(?:[^a-z]|$)') THEN {STEP} ELSE 0 END"
    free = "NOT touched AND NOT regexp_matches(left_text, '[A-Za-z0-9]$') AND NOT regexp_matches(right_text, '^[A-Za-z0-9]')"
    luhn = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse(d)[i]::INT ELSE reverse(d)[i]::INT * 2 % 10 + reverse(d)[i]::INT * 2 // 10 END)) % 10 = 0"
    values = "list_transform(string_split(substr(replace(x, ' ', ''), 5) || substr(x, 1, 4), ''), lambda c: CASE WHEN c < 'A' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
    good = {
        "email": "true", "ip": rf"regexp_matches(x, '^{_OCTET}(?:\.{_OCTET}){{3}}$')", "card": f"CASE WHEN length(d) BETWEEN 12 AND 19 THEN {luhn} ELSE false END", "phone": "length(d) BETWEEN 9 AND 15",
        "iban": f"{free} AND list_reduce({values}, lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1", "ssn": free, "local_phone": free,
    }
    kinds = " UNION ALL ".join(rf"""
  SELECT * FROM (SELECT r, '{k}' AS kind, {n} AS rank, x, d, start, start + length(x) AS end_, left_text, right_text, touched FROM (
    SELECT *, regexp_replace(x, '[^0-9]', '', 'g') AS d, right(p[i], {BEFORE}) AS left_text, left(p[i + 1], {AFTER}) AS right_text, (p[i] = '' AND i > 1) OR (p[i + 1] = '' AND i < length(m)) AS touched,
      (sum(length(p[i]) + length(x)) OVER (PARTITION BY r ORDER BY i) - length(x))::BIGINT AS start
    FROM (SELECT *, m[i] AS x FROM (SELECT r, m, p, unnest(range(1, length(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS p FROM docs)))
  )) WHERE {good[k]}{"" if k in BASE else f" AND round({SCORES[k]} + {says(WORDS[k])} - {says(CONTRARY[k])}, 2) >= {LEAST}"}""" for n, (k, pattern) in enumerate((BASE | ADDED).items()))
    name = "kind || ':' || start || ':' || end_"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), found AS ({kinds})
SELECT any_value(doc_id) AS doc_id, {counts}, sha256(coalesce(string_agg({name}, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg({name}, ',' ORDER BY start, rank) FILTER (rank IS NOT NULL), '') AS spans
FROM docs LEFT JOIN found USING (r) GROUP BY r
"""


ORACLE_SQL = _sql()
