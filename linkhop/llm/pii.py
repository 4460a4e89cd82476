"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds are email, ip, card (Luhn) and phone.  The method adds iban (mod 97), ssn, dates
of birth, account numbers and secrets (long runs of hexadecimal digits).  Words near a span raise its score, words that speak against
it (a version near an ip, a tracking number near a card) lower it.  A span of a base kind
always stays, its score says how sure it is; an added span stays from SCORE on, so ssn,
birth dates, accounts and secrets are only taken where the context speaks for them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from linkhop.llm.common import documents, prepare, tidy

KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "birth", "account", "secret"]
BASE = 4
#: The least score of an added span, and the characters around a span that are read for context.
SCORE, AROUND = 0.7, 48

#: An address's domain; what stands before the @ is read backwards, so that long words cost nothing.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match takes digit runs whole, so it may only begin where a run does.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_BIRTH = re.compile(r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[./](?:0?[1-9]|1[0-2])[./](?:19|20)[0-9]{2})(?![0-9./-])")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z.,+-])[0-9]{8,17}(?![0-9A-Za-z.,-])")
_SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])")
_DIGITS = re.compile(r"[0-9]")
#: Words near a span that raise its score.
CONTEXT = {
    "email": re.compile(r"mail|contact|@", re.I),
    "ip": re.compile(r"\bip\b|host|server|address", re.I),
    "card": re.compile(r"card|visa|credit|payment|account", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax", re.I),
    "iban": re.compile(r"iban|bank|account|transfer", re.I),
    "ssn": re.compile(r"\bssn\b|social security", re.I),
    "birth": re.compile(r"\bborn\b|birth|\bdob\b", re.I),
    "secret": re.compile(r"token|secret|passw|api.?key", re.I),
    "account": re.compile(r"\baccount (?:no|number|nr)\b|\bacct\b|routing number|sort code", re.I),
}
#: Words near a span that lower its score.
AGAINST = {
    "ip": re.compile(r"version|release|section|chapter", re.I),
    "card": re.compile(r"tracking|order|isbn|serial|invoice", re.I),
    "phone": re.compile(r"isbn|serial|version", re.I),
    "iban": re.compile(r"serial|licen[cs]e key|product key", re.I),
}
#: Scores without context; context adds RAISE and words against take LOWER away.
PLAIN = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "birth": 0.4, "account": 0.4, "secret": 0.4}
RAISE, LOWER = 0.35, 0.3

SPAN = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()),
]))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    past = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            past = m.end()
            yield start, past


def proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """The confirmed spans of each kind; start and end in code points."""
    for start, end in _emails(text):
        yield "email", start, end
    if not _DIGITS.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
            yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        if 15 <= len(bare := m[0].replace(" ", "")) <= 34 and mod97(bare):
            yield "iban", *m.span()
    for kind, pattern in (("ssn", _SSN), ("birth", _BIRTH), ("account", _ACCOUNT), ("secret", _SECRET)):
        for m in pattern.finditer(text):
            yield kind, *m.span()


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of a text by start, then kind."""
    out = []
    for kind, start, end in proposed(text or ""):
        near = f"{text[max(0, start - AROUND) : start]} {text[end : end + AROUND]}"
        against = kind in AGAINST and bool(AGAINST[kind].search(near))
        score = round(min(1.0, max(0.0, PLAIN[kind] + RAISE * bool(CONTEXT[kind].search(near)) - LOWER * against)), 2)
        if score >= SCORE or KINDS.index(kind) < BASE:
            out.append((kind, start, end, score))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def masked(text: str | None, found: list[tuple]) -> str | None:
    """The text with each run of overlapping spans replaced by the kind of its first, in brackets."""
    if text is None or not found:
        return text
    parts, past = [], 0
    for kind, start, end, _ in found:
        if start >= past:
            parts += [text[past:start], f"[{kind.upper()}]"]
        past = max(past, end)
    return "".join(parts) + text[past:]


def span_column(text: Column) -> Column:
    """All spans of each text, as an array of (kind, start, end, score)."""

    @F.pandas_udf(SPAN)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([spans(t) for t in rows], dtype=object)

    return find(text)


def masked_column(text: Column) -> Column:
    """Each text with its spans masked; a null stays null."""

    @F.pandas_udf(T.StringType())
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([masked(t, spans(t)) for t in rows], dtype=object)

    return mask(text)


def pii_spans(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """docs with the spans of each text as column spans_col, which replaces one of that name."""
    prepare(docs.sparkSession)
    docs = tidy(docs, text_col)
    return docs.withColumn(spans_col, span_column(docs[text_col]))


def pii_masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with masked texts; every row stays, also where another column's name differs from text_col in case only."""
    prepare(docs.sparkSession)
    own = tidy(docs, text_col)
    return own.select(*(masked_column(own[c]).alias(c) if n == text_col else own[c] for n, c in zip(docs.columns, own.columns, strict=True))).toDF(*docs.columns)


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores.

    Counts and base_sha256 are of the base kinds; spans lists all kinds, scores the score of each in the same order.  A null or empty
    text has none.  Null and repeated ids are kept, further columns left out.  One narrow
    pass without a shuffle; all patterns take linear time, also on very long texts.
    """
    found = pii_spans(documents(docs, id_col, text_col).toDF("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(KINDS[:BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:BASE]), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.transform("spans", lambda s: s["score"]).alias("scores"))
