"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Fixed values of the contract: kinds in their order, with the score before context.
BASE_KINDS = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.6}
#: Kinds that the method adds.
MORE_KINDS = {"iban": 0.7, "ssn": 0.4}
ORDER = {kind: i for i, kind in enumerate([*BASE_KINDS, *MORE_KINDS])}

#: Words that make a kind likelier, and words that make any number less likely to be personal.
FOR = {
    "email": ("mail", "contact", "write"),
    "ip": ("address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "mobile", "tel"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social security", "tax"),
}
AGAINST = ("version", "isbn", "invoice", "order no", "serial")
CONTEXT = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: The length of each country's numbers.
IBAN_LENGTHS = {
    code[:2]: int(code[2:])
    for code in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 "
        "GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 "
        "MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The same spans as searching local@domain from left to right, in linear time.

    A match has one @, so each @ is tried once, with the run of name letters
    before it that no earlier match has taken.
    """
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            taken = m.end()
        at = text.find("@", max(at + 1, taken))


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                yield "phone", *m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest end before a space, or of the match, at which length and checksum hold; else the search goes on inside the match."""
    at = 0
    while m := _IBAN.search(text, at):
        start, end = m.span()
        at = start + 4
        while end - start >= 12:
            iban = text[start:end].replace(" ", "")
            if len(iban) == IBAN_LENGTHS.get(iban[:2], max(12, len(iban))) and mod97(iban):
                yield start, end
                at = end
                break
            end = text.rfind(" ", start, end)


def _more(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _ibans(text):
        yield "iban", start, end
    for m in _SSN.finditer(text):
        yield "ssn", *m.span()


def find(text: str, least: float = 0.6) -> list[tuple[str, int, int, float]]:
    """Spans (kind, start, end in code points, score), by start and then kind.

    Base kinds always stay, whatever their score; added kinds need `least`.
    """
    found = []
    for kinds, spans in ((BASE_KINDS, _base(text)), (MORE_KINDS, _more(text))):
        for kind, start, end in spans:
            near = text[max(0, start - CONTEXT) : start].lower() + " " + text[end : end + CONTEXT].lower()
            score = kinds[kind] + 0.2 * any(w in near for w in FOR[kind]) - 0.2 * any(w in near for w in AGAINST)
            score = round(min(1.0, max(0.0, score)), 2)
            if kind in BASE_KINDS or score >= least:
                found.append((kind, start, end, score))
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def personal_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.6) -> DataFrame:
    """Per row of `df`: doc_id and spans, an array of (kind, start, end, score).

    Null text counts as empty and has no spans; repeated rows give repeated
    results; other columns are not returned. Work is linear in the text.
    """

    def rows(batch: list[dict]) -> list[dict]:
        return [{"doc_id": r["doc_id"], "spans": [dict(zip(("kind", "start", "end", "score"), s)) for s in find(r["text"] or "", least)]} for r in batch]

    arrow = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])
    return map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rows, f"doc_id long, spans {SPANS}", arrow)


def joined(spans: str | Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(kind: str, spans: str = "spans") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
