"""Secret scans: a keyword automaton, anchored patterns near its hits, then checksums.

One pass of an Aho-Corasick automaton over the text finds all keywords; each
pattern is tried only where one of its keywords stands. Runs of hex digits have
no keyword and are searched directly. A private key is its whole block, with line
ends as such or written as backslash and letter.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Fixed values of the contract, in its order.
BASE_KINDS = ("assign", "access", "hex")
#: Kinds that the method adds.
MORE_KINDS = ("github", "jwt", "key")
ORDER = {kind: i for i, kind in enumerate([*BASE_KINDS, *MORE_KINDS])}

#: Keywords in lower case, and the kind that each leads to.
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "eyj": "jwt",
    "-----begin ": "key",
}
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    "key": re.compile(
        r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----(?:"
        r"(?:[^-]++|-(?!----))*+-----END \1-----"  # up to the next row of dashes, if that is the END line
        r"|(?:(?:\s|\\[rn])*+(?:Proc-Type|DEK-Info):[^\n\\]*+)*+"  # END is missing: head lines and base64 lines, the last one shorter
        r"(?:(?:(?:\s|\\[rn])*+[A-Za-z0-9+/]{16,}+={0,2}+)++(?:(?:\r?\n|\\n)[ \t]*+[A-Za-z0-9+/]{1,15}+={0,2}+(?![^\s\\\"'`,]))?)?)"
    ),
}
#: Where a web token fails, so does one that starts later in the same run of its letters.
_RUN = re.compile("[A-Za-z0-9_-]*+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_LOWER = {c: c + 32 for c in range(65, 91)}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(body: str) -> str:
    """The six letters that close a token: the CRC-32 of its body in base 62."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out


def _holds(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 8
    if kind == "access":
        return len(m[0]) >= 16
    if kind == "github":
        return crc_base62(m[0][4:-6]) == m[0][-6:]
    if kind == "jwt":
        head = m[0].split(".")[0]
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        except (binascii.Error, ValueError, TypeError):
            return False
    return True


@cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def _spans(text: str) -> Iterator[tuple[str, int, int]]:
    low = text.lower() if text.isascii() else text.translate(_LOWER)  # as long as the text
    hits: dict[str, set[int]] = {}
    for last, (kind, length) in _automaton().iter(low):
        hits.setdefault(kind, set()).add(last - length + 1)
    for kind, starts in hits.items():
        taken = 0
        for start in sorted(starts):
            if start < taken:
                continue
            if m := PATTERNS[kind].match(text, start):
                taken = m.end()  # a match that fails its check still takes its place
                if _holds(kind, m):
                    yield kind, *m.span()
            elif kind == "jwt":
                taken = _RUN.match(text, start).end()
    for m in _HEX.finditer(text):
        yield "hex", *m.span()


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end in code points), by start and then kind."""
    return sorted(_spans(text), key=lambda s: (s[1], ORDER[s[0]]))


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `df`: doc_id and spans, an array of (kind, start, end).

    Null text counts as empty and has no spans; repeated rows give repeated
    results; other columns are not returned. Work is linear in the text.
    """

    def rows(batch: list[dict]) -> list[dict]:
        return [{"doc_id": r["doc_id"], "spans": [dict(zip(("kind", "start", "end"), s)) for s in find(r["text"] or "")]} for r in batch]

    arrow = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])
    return map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rows, "doc_id long, spans array<struct<kind:string,start:long,end:long>>", arrow)


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`df` with every secret in `text_col` replaced by `mark`; all rows and columns stay.

    Overlapping spans are replaced once, from the first start to the last end.
    Null texts stay null; texts without secrets are unchanged.
    """

    @F.pandas_udf("string")
    def clean(texts):
        def one(text):
            if not text:
                return text
            parts, at = [], 0
            for _, start, end in find(text):
                if start >= at:
                    parts += [text[at:start], mark]
                at = max(at, end)
            return "".join([*parts, text[at:]])

        return texts.map(one, na_action="ignore")

    return df.withColumn(text_col, clean(F.col(text_col)))
