"""Names of a table found in texts by one pass of an automaton, however many names there are."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A name may not follow one of these characters, nor stand before one of the others.
NOT_BEFORE_NAME = "-ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+#"
NOT_AFTER_NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+#"
#: Bytes of names that one automaton is built from and that are sent to the tasks; larger tables are dealt over several.
NAMES_BYTES = 8_000_000
SLICE = 256

#: Lower case of A-Z alone, so that no letter changes its place.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

HITS = "array<struct<start: int, end: int, term: string>>"
FOUND = "array<struct<start: int, name: string, text: string, n: int>>"
ARROW_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string())]))
ARROW_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("name", pa.string()), ("text", pa.string()), ("n", pa.int32())]))


class Names:
    """An automaton over names, each (term, alias, exact, not_after, not_before)."""

    def __init__(self, names: list[tuple]):
        of: dict[str, list[tuple]] = {}
        for name in names:
            of.setdefault(name[1].translate(LOWER), []).append(name)
        self.automaton = ahocorasick.Automaton()
        for alias, meant in of.items():
            self.automaton.add_word(alias, (len(alias), meant))
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, term) of all names in a text, overlapping ones too."""
        out = set()
        if not len(self.automaton):
            return []
        for last, (size, meant) in self.automaton.iter(text.translate(LOWER)):
            start, end = last + 1 - size, last + 1
            if (start and text[start - 1] in NOT_BEFORE_NAME) or (end < len(text) and text[end] in NOT_AFTER_NAME):
                continue
            before, after = text[max(0, start - 64) : start].translate(LOWER), text[end : end + 64].translate(LOWER)
            for term, alias, exact, not_after, not_before in meant:
                if exact and text[start:end] != alias:
                    continue
                if any(before.endswith(x) for x in not_after) or any(after.startswith(x) for x in not_before):
                    continue
                out.add((start, end, term))
        return sorted(out)


def unshadowed(hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Hits that don't lie within a longer one."""
    out, reach, before = [], -1, (-1, -1)
    for start, end, term in sorted(hits, key=lambda h: (h[0], -h[1], h[2])):
        if (start, end) == before or end > reach:
            out.append((start, end, term))
            before, reach = (start, end), max(reach, end)
    return out


def first_of_each(text: str, hits: list[tuple[int, int, str]]) -> list[dict]:
    """One entry for each term, by its first place (from 1), with how often it occurs."""
    out: dict[str, dict] = {}
    for start, end, term in hits:
        if term in out:
            out[term]["n"] += 1
        else:
            out[term] = {"start": start + 1, "name": term, "text": text[start:end], "n": 1}
    return sorted(out.values(), key=lambda t: (t["start"], t["name"]))


def as_names(aliases: DataFrame) -> DataFrame:
    """A table of names with all its columns: term, alias, exact (false), not_after, not_before (none). Null or empty names go, as do null terms."""
    columns = {
        "exact": F.coalesce(F.col("exact"), F.lit(False)) if "exact" in aliases.columns else F.lit(False),
        **{c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(x)) if c in aliases.columns else F.array().cast("array<string>") for c in ("not_after", "not_before")},
    }
    return aliases.where("term is not null and alias <> ''").select("term", "alias", *(v.alias(k) for k, v in columns.items())).distinct()


def find_names(docs: DataFrame, id_col: str, text_col: str, aliases: DataFrame, longest: bool = True, most: int = NAMES_BYTES) -> DataFrame:
    """For each row its id and `terms`: array of (start, name, text, n) of the terms it mentions, by first appearance.

    `aliases` has term and alias, and may have exact (upper and lower case
    differ; else A-Z and a-z are alike), not_after and not_before (texts that
    may not stand right before or after the name; 64 letters at most are looked
    at). A name may not touch a letter or digit, + or #, nor follow a hyphen.
    With `longest` a name within a longer one doesn't count; one that is the
    name of several terms counts for each. Null and empty texts have no terms.
    `id_col` names a row.

    Names up to `most` bytes go to the tasks as one automaton; more are dealt
    over several by hash, each of which reads the texts once.
    """
    spark = docs.sparkSession
    names = as_names(aliases)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(docs.dtypes)[id_col]
    total = names.agg(F.sum(F.octet_length("alias") + F.octet_length("term"))).first()[0] or 0
    parts = -(-total // most) or 1

    def read(part: int):
        some = names.where(F.pmod(F.xxhash64("alias"), F.lit(parts)) == part).collect()  # about `most` bytes
        return spark.sparkContext.broadcast([(r.term, r.alias, r.exact, r.not_after, r.not_before) for r in some])

    def passed(sent, whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Names(sent.value)
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    texts = [t or "" for t in part.column("text").to_pylist()]
                    found = [known.hits(t) for t in texts]
                    yield ended(part, texts, found) if whole else pa.RecordBatch.from_arrays([part.column("id"), pa.array([[dict(zip(("start", "end", "term"), h, strict=True)) for h in hits] for hits in found], ARROW_HITS)], names=["id", "hits"])

        return run

    def ended(part: pa.RecordBatch, texts: list[str], found: list[list[tuple]]) -> pa.RecordBatch:
        kept = [unshadowed(hits) if longest else hits for hits in found]
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array([first_of_each(t, h) for t, h in zip(texts, kept, strict=True)], ARROW_FOUND)], names=["id", "terms"])

    if parts == 1:
        return rows.mapInArrow(passed(read(0), True), f"id {kind}, terms {FOUND}").withColumnRenamed("id", id_col)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [sorted((h["start"], h["end"], h["term"]) for h in hits or []) for hits in part.column("hits").to_pylist()]
                yield ended(part, [t or "" for t in part.column("text").to_pylist()], found)

    hits = None
    for k in range(parts):
        more = rows.mapInArrow(passed(read(k), False), f"id {kind}, hits {HITS}").where("size(hits) > 0")
        hits = more if hits is None else hits.unionByName(more)
    all_hits = hits.groupBy("id").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    return rows.join(all_hits, "id", "left").select("id", "text", "hits").mapInArrow(joined, f"id {kind}, terms {FOUND}").withColumnRenamed("id", id_col)
