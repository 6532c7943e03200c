"""Repeated passages, by sorting suffixes blockwise with ranks from a cover sample.

A text is a sequence of items: its bytes, or its words, of which each stands as
a 64-bit hash. The cover sample holds, of every window of the unit's length, the
place whose gram has the smallest hash. Like the places of a difference cover, it
gives two equal windows a common offset at which both are sampled; as it follows
the content, it takes one place in about 170 bytes and keeps equal windows
together. Where a text repeats itself at short distances, as padding does, equal
windows of it are written once. A block is what shares a sampled gram, and one block after another is
sorted: suffixes that start before the sampled place are ordered by the items up
to it, and ties among them by the precomputed rank of what follows it. Only
blocks whose members differ need their items. Blocks too large for one task are
decided by a hash of each window instead, which partial aggregation makes safe
for any skew.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, join_by_share, map_rows, read, text_bytes

LENGTH = 400
#: A passage of so many words, upper and lower case alike, is repeated if another document has it too.
PASSAGE_WORDS = 50


class Unit(NamedTuple):
    """Bytes to an item, items to a window, items to a gram (a power of 2)."""

    item: int
    length: int
    gram: int

    @property
    def reach(self) -> int:
        """A sampled place is at most so many items behind the start of its window."""
        return self.length - self.gram


#: The lowest bit of a gram's hash tells its unit.
UNITS = (Unit(1, LENGTH, 64), Unit(8, PASSAGE_WORDS, 8))
#: Items of a text that are hashed at a time; longer texts go in overlapping pieces.
PIECE = 1 << 19
#: Different members of a block that one task sorts at most.
BLOCK = 4096

_BITS = np.uint64(22)  # places in what is hashed at a time
_LOW = (np.uint64(1) << _BITS) - np.uint64(1)
_TABLE = np.random.Generator(np.random.PCG64(400)).integers(0, 2**64, 256, np.uint64, endpoint=False)
_M, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def items(text: bytes, unit: int) -> bytes:
    """The text itself, or the hashes of its words in lower case."""
    return b"".join(map(xxhash.xxh64_digest, text.lower().split())) if unit else text


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def sample(pieces: list[bytes], unit: int = 0) -> tuple[np.ndarray, ...]:
    """For each run of windows with one sampled place: piece, place, first and last start of the run, gram's hash.

    Places are counted in items from the start of the piece.
    """
    item, length, gram = UNITS[unit]
    buffer = np.frombuffer(b"".join(pieces), "<u8" if unit else np.uint8)
    if len(buffer) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    grams, width, factor = buffer if unit else _TABLE[buffer], 1, _M
    with np.errstate(over="ignore"):
        while width < gram:
            grams = grams[:-width] * factor + grams[width:]
            factor, width = factor * factor, width * 2
        grams ^= grams >> np.uint64(32)
        grams *= _MIX
    order = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    place = (_smallest(order, UNITS[unit].reach + 1) & _LOW).astype(np.int64)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // item
    begins = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - length + 1, 0)
    piece = np.repeat(np.arange(len(pieces)), windows)
    starts = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + begins[piece]
    at = place[starts]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])]) if len(at) else np.zeros(0, np.int64)
    last = np.r_[new[1:], len(at)] - 1
    piece, at = piece[new], at[new]
    marked = (grams[at] & ~np.uint64(1)) | np.uint64(unit)
    return piece, at - begins[piece], starts[new] - begins[piece], starts[last] - begins[piece], marked


def _pieces(data: bytes, unit: int = 0) -> Iterator[tuple[int, bytes]]:
    item, length, _ = UNITS[unit]
    for at in range(0, max(1, len(data) // item - length + 1), PIECE):
        yield at, data[at * item : (at + PIECE + length - 1) * item]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc and key tell a row from all others, apart from repeated rows."""
    data = text_bytes(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(data).alias("key"), data.alias("data"))


_RANGE = pa.struct([("a", pa.int32()), ("b", pa.int32())])
_PLACES = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("place", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("gram", pa.int64()), ("member", pa.int64()), ("more", pa.list_(_RANGE))])


def once_each(piece: np.ndarray, members: np.ndarray, low: np.ndarray, high: np.ndarray, unit: int) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Which places to keep, and for some of them the ranges of the equal ones that they stand for.

    In padding and other text of short period every window has a place of its
    own, but few differ. Two equal members in a text prove that bytes are
    repeated, so two are kept; of equal members of one window of words, whose
    verdict is one for all, the first is.
    """
    order = np.lexsort((np.arange(len(members)), members, piece))
    first = np.flatnonzero(np.r_[True, (members[order][1:] != members[order][:-1]) | (piece[order][1:] != piece[order][:-1])]) if len(order) else order
    keep, ranges, held = np.ones(len(members), bool), {}, 1 if unit else 2
    for at, n in zip(first.tolist(), np.diff(np.r_[first, len(order)]).tolist()):
        if n <= held or (unit and low[order[at]] < high[order[at]]):
            continue
        others = order[at + held : at + n]
        keep[others] = False
        a, b = low[others], high[others] + UNITS[unit].length
        new = np.r_[True, a[1:] > b[:-1]]
        ranges[int(order[at])] = a[new], b[np.r_[np.flatnonzero(new)[1:] - 1, len(b) - 1]]
    return keep, ranges


def cover_sample(keyed: DataFrame) -> DataFrame:
    """(doc, key, place, low, high, gram, member, more): the sampled places of all texts in both units.

    low and high are the first and last start of the windows that the place
    stands for, member is a hash of all items of these windows. more are ranges
    of items that are covered by equal members of the text which have no row.
    """

    def places(held: list[tuple[int, int, int, bytes]], unit: int) -> pa.RecordBatch:
        item, length, _ = UNITS[unit]
        parts = [h[3] for h in held]
        docs, keys, bases = (np.array([h[i] for h in held], np.int64) for i in range(3))
        piece, place, low, high, gram = sample(parts, unit)
        ends = zip(piece.tolist(), place.tolist(), low.tolist(), high.tolist())
        members = np.fromiter((xxhash.xxh64_intdigest(parts[i][a * item : (b + length) * item], p - a) for i, p, a, b in ends), np.uint64, len(piece))
        place, low, high = (x + bases[piece] for x in (place, low, high))
        keep, ranges = once_each(piece, members, low, high, unit)
        longs = [docs[piece], keys[piece], *(x.astype(np.int32) for x in (place, low, high)), gram.view(np.int64), members.view(np.int64)]
        more = [[{"a": a, "b": b} for a, b in zip(*(x.tolist() for x in ranges[i]))] if i in ranges else None for i in np.flatnonzero(keep).tolist()]
        return pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in longs), pa.array(more, pa.list_(_RANGE))], schema=_PLACES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, (item, length, _) in enumerate(UNITS):
                held, size = [], 0
                for doc, key, text in zip(batch["doc"].to_pylist(), batch["key"].to_pylist(), batch["data"]):
                    for base, part in _pieces(items(text.as_py(), unit), unit):
                        if len(part) < length * item:
                            continue
                        if size + len(part) // item > 2 * PIECE and held:
                            yield places(held, unit)
                            held, size = [], 0
                        held.append((doc, key, base, part))
                        size += len(part) // item
                if held:
                    yield places(held, unit)

    return keyed.select("doc", "key", "data").mapInArrow(run, "doc long, key long, place int, low int, high int, gram long, member long, more array<struct<a:int,b:int>>")


_HEAD = ["gram", "member", "many", "settled", "least", "most"]
_HEAD_SQL = "gram long, member long, many long, settled boolean, least long, most long"
_HEAD_ARROW = [("gram", pa.int64()), ("member", pa.int64()), ("many", pa.int64()), ("settled", pa.bool_()), ("least", pa.int64()), ("most", pa.int64())]


def _member_items(keyed: DataFrame, heads: DataFrame) -> DataFrame:
    """The items of the windows of each member, from the one document that stands for it."""
    wanted = heads.groupBy("doc", "key").agg(F.collect_list(F.struct(*_HEAD, "place", "low", "high", "size")).alias("wanted"))

    def rows(batch: list[dict]) -> list[dict]:
        out = []
        for r in batch:
            data: dict[int, bytes] = {}
            for w in r["wanted"]:
                unit = w["gram"] & 1
                if unit not in data:
                    data[unit] = items(r["data"], unit)
                item, length, _ = UNITS[unit]
                out.append({**{n: w[n] for n in _HEAD}, "size": w["size"], "before": w["place"] - w["low"], "after": w["place"] - w["high"], "data": data[unit][w["low"] * item : (w["high"] + length) * item]})
        return out

    once = keyed.select("doc", "key", "data").join(wanted, ["doc", "key"]).dropDuplicates(["doc", "key"]).select("data", "wanted")
    arrow = pa.schema([*_HEAD_ARROW, ("size", pa.int64()), ("before", pa.int64()), ("after", pa.int64()), ("data", pa.binary())])
    return map_rows(once, rows, f"{_HEAD_SQL}, size long, before long, after long, data binary", arrow, 64)


def _ranks(block: np.ndarray, texts: list[bytes], width: int, item: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the texts within their blocks, and how many items each shares with the one before it, -1 for a new block."""
    padded = [t.ljust(width * item, b"\0") for t in texts]
    order = np.array(sorted(range(len(texts)), key=lambda i: (block[i], padded[i])))
    rows = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, width * item)[order]
    differ = rows[1:] != rows[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1) // item, width)
    shared[block[order[1:]] != block[order[:-1]]] = -1
    return order, np.r_[-1, shared]


def _backwards(data: bytes, item: int) -> bytes:
    return data[::-1] if item == 1 else np.frombuffer(data, "<u8")[::-1].tobytes()


def repeated_offsets(block: np.ndarray, data: list[bytes], before: np.ndarray, after: np.ndarray, unit: int, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the window that starts r items before the sampled place is found in another member of the block.

    A (members, reach + 1) array; `before` and `after` are each member's largest
    and smallest r, `least` and `most` the smallest and largest of its documents.
    A window of words must be found in another document.
    """
    item, length, _ = UNITS[unit]
    n, reach = len(data), UNITS[unit].reach
    left, left_shared = _ranks(block, [_backwards(d[: b * item], item) for d, b in zip(data, before)], reach, item)
    right, right_shared = _ranks(block, [d[b * item :] for d, b in zip(data, before)], length, item)
    out, a, b = np.zeros((n, reach + 1), bool), np.empty(n, np.int64), np.empty(n, np.int64)
    for r in range(reach + 1):
        has = np.flatnonzero((after <= r) & (r <= before))
        if len(has) < 2:
            continue
        a[left] = np.cumsum(left_shared < r)  # equal numbers: the same r items before the place
        b[right] = np.cumsum(right_shared < length - r)  # and the same items from it on
        both = a[has] * (n + 1) + b[has]
        order = np.argsort(both, kind="stable")
        same = both[order[1:]] == both[order[:-1]]
        if unit:
            starts = np.flatnonzero(np.r_[True, ~same])
            wide = np.minimum.reduceat(least[has[order]], starts) < np.maximum.reduceat(most[has[order]], starts)
            out[has[order], r] = np.repeat(wide, np.diff(np.r_[starts, len(order)]))
        else:
            out[has[order], r] = np.r_[False, same] | np.r_[same, False]
    return out


def _intervals(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])]


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_FOUND = pa.schema([("gram", pa.int64()), ("member", pa.int64()), ("many", pa.int64()), ("offsets", _SPANS)])
_FOUND_SQL = "gram long, member long, many long, offsets array<struct<a:long,b:long>>"


def _sort_blocks(members: DataFrame) -> DataFrame:
    """(gram, member, many, offsets): repeated offsets of members that aren't settled, a block at a time."""

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        gram = rows["gram"].to_numpy()
        block = np.cumsum(np.r_[0, gram[1:] != gram[:-1]]) if len(gram) else gram
        for unit in range(len(UNITS)):
            mine = np.flatnonzero(gram & 1 == unit)
            if not len(mine):
                continue
            part = rows.take(pa.array(mine))
            numbers = {c: part[c].to_numpy() for c in ("before", "after", "least", "most")}
            flags = repeated_offsets(block[mine], part["data"].to_pylist(), unit=unit, **numbers)
            open_ = np.flatnonzero(flags.any(axis=1) & ~part["settled"].to_numpy())
            heads = part.select(["gram", "member", "many"]).take(pa.array(open_)).to_pylist()
            if heads:
                yield pa.RecordBatch.from_pylist([h | {"offsets": _intervals(flags[i])} for h, i in zip(heads, open_)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                table = pa.Table.from_batches([batch.slice(at, BLOCK)])
                held = table if held is None else pa.concat_tables([held, table])
                gram = held["gram"].to_numpy()
                last = int(np.searchsorted(gram, gram[-1]))  # the last block may go on
                yield from solve(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield from solve(held)

    return members.repartition("gram").sortWithinPartitions("gram", "member").mapInArrow(run, _FOUND_SQL)


def _hash_windows(members: DataFrame) -> DataFrame:
    """The same for blocks of any size, by grouping the windows' hashes. Windows of settled members are repeated as such."""

    def rows(batch: list[dict]) -> list[dict]:
        out = []
        for w in batch:
            item, length, _ = UNITS[w["gram"] & 1]
            for r in range(w["after"], w["before"] + 1):
                at = (w["before"] - r) * item
                out.append({**{n: w[n] for n in _HEAD}, "window": xxhash.xxh128_digest(w["data"][at : at + length * item], w["gram"] & 1), "r": r})
        return out

    arrow = pa.schema([*_HEAD_ARROW, ("window", pa.binary()), ("r", pa.int64())])
    windows = map_rows(members, rows, f"{_HEAD_SQL}, window binary, r long", arrow, 64)
    each = windows.groupBy("window").agg(F.count("*").alias("n"), F.bool_or("settled").alias("any"), F.min("least").alias("least"), F.max("most").alias("most"), F.max(F.col("gram").bitwiseAND(F.lit(1))).alias("unit"))
    repeated = each.where(F.col("any") | F.when(F.col("unit") == 0, F.col("n") > 1).otherwise(F.col("least") < F.col("most"))).select("window")
    found = windows.where("not settled").select("gram", "member", "many", "window", "r").join(repeated, "window").groupBy("gram", "member", "many").agg(F.collect_set("r").alias("rs"))
    return found.select("gram", "member", "many", F.transform("rs", lambda r: F.struct(r.alias("a"), r.alias("b"))).alias("offsets"))


def repeated_spans(keyed: DataFrame, shelf: Shelf) -> DataFrame:
    """(doc, key, spans, passages): for each text with repeated windows, the ranges of bytes and of words that they cover, unmerged."""
    owner = F.xxhash64("doc", "key")
    of_words = F.col("gram").bitwiseAND(F.lit(1)) == 1
    places = shelf.put("places", cover_sample(keyed))
    total = places.count()
    blocks = places.groupBy("gram").agg(F.count("*").alias("n"), F.min("member").alias("first"), F.max("member").alias("last"), F.min(owner).alias("least"), F.max(owner).alias("most"))
    blocks = blocks.where((F.col("n") > 1) & (~of_words | (F.col("least") < F.col("most")))).select("gram", "n", (F.col("first") < F.col("last")).alias("mixed"))
    shared = shelf.put("shared", join_by_share(places, blocks, ["gram"], "n", total).drop("n"))
    shelf.drop("places")

    mixed = shared.where("mixed")
    heads = mixed.groupBy("gram", "member").agg(F.count("*").alias("many"), F.min(owner).alias("least"), F.max(owner).alias("most"), F.min(F.struct("doc", "key", "place", "low", "high")).alias("at"))
    settled = F.when(of_words, F.col("least") < F.col("most")).otherwise(F.col("many") > 1)
    heads = shelf.put("heads", heads.select("gram", "member", "many", "least", "most", settled.alias("settled"), "at.*"))
    sizes = heads.groupBy("gram").agg(F.count("*").alias("size"))
    members = shelf.put("members", _member_items(keyed, join_by_share(heads, sizes, ["gram"], "size", heads.count())))
    once = _sort_blocks(members.where(F.col("size") <= BLOCK).drop("size"))
    large = members.where(F.col("size") > BLOCK)
    if not large.isEmpty():
        once = once.unionByName(_hash_windows(large.drop("size")))
    found = shelf.put("found", once)
    shelf.drop("members")

    # Settled members are repeated as a whole; so are blocks of equal members.
    length = F.when(of_words, PASSAGE_WORDS).otherwise(LENGTH)
    span = lambda a, b: F.struct(a.cast("int").alias("a"), (b + length).cast("int").alias("b"))
    all_of = F.array(span(F.col("low"), F.col("high")))
    verdicts = heads.where("settled").select("gram", "member", "many", F.lit(None).cast("array<struct<a:long,b:long>>").alias("offsets")).unionByName(found)
    judged = join_by_share(mixed, verdicts, ["gram", "member"], "many", shared.count())
    some = F.transform("offsets", lambda o: span(F.col("place") - o["b"], F.col("place") - o["a"]))
    with_more = lambda s: F.when((F.size(s) > 0) & F.col("more").isNotNull(), F.concat(s, "more")).otherwise(s).alias("s")
    spans = shared.where("not mixed").select("doc", "key", of_words.alias("words"), with_more(all_of))
    spans = spans.unionByName(judged.select("doc", "key", of_words.alias("words"), with_more(F.coalesce(some, all_of))))
    one = lambda words: F.flatten(F.collect_set(F.when(F.col("words") == words, F.col("s"))))
    return spans.groupBy("doc", "key").agg(one(False).alias("spans"), one(True).alias("passages"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, removed (ranges of bytes), kept (the other bytes), passages (ranges of words).

    A byte goes if a string of LENGTH bytes that covers it also starts anywhere
    else, in the same text or another, all occurrences alike. passages are the
    runs of words, counted from 0, that are covered by PASSAGE_WORDS words which
    another document has too; they are reported and not removed. Null and short
    texts keep everything. Rows that are repeated with their id are repeats of
    each other, and one document. A removed range may end inside a character, so
    kept is binary. Other columns aren't returned.
    """
    shelf = Shelf(docs.sparkSession, "passages")
    keyed = _keyed(docs, id_col, text_col)
    spans = shelf.put("spans", repeated_spans(keyed, shelf))
    shelf.drop("shared", "found", "heads")

    def rows(batch: list[dict]) -> list[dict]:
        out = []
        for r in batch:
            at, parts, removed = 0, [], merged(r["spans"] or [])
            for a, b in removed:
                parts.append(r["data"][at:a])
                at = b
            kept = b"".join([*parts, r["data"][at:]])
            ranges = lambda spans: [{"a": a, "b": b} for a, b in spans]
            out.append({"doc_id": r["doc_id"], "n_bytes": len(r["data"]), "removed": ranges(removed), "kept": kept, "passages": ranges(merged(r["passages"] or []))})
        return out

    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", _SPANS), ("kept", pa.binary()), ("passages", _SPANS)])
    ranges = "array<struct<a:long,b:long>>"
    return map_rows(keyed.join(spans, ["doc", "key"], "left").select("doc_id", "data", "spans", "passages"), rows, f"doc_id long, n_bytes long, removed {ranges}, kept binary, passages {ranges}", arrow, 64)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed of each document, and how many of its words are in passages that another document has.

    Null texts count as empty; remove_repeats says what holds for other odd rows.
    """
    out = remove_repeats(read(spark, sf_dir, "documents"))
    total = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return out.select("doc_id", "n_bytes", total("removed").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), total("passages").alias("n_passage_words"))
