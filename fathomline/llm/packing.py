"""Harmonic packing: pieces in reciprocal-capacity classes, a fixed number of pieces to a bin.

A piece of length in (C/(j+1), C/j] is of class j, and a bin of class j takes j
of them. Documents are cut so that pieces nearly fill their class, which keeps
the padding small. Workers, which are hashed shares of the pieces, fill their
bins independently: pieces are dealt in order of their documents, one to a bin
in turn, so those of one document, its copies too, come to different bins. What
is left of a worker's classes, less than j pieces each, is packed first-fit
within that worker, again apart.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shelf, map_rows, read

CAPACITY = 2048
END_ID = 1
#: A piece is cut further if a bin of its class would leave more than this share unused.
SLACK = 0.02
#: Pieces to a worker on average. The rest of all its classes is bounded whatever the input's size.
PER_WORKER = 20_000
#: A document with more pieces in a class of a worker, or among its rest, than this may have two in a bin.
APART = 64
#: The one special string of the vocabulary and its id.
SPECIAL = {"<|endoftext|>": 50256}


@cache
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)


def encode(text: str, path: str, pattern: str) -> np.ndarray:
    """The same ids as the vocabulary's JSON file gives with the tokenizers library."""
    own = encoder(path, pattern)
    ids = own.encode(text, allowed_special="all") if any(s in text for s in SPECIAL) else own.encode_ordinary(text)
    return np.array([*ids, END_ID], "<u4")


def cuts(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of a document of n ids: each nearly fills a bin of its class."""
    out, rest = [capacity] * (n // capacity), n % capacity
    while rest:
        j = capacity // rest
        piece = rest if capacity - j * rest <= slack * capacity else capacity // (j + 1)
        out.append(piece)
        rest -= piece
    return out


def token_pieces(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, slack: float = SLACK, with_ids: bool = True) -> DataFrame:
    """Tokenize whole texts (null: empty) and cut them; a row per piece with its ids, if wanted, and their CRC-32."""

    def rows(batch: list[dict]) -> list[dict]:
        out = []
        for row in batch:
            ids, start = encode(row["text"] or "", path, pattern), 0
            for n in cuts(len(ids), capacity, slack):
                raw = ids[start : start + n].tobytes()
                piece = {"doc_id": row["doc_id"], "start": start, "length": n, "ids_crc32": zlib.crc32(raw), "doc_tokens": len(ids)}
                out.append(piece | {"ids": raw} if with_ids else piece)
                start += n
        return out

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = ", ".join(f"{n} long" for n in names) + ", ids binary" * with_ids
    arrow = pa.schema([(n, pa.int64()) for n in names] + [("ids", pa.binary())] * with_ids)
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rows, schema, arrow, 64)


def _first_fit(lengths: list[int], capacity: int, owners: list) -> list[tuple[int, int]]:
    """(bin, offset) of each length, the longest first into the fullest bin that takes it and has none of its owner."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    many = Counter(owners)
    room, used, held, out = [], [], [], [(0, 0)] * len(lengths)  # room: sorted (free, bin)
    for i in order:
        at, own = bisect_left(room, (lengths[i], -1)), owners[i]
        if own is not None and many[own] <= APART:
            while at < len(room) and own in held[room[at][1]]:
                at += 1
        free, k = room.pop(at) if at < len(room) else (capacity, len(used))
        if k == len(used):
            used.append(0)
            held.append(set())
        out[i] = (k, used[k])
        used[k] += lengths[i]
        held[k].add(own)
        insort(room, (free - lengths[i], k))
    return out


def harmonic_pack(pieces: DataFrame, workers: int, capacity: int = CAPACITY, row: str | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, start, length (1 to capacity).

    Sequences hold at most `capacity` ids and have no gaps. Pieces of one doc_id
    get sequences of their own; only where a worker has more than `APART` of
    them in one class, or in its rest, two may share one. Ties, repeated rows and null ids are
    packed like any other row; null ids are no document. Other columns stay; those
    named sequence_id, offset or __pack_* are replaced. `row` names a written
    column of distinct numbers, which deals repeated rows over all workers and
    stays; without it those with equal doc_id, start and length share one.
    """
    pieces = pieces.drop("sequence_id", "offset", *(c for c in pieces.columns if c.startswith("__pack_") and c != row))
    more = [row] if row else []
    keyed = pieces.withColumns({
        "__pack_class": F.floor(F.lit(capacity) / F.col("length")).cast("long"),
        "__pack_worker": F.pmod(F.xxhash64("doc_id", "start", "length", *more), F.lit(workers)),
    })
    share = Window.partitionBy("__pack_worker", "__pack_class")
    order = ["doc_id", "start", *more, *(c for c in ("ids_crc32",) if c in pieces.columns)]
    numbered = keyed.withColumns({"__pack_i": (F.row_number().over(share.orderBy(*order)) - 1).cast("long"), "__pack_bins": F.floor(F.count(F.lit(1)).over(share) / F.col("__pack_class"))})
    numbered = numbered.withColumn("__pack_same", F.count(F.lit(1)).over(Window.partitionBy("__pack_worker", "__pack_class", "doc_id")))
    numbered = numbered.withColumn("__pack_most", F.max(F.when(F.col("doc_id").isNotNull(), F.col("__pack_same"))).over(share))
    # A class of few bins, of which a document has more pieces than that, is packed with the rest.
    crowded = F.coalesce((F.col("__pack_bins") < F.col("__pack_most")) & (F.col("__pack_most") <= APART), F.lit(False))
    whole = ~crowded & (F.col("__pack_i") < F.col("__pack_bins") * F.col("__pack_class"))
    number = lambda kind, k: F.shiftleft(F.col("__pack_worker"), 40) + F.shiftleft(kind, 28) + k
    within = Window.partitionBy("__pack_worker", "__pack_class", "__pack_bin").orderBy("__pack_i").rowsBetween(Window.unboundedPreceding, -1)
    full = numbered.where(whole).withColumn("__pack_bin", F.col("__pack_i") % F.col("__pack_bins")).withColumns({
        "sequence_id": number(F.col("__pack_class"), F.col("__pack_bin")),
        "offset": F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long"),
    })

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["__pack_class", "__pack_i"], kind="stable")
        owners = [None if pd.isna(i) else i for i in group["doc_id"].tolist()]
        placed = _first_fit(group["length"].tolist(), capacity, owners)
        return group.assign(__pack_bin=[k for k, _ in placed], offset=[o for _, o in placed])

    # Less than j pieces of each class j of a worker, or APART bins of them: a number that does not grow with the input.
    rest = numbered.where(~whole)
    rest = rest.groupBy("__pack_worker").applyInPandas(fit, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rest.schema.fields)}, __pack_bin long, offset long")
    rest = rest.withColumn("sequence_id", number(F.lit(0).cast("long"), F.col("__pack_bin")))
    columns = [*pieces.columns, "sequence_id", "offset"]
    return full.select(columns).unionByName(rest.select(columns))


def pack_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = True, **more) -> DataFrame:
    """Tokenize, cut and pack all documents; the pieces are kept in the shared folder meanwhile."""
    shelf = Shelf(docs.sparkSession, "packing")
    pieces = shelf.put("pieces", token_pieces(docs, path, pattern, with_ids=with_ids, **more).withColumn("__pack_row", F.monotonically_increasing_id()))
    workers = max(1, round(pieces.count() / PER_WORKER))
    # Ids are not needed to place their pieces, so they are shuffled once, to meet their places.
    placed = harmonic_pack(pieces.drop("ids"), workers, more.get("capacity", CAPACITY), "__pack_row")
    if with_ids:
        placed = pieces.join(placed.select("__pack_row", "sequence_id", "offset"), "__pack_row")
    return placed.drop("__pack_row")


def production(docs: DataFrame, with_ids: bool) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences. Null texts count as empty, with the closing id alone."""
    return production(read(spark, sf_dir, "documents"), with_ids=False)
