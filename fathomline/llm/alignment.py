"""Alignment of two tokenizers over the same text, and how often their tokens overlap.

Both tokenizers cut the same bytes. A label for each byte says which of them
end a token there; a regular expression scans the labels up to each place where
both do, and the counts of labels in a span are its group's numbers of tokens.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shelf, join_by_share, read

#: Labels of a byte: a token of A ends, a token of B ends, or both; else none, 0.
A_END, B_END, BOTH = 1, 2, 3
GROUP = re.compile(rb"[^\x03]*\x03")
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Documents that a task tokenizes together.
SLICE = 64
#: Up to so many pairs of ids are broadcast with their counts (20 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000


class Pair:
    """The tokenizers A (byte-level BPE ranks) and B (a piece model), with the bytes of their tokens."""

    def __init__(self, a_path: str, pattern: str, b_path: str):
        with open(a_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.a = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.a_sizes[rank] = len(token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.b_sizes = np.array([len(p) for p in self.b_bytes], np.int64)
        # An id of A is followed by a comma, or by a bar at its group's end; one of B by a comma or a semicolon.
        self.written = [f"{i}{end}" for i in range(len(self.a_sizes)) for end in ",|"]
        self.b_from = len(self.written)
        self.written += [f"{i}{end}" for i in range(len(pieces)) for end in ",;"]

    def align(self, text: str | None, b_ids: list[int]) -> dict | None:
        """Groups and linked id pairs of a text whose ids by B are given; None if it has no tokens or B's bytes aren't the text's."""
        raw = f" {text}".encode() if text else b""
        if not raw or b"".join(map(self.b_bytes.__getitem__, b_ids)) != raw:
            return None
        a, b = np.array(self.a.encode_ordinary(f" {text}"), np.int64), np.array(b_ids, np.int64)
        labels = np.zeros(len(raw), np.uint8)
        labels[np.cumsum(self.a_sizes[a]) - 1] += A_END
        labels[np.cumsum(self.b_sizes[b]) - 1] += B_END
        n_a, n_b = group_sizes(labels)
        linked, n = np.unique(links(labels, a, b, len(self.b_sizes)), return_counts=True)
        return {"n_a": len(a), "n_b": len(b), "n_groups": len(n_a), "n_links": int(n.sum()), "groups": self.write(a, b, n_a, n_b), "linked": linked, "n": n}

    def write(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> str:
        """The groups as `a1,a2|b1;a3|b2,b3`."""
        of_a, of_b = a * 2, self.b_from + b * 2
        of_a[np.cumsum(n_a) - 1] += 1
        of_b[np.cumsum(n_b) - 1] += 1
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(np.cumsum(n_b) - n_b, n_a)] = of_a
        out[np.arange(len(b)) + np.repeat(np.cumsum(n_a), n_b)] = of_b
        return "".join(map(self.written.__getitem__, out.tolist()))[:-1]


def group_sizes(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens of A and of B in each group, in order."""
    ends = np.fromiter((m.end() for m in GROUP.finditer(labels.tobytes())), np.int64)
    return tuple(np.diff(np.cumsum(ended, dtype=np.int64)[ends - 1], prepend=0) for ended in (labels & A_END, labels >> 1))


def links(labels: np.ndarray, a: np.ndarray, b: np.ndarray, kinds_of_b: int) -> np.ndarray:
    """All pairs of overlapping tokens, as a * kinds_of_b + b.

    Between two neighbouring ends lies the overlap of one token of A with one of
    B, and the overlap of two tokens is one such stretch.
    """
    ends = labels[labels > 0]
    at_a, at_b = np.cumsum(ends & A_END, dtype=np.int64) - (ends & A_END), np.cumsum(ends >> 1, dtype=np.int64) - (ends >> 1)
    return a[at_a] * kinds_of_b + b[at_b]


@cache
def pair(a_path: str, pattern: str, b_path: str) -> Pair:
    """One for each Python worker."""
    return Pair(a_path, pattern, b_path)


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
PAIRS = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("groups", pa.string()), ("pairs", pa.list_(PAIRS))])
SCHEMA = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, groups string, pairs array<struct<a: int, b: int, n: bigint>>"


def align(docs: DataFrame, a_path: str, pattern: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Align the tokens of both tokenizers in each whole text; a row for each row of `docs`.

    A encodes a space and the text, B the text, to which it adds that space;
    strings of special tokens are plain text. Returns doc_id, n_a, n_b,
    n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`) and pairs (a, b and how many
    links hold them linked). A text that is null or empty, or which B changes
    (so that its tokens' bytes differ), has zeros, '' and no pairs. Null and
    repeated ids and repeated texts are rows like any other; other columns of
    `docs` are not used. Memory is in proportion to the longest texts in a slice of 64.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_path, pattern, b_path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                ids, texts = batch.slice(at, SLICE).columns
                texts = [text or "" for text in texts.to_pylist()]
                found = [both.align(*x) for x in zip(texts, both.b.encode(texts, num_threads=1), strict=True)]
                some = [x for x in found if x]
                linked = np.concatenate([np.zeros(0, np.int64), *(x["linked"] for x in some)])
                n = np.concatenate([np.zeros(0, np.int64), *(x["n"] for x in some)])
                first, second = np.divmod(linked, len(both.b_sizes))
                pairs = pa.StructArray.from_arrays([first.astype("int32"), second.astype("int32"), n], fields=list(PAIRS))
                starts = np.cumsum([0, *(len(x["n"]) if x else 0 for x in found)]).astype("int32")
                counts = [pa.array([x[c] if x else 0 for x in found], pa.int64()) for c in COUNTS]
                groups = pa.array([x["groups"] if x else "" for x in found])
                yield pa.RecordBatch.from_arrays([ids, *counts, groups, pa.ListArray.from_arrays(starts, pairs, type=pa.list_(PAIRS))], schema=ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """How many links hold each pair of ids linked, over all rows; best: no pair with the same b has more."""
    counts = aligned.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def best_links(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Adds n_best and count_sum to rows with a column of pairs, which it takes away.

    n_best are the links whose count is the highest of their id of B, count_sum
    is the sum of counts over the links. Up to `broadcast_pairs` counts are
    broadcast; more are shuffled, but for those that are very frequent.
    """
    shelf = Shelf(aligned.sparkSession, "alignment")
    # The number of a row is fixed by writing it.
    rows = shelf.put("rows", aligned.withColumn("__row", F.monotonically_increasing_id()))
    counts = shelf.put("counts", counts)
    linked = rows.select("__row", F.inline("pairs"))
    if counts.count() <= broadcast_pairs:
        met = linked.join(F.broadcast(counts), ["a", "b"])
    else:  # a pair is as heavy as the number of documents that hold it
        met = join_by_share(linked, counts.join(linked.groupBy("a", "b").agg(F.count("*").alias("docs")), ["a", "b"]), ["a", "b"], "docs", rows.agg(F.sum(F.size("pairs"))).first()[0])
    sums = met.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    return rows.drop("pairs").join(sums, "__row", "left").drop("__row").fillna(0, ["n_best", "count_sum"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of both vocabularies over all documents; align says what holds for odd rows."""
    import public_tokenizers as files

    aligned = align(read(spark, sf_dir, "documents"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN, files.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    kept = Shelf(spark, "aligned").put("documents", aligned.withColumn("groups_sha256", digest).drop("groups"))
    return best_links(kept, pair_counts(kept)).select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")
