"""Near duplicates by a chosen-path set similarity join.

Documents are sets of word shingles. In each of several independent trees a
document goes from node to node by the minwise token of its set, a fresh hash
for each level, until its node is small; the members of small nodes are then
compared exhaustively. Two sets of similarity s stay together for d levels of a
tree with probability s^d, and the trees are repeated until a pair at the
threshold is missed by all of them with probability MISS at most: TREES trees are
enough for documents whose nodes are all small at the first depth, and those that
share a larger node there go through as many more as the last level needs.
Sketches reject pairs
that are far apart; all links are confirmed on the full sets. Components grow in
two rounds: first each member meets one other that it resembles, then only
members of different components are compared, so a large group of near copies
yields about as many pairs as it has members. The other trees come between the two
rounds and leave out nodes of one component. A node that no level makes small is
cut into blocks; each member meets its own block and the node's first member, and
only members outside that one's component then meet the other blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, join_by_share, map_rows, read, text_bytes
from .components import components

WORDS = 5
#: Trees of every document.
TREES = 16
LEVELS = 8
#: The most that the probability may be by which all trees, or one of the two sketches, lose a pair at the threshold.
MISS = 1e-6
#: Levels at which nodes are looked at. Nodes above SMALL members branch on to the next one.
DEPTHS = (2, 3, 4, 6, 8)
#: The same for the further trees. Their number is that of the last level, so nodes that are small before it add nothing to the recall that MISS states.
MORE_DEPTHS = (6, 8)
SMALL = 1024
#: Bytes of the finer sketch, which is made only of documents that the first one can't tell apart.
FINE = 1024

#: Rows of one leader that meet its set in one task.
SALT = 1024

_HASHES = TREES * LEVELS


def trees_for(percent: int, depth: int, miss: float = MISS) -> int:
    """How many trees part a pair at `percent` above `depth` levels with probability `miss` at most."""
    together = (percent / 100) ** depth
    return 1 if together >= 1 else math.ceil(math.log(miss) / math.log1p(-together))


def sketch_cut(percent: int, n: int) -> float:
    """The share of `n` equal bytes that a pair at `percent` falls below with probability MISS at most."""
    share, below, k = percent / 100, 0.0, 0
    while k < n and (below := below + math.comb(n, k) * share**k * (1 - share) ** (n - k)) <= MISS:
        k += 1
    return k / n


def _functions(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(seed))
    return random.integers(0, 2**64, n, np.uint64) | np.uint64(1), random.integers(0, 2**64, n, np.uint64)


_COARSE_HASHES, _FINE_HASHES = _functions(20_077, _HASHES), _functions(20_078, FINE)
_M, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BLOCK = 2048


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text in UTF-8.

    A-Z are lower-cased; words are what spaces, tabs and line ends separate. A
    text with fewer words is one shingle, a text without words has none.
    """
    tokens = text.lower().split()  # bytes: ASCII letters and white space only
    n = len(tokens)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, n)
    size = min(n, words)
    if not size:
        return hashes
    out = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        out = (out ^ (out >> np.uint64(29))) * _M + hashes[j : n - size + 1 + j]
    out ^= out >> np.uint64(33)
    out *= _MIX
    return np.unique(out ^ (out >> np.uint64(31)))


def minwise(values: np.ndarray, functions: tuple[np.ndarray, np.ndarray] = _COARSE_HASHES) -> np.ndarray:
    """The minimum of each of the hash functions over a set, 32 bits each."""
    factors, shifts = functions
    least = np.full(len(factors), 2**32 - 1, np.uint64)
    for at in range(0, len(values), _BLOCK):
        block = values[None, at : at + _BLOCK] * factors[:, None]
        block += shifts[:, None]
        np.minimum(least, block.min(axis=1) >> np.uint64(32), out=least)
    return least.astype("<u4")


def set_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, digest of the set, tokens (32 bits for each tree and level), sketch (a byte of each)."""

    def rows(batch: list[dict]) -> list[dict]:
        out = []
        for r in batch:
            values = shingles(r["data"])
            least = minwise(values) if len(values) else np.zeros(0, "<u4")
            out.append({"doc_id": r["doc_id"], "n_shingles": len(values), "digest": xxhash.xxh128_digest(values.tobytes()), "tokens": least.tobytes(), "sketch": least.astype(np.uint8).tobytes()})
        return out

    arrow = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("tokens", pa.binary()), ("sketch", pa.binary())])
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("data")), rows, "doc_id long, n_shingles long, digest binary, tokens binary, sketch binary", arrow)


def _more_tokens(docs: DataFrame, needed: DataFrame, trees: int, id_col: str, text_col: str) -> DataFrame:
    """rep and its tokens in `trees` trees after the first TREES."""
    factors, shifts = _functions(20_079, trees * LEVELS)
    parts = [(factors[at : at + FINE], shifts[at : at + FINE]) for at in range(0, len(factors), FINE)]

    def rows(batch: list[dict]) -> list[dict]:
        out = []
        for r in batch:
            values = shingles(r["data"])
            out.append({"rep": r["doc_id"], "tokens": b"".join(minwise(values, part).tobytes() for part in parts)})
        return out

    arrow = pa.schema([("rep", pa.int64()), ("tokens", pa.binary())])
    return map_rows(_texts(docs, needed, id_col, text_col), rows, "rep long, tokens binary", arrow, 64)


def _with_rep(rows: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
    """Rows, of which a rep has one for each tree at most, joined with what `side` says of the rep: once for each rep."""
    mine = [c for c in rows.columns if c != "rep"]
    lists = rows.groupBy("rep").agg(F.collect_list(F.struct(*mine)).alias("_rows")).join(side, "rep", how)
    return lists.withColumn("_row", F.explode("_rows")).select("rep", *(f"_row.{c}" for c in mine), *(c for c in side.columns if c != "rep"))


def _block(of: str, n: Column) -> Column:
    """One of n blocks of a node's members."""
    return F.pmod(F.xxhash64("rep", of), n).cast("int")


def small_nodes(sets: DataFrame, shelf: Shelf, small: int = SMALL, first: int = 0, trees: int = TREES, depths: tuple[int, ...] = DEPTHS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, rep) of all nodes with 2 to `small` members, from trees `first` on, the reps of larger nodes at the first
    depth, and (path, rep) of nodes that are still larger at the last level, which are also cut into blocks as nodes.

    `sets` has rep, component and tokens. A path whose members are all of one
    component has nothing left to decide and ends there.
    """
    rows = sets.withColumn("tree", F.explode(F.sequence(F.lit(first), F.lit(first + trees - 1))))
    own = F.substr("tokens", (F.col("tree") - first) * (4 * LEVELS) + 1, F.lit(4 * LEVELS))  # those of one tree, which rows keep from level to level
    rows = rows.select("tree", "rep", "component", own.alias("tokens"))
    done, crowded, total = [], None, sets.count() * trees
    for depth in depths:
        rows = rows.withColumn("path", F.xxhash64("tree", F.substr("tokens", F.lit(1), F.lit(4 * depth))))
        sizes = rows.groupBy("path").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
        sizes = sizes.where("low < high").select("path", "size")
        level = shelf.put(f"level-{first}-{depth}", join_by_share(rows, sizes, ["path"], "size", total))
        done.append(level.where(F.col("size") <= small).select(F.xxhash64(F.lit(depth), "path").alias("node"), "rep"))
        large = level.where(F.col("size") > small)
        if crowded is None:
            crowded = large.select("rep").distinct()
        if not (total := large.count()):
            break
        rows = large.select("tree", "rep", "component", "tokens")
        shelf.tidy()
    else:
        block = _block("path", F.ceil(F.col("size") / (small // 2)).cast("int"))
        done.append(large.select(F.xxhash64(F.lit(-1), "path", block).alias("node"), "rep"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, crowded, large.select("path", "rep")


def _drop_levels(shelf: Shelf, first: int) -> None:
    shelf.drop(*(f"level-{first}-{depth}" for depth in DEPTHS))
    shelf.tidy()


def _first_nodes(classes: DataFrame, shelf: Shelf, percent: int, small: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, rep) and the crowds (path, rep) of the first trees, and the reps that go through more trees."""
    nodes, crowded, crowds = small_nodes(classes.select("rep", F.col("rep").alias("component"), "tokens"), shelf, small)
    if trees_for(percent, DEPTHS[0]) > TREES:
        crowded = classes.select("rep")
    out = shelf.put("nodes", nodes), shelf.put("crowds", crowds), shelf.put("crowded", crowded)
    _drop_levels(shelf, 0)
    return out


def _more_nodes(docs: DataFrame, crowded: DataFrame, component: DataFrame, shelf: Shelf, trees: int, small: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(node, rep) and the crowds (path, rep) of `trees` trees after the first ones.

    A pair of which one document meets small nodes only at the first depth is
    found by TREES trees unless they part it there in each. All other
    documents go through the trees that the last level needs, in which pairs of
    them stay together to the end, or to a small node before it. Paths within
    one `component` (rep, component; a rep without one is its own) end early, so
    a group of near copies that the first trees linked isn't carried through the others.
    """
    tokens = _more_tokens(docs, crowded, trees, id_col, text_col).join(component, "rep", "left")
    tokens = shelf.put("more-tokens", tokens.select("rep", F.coalesce("component", "rep").alias("component"), "tokens"))
    nodes, _, crowds = small_nodes(tokens, shelf, small, TREES, trees, MORE_DEPTHS)
    out = shelf.put("more-nodes", nodes), shelf.put("more-crowds", crowds)
    shelf.drop("more-tokens")
    shelf.tidy()
    _drop_levels(shelf, TREES)
    return out


def _crowd_leaders(crowds: DataFrame, sketches: DataFrame, cut: float) -> DataFrame:
    """Pairs of the members of a crowd with its first member, where they resemble it."""

    def run(batches):
        for batch in batches:
            mine, lead = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch", "lead_sketch"))
            near = (mine == lead).mean(axis=1) >= cut if batch.num_rows else np.zeros(0, bool)
            yield _pair_batch(np.stack([batch["lead"].to_numpy()[near], batch["rep"].to_numpy()[near]], axis=1))

    leads = crowds.groupBy("path").agg(F.min("rep").alias("lead"), F.count("*").alias("size"))
    leads = leads.join(sketches.select(F.col("rep").alias("lead"), F.col("sketch").alias("lead_sketch")), "lead")
    rows = _with_rep(join_by_share(crowds, leads.select("path", "lead", "size"), ["path"], "size", crowds.count()).select("rep", "path", "lead"), sketches)
    rows = join_by_share(rows, leads.select("path", "lead_sketch", "size"), ["path"], "size", crowds.count())
    return rows.select("lead", "rep", "lead_sketch", "sketch").mapInArrow(run, "a long, b long").distinct()


def crowd_nodes(crowds: DataFrame, component: DataFrame, small: int) -> DataFrame:
    """(node, rep) in which the members of a crowd outside its first member's component meet all its other blocks.

    `component` has rep and component; reps without one are their own. A crowd
    that is one component gives no node, so a group of near copies costs nothing
    beyond its own blocks and its leader.
    """
    half = small // 2
    rows = _with_rep(crowds, component, "left").select("path", "rep", F.coalesce("component", "rep").alias("component"))
    leads = rows.groupBy("path").agg(F.min(F.struct("rep", "component"))["component"].alias("main"), F.count("*").alias("size"))
    rows = join_by_share(rows, leads, ["path"], "size", crowds.count()).withColumn("stranger", F.col("component") != F.col("main"))
    strange = rows.groupBy("path").agg(F.count_if("stranger").alias("k")).where("k > 0")
    sizes = leads.join(strange, "path").select("path", F.col("size").alias("n"), F.ceil(F.col("k") / half).cast("int").alias("out"), F.ceil((F.col("size") - F.col("k")) / half).cast("int").alias("in"))
    rows = join_by_share(rows.select("path", "rep", "stranger"), sizes, ["path"], "n", crowds.count())
    block = F.when(F.col("stranger"), _block("path", F.col("out"))).otherwise(F.col("out") + _block("path", F.col("in")))
    last = F.when(F.col("stranger"), F.col("out") + F.col("in")).otherwise(F.col("out")) - 1
    pairs = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last))).where("other <> block")
    return pairs.select(F.xxhash64(F.lit(-2), "path", F.least("block", "other"), F.greatest("block", "other")).alias("node"), "rep")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Whole nodes from rows sorted by node: where the nodes start, and their rows."""
    rest: pa.Table | None = None

    def starts(table: pa.Table) -> np.ndarray:
        node = table["node"].to_numpy()
        return np.r_[np.flatnonzero(np.r_[True, node[1:] != node[:-1]]), len(node)]

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        node = table["node"].to_numpy()
        last = int(np.searchsorted(node, node[-1]))
        rest = table.slice(last)
        if last:
            yield starts(table.slice(0, last)), table.slice(0, last)
    if rest is not None and rest.num_rows:
        yield starts(rest), rest


def _members(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rep, sketch and component of the rows."""
    sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
    return table["rep"].to_numpy(), sketch, table["component"].to_numpy()


def _by_node(nodes: DataFrame, *more: str) -> DataFrame:
    return nodes.select("node", "rep", "sketch", "component", *more).repartition("node").sortWithinPartitions("node", "rep")


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pair_batch(found: list[tuple[int, int]] | np.ndarray) -> pa.RecordBatch:
    pairs = np.asarray(found, np.int64).reshape(-1, 2)
    pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_PAIRS)


def _alike(sketch: np.ndarray, i: int, others: np.ndarray, cut: float) -> np.ndarray:
    """Those of the others whose sketch is near that of i."""
    return others[(sketch[others] == sketch[i]).mean(axis=1) >= cut]


def _leader_pairs(nodes: DataFrame, cut: float) -> DataFrame:
    """Pairs of the members of a node with the first unpaired member that they resemble."""

    def run(batches):
        for starts, table in _groups(batches):
            rep, sketch, _ = _members(table)
            sizes = np.diff(starts)
            two = starts[:-1][sizes == 2]  # most nodes have two members
            two = two[(sketch[two] == sketch[two + 1]).mean(axis=1) >= cut]
            found = [np.stack([rep[two], rep[two + 1]], axis=1)]
            for at, n in zip(starts[:-1][sizes > 2], sizes[sizes > 2]):
                left = np.arange(at, at + n)
                while len(left) > 1:
                    near = _alike(sketch, left[0], left[1:], cut)
                    found.append(np.stack([np.full(len(near), rep[left[0]]), rep[near]], axis=1))
                    left = np.setdiff1d(left[1:], near, assume_unique=True)
            yield _pair_batch(np.concatenate(found))

    return _by_node(nodes).mapInArrow(run, "a long, b long").distinct()


def _undecided(nodes: DataFrame, cut: float) -> DataFrame:
    """The rows of nodes that resemble a member of another component in the same node."""

    def run(batches):
        for starts, table in _groups(batches):
            rep, sketch, component = _members(table)
            keep = np.zeros(len(rep), bool)
            for at, end in zip(starts[:-1], starts[1:]):
                for i in range(at, end - 1):
                    near = _alike(sketch, i, i + 1 + np.flatnonzero(component[i + 1 : end] != component[i]), cut)
                    keep[near] = True
                    keep[i] |= len(near) > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()) for x in (table["node"].to_numpy(), rep, component)], names=["node", "rep", "component"])

    return _by_node(nodes).mapInArrow(run, "node long, rep long, component long")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted arrays of distinct values."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


def _links_across(nodes: DataFrame, cut: float, percent: int) -> DataFrame:
    """Links between members of different components, compared on their full sets within the node.

    A link joins its two components for the rest of the node, so a node gives
    fewer links than it has members.
    """

    def run(batches):
        for starts, table in _groups(batches):
            rep, sketch, component = _members(table)
            component, found = component.copy(), []
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"].combine_chunks()]
            for at, end in zip(starts[:-1], starts[1:]):
                for i in range(at, end - 1):
                    for j in _alike(sketch, i, i + 1 + np.flatnonzero(component[i + 1 : end] != component[i]), cut):
                        if component[i] != component[j] and _linked(sets[i], sets[j], percent):
                            found.append((rep[i], rep[j]))
                            mine = component[at:end]
                            mine[mine == component[j]] = component[i]
            yield _pair_batch(found)

    return _by_node(nodes, "shingles").mapInArrow(run, "a long, b long").distinct()


def _texts(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("data"))
    return rows.join(needed.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").distinct()


def _full_sets(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    arrow = pa.schema([("rep", pa.int64()), ("shingles", pa.binary())])
    return map_rows(_texts(docs, needed, id_col, text_col), lambda batch: [{"rep": r["doc_id"], "shingles": shingles(r["data"]).tobytes()} for r in batch], "rep long, shingles binary", arrow)


def _fine_sketches(sets: DataFrame) -> DataFrame:
    arrow = pa.schema([("rep", pa.int64()), ("sketch", pa.binary())])

    def rows(batch: list[dict]) -> list[dict]:
        return [{"rep": r["rep"], "sketch": minwise(np.frombuffer(r["shingles"], np.uint64), _FINE_HASHES).astype(np.uint8).tobytes()} for r in batch]

    return map_rows(sets, rows, "rep long, sketch binary", arrow, 64)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union. The set of a leader of many pairs is sent to several tasks."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    slices = F.ceil(F.col("n") / SALT).cast("int")
    pairs = join_by_share(pairs, sizes, ["a"], "n", pairs.count()).withColumn("slice", F.pmod(F.xxhash64("b"), slices).cast("int"))
    a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")).join(sizes, "a").select("a", "x", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))

    def run(batches):
        for batch in batches:
            sets = ((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch["x"], batch["y"]))
            yield batch.select(["a", "b"]).filter(pa.array([_linked(x, y, percent) for x, y in sets], pa.bool_()))

    return pairs.select("a", "b", "slice").join(a, ["a", "slice"]).join(b, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest id reachable over links, itself
    included, and one document of each component is kept. Equal sets are one
    class, so copies add no pairs. Texts that are null or have no words are
    linked with nothing. Rows that share an id are taken as one document. Null
    ids have a null component and are kept. Other columns aren't returned.
    """
    shelf = Shelf(docs.sparkSession, "neardup")
    cut, fine_cut = (sketch_cut(percent, n) for n in (_HASHES, FINE))
    prints = shelf.put("prints", set_prints(docs, id_col, text_col))
    known = prints.where("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("tokens").alias("tokens"), F.min("sketch").alias("sketch"))
    classes = shelf.put("classes", classes)
    nodes, crowds, crowded = _first_nodes(classes, shelf, percent, small)
    crowd = not crowds.isEmpty()

    # First one link for each member that resembles another, then what connects different components.
    sketches = classes.select("rep", "sketch")
    sets = shelf.put("sets", _full_sets(docs, nodes.select("rep").unionByName(crowded), id_col, text_col))
    lone = _with_rep(nodes, sketches).withColumn("component", F.col("rep"))
    pairs = _leader_pairs(lone, cut)
    tried = shelf.put("tried", pairs.unionByName(_crowd_leaders(crowds, sketches, cut)).distinct() if crowd else pairs)
    links = shelf.put("links", _confirmed(tried, sets, percent))
    shelf.tidy()
    first = shelf.put("first", components(links, shelf, "first-round"))

    of = first.withColumnRenamed("node", "rep")
    trees = trees_for(percent, LEVELS) - TREES
    if trees > 0 and not crowded.isEmpty():
        more_nodes, more_crowds = _more_nodes(docs, crowded, of, shelf, trees, small, id_col, text_col)
        nodes, crowds = nodes.unionByName(more_nodes), crowds.unionByName(more_crowds)
        crowd = crowd or not more_crowds.isEmpty()
    if crowd:
        nodes = nodes.unionByName(shelf.put("crowd-nodes", crowd_nodes(crowds, of, small)))
    placed = _with_rep(nodes, of, "left").select("node", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("node")
    open_ = shelf.put("open", _undecided(_with_rep(placed.join(mixed, "node", "left_semi"), sketches), cut))
    fine = shelf.put("fine", _fine_sketches(sets.join(open_.select("rep").distinct(), "rep", "left_semi")))
    close = shelf.put("close", _undecided(_with_rep(open_, fine), fine_cut))
    more = shelf.put("more", _links_across(_with_rep(close, fine.join(sets, "rep")), fine_cut, percent))
    final = shelf.put("final", components(links.unionByName(more), shelf, "second-round"))

    same = known.select("digest", "doc_id").join(classes.select("digest", "rep"), "digest").select("doc_id", "rep").distinct()
    same = same.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    placed = same.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("doc_id").alias("_id"), F.coalesce("component", "rep").alias("_component"))
    out = prints.select("doc_id", "n_shingles").join(placed, F.col("doc_id") == F.col("_id"), "left")
    component = F.coalesce("_component", "doc_id")
    out = shelf.put("out", out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")))
    shelf.drop("prints", "classes", "nodes", "more-nodes", "crowds", "crowded", "more-crowds", "crowd-nodes", "sets", "tried", "links", "first", "open", "fine", "close", "more", "final")
    shelf.tidy()
    return out


def keep_one(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that near_duplicates keeps: one of each component and of each id.

    Rows with a null id stay. Of different rows with one id, any one stays.
    """
    kept = near_duplicates(docs, percent, id_col, text_col).where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept_id")).distinct()
    one = docs.join(kept, F.col(id_col) == F.col("__kept_id"), "left_semi").dropDuplicates([id_col])
    return one.unionByName(docs.where(F.col(id_col).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 85 per cent; near_duplicates says what holds for odd rows."""
    return near_duplicates(read(spark, sf_dir, "documents"), 85)
