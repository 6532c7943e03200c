"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Each paragraph is hashed to a wide vector of bytes; a document's fingerprint is
the sum of its paragraphs' vectors, each lane modulo 2^32. The order of the
paragraphs doesn't matter, and a paragraph is inserted or deleted by adding or
subtracting its own vector. Everything is built from column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

#: Lanes: each of SEEDS 64-bit hashes gives eight.
SEEDS = 8
LANES = SEEDS * 8
MODULUS = 1 << 32
#: A paragraph is a line. Its vector is the sum of the vectors of the line and of its phrases of up to four words.
#: A phrase ends with its line and doesn't hold the line's end, so it depends on the line alone.
PHRASE = r"((?=[^\n])(?:[^ \n]* ){0,3}[^ \n]* ?)"

#: Units of a text that are summed together: 255 * 2^PART_BITS fits a field eight times.
PART_BITS = 19

#: Documents to a range of ids on average, and the most ranges that the driver plans for.
PER_RANGE = 200
MOST_RANGES = 20_000


def units(text: Column) -> Column:
    """What is hashed: the lines of a text and their phrases. An empty text has one empty line."""
    return F.concat(F.split(text, "\n", -1), F.regexp_extract_all(text, F.lit(PHRASE), F.lit(1)))


def lane_sums(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """The keys and lanes: for each key the sums of its texts' vectors, as an array of numbers from -2^31 to 2^31 - 1.

    A lane adds bytes shifted to -128..127, so that the lanes of unrelated
    documents are not alike. Rows of one key add up to the multiset of all their
    paragraphs. Null texts count as empty. Units are rows of a task that are
    summed before anything is shuffled; where the rows already lie by one of the
    keys, nothing is. Two lanes share a sum, in fields of 32 bits; no field runs
    over, as a text's units go into sums of 2^PART_BITS at most, and a key must not
    have more than 8 texts that are so long.
    """
    unit, part, n, hashes = "__fp_unit", "__fp_part", "__fp_n", [f"__fp_hash{seed}" for seed in range(SEEDS)]
    each = rows.select(*keys, F.posexplode(units(F.coalesce(F.col(text_col), F.lit("")))).alias(part, unit))
    each = each.select(*keys, F.shiftright(part, PART_BITS).alias(part), *(F.xxhash64(F.lit(seed), unit).alias(name) for seed, name in enumerate(hashes)))
    packed = lambda i: F.sum(F.shiftright(hashes[i // 4], i % 4 * 8).bitwiseAND(F.lit(0xFF000000FF)))
    sums = each.groupBy(*keys, part).agg(F.count("*").alias(n), *(packed(i).alias(f"__fp_sum{i}") for i in range(LANES // 2)))
    field = lambda i: F.shiftright(f"__fp_sum{i // 8 * 4 + i % 4}", i % 8 // 4 * 32).bitwiseAND(F.lit(MODULUS - 1))
    sums = sums.select(*keys, F.array(*(signed(field(i) - 128 * F.col(n)) for i in range(LANES))).alias("lanes"))
    parts = sums.groupBy(*keys).agg(F.collect_list("lanes").alias("lanes"))
    added = F.reduce(F.slice("lanes", 2, F.size("lanes")), F.get("lanes", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return parts.select(*keys, F.when(F.size("lanes") == 1, F.get("lanes", F.lit(0))).otherwise(F.transform(added, signed)).alias("lanes"))


def signed(value: Column) -> Column:
    """The number modulo 2^32, from -2^31 on."""
    return F.pmod(value + MODULUS // 2, F.lit(MODULUS)) - MODULUS // 2


def as_text(values: Column) -> Column:
    """Lanes as a fingerprint: eight hexadecimal digits each."""
    return F.array_join(F.transform(values, lambda v: F.lower(F.lpad(F.hex(F.pmod(v, F.lit(MODULUS))), 8, "0"))), "")


def from_text(print_: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: signed(F.conv(F.substr(print_, i * 8 + 1, F.lit(8)), 16, 10).cast("long")))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The lanes of two multisets together (sign 1), or of `a` without what `b` holds (sign -1)."""
    return F.zip_with(a, b, lambda x, y: signed(x + y * sign))


def likeness(a: Column, b: Column) -> Column:
    """The cosine of two arrays of lanes, 0 where negative; it estimates how far the multisets agree.

    Equal fingerprints have 1. A fingerprint of zeros is unlike all others.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a == b, 1.0).when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / size)))


def _range_of(id_: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below the id, found in two steps."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    outer = F.array(*(F.lit(g[-1]).cast("long") for g in groups))
    inner = F.array(*(F.array(*(F.lit(b).cast("long") for b in g)) for g in groups))
    group = F.size(F.filter(outer, lambda b: b < id_))
    inside = F.coalesce(F.size(F.filter(F.get(inner, group), lambda b: b < id_)), F.lit(0))
    return F.least(group * step + F.when(group < len(groups), inside).otherwise(0), F.lit(len(bounds) - 1))


#: Columns that with_next uses; those of `docs` with these names are replaced.
RANGE, GUEST, PLACE = "__fp_range", "__fp_guest", "__fp_place"


def _dealt(docs: DataFrame, id_col: str) -> DataFrame:
    """`docs` with RANGE, GUEST and PLACE: ranges of descending ids, each followed by the first row of the next one as a guest.

    So no window spans the table. Rows with one id are ordered by a hash of the
    columns; null ids come last.
    """
    docs = docs.drop(RANGE, GUEST, PLACE)
    key = F.coalesce(F.col(id_col), F.lit(-(2**63)).cast("long"))
    n, top = docs.agg(F.count("*"), F.max(key)).first()
    if not n:
        bounds = [0]
    else:
        count = min(MOST_RANGES, max(1, n // PER_RANGE))
        found = docs.agg(F.percentile_approx(key, [(i + 1) / count for i in range(count)], 10 * count)).first()[0]
        bounds = sorted({*found, top})  # ids of the table, of which the last is the largest
    m = len(bounds)
    own = docs.withColumn(RANGE, _range_of(key, bounds))
    first = F.array_contains(F.array(*(F.lit(b).cast("long") for b in bounds)), key) if m <= 256 else key.isin(bounds)
    places = F.array(F.struct(F.col(RANGE).alias("r"), F.lit(0).alias("guest")))
    guest = F.array(F.struct(F.pmod(F.col(RANGE) + 1, F.lit(m)).alias("r"), F.lit(1).alias("guest")))
    dealt = own.withColumn(PLACE, F.explode(F.when(first, F.concat(places, guest)).otherwise(places)))
    dealt = dealt.withColumns({RANGE: F.col(f"{PLACE}.r"), GUEST: F.col(f"{PLACE}.guest")}).repartition(RANGE)
    by = Window.partitionBy(RANGE).orderBy(GUEST, key.desc(), F.xxhash64(*docs.columns))
    return dealt.withColumn(PLACE, F.row_number().over(by))


def with_next(docs: DataFrame, id_col: str, columns: dict[str, Column]) -> DataFrame:
    """Adds next_<name> for each of `columns`: its value in the row with the next smaller id, after the last the first.

    Rows with one id are ordered by a hash of the columns; null ids come last.
    Columns of `docs` with the new names are replaced.
    """
    by = Window.partitionBy(RANGE).orderBy(PLACE)
    out = _dealt(docs, id_col).withColumns({f"next_{k}": F.lead(v).over(by) for k, v in columns.items()})
    return out.where(F.col(GUEST) == 0).drop(RANGE, GUEST, PLACE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and how far these and the next documents' agree.

    Null texts count as empty. Repeated rows follow each other, null ids come
    last, and other columns are left aside. The texts are shuffled once: all
    later steps keep to the ranges of ids, by which the rows then lie.
    """
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _dealt(docs, "doc_id").withColumn("after", F.lead("text").over(Window.partitionBy(RANGE).orderBy(PLACE)))
    n = F.char_length("text").cast("long")
    rows = rows.withColumns({"n_chars": n, "cut": F.floor(n / 3).cast("int")})
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - F.col("cut")), F.substr("after", F.lit(1), F.col("cut")))
    keys = [RANGE, PLACE, GUEST, "doc_id", "n_chars"]
    rows = rows.select(*keys, "text", edited.alias("edited"))
    both = F.array(*(F.struct(F.lit(k).alias("version"), F.col(c).alias("text")) for k, c in enumerate(("text", "edited"))))
    rows = rows.select(*keys, F.sha2("edited", 256).alias("edited_sha256"), F.explode(both).alias("v"))
    keys += ["edited_sha256", "version"]
    sums = lane_sums(rows.select(*keys[:-1], "v.version", "v.text"), keys, "text")
    # A text, its edited text, the next text: three rows that follow each other.
    order = Window.partitionBy(RANGE).orderBy(PLACE, "version")
    sums = sums.withColumns({"edited_lanes": F.lead("lanes", 1).over(order), "next_lanes": F.lead("lanes", 2).over(order)})
    return sums.where((F.col("version") == 0) & (F.col(GUEST) == 0)).select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("lanes")).alias("fingerprint"),
        as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
