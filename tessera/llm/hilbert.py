"""Operator 5 (native): shards cut from a Hilbert-curve order.

Metadata is quantised to ``BITS`` bits a dimension: hash bins of source and of
lang, and the octave of the text's size.  Cells get their place on the Hilbert
curve; documents are ordered by cell and, within it, by a hash of doc_id; runs
of equal row counts become shards (law ``rows``: counts at most one apart).

No global sort is made: cells (at most 2**(3 * BITS)) are counted, large cells
are divided evenly by hash into bounded ranges, and a document's rank is its
range's start plus its place in the range.  Documents equal in all metadata, however
many, so never meet in one task.

Cases: null text has size 8 and the checksum of the empty text; null source,
lang or doc_id are values of their own; rows that repeat a doc_id are placed by their
checksums too, equal ones in any order; rows without doc_id are placed at random within their cell; an empty table gives no rows; more shards
than rows leave some empty; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import HASH32_SQL, cut, hash32

BITS = 4
DIMENSIONS = 3
SHARDS = 24


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of integer coordinates below 2**bits.

    Reflect and swap axes from the top bit down, Gray-code across axes, then interleave bits.
    Each step is an array in a fold, so the expression stays small.
    """
    n = len(axes)
    at = F.array(*(a.cast("int") for a in axes))

    def spun(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        own, head, low = F.element_at(x, i + 1), F.element_at(x, 1), q - 1
        swap = head.bitwiseXOR(own).bitwiseAND(low)
        flip = own.bitwiseAND(q) != 0
        return F.transform(x, lambda v, k: F.when(flip, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)).when((k == 0) | (k == i), F.when(i == 0, v).otherwise(v.bitwiseXOR(swap))).otherwise(v))

    steps = F.array(*(F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)))
    at = F.aggregate(steps, at, spun)
    at = F.transform(at, lambda _, k: F.aggregate(F.slice(at, 1, k + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))
    flips = F.aggregate(F.array(*(F.lit(1 << b) for b in range(bits - 1, 0, -1))), F.lit(0), lambda a, q: F.when(F.element_at(at, n).bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a))
    order = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)))
    packed = F.array(F.struct(at.alias("x"), flips.alias("f")))

    def bit(p: Column, o: Column) -> Column:
        return F.call_function("shiftright", F.element_at(p["x"], o["i"] + 1).bitwiseXOR(p["f"]), o["b"]).bitwiseAND(1)

    return F.element_at(F.transform(packed, lambda p: F.aggregate(order, F.lit(0), lambda a, o: F.shiftleft(a, 1) + bit(p, o))), 1)


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the three quantised coordinates."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = (F.octet_length(text) + 8).cast("long")
    bins = 1 << BITS

    def bin_of(name: str) -> Column:
        value = F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")
        return (hash32(F.coalesce(F.concat(F.lit("="), value), F.lit("null"))) % bins).cast("int")

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("lone"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        bin_of("source").alias("x"),
        F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.length(F.bin(size)) - 5)).cast("int").alias("y"),
        bin_of("lang").alias("z"),
    )


def hilbert_shards(docs: DataFrame, *, shards: int = SHARDS, least_range: int = 256, most_ranges: int = 1 << 16) -> DataFrame:
    """Adds to each document's metadata: curve (its place on the curve), shard and slot."""
    rows = cut(metadata(docs))  # texts are read once, then a few numbers a row
    # Cells: a bounded table, so its windows without keys and its broadcast are bounded too.
    cells = rows.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n")).withColumn("curve", hilbert_index([F.col("x"), F.col("y"), F.col("z")]))
    everything = Window.orderBy("curve")
    whole = Window.partitionBy(F.lit(0))
    cells = cells.select("x", "y", "z", "curve", (F.sum("n").over(everything) - F.col("n")).alias("first"), F.sum("n").over(whole).alias("total"), "n")
    target = F.greatest(F.lit(least_range), F.ceil(F.col("total") / most_ranges))
    cells = cells.withColumn("ranges", F.ceil(F.col("n") / target).cast("long"))
    mixed = hash32(F.lit("place"), "doc_id", "lone", "text_crc32")
    placed = rows.withColumn("mixed", mixed).join(F.broadcast(cells), ["x", "y", "z"]).withColumn("part", F.shiftright(F.col("mixed") * F.col("ranges"), 32))
    counts = placed.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("held"), F.first("first").alias("first"))
    in_cell = Window.partitionBy("curve").orderBy("part")
    begins = counts.select("curve", "part", (F.col("first") + F.sum("held").over(in_cell) - F.col("held")).alias("begin"))
    in_range = Window.partitionBy("curve", "part").orderBy("mixed", "doc_id", "lone", "text_crc32", "size")
    ranked = placed.withColumn("place", F.row_number().over(in_range) - 1).join(begins, ["curve", "part"]).withColumn("rank", F.col("begin") + F.col("place"))
    each, extra = F.expr(f"total div {shards}"), F.col("total") % shards
    large = extra * (each + 1)
    shard = F.when(F.col("rank") < large, F.expr(f"rank div (total div {shards} + 1)")).otherwise(extra + F.expr(f"(rank - (total % {shards}) * (total div {shards} + 1)) div greatest(total div {shards}, 1)"))
    out = ranked.withColumn("shard", shard.cast("int"))
    slot = F.when(F.col("shard") < extra, F.col("rank") - F.col("shard") * (each + 1)).otherwise(F.col("rank") - large - (F.col("shard") - extra) * each)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("curve").cast("int").alias("curve"))


def write_shards(docs: DataFrame, path: str, *, shards: int = SHARDS) -> DataFrame:
    """Writes documents under file_shard=k, in slot order, and gives each shard's manifest
    (rows, bytes, least and greatest curve place, size and, where docs have them, source and lang) for file pruning.

    Files hold the documents' columns in a struct ``row`` beside slot, curve and size.  Documents must have distinct ids
    here, as rows are matched to shards by doc_id."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    shard_of = hilbert_shards(docs, shards=shards).select(F.col("doc_id").alias("id"), F.col("shard").alias("file_shard"), "slot", "curve", "size")
    placed = keyed.join(shard_of, "id").drop("id")
    placed.repartition("file_shard", F.shiftright("slot", 20)).sortWithinPartitions("file_shard", "slot").write.partitionBy("file_shard").parquet(path)
    ends = [f(c).alias(f"{n}_{c.removeprefix('row.')}") for c in ("curve", "size", *(f"row.{x}" for x in ("source", "lang") if x in docs.columns)) for n, f in (("least", F.min), ("most", F.max))]
    return docs.sparkSession.read.parquet(path).groupBy("file_shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *ends)


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_NAMES = ("a", "b", "c")


def _curve_sql(source: str, bits: int = BITS) -> str:
    """Common table expressions from ``source`` (columns a, b, c) to ``curves`` with its place on the curve: a step of ``hilbert_index`` each."""
    steps, at = [], source
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i, own in enumerate(_NAMES):
            changed = [f"CASE WHEN {own} & {q} <> 0 THEN xor(a, {q - 1}) ELSE xor(a, xor(a, {own}) & {q - 1}) END AS a"]
            changed += [f"CASE WHEN {own} & {q} <> 0 THEN {own} ELSE xor({own}, xor(a, {own}) & {q - 1}) END AS {own}"] if i else []
            steps.append(f"h{q}{own} AS (SELECT * REPLACE ({', '.join(changed)}) FROM {at})")
            at = f"h{q}{own}"
    gray = f"gray AS (SELECT * REPLACE (xor(a, b) AS b, xor(xor(a, b), c) AS c) FROM {at})"
    flips = "0"
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flips = f"xor({flips}, CASE WHEN c & {q} <> 0 THEN {q - 1} ELSE 0 END)"
    place = " + ".join(f"(((xor({n}, {flips}) >> {b}) & 1) << {3 * b + 2 - i})" for b in range(bits) for i, n in enumerate(_NAMES))
    return ", ".join([*steps, gray, f"curves AS (SELECT *, {place} AS curve FROM gray)"])


def _oracle(shards: int = SHARDS, bits: int = BITS) -> str:
    def bin_of(name: str) -> str:
        hashed = HASH32_SQL.format(f"coalesce('=' || {name}, 'null')")
        return f"{hashed} % {1 << bits}"

    return f"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
m AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {bin_of("source")} AS a, {bin_of("lang")} AS c,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM documents, t
), d AS (SELECT *, least({(1 << bits) - 1}, greatest(0, floor(log2(size))::BIGINT - 4)) AS b FROM m),
{_curve_sql("d", bits)},
r AS (SELECT *, row_number() OVER (ORDER BY curve, {HASH32_SQL.format("'place|' || doc_id || '|' || text_crc32")}, doc_id, text_crc32, size) - 1 AS rank, count(*) OVER () AS n FROM curves),
s AS (SELECT *, CASE WHEN rank < n % {shards} * (n // {shards} + 1) THEN rank // (n // {shards} + 1) ELSE n % {shards} + (rank - n % {shards} * (n // {shards} + 1)) // greatest(n // {shards}, 1) END AS shard FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY rank) - 1 AS slot, NULL::INTEGER AS grown_shard, curve::INTEGER AS curve FROM s
"""


ORACLE = _oracle()
