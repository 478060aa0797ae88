"""Operator 4: near-duplicates by a signature-coordinate inverted join.

1. Each text's set of five-word shingles gives a digest and ``COORDINATES`` MinHash values.
   Rows with equal sets form a class, which is a node of its own.
2. A class is posted under its (coordinate, value) pairs.  Pairs that no other class
   has are dropped; a class with fewer than ``MATCH`` shared ones can't have
   ``MATCH`` collisions with any other.  Of the rest, only a prefix in order of rising
   frequency is posted: two classes with MATCH collisions meet in the prefixes.
3. A list is open while its classes are of different components.  For lists with more than ``LONG`` minor
   classes (see 4) rounds of leaders go first, as long as each halves what is open: one class of each list leads, every other
   follows the leader it has most collisions with, and pairs similar on full sets are joined.
4. What stays open is compared for good.  All classes of a list but those of its largest component
   are its minor ones.  Minor classes that share a long list, their home, form groups of bounded size; a group is
   compared with all classes that share a list with its home, once, however many lists they share.
   Comparing is: collisions of signatures, pairs below MATCH dropped, the rest confirmed on full sets
   unless joined already; a group reports only links that join components.
   No list is capped, and no list's pairs are written out.

A linked pair at similarity 0.75 has fewer than MATCH of COORDINATES collisions with
probability 1e-6 (``miss_probability``); that is the only way to lose a link.

Cases: null or empty text, or text without words, has an empty set and no links;
fewer than five words count as one shingle; rows that repeat a doc_id with another text are documents of
their own; null doc_id links with nothing, has a null component and is kept; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, cut, drop_encoders, map_arrow, sieve, sifted, spread, strings
from tessera.llm.graph import star_forest
from tessera.llm.words import _U, groups, hash_words, mix, shingles

SHINGLE = 5
COORDINATES = 48
MATCH = 21
SIMILAR = 75  # per cent
LONG = 2048  # minor classes of a list from which on leaders go first
HEADS = 256  # minor classes of a group, about
HEAD_ITEMS = 1 << 21  # and their shingles, about
MEMBERS = 2048  # others that a task compares with them, about


def miss_probability(similarity: float = 0.75, coordinates: int = COORDINATES, match: int = MATCH) -> float:
    return sum(comb(coordinates, i) * similarity**i * (1 - similarity) ** (coordinates - i) for i in range(match))


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * k + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return seeds[:k] | _U(1), seeds[k:]


def signature(items: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """k MinHash values of a non-empty set of 64-bit hashes, as int32."""
    a, b = _coefficients(k)
    least = np.full(k, np.iinfo(np.uint64).max, _U)
    for at in range(0, len(items), 2048):
        least = np.minimum(least, (a[:, None] * items[at : at + 2048] + b[:, None]).min(axis=1))
    return (least >> _U(32)).astype(np.uint32).view(np.int32)


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text; A-Z count as a-z."""
    parts = [t.encode().lower() for t in texts]
    for at, end, data, starts in groups(parts):
        words, where = hash_words(data)
        bounds = np.append(np.searchsorted(where, starts), len(words))
        for k in range(end - at):
            yield shingles(words[bounds[k] : bounds[k + 1]], SHINGLE)


def similar(a: np.ndarray, b: np.ndarray, per_cent: int = SIMILAR) -> bool:
    """100 * intersection >= per_cent * union, of sorted distinct hashes."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < per_cent * large:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= per_cent * (small + large - common)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, digest of the set, and its signature (null for an empty set)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, digests, values = [], [], []
            for items in shingle_sets(strings(batch.column("text")).to_pylist()):
                sizes.append(len(items))
                digests.append(hashlib.blake2b(items, digest_size=16).digest() if len(items) else None)
                values.append(signature(items) if len(items) else None)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(values, pa.list_(pa.int32()))], names=["doc_id", "text_key", "n_shingles", "digest", "sig"])

        return step

    return map_arrow(_texts(docs), make, "doc_id long, text_key long, n_shingles long, digest binary, sig array<int>")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def prefix_postings(classes: DataFrame, work: Workspace) -> DataFrame:
    """token, node: the posting lists of prefixes.  classes: node, sig."""
    tokens = classes.select("node", F.posexplode("sig").alias("i", "v")).select("node", F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(0xFFFFFFFF)).alias("token"))
    shared = work.put(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    own = Window.partitionBy("node")
    ranked = tokens.join(shared, "token").withColumns({"c": F.count(F.lit(1)).over(own), "r": F.row_number().over(own.orderBy("df", "token"))})
    postings = work.put(ranked.where(f"c >= {MATCH} AND r <= c - {MATCH - 1}").select("token", "node"))
    work.drop(shared)
    return postings


def open_lists(postings: DataFrame, work: Workspace) -> DataFrame:
    """token, node, part, minor, n, minors: the lists whose classes are of different components, with their classes and minor classes.  postings: token, node, part."""
    counts = postings.groupBy("token", "part").agg(F.count(F.lit(1)).alias("n"))
    tops = work.put(counts.groupBy("token").agg(F.max(F.struct("n", F.negative("part").alias("p"))).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("token", (-F.col("top.p")).alias("top"), "n", (F.col("n") - F.col("top.n")).alias("minors")))
    found = work.put(postings.join(tops, "token").select("token", "node", "part", (F.col("part") != F.col("top")).alias("minor"), "n", "minors"))
    work.drop(tops)
    return found


def minor_homes(opened: DataFrame, classes: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """opened with home, bucket and k of a class that is minor in any list (else null): the group that it is a head of,
    and the buckets of its home.

    A class's home is its longest list; then the home that most others of its lists have, so that few homes share a list."""
    minors = opened.where("minor").select("token", "node", "n")
    first = work.put(minors.groupBy("node").agg(F.max(F.struct("n", "token")).getField("token").alias("home")))
    held = work.put(first.groupBy("home").agg(F.count(F.lit(1)).alias("held")))
    usual = work.put(minors.join(first.join(held, "home"), "node").groupBy("token").agg(F.max(F.struct("held", "home")).alias("usual")))
    homes = minors.join(usual, "token").groupBy("node").agg(F.max("usual").getField("home").alias("home"))
    homes = work.put(homes.join(classes.select("node", "n_shingles"), "node"))
    sizes = work.put(homes.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / HEADS), F.ceil(F.sum("n_shingles") / HEAD_ITEMS)).alias("k")))
    heads = homes.join(sizes, "home").select("node", "home", spread(F.col("node"), F.col("k")).alias("bucket"), "k")
    grouped = work.put(opened.join(heads, "node", "left"))
    work.drop(first, held, usual, homes)
    return grouped, sizes


def group_members(grouped: DataFrame, sizes: DataFrame, work: Workspace) -> DataFrame:
    """home, node, part, head, bucket: the heads of each group (home, bucket); with bucket null, classes that all
    groups of the home must be compared with.

    Two minor classes of a list with different homes meet at one of these only."""
    meets = work.put(grouped.where("minor").select("token", F.col("home").alias("at")).distinct())
    others = grouped.join(meets, "token").where("home IS NULL OR (minor AND home > at) OR (NOT minor AND home <> at)").select(F.col("at").alias("home"), "node", "part", F.lit(None).cast("long").alias("bucket")).distinct()
    heads = grouped.where("home IS NOT NULL").select("home", "node", "part", "bucket").distinct()
    found = work.put(others.unionByName(heads).join(sizes, "home"))
    work.drop(meets)
    return found


def followers(opened: DataFrame, classes: DataFrame, work: Workspace) -> DataFrame:
    """home, node, part, bucket, k: each list's leader (a head), and the classes that follow it because no other leader of theirs has more collisions with them."""
    weights = opened.where("minor").groupBy("node").agg(F.sum("n").alias("weight"))  # what most share, the middle of a group of copies has
    leaders = opened.where("minor").join(weights, "node").groupBy("token").agg(F.max_by(F.struct("node", "part"), F.struct("weight", "node")).alias("a"))
    leaders = work.put(leaders.select("token", F.col("a.node").alias("lead"), F.col("a.part").alias("lead_part")))
    pairs = opened.join(leaders, "token").where("part <> lead_part").select("node", "part", "lead", "lead_part").distinct()
    signs = classes.select("node", "sig")
    both = pairs.join(signs.select(F.col("node").alias("lead"), F.col("sig").alias("lead_sig")), "lead").join(signs, "node")
    hits = F.size(F.filter(F.zip_with("sig", "lead_sig", lambda x, y: x == y), lambda same: same))
    best = work.put(both.withColumn("hits", hits).where(f"hits >= {MATCH}").groupBy("node", "part").agg(F.max_by(F.struct("lead", "lead_part"), F.struct("hits", "lead")).alias("a")))
    followed = best.select(F.col("a.lead").alias("home"), "node", "part", F.lit(None).cast("long").alias("bucket"), F.lit(1).cast("long").alias("k"))
    heads = best.select(F.col("a.lead").alias("home"), F.col("a.lead").alias("node"), F.col("a.lead_part").alias("part"), F.lit(0).cast("long").alias("bucket"), F.lit(1).cast("long").alias("k")).distinct()
    found = work.put(followed.unionByName(heads))
    work.drop(leaders, best)
    return found


def full_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, work: Workspace) -> DataFrame:
    """node, sig and items (the sorted shingle hashes as bytes) of the given nodes; only texts that the sieve lets pass are shuffled."""
    wanted = work.put(classes.join(nodes.select("node").distinct(), "node").select("node", "doc_id", "text_key", "sig"))
    rows = sieve(F.struct("doc_id", "text_key"), wanted)
    texts = sifted(_texts(docs), F.struct("doc_id", "text_key"), rows, "passed").where("passed").groupBy("doc_id", "text_key").agg(F.first("text").alias("text"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            items = [s.tobytes() for s in shingle_sets(strings(batch.column("text")).to_pylist())]
            return pa.RecordBatch.from_arrays([batch.column("node"), batch.column("sig"), pa.array(items, pa.large_binary()).cast(pa.binary())], names=["node", "sig", "items"])

        return step

    found = work.put(map_arrow(texts.join(wanted, ["doc_id", "text_key"]).select("node", "sig", "text"), make, "node long, sig array<int>, items binary"))
    work.drop(wanted)
    return found


class Group:
    """Heads and others of one group: finds the links that join components."""

    def __init__(self) -> None:
        self.signs = np.zeros((16, COORDINATES), np.int32)
        self.sets: list[np.ndarray] = []
        self.parts: list[int] = []
        self.root: dict[int, int] = {}

    def find(self, part: int) -> int:
        root = self.root
        while (up := root.setdefault(part, part)) != part:
            root[part] = part = root[up]
        return part

    def meet(self, part: int, sign: np.ndarray, items: np.ndarray, head: bool) -> None:
        n = len(self.sets)
        hits = (self.signs[:n] == sign).sum(axis=1)
        near = np.flatnonzero(hits >= MATCH)
        for k in near[np.argsort(-hits[near], kind="stable")].tolist():
            a, b = self.find(part), self.find(self.parts[k])
            if a != b and similar(self.sets[k], items):
                self.root[max(a, b)] = min(a, b)
        if head:
            if n == len(self.signs):
                self.signs = np.concatenate([self.signs, np.zeros_like(self.signs)])
            self.signs[n] = sign
            self.sets.append(items)
            self.parts.append(part)

    def links(self) -> list[tuple[int, int]]:
        return [(top, p) for p in list(self.root) if (top := self.find(p)) != p]


def confirmed(members: DataFrame, sets: DataFrame, work: Workspace) -> DataFrame:
    """a, b: links between parts.  members: home, node, part, bucket, k.

    A task has the heads of a group and a bounded share of what they are compared with; heads of later buckets are among that."""
    sizes = work.put(members.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("subs")))
    placed = members.join(sizes, "home")
    zero = F.lit(0).cast("long")
    before = F.when(F.coalesce("bucket", "k") > 0, F.sequence(zero, F.coalesce("bucket", "k") - 1)).otherwise(F.array().cast("array<bigint>"))
    met = placed.select("home", F.explode(before).alias("to"), spread(F.col("node"), F.col("subs")).alias("sub"), "node", "part", F.lit(False).alias("head"))
    heads = placed.where("bucket IS NOT NULL").select("home", F.col("bucket").alias("to"), F.explode(F.sequence(zero, F.col("subs") - 1)).alias("sub"), "node", "part", F.lit(True).alias("head"))
    dealt = met.unionByName(heads).select(F.xxhash64("home", "to", "sub").alias("g"), "node", "part", "head")
    met = dealt.join(sets, "node").repartition("g").sortWithinPartitions("g", F.desc("head"), "node")

    def run(batches):
        drop_encoders()
        key, group = None, Group()

        def flush():
            if found := group.links():
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            signs = np.asarray(batch.column("sig").flatten()).reshape(-1, COORDINATES)
            for k, (g, part, head) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "part", "head")))):
                if key != g:
                    yield from flush()
                    key, group = g, Group()
                group.meet(part, signs[k], np.frombuffer(batch.column("items")[k].as_buffer(), _U), head)
        yield from flush()

    links = work.put(met.mapInArrow(run, "a long, b long"))
    work.drop(sizes)
    return links


def class_links(docs: DataFrame, classes: DataFrame, work: Workspace) -> DataFrame:
    """a, b: links that span the components of classes (node, doc_id, text_key, n_shingles, sig)."""
    postings = prefix_postings(classes, work).withColumn("part", F.col("node"))
    opened = open_lists(postings, work)
    sets = full_sets(docs, classes, opened, work)
    links, before = None, None
    while True:
        long = opened.where(f"minors > {LONG}")
        pressing = long.where("minor").count()
        if not pressing or (before is not None and 2 * pressing > before):
            break
        # A long list costs its length for each group of its minor classes: leaders go first while they halve these.
        led = confirmed(followers(long, classes, work), sets, work)
        links = led if links is None else work.put(links.unionByName(led))
        renamed = star_forest(led, work).withColumnRenamed("node", "part")
        opened = open_lists(opened.select("token", "node", "part").join(renamed, "part", "left").select("token", "node", F.coalesce("component", "part").alias("part")), work)
        before = pressing
    last = confirmed(group_members(*minor_homes(opened, classes, work), work), sets, work)
    return last if links is None else links.unionByName(last)


def verdicts(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, text_key, n_shingles and head of every row of docs: the least (doc_id, text_key) of its component; null where nothing links."""
    base = work.put(describe(docs))
    some = base.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    least = some.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("head"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = work.put(least.select(F.monotonically_increasing_id().alias("node"), "digest", "head.doc_id", "head.text_key", "n_shingles", "sig"))
    stars = star_forest(class_links(docs, classes, work), work)
    named = classes.join(stars, "node", "left").select("digest", F.coalesce("component", "node").alias("component"), F.struct("doc_id", "text_key").alias("head"))
    heads = work.put(named.groupBy("component").agg(F.min("head").alias("head")))
    placed = named.select("digest", "component").join(heads, "component").select("digest", "head")
    return base.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(placed, "digest", "left").select("doc_id", "text_key", "n_shingles", "head")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    with Workspace(docs.sparkSession, "near_duplicates") as work:
        rows = verdicts(docs, work).withColumn("component_id", F.coalesce("head.doc_id", "doc_id"))
        return cut(rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, all columns as they were: that of the least doc_id (of several, the least text
    hash; of equal rows, any).  Rows without doc_id or words stay.

    Texts that may belong to a row that goes are shuffled; the others stay where they are read."""
    with Workspace(docs.sparkSession, "distinct_documents") as work:
        rows = verdicts(docs, work).where("head IS NOT NULL")
        known = rows.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"), F.bool_or((F.col("head.doc_id") != F.col("doc_id")) | (F.col("head.text_key") != F.col("text_key"))).alias("goes"))
        marked = cut(known.where("goes OR n > 1").select("doc_id", "text_key", "goes"))
        bits = cut(sieve(F.struct("doc_id", "text_key"), marked))
    names = docs.columns
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    whole = sifted(whole, F.struct("doc_id", "text_key"), bits, "passed")
    met = whole.where("passed").select("doc_id", "text_key", "row").join(marked, ["doc_id", "text_key"], "left")
    once = met.where("NOT goes").groupBy("doc_id", "text_key").agg(F.first("row").alias("row"))
    return whole.where("NOT passed").select("row.*").union(met.where("goes IS NULL").select("row.*")).union(once.select("row.*"))


def op4_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, ws[i:i + {SHINGLE - 1}] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {SHINGLE - 2})) AS i FROM w WHERE len(ws) >= {SHINGLE})
  UNION ALL SELECT doc_id, ws FROM w WHERE len(ws) BETWEEN 1 AND {SHINGLE - 1}
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {SIMILAR} * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
