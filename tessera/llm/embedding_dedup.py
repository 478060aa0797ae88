"""Operator 7: embedding near-dedup in spherical k-means cells.

1. Equal vectors form a class, which the least vec_id stands for.
2. Spherical k-means is fitted on a bounded sample (``SAMPLE`` classes by hash of
   id, at most ``MOST_CELLS`` cells); every class is assigned to its home cell.  A class also probes each
   earlier cell that a partner may have for its home: partners are at most the angle
   arccos(``LEAST``) apart, so a cell behind a farther bisector holds none.  No link is lost to
   cells; how many cells are probed depends on how well the vectors cluster.
3. The home members of a cell are compared with each other and with the cell's probes, in blocks by
   hash (``block_rows``: about 4 MB of components).  A block pair first bounds all its cosines: a vector is cut
   down to its part along the ``LEAD`` main axes of the sample and the length of the rest, and the product of
   two such short vectors is never below the cosine.  Only pairs whose bound reaches ``LEAST`` get
   their cosine.  A block pair reports sums of links and a spanning forest, never the pairs.
4. Components come from the forests; one vector of each is kept.

Cosines are in double precision over all rows, whatever their labels.  Cases: vectors that are null, empty,
zero or hold null or non-finite components link with nothing, are their own component and kept;
vectors of different lengths don't link; null vec_id links with nothing, has a null component and is kept;
rows that repeat a vec_id share a node, and equal rows count as links of each other; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, map_arrow, spread
from tessera.llm.graph import components

LEAST = 0.95
SAMPLE = 20_000
ROWS_A_CELL = 8192
LEAST_CELLS = 8
MOST_CELLS = 4096
LEAD = 16
SLACK = 1e-5  # bounds are in single precision, whose error on unit vectors is far smaller
TILE = 256


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centres of unit rows; starts from rows far from those already chosen."""
    rng = np.random.default_rng(7)
    centres = [rows[0]]
    far = 1 - rows @ rows[0]
    for _ in range(k - 1):
        weight = np.maximum(far, 0)
        pick = int(rng.choice(len(rows), p=weight / weight.sum())) if weight.sum() > 1e-9 else int(rng.integers(len(rows)))
        centres.append(rows[pick])
        far = np.minimum(far, 1 - rows @ rows[pick])
    c = np.array(centres)
    for _ in range(rounds):
        home = np.concatenate([(rows[a : a + TILE] @ c.T).argmax(axis=1) for a in range(0, len(rows), TILE)])
        sums = np.zeros_like(c)
        np.add.at(sums, home, rows)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), c)
    return c


def unit(raw: list[bytes], size: int) -> np.ndarray:
    """Unit rows in double precision from components stored as doubles, or as floats where that is exact."""
    kinds = [x if len(x) == 8 * size else np.frombuffer(x, "<f4").astype("<f8").tobytes() for x in raw] if any(len(x) == 8 * size for x in raw) else None
    rows = np.frombuffer(b"".join(raw), "<f4").astype(np.float64).reshape(-1, size) if kinds is None else np.frombuffer(b"".join(kinds), "<f8").reshape(-1, size)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def main_axes(rows: np.ndarray, n: int = LEAD) -> np.ndarray:
    """The n orthonormal axes that hold most of the rows' squared length, as columns."""
    return np.linalg.eigh(rows.T @ rows)[1][:, ::-1][:, :n]


def shortened(x: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    """Unit rows as their part along the axes (null: the first coordinates) and the length of the rest.

    By Cauchy-Schwarz the product of two shortened rows is never below that of the rows."""
    head = x[:, :LEAD] if axes is None else x @ axes
    rest = np.sqrt(np.maximum(0, 1 - (head * head).sum(axis=1, keepdims=True)))
    return np.concatenate([head, rest], axis=1).astype(np.float32)


def narrow(x: np.ndarray) -> bool:
    with np.errstate(over="ignore"):
        return bool((x.astype(np.float32).astype(np.float64) == x).all())


def describe(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and raw (the components' bytes; both null for vectors that can't link)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            dims, raws = [], []
            for v in batch.column(1):
                x = np.array(v.as_py() if v.is_valid else [], np.float64)  # null components become nan
                good = len(x) > 0 and np.isfinite(x).all() and x.any()
                dims.append(len(x) if good else None)
                raws.append((x.astype("<f4") if good and narrow(x) else x.astype("<f8")).tobytes() if good else None)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], names=["vec_id", "dim", "raw"])

        return step

    return map_arrow(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")), make, "vec_id long, dim int, raw binary")


def assign(reps: DataFrame, centres: np.ndarray, least: float) -> DataFrame:
    """node, n, dim, raw, home, probes: the cell of each class and the earlier cells it probes."""
    reach = float(np.sqrt(max(0.0, 1 - least * least))) if least > 0 else 2.0
    gaps = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))
    size = centres.shape[1]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            dims = batch.column("dim").to_numpy()
            homes = -dims.astype(np.int32)  # other lengths: one cell each, divided in blocks as any
            probes: list[list[int]] = [[] for _ in dims]
            own = np.flatnonzero(dims == size)
            if len(own):
                rows = unit(batch.column("raw").take(pa.array(own)).to_pylist(), size)
                for a in range(0, len(own), TILE):
                    at = own[a : a + TILE]
                    sims = rows[a : a + TILE] @ centres.T
                    home = sims.argmax(axis=1)
                    homes[at] = home
                    near = (sims[np.arange(len(at)), home][:, None] - sims) <= reach * gaps[home] + 1e-9
                    near &= np.arange(len(centres)) < home[:, None]
                    for k, row in zip(at.tolist(), near):
                        probes[k] = np.flatnonzero(row).tolist()
            columns = [batch.column(c) for c in ("node", "n", "dim", "raw")]
            return pa.RecordBatch.from_arrays([*columns, pa.array(homes), pa.array(probes, pa.list_(pa.int32()))], names=["node", "n", "dim", "raw", "home", "probes"])

        return step

    return map_arrow(reps, make, "node long, n long, dim int, raw binary, home int, probes array<int>")


def block_rows(dim: Column) -> Column:
    return F.least(F.lit(8192), F.greatest(F.lit(256), F.floor(F.lit(1 << 19) / dim)))


def meetings(placed: DataFrame) -> DataFrame:
    """cell, kind, i, j, side and the class: every block pair that must be compared."""
    blocks = F.ceil(F.count(F.lit(1)) / block_rows(F.max("dim")))
    homes = placed.groupBy(F.col("home").alias("cell")).agg(blocks.alias("hb"))
    probed = placed.select("dim", F.explode("probes").alias("cell")).groupBy("cell").agg(blocks.alias("pb"))
    sizes = cut(homes.join(probed, "cell", "left").select("cell", "hb", F.coalesce("pb", F.lit(0).cast("long")).alias("pb")))
    own = placed.withColumnRenamed("home", "cell").join(sizes, "cell").withColumn("b", spread(F.col("node"), F.col("hb")))

    def upto(n: str) -> Column:
        return F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.greatest(F.col(n) - 1, F.lit(0).cast("long")))).otherwise(F.array().cast("array<bigint>"))

    names = ["cell", "kind", "i", "j", "side", "node", "n", "dim", "raw"]
    inside = own.withColumn("o", F.explode(upto("hb"))).withColumns({"kind": F.lit("h"), "i": F.least("b", "o"), "j": F.greatest("b", "o"), "side": (F.col("b") > F.col("o")).cast("int")}).select(*names)
    facing = own.withColumn("o", F.explode(upto("pb"))).withColumns({"kind": F.lit("p"), "i": F.col("b"), "j": F.col("o"), "side": F.lit(0)}).select(*names)
    guests = placed.withColumn("cell", F.explode("probes")).join(sizes, "cell").withColumn("b", spread(F.col("node"), F.col("pb"))).withColumn("o", F.explode(upto("hb")))
    guests = guests.withColumns({"kind": F.lit("p"), "i": F.col("o"), "j": F.col("b"), "side": F.lit(1)}).select(*names)
    return inside.unionByName(facing).unionByName(guests)


def linked_pairs(x: np.ndarray, short: np.ndarray, here: np.ndarray, there: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in x) of the pairs of a row here and a row there with a cosine of at least ``least``."""
    maybe = short[here] @ short[there].T >= least - SLACK
    r, c = np.nonzero(maybe)
    if len(r) * 8 > maybe.size:  # so many that one product costs less
        r, c = np.nonzero(maybe & (x[here] @ x[there].T >= least))
        return here[r], there[c]
    step = max(1, (1 << 21) // x.shape[1])
    sure = [np.einsum("ij,ij->i", x[here[r[a : a + step]]], x[there[c[a : a + step]]]) >= least for a in range(0, len(r), step)]
    good = np.concatenate(sure) if sure else np.zeros(0, bool)
    return here[r[good]], there[c[good]]


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each place's least place reachable, after links a-b join those of ``root``."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def compare(group: pa.Table, least: float = LEAST, axes: np.ndarray | None = None) -> pa.Table:
    """Links of one block pair: for each linked node its sum of links and its tree's root."""
    size = group["dim"][0].as_py()
    x = unit(group["raw"].to_pylist(), size)
    short = shortened(x, axes if axes is not None and len(axes) == size else None)
    side, n, nodes = group["side"].to_numpy(), group["n"].to_numpy(), group["node"].to_numpy()
    whole = len(np.unique(side)) == 1 and group["kind"][0].as_py() == "h"
    sums, root = np.zeros(len(x), np.int64), np.arange(len(x))
    first, second = (np.arange(len(x)),) * 2 if whole else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for a in range(0, len(first), TILE):
        i, j = linked_pairs(x, short, first[a : a + TILE], second[a:] if whole else second, least)
        if whole:
            i, j = i[i < j], j[i < j]
        np.add.at(sums, i, n[j])
        np.add.at(sums, j, n[i])
        root = joined(root, i, j)
    linked = np.flatnonzero(sums)
    return pa.table({"node": nodes[linked], "links": sums[linked], "root": nodes[root[linked]]})


def near_duplicates(vectors: DataFrame, *, least: float = LEAST, rows_a_cell: int = ROWS_A_CELL) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    base = cut(describe(vectors).withColumn("key", F.sha2("raw", 256)))
    good = base.where("vec_id IS NOT NULL AND dim IS NOT NULL")
    classes = cut(good.groupBy("dim", "key").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")))
    reps = cut(classes.join(good.select("vec_id", "dim", "key", "raw").alias("g"), ["dim", "key"]).where("vec_id = node").select("node", "n", "dim", "raw").dropDuplicates(["node", "raw"]))
    ids = good.select("vec_id", "dim", "key").join(classes, ["dim", "key"])
    count = reps.count()
    if count:
        usual = reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()["dim"]
        some = reps.where(F.col("dim") == usual).orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("raw").toPandas()["raw"].tolist()
        sample = unit([bytes(r) for r in some], usual)
        centres = spherical_kmeans(sample, max(1, min(MOST_CELLS, len(sample), max(LEAST_CELLS, -(-count // rows_a_cell)))))
        axes = main_axes(sample)
        placed = cut(assign(reps, centres, least))

        def run(key: tuple, group: pa.Table) -> pa.Table:
            return compare(group, least, axes)

        found = cut(meetings(placed).groupBy("cell", "kind", "i", "j").applyInArrow(run, "node long, links long, root long"))
        linked = cut(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        sums = cut(found.groupBy("node").agg(F.sum("links").alias("links")))
        ids = ids.join(sums, "node", "left").join(linked, "node", "left")
    else:
        ids = ids.withColumns({"links": F.lit(0).cast("long"), "component": F.lit(None).cast("long")})
    linked_rows = ids.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    alone = base.where("vec_id IS NULL OR dim IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_spherical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {LEAST}
), r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)
"""
