"""Cosine retrieval over an array column, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators.lexical import DIGITS, top_k
from tessera.params import DEFAULTS, Params
from tessera.sources import tables

QUERIES_AT_ONCE = 4096
MOST_HITS = 1 << 19


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """The unit vector in double precision; zero vectors stay zero."""
    return F.transform(F.transform(F.array(v), lambda w: F.struct(w.alias("w"), norm(w).alias("n")))[0]["w"], lambda x: F.when(norm(v) > 0, x.cast("double") / norm(v)).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns; 0 if either is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size).otherwise(F.lit(0.0))


def checked(vectors: DataFrame, params: Params = DEFAULTS, *, column: str = "embedding") -> DataFrame:
    """Raises at run time on a vector whose size isn't params.embedding_dim."""
    if params.embedding_dim is None:
        return vectors
    good = F.size(column) == params.embedding_dim
    message = F.concat(F.lit("vector of size "), F.size(column), F.lit(f", expected {params.embedding_dim}"))
    return vectors.withColumn(column, F.when(F.col(column).isNull() | good, F.col(column)).otherwise(F.raise_error(message).cast("array<float>")))


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, params: Params = DEFAULTS, *, id_col: str = "id") -> DataFrame:
    """query_id, id, score, rank: the k best vectors of each query by brute force.

    Queries, a stated set, go in blocks of QUERIES_AT_ONCE as a matrix; vectors are multiplied with it a few at a time, so that a task
    holds about MOST_CELLS cosines at once, and a task leaves at most k rows a query for the final ranking.
    Null vectors are left out; with k of 0 or less, or without queries, there is no row.
    """
    schema = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(vectors.dtypes)[id_col]}, score double"
    if k <= 0:
        return top_k(vectors.sparkSession.createDataFrame([], schema), 0)
    rows = checked(vectors, params).where("embedding IS NOT NULL").select(F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = checked(queries, params).where("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    query_type = to_arrow_type(queries.schema["query_id"].dataType)
    found, block = None, []
    for row in asked.toLocalIterator():
        block.append(row)
        if len(block) == QUERIES_AT_ONCE:
            part, block = rows.mapInArrow(_scorer(block, query_type, k), schema), []
            found = part if found is None else found.unionByName(part)
    if block:
        part = rows.mapInArrow(_scorer(block, query_type, k), schema)
        found = part if found is None else found.unionByName(part)
    return top_k(found if found is not None else rows.sparkSession.createDataFrame([], schema), k)


def _scorer(block: list, query_type, k: int):
    import numpy as np

    from tessera.functions.batches import MOST_CELLS, Best

    def units(matrix):
        sizes = np.linalg.norm(matrix, axis=1, keepdims=True)
        return np.divide(matrix, sizes, out=np.zeros_like(matrix), where=np.isfinite(sizes) & (sizes > 0))

    names = [r["query_id"] for r in block]
    matrix = units(np.array([r["embedding"] for r in block], np.float64).reshape(len(block), -1))
    most_rows = max(1, MOST_CELLS // len(block))

    def run(batches):
        best, id_type = Best(len(names), k), None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, most_rows):
                part = batch.slice(at, most_rows)
                flat = units(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1))
                scores = flat @ matrix.T
                if len(scores) >= k and not np.isfinite(best.floor).all():
                    best.floor = np.maximum(best.floor, np.round(np.partition(scores, len(scores) - k, axis=0)[len(scores) - k], DIGITS))
                row, query = np.nonzero(scores >= best.floor - 2 * 10.0**-DIGITS)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                best.add(query, ids[row], np.round(scores[row, query], DIGITS) + 0.0)
        if id_type is not None:
            yield from best.batches(names, query_type, id_type)

    return run


def hydrate(hits: DataFrame, metadata: DataFrame, *, id_col: str = "id") -> DataFrame:
    """Metadata of the hits only, joined after ranking; hits whose row is gone are skipped.

    Hits are written first.  Up to MOST_HITS of them go to the rows of the metadata, so that texts of others never move."""
    hits = tables.settle(hits)
    meta = metadata.withColumnRenamed(id_col, "id") if id_col != "id" else metadata
    return (F.broadcast(hits) if hits.count() <= MOST_HITS else hits).join(meta, "id")
