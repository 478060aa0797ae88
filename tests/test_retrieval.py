import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import dense, evaluate, fusion, lexical
from tessera.params import Params

TEXTS = [(10, "önlisans süresi önlisans"), (20, "doğal gaz dağıtım"), (30, "dağıtım bedeli"), (40, "yan hizmet"), (50, "")]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(TEXTS, "id long, text string")


def queries(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "query_id long, text string")


def test_bm25_by_hand(spark, texts):
    index = lexical.build_index(texts)
    row = lexical.bm25_search(index, queries(spark, "onlisans"), 5).first()
    idf, avgdl = math.log(1 + (5 - 1 + 0.5) / 1.5), (3 + 3 + 2 + 2 + 0) / 5
    assert row["id"] == 10 and row["score"] == pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avgdl)), abs=1e-8)


def test_bm25_paths_agree_and_repeat_counts(spark, texts):
    q = queries(spark, "dağıtım", "dagitim dagitim", "yok", "ve ile", "bedeli onlisans")
    a = lexical.bm25_search(lexical.build_index(texts), q, 5).select("query_id", "id", "score", "rank")
    b = lexical.search(texts, q, 5).select("query_id", "id", "score", "rank")
    rows = sorted(map(tuple, a.collect()))
    assert rows == sorted(map(tuple, b.collect()))
    by = {}
    for query, i, s, _ in rows:
        by.setdefault(query, {})[i] = s
    assert by[1][30] == pytest.approx(2 * by[0][30], abs=1e-8) and 2 not in by and 3 not in by
    assert lexical.search(texts, q, 0).count() == 0


def test_cosines(spark):
    unit = lambda a, b: [float(a), float(b)] + [0.0] * 6
    rows = [(1, unit(2, 0)), (2, unit(0.8, 0.6)), (3, unit(0.6, 0.8)), (4, unit(0, 1)), (5, unit(0, 0)), (6, unit(3, 0)), (7, None)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = spark.createDataFrame([(0, unit(1, 0)), (1, unit(0, 0)), (2, None)], "query_id long, embedding array<float>")
    got = dense.cosine_topk(v, q, 10).orderBy("query_id", "rank").collect()
    assert [(r.id, round(r.score, 6)) for r in got if r.query_id == 0] == [(1, 1), (6, 1), (2, 0.8), (3, 0.6), (4, 0), (5, 0)]
    assert all(r.score == 0 for r in got if r.query_id == 1) and not [r for r in got if r.query_id == 2]
    assert dense.cosine_topk(v, q, 0).count() == 0 and dense.cosine_topk(v, q.where("query_id > 1"), 5).count() == 0
    native = v.select(dense.cosine(F.col("embedding"), F.array(*map(F.lit, unit(1, 0)))).alias("c")).where("c is not null").collect()
    assert [round(r.c, 6) for r in native][:5] == [1, 0.8, 0.6, 0, 0]
    assert v.where("id = 2").select(dense.l2_normalize(F.col("embedding")).alias("u")).first()["u"][:2] == pytest.approx([0.8, 0.6], abs=1e-6)


def test_wrong_size_raises(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<float>")
    with pytest.raises(Exception, match="vector of size 2"):
        dense.checked(v, Params(embedding_dim=3)).collect()


def ranking(spark, ids, q=0):
    return spark.createDataFrame([(q, i, r) for r, i in enumerate(ids, 1)], "query_id long, id long, rank int")


def test_rrf(spark):
    got = lexical.top_k(fusion.reciprocal_rank_fusion([ranking(spark, [1, 2, 3]), ranking(spark, [4, 2, 5])]), 10).orderBy("rank").collect()
    assert [r.id for r in got][:3] == [2, 1, 4] and got[0].score == pytest.approx(2 / 62)
    tied = fusion.reciprocal_rank_fusion([ranking(spark, [1, 2]), ranking(spark, [2, 1])], Params(rrf_k=10)).collect()
    assert {round(r.score, 9) for r in tied} == {round(1 / 11 + 1 / 12, 9)}


@pytest.mark.parametrize("score, decision", [(0.32979, "ANSWER"), (0.329789, "ANSWER_WEAK"), (0.18804, "ANSWER_WEAK"), (0.188039, "NOT_FOUND"), (0.0, "NOT_FOUND")])
def test_gate(one, score, decision):
    assert one(fusion.gate(F.col("s")), s=score) == decision


def test_gate_needs_cutoffs():
    with pytest.raises(ValueError):
        fusion.classify(F.lit(1.0), None, 0.1)


def test_answerable_end_to_end(spark, texts):
    v = spark.createDataFrame([(10, [1.0, 0.0]), (20, [0.0, 1.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(0, "önlisans süresi", [1.0, 0.0]), (1, "rafineri", None), (2, "yan hizmet rafineri", None)], "query_id long, text string, embedding array<float>")
    index = lexical.build_index(texts)
    fused, judged = fusion.answerable(index, texts, v, q)
    by = {r.query_id: r for r in judged.collect()}
    assert by[0].decision == "ANSWER" and by[0].confidence == 1.0
    assert by[1].decision == "NOT_FOUND" and by[1].coverage == 0
    top = fused.where("query_id = 2 AND rank = 1").first()
    assert top.id == 40 and top.dense_score is None and top.lexical_rank == 1


def test_calibration(spark):
    rows = [(0.9, True), (0.8, True), (0.5, False), (0.4, False)]
    clean = spark.createDataFrame(rows, "score double, positive boolean")
    got = evaluate.recommend(clean).first()
    assert got["clean"] and got["threshold"] == pytest.approx(0.725, abs=1e-5) and got["floor"] == pytest.approx(0.575, abs=1e-5)
    mixed = spark.createDataFrame([*rows, (0.3, True)], "score double, positive boolean")
    best = evaluate.best_separation(mixed).first()
    assert best["cutoff"] == 0.8 and best["j"] == pytest.approx(2 / 3, abs=1e-6)
    got = evaluate.recommend(mixed).first()
    assert not got["clean"] and got["floor"] == pytest.approx(0.3, abs=1e-5)
