"""Passes over whole batches of text against the columns they stand for, and plans that must not move texts or tokens."""

import hashlib
import os
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions import batches
from tessera.functions import text as T
from tessera.operators import dense, evaluate, lexical, services
from tessera.plans import registry

ODD = ["", None, " lead and tail ", "\n\nlead", "\ttab\t", "a <think> b </think> c", "  ", "x" * 300, "é ü - _ ı İ", "on 55.63.178.142 we 24/2/2017 met\nsecond", "KAYNAK 1:\nno\r\nyes", "你 好", " - a -- b - ", "a " * 400, "- " * 90 + "z"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_of_every_sign(spark):
    signs = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = [None, "", "x", *("q" + "q ".join(signs[at : at + 997]) + "q" for at in range(0, len(signs), 997)), "ve VE Ve İSE ışık 12 K5 kelvKİn", "tail"]
    want = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", T.tokenize(F.col("text")).alias("t")).orderBy("i").collect()]
    for column in (pa.array(texts), pa.array(["no", *texts]).slice(1)):
        tokens, rows = batches.tokens_of(column)
        got = [[] for _ in texts]
        for t, r in zip(tokens.to_pylist(), rows, strict=True):
            got[r].append(t)
        assert got == [w or [] for w in want]


def test_stem_word(spark):
    words = [f"{w}{s}{s2}" for w in ("abc", "abcd", "kanunda") for s in ("", *fixed.SUFFIXES) for s2 in ("", *fixed.SUFFIXES)]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem(F.col("w")).alias("s")).collect()
    assert all(T.stem_word(r.w) == r.s for r in rows)


def test_best_of_many_batches_is_k_rows_a_query():
    rng = np.random.default_rng(0)
    scores, ids = np.round(rng.random((5000, 3)), 2), rng.permutation(5000)
    best = batches.Best(3, 4)
    best.most = 100
    for at in range(0, 5000, 7):
        for q in range(3):
            best.add(np.full(len(ids[at : at + 7]), q), ids[at : at + 7], scores[at : at + 7, q])
    out = pa.Table.from_batches(best.batches(["a", "b", "c"], pa.string(), pa.int64())).to_pylist()
    assert [(r["query_id"], r["score"], r["id"]) for r in out] == [("abc"[q], -s, i) for q in range(3) for s, i in sorted(zip(-scores[:, q], ids, strict=True))[:4]]


def test_cosines_leave_k_rows_a_task_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(batches, "MOST_CELLS", 8)
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(60, 3)))]
    block = [{"query_id": i, "embedding": v} for i, v in vectors[:2]]
    parts = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in vectors[a : a + 20]]), pa.array([v for _, v in vectors[a : a + 20]], pa.list_(pa.float64()))], names=["id", "embedding"]) for a in (0, 20, 40)]
    got = pa.Table.from_batches(dense._scorer(block, pa.int64(), 5)(iter(parts)))
    assert got.num_rows == 10  # not five a query and batch
    m = np.array([v for _, v in vectors])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 1):
        assert [r["id"] for r in got.to_pylist() if r["query_id"] == q] == sorted(range(60), key=lambda i: (-round(float(m[i] @ m[q]), 9), i))[:5]


def test_cosines_hold_a_part_of_a_batch(spark, monkeypatch):
    """A task's memory follows neither the rows of a batch nor the number of batches."""
    taken, rng = [], np.random.default_rng(2)
    asked = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(1500, 3)).tolist())], "query_id long, embedding array<float>")
    real = type(asked).mapInArrow
    monkeypatch.setattr(type(asked), "mapInArrow", lambda self, f, *a, **k: taken.append(f) or real(self, f, *a, **k))
    dense.cosine_topk(asked.withColumnRenamed("query_id", "id"), asked, 5)

    def peak(n):
        flat = pa.array(rng.normal(size=30_000))
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, 30_001, 3, np.int32)), flat)
        tracemalloc.start()
        for out in taken[0](pa.RecordBatch.from_arrays([pa.array(np.arange(10_000) + i * 10_000), vectors], names=["id", "embedding"]) for i in range(n)):
            assert out.num_rows <= 1 << 16
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    few, many = peak(1), peak(6)
    assert few < 64 * batches.MOST_CELLS and many < 1.5 * few


def test_search_moves_no_tokens(spark):
    texts = spark.createDataFrame([(i, f"word{i % 7} other{i % 3} rest") for i in range(60)], "id long, text string")
    asked = spark.createDataFrame([("a", "word1 other2"), ("b", "rest rest")], "query_id string, text string")
    hits = lexical.search(texts, asked, 3)
    assert "Generate" not in plan(hits) and "hashpartitioning(query_id#" in plan(hits) and ", id#" not in plan(hits).split("hashpartitioning(query_id#")[1].split(")")[0]
    want = lexical.bm25_search(lexical.build_index(texts), asked, 3).select(*hits.columns)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, want.collect()))
    seen = lexical.vocabulary(texts)
    assert "Generate" not in plan(seen.stats)
    assert sorted(map(tuple, seen.stats.collect())) == sorted(map(tuple, lexical.build_index(texts).stats.collect()))
    assert seen.corpus.first() == lexical.build_index(texts).corpus.first()


def test_search_of_repeated_ids(spark):
    texts = spark.createDataFrame([(1, "word one"), (1, "word"), (2, "word two two")], "id long, text string")
    asked = spark.createDataFrame([(0, "word two")], "query_id long, text string")
    for hits in (lexical.search(texts, asked, 5), lexical.search(texts.where("length(text) > 4"), asked, 1)):
        assert len({r.id for r in hits.collect()}) == hits.count()
    assert {r.term: r.df for r in lexical.vocabulary(texts).stats.collect()}["word"] == 2


def test_hydrate_moves_hits_only(spark):
    texts = spark.range(2000).select("id", F.repeat(F.lit("x"), 50).alias("text"))
    hits = spark.createDataFrame([(0, 5, 1), (0, 9999, 2)], "query_id long, id long, rank int")
    got = dense.hydrate(hits, texts)
    assert "hashpartitioning" not in plan(got) and [r.id for r in got.collect()] == [5]


def test_mean_of_rounded_numbers_rounds_half_up(one):
    assert one(evaluate.half_up((F.col("d") + F.col("c")) / 2), d=0.348618561, c=1.0) == 0.674309281


def plain_vector(text, dim):
    v = [0.0] * dim
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    return v


def test_embedded_words_of_every_sign():
    signs = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["", " ", "x", "İI a\x00 a a\x00\x00 \x00", *(f"{'q' * n} {'ü' * n} {'q' * n}" for n in range(1, 20)), *("q" + "q q".join(signs[at : at + 997]) for at in range(0, len(signs), 997)), "\u3000a\u2028b\x1c", "tail"]
    for dim in (1, 7, 64):
        want = [plain_vector(t, dim) for t in texts]
        assert services.hashing_embedder(dim)(texts) == want
        assert [services.hashing_embedder(dim)([t])[0] for t in texts] == want
    few = batches.WordHashes(2)  # places that words take from each other
    data, starts, ends, _ = batches.words_of(texts)
    want = [int.from_bytes(hashlib.blake2b(data[a:b], digest_size=8).digest(), "little") for a, b in zip(starts, ends, strict=True)]
    assert few(data, starts, ends).tolist() == want and few(data, starts, ends).tolist() == want
    assert services.hashing_embedder(8)([]) == []


def test_embedder_hashes_a_word_once(monkeypatch):
    hashed, real = [], hashlib.blake2b
    monkeypatch.setattr(hashlib, "blake2b", lambda *a, **k: hashed.append(a) or real(*a, **k))
    batches.word_hashes.cache_clear()
    for _ in range(50):
        services.hashing_embedder(8)(["the same words again", "again the words"])
    assert len(hashed) <= 20  # four words; those of one call aren't told apart


@pytest.mark.parametrize("name", ["strip_thinking", "slugs"])
def test_odd_texts_against_sql(spark, tmp_path, name):
    rows = [(i * 4 + k, t) for i, t in enumerate(ODD) for k in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").where("text IS NOT NULL OR 'slugs' <> '" + name + "'").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = con.execute(registry.ORACLES[name]).fetchall()
    assert sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(theirs)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_answers_hide_source_names_only(spark, tmp_path):
    for name in ("benchmark", "embeddings"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.withColumn("text", F.concat(F.lit("on 55.63.178.142 and 24/2/2017 "), "text")).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name, glob in (("documents", "/*.parquet"), ("benchmark", ""), ("embeddings", "")):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet{glob}'")
    got = registry.QUERIES["answers"](spark, str(tmp_path))
    theirs = con.execute(registry.ORACLES["answers"])
    at = {d[0]: i for i, d in enumerate(theirs.description)}
    assert sorted((r.query_id, r.text, r.citations) for r in got.collect()) == sorted((r[at["query_id"]], r[at["text"]], r[at["citations"]]) for r in theirs.fetchall())


def test_scrub_patterns_match_the_same_behind_their_first_signs(spark, one):
    from tessera.operators import answer

    kinds = ["MADDE 6", "geçici 3 üncü MADDE", "Ek Madde 5/A", "ek 4 ncı maddesi", "GEÇİCİ MADDE 2", "BİRİNCİ Madde", "ikinci maddede", "kanun no: 5", "Kanun No 7", "SAYI NUMARASI 3", "ſayı no 9", "Tebliğ No 12", "Bu Kanun", "İlgili Yönetmelik", "Söz konusu Tebliğ", "Aynı Karar", "madde", "no 4", "6446 sayılı", "24/2/2017", "x"]
    rows = spark.createDataFrame([(f"a {x} {y}. b",) for x in kinds for y in kinds] + [(None,)], "t string")
    plain = F.col("t")
    for pattern in fixed.SCRUB:
        plain = F.regexp_replace(plain, pattern, fixed.REDACTED)
    plain = T.strip(F.regexp_replace(F.regexp_replace(plain, fixed.SCRUB_RUN, f"{fixed.REDACTED} "), fixed.SCRUB_SPACE, " "))
    assert rows.where(~answer.scrub_context(F.col("t")).eqNullSafe(plain)).count() == 0


MOVED = ["hybrid_answer", "gate_decision", "gate_signals", "budget_prefix", "rrf_many", "answer_states"]


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """The smallest tables, and their documents and vectors ten times with shifted keys; the questions once."""
    roots = {}
    for n in (1, 10):
        roots[n] = tmp_path_factory.mktemp(f"times{n}")
        for name, key in (("documents", "doc_id"), ("embeddings", "vec_id")):
            rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").crossJoin(spark.range(n).withColumnRenamed("id", "copy"))
            rows.withColumn(key, F.col(key) + F.col("copy") * 100_000).drop("copy").repartition(4, key).write.parquet(f"{roots[n]}/{name}.parquet")
        (roots[n] / "benchmark.parquet").symlink_to("/root/testdata/sf0.001/benchmark.parquet")
    return roots


def moved(spark, run):
    """Bytes that the stages of a run shuffle and spill."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        sc.listenerBus().waitUntilEmpty()
        every = sc.statusStore().stageList(gateway.jvm.java.util.ArrayList(), False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {every.apply(i).stageId(): every.apply(i).shuffleWriteBytes() + every.apply(i).diskBytesSpilled() for i in range(every.size())}

    before = stages()
    run()
    return sum(v for k, v in stages().items() if k not in before)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
@pytest.mark.parametrize("name", MOVED)
def test_retrieval_moves_a_small_part_of_added_texts(spark, grown, name):
    few, many = (moved(spark, registry.QUERIES[name](spark, str(grown[n])).collect) for n in (1, 10))
    added = spark.read.parquet(f"{grown[10]}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0] * 0.9
    assert many - few < added / 10
