import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import hilbert, mixing


def test_curve_visits_neighbours(spark):
    cells = spark.range(512).select(*(F.expr(f"int(id div {8**k} % 8)").alias("xyz"[k]) for k in range(3)))
    rows = cells.withColumn("c", hilbert.hilbert_index([F.col(a) for a in "xyz"], 3)).orderBy("c").collect()
    assert [r.c for r in rows] == list(range(512))
    assert {sum(abs(a[i] - b[i]) for i in range(3)) for a, b in zip(rows, rows[1:])} == {1}


@pytest.mark.parametrize("least", [1, 256])
def test_shards_are_even_runs(docs, least):
    rows = docs([(i, "same text" if i < 400 else "x" * (i % 97), "en", "hot" if i < 700 else f"s{i % 9}") for i in range(1000)])
    got = hilbert.hilbert_shards(rows, least_range=least).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert len(got) == 1000 and sorted(by) == list(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    last = -1
    for k in range(24):
        run = sorted(by[k], key=lambda r: r.slot)
        assert [r.slot for r in run] == list(range(len(run))) and [r.curve for r in run] == sorted(r.curve for r in run) and run[0].curve >= last
        last = run[-1].curve
    assert {r.law for r in got} == {"rows"} and all(r.text_crc32 == zlib.crc32(b"same text") and r.size == 17 for r in got if r.doc_id < 400)


def test_shard_edges(edges, nothing):
    got = hilbert.hilbert_shards(edges).collect()
    assert len(got) == edges.count() and {r.size for r in got if r.doc_id == 0} == {8} and max(Counter(r.shard for r in got).values()) == 1
    assert hilbert.hilbert_shards(nothing).count() == 0


def test_shard_files(spark, docs, tmp_path):
    rows = docs([(i, "x" * i, "en", f"s{i % 3}") for i in range(100)])
    manifest = hilbert.write_shards(rows, str(tmp_path / "s"), shards=5).collect()
    assert sum(r.rows for r in manifest) == 100 and all(r.rows == 20 for r in manifest) and spark.read.parquet(str(tmp_path / "s")).where("file_shard = 2").count() == 20
    odd = rows.drop("lang").withColumns({c: F.lit(1) for c in ("shard", "slot", "size", "curve", "id", "row")})
    manifest = hilbert.write_shards(odd, str(tmp_path / "t"), shards=5)
    assert sum(r.rows for r in manifest.collect()) == 100 and "least_lang" not in manifest.columns
    assert spark.read.parquet(str(tmp_path / "t")).select("row.*").columns == odd.columns


def curve_place(x, y, z, bits=4):
    """The place on the three-dimensional curve, bit by bit, independently of columns."""
    at = [x, y, z]
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        for i in range(3):
            if at[i] & q:
                at[0] ^= q - 1
            else:
                t = (at[0] ^ at[i]) & (q - 1)
                at[0], at[i] = at[0] ^ t, at[i] ^ t
    for i in (1, 2):
        at[i] ^= at[i - 1]
    t = 0
    for b in range(bits - 1, 0, -1):
        if at[2] & (1 << b):
            t ^= (1 << b) - 1
    return int("".join(str((v ^ t) >> b & 1) for b in range(bits - 1, -1, -1) for v in at), 2)


def test_shards_against_brute_force(docs):
    """Every document's shard and slot from a sort of all documents."""
    def hashed(*parts):
        return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)

    def bin_of(value):
        return hashed("null" if value is None else "=" + value) % 16

    rows = [(i, None if i % 50 == 0 else "é" * (i * 7 % 300), ("en", "fr", None)[i % 3], "hot" if i < 500 else f"s{i % 13}") for i in range(800)]
    order = []
    for i, t, lang, source in rows:
        raw = (t or "").encode()
        size, crc = len(raw) + 8, zlib.crc32(raw)
        place = curve_place(bin_of(source), min(15, max(0, math.floor(math.log2(size)) - 4)), bin_of(lang))
        order.append((place, hashed("place", i, crc), i, size, crc))
    want, at = {}, 0
    order.sort()
    for shard in range(24):
        for slot in range(800 // 24 + (shard < 800 % 24)):
            place, _, i, size, crc = order[at]
            want[i], at = (size, crc, shard, slot, place), at + 1
    got = hilbert.hilbert_shards(docs(rows), least_range=16).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.shard, r.slot, r.curve) for r in got} == want


def words(n):
    return " ".join(["w"] * n)


def corpus(docs):
    rows = [(i, words(10 + i % 7), "en", "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(900)]
    return docs(rows), rows


def test_mix_keeps_to_its_quotas(docs):
    frame, rows = corpus(docs)
    held = Counter()
    for _, t, _, s in rows:
        held[s] += len(t.split())
    total = sum(held.values())
    got = mixing.temperature_mix(frame, spread=0.99, repetition_limit=4.0, least_block=100).collect()
    read = Counter()
    for r in got:
        read[r.source] += r.tokens
    shares = [read[s] / sum(read.values()) for s in held]
    assert -sum(p * math.log(p) for p in shares) >= 0.985 * math.log(len(held))
    assert total - 20 * len(held) <= sum(read.values()) <= total and read["hot"] < held["hot"]
    times = Counter((r.doc_id, r.epoch) for r in got)
    assert max(times.values()) == 1
    for s in held:  # whole passes read every document, the last a part
        by = Counter(r.doc_id for r in got if r.source == s)
        assert max(by.values()) - min(by.get(i, 0) for i, _, _, x in rows if x == s) <= 1


def test_repetition_limit_and_exponent(docs):
    frame, rows = corpus(docs)
    got = mixing.temperature_mix(frame, spread=None, repetition_limit=1.0, budget_ratio=0.9, least_block=50).collect()
    assert max(Counter(r.doc_id for r in got).values()) == 1
    shares = frame.sparkSession.createDataFrame([(0.7,), (0.2,), (0.1,)], "p double")
    a = mixing.exponent(shares, target_entropy=1.0, spread=None, repetition_limit=None, budget_ratio=1.0)
    w = [p**a for p in (0.7, 0.2, 0.1)]
    assert -sum(x / sum(w) * math.log(x / sum(w)) for x in w) == pytest.approx(1.0, abs=1e-4)
    a = mixing.exponent(shares, target_entropy=None, spread=None, repetition_limit=1.5, budget_ratio=1.0)
    w = [p**a for p in (0.7, 0.2, 0.1)]
    assert w[2] / sum(w) / 0.1 == pytest.approx(1.5, abs=1e-4)
    assert mixing.exponent(shares, target_entropy=None, spread=None, repetition_limit=None, budget_ratio=1.0) == 1.0


def test_mix_edges(edges, nothing):
    got = mixing.temperature_mix(edges).collect()
    assert {r.source for r in got} == {None, "s"}
    assert mixing.temperature_mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    same = mixing.mixed_documents(edges, spread=None, repetition_limit=None)
    assert same.columns == edges.columns and same.count() == edges.count()
