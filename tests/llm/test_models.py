import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup as E
from tessera.llm import language, linear, toxicity

WORDS = {"aa": "baka lori tumo sani kera".split(), "bb": "xiþ ñolq zzur qwik vörd".split(), "cc": "sch ung keit lich heit".split()}


def languages(n=600):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        rows.append((i, " ".join("".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randrange(1, 3))) for _ in range(rnd.randrange(4, 40))), lang, "s"))
    return rows


def test_language_held_out(docs):
    rows = languages()
    odd = [(1000, None, "aa", "s"), (1001, "12 !?", "aa", "s"), (None, "baka lori", None, "s"), (1002, "sani kera tumo", None, "s")]
    got = {r.doc_id: r for r in language.identify(docs([*rows, *odd])).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i, *_ in rows) and held
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) >= 0.98
    assert (got[1000].lang_pred, got[1001].lang_pred, got[1000].score) == ("und", "und", 0.0) and got[1002].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_are_never_learned(docs):
    rows = languages()
    swapped = [(i, t, "wrong" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in rows]
    a, b = ({r.doc_id: r.lang_pred for r in language.identify(docs(x)).collect()} for x in (rows, swapped))
    assert a == b


def test_language_edges(edges, nothing, docs):
    assert language.identify(edges).count() == edges.count() and language.identify(nothing).count() == 0
    assert {r.lang_pred for r in language.identify(docs([(1, "abc", None, None)])).collect()} == {"und"}


def test_document_frequencies_cover_all(docs):
    df = language.document_frequency(docs(["ab", "ab", "cd"]))
    one = next(language.counts(["ab"]))
    assert (df[one > 0] >= 2).all() and df.sum() == sum((next(language.counts([t])) > 0).sum() for t in ("ab", "ab", "cd"))


def test_ftrl_is_sparse_and_calibrated():
    rng = np.random.default_rng(0)
    rows = [(np.array([y, 5 + rng.integers(20)]), np.array([1.0, 1.0])) for y in rng.integers(0, 3, 300)]
    labels = np.array([r[0][0] for r in rows])
    w, b = linear.ftrl_multinomial(rows, labels, 30, 3, l1=1.0)
    assert (w[:3].argmax(axis=1) == np.arange(3)).all() and (w[5:] == 0).mean() > 0.5
    logits = np.array([x @ w[at] for at, x in rows]) + b
    assert linear.temperature(logits * 10, labels) == pytest.approx(10 * linear.temperature(logits, labels), rel=0.1)


def test_toxicity_catches_planted_documents(spark, docs):
    rnd = random.Random(6)
    neutral, bad = [f"word{i}" for i in range(300)], ["grumble", "snarl", "vexing", "blight"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        text = [rnd.choice(neutral) for _ in range(60)]
        for _ in range(rnd.choice((1, 3, 6)) if toxic else 0):
            text.insert(rnd.randrange(60), rnd.choice(bad).title() + ",")
        rows.append((i, " ".join(text), "en", "s"))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    table = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None), (999_999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.severity(docs([*rows, (2000, None, None, None)]), table).collect()}
    truth = np.array([i % 6 == 0 for i in range(900)])
    flagged = np.array([got[i].toxic for i in range(900)])
    assert flagged[truth].mean() > 0.97 and flagged[~truth].mean() < 0.02
    assert np.mean([got[i].severity for i in range(0, 900, 6)]) > 1 and not got[2000].toxic
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 for r in got.values())


def test_toxicity_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.severity(edges, labels).collect()
    assert len(rows) == edges.count() and not any(r.toxic or r.severity for r in rows)
    assert toxicity.severity(nothing, labels.limit(0)).count() == 0


def test_thresholds_stay_ordered():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 4, 400)
    rows = [(np.arange(1, g + 1), np.ones(g)) for g in grades]
    w, cuts = linear.cumulative_link(rows, grades, 6, 4)
    assert (np.diff(cuts) > 0).all() and w[1] > 0
    s = np.array([x @ w[at] if len(at) else 0.0 for at, x in rows])
    expected = linear.sigmoid(s[:, None] - cuts).sum(axis=1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.9


def brute(rows, least=0.95):
    good = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    links, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= least:
                links[a] += 1
                links[b] += 1
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    return {i: (links[i], find(i)) for i, _ in rows}


@pytest.mark.parametrize("size", [8, 40])
@pytest.mark.parametrize("least", [0.95, -1.0])
def test_short_vectors_bound_cosines(size, least):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, size)) * np.linspace(3, 0.1, size)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for axes in (None, E.main_axes(x)):
        short = E.shortened(x, axes)
        assert (short @ short.T >= x @ x.T - E.SLACK).all()
        i, j = E.linked_pairs(x, short, np.arange(100), np.arange(100, 300), least)
        assert set(zip(i, j)) == {(a, b + 100) for a, b in np.argwhere(x[:100] @ x[100:].T >= least)}


@pytest.mark.parametrize("wide", [0, 32])
@pytest.mark.parametrize("cell, block, tile", [(4096, 2048, 256), (40, 16, 7)])
def test_embeddings_against_brute_force(spark, monkeypatch, cell, block, tile, wide):
    monkeypatch.setattr(E, "block_rows", lambda _: F.lit(block))
    monkeypatch.setattr(E, "TILE", tile)
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        base = rng.normal(size=8)
        for _ in range(rng.choice((1, 2, 6))):
            rows.append((base + rng.normal(size=8) * rng.choice((0, 0.1, 0.3))).astype(np.float32).tolist())
    rows = [r + (rng.normal(size=wide) / 20).tolist() for r in rows]
    rows += [rows[0]] * 30 + [[0.0] * 8, None, [], [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0], [2.0, 4.0], [3.0e38] * 8, [1.0e-38] * 8]
    rows = list(enumerate(rows))
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, node string, n int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(frame, rows_a_cell=cell).collect()}
    assert got == brute(rows)


def test_embedding_edges(spark):
    frame = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r for r in E.near_duplicates(frame).collect()}
    assert rows[None].kept and rows[None].component_id is None and rows[1].n_links == 1
    assert E.near_duplicates(frame.limit(0)).count() == 0
