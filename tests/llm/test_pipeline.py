import os
import random
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, docs):
    clean = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)]
    texts = [*clean, clean[0], clean[1] + " more", "few words", "### " * 40, clean[2].replace("w2x5", "token = \"Zq83LmPw1xAA\"", 1)]
    rows = docs([(i, t, "en", f"s{i % 4}") for i, t in enumerate(texts)])
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "near_dedup", "secrets", "mixing", "packing"]
    for name, stage in pipeline.STAGES:
        out = stage(spark, rows, "")
        if name != "packing":
            assert out.columns == rows.columns
        out = out.cache()
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "quality":
            assert ids == set(range(45)) - {42, 43}
        if name == "near_dedup":
            assert {40, 41} & ids == set() and set(range(40)) <= ids
            secret = 44 in ids
        if name == "secrets" and secret:
            assert "[SECRET]" in out.where("doc_id = 44").first()["text"]
        rows = out
    assert rows.count() >= len(ids)


def test_stages_on_edges(spark, edges, nothing):
    """Nulls, long and repeated rows and clashing columns pass every stage; an empty table stays one."""
    for rows in (edges, nothing):
        for name, stage in pipeline.STAGES:
            out = stage(spark, rows, "").cache()
            if name == "packing":
                assert (out.count() > 0) == (rows is edges)
                continue
            assert out.columns == rows.columns and out.count() <= rows.count()
            kept = {r.doc_id for r in out.select("doc_id").collect()}
            if rows is edges and name == "quality":
                assert kept <= {8, 9} and 0 not in kept
            if rows is edges and name == "near_dedup":
                assert {0, 1, 2, 3, 5, None} <= kept and 6 not in kept
            if name == "secrets":
                assert out.count() == rows.count()


def brute(texts):
    """The first three stages in plain Python over distinct ids: quality, near-dedup, redaction."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in texts.items()}

    def passes(i):
        w, t = words[i], texts[i]
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        again = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        n, chars, letters = len(w), sum(map(len, w)), re.findall("[A-Za-z]", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return not (n < 10 or 100 * len(again) > 20 * n or 100 * len(re.findall(r"[#*$%&|<>]", t)) > 5 * chars or 100 * t.count("!") > 5 * chars
                    or len(letters) >= 40 and 100 * len(re.findall("[A-Z]", t)) > 40 * len(letters) or len(lines) >= 4 and 100 * (len(lines) - len(set(lines))) > 50 * len(lines)
                    or chars < 2 * n or chars > 20 * n)

    kept = [i for i in sorted(texts) if passes(i)]
    sets = {i: {tuple(x.lower() for x in words[i][k : k + 5]) for k in range(len(words[i]) - 4)} for i in kept}
    root = {i: i for i in kept}
    for _ in kept:
        for a in kept:
            for b in kept:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    root[a] = root[b] = min(root[a], root[b])
    return {i: re.sub(r'(?<=token = ")\w+', "[SECRET]", texts[i]) for i in kept if root[i] == i}


def test_stages_against_brute_force(spark, docs):
    rnd = random.Random(5)
    texts = {}
    for i in range(0, 120, 2):
        base = [f"w{rnd.randrange(900)}x" for _ in range(rnd.choice((6, 12, 40, 90)))]
        if rnd.random() < 0.2:
            base[3:3] = rnd.choice((["###"] * 9, ["SHOUTED"] * 60, base[:5] * 4, ["a"] * 80, ["wow!!!!"] * 9))
        if rnd.random() < 0.3:
            base[2:2] = ["token", "=", f'"aZ9{rnd.randrange(10**9)}q"']
        texts[i] = " ".join(base)
        base[rnd.randrange(len(base))] = "changed"
        texts[i + 1] = "\n".join(base) if rnd.random() < 0.5 else " ".join(base)
    rows = docs([(i, t, "en", f"s{i % 3}") for i, t in texts.items()])
    for name, stage in pipeline.STAGES[:3]:
        rows = stage(spark, rows, "")
    assert {r.doc_id: r.text for r in rows.collect()} == brute(texts)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_run(spark):
    rows = pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.length <= 1024 for r in rows)
    assert pipeline.ORACLE_SQL is None


def test_contract():
    import __spark_entry__ as entry

    queries = entry.queries()
    numbers = sorted(int(m[1]) for q in queries if (m := re.match(r"op(\d+)_", q)))
    assert numbers == list(range(1, 11)) and "pipeline" in queries
    assert set(entry.oracle_sql()) <= set(queries)
