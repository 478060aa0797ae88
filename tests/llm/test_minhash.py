import random
import re
import string

import pytest
from pyspark.sql import functions as F

from tessera.llm import graph, minhash
from tessera.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    return out


def brute(rows):
    sets = sets_of(rows)
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed=1, n=150):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice((3, 20, 80, 200)))]
        if i % 3 == 0:
            base = passage + base[:30]
        rows.append(" ".join(base))
        for _ in range(rnd.choice((0, 0, 1, 4))):
            copy = base[:]
            for _ in range(rnd.choice((0, 1, 2, 4))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append(" ".join(copy).title() if rnd.random() < 0.3 else "\n".join(copy))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_components_against_brute_force(docs, monkeypatch, small):
    if small:  # many groups of many tasks, behind rounds of leaders
        for name, value in (("LONG", 3), ("HEADS", 3), ("MEMBERS", 5)):
            monkeypatch.setattr(minhash, name, value)
    rows = corpus(8 if small else 2048)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(rows)).collect()}
    assert got == brute(list(enumerate(rows)))


def test_leaders_that_hide_links(docs, monkeypatch):
    """A chain in which each text is like its neighbours only: links between non-leaders count."""
    monkeypatch.setattr(minhash, "HEADS", 2)
    words = [f"w{i}" for i in range(400)]
    rows = [" ".join(words[k * 6 : k * 6 + 80]) for k in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(rows)).collect()}
    assert got == brute(list(enumerate(rows))) and len({c for _, c in got.values()}) == 1


def test_edges(edges, nothing):
    rows = minhash.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    by = {r.doc_id: r for r in rows}
    assert by[None].component_id is None and by[None].kept
    assert (by[0].n_shingles, by[0].component_id, by[3].n_shingles, by[8].n_shingles) == (0, 0, 1, 1)
    assert by[6].component_id == 5 and not by[6].kept and by[9].n_shingles == 1
    assert minhash.near_duplicates(nothing).count() == 0
    kept = minhash.distinct_documents(edges)
    assert kept.columns == edges.columns and 6 not in {r.doc_id for r in kept.collect()}


def test_rows_that_repeat_a_doc_id(docs):
    """A row is its text's: another text under a known doc_id is a document of its own; of equal rows one stays."""
    t, u = (" ".join(f"{c}{k}" for k in range(40)) for c in "tu")
    rows = docs([(3, t, "a", "s"), (5, t, "b", "s"), (5, u, "c", "s"), (7, u, "d", "s"), (7, u, "d", "s"), (8, None, "e", "s"), (8, None, "e", "s"), (9, u + " more", "f", "s"), (9, u + " end", "g", "s")])
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(rows).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False), (7, 5, False), (8, 8, True), (8, 8, True), (9, 5, False), (9, 5, False)]
    assert sorted((r.doc_id, r.lang) for r in minhash.distinct_documents(rows).collect()) == [(3, "a"), (5, "c"), (8, "e"), (8, "e")]
    twice = docs([(1, t, "a", "s"), (1, t, "a", "s"), (1, t + " more", "b", "s"), (2, u, "c", "s")])
    assert sorted(r.doc_id for r in minhash.distinct_documents(twice).collect()) == [1, 2]


def test_names_used_inside(spark):
    names = "row passed sieve_row sieve_bits text_key head goes n digest node dropped_id component".split()
    t = " ".join(f"w{k}" for k in range(40))
    rows = spark.createDataFrame([(i, t if i < 5 else f"other {i}", *range(len(names))) for i in range(8)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    assert sorted(r.doc_id for r in minhash.distinct_documents(rows).collect()) == [0, 5, 6, 7]
    assert minhash.near_duplicates(rows).count() == 8


def test_a_text_moves_seldom(docs, monkeypatch):
    """600 near copies share hundreds of lists; a text meets its groups once, not once a list."""
    rnd = random.Random(4)
    base = [rnd.choice(string.ascii_lowercase) + str(k) for k in range(150)]
    texts = []
    for _ in range(600):
        copy = base[:]
        for k in rnd.sample(range(150), rnd.randrange(1, 6)):
            copy[k] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(copy))
    met = []
    whole = minhash.confirmed

    def counted(members, sets, work):
        met.append(members.select(F.sum(F.coalesce("bucket", "k") + F.col("bucket").isNotNull().cast("int"))).first()[0])
        return whole(members, sets, work)

    monkeypatch.setattr(minhash, "confirmed", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(texts)).collect()}
    assert got == brute(list(enumerate(texts))) and sum(met) <= 2 * 600


def test_hashes_do_not_depend_on_cuts(monkeypatch):
    text = " ".join(f"wörd{i}" for i in range(3000)).encode() + b" " + b"z" * 5000 + b" end"
    whole = W.hash_words(text)[0]
    monkeypatch.setattr(W, "GROUP", 1000)
    assert (W.hash_words(text)[0] == whole).all() and len(whole) == 3002
    assert minhash.miss_probability() < 1.1e-6


def test_graph(spark):
    rnd = random.Random(2)
    edges = [(0, k) for k in range(1, 300)] + [(1000 + k, 1001 + k) for k in range(60)] + [(rnd.randrange(5000, 5200), rnd.randrange(5000, 5200)) for _ in range(90)] + [(7, 7)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
