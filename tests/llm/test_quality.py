import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    letters = re.findall("[A-Za-z]", text)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines), text.count("!"), sum(c.isupper() for c in letters), len(letters))


def test_measures_against_brute_force(docs):
    texts = ["a b c d e f a b c d e g", "x " * 12, "L1 a\nL1 a\n \nL2\r\nL1 a", "# * $ % & | < > !", "é ß ﬀ a b c \x1c", "one two three four five " * 3 + "end", ""]
    got = {r.doc_id: tuple(r[m] for m in quality.MEASURES) for r in quality.ledger(docs(texts)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_edges_and_empty(edges, nothing):
    rows = quality.apply_policy(quality.ledger(edges)).collect()
    assert len(rows) == edges.count()
    by = {r.doc_id: r for r in rows}
    assert by[0].n_words == 0 and by[0].base_failed and not by[0].kept and by[8].n_repeat_words == 30000
    assert quality.ledger(nothing).count() == 0 and quality.kept_documents(nothing).count() == 0
    assert quality.kept_documents(edges).columns == edges.columns


def test_policies_and_ablations(docs):
    clean = " ".join(f"word{i}" for i in range(20))
    rows = docs([clean, clean + " ### ### ### ###", clean.upper(), "few", clean + " ###!!! ###!!! ###!!! ###!!!"])
    ledger = quality.ledger(rows).cache()
    kept = {v: [r.doc_id for r in quality.apply_policy(ledger, v).where("kept").orderBy("doc_id").collect()] for v in quality.POLICIES}
    assert kept == {"v1": [0, 1, 2, 4], "v2": [0], "v3": [0]}
    for row in quality.ablations(ledger).collect():
        others = quality.POLICIES[row.policy] & ~quality.BIT[row.rule]
        without = ledger.where(F.col("fail_bits").bitwiseAND(F.lit(others)) == 0).count()
        assert row.kept_without == without - len(kept[row.policy]) and row.rejected == 5 - len(kept[row.policy])
    assert [r.doc_id for r in quality.kept_documents(rows).collect()] == [0]
