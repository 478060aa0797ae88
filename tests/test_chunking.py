import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking
from tessera.params import Params

C = F.col("t")
LAW = "BAŞLIK\nMADDE 1 – Amaç budur.\nMADDE 2- 5 inci maddesinde yazılı.\nGEÇİCİ MADDE 1. Geçici hüküm.\nEk Madde 5/A: Ek hüküm."


def test_articles_of_three_kinds(one):
    found = one(chunking.find_articles(C), t=LAW)
    assert [(a["kind"], a["number"]) for a in found] == [(None, None), ("MADDE", "1"), ("MADDE", "2"), ("GEÇİCİ MADDE", "1"), ("EK MADDE", "5/A")]
    assert "".join(a["text"] for a in found) == LAW
    assert [(a["start"], a["end"]) for a in found][1] == (7, 29)


def test_inline_references_are_no_headings(one):
    assert len(one(chunking.find_articles(C), t="Bu madde 5 uyarınca\nolan metin")) == 1


def test_items(one):
    assert one(chunking.split_items(C), t="Giriş:\n(1) bir\n(2) iki\na) üç") == ["Giriş:", "(1) bir", "(2) iki", "a) üç"]
    assert one(chunking.split_items(C), t="Giriş:\n(1) bir") == ["Giriş:\n(1) bir"]


@pytest.mark.parametrize("n, starts", [(0, []), (1, [0]), (256, [0]), (257, [0, 231]), (487, [0, 231]), (488, [0, 231, 462])])
def test_windows(one, n, starts):
    found = one(chunking.token_windows(C), t=" ".join(f"w{i}" for i in range(n)))
    assert [int(w.split()[0][1:]) for w in found] == starts
    if n:
        assert found[-1].split()[-1] == f"w{n - 1}" and all(len(w.split()) <= 256 for w in found)


def test_packing_keeps_parts_whole(one):
    parts = F.split(C, ";")
    assert one(chunking.pack(parts, Params(chunk_tokens=8)), t="a b;c d;e f g h i;j") == ["a b\nc d", "e f g h i", "j"]


def test_document_chunks(spark):
    long = "MADDE 2 – giriş\n" + "\n".join(f"({i}) " + "söz " * 120 for i in range(1, 5))
    pages = [(1, "BAŞLIK SATIRI " + "lead " * 20 + "\nMADDE 1 – kısa"), (2, ""), (3, long), (4, "MADDE 3 – " + "söz " * 600)]
    docs = spark.createDataFrame([("d", "T", None, pages), ("e", None, "note", [(None, "x " * 300)]), ("f", None, None, [(None, "  ")])], "doc_id string, title string, page_note string, pages array<struct<number:int,text:string>>")
    rows = chunking.chunk_documents(docs).orderBy("doc_id", "chunk_index").collect()
    got = [(r.doc_id, r.chunk_index, r.strategy, r.article_ref, r.page_start, r.page_end) for r in rows]
    assert got[:2] == [("d", 0, "preamble", None, 1, 1), ("d", 1, "article", "MADDE 1", 1, 1)]
    assert {g[2] for g in got if g[3] == "MADDE 2"} == {"article-sub"} and {g[4:] for g in got if g[3] == "MADDE 2"} == {(3, 3)}
    assert {g[2] for g in got if g[3] == "MADDE 3"} == {"article-window"}
    assert [g[2] for g in got if g[0] == "e"] == ["token-window", "token-window"]
    assert [r.page_note for r in rows if r.doc_id == "e"] == ["note", "note"] and not [g for g in got if g[0] == "f"]


def test_page_span_and_citation(spark):
    pages = "array(named_struct('number', 1, 'text', 'aaaa'), named_struct('number', 2, 'text', ' '), named_struct('number', 3, 'text', 'bbbb'))"
    row = spark.range(1).select(F.expr(pages).alias("p"))
    spans = [row.select(chunking.page_span(F.col("p"), F.lit(a), F.lit(b)).alias("s")).first()["s"] for a, b in ((0, 4), (4, 6), (3, 7), (6, 10))]
    assert [tuple(s) for s in spans] == [(1, 1), (None, None), (1, 3), (3, 3)]
    cited = row.select(chunking.chunk_citation(F.lit("T"), F.lit("id"), F.lit("MADDE 1"), F.lit(3), F.lit(4)).alias("c")).first()["c"]
    assert cited == "T - MADDE 1 (s. 3-4)"
