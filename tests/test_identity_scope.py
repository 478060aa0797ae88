import pytest
from pyspark.sql import functions as F

from tessera.operators import identity, scope

MAST = "5 Temmuz 2012 PERŞEMBE Resmî Gazete Sayı : 28344\nYÖNETMELİK\nEnerji Piyasası Düzenleme Kurumundan:\nELEKTRİK PİYASASI LİSANS\nYÖNETMELİĞİNDE DEĞİŞİKLİK YAPILMASINA\nDAİR YÖNETMELİK\nKarar No: 10543\nMADDE 1 – metin"


@pytest.mark.parametrize(
    "text, title, kind, number, date, gazette, sure",
    [
        (MAST, "ELEKTRİK PİYASASI LİSANS YÖNETMELİĞİNDE DEĞİŞİKLİK YAPILMASINA DAİR YÖNETMELİK", "Yönetmelik", "10543", "2012-07-05", "28344", "high"),
        ("ELEKTRİK PİYASASI KANUNU Kanun No. 4628 Kabul Tarihi: 20/2/2001\nYayımlandığı R. Gazete : Tarih : 3/3/2001 Sayı : 24335", "ELEKTRİK PİYASASI KANUNU", "Kanun", "4628", "2001-03-03", "24335", "high"),
        ("küçük harfli bir metin yalnız başına duruyor", None, None, None, None, None, "none"),
        ("BÜYÜK HARFLİ UZUN BİR SATIR\nmetin", "BÜYÜK HARFLİ UZUN BİR SATIR", None, None, None, None, "low"),
        ("", None, None, None, None, None, "none"),
    ],
)
def test_identity(spark, text, title, kind, number, date, gazette, sure):
    row = identity.identify(spark.createDataFrame([(text,)], "text string")).first()
    assert (row["title"], row["mevzuat_type"], row["number"], row["rg_date"], row["rg_number"], row["confidence"]) == (title, kind, number, date, gazette, sure)


def test_impossible_dates(one):
    assert one(identity.iso_date(F.col("t")), t="31/2/2001") == "2001-02-31"
    assert one(identity.iso_date(F.col("t")), t="1/13/2001") is None


@pytest.mark.parametrize(
    "title, text, disposition",
    [
        ("BAZI KANUNLARDA DEĞİŞİKLİK YAPILMASINA DAİR KANUN", "", "OMNIBUS"),
        ("Diğer bazı kanunlarda değişiklik", "", "OMNIBUS"),
        ("Elektrik Piyasası Kanununda Değişiklik Yapılmasına Dair Kanun", "", "IN_SCOPE"),
        (None, "x bazı kanun ve kanun hükmünde kararnamelerde değişiklik yapılmasına dair", "OMNIBUS"),
        (None, "x" * 1500 + " bazı kanunlarda değişiklik yapılması", "IN_SCOPE"),
        ("NÜKLEER DÜZENLEME KANUNU", "", "EXCLUDED"),
        ("DÜZENLEME KANUNU", "Kanun No. 7381", "EXCLUDED"),
    ],
)
def test_dispositions(spark, title, text, disposition):
    row = spark.createDataFrame([(title, text)], "t string, x string").select(scope.document_scope(F.col("t"), F.col("x")).alias("s")).first()["s"]
    assert row["disposition"] == disposition


@pytest.mark.parametrize(
    "text, label",
    [
        ("6446 sayılı Kanunun 4 üncü maddesi", "ELECTRICITY"),
        ("3213 sayılı Maden Kanununun 16 ncı maddesi", "OFF_DOMAIN"),
        ("193 sayılı Kanun elektrik üretim tesisi", "ELECTRICITY"),
        ("noterlik ücretleri", "OFF_DOMAIN"),
        ("aboneliğin ve sayaçların", "ELECTRICITY"),
        ("karayolları trafik ve sürücü belgesi", "OFF_DOMAIN"),
        ("elektrik ve gelir vergisi", "AMBIGUOUS"),
        ("epiaş gelir vergisi", "ELECTRICITY"),
        ("xkv xmw", "OFF_DOMAIN"),
    ],
)
def test_labels(spark, text, label):
    assert scope.classify(spark.createDataFrame([(text,)], "text string")).first()["scope_label"] == label


def test_articles_are_judged_whole(spark):
    items = [("MADDE 1", "3213 sayılı maden ruhsat"), (None, "devamı"), (None, "elektrik"), ("MADDE 2", "elektrik"), ("MADDE 2", "devamı")]
    rows = spark.createDataFrame([("d", "BAZI KANUNLARDA DEĞİŞİKLİK", i, r, t) for i, (r, t) in enumerate(items)], "doc_id string, document_title string, chunk_index int, article_ref string, text string")
    labels = [r["scope_label"] for r in scope.scope_chunks(rows).orderBy("chunk_index").collect()]
    # Only the first chunk without a reference goes on with the article.
    assert labels == ["OFF_DOMAIN", "OFF_DOMAIN", "ELECTRICITY", "ELECTRICITY", "ELECTRICITY"]


def test_documents_in_scope_are_never_judged(spark):
    rows = spark.createDataFrame([("d", "ELEKTRİK", 0, None, "x")], "doc_id string, document_title string, chunk_index int, article_ref string, text string")
    row = scope.scope_chunks(rows).first()
    assert row["scope_label"] is None and row["indexable"]
