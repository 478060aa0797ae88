import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T

C = F.col("t")


@pytest.mark.parametrize("source, low, up", [("ISPARTA İZMİR", "ısparta izmir", "ISPARTA İZMİR"), ("ırmak için", "ırmak için", "IRMAK İÇİN"), ("ŞĞÜÖÇ", "şğüöç", "ŞĞÜÖÇ")])
def test_turkish_casing(one, source, low, up):
    assert one(T.tr_lower(C), t=source) == low
    assert one(T.tr_upper(C), t=source) == up


def test_folding_makes_spellings_one_key(one):
    assert one(T.fold_diacritics(C), t="Önlisans hâl ÇĞİ") == "Onlisans hal CGI"
    assert one(T.tokenize(C), t="Önlisans süresi ve 5 bir şirketin A") == one(T.tokenize(C), t="onlisans SURESI ve 5 bir sirketin a") == ["onlisans", "suresi", "sirketin"]
    assert one(T.tokenize(C), t="ve ile bu") == []


@pytest.mark.parametrize(
    "source, joined",
    [("yönet-\nmelik", "yönetmelik"), ("yönet-  \n   melik", "yönetmelik"), ("ön-\nKoşul", "ön-\nKoşul"), ("ön-koşul", "ön-koşul"), ("a -\nb", "a -\nb"), ("yönet-\n\nmelik", "yönet-\n\nmelik")],
)
def test_hyphenation(one, source, joined):
    assert one(T.fix_hyphenation(C), t=source) == joined


def test_normalisation_composes_and_tidies(one):
    assert one(T.normalize_text(C), t="  şey x​  \r\n\r\n\r\n\r\nson \t\r") == "şey x\n\nson"


@pytest.mark.parametrize("line, is_number", [("12", True), (" - 3 - ", True), ("Sayfa 3", True), ("3/12", True), ("3 / 12", True), ("madde 3", False), ("1234567890123", False), ("", False), ("...", False)])
def test_page_numbers(one, line, is_number):
    assert one(T.looks_like_page_number(C), t=line) is is_number


@pytest.mark.parametrize("source, n", [("", 0), ("one", 1), ("a b c\x1cd  ", 4), (" \n ", 0)])
def test_words_split_at_all_white_space(one, source, n):
    assert one(T.word_count(C), t=source) == n
    assert one(T.estimate_tokens(C), t=source) == 2 * n
    assert one(T.count_tokens(C), t=source) == int(n * 2.77) + 1


@pytest.mark.parametrize(
    "raw, shown",
    [("<think>a\nb</think> cevap", "cevap"), ("<think>\n\ncevap", "cevap"), ("önce <think> düşün", "önce"), ("<think>yarım", ""), ("düz ", "düz")],
)
def test_reasoning_is_dropped(one, raw, shown):
    assert one(T.strip_thinking(C), t=raw) == shown


@pytest.mark.parametrize("raw, shown", [("**Başlık**\nmetin", "metin"), ("# Başlık\nmetin", "metin"), ("**Başlık.**\nmetin", "**Başlık.**\nmetin"), ("**KAYNAK 1**\nmetin", "**KAYNAK 1**\nmetin"), ("tek", "tek"), ("düz satır\nmetin", "düz satır\nmetin")])
def test_leading_heading(one, raw, shown):
    assert one(T.strip_leading_heading(C), t=raw) == shown


@pytest.mark.parametrize("label, kind", [("SON VERSİYON", "son_versiyon"), ("son hali", "son_versiyon"), ("Değişiklik 2", "degisiklik"), ("Eski metin", "eski_versiyon"), ("x", "diger"), (None, "diger")])
def test_version_kinds(one, label, kind):
    assert one(T.classify_version(C), t=label) == kind


@pytest.mark.parametrize("raw, date", [("3.1.2020", "2020-01-03"), (" 13.11.2001 x", "2001-11-13"), ("2020-01-01", None), (None, None)])
def test_dotted_dates(one, raw, date):
    assert one(T.parse_dotted_date(C), t=raw) == date


@pytest.mark.parametrize("token, stem", [("sirketlerin", "sirket"), ("tarifesi", "tarif"), ("evde", "evde"), ("abc", "abc")])
def test_stems(one, token, stem):
    assert one(T.stem(C), t=token) == stem


def test_slugs(one):
    assert one(T.slugify(C), t="  Çok Güzel: Belge_1  ") == "cok-guzel-belge_1"
    assert one(T.slugify(C), t="!!") == "belge"


def test_rewrite_cleaning(one):
    assert one(T.clean_rewrite(C), t="\n SON SORU: “Süre ne kadar?” \nçünkü") == "Süre ne kadar?"
    assert one(T.strip_labels(C), t="Süre [KAYNAK 1 ve 2]  uzar (KAYNAK 3)") == "Süre uzar ()"
