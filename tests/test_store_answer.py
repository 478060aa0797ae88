import pytest
from pyspark.sql import functions as F

from tessera.operators import answer, conversation, evaluate, quality, services, store
from tessera.params import DEFAULTS, Params
from tessera.plans import pipelines
from tessera.sources import tables


def batch(spark, *rows):
    return spark.createDataFrame([(p, s, i, f"{p}{s}{i}", [1.0], True) for p, s, i in rows], "source_path string, file_sha256 string, chunk_index int, text string, embedding array<float>, indexable boolean")


def state(rows):
    return sorted((r.source_path, r.file_sha256, r.chunk_index, r.active) for r in rows.collect())


def test_versions_retire_resume_and_return(spark):
    a, b = batch(spark, ("p", "A", 0), ("p", "A", 1)), batch(spark, ("p", "B", 0))
    first = store.upsert(store.empty(spark), a)
    assert state(first) == [("p", "A", 0, True), ("p", "A", 1, True)] == state(store.upsert(first, a))
    assert [tuple(r) for r in store.ingest_totals(first, a).collect()] == [("p", 0, 2, 0)]
    second = store.upsert(first, b)
    assert state(second) == [("p", "A", 0, False), ("p", "A", 1, False), ("p", "B", 0, True)]
    assert state(store.upsert(second, a)) == [("p", "A", 0, True), ("p", "A", 1, True), ("p", "B", 0, False)]
    assert store.delete(second, spark.createDataFrame([("p",)], "source_path string")).count() == 0
    assert store.has_active(second, spark.createDataFrame([("p",), ("q",)], "source_path string")).count() == 1


def test_no_vector_means_not_indexable(spark):
    rows = batch(spark, ("p", "A", 0)).withColumn("embedding", F.lit(None).cast("array<float>"))
    row = store.upsert(store.empty(spark), rows).first()
    assert not row["indexable"] and row["embedded_at"] is None and row["active"]


def test_repeated_keys_enter_once(spark):
    assert store.upsert(store.empty(spark), batch(spark, ("p", "A", 0), ("p", "A", 0), ("q", "A", 0))).count() == 1


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "store")
    assert store.read_snapshot(spark, root).count() == 0
    first = store.upsert(store.read_snapshot(spark, root), batch(spark, ("p", "A", 0)))
    assert store.write_snapshot(first, root) == 0
    assert store.write_snapshot(store.upsert(store.read_snapshot(spark, root), batch(spark, ("p", "B", 0))), root) == 1
    assert state(store.read_snapshot(spark, root)) == [("p", "A", 0, False), ("p", "B", 0, True)]
    old = spark.createDataFrame([("p", "A")], "source_path string, file_sha256 string")
    assert store.migrate(old).first()["active"] is True


@pytest.mark.parametrize(
    "source",
    ["(Değişik:RG-24/2/2017-29989)", "RG-24/2/2017-29989", "Resmî Gazete'de", "GEÇİCİ MADDE 12/A", "3 üncü maddesinin", "birinci maddesinde", "6446 sayılı Kanun", "Karar No: 10543", "ELEKTRİK PİYASASI LİSANS YÖNETMELİĞİ", "Doğal Gaz Piyasası Kanununun", "Aynı Yönetmeliğin", "24/2/2017", "18 Nisan 2001"],
)
def test_scrubbing(one, source):
    got = one(answer.scrub_context(F.col("t")), t=f"önce {source} sonra lisans süresi")
    assert source not in got and "[…]" in got and "lisans süresi" in got
    assert one(answer.scrub_context(F.col("t")), t=got) == got


def test_scrubbing_own_terms_and_runs(one):
    c = answer.scrub_context(F.col("t"), F.array(F.lit("Özel Belge Adı"), F.lit("Öz"), F.lit(None).cast("string")))
    assert one(c, t="bkz. özel belge adı ve Öz [uyum]") == "bkz. […] ve Öz [uyum]"
    assert one(answer.scrub_context(F.col("t")), t="24/2/2017  1.1.2026 metin") == "[…] metin"


@pytest.mark.parametrize(
    "text, labels",
    [("Süre (KAYNAK 1).", [1]), ("[KAYNAK 2] x [kaynak 1]", [2, 1]), ("KAYNAK 1 ve 2", [1, 2]), ("KAYNAK 1, 2 ve 3", [1, 2, 3]), ("KAYNAK 1-3", [1, 3]), ("KAYNAK 1 sonra KAYNAK 1", [1]), ("yok", []), ("", [])],
)
def test_labels(one, text, labels):
    assert one(answer.parse_labels(F.col("t")), t=text) == labels


def test_budget_is_a_prefix(spark):
    rows = spark.createDataFrame([(0, i, i, "söz " * n) for i, n in ((1, 5), (2, 50), (3, 1))], "query_id long, id long, label int, text string")
    for available, kept in ((0, []), (30, [1]), (180, [1, 2]), (1000, [1, 2, 3])):
        got = answer.fit(rows, spark.createDataFrame([(0, available)], "query_id long, available int"))
        assert sorted(r.label for r in got.collect()) == kept


def test_answer_states(spark):
    q = spark.createDataFrame([(i, "soru nedir") for i in range(6)], "query_id long, text string")
    judged = spark.createDataFrame([(0, 0.1, "NOT_FOUND"), *((i, 0.5, "ANSWER") for i in range(1, 5)), (5, 0.2, "ANSWER_WEAK")], "query_id long, confidence double, decision string")
    results = spark.createDataFrame([(i, 100 + i, 1, "söz " * (3000 if i == 1 else 5) + f"s{i}", None, None) for i in range(6)], "query_id long, id long, rank int, text string, document_title string, article_ref string")

    def model(prompts):
        if "s0" in prompts[0].split("\n\nSORU")[-2]:
            raise AssertionError("the gate was passed over")
        if "s2" in prompts[0]:
            raise RuntimeError("CUDA out of memory")
        if "s3" in prompts[0]:
            raise RuntimeError("no route")
        return ["<think>x" if "s4" in prompts[0] else "**Başlık**\nCevap (KAYNAK 1, 7)."]

    rows = {r.query_id: r for r in answer.answer_all(q, judged, results, model).collect()}
    assert [rows[i].status for i in range(6)] == ["not_found", "context_exhausted", "context_exhausted", "generation_failed", "empty", "generated"]
    done = rows[5]
    assert (done.text, done.labels, done.citations, done.hallucinated_labels, done.low_confidence) == ("Cevap (KAYNAK 1, 7).", [1, 7], [105], [7], True)
    assert rows[0].chunks_dropped == 1 and done.chunks_dropped == 0 and DEFAULTS.context_budget == 3004


@pytest.mark.parametrize("question, depends", [("Peki bu süre uzatılabilir mi?", True), ("Süresi ne kadar?", True), ("ayrica basvuru gerekir mi bunun icin", True), ("Dağıtım bağlantı bedeli nasıl hesaplanır ve kim öder?", False), ("", False), ("?!", False)])
def test_follow_ups(one, question, depends):
    assert one(conversation.looks_like_follow_up(F.col("t")), t=question) is depends


@pytest.mark.parametrize("candidate, good", [("Önlisans süresi uzatılır mı?", True), ("YENİ", False), ("yeni soru?", False), ("Evet, uzar?", False), ("Uzatılır.", False), ("", False), ("a" * 300 + "?", False)])
def test_rewrites(one, candidate, good):
    assert one(conversation.rewrite_accepted(F.lit("Peki süre?"), F.col("t")), t=candidate) is good


def test_history_is_bounded_and_condensed(spark):
    long = "Birinci cümle. " * 60
    turns = spark.createDataFrame([(1, i, f"s{i}", long if i == 4 else f"c{i} (KAYNAK 1)") for i in range(1, 7)], "conv_id long, exchange int, question string, answer string")
    rows = {r.exchange: r.history for r in conversation.history(turns).collect()}
    assert rows[1] is None and rows[2] == "[Önceki tur]\nKullanıcı: s1\nAsistan: c1 ()"
    assert "s2" not in rows[6] and rows[6].count("Kullanıcı") == 3 and 10 < rows[6].count("Birinci") < 60


def test_quality_flags(spark):
    rows = [("", [(1, "", True)]), ("x" * 50, [(None, "x", False)]), ("ş" + "metin " * 60, [(1, "a", False), (2, " ", False), (3, "", True)])]
    df = spark.createDataFrame(rows, "text string, pages array<struct<number:int,text:string,needs_ocr:boolean>>")
    got = [[f.split(":")[0] for f in r["f"]] for r in df.select(quality.quality_flags(F.col("text"), F.col("pages")).alias("f")).collect()]
    assert got == [["needs-ocr", "empty"], ["near-empty", "no-turkish-chars", "gibberish-run"], ["needs-ocr", "empty-pages"]]


def test_running_lines(spark):
    rows = [("d", i, f"Üst bilgi\nmetin {'abc'[i - 1]} satırı\ngövde\n{i}") for i in (1, 2, 3)] + [("e", 1, "Üst bilgi\n5")]
    got = {(r.doc_id, r.number): r.text for r in quality.strip_repeating_lines(spark.createDataFrame(rows, "doc_id string, number int, text string")).collect()}
    assert got[("d", 1)] == "metin a satırı" and got[("e", 1)] == "Üst bilgi"


def test_embedding_service(spark):
    calls = services.hashing_embedder(8)
    rows = spark.createDataFrame([("a b",), (None,), ("a b",)], "t string").select(services.embed(F.col("t"), calls).alias("v")).collect()
    assert rows[0].v == rows[2].v and len(rows[0].v) == 8 and rows[1].v is None
    with pytest.raises(ValueError):
        services.with_retries(lambda b: (_ for _ in ()).throw(ValueError("size")), [], DEFAULTS, lambda s: pytest.fail("waited"))
    waits = []
    with pytest.raises(OSError):
        services.with_retries(lambda b: (_ for _ in ()).throw(OSError("down")), [], DEFAULTS, waits.append)
    assert waits == [1, 2]


def test_pipelines(spark, tmp_path):
    text = "ELEKTRİK PİYASASI LİSANS YÖNETMELİĞİ\nKarar No: 10543\nMADDE 1 – Önlisans süresi yirmi dört aydır.\nMADDE 2 – Dağıtım bedeli kurul tarafından belirlenir."
    docs = spark.createDataFrame([("d1", "p/1", "sha1", "ok", [], text, None, [(None, text, False)])], "doc_id string, path string, file_sha256 string, status string, flags array<string>, text string, page_note string, pages array<struct<number:int,text:string,needs_ocr:boolean>>")
    embed = services.hashing_embedder()
    root = str(tmp_path / "store")
    store.write_snapshot(pipelines.ingest(store.read_snapshot(spark, root), docs, embed), root)
    current = store.read_snapshot(spark, root)
    assert current.where("active AND indexable").count() == 2
    found = pipelines.ask(current, spark.createDataFrame([(0, "önlisans süresi yirmi dört aydır"), (1, "rafineri stok")], "query_id long, text string"), embed, services.echo_generator, Params())
    found = tables.settle(found)
    rows = {r.query_id: r for r in found.collect()}
    assert rows[0].status == "generated" and len(rows[0].citations) == 1 and rows[1].decision == "NOT_FOUND"
    again, timings = pipelines.ask_timed(current, spark.createDataFrame([(0, "önlisans süresi yirmi dört aydır"), (1, "rafineri stok")], "query_id long, text string"), embed, services.echo_generator)
    assert sorted(again.collect()) == sorted(found.collect())
    spent = {r.stage: r.seconds for r in timings.collect()}
    assert list(spent) == ["embed", "index", "retrieve", "generate", "total"] and 0 < sum(spent.values()) - spent["total"] <= spent["total"]
    turns = spark.createDataFrame([(7, 1, "önlisans süresi ne kadardır bana anlat", "yirmi dört ay"), (7, 2, "peki bu süre?", None)], "conv_id long, exchange int, question string, answer string")
    talked = pipelines.converse(current, turns, embed, lambda prompts: ["Önlisans süresi kaç aydır?"]).first()
    assert talked.was_follow_up and talked.rewritten_query == "Önlisans süresi kaç aydır?"

    # Every question in turn: a rewrite sees the answer before it, refusals included.
    def model(prompts):
        asked = prompts[0]
        if not asked.startswith(conversation.REWRITE_TASK):
            return services.echo_generator(prompts)
        recap = asked.rpartition("[Önceki tur]")[2]
        assert recap.endswith(conversation.REWRITE_TASK) and asked.count("SON SORU: ") == 3
        return ["Dağıtım bedeli kurul tarafından mı belirlenir?" if "yirmi dört aydır" in recap else "Stok yükümlülüğünün istisnası nedir?" if "bulunamadı" in recap else "YENİ"]

    turns = [(7, 1, "önlisans süresi yirmi dört aydır"), (7, 2, "peki bu bedel?"), (8, 1, "rafineri stok yükümlülüğü kapsamı nedir acaba"), (8, 2, "bunun istisnası?"), (9, 1, "peki bu?")]
    rows = {(r.query_id, r.exchange): r for r in pipelines.converse_all(current, spark.createDataFrame(turns, "conv_id long, exchange int, question string"), embed, model).collect()}
    assert len(rows) == 5 and not any(rows[k].was_follow_up for k in ((7, 1), (8, 1), (9, 1)))
    assert rows[7, 1].status == "generated" and rows[7, 2].rewritten_query.startswith("Dağıtım bedeli") and rows[7, 2].question == "peki bu bedel?"
    assert rows[8, 1].status == "not_found" and rows[8, 2].rewritten_query == "Stok yükümlülüğünün istisnası nedir?"
    assert pipelines.converse_all(current, spark.createDataFrame([], "conv_id long, exchange int, question string"), embed, model).count() == 0

    questions = spark.createDataFrame([(0, "önlisans süresi yirmi dört aydır", True), (1, "rafineri stok", False)], "query_id long, text string, answerable boolean")
    probes = tables.settle(pipelines.probe(current, questions, embed))
    p = {r.query_id: r for r in probes.collect()}
    assert p[0].fused > 0.3 and p[0].coverage == 1 and p[0].dense > p[1].dense and p[1].fused == 0 and p[0].top is not None
    assert p[0].fused_folded == pytest.approx(p[0].dense_folded * 1, abs=0.5) and p[0].fused_folded <= p[0].fused
    accuracy = {r.path: r for r in evaluate.path_accuracy(probes, (0.6, 0.3), (0.33, 0.19)).collect()}
    assert accuracy["fused"].right_typed == 2 and accuracy["dense"].total == 2
    assert tuple(evaluate.off_domain_sweep(probes.withColumn("off_domain", ~F.col("answerable")), 0.33, 0.19).first()) == (1, 1)

    results, judged = map(tables.settle, pipelines.retrieve(current, questions, embed))
    said = {r.decision: r for r in evaluate.retrieval_report(results, judged).collect()}
    assert said["NOT_FOUND"].queries == 1 and sum(r.both + r.dense_only + r.lexical_only for r in said.values()) == results.count()
    report = {r.status: r for r in evaluate.answer_report(found).collect()}
    assert report["generated"].answers == 1 and report["generated"].cited == 1 and report["not_found"].cited == 0

    again = pipelines.reprocess(current, docs, spark.createDataFrame([("p/1",), ("p/none",)], "source_path string"), embed)
    assert again.where("active").count() == current.where("active").count()
    assert pipelines.reprocess(current, docs.limit(0), spark.createDataFrame([("p/1",)], "source_path string"), embed).count() == 0


def test_stand_in_generator_answers_from_the_first_source_not_from_the_example():
    head = f"{answer.DEFAULT.example_user}\n\n{answer.DEFAULT.example_answer}"
    assert services.echo_generator([f"{head}\n\nKAYNAK 1:\nBedel ödenir.\nSonra.\n\nKAYNAK 2:\nx\n\nSORU: y", "no source"]) == ["Bedel ödenir. (KAYNAK 1).", ""]
