import json

import pytest
from pyspark.sql import functions as F

from granthika.functions import dates, ids, text, urls
from granthika.operators import dedup, documents, evidence, html, retrieval, sections, store


def values(spark, expr, rows, kind="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], kind).select(expr).collect()]


def test_text_cleaning(spark):
    x = F.col("x")
    assert values(spark, text.clean_block(x), ["a  b​[ TABLE ]\r\n\r\n\r\n\r\nc \n d", None, "  "]) == ["a b\n\nc\nd", None, ""]
    assert values(spark, text.clean_web(x), ["<p>a</p>\n<b>b</b>", None]) == ["a b", None]
    assert values(spark, text.clean_social(x), ["a &amp; b?c\\nd\te", None, "&#39;"]) == ["a & b? c\nd e", None, "'"]
    assert values(spark, text.clean_scanned(x), ["a\x07  \n\n\n\nb ", None]) == ["a\n\nb", None]
    assert values(spark, text.script_language(x), ["hello", "नमस्ते ab", "", "न hello world text"]) == ["en", "hi", "en", "en"]
    assert values(spark, text.is_heading(x), ["Background", "About us", "1. Aim of it", "IV) Scope", "Note:", "plain words", None]) == [True, True, True, True, True, False, False]
    assert values(spark, text.heading_name(x), ["2) Scope:", "Details"]) == ["Scope", "Details"]
    assert values(spark, text.important_text(x, "pump", 90, 10), ["First one says pump pump. Nothing here at all really. Last pump is here now.", None]) == ["First one says pump pump. Nothing here at all really. Last pump is here now.", None]
    assert values(spark, text.important_text(x, "pump", 30, 10), ["Nothing here at all. The pump, a pump is old."]) == ["The pump, a pump is old."]


def test_urls_and_ids(spark):
    x = F.col("x")
    assert values(spark, urls.host(x), ["https://www.A.example:80/x", "no url", None]) == ["a.example", None, None]
    assert values(spark, urls.on_whitelist(x, ["a.example"]), ["http://b.a.example/", "http://ba.example", None]) == [True, False, False]
    assert values(spark, urls.release_number(x), ["?prid = 12", "x", None]) == ["12", None, None]
    import uuid

    assert values(spark, ids.uuid5(uuid.NAMESPACE_DNS, x), ["d:0", "é", None]) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, "d:0")), str(uuid.uuid5(uuid.NAMESPACE_DNS, "é")), None]


def test_release_dates(spark):
    rows = ["10 MAY 2025 2:31PM", "10-06-2025 14:31:05", "2025-06-10T14:31:00Z", "2025-06-10", "10/06/2025 2:31 PM", "10 Jun 2025 2:31 PM", "10 Jun 2025 14:31", "x 1.2.2024 3:04 y", "31-02-2025", None, ""]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, d string")
    got = [r[0] for r in dates.with_release_instant(df, "d").orderBy("i").select(dates.iso_utc(F.col("instant"))).collect()]
    assert got == ["2025-05-10T09:01:00Z", "2025-06-10T09:01:05Z", "2025-06-10T14:31:00Z", "2025-06-09T18:30:00Z", None, None, "2025-06-10T09:01:00Z", "2024-01-31T21:34:00Z", None, None, None]
    assert values(spark, dates.iso_utc(dates.social_instant(F.col("x"))), ["Wed Oct 10 20:19:24 +0530 2018", "x", None]) == ["2018-10-10T14:49:24Z", None, None]


def test_adapters(spark):
    content = json.dumps({"source_type": "web_page", "sections": [{"section_id": "s", "heading": None, "content": "a"}, {"section_id": "t", "content": "b"}]})
    meta = json.dumps({"retrieved_at": "2024-01-01", "source_type": "report", "url": "https://x.example/1"})
    kind = "id long, document_id string, url string, title string, published_at string, language string, organization string, metadata_json string, content_json string"
    rows = [(1, "d1", " ", None, "", "en", "o", meta, content), (2, "d2", "https://y.example", "t", "x", "e", None, "[1]", content[:-5]), (3, None, None, None, None, None, None, None, None)]
    out = {r.id: r for r in documents.release_documents(spark.createDataFrame(rows, kind)).collect()}
    assert (out[1].content, out[1].url, out[1].source_type, out[1].errors) == ("a\n\nb", "https://x.example/1", "web_page", [])
    assert set(out[2].errors) >= {"content_json", "metadata_json", "publisher", "language"} and "document_id" in out[3].errors
    valid, rejected = documents.split_valid(documents.release_documents(spark.createDataFrame(rows, kind)))
    assert valid.count() == 1 and rejected.count() == 2
    with pytest.raises(Exception, match="invalid row"):
        documents.require_valid(documents.release_documents(spark.createDataFrame(rows, kind)), "id").collect()
    with pytest.raises(ValueError, match="columns are missing: b"):
        documents.check_columns(spark.createDataFrame([(1,)], "a int"), ["a", "b"])
    assert values(spark, documents.missing_keys(F.col("x"), ["a", "b"]), ['{"a": 1}', "no", None]) == [["b"], ["a", "b"], ["a", "b"]]


def test_dedup_and_store(spark):
    r = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, None, "z"), (5, None, "z")], "id long, k string, l string")
    assert [x.id for x in dedup.first_by(r, ["k"], ["id"]).orderBy("id").collect()] == [1, 3, 4]
    assert [x.id for x in dedup.last_by(r, ["k"], ["id"]).orderBy("id").collect()] == [2, 3, 5]
    assert sorted(x.id for x in store.insert_or_ignore(r.where("id = 1"), r.where("id > 1"), ["k", "l"], "id").collect()) == [4]
    assert store.insert_or_ignore(r.limit(0), r.limit(0), ["k"], "id").count() == 0
    up = store.upsert_documents(r, spark.createDataFrame([(9, "a", "new")], r.schema), "k")
    assert sorted(x.id for x in up.collect()) == [3, 4, 5, 9]
    filled = store.fill_missing(r.withColumn("l", F.when(F.col("id") == 3, "").otherwise(F.col("l"))), spark.createDataFrame([("b", "fix")], "k string, l string"), "k", "l")
    assert {x.id: (x.l, x.repaired) for x in filled.collect()}[3] == ("fix", True)


def test_versions_and_progress(spark, tmp_path):
    t = store.BucketedTable(spark, f"file://{tmp_path}/t", "d", 16)
    assert t.read() is None
    t.upsert(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 5)], "d string, n int"))
    untouched = {f for f in t.read().inputFiles() if spark.read.parquet(f).where("d = 'a'").isEmpty()}
    for _ in range(2):
        t.upsert(spark.createDataFrame([("a", 7)], "d string, n int"))
    assert sorted((r.d or "", r.n) for r in t.read().collect()) == [("", 5), ("a", 7), ("b", 1)]
    assert untouched <= set(t.read().inputFiles())
    p = spark.createDataFrame([("31-01-2025", "completed"), ("01-02-2025", "failed"), ("03-02-2025", "completed")], "crawl_date string, status string")
    assert [(str(r.day), r.status) for r in store.missing_days(p).orderBy("day").collect()] == [("2025-02-01", "failed"), ("2025-02-02", None)]
    assert str(store.resume_day(p).first()[0]) == "2025-02-01"
    begun = store.started_days(p, F.lit("t0"))
    assert sorted((r.crawl_date, r.status) for r in begun.collect()) == [("01-02-2025", "running"), ("02-02-2025", "running")]
    outcomes = spark.createDataFrame([("01-02-2025", None, None, None)], "crawl_date string, found int, added int, error string")
    ended = {r.crawl_date: r for r in store.ended_days(begun, outcomes, F.lit("t1")).collect()}
    assert (ended["01-02-2025"].status, ended["01-02-2025"].documents_found, ended["01-02-2025"].completed_at) == ("completed", 0, "t1")
    assert (ended["02-02-2025"].status, ended["02-02-2025"].documents_added, ended["02-02-2025"].completed_at) == ("running", None, None)
    bad = store.ended_days(begun, outcomes.select("crawl_date", F.lit(4).alias("found"), "added", F.lit("x" * 3000).alias("error")), F.lit("t1")).where("status = 'failed'").first()
    assert len(bad.error) == 2000 and bad.documents_found == 4
    assert str(store.resume_day(p.where("status = 'completed'").limit(1)).first()[0]) == "2025-02-01"


def test_html_to_sections(spark):
    page = """<html><body><nav><p>Menu</p></nav><div class="ad-share"><p>Share</p></div><article><p>Release ID: 12</p><h1>Title</h1><p>First <b>bold</b><p>Second
    <h2>Background</h2><ul><li>x</li><li>y<ul><li>deep</li></ul></li></ul><ol><li>p</li><li></li><li>q</li></ol><p>first   BOLD</p><p>Details:</p><table><tr><td>a</td><th>b</th></tr></table><h2>Empty</h2></article></body></html>"""
    df = spark.createDataFrame([(1, page), (2, None)], "id long, html string")
    blocks = html.parse_blocks(df, "id")
    out = sections.infer_sections(blocks, "id", F.lit("D")).orderBy("id", "section_no").collect()
    assert [tuple(s)[2:] for s in out] == [("D-S01", "Title", "First bold\n\nSecond"), ("D-S02", "Background", "• x\n• y\n\n1. p\n3. q"), ("D-S03", "Details", "a | b")]
    assert [tuple(r) for r in sections.has_tables(blocks, "id").collect()] == [(1, True)] and html.titles(blocks, "id").first().title == "Title"
    assert sections.infer_sections(html.parse_blocks(df.limit(0), "id"), "id").count() == 0
    whole = page.replace("12", " 77 ").replace("<article>", "<article><p>Ministry of X</p><p>Posted On: 4 March 2024 1:05PM by PIB Town</p>") + "long text " * 40
    bare = "<div>posted on: never. release id : none " + "x " * 200 + "</div>"
    index = [("a", whole.replace("</article>", "<p>" + "long text " * 40 + "</p></article>"), "u", "1", "T", None), ("b", bare, "v", "2", "Given", "05-03-2024"), ("c", "", "w", "3", None, None), (None, bare, "v", "2", None, None)]
    made = {r.k: r for r in html.page_documents(spark.createDataFrame(index, "k string, html string, url string, release_id string, title string, published_at string"), "k").collect()}
    assert set(made) == {"a", "b"} and (made["a"].document_id, made["a"].title, made["a"].organization, str(made["a"].published_at)) == ("PIB-77", "Title", "Ministry of X", "2024-03-04 07:35:00")
    assert (made["b"].document_id, made["b"].title, made["b"].organization, str(made["b"].published_at)[:10]) == ("PIB-2", "Given", "Press Information Bureau", "2024-03-04")
    assert made["a"].has_tables and [s.section_id for s in made["b"].sections] == ["PIB-2-S01"] and made["b"].sections[0].heading == "Main Content"
    nested = "<article><table><tr><td>a<table><tr><td>in</td></tr></table></td><td> b </td></tr></table></article>"
    assert [r.text for r in html.parse_blocks(spark.createDataFrame([(1, nested)], "id long, html string"), "id", markers=()).collect()] == ["a | b\nin"]
    kind = "page long, pos int, href string, onclick string, text string"
    found = [(1, 0, "https://h.example/x?PRID=5", None, "old"), (1, 1, "/x?prid=5", None, "new"), (2, 0, None, "open('PRID = 6')", "six"), (2, 1, "https://other.example?PRID=7", None, "x"), (2, 2, "#", None, None)]
    assert sorted(tuple(r) for r in html.release_links(spark.createDataFrame(found, kind), "page", "https://h.example/?PRID=", "h.example").collect()) == [("5", "https://h.example/?PRID=5", "new"), ("6", "https://h.example/?PRID=6", "six")]
    links = html.anchors(spark.createDataFrame([(1, '<a href="/x?PRID=5">t<b>u</b></a><a onclick="go(6)">v</a>')], "id long, html string"), "id").orderBy("pos").collect()
    assert [(r.href, r.onclick, r.text) for r in links] == [("/x?PRID=5", None, "tu"), (None, "go(6)", "v")]


def test_retrieval(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [2.0, 0.0])], "item_id long, vector array<double>")
    q = v.where("item_id in (1, 3)").withColumnRenamed("item_id", "query_id")
    for block in (1, 100):
        got = [(r.query_id, r.item_id) for r in retrieval.dense_top(v, q, 2, block=block).orderBy("query_id", "rank").collect()]
        assert got == [(1, 1), (1, 6), (3, 3), (3, 1)]
    docs = spark.createDataFrame([(1, "Solar pumps for farms"), (2, "solar solar"), (3, None), (4, "")], "item_id long, text string")
    claims = spark.createDataFrame([(7, ["solar", "pumps"]), (8, [" ", "none"]), (9, None)], "query_id long, keywords array<string>")
    assert [(r.query_id, r.item_id, r.score, r.keyword_pos) for r in retrieval.relevance(docs, claims).orderBy("item_id").collect()] == [(7, 1, 6, 0), (7, 2, 2, 0)]
    hindi = spark.createDataFrame([(1, "सौर पंप योजना, c++-pumps"), (2, "सौरपंप"), (3, "solar\u00a0 pumps!"), (4, "solar, pumps solar_pumps")], "item_id long, text string")
    asked = spark.createDataFrame([(7, ["सौर", "पंप"]), (8, ["solar pumps", "C++"]), (9, ["++", "Solar"])], "query_id long, keywords array<string>")
    assert sorted((r.query_id, r.item_id, r.score) for r in retrieval.relevance(hindi, asked).collect()) == [(7, 1, 6), (8, 1, 1), (8, 3, 2), (9, 3, 1), (9, 4, 1)]
    assert sorted((r.query_id, r.item_id) for r in retrieval.relevance(hindi, asked, least=2).collect()) == [(7, 1), (8, 3)]
    assert retrieval.relevance(hindi.limit(0), asked).count() == retrieval.relevance(hindi, asked.limit(0)).count() == 0
    assert {(r.query_id, r.token, r.weight) for r in retrieval.token_weights(claims.selectExpr("query_id", "keywords[0] as text"), "query_id", "text").collect()} == {(7, "solar", 1.0)}
    query = spark.createDataFrame([(7, "solar", 1.0)], "query_id long, token string, weight double")
    sparse = retrieval.sparse_top(docs, query, 5)
    assert [(r.item_id, r.score) for r in sparse.orderBy("rank").collect()] == [(2, 2.0), (1, 1.0)]
    assert retrieval.fuse([sparse, sparse]).count() == 2
    assert retrieval.hybrid(docs, spark.createDataFrame([(7, "solar pumps")], "query_id long, text string"), "text").first().item_id == 1
    assert values(spark, retrieval.search_text(F.col("x")), [["A b", "c"], ["c", " "], []], "x array<string>") == ['"a b"', '"c"', ""]


def test_evidence(spark):
    ev = spark.createDataFrame([(1, 1, "c1", "text"), (1, 2, "c2", None)], "q long, source_number int, chunk_id string, content string")
    for c in ("title", "publisher", "author", "url", "published_at", "section_heading"):
        ev = ev.withColumn(c, F.lit(None).cast("string"))
    context = evidence.build_context(ev.withColumn("question", F.lit("Q")), "q", "question").first().context
    assert context.startswith("USER QUESTION:\nQ\n\nRETRIEVED SOURCES:\n\nSOURCE 1\nChunk ID: c1\nTitle: Unknown") and "SOURCE 2" in context
    raw = [(1, '{"answer":"a","citations":[2,2,9],"verdict":"true","confidence":3}'), (2, '{"answer":"a","citations":[1],"verdict":"true","confidence":3}'), (3, "{")]
    more = ev.unionByName(ev.limit(1).withColumn("q", F.lit(3).cast("long")))
    out = {r.q: r for r in evidence.validated_answers(spark.createDataFrame(raw, "q long, raw_output string"), more, "q").collect()}
    assert out[1].citations == [2] and out[2].answer == evidence.NO_EVIDENCE and out[3].error == "malformed output"


def test_social_posts(spark):
    kind = "id string, text string, url string, lang string, created_at string, author_handle string, author_name string, hashtags array<string>, mentions array<string>, urls array<struct<url:string,expanded_url:string>>, _clean string"
    rows = [("1", "a &amp; b https://x.example/1. https://y.example", "u", "en", "Wed Oct 10 20:19:24 +0000 2018", "h", "n", ["#T", ""], ["@m"], [("https://y.example", "https://long.example")], "x"), ("2", None, None, None, None, None, None, None, None, None, None)]
    out = {r.doc_id: r for r in documents.social_records(spark.createDataFrame(rows, kind).drop("_clean")).collect()}
    first = out["X_1"]
    assert first.content.clean_text == "a & b https://x.example/1. https://y.example" and first.dates.published_at == "2018-10-10T20:19:24Z"
    assert [u.url for u in first.entities.urls] == ["https://y.example", "https://x.example/1"] and first.entities.hashtags == ["T"] and first.entities.mentions == ["m"]
    assert out["X_2"].content.clean_text is None and out["X_2"].entities.urls == []


def test_publisher_line_and_best_pass(spark):
    page = "Government of India\nMinistry of Soil\nPosted On: today\nThe title\nbody"
    assert values(spark, text.publisher_line(F.col("x"), F.lit("The title")), [page, "The title\nx", "no", None]) == ["Ministry of Soil", None, None, None]
    rows = [("a", 1, 50.0, 30), ("a", 2, 90.0, 30), ("a", 3, 99.0, 30), ("b", 1, None, 0), ("b", 2, None, 5), ("c", 1, 10.0, 0)]
    best = dedup.best_pass(spark.createDataFrame(rows, "k string, n int, conf double, len int"), ["k"], "n", "conf", "len")
    assert {(r.k, r.n) for r in best.collect()} == {("a", 2), ("b", 2)}


def test_display_verdict(spark):
    assert values(spark, evidence.display_verdict(F.col("x")), [" Verified", "FALSE", "?", None]) == ["true", "false", "unverifiable", "unverifiable"]


def test_excerpts_follow_the_claims(spark, tmp_path):
    from granthika.plans.retrieval_queries import web_evidence

    rest = " ".join(f"Filler sentence number {i} stands here to take up some of the room." for i in range(60))
    page = f"{rest} The new wells of the valley were counted last week. Farmers got सौर पंप in every village of the hills. The old school roof was mended after heavy rain."
    claims = [(1, "q", ["wells", "valley"]), (2, "q", ["school roof", None]), (3, "q", ["village", "सौर पंप"]), (4, "q", ["farmers"])]
    spark.createDataFrame(claims, "query_id long, query string, keywords array<string>").write.parquet(f"{tmp_path}/claim_queries.parquet")
    spark.createDataFrame([(7, ("https://news.pib.example/x",), (page,))], "record_no long, source struct<source_url:string>, content struct<clean_text:string>").write.parquet(f"{tmp_path}/webscraper_output.parquet")
    out = {r.query_id: r.excerpt for r in web_evidence(spark, str(tmp_path)).collect()}
    wanted = {1: "wells of the valley", 2: "school roof", 3: "सौर पंप", 4: "Farmers got"}
    assert out.keys() == wanted.keys() and all(w in out[q] and len(out[q]) <= 2100 for q, w in wanted.items())
    assert "school roof" not in out[1] and "wells" not in out[2]
    x = spark.createDataFrame([("One long sentence about a pump stands here. Another long sentence on सड़क is here.", t) for t in ("pump", "सड़क", "", None)], "t string, k string")
    got = [r[0] for r in x.select(text.important_text(x.t, x.k, 50)).collect()]
    assert [g[:3] for g in got] == ["One", "Ano", "One", "One"]


def test_chunks_points_and_metadata(spark, tmp_path):
    chunks = spark.createDataFrame([("a", i, "x") for i in range(5)] + [("b", 0, None), (None, 0, "x")], "document_id string, chunk_index int, _rn string")
    asked = spark.createDataFrame([("a",), ("a",), (None,), ("z",)], "document_id string")
    assert sorted((r.document_id, r.chunk_index) for r in store.chunks_of(chunks.drop("_rn"), asked, 3).collect()) == [("a", 0), ("a", 1), ("a", 2)]
    points = spark.createDataFrame([("p", "t", "en", [1.0, 2.0]), ("q", "t", None, [1.0, 2.0])], "point_id string, source_type string, language string, vector array<double>")
    at = f"{tmp_path}/points"
    assert store.ensure_loaded(spark, at, points, 2).count() == 2
    assert store.ensure_loaded(spark, at, points.where("point_id = 'p'"), 2).count() == 2
    wider = points.where("point_id = 'p'").withColumn("vector", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    assert store.ensure_loaded(spark, at, wider, 1).count() == 1 and store.ensure_loaded(spark, at, points, 9).count() == 2
    given = ['{"a": {"b": [1, "x"]}, "published_at": null}', "no json", "[1]", None]
    got = values(spark, store.with_metadata_value(F.col("x"), "published_at", F.lit('2024 "q"')), given)
    assert [json.loads(g) for g in got] == [{"a": {"b": [1, "x"]}, "published_at": '2024 "q"'}] + [{"published_at": '2024 "q"'}] * 3
    assert values(spark, store.with_metadata_value(F.col("x"), "k", F.lit(None).cast("string")), ["{}", None]) == ["{}", None]
    rows = spark.createDataFrame([("a", 12.0), ("a", float("nan")), ("b", None), ("c", -3.0), ("d", 5.0)], "k string, v double")
    from granthika.operators import analytics

    assert {r.k: r.mean_confidence for r in analytics.mean_confidence(rows, "v", "k").collect()} == {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.5}
    named = text.named_entities(F.col("x"), ("screen_name", "name"))
    assert values(spark, named, [[{"screen_name": "@a"}, {"screen_name": "", "name": "#b"}, {"other": "c"}], None], "x array<map<string,string>>") == [["a", "b"], None]


def test_web_evidence_follows_the_claim(spark):
    kind = "query_id long, url string, keyword_pos int, result_pos long, score long, has_content boolean"
    rows = [(1, "https://a.example/x", 0, 1, 5, True), (1, "https://a.example/x", 0, 2, 9, True), (1, "https://b.other/x", 0, 3, 9, True), (1, "https://a.example/y", 1, 4, 5, True), (1, "https://a.example/z", 0, 5, 9, None), (2, "https://a.example/x", 0, 1, 5, True), (1, None, 0, 6, 7, True)]
    found = spark.createDataFrame(rows, kind)
    best = lambda **x: [(r.query_id, r["rank"], r.result_pos) for r in retrieval.web_evidence(found, ["a.example"], **x).orderBy("query_id", "rank").collect()]
    assert best() == [(1, 1, 1), (1, 2, 4), (2, 1, 1)] and best(k=1) == [(1, 1, 1), (2, 1, 1)]
    assert best(answered=spark.createDataFrame([(1,), (1,), (None,)], "query_id long")) == [(2, 1, 1)]
    page = "Solar pumps help the farmers of the whole district here. The new bridge is open to all the traffic at last."
    two = spark.createDataFrame([(page, "solar pumps"), (page, "bridge")], "t string, k string")
    assert [r[0][:9] for r in two.select(text.important_text(F.col("t"), F.col("k"), 60)).collect()] == ["Solar pum", "The new b"]
