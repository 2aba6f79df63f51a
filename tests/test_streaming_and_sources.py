import json

from granthika.operators.store import AppendedTable, BucketedTable
from granthika.sources import readers, writers
from granthika.streaming import ingest


def test_stream_adds_once(spark, tmp_path):
    src, out = f"{tmp_path}/in", AppendedTable(spark, f"file://{tmp_path}/t")
    a = spark.createDataFrame([(1, "r1"), (2, "r1"), (3, "r2")], "id long, release_id string")
    for part in (a, spark.createDataFrame([(4, "r2"), (5, "r3")], a.schema)):
        part.write.mode("append").parquet(src)
        ingest.ingest_new(spark, src, a.schema, out, ["release_id"], "id", f"{tmp_path}/c")
        out.add(part, ["release_id"], "id")  # run again after a failure
    assert sorted(r.id for r in out.read().collect()) == [1, 3, 5]


def test_stream_replaces_documents(spark, tmp_path):
    src, out = f"{tmp_path}/in", BucketedTable(spark, f"file://{tmp_path}/t", "d", 4)
    a = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "d string, n int")
    for part in (a, spark.createDataFrame([("a", 9)], a.schema)):
        part.coalesce(1).write.mode("append").parquet(src)
        ingest.ingest_documents(spark, src, a.schema, out, f"{tmp_path}/c")
    assert sorted((r.d, r.n) for r in out.read().collect()) == [("a", 9), ("b", 1)]


def test_windows_batch_and_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    batch = ingest.windowed_counts(events, "ts", "event_type", "value")
    assert batch.selectExpr("sum(n)").first()[0] == events.count()
    events.write.parquet(f"{tmp_path}/e")
    stream = ingest.windowed_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e"), "ts", "event_type", "value")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").count() == batch.count()


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ab\xff")
    (tmp_path / "b.pdf").write_bytes(b"x")
    assert [(r.text, r.character_count) for r in readers.read_text_files(spark, f"{tmp_path}/*.txt").collect()] == [("ab�", 3)]
    assert sorted(r.route for r in readers.route_files(spark, f"{tmp_path}/*.*").collect()) == ["pdf", "text"]
    (tmp_path / "r.json").write_text(json.dumps({"record_no": 1, "doc_id": "d", "source": {"platform": "X"}}) + "\n{broken\n")
    rows = readers.read_live_records(spark, f"{tmp_path}/r.json").collect()
    assert rows[0].source.platform == "X" and rows[1]._broken is not None
    writers.write_json(spark.createDataFrame([(1,)], "a int"), f"{tmp_path}/j")
    writers.write_csv(spark.createDataFrame([(1,)], "a int"), f"{tmp_path}/c")
    writers.write_text(spark.createDataFrame([("x",)], "text string"), f"{tmp_path}/t")
    assert spark.read.json(f"{tmp_path}/j").first().a == 1 and spark.read.text(f"{tmp_path}/t").first()[0] == "x"


def test_rows_kept_by_either_side(spark):
    from granthika import session

    rows = spark.range(10)
    for bound in (1 << 20, 0):
        for cut in (2, 7):
            kept = session.only(rows, "id", rows.where(f"id > {cut}"), rows.where(f"id <= {cut}"), bound)
            assert sorted(r.id for r in kept.collect()) == list(range(cut + 1, 10))


def test_stored_tables_and_scratch(spark, tmp_path):
    from granthika import session

    built = []
    make = lambda: built.append(1) or spark.range(3)
    mark = session.uuid.uuid4().hex
    assert session.stored(spark, "t", mark, make).count() == session.stored(spark, "t", mark, make).count() == 3 and len(built) == 1
    spark.range(4).write.parquet(f"{tmp_path}/a")
    a = spark.read.parquet(f"{tmp_path}/a")
    before = session.fingerprint(a, "x")
    assert before == session.fingerprint(a, "x") != session.fingerprint(a, "y")
    spark.range(1).write.mode("append").parquet(f"{tmp_path}/a")
    assert before != session.fingerprint(spark.read.parquet(f"{tmp_path}/a"), "x")
    kept = session.materialise(spark.range(2), "gone")
    assert kept.count() == 2 and session.clear_scratch() > 0 and session.read_if_there(spark, kept.inputFiles()[0].rpartition("/")[0]) is None


def test_join_of_frequent_and_rare_keys(spark):
    from granthika import session

    rows = spark.createDataFrame([(i, "a" if i < 1500 else None if i < 1503 else f"k{i}") for i in range(1510)], "i int, key string")
    found = rows.where("key is not null").groupBy("key").count().withColumnRenamed("count", "n")
    inner, left = (session.join_counted(rows, found, "key", "n", how) for how in ("inner", "left"))
    assert inner.count() == 1507 and left.count() == 1510 and inner.where("key = 'a' and n = 1500").count() == 1500
    assert session.join_counted(rows.limit(0), found.limit(0), "key").count() == 0
