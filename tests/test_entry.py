import __spark_entry__ as entry


def test_keys_match():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and len(queries) > 60


def test_core_queries_run(spark, sf_dir):
    for name in ("corpus_distribution", "release_documents", "dense_topk", "missing_days", "p2_undecidable_by_field"):
        assert entry.queries()[name](spark, sf_dir).count() > 0
