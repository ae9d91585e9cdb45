from logloom import queries


def test_semantic_topk_asks_for_every_twentieth(spark, tmp_path):
    parts = [(i, f"b{i % 7}", f"t{i % 11}", i % 3) for i in range(130)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = set()
    for q in parts[::20]:
        scored = [(round((0.25 * (q[1] == e[1]) + 0.15 * (q[2] == e[2]) + 0.1 * (q[3] == e[3]) + 0.35) / 0.85, 6), -e[0]) for e in parts if q[1] == e[1] or q[2] == e[2]]
        want |= {(q[0], -e, s, n) for n, (s, e) in enumerate(sorted(scored, reverse=True)[:10], 1)}
    assert {(r.query_id, r.entry_id, r.score, r.place) for r in queries.semantic_topk(spark, str(tmp_path)).collect()} == want


def test_recursive_trigger_indirect_follows_eleven(spark, tmp_path):
    rows = [(1, i, "signup", float(i % 2 * 20)) for i in range(28)] + [(2, 90, "signup", 1.0), (2, 91, "click", 1.0), (2, 92, "signup", 2.0)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, event_type string, value double")
    df.selectExpr("*", "timestamp_seconds(event_id) AS ts", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    want = {(1, i): min(11, 14 - i // 2) for i in range(28)} | {(2, 90): 2, (2, 92): 1}
    assert {(r.log_id, r.id): r.n for r in queries.recursive_trigger_indirect(spark, str(tmp_path)).collect()} == want


def test_keyword_search_reads_all_languages(spark, tmp_path):
    rows = [(1, "the token", "en"), (2, "Apache et the", "fr"), (3, "nada", "es"), (4, "License", None), (5, None, "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.hits for r in queries.keyword_search(spark, str(tmp_path)).collect()} == {1: 2, 2: 2, 4: 1}
