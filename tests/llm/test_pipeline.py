import corpus_pipeline


def test_stages_keep_columns_and_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        if name != "encoding":
            assert out.columns == corpus_pipeline.COLUMNS
        assert 0.5 * n < out.count() <= docs.count() <= n
        docs = out
    assert docs.select("doc_id").distinct().count() == docs.count()


def test_odd_documents(spark, odd_docs, no_docs, sf):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        if name == "near_dedup":
            ids = [r["doc_id"] for r in docs.collect()]
            assert ids.count(4) == 1 and 8 not in ids and 1 not in ids and 7 not in ids and None in ids
    assert docs.count() > 0
    empty = no_docs
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_near_dedup_keeps_rows_not_ids(spark):
    def text(k):
        return " ".join(f"w{k}x{i}" for i in range(30))

    rows = [(1, text(0)), (1, text(0)), (2, text(1)), (2, text(2)), (None, text(3)), (None, text(4)), (None, text(5)), (5, text(5)), (None, text(6)), (None, text(6)), (7, text(0))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()]
    want = [(1, text(0)), (2, text(1)), (2, text(2)), (None, text(3)), (None, text(4)), (5, text(5)), (None, text(6))]
    assert sorted(got, key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])
