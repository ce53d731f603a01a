import corpus_pipeline


def test_stages_and_run(spark, small):
    from rasterloom.plans.scale import Written

    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = Written(stage(spark, docs, small), "test").df
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
            assert docs.where("n_chars <> char_length(text)").count() == 0
    assert counts[1] == counts[0] and counts[2] < counts[1] and counts[3] > 0
    got = corpus_pipeline.run(spark, small)
    assert got.count() == counts[-1]


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "packing"]
