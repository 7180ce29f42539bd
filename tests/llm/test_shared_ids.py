import corpus_pipeline


def test_unlike_texts_of_one_id_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = a.replace("a59", "other")
    rows = [(1, a), (1, b), (1, b), (1, near), (0, a), (2, c), (None, c), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_copies(spark, docs, "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(0, a), (1, b), (2, c), (None, c), (3, None)], key=str)
