import hashlib

from pyspark.sql import functions as F

from tonewright.functions import scores
from tonewright.operators import corpus, features, importance, metrics, reasoning, tfidf
from tonewright.operators.split import stratified_split
from tonewright.plans import catalog
from tonewright.plans.catalog import s6


def test_metrics_golden(spark):
    df = spark.createDataFrame(zip([0, 0, 1, 1, 1, 2], [0, 1, 1, 1, 2, 2]),
                               "label int, prediction int")
    r = metrics.classification_metrics(df).first().asDict()
    expected = {"accuracy": .666667, "precision_macro": .722222, "recall_macro": .722222,
                "f1_macro": .666667, "precision_weighted": .75, "recall_weighted": .666667,
                "f1_weighted": .666667}
    assert {k: round(v, 6) for k, v in r.items()} == expected
    cells = {(x.truth, x.prediction): x.n for x in metrics.confusion_matrix(df).collect()}
    assert len(cells) == 9 and cells[1, 1] == 2 and cells[2, 0] == 0
    assert metrics.error_analysis(df).first().total_errors == 2


def test_metrics_agree_with_spark_evaluator(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator as Evaluator

    df = spark.range(500).select((F.col("id") % 3).cast("double").alias("label"),
                                 (F.col("id") * 7 % 5 % 3).cast("double").alias("prediction"))
    ours = metrics.classification_metrics(df).first()
    for ours_name, name in (("accuracy", "accuracy"), ("f1_weighted", "f1"),
                            ("precision_weighted", "weightedPrecision")):
        assert abs(ours[ours_name] - Evaluator(metricName=name).evaluate(df)) < 1e-9


def test_split_sizes_membership_and_skew(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("label"))
    got = stratified_split(df)
    sizes = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert sizes == {"train": 79, "val": 9, "test": 12}
    skewed = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, 0).otherwise(2).alias("label"))
    found = {r.doc_id: r.split for r in stratified_split(skewed).collect()}
    for label in (0, 2):
        ids = [i for i in range(3000) if (0 if i % 100 == 0 else 2) == label]
        ids.sort(key=lambda i: (hashlib.md5(f"{i}:42".encode()).hexdigest(), i))
        for rank, i in enumerate(ids, 1):
            wanted = "train" if rank <= len(ids) * 8 // 10 else \
                "val" if rank <= len(ids) * 9 // 10 else "test"
            assert found[i] == wanted


def test_split_of_tiny_classes_and_unknown_labels(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, None), (4, 7)], "doc_id long, label int")
    got = {r.doc_id: r.split for r in stratified_split(df).collect()}
    assert got == {1: "test", 2: "test", 3: None, 4: None}


def test_preprocess_keeps_first_and_drops_blank(spark):
    rows = [(3, "A b!", "positive"), (1, "A b!", "neutral"), (2, " \u00a0", "negative"),
            (4, None, "neutral"), (5, "a b", "what")]
    df = spark.createDataFrame(rows, "doc_id long, sentence string, label string")
    got = [tuple(r) for r in corpus.preprocess(df).orderBy("doc_id").collect()]
    assert got == [(1, "a b", 1), (5, "a b", None)]
    already = df.withColumn("label", F.lit(2))
    assert corpus.encode_labels(already).schema["label"].dataType.simpleString() == "int"


def test_one_of_tied_rows_stays(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (1, "a b", "y"), (None, "a b", "x"), (None, "c", "x"), (None, "c", "x"),
            (2, None, "x"), (2, None, "x"), (3, "d", "x")]
    df = spark.createDataFrame(rows, "doc_id long, sentence string, label string").repartition(4)
    got = [(r.doc_id, r.sentence) for r in corpus.drop_duplicate_sentences(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "a b"), (None, "c"), (2, None), (3, "d")], key=str)
    kept = [(r.doc_id, r.sentence) for r in corpus.preprocess(df).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a b"), (None, "c"), (3, "d")], key=str)


def test_histogram_counts_every_row(spark):
    import numpy as np

    lengths = [1, 2, 2, 5, 9, 14, 30, 31, 31]
    df = spark.createDataFrame([("w " * n, "neutral") for n in lengths] + [("w", "positive")],
                               "sentence string, label string")
    got = corpus.length_histogram(df).where("label = 'neutral'").collect()
    counts, _ = np.histogram(lengths, bins=30)
    assert {r.bin: r.n for r in got} == {i: int(c) for i, c in enumerate(counts) if c}


def test_no_overlap_after_deduplication(spark):
    df = spark.range(60).select(F.col("id").alias("doc_id"),
                                F.concat(F.lit("s"), (F.col("id") % 50).cast("string")).alias("sentence"),
                                (F.col("id") % 3).cast("int").alias("label"))
    unique = corpus.drop_duplicate_sentences(df)
    assert unique.count() == 50
    assert corpus.split_overlap(stratified_split(unique)).count() == 0


def test_weights_compute_the_length_of_a_text_once(texts):
    rows = texts("gain gain loss", " ".join(f"word{i % 700}" for i in range(3000)), "", None, "loss")
    vocab = tfidf.fit_vocabulary(rows, min_df=1, max_df=1.0)
    weighed = tfidf.weigh_rows(rows, vocab)
    plan = weighed._jdf.queryExecution().optimizedPlan().toString()
    assert "SQRT(aggregate(" not in plan  # inside the division of each weight
    for r in weighed.collect():
        assert len(r.term_no) == len(r.tfidf) and abs(sum(w * w for w in r.tfidf) - (1 if r.tfidf else 0)) < 1e-9


def test_term_stats_are_those_of_the_counts(texts):
    rows = texts("gain gain loss gain", "loss gain loss", "", None, "x", "Gain Gain")
    plain = tfidf.term_document_stats(tfidf.term_counts(rows))
    assert sorted(map(tuple, tfidf.term_stats(rows).collect())) == sorted(map(tuple, plain.collect()))


def test_known_words_are_computed_once_for_a_text(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c", "c"]), ([], ["a"]), (None, ["a"])], "ranked array<string>, words array<string>")
    ranked = F.transform("ranked", lambda w: F.struct(w.alias("word"), F.lit(1.0).alias("score")))
    known = F.transform("ranked", lambda w: F.upper(F.lower(w)))
    told = rows.select(importance.append_unseen(ranked, F.transform(known, F.lower), F.col("words")).alias("x"))
    lines = told._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains(transform(" not in lines
    assert [r.x and [w.word for w in r.x] for r in told.collect()] == [["a", "b", "c", "c"], ["a"], None]


def test_quick_rounding_is_that_of_spark(spark):
    numbers = [0.0, -0.0, 1e-7, -1e-7, 5e-7, -5e-7, 0.1234565, -0.1234565, 1.0000005, 2.5e-6, 99999.1234565, 1e5, 1e300,
               float("nan"), float("inf"), float("-inf"), None, 0.30000000000000004, 1.4999995, -1e-320]
    given = spark.createDataFrame([(x,) for x in numbers], "x double")
    drawn = spark.range(200_000).select(((F.rand(3) - 0.5) * F.pow(F.lit(10.0), F.rand(4) * 9 - 4)).alias("x"))
    near = spark.range(20_000).select(((F.col("id") - 10_000) / 1e6 + 5e-7 + (F.col("id") % 5 - 2) * 1e-11).alias("x"))
    rows = given.union(drawn).union(near)
    assert rows.where(~scores.rounded(F.col("x")).eqNullSafe(F.round("x", 6))).count() == 0
    plan = spark.range(1).select(F.lit(0.5).alias("tfidf")).withColumn("tfidf", s6("tfidf"))
    assert "rint(" in plan._jdf.queryExecution().analyzed().toString().lower()


def test_linguistic_block_computes_no_explanation(spark):
    texts = spark.createDataFrame([(1, "Profit rose 5% at Acme Inc.", "positive", 0.9)],
                                  "doc_id long, text string, model_label string, model_confidence double")
    full = reasoning.comprehensive_explanation(texts).select("linguistic_analysis")
    assert "Mildly positive" not in full._jdf.queryExecution().optimizedPlan().toString()
    block, record = full.first()[0], features.analyze(texts).first()
    assert (block.lexicon_sentiment_score, block.uncertainty_level) == (record.sentiment.score, record.linguistic.uncertainty_score)
    assert block.positive_words_found == record.features.positive_words and block.entities_found == record.entities


def test_coef_lookup_sends_out_the_coefficients(spark, tmp_path):
    rows = [(n, n % 7, "OFP"[n % 3], 1000.0 * n, "1-URGENT") for n in range(1, 400)]
    spark.createDataFrame(
        rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
    ).write.parquet(str(tmp_path / "orders.parquet"))
    plan = catalog.coef_lookup(spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan  # the weights stay where they are


def test_words_are_ranked_by_numbers_as_by_their_items(texts):
    rows = texts("beta alpha gamma delta", "delta delta beta", " ".join(f"word{i % 40}" for i in range(90)), "", None)
    vocab = tfidf.fit_vocabulary(rows, min_df=1, max_df=1.0)
    weighed = tfidf.weigh_rows(rows, vocab)
    lambdas = weighed._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction")
    assert lambdas == 1  # the pairs; weights are left to compiled loops
    n = len(vocab.terms)
    some = tuple(None if i % 5 == 0 else float(i % 3) for i in range(n))
    for factors in ((1.0,) * n, some, (None,) * n, (1e12,) * n):  # the last don't fit into the numbers
        scores = importance.WordScores(vocab, factors, tuple("positive" if i % 2 else "neutral" for i in range(n)))
        plain = importance.add_importance(weighed, scores).select(
            "doc_id", importance.top_items(F.col("importance"), 7).alias("word_importance"))
        listed = importance.importance_lists(weighed, scores, 7)
        assert sorted(map(str, listed.collect())) == sorted(map(str, plain.collect()))
        by_items = "round(" in listed._jdf.queryExecution().optimizedPlan().toString()
        assert by_items == (factors[0] == 1e12)
