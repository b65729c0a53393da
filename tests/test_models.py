import threading

import pytest
from pyspark.sql import functions as F

from tonewright.functions.lexicon import Lexicon
from tonewright.operators import importance, tfidf
from tonewright.plans import scoring, training
from tonewright.streaming import live

FEW = {"maxIter": 3}


@pytest.fixture(scope="module")
def labelled(spark):
    words = {0: "loss decline weak", 1: "flat steady report", 2: "gain profit strong"}
    rows = [(i, f"{words[i % 3]} item {i % 7} in quarter {i % 4}", i % 3) for i in range(90)]
    return spark.createDataFrame(rows, "doc_id long, sentence string, label int").repartition(2).cache()


def test_tfidf_pipeline_equals_long_form(spark, labelled):
    features = training.fit_features(labelled)
    vectors = training.vectors(features, labelled, ["doc_id"])
    from pyspark.ml.functions import vector_to_array

    total = vectors.select("doc_id", F.aggregate(vector_to_array("features"), F.lit(0.0),
                                                 lambda a, x: a + x).alias("s"))
    long = tfidf.tfidf(labelled, text="sentence").groupBy("doc_id").agg(
        F.sum("tfidf").alias("t"), F.sum(F.col("tfidf") * F.col("tfidf")).alias("one"))
    rows = total.join(long, "doc_id").collect()
    assert len(rows) == 90
    assert all(abs(r.s - r.t) < 1e-9 and abs(r.one - 1) < 1e-9 for r in rows)


def test_naive_bayes_forms_agree(spark, labelled):
    vocab = tfidf.fit_vocabulary(labelled, text="sentence")
    rows = tfidf.weigh_rows(labelled, vocab, text="sentence", keep=["label"])
    model = tfidf.fit_naive_bayes(tfidf.exploded(rows, vocab, keep=["label"]))
    ours = tfidf.score_naive_bayes(rows, vocab, model, tfidf.class_priors(labelled))
    fitted = training.train_model("naive_bayes", labelled)
    theirs = training.score(fitted, labelled).select("doc_id", "prediction.prediction")
    both = ours.select("doc_id", "prediction").exceptAll(theirs)
    assert both.count() == 0


def test_all_classifiers_save_load_list(spark, labelled, tmp_path):
    changes = {"logreg": FEW, "svm": FEW, "random_forest": {"numTrees": 5}, "mlp": FEW,
               "gradient_boosting": {"maxIter": 2}}
    models = training.train_all(labelled, changes=changes)
    results = training.compare_models({**models, "broken": object()}, labelled).collect()
    assert {r.name for r in results} == {*training.CLASSIFIERS, "broken"}
    assert max(r.f1_macro for r in results if r.error is None) > 0.9
    assert [r.name for r in results if r.error] == ["broken"]
    for name in ("logreg", "svm"):
        training.save_model(models[name], str(tmp_path), name)
        again = training.load_model(str(tmp_path), name)
        a = training.score(models[name], labelled).select("doc_id", "prediction.confidence")
        b = training.score(again, labelled).select("doc_id", "prediction.confidence")
        assert sorted(a.collect()) == sorted(b.collect())
        coefs = training.coefficient_table(spark, models[name])
        top = importance.top_features_per_class(coefs, 3).where("class = 'positive'").collect()
        assert "profit" in " ".join(r.term for r in top) or "gain" in " ".join(r.term for r in top)
    assert training.list_models(spark, str(tmp_path)) == [
        "baseline_logreg", "baseline_svm", "finbert_pretrained"]
    with pytest.raises(ValueError):
        training.coefficient_table(spark, models["random_forest"])


def test_a_broken_save_leaves_the_version_before(spark, labelled, tmp_path):
    path = str(tmp_path)
    first = training.train_model("naive_bayes", labelled)
    assert training.save_model(first, path, "naive_bayes") == 1

    class Breaks:
        def save(self, where):
            first.write().save(where)
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        training.save_model(Breaks(), path, "naive_bayes")
    assert [n for n, _ in training.versions(spark, path, "naive_bayes")] == [1]
    rows = training.score(training.load_model(path, "naive_bayes"), labelled).count()
    second = training.train_model("naive_bayes", labelled.where("label <> 2"))
    assert rows == 90 and training.save_model(second, path, "naive_bayes") == 2
    labels = {n: {r[0] for r in training.score(training.load_model(path, "naive_bayes", n), labelled).select("prediction.label").collect()}
              for n in (1, 2, None)}
    assert len(labels[1]) == 3 and labels[2] == labels[None] == {"negative", "neutral"}
    with pytest.raises(FileNotFoundError):
        training.load_model(path, "naive_bayes", 3)
    with pytest.raises(FileNotFoundError):
        training.load_model(path, "svm")


def test_folds_share_out_every_class(spark):
    rows = [(i, 0 if i % 10 == 0 else 1 + i % 2) for i in range(900)]
    placed = training.with_folds(spark.createDataFrame(rows, "doc_id long, label int"), "doc_id", 3)
    counts = {(r.label, r._fold): r["count"] for r in placed.groupBy("label", "_fold").count().collect()}
    size = {c: sum(1 for _, x in rows if x == c) for c in range(3)}
    assert len(counts) == 9 and all(abs(n - size[c] / 3) <= 1 for (c, _), n in counts.items())


def test_checkpoint_folder_is_needed(spark):
    from types import SimpleNamespace

    from tonewright.session import materialize

    context = SimpleNamespace(getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, other: other))
    with pytest.raises(ValueError):
        materialize(SimpleNamespace(sparkSession=session))


def test_plans_of_dedup_and_terms(spark, labelled):
    from tonewright.operators import corpus

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "SortAggregate" not in plan(corpus.drop_duplicate_sentences(labelled))
    stats = tfidf.term_document_stats(tfidf.term_counts(labelled, text="sentence"))
    assert plan(stats).count("Exchange hashpartitioning") == 1
    assert "hashpartitioning" not in plan(tfidf.tfidf(labelled, text="sentence"))


def test_ensemble(spark, labelled, tmp_path):
    changes = {"logreg": FEW, "svm": FEW, "forest": {"numTrees": 5}}
    model = training.train_ensemble(labelled, changes=changes)
    rows = training.score(model, labelled).select("doc_id", "prediction.*").collect()
    assert len(rows) == 90
    assert all(abs(sum(r.probabilities.values()) - 1) < 1e-9 for r in rows)
    assert all(r.confidence == max(r.probabilities.values()) for r in rows)
    training.save_model(model, str(tmp_path), "ensemble")
    again = training.load_model(str(tmp_path), "ensemble")
    assert training.evaluate_model("e", again, labelled).first().accuracy > 0.9


def test_external_scorer_survives_bad_rows(spark):
    def make():
        def score(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("bad text")
            return [[float(len(t)), 1.0, 2.0] for t in texts]

        return score

    df = spark.createDataFrame([(1, "abcdef"), (2, "boom"), (3, None), (4, " ")],
                               "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.prediction for r in scoring.score_external(df, make).collect()}
    assert got[1].label == "positive" and got[1].prediction == 2
    assert [got[i].label for i in (2, 3, 4)] == ["error"] * 3 and got[2].confidence == 0.0
    told = {r.doc_id: r.error for r in scoring.score_external(df, make).collect()}
    assert told == {1: None, 2: "RuntimeError: bad text", 3: "no text", 4: "no text"}


def test_external_scorer_is_made_once_per_worker(spark, tmp_path):
    log = str(tmp_path / "made")

    def make():
        import os
        with open(log, "a") as out:
            out.write(f"{os.getpid()}\n")
        return lambda texts: [[1.0, 2.0, 3.0] for _ in texts]

    df = spark.range(64).selectExpr("id as doc_id", "cast(id as string) as text").repartition(32, "doc_id")
    for _ in range(2):
        scoring.score_external(df, make).write.format("noop").mode("overwrite").save()
    made = open(log).read().split()
    assert 1 <= len(made) == len(set(made)) <= 16  # far fewer than the 64 tasks


def test_external_scorer_cuts_tokens_and_sorts_by_length(spark, tmp_path):
    log = str(tmp_path / "padded")

    def make():
        def score(items):
            with open(log, "a") as out:
                out.write(f"{max(map(len, items)) * len(items) - sum(map(len, items))}\n")
            return [[float(len(t)), 0.0, float(t[0] == "b")] for t in items]

        return score

    def make_tokenizer():
        def tokens(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("bad text")
            return [t.split() for t in texts]

        return tokens

    sizes = [1, 9, 2, 8, 1, 7, 2, 40, 3, 300]
    rows = [(i, " ".join(["ab"[i % 2]] * n)) for i, n in enumerate(sizes)]
    df = spark.createDataFrame([*rows, (10, None), (11, "boom"), (12, " ")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in scoring.score_external(
        df, make, batch_size=2, external_order=False, make_tokenizer=make_tokenizer, max_tokens=32).collect()}
    assert [got[i].n_tokens for i in range(13)] == [*sizes, None, None, None]
    assert [got[i].truncated for i in range(10)] == [n > 32 for n in sizes] and got[10].truncated is None
    assert [got[i].error for i in (9, 10, 11, 12)] == [None, "no text", "RuntimeError: bad text", "no text"]
    alone = [32 if n > 32 else n for n in sizes]
    for i, n in enumerate(alone):
        p = got[i].prediction.probabilities
        assert p["negative"] / p["neutral"] == pytest.approx(2.718281828459045 ** n)
    in_row_order = sum(abs(a - b) for a, b in zip(alone[::2], alone[1::2]))
    assert sum(map(int, open(log).read().split())) < in_row_order / 10
    with pytest.raises(ValueError):
        scoring.score_external(df, make, max_tokens=3)


def test_lexicon_words_are_appended_and_highlighted(spark):
    top = [("profit", 0.5, "positive"), ("weak demand", 0.4, "negative")]
    df = spark.createDataFrame([(1, "Profit up, weak demand.", top)],
                               "doc_id long, text string, word_importance "
                               "array<struct<word:string,score:double,direction:string>>")
    r = importance.explain_words(df, Lexicon()).first()
    assert [tuple(x) for x in r.positive_words] == [("profit", 0.5), ("up", 0.1)]
    assert [tuple(x) for x in r.negative_words] == [("weak demand", 0.4), ("weak", 0.1)]
    html = importance.highlight_html(df).first().html
    assert html.startswith('<span style="background-color: rgba(40, 167, 69, 0.2)')
    assert html.endswith("up, weak demand.")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "Strong growth of 5%."), (2, "Weak sales and losses."), (3, None)]
    batch = spark.createDataFrame(rows, "doc_id long, text string")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    live.write_stream(live.analyze_stream(stream), str(tmp_path / "out"),
                      str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = live.analyze_stream(batch)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_folds_and_classes_of_calibrated_svms_are_fitted_side_by_side(spark, monkeypatch):
    rows = [(i, f"{'good' if i % 3 == 2 else 'bad' if i % 3 == 0 else 'calm'} thing {i % 5}", i % 3) for i in range(90)]
    train = spark.createDataFrame(rows, "doc_id long, sentence string, label int")
    features = training.fit_features(train)
    data = training.vectors(features, train, ["doc_id", "label"]).cache()
    together, make = threading.Barrier(3, timeout=30), training.classifier

    def meeting(name, n_rows, **changes):
        together.wait()  # breaks unless three folds come here at a time
        made = make(name, n_rows, **changes)
        assert made.getParallelism() == 3
        return made

    apart = [make("svm", 1).getOrDefault("parallelism")]
    monkeypatch.setattr(training, "classifier", meeting)
    model = training.CalibratedSvm.fit(data, maxIter=5)
    assert len(model.members) == 3 and len(model.sigmoids) == 3 and apart == [3]
    placed = training.with_folds(data, "doc_id", 3)
    for fold, member in enumerate(model.members):  # each saw the rows of the other folds, as if fitted alone
        seen, n_rows = training.with_weights(placed.where(F.col("_fold") != fold))
        alone = make("svm", n_rows, maxIter=5).fit(seen)
        for one, two in zip(member.models, alone.models):
            assert abs(one.coefficients.toArray() - two.coefficients.toArray()).max() < 1e-9
