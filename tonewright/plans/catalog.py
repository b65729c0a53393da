"""Every operator as a named query over the given tables: ``name -> f(spark, sf_dir)``.

Arrays are shown as ``|``-joined strings and fractions rounded to 6 decimals (sums of doubles
depend on the order of addition), so that results can be compared across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scores as S
from ..functions import text as T
from ..functions.lexicon import Lexicon
from ..operators import corpus, explanation, features, importance, lexicon, metrics, outlook
from ..operators import reasoning, tfidf
from ..operators.split import stratified_split
from ..sources import metrics_store, texts
from ..sources.tables import headline_label, headlines, labelled_documents, table
from ..sources.tables import texts as texts_of
from ..session import materialize, shared_path
from ..streaming import live
from . import calibration, scoring, training

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LEXICON = Lexicon()


def query(function):
    QUERIES[function.__name__] = function
    return function


def r6(column: Column | str) -> Column:
    return F.round(column, 6) + F.lit(0.0)


def s6(column: str) -> Column:
    """``r6`` of a double that every term of every text has."""
    return S.rounded(F.col(column)) + F.lit(0.0)


def joined(array: Column | str) -> Column:
    return F.array_join(array, "|")


# --- inputs shared by several queries ---------------------------------------------------------

def corpus_table(spark: SparkSession, d: str) -> DataFrame:
    """documents with a class name for every row: ``doc_id, sentence, label``."""
    label = (
        F.when(F.col("doc_id") % 7 == 0, "negative")
        .when(F.col("doc_id") % 7 < 3, "positive").otherwise("neutral")
    )
    return documents(spark, d).select(
        "doc_id", F.col("text").alias("sentence"), label.alias("label")
    )


def documents(spark: SparkSession, d: str) -> DataFrame:
    return texts_of(spark, d, "documents", "doc_id", "text")


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the documents, blank ones included: ``doc_id, position, value``."""
    lines = documents(spark, d).select("doc_id", F.split("text", "\n").alias("lines"))
    return lines.select("doc_id", F.posexplode("lines").alias("position", "value"))


def with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Headlines with some null and some blank texts."""
    text = (
        F.when(F.col("doc_id") % 11 == 0, F.lit(None).cast("string"))
        .when(F.col("doc_id") % 13 == 0, F.lit(" \t ")).otherwise(F.col("text"))
    )
    return headlines(spark, d).withColumn("text", text)


def featured(spark: SparkSession, d: str) -> DataFrame:
    return features.extract_features(headlines(spark, d), lexicon=LEXICON)


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Headlines with features, category and confidence."""
    return features.add_sentiment(featured(spark, d))


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """Headlines with a true class and the lexicon's class as prediction."""
    return judged(spark, d).select(
        "doc_id", "grp", "text", T.encode_label(headline_label()).alias("label"),
        T.encode_label(F.col("category")).alias("prediction"), "confidence",
    )


def with_model(spark: SparkSession, d: str) -> DataFrame:
    """Headlines with the lexicon's verdict in the role of a model's."""
    return judged(spark, d).select(
        "doc_id", "grp", "text", F.col("category").alias("model_label"),
        F.col("confidence").alias("model_confidence"),
    )


def labelled_headlines(spark: SparkSession, d: str) -> DataFrame:
    return headlines(spark, d).withColumn("label", T.encode_label(headline_label()))


def headline_vocabulary(spark: SparkSession, d: str) -> tfidf.Vocabulary:
    return tfidf.fit_vocabulary(headlines(spark, d))


def headline_model(spark: SparkSession, d: str, vocab: tfidf.Vocabulary) -> DataFrame:
    """Naive Bayes of the headlines. Fitted once and stored: at most one row per vocabulary term."""
    weights = tfidf.weigh(labelled_headlines(spark, d), vocab, keep=["label"])
    return materialize(tfidf.fit_naive_bayes(weights))


def headline_coefs(spark: SparkSession, d: str) -> DataFrame:
    model = headline_model(spark, d, headline_vocabulary(spark, d))
    return tfidf.naive_bayes_coefficients(model)


def headline_scores(spark: SparkSession, d: str) -> tuple[importance.WordScores, DataFrame]:
    """Vocabulary, factors and directions of the headlines' words, and the model they come from:
    fitted once, used for any text."""
    vocab = headline_vocabulary(spark, d)
    model = headline_model(spark, d, vocab)
    coefs = tfidf.naive_bayes_coefficients(model)
    return importance.word_scores(spark, vocab, LEXICON, coefs), model


def score_rows(spark: SparkSession, d: str, width: int) -> DataFrame:
    """Every vector as rows of ``width`` scores, all its elements: ``vec_id, part, scores``. The last row goes on
    at the vector's begin."""
    n = F.size("embedding")
    parts = F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1)
    rows = table(spark, d, "embeddings").where(n > 0).select("vec_id", "embedding", F.explode(parts).alias("part"))
    scores = [F.get("embedding", (F.col("part") * width + i) % n).cast("double") for i in range(width)]
    return rows.select("vec_id", "part", F.array(*scores).alias("scores"))


# --- sources ----------------------------------------------------------------------------------

@query
def read_labelled_text(spark, d):
    lines = headlines(spark, d).select(
        "doc_id",
        F.when(F.col("dir") == "new", F.col("text"))
        .otherwise(F.concat("text", F.lit("@"), headline_label())).alias("value"),
    )
    return texts.parse_labelled_lines(lines)


@query
def agreement_levels(spark, d):
    """Labelled lines written in Latin-1 under the name of each agreement level and read back; the
    fifth priority goes to the last level."""
    path = shared_path(spark, "agreement")
    lines = headlines(spark, d).where("dir <> 'new'").select(
        "grp", F.concat("text", F.lit("@"), headline_label()).alias("value"))
    parts = []
    for number, (level, name) in enumerate(texts.AGREEMENT_FILES.items()):
        place = F.least(F.left("grp", F.lit(1)).cast("int"), F.lit(len(texts.AGREEMENT_FILES)))
        some = lines.where(place == number + 1)
        raw = F.encode("value", "ISO-8859-1").cast("string")
        some.select(raw.alias("value")).write.text(f"{path}/{name}")
        read = texts.read_labelled_text(spark, path, level)
        parts.append(read.select(F.lit(level).alias("level"), "sentence", "label"))
    return reduce(DataFrame.unionByName, parts)


@query
def splits_round_trip(spark, d):
    path = shared_path(spark, "splits")
    coded = corpus.encode_labels(corpus_table(spark, d))
    texts.write_splits(stratified_split(coded), path)
    return reduce(DataFrame.unionByName, [
        texts.read_split(spark, path, name).withColumn("split", F.lit(name)) for name in texts.SPLITS])


@query
def predictions_round_trip(spark, d):
    """Results written as CSV and read back as texts to score."""
    path = shared_path(spark, "predictions")
    rows = judged(spark, d).select("doc_id", "text", F.col("category").alias("predicted_label"))
    texts.write_predictions(rows, path)
    return texts.read_texts(spark, path).select("doc_id", "text", "predicted_label")


@query
def read_csv_texts(spark, d):
    """Whole documents, line breaks and quotes included, written as CSV and read back in splits."""
    path = shared_path(spark, "texts")
    texts.write_predictions(documents(spark, d), path, ["doc_id", "text"])
    found = texts.read_csv_any_encoding(spark, path, "text")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


@query
def metrics_round_trip(spark, d):
    path = shared_path(spark, "metrics")
    named = predicted(spark, d).withColumnRenamed("grp", "name")
    metrics_store.write_metrics(metrics.classification_metrics(named, by=["name"]), path)
    return rounded(metrics_store.read_metrics(spark, path), *metrics.METRICS)


@query
def models_round_trip(spark, d):
    """Every kind of model is trained (in few steps), stored twice, listed, loaded, scored by its name and compared: a row
    of facts for each."""
    path = shared_path(spark, "models")
    data = training_data(spark, d)
    train, val = data.where("split = 'train'"), data.where("split = 'val'")
    models = training.train_all(train, changes=FEW_STEPS)
    models["ensemble"] = training.train_ensemble(train, changes=FEW_STEPS)
    for name, model in models.items():
        training.save_model(model, path, name)
        training.save_model(model, path, name)
    compared = materialize(training.compare_models(models, val))
    texts_of_val = val.select("doc_id", F.col("sentence").alias("text"), "label")
    parts = []
    for listed in training.list_models(spark, path):
        name = listed.removeprefix("baseline_")
        scored = training.score_by_name(path, listed, texts_of_val, make_scorer=letter_scorer)
        right = F.count_if(F.col("prediction.prediction") == F.col("label")) / F.count("*")
        facts = scored.agg(
            F.lit(listed).alias("model"), F.count("*").alias("n"),
            F.count_if(F.col("prediction.prediction").isin(0, 1, 2)).alias("predicted"), right.alias("right"))
        measured = compared.where(F.col("name") == name).select("accuracy", "error")
        parts.append(facts.join(measured, how="left").select(
            "model", "n", "predicted", F.lit(len(training.versions(spark, path, name))).cast("long").alias("versions"),
            (F.abs(F.col("right") - F.col("accuracy")) < 1e-9).alias("accuracy_is_that_compared"),
            F.col("error").isNull().alias("no_error")))
    return reduce(DataFrame.unionByName, parts)


@query
def read_texts(spark, d):
    return texts.non_empty_lines(document_lines(spark, d))


@query
def read_texts_any_encoding(spark, d):
    latin = F.col("grp") < "3"
    raw = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    lines = headlines(spark, d).select("doc_id", F.col("grp").alias("file"), raw.alias("raw"))
    return texts.decode_per_file(lines)


@query
def detect_text_columns(spark, d):
    documents = table(spark, d, "documents")
    names = corpus.detect_text_columns(documents)
    counts = documents.agg(*[F.count(n).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("n")) for n in names])
    return counts.select(F.inline(pairs))


# --- cleaning ---------------------------------------------------------------------------------

@query
def clean_text(spark, d):
    return documents(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query
def clean_text_headlines(spark, d):
    return headlines(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query
def drop_duplicate_sentences(spark, d):
    return corpus.drop_duplicate_sentences(corpus_table(spark, d))


@query
def drop_empty(spark, d):
    return corpus.drop_empty(with_gaps(spark, d), "text")


@query
def encode_label(spark, d):
    mixed = F.when(F.col("dir") == "new", F.col("dir")).otherwise(headline_label())
    return headlines(spark, d).select(
        "doc_id", mixed.alias("name"), T.encode_label(mixed).alias("label")
    )


@query
def decode_label(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        T.decode_label((F.col("o_orderkey") % 4).cast("int")).alias("label"),
    )


@query
def preprocess(spark, d):
    return corpus.preprocess(corpus_table(spark, d))


@query
def preview_text(spark, d):
    return documents(spark, d).select(
        "doc_id", T.preview(F.col("text"), 100).alias("preview_100"),
        T.preview(F.col("text"), 200).alias("preview_200"),
    )


FEW_STEPS = {
    "logreg": {"maxIter": 5}, "svm": {"maxIter": 5}, "random_forest": {"numTrees": 5, "maxDepth": 6},
    "forest": {"numTrees": 5, "maxDepth": 6}, "gradient_boosting": {"maxIter": 3}, "mlp": {"maxIter": 4},
}

BROKEN_QUOTES = ' â€œAsk itâ€™s deskâ€ â€" www.example.org now'


@query
def clean_financial_text(spark, d):
    text = F.concat("text", F.lit(BROKEN_QUOTES))
    return headlines(spark, d).select("doc_id", T.clean_financial_text(text).alias("cleaned"))


@query
def clean_financial_documents(spark, d):
    return documents(spark, d).select(
        "doc_id", T.clean_financial_text(F.col("text")).alias("cleaned")
    )


@query
def normalize_numbers(spark, d):
    cleaned = T.clean_financial_text(F.col("text"))
    return headlines(spark, d).select("doc_id", T.normalize_text(cleaned).alias("normalized"))


@query
def processor_options(spark, d):
    cleaned = T.clean_financial_text(F.col("text"))
    return headlines(spark, d).select(
        "doc_id",
        T.normalize_text(cleaned, lowercase=False).alias("keep_case"),
        T.normalize_text(cleaned, remove_punctuation=True).alias("no_punctuation"),
        T.normalize_text(cleaned, normalize_numbers=False).alias("keep_numbers"),
    )


@query
def tokenize(spark, d):
    tokens = T.tokens(F.col("text"))
    return documents(spark, d).select(
        "doc_id", joined(tokens).alias("tokens"), F.size(tokens).alias("n_tokens")
    )


@query
def lexical_words(spark, d):
    return headlines(spark, d).select(
        "doc_id", joined(T.lexical_words(F.col("text"))).alias("words")
    )


# --- look-up joins ----------------------------------------------------------------------------

@query
def lexicon_match(spark, d):
    words = lexicon.explode_words(headlines(spark, d))
    return lexicon.match_lexicon(words, LEXICON.table(spark))


@query
def lexicon_match_documents(spark, d):
    words = lexicon.explode_words(documents(spark, d))
    return lexicon.match_lexicon(words, LEXICON.table(spark))


@query
def lexicon_counts(spark, d):
    words = lexicon.explode_words(headlines(spark, d))
    return lexicon.lexicon_counts(lexicon.match_lexicon(words, LEXICON.table(spark)))


@query
def lexicon_word_lists(spark, d):
    words = lexicon.explode_words(headlines(spark, d))
    return lexicon.lexicon_word_lists(lexicon.match_lexicon(words, LEXICON.table(spark)))


@query
def coef_lookup(spark, d):
    vocab = headline_vocabulary(spark, d)
    weights = tfidf.weigh(headlines(spark, d), vocab)
    # a row for a vocabulary term at most, which the planner can't know of a stored table: it takes the weights for the
    # smaller side, by the size of the files that they come from
    coefs = F.broadcast(tfidf.naive_bayes_coefficients(headline_model(spark, d, vocab)))
    rows = importance.coef_lookup(weights, coefs)
    return rows.select(
        "doc_id", "term", *[s6(c).alias(c) for c in ("tfidf", *importance.COEFS)]
    )


@query
def append_unseen_lexicon_words(spark, d):
    full = explained(spark, d)
    words = {c: F.transform(f"{c}_words", lambda x: x["word"]) for c in ("positive", "negative")}
    added = {
        c: F.size(F.filter(f"{c}_words", lambda x: x["score"] == 0.1))
        for c in ("positive", "negative")
    }
    return full.select(
        "doc_id",
        *[joined(words[c]).alias(f"{c}_words") for c in words],
        *[added[c].alias(f"{c}_added") for c in added],
    )


MODEL_OF_GROUP = {"1-URGENT": "baseline_svm", "2-HIGH": "baseline_mlp"}
MODEL_OF_DIRECTION = {
    "up": "baseline_logreg", "down": "baseline_ensemble", "flat": "finbert_pretrained",
}


def renamed(column: str, names: dict[str, str]) -> Column:
    out = F.col(column)
    for old, new in names.items():
        out = F.when(F.col(column) == old, new).otherwise(out)
    return out


def group_metrics(spark, d) -> DataFrame:
    by_model = predicted(spark, d).withColumn("name", renamed("grp", MODEL_OF_GROUP))
    return metrics.classification_metrics(by_model, by=["name"])


@query
def model_info(spark, d):
    names = headlines(spark, d).select(
        F.explode(F.array(renamed("grp", MODEL_OF_GROUP), renamed("dir", MODEL_OF_DIRECTION)))
        .alias("model")
    )
    info = metrics_store.model_info(names, group_metrics(spark, d))
    return info.withColumn("features", joined("features"))


@query
def attach_predictions(spark, d):
    return judged(spark, d).select(
        "doc_id", "grp", "dir", "text", F.col("category").alias("predicted_label"),
        T.encode_label(F.col("category")).alias("predicted_class"), r6("confidence").alias("confidence"),
    )


# --- corpus description and split ---------------------------------------------------------------

@query
def label_distribution(spark, d):
    return corpus.label_distribution(corpus_table(spark, d)).withColumn("pct", r6("pct"))


@query
def corpus_quality_report(spark, d):
    return corpus.corpus_quality_report(
        document_lines(spark, d).select(
            F.col("value").alias("sentence"),
            F.when(F.col("doc_id") % 7 == 0, "negative")
            .when(F.col("doc_id") % 7 < 3, "positive")
            .when(F.col("doc_id") % 7 == 6, "unsure").otherwise("neutral").alias("label"),
        )
    )


@query
def length_by_label(spark, d):
    return corpus.length_by_label(corpus_table(spark, d)).withColumn("avg_words", r6("avg_words"))


@query
def length_histogram(spark, d):
    return corpus.length_histogram(corpus_table(spark, d))


@query
def class_weights(spark, d):
    return corpus.class_weights(corpus_table(spark, d)).withColumn("weight", r6("weight"))


@query
def label_set_check(spark, d):
    found = headlines(spark, d).select(
        F.when(F.col("dir").isin("new", "flat"), F.col("dir")).otherwise(headline_label())
        .alias("label")
    )
    return corpus.label_set_difference(found)


@query
def stratified_split_exact(spark, d):
    coded = corpus.encode_labels(corpus_table(spark, d)).select("doc_id", "label")
    return stratified_split(coded)


@query
def stratified_split_headlines(spark, d):
    return stratified_split(labelled_headlines(spark, d).select("doc_id", "label"))


@query
def split_overlap(spark, d):
    coded = corpus.encode_labels(corpus_table(spark, d))
    return corpus.split_overlap(stratified_split(coded))


# --- aggregate sentiment and outlook ------------------------------------------------------------

def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


AGGREGATE_FRACTIONS = (
    "average_sentiment_score", "sentiment_std", "positive_ratio", "negative_ratio", "neutral_ratio",
)
MIX_FRACTIONS = ("avg_confidence", "pos_pct", "neu_pct", "neg_pct")


@query
def aggregate_sentiment(spark, d):
    return rounded(outlook.aggregate_sentiment(judged(spark, d), ["grp"]), *AGGREGATE_FRACTIONS)


@query
def aggregate_sentiment_overall(spark, d):
    return rounded(outlook.aggregate_sentiment(judged(spark, d)), *AGGREGATE_FRACTIONS)


@query
def aggregate_sentiment_with_gaps(spark, d):
    """Null texts have no class and are counted apart; blank ones are neutral."""
    full = features.add_sentiment(features.extract_features(with_gaps(spark, d), lexicon=LEXICON))
    return rounded(outlook.aggregate_sentiment(full, ["grp"]), *AGGREGATE_FRACTIONS)


def scored_or_error(spark, d) -> DataFrame:
    """Scored headlines; null and blank texts get the label ``error``."""
    base = with_gaps(spark, d)
    full = features.add_sentiment(features.extract_features(base, lexicon=LEXICON))
    return scoring.score_or_error(full, "text", "category", "confidence")


@query
def score_or_error(spark, d):
    return rounded(
        scored_or_error(spark, d).select("doc_id", "grp", "label", "confidence"), "confidence"
    )


@query
def batch_summary(spark, d):
    return rounded(outlook.batch_summary(scored_or_error(spark, d), ["grp"]), *MIX_FRACTIONS)


@query
def market_outlook(spark, d):
    mix = outlook.label_mix(judged(spark, d), ["grp"], "category")
    return rounded(outlook.market_outlook(mix), *MIX_FRACTIONS)


@query
def market_outlook_by_direction(spark, d):
    mix = outlook.label_mix(judged(spark, d), ["dir"], "category")
    return rounded(outlook.market_outlook(mix), *MIX_FRACTIONS)


@query
def market_outlook_graded(spark, d):
    mix = outlook.label_mix(judged(spark, d), ["grp"], "category")
    return rounded(outlook.graded_outlook(mix), *MIX_FRACTIONS)


@query
def market_outlook_graded_by_direction(spark, d):
    mix = outlook.label_mix(judged(spark, d), ["dir"], "category")
    return rounded(outlook.graded_outlook(mix), *MIX_FRACTIONS)


# --- evaluation ---------------------------------------------------------------------------------

@query
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(predicted(spark, d))


@query
def classification_metrics(spark, d):
    return rounded(metrics.classification_metrics(predicted(spark, d)), *metrics.METRICS)


@query
def classification_metrics_by_group(spark, d):
    return rounded(
        metrics.classification_metrics(predicted(spark, d), by=["grp"]), *metrics.METRICS
    )


@query
def classification_report(spark, d):
    return rounded(metrics.classification_report(predicted(spark, d)), "precision", "recall", "f1")


@query
def error_analysis(spark, d):
    return rounded(metrics.error_analysis(predicted(spark, d)), "error_rate")


@query
def error_patterns(spark, d):
    return metrics.error_patterns(predicted(spark, d))


@query
def error_samples(spark, d):
    return metrics.error_samples(predicted(spark, d))


@query
def leaderboard(spark, d):
    return rounded(metrics.leaderboard(group_metrics(spark, d)), *metrics.METRICS)


@query
def best_model(spark, d):
    return rounded(metrics.best_model(group_metrics(spark, d)), "f1_macro")


def reasoned(spark, d) -> DataFrame:
    """Headlines with the reasoning steps' label as prediction."""
    return reasoning.reason(headlines(spark, d), lexicon=LEXICON).select(
        F.lit("six_step_reasoning").alias("name"),
        T.encode_label(headline_label()).alias("label"),
        T.encode_label(F.col("final_sentiment")).alias("prediction"),
    )


@query
def union_results(spark, d):
    rules = metrics.classification_metrics(reasoned(spark, d), by=["name"])
    return rounded(metrics.union_results(group_metrics(spark, d), rules), *metrics.METRICS)


# --- text features --------------------------------------------------------------------------------

def listing(name: str, expression: Callable[[Column], Column], source=headlines):
    def run(spark, d):
        found = expression(F.col("text"))
        return source(spark, d).select("doc_id", joined(found).alias("found"), F.size(found).alias("n"))

    QUERIES[name] = run


listing("extract_percentages", T.percentages)
listing("extract_currencies", T.currencies)
listing("extract_numbers", T.numbers)
listing("extract_companies", T.companies)
listing("extract_companies_strict", lambda c: T.companies(c, ignore_case=False))
listing("extract_fiscal_terms", T.fiscal_terms)
listing("extract_dates", T.dates)
listing("extract_percentages_documents", T.percentages, documents)
listing("extract_currencies_documents", T.currencies, documents)
listing("extract_numbers_documents", T.numbers, documents)
listing("extract_companies_documents", T.companies, documents)


@query
def size_stats(spark, d):
    return featured(spark, d).select(
        "doc_id", "word_count", "char_count", "sentence_count",
        r6("avg_word_length").alias("avg_word_length"),
    )


@query
def size_stats_documents(spark, d):
    full = features.extract_features(documents(spark, d), lexicon=LEXICON)
    return full.select(
        "doc_id", "word_count", "char_count", "sentence_count",
        r6("avg_word_length").alias("avg_word_length"), "negative_word_count",
    )


@query
def lexicon_features(spark, d):
    return featured(spark, d).select(
        "doc_id", "positive_word_count", "negative_word_count", "uncertainty_word_count",
        "litigious_word_count", joined("positive_words").alias("positive_words"),
        joined("negative_words").alias("negative_words"),
        joined("uncertainty_words").alias("uncertainty_words"),
    )


@query
def sentiment_score(spark, d):
    raw = features.extract_features(headlines(spark, d), lexicon=LEXICON, handle_negations=False)
    return raw.select("doc_id", r6("sentiment_score").alias("score"))


@query
def negation_flip(spark, d):
    return featured(spark, d).select(
        "doc_id", "has_negation", "negation_count", r6("sentiment_score").alias("score")
    )


@query
def uncertainty_score(spark, d):
    return featured(spark, d).select("doc_id", r6("uncertainty_score").alias("score"))


@query
def subjectivity_score(spark, d):
    return featured(spark, d).select("doc_id", r6("subjectivity_score").alias("score"))


@query
def punctuation_counts(spark, d):
    return documents(spark, d).select(
        "doc_id", T.count_char(F.col("text"), "!").alias("exclamations"),
        T.count_char(F.col("text"), "?").alias("questions"),
    )


@query
def sentiment_category(spark, d):
    return judged(spark, d).select("doc_id", "category")


@query
def lexicon_confidence(spark, d):
    return judged(spark, d).select("doc_id", r6("confidence").alias("confidence"))


@query
def feature_explanation(spark, d):
    return judged(spark, d).select("doc_id", "explanation")


@query
def list_caps(spark, d):
    record = features.analyze(documents(spark, d), lexicon=LEXICON)
    return record.select(
        "doc_id", joined("features.numbers").alias("numbers"),
        joined("features.companies").alias("companies"),
        joined("features.negative_words").alias("negative_words"),
    )


@query
def analyze(spark, d):
    return analysis_columns(features.analyze(headlines(spark, d), lexicon=LEXICON))


@query
def analyze_stream(spark, d):
    """Headlines that arrive in two parts. The stream reads some files in each batch and ends with the first part; started
    anew it goes on from its checkpoint, and a third start finds nothing new."""
    folder = shared_path(spark, "stream")
    rows = headlines(spark, d).select("doc_id", "text", F.coalesce(F.col("dir") == "up", F.lit(False)).alias("early"))
    for part in ("early", "not early", None):
        if part:
            rows.where(part).drop("early").write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 64)
        analyzed = live.analyze_stream(arriving.parquet(f"{folder}/in"), lexicon=LEXICON)
        live.write_stream(analyzed, f"{folder}/out", f"{folder}/progress").awaitTermination()
    return analysis_columns(spark.read.parquet(f"{folder}/out"))


def analysis_columns(record: DataFrame) -> DataFrame:
    """The nested analysis record as flat columns."""
    return record.select(
        "doc_id", "cleaned_text", F.col("sentiment.category").alias("category"),
        r6("sentiment.score").alias("score"), r6("sentiment.confidence").alias("confidence"),
        "sentiment.explanation",
        *[F.col(f"features.{c}").alias(c) for c in features.COUNTS if c != "avg_word_length"],
        r6("features.avg_word_length").alias("avg_word_length"),
        *[joined(f"features.{c}").alias(c) for c in
          ("positive_words", "negative_words", "uncertainty_words", "numbers")],
        *[joined(f"entities.{c}").alias(c) for c in ("percentages", "currencies", "companies")],
        r6("linguistic.uncertainty_score").alias("uncertainty_score"),
        r6("linguistic.subjectivity_score").alias("subjectivity_score"),
        "linguistic.has_negation",
        *[F.col(f"features.{c}").alias(c) for c in
          ("negation_count", "exclamation_count", "question_count")],
    )


@query
def get_lexicon_sentiment(spark, d):
    short = features.lexicon_sentiment(headlines(spark, d), lexicon=LEXICON)
    return short.select(
        "doc_id", "positive_count", "negative_count", "uncertainty_count",
        r6("sentiment_score").alias("sentiment_score"),
        *[joined(f"{c}_words").alias(f"{c}_words") for c in ("positive", "negative", "uncertainty")],
    )


# --- probabilities ----------------------------------------------------------------------------------

def numbered(array: str, names=("p0", "p1", "p2")) -> list[Column]:
    return [r6(F.get(array, F.lit(i))).alias(n) for i, n in enumerate(names)]


@query
def softmax(spark, d):
    probabilities = score_rows(spark, d, 3).select("vec_id", "part", S.softmax(F.col("scores")).alias("p"))
    return probabilities.select("vec_id", "part", *numbered("p"))


@query
def argmax_label(spark, d):
    scored = score_rows(spark, d, 3).select("vec_id", "part", S.softmax(F.col("scores")).alias("p"))
    return scored.select(
        "vec_id", "part", S.argmax(F.col("p")).alias("prediction"),
        T.decode_label(S.argmax(F.col("p"))).alias("label"),
        r6(F.array_max("p")).alias("confidence"),
    )


@query
def reorder_probabilities(spark, d):
    scored = score_rows(spark, d, 3).select(
        "vec_id", "part", S.reorder_external(S.softmax(F.col("scores"))).alias("p")
    )
    return scored.select("vec_id", "part", *numbered("p", ("negative", "neutral", "positive")))


@query
def prediction_record(spark, d):
    probabilities = S.softmax(F.array(
        F.col("negative_word_count") * 1.0, F.lit(0.5), F.col("positive_word_count") * 1.0
    ))
    record = scoring.prediction_record(F.col("text"), F.col("p"))
    done = featured(spark, d).withColumn("p", probabilities).select("doc_id", record.alias("r"))
    return done.select(
        "doc_id", F.col("r.text").alias("shown"), "r.prediction", "r.label",
        r6("r.confidence").alias("confidence"),
        *[r6(F.col("r.probabilities")[n]).alias(n) for n in P.LABELS],
    )


@query
def soft_vote(spark, d):
    members = [S.softmax(F.slice("scores", i, 3)) for i in (1, 4, 7)]
    voted = score_rows(spark, d, 9).select("vec_id", "part", scoring.soft_vote(members).alias("p"))
    return voted.select(
        "vec_id", "part", *numbered("p"), S.argmax(F.col("p")).alias("prediction"),
        r6(F.array_max("p")).alias("confidence"),
    )


def letter_scorer():
    """A stand-in scorer without weights: three scores from letter counts."""
    def score(texts):
        return [[t.count("a") / 4, t.count("e") / 4, t.count("o") / 4] for t in texts]

    return score


@query
def score_external(spark, d):
    scored = scoring.score_external(headlines(spark, d), letter_scorer, batch_size=512)
    return scored.select(
        "doc_id", "prediction.prediction", "prediction.label",
        r6("prediction.confidence").alias("confidence"),
        *[r6(F.col("prediction.probabilities")[n]).alias(n) for n in P.LABELS],
    )


def word_tokenizer():
    """A stand-in tokenizer: words between spaces."""
    return lambda texts: [t.split() for t in texts]


def token_scorer():
    """A stand-in scorer of token lists: three scores from letter counts."""
    return lambda items: [[sum(t.count(c) for t in tokens) / 16 for c in "aeo"] for tokens in items]


@query
def score_external_tokens(spark, d):
    """Whole documents, tokenised and cut for a model that takes 128 tokens."""
    scored = scoring.score_external(
        documents(spark, d), token_scorer, batch_size=64, make_tokenizer=word_tokenizer, max_tokens=128)
    return scored.select(
        "doc_id", "n_tokens", "truncated", "prediction.prediction", "prediction.label",
        r6("prediction.confidence").alias("confidence"),
    )


# --- TF-IDF and naive Bayes -----------------------------------------------------------------------

@query
def tokens_1_2gram(spark, d):
    terms = T.terms_1_2(F.col("text"))
    return documents(spark, d).select(
        "doc_id", joined(terms).alias("terms"), F.size(terms).alias("n_terms")
    )


@query
def term_document_stats(spark, d):
    return tfidf.term_document_stats(tfidf.term_counts(documents(spark, d)))


@query
def vocabulary_top_k(spark, d):
    counts = tfidf.term_counts(documents(spark, d))
    vocab = tfidf.vocabulary(tfidf.term_document_stats(counts), documents(spark, d))
    return vocab.withColumn("idf", r6("idf"))


@query
def tfidf_documents(spark, d):
    weights = tfidf.tfidf(documents(spark, d))
    return weights.withColumn("tfidf", s6("tfidf"))


@query
def tfidf_headlines(spark, d):
    return tfidf.tfidf(headlines(spark, d)).withColumn("tfidf", s6("tfidf"))


@query
def naive_bayes_model(spark, d):
    data = labelled_documents(spark, d)
    weights = tfidf.weigh(data, tfidf.fit_vocabulary(data), keep=["label"])
    model = tfidf.fit_naive_bayes(weights)
    return rounded(model, *[f"log_prob_{c}" for c in tfidf.CLASSES])


@query
def naive_bayes_predictions(spark, d):
    data = labelled_documents(spark, d)
    vocab = tfidf.fit_vocabulary(data)
    rows = tfidf.weigh_rows(data, vocab, keep=["label"])
    model = tfidf.fit_naive_bayes(tfidf.exploded(rows, vocab, keep=["label"]))
    scored = tfidf.score_naive_bayes(rows, vocab, model, tfidf.class_priors(data))
    return rounded(scored, *[f"jll_{c}" for c in tfidf.CLASSES])


# --- word importance -----------------------------------------------------------------------------

@query
def word_importance(spark, d):
    scores, _ = headline_scores(spark, d)
    rows = tfidf.weigh_rows(headlines(spark, d), scores.vocabulary)
    return importance.word_importance(rows, scores).withColumn("score", s6("score"))


@query
def word_importance_without_coefs(spark, d):
    scores = importance.word_scores(spark, headline_vocabulary(spark, d), LEXICON)
    rows = tfidf.weigh_rows(headlines(spark, d), scores.vocabulary)
    return importance.word_importance(rows, scores).withColumn("score", s6("score"))


def headline_top_words(spark, d) -> DataFrame:
    scores, _ = headline_scores(spark, d)
    rows = tfidf.weigh_rows(headlines(spark, d), scores.vocabulary)
    return importance.top_words_per_text(rows, scores)


@query
def top_words_per_text(spark, d):
    return headline_top_words(spark, d).withColumn("score", s6("score"))


@query
def top_words_by_direction(spark, d):
    scores, _ = headline_scores(spark, d)
    rows = tfidf.weigh_rows(headlines(spark, d), scores.vocabulary)
    return importance.top_words_by_direction(rows, scores).withColumn("score", s6("score"))


@query
def top_features_per_class(spark, d):
    return importance.top_features_per_class(headline_coefs(spark, d)).withColumn("coef", r6("coef"))


@query
def class_word_comparison(spark, d):
    return importance.class_word_comparison(headline_coefs(spark, d)).withColumn("score", r6("score"))


def explained(spark, d) -> DataFrame:
    scores, _ = headline_scores(spark, d)
    keep = ["text", "category", "confidence"]
    rows = tfidf.weigh_rows(judged(spark, d), scores.vocabulary, keep=keep)
    return importance.explain_words(importance.importance_lists(rows, scores, keep=keep), LEXICON)


def words_of(array: str) -> Column:
    return F.transform(array, lambda x: x["word"])


@query
def explain_prediction(spark, d):
    scores, model = headline_scores(spark, d)
    rows = tfidf.weigh_rows(headlines(spark, d), scores.vocabulary, keep=["text"])
    priors = tfidf.class_priors(labelled_headlines(spark, d))
    return importance.explain_prediction(rows, scores, model, priors, LEXICON).select(
        "doc_id", "prediction",
        *[r6(F.get("probabilities", F.lit(i))).alias(f"p_{c}") for i, c in enumerate(P.LABELS)],
        joined(words_of("word_importance")).alias("word_importance"),
        *[joined(words_of(f"{c}_words")).alias(f"{c}_words") for c in P.LABELS],
        *[joined(f"lexicon_{c}").alias(f"lexicon_{c}")
          for c in ("positive", "negative", "uncertainty")],
    )


@query
def highlight_html(spark, d):
    return importance.highlight_html(explained(spark, d)).select("doc_id", "html")


@query
def explanation_text(spark, d):
    sides = ("positive", "negative", "neutral")
    words = explained(spark, d).select("doc_id", "category", "confidence", *[words_of(f"{c}_words").alias(c) for c in sides])
    told = explanation.explanation_text(F.col("category"), F.col("confidence"), *[F.col(c) for c in sides])
    return words.select("doc_id", told.alias("explanation"))


# --- six-step reasoning -----------------------------------------------------------------------------

def step(position: int):
    def run(spark, d):
        done = reasoning.reason(headlines(spark, d), lexicon=LEXICON)
        one = F.get("steps", F.lit(position))
        return done.select("doc_id", one.alias("s")).select(
            "doc_id", "s.step", "s.observation", "s.reasoning", "s.conclusion",
            r6("s.confidence").alias("confidence"),
        )

    return run


for _position, _name in enumerate((
    "reasoning_comprehension", "reasoning_entities", "reasoning_sentiment", "reasoning_context",
    "reasoning_calibration", "reasoning_synthesis",
)):
    QUERIES[_name] = step(_position)


@query
def reasoning_final(spark, d):
    done = reasoning.reason(headlines(spark, d), lexicon=LEXICON)
    return done.select(
        "doc_id", "final_sentiment", r6("final_confidence").alias("final_confidence"), "reasoning"
    )


@query
def reasoning_key_factors(spark, d):
    done = reasoning.reason(headlines(spark, d), lexicon=LEXICON)
    return done.select("doc_id", joined("key_factors").alias("key_factors"))


@query
def reasoning_trace(spark, d):
    done = reasoning.reason(headlines(spark, d), lexicon=LEXICON)
    return done.select("doc_id", reasoning.reasoning_trace(F.col("steps")).alias("trace"))


@query
def reasoning_documents(spark, d):
    done = reasoning.reason(documents(spark, d), lexicon=LEXICON)
    return done.select(
        "doc_id", "final_sentiment", r6("final_confidence").alias("final_confidence"),
        joined("key_factors").alias("key_factors"),
    )


@query
def reasoning_without_lexicon(spark, d):
    done = reasoning.reason(headlines(spark, d))
    return done.select("doc_id", "final_sentiment", joined("key_factors").alias("key_factors"))


@query
def comprehensive_explanation(spark, d):
    full = reasoning.comprehensive_explanation(with_model(spark, d), lexicon=LEXICON)
    return full.select(
        "doc_id", "summary", "confidence_explanation", joined("key_factors").alias("key_factors"),
        F.col("model_vs_reasoning.reasoning_prediction").alias("reasoning_prediction"),
        r6("model_vs_reasoning.reasoning_confidence").alias("reasoning_confidence"),
        F.col("model_vs_reasoning.agreement").alias("agreement"), "reasoning", "trace",
    )


@query
def comprehensive_explanation_words(spark, d):
    """The influential words and the linguistic block of the comprehensive explanation."""
    scores, _ = headline_scores(spark, d)
    keep = ["text", "model_label", "model_confidence"]
    rows = tfidf.weigh_rows(with_model(spark, d), scores.vocabulary, keep=keep)
    listed = importance.importance_lists(rows, scores, keep=keep)
    full = reasoning.comprehensive_explanation(listed, lexicon=LEXICON)
    block = "linguistic_analysis"
    return full.select(
        "doc_id",
        *[joined(words_of(f"influential_words.{c}")).alias(f"influential_{c}") for c in ("positive", "negative")],
        *[r6(f"{block}.{c}").alias(c) for c in ("lexicon_sentiment_score", "uncertainty_level")],
        *[joined(f"{block}.{c}_words_found").alias(f"{c}_words_found") for c in ("positive", "negative")],
        *[joined(f"{block}.entities_found.{c}").alias(c) for c in ("percentages", "currencies", "companies")],
    )


@query
def sample_analyses(spark, d):
    sampled = reasoning.sample_analyses(with_model(spark, d), lexicon=LEXICON)
    return sampled.withColumn("key_factors", joined("key_factors"))


# --- model training: metrics on the validation split ------------------------------------------------

def training_data(spark, d) -> DataFrame:
    data = labelled_documents(spark, d).withColumnRenamed("text", "sentence")
    return materialize(stratified_split(data))


def scored_facts(model, data: DataFrame) -> DataFrame:
    """What has to hold for the scores of any model, counted over all rows, for each class."""
    scored = training.score(model, data).select(F.col("label").alias("class"), "prediction.*")
    shares = F.map_values("probabilities")
    total = F.aggregate(shares, F.lit(0.0), lambda acc, x: acc + x)
    return scored.groupBy("class").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("prediction").isin(0, 1, 2)).alias("predicted"),
        F.count_if(F.abs(total - 1) < 1e-6).alias("shares_sum_to_one"),
        F.count_if(F.abs(F.col("confidence") - F.array_max(shares)) < 1e-9).alias("confidence_is_largest"),
    )


def learned(model, train: DataFrame) -> DataFrame:
    """Whether a model knows its own training rows at least as well as naming the largest class would; one that guesses
    does not."""
    right = F.count_if(F.col("label") == F.col("prediction.prediction"))
    by_class = training.score(model, train).groupBy("label").agg(F.count("*").alias("n"), right.alias("right"))
    return by_class.agg((F.sum("right") >= F.max("n")).alias("learned"))


def trained(name: str):
    def run(spark, d):
        data = training_data(spark, d)
        train = data.where("split = 'train'")
        model = training.train_model(name, train)
        return scored_facts(model, data.where("split = 'val'")).join(learned(model, train), how="left")

    return run


for _name in training.CLASSIFIERS:
    QUERIES[f"train_{_name}"] = trained(_name)


@query
def forest_leaves(spark, d):
    """Trees that see every training row once: rows of each class in the leaves as stored, and as the rows come to them."""
    train = training_data(spark, d).where("split = 'train'")
    model = training.train_model("random_forest", train, numTrees=10, bootstrap=False)
    nodes = model.nodes(spark)
    stored = nodes.where("term is null").select("tree", "node", F.posexplode("counts").alias("class", "stored"))
    come = model.add_leaves(training.vectors(model.features, train, ["label"]))
    come = come.select("label", F.posexplode("leaves").alias("tree", "node")).groupBy("tree", "node", F.col("label").alias("class")).count()
    inner = nodes.groupBy("tree").agg(
        F.count_if(F.col("term").isNotNull() & (F.col("n_rows") < 5)).alias("small_split"), (F.max("depth") <= 50).alias("depth_in_bounds"))
    both = stored.join(come, ["tree", "node", "class"], "left").groupBy("tree", "class").agg(
        F.sum("stored").cast("long").alias("n"),
        (F.count_if(F.col("stored") != F.coalesce("count", F.lit(0))) == 0).alias("all_leaves_agree"))
    return both.join(inner, "tree").where("n > 0")


@query
def boosting_rounds(spark, d):
    """The mean log loss of the training rows after every round of boosting: whether it has fallen."""
    train = training_data(spark, d).where("split = 'train'")
    losses = training.train_model("gradient_boosting", train).losses
    rounds = [(i, losses[i] < losses[i - 1], losses[i] > 0) for i in range(1, len(losses))]
    return spark.createDataFrame(rounds, "round long, falls boolean, above_zero boolean")


@query
def network_early_stop(spark, d):
    """Where the training of the neural network stopped, and whether it kept its best epoch."""
    train = training_data(spark, d).where("split = 'train'")
    model = training.train_model("mlp", train)
    shares = [share for _, share in model.curve]
    best = model.best_epoch
    facts = [(1 < len(shares) < 500, shares[best] == max(shares), max(shares) > shares[0], len(shares) - best > 10)]
    return spark.createDataFrame(facts, "stopped_early boolean, kept_best boolean, learned boolean, waited boolean")


@query
def calibrate_margins(spark, d):
    """Sigmoids for margins from word counts, a line for each priority and class: whether the slope of the loss
    is zero there, by sums over all rows."""
    counts = F.array(*[(F.col(f"{c}_word_count") - F.col(f"{o}_word_count")).cast("double") / 2
                       for c, o in (("negative", "positive"), ("uncertainty", "negative"), ("positive", "negative"))])
    rows = featured(spark, d).select("grp", T.encode_label(headline_label()).alias("label"), counts.alias("margins"))
    stacked = materialize(calibration.stacked_margins(rows, fold="grp"))
    lines = calibration.fit_sigmoids(stacked)
    fitted = spark.createDataFrame([(g, c, *line) for (g, c), line in lines.items()], "fold string, class int, a double, b double")
    p, q = F.count_if("hit"), F.count_if(~F.col("hit"))
    sizes = stacked.groupBy("fold", "class").agg(p.alias("hits"), q.alias("others"))
    share = 1 / (1 + F.exp(-(F.col("a") * F.col("margin") + F.col("b"))))
    target = F.when(F.col("hit"), (F.col("hits") + 1) / (F.col("hits") + 2)).otherwise(1 / (F.col("others") + 2))
    told = stacked.join(sizes, ["fold", "class"]).join(fitted, ["fold", "class"]).withColumn("gap", share - target)
    limit = F.count("*") * 1e-9
    return told.groupBy(F.col("fold").alias("grp"), "class").agg(
        F.count("*").alias("n"), F.count_if("hit").alias("hits"),
        (F.abs(F.sum("gap")) < limit).alias("level_fits"),
        (F.abs(F.sum(F.col("gap") * F.col("margin"))) < limit).alias("slope_fits"))


@query
def train_ensemble(spark, d):
    data = training_data(spark, d)
    train = data.where("split = 'train'")
    model = training.train_ensemble(train)
    return scored_facts(model, data.where("split = 'val'")).join(learned(model, train), how="left")


# --- explanations of fitted linear models -----------------------------------------------------------

def explained_by(name: str):
    """Texts explained by the stored model of a name, next to what the model itself says of them."""
    def run(spark, d):
        path = shared_path(spark, "explained")
        data = training_data(spark, d)
        training.save_model(training.train_model(name, data.where("split = 'train'")), path, name)
        model = training.load_model(path, name)
        scored = model.transform(data.where("split <> 'train'")).select(
            "doc_id", F.col("sentence").alias("text"), vector_to_array("rawPrediction").alias("model_margins"),
            F.col("prediction").cast("int").alias("model_class"))
        told = training.explain_by_name(
            path, f"baseline_{name}", scored, LEXICON, keep=["model_margins", "model_class"])
        apart = F.zip_with("margins", "model_margins", lambda a, b: F.abs(a - b))
        positive = F.transform(F.filter("word_importance", lambda x: x["direction"] == "positive"), lambda x: x["word"])
        return told.select(
            "doc_id", F.size("contributions").alias("n_terms"),
            joined(F.array_sort(F.transform("contributions", lambda x: x["word"]))).alias("terms"),
            joined("lexicon_negative").alias("lexicon_negative"),
            (F.array_max(apart) < 1e-9).alias("adds_up"),
            (F.col("prediction") == T.decode_label(F.col("model_class"))).alias("same_class"),
            (F.size(F.array_except(F.slice(positive, 1, 5), words_of("positive_words"))) == 0).alias("positive_listed"),
        )

    return run


for _name in training.LINEAR:
    QUERIES[f"explain_{_name}"] = explained_by(_name)
