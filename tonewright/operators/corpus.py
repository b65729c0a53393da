"""Corpus preparation and description: duplicates, labels, lengths, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import patterns as P
from ..functions import text as T


def fingerprint(column: str) -> list[Column]:
    """128 bits that stand for a text in grouping: two hashes, so whole texts are not sorted."""
    return [F.xxhash64(column), F.xxhash64(F.lit(1), column)]


def drop_duplicate_sentences(
    df: DataFrame, sentence: str = "sentence", order: str = "doc_id"
) -> DataFrame:
    """Keep the row with the lowest ``order`` per exact sentence, nulls last; one of rows that tie in it.

    The first row of each sentence is found on fingerprints: copies collapse before the shuffle, so
    a sentence that makes up a third of the rows sends one row per input partition, and only
    fingerprints are grouped. Rows that tie with it are cut to one in each partition before they are
    dealt again.
    """
    one, two = fingerprint(sentence)
    marked = df.withColumns({"_h1": one, "_h2": two})
    first = marked.groupBy("_h1", "_h2").agg(F.min(order).alias("_first"))
    first = first.withColumnsRenamed({"_h1": "_f1", "_h2": "_f2"})
    same = (F.col("_h1") == F.col("_f1")) & (F.col("_h2") == F.col("_f2")) & F.col(order).eqNullSafe(F.col("_first"))
    tied = Window.partitionBy("_h1", "_h2").orderBy(order)
    return (
        marked.join(first, same, "left_semi").withColumn("_number", F.row_number().over(tied))
        .where("_number = 1").select(*df.columns)
    )


def drop_empty(df: DataFrame, sentence: str = "sentence") -> DataFrame:
    """Drop rows whose sentence is null or whitespace."""
    return df.where(~T.is_blank(F.col(sentence)))


def encode_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Names to numbers; a column that is not a string column stays as it is."""
    if not isinstance(df.schema[label].dataType, StringType):
        return df
    return df.withColumn(label, T.encode_label(F.col(label)))


def preprocess(df: DataFrame, clean: bool = True, order: str = "doc_id") -> DataFrame:
    """Duplicates out, blanks out, then optional cleaning and label numbers.

    Blanks go first in the plan (the same rows result), so they are never shuffled.
    """
    out = drop_duplicate_sentences(drop_empty(df), order=order)
    if clean:
        out = out.withColumn("sentence", T.clean_text(F.col("sentence")))
    return encode_labels(out)


def detect_text_columns(df: DataFrame) -> list[str]:
    """Names of the string columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and percent per label."""
    total = df.agg(F.count("*")).scalar()
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def corpus_quality_report(
    df: DataFrame,
    sentence: str = "sentence",
    label: str = "label",
    expected: Sequence[str] = P.LABELS,
) -> DataFrame:
    """One row: size, label check, duplicates, blanks. Grouping by the sentence's fingerprint first means a
    single shuffle of combined rows without their texts, and no growing buffers."""
    seen = [F.max(F.col(label) == name).alias(f"_has_{i}") for i, name in enumerate(expected)]
    other = F.count_if(~F.coalesce(F.col(label).isin(*expected), F.lit(False))).alias("_other")
    is_blank = F.max(T.is_blank(F.col(sentence))).alias("_blank")
    per_sentence = df.groupBy(*fingerprint(sentence)).agg(F.count("*").alias("_n"), is_blank, other, *seen)
    present = F.array(
        *[F.when(F.max(f"_has_{i}"), F.lit(name)) for i, name in enumerate(expected)]
    )
    blank = F.sum(F.when(F.col("_blank"), F.col("_n")).otherwise(0))
    report = per_sentence.agg(
        F.sum("_n").alias("n_rows"),
        (F.sum("_n") - F.count("*")).alias("n_duplicates"),
        blank.alias("n_blank"),
        F.sum("_other").alias("n_unexpected_labels"),
        F.array_compact(present).alias("_present"),
    )
    complete = (F.size("_present") == len(expected)) & (F.col("n_unexpected_labels") == 0)
    return report.select(
        "n_rows", "n_duplicates", "n_blank", "n_unexpected_labels",
        F.array_join("_present", ",").alias("labels_seen"),
        complete.alias("labels_as_expected"),
    )


def length_by_label(df: DataFrame, sentence: str = "sentence", label: str = "label") -> DataFrame:
    """Mean number of words per label."""
    return df.groupBy(label).agg(F.avg(T.word_count(F.col(sentence))).alias("avg_words"))


def length_histogram(
    df: DataFrame,
    sentence: str = "sentence",
    label: str = "label",
    bins: int = 30,
    labels: Sequence[str] = P.LABELS,
) -> DataFrame:
    """Counts in ``bins`` equal bins of word count, each label over its own range; last bin closed.

    Word counts are grouped first, so the ranges and bins come from (label, length) pairs.
    """
    words = T.word_count(F.col(sentence)).alias("words")
    lengths = (
        df.where(F.col(label).isin(*labels)).select(label, words)
        .groupBy(label, "words").agg(F.count("*").alias("n"))
    )
    span = lengths.groupBy(label).agg(F.min("words").alias("low"), F.max("words").alias("high"))
    placed = lengths.join(F.broadcast(span), label)  # at most one row per entry of `labels`
    # a single length gets a range of one word around it, as histogram routines do
    low = F.when(F.col("low") == F.col("high"), F.col("low") - 0.5).otherwise(F.col("low") * 1.0)
    high = F.when(F.col("low") == F.col("high"), F.col("high") + 0.5).otherwise(F.col("high") * 1.0)
    position = F.floor((F.col("words") - low) * bins / (high - low)).cast("int")
    return (
        placed.withColumn("bin", F.least(position, F.lit(bins - 1)))
        .groupBy(label, "bin").agg(F.sum("n").alias("n"))
    )


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight per class: n / (classes * class size)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total, classes = (counts.agg(x).scalar() for x in (F.sum("n"), F.count("*")))
    return counts.withColumn("weight", total / (classes * F.col("n")))


def label_set_difference(
    df: DataFrame, label: str = "label", expected: Sequence[str] = P.LABELS
) -> DataFrame:
    """Labels that occur but are not expected, and the other way round."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(x,) for x in expected], f"{label} string")
    found = df.select(F.col(label).cast("string").alias(label)).distinct()
    extra = found.subtract(wanted).withColumn("problem", F.lit("unexpected"))
    absent = wanted.subtract(found).withColumn("problem", F.lit("missing"))
    return extra.unionByName(absent)


def split_overlap(
    df: DataFrame, sentence: str = "sentence", split: str = "split",
    splits: Sequence[str] = ("train", "val", "test"),
) -> DataFrame:
    """Sentences that occur in more than one split, with the splits they occur in."""
    flags = [F.max((F.col(split) == name).cast("int")).alias(name) for name in splits]
    total = sum((F.coalesce(F.col(name), F.lit(0)) for name in splits), F.lit(0))
    one, two = fingerprint(sentence)
    marked = df.withColumns({"_h1": one, "_h2": two})
    both = marked.groupBy("_h1", "_h2").agg(*flags).where(total > 1)
    # the sentence is looked up only for those in several splits
    named = marked.select("_h1", "_h2", sentence).join(both, ["_h1", "_h2"])
    return named.dropDuplicates(["_h1", "_h2"]).select(sentence, *splits)
