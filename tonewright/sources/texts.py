"""Readers for labelled lines, plain texts and CSV files, and writers for results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

# fixed values: file names by annotator agreement
AGREEMENT_FILES = {
    "50Agree": "Sentences_50Agree.txt",
    "66Agree": "Sentences_66Agree.txt",
    "75Agree": "Sentences_75Agree.txt",
    "AllAgree": "Sentences_AllAgree.txt",
}
SPLITS = ("train", "val", "test")
SPLIT_SCHEMA = "sentence string, label int"


def latin1(raw: Column) -> Column:
    return F.decode(raw.cast("binary"), "ISO-8859-1")


def parse_labelled_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``sentence@label`` lines split at the last ``@``; lines without one are dropped."""
    stripped = T.strip(F.col(value))
    kept = lines.withColumn(value, stripped).where(F.contains(F.col(value), F.lit("@")))
    return kept.select(
        *[c for c in lines.columns if c != value],
        F.regexp_extract(value, r"(?s)^(.*)@([^@]*)$", 1).alias("sentence"),
        F.regexp_extract(value, r"(?s)^(.*)@([^@]*)$", 2).alias("label"),
    )


def read_labelled_text(spark: SparkSession, path: str, level: str | None = "AllAgree") -> DataFrame:
    """Read Latin-1 ``sentence@label`` files.

    With ``level``, ``path`` is the folder of the agreement files; with ``None`` it is a path or
    glob. Lines stay splittable: bytes are decoded per line. ``doc_id`` is the number of the line in
    the files in order of their paths, whatever the size of splits; ``file`` names the source.
    """
    if level is not None and level not in AGREEMENT_FILES:
        raise ValueError(f"unknown agreement level {level!r}; use one of {list(AGREEMENT_FILES)}")
    where = f"{path}/{AGREEMENT_FILES[level]}" if level else path
    lines = numbered_lines(spark, where).select(
        "doc_id",
        F.element_at(F.split("path", "/"), -1).alias("file"),
        latin1(F.col("value")).alias("value"),
    )
    return parse_labelled_lines(lines)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, path, value``: lines with their number, counted through the files by path.

    Ids within a task rise by one from line to line, so a line's place in its split is its id less
    the split's first. The splits (one row each) are then counted through in order.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), "value",
    )
    splits = lines.groupBy("path", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.orderBy("path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    number = F.col("_before") + F.col("_id") - F.col("_first")
    return lines.join(splits, ["path", "_block"]).select(number.alias("doc_id"), "path", "value")


def write_splits(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Write the corpus partitioned by ``split``, so a reader of one split opens only its files."""
    writer = df.select("sentence", "label", "split").write.mode("overwrite").partitionBy("split")
    if file_format == "csv":
        writer.options(header=True, quote='"', escape='"').csv(path)
    else:
        writer.format(file_format).save(path)


def read_split(
    spark: SparkSession, path: str, split: str = "train", file_format: str = "parquet"
) -> DataFrame:
    """One split of the corpus: ``sentence, label``."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}; use one of {SPLITS}")
    if file_format == "csv":
        return spark.read.schema(SPLIT_SCHEMA).options(**csv_options(True)).csv(f"{path}/split={split}")
    stored = spark.read.schema(f"{SPLIT_SCHEMA}, split string").format(file_format).load(path)
    return stored.where(F.col("split") == split).select("sentence", "label")


def non_empty_lines(lines: DataFrame, value: str = "value", out: str = "text") -> DataFrame:
    """Stripped lines, blank ones dropped."""
    stripped = lines.select(
        *[c for c in lines.columns if c != value], T.strip(F.col(value)).alias(out)
    )
    return stripped.where(F.col(out) != "")


def file_kind(spark: SparkSession, path: str) -> str:
    """``csv`` or ``txt``: what the files of a path, folder or glob are."""
    for kind in ("csv", "txt"):
        if path.endswith(f".{kind}"):
            return kind
    # names only; contents are not read
    names = spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", r"\.([A-Za-z]+)$", 1).alias("kind"))
    found = {r["kind"] for r in names.distinct().collect()}
    if len(found) != 1 or not found <= {"csv", "txt"}:
        raise ValueError(f"unsupported file format: {path} holds {sorted(found)}")
    return found.pop()


def csv_options(line_breaks: bool) -> dict:
    return {"header": True, "multiLine": line_breaks, "quote": '"', "escape": '"'}


def csv_records(spark: SparkSession, path: str, decode: bool = False) -> DataFrame:
    """``file, record`` of CSV files with a header, read in splits though quoted fields may hold line breaks.

    Quotes come in pairs (a quote inside a field is doubled), so a line break ends a record when an even
    number of quotes lies before it. Each split counts its quotes; sums over the splits of a file (one row each) tell
    every split whether it begins inside a field. Lines that are whole records stay as they are; only
    lines of records with breaks are grouped, by the line in which their record begins, also across splits.
    With ``decode``, files that aren't valid UTF-8 are taken as Latin-1, which the same count of splits tells. A quote
    that is never closed makes the rest of its file one record. Breaks inside a field stay as they are, CR LF too.
    """
    here = ["file", "_block"]
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), "value",
    )
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.withColumn("_quotes", quotes.cast("long"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        lines.groupBy(*here).agg(F.sum("_quotes").alias("_sum"), F.max(~F.is_valid_utf8("value")).alias("_broken"))
        .select(*here, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
                F.max("_broken").over(Window.partitionBy("file")).alias("_latin1"))
    )
    in_order = Window.partitionBy(*here).orderBy("_id")
    above = in_order.rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum("_quotes").over(above), F.lit(0))
    value = F.col("value")
    if decode:
        value = F.when(F.col("_latin1"), latin1(value)).otherwise(value)
    marked = lines.join(splits, here).select(
        *here, "_id", value.alias("value"), (before % 2 == 1).alias("_inside"),
        ((before + F.col("_quotes")) % 2 == 1).alias("_goes_on"),
        ((F.col("_block") == 0) & (F.row_number().over(in_order) == 1)).alias("_header"),
    )
    whole = marked.where("not _inside and not _goes_on and not _header").select("file", "value")
    # records with breaks: put together within their split first, then what crosses a border of splits
    begins = F.max(F.when(~F.col("_inside"), F.struct("_block", "_id"))).over(
        in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    in_split = (
        marked.where("_inside or _goes_on").withColumn("_begin", begins).groupBy(*here, "_begin")
        .agg(F.array_sort(F.collect_list(F.struct("_id", "value"))).alias("_lines"), F.max("_header").alias("_header"),
             F.max_by("_goes_on", "_id").alias("_open"))
        .withColumn("value", F.array_join(F.col("_lines.value"), "\n")).drop("_lines")
    )
    closed = in_split.where("_begin is not null and not _open and not _header").select("file", "value")
    # at most two pieces of a split cross its borders: the end of an earlier record and the begin of a later one
    through = Window.partitionBy("file").orderBy("_block", F.col("_begin").asc_nulls_first())
    crossing = (
        in_split.where("_begin is null or _open").withColumn("_begin", F.max("_begin").over(through))
        .groupBy("file", "_begin")
        .agg(F.array_sort(F.collect_list(F.struct("_block", "value"))).alias("_lines"), F.max("_header").alias("_header"))
        .where("not _header").select("file", F.array_join(F.col("_lines.value"), "\n").alias("value"))
    )
    record = F.regexp_replace("value", r"\r\z", "")
    return whole.union(closed).union(crossing).select("file", record.alias("record")).where("record <> ''")


def read_csv_records(spark: SparkSession, path: str, decode: bool = False) -> DataFrame:
    """CSV files as :func:`csv_records` cuts them: string columns named by the first file's header."""
    options = csv_options(True)
    names = spark.read.options(**options).csv(path).columns
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    fields = F.from_csv("record", schema, {"quote": options["quote"], "escape": options["escape"]})
    return csv_records(spark, path, decode).select(fields.alias("_row")).select("_row.*")


def read_texts(
    spark: SparkSession, path: str, text_column: str = "text", line_breaks: bool = True
) -> DataFrame:
    """Texts to score: CSV with a named column, or ``.txt`` with one text per line.

    ``path`` is a file, folder or glob. Texts in a CSV file may hold quoted line breaks; large files are
    split all the same (:func:`csv_records`). ``line_breaks=False`` spares the shuffle where there are none.
    """
    if file_kind(spark, path) == "txt":
        return non_empty_lines(spark.read.text(path))
    df = read_csv_records(spark, path) if line_breaks else spark.read.options(**csv_options(False)).csv(path)
    if text_column not in df.columns:
        raise ValueError(f"no column {text_column!r} in {path}; found {df.columns}")
    return df


def decode_per_file(lines: DataFrame, file: str = "file", raw: str = "raw", out: str = "text") -> DataFrame:
    """Decode byte lines as UTF-8 if the whole file is valid UTF-8, otherwise as Latin-1.

    The flag per file is a two-value aggregate; joining it back is left to the planner, which
    broadcasts it while small and splits a file that holds many of the rows otherwise.
    """
    as_text = F.col(raw).cast("string")
    broken = lines.groupBy(file).agg(F.max(~F.is_valid_utf8(as_text)).alias("_broken"))
    broken = broken.where("_broken").select(file, F.lit(True).alias("_latin1"))
    joined = lines.join(broken, file, "left")
    decoded = F.when(F.col("_latin1"), F.decode(F.col(raw), "ISO-8859-1")).otherwise(
        F.try_validate_utf8(as_text)
    )
    return joined.select(*[c for c in lines.columns if c != raw], decoded.alias(out))


def read_texts_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """``.txt`` files of unknown encoding, one text per line: ``file, text``."""
    lines = spark.read.text(path).select(
        F.input_file_name().alias("file"), F.col("value").cast("binary").alias("raw")
    )
    return non_empty_lines(decode_per_file(lines), "text", "text")


def read_csv_any_encoding(
    spark: SparkSession, path: str, text_column: str, line_breaks: bool = True
) -> DataFrame:
    """CSV files of unknown encoding, found for each file; rows without a text are dropped.

    With ``line_breaks`` files are read in splits, and the count of quotes finds the encoding too.
    Without, all files are read in both encodings and each file's rows are taken from the right one. No
    list of files is gathered. Column names have to be the same in both encodings.
    """
    if line_breaks:
        return read_csv_records(spark, path, decode=True).where(F.col(text_column).isNotNull())
    broken = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("_file")).agg(
        F.max(~F.is_valid_utf8(F.col("value"))).alias("_broken"))
    broken = broken.where("_broken").select("_file")
    parts = []
    for encoding, how in (("UTF-8", "left_anti"), ("ISO-8859-1", "left_semi")):
        df = spark.read.options(**csv_options(False), encoding=encoding).csv(path)
        named = df.select("*", F.col("_metadata.file_path").alias("_file"))
        parts.append(named.join(broken, "_file", how).select(*df.columns))
    return parts[0].unionByName(parts[1]).where(F.col(text_column).isNotNull())


def write_predictions(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Result rows as CSV with a header; nested columns have to be flattened or left out."""
    out = df.select(*columns) if columns else df
    out.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)
