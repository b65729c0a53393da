"""The given Parquet tables and the finance texts derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADLINES = """
select o_orderkey as doc_id, o_orderpriority as grp, dir,
  concat(
    case dir
      when 'up' then concat('Revenue increased sharply by ', cast(pct as string), '% to $', cast(k as string), ' million, a record gain')
      when 'down' then concat('Revenue declined by ', cast(-pct as string), '% to $', cast(k as string), ' million on weak demand and losses')
      when 'flat' then concat('Revenue remained flat at EUR ', cast(k as string), ' million')
      else concat('The company opened with sales of $', cast(k as string), ',500') end,
    case o_orderkey % 9
      when 0 then '.'
      when 1 then '. Management expects a strong recovery in Q4!'
      when 2 then ', and the firm did not report any growth.'
      when 3 then '. Acme Holdings Inc. may face litigation in court.'
      when 4 then '. See https://ir.example.com/q?id=7 for details.'
      when 5 then '. Contact ir@example.com.'
      when 6 then '. Could volatility be a risk in FY2024, H1 or the fiscal year to March 31, 2025?'
      when 7 then '.  Résultat   naïve, no change.'
      else ' versus a profit of -3.5% last year.' end) as text
from (
  select o_orderkey, o_orderpriority, k, pct,
    case when o_orderstatus = 'P' and pct % 3 = 0 then 'new'
         when pct > 4 then 'up' when pct < -4 then 'down' else 'flat' end as dir
  from (
    select o_orderkey, o_orderpriority, o_orderstatus,
      cast(floor(o_totalprice / 1000) as int) as k,
      cast(floor(o_totalprice) % 61 as int) - 30 as pct
    from {orders}))
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when the whole input is less than one split (``maxPartitionBytes``).

    Text work costs far more than reading, and such a table would be a single task. What moves is
    bounded by the size of a split; larger tables are read where they are and never pass through
    a shuffle, whatever the number of cores.
    """
    spark = df.sparkSession
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(spark.sparkContext.defaultParallelism) if size < split else df


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a text table, ready for text work."""
    return spread(table(spark, sf_dir, name).select(*columns))


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finance headline per order: ``doc_id, grp, dir, text``. A projection of ``orders``
    without a shuffle; ``dir`` is up, down, flat or new."""
    columns = ("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return spark.sql(HEADLINES, orders=texts(spark, sf_dir, "orders", *columns))


def headline_label(direction: str = "dir"):
    """up -> positive, down -> negative, flat and new -> neutral."""
    return (
        F.when(F.col(direction) == "up", "positive")
        .when(F.col(direction) == "down", "negative")
        .otherwise("neutral")
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a quality / toxicity label, as three classes: ``doc_id, text, label``.

    Both sides are keyed by document, so the join is left to the planner.
    """
    labels = table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1).alias("label"),
    )
    documents = texts(spark, sf_dir, "documents", "doc_id", "text")
    return documents.join(labels, "doc_id")
