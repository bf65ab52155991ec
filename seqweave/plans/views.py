"""A time-coded view of the conversations, the same in Spark and in DuckDB; all times are whole milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ENDERS, COMMA = ".!?", ","
TASK_BYTES = 2 << 20  # of the conversations' files, some 500,000 words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_size(df: DataFrame, *key: str) -> DataFrame:
    """Rows of a key together, in as many parts as the files of df call for: what a task holds doesn't grow with the table.

    The setting for shuffles is the same for any input, and what follows makes many rows of one.
    """
    spark = df.sparkSession
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(least, -(-size // TASK_BYTES)), *key)


def timed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, pos, turn, speaker, text, morph_count, start, end of every word."""
    words = by_size(table(spark, sf_dir, "conversations"), "conv_id").select("conv_id", "turn", F.col("role").alias("speaker"), F.posexplode(F.split("text", r"\s+")).alias("i", "text")).where("text <> ''")
    order = W.partitionBy("conv_id").orderBy("turn", "i")
    words = words.withColumn("pos", (F.row_number().over(order) - 1).cast("int"))
    last = F.right("text", F.lit(1))
    gap = F.when(last.isin(*".!?。！？"), 500).when(last == ",", 150).otherwise(40) + F.when((F.col("pos") * 7 + F.col("conv_id")) % 23 == 0, 450).otherwise(0)
    d = (60 * F.length("text")).cast("long")
    start = F.coalesce(F.sum(d + gap).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    words = words.withColumn("start", start).withColumn("end", F.col("start") + d)
    return words.select("conv_id", "pos", "turn", "speaker", "text", (1 + F.floor(F.length("text") / 4)).cast("int").alias("morph_count"), "start", "end")


TIMED = r"""
RECURSIVE w0 AS (SELECT conv_id, turn, role, string_split_regex(text, '\s+') AS ws FROM conversations),
w1 AS (SELECT conv_id, turn, role, unnest(ws) AS text, generate_subscripts(ws, 1) AS i FROM w0),
w2 AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1)::INT AS pos, turn, role AS speaker, text, (1 + length(text) // 4)::INT AS m FROM w1 WHERE text <> ''),
w3 AS (SELECT *, 60 * length(text) AS d, CASE WHEN right(text, 1) IN ('.', '!', '?', '。', '！', '？') THEN 500 WHEN right(text, 1) = ',' THEN 150 ELSE 40 END
  + CASE WHEN (pos * 7 + conv_id) % 23 = 0 THEN 450 ELSE 0 END AS g FROM w2),
w4 AS (SELECT *, coalesce(sum(d + g) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM w3),
tv AS MATERIALIZED (SELECT conv_id, pos, turn, speaker, text, m, s, (s + d)::BIGINT AS e,
  lag(speaker) OVER k AS ps, s - lag(s + d) OVER k AS gap, right(lag(text) OVER k, 1) AS pc FROM w4 WINDOW k AS (PARTITION BY conv_id ORDER BY pos))
"""
