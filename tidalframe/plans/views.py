"""The supplied tables as frames, signals and packets; each view in Spark and as DuckDB text.

Nothing is collected here, and only ``spread`` deals rows out anew: the views are projections that Catalyst
folds into whatever reads them, so only the columns in use reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Borders of the bands over 64 lines.
BORDERS = (0, 4, 8, 12, 16, 24, 32, 48, 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to as many tasks as a shuffle has: a narrow table lies in few splits of the scan, and work by row would go on there."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, ch, x): two embeddings make the two channels of a frame."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    return e.select(F.expr("vec_id div 2").alias("frame"), (F.col("vec_id") % 2).cast("int").alias("ch"), F.col("embedding").cast("array<double>").alias("x"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, ch, line, v)."""
    return vectors(spark, sf_dir).select("frame", "ch", F.posexplode("x").alias("line", "v"))


def bands(spark: SparkSession) -> DataFrame:
    """(band, start, stop): a literal of eight rows."""
    rows = [F.struct(F.lit(i).alias("band"), F.lit(a).alias("start"), F.lit(b).alias("stop")) for i, (a, b) in enumerate(zip(BORDERS, BORDERS[1:], strict=False))]
    return spark.range(1).select(F.inline(F.array(*rows)))


def banded(spectrum: DataFrame) -> DataFrame:
    """``spectrum`` with the band of each line, as an expression: borders are few and fixed."""
    band = F.lit(0)
    for b in BORDERS[1:-1]:
        band = band + (F.col("line") >= b).cast("int")
    return spectrum.withColumn("band", band)


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, t, ts, v, kind): each user's events in order; t counts from 0."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("stream"), (F.row_number().over(order) - 1).cast("long").alias("t"), "ts", F.col("value").alias("v"), F.col("event_type").alias("kind"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, sub, bytes, bits): an order's lines as the packets of a unit, from 0."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.select(F.col("l_orderkey").alias("unit"), (F.row_number().over(order) - 1).cast("long").alias("sub"), F.col("l_quantity").cast("long").alias("bytes"), (F.col("l_quantity").cast("long") * 8).alias("bits"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(blob_id, data): documents as bytes."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("blob_id"), F.encode("text", "utf-8").alias("data"))


#: The same views for DuckDB, as common table expressions.
DUCK = {
    "spectra": """spectra AS (SELECT vec_id // 2 AS frame, CAST(vec_id % 2 AS INTEGER) AS ch, CAST(i - 1 AS INTEGER) AS line, CAST(embedding[i] AS DOUBLE) AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE embedding IS NOT NULL))""",
    "bands": "bands(band, start, stop) AS (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(BORDERS, BORDERS[1:], strict=False))) + ")",
    "signal": """signal AS (SELECT user_id AS stream, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS t, ts, value AS v, event_type AS kind FROM events)""",
    "packets": """packets AS (SELECT l_orderkey AS unit, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS BIGINT) AS sub,
  CAST(l_quantity AS BIGINT) AS bytes, CAST(l_quantity AS BIGINT) * 8 AS bits FROM lineitem)""",
}


def duck(*names: str) -> str:
    return "WITH " + ",\n".join(DUCK[n] for n in names)
