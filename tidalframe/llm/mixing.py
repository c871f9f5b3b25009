"""Operator 2: mix sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Each source's key space is cut into ranges that hold about the
same number of rows, so a source with a third of all rows is many ranges. Words are summed by range,
the sums are summed along the ranges of each source, and each range orders its own rows: together an
exact prefix sum of words in key order, of which no task sees more than one range. A source gives
whole epochs and, of one more epoch, exactly the words that its target still lacks: the document on
the edge gives its first words only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, documents, dropped, shuffle_partitions, written

#: Most rows that one range of a source's keys should hold.
RANGE_ROWS = 200_000
#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (1, 2, 3)
#: No document is used more often.
MAX_EPOCHS = 3

_OWN = ["size", "source_size", "target", "taken"]


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources from (source, source_size): columns weight and target follow.

    All sources together get the sum of all sizes, by weight; a target stops at ``max_epochs`` times
    its source's size and what it can't use goes to the others by weight. With the sources in order
    of cap over weight, those that stop are the first ones, so running sums find the level at which
    the others share the rest.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    # One row for each source, which these windows gather in one task.
    out = sizes.withColumn("weight", weight).withColumn("__cap", F.col("source_size") * max_epochs)
    by_cap = Window.orderBy(F.col("__cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns(
        {
            "__all": F.sum("source_size").over(everything),
            "__capped": F.coalesce(F.sum("__cap").over(before), F.lit(0)),
            "__weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    ).withColumns({"__level": (F.col("__all") - F.col("__capped")) / F.col("__weights"), "__at": F.row_number().over(by_cap)})
    # The first source in this order that doesn't stop sets the level for itself and all after it.
    fits = F.col("__level") * F.col("weight") <= F.col("__cap")
    out = out.withColumn("__final", F.min(F.when(fits, F.struct("__at", "__level"))).over(everything)["__level"])
    target = F.least(F.col("__cap").cast("double"), F.coalesce(F.col("__final") * F.col("weight"), F.col("__cap").cast("double")))
    return out.withColumn("target", target).drop("__cap", "__all", "__capped", "__weights", "__level", "__at", "__final")


def mix_sources(
    df: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size_col: str | None = None,
) -> DataFrame:
    """``df`` with size, source_size, target and taken (words that the mix takes, repeats counted).

    Each source's taken words add up to its target, rounded down. Null sources are one source, the
    last. Null and empty texts have size 0 and give 0 words. Equal ids tie in key order: they share
    the hash, and their order is that of their sizes, so totals are exact and reruns agree. An empty
    table gives no rows. Columns of ``df`` with the names of the new ones are replaced. ``size_col``
    may name a column that holds the sizes already.
    """
    spark = df.sparkSession
    size = F.col(f"`{size_col}`").cast("long") if size_col else words(F.col(f"`{text_col}`"))
    base = df.withColumn("__size", size)
    base = dropped(base, _OWN) if size_col not in _OWN else dropped(base, [n for n in _OWN])
    source = F.col(f"`{source_col}`").cast("string")
    digest = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    base = base.withColumns({"__source": F.coalesce(F.concat(F.lit("="), source), F.lit("")), "__key": digest})
    totals = base.groupBy("__source").agg(F.sum("__size").alias("source_size"), F.count("*").alias("__rows"), F.first(source).alias("source"))
    plan = targets(totals, weights, max_epochs)
    rows = F.sum("__rows").over(Window.partitionBy())
    per_range = F.greatest(F.lit(1), F.least(F.lit(RANGE_ROWS), F.ceil(rows / (4 * shuffle_partitions(spark)))))
    budget = F.floor("target")
    plan = plan.withColumns(
        {
            "__ranges": F.ceil(F.col("__rows") / per_range),
            "__epochs": F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0),
            "__rest": F.when(F.col("source_size") > 0, budget % F.col("source_size")).otherwise(0),
        }
    ).select("__source", "source_size", "target", "__ranges", "__epochs", "__rest")
    plan = written(plan, "mix-plan")
    # The high 32 bits of the key, scaled to the source's number of ranges: ranges are in key order.
    high = F.conv(F.substring("__key", 1, 8), 16, 10).cast("long")
    ranged = base.join(plan, "__source").withColumn("__range", F.floor(high * F.col("__ranges") / F.lit(2**32)).cast("long"))
    sums = ranged.groupBy("__source", "__range").agg(F.sum("__size").alias("__n"))
    ahead = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__source", "__range", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__offset"))
    own = Window.partitionBy("__source", "__range").orderBy("__key", "__size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("__before", F.coalesce(F.sum("__size").over(own), F.lit(0))).join(offsets, ["__source", "__range"])
    left = F.col("__rest") - F.col("__offset") - F.col("__before")
    taken = F.col("__epochs") * F.col("__size") + F.greatest(F.lit(0), F.least(F.col("__size"), left))
    keep = [F.col(f"`{c}`") for c in base.columns if not c.startswith("__")]
    return placed.select(*keep, F.col("__size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))


def copies(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The texts of a mix: each document as often as it is taken, the last copy cut to its words.

    ``mixed`` is what ``mix_sources`` returns. Documents of which nothing is taken go.
    """
    rest = F.col("taken") % F.greatest(F.col("size"), F.lit(1))
    whole = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))
    text = F.col(f"`{text_col}`")
    # Only the document on the edge of a source is cut, so few texts are ever taken apart.
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col("__copy") > whole, F.array_join(F.slice(pieces, F.lit(1), rest.cast("int")), "")).otherwise(text)
    times = (whole + (rest > 0).cast("long")).cast("int")
    out = mixed.withColumn("__copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
    return out.withColumn(text_col, cut).drop("__copy")


def op2_mix(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' target weights."""
    docs = documents(spark, sf_dir).select("doc_id", "source", words(F.col("text")).alias("n"))
    mixed = mix_sources(written(docs, "mix-sizes"), size_col="n")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = """
WITH d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([1.0, 2.0, 3.0][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, 3 * source_size AS cap,
         sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER w, 0) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weights
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(total - capped AS DOUBLE) / weights AS level,
             row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS pos FROM c),
m AS (SELECT *, min(CASE WHEN level * weight <= cap THEN pos END) OVER () AS first_fit FROM l),
f AS (SELECT *, max(CASE WHEN pos = first_fit THEN level END) OVER () AS final FROM m),
t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(final * weight, CAST(cap AS DOUBLE))) AS target FROM f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - ahead)) END AS BIGINT) AS taken
FROM p
"""
