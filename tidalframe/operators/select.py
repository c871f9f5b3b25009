"""Selection among rules with stated ties, as ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_rule(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """(request_id, rule_id): the rule that suits each request best, null where none does.

    Rules (rule_id, pos, effect, downmix_id, lower, upper, depends_on) are a catalogue, a literal or a small table; it is
    broadcast, so it must fit the memory of an executor.
    One suits if its downmix is the request's or the wildcard 127, if it depends on no other or that is
    allowed, and if the loudness lies in its range. A shared effect counts most, then the exact
    downmix, then independence; of equals the last by ``pos`` wins.
    """
    r, q = F.broadcast(rules.alias("r")), requests.alias("q")
    suits = (
        F.col("r.downmix_id").isin(127) | (F.col("r.downmix_id") == F.col("q.downmix_id"))
    ) & (F.col("q.allow_dependent") | F.col("r.depends_on").isNull()) & (
        F.col("q.loudness").isNull() | F.col("q.loudness").between(F.coalesce("r.lower", F.lit(-63)), F.coalesce("r.upper", F.lit(0)))
    )
    rank = F.struct(
        ((F.col("q.effect") != 0) & (F.col("r.effect").bitwiseAND(F.col("q.effect")) != 0)).cast("int").alias("effect"),
        (F.col("r.downmix_id") == F.col("q.downmix_id")).cast("int").alias("exact"),
        F.col("r.depends_on").isNull().cast("int").alias("free"),
        F.col("r.pos").alias("pos"),
        F.col("r.rule_id").alias("rule_id"),
    )
    return q.join(r, suits, "left").groupBy("q.request_id").agg(F.max(F.when(F.col("r.pos").isNotNull(), rank))["rule_id"].alias("rule_id"))


def loudness(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """(request_id, loudness): of the album's or the tracks' entries, the first of a set with the request's downmix, else the first with the wildcard 127.

    An entry whose loudness is null counts as found, but gives way to the wildcard's.
    """
    e, q = F.broadcast(entries.alias("e")), requests.alias("q")
    exact, wild = F.col("e.downmix_id") == F.col("q.downmix_id"), F.col("e.downmix_id") == 127
    fits = (F.col("e.album") == F.col("q.album")) & (F.col("e.set_id") == F.col("q.set_id")) & (exact | wild)
    first = lambda which: F.min(F.when(which, F.struct(F.col("e.pos").alias("pos"), F.col("e.loudness").alias("loudness"))))["loudness"]
    return q.join(e, fits, "left").groupBy("q.request_id").agg(F.coalesce(first(exact), first(wild)).alias("loudness"))


def first_rank(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each ``by`` in ``order``, which must end in a key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")
