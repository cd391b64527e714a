"""Mixing sources to target weights by nested thresholds on a hash.

Every document has a place in [0, 2**60) given by a hash of its id. A source
takes the documents below a threshold of that place, and the threshold is found
from sums of words by hash bucket: 4,096 buckets per source, then 4,096 parts of
the one bucket where the budget ends, then the places in the one part where it
ends. Nothing is sorted but those few places, and only sums are shuffled.

Defined cases: a null text has size 0; a null source is a source of its own, the
last; documents with one id share one place, so repeated rows share what is
left of the budget there in proportion to their sizes, rounded down; an empty
table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
_FINE_BITS = (48, 36)  # a place's bits below the first and the second bucket
BROADCAST_SOURCES = 50_000


def place(doc_id: Column) -> Column:
    """60 bits of the id's MD5; null ids share one place."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """``target`` for each row of ``totals(source, source_size)``.

    Sources by code point, null last, weigh ``weights`` in turn. A target is
    ``min(most_repeats * size, level * weight)``; the level is where the targets
    add up to all words. Seen from the smallest cap per weight upwards, it is the
    first rest per remaining weight that the next cap allows, which is where
    resharing the excess again and again ends. One row per source passes through
    one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = totals.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    ).withColumn("cap", (F.col("source_size") * most_repeats).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    return (
        weighed.withColumn("level", level)
        .withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
        .withColumn("level", F.first("fits", ignorenulls=True).over(by_cap.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("source", "source_size",
                F.least("cap", F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))
    )


def _ends_in(sums: DataFrame, bucket: str) -> DataFrame:
    """The bucket of each source in which its budget ends, and what is left of
    the budget there. ``sums(source, budget, bucket, words)``."""
    upto = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sums.withColumn("upto", F.sum("words").over(upto))
        .where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("words") <= F.col("budget")))
        .select("source", bucket, (F.col("budget") - F.col("upto") + F.col("words")).alias("budget"))
    )


def _small(df: DataFrame) -> DataFrame:
    """A saved table of one row per source, broadcast if it was counted small."""
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def mix(docs: DataFrame, weights=WEIGHTS, most_repeats: int = MOST_REPEATS, *more: str) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per row of ``docs``, and ``more``: the
    source, if asked for."""
    scratch = Scratch(docs.sparkSession)
    first, second = _FINE_BITS
    sized = scratch.save(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                    place(F.col("doc_id")).alias("place"))
    )
    coarse = scratch.save(
        sized.groupBy("source", F.shiftright("place", first).alias("b1"))
        .agg(F.sum("size").alias("words"))
    )
    goal = targets(
        coarse.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most_repeats
    )
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    goal = scratch.save(
        goal.withColumn("times", F.coalesce(times, F.lit(0)).cast("long")).withColumn(
            "budget", F.round(F.col("target") - F.col("times") * F.col("source_size")).cast("long"))
    )
    same_source = lambda a, b: a["source"].eqNullSafe(b["source"])

    budgets = _small(goal).select("source", "budget")
    at_1 = scratch.save(_ends_in(
        coarse.join(budgets, same_source(coarse, budgets)).select(coarse["*"], "budget"), "b1"))
    edge = _small(at_1)
    inside = sized.join(
        edge, same_source(sized, edge) & (F.shiftright(sized["place"], first) == edge["b1"])
    ).select(sized["source"], "place", "size", "budget")
    at_2 = scratch.save(_ends_in(
        inside.groupBy("source", "budget", F.shiftright("place", second).alias("b2"))
        .agg(F.sum("size").alias("words")), "b2"))
    edge = _small(at_2)
    inside = sized.join(
        edge, same_source(sized, edge) & (F.shiftright(sized["place"], second) == edge["b2"])
    ).select(sized["source"], "place", "size", "budget")
    at_3 = scratch.save(_ends_in(
        inside.groupBy("source", "budget", "place").agg(F.sum("size").alias("words"))
        .withColumnRenamed("place", "b3"), "b3"))
    last = inside.groupBy("source", "place").agg(F.sum("size").alias("words"))
    at_3 = scratch.save(
        at_3.join(last, same_source(at_3, last) & (at_3["b3"] == last["place"]))
        .select(at_3["source"], "b3", at_3["budget"].alias("left"), last["words"].alias("there"))
    )
    found = goal.join(at_3, same_source(goal, at_3), "left").select(
        goal["source"], "source_size", "target", "times", "budget", "b3", "left", "there")
    plan = _small(scratch.save(found))
    # without a place where the budget ends, it is all words or none
    extra = (
        F.when(F.col("b3").isNull(), F.when(F.col("budget") > 0, F.col("size")).otherwise(0))
        .when(F.col("place") < F.col("b3"), F.col("size"))
        .when(F.col("place") == F.col("b3"), F.expr("left * size div there"))
        .otherwise(0)
    )
    plan = plan.withColumnRenamed("source", "of")
    return sized.join(plan, sized["source"].eqNullSafe(plan["of"]), "left").select(
        *more, "doc_id", "size", "source_size", "target",
        (F.col("times") * F.col("size") + extra).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``.

    A document is repeated as often as its taken words hold it, to the nearest
    whole number; whole documents only. Rows of one id, size and source stand for the
    same share. A document without a word is kept once.
    """
    taken = mix(docs, weights, most_repeats, "source").groupBy("source", "doc_id", "size").agg(
        F.max("taken").alias("taken"))
    # the row travels whole, so that no column of its own meets these
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"),
                       F.col("source").alias("from"), n_words(F.col("text")).alias("words"))
    joined = rows.join(
        taken, rows["id"].eqNullSafe(taken["doc_id"]) & (rows["words"] == taken["size"])
        & rows["from"].eqNullSafe(taken["source"]))
    copies = F.when(F.col("size") == 0, 1).otherwise(
        F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).cast("int")
    return (
        joined.select("row", copies.alias("copies")).where(F.col("copies") > 0)
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .select("row.*")
    )
