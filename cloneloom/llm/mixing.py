"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue of its documents in a pseudo-random order (md5 of seed and id), sent up to ``max_repeats``
times.  Documents go as packets of at most ``packet`` words, so that a very long one does not hold its source's turn.
A packet's virtual finish time is the words of its source up to its end, passes before it included, over the
source's target.  All packets of the table that start before time 1, when every queue has sent its target, are range-
sorted by finish time; a running sum of words over the ranges (their totals, then offsets) truncates the sorted
packets at the total budget: what ends within it is taken whole, the packet at the cut in part, the rest not at all.
So a source's taken words are within one packet of its target and all sources together meet the budget exactly.

Nothing gathers a source in one task: running sums within a source are taken in buckets (source, first hex digits of
the hash) with offsets from the short table of bucket sums, and ranges of virtual time are ``ranges`` stretches of
equal length in [0, 1], which hold about equal words, and one for what ends later.

Edge cases: null texts have size 0 and are never taken; null sources form one source, the last; an empty
table gives an empty result; rows that repeat an id are separate documents in an order fixed by their size, and rows
without an id are ordered by their texts; very long texts are many packets; a target of 0 takes nothing; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloneloom.llm.common import cut_lineage, n_words, shared_dir

CYCLE = (1, 2, 3)
#: Words of a document that are sent at a time.
PACKET = 64


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, max_repeats: int = 3) -> DataFrame:
    """source, source_size, weight, target, budget: the budget (all sizes) shared by weight, no target above its cap.

    sizes: one row per source (source, source_size).  Handing the excess of capped sources to the others by
    weight, again and again, ends at the level L with sum(min(L * weight, cap)) = budget; in order of
    cap / weight it is (budget - caps before) / (weights from here on) at the first source it does not cap,
    which is the largest such level.
    """
    every = Window.partitionBy(F.lit(0))
    by_code_point = every.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(by_code_point) - 1) % len(cycle) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * max_repeats)
    by_ratio = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn(
        "level",
        (F.sum("source_size").over(every) - F.sum("cap").over(before) + F.col("cap")) / F.sum("weight").over(onward),
    )
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every)
    return rows.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select(
        "source", "source_size", "weight", "target", F.sum("source_size").over(every).alias("budget")
    )


def queued_documents(docs: DataFrame, seed: int, cycle: tuple[int, ...], max_repeats: int, digits: int, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, budget, through: words of the source's queue up to the document's end."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *carry, F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("by_text"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), "by_text"))
    rows = rows.withColumn("shuffled", F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))).drop("by_text")
    rows = cut_lineage(rows.withColumn("bucket", F.substring("shuffled", 1, digits)))  # the texts are read once
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), cycle, max_repeats)
    first = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = (
        buckets.withColumn("offset", F.sum("bucket_size").over(first) - F.col("bucket_size"))
        .join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .select(F.col("source").alias("of"), F.col("bucket").alias("in"), "offset", "source_size", "target", "budget")
    )
    within = Window.partitionBy("source", "bucket").orderBy("shuffled", "doc_id", "size", *carry)
    queued = rows.withColumn("through", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    queued = queued.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in")))
    return queued.select("doc_id", "source", "size", "source_size", "target", "budget", (F.col("through") + F.col("offset")).alias("through"), *carry)


def truncated(packets: DataFrame, ranges: int) -> DataFrame:
    """packets (virtual_finish, source, words, budget) with taken: their words within the budget, in the order of finish times."""
    place = F.when(F.col("words") > 0, F.least(F.floor(F.col("virtual_finish") * ranges), F.lit(ranges))).otherwise(F.pmod(F.xxhash64("doc_id", "through"), F.lit(ranges)))
    rows = packets.withColumn("range", place.cast("int"))  # rows without words count nowhere and are spread over all
    rows = rows.repartitionByRange("range")
    own = Window.partitionBy("range").orderBy("virtual_finish", "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("range").agg(F.sum("words").alias("n"))  # ranges + 1 rows at most
    starts = totals.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    sums = rows.withColumn("sent", F.sum("words").over(own)).join(F.broadcast(starts), "range")
    left = F.col("budget") - F.col("start") - F.col("sent") + F.col("words")
    return sums.withColumn("taken", F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), left))).drop("range", "start", "sent", "budget")


def fair_schedule(
    docs: DataFrame, seed: int = 42, cycle: tuple[int, ...] = CYCLE, max_repeats: int = 3, digits: int = 3, packet: int = PACKET, ranges: int = 1024, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, takes, taken, virtual_finish.

    takes[e] is the words that the e-th pass over the source takes of the document; virtual_finish is that of
    its first pass.  carry: further columns, which also order rows of one id and size.
    """
    queued = queued_documents(docs, seed, cycle, max_repeats, digits, carry)
    clock = lambda words: F.when(F.col("target") > 0, words / F.col("target")).otherwise(F.lit(0.0))
    start = F.col("through") - F.col("size")
    places = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / packet), F.lit(1)).cast("int") - 1)
    # Packets that start before time 1; a document that has none keeps a row without words.
    cut = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: F.transform(places, lambda k: F.struct(
            e.alias("pass"), (e * F.col("source_size") + start + k * packet).alias("from"), F.least(F.lit(packet), F.col("size") - k * packet).alias("words"))))),
        lambda p: (p["words"] > 0) & (clock(p["from"]) < 1.0),
    )
    packets = queued.withColumn("first_finish", clock(F.col("through"))).select("*", F.explode_outer(cut).alias("p")).select(
        "doc_id", "source", "size", "source_size", "target", "budget", "through", "first_finish", *carry, "p.pass",
        F.coalesce("p.words", F.lit(0)).cast("long").alias("words"), F.coalesce(clock(F.col("p.from") + F.col("p.words")), F.lit(0.0)).alias("virtual_finish"),
    )
    sent = truncated(packets, ranges)
    per_pass = [F.coalesce(F.sum(F.when(F.col("pass") == e, F.col("taken"))), F.lit(0)).alias(f"take{e}") for e in range(max_repeats)]
    # Documents of no words can share a place in the queue: they come back as often as they went in.
    places = sent.groupBy("source", "through", "size", "doc_id").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.first("first_finish").alias("virtual_finish"), F.sum((F.col("size") == 0).cast("int")).alias("n"), F.sum("taken").alias("taken"), *[F.first(c).alias(c) for c in carry], *per_pass)
    rows = places.withColumn("takes", F.array(*[f"take{e}" for e in range(max_repeats)])).withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1)))))
    return rows.select("doc_id", "source", "size", "source_size", "target", "takes", "virtual_finish", "taken", *carry)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, the last ones of a source cut to their words.

    Rows are numbered and written to the shared folder first, so that each follows its own schedule even where rows
    repeat an id, a size or all they have.
    """
    spark, path = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/mix-{uuid.uuid4().hex}"
    docs.select("*", F.xxhash64(*docs.columns).alias("_tie"), F.monotonically_increasing_id().alias("_row")).write.parquet(path)
    rows = spark.read.parquet(path)
    schedule = fair_schedule(rows, carry=("_tie", "_row"), **how).where("taken > 0").select("_row", F.explode(F.filter("takes", lambda n: n > 0)).alias("_words"), F.col("size").alias("_size"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    kept = F.when(F.col("_words") < F.col("_size"), F.array_join(F.slice(words, F.lit(1), F.col("_words").cast("int")), " ")).otherwise(F.col("text"))
    joined = rows.join(schedule, "_row").withColumn("text", kept)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast("long"))
    return joined.select(*docs.columns)
