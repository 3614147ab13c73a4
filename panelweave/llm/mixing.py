"""Source mixing by hash thresholds: histograms of sizes per source and hash bucket, no sort of documents.

A source's documents stand in the order of a 60-bit hash of their id. Its budget falls into one of 4096
buckets of the leading 12 bits; that bucket alone is cut again by the next 12 bits, five times in all,
until the boundary is one hash value. Documents below it are taken by a plain filter. Histograms are
summed before the shuffle, so a hot source sends at most 4096 rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import WORD, named
from panelweave.operators.scale import null_safe_join, with_row
from panelweave.session import durable

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BITS, LEVELS = 12, 5
BROADCAST_BYTES = 32 << 20  # most bytes of the table of sources that are broadcast


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column) -> Column:
    """60 bits of a hash of the id; a null id hashes like the text 'null'."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target from one row per source.

    Weights go round the sources in code-point order, null last. A target is the level times the weight,
    at most ``most`` times the size; the level is the one that makes targets add up to all sizes. Both
    windows hold one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = ranked.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = F.when(F.sum("weight").over(after) > 0,
                   (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0)))
                   / F.sum("weight").over(after))
    leveled = rows.withColumn("level", level)
    chosen = leveled.where(F.col("level") * F.col("weight") <= F.col("most")).agg(F.max("level").alias("level"))
    return with_row(rows, chosen).select(
        "source", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def thresholds(places: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source of ``plan`` (source, budget): ``cut``, the boundary hash, and ``at_cut``, whether documents
    exactly there are taken. ``cut`` is null where the budget covers the whole source."""
    state = plan.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        cut = null_safe_join(places.select("source", "size", F.shiftright("place", shift).alias("bucket")), state, ["source"], "inner")
        if level:
            cut = cut.where(F.shiftright("bucket", BITS) == F.col("prefix"))
        hist = cut.groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.max("budget").alias("budget"),
                                                   F.max("below").alias("below"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        summed = hist.withColumn("upto", F.col("below") + F.sum("size").over(upto)).where(F.col("upto") > F.col("budget"))
        first = F.min(F.struct("bucket", "upto", "size", "budget")).alias("b")
        state = summed.groupBy("source").agg(first).select(
            "source", F.col("b.budget").alias("budget"), F.col("b.bucket").alias("prefix"),
            (F.col("b.upto") - F.col("b.size")).alias("below"), F.col("b.upto").alias("upto"))
    near = (F.col("upto") - F.col("budget")) <= (F.col("budget") - F.col("below"))
    return state.select("source", F.col("prefix").alias("cut"), near.alias("at_cut"))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per source: source, source_size, target, whole (full copies of every document), cut, at_cut."""
    places = durable(docs.select(named(source_col).cast("string").alias("source"), word_count(named(text_col)).alias("size"),
                                 place(named(id_col)).alias("place")))
    plan = targets(places.groupBy("source").agg(F.sum("size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = durable(plan.withColumn("whole", whole.cast("long"))
                   .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))
    return durable(null_safe_join(plan, thresholds(places, plan), ["source"], "left").drop("budget"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", out_col: str = "mix") -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target`` (of its source), ``copies`` and ``taken``
    (= size * copies) in the struct column ``out_col``, beside all its own columns; an own column of that
    name is replaced.

    A source takes whole documents: all of them as often as the target covers the source, then those whose
    hash lies below the boundary; the document at the boundary is taken if that brings the sum nearer. Null
    text has size 0; null is a source of its own, ordered last. Rows that repeat an id are taken together.
    Sources without words get target 0. An empty table gives an empty result. The same rows give the same
    mix on every run.
    """
    plan = decide(docs, id_col, text_col, source_col)
    held = plan.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()[0] or 0
    plan = plan.select(F.struct("source_size", "target", "whole", "cut", "at_cut").alias("__llm_plan"), F.col("source").alias("__llm_source"))
    if held <= BROADCAST_BYTES:  # one row per source; more sources than that meet their rows in a shuffled join
        plan = F.broadcast(plan)
    sized = docs.withColumns({"__llm_size": word_count(named(text_col)), "__llm_here": place(named(id_col))})
    joined = sized.join(plan, named(source_col).cast("string").eqNullSafe(F.col("__llm_source")))
    p, here, size = F.col("__llm_plan"), F.col("__llm_here"), F.col("__llm_size")
    more = F.col("__llm_plan.cut").isNull() & (p.target > p.whole * p.source_size) | (here < p.cut) | (here == p.cut) & p.at_cut
    copies = p.whole + F.when(F.coalesce(more, F.lit(False)) & (p.whole < MOST_REPEATS), 1).otherwise(0)
    out = F.struct(size.alias("size"), p.source_size.alias("source_size"), p.target.alias("target"),
                   copies.alias("copies"), (size * copies).alias("taken"))
    return joined.select(*[named(c) for c in docs.columns if c.lower() != out_col.lower()], out.alias(out_col))


def repeat_taken(docs: DataFrame, **columns: str) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with its own columns."""
    taken = mix(docs, out_col="__llm_mix", **columns)
    copies = F.explode(F.sequence(F.lit(1), F.lit(MOST_REPEATS + 1))).alias("__llm_copy")
    repeated = taken.select(*[named(c) for c in docs.columns], F.col("__llm_mix.copies").alias("__llm_copies"), copies)
    return repeated.where(F.col("__llm_copy") <= F.col("__llm_copies")).select(*[named(c) for c in docs.columns])
