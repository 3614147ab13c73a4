"""Whole flows: prediction tables, labelled pair sets, training rows from documents and instructions, model
inputs from a panel."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions import answers as an
from panelweave.functions import names as nm
from panelweave.functions import text as tx
from panelweave.functions.numbers import clamp_rate
from panelweave.operators import aggregates as ag
from panelweave.operators import answers as ans
from panelweave.operators import corpus as cp
from panelweave.operators import joins as jn
from panelweave.operators import languages as lg
from panelweave.operators import networks as nw
from panelweave.operators import panel as pn
from panelweave.operators import pairs as pr
from panelweave.operators import subwords as sw
from panelweave.operators.scale import spread
from panelweave.session import durable


def prediction_table(pairs: DataFrame, ids: Sequence[str], names: Sequence[str], templates: Sequence[str],
                     answers: DataFrame, effect: str = "directly", parse: Callable[[Column], Column] = an.parse_yes_no,
                     aggregate: str = "distribution", top: int = 5) -> DataFrame:
    """Pairs to prompts, answers (a table of ids, member, answer) to predictions, predictions to one
    result per pair. ``parse`` turns an answer into a label or a digit; ``aggregate`` is
    ``distribution`` or ``mode`` of labels, or ``scale`` of digits up to ``top``. Prompts and
    predictions of a pair stay together as arrays; a pair has one entry per template.

    Only members and predictions are grouped and joined. A prompt follows from the pair's names and the
    member, so prompts are written last, in the joined row, and no text goes through a sort or an aggregate."""
    parsed = answers.where(F.col("member").isin(*range(len(templates)))).withColumn("prediction", parse(F.col("answer"))).select(*ids, "member", "prediction")
    if aggregate == "scale":
        result = ans.agg_scale(parsed, ids, "prediction", top)
    else:
        one_hot = parsed.withColumn("__p", an.one_hot(F.col("prediction")))
        result = (ans.agg_distribution(one_hot, ids, F.col("__p")) if aggregate == "distribution"
                  else ans.agg_mode(one_hot, ids, "member", F.col("__p")))
    kept = parsed.groupBy(*ids).agg(F.collect_list(F.struct("member", "prediction")).alias("__m"))
    # rows that repeat a pair's ids share the prompts of all of them
    named = pairs.groupBy(*ids).agg(F.collect_list(F.struct(*[F.col(c).alias(f"n{i}") for i, c in enumerate(names)])).alias("__n"))

    def entries(row: Column) -> Column:
        texts = pr.prompt_array({c: row[f"n{i}"] for i, c in enumerate(names)}, templates, effect)
        return tx.let(texts, lambda t: F.transform("__m", lambda m: F.struct(
            m["member"].alias("member"), F.get(t, m["member"].cast("int")).alias("prompt"), m["prediction"].alias("prediction"))))

    joined = pairs.join(result, list(ids)).join(kept, list(ids)).join(named, list(ids))
    stacked = joined.withColumn("__m", F.sort_array(F.flatten(F.transform("__n", entries)))).drop("__n")
    return stacked.withColumns({"prompts": F.transform("__m", lambda m: m["prompt"]),
                                "predictions": F.transform("__m", lambda m: m["prediction"])}).drop("__m")


def pair_dataset(outcome: DataFrame, spend: DataFrame, item: str, name: str, indicator: str, patterns: Sequence[str],
                 seed: int, train_share: float = 0.2, least: int = 2) -> DataFrame:
    """Approved (item, indicator) pairs to a labelled train and test set: items get their broad names,
    affixes of the indicators go, as many negatives are drawn per item as it has pairs (and others
    exist), groups of an item and a label with fewer than ``least`` rows go, the rest is split with
    the same share of each group. Pairs are unique."""
    named = jn.rename_items(outcome, ag.broad_names(spend, item, name), item, "name")
    positives = durable(named.select(item, nm.strip_affixes(F.col(indicator), patterns).alias(indicator)).distinct())
    drawn = pr.negatives(positives, item, [indicator], seed).select(item, indicator, "related")
    both = positives.withColumn("related", F.lit("Yes")).unionByName(drawn)
    kept = durable(ag.min_size(both, [item, "related"], least))
    return pr.split_stratified(kept, [item, "related"], train_share, [indicator], seed)


def _id(value: int) -> Column:
    return F.array(F.lit(value).cast("bigint"))


def corpus_rows(docs: DataFrame, doc: str, text: str, languages: Sequence[str], profiles: lg.Profiles, merges: sw.Merges, length: int = 256,
                words: int = 196, overlap: float = 0.45, min_words: int = 98, train_share: float = 0.8,
                seed: int = 10, separator: str = r"\n{2,}", tasks: int | None = None) -> DataFrame:
    """Documents to padded sub-word rows with begin and end ids and labels up to the end id, split into
    train and test by whole document. Row-local from the document to its rows. ``tasks`` deals documents over so
    many tasks first, see ``scale.spread``."""
    clean = docs.select(doc, tx.strip_direction_marks(F.col(text)).alias(text))
    marked = cp.split_docs(spread(clean, doc, tasks), doc, train_share, seed)
    chunked = cp.chunk_overlap(cp.split_paragraphs(marked, text, min_words, separator), text, words, overlap)
    kept = lg.language_filter(chunked, text, languages, profiles)
    encoded = sw.with_tokens(kept, text, merges, length - 2).withColumn("ids", F.concat(_id(merges.begin), "ids", _id(merges.end)))
    rows = cp.pad_truncate_mask(encoded, "ids", length, merges.pad)
    return rows.select(doc, "paragraph_no", "chunk_no", "language", "split", "input_ids", "attention_mask",
                       tx.labels_until_eos(F.col("input_ids"), merges.begin, merges.end).alias("labels"))


def instruct_rows(rows: DataFrame, key: str, instruction: str, output: str, layout: str, merges: sw.Merges, length: int = 256,
                  train_share: float = 0.8, seed: int = 10) -> DataFrame:
    """Instructions and answers to padded sub-word rows whose labels cover the tokens of the answer and the one after it,
    split by hash. ``layout`` uses {user} and {response}; white space counts as single spaces. Row-local."""
    def spaced(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))

    shaped = rows.select(key, spaced(tx.fill(F.lit(layout), user=F.col(instruction), response=F.col(output))).alias("text"),
                         spaced(F.col(output)).alias("answer"))
    tokens = sw.with_tokens(shaped, "text", merges, length - 1, spans="spans")
    after = F.length("text")  # the end id touches no character
    framed = tokens.withColumn("ids", F.concat("ids", _id(merges.end))).withColumn(
        "spans", F.concat("spans", F.array(F.struct(after.alias("begin"), after.alias("end")))))
    labels = sw.labels_answer_span(F.col("ids"), F.col("spans"), F.col("text"), F.col("answer"))
    padded = cp.pad_truncate_mask(framed.withColumn("labels", labels), "ids", length, merges.pad)
    return cp.split_docs(padded, key, train_share, seed).select(
        key, "split", "input_ids", "attention_mask", tx.pad_ids(F.col("labels"), length, tx.IGNORE).alias("labels"))


def calibration_inputs(panel: DataFrame, categories: DataFrame, key: str, t: str, val: str, years: Sequence[int],
                       train_end: int, category_columns: Sequence[str], at_least: int = 5) -> DataFrame:
    """Series with enough years, gaps filled, scaled by their training bounds: value at the first
    and the last year and the mean success rate of the series' categories."""
    enough = ag.valid_years(panel.where(F.col(t).between(min(years), max(years))), [key], val, at_least)
    kept = panel.join(enough.select(key), key, "left_semi")
    # read by the rates and by the scaling
    filled = durable(pn.gap_fill(kept, key, t, val, years, "linear"))
    scaled = pn.normalise(filled.select(key, t, val), key, t, val, train_end)
    ends = scaled.groupBy(key).agg(
        F.max(F.when(F.col(t) == min(years), F.col("scaled"))).alias("start"),
        F.max(F.when(F.col(t) == max(years), F.col("scaled"))).alias("final"))
    train = filled.where(F.col(t) <= train_end).select(key, t, val).join(categories, key)
    rates = ag.success_rate(train, key, t, val, category_columns)
    means = ag.mean_rate(categories.select(key, *category_columns), key, category_columns, rates)
    return ends.join(means, key).select(key, "start", "final", clamp_rate(F.col("success_rate")).alias("success_rate"))


def calibration_schedule(amounts: DataFrame, prices: DataFrame, people: DataFrame, items: DataFrame, key: str, t: str, val: str,
                         base: int, train_end: int, k: int, first: int, last: int, start: int, end: int) -> DataFrame:
    """Spending to disbursement periods: deflated per head, detrended, each year cut into ``k`` periods,
    the periods of the years start to end kept, and aligned with the full list of items, which keep a
    row with nulls where they spend nothing."""
    real = pn.deflate(amounts, prices, people, t, val, base).select(key, t, F.col("adjusted").alias(val))
    flat = pn.detrend(real, key, t, val, train_end).select(key, t, F.col("detrended").alias(val))
    periods = pn.period_slice(pn.refine(flat, key, t, val, k, first, last), start, end, k, first)
    return jn.align(items.select(key), periods, [key])


def calibration_networks(item_edges: DataFrame, items: DataFrame, indicators: DataFrame, default: DataFrame, yes: Column,
                         links: DataFrame, method: str, item_least: float = 0.5, link_least: float | None = None) -> DataFrame:
    """Both edge tables of a calibration run as kind, src, dst, weight: which item funds which indicator
    (weight 1, the default for indicators without any), and how indicators act on each other."""
    funds = nw.b2i_network(item_edges, items, indicators, default, yes, item_least)
    acts = nw.i2i_network(links, indicators, method, link_least)
    return funds.select(F.lit("item").alias("kind"), F.col("item_idx").alias("src"), F.col("indicator_idx").alias("dst"), F.lit(1.0).alias("weight")).unionByName(
        acts.select(F.lit("indicator").alias("kind"), "src", "dst", "weight"))
