"""Sampling labelled pairs and filling prompt templates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.text import fill, single_spaced
from panelweave.operators.scale import (
    attach_stats,
    hash_bucket,
    hash_number,
    hash_rank,
    hash_text,
    null_safe_join,
    running_sums,
    with_row,
)
from panelweave.operators.selection import smallest_by_hash
from panelweave.session import durable

EXAMPLE_QUESTION, EXAMPLE_ANSWER = "Example Question ", "Example Answer "  # fixed values
STRIDE = 2_305_843_009_213_693_951  # prime 2^61 - 1: steps through any smaller range without repeats


def negatives(df: DataFrame, item: str, others: Sequence[str], seed: int,
              exclude_known: bool = False) -> DataFrame:
    """Per item with n rows, min(n, total − n) different rows of other items, relabelled to it.

    Rows get positions with every item in one contiguous block, so the rows of other items are
    one circular range. The k-th row of an item draws the place (start + k·stride) modulo the
    range length, which never repeats; an equi-join on the position fetches the row. No pair of
    items is ever crossed and a frequent item is spread over its hash buckets.
    """
    ranked = hash_rank(df, [item], seed, others, "__k")
    sizes = df.groupBy(item).agg(F.count(F.lit(1)).alias("__n")).withColumn("__ih", hash_text(seed, item))
    starts = running_sums(sizes, [], hash_bucket(F.col("__ih")), ["__ih", item], {"__s": F.col("__n")})
    total = df.agg(F.count(F.lit(1)).alias("__all"))
    # read twice below, as the drawing rows and as the rows drawn
    placed = durable(with_row(null_safe_join(ranked, starts.drop("__ih"), [item], "inner"), total).withColumn(
        "__at", F.col("__s") + F.col("__k")))
    room = F.col("__all") - F.col("__n")
    offset = hash_number(hash_text(seed, F.lit("offset"), item)).cast("decimal(20,0)")
    wide = "decimal(19,0)"
    place = (offset + F.col("__k").cast(wide) * (F.lit(STRIDE).cast(wide) % room.cast(wide))) % room.cast(wide)
    draws = placed.where((F.col("__k") < room) & (room > 0)).select(
        F.col(item).alias("__item"),
        ((F.col("__s") + F.col("__n") + place) % F.col("__all")).cast("bigint").alias("__at"))
    picked = draws.join(placed.select("__at", *others, F.col(item).alias(f"{item}_source")), "__at")
    out = picked.select(F.col("__item").alias(item), *others, f"{item}_source", F.lit("No").alias("related"))
    if exclude_known:
        out = out.join(df.select(item, *others).distinct(), [item, *others], "left_anti")
    return out


def split_stratified(df: DataFrame, strata: Sequence[str], train_share: float, ids: Sequence[str],
                     seed: int) -> DataFrame:
    """Train and test with the same share of every stratum."""
    ranked = attach_stats(hash_rank(df, strata, seed, ids, "__r", nulls_match=True), strata,
                          [F.count(F.lit(1)).alias("__n")], source=df)
    cut = F.floor(F.col("__n") * train_share + 0.5)
    return ranked.withColumn("split", F.when(F.col("__r") < cut, "train").otherwise("test")).drop("__r", "__n")


def sample_n(df: DataFrame, n: int, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows without replacement, all rows when there are no more: those whose ``ids``, which make rows
    unique, have the smallest hashes. A filter, without a sort or a join."""
    return smallest_by_hash(df, n, ids, seed)


def sample_balanced(df: DataFrame, label: str, n: int, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """n/2 rows of label Yes and n/2 of label No."""
    ranked = hash_rank(df.where(F.col(label).isin("Yes", "No")), [label], seed, ids, "__r")
    return ranked.where(F.col("__r") < n // 2).drop("__r")


def sample_strata(df: DataFrame, col: str, n: int, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """⌈n × share⌉ rows of every category, at least one."""
    sized = attach_stats(hash_rank(df, [col], seed, ids, "__r", nulls_match=True), [col],
                         [F.count(F.lit(1)).alias("__n")], source=df)
    sized = with_row(sized, df.agg(F.count(F.lit(1)).alias("__all")))
    want = F.greatest(F.lit(1), F.ceil(F.lit(n) * F.col("__n") / F.col("__all")))
    return sized.where(F.col("__r") < want).drop("__r", "__n", "__all")


def with_templates(pairs: DataFrame, templates: Sequence[str]) -> DataFrame:
    """One row per pair and ensemble member; the templates are literals of the plan."""
    members = F.array(*[F.lit(t) for t in templates])
    return pairs.select("*", F.posexplode(members).alias("member", "template"))


def prompts(pairs: DataFrame, templates: Sequence[str], columns: Sequence[str], effect: str = "") -> DataFrame:
    """Fill every template with the pair's names. Dots at both ends of a name go, an
    "arbitrary" effect leaves its word blank, double spaces collapse. ``template`` keeps the wording."""
    shaped = _shaped(F.col("template"), effect)
    return with_templates(pairs, templates).withColumn("prompt", _named(shaped, {c: F.col(c) for c in columns})).withColumn("template", shaped)


def _shaped(template: Column, effect: str) -> Column:
    return single_spaced(fill(template, effect=F.lit("" if effect == "arbitrary" else effect)))


def _named(shaped: Column, names: Mapping[str, Column]) -> Column:
    return fill(shaped, **{c: F.btrim(name, F.lit(".")) for c, name in names.items()})


def prompt_array(names: Mapping[str, Column], templates: Sequence[str], effect: str = "") -> Column:
    """The prompts of :func:`prompts` as one array per row, a member's prompt at its own place (from 0)."""
    return F.array(*[_named(_shaped(F.lit(t), effect), names) for t in templates])


def _draw(rows: DataFrame, keys: Sequence[str], examples: DataFrame, k: int, seed: int,
          ids: Sequence[str], tag: str, left_out: Column | None) -> DataFrame:
    """Up to k different examples per row. The pool in hash order is cut into k + 1 equal stretches
    and a hash of the row picks one place in each, so no example repeats and the choices are
    independent; what ``left_out`` says of (row, example) goes, and k of the rest stay."""
    placed = hash_rank(examples, [], f"{seed}{tag}", ids, "__at")
    size = examples.agg(F.count(F.lit(1)).alias("__size"))
    spots = with_row(rows, size).withColumn("__d", F.explode(F.sequence(F.lit(0), F.lit(k))))
    edge = [F.floor((F.col("__d") + i) * F.col("__size") / (k + 1)) for i in (0, 1)]
    spot = edge[0] + hash_number(hash_text(f"{seed}{tag}", *keys, "__d")) % (edge[1] - edge[0])
    wanted = spots.where(edge[1] > edge[0]).withColumn("__at", spot.cast("bigint")).drop("__size")
    drawn = wanted.join(placed, "__at").drop("__at")
    return drawn if left_out is None else drawn.where(~F.coalesce(left_out, F.lit(False)))


def _chosen(drawn: DataFrame, keys: Sequence[str], k: int, order: Sequence[str], question: Column, answer: Column) -> DataFrame:
    """The first k examples of each row as an array; a group holds at most k + 1."""
    lines = F.sort_array(F.collect_list(F.struct(*order, question.alias("q"), answer.alias("a"))))
    return drawn.groupBy(*keys).agg(F.slice(lines, 1, k).alias("__x"))


def _context(lines: Column) -> Column:
    # fixed values: how an example is written
    def written(line: Column, i: Column) -> Column:
        no = i.cast("string")
        return F.concat(F.lit(EXAMPLE_QUESTION), no, F.lit(": "), line["q"],
                        F.lit("\n" + EXAMPLE_ANSWER), no, F.lit(": "), line["a"], F.lit("."))
    return F.array_join(F.transform(lines, written), "\n\n")


def _prefixed(rows: DataFrame, contexts: DataFrame, keys: Sequence[str], prompt: str) -> DataFrame:
    """Rows for which the pool has no example keep their bare prompt."""
    joined = rows.join(contexts, list(keys), "left")
    full = F.when(F.size("__x") > 0, F.concat(_context(F.col("__x")), F.lit("\n\n"), F.col(prompt))).otherwise(F.col(prompt))
    return joined.withColumn(prompt, full).drop("__x")


def with_shots(rows: DataFrame, keys: Sequence[str], examples: DataFrame, question: Column, answer: Column,
               k: int, seed: int, ids: Sequence[str], prompt: str = "prompt", left_out: Column | None = None) -> DataFrame:
    """k labelled examples, numbered, in front of the prompt. ``question`` and ``answer`` read the
    row's columns (its own template, say) and the example's; ``examples`` should be the train part,
    and ``left_out`` keeps a row's own pair from its prompt. Example columns must not clash with row
    columns."""
    drawn = _draw(rows.drop(prompt), keys, examples, k, seed, ids, "any", left_out)
    return _prefixed(rows, _chosen(drawn, keys, k, ["__d"], question, answer), keys, prompt)


def with_balanced_shots(rows: DataFrame, keys: Sequence[str], examples: DataFrame, label: str, question: Column,
                        answer: Column, k: int, seed: int, ids: Sequence[str], prompt: str = "prompt",
                        left_out: Column | None = None) -> DataFrame:
    """⌈k/2⌉ positive and ⌊k/2⌋ negative examples in hash order in front of the prompt."""
    parts = []
    for name, share in (("Yes", -(-k // 2)), ("No", k // 2)):
        if share:
            drawn = _draw(rows.drop(prompt), keys, examples.where(F.col(label) == name), share, seed, ids, name, left_out)
            mixed = drawn.withColumn("__h", hash_text(seed, *keys, *ids))
            parts.append(_chosen(mixed, keys, share, ["__d", "__h", *ids], question, answer).select(*keys, F.explode("__x").alias("__e")))
    both = reduce(lambda a, b: a.unionByName(b), parts)
    lines = F.sort_array(F.collect_list(F.struct("__e.__h", *[f"__e.{c}" for c in ids], "__e.q", "__e.a")))
    return _prefixed(rows, both.groupBy(*keys).agg(lines.alias("__x")), keys, prompt)


def with_reversed(pairs: DataFrame, templates: Sequence[str], reversed_templates: Sequence[str],
                  columns: Sequence[str], effect: str = "") -> DataFrame:
    """Prompts in both option orders; both belong to the ensemble."""
    straight = prompts(pairs, templates, columns, effect).withColumn("reversed", F.lit(False))
    swapped = prompts(pairs, reversed_templates, columns, effect).withColumn("reversed", F.lit(True))
    return straight.unionByName(swapped)


def expand_answers(rows: DataFrame, answers: Sequence[str], prompt: str = "prompt") -> DataFrame:
    """One row per prompt and candidate answer, the answer appended."""
    return rows.withColumn("answer", F.explode(F.array(*[F.lit(a) for a in answers]))).withColumn(
        "filled", F.concat(F.col(prompt), F.col("answer")))


def second_stage(rows: DataFrame, statement: str, template: str, columns: Sequence[str]) -> DataFrame:
    """The first answer becomes the statement of a second, categorising prompt."""
    values = {"statement": F.col(statement), **{c: F.col(c) for c in columns}}
    return rows.withColumn("second_prompt", single_spaced(fill(F.lit(template), **values)))
