"""Column functions that read labels and numbers out of answer texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("Yes", "No", "NA")


def parse_yes_no(text: Column, word_boundary: bool = False) -> Column:
    """Label of a free answer by keyword, first rule wins.

    By default keywords match anywhere in the text ("know" counts as "no");
    ``word_boundary`` asks for whole words.
    """
    low = F.lower(text)

    def has(word: str) -> Column:
        return low.rlike(rf"\b{word}\b") if word_boundary else F.contains(low, F.lit(word))

    # fixed values: the keywords, in the order they are tried
    return (F.when(has("yes"), "Yes").when(has("no"), "No").when(has("false"), "No")
            .when(has("not"), "No").when(has("true") | has("correct"), "Yes").otherwise("NA"))


def parse_scale_digit(text: Column, top: int) -> Column:
    """First digit of the text, null when there is none or it lies above the scale."""
    digit = F.regexp_extract(text, "[0-9]", 0).try_cast("int")
    return F.when(digit <= top, digit)


def parse_category(text: Column, options: Mapping[str, str], labels: Mapping[str, str]) -> Column:
    """Option number at the start, else the option wording, else the number anywhere, else NA."""
    low = F.lower(text)
    tiers = [
        [(F.substring(low, 1, 1) == F.lit(number), number) for number in options],
        [(F.contains(low, F.lit(wording.lower())), number) for number, wording in options.items()],
        [(F.contains(low, F.lit(number)), number) for number in options],
    ]
    out = F.lit("NA")
    for test, number in reversed([rule for tier in tiers for rule in tier]):
        out = F.when(test, F.lit(labels[number])).otherwise(out)
    return out


def one_hot(label: Column, labels=LABELS) -> Column:
    """Label to a probability map that is 1 on the label."""
    pairs = []
    for name in labels:
        pairs += [F.lit(name), (label == F.lit(name)).cast("double")]
    return F.create_map(*pairs)


def _as_json(text: Column) -> Column:
    """Single quotes to double ones, quotes around numeric keys."""
    quoted = F.replace(text, F.lit("'"), F.lit('"'))
    return F.regexp_replace(quoted, r"([{,]\s*)(\d+)\s*:", '$1"$2":')


def parse_probs(text: Column) -> Column:
    """JSON text of a label distribution to a map; Python-style quotes and numeric keys are
    accepted. Text is parsed, never evaluated."""
    return F.from_json(_as_json(text), "map<string,double>")


def parse_ensemble(text: Column) -> Column:
    """JSON text of a list of distributions, one per member, to an array of maps."""
    return F.from_json(_as_json(text), "array<map<string,double>>")


def edge_weight(weight: Column) -> Column:
    """Scaled mean when stored, else the mean, else 0."""
    return F.coalesce(weight["scaled_mean"], weight["mean"], F.lit(0.0))


def argmax_label(probs: Column, labels=LABELS) -> Column:
    """Label of the largest probability; the earlier label wins a tie."""
    top = F.greatest(*[F.coalesce(probs[name], F.lit(-1.0)) for name in labels])
    out = F.lit(None).cast("string")
    for name in reversed(labels):
        out = F.when(probs[name] == top, F.lit(name)).otherwise(out)
    return out


def expected_scale(probs: Column) -> Column:
    """Sum of scale value times probability."""
    return F.aggregate(F.map_entries(probs), F.lit(0.0),
                       lambda acc, e: acc + e["key"].cast("double") * e["value"])
