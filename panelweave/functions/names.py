"""Column functions on names and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: decile classes and the phrases that name them
DECILE_PHRASES = {
    "Most deprived decile": " for the most deprived decile of the population.",
    "Least deprived decile": " for the least deprived decile of the population.",
}


def strip_affixes(text: Column, patterns: Sequence[str]) -> Column:
    """Remove every match of each pattern, in the given order, then outer spaces."""
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, "")
    return F.trim(text)


def composite_key(*parts: Column) -> Column:
    """Join the parts with underscores."""
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def label_name_age(name: Column, age: Column, group: Column) -> Column:
    """Readable label: the age in brackets unless the name already tells it, then the decile."""
    first_number = F.regexp_extract(age, r"\d+", 0)
    told = (
        F.contains(name, age)
        | ((first_number != "") & F.contains(name, first_number))
        | name.rlike(r"\d+")
    )
    label = F.when(told, name).otherwise(F.concat(name, F.lit(" ("), age, F.lit(")")))
    phrase = F.lit("")
    for decile, words in reversed(list(DECILE_PHRASES.items())):
        phrase = F.when(F.contains(group, F.lit(decile)), F.lit(words)).otherwise(phrase)
    return F.replace(F.concat(label, phrase), F.lit("  "), F.lit(" "))


def join_names(authors: Column, field: str = "name") -> Column:
    """Array of author structs to one comma-separated text."""
    return F.array_join(F.transform(authors, lambda a: a[field]), ", ")


def layout_family(model: Column, families: Mapping[str, Sequence[str]]) -> Column:
    """First family one of whose name parts occurs in the model name, ignoring case."""
    low = F.lower(model)
    out = F.lit(None).cast("string")
    for family, parts in reversed(list(families.items())):
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(low, F.lit(part.lower()))
        out = F.when(hit, F.lit(family)).otherwise(out)
    return out


def replace_values(col: Column, mapping: Mapping[str, str]) -> Column:
    """Replace the named values, leave all others."""
    out = col
    for old, new in mapping.items():
        out = F.when(col == F.lit(old), F.lit(new)).otherwise(out)
    return out


def metric_in_name(name: Column, pattern: str) -> Column:
    """First capture of the pattern as a number, 0 when absent."""
    return F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("double"), F.lit(0.0))
