"""Column functions on running text and token arrays. All are row-local."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100  # fixed value: label of tokens that do not count in the loss


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``."""
    return F.transform(F.array(value), body)[0]


def paragraphs(text: Column, min_words: int, separator: str = r"\n{2,}") -> Column:
    """Array of paragraphs: outer newlines trimmed, split on the separator, inner newlines
    removed unless a non-ASCII character follows, spaces trimmed, short ones dropped."""
    parts = F.split(F.btrim(text, F.lit("\n")), separator, -1)
    cleaned = F.transform(
        parts, lambda p: F.btrim(F.regexp_replace(p, r"\n(?![^\u0000-\u007F])", ""), F.lit(" ")))
    return F.filter(cleaned, lambda p: F.size(F.split(p, " ", -1)) >= min_words)


def overlapping_windows(text: Column, words: int, overlap: float) -> Column:
    """Array of word windows of the given size; a short text is one window."""
    step = int(words * (1 - overlap))

    def windows(tokens: Column) -> Column:
        extra = F.greatest(F.ceil((F.size(tokens) - words) / F.lit(float(step))), F.lit(0)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), extra),
            lambda i: F.btrim(F.array_join(F.slice(tokens, i * step + 1, F.lit(words)), " "), F.lit(" ")))

    return let(F.split(text, " ", -1), windows)


def strip_direction_marks(text: Column) -> Column:
    """Remove embedding marks together with a newline right after them."""
    # fixed values: the three directional control characters U+202A to U+202C
    return F.regexp_replace(text, "[\u202a\u202b\u202c]\n?", "")


def truncate_tokens(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, " ", -1), 1, n), " ")


def after_last_marker(text: Column, marker: str, keep_unmarked: bool = False) -> Column:
    """Text behind the last marker, trimmed. Without a marker null, or the text itself."""
    last = F.btrim(F.substring_index(text, marker, -1), F.lit(" \n"))
    return last if keep_unmarked else F.when(F.contains(text, F.lit(marker)), last)


def pad_ids(ids: Column, length: int, pad: int = 0) -> Column:
    """Cut or right-pad token ids to a fixed length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad).cast("bigint"), length)), 1, length)


def attention_mask(ids: Column, length: int) -> Column:
    used = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(length) - used))


def _only(ids: Column, first: Column, last: Column) -> Column:
    """Ids at the 0-based positions first to last, the ignore label elsewhere. Built from three
    pieces, so a row costs its length once."""
    size = F.size(ids)
    lo = F.greatest(F.least(first, size), F.lit(0)).cast("int")
    hi = F.greatest(F.least(last + 1, size), lo).cast("int")
    blank = F.lit(IGNORE).cast("bigint")
    return F.concat(F.array_repeat(blank, lo), F.slice(ids, lo + 1, hi - lo), F.array_repeat(blank, size - hi))


def labels_until_eos(ids: Column, bos: int, eos: int) -> Column:
    """Ids up to the first end token behind the first start token, the ignore label after it;
    all ids when no end token follows."""
    start = F.array_position(ids, bos)
    tail = F.when(start > 0, F.slice(ids, start.cast("int"), F.size(ids)))
    offset = F.array_position(tail, eos)
    last = F.coalesce(F.when(offset > 0, start + offset - 2), F.size(ids).cast("bigint"))
    return _only(ids, F.lit(0), last)


def fill(template: Column, **values: Column) -> Column:
    """Replace {name} placeholders by column values."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def single_spaced(text: Column) -> Column:
    return F.replace(text, F.lit("  "), F.lit(" "))
