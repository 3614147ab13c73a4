"""Documents to training rows, and paper lists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions import text as tx
from panelweave.operators.ranks import keep_first
from panelweave.operators.scale import global_index, hash_text, hash_unit


def split_paragraphs(df: DataFrame, text: str, min_words: int, separator: str = r"\n{2,}") -> DataFrame:
    """One row per paragraph with its position."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(tx.paragraphs(F.col(text), min_words, separator)).alias("paragraph_no", text))


def chunk_overlap(df: DataFrame, text: str, words: int = 196, overlap: float = 0.45) -> DataFrame:
    """One row per overlapping word window with its position."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(tx.overlapping_windows(F.col(text), words, overlap)).alias("chunk_no", text))


def extract_after_marker(df: DataFrame, text: str, marker: str) -> DataFrame:
    return df.withColumn(text, tx.after_last_marker(F.col(text), marker)).where(F.col(text).isNotNull())


def dedup_papers(df: DataFrame, term: str, pos: str, title: str = "title", author: str = "author") -> DataFrame:
    """One paper per (title, author): the earliest search term, and in it the last position."""
    return keep_first(df, [title, author], [F.col(term), -F.col(pos)], [term, pos])


def citation_filter(df: DataFrame, citations: str, least: int) -> DataFrame:
    return df.where(F.col(citations) >= least)


def signature_filter(df: DataFrame, content: str, signature: bytes = b"%PDF") -> DataFrame:
    """Keep binary content that starts with the signature."""
    return df.where(F.substring(F.col(content), 1, len(signature)) == F.lit(bytearray(signature)))


def tokens(df: DataFrame, doc: str, text: str) -> DataFrame:
    """One row per whitespace token with its position."""
    words = F.filter(F.split(F.col(text), r"\s+", -1), lambda w: w != "")
    return df.select(doc, F.posexplode(words).alias("pos", "token"))


def vocabulary(df: DataFrame, doc: str, text: str, first_id: int = 0) -> DataFrame:
    """Token ids by falling frequency. Counts are pre-aggregated and the ranking is cut by
    range, so neither a frequent token nor a long tail meets in one task."""
    counts = tokens(df, doc, text).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = global_index(counts.withColumn("__neg", -F.col("n")), ["__neg", "token"], "token_id")
    return ranked.select("token", "n", (F.col("token_id") + first_id).alias("token_id"))


def encode(df: DataFrame, doc: str, text: str, vocab: DataFrame, length: int | None = None) -> DataFrame:
    """Token id array per document, in text order; only the first ``length`` tokens if given. A
    group is one document's own tokens. Documents without tokens keep an empty array, tokens the
    vocabulary lacks are left out. ``doc`` must be unique."""
    words = F.filter(F.split(F.col(text), r"\s+", -1), lambda w: w != "")
    kept = words if length is None else F.slice(words, 1, length)
    found = (df.select(doc, F.posexplode_outer(kept).alias("pos", "token"))
             .join(vocab.select("token", "token_id"), "token", "left"))
    placed = F.when(F.col("token_id").isNotNull(), F.struct("pos", "token_id"))
    ordered = F.sort_array(F.collect_list(placed))
    return found.groupBy(doc).agg(F.transform(ordered, lambda s: s["token_id"]).alias("ids"))


def pad_truncate_mask(df: DataFrame, ids: str, length: int, pad: int = 0) -> DataFrame:
    return df.withColumn("attention_mask", tx.attention_mask(F.col(ids), length)).withColumn(
        "input_ids", tx.pad_ids(F.col(ids), length, pad))


def format_chat(df: DataFrame, layouts: Mapping[str, tuple[str, str]], family: str, user: str,
                system: str | None = None, response: str | None = None) -> DataFrame:
    """Fill the chat layout of each row's model family. A layout is (with system, without system),
    using {system}, {user} and {response}."""
    blank = F.lit(None).cast("string")
    sys_col = F.col(system) if system else blank
    with_system, plain = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (full, bare) in layouts.items():
        hit = F.col(family) == name
        with_system = F.when(hit, F.lit(full)).otherwise(with_system)
        plain = F.when(hit, F.lit(bare)).otherwise(plain)
    layout = F.when(sys_col.isNotNull(), with_system).otherwise(plain)
    filled = tx.fill(layout, system=sys_col, user=F.col(user), response=F.col(response) if response else blank)
    return df.withColumn("text", F.btrim(filled, F.lit(" ")))


def flatten_chat(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The turns of a conversation, in order, as one text. ``valid`` tells whether user turns
    outnumber assistant turns by 0 or 1. A group is one conversation, which is one output row."""
    line = F.concat(F.lit("<"), F.col(role), F.lit("> "), F.col(text))
    turns = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("line"))))
    lead = F.sum((F.col(role) == "user").cast("int")) - F.sum((F.col(role) == "assistant").cast("int"))
    return df.groupBy(conv).agg(F.array_join(F.transform(turns, lambda s: s["line"]), "\n").alias("chat"),
                                lead.isin(0, 1).cast("int").alias("valid"))


def split_docs(df: DataFrame, doc: str, train_share: float, seed: int) -> DataFrame:
    """Mark whole documents as train or test by their hash, without a shuffle."""
    return df.withColumn("split", F.when(hash_unit(hash_text(seed, doc)) < train_share, "train").otherwise("test"))
