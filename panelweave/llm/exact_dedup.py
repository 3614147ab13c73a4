"""Exact duplicates: partitions exchange Golomb-coded fingerprints, not texts.

1. Every partition writes (id, SHA-256, place) of its rows to the checkpoint folder: about 60 bytes a row.
2. It sends its sorted distinct 64-bit fingerprints, cut by range, to their owners as Golomb-Rice codes.
3. An owner counts in how many messages a fingerprint occurs and answers each message with a bitmap.
4. Rows whose fingerprint is marked are suspects. Only their texts are shuffled, and grouped by their
   bytes, with partial aggregation first, so a group of copies sends one row per task.
5. The verified groups go back to the suspects over the digest in a join whose hot keys can split.

A text with very many copies adds one code per message at most, so no owner grows with one group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm import exchange
from panelweave.llm.common import (LOWER, UPPER, byte_values, in_filter, named, pick, presence_filter,
                                   shuffle_partitions)
from panelweave.operators.scale import null_safe_join
from panelweave.session import durable



def _fingerprint(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [hashlib.sha256(text.lower()).digest() for text in byte_values(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary())], names=["doc_id", "sha"])


def _send(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, digests = None, []
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                digests += batch.column("sha").to_pylist()
        if part is not None:
            yield exchange.messages(part, _fingerprint(digests), owners)
    return run


def _mark(owners: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        """Rows of one part with the bitmaps it got back."""
        fingerprints = _fingerprint(rows.column("sha").to_pylist())
        repeated, _ = exchange.marks(fingerprints, answers, owners)
        return pa.table([rows.column("doc_id"), rows.column("sha"), rows.column("place"), pa.array(repeated),
                         pa.array(fingerprints.view(np.int64), pa.int64())], names=["doc_id", "sha", "place", "suspect", "fp"])
    return run


def _suspect_texts(flags):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text.lower() for text in byte_values(batch, "text")]
            digests = [hashlib.sha256(text).digest() for text in texts]
            if not digests:
                continue
            hit = np.flatnonzero(in_filter(flags.value, _fingerprint(digests)))
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in hit], pa.binary()),
                                              pa.array([texts[i] for i in hit], pa.binary())], names=["sha", "body"])
    return run


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (hex), place.

    Texts are equal when identical after lower-casing A-Z only. Null text counts as empty, and empty
    texts are equal to each other. The largest id of a group stays; null ids come last; of rows that
    repeat both id and text one stays. ``place`` tells such rows apart and is stable, as the narrow
    rows are written to the checkpoint folder. Very long texts are hashed whole. Extra columns do not
    matter. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = pick(docs, doc_id=id_col, text=text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()
    owners = shuffle_partitions(docs)
    rows = durable(source.select("doc_id", F.col("text").cast("string").alias("text"))
                   .mapInArrow(_digest, f"doc_id {id_type}, sha binary")
                   .withColumn("part", F.spark_partition_id().cast("long")).withColumn("place", F.monotonically_increasing_id()))
    answers = (exchange.to_owners(rows.select("sha", "part").mapInArrow(_send(owners), exchange.MESSAGE), owners)
               .mapInArrow(exchange.answer, exchange.ANSWER))
    marked = durable(rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
        _mark(owners), f"doc_id {id_type}, sha binary, place long, suspect boolean, fp long"))
    suspects = marked.where("suspect")

    flags = spark.sparkContext.broadcast(presence_filter(suspects, "fp", filter_bits))
    texts = (source.select(F.col("text").cast("string").alias("text"))
             .mapInArrow(_suspect_texts(flags), "sha binary, body binary"))
    verified = (texts.groupBy("sha", "body").agg(F.count(F.lit(1)).alias("rows"))
                .groupBy("sha").agg(F.max("rows").alias("group_size"), F.count(F.lit(1)).alias("texts")))
    best = suspects.groupBy("sha").agg(F.max(F.struct("doc_id", "place")).alias("best"))
    groups = best.join(verified, "sha").select(
        "sha", "best", F.when(F.col("texts") == 1, F.col("group_size"))
        .otherwise(F.raise_error(F.lit("two different texts have one SHA-256"))).alias("group_size"))
    grouped = null_safe_join(suspects, groups, ["sha"], "left").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("place") == F.col("best.place")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "place")
    single = marked.where("NOT suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "place")
    return single.unionByName(grouped)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Only ids and digests of dropped rows are joined."""
    fate = durable(classify(docs, id_col, text_col).groupBy("doc_id", "text_sha256")
                   .agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("rows")))
    digest = F.sha2(F.translate(F.coalesce(named(text_col).cast("string"), F.lit("")), UPPER, LOWER), 256)

    def matching(keys: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("__llm_id"), F.col("text_sha256").alias("__llm_sha"))
        return rows.join(keys, named(id_col).eqNullSafe(F.col("__llm_id")) & (digest == F.col("__llm_sha")), how)

    out = matching(fate.where("NOT stays OR rows > 1"), docs, "left_anti")
    repeated = fate.where("stays AND rows > 1")
    if repeated.isEmpty():
        return out
    # equal as in ``classify``: by the lower-cased text, null as empty
    once = matching(repeated, docs, "left_semi").withColumn("__llm_sha", digest).dropDuplicates([id_col, "__llm_sha"])
    return out.unionByName(once.drop("__llm_sha"))
