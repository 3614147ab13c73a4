"""Readers and writers. Every reader has a declared schema; nothing is inferred."""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.names import metric_in_name
from panelweave.operators.scale import null_safe_join, ordered_rank
from panelweave.session import ensure_checkpoint_dir

# the Arrow function below travels to the workers by value
register_pickle_by_value(sys.modules[__name__])

PAIR_COLUMNS = {"b2i": ("budget_item", "indicator"), "i2i": ("indicator1", "indicator2")}


def scratch_folder(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, on storage all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None,
             encoding: str = "UTF-8") -> DataFrame:
    df = (spark.read.schema(schema).option("header", True).option("encoding", encoding)
          .option("multiLine", False).option("escape", '"').csv(path))
    return df.select(*columns) if columns else df


def read_pairs(spark: SparkSession, path: str, kind: str, multi_line: bool = True) -> DataFrame:
    """JSON objects of parallel arrays to one row per index; a missing ``related`` is null."""
    one, two = PAIR_COLUMNS[kind]
    schema = f"{one} array<string>, {two} array<string>, related array<string>"
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    related = F.coalesce("related", F.array().cast("array<string>")).alias("related")
    return raw.select(F.explode(F.arrays_zip(F.col(one), F.col(two), related)).alias("r")).select("r.*")


def read_instruct(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema("instruction string, output string").option("multiLine", multi_line).json(path)


def read_corpus(spark: SparkSession, folder: str, pattern: str = "[0-9][0-9][0-9].txt") -> DataFrame:
    """Every matching file under a tree, one row per whole file."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_doc_index(spark: SparkSession, folder: str) -> DataFrame:
    """term_idx, pos, title, author from the index file of every search-term folder."""
    return (spark.read.schema("pos int, title string, author string").option("recursiveFileLookup", True)
            .option("pathGlobFilter", "index.csv").option("escape", '"').csv(folder)
            .withColumn("term_idx", F.regexp_extract(F.input_file_name(), r"/(\d+)/index\.csv$", 1).cast("int")))


def read_docs(spark: SparkSession, folder: str, index: DataFrame | None = None,
              pattern: str = "[0-9][0-9][0-9].*", term_in_path: str = r"/(\d+)/\d+\.[^/]*$",
              pos_in_path: str = r"/\d+/(\d+)\.[^/]*$", numbers: dict[str, str] | None = None) -> DataFrame:
    """Stored documents joined to title and author by search term and position, both of which the
    path tells. ``numbers`` are further columns from the path, for documents stored in several files."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).load(folder).select(
                 F.regexp_extract("path", term_in_path, 1).cast("int").alias("term_idx"),
                 F.regexp_extract("path", pos_in_path, 1).cast("int").alias("pos"),
                 *[F.regexp_extract("path", found, 1).cast("long").alias(name) for name, found in (numbers or {}).items()], "content"))
    return files.join(read_doc_index(spark, folder) if index is None else index, ["term_idx", "pos"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, md5 = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([md5.hexdigest()])],
                                          names=["term_idx", "pos", "digest"])

    for batch in batches:
        for term, pos, content in zip(*[batch.column(c) for c in ("term_idx", "pos", "content")]):
            own = term.as_py(), pos.as_py()
            if own != key:
                if md5:
                    yield row()
                key, md5 = own, hashlib.md5()
            md5.update(content.as_buffer())
    if md5:
        yield row()


def digest_docs(stored: DataFrame, order: Sequence[str]) -> DataFrame:
    """term_idx, pos and the MD5 of documents stored in several files. A document is read file by file in
    one task, as a digest is made from front to back; only one batch of files is held."""
    files = stored.select("term_idx", "pos", *order, "content").repartition("term_idx", "pos")
    return (files.sortWithinPartitions("term_idx", "pos", *order).select("term_idx", "pos", "content")
            .mapInArrow(_digest, "term_idx int, pos int, digest string"))


def read_experiments(spark: SparkSession, results_glob: str, results_schema: str, config: DataFrame,
                     pattern: str = r"exp_id=([^/]+)/") -> DataFrame:
    """Result files of all experiment folders, tagged by folder and joined to their configuration."""
    results = (spark.read.schema(results_schema).option("header", True).option("escape", '"').csv(results_glob)
               .withColumn("exp_id", F.regexp_extract(F.input_file_name(), pattern, 1)))
    return results.join(config, "exp_id")


def best_by_regex(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """The one row whose name carries the largest metric, 0 where the name has none."""
    scored = df.withColumn("metric", metric_in_name(F.col(name), pattern))
    order = F.struct("metric", F.col(name))
    return scored.agg(F.max_by(F.struct(*scored.columns), order).alias("r")).where("r IS NOT NULL").select("r.*")


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).format(fmt)
    (writer.option("header", True).option("escape", '"') if fmt == "csv" else writer).save(path)


def encode_predictions(df: DataFrame, kind: str) -> DataFrame:
    """Ensembles, prompts and discourse as JSON text, columns in export order."""
    text = {c: F.to_json(c).alias(c) for c in ("pred_aggregated", "predictions", "prompts", "discourse")}
    with_label = "related" in df.columns
    tail = (["pred_aggregated", "predictions", "prompts", "discourse"] if kind == "b2i" or with_label
            else ["pred_aggregated", "prompts", "predictions", "discourse"])
    return df.select(*PAIR_COLUMNS[kind], *(["related"] if with_label else []), *[text[c] for c in tail])


def write_split(df: DataFrame, path: str, column: str = "split") -> None:
    df.write.partitionBy(column).parquet(path)


def number_docs(df: DataFrame, term: str, order: Sequence[str]) -> DataFrame:
    """Running number from 0 inside each search term."""
    return ordered_rank(df, [term], order, "pos")


def write_docs(df: DataFrame, path: str, term: str, order: Sequence[str]) -> None:
    """One folder per search term, rows numbered inside it. Only the term and the ordering columns,
    which make rows unique, are ranked; the texts meet their numbers in one join."""
    numbers = number_docs(df.select(term, *order), term, order)
    null_safe_join(df, numbers, [term, *order], "inner").write.partitionBy(term).parquet(path)
