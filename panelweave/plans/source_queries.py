"""Queries that write given tables in a file format and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators import corpus as cp
from panelweave.operators import ranks as rk
from panelweave.plans import fixtures as fx
from panelweave.plans.fixtures import ENSEMBLE, PANEL
from panelweave.plans.registry import query, rnd, sql_hash, sql_rnd, sql_unit
from panelweave.sources import io


@query("read_columns_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    path = io.scratch_folder(t.spark)
    io.write_table(t.customer, path)
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return io.read_csv(t.spark, path, schema, ["c_custkey", "c_name", "c_acctbal"])


@query("read_pairs_json", """SELECT CAST(l_suppkey AS VARCHAR) AS budget_item, CAST(l_partkey AS VARCHAR) AS indicator,
  CASE WHEN l_orderkey % 2 = 0 THEN l_returnflag END AS related FROM lineitem""")
def _(t):
    path = io.scratch_folder(t.spark)
    lines = F.collect_list(F.struct("l_suppkey", "l_partkey", "l_returnflag"))
    rows = t.lineitem.groupBy("l_orderkey").agg(lines.alias("x"))
    rows.select(F.transform("x", lambda s: s["l_suppkey"].cast("string")).alias("budget_item"),
                F.transform("x", lambda s: s["l_partkey"].cast("string")).alias("indicator"),
                F.when(F.col("l_orderkey") % 2 == 0, F.transform("x", lambda s: s["l_returnflag"])).alias("related")).write.json(path)
    return io.read_pairs(t.spark, path, "b2i", multi_line=False)


@query("read_instruct_json", "SELECT role || ' ' || CAST(turn AS VARCHAR) AS instruction, text AS output FROM conversations")
def _(t):
    path = io.scratch_folder(t.spark)
    t.conversations.select(F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("instruction"),
                           F.col("text").alias("output")).write.json(path)
    return io.read_instruct(t.spark, path)


FILE_ROWS, FILE_BYTES = 1000, 16 << 20  # texts of a stored file, and the bytes after which a new one begins


def number_files(rows: DataFrame, group: list[str], order: str, file_bytes: int) -> DataFrame:
    """Adds ``part``: texts of a group, itself of at most FILE_ROWS rows, go to the next file once one holds ``file_bytes``."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    so_far = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("part", F.floor((F.sum(size).over(so_far) - size) / file_bytes))


def stored_texts(rows: DataFrame, path: str, file_rows: int = FILE_ROWS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """item_id and text, written to files of bounded size and read back by whole files.

    A text follows a form feed and a line with its id; form feeds in texts are written \\1, backslashes \\0, null \\2."""
    escaped = F.replace(F.replace("text", F.lit("\\"), F.lit("\\0")), F.lit("\f"), F.lit("\\1"))
    marked = F.concat(F.lit("\f"), F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce(escaped, F.lit("\\2")))
    placed = rows.withColumn("file", F.expr(f"monotonically_increasing_id() div {file_rows}"))
    (number_files(placed, ["file"], "item_id", file_bytes).select("file", "part", marked.alias("text"))
     .write.partitionBy("file", "part").text(path))
    files = io.read_corpus(rows.sparkSession, path, "*.txt")
    parts = files.select(F.explode(F.slice(F.split("text", "\f"), 2, 2 ** 30)).alias("record"))
    # the writer ends every text with a newline
    body = F.expr("substring(record, instr(record, '\n') + 1, length(record) - instr(record, '\n') - 1)")
    text = F.replace(F.replace(body, F.lit("\\1"), F.lit("\f")), F.lit("\\0"), F.lit("\\"))
    number = F.substring_index("record", "\n", 1)
    return parts.select(F.when(number != "", number).cast("bigint").alias("item_id"), F.when(body != "\\2", text).alias("text"))


@query("read_text_corpus", "SELECT item_id, text FROM benchmark")
def _(t):
    return stored_texts(t.benchmark.select("item_id", "text"), io.scratch_folder(t.spark))


def stored_docs(rows: DataFrame, path: str, file_rows: int = FILE_ROWS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """One document per term, the texts of its items in order of ids: written to numbered files of bounded size,
    read against the index, and digested file by file, so that no value holds a document."""
    term = (F.col("item_id") % 7).cast("int")
    docs = rows.select(term.alias("term_idx"), (term + 100).alias("pos"), "item_id", "text")
    index = docs.select("term_idx", "pos", F.concat(F.lit("title "), F.col("term_idx").cast("string")).alias("title")).distinct()
    keys = ["term_idx", "pos", "file"]
    texts = docs.where("text IS NOT NULL").withColumn("file", F.expr(f"item_id div {7 * file_rows}"))
    (number_files(texts, keys, "item_id", file_bytes).sortWithinPartitions(*keys, "part", "item_id").drop("item_id")
     .write.partitionBy(*keys, "part").text(path))
    stored = io.read_docs(rows.sparkSession, path, index, "*.txt", r"term_idx=(-?\d+)/", r"pos=(-?\d+)/",
                          {"file": r"file=(-?\d+)/", "part": r"part=(\d+)/"})
    return index.join(io.digest_docs(stored, ["file", "part"]), ["term_idx", "pos"], "left")


@query("read_binary_docs", """SELECT CAST(item_id % 7 AS INTEGER) AS term_idx, CAST(item_id % 7 + 100 AS INTEGER) AS pos, 'title ' || CAST(item_id % 7 AS VARCHAR) AS title,
  md5(string_agg(text, chr(10) ORDER BY item_id) || chr(10)) AS digest FROM benchmark GROUP BY item_id % 7""")
def _(t):
    return stored_docs(t.benchmark.select("item_id", "text"), io.scratch_folder(t.spark))


@query("read_experiments", """SELECT CAST(l_linenumber AS VARCHAR) AS exp_id, l_returnflag AS item, l_quantity AS score,
  'model ' || CAST(l_linenumber % 3 AS VARCHAR) AS llm_name FROM lineitem""")
def _(t):
    path = io.scratch_folder(t.spark)
    results = t.lineitem.select(F.col("l_linenumber").cast("string").alias("exp_id"), F.col("l_returnflag").alias("item"),
                                F.col("l_quantity").alias("score"))
    results.write.option("header", True).partitionBy("exp_id").csv(path)
    number = F.col("l_linenumber")
    config = t.lineitem.select(number.cast("string").alias("exp_id"),
                               F.concat(F.lit("model "), (number % 3).cast("string")).alias("llm_name")).distinct()
    return io.read_experiments(t.spark, f"{path}/exp_id=*/", "item string, score double", config)


@query("latest_version", """SELECT o_custkey, arg_max(o_orderkey, v) AS o_orderkey, max(v) AS version FROM (SELECT *, 'params_v' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS v FROM orders) GROUP BY 1""")
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.concat(
        F.lit("params_v"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("version"))
    return rk.latest_by(rows, ["o_custkey"], "version")


_RUN = "CASE WHEN p_size % 5 = 0 THEN 'run' || CAST(p_partkey AS VARCHAR) ELSE 'run' || CAST(p_partkey AS VARCHAR) || '_f1=0.' || CAST(p_size AS VARCHAR) END"


@query("best_by_name_metric", f"""SELECT name, coalesce(TRY_CAST(regexp_extract(name, 'f1=([0-9.]+)', 1) AS DOUBLE), 0) AS metric FROM (SELECT {_RUN} AS name FROM part)
  ORDER BY metric DESC, name DESC LIMIT 1""")
def _(t):
    return io.best_by_regex(t.part.select(F.expr(_RUN.replace("VARCHAR", "STRING")).alias("name")), "name", r"f1=([0-9.]+)")


@query("write_table", f"WITH {PANEL} SELECT * FROM panel")
def _(t):
    path = io.scratch_folder(t.spark)
    io.write_table(fx.panel(t), path)
    return io.read_csv(t.spark, path, "series bigint, year int, value double")


_TWO = sql_rnd("yes", 2)


@query("write_predictions", f"""WITH {ENSEMBLE} SELECT CAST(pair AS VARCHAR) AS budget_item, CAST(member AS VARCHAR) AS indicator, CASE WHEN yes > 0.2 THEN 'Yes' ELSE 'No' END AS related,
  '{{"Yes":' || CAST({_TWO} AS VARCHAR) || '}}' AS pred_aggregated, '["' || answer || '"]' AS predictions, '["' || event_type || '","again"]' AS prompts, '["' || answer || '"]' AS discourse FROM ens""")
def _(t):
    rows = fx.ensemble(t).select(
        F.col("pair").cast("string").alias("budget_item"), F.col("member").cast("string").alias("indicator"),
        F.when(F.col("yes") > 0.2, "Yes").otherwise("No").alias("related"),
        F.create_map(F.lit("Yes"), rnd(F.col("yes"), 2)).alias("pred_aggregated"), F.array("answer").alias("predictions"),
        F.array("event_type", F.lit("again")).alias("prompts"), F.array("answer").alias("discourse"))
    path = io.scratch_folder(t.spark)
    io.write_table(io.encode_predictions(rows, "b2i"), path)
    text = ["budget_item", "indicator", "related", "pred_aggregated", "predictions", "prompts", "discourse"]
    return io.read_csv(t.spark, path, ", ".join(f"{c} string" for c in text))


@query("write_split_dataset", f"SELECT doc_id, lang, CASE WHEN {sql_unit(sql_hash(10, 'doc_id'))} / 4294967296.0 < 0.8 THEN 'train' ELSE 'test' END AS split FROM documents")
def _(t):
    path = io.scratch_folder(t.spark)
    io.write_split(cp.split_docs(t.documents.select("doc_id", "lang"), "doc_id", 0.8, 10), path)
    return t.spark.read.schema("doc_id bigint, lang string, split string").parquet(path)


@query("write_partitioned_docs", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, md5(text) AS digest FROM documents")
def _(t):
    path = io.scratch_folder(t.spark)
    io.write_docs(t.documents.select("doc_id", "source", "text"), path, "source", ["doc_id"])
    stored = t.spark.read.schema("doc_id bigint, text string, pos bigint, source string").parquet(path)
    return stored.select("doc_id", "source", "pos", F.md5("text").alias("digest"))
