"""Roles of the given tables: panels, observations, edges, ensembles, labelled pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.plans.registry import Tables

YEARS = list(range(1995, 2002))
TRAIN_END = 1999
AGES = ["All ages", "10+ yrs", "16+ yrs", "18+ yrs", "40+ yrs", "65+ yrs", "18-64 yrs"]
AGE_ORDER = AGES[:6]


def money(col: str) -> Column:
    return F.sum(F.col(col).cast("decimal(18,2)")).cast("double")


def panel(t: Tables) -> DataFrame:
    """series, year, value: yearly order totals per customer, with gaps."""
    return t.orders.groupBy(F.col("o_custkey").alias("series"), F.year("o_orderdate").alias("year")).agg(
        money("o_totalprice").alias("value"))


PANEL = """panel AS (SELECT o_custkey AS series, CAST(year(o_orderdate) AS INTEGER) AS year,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY 1, 2)"""


def programs(t: Tables) -> DataFrame:
    """program, year, amount: yearly sales per supplier, all years present."""
    return t.lineitem.groupBy(F.col("l_suppkey").alias("program"), F.year("l_shipdate").alias("year")).agg(
        money("l_extendedprice").alias("amount"))


PROGRAMS = """programs AS (SELECT l_suppkey AS program, CAST(year(l_shipdate) AS INTEGER) AS year,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem GROUP BY 1, 2)"""


def cells(values: str, key: str = "year") -> str:
    return ", ".join(f'max(CASE WHEN {key} = {y} THEN {values} END) AS "{y}"' for y in YEARS)


def observations(t: Tables) -> DataFrame:
    """series, subgroup, grp, age, period, value: raw observations with repeated series."""
    age = F.element_at(F.array(*[F.lit(a) for a in AGES]), F.col("l_linenumber"))
    return t.lineitem.groupBy(
        F.col("l_suppkey").alias("series"), F.col("l_returnflag").alias("subgroup"),
        F.col("l_linestatus").alias("grp"), age.alias("age"), F.year("l_shipdate").alias("period")).agg(
        money("l_extendedprice").alias("value"))


OBS = f"""obs AS (SELECT l_suppkey AS series, l_returnflag AS subgroup, l_linestatus AS grp,
  list_extract([{', '.join(repr(a) for a in AGES)}], l_linenumber) AS age,
  CAST(year(l_shipdate) AS INTEGER) AS period,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2, 3, 4, 5)"""


def edges(t: Tables) -> DataFrame:
    """src, dst, weight: signed weights between part and supplier numbers."""
    return t.lineitem.groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(
        F.sum(F.col("l_quantity") - 25.5).alias("weight"))


EDGES = """edges AS (SELECT l_partkey AS src, l_suppkey AS dst, sum(l_quantity - 25.5) AS weight
  FROM lineitem GROUP BY 1, 2)"""


def nodes(t: Tables) -> DataFrame:
    """node with three categories, the last one sometimes missing."""
    return t.part.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("c1"),
                         F.col("p_type").alias("c2"), F.when(F.col("p_size") > 25, F.concat(
                             F.lit("size "), F.col("p_size").cast("string"))).alias("c3"))


NODES = """nodes AS (SELECT p_partkey AS node, p_brand AS c1, p_type AS c2,
  CASE WHEN p_size > 25 THEN 'size ' || CAST(p_size AS VARCHAR) END AS c3 FROM part)"""


def ensemble(t: Tables) -> DataFrame:
    """pair, member, yes, no, na, answer: one row per ensemble member."""
    cents = F.floor(F.col("value") * 100 + 0.5)
    yes = cents * 2 / 100000
    digit = F.get_json_object("props", "$.k")
    answer = (F.when(F.col("event_type") == "click", F.concat(F.lit("Yes, level "), digit))
              .when(F.col("event_type") == "view", F.lit("I know it is true"))
              .when(F.col("event_type") == "signup", F.lit("Correct."))
              .when(F.col("event_type") == "error", F.concat(digit, F.lit(" is FALSE"))).otherwise(F.lit("maybe")))
    return t.events.select(F.col("user_id").alias("pair"), F.col("event_id").alias("member"),
                           yes.alias("yes"), ((1 - yes) / 2).alias("no"), ((1 - yes) / 4).alias("na"),
                           answer.alias("answer"), cents.alias("cents"), "event_type", "ts")


ENSEMBLE = """ens AS (SELECT pair, member, yes, (1 - yes) / 2 AS no, (1 - yes) / 4 AS na, answer, cents, event_type, ts FROM (
  SELECT user_id AS pair, event_id AS member, event_type, ts, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents,
  floor(value * 100 + 0.5) * 2 / 100000 AS yes,
  CASE event_type WHEN 'click' THEN 'Yes, level ' || json_extract_string(props, '$.k') WHEN 'view' THEN 'I know it is true'
  WHEN 'signup' THEN 'Correct.' WHEN 'error' THEN json_extract_string(props, '$.k') || ' is FALSE' ELSE 'maybe' END AS answer
  FROM events))"""


def probs_map() -> Column:
    return F.create_map(F.lit("Yes"), F.col("yes"), F.lit("No"), F.col("no"), F.lit("NA"), F.col("na"))


def scored(t: Tables) -> DataFrame:
    """exp, item, related, truth, p_yes, pred: scored predictions of seven experiments."""
    p_yes = F.least(F.lit(1.0), F.col("l_extendedprice") / 100000)
    truth = (F.col("l_linestatus") == "F").cast("int")
    return t.lineitem.select(
        F.col("l_linenumber").alias("exp"), F.col("l_returnflag").alias("item"),
        F.when(truth == 1, "Yes").otherwise("No").alias("related"), truth.alias("truth"), p_yes.alias("p_yes"),
        F.when(p_yes >= 0.5, "Yes").otherwise("No").alias("pred"))


SCORED = """scored AS (SELECT exp, item, related, truth, p_yes, CASE WHEN p_yes >= 0.5 THEN 'Yes' ELSE 'No' END AS pred FROM (
  SELECT l_linenumber AS exp, l_returnflag AS item, CASE WHEN l_linestatus = 'F' THEN 'Yes' ELSE 'No' END AS related,
  CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS truth, least(1.0, l_extendedprice / 100000) AS p_yes FROM lineitem))"""


def spend(t: Tables) -> DataFrame:
    """item, name: spend names of each broad item; some items have a Total."""
    name = F.when(F.col("p_type") == "ECONOMY", "Total ECONOMY").otherwise(F.col("p_type"))
    return t.part.select(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("item"), name.alias("name"))


SPEND = """spend AS (SELECT p_brand || ' ' || CAST(p_size AS VARCHAR) AS item,
  CASE WHEN p_type = 'ECONOMY' THEN 'Total ECONOMY' ELSE p_type END AS name FROM part)"""


def pairs(t: Tables) -> DataFrame:
    """row_id, budget_item, indicator, related: labelled pairs."""
    return t.part.select(
        F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("budget_item"),
        F.concat_ws(" ", "p_name", "p_type").alias("indicator"),
        F.when(F.col("p_size") <= 20, "Yes").otherwise("No").alias("related"))


PAIRS = """pairs AS (SELECT p_partkey AS row_id, p_brand AS budget_item, p_name || ' ' || p_type AS indicator,
  CASE WHEN p_size <= 20 THEN 'Yes' ELSE 'No' END AS related FROM part)"""
