"""Queries on joins, candidate pairs, networks and allocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import aggregates as ag
from panelweave.operators import joins as jn
from panelweave.operators import mixing as mx
from panelweave.operators import networks as nw
from panelweave.operators import ranks as rk
from panelweave.plans import fixtures as fx
from panelweave.plans.fixtures import EDGES, ENSEMBLE, PANEL, SPEND
from panelweave.plans.registry import query, rnd, sql_hash, sql_rnd, sql_unit


# ---- joins ------------------------------------------------------------------

@query("join_lookup", """SELECT o_orderkey, o_custkey, c_mktsegment, c_nationkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def _(t):
    dim = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return jn.lookup(t.orders.select("o_orderkey", "o_custkey"), dim, ["o_custkey"])


@query("join_outer_stats", f"""WITH {PANEL} SELECT c_custkey AS series, c_mktsegment, lowest, highest FROM customer FULL OUTER JOIN
  (SELECT series, min(value) AS lowest, max(value) AS highest FROM panel GROUP BY 1) s ON s.series = c_custkey""")
def _(t):
    stats = fx.panel(t).groupBy("series").agg(F.min("value").alias("lowest"), F.max("value").alias("highest"))
    return jn.attach_outer(t.customer.select(F.col("c_custkey").alias("series"), "c_mktsegment"), stats, ["series"])


@query("anti_join_existing", f"""WITH {PANEL}, known AS (SELECT l_suppkey AS series, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem)
  SELECT * FROM panel p WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.series = p.series AND k.year = p.year)""")
def _(t):
    known = t.lineitem.select(F.col("l_suppkey").alias("series"), F.year("l_shipdate").alias("year"))
    return jn.minus(fx.panel(t), known, ["series", "year"])


_ITEMS = "items AS (SELECT DISTINCT p_brand AS item, p_type AS category FROM part)"


@query("join_category", f"""WITH {_ITEMS}, ind AS (SELECT c_custkey AS indicator, CASE WHEN c_acctbal > 0 THEN 'PROMO' END AS category1,
    CASE WHEN c_nationkey < 5 THEN 'ECONOMY' END AS category2 FROM customer),
  long AS (SELECT indicator, category1 AS category FROM ind UNION SELECT indicator, category2 FROM ind),
  listed AS (SELECT DISTINCT o_custkey AS indicator, p_brand AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
  SELECT s.indicator, s.item, l.category FROM listed s JOIN long l ON l.indicator = s.indicator JOIN (SELECT DISTINCT item, category FROM items) i
    ON i.item = s.item AND i.category = l.category""")
def _(t):
    items = t.part.select(F.col("p_brand").alias("item"), F.col("p_type").alias("category")).distinct()
    ind = t.customer.select(F.col("c_custkey").alias("indicator"), F.when(F.col("c_acctbal") > 0, "PROMO").alias("category1"),
                            F.when(F.col("c_nationkey") < 5, "ECONOMY").alias("category2"))
    bought = (t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
              .select(F.col("o_custkey").alias("indicator"), F.col("p_brand").alias("item")))
    return jn.naive_pairs(bought, ind, items, "indicator", "item", ["category1", "category2"], "category")


@query("join_outer_category", """SELECT coalesce(n_nationkey, c_nationkey) AS nation, n_name, n FROM (SELECT DISTINCT n_nationkey, n_name FROM nation)
  FULL OUTER JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey""")
def _(t):
    counted = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    return jn.with_category(counted, t.nation.select(F.col("n_nationkey").alias("nation"), "n_name"), ["nation"])


@query("semi_join_pairs", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE EXISTS (
  SELECT 1 FROM lineitem a WHERE a.l_returnflag = 'R' AND a.l_partkey = l.l_partkey AND a.l_suppkey = l.l_suppkey)""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return jn.restrict(rows, t.lineitem.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"])


@query("semi_join_in", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t):
    wanted = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return jn.restrict(t.orders.select("o_orderkey", "o_custkey"), wanted, ["o_custkey"])


@query("cross_join_pairs", """WITH flows AS (SELECT DISTINCT s_nationkey AS id1, c_nationkey AS id2 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
    JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey)
  SELECT id1, id2, a.n_name AS n_name1, a.n_regionkey AS n_regionkey1, b.n_name AS n_name2, b.n_regionkey AS n_regionkey2
  FROM flows JOIN nation a ON a.n_nationkey = id1 JOIN nation b ON b.n_nationkey = id2""")
def _(t):
    flows = (t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
             .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
             .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
             .select(F.col("s_nationkey").alias("id1"), F.col("c_nationkey").alias("id2")))
    return jn.ordered_pairs(t.nation, flows, "n_nationkey", "id1", "id2")


@query("cross_join_filtered", """SELECT DISTINCT l_suppkey AS item, l_partkey AS indicator, s_name, p_name, p_type,
  s_name || ' on ' || p_name || CASE WHEN p_type = 'PROMO' THEN ' (promo)' ELSE '' END AS label
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey""")
def _(t):
    allowed = t.lineitem.select(F.col("l_suppkey").alias("item"), F.col("l_partkey").alias("indicator"))
    items = t.supplier.select(F.col("s_suppkey").alias("item"), "s_name")
    indicators = t.part.select(F.col("p_partkey").alias("indicator"), "p_name", "p_type")
    label = F.concat("s_name", F.lit(" on "), "p_name", F.when(F.col("p_type") == "PROMO", " (promo)").otherwise(""))
    return jn.candidates(allowed, items, indicators, "item", "indicator", label)


_PROG = "prog AS (SELECT s_suppkey AS program, CASE WHEN s_acctbal > 5000 THEN 'Brand#' || CAST(s_nationkey + 1 AS VARCHAR) ELSE 'size ' || CAST(s_nationkey + 20 AS VARCHAR) END AS category FROM supplier)"


def _prog(t):
    return t.supplier.select(F.col("s_suppkey").alias("program"), F.when(
        F.col("s_acctbal") > 5000, F.concat(F.lit("Brand#"), (F.col("s_nationkey") + 1).cast("string"))).otherwise(
        F.concat(F.lit("size "), (F.col("s_nationkey") + 20).cast("string"))).alias("category"))


@query("any_of_match_join", f"""WITH {fx.NODES}, {_PROG} SELECT DISTINCT node, program FROM (SELECT DISTINCT l_partkey AS node, l_suppkey AS program FROM lineitem) JOIN nodes USING (node) JOIN prog USING (program)
  WHERE category = c1 OR category = c2 OR category = c3""")
def _(t):
    listed = t.lineitem.select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("program"))
    return jn.match_any(listed, fx.nodes(t), "node", ["c1", "c2", "c3"], _prog(t), "program", "category")


# ---- name resolution and item lists ----------------------------------------

# every name is shared by two neighbouring numbers
_NAMED = """items AS (SELECT s_suppkey AS idx, 'item ' || CAST(s_suppkey // 2 AS VARCHAR) AS name FROM supplier),
  inds AS (SELECT p_partkey AS idx, 'indicator ' || CAST(p_partkey // 2 AS VARCHAR) AS name FROM part),
  preds AS (SELECT 'item ' || CAST(l_suppkey // 2 AS VARCHAR) AS budget_item, 'indicator ' || CAST(l_partkey // 2 AS VARCHAR) AS indicator,
    max(l_discount * 10) AS yes FROM lineitem GROUP BY 1, 2)"""


def _shared(kind, key):
    return F.concat(F.lit(f"{kind} "), F.expr(f"CAST({key} DIV 2 AS STRING)"))


def item_index(t):
    return t.supplier.select(F.col("s_suppkey").alias("idx"), _shared("item", "s_suppkey").alias("name"))


def indicator_index(t):
    return t.part.select(F.col("p_partkey").alias("idx"), _shared("indicator", "p_partkey").alias("name"))


def default_items(t):
    return t.part.select(F.col("p_partkey").alias("indicator_idx"), F.col("p_size").cast("bigint").alias("item_idx"))


def predicted(t):
    return t.lineitem.groupBy(_shared("item", "l_suppkey").alias("budget_item"),
                              _shared("indicator", "l_partkey").alias("indicator")).agg(
        F.max(F.col("l_discount") * 10).alias("yes"))


@query("name_index_fanout", f"""WITH {_NAMED} SELECT budget_item, indicator, yes, i.idx AS item_idx, d.idx AS indicator_idx
  FROM preds JOIN items i ON i.name = budget_item JOIN inds d ON d.name = indicator""")
def _(t):
    return jn.resolve(predicted(t), item_index(t), indicator_index(t))


@query("fallback_fill", """WITH r AS (SELECT DISTINCT l_partkey AS indicator, l_suppkey AS program FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'),
  d AS (SELECT p_partkey AS indicator, p_size AS program FROM part)
  SELECT indicator, program FROM r UNION ALL SELECT indicator, program FROM d WHERE indicator NOT IN (SELECT indicator FROM r)""")
def _(t):
    rows = t.lineitem.where("l_returnflag = 'R' AND l_linestatus = 'F'").select(F.col("l_partkey").alias("indicator"), F.col("l_suppkey").alias("program")).distinct()
    default = t.part.select(F.col("p_partkey").alias("indicator"), F.col("p_size").cast("bigint").alias("program"))
    return jn.with_default(rows, default, "indicator")


def _outcome(t):
    return t.part.select(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("item"),
                         F.col("p_partkey").alias("indicator"))


_LISTS = f"""{SPEND}, l AS (SELECT item, list(DISTINCT name ORDER BY name) AS names FROM spend GROUP BY 1),
  f AS (SELECT item, names, list_filter(names, lambda x: contains(x, 'Total ')) AS totals,
    list_filter(names, lambda x: NOT contains(x, 'Total ')) AS others FROM l)"""
_OUT = "o AS (SELECT p_brand || ' ' || CAST(p_size AS VARCHAR) AS item, p_partkey AS indicator FROM part)"


@query("one_to_many_rename", f"""WITH {_LISTS}, {_OUT}, e AS (SELECT item, unnest(CASE WHEN len(names) > 1 AND len(totals) > 0 THEN list_concat(
    [totals[1] || ' (excluding ' || array_to_string(others, ', ') || ')'], others) ELSE names END) AS fine FROM f)
  SELECT o.item AS item_original, indicator, fine AS item FROM o JOIN e ON e.item = o.item""")
def _(t):
    return jn.expand_items(_outcome(t), ag.fine_names(fx.spend(t), "item", "name"), "item", "names")


@query("map_rename", f"""WITH {_LISTS}, {_OUT}, e AS (SELECT item, CASE WHEN len(names) = 1 THEN replace(names[1], 'Total ', '')
    WHEN len(totals) > 0 THEN replace(totals[1], 'Total ', '') ELSE array_to_string(names, ' & ') END AS broad FROM f)
  SELECT o.item AS item_original, indicator, broad AS item FROM o LEFT JOIN e ON e.item = o.item""")
def _(t):
    return jn.rename_items(_outcome(t), ag.broad_names(fx.spend(t), "item", "name"), "item", "name")


@query("scatter_align", f"WITH {ENSEMBLE} SELECT pair, member, CASE WHEN yes >= 0.5 THEN {sql_rnd('yes * 2 - 1', 6)} END AS strength FROM ens")
def _(t):
    full = fx.ensemble(t).select("pair", "member", "yes")
    part = nw.edge_threshold(full, F.col("yes")).select("pair", "member", rnd(F.col("yes") * 2 - 1, 6).alias("strength"))
    return jn.align(full.drop("yes"), part, ["pair", "member"])


# ---- set operations ---------------------------------------------------------

@query("union_fill", """SELECT c_custkey AS id, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment, NULL AS nation FROM customer
  UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, s_nationkey FROM supplier""")
def _(t):
    customers = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                  F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    suppliers = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                                  F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nation"))
    return mx.union_fill([customers, suppliers])


@query("distinct_rows", "SELECT DISTINCT l_partkey, l_returnflag, l_linestatus FROM lineitem")
def _(t):
    return t.lineitem.select("l_partkey", "l_returnflag", "l_linestatus").distinct()


@query("distinct_keep_first", """SELECT text, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS r FROM documents) WHERE r = 1""")
def _(t):
    return rk.keep_first(t.documents.select("text", "doc_id", "source"), ["text"], [F.col("source"), F.col("doc_id")])


@query("interleave_sources", f"""WITH src AS (SELECT 0 AS source_no, doc_id AS id, text FROM documents UNION ALL
    SELECT 1, conv_id * 1000 + turn, text FROM conversations),
  n AS (SELECT source_no, count(*) AS n FROM src GROUP BY 1),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY {sql_hash(7, 'id')}, id) - 1 AS j FROM src),
  steps AS (SELECT i AS step, CASE WHEN {sql_unit(sql_hash(7, 'i'))} / 4294967296.0 < 0.5 THEN 0 ELSE 1 END AS source_no
    FROM range((SELECT CAST(sum(n) AS BIGINT) + 1 FROM n)) r(i)),
  drawn AS (SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY step) - 1 AS j FROM steps),
  stop AS (SELECT min(step) AS stop FROM drawn d JOIN n ON n.source_no = d.source_no WHERE j = n.n - 1)
  SELECT step, d.source_no, id, text FROM drawn d JOIN ranked k ON k.source_no = d.source_no AND k.j = d.j, stop WHERE step <= stop""")
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    turns = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return mx.interleave([docs, turns], [0.5, 0.5], ["id"], 7)


@query("concat_capped", f"""WITH src AS (SELECT 0 AS source_no, doc_id AS id FROM documents UNION ALL SELECT 1, page_id FROM pages)
  SELECT source_no, id FROM (SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY {sql_hash(11, 'id')}, id) AS r FROM src) WHERE r <= 150""")
def _(t):
    return mx.concat_capped([t.documents.select(F.col("doc_id").alias("id")), t.pages.select(F.col("page_id").alias("id"))],
                            300, ["id"], 11)


# ---- networks ---------------------------------------------------------------

@query("edge_threshold", f"WITH {ENSEMBLE} SELECT pair, member, yes FROM ens WHERE yes >= 0.5")
def _(t):
    return nw.edge_threshold(fx.ensemble(t).select("pair", "member", "yes"), F.col("yes"))


@query("b2i_network", f"""WITH {_NAMED}, k AS (SELECT DISTINCT d.idx AS indicator_idx, i.idx AS item_idx FROM preds JOIN items i ON i.name = budget_item
    JOIN inds d ON d.name = indicator WHERE yes >= 0.5)
  SELECT * FROM k UNION ALL SELECT p_partkey, p_size FROM part WHERE p_partkey NOT IN (SELECT indicator_idx FROM k)""")
def _(t):
    return nw.b2i_network(predicted(t), item_index(t), indicator_index(t), default_items(t), F.col("yes"))


_I2I_ROWS = """raw AS (SELECT 'indicator ' || CAST(l_partkey // 2 AS VARCHAR) AS indicator1, 'indicator ' || CAST(l_suppkey // 2 AS VARCHAR) AS indicator2,
    l_discount * 10 AS w, l_tax * 10 AS p, l_orderkey * 10 + l_linenumber AS row_no, l_extendedprice FROM lineitem),
  names AS (SELECT 'indicator ' || CAST(p_partkey // 2 AS VARCHAR) AS name, max(p_partkey) AS idx FROM part GROUP BY 1)"""


def indicator_links(t):
    p = F.col("l_tax") * 10
    return t.lineitem.select(
        _shared("indicator", "l_partkey").alias("indicator1"), _shared("indicator", "l_suppkey").alias("indicator2"),
        F.create_map(F.lit("mean"), F.col("l_discount") * 50, F.lit("scaled_mean"), F.col("l_discount") * 10).alias("weight"),
        F.array(F.create_map(F.lit("1"), p, F.lit("2"), 1 - p)).alias("distribution"),
        F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a"), F.col("l_extendedprice").alias("b")).alias("row_no"))


def _i2i_sql(condition: str) -> str:
    return f"""WITH {_I2I_ROWS} SELECT x.idx AS src, y.idx AS dst, {sql_rnd('arg_max(w, row(row_no, l_extendedprice))', 6)} AS weight
  FROM raw JOIN names x ON x.name = indicator1 JOIN names y ON y.name = indicator2 WHERE w <> 0 {condition} GROUP BY 1, 2"""


_CERTAIN = "AND (1 + (CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END + CASE WHEN p < 1 THEN (1 - p) * ln(1 - p) ELSE 0 END) / ln(2)) >= 0.2"


@query("i2i_network", _i2i_sql(_CERTAIN))
def _(t):
    return nw.i2i_network(indicator_links(t), indicator_index(t), "distribution", 0.2).withColumn("weight", rnd(F.col("weight"), 6))


@query("i2i_network_digit", _i2i_sql("AND w >= 0.45"))
def _(t):
    return nw.i2i_network(indicator_links(t), indicator_index(t), "digit", 0.45).withColumn("weight", rnd(F.col("weight"), 6))


@query("i2i_network_entropy", _i2i_sql(""))
def _(t):
    return nw.i2i_network(indicator_links(t), indicator_index(t), "entropy").withColumn("weight", rnd(F.col("weight"), 6))


@query("i2i_network_edge_list", f"WITH {EDGES} SELECT src, dst, weight FROM edges WHERE weight >= 10")
def _(t):
    listed = fx.edges(t).withColumn("row_no", F.col("src"))
    return nw.i2i_network(listed, fx.nodes(t), "edge_list", 10.0)


_RELATION = "rel AS (SELECT DISTINCT l_suppkey AS program, l_partkey AS indicator FROM lineitem), shares AS (SELECT p_partkey AS indicator, CAST(p_size AS DOUBLE) AS share FROM part), budget AS (SELECT s_suppkey AS program, s_acctbal AS amount FROM supplier)"


def _relation(t):
    return t.lineitem.select(F.col("l_suppkey").alias("program"), F.col("l_partkey").alias("indicator")).distinct()


def _allocated(t, power):
    shares = t.part.select(F.col("p_partkey").alias("indicator"), F.col("p_size").cast("double").alias("share"))
    budget = t.supplier.select(F.col("s_suppkey").alias("program"), F.col("s_acctbal").alias("amount"))
    return nw.allocate(budget, _relation(t), shares, power).select("indicator", rnd(F.col("amount"), 6).alias("amount"))


def _allocate_sql(weight):
    return f"""WITH {_RELATION}, w AS (SELECT r.program, r.indicator, {weight} AS w, sum({weight}) OVER (PARTITION BY r.program) AS t
    FROM rel r JOIN shares s ON s.indicator = r.indicator)
  SELECT indicator, {sql_rnd('sum(w * (amount / t))', 6)} AS amount FROM w JOIN budget b ON b.program = w.program GROUP BY 1"""


@query("proportional_allocation", _allocate_sql("share"))
def _(t):
    return _allocated(t, 1.0)


@query("modulated_allocation", _allocate_sql("pow(share, 1.5)"))
def _(t):
    return _allocated(t, 1.5)


@query("neighbour_sum", f"""WITH {EDGES} SELECT p_partkey AS node, CASE WHEN p_size > 25 THEN 1 ELSE 0 END * coalesce(w, 0) AS spillover FROM part
  LEFT JOIN (SELECT src, sum(weight) AS w FROM edges WHERE src <> dst GROUP BY 1) ON src = p_partkey""")
def _(t):
    state = t.part.select(F.col("p_partkey").alias("node"), (F.col("p_size") > 25).cast("int").alias("grew"))
    return nw.spillover(fx.edges(t), state)


@query("invert_relation", "SELECT DISTINCT l_suppkey AS program, l_orderkey AS indicator FROM lineitem")
def _(t):
    lists = t.lineitem.groupBy(F.col("l_orderkey").alias("indicator")).agg(F.collect_set("l_suppkey").alias("programs"))
    return nw.invert(lists, "indicator", "programs", "program")


@query("relation_checks", """WITH s AS (SELECT s_suppkey AS program FROM supplier WHERE s_acctbal > 0),
  r AS (SELECT o_orderkey, l_suppkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)
  SELECT 'empty' AS problem, CAST(o_orderkey AS VARCHAR) AS id FROM r GROUP BY o_orderkey HAVING count(l_suppkey) = 0
  UNION ALL SELECT DISTINCT 'no schedule', CAST(l_suppkey AS VARCHAR) FROM r WHERE l_suppkey IS NOT NULL AND l_suppkey NOT IN (SELECT program FROM s)""")
def _(t):
    lines = t.orders.select("o_orderkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"), "o_orderkey", "left")
    relation = lines.groupBy(F.col("o_orderkey").alias("indicator")).agg(F.collect_set("l_suppkey").alias("programs"))
    schedule = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("program"))
    return nw.relation_checks(relation, schedule, "indicator", "programs")


_RUNS = "runs AS (SELECT l_linenumber AS run, l_suppkey AS series, CAST(year(l_shipdate) AS INTEGER) AS t, l_quantity AS value, l_discount * 10 AS rate FROM lineitem)"


def _runs(t):
    return t.lineitem.select(F.col("l_linenumber").alias("run"), F.col("l_suppkey").alias("series"), F.year("l_shipdate").alias("t"),
                             F.col("l_quantity").alias("value"), (F.col("l_discount") * 10).alias("rate"))


@query("mc_mean", f"WITH {_RUNS} SELECT series, t, {sql_rnd('avg(value)', 6)} AS mean FROM runs GROUP BY 1, 2")
def _(t):
    return nw.mc_mean(_runs(t), ["series"], "t", "value").withColumn("mean", rnd(F.col("mean"), 6))


_MC = f"{_RUNS}, m AS (SELECT series, t, avg(value) AS v, avg(rate) AS r FROM runs GROUP BY 1, 2), est AS (SELECT series, arg_max(v, t) AS final, avg(r) AS rate FROM m GROUP BY 1)"


@query("mc_summary", f"WITH {_MC} SELECT series, {sql_rnd('final', 6)} AS final, {sql_rnd('rate', 6)} AS rate FROM est")
def _(t):
    out = nw.mc_summary(_runs(t), ["series"], "t", "value", "rate")
    return out.select("series", rnd(F.col("final"), 6).alias("final"), rnd(F.col("rate"), 6).alias("rate"))


_GOF = f"""{_MC}, gof AS (SELECT series, s_nationkey + 20.0 - final AS ev, 0.5 - rate AS er,
    1 - abs(s_nationkey + 20.0 - final) / nullif(abs(s_nationkey + 20.0 - 10.0), 0) AS fv, 1 - abs(0.5 - rate) / 0.5 AS fr
    FROM est JOIN supplier ON s_suppkey = series)"""


def _fits(t):
    target = t.supplier.select(F.col("s_suppkey").alias("series"), F.lit(10.0).alias("start"),
                               (F.col("s_nationkey") + 20.0).alias("goal"), F.lit(0.5).alias("goal_rate"))
    return nw.goodness_of_fit(nw.mc_summary(_runs(t), ["series"], "t", "value", "rate"), target, "series")


@query("goodness_of_fit", f"""WITH {_GOF} SELECT series, {sql_rnd('ev', 6)} AS error_value, {sql_rnd('er', 6)} AS error_rate,
  {sql_rnd('fv', 6)} AS fit_value, {sql_rnd('fr', 6)} AS fit_rate FROM gof""")
def _(t):
    return _fits(t).select("series", *[rnd(F.col(c), 6).alias(c) for c in ("error_value", "error_rate", "fit_value", "fit_rate")])


@query("goodness_of_fit_worst", f"WITH {_GOF} SELECT {sql_rnd('least(min(fv), min(fr))', 6)} AS worst FROM gof")
def _(t):
    return nw.worst_fit(_fits(t)).select(rnd(F.col("worst"), 6).alias("worst"))
