"""Queries that run a whole flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions import answers as an
from panelweave.operators.scale import spread
from panelweave.plans import fixtures as fx
from panelweave.plans import flows
from panelweave.plans import graph_queries as gq
from panelweave.plans.fixtures import PAIRS, PANEL, PROGRAMS, SPEND, TRAIN_END, YEARS
from panelweave.plans.pair_queries import TEMPLATES, all_templates_sql, negatives_sql
from panelweave.plans.panel_queries import customer_categories
from panelweave.plans.registry import ORACLE, query, rnd, sql_hash, sql_rnd, sql_unit, text_tasks
from panelweave.plans.text_queries import BEGIN, CHUNKS, END, PAD, language_sql, merges, profiles, span_sql, subword_sql

_ANSWER = "CASE max(l_returnflag) WHEN 'A' THEN 'Yes, it does' WHEN 'N' THEN 'I do not know' ELSE 'Hard to tell' END"
_LABEL = "CASE WHEN contains(lower(answer), 'yes') THEN 'Yes' WHEN contains(lower(answer), 'no') THEN 'No' ELSE 'NA' END"


@query("prediction_table", f"""WITH {PAIRS}, asked AS ({all_templates_sql('row_id')}),
  replies AS (SELECT l_partkey AS row_id, l_linenumber % 3 AS member, {_ANSWER} AS answer FROM lineitem GROUP BY 1, 2),
  parsed AS (SELECT a.row_id, a.member, prompt, {_LABEL} AS label FROM asked a JOIN replies r ON r.row_id = a.row_id AND r.member = a.member),
  agg AS (SELECT row_id, {sql_rnd("avg(CASE WHEN label = 'Yes' THEN 1 ELSE 0 END)", 3)} AS "Yes", {sql_rnd("avg(CASE WHEN label = 'No' THEN 1 ELSE 0 END)", 3)} AS "No",
    {sql_rnd("avg(CASE WHEN label = 'NA' THEN 1 ELSE 0 END)", 3)} AS "NA", string_agg(prompt, ' | ' ORDER BY member) AS prompts,
    string_agg(label, ' | ' ORDER BY member) AS predictions FROM parsed GROUP BY 1)
  SELECT p.row_id, budget_item, indicator, related, "Yes", "No", "NA", prompts, predictions FROM pairs p JOIN agg ON agg.row_id = p.row_id""")
def _(t):
    replies = t.lineitem.groupBy(F.col("l_partkey").alias("row_id"), (F.col("l_linenumber") % 3).alias("member")).agg(
        F.expr(_ANSWER).alias("answer"))
    out = flows.prediction_table(fx.pairs(t), ["row_id"], ["budget_item", "indicator"], TEMPLATES, replies)
    return out.withColumn("prompts", F.array_join("prompts", " | ")).withColumn("predictions", F.array_join("predictions", " | "))


def _joined(name):
    return F.array_join(F.transform(name, lambda x: x.cast("string")), " ").alias(name)


_CHUNK_TEXT = "trim(array_to_string(ws[chunk_no * 107 + 1 : chunk_no * 107 + 196], ' '), ' ')"


@query("corpus_rows", f"""WITH RECURSIVE {CHUNKS}, ch AS (SELECT doc_id, paragraph_no, chunk_no, {_CHUNK_TEXT} AS text FROM c WHERE len(ws) >= 98),
  {language_sql('ch', 'doc_id, paragraph_no, chunk_no')},
  kept AS (SELECT ch.*, language FROM ch JOIN spoken USING (doc_id, paragraph_no, chunk_no) WHERE language IN ('en', 'fr')),
  {subword_sql('kept', 'doc_id, paragraph_no, chunk_no')}
  SELECT k.doc_id, CAST(k.paragraph_no AS INTEGER) AS paragraph_no, CAST(k.chunk_no AS INTEGER) AS chunk_no, language,
    CASE WHEN {sql_unit(sql_hash(10, 'k.doc_id'))} / 4294967296.0 < 0.8 THEN 'train' ELSE 'test' END AS split,
    array_to_string(list_resize(list_concat(list_concat([{BEGIN}], ids[1:126]), [{END}]), 128, {PAD}), ' ') AS input_ids, CAST(least(len(ids), 126) + 2 AS INTEGER) AS used,
    array_to_string(list_resize(list_concat(list_concat([{BEGIN}], ids[1:126]), [{END}]), 128, -100), ' ') AS labels
  FROM kept k JOIN enc i ON i.doc_id = k.doc_id AND i.paragraph_no = k.paragraph_no AND i.chunk_no = k.chunk_no""")
def _(t):
    rows = flows.corpus_rows(t.documents, "doc_id", "text", ["en", "fr"], profiles(t), merges(t), length=128, tasks=text_tasks(t.spark))
    return rows.select("doc_id", "paragraph_no", "chunk_no", "language", "split",
                       _joined("input_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("used"), _joined("labels"))


_LAYOUT = "Ask: {user} Answer: {response}"


@query("instruct_rows", f"""WITH RECURSIVE x AS (SELECT conv_id || '-' || turn AS id, trim(regexp_replace('Ask: ' || role || ' ' || turn || ' Answer: ' || coalesce(text, ''), '\\s+', ' ', 'g')) AS text,
    trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS answer FROM conversations),
  {subword_sql('x', 'id')}, g AS (SELECT id, list_concat(ids[1:63], [{END}]) AS f, begins[1:63] AS begins, ends[1:63] AS ends FROM enc),
  q AS (SELECT g.*, instr(text, answer) - 1 AS s, instr(text, answer) - 1 + length(answer) AS e FROM g JOIN x ON x.id = g.id),
  p AS (SELECT *, {span_sql('begins')} FROM q)
  SELECT id, CASE WHEN {sql_unit(sql_hash(10, 'id'))} / 4294967296.0 < 0.8 THEN 'train' ELSE 'test' END AS split, array_to_string(list_resize(f, 64, {PAD}), ' ') AS input_ids,
    CAST(len(f) AS INTEGER) AS used, array_to_string(list_resize(list_transform(f, lambda v, i: CASE WHEN first > 0 AND i >= first AND (last = 0 OR i <= last + 1) THEN v ELSE -100 END), 64, -100), ' ') AS labels FROM p""")
def _(t):
    rows = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat_ws(" ", "role", "turn").alias("ask"), "text")
    out = flows.instruct_rows(spread(rows, "id", text_tasks(t.spark)), "id", "ask", "text", _LAYOUT, merges(t), length=64)
    return out.select("id", "split", _joined("input_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("used"), _joined("labels"))


_SCALE = "CASE WHEN TRY_CAST(regexp_extract(answer, '[0-9]', 0) AS INTEGER) <= 5 THEN TRY_CAST(regexp_extract(answer, '[0-9]', 0) AS INTEGER) END"
_OPTIONS, _OPTION_LABELS = {"1": "Agree", "2": "Deny"}, {"1": "Yes", "2": "No"}
_CATEGORY = """CASE WHEN lower(answer) LIKE '1%' THEN 'Yes' WHEN lower(answer) LIKE '2%' THEN 'No' WHEN contains(lower(answer), 'agree') THEN 'Yes'
    WHEN contains(lower(answer), 'deny') THEN 'No' WHEN contains(lower(answer), '1') THEN 'Yes' WHEN contains(lower(answer), '2') THEN 'No' ELSE 'NA' END"""
_REPLY = "concat(max(l_linenumber), CASE WHEN max(l_discount) > 0.05 THEN ', I agree' ELSE ' of 7' END)"


def _replies(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("row_id"), (F.col("l_linenumber") % 3).alias("member")).agg(F.expr(_REPLY).alias("answer"))


def _replied_sql(label: str) -> str:
    return f"""{PAIRS}, asked AS ({all_templates_sql('row_id')}),
  replies AS (SELECT l_partkey AS row_id, l_linenumber % 3 AS member, {_REPLY} AS answer FROM lineitem GROUP BY 1, 2),
  parsed AS (SELECT a.row_id, a.member, prompt, {label} AS label FROM asked a JOIN replies r ON r.row_id = a.row_id AND r.member = a.member)"""


def _flat(out):
    return out.withColumn("prompts", F.array_join("prompts", " | ")).withColumn(
        "predictions", F.array_join(F.transform("predictions", lambda p: F.coalesce(p.cast("string"), F.lit("-"))), " | "))


@query("prediction_table_scale", f"""WITH {_replied_sql(_SCALE)}, agg AS (SELECT row_id, {sql_rnd('coalesce(avg(label), 0)', 3)} AS mean, {sql_rnd('coalesce(avg(label), 0) / 5', 3)} AS scaled_mean,
    string_agg(prompt, ' | ' ORDER BY member) AS prompts, string_agg(coalesce(CAST(label AS VARCHAR), '-'), ' | ' ORDER BY member) AS predictions FROM parsed GROUP BY 1)
  SELECT p.row_id, budget_item, indicator, related, mean, scaled_mean, prompts, predictions FROM pairs p JOIN agg ON agg.row_id = p.row_id""")
def _(t):
    return _flat(flows.prediction_table(fx.pairs(t), ["row_id"], ["budget_item", "indicator"], TEMPLATES, _replies(t),
                                        parse=lambda c: an.parse_scale_digit(c, 5), aggregate="scale"))


@query("prediction_table_category", f"""WITH {_replied_sql(_CATEGORY)}, c AS (SELECT row_id, label, count(*) AS n, min(member) AS m FROM parsed GROUP BY 1, 2),
  top AS (SELECT row_id, label AS mode FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, m) AS r FROM c) WHERE r = 1),
  agg AS (SELECT row_id, string_agg(prompt, ' | ' ORDER BY member) AS prompts, string_agg(label, ' | ' ORDER BY member) AS predictions FROM parsed GROUP BY 1)
  SELECT p.row_id, budget_item, indicator, related, mode, prompts, predictions FROM pairs p JOIN agg ON agg.row_id = p.row_id JOIN top ON top.row_id = p.row_id""")
def _(t):
    return _flat(flows.prediction_table(fx.pairs(t), ["row_id"], ["budget_item", "indicator"], TEMPLATES, _replies(t),
                                        parse=lambda c: an.parse_category(c, _OPTIONS, _OPTION_LABELS), aggregate="mode"))


_BROAD = f"""{SPEND}, l AS (SELECT item, list(DISTINCT name ORDER BY name) AS names FROM spend GROUP BY 1),
  f AS (SELECT item, names, list_filter(names, lambda x: contains(x, 'Total ')) AS totals FROM l),
  b AS (SELECT item, CASE WHEN len(names) = 1 THEN replace(names[1], 'Total ', '') WHEN len(totals) > 0 THEN replace(totals[1], 'Total ', '')
    ELSE array_to_string(names, ' & ') END AS name FROM f),
  pairs AS (SELECT DISTINCT b.name AS budget_item, trim(regexp_replace('Spend: ' || p_name || ' ' || p_partkey, '^Spend: ', '')) AS indicator
    FROM part JOIN b ON b.item = p_brand || ' ' || CAST(p_size AS VARCHAR))"""


@query("pair_dataset", f"""WITH {negatives_sql(_BROAD, 9, ['indicator'])},
  both_labels AS (SELECT budget_item, indicator, 'Yes' AS related FROM pairs UNION ALL
    SELECT item, indicator, 'No' FROM draws d JOIN placed p ON p.pos = d.pos),
  r AS (SELECT *, row_number() OVER (PARTITION BY budget_item, related ORDER BY {sql_hash(9, 'indicator')}, indicator) - 1 AS r,
    count(*) OVER (PARTITION BY budget_item, related) AS n FROM both_labels)
  SELECT budget_item, indicator, related, CASE WHEN r < floor(n * 0.2 + 0.5) THEN 'train' ELSE 'test' END AS split FROM r WHERE n >= 2""")
def _(t):
    outcome = t.part.select(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("item"),
                            F.concat(F.lit("Spend: "), "p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("indicator"))
    return flows.pair_dataset(outcome, fx.spend(t), "item", "name", "indicator", ["^Spend: "], 9).withColumnRenamed("item", "budget_item")


@query("calibration_inputs", f"""WITH {PANEL}, w AS (SELECT * FROM panel WHERE series IN (SELECT series FROM panel GROUP BY 1 HAVING count(*) >= 5)),
  g AS (SELECT s.series, CAST(y AS INTEGER) AS year, w.value FROM (SELECT DISTINCT series FROM w) s CROSS JOIN range({YEARS[0]}, {YEARS[-1] + 1}) r(y)
    LEFT JOIN w ON w.series = s.series AND w.year = y),
  n AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN year END) OVER (PARTITION BY series ORDER BY year) AS ly,
    min(CASE WHEN value IS NOT NULL THEN year END) OVER (PARTITION BY series ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ry FROM g),
  f AS (SELECT n.series, n.year, coalesce(n.value, l.value + (r.value - l.value) * ((n.year - ly) / (ry - ly)), l.value, r.value) AS value
    FROM n LEFT JOIN w l ON l.series = n.series AND l.year = ly LEFT JOIN w r ON r.series = n.series AND r.year = ry),
  b AS (SELECT series, min(CASE WHEN year <= {TRAIN_END} THEN value END) AS lo, max(CASE WHEN year <= {TRAIN_END} THEN value END) AS hi,
    max(CASE WHEN year = {YEARS[0]} THEN value END) AS v0, max(CASE WHEN year = {YEARS[-1]} THEN value END) AS v1 FROM f GROUP BY 1),
  cat AS (SELECT c_custkey AS series, c_mktsegment AS category1, 'nation ' || CAST(c_nationkey AS VARCHAR) AS category2,
    CASE WHEN c_acctbal > 5000 THEN 'rich' END AS category3 FROM customer),
  rises AS (SELECT series, sum(CASE WHEN year <= {TRAIN_END} AND value > prev THEN 1 ELSE 0 END) AS rises FROM
    (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY year) AS prev FROM f) GROUP BY 1),
  long AS (SELECT rises, unnest([category1, category2, category3]) AS category FROM rises r JOIN cat ON cat.series = r.series),
  rates AS (SELECT category, sum(rises) / (count(*) * 4.0) AS rate FROM long WHERE category IS NOT NULL GROUP BY 1),
  m AS (SELECT cat.series, (coalesce(x.rate, 0) + coalesce(y.rate, 0) + coalesce(z.rate, 0)) / ((x.rate IS NOT NULL)::INT + (y.rate IS NOT NULL)::INT + (z.rate IS NOT NULL)::INT) AS rate
    FROM cat LEFT JOIN rates x ON category1 = x.category LEFT JOIN rates y ON category2 = y.category LEFT JOIN rates z ON category3 = z.category)
  SELECT b.series, {sql_rnd('(v0 - lo) / nullif(hi - lo, 0)')} AS start, {sql_rnd('(v1 - lo) / nullif(hi - lo, 0)')} AS final,
    {sql_rnd('CASE WHEN rate <= 0 THEN 0.05 WHEN rate >= 1 THEN 0.95 ELSE rate END', 6)} AS success_rate FROM b JOIN m ON m.series = b.series""")
def _(t):
    out = flows.calibration_inputs(fx.panel(t), customer_categories(t), "series", "year", "value", YEARS, TRAIN_END,
                                   ["category1", "category2", "category3"])
    return out.select("series", rnd(F.col("start")).alias("start"), rnd(F.col("final")).alias("final"),
                      rnd(F.col("success_rate"), 6).alias("success_rate"))


@query("calibration_schedule", f"""WITH {PROGRAMS}, cpi AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS cpi FROM orders GROUP BY 1),
  people AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS population FROM lineitem GROUP BY 1),
  p AS (SELECT program, g.year, CAST(g.year AS DOUBLE) AS x, amount * ((SELECT cpi FROM cpi WHERE year = 1996) / cpi) / population AS value
    FROM programs g JOIN cpi ON cpi.year = g.year JOIN people ON people.year = g.year),
  f AS (SELECT program, count(*) AS n, avg(x) AS mx, avg(value) AS my FROM p WHERE year <= {TRAIN_END} GROUP BY 1),
  s AS (SELECT p.program, any_value(n) AS n, any_value(mx) AS mx, sum((x - mx) * (value - my)) AS sxy, sum((x - mx) * (x - mx)) AS sxx
    FROM p JOIN f ON f.program = p.program WHERE year <= {TRAIN_END} GROUP BY 1),
  d AS (SELECT p.program, year, CASE WHEN year <= {TRAIN_END} AND n >= 2 THEN value - (x - mx) * sxy / sxx ELSE value END AS v FROM p LEFT JOIN s ON s.program = p.program),
  r AS (SELECT program, CAST((year - {YEARS[0]}) * 5 + i AS INTEGER) AS period, CASE WHEN year < {YEARS[-1]} THEN v / 5 ELSE v END AS amount
    FROM d, range(5) g(i) WHERE year < {YEARS[-1]} OR i = 0)
  SELECT s_suppkey AS program, period, {sql_rnd('amount', 6)} AS amount FROM supplier LEFT JOIN (SELECT * FROM r WHERE period BETWEEN 5 AND 24) r ON r.program = s_suppkey""")
def _(t):
    prices = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("cpi"))
    people = t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("population"))
    out = flows.calibration_schedule(fx.programs(t), prices, people, t.supplier.select(F.col("s_suppkey").alias("program")), "program", "year", "amount",
                                     1996, TRAIN_END, 5, YEARS[0], YEARS[-1], 1996, 1999)
    return out.withColumn("amount", rnd(F.col("amount"), 6))


@query("calibration_networks", f"""SELECT 'item' AS kind, item_idx AS src, indicator_idx AS dst, CAST(1 AS DOUBLE) AS weight FROM ({ORACLE['b2i_network']})
  UNION ALL SELECT 'indicator', src, dst, weight FROM ({ORACLE['i2i_network']})""")
def _(t):
    out = flows.calibration_networks(gq.predicted(t), gq.item_index(t), gq.indicator_index(t), gq.default_items(t), F.col("yes"),
                                     gq.indicator_links(t), "distribution", link_least=0.2)
    return out.withColumn("weight", rnd(F.col("weight"), 6))
