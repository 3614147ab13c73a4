import os
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from compare import rows
from pyspark.sql import functions as F

from panelweave.functions.numbers import clamp_rate, mean_of_present
from panelweave.operators import aggregates as ag
from panelweave.operators import panel as pn
from panelweave.operators import ranks as rk
from panelweave.operators import recode as rc
from panelweave.plans import catalog


def table(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def long(spark, series):
    rows = [(k, y, None if v is None else float(v)) for k, vs in series.items() for y, v in vs]
    return spark.createDataFrame(rows, "series string, year int, value double")


def test_pivot_raises_on_repeated_key(spark):
    df = long(spark, {"a": [(2013, 1), (2013, 2)]})
    with pytest.raises(Exception, match="more than one row"):
        rc.to_wide(df, ["series"], "year", "value", [2013]).collect()
    assert rc.to_wide(df, ["series"], "year", "value", [2013], strict=False).first()["2013"] == 2.0


def test_pivot_mean_averages_and_drops_null_ids(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 3.0), (None, 1, 9.0)], "k string, y int, v double")
    assert table(rc.to_wide_mean(df, ["k"], "y", "v", [1]), "k", "1") == [("a", 2.0)]


def test_pivots_of_null_keys(spark):
    """Keys taken from the data leave null out; a listed set does not hold it."""
    df = spark.createDataFrame([(1, "a", 2.0), (1, None, 5.0), (2, None, 7.0), (3, "b", 4.0)], "id int, key string, v double")
    for pivot in (rc.to_wide, rc.to_wide_mean):
        got = {r.id: (r.a, r.b) for r in pivot(df, ["id"], "key", "v").collect()}
        assert got == {1: (2.0, None), 2: (None, None), 3: (None, 4.0)}
        with pytest.raises(Exception, match="not among the listed"):
            pivot(df, ["id"], "key", "v", ["a", "b"]).collect()


def test_pivots_refuse_keys_without_bound(spark, monkeypatch):
    monkeypatch.setattr(rc, "MOST_KEYS", 3)
    df = spark.range(4).selectExpr("1 AS id", "concat('k', id) AS key", "id AS v")
    with pytest.raises(ValueError, match="more than 3"):
        rc.to_wide(df, ["id"], "key", "v")
    assert len(rc.to_wide(df.where("v < 3"), ["id"], "key", "v").columns) == 4


def test_lines_through_large_values(spark):
    """A slope of 0.001 on values near 1e9, and no line through one point or one period."""
    df = spark.createDataFrame([("a", t, 1e9 + 0.001 * t) for t in range(2000, 2030)] + [("b", 2000, 5.0), ("c", 2000, 1.0), ("c", 2000, 3.0), ("d", 2000, None)],
                               "series string, t int, v double").repartition(5)
    fit = {r.series: r for r in pn.line_fit(df, ["series"], F.col("t"), "v").collect()}
    assert fit["a"].slope == pytest.approx(0.001, rel=1e-4)
    assert [(fit[s].slope, fit[s].mean) for s in "bcd"] == [(None, 5.0), (None, 2.0), (None, None)]


def test_spread_numbered_raises_beyond_n(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "z")], "k string, v string")
    assert sorted((r.k, r.c1, r.c2 or "") for r in rc.spread_numbered(df, "k", "v", "c", 2).collect()) == [
        ("a", "x", "y"), ("b", "z", "")]
    with pytest.raises(Exception, match="more than 1 values"):
        rc.spread_numbered(df, "k", "v", "c", 1).collect()


def test_later_rules_win_and_null_conditions_are_false(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    rules = [(F.col("v") > 0, "positive"), (F.col("v") > 3, "large")]
    got = {r.v: r.c for r in rc.apply_rules(df, "c", rules, F.lit("none")).collect()}
    assert got == {1: "positive", 5: "large", None: "none"}
    assert rc.drop_where(df, F.col("v") > 3).count() == 2
    assert {r.v: r.f for r in rc.flag_any(df, "f", [F.col("v") > 3]).collect()} == {1: 0, 5: 1, None: 0}


def test_prefer_class(spark):
    df = spark.createDataFrame([("a", "Persons"), ("a", "Female"), ("b", "Male"), ("c", "Female"), ("c", "Male")],
                               "k string, sex string")
    assert table(rc.prefer_class(df, ["k"], "sex", ["Persons", "Female"]), "k", "sex") == [
        ("a", "Persons"), ("b", "Male"), ("c", "Female")]


def test_recode_unmatched_is_null_and_table_mapping_agrees(spark):
    df = spark.createDataFrame([("a",), ("z",)], "k string")
    pairs = spark.createDataFrame([("a", 1)], "x string, y int")
    assert {r.k: r.n for r in rc.recode(df, "k", {"a": 1}, "n").collect()} == {"a": 1, "z": None}
    assert {r.k: r.n for r in rc.recode(df, "k", pairs, "n").collect()} == {"a": 1, "z": None}


def test_dup_flag_counts_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    assert table(rk.dup_flag(df, ["k"]), "v", "is_dup") == [(1, 1), (2, 1), (3, 0)]


AGES = ["All ages", "10+ yrs", "16+ yrs"]


def test_broadest_age_prefers_order_then_override(spark):
    df = spark.createDataFrame([("s", "g", 2013, "16+ yrs"), ("s", "g", 2013, "10+ yrs"), ("s", "g", 2014, "16+ yrs"),
                                ("t", "g", 2013, "All ages"), ("t", "g", 2013, "16+ yrs")],
                               "series string, grp string, period int, age string")
    got = rk.broadest_age(df, ["series"], ["series", "grp", "period"], "age", AGES)
    flags = {(r.series, r.period, r.age): (r.is_dup_age, r.large_agegroup) for r in got.collect()}
    assert flags == {("s", 2013, "16+ yrs"): (1, 0), ("s", 2013, "10+ yrs"): (1, 1), ("s", 2014, "16+ yrs"): (0, 0),
                     ("t", 2013, "All ages"): (1, 1), ("t", 2013, "16+ yrs"): (1, 0)}
    override = F.when((F.col("series") == "t") & (F.col("age") == "16+ yrs"), -1)
    forced = rk.broadest_age(df, ["series"], ["series", "grp", "period"], "age", AGES, override)
    assert {r.age for r in forced.where("series = 't' AND large_agegroup = 1").collect()} == {"16+ yrs"}


def test_cascade_leaves_unique_keys(spark):
    rows = [("s", "old", "g", "All ages", y, 1.0) for y in (2013, 2014, 2015)]
    rows += [("s", "new", "g", "All ages", y, 2.0) for y in (2013, 2014, 2015)]
    rows += [("s", "new", "g", "16+ yrs", y, 3.0) for y in (2013, 2014, 2015)]
    df = spark.createDataFrame(rows, "series string, subgroup string, grp string, age string, period int, value double")
    vintage = F.when(F.col("subgroup") == "new", 0).otherwise(1)
    out = rk.dedup_series(df, AGES, vintage, strict=True)
    assert table(out, "period", "subgroup", "value") == [(y, "new", 2.0) for y in (2013, 2014, 2015)]


def test_cascade_query_keeps_a_repetition_that_its_rules_leave(spark, tmp_path):
    """A row that is its age's only one is both longest and latest, so no rule drops it beside a national row."""
    spark.sql("""SELECT * FROM VALUES (7L, 'N', 'F', 1, 100.0D, TIMESTAMP '1998-03-01 00:00:00'), (7L, 'A', 'F', 5, 50.0D, TIMESTAMP '1998-06-01 00:00:00'),
        (7L, 'N', 'F', 1, 10.0D, TIMESTAMP '1999-03-01 00:00:00') AS t(l_suppkey, l_returnflag, l_linestatus, l_linenumber, l_extendedprice, l_shipdate)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    ours = catalog.QUERIES["exclusion_cascade"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert len(ours) == 3
    assert rows(ours) == rows(con.sql(catalog.ORACLE["exclusion_cascade"]).df())


def test_gaps_and_adjacent_changes(spark):
    df = long(spark, {"a": [(2013, 1), (2014, 3), (2017, 2), (2018, 1)]})
    assert {r.year: (r.step, r.max_gap) for r in rk.gaps(df, ["series"], "year").collect()} == {
        2013: (None, 2), 2014: (1, 2), 2017: (3, 2), 2018: (1, 2)}
    assert {r.year: r.change for r in rk.diff(df, ["series"], "year", "value").collect()} == {
        2013: None, 2014: 2.0, 2017: None, 2018: -1.0}
    assert rk.first_fall(df, ["series"], "year", "value", 2013).first().first_fall == 5


def test_reindex_drops_ids_at_the_limit(spark):
    df = spark.createDataFrame([(1, 7), (2, 3), (3, 9), (4, 7)], "indicator int, program int")
    assert table(rk.reindex(df, "program", 9), "indicator", "new_program") == [(1, 1), (2, 0), (4, 1)]


def test_large_top_n_uses_the_range_order(spark):
    df = spark.range(5000).select(F.lit("k").alias("k"), "id")
    out = rk.top_n(df, ["k"], ["id"], 1500)
    assert out.agg(F.max("id"), F.max("position"), F.count("id")).first()[:] == (1499, 1500, 1500)


def test_page_stitch(spark):
    brk = "\n\n\f"
    df = spark.createDataFrame([(1, 0, "First part" + brk), (1, 1, "goes on." + brk), (1, 2, "next, lower" + brk),
                                (1, 3, "References" + brk), (1, 4, "tail")], "doc int, page int, text string")
    got = [r.text for r in rk.stitch_pages(df, "doc", "page", "text", "References").orderBy("page").collect()]
    assert got == ["First part ", "goes on." + brk, "next, lower" + brk]


def test_stitched_text_is_one_row_per_document(spark):
    brk = "\n\n\f"
    df = spark.createDataFrame([(1, 0, "First part" + brk), (1, 1, "goes on." + brk), (1, 2, "References" + brk), (2, 0, "Two")],
                               "doc int, page int, text string")
    assert table(rk.stitched_text(df, "doc", "page", "text", "References"), "doc", "text") == [(1, "First part goes on." + brk), (2, "Two")]


def test_detrend_keeps_series_without_a_line(spark):
    df = long(spark, {"one": [(2017, 3.0), (2018, 5.0)], "late": [(2018, 7.0)]})
    got = pn.detrend(df, "series", "year", "value", 2017)
    assert sorted((r.series, r.year, r.detrended) for r in got.collect()) == [("late", 2018, 7.0), ("one", 2017, 3.0), ("one", 2018, 5.0)]


def test_pivots_raise_on_unlisted_keys_and_find_their_own(spark):
    df = spark.createDataFrame([(1, 2001, 1.0), (1, 2003, 2.0), (2, 2003, 3.0)], "series int, year int, value double")
    for pivot in (rc.to_wide, rc.to_wide_mean):
        with pytest.raises(Exception, match="not among"):
            pivot(df, ["series"], "year", "value", [2001]).collect()
        assert table(pivot(df, ["series"], "year", "value"), "series", "2001", "2003") == [(1, 1.0, 2.0), (2, None, 3.0)]
        assert pivot(df, ["series"], "year", "value", [2001], strict=False).columns == ["series", "2001"]


def test_spread_numbered_takes_as_many_as_there_are(spark):
    df = spark.createDataFrame([("a", f"v{i}") for i in range(9)] + [("b", "x")], "k string, v string")
    assert rc.spread_numbered(df, "k", "v", "c").columns == ["k", *[f"c{i}" for i in range(1, 10)]]


def test_recode_takes_large_dictionaries(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in (0, 500, 900)], "k string")
    assert {r.k: r.n for r in rc.recode(df, "k", {f"k{i}": i for i in range(501)}, "n").collect()} == {"k0": 0, "k500": 500, "k900": None}


def test_kernels_run_where_the_package_is_not_installed(tmp_path):
    code = """
import sys; sys.path.insert(0, {root!r})
from panelweave.session import build_session
from panelweave.operators import panel as pn
spark = build_session("local[2]", 2, **{{"spark.sql.warehouse.dir": {tmp!r}}})
df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, 2.0)], "s string, t int, v double")
print("rows", pn.forecast(df, "s", "t", "v", [1, 2, 3]).count(), pn.gap_fill(df, "s", "t", "v", [1, 2, 3, 4]).count())
from panelweave.operators import subwords as sw
from panelweave.plans.text_queries import VOCABULARY
print("more", pn.gap_fill(df, "s", "t", "v", [1, 2, 3, 4], "fitted").count(), sw.with_tokens(df, "s", sw.read_merges(spark, VOCABULARY)).first().ids)
"""
    root = str(Path(__file__).resolve().parents[1])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code.format(root=root, tmp=str(tmp_path))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "rows 3 4" in run.stdout and "more 4 [64]" in run.stdout, run.stderr[-800:]


def test_detrend_keeps_the_mean_and_later_years(spark):
    values = [1.0, 2.5, 2.0, 4.0, 4.5, 9.0, 11.0]
    df = long(spark, {"a": [(2013 + i, v) for i, v in enumerate(values)]})
    got = [r.detrended for r in pn.detrend(df, "series", "year", "value", 2017).orderBy("year").collect()]
    train = np.array(values[:5])
    line = np.polyval(np.polyfit(np.arange(5), train, 1), np.arange(5))
    assert got[:5] == pytest.approx(train - line + train.mean())
    assert got[5:] == values[5:]


def test_refine_has_the_stated_length_and_keeps_totals(spark):
    df = long(spark, {"a": [(2013 + i, 7.0 * (i + 1)) for i in range(7)]})
    out = pn.refine(df, "series", "year", "value", 7, 2013, 2019)
    assert out.count() == 7 * 6 + 1
    assert out.agg(F.sum("amount")).first()[0] == pytest.approx(sum(7.0 * (i + 1) for i in range(7)))
    assert pn.refine_repeat(df, "series", "year", "value", 50, 2013, 2019).count() == 49


def test_period_slice_counts_from_the_base_year(spark):
    schedule = spark.range(10).select(F.col("id").cast("int").alias("period"))
    assert [r.period for r in pn.period_slice(schedule, 2014, 2015, 2, 2013).orderBy("period").collect()] == [2, 3, 4, 5]


def test_normalise_inverts_and_survives_flat_series(spark):
    df = spark.createDataFrame([("a", 2013, 2.0, 1, 0.0, 8.0), ("a", 2014, 6.0, 1, 0.0, 8.0), ("b", 2013, 3.0, 0, 3.0, 3.0)],
                               "k string, y int, v double, inv int, worst double, best double")
    got = {(r.k, r.y): r.scaled for r in pn.normalise(df, "k", "y", "v", 2017, ["worst"], ["best"], "inv").collect()}
    assert got == {("a", 2013): 0.75, ("a", 2014): 0.25, ("b", 2013): None}


def test_endpoints(spark):
    df = long(spark, {"up": [(2013, 1), (2014, 2), (2015, 3)], "same": [(2013, 1), (2014, 4), (2015, 1)],
                      "down": [(2013, 3), (2014, 2), (2015, 1)], "one": [(2014, 5)]})
    plain = {r.series: r.final for r in pn.endpoint(df, "series", "year", "value", 2016).collect()}
    floor = {r.series: r.final for r in pn.endpoint_floor(df, "series", "year", "value", 2016).collect()}
    assert plain == pytest.approx({"up": 3.0, "same": 2.0, "down": 1.0, "one": 5.0})
    assert floor == pytest.approx({"up": 3.0, "same": 2.0, "down": 3.0, "one": 5.0})


def brute_posterior(years, known, values):
    """Textbook Gaussian-process mean, one entry at a time."""
    def k(a, b):
        d = np.sqrt(3) * abs(a - b) / 2.0
        return 1.0 + (1 + d) * np.exp(-d)

    gram = np.array([[k(a, b) + (a == b) for b in known] for a in known])
    centre = np.mean(values)
    weights = np.linalg.inv(gram) @ (np.array(values) - centre)
    return [centre + sum(k(y, x) * w for x, w in zip(known, weights)) for y in years]


def test_kernel_gap_fill_against_brute_force(spark):
    years = list(range(2013, 2018))
    series = {"a": [(2013, 1.0), (2015, 4.0), (2016, 2.0)], "b": [(2014, 3.0)], "c": [(y, float(y)) for y in years]}
    got = {(r.series, r.year): (r.value, r.imputed) for r in pn.gap_fill(long(spark, series), "series", "year", "value", years).collect()}
    for name, points in series.items():
        fitted = dict(zip(years, brute_posterior(years, [p[0] for p in points], [p[1] for p in points])))
        for y in years:
            want = dict(points).get(y, fitted[y])
            assert got[name, y][0] == pytest.approx(want)
            assert got[name, y][1] == (y not in dict(points))


def test_linear_gap_fill_holds_the_ends(spark):
    df = long(spark, {"a": [(2014, 1.0), (2016, 3.0)]})
    got = [r.value for r in pn.gap_fill(df, "series", "year", "value", list(range(2013, 2018)), "linear").orderBy("year").collect()]
    assert got == [1.0, 1.0, 2.0, 3.0, 3.0]


def test_forecast_against_brute_force(spark):
    years = list(range(2013, 2020))
    series = {"falls": [1.0, 2.0, 4.0, 3.0, 9.0, 1.0, 1.0], "rises": [1.0, 2, 3, 4, 5, 6, 7]}
    df = long(spark, {k: list(zip(years, v)) for k, v in series.items()})
    out = pn.forecast(df, "series", "year", "value", years)
    assert {r.series for r in out.collect()} == {"falls"}
    fitted = brute_posterior(years, years[:3], series["falls"][:3])
    want = series["falls"][:3] + [max(f, v) for f, v in zip(fitted[3:], series["falls"][3:])]
    assert [r.value for r in out.orderBy("year").collect()] == pytest.approx(want)
    assert pn.forecast(df, "series", "year", "value", years, keep_rising=True).count() == 14


def test_schedules(spark):
    df = spark.createDataFrame([("p", 0, 1.0), ("p", 1, 4.0)], "program string, t int, amount double")
    assert table(pn.hold_last(df, "program", "t", "amount", 3), "t", "amount") == [(0, 4.0), (1, 4.0), (2, 4.0)]
    assert table(pn.grow(df, "t", "amount", 2), "t", "amount") == [(0, 1.0), (1, 12.0)]
    longer = spark.range(10).select(F.lit("p").alias("program"), F.col("id").cast("int").alias("t"))
    assert [r.t for r in pn.downsample(longer, "program", "t", 4).orderBy("t").collect()] == [1, 5, 9]


def test_success_rate_ignores_rises_over_a_gap(spark):
    rows = [("a", 2013, 1.0), ("a", 2014, 2.0), ("a", 2016, 9.0), ("b", 2013, 5.0), ("b", 2014, 4.0), ("b", 2015, 5.0)]
    df = spark.createDataFrame([(*r, "x", "x" if r[0] == "a" else "y") for r in rows],
                               "k string, y int, v double, c1 string, c2 string")
    got = {r.category: r.success_rate for r in ag.success_rate(df, "k", "y", "v", ["c1", "c2"]).collect()}
    assert got == {"x": pytest.approx(2 / (2 * 3)), "y": pytest.approx(1 / 3)}


def test_trim_keeps_the_edge_but_zeroes_the_weight(spark):
    df = spark.createDataFrame([(i, 0, float(i)) for i in range(1, 22)] + [(99, 0, 0.0)], "src int, dst int, weight double")
    rows = {r.src: r.weight for r in ag.edge_rows(ag.trim_edges(df)).collect()}
    assert len(rows) == 21 and rows[1] == 0.0 and rows[21] == 0.0 and rows[2] == 2.0 and rows[20] == 20.0


def test_shared_category_edges_and_null_categories(spark):
    nodes = spark.createDataFrame([(1, "x", None), (2, "y", "x"), (3, None, None)], "node int, a string, b string")
    edges = spark.createDataFrame([(1, 2, -1.0), (1, 3, -2.0), (2, 1, 3.0), (3, 3, -4.0)], "src int, dst int, weight double")
    got = {(r.src, r.dst): r.weight for r in ag.clean_edges(edges, nodes, ["a", "b"]).collect()}
    assert got == {(1, 2): 0.0, (1, 3): -2.0, (2, 1): 3.0, (3, 3): -4.0}


def test_item_names(spark):
    spend = spark.createDataFrame([("one", "Roads"), ("tot", "Total Care"), ("tot", "Adult"), ("tot", "Child"),
                                   ("many", "Parks"), ("many", "Bins")], "item string, name string")
    assert dict(table(ag.broad_names(spend, "item", "name"), "item", "name")) == {
        "one": "Roads", "tot": "Care", "many": "Bins & Parks"}
    fine = {r["item"]: list(r["names"]) for r in ag.fine_names(spend, "item", "name").collect()}
    assert fine == {"one": ["Roads"], "many": ["Bins", "Parks"], "tot": ["Total Care (excluding Adult, Child)", "Adult", "Child"]}


def test_attach_scalar_refuses_two_rows(spark):
    with pytest.raises(Exception, match="more than one scalar row"):
        ag.attach_scalar(spark.range(1), spark.createDataFrame([(1,), (2,)], "s int")).collect()


def test_rates(spark):
    row = spark.range(1).select(clamp_rate(F.lit(0.0)).alias("a"), clamp_rate(F.lit(1.0)).alias("b"), clamp_rate(F.lit(0.4)).alias("c"),
                                mean_of_present(F.lit(1.0), F.lit(None), F.lit(3.0)).alias("m")).first()
    assert (row.a, row.b, row.c, row.m) == (0.05, 0.95, 0.4, 2.0)
