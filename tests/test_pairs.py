import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelweave.functions import answers as an
from panelweave.functions import names as nm
from panelweave.functions import uncertainty as un
from panelweave.operators import answers as ans
from panelweave.operators import evaluation as ev
from panelweave.operators import pairs as pr
from panelweave.plans import flows


@pytest.fixture(scope="module")
def pairs(spark):
    """One item holds two thirds of all rows."""
    items = ["hot"] * 60 + [f"i{n % 6}" for n in range(30)]
    rows = [(i, item, f"ind {i}", "Yes" if i % 3 else "No") for i, item in enumerate(items)]
    return spark.createDataFrame(rows, "row_id bigint, item string, indicator string, related string")


def test_negatives_have_the_stated_size_and_never_come_from_the_item(pairs):
    out = pr.negatives(pairs, "item", ["row_id", "indicator"], 1).collect()
    sizes, total = Counter(r["item"] for r in pairs.collect()), pairs.count()
    drawn = Counter(r["item"] for r in out)
    assert drawn == {item: min(n, total - n) for item, n in sizes.items()}
    assert all(r["item"] != r.item_source and r.related == "No" for r in out)
    for item in sizes:
        picked = [r.row_id for r in out if r["item"] == item]
        assert len(picked) == len(set(picked))


def test_negatives_can_leave_out_known_pairs(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "z")], "item string, indicator string")
    known = {(r[0], r[1]) for r in df.collect()}
    out = pr.negatives(df, "item", ["indicator"], 3, exclude_known=True).collect()
    assert out and all((r["item"], r["indicator"]) not in known for r in out)


def test_stratified_split_is_a_partition_with_the_share(pairs):
    out = pr.split_stratified(pairs, ["item", "related"], 0.2, ["row_id"], 4)
    assert sorted(r.row_id for r in out.collect()) == list(range(90))
    for r in out.groupBy("item", "related").agg(F.count("row_id").alias("n"), F.sum((F.col("split") == "train").cast("int")).alias("t")).collect():
        assert r.t == math.floor(r.n * 0.2 + 0.5)


def test_samples(pairs):
    assert pr.sample_n(pairs, 10, ["row_id"]).count() == 10
    assert pr.sample_n(pairs, 500, ["row_id"]).count() == 90
    few = {r.row_id for r in pr.sample_n(pairs, 10, ["row_id"]).collect()}
    assert {r.row_id for r in pr.sample_n(pairs.repartition(7), 10, ["row_id"]).collect()} == few
    assert few < {r.row_id for r in pr.sample_n(pairs, 20, ["row_id"]).collect()}
    assert Counter(r.related for r in pr.sample_balanced(pairs, "related", 20, ["row_id"]).collect()) == {"Yes": 10, "No": 10}
    per_item = Counter(r["item"] for r in pr.sample_strata(pairs, "item", 9, ["row_id"]).collect())
    assert per_item == {"hot": 6, **{f"i{n}": 1 for n in range(6)}}


def test_prompts_strip_dots_blank_arbitrary_and_collapse(spark):
    df = spark.createDataFrame([(1, "Roads.", ".Speed.")], "row_id int, budget_item string, indicator string")
    one = pr.prompts(df, ["Does {budget_item} {effect} move {indicator}?"], ["budget_item", "indicator"], "arbitrary").first()
    assert one.prompt == "Does Roads move Speed?"


def test_shots_are_different_numbered_and_balanced(spark, pairs):
    asked = pairs.select("row_id").withColumn("prompt", F.lit("Q?"))
    examples = pairs.withColumnRenamed("row_id", "example")
    out = pr.with_shots(asked, ["row_id"], examples, F.col("indicator"), F.col("related"), 4, 2, ["example"])
    assert out.count() == 90
    text = out.where("row_id = 7").first().prompt
    parts = text.split("\n\n")
    assert parts[-1] == "Q?" and len(set(parts[:-1])) == 4
    assert [p.split(":")[0] for p in parts[:-1]] == [f"Example Question {i}" for i in range(4)]
    balanced = pr.with_balanced_shots(asked, ["row_id"], examples, "related", F.col("indicator"), F.col("related"), 5, 2, ["example"])
    for r in balanced.collect():
        labels = Counter(line.split(": ")[1] for line in r.prompt.split("\n") if line.startswith("Example Answer"))
        assert labels == {"Yes.": 3, "No.": 2}


def test_no_prompt_holds_its_own_pair(spark, pairs):
    asked = pairs.select("row_id").withColumn("prompt", F.lit("Q?"))
    for pool in (pairs.where("row_id < 6"), pairs.where("row_id = 3")):
        examples = pool.withColumnRenamed("row_id", "example")
        out = pr.with_shots(asked, ["row_id"], examples, F.col("example").cast("string"), F.col("related"), 4, 2, ["example"],
                            left_out=F.col("row_id") == F.col("example"))
        rows = out.collect()
        assert len(rows) == 90
        for r in rows:
            used = [line.split(": ")[1] for line in r.prompt.split("\n") if line.startswith("Example Question")]
            assert str(r.row_id) not in used and len(set(used)) == len(used)
    contexts = {r.prompt for r in pr.with_shots(asked, ["row_id"], pairs.withColumnRenamed("row_id", "example"), F.col("example").cast("string"),
                                                F.col("related"), 2, 2, ["example"]).collect()}
    assert len(contexts) > 80


@pytest.mark.parametrize("text,label,words", [
    ("Yes.", "Yes", "Yes"), ("No", "No", "No"), ("I know", "No", "NA"), ("FALSE", "No", "No"), ("it is not true", "No", "No"),
    ("Correct", "Yes", "Yes"), ("perhaps", "NA", "NA"), ("cannot answer", "No", "NA")])
def test_yes_no_rules(spark, text, label, words):
    row = spark.range(1).select(an.parse_yes_no(F.lit(text)).alias("a"), an.parse_yes_no(F.lit(text), True).alias("b")).first()
    assert (row.a, row.b) == (label, words)


@pytest.mark.parametrize("text,want", [("level 3", 3), ("9", None), ("none", None), ("12", 1), ("0", 0)])
def test_scale_digit(spark, text, want):
    assert spark.range(1).select(an.parse_scale_digit(F.lit(text), 5).alias("d")).first().d == want


@pytest.mark.parametrize("text,want", [("1) sure", "Yes"), ("It is UNRELATED", "No"), ("say 2 or so", "No"), ("hm", "NA")])
def test_category_tiers(spark, text, want):
    options, labels = {"1": "It is related", "2": "It is unrelated"}, {"1": "Yes", "2": "No"}
    assert spark.range(1).select(an.parse_category(F.lit(text), options, labels).alias("c")).first().c == want


def test_label_text_is_parsed_not_evaluated(spark):
    row = spark.range(1).select(an.parse_probs(F.lit("{'Yes': 0.7, 'No': 0.3}")).alias("a"),
                                an.parse_probs(F.lit("__import__('os')")).alias("b")).first()
    assert row.a == {"Yes": 0.7, "No": 0.3} and not row.b
    many = spark.range(1).select(an.parse_ensemble(F.lit("[{1: 0.25, 2:0.75}, {'1': 1.0}]")).alias("m")).first().m
    assert many == [{"1": 0.25, "2": 0.75}, {"1": 1.0}]


def test_model_family_by_name_part(spark):
    families = {"one": ("alpha", "beta"), "two": ("gamma",)}
    rows = spark.createDataFrame([("My-Beta-7B",), ("gamma-alpha",), ("GAMMA",), ("delta",)], "m string")
    assert [r.f for r in rows.select(nm.layout_family(F.col("m"), families).alias("f")).collect()] == ["one", "one", "two", None]


@pytest.mark.parametrize("yes,no", [(0.9, 0.1), (0.5, 0.5), (0.2, 0.8), (1.0, 0.0)])
def test_binary_certainty_formula(spark, yes, no):
    got = spark.range(1).select(un.certainty_binary(F.lit(yes), F.lit(no)).alias("c")).first().c
    assert got == pytest.approx(1 + sum(p * math.log2(p) for p in (yes, no) if p))


def test_certainty_counts_zero_categories_in_the_base(spark):
    def certainty(*ps):
        cells = [x for i, p in enumerate(ps) for x in (F.lit(str(i)), F.lit(p))]
        return spark.range(1).select(un.certainty(F.create_map(*cells)).alias("c")).first().c

    assert certainty(1.0, 0.0, 0.0) == 1.0
    assert certainty(0.25, 0.25, 0.25, 0.25) == pytest.approx(0.0)
    assert certainty(0.5, 0.5, 0.0, 0.0) == pytest.approx(0.5)


def members(spark, *probs):
    rows = [(1, i, dict(zip(("Yes", "No", "NA"), p))) for i, p in enumerate(probs)]
    return spark.createDataFrame(rows, "pair int, member int, p map<string,double>")


def test_mode_ties_go_to_the_first_seen(spark):
    df = members(spark, (0.1, 0.9, 0.0), (0.9, 0.1, 0.0))
    assert ans.agg_mode(df, ["pair"], "member", F.col("p")).first().mode == "No"
    df = members(spark, (0.5, 0.5, 0.0))
    assert ans.agg_mode(df, ["pair"], "member", F.col("p")).first().mode == "Yes"


def test_distribution_sums_to_one(spark):
    row = ans.agg_distribution(members(spark, (2.0, 1.0, 1.0), (0.0, 0.0, 3.0)), ["pair"], F.col("p")).first()
    assert (row.Yes, row.No, row.NA) == (0.25, 0.125, 0.625)


def test_scale_aggregates(spark):
    digits = spark.createDataFrame([(1, 3), (1, None), (1, 4), (2, None)], "pair int, d int")
    got = {r.pair: (r.mean, r.scaled_mean) for r in ans.agg_scale(digits, ["pair"], "d", 5).collect()}
    assert got == {1: (3.5, 0.7), 2: (0.0, 0.0)}


def test_softmax_adds_spelling_variants(spark):
    df = spark.createDataFrame([(1, "1", math.log(0.1)), (1, "1", math.log(0.2)), (1, "2", math.log(0.1))], "k int, a string, lp double")
    got = {r.a: r.probability for r in ans.normalise_answers(df, ["k"], "a", "lp").collect()}
    assert got == {"1": pytest.approx(0.75), "2": pytest.approx(0.25)}


def test_swapped_labels(spark):
    df = spark.createDataFrame([("1", False), ("1", True), ("2", True), ("3", False)], "o string, r boolean")
    assert [r.label for r in ans.relabel(df, "o", {"1": "Yes", "2": "No"}, "r").collect()] == ["Yes", "No", "Yes", None]


def test_auc_with_ties_against_all_pairs(spark):
    data = [(e, (i * 7) % 5 / 4, (i * i) % 3 == 0) for e in ("a", "b") for i in range(60)] + [("one", 0.5, True)]
    df = spark.createDataFrame([(e, s, int(t)) for e, s, t in data], "e string, s double, y int")
    got = {r.e: r.roc_auc for r in ev.roc_auc(df, ["e"], "y", "s").collect()}
    for e in ("a", "b"):
        pos = [s for k, s, t in data if k == e and t]
        neg = [s for k, s, t in data if k == e and not t]
        want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
        assert got[e] == pytest.approx(want)
    assert got["one"] is None


def test_prf_empty_denominator(spark):
    df = spark.createDataFrame([("e", "No", "No")], "e string, related string, pred string")
    assert ev.prf(df, ["e"]).first().precision_yes is None
    assert ev.prf(df, ["e"], empty=0.0).first().precision_yes == 0.0


def test_label_name_age(spark):
    cases = [("Deaths", "10+ yrs", "Most deprived decile", "Deaths (10+ yrs) for the most deprived decile of the population."),
             ("Deaths under 75", "0-74 yrs", "x", "Deaths under 75"), ("Births All ages", "All ages", "x", "Births All ages"),
             ("Falls  rate", "All ages", "Least deprived decile (IMD)", "Falls rate (All ages) for the least deprived decile of the population.")]
    df = spark.createDataFrame(cases, "name string, age string, grp string, want string")
    for r in df.select(nm.label_name_age(F.col("name"), F.col("age"), F.col("grp")).alias("got"), "want").collect():
        assert r.got == r.want


def test_prediction_table_ships_no_prompts_and_keeps_repeated_pairs(spark):
    pairs = spark.createDataFrame([(1, ".roads.", "life"), (1, "schools", "life"), (2, "parks", "air"), (3, "none", "asked")], "id int, item string, goal string")
    answers = spark.createDataFrame([(1, 1, "Yes"), (1, 0, "no way"), (2, 0, "yes"), (2, 0, "maybe"), (2, 7, "yes"), (2, None, "yes"), (9, 0, "yes"), (None, 0, "no")],
                                    "id int, member int, answer string")
    out = flows.prediction_table(pairs, ["id"], ["item", "goal"], ["Does {item} {effect} move {goal}?", "Is {goal} {item}?"], answers)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    assert not [line for line in plan.splitlines() if "prompt" in line and any(node in line for node in ("Exchange", "Sort ", "Aggregate"))]
    got = sorted((r.id, r.item, r.Yes, r.No, r.NA, r.prompts, r.predictions) for r in out.collect())
    first = ["Does roads directly move life?", "Does schools directly move life?", "Is life roads?", "Is life schools?"]
    both = (0.5, 0.5, 0.0, first, ["No", "No", "Yes", "Yes"])
    assert got == [(1, ".roads.", *both), (1, "schools", *both), (2, "parks", 0.5, 0.0, 0.5, ["Does parks directly move air?"] * 2, ["NA", "Yes"])]
