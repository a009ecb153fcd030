import math
import random

import pytest

from ledgerloom.operators import contrasts, metrics, ranking

COND = ["condition"]


def frame(spark, rows):
    """rows: (condition, true, predicted, group)"""
    return spark.createDataFrame(rows, "condition string, true_label string, predicted_label string, audit_group string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_label_never_true_and_never_predicted(spark):
    c = metrics.cells(frame(spark, [("c", "a", "a", "m"), ("c", "b", "a", "f")]), COND)
    r = one(metrics.target_label_metrics(c, ["a", "b", "z"], COND).where("target_label = 'z'"))
    assert (r["precision"], r["recall"], r["f1"], r["false_negative_rate"]) == (None,) * 4
    assert r["false_positive_rate"] == 0 and r["specificity"] == 1 and r["tn"] == 2


def test_single_group_and_group_without_support(spark):
    c = metrics.cells(frame(spark, [("c", "a", "a", "m"), ("c", "b", "a", "m")]), COND)
    r = one(metrics.fairness_metrics(c, ["a"], COND))
    assert r["demographic_parity_difference"] is None and r["demographic_parity_ratio"] is None and r["n_audit_groups_compared"] == 1
    assert one(metrics.results(c, ["a", "b"], COND))["worst_audit_group_accuracy"] == 0.5
    c = metrics.cells(frame(spark, [("c", "a", "a", "m"), ("c", "b", "b", "m"), ("c", "b", "b", "f")]), COND)
    r = one(metrics.fairness_metrics(c, ["a"], COND))
    assert r["equal_opportunity_difference"] is None and r["false_positive_rate_difference"] == 0 and r["equalized_odds_difference"] is None


def test_label_that_no_group_selects(spark):
    c = metrics.cells(frame(spark, [("c", "a", "b", "m"), ("c", "a", "b", "f")]), COND)
    r = one(metrics.fairness_metrics(c, ["a"], COND))
    assert r["demographic_parity_difference"] == 0 and r["demographic_parity_ratio"] is None


def test_agreement_of_constant_predictions(spark):
    c = metrics.cells(frame(spark, [("c", "a", "a", "m"), ("c", "b", "a", "m"), ("d", "a", "a", "m")]), COND)
    r = {x["condition"]: x for x in metrics.results(c, ["a", "b"], COND).collect()}
    assert r["c"]["matthews_correlation_coefficient"] == 0 and r["c"]["cohen_kappa"] == 0
    assert r["d"]["matthews_correlation_coefficient"] == 0 and r["d"]["cohen_kappa"] is None and r["d"]["accuracy"] == 1


def test_identities(spark):
    rng = random.Random(1)
    labels = ["a", "b", "c"]
    rows = [(c, rng.choice(labels), rng.choice(labels), rng.choice("mf")) for c in "xyz" for _ in range(200)]
    c = metrics.cells(frame(spark, rows), COND)
    for r in metrics.target_label_metrics(c, labels, COND).collect():
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == 200
        assert math.isclose(r["false_positive_rate"], 1 - r["specificity"]) and math.isclose(r["false_negative_rate"], 1 - r["recall"])
    for r in metrics.results(c, labels, COND).collect():
        own = [x for x in rows if x[0] == r["condition"]]
        n, right = len(own), sum(x[1] == x[2] for x in own)
        assert r["accuracy"] == right / n
        t = {l: sum(x[1] == l for x in own) for l in labels}
        p = {l: sum(x[2] == l for x in own) for l in labels}
        e = sum(t[l] * p[l] for l in labels)
        assert math.isclose(r["cohen_kappa"], (right / n - e / n**2) / (1 - e / n**2))
        assert math.isclose(r["matthews_correlation_coefficient"], (right * n - e) / math.sqrt((n * n - sum(v * v for v in p.values())) * (n * n - sum(v * v for v in t.values()))))
    matrix = metrics.confusion_matrix(c, [*labels, "never"], COND)
    assert matrix.count() == 3 * 16 and matrix.agg({"count": "sum"}).first()[0] == 600


def test_validation(spark):
    good = frame(spark, [("c", "a", "a", "m")])
    metrics.validate(good, ["a"], COND)
    for bad, text in ((good.limit(0), "no predictions"), (good.drop("audit_group"), "missing"), (frame(spark, [("c", None, "a", "m")]), "null"), (frame(spark, [("c", "a", "q", "m")]), "not configured")):
        with pytest.raises(ValueError, match=text):
            metrics.validate(bad, ["a"], COND)
    with pytest.raises(ValueError, match="several values"):
        metrics.require_constant(frame(spark, [("c", "a", "a", "m"), ("c", "a", "a", "f")]), ["audit_group"])


def ranks(spark, values, fairness=None):
    rows = [("lm", f"c{i}", v, f) for i, (v, f) in enumerate(zip(values, fairness or values))]
    return spark.createDataFrame(rows, "language_model string, condition string, macro_f1 double, mean_equalized_odds_difference double")


def test_ties_and_undefined_values(spark):
    got = {r["condition"]: r for r in ranking.rank_results(ranks(spark, [0.9, 0.9, 0.8, None], [None] * 4)).collect()}
    assert [got[f"c{i}"]["quality_rank"] for i in range(4)] == [1, 1, 2, None]
    assert [got[f"c{i}"]["is_quality_best"] for i in range(4)] == [True, True, False, False]
    assert not any(r["is_fairness_best"] for r in got.values())
    with pytest.raises(ValueError, match="undefined for every condition"):
        ranking.rank_results(ranks(spark, [None, None]))
    with pytest.raises(ValueError, match="direction"):
        ranking.rank_results(ranks(spark, [0.1]), quality_direction="up")


LEVELS = {"language_model": ["x", "y"], "prompt_name": ["p", "q"], "retrieval_method": ["s"], "embedding_model": ["e"], "example_count": [0, 2, 4], "example_order": ["f", "l"]}


def results(spark, value=lambda lm, p, n, o: 0.5, skip=()):
    rows = []
    for lm in "xy":
        for p in "pq":
            rows.append(("v", "t", "a", "g", lm, p, "not_applicable", "not_applicable", 0, "not_applicable", value(lm, p, 0, "")))
            rows += [("v", "t", "a", "g", lm, p, "s", "e", n, o, value(lm, p, n, o)) for n in (2, 4) for o in "fl" if (lm, p, n, o) not in skip]
    return spark.createDataFrame(rows, "evaluation_split string, target string, audit_column string, prediction_method string, language_model string, prompt_name string, retrieval_method string, embedding_model string, example_count int, example_order string, accuracy double")


def test_contrasts(spark):
    value = lambda lm, p, n, o: None if (lm, p, n, o) == ("x", "p", 4, "l") else n / 10 + (lm == "y")
    d = contrasts.contrast_details(results(spark, value), LEVELS).collect()
    by = {f: [r for r in d if r["factor"] == f and r["contrast_type"] == "single_factor"] for f in LEVELS}
    assert {f: len(v) for f, v in by.items()} == {"language_model": 10, "prompt_name": 10, "retrieval_method": 0, "embedding_model": 0, "example_count": 8, "example_order": 8}
    assert all(r["language_model"] == "not_applicable" for r in by["language_model"])
    zero = [r for r in d if r["contrast_type"] != "single_factor"]
    assert len(zero) == 8 and sum(r["outcome"] == "undefined" for r in zero) == 1 and all(r["to_condition_count"] == 2 for r in zero)
    s = contrasts.contrast_summary(spark.createDataFrame(d)).collect()
    r = next(r for r in s if r["contrast_type"] != "single_factor" and r["to_factor_value"] == "4" and r["aggregation_scope"] == "overall")
    assert (r["n_total_pairs"], r["n_defined_pairs"], r["n_improved"]) == (4, 3, 3) and math.isclose(r["mean_delta"], 0.4)
    assert not [r for r in s if r["factor"] == "language_model" and r["aggregation_scope"] == "language_model"]
    with pytest.raises(ValueError, match="partner"):
        contrasts.strict_contrasts(results(spark, skip={("x", "p", 2, "f")}), LEVELS)
    with pytest.raises(ValueError, match="retrieval conditions"):
        contrasts.zero_shot_contrasts(results(spark, skip={("x", "p", 2, "f")}), LEVELS)
