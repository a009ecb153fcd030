"""SQL that DuckDB runs over the same tables, one for each query."""

from __future__ import annotations

from .functions.text import LIGATURES, MARKUP, NARROW, QUOTES, REMOVED, WIDE
from .operators.reports import PLOTTED
from .operators.retrieval import permutation
from .schema import FAIRNESS, GENDERS, PROFESSIONS

_P = ", ".join(f"('{p}', {i})" for i, p in enumerate(PROFESSIONS))
_NAMES = ", ".join(f"'{p}'" for p in PROFESSIONS)

_ROWS = f"""
one AS (SELECT id, CASE WHEN lower(trim(split)) = 'dev' THEN 'validation' ELSE lower(trim(split)) END AS split, hard_text,
    replace(replace(lower(trim(profession)), ' ', '_'), '-', '_') AS profession, lower(trim(gender)) AS gender,
    CAST(split_part(id, ':', 3) AS BIGINT) AS ordinal, train_order
  FROM source_rows WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1),
good AS (SELECT * FROM one WHERE profession IN ({_NAMES}) AND gender IN ('male', 'female')),
cell AS (SELECT profession, gender FROM (VALUES {_P}) p(profession, i), (VALUES ('male'), ('female')) g(gender))
"""

COMPOSITION = f"""
WITH {_ROWS}, spine AS (SELECT * FROM (VALUES ('train'), ('validation'), ('test')) s(split), cell),
n AS (SELECT split, profession, gender, count(*) AS n FROM good GROUP BY ALL),
f AS (SELECT spine.*, coalesce(n.n, 0) AS count FROM spine LEFT JOIN n USING (split, profession, gender)),
s AS (SELECT *, count / nullif(sum(count) OVER (PARTITION BY split, profession), 0)::DOUBLE AS gender_share_within_profession,
    count / nullif(sum(count) OVER (PARTITION BY split, gender), 0)::DOUBLE AS profession_share_within_gender,
    count / nullif(sum(count) OVER (PARTITION BY split), 0)::DOUBLE AS cell_share_of_split FROM f)
SELECT *, max(gender_share_within_profession) OVER a - min(gender_share_within_profession) OVER a AS gender_share_gap_within_profession,
    max(profession_share_within_gender) OVER b - min(profession_share_within_gender) OVER b AS profession_share_gap_within_gender
FROM s WINDOW a AS (PARTITION BY split, profession), b AS (PARTITION BY split, gender)
"""

MAX_BALANCED = f"""
WITH {_ROWS}, n AS (SELECT profession, gender, count(*) AS n FROM good WHERE split = 'validation' GROUP BY ALL)
SELECT min(coalesce(n, 0)) AS rows_per_cell, count(*) FILTER (n IS NULL) AS empty_cells FROM cell LEFT JOIN n USING (profession, gender)
"""

BALANCED_SAMPLE = f"""
WITH {_ROWS} SELECT id, profession, gender, row_number() OVER (PARTITION BY profession, gender ORDER BY ordinal, id) AS place
FROM good WHERE split = 'test' QUALIFY place <= 5
"""

TRAIN_ORDER = f"""
WITH {_ROWS} SELECT id, split, CASE WHEN split = 'train' THEN row_number() OVER (PARTITION BY split ORDER BY ordinal, id) - 1 END AS train_order FROM good
"""

TRAIN_CAP = f"WITH {_ROWS} SELECT id, profession, gender, ordinal FROM good WHERE split = 'train' ORDER BY ordinal, id LIMIT 100"

CONDITION_GRID = """
WITH m AS (SELECT DISTINCT language_model FROM conditions), p AS (SELECT DISTINCT prompt_name, master_prompt FROM conditions),
few AS (SELECT * FROM (SELECT DISTINCT retrieval_method FROM conditions WHERE retrieval_method <> 'not_applicable'),
    (SELECT DISTINCT embedding_model FROM conditions WHERE embedding_model <> 'not_applicable'), (SELECT DISTINCT example_count FROM conditions WHERE example_count > 0),
    (SELECT DISTINCT example_order FROM conditions WHERE example_order <> 'not_applicable')
  UNION ALL SELECT 'not_applicable', 'not_applicable', 0, 'not_applicable')
SELECT concat_ws('|', language_model, prompt_name, retrieval_method, example_count, example_order) AS condition, language_model, retrieval_method, embedding_model,
    example_count, example_order, prompt_name, master_prompt FROM m, few, p
"""

_C = "condition, evaluation_split, target, audit_column, retrieval_method, embedding_model, example_count, example_order, prompt_name, language_model, prediction_method"
_CELLS = f"""
lab AS (SELECT * FROM (VALUES {_P}) p(target_label, label_index)),
pred AS (SELECT *, 'profession' AS target, 'gender' AS audit_column, 'generated_output' AS prediction_method FROM (
    SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY condition, evaluation_split, query_id ORDER BY run_no DESC, predicted_at DESC) = 1)
  WHERE predicted_label IS NOT NULL AND true_label IS NOT NULL AND audit_group IS NOT NULL),
c AS (SELECT {_C}, audit_group, true_label, predicted_label, count(*) AS n FROM pred GROUP BY ALL)
"""


def _one_vs_rest(keys: str, source: str = "c") -> str:
    return f"""(SELECT *, positive_support + negative_support AS total, predicted_positive / nullif(positive_support + negative_support, 0)::DOUBLE AS selection_rate, tp / nullif(tp + fp, 0)::DOUBLE AS precision,
    tp / nullif(tp + fn, 0)::DOUBLE AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1, tn / nullif(tn + fp, 0)::DOUBLE AS specificity,
    fp / nullif(tn + fp, 0)::DOUBLE AS false_positive_rate, fn / nullif(tp + fn, 0)::DOUBLE AS false_negative_rate, tn / nullif(tn + fn, 0)::DOUBLE AS negative_predictive_value
  FROM (SELECT {keys}, label_index, target_label,
      coalesce(sum(n) FILTER (true_label = target_label), 0)::BIGINT AS positive_support, coalesce(sum(n) FILTER (true_label <> target_label), 0)::BIGINT AS negative_support,
      coalesce(sum(n) FILTER (predicted_label = target_label), 0)::BIGINT AS predicted_positive,
      coalesce(sum(n) FILTER (true_label = target_label AND predicted_label = target_label), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (true_label <> target_label AND predicted_label = target_label), 0)::BIGINT AS fp,
      coalesce(sum(n) FILTER (true_label = target_label AND predicted_label <> target_label), 0)::BIGINT AS fn, coalesce(sum(n) FILTER (true_label <> target_label AND predicted_label <> target_label), 0)::BIGINT AS tn
    FROM {source}, lab GROUP BY ALL))"""


_COLUMNS = "positive_support, negative_support, predicted_positive, tp, fp, fn, tn, selection_rate, precision, recall, f1, specificity, false_positive_rate, false_negative_rate, negative_predictive_value"

CONFUSION = f"""
WITH {_CELLS}, k AS (SELECT DISTINCT {_C} FROM c), n AS (SELECT {_C}, true_label, predicted_label, sum(n)::BIGINT AS n FROM c GROUP BY ALL)
SELECT {", ".join(f"k.{x.strip()}" for x in _C.split(","))}, a.target_label AS true_label, b.target_label AS predicted_label, coalesce(n.n, 0) AS count
FROM k CROSS JOIN lab a CROSS JOIN lab b LEFT JOIN n ON n.condition = k.condition AND n.evaluation_split = k.evaluation_split AND n.true_label = a.target_label AND n.predicted_label = b.target_label
"""

CONFUSION_PIVOT = f"""
WITH {_CELLS}, k AS (SELECT DISTINCT {_C} FROM c)
SELECT {", ".join(f"k.{x.strip()}" for x in _C.split(","))}, a.target_label AS true_label, {", ".join(f"coalesce(sum(c.n) FILTER (c.predicted_label = '{p}'), 0)::BIGINT AS {p}" for p in PROFESSIONS)}
FROM k CROSS JOIN lab a LEFT JOIN c ON c.condition = k.condition AND c.evaluation_split = k.evaluation_split AND c.true_label = a.target_label GROUP BY ALL
"""

LABEL_METRICS = f"WITH {_CELLS} SELECT {_C}, target_label, {_COLUMNS} FROM {_one_vs_rest(_C)}"

GROUP_METRICS = f"""
WITH {_CELLS}, g AS (SELECT condition, evaluation_split, audit_group, sum(n)::BIGINT AS audit_group_n, coalesce(sum(n) FILTER (true_label = predicted_label), 0) / sum(n)::DOUBLE AS audit_group_accuracy FROM c GROUP BY ALL)
SELECT {_C}, audit_group, audit_group_n, audit_group_accuracy, target_label, {_COLUMNS} FROM {_one_vs_rest(_C + ", audit_group")} JOIN g USING (condition, evaluation_split, audit_group)
"""


def _range(x: str) -> str:
    return f"CASE WHEN count({x}) >= 2 THEN max({x}) - min({x}) END"


_FAIR = f"""
fair0 AS (SELECT {_C}, label_index, target_label, {_range("selection_rate")} AS demographic_parity_difference, CASE WHEN count(selection_rate) >= 2 THEN min(selection_rate) / nullif(max(selection_rate), 0) END AS demographic_parity_ratio,
    {_range("recall")} AS equal_opportunity_difference, {_range("false_positive_rate")} AS false_positive_rate_difference, {_range("precision")} AS predictive_parity_difference, count(*) AS n_audit_groups_compared,
    count(selection_rate) AS n_selection_rate_defined_audit_groups, count(recall) AS n_recall_defined_audit_groups, count(false_positive_rate) AS n_false_positive_rate_defined_audit_groups, count(precision) AS n_precision_defined_audit_groups
  FROM {_one_vs_rest(_C + ", audit_group")} GROUP BY ALL),
fair AS (SELECT *, CASE WHEN equal_opportunity_difference IS NOT NULL AND false_positive_rate_difference IS NOT NULL THEN greatest(equal_opportunity_difference, false_positive_rate_difference) END AS equalized_odds_difference FROM fair0)
"""

FAIRNESS_SQL = f"WITH {_CELLS}, {_FAIR} SELECT * EXCLUDE (label_index) FROM fair"

_SPREAD = ", ".join(f"round(avg({x}), 10) AS mean_{x}, round(min({x}), 10) AS min_{x}, round(max({x}), 10) AS max_{x}, count({x}) AS n_{x if x.endswith('ratio') else x.removesuffix('_difference')}_defined_target_labels" for x in FAIRNESS)
_SPREAD_RAW = _SPREAD.replace("round(", "(").replace(", 10)", ")")


def _results(exact: bool) -> str:
    r = (lambda x: x) if exact else (lambda x: f"round({x}, 10)")
    return f"""
v AS (SELECT * FROM {_one_vs_rest(_C)}),
q AS (SELECT {_C}, sum(positive_support)::BIGINT AS sample_count, count(*) AS n_target_labels, {r("sum(tp) / sum(positive_support)::DOUBLE")} AS accuracy,
    {r("avg(precision)")} AS macro_precision, {r("avg(recall)")} AS macro_recall, {r("avg(f1)")} AS macro_f1,
    {r("sum(precision * positive_support) FILTER (precision IS NOT NULL) / nullif(sum(positive_support) FILTER (precision IS NOT NULL), 0)")} AS weighted_precision,
    {r("sum(f1 * positive_support) FILTER (f1 IS NOT NULL) / nullif(sum(positive_support) FILTER (f1 IS NOT NULL), 0)")} AS weighted_f1,
    count(precision) AS n_precision_defined_target_labels, count(recall) AS n_recall_defined_target_labels, count(f1) AS n_f1_defined_target_labels,
    {r('''coalesce((sum(tp)::DOUBLE * sum(positive_support) - sum(positive_support * predicted_positive)) / nullif(sqrt((sum(positive_support)::DOUBLE * sum(positive_support) - sum(predicted_positive * predicted_positive))
      * (sum(positive_support)::DOUBLE * sum(positive_support) - sum(positive_support * positive_support))), 0), 0)''')} AS matthews_correlation_coefficient,
    {r('''(sum(tp)::DOUBLE * sum(positive_support) - sum(positive_support * predicted_positive)) / nullif(sum(positive_support)::DOUBLE * sum(positive_support) - sum(positive_support * predicted_positive), 0)''')} AS cohen_kappa
  FROM v GROUP BY ALL),
g0 AS (SELECT condition, evaluation_split, audit_group, coalesce(sum(n) FILTER (true_label = predicted_label), 0) / sum(n)::DOUBLE AS a FROM c GROUP BY ALL),
g AS (SELECT condition, evaluation_split, count(*) AS n_audit_groups, {r("min(a)")} AS worst_audit_group_accuracy, {r("CASE WHEN count(a) >= 2 THEN max(a) - min(a) END")} AS audit_group_accuracy_difference FROM g0 GROUP BY ALL),
sp AS (SELECT condition, evaluation_split, {_SPREAD_RAW if exact else _SPREAD} FROM fair GROUP BY ALL),
res AS (SELECT * FROM q JOIN g USING (condition, evaluation_split) JOIN sp USING (condition, evaluation_split))
"""


RESULTS = f"WITH {_CELLS}, {_FAIR}, {_results(False)} SELECT * FROM res"
_PANELS = ", ".join(PLOTTED["quality"])
METRIC_PANELS = f"""WITH {_CELLS}, {_FAIR}, {_results(False)},
wide AS (SELECT concat_ws(' | ', language_model, prompt_name, retrieval_method, example_count::VARCHAR, example_order) AS label, {", ".join(f"{c}::DOUBLE AS {c}" for c in PLOTTED["quality"])} FROM res)
SELECT label, metric, value, value IS NULL AS undefined FROM wide UNPIVOT INCLUDE NULLS (value FOR metric IN ({_PANELS}))"""
AXIS_LIMITS = f"""WITH {_CELLS}, {_FAIR}, {_results(True)},
ends AS (SELECT 'accuracy' AS panel, least(0, min(accuracy)) AS a, greatest(0, max(accuracy)) AS b FROM res
  UNION ALL SELECT 'agreement', least(0, min(macro_f1), min(cohen_kappa), min(matthews_correlation_coefficient)), greatest(0, max(macro_f1), max(cohen_kappa), max(matthews_correlation_coefficient)) FROM res),
m AS (SELECT *, CASE WHEN b > a THEN (b - a) * 0.05 ELSE 0.05 END AS m FROM ends)
SELECT panel, round(CASE WHEN a < 0 THEN a - m ELSE 0 END, 10) AS low, round(CASE WHEN b > 0 THEN b + m ELSE m END, 10) AS high FROM m"""
BEST_LABELS = f"""WITH {_CELLS}, l AS (SELECT * FROM (VALUES {_P}) p(predicted_label, i)),
n AS (SELECT condition, evaluation_split, true_label, predicted_label, sum(n) AS n FROM c GROUP BY ALL)
SELECT condition, evaluation_split, true_label, predicted_label AS best_label FROM n JOIN l USING (predicted_label)
QUALIFY row_number() OVER (PARTITION BY condition, evaluation_split, true_label ORDER BY n DESC, i) = 1"""
LENGTH_ORDER = f"""WITH {_ROWS} SELECT id, length(hard_text)::INT AS length, row_number() OVER (PARTITION BY profession ORDER BY length(hard_text) DESC, ordinal, id) AS place
FROM good WHERE split = 'train' AND hard_text IS NOT NULL"""
_RANKED = f"""WITH {_CELLS}, {_FAIR}, {_results(False)}, ranked AS (SELECT condition, evaluation_split, language_model, macro_f1, mean_equalized_odds_difference,
    CASE WHEN macro_f1 IS NOT NULL THEN dense_rank() OVER (PARTITION BY language_model, evaluation_split ORDER BY macro_f1 DESC NULLS LAST) END::INT AS quality_rank,
    CASE WHEN mean_equalized_odds_difference IS NOT NULL THEN dense_rank() OVER (PARTITION BY language_model, evaluation_split ORDER BY mean_equalized_odds_difference NULLS LAST) END::INT AS fairness_rank
  FROM res)"""
RANKED = f"{_RANKED} SELECT condition, language_model, evaluation_split, macro_f1, mean_equalized_odds_difference, quality_rank, coalesce(quality_rank = 1, false) AS is_quality_best, fairness_rank, coalesce(fairness_rank = 1, false) AS is_fairness_best FROM ranked"
WINNERS = f"{_RANKED} SELECT language_model, evaluation_split, condition, macro_f1 FROM ranked WHERE quality_rank = 1"
WINNER_PREDICTIONS = f"""{_RANKED} SELECT condition, evaluation_split, query_id, true_label, predicted_label FROM pred
WHERE (condition, evaluation_split) IN (SELECT (condition, evaluation_split) FROM ranked WHERE quality_rank = 1)"""

_FACTORS = ["language_model", "prompt_name", "retrieval_method", "embedding_model", "example_count", "example_order"]
_CONTEXT = ["evaluation_split", "target", "audit_column", "prediction_method"]
_METRICS = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_f1", "matthews_correlation_coefficient", "cohen_kappa", "worst_audit_group_accuracy", "audit_group_accuracy_difference", *(f"{a}_{x}" for x in FAIRNESS for a in ("mean", "min", "max"))]
_LONG = f"""long AS (SELECT * FROM (SELECT {", ".join(_CONTEXT + _FACTORS)}, {", ".join(f"{m}::DOUBLE AS {m}" for m in _METRICS)} FROM res) UNPIVOT INCLUDE NULLS (value FOR metric IN ({", ".join(_METRICS)})))"""


def _zero(x: str) -> str:
    """Rounded, without a sign on 0."""
    return f"CASE WHEN abs({x}) < 5e-11 THEN 0.0 ELSE round({x}, 10) END"


def _strict(factor: str) -> str:
    held = [x for x in _CONTEXT + _FACTORS if x != factor]
    levels = f"(SELECT DISTINCT {factor} FROM conditions WHERE {factor}::VARCHAR NOT IN ('not_applicable', '0'))"
    model = "'not_applicable'" if factor == "language_model" else "a.language_model"
    return f"""SELECT 'single_factor' AS contrast_type, '{factor}' AS factor, a.{factor}::VARCHAR AS from_factor_value, b.{factor}::VARCHAR AS to_factor_value, {", ".join(f"a.{x}" for x in _CONTEXT)}, {model} AS language_model,
    {", ".join(f"a.{x} AS held_{x}" if x in held else f"NULL AS held_{x}" for x in _FACTORS if x not in ("example_count",))}, a.metric, a.value AS from_metric_value, b.value AS to_metric_value, 1 AS from_condition_count, 1 AS to_condition_count
  FROM long a JOIN long b ON a.metric = b.metric AND a.{factor} < b.{factor} AND {" AND ".join(f"a.{x} = b.{x}" for x in held)}
  WHERE a.{factor} IN {levels} AND b.{factor} IN {levels} AND (SELECT count(*) FROM {levels}) > 1"""


_ZERO = f"""SELECT 'zero_shot_to_few_shot' AS contrast_type, 'example_count' AS factor, '0' AS from_factor_value, f.example_count::VARCHAR AS to_factor_value, {", ".join(f"z.{x}" for x in _CONTEXT)}, z.language_model,
    NULL AS held_language_model, z.prompt_name AS held_prompt_name, NULL AS held_retrieval_method, NULL AS held_embedding_model, NULL AS held_example_order, z.metric, z.value AS from_metric_value, f.value AS to_metric_value, 1 AS from_condition_count, f.n::INT AS to_condition_count
  FROM long z JOIN (SELECT {", ".join(_CONTEXT)}, language_model, prompt_name, example_count, metric, CASE WHEN count(value) = count(*) THEN avg(value) END AS value, count(*) AS n FROM long WHERE example_count > 0 GROUP BY ALL) f
  ON z.metric = f.metric AND z.language_model = f.language_model AND z.prompt_name = f.prompt_name AND {" AND ".join(f"z.{x} = f.{x}" for x in _CONTEXT)} WHERE z.example_count = 0"""
_DETAILS = f"""WITH {_CELLS}, {_FAIR}, {_results(True)}, {_LONG},
pairs AS ({" UNION ALL BY NAME ".join(_strict(f) for f in _FACTORS)} UNION ALL BY NAME {_ZERO}),
det AS (SELECT *, CASE WHEN metric LIKE '%\\_difference' ESCAPE '\\' THEN 'minimize' ELSE 'maximize' END AS direction, to_metric_value - from_metric_value AS delta, CASE WHEN metric LIKE '%\\_difference' ESCAPE '\\' THEN -1 ELSE 1 END * (to_metric_value - from_metric_value) AS improvement FROM pairs),
fin AS (SELECT *, CASE WHEN improvement IS NULL THEN 'undefined' WHEN round(improvement, 10) > 0 THEN 'improved' WHEN round(improvement, 10) < 0 THEN 'worsened' ELSE 'tied' END AS outcome FROM det)"""
_D = f"contrast_type, factor, from_factor_value, to_factor_value, {', '.join(_CONTEXT)}, language_model, metric, direction, round(from_metric_value, 10) AS from_metric_value, round(to_metric_value, 10) AS to_metric_value, {_zero('delta')} AS delta, {_zero('improvement')} AS improvement, outcome, from_condition_count, to_condition_count"
DETAILS = f"{_DETAILS} SELECT {_D} FROM fin WHERE contrast_type = 'single_factor'"
ZERO = f"{_DETAILS} SELECT {_D} FROM fin WHERE contrast_type <> 'single_factor'"


def _summary(scope: str, model: str, where: str, extra: str) -> str:
    return f"""SELECT contrast_type, '{scope}' AS aggregation_scope, {model} AS scope_language_model, factor, from_factor_value, to_factor_value, metric, direction, count(*) AS n_total_pairs, count(delta) AS n_defined_pairs,
    round(avg(from_metric_value) FILTER (delta IS NOT NULL), 10) AS mean_from_metric_value, round(avg(to_metric_value) FILTER (delta IS NOT NULL), 10) AS mean_to_metric_value, {_zero('avg(delta)')} AS mean_delta, round(stddev_samp(delta), 10) AS std_delta,
    count(*) FILTER (outcome = 'improved') AS n_improved, count(*) FILTER (outcome = 'tied') AS n_tied, count(*) FILTER (outcome = 'worsened') AS n_worsened, round(count(*) FILTER (outcome = 'improved') / nullif(count(delta), 0)::DOUBLE, 10) AS improvement_rate
  FROM fin {where} GROUP BY contrast_type, factor, from_factor_value, to_factor_value, metric, direction{extra}"""


SUMMARY = f"{_DETAILS} {_summary('overall', chr(39) + 'not_applicable' + chr(39), '', '')} UNION ALL {_summary('language_model', 'language_model', 'WHERE factor <> ' + chr(39) + 'language_model' + chr(39), ', language_model')}"

_SCORED = f"""
WITH {_ROWS}, usable AS (SELECT v.*, coalesce(length(one.hard_text), 0) AS text_length FROM (
    SELECT * FROM train_vectors WHERE id IS NOT NULL AND vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY vector, profession, gender, train_order) = 1) v LEFT JOIN one USING (id) WHERE v.profession IS NOT NULL AND v.gender IS NOT NULL),
s AS (SELECT q.id AS query_id, p.id, p.profession, p.gender, p.train_order, p.text_length, round(list_cosine_similarity(q.vector::DOUBLE[], p.vector::DOUBLE[]), 12) AS score
  FROM usable q JOIN usable p ON p.id <> q.id WHERE q.train_order % 50 = 0)
"""
_O = "ORDER BY score DESC, text_length DESC, train_order, id"
SEMANTIC = f"{_SCORED} SELECT query_id, (row_number() OVER (PARTITION BY query_id {_O}))::INT AS pos, id, profession, gender, round(score, 6) AS score FROM s QUALIFY pos <= 8"
# with four rows and more professions than rows: a new profession each time; the second and the fourth row take the gender picked less
BALANCED = f"""{_SCORED},
a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id {_O}) = 1),
b AS (SELECT s.* FROM s JOIN a USING (query_id) WHERE s.profession <> a.profession AND s.gender <> a.gender QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, s.text_length DESC, s.train_order, s.id) = 1),
c AS (SELECT s.* FROM s JOIN a USING (query_id) JOIN b USING (query_id) WHERE s.profession NOT IN (a.profession, b.profession) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, s.text_length DESC, s.train_order, s.id) = 1),
d AS (SELECT s.* FROM s JOIN a USING (query_id) JOIN b USING (query_id) JOIN c USING (query_id) WHERE s.profession NOT IN (a.profession, b.profession, c.profession) AND s.gender <> c.gender QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, s.text_length DESC, s.train_order, s.id) = 1)
SELECT query_id, pos, id, profession, gender, round(score, 6) AS score FROM (SELECT 1 AS pos, * FROM a UNION ALL SELECT 2, * FROM b UNION ALL SELECT 3, * FROM c UNION ALL SELECT 4, * FROM d)
"""

VECTOR_PROBLEMS = f"""
WITH {_ROWS}, shaped AS (SELECT *, vector IS NOT NULL AND len(vector) = 64 AS shaped, len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS finite, len(list_filter(vector, lambda x: x <> 0)) > 0 AS nonzero FROM train_vectors),
a AS (SELECT count(*) AS vector_rows, count(*) FILTER (vector IS NULL) AS null_vectors, count(*) FILTER (vector IS NOT NULL AND len(vector) <> 64) AS wrong_length, count(*) FILTER (shaped AND NOT finite) AS not_finite, count(*) FILTER (shaped AND finite AND NOT nonzero) AS zero_vectors FROM shaped),
ids AS (SELECT id, count(*) AS n, max(profession) AS profession, max(gender) AS gender, max(train_order) AS train_order FROM train_vectors GROUP BY id), tr AS (SELECT * FROM one WHERE split = 'train'),
b AS (SELECT count(*) FILTER (n > 1) AS repeated_ids, count(*) FILTER (tr.id IS NULL) AS without_row, count(*) FILTER (ids.id IS NULL) AS rows_without_vector,
    count(*) FILTER (ids.id IS NOT NULL AND tr.id IS NOT NULL AND (ids.profession IS DISTINCT FROM tr.profession OR ids.gender IS DISTINCT FROM tr.gender OR ids.train_order IS DISTINCT FROM tr.train_order)) AS labels_differ FROM ids FULL JOIN tr ON ids.id = tr.id)
SELECT * FROM a, b
"""

_SHUFFLE = "[" + ", ".join(str(i + 1) for i in permutation(42, 4)) + "]"
ORDERED = f"""
WITH s AS (SELECT DISTINCT retrieval_method, embedding_model, query_id, pos, id, retrieval_score FROM retrieval_selections WHERE pos <= 4),
f AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY retrieval_method, embedding_model, query_id ORDER BY pos, id, retrieval_score) AS place_ FROM s WINDOW w AS (PARTITION BY retrieval_method, embedding_model, query_id))
SELECT retrieval_method, query_id, 'most_similar_first' AS example_order, (row_number() OVER (PARTITION BY retrieval_method, embedding_model, query_id ORDER BY retrieval_score DESC NULLS LAST, pos, id) - 1)::INT AS place, id FROM f WHERE n = 4
UNION ALL SELECT retrieval_method, query_id, 'most_similar_last', (row_number() OVER (PARTITION BY retrieval_method, embedding_model, query_id ORDER BY retrieval_score NULLS LAST, pos, id) - 1)::INT, id FROM f WHERE n = 4
UNION ALL SELECT retrieval_method, query_id, 'shuffle', (list_position({_SHUFFLE}, place_) - 1)::INT, id FROM f WHERE n = 4
"""

HYDRATED = f"WITH {_ROWS} SELECT r.*, one.hard_text FROM retrieval_selections r JOIN one USING (id)"

PROMPT = f"""
WITH {_ROWS}, e AS (SELECT DISTINCT retrieval_method, query_id, pos, id, profession, gender FROM retrieval_selections WHERE profession IS NOT NULL AND gender IS NOT NULL),
x AS (SELECT e.*, one.hard_text, row_number() OVER (PARTITION BY retrieval_method, query_id ORDER BY pos, id, one.hard_text) AS place_ FROM e JOIN one USING (id) WHERE one.hard_text IS NOT NULL),
t AS (SELECT c.condition, c.master_prompt, x.query_id, count(*) AS n, string_agg('user: Biography: ' || x.hard_text || chr(10) || 'Gender: ' || x.gender || chr(10) || chr(10) || 'assistant: ' || x.profession, chr(10) || chr(10) ORDER BY place_) AS shown
  FROM x JOIN conditions c ON c.retrieval_method = x.retrieval_method AND c.example_count > 0 AND x.place_ <= c.example_count GROUP BY ALL)
SELECT t.condition, t.query_id, (2 + 2 * n)::INT AS messages, sha256('system: ' || replace(replace(replace(master_prompt, '{{target}}', 'profession'), '{{audit_column}}', 'gender'), '{{labels}}', '{", ".join(PROFESSIONS)}')
  || chr(10) || chr(10) || shown || chr(10) || chr(10) || 'user: Biography: ' || one.hard_text || chr(10) || 'Gender: ' || one.gender) AS prompt_sha256
FROM t JOIN one ON one.id = t.query_id WHERE one.hard_text IS NOT NULL AND one.gender IS NOT NULL
"""

LABEL_NORMALISE = rf"""
SELECT condition, label, coalesce(label IN ({_NAMES}), false) AS valid, count(*) AS outputs
FROM (SELECT condition, lower(regexp_replace(model_output, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) AS label FROM predictions) GROUP BY ALL
"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TEXT = f"regexp_replace(hard_text, '{MARKUP}', ' ', 'gis')"
_TEXT = f"replace({_TEXT}, '&amp;', '&')"
_TEXT = f"translate({_TEXT}, {_q(WIDE + ''.join(QUOTES))}, {_q(NARROW + ''.join(QUOTES.values()))})"
for _c, _plain in LIGATURES.items():
    _TEXT = f"replace({_TEXT}, {_q(_c)}, {_q(_plain)})"
_TEXT = rf"nfc_normalize(regexp_replace({_TEXT}, '[\x01-\x08\x0b\x0e-\x1f\x7f]', '', 'g'))"
_TEXT = rf"regexp_replace({_TEXT}, '[\x{{ad}}\x{{200b}}-\x{{200f}}\x{{2060}}\x{{feff}}]', '', 'g')"
_TEXT = rf"regexp_replace({_TEXT}, '[\x0c\x{{80}}-\x{{9f}}]', ' ', 'g')"
_TEXT = rf"trim(regexp_replace({_TEXT}, '[\s\p{{Z}}]+', ' ', 'g'))"
CLEAN = rf"SELECT id, loaded_at, regexp_replace({_TEXT}, ' ([,.;:!?])', '\1', 'g') AS clean FROM source_rows"
assert REMOVED  # the control characters above are those of this list that the tables hold

_DIGEST = ", ".join(f"""coalesce('"' || replace(replace({c}::VARCHAR, '\\', '\\\\'), '"', '\\"') || '"', 'null')""" for c in ("id", "split", "hard_text", "profession", "gender", "train_order"))
FINGERPRINTS = f"SELECT id, sha256('[' || concat_ws(',', {_DIGEST}) || ']') AS digest FROM source_rows"

BENCHMARK = """
SELECT event_type AS embedding_model, user_id % 9 AS batch_size, count(*) AS row_count, sum(round(value * 100)::BIGINT)::BIGINT / 100 AS seconds, round(count(*) / nullif(sum(round(value * 100)::BIGINT)::BIGINT / 100, 0), 10) AS rows_per_second
FROM events GROUP BY ALL
"""

EXTRA_VOLUME = f"""
WITH lab AS (SELECT * FROM (VALUES ('A', 0), ('N', 1), ('R', 2)) p(target_label, label_index)),
c AS (SELECT 'lineitem' AS condition, l_returnflag AS true_label, l_linestatus AS audit_group, CASE WHEN l_linenumber % 4 = 0 THEN 'N' ELSE l_returnflag END AS predicted_label, count(*) AS n FROM lineitem GROUP BY ALL),
g AS (SELECT condition, audit_group, sum(n)::BIGINT AS audit_group_n, coalesce(sum(n) FILTER (true_label = predicted_label), 0) / sum(n)::DOUBLE AS audit_group_accuracy FROM c GROUP BY ALL)
SELECT condition, audit_group, audit_group_n, audit_group_accuracy, target_label, {_COLUMNS} FROM {_one_vs_rest("condition, audit_group")} JOIN g USING (condition, audit_group)
"""
assert GENDERS == ("male", "female")


def oracle_sql() -> dict[str, str]:
    return {
        "composition_counts": COMPOSITION, "max_balanced": MAX_BALANCED, "balanced_sample": BALANCED_SAMPLE, "train_order": TRAIN_ORDER, "train_cap": TRAIN_CAP, "condition_grid": CONDITION_GRID,
        "confusion_matrix": CONFUSION, "confusion_pivot": CONFUSION_PIVOT, "target_label_metrics": LABEL_METRICS, "audit_group_metrics": GROUP_METRICS, "fairness_metrics": FAIRNESS_SQL,
        "condition_results": RESULTS, "metric_panels": METRIC_PANELS, "axis_limits": AXIS_LIMITS, "best_labels": BEST_LABELS, "length_order": LENGTH_ORDER, "ranked_results": RANKED, "winners": WINNERS, "winner_predictions": WINNER_PREDICTIONS, "contrast_details": DETAILS, "zero_shot_contrasts": ZERO, "contrast_summary": SUMMARY,
        "semantic_topk": SEMANTIC, "balanced_topk": BALANCED, "vector_problems": VECTOR_PROBLEMS, "ordered_examples": ORDERED, "hydrated_examples": HYDRATED, "build_prompt": PROMPT, "label_normalise": LABEL_NORMALISE,
        "clean_text": CLEAN, "fingerprints": FINGERPRINTS, "benchmark_aggregate": BENCHMARK, "group_quality_extra_volume": EXTRA_VOLUME,
    }
