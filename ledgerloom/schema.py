"""Labels, schemas and column lists that all parts share."""

from __future__ import annotations

# The labels of the two attributes, in code order.
PROFESSIONS = (
    "accountant", "architect", "attorney", "chiropractor", "comedian", "composer", "dentist", "dietitian", "dj", "filmmaker",
    "interior_designer", "journalist", "model", "nurse", "painter", "paralegal", "pastor", "personal_trainer", "photographer",
    "physician", "poet", "professor", "psychologist", "rapper", "software_engineer", "surgeon", "teacher", "yoga_teacher",
)
GENDERS = ("male", "female")
NOT_APPLICABLE = "not_applicable"

SOURCE_ROW = "id string, split string, hard_text string, profession string, gender string"
VECTOR_ROW = "id string, profession string, gender string, train_order int, vector array<float>"

CONDITION = ["condition", "evaluation_split", "target", "audit_column", "retrieval_method", "embedding_model", "example_count", "example_order", "prompt_name", "language_model", "prediction_method"]
FACTORS = ["language_model", "prompt_name", "retrieval_method", "embedding_model", "example_count", "example_order"]
CONTEXT = ["evaluation_split", "target", "audit_column", "prediction_method"]

# The standard names of two shared metrics, and the names they have in reports.
METRIC_ALIASES = {n: "accuracy" for n in ("micro_precision", "micro_recall", "micro_f1", "weighted_recall")} | {"balanced_accuracy": "macro_recall"}
REPORT_NAMES = {"accuracy": "accuracy / micro_precision / micro_recall / micro_f1 / weighted_recall", "macro_recall": "macro_recall / balanced_accuracy"}

RATES = ["selection_rate", "precision", "recall", "f1", "specificity", "false_positive_rate", "false_negative_rate", "negative_predictive_value"]
COUNTS = ["positive_support", "negative_support", "predicted_positive", "tp", "fp", "fn", "tn"]
FAIRNESS = ["demographic_parity_difference", "equal_opportunity_difference", "false_positive_rate_difference", "equalized_odds_difference", "predictive_parity_difference", "demographic_parity_ratio"]


def metric_name(name: str) -> str:
    """The column that holds a metric known by several names."""
    return METRIC_ALIASES.get(name, name)
