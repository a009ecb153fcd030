"""Experiment configuration: YAML, prompt files and the checks a configuration must pass."""

from __future__ import annotations

import os
from dataclasses import dataclass

from .operators.prompts import check_template
from .operators.ranking import metric_name
from .schema import FAIRNESS, PROFESSIONS

METHODS = ("semantic", "balanced_semantic")
ORDERS = ("most_similar_first", "most_similar_last", "shuffle")
SECTIONS = ("defaults", "dataset", "retrieval", "prompt_templates", "inference")
DEFAULTS = ("target", "evaluation_split", "seed", "output_dir", "quality_metric", "quality_direction", "fairness_metric", "fairness_direction")
ENCODER = ("id", "revision", "dimension", "max_sequence_length", "batch_size", "dtype", "query_prompt")
FAIRNESS_METRICS = frozenset({"audit_group_accuracy_difference", *(f"{a}_{x}" for a in ("mean", "min", "max") for x in FAIRNESS)})
RESULT_METRICS = frozenset({"accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_f1", "matthews_correlation_coefficient", "cohen_kappa", "worst_audit_group_accuracy", *FAIRNESS_METRICS})


class ConfigError(ValueError):
    pass


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


def _text(value, name: str) -> None:
    _need(isinstance(value, str) and bool(value.strip()), f"{name} must be a text that is not empty")


def _whole(value, name: str, least: int) -> None:
    _need(isinstance(value, int) and not isinstance(value, bool) and value >= least, f"{name} must be a whole number of at least {least}")


def _one_of(value, name: str, allowed) -> None:
    _need(value in allowed, f"{name} must be one of {', '.join(map(str, sorted(allowed)))}")


def _unique(value, name: str, least: int = 1) -> None:
    _need(isinstance(value, list) and len(value) >= least and all(value.count(x) == 1 for x in value), f"{name} must be a list of at least {least} different values")


def load_config(path: str) -> dict:
    """Reads a YAML file; prompt files are looked for beside it."""
    with open(path, encoding="utf-8") as f:
        return load_config_text(f.read(), os.path.dirname(os.path.abspath(path)))


def load_config_text(text: str, base: str) -> dict:
    import yaml

    config = yaml.safe_load(text)
    _need(isinstance(config, dict), "a configuration must be a mapping")
    return resolve_prompts(config, base)


def resolve_prompts(config: dict, base: str) -> dict:
    """config with prompt templates given as {file: path} replaced by the files' stripped texts.

    All entries must be of one kind; paths are relative, stay under base and exist."""
    entries = config.get("prompt_templates")
    if not isinstance(entries, dict) or all(isinstance(v, str) for v in entries.values()):
        return config
    _need(all(isinstance(v, dict) and set(v) == {"file"} and isinstance(v["file"], str) for v in entries.values()), "prompt templates are either all texts or all files")
    root, out = os.path.realpath(base), {}
    for name, entry in entries.items():
        path = os.path.realpath(os.path.join(root, entry["file"]))
        _need(not os.path.isabs(entry["file"]) and path.startswith(root + os.sep), f"the prompt file of {name} must lie under the configuration's folder")
        _need(os.path.isfile(path), f"there is no prompt file {entry['file']}")
        with open(path, encoding="utf-8") as f:
            out[name] = f.read().strip()
    return config | {"prompt_templates": out}


def validate(config: dict) -> dict:
    """Fails on the first rule that the configuration breaks; returns it."""
    _need(isinstance(config, dict), "a configuration must be a mapping")
    for section in SECTIONS:
        _need(isinstance(config.get(section), dict), f"the section {section} is missing")
    _defaults(config["defaults"])
    _dataset(config["dataset"])
    _retrieval(config["retrieval"], config["dataset"])
    prompts = config["prompt_templates"]
    _need(bool(prompts), "there must be a prompt template")
    for name, template in prompts.items():
        _text(name, "a prompt's name")
        _text(template, f"the prompt {name}")
        try:
            check_template(template)
        except ValueError as e:
            raise ConfigError(f"prompt {name}: {e}") from e
    _inference(config["inference"])
    return config


def _defaults(d: dict) -> None:
    _need(set(d) == set(DEFAULTS), f"defaults must hold exactly {', '.join(DEFAULTS)}")
    _one_of(d["target"], "target", ("profession", "gender"))
    _one_of(d["evaluation_split"], "evaluation_split", ("validation", "test"))
    _whole(d["seed"], "seed", 0)
    _text(d["output_dir"], "output_dir")
    for kind, allowed in (("quality", RESULT_METRICS), ("fairness", FAIRNESS_METRICS)):
        _text(d[f"{kind}_metric"], f"{kind}_metric")
        _one_of(metric_name(d[f"{kind}_metric"]), f"{kind}_metric", allowed)
        _one_of(d[f"{kind}_direction"], f"{kind}_direction", ("maximize", "minimize"))


def _dataset(d: dict) -> None:
    for key in ("file", "hub_id", "revision"):
        _text(d.get(key), key)
    if d.get("professions") != "all":
        _unique(d.get("professions"), "professions", 2)
        for p in d["professions"]:
            _one_of(p, "professions", PROFESSIONS)
    _whole(d.get("shuffle_seed"), "shuffle_seed", 0)
    if d.get("train_size") != "all":
        _whole(d.get("train_size"), "train_size", 1)
    if d.get("evaluation_per_profession_gender") != "max_balanced":
        _whole(d.get("evaluation_per_profession_gender"), "evaluation_per_profession_gender", 1)


def _retrieval(r: dict, dataset: dict) -> None:
    for key, allowed in (("methods", METHODS), ("example_orders", ORDERS)):
        _unique(r.get(key), key)
        for x in r[key]:
            _one_of(x, key, allowed)
    _unique(r.get("example_counts"), "example_counts")
    for n in r["example_counts"]:
        _whole(n, "example_counts", 0)
        _need(dataset["train_size"] == "all" or n <= dataset["train_size"], "example_counts must not be above train_size")
    models = r.get("embedding_models")
    _need(isinstance(models, list) and bool(models), "there must be an embedding model")
    for m in models:
        _need(isinstance(m, dict) and set(m) == set(ENCODER), f"an embedding model must hold exactly {', '.join(ENCODER)}")
        for key in ("id", "revision", "query_prompt"):
            _text(m[key], key)
        for key in ("dimension", "max_sequence_length", "batch_size"):
            _whole(m[key], key, 1)
        _one_of(m["dtype"], "dtype", ("float32", "float16", "bfloat16"))
    _unique([m["id"] for m in models], "embedding model ids")


def _inference(i: dict) -> None:
    _unique(i.get("language_models"), "language_models")
    for m in i["language_models"]:
        _text(m if isinstance(m, str) else (m or {}).get("id"), "a language model's id")
    _one_of(i.get("prediction_method", "generated_output"), "prediction_method", ("generated_output", "label_log_probability"))
    _whole(i.get("batch_size", 1), "batch_size", 1)


@dataclass(frozen=True)
class Task:
    target: str
    audit_column: str
    professions: tuple[str, ...]
    labels: tuple[str, ...]


def task_settings(config: dict) -> Task:
    """What is predicted, which attribute audits it, and the labels in configured order."""
    target = config["defaults"]["target"]
    given = config["dataset"]["professions"]
    professions = PROFESSIONS if given == "all" else tuple(given)
    return Task(target, "gender" if target == "profession" else "profession", professions, professions if target == "profession" else ("male", "female"))
