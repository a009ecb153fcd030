"""Conditions of an experiment, prompts and their predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import product
from string import Formatter
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import NOT_APPLICABLE

CONDITIONS = "condition string, language_model string, retrieval_method string, embedding_model string, example_count int, example_order string, prompt_name string, master_prompt string"


def check_template(template: str) -> None:
    """Fails on broken braces and on placeholders other than target, audit_column and labels."""
    try:
        names = {n for _, n, _, _ in Formatter().parse(template) if n is not None}
    except ValueError as e:
        raise ValueError(f"template with broken braces: {e}") from e
    if bad := names - {"target", "audit_column", "labels"}:
        raise ValueError(f"unknown placeholders: {sorted(bad)}")


def condition_grid(spark, models: list[str], methods: list[str], encoders: list[str], counts: list[int], orders: list[str], prompts: dict[str, str]) -> DataFrame:
    """Every combination in configured order; a count of 0 stands once for each model and prompt."""
    few = [x for x in product(methods, encoders, [c for c in counts if c > 0], orders)]
    if 0 in counts:
        few.insert(0, (NOT_APPLICABLE, NOT_APPLICABLE, 0, NOT_APPLICABLE))
    rows = []
    for model, (method, encoder, count, order), (prompt, template) in product(models, few, prompts.items()):
        name = [model, prompt, method, str(count), order, *([encoder] if len(encoders) > 1 else [])]
        rows.append(("|".join(name), model, method, encoder, count, order, prompt, template))
    # as many rows as conditions, each of which is a run over all queries
    return spark.createDataFrame(rows, CONDITIONS)


def fill(template: Column, target: str, audit: str, labels: list[str]) -> Column:
    """A checked template with its placeholders replaced, at once: a value that holds a placeholder stays as it is."""
    given = {"target": target, "audit_column": audit, "labels": ", ".join(labels)}
    marks = {name: f"\ue000{i}\ue001" for i, name in enumerate(given)}  # private characters, which no text shares
    for name, mark in marks.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.lit(mark))
    for name, value in given.items():
        template = F.replace(template, F.lit(marks[name]), F.lit(value))
    return template


def render_input(text: Column, audit_name: str, audit: Column) -> Column:
    return F.concat(F.lit("Biography: "), text, F.lit(f"\n{audit_name.capitalize()}: "), audit)


def chat(system: Column, examples: Column, query: Column, target: str, audit_name: str) -> Column:
    """Messages: system, then input and answer of each example, then the query's input without an answer."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    shown = F.flatten(F.transform(examples, lambda x: F.array(message("user", render_input(x["hard_text"], audit_name, x[audit_name])), message("assistant", x[target]))))
    return F.concat(F.array(message("system", system)), shown, F.array(message("user", query)))


def chat_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n\n")


class Predictor(Protocol):
    """Gives a label and raw output, or label scores, for each chat; made once in every worker."""

    def predict(self, chats: list[list[dict]], labels: list[str]) -> list[tuple[str | None, str | None, dict[str, float] | None]]: ...


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class StubPredictor:
    """A predictor without a model: the label picked by a hash of the chat."""

    method: str = "generation"
    seen: int = field(default=0, init=False)

    def predict(self, chats, labels):
        import hashlib

        out = []
        for c in chats:
            self.seen += 1
            h = int.from_bytes(hashlib.sha256(repr([(m["role"], m["content"]) for m in c]).encode()).digest()[:4], "big")
            scores = {l: -float((h >> i) % 97) for i, l in enumerate(labels)}
            out.append((max(labels, key=scores.get), None, scores) if self.method == "scoring" else (labels[h % len(labels)], labels[h % len(labels)], None))
        return out


@dataclass
class StubEncoder:
    """An encoder without a model: hashed counts of words, at unit length."""

    dim: int = 64

    def encode(self, texts):
        import hashlib
        import math

        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in (t or "").lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v[h[0] % self.dim] += 1 if h[1] & 1 else -1
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else [1.0] + v[1:])
        return out


def best_label(scores: Column, labels: list[str]) -> Column:
    """The label of the largest score; of equal ones the first configured."""
    order = F.array(*(F.struct(F.element_at(scores, F.lit(l)).alias("s"), F.lit(-i).alias("i"), F.lit(l).alias("l")) for i, l in enumerate(labels)))
    return F.array_max(order)["l"]


def predict(grid: DataFrame, make: Callable[[], Predictor], labels: list[str], *, strict: bool = True) -> DataFrame:
    """grid with predicted_label, model_output and label_scores from the predictor, in Arrow batches.

    grid: any columns with `prompt`, an array of role and content.  strict: an output that is no label is an error;
    otherwise its predicted_label is null."""
    extra = "predicted_label string, model_output string, label_scores map<string,double>"
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*grid.schema.fields, *_parse_datatype_string(extra).fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            chats = [[dict(m.asDict()) if hasattr(m, "asDict") else dict(m) for m in c] for c in frame["prompt"]]
            found = model.predict(chats, labels)
            names = [l.strip().lower() if l else None for l, _, _ in found]
            bad = [i for i, n in enumerate(names) if n not in labels]
            if strict and bad:
                raise ValueError(f"output {bad[0]} of a batch is no label: {found[bad[0]][1]!r}")
            yield frame.assign(predicted_label=[n if n in labels else None for n in names], model_output=[o for _, o, _ in found], label_scores=[s for _, _, s in found])

    return grid.mapInPandas(run, schema)


def encode(rows: DataFrame, make: Callable[[], Encoder], dim: int, text_col: str = "hard_text") -> DataFrame:
    """rows with a vector of dim values; longest texts first within a partition, as encoders pad to the longest of a batch."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField("vector", ArrayType(FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            vectors = model.encode(frame[text_col].tolist())
            whole = len(vectors) == len(frame) and all(len(v) == dim for v in vectors)
            x = np.array(vectors, np.float64).reshape(len(vectors), -1) if whole else np.empty(0)
            if not whole or not np.isfinite(x).all() or not x.any(1).all():
                raise ValueError(f"the encoder must give {dim} finite values that are not all 0 for every text")
            yield frame.assign(vector=vectors)

    return rows.sortWithinPartitions(F.length(text_col).desc()).mapInPandas(run, schema)


def too_long(rows: DataFrame, most_tokens: int, text_col: str = "hard_text") -> DataFrame:
    """Rows whose text has more white-space tokens than an encoder takes; they would be cut."""
    return rows.withColumn("tokens", F.size(F.split(F.trim(text_col), "(?U)\\s+"))).where(F.col("tokens") > most_tokens)
