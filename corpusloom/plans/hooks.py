"""Places for external models: anything callable on a Column; the defaults need none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from ..functions import text

Generator = Callable[[Column], Column]  # answer -> array of paraphrases
Embedder = Callable[[Column], Column]  # text -> array of numbers


def paraphrase(answers: DataFrame, answer: str, positives: Generator = text.rule_positives, negative: Generator = text.rule_negative) -> DataFrame:
    """answers with positives and negative; a model's function takes the place of the rules."""
    return answers.withColumns({"positives": positives(answers[answer]), "negative": negative(answers[answer])})
