"""Functions for SQL texts: token measure, category and lines, under names of the caller's session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import plain


class Lines:
    """Rows (line_no from 1, line) of a text; a null text has none."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(text.split("\n"), start=1)


def register(spark: SparkSession) -> list[str]:
    """estimate_tokens(text), truncate_to_tokens(text, budget) and the table function text_lines(text)."""
    from ..operators.budget import truncate

    @F.pandas_udf("long")
    def estimate_tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else plain.tokens(t)).astype("Int64")

    @F.pandas_udf("string")
    def truncate_to_tokens(texts: pd.Series, budgets: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or pd.isna(b) else truncate(t, int(b)) for t, b in zip(texts, budgets)], dtype=object)

    spark.udf.register("estimate_tokens", estimate_tokens)
    spark.udf.register("truncate_to_tokens", truncate_to_tokens)
    spark.udtf.register("text_lines", F.udtf(Lines, returnType="line_no int, line string"))
    return ["estimate_tokens", "truncate_to_tokens", "text_lines"]
