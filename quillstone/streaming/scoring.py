"""Scoring a stream of vectors, an extension: the rows of a readStream under fitted Gaussian states, stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.gaussian import score_rows


def score_stream(rows: DataFrame, states: dict[int, dict]) -> DataFrame:
    """(id, model, name, value) of streamed rows (id, model, x); nothing is kept between batches."""
    return score_rows(rows, states)
