"""Ladders of conditions: each is a function that ranks, and all are measured alike.

Extension points are plain functions: a scorer (documents, queries) -> (query_id, doc_id, score), a source of evidence pairs -> evidence rows,
a transform of the corpus, a stratum of a row. `checked` holds a function to its columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[DataFrame, DataFrame], DataFrame]
Evidence = Callable[[DataFrame], DataFrame]
Transform = Callable[[DataFrame], DataFrame]

SCORED = {"query_id", "doc_id", "score"}
RANKED = {"query_id", "doc_id", "rank"}


def checked(rows: DataFrame, columns: set[str], name: str) -> DataFrame:
    if missing := columns - set(rows.columns):
        raise ValueError(f"{name} gives no {', '.join(sorted(missing))}")
    return rows


def ladder(conditions: dict[str, Callable[[], DataFrame]], mode: str | None = None) -> DataFrame:
    """(condition, [mode,] query_id, doc_id, rank) of all conditions; each function gives a ranking."""
    out = None
    for name, run in conditions.items():
        rows = checked(run(), RANKED, name).select(F.lit(name).alias("condition"), *([F.lit(mode).alias("mode")] if mode else []), "query_id", "doc_id", "rank")
        out = rows if out is None else out.unionByName(rows)
    return out


def over_modes(corpora: dict[str, Transform], corpus: DataFrame, run: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """A ladder run over several views of a corpus; run(view, mode) gives a ladder's rows."""
    out = None
    for mode, view in corpora.items():
        rows = run(corpus.transform(view), mode)
        out = rows if out is None else out.unionByName(rows)
    return out
