"""Queries over the tables, by theme; importing this package registers them."""

from . import checks, corpora, evidence, graphs, history, joins, ladders, ledgers, measures, panels, recall, retrieval, rollups, summaries, turns, values  # noqa: F401
