"""Paths, commands and claims in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What paths, commands, wishes to read again and claims look like.
PATH = r"(?i)(?:[A-Z]:\\[^\s`'\"]+)|(?:(?:\.{1,2}|[\w.-]+)[\\/][^\s`'\"]+)|(?:/[\w.\-]+(?:/[\w.\-]+)+)|(?<!\S)\.[A-Za-z0-9_.-]+|(?<!\S)(?:README|Makefile|Dockerfile|LICENSE|AGENTS\.md|pyproject\.toml|package\.json)(?=$|[\s,.;:)\]}])"
COMMAND = r"(?i)(?:npm|pip|python|git|cargo|go|docker|kubectl|make)\s+\S+"
READ_AGAIN = r"(?i)(?:let me (?:re-?read|read|open|check|look at|view|cat|see) |i (?:need to |should )?(?:re-?read|read|open|check|look at|view) |can you (?:re-?read|read|open|show|print|display) |show me (?:the |that |those )?(?:file|content|output|result)s?)"
PERCENT = r"(?:\b(?:about|around|~|approximately|over|under)\s+)?\d+(?:\.\d+)?\s*%"
SCORE = r"(?:score|accuracy|pass@\d+|f1|precision|recall|exact_match|em|bleu|rouge)\s+(?:of\s+)?\d+(?:\.\d+)?\s*%?|\d+\.\d{2,}\s+(?:score|accuracy|f1|precision|recall)"
COMPARED = r"(?:beats?|improves?|reduces?|saves?|cuts?|lowers?|exceeds?|outperforms?|increases?|decreases?|reduction|savings|gain|boost)\s+(?:by\s+)?\d+(?:\.\d+)?\s*%?"
BENCHMARKS = "ruler longbench swe-bench helm agentdojo cyberseceval dmr mteb longmemeval bigcodebench humaneval gsm8k mmlu bbh drop nq triviaqa hotpotqa 2wiki musique".split()
NAMED = rf"(?i)(?:{'|'.join(BENCHMARKS)})\s*[-:;]?\s*\d+(?:\.\d+)?\s*%?|\d+(?:\.\d+)?\s*%?\s+(?:on|in|for)\s+(?:{'|'.join(BENCHMARKS)})"


def paths(x: Column) -> Column:
    """Distinct file paths, without punctuation at their ends."""
    found = F.transform(F.regexp_extract_all(x, F.lit(PATH), F.lit(0)), lambda p: F.regexp_replace(p, r"[.,;)\]}]+$", ""))
    return F.array_distinct(F.filter(found, lambda p: p != ""))


def commands(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(COMMAND), F.lit(0)))


def claims(x: Column) -> Column:
    """Percentages, scores, comparisons and benchmark figures of a line, in this order."""
    return F.transform(F.concat(*(F.regexp_extract_all(x, F.lit(p), F.lit(0)) for p in (PERCENT, SCORE, COMPARED, NAMED))), lambda c: F.trim(c))


def read_lines(lines: DataFrame, group: list[str], order: str, text: str, marker: str = "claim-scan") -> DataFrame:
    """The lines outside <!-- marker: ignore-start --> ... ignore-end --> and not after an ignore-next-line; markers themselves are left out."""
    by = Window.partitionBy(*group).orderBy(order)
    is_ = lambda what: F.regexp_like(F.col(text), F.lit(rf"<!--\s*{marker}:\s*{what}\s*-->"))
    start, end, nxt = is_("ignore-start"), is_("ignore-end"), is_("ignore-next-line")
    last = F.last(F.when(start, True).when(end, False), True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("_open", F.coalesce(last, F.lit(False))).withColumn("_nx", nxt & ~F.col("_open"))
    rows = rows.withColumn("_skip", F.coalesce(F.lag("_nx").over(by), F.lit(False)))
    return rows.where(~F.col("_open") & ~F.col("_skip") & ~F.col("_nx") & ~end).drop("_open", "_nx", "_skip")


def identifier_shape(t: Column) -> Column:
    """snake, dotted, camel or constant case, or a path."""
    return F.regexp_like(t, F.lit(r"^[A-Za-z]\w*(?:_\w+)+$|^[A-Za-z]\w*(?:\.[A-Za-z]\w*)+$|^[a-z]+[A-Z]\w*$|^[A-Z][a-z0-9]+[A-Z]\w*$|/"))


def leaks(question: Column, names: Column) -> Column:
    """Whether a question names one of the identifiers (array) that are to be found."""
    return F.exists(names, lambda n: F.contains(F.lower(question), F.lower(n)) & identifier_shape(n))


def canonical(columns: dict[str, Column]) -> Column:
    """SHA-256 of a JSON text with sorted keys."""
    return F.sha2(F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns)))), 256)
