"""Scan of public texts for claims that no active headline backs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import claims
from .scans import MOST, Running, running
from .sizes import small_side

#: Lines read before and after a claim for the product or the phrase.
REACH = 5
#: A headline's product that stands for no headline.
NONE = ("", "none", "_none_")


def active(headlines: DataFrame) -> DataFrame:
    """The headlines (product, claim, value) that count; rows without a product stand for none."""
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    return headlines.select(*(plain(c).alias(c) for c in ("product", "claim", "value"))).where(~F.col("product").isin(*NONE))


def found(lines: DataFrame, file: str, line: str, text: str, marker: str = "claim-scan", most: int = MOST) -> DataFrame:
    """(file, line, claim, ignored, around): claims of the lines outside ignored blocks, and the lines after an ignore-next-line mark, each as a whole, as ignored.

    The mark only records the line after it: claims in that line are found as in any other. around: the lines up to REACH before and after, in lower case. Lines are numbered from 1 without gaps.
    """
    is_ = lambda what: F.regexp_like(F.col(text), F.lit(rf"<!--\s*{marker}:\s*{what}\s*-->"))
    rows = lines.select(file, line, text).withColumn("_start", is_("ignore-start")).withColumn("_end", is_("ignore-end") & ~F.col("_start")).withColumn("_next", is_("ignore-next-line"))
    rows = running(rows, [file], [line], Running("_last", "lasts", F.when(F.col("_start"), True).when(F.col("_end"), False)), most=most)
    rows = rows.withColumn("_read", ~F.coalesce(F.try_element_at("_last", F.lit(1)), F.lit(False)) & ~F.col("_start") & ~F.col("_end"))
    by = Window.partitionBy(file).orderBy(line)
    rows = rows.withColumn("around", F.lower(F.concat_ws(" ", F.collect_list(text).over(by.rowsBetween(-REACH, REACH)))))
    rows = rows.withColumn("_before", F.coalesce(F.lag(F.col("_read") & F.col("_next")).over(by), F.lit(False)))
    read = rows.where(F.col("_read") & ~F.col("_next")).select(file, line, F.explode(claims.claims(F.col(text))).alias("claim"), F.lit(False).alias("ignored"), "around")
    return read.unionByName(rows.where("_before").select(file, line, F.trim(text).alias("claim"), F.lit(True).alias("ignored"), "around"))


def _mentions(text: Column, product: Column) -> Column:
    """Whether a text names a product, or a beginning of it up to a hyphen."""
    parts = F.split(product, "-")
    return F.exists(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("-", F.slice(parts, F.lit(1), n))), lambda p: F.contains(text, p))


def _figures(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: F.regexp_like(t, F.lit(r"\d")))


def judged(found_rows: DataFrame, headlines: DataFrame, file: str, line: str) -> DataFrame:
    """Adds status: ignored, allowed or unapproved. A claim is allowed if its text and a headline's value hold one another or share a figure, and the lines around name the headline's product or phrase."""
    heads = active(headlines).distinct()
    rows = found_rows.withColumn("_id", F.monotonically_increasing_id())
    low = F.lower("claim")
    fits = reduce(or_, (F.contains(low, F.col("_value")), F.contains(F.col("_value"), low), F.arrays_overlap(_figures(low), _figures(F.col("_value")))))
    near = _mentions(F.col("around"), F.col("_product")) | F.contains(F.col("around"), F.col("_phrase"))
    # headlines are a stated table of some rows; each claim is held against all
    backed = rows.where(~F.col("ignored")).crossJoin(small_side(heads.select(F.col("product").alias("_product"), F.col("claim").alias("_phrase"), F.col("value").alias("_value")))).where(fits & near)
    keyed = backed.select(file, line, "claim").distinct().withColumn("_ok", F.lit(True))
    out = rows.drop("_id").join(keyed, [file, line, "claim"], "left")
    return out.withColumn("status", F.when(F.col("ignored"), "ignored").when(F.col("_ok"), "allowed").otherwise("unapproved")).select(file, line, "claim", "status")


def by_file(judged_rows: DataFrame, lines: DataFrame, file: str) -> DataFrame:
    """(file, detected, ignored, unapproved, ok) of every file."""
    n = lambda s: F.count_if(F.col("status") == s)
    sums = judged_rows.groupBy(file).agg(F.count("claim").alias("detected"), n("ignored").alias("ignored"), n("unapproved").alias("unapproved"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return lines.select(file).distinct().join(sums, file, "left").select(file, zero("detected"), zero("ignored"), zero("unapproved")).withColumn("ok", F.col("unapproved") == 0)
