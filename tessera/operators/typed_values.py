"""Typed values that sentences state, their slots and clusters, corrections, labels and counts folded from changes.

`spans` finds values with their places in a sentence: patterns are taken by priority and a match that overlaps one already taken is
dropped, which needs places, so it runs as an Arrow function over batches of sentences. All that follows are joins, groups and windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NUMBER_WORDS, stable_id
from .sizes import small_side

#: Units and patterns of each kind, by priority.
NUMBER = r"(?:\d[\d,]*(?:\.\d+)?|" + "|".join(sorted([*NUMBER_WORDS, *(f"{t}-{o}" for t, n in NUMBER_WORDS.items() if n >= 20 for o, k in NUMBER_WORDS.items() if 0 < k < 10)], key=lambda w: (-len(w), w))) + ")"
RANGE = rf"\b(?P<start>{NUMBER})(?:\s*[-–]\s*(?P<end>{NUMBER}))?\s+"
DURATION_UNITS = "seconds?|minutes?|hours?|days?|weeks?|months?|years?"
MEASUREMENT_UNITS = "ounces?|pounds?|grams?|kilograms?|miles?|kilometers?|feet|foot|inches?|cups?|tablespoons?|teaspoons?|percent(?:age)?"
COUNT_UNITS = "restaurants?|titles?|pages?|sessions?|films?|movies?|wears?|times?|episodes?|videos?|points?|coins?|nights?|engineers?|bikes?|recipes?|stories?|postcards?|followers?|issues?|classes?|items?|books?|songs?|attempts?|visits?|runs?|ones?"
KINDS = [
    ("boolean", r"\b(?P<word>do not have|don't have|no longer have|have|own)(?=\s+(?:an?\s+)?(?:spare|extra|backup)\b)"),
    ("status", r"\b(?P<word>finished|completed|put down(?=(?:\s+\S+){0,8}\s+temporarily\b))\b"),
    ("money", r"(?<!\w)\$(?P<start>\d[\d,]*(?:\.\d{1,2})?)\b"),
    ("clock_time", r"(?<!\d)(?P<hour>1[0-2]|0?[1-9]):(?P<minute>[0-5]\d)\s*(?P<half>[ap]\.?m\.?)\b"),
    ("frequency", rf"\b(?:(?P<start>{NUMBER})\s+times?\s+(?:a|an|per)\s+(?P<period>day|week|month|year)|(?P<word>once|twice)\s+(?:a|an|per)\s+(?P<period2>day|week|month|year)|(?P<every>every\s+other\s+(?:day|week|month|year)|daily|weekly|monthly|yearly))\b"),
    ("weekday", r"\b(?P<word>Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)\b"),
    ("duration", rf"{RANGE}(?P<unit>{DURATION_UNITS})\b"),
    ("measurement", rf"{RANGE}(?P<unit>{MEASUREMENT_UNITS})\b"),
    ("count", rf"{RANGE}(?:(?:[A-Za-z][\w'-]*\s+){{0,3}}?)(?P<unit>{COUNT_UNITS})\b"),
    ("count", rf"\b(?P<unit>pages?|points?|episodes?|videos?|titles?)\s+(?P<start>{NUMBER})\b"),
]
ASKING = r"\b(?:do|does|did|can|could|would|will)\s+(?:i|we|you|they|he|she)(?:\s+\w+){0,2}\s*$"
UNITS = {"money": "USD", "clock_time": "local_time", "weekday": "weekday"}
EVERY = {"daily": "1/day", "weekly": "1/week", "monthly": "1/month", "yearly": "1/year"}
#: Marks of a correction, looked for 40 characters before a value and 24 after it.
PRESENT = r"(?i)\b(now|currently|nowadays|these days|so far|to date|as of now|at this point|anymore|updated to|changed to|up to)\b"
PAST = r"(?i)\b(used to|previously|originally|back then|at first|earlier|formerly|no longer|last year|last month|to begin with)\b"
NOT_BEFORE = r"(?i)\bnot\b[\s\w]{0,12}$"
BEFORE, AFTER = 40, 24
#: The state that a verb reports; those of owning only where no other verb stands.
VERBS = {
    "watched": "watched", "watch": "watched", "watching": "watched", "read": "read", "reading": "read", "completed": "completed", "complete": "completed", "finished": "completed", "own": "owned", "owned": "owned", "have":
    "owned", "has": "owned", "had": "owned", "got": "owned", "added": "owned", "collect": "owned", "collecting": "owned", "sold": "sold", "sell": "sold", "selling": "sold", "lost": "lost", "lose": "lost", "losing": "lost",
    "spent": "spent", "spend": "spent", "spending": "spent", "tried": "tried", "try": "tried", "trying": "tried", "making": "tried", "made": "tried", "worn": "worn", "wore": "worn", "wear": "worn", "wearing": "worn",
    "attended": "attended", "attend": "attended", "attending": "attended", "played": "played", "play": "played", "playing": "played", "earned": "earned", "earn": "earned", "earning": "earned", "woke": "wake", "wake": "wake",
    "waking": "wake", "dedicate": "dedicated", "dedicated": "dedicated", "dedicating": "dedicated", "sticking": "sticking", "stick": "sticking",
}
#: Words that say nothing about which series a value belongs to.
STOP = [
    "a", "an", "and", "are", "did", "do", "does", "for", "have", "how", "i", "in", "is", "it", "me", "my", "of", "on", "or", "our", "that", "the", "their", "them", "they", "this", "to", "was", "we", "were", "what", "when",
    "where", "which", "who", "with", "you", "your",
]
NOISE = [
    "hundred", "thousand", "million", "dozen", "couple", "am", "pm", "at", "now", "currently", "current", "recently", "already", "just", "still", "again", "actually", "really", "pretty", "lately", "nowadays", "today",
    "yesterday", "tomorrow", "far", "new", "also", "these", "those", "this", "ever", "since", "ago", "around", "about", "roughly", "approximately", "only", "even", "quite", "very", "much", "many", "some", "few", "more",
    "less", "most", "least", "then", "here", "while", "per", "each", "every", "average", "usually", "often", "sometimes", "always", "local", "been", "being", "up", "out", "down", "over", "back", "get", "go", "going", "gone",
    "day", "week", "month", "year", "used", "previously", "originally", "formerly", "longer", "once", "first", "last", "next", "recent", "anymore", "updated", "changed", "so", "by", "way",
]
HOLDERS = [
    "collection", "list", "game", "routine", "series", "app", "tracker", "total", "one", "ones", "thing", "things", "time", "times", "piece", "pieces",
]
ALIAS = {"movie": "film"}
#: Phrases that add to or take from a count; the first that fits a place.
FEW = r"\d+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve"
CHANGES = [
    (1, r"\b(?:added|acquired|purchased|bought|picked up|got)\s+(?:a|an|another|one)\s+(?:new\s+|extra\s+|other\s+)?(?P<noun>[a-z]+)"),
    (-1, rf"\b(?:sold|lost|gave away|got rid of|donated|removed)\s+(?P<n>{FEW}|a|an|one)\s+(?P<noun>[a-z]+)"),
    (1, rf"\b(?P<n>{FEW})\s+(?:more|additional|extra)\s+(?P<noun>[a-z]+)"),
]
SPANS = "array<struct<kind: string, start: int, stop: int, display: string, value: string, low: double, high: double, unit: string>>"
DELTAS = "array<struct<amount: int, noun: string, phrase: string>>"


def number(raw: str) -> float:
    """Value of digits with commas or of number words."""
    text = raw.lower().replace(",", "").replace(" ", "-")
    return float(text) if text[0].isdigit() else float(sum(NUMBER_WORDS[w] for w in text.split("-")))


def plain(x: float) -> str:
    return str(int(x)) if x == int(x) else str(x)


def normal(kind: str, m: re.Match) -> tuple[str, float | None, float | None, str | None]:
    """Normal text, numbers and unit of a match."""
    g = m.groupdict()
    if kind == "boolean":
        return str(not ("not" in g["word"].lower() or "n't" in g["word"].lower() or "no longer" in g["word"].lower())).lower(), None, None, None
    if kind == "status":
        return "paused" if g["word"].lower().startswith("put") else "finished", None, None, None
    if kind == "clock_time":
        return f"{int(g['hour']) % 12 + (12 if g['half'].lower().startswith('p') else 0):02d}:{g['minute']}", None, None, UNITS[kind]
    if kind == "weekday":
        return g["word"].lower(), None, None, UNITS[kind]
    if kind == "frequency":
        period = g["period"] or g["period2"]
        if period:
            n = number(g["start"]) if g["start"] else {"once": 1.0, "twice": 2.0}[g["word"].lower()]
            return f"{plain(n)}/{period.lower()}", n, None, period.lower()
        every = g["every"].lower()
        return EVERY.get(every, re.sub(r"\s", "_", every)), None, None, every.rsplit(maxsplit=1)[-1]
    low = number(g["start"])
    high = number(g["end"]) if g.get("end") else None
    return plain(low) if high is None else f"{plain(low)}-{plain(high)}", low, high, UNITS.get(kind) or g["unit"].lower()


def _taken(sentence: str, patterns: list) -> Iterator[tuple[object, re.Match]]:
    """Matches by priority that overlap none before them."""
    taken: list[tuple[int, int]] = []
    for tag, pattern, refuse in patterns:
        for m in pattern.finditer(sentence):
            if not (refuse and refuse.search(sentence[: m.start()])) and all(m.end() <= a or m.start() >= b for a, b in taken):
                taken.append(m.span())
                yield tag, m


def _patterns() -> list:
    return [(k, re.compile(p, re.I), re.compile(ASKING, re.I) if k == "boolean" else None) for k, p in KINDS]


def _change_patterns() -> list:
    return [((s, "(?P<n>" in p), re.compile(p, re.I), None) for s, p in CHANGES]


def values_in(text: str | None, patterns: list) -> list[tuple]:
    """(kind, start, stop, display, value, low, high, unit) of a sentence's values."""
    return [(k, m.start(), m.end(), m[0], *normal(k, m)) for k, m in _taken(text or "", patterns)]


def changes_in(text: str | None, patterns: list) -> list[tuple]:
    """(amount, noun, phrase) of the changes of counts that a sentence tells."""
    out = []
    for (sign, counted), m in _taken(text or "", patterns):
        n = (1 if m["n"].lower() in ("a", "an") else int(number(m["n"]))) if counted else 1
        if n:
            out.append((sign * n, m["noun"].lower(), m[0]))
    return out


def spans(sentence: Column) -> Column:
    """Array of the values of a sentence: kind, place, as it stands, normal text, numbers, unit."""

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        patterns = _patterns()
        return texts.map(lambda t: values_in(t, patterns), na_action=None)

    return found(sentence)


def deltas(sentence: Column) -> Column:
    """Array of the changes of counts that a sentence tells: signed amount, noun, phrase."""

    @F.pandas_udf(DELTAS)
    def found(texts: pd.Series) -> pd.Series:
        patterns = _change_patterns()
        return texts.map(lambda t: changes_in(t, patterns), na_action=None)

    return found(sentence)


#: A sentence without any of these states no value: digits, words of numbers, and the words that the patterns of other kinds begin with.
MAY_STATE = r"(?i)\d|\b(?:have|own|finished|completed|put down|once|twice|every other|daily|weekly|monthly|yearly|\w+day|" + "|".join(NUMBER_WORDS) + r")\b|(?:" + "|".join(w for w, n in NUMBER_WORDS.items() if n >= 20) + ")-"


def stated(rows: DataFrame, sentence: str) -> DataFrame:
    """Adds, for each value that a row's sentence states, found (its number) and v (the value): sentences that may state one are read once each, and joined back."""
    some = rows.where(F.regexp_like(sentence, F.lit(MAY_STATE))).select(F.col(sentence).alias("_s")).distinct()
    read = some.select("_s", F.posexplode(spans(F.col("_s"))).alias("found", "v"))
    return rows.join(read, F.col(sentence) == F.col("_s")).drop("_s")


def singular(t: Column) -> Column:
    """ies becomes y in words of five letters or more; a last s goes from words of four or more, unless doubled."""
    n = F.length(t)
    return F.when((n > 4) & t.endswith("ies"), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y"))).when((n > 3) & t.endswith("s") & ~t.endswith("ss"), F.substring(t, F.lit(1), n - 1)).otherwise(t)


def alias(t: Column) -> Column:
    return F.coalesce(*(F.when(t == a, b) for a, b in ALIAS.items()), t)


def assertions(turns: DataFrame, namespace: str, session: str, turn: str, text: str) -> DataFrame:
    """A row for each value of each sentence of a namespace's turns: sentence, span, ids, slot, and ordinal in order of session, turn, sentence and place."""
    cut = turns.select(F.col(namespace).alias("namespace"), F.col(session).alias("session"), F.col(turn).alias("turn"), F.posexplode(F.split(text, r"(?<=[.!?])\s+|\n+")).alias("n", "sentence"))
    cut = cut.withColumn("sentence", F.trim("sentence")).where("sentence <> ''")
    rows = stated(cut, "sentence").select("namespace", "session", "turn", "n", "found", "sentence", "v.*")
    marker = F.concat(F.coalesce("unit", F.lit("value")), F.lit(" <"), "kind", F.lit(">"))
    subject = F.trim(F.regexp_replace(F.concat(F.substring("sentence", F.lit(1), F.col("start")), marker, F.substring(F.col("sentence"), F.col("stop") + 1, F.lit(1 << 30))), r"\s+", " "))
    rows = rows.withColumn("subject", subject).withColumn("subject_id", stable_id("namespace", F.lit("subject"), F.lower("subject")))
    place = F.struct("session", "turn", "n", "found")
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("namespace").orderBy(place)).cast("bigint"))


def superseded(rows: DataFrame) -> DataFrame:
    """Adds superseded_by (the ordinal of the slot's next assertion) and current: a slot is a subject, kind and unit."""
    later = F.lead("ordinal").over(Window.partitionBy("namespace", "subject_id", "kind", F.coalesce("unit", F.lit(""))).orderBy("ordinal"))
    return rows.withColumn("superseded_by", later).withColumn("current", F.col("superseded_by").isNull())


def marked(rows: DataFrame) -> DataFrame:
    """Adds past and present: what stands around the value says that it was, or that it is now."""
    before = F.substring(F.col("sentence"), F.greatest(F.lit(0), F.col("start") - BEFORE) + 1, F.least(F.col("start"), F.lit(BEFORE)))
    around = F.concat(before, F.lit(" "), F.substring(F.col("sentence"), F.col("stop") + 1, F.lit(AFTER)))
    past = F.regexp_like(around, F.lit(PAST)) | F.regexp_like(before, F.lit(NOT_BEFORE))
    return rows.withColumn("past", past).withColumn("present", F.regexp_like(around, F.lit(PRESENT)) & ~F.col("past"))


def attribute(words: Column) -> Column:
    """The state that the words report: on_list for lists, else that of the first verb other than owning, else of the first verb."""
    family = F.create_map(*(F.lit(x) for pair in VERBS.items() for x in pair))
    states = F.array_compact(F.transform(words, lambda w: F.try_element_at(family, w)))
    special = F.filter(states, lambda s: s != "owned")
    return F.when(F.array_contains(words, "list"), "on_list").otherwise(F.coalesce(F.try_element_at(special, F.lit(1)), F.try_element_at(states, F.lit(1)), F.lit("")))


def clustered(rows: DataFrame, coarse: bool = False) -> DataFrame:
    """Adds cluster: one text for attribute, content words, kind and unit (coarse: the counted noun in place of the words), and noun."""
    words = F.regexp_extract_all(F.lower("sentence"), F.lit("[a-z0-9]+"), F.lit(0))
    unit = singular(F.lower(F.coalesce("unit", F.lit(""))))
    noun = alias(F.when(F.lower(F.coalesce("unit", F.lit(""))).isin("usd", "local_time", "weekday"), "").otherwise(unit))
    bucket = F.when(F.col("kind").isin("duration", "measurement", "frequency"), F.lower(F.coalesce("unit", F.lit("")))).otherwise("")
    drop = sorted({*STOP, *NOISE, *HOLDERS, *VERBS, *NUMBER_WORDS})
    content = F.filter(F.transform(F.array_except(words, F.lit(STOP)), singular), lambda t: ~t.isin(drop))
    content = F.filter(content, lambda t: ~F.regexp_like(t, F.lit("^[0-9]+$")))
    scope = F.array_sort(F.array_distinct(F.filter(F.array_append(F.transform(content, alias), noun), lambda t: t != "")))
    key = F.concat_ws("|", attribute(words), F.lit("") if coarse else F.concat_ws(" ", scope), "kind", bucket, noun if coarse else F.lit(""))
    return rows.withColumn("noun", noun).withColumn("cluster", key)


def labelled(rows: DataFrame) -> DataFrame:
    """Adds label for clusters with several displays: where some are past and one distinct value survives, current and superseded; else candidate. Others have none."""
    by = ["namespace", "cluster"]
    told = rows.groupBy(*by).agg(F.count_distinct("display").alias("_displays"), F.bool_or("past").alias("_rejected"), F.count_distinct(F.when(~F.col("past"), F.col("display"))).alias("_left"))
    label = F.when(F.col("_displays") <= 1, F.lit(None)).when(F.col("_rejected") & (F.col("_left") == 1), F.when(F.col("past"), "superseded").otherwise("current")).otherwise("candidate")
    return rows.join(told, by).withColumn("label", label).drop("_displays", "_rejected", "_left")


def chosen(rows: DataFrame) -> DataFrame:
    """Adds picked (the assertion of its cluster that holds now) and last_before (the latest of all others)."""
    by = Window.partitionBy("namespace", "cluster")
    pool = ~F.col("past") | ~F.bool_or(~F.col("past")).over(by)
    rows = rows.withColumn("_pool", pool)
    order = by.orderBy(F.desc("_pool"), F.desc("present"), F.desc("ordinal"))
    rows = rows.withColumn("picked", F.row_number().over(order) == 1)
    return rows.withColumn("last_before", ~F.col("picked") & (F.col("ordinal") == F.max(F.when(~F.col("picked"), F.col("ordinal"))).over(by))).drop("_pool")


def stale_displays(rows: DataFrame) -> DataFrame:
    """(namespace, kind, display) of values that hold no longer and that no current value shows."""
    low = rows.withColumn("display", F.lower("display"))
    return low.where("NOT picked").select("namespace", "kind", "display").distinct().join(low.where("picked").select("namespace", "display").distinct(), ["namespace", "display"], "left_anti")


def counts_folded(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """(namespace, noun, anchor, change, total): one stated count and the changes of its noun from then on.

    Silent where several counts are stated, there is no change or none in all, the total is negative, or it was stated itself. Years are no counts, and
    neither are amounts that a change names. changes: namespace, session, turn, sentence, amount, noun.
    """
    key = ["namespace", "noun"]
    years = F.concat(F.lit(r"(?i)(?:pre-?|post-?|since\s+|before\s+|after\s+|in\s+|circa\s+)"), F.col("value"), F.lit(r"\b"))
    stated = rows.where((F.col("kind") == "count") & (F.col("noun") != ""))
    from_change = changes.select("namespace", "sentence").distinct()
    anchors = stated.where(F.col("high").isNull() & (F.col("low") == F.floor("low")) & ~F.regexp_like("sentence", years)).join(from_change, ["namespace", "sentence"], "left_anti")
    one = anchors.groupBy(*key).agg(F.min("low").alias("anchor"), F.count_distinct("low").alias("n"), F.min(F.struct("session", "turn")).alias("since")).where("n = 1")
    named = changes.withColumn("noun", alias(singular(F.col("noun"))))
    total = named.join(one, key).where(F.struct("session", "turn") >= F.col("since")).groupBy(*key, "anchor").agg(F.sum("amount").alias("change")).where("change <> 0")
    out = total.withColumn("total", F.col("anchor") + F.col("change")).where("total >= 0")
    said = anchors.select(*key, F.col("low").alias("total")).union(stated.where(F.col("high").isNotNull()).select(*key, F.explode(F.array("low", "high"))))
    return out.join(said.distinct(), [*key, "total"], "left_anti").select(*key, "anchor", "change", "total")


def recalled(rows: DataFrame, asked: DataFrame, limit: int = 4) -> DataFrame:
    """(query_id, sentence, score, rank): assertions by ten times the shared words, eight for a kind that is asked for, two for current ones, later ones first; each sentence once.

    asked: namespace, query_id, words (array), kinds (array).
    """
    words = F.transform(F.array_except(F.regexp_extract_all(F.lower(F.concat_ws(" ", "subject", "sentence")), F.lit("[a-z0-9]+"), F.lit(0)), F.lit(STOP)), singular)
    pairs = rows.withColumn("_w", words).join(asked, "namespace")
    overlap = F.size(F.array_intersect("_w", "words"))
    score = 10.0 * overlap + F.when(F.array_contains("kinds", F.col("kind")), 8.0).otherwise(0.0) + F.when(F.col("current"), 2.0).otherwise(0.0) + F.col("ordinal") / 1e6
    best = pairs.groupBy("query_id", "sentence").agg(F.max(F.round(score, 6)).alias("score")).where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "sentence")
    return best.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= limit)


def with_values(recalled_rows: DataFrame, typed: DataFrame, stale: DataFrame, cap: int) -> DataFrame:
    """(query_id, snippet, rank): typed snippets first, then recalled ones that repeat none and hold no stale display as a whole word, up to a cap. stale: query_id, display."""
    word = F.concat(F.lit(r"(?i)(?<!\w)\Q"), "display", F.lit(r"\E(?!\w)"))
    hit = recalled_rows.join(stale, "query_id").where(F.regexp_like("snippet", word)).select("query_id", "snippet").distinct()
    rest = recalled_rows.join(hit, ["query_id", "snippet"], "left_anti")
    rows = typed.select("query_id", "snippet", F.struct(F.lit(0).alias("l"), F.col("rank").cast("bigint").alias("r")).alias("_at")).unionByName(rest.select("query_id", "snippet", F.struct(F.lit(1).alias("l"), F.col("rank").cast("bigint").alias("r")).alias("_at")))
    first = rows.groupBy("query_id", "snippet").agg(F.min("_at").alias("_at"))
    return first.select("query_id", "snippet", F.row_number().over(Window.partitionBy("query_id").orderBy("_at")).cast("bigint").alias("rank")).where(F.col("rank") <= cap)


def regrouped(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Clusters by stated rules (pattern, label) where one fits the sentence (the first by label), else as they are."""
    key = ["namespace", "ordinal"]
    named = rows.select(*key, "sentence").join(small_side(rules), F.contains(F.lower("sentence"), F.lower("pattern"))).groupBy(*key).agg(F.min("label").alias("_label"))
    return rows.join(named, key, "left").withColumn("cluster", F.coalesce("_label", "cluster")).drop("_label")
