"""Text functions as Spark column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unset(x: str | Column) -> Column:
    """Blank texts mean "not set": they become null."""
    return F.nullif(F.trim(_c(x)), F.lit(""))


def tokens(x: str | Column) -> Column:
    """ASCII word tokens of the lower-cased text, repeats included."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit("[a-z0-9_]+"), F.lit(0))


def tokens_any_case(x: str | Column) -> Column:
    """ASCII word tokens matched in either case, then lower-cased."""
    return F.transform(F.regexp_extract_all(_c(x), F.lit("[a-zA-Z0-9_]+"), F.lit(0)), F.lower)


def letter_tokens(x: str | Column, longer_than: int = 1) -> Column:
    """Distinct runs of letters and digits of any script, longer than a length."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(_c(x)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.length(t) > longer_than))


def content_tokens(x: str | Column, stop_words: list[str]) -> Column:
    """Distinct tokens without stop words."""
    return F.array_except(F.array_distinct(tokens(x)), F.lit(stop_words))


def singular(t: Column) -> Column:
    """Plural endings off: ies becomes y, a last s goes unless doubled."""
    return F.when(F.length(t).__gt__(3) & t.endswith("ies"), F.concat(F.substring(t, 1, F.length(t) - 3), F.lit("y"))).when(F.length(t).__gt__(3) & t.endswith("s") & ~t.endswith("ss"), F.substring(t, 1, F.length(t) - 1)).otherwise(t)


#: Endings that a stem loses, the first that fits.
ENDINGS = ("ing", "ed", "es", "s")


def stem(t: Column) -> Column:
    """The word without the first of ENDINGS that it has, if three letters or more stay; a doubled last letter of a stem of three letters or more is undoubled."""
    cut = F.coalesce(*(F.when((F.length(t) > len(e) + 2) & t.endswith(e), F.substring(t, F.lit(1), F.length(t) - len(e))) for e in ENDINGS))
    return F.coalesce(F.when(F.length(cut) >= 3, F.regexp_replace(cut, r"(.)\1$", "$1")), cut, t)


def variants(words: Column) -> Column:
    """Each word with s, ed and ing added."""
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, F.concat(w, F.lit("s")), F.concat(w, F.lit("ed")), F.concat(w, F.lit("ing"))))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def keyword_hit(text: Column, phrase: Column) -> Column:
    """The phrase's words stand in the text in a row, or the stems of all of them do; a phrase without a word is not there."""
    cut = lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))
    have = F.transform(cut(text), stem)
    in_a_row = F.contains(F.concat_ws(" ", cut(text)), F.concat_ws(" ", cut(phrase)))
    return (F.size(cut(phrase)) > 0) & (in_a_row | F.forall(cut(phrase), lambda w: F.array_contains(have, stem(w))))


def normal_answer(x: str | Column) -> Column:
    """Lower case, no ASCII punctuation, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"[!-/:-@\[-`{-~]", ""), r"\s+", " "))


def choice_letter(x: str | Column) -> Column:
    """Choice A-D: after "answer is" or "answer:", else the last one that stands alone; null without any."""
    said = F.upper(F.regexp_extract(_c(x), r"(?i)answer(?:\s+is)?\s*[:\s]\s*\(?([A-D])\b", 1))
    alone = F.regexp_extract_all(_c(x), F.lit(r"\b([A-D])\b"), F.lit(1))
    return F.coalesce(F.nullif(said, F.lit("")), F.when(F.size(alone) > 0, F.element_at(alone, -1)))


def code_fence(x: str | Column) -> Column:
    """What the first fenced block holds, else the whole text."""
    inner = F.regexp_extract(_c(x), r"(?s)```[a-zA-Z]*\n(.*?)```", 1)
    return F.when(inner == "", _c(x)).otherwise(inner)


def says_yes(x: str | Column) -> Column:
    return F.lower(F.trim(_c(x))).startswith("yes")


def json_array_in(x: str | Column) -> Column:
    """The first array of strings found in a text, null where it cannot be read."""
    return F.from_json(F.nullif(F.regexp_extract(_c(x), r"(?s)\[.*\]", 0), F.lit("")), "array<string>")


#: Patterns of names and places in developers' notes.
PATTERNS = {
    "file": r"\b[\w./-]+\.(?:py|md|json|js|ts|tsx|jsx|yaml|yml|toml|sh|txt|cfg|ini|rs|go|java)\b",
    "test": r"\b(?:test_\w+|\w+_test)\b",
    "pascal": r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b",
    "call": r"\b([a-z_][a-z0-9_]+)\s*\(",
    "snake": r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b",
    "constant": r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b",
    "backtick": r"`([^`]+)`",
    "quoted": r"[\"']([^\"']{2,})[\"']",
    "date": r"\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?\b",
}
#: Of these the first group is what is found.
GROUPED = ("call", "backtick", "quoted")


def found(x: str | Column, kind: str, most: int = 8) -> Column:
    """Distinct matches of one of PATTERNS, sorted; at most `most`."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(_c(x), F.lit(PATTERNS[kind]), F.lit(int(kind in GROUPED))))), 1, most)


def percentages(x: str | Column) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(r"[0-9]+(?:\.[0-9]+)?\s?%"), F.lit(0))


def sentences(x: str | Column) -> Column:
    """Cut after . ! or ? before white space and an ASCII capital."""
    return F.split(_c(x), r"(?<=[.!?])\s+(?=[A-Z])")


def amount(x: str | Column) -> Column:
    """First number of a text with thousands commas; a k or m after it multiplies."""
    digits = F.regexp_replace(F.regexp_extract(_c(x), r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*([kKmM]?)", 1), ",", "")
    unit = F.lower(F.regexp_extract(_c(x), r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*([kKmM]?)", 2))
    return F.nullif(digits, F.lit("")).try_cast("double") * F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0)


def whole_number_in(text: Column, number: Column) -> Column:
    """The number stands in the text and no digit touches it."""
    return F.regexp_like(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit("[^0-9]"), number, F.lit("[^0-9]")))


def same_value(a: Column, b: Column) -> Column:
    """Loose equality: yes/no words, numbers within 1e-6, or one text within the other."""
    left, right = F.lower(F.trim(a)), F.lower(F.trim(b))
    truth = lambda v: F.when(v.isin("true", "yes", "1", "on"), True).when(v.isin("false", "no", "0", "off"), False)
    numbers = left.try_cast("double"), right.try_cast("double")
    return F.coalesce(
        F.when(truth(left).isNotNull() & truth(right).isNotNull(), truth(left) == truth(right)),
        F.when(numbers[0].isNotNull() & numbers[1].isNotNull(), F.abs(numbers[0] - numbers[1]) <= 1e-6),
        F.contains(left, right) | F.contains(right, left),
    )


def duration(seconds: str | Column) -> Column:
    """Days, hours, minutes and seconds of a whole number of seconds, largest two units."""
    s = _c(seconds).cast("bigint")
    parts = F.array(
        F.when(s >= 86400, F.concat(F.floor(s / 86400).cast("string"), F.lit("d"))),
        F.when(s % 86400 >= 3600, F.concat(F.floor(s % 86400 / 3600).cast("string"), F.lit("h"))),
        F.when(s % 3600 >= 60, F.concat(F.floor(s % 3600 / 60).cast("string"), F.lit("m"))),
        F.when((s % 60 > 0) | (s == 0), F.concat((s % 60).cast("string"), F.lit("s"))),
    )
    return F.concat_ws(" ", F.slice(F.array_compact(parts), 1, 2))


def logged_at(x: str | Column) -> Column:
    """Timestamps like 2023/05/20 (Sat) 02:21."""
    return F.to_timestamp(F.regexp_replace(_c(x), r"\s*\([A-Za-z]{3}\)\s*", " "), "yyyy/MM/dd HH:mm")


def stable_id(*parts: str | Column) -> Column:
    """24 hexadecimal digits of the SHA-256 of the parts, joined by U+001F."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(_c(p) for p in parts)), 256), 1, 24)


def slug(x: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "-"), F.lit("-"))


def identifier_like(t: Column) -> Column:
    """Has an underscore, a dot between letters, or a capital after a small letter."""
    return F.regexp_like(t, F.lit(r"_|[a-z]\.[a-z]|[a-z][A-Z]"))


#: Number words from zero to nineteen, and the tens.
NUMBER_WORDS = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(20), strict=True)) | dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10), strict=True))


def number_word(x: str | Column) -> Column:
    """Value of digits with commas, or of words such as twenty-five; null for others."""
    table = F.create_map(*(F.lit(v) for pair in NUMBER_WORDS.items() for v in pair))
    parts = F.split(F.lower(F.trim(_c(x))), "[- ]")
    values = F.transform(parts, lambda p: table[p])
    spelled = F.when(F.forall(values, lambda v: v.isNotNull()), F.aggregate(values, F.lit(0), lambda a, v: a + v))
    return F.coalesce(F.regexp_replace(_c(x), ",", "").try_cast("bigint"), spelled.cast("bigint"))


def pascal_suffix(name: str | Column) -> Column:
    """The last part of a name in Pascal case, null for others."""
    return F.nullif(F.regexp_extract(_c(name), r"^(?:[A-Z][a-z0-9]+)+([A-Z][a-z0-9]+)$", 1), F.lit(""))


#: Ways to say that one does not know, and words that deny what follows within three words.
ABSTAINS = r"\b(?:i (?:do not|dont) know|not sure|cannot (?:say|tell|answer)|no (?:information|idea)|unknown)\b"
DENIES = r"\b(?:not|no|never|isnt|wasnt|didnt|doesnt)\b(?: \w+){0,3} "


def answer_outcome(said: Column, truth: Column) -> Column:
    """right if the normal answer holds the truth's, negated if it denies it, abstained, or wrong."""
    a, t = normal_answer(said), normal_answer(truth)
    denied = F.regexp_like(a, F.concat(F.lit(DENIES), F.lit(r"\Q"), t, F.lit(r"\E")))
    return F.when(F.regexp_like(a, F.lit(ABSTAINS)), "abstained").when((t == "") | ~F.contains(a, t), "wrong").when(denied, "negated").otherwise("right")


#: Signs that a question asks for the latest, forms that name what it asks for, and nouns that say too little.
RECENT = r"most recently|most recent|latest"
ASKED_FOR = (r"^what\s+(?:type|kind)\s+of\s+(.+?)\s+did\b", r"^which\s+(.+?)\s+did\b")
GENERIC = "thing things item items object objects gadget gadgets equipment device devices stuff tool tools product products accessory accessories supply supplies gear".split()
ARTICLES = ["of", "one", "a", "an", "the"]


def latest_scope(question: Column, goal: Column) -> Column:
    """(token, phrase, reason) of a question: the noun that it asks for, or why none is taken."""
    q = F.lower(F.regexp_replace(F.trim(question), r"\s+", " "))
    phrase = F.coalesce(*(F.nullif(F.trim(F.regexp_extract(q, p, 1)), F.lit("")) for p in ASKED_FOR))
    phrase = F.when(~F.get(F.split(phrase, " "), F.lit(0)).isin(ARTICLES), phrase)
    head = F.element_at(F.split(phrase, " "), -1)
    reason = (
        F.when(F.coalesce(q, F.lit("")) == "", "no_question").when(goal != "latest", "not_latest_intent").when(~F.regexp_like(q, F.lit(RECENT)), "missing_recency_cue")
        .when(phrase.isNull(), "no_noun_phrase").when(head.isin(GENERIC), "generic_noun")
    )
    return F.struct(F.when(reason.isNull(), head).alias("token"), F.when(reason.isNull() | (reason == "generic_noun"), phrase).alias("phrase"), reason.alias("reason"))
