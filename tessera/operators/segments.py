"""How turns of a conversation are taken in: skipped, kept as context, taken whole or cut into claims. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences

#: Signals of facts in a message.
CORRECTION = r"(?i)\b(?:actually|instead|no longer|not anymore|now (?:that|I|we|she|he|they|it)|used to|again|turns out|changed|anymore|switched|rather than)\b"
CORRECTION_WITHOUT_AGAIN = CORRECTION.replace("again|", "")
STATE = r"(?i)\b(?:moved|changed|started|stopped|switched|left|quit|joined|bought|sold|married|divorced|graduated|retired|promoted|transferred|adopted|resigned|relocated|enrolled|dropped)\b"
POSSESSIVE = r"(?i)\bmy\s+(?:[A-Za-z][\w'-]*\s+){0,2}(?:is|are|was|were|has|have|had|became|becomes|will\s+be|uses|used|likes|liked|prefers|preferred|works|worked|lives|lived|goes|went|owns|owned|needs|needed|wants|wanted|takes|took|makes|made|says|said|keeps|kept|runs|ran|costs|cost|starts|started|stops|stopped|moves|moved|switched|switches)\b"
PRESUPPOSED = r"(?i)\b(?:why|when|where|how)\s+(?:did|do|does|has|have|had)\s+(?:i|we|he|she|they|my\s+[A-Za-z][\w'-]*)\s+(?:[A-Za-z][\w'-]*\s+){0,2}(?:move|change|start|stop|switch|leave|quit|join|buy|sell|marry|divorce|graduate|retire|transfer|adopt|resign|relocate|enroll|drop)\w*\b"
FREQUENCY = r"(?i)\b(?:one|two|three|four|five|six|seven|eight|nine|ten|once|twice|a|an|\d+)\s+times?\s+(?:a|an|per|each|every)\s+(?:day|week|month|year|morning|evening|night|session|visit)\b|\b(?:every|each)\s+(?:other\s+)?(?:day|week|month|year|morning|evening|night)\b|\b(?:daily|weekly|monthly|yearly|nightly|hourly)\b"
QUANTITY = r"(?i)(?:\$\s*\d|\b\d[\d,]*(?:\.\d+)?\s*(?:%|percent|dollars?|k\b|hours?|minutes?|days?|weeks?|months?|years?|miles?|km|kg|lbs?|pounds?)\b)"
NUMBERS = r"\$?\d[\d,]*(?:\.\d+)?(?:\s*(?:hours?|minutes?|times?|days?|weeks?|months?|years?))?"
PLACES = r"\b(?:in|to|from|at|near|around)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
SUBJECTS = r"(?:^|[.!?]\s+)(?:My\s+(?:friend|sister|brother|mom|dad|wife|husband|partner)\s+)?([A-Z][a-z]{2,})"
STARTERS = [
    "The", "This", "That", "These", "Those", "What", "Where", "When", "How", "Why", "Which", "Who", "Here", "There", "Some", "Many", "Most", "Any", "Each", "Every", "Both", "All", "One", "Two", "Can", "Could", "Would",
    "Should", "Will", "May", "Might", "For", "And", "But", "Also", "Yes", "Yeah", "Sure", "Thanks", "Great", "Good", "Got", "Nice", "Sounds", "Let", "Did", "Does", "Was", "Were", "Are", "Has", "Have", "Had", "Shall", "Must",
    "Okay", "Well", "Just", "Please", "Actually", "Maybe", "Perhaps", "Right",
]
PHATIC = [
    "a", "about", "absolutely", "again", "agreed", "alright", "all", "also", "am", "amazing", "and", "any", "anyway", "appreciate", "are", "as", "awesome", "be", "been", "brilliant", "but", "cheers", "cool", "definitely",
    "do", "does", "enough", "exactly", "excellent", "fair", "fantastic", "fine", "for", "get", "glad", "good", "got", "great", "haha", "have", "hear", "hello", "help", "helpful", "hey", "hi", "hmm", "how", "i", "idea", "if",
    "in", "indeed", "interesting", "is", "it", "just", "know", "let", "like", "lol", "lot", "love", "makes", "many", "me", "much", "my", "neat", "nice", "no", "noted", "of", "ofcourse", "oh", "ok", "okay", "one", "perfect",
    "please", "point", "really", "right", "same", "see", "sense", "so", "sorry", "sound", "sounds", "sure", "team", "thank", "thanks", "that", "the", "then", "there", "these", "think", "this", "those", "thx", "to", "too",
    "true", "try", "understood", "very", "well", "what", "when", "will", "wonderful", "work", "works", "wow", "yeah", "yep", "yes", "you", "your", "yup", "that's",
]
MOST_PHATIC_WORDS = 8
CLAUSES = r"\s*(?:[,;:]|--|—)\s*|\s+(?:and|but|so|then|though|although)\s+"
ASKS = r"(?i)^(?:and|but|so|or|also)?\s*(?:what|when|where|why|how|which|who|whom|whose|can|could|would|should|will|shall|may|might|must|do|does|did|is|are|was|were|have|has|had|any|anyone|anybody)\b"
FIRST_PERSON = r"(?i)\b(?:I|I'm|I've|I'll|I'd|we|we're|we've|we'll|we'd|my|mine|our|ours)\b"
DURABLE = r"(?i)\bI\s+(?:live|work|have|own|prefer|like|love|want|need|plan|moved|started|stopped|quit|joined|left|bought|sold|got|adopted|enrolled|graduated|retired|completed|wrote|finished|built|created|made|recently|just|finally|decided|chose|picked|applied|signed up|scheduled|booked|reserved|ordered)\b"
REACTIVE = r"(?i)\bI\s+(?:think|agree|see|understand|suppose|imagine|guess|feel like|like (?:the |that |this |it)|wonder|hope|bet|mean|appreciate|enjoy (?:the |that |this ))\b"
REACTIVE_CLAUSE = r"(?i)^(?:and|but|so|also|well|ok|okay|yeah|yes|sure)?\s*(?:I\s+(?:agree|see|understand|appreciate)\b(?:\s+(?:that|this|it))?\s*[.!]?$|I\s+(?:think|thought|suppose|guess|bet|mean|imagine|assume|figured|believe)\s+(?:that|this|it|so|the\s+(?:idea|plan|approach)|.*\bsounds?\b)|I\s+was\s+wondering\b|I'?m\s+(?:curious|wondering|not\s+sure|glad|sorry|excited\s+to\s+hear)\b|I'?d\s+(?:love|like)\s+to\s+(?:know|hear)\b|I\s+see\b)"
ASSISTANT = r"(?i)\b(?:I(?:'ve| have) (?:scheduled|booked|reserved|ordered|created|set up|configured|deployed|committed|pushed|merged|installed)|(?:your|the) (?:appointment|reservation|booking|order|subscription|membership|account|profile|settings?) (?:is|are|has been|was)|I(?:'ll| will) (?:remember|note|keep track|make a note)|(?:confirmed|completed|finished|done|approved|accepted|rejected|denied|cancelled))\b"
SHORT_CHARS, SHORT_SENTENCES = 300, 3


def _like(x: Column, pattern: str) -> Column:
    return F.regexp_like(x, F.lit(pattern))


def _all(x: Column, pattern: str, group: int = 0) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(pattern), F.lit(group)))


def _real(text: Column) -> Column:
    return F.filter(F.transform(sentences(text), lambda s: F.trim(s)), lambda s: s != "")


def subjects(text: Column) -> Column:
    """Capitalised words that begin a sentence and are no common opener."""
    return F.array_except(_all(text, SUBJECTS, 1), F.lit(STARTERS))


def corrects(text: Column) -> Column:
    """A mark of correction; "again" in a text that thanks is none."""
    return _like(text, CORRECTION_WITHOUT_AGAIN) | (_like(text, r"(?i)\bagain\b") & ~_like(text, r"(?i)\bthank"))


def _telling(text: Column, test) -> Column:
    """Whether a clause that asks nothing passes a test."""
    clauses = lambda s: F.filter(F.transform(F.split(s, CLAUSES), lambda c: F.trim(c)), lambda c: c != "")
    tells = lambda c: ~F.rtrim(c).endswith("?") & ~_like(c, ASKS) & test(c)
    return F.exists(_real(text), lambda s: F.exists(clauses(s), tells))


def durable(text: Column) -> Column:
    """Any sign of a lasting fact, in questions too."""
    some = _telling(text, lambda c: _like(c, DURABLE)) | corrects(text) | (F.size(subjects(text)) > 0)
    for pattern in (STATE, PRESUPPOSED, POSSESSIVE, FREQUENCY, QUANTITY):
        some = some | _like(text, pattern)
    return some


def phatic(sentence: Column) -> Column:
    """Provably without a fact: no sign of one, no digit, no name, and only courtesies, or a short reaction."""
    s = F.trim(sentence)
    words = F.regexp_extract_all(s, F.lit(r"[A-Za-z][A-Za-z'-]*"), F.lit(0))
    named = F.exists(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: _like(w, "^[A-Z]") & (w != "I"))
    courtesy = F.forall(F.transform(words, F.lower), lambda w: w.isin(PHATIC)) | (_like(s, REACTIVE) & (F.size(words) <= MOST_PHATIC_WORDS))
    return F.when(s == "", True).when(durable(s), False).when(F.size(words) == 0, True).when(_like(s, r"\d") | named, False).otherwise(courtesy)


def context_only(text: Column) -> Column:
    """A user's turn that is proven to state nothing."""
    about_self = _telling(text, lambda c: _like(c, FIRST_PERSON) & ~(_like(c, REACTIVE_CLAUSE) & phatic(c)))
    said = F.filter(_real(text), lambda s: ~s.endswith("?"))
    return ~durable(text) & ~about_self & F.forall(said, phatic)


def signals(text: Column) -> Column:
    """Struct of the signs that a message holds several claims."""
    parts = _real(text)
    n = F.size(parts)
    topics = F.transform(sentences(text), lambda s: F.array_union(subjects(s), _all(s, PLACES, 1)))
    shift = lambda i: (F.size(F.get(topics, i)) > 0) & (F.size(F.get(topics, i + 1)) > 0) & ~F.arrays_overlap(F.get(topics, i), F.get(topics, i + 1))
    change = _like(text, CORRECTION) | _like(text, STATE)
    return F.struct(
        n.alias("sentences"), F.length(text).alias("chars"), _like(text, CORRECTION).alias("corrections"), _like(text, STATE).alias("changes"),
        (F.size(_all(text, NUMBERS)) >= 3).alias("numbers"), (F.size(_all(text, PLACES, 1)) >= 2).alias("places"), (F.size(subjects(text)) >= 2).alias("several"),
        ((F.length(text) > 300) & change & (n >= 3)).alias("buried"), ((n >= 3) & F.exists(F.sequence(F.lit(0), F.greatest(F.size(topics) - 2, F.lit(0))), shift)).alias("shift"),
    )


def mode(role: Column, text: Column) -> Column:
    """SKIP, CONTEXT_ONLY, EXTRACT_WHOLE or SEGMENT_CLAIMS."""
    s = signals(text)
    single = (s["sentences"] <= 2) & ~s["corrections"] & ~s["changes"] & ~s["several"]
    long = s["chars"] > 200
    several = s["corrections"] | s["changes"] | s["several"] | s["shift"] | s["buried"] | (s["numbers"] & long) | (s["places"] & long)
    short = (F.length(text) <= SHORT_CHARS) & (F.size(_real(text)) <= SHORT_SENTENCES)
    assistant = F.lower(F.trim(role)) == "assistant"
    return (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "SKIP")
        .when(assistant, F.when(_like(text, ASSISTANT), "EXTRACT_WHOLE").otherwise("CONTEXT_ONLY"))
        .when(context_only(text), "CONTEXT_ONLY")
        .when(short | single, "EXTRACT_WHOLE")
        .when(several, "SEGMENT_CLAIMS")
        .otherwise("EXTRACT_WHOLE")
    )


def claims(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, n, claim, kind, subject, start, stop): the sentences that have a mark of correction (kind state_update) or a change of state (new_fact).

    n is the sentence's place among all, blank ones included; subject the capitalised word that it begins with, if any; places are those of the claim's first occurrence in the text.
    """
    rows = df.select(*key, F.col(text).alias("_t"), F.posexplode(sentences(text)).alias("n", "claim")).withColumn("claim", F.regexp_replace("claim", r"^\s+|\s+$", ""))
    corrected = _like(F.col("claim"), CORRECTION)
    rows = rows.where((F.col("claim") != "") & (corrected | _like(F.col("claim"), STATE)))
    at = F.instr("_t", F.col("claim")) - 1
    return rows.select(*key, "n", "claim", F.when(corrected, "state_update").otherwise("new_fact").alias("kind"), F.regexp_extract("claim", SUBJECTS, 1).alias("subject"), at.alias("start"), (at + F.length("claim")).alias("stop"))


def arm(df: DataFrame, name: str, role: str, text: str) -> DataFrame:
    """Adds pieces: the text as one (none), its sentences (sentence), a user's sentences (user_sentence), or by mode (adaptive); nothing for SKIP."""
    whole, cut = F.array(F.col(text)), _real(F.col(text))
    user = F.lower(F.trim(F.col(role))) == "user"
    m = mode(F.col(role), F.col(text))
    pieces = {"none": whole, "sentence": cut, "user_sentence": F.when(user, cut).otherwise(whole), "adaptive": F.when(m == "SEGMENT_CLAIMS", cut).when(m.isin("EXTRACT_WHOLE", "CONTEXT_ONLY"), whole).otherwise(F.array().cast("array<string>"))}
    return df.withColumn("pieces", pieces[name])
