"""Column expressions over text: counts, cleaning rules, content type, quality, markers.

Patterns are written so that Java's and RE2's engines agree: classes are spelt
out, and multi-line anchors know "\\n" only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split and \\s know it.
WS = r"\t\n\x0B\f\r\x1C-\x1F \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
MULTILINE = "(?md)"


def str_count(text: Column, needle: str) -> Column:
    """Occurrences of a string that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def strip(text: Column) -> Column:
    """Without white space at the ends; a run is tried from its beginning only."""
    return F.regexp_replace(text, f"^[{WS}]+|(?<![{WS}])[{WS}]+$", "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often it is read."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"[{WS}]+", " "))


def words(text: Column) -> Column:
    """Pieces between white space; none for a blank text."""
    return F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "")


def hits(text: Column, needles: list[str]) -> Column:
    """How many of the strings occur in the lower-cased text."""
    return bound(F.lower(text), lambda low: _found(low, needles))


def _found(low: Column, needles: list[str]) -> Column:
    return total([F.contains(low, F.lit(n)).cast("int") for n in needles])


def any_of(text: Column, needles: list[str]) -> Column:
    return hits(text, needles) > 0


# --- content type (fixed values: what is counted, and the thresholds) ---
MATH = ["$", "\\[", "\\(", "\\frac", "\\sum", "\\int", "\\partial", "\\nabla"]
CODE = ["```", "def ", "class ", "import ", "function ", "{"]
PHYSICS = ["alpha", "beta", "gamma", "theta", "omega", "delta", "kg", "m/s", "N/m", "Hz", "rad/s", "deg/s"]
TELEMETRY = ["sensor", "timestamp", "voltage", "current", "temperature", "["]
SCIENTIFIC = rf"{DIGIT}+\.?{DIGIT}*[eE][+-]?{DIGIT}+"
CLOCK = rf"{DIGIT}{{2}}:{DIGIT}{{2}}:{DIGIT}{{2}}"


def content_type(text: Column) -> Column:
    """Struct of is_math, is_code, is_physics, is_telemetry, is_technical."""
    count = lambda needles: total([str_count(text, n) for n in needles])
    sci = F.regexp_count(text, F.lit(SCIENTIFIC))
    math = count(MATH) > 5
    code = (count(CODE) > 3) | F.contains(text, F.lit("```"))
    physics = (count(PHYSICS) + sci > 5) | (sci > 3)
    closing = F.floor(str_count(text, "]") / 10).cast("int")
    telemetry = count(TELEMETRY) + F.regexp_count(text, F.lit(CLOCK)) + closing > 5
    return F.struct(
        math.alias("is_math"), code.alias("is_code"), physics.alias("is_physics"), telemetry.alias("is_telemetry"), (math | code | physics | telemetry).alias("is_technical")
    )


# --- cleaning (fixed values: the patterns, in the order in which they are applied) ---
URL, EMAIL, PHONE = rf"https?://[^{WS}]+", rf"[^{WS}]+@[^{WS}]+", r"\+?[0-9][0-9() .-]{7,}[0-9]"
#: What EMAIL matches is a whole run without white space; this asks each run once.
EMAIL_RUN = rf"(?<![^{WS}])[^{WS}][^{WS}@]*+@[^{WS}]+"
TAG, ENTITY = r"<[^>]+>", r"&[a-zA-Z]+;|&#[0-9]+;"
HYPHEN = rf"({WORD})-[{WS}]*\n[{WS}]*({WORD})"
#: (pattern, replacement, multi-line) in the order in which they are applied to ordinary text.
PAGE_RULES = [
    (HYPHEN, "$1$2", False),
    (rf"^{DIGIT}+[{WS}]*$", "", True),
    (rf"^Page {DIGIT}+.*$", "", True),
    (rf"^{DIGIT}+[{WS}]+of[{WS}]+{DIGIT}+.*$", "", True),
    (rf"^[\p{{Nd}}/-]+[{WS}]*$", "", True),
    (rf"^[A-Z{WS}]{{20,}}$", "", True),
    (rf"\[{DIGIT}+\][{WS}]*\n", " ", False),
    (r"\n{3,}", "\n\n", False),
    (rf"([a-z])[{WS}]+([.,;:)])", "$1$2", False),
    (rf"([(\[])[{WS}]+([a-zA-Z])", "$1$2", False),
    (rf"\$[{WS}]+|[{WS}]+\$", r"\$", False),
    (rf"\|[{WS}-]+\|", " ", False),
    (rf"^[{WS}]*[=-]{{3,}}[{WS}]*$", "", True),
    (rf"[{WS}]+", " ", False),
    (rf"\n[{WS}]+|[{WS}]+\n", "\n", False),
]


#: UTF-8 read as Latin-1: the commonest sequences.
REPAIRS = {"â€™": "’", "â€œ": "“", "â€“": "–", "â€”": "—", "Ã©": "é", "Ã¨": "è", "Ã¼": "ü", "Ã¶": "ö", "Ã¤": "ä", "Ã±": "ñ", "Â ": " "}


def fix_unicode(text: Column) -> Column:
    """Replaces the commonest mis-decoded sequences; other text is left alone."""
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), REPAIRS.items(), text)


def unicode_repairs(text: Column) -> Column:
    """How many sequences :func:`fix_unicode` replaces."""
    return total([str_count(text, bad) for bad in REPAIRS])


def remove_contacts(text: Column, phones: bool | Column = False) -> Column:
    """Links and e-mail addresses go, telephone numbers where asked; white space collapses."""
    out = F.regexp_replace(F.regexp_replace(text, URL, ""), EMAIL_RUN, "")
    if isinstance(phones, Column):
        return collapse(F.when(phones, F.regexp_replace(out, PHONE, "")).otherwise(out))
    return collapse(F.regexp_replace(out, PHONE, "") if phones else out)


#: Common words that tell languages apart, in the order in which equal counts are decided.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "was", "are"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "den", "mit", "dem", "von", "zu"],
    "fr": ["le", "les", "des", "et", "est", "une", "du", "dans", "pas", "qui", "pour", "au"],
    "es": ["el", "los", "las", "una", "por", "con", "para", "del", "y", "es", "no", "se"],
}
#: Characters that the language is told by.
LANGUAGE_CHARS = 500


def language(text: Column) -> Column:
    """The language with most of its common words at the beginning of a text; "en" where none has any, as what can't be told passes."""

    def among(common: list[str]) -> Callable[[Column], Column]:
        return lambda word: word.isin(common)

    found = bound(words(F.lower(F.substring(text, 1, LANGUAGE_CHARS))), lambda w: F.array(*(F.size(F.filter(w, among(s))) for s in STOP_WORDS.values())))
    return bound(found, lambda n: F.element_at(F.array(*map(F.lit, STOP_WORDS)), F.greatest(F.array_position(n, F.array_max(n)), F.lit(1)).cast("int")))


def remove_html(text: Column) -> Column:
    return collapse(F.regexp_replace(F.regexp_replace(text, TAG, " "), ENTITY, " "))


def clean_pages(text: Column, technical: Column) -> Column:
    """Artefacts of paged documents; technical text only loses broken hyphens and blank lines."""
    light = strip(F.regexp_replace(F.regexp_replace(text, HYPHEN, "$1$2"), r"\n{3,}", "\n\n"))
    full = text
    for pattern, by, multi in PAGE_RULES:
        full = F.regexp_replace(full, (MULTILINE if multi else "") + pattern, by)
    return F.when(technical, light).otherwise(strip(full))


def clean(text: Column, technical: Column, mode: str = "faithful") -> Column:
    """The cleaning steps; "intended" treats pages before line breaks are collapsed."""
    if mode == "intended":
        return remove_html(remove_contacts(clean_pages(text, technical), ~technical))
    if mode != "faithful":
        raise ValueError(mode)
    return clean_pages(remove_html(remove_contacts(text, ~technical)), technical)


# --- quality (fixed values) ---
KEYWORDS = [
    "ros2", "ros", "robot", "navigation", "slam", "control", "sensor", "algorithm", "matrix", "vector",
    "calculus", "physics", "python", "function", "class", "import", "package", "node", "topic",
]
FORMAL = ["however", "therefore", "furthermore", "additionally", "consequently", "moreover", "specifically", "particularly", "demonstrates", "indicates"]
INFORMAL = ["lol", "omg", "wtf", "idk", "tbh", "!!!", "..."]
SHORT, LONG, LOW_QUALITY = 100, 50_000, 0.4


def quality(text: Column, technical: Column) -> Column:
    """Heuristic quality from 0 to 1."""
    n = F.length(text)
    d = lambda x: F.lit(float(x))
    sentences = F.split(text, "[.]", -1)
    capitals = F.struct(F.size(sentences).alias("n"), F.size(F.filter(sentences, lambda s: s.rlike(rf"^[{WS}]*\p{{Lu}}"))).alias("capital"))
    found = bound(F.lower(text), lambda low: F.struct(*(_found(low, x).alias(c) for c, x in (("keywords", KEYWORDS), ("formal", FORMAL), ("informal", INFORMAL)))))

    def score(x: Column) -> Column:
        sentence, hit = x["sentence"], x["hit"]
        tone = (
            F.when((sentence["n"] > 2) & (sentence["capital"] / sentence["n"] > 0.7), d(0.05)).otherwise(d(0))
            + F.when(str_count(text, ".") + str_count(text, "!") + str_count(text, "?") > 2, d(0.05)).otherwise(d(0))
            + F.when(hit["formal"] >= 2, d(0.05)).otherwise(d(0))
            - F.when(hit["informal"] > 0, d(0.1)).otherwise(d(0))
            + F.when(technical, d(0.1)).otherwise(d(0))
        )
        base = d(0.5) + F.when(n.between(500, 5000), d(0.1)).otherwise(d(0)) + F.when(hit["keywords"] >= 3, d(0.2)).when(hit["keywords"] >= 1, d(0.1)).otherwise(d(0))
        return F.least(d(1), F.greatest(d(0), base + tone))

    return F.when((n < SHORT) | (n > LONG), d(0)).otherwise(bound(F.struct(capitals.alias("sentence"), found.alias("hit")), score))


# --- personality markers (fixed values: phrases, and how many make 1.0) ---
PERSONALITY = {
    "helpful": (3, ["let me help", "i can assist", "here's how", "you can", "try this", "alternatively", "consider", "might want to"]),
    "polite": (4, ["please", "thank you", "thanks", "appreciate", "kindly", "would you", "could you", "may i", "excuse me", "sorry"]),
    "professional": (3, ["regarding", "furthermore", "however", "therefore", "accordingly", "nevertheless", "consequently"]),
    "casual": (4, ["gonna", "wanna", "yeah", "cool", "awesome", "hey", "lol", "btw", "fyi", "basically", "like", "just"]),
    "technical": (4, ["algorithm", "function", "parameter", "variable", "class", "method", "implementation", "configuration", "optimization"]),
}


def personality(text: Column) -> dict[str, Column]:
    return {k: F.least(F.lit(1.0), hits(text, m) / n).alias(k) for k, (n, m) in PERSONALITY.items()}


#: Characters of a text that are shown or sent, by purpose.
PREVIEWS = {"payload": 200, "labels": 500, "embedding": 512, "context": 800, "entities": 2000, "recogniser": 5000}


def preview(text: Column, purpose: str) -> Column:
    """The beginning of a text, in code points."""
    return F.substring(text, 1, PREVIEWS[purpose])


def first_present(fields: list[Column]) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in fields))


def json_block(text: Column) -> Column:
    """The first [...] of a model's answer, outside of code fences; null without one."""
    bare = F.regexp_replace(text, "```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.lit(""))


def window_chunks(text: Column, size: int = 200, overlap: int = 50) -> Column:
    """Windows of ``size`` words that share ``overlap`` with the next; none for a blank text."""
    w = words(text)
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size(w) - size) / F.lit(step)), F.lit(0)).cast("int"))
    return F.when(F.size(w) > 0, F.transform(starts, lambda k: F.array_join(F.slice(w, k * step + 1, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))
