"""Text functions on string columns: punctuation, greetings, tone, ids, counts.

Patterns use ASCII word boundaries written as look-arounds, because ``\\b`` takes
letters of any script on recent JVMs. Null texts give null unless stated.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

START, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Greetings, question words, verbs, tone words and weights.
GREETINGS = ("thank you", "thanks", "good morning", "good afternoon", "good evening", "hello there", "hi there", "hey there", "hello", "hey", "hi")
QUESTION_WORDS = ("what", "why", "how", "who", "where", "when", "which")
VERBS = ("explain", "describe", "tell", "show", "list", "define", "compare", "summarize")
ADDITIVES = ("also", "as well as", "in addition", "additionally")
URGENT = ("please help", "help me", "help", "urgent", "asap", "immediately", "emergency", "panic", "right now", "right away", "doesn't work", "does not work", "not working", "broken", "failed", "stuck", "now")
HEAVY = ("fuck", "fucking", "shit", "wtf")
LIGHT = ("damn", "hell", "crap")
HONORIFICS = ("Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "St", "Mt", "Fig", "Eq", "Ref", "Vol", "No", "pp", "p", "vs", "etc", "cf", "al", "approx", "Inc", "Ltd", "Co", "Corp", "e.g", "i.e", "et al")
W_SHOUT, W_PUNCT, W_URGENT, W_PROFANE = 0.25, 0.20, 0.25, 0.40
SHOUT_FROM, SHOUT_FULL, SHOUT_LETTERS = 0.4, 0.7, 4
EXCESS_CAP, URGENT_CAP, LIGHT_PART, HEAVY_FLOOR = 5, 2, 0.6, 0.5
LEVELS = ((0.8, "very_frustrated"), (0.5, "frustrated"), (0.2, "mildly_frustrated"))
MEDIA = {
    "txt": "text/plain", "text": "text/plain", "pdf": "application/pdf", "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xml": "application/xml",
    "csv": "application/csv", "markdown": "text/markdown", "md": "text/markdown", "ppl": "text/plain", "dsl": "text/plain",
    "toon": "text/toon", "moon": "text/plain", "json": "application/json", "yaml": "application/yaml", "yml": "application/yaml",
}

_any = lambda words: "(?:" + "|".join(w.replace(".", r"\.").replace(" ", r"\s+") for w in words) + ")"
GREETING = _any(GREETINGS)
GREETING_STARTS = _any(("hi", "hello", "hey", "thanks", "thank you", "good morning", "good afternoon", "good evening"))


def _replace(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, pattern, by)


def collapse_punctuation(text: Column) -> Column:
    """A run of ! and ? becomes its first mark; repeats of , . ; : become one."""
    return _replace(_replace(text, r"([!?])[!?]+", "$1"), r"([,.;:])\1+", "$1")


def normalize_punctuation(text: Column) -> Column:
    """Repeats of , ! ? become one; dot runs an ellipsis (three dots give four, as in the model system); -- a dash; _ and ~ a hyphen."""
    text = _replace(text, r"([,!?])\1+", "$1")
    text = _replace(text, r"\.{4,}|\.{2}", "...")
    return _replace(_replace(text, r"-{2,}", "—"), r"[_~]", "-")


def plain_text(text: Column) -> Column:
    """Only ASCII word characters, spaces and hyphens, single-spaced."""
    return F.trim(_replace(_replace(text, r"[^\w\s-]", " "), r"\s+", " "))


def squeeze(text: Column) -> Column:
    return F.trim(_replace(text, r"\s+", " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def bucket(words: Column, short: int = 150, long: int = 400) -> Column:
    return F.when(words < short, "short").when(words > long, "long").otherwise("medium")


def split_words(text: Column) -> Column:
    """Words and the separators between them, in order."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9'’]+|[^A-Za-z0-9'’]+"), F.lit(0))


def correct_words(text: Column, corrections: dict[str, str]) -> Column:
    """Spell map per word, whatever its case; words without an entry stay. The map is a parameter of fixed size."""
    table = F.create_map(*[F.lit(x) for k, v in corrections.items() for x in (k.lower(), v)]) if corrections else F.create_map().cast("map<string,string>")
    return F.array_join(F.transform(split_words(normalize_punctuation(text)), lambda w: F.coalesce(F.element_at(table, F.lower(w)), w)), "")


def is_delimiter(text: Column) -> Column:
    """A rule: at least three of one of * + - = _ ~."""
    return text.rlike(r"^([*+\-=_~])\1{2,}$")


def has_title(markdown: Column) -> Column:
    return markdown.isNotNull() & markdown.rlike(r"(?m)^#\s+.+")


def strip_fences(text: Column) -> Column:
    return F.trim(_replace(text, r"(?s)^\s*```[A-Za-z]*\s*\n?(.*?)\n?\s*```\s*$", "$1"))


def media_type(path: Column, default: str = "text/plain") -> Column:
    table = F.create_map(*[F.lit(x) for k, v in MEDIA.items() for x in (k, v)])
    extension = F.lower(F.regexp_extract(path, r"(?:^|[./])([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.element_at(table, extension), F.lit(default))


@F.pandas_udf(StringType())
def _without_marks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not "̀" <= c <= "ͯ"))


def sanitize(text: Column, ascii_only: bool = False) -> Column:
    """Lower-case letters and digits joined by single underscores; accents are folded unless the text is known to be ASCII."""
    folded = text if ascii_only else _without_marks(text)
    return F.regexp_replace(F.regexp_replace(F.lower(folded), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def is_document_id(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[a-z0-9]+(_[a-z0-9]+)*\|[a-z0-9]+(_[a-z0-9]+)*$"), F.lit(False))


def theme_of(path: Column) -> Column:
    """The parent folder's name; ``root`` if there is none."""
    return F.coalesce(F.nullif(F.try_element_at(F.split(_replace(path, r"\\", "/"), "/"), F.lit(-2)), F.lit("")), F.lit("root"))


def theme_conflict(path: Column, theme: Column, ascii_only: bool = False) -> Column:
    """Whether ``theme`` overrides another theme, of an id or of a path with a folder."""
    own = F.when(is_document_id(path), F.split(path, r"\|")[0]).otherwise(sanitize(theme_of(path), ascii_only))
    return F.coalesce((own != "root") & (own != sanitize(theme, ascii_only)), F.lit(False))


def document_id(path: Column, theme: Column | None = None, ascii_only: bool = False, on_conflict: str = "silent") -> Column:
    """``theme|stem``: the parent folder (or root) and the file name without extension and build suffix; ids pass through.

    A given theme overrides the folder's. Where both differ, ``on_conflict`` decides:
    ``silent`` takes the given one, ``throw`` fails; ``theme_conflict`` marks such rows.
    """
    if on_conflict not in ("silent", "throw"):
        raise ValueError(f"unknown conflict mode {on_conflict}")
    stem = _replace(F.element_at(F.split(_replace(path, r"\\", "/"), "/"), -1), r"(?i)\.[a-z0-9]{1,5}$", "")
    stem = _replace(stem, r"\|md_\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}-\d{3}Z$", "")
    parent = theme_of(path)
    if theme is not None and on_conflict == "throw":
        theme = F.when(theme_conflict(path, theme, ascii_only), F.raise_error(F.concat(F.lit("themes conflict: "), path)).cast("string")).otherwise(theme)
    theme = parent if theme is None else F.coalesce(theme, parent)
    return F.when(is_document_id(path), path).otherwise(F.concat(sanitize(theme, ascii_only), F.lit("|"), sanitize(stem, ascii_only)))


def _held(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _letters(text: Column, kind: str = "A-Za-z") -> Column:
    return F.length(F.regexp_replace(text, f"[^{kind}]+", ""))


def caps_ratio(text: Column) -> Column:
    return _held(_letters(text), lambda letters: F.when(letters == 0, 0.0).otherwise(_letters(text, "A-Z") / letters))


def shouting(text: Column) -> Column:
    ramp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (caps_ratio(text) - SHOUT_FROM) / (SHOUT_FULL - SHOUT_FROM)))
    return F.when(_letters(text) < SHOUT_LETTERS, 0.0).otherwise(ramp)


def punctuation_excess(text: Column) -> Column:
    """Weighted surplus marks of runs of ! and ?: runs of ? alone count half."""
    runs = F.regexp_extract_all(text, F.lit("[!?]{2,}"), F.lit(0))
    weight = lambda r: (F.length(r) - 1) * F.when(r.contains("!"), 1.0).otherwise(0.5)
    return F.aggregate(runs, F.lit(0.0), lambda a, r: a + weight(r))


def urgent_hits(text: Column) -> Column:
    """Urgent words found, in list order; a longer phrase takes its characters from later words.

    One pattern finds them all: of words that start at one place the first in the list
    counts, and no word of the list begins inside one that stands before it there.
    """
    ways = [rf"(?<=^|\s){w}(?=\s|$|[.,!?])" if " " in w else w + END for w in URGENT]
    hits = F.regexp_extract_all(F.lower(text), F.lit(f"{START}(?:{'|'.join(ways)})"), F.lit(0))
    return _held(hits, lambda found: F.flatten(F.transform(F.array(*map(F.lit, URGENT)), lambda w: F.filter(found, lambda h: h == w))))


def profanity_tier(text: Column) -> Column:
    lower = F.lower(text)
    return F.when(lower.rlike(START + _any(HEAVY) + END), "heavy").when(lower.rlike(START + _any(LIGHT) + END), "light")


def frustration(text: Column) -> Column:
    """Struct of the tone signals and a score from 0 to 1; null counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def scored(s: Column) -> Column:
        tier = s["profanity"]
        profane = F.when(tier == "heavy", 1.0).when(tier == "light", LIGHT_PART).otherwise(0.0)
        parts = W_SHOUT * s["shouting"] + W_PUNCT * F.least(F.lit(1.0), s["excess"] / EXCESS_CAP) + W_URGENT * F.least(F.lit(1.0), F.size(s["urgent"]) / URGENT_CAP) + W_PROFANE * profane
        score = F.least(F.lit(1.0), F.when(tier == "heavy", F.greatest(F.lit(HEAVY_FLOOR), parts)).otherwise(parts))
        return F.struct(score.alias("score"), *[s[c].alias(c) for c in ("shouting", "caps_ratio", "excess", "urgent", "profanity")])

    signs = F.struct(shouting(text).alias("shouting"), caps_ratio(text).alias("caps_ratio"), punctuation_excess(text).alias("excess"), urgent_hits(text).alias("urgent"), profanity_tier(text).alias("profanity"))
    return _held(signs, scored)


def frustration_level(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for least, name in reversed(LEVELS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def is_multi_part(text: Column) -> Column:
    """Any of seven signs of more than one request."""
    q = collapse_punctuation(F.coalesce(text, F.lit("")))
    words, verbs = _any(QUESTION_WORDS), _any(VERBS)
    return (
        (F.regexp_count(q, F.lit(r"\?")) > 1)
        | q.rlike(rf"(?i){START}{words}{END}.+{START}{words}{END}")
        | q.rlike(rf"(?i){START}{verbs}{END}.+{START}{verbs}{END}")
        | q.rlike(rf"(?i){START}{_any(ADDITIVES)}{END}")
        | q.rlike(r"\w{4,}[.!?]\s+\w{4,}")
        | q.rlike(r"\w{3,}[.!?]\s+[A-Z]")
        | F.trim(q).rlike(rf"(?i)^{GREETING_STARTS}{END}[^!,.]*[!,.][^A-Za-z0-9]*[A-Za-z0-9]")
    )


def peel_greeting(text: Column) -> Column:
    """Struct (greeting, query): greetings set apart by punctuation are taken off either end and the middle."""
    whole = F.trim(F.coalesce(text, F.lit("")))
    marks = "[!?.,]*"
    q = F.trim(_replace(whole, rf"(?i)^{GREETING}[!?.,]+\s+", ""))
    q = F.trim(_replace(q, rf"(?i)(?<=[!?.,])\s+{GREETING}{marks}$", ""))
    middle = _replace(q, rf"(?i)(?<=[!?.])\s+{GREETING}{marks}(?=\s|$)", "")
    q = F.when(middle != q, squeeze(middle)).otherwise(squeeze(q))
    q = _replace(q, rf"(?i)^{GREETING}{marks}$", "")
    return F.struct((q != squeeze(whole)).alias("greeting"), q.alias("query"))


def greedy_split(text: Column) -> Column:
    """Requests of a text: greeting, then ? and !, sentence dots, additive openers, and 'and' before a question word or verb."""
    q = F.trim(collapse_punctuation(F.coalesce(text, F.lit(""))))
    mark, dot = "\u0001", "\u0002"
    greeting = r"(hi(?:\s+there)?|hello(?:\s+there)?|hey(?:\s+there)?|thanks?(?:\s+you)?|good\s+(?:morning|afternoon|evening))"
    q = _replace(q, rf"(?is)^{greeting}\s*([!.]+)\s*(?=[A-Za-z0-9])", f"$1$2{mark}")
    q = _replace(q, rf"(?is)^{greeting}\s*[!,.][!,.\s]*(?=[A-Za-z0-9])", f"$1{mark}")
    q = _replace(q, r"(?<=[?!])\s+(?=\S)", mark)
    q = _replace(q, rf"{START}({_any(HONORIFICS)})\.", f"$1{dot}")
    q = _replace(q, r"(?<=\w{4}\.)\s+(?=\w{4,})", mark)
    q = _replace(q, rf"(?<={START}[A-Za-z]{{2,60}}\.)\s+(?=[A-Z])", mark)
    q = F.replace(q, F.lit(dot), F.lit("."))
    q = _replace(q, rf"(?i)(?<=[.?,])\s+(?={_any(ADDITIVES)}{END})", mark)
    q = _replace(q, rf"(?i)\s+and\s+(?={_any((*QUESTION_WORDS, *VERBS))}{END})", mark)
    parts = F.filter(F.transform(F.split(q, mark), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(parts)


TEMPLATE_RULES = ((r"(thanks|thank\s+you|thx|ty)", "thanks"), (r"good\s+(morning|day)", "morning"), (r"good\s+afternoon", "afternoon"), (r"good\s+evening", "evening"))
TEMPLATES = {"default": "Hello! What can I help you with?", "thanks": "You're welcome!", "morning": "Good morning! What can I help you with?", "afternoon": "Good afternoon! What can I help you with?", "evening": "Good evening! What can I help you with?"}


def greeting_key(text: Column) -> Column:
    out = F.lit("default")
    for pattern, key in reversed(TEMPLATE_RULES):
        out = F.when(text.rlike(rf"(?i){START}{pattern}{END}"), key).otherwise(out)
    return out


def greeting_answer(text: Column, templates: dict[str, str] = TEMPLATES) -> Column:
    table = F.create_map(*[F.lit(x) for kv in templates.items() for x in kv])
    return F.element_at(table, greeting_key(text))


def query_prefix(text: Column, prefix: str) -> Column:
    """The encoder prefix once, however often it was there."""
    import re

    return F.concat(F.lit(prefix), _replace(text, rf"^(?:{re.escape(prefix.strip())}\s*)+", ""))


def token_counts(text: Column) -> Column:
    """Struct: bytes, words, special characters, space runs and the estimate of tokens."""
    text = F.coalesce(text, F.lit(""))
    size, special = F.octet_length(text), F.regexp_count(text, F.lit(r"[^a-zA-Z0-9\s]"))
    words, spaces = F.regexp_count(text, F.lit(r"[a-zA-Z0-9]+")), F.regexp_count(text, F.lit(r"\s+"))
    tokens = F.ceil((size - special - spaces) / 4 + spaces / 2 + special)
    return F.struct(size.alias("num_bytes"), words.alias("num_words"), special.alias("num_special"), spaces.alias("num_spaces"), tokens.alias("tokens"))


def snake_case(text: Column) -> Column:
    return sanitize(_replace(text, r"([a-z0-9])([A-Z])", "$1_$2"))


def truncate_at_word(text: Column, most: int = 80) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(_replace(F.substring(text, 1, most), r"_[^_]*$", ""))


def without_formatting(markdown: Column) -> Column:
    linked = _replace(markdown, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(_replace(linked, r"[*`~]+|(?<!\w)_+|_+(?!\w)", ""))


def file_name_of(markdown: Column) -> Column:
    """File name from the first top heading; null without one."""
    title = F.regexp_extract(markdown, r"(?m)^#\s+(.+)$", 1)
    name = truncate_at_word(sanitize(without_formatting(title)))
    return F.when(name != "", F.concat(name, F.lit(".md")))
