"""Text helpers: joining, cleaning, tokens, containment."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.dictionaries import ENGLISH_STOPWORDS, REVIEW_STOPWORDS

# The characters that count as white space in Unicode text.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Anything that is neither a letter, a digit nor an underscore separates words.
WORD_BREAK = r"[^\p{L}\p{N}_]+"
SPACES = SPACE_CLASS[1:-1]
URL_PATTERN = rf"(?:https?://|www\.)[^{SPACES}]+"
COMMENT_PATTERN = r"(?s)<!--.*?-->"
TAG_PATTERN = r"<[^<>]*>"
DROP_PATTERN = rf"[^a-zA-Z0-9{SPACES}.,!?-]+"
SPREAD_PATTERN = rf"[{SPACES}]+"
NUMERIC_ENTITY = r"&#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"
_PLAIN_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "nbsp": "\xa0", "ensp": "\u2002", "emsp": "\u2003", "thinsp": "\u2009", "amp": "&"}
# All other named entities of the language are characters that cleaning drops.
DROPPED_ENTITIES = "&(?:" + "|".join(n for n in name2codepoint if n not in _PLAIN_ENTITIES) + ");"


def sql_words(words: Iterable[str]) -> str:
    """A word list as SQL text, for lists too long to pass literal by literal."""
    return "(" + ", ".join("'" + w.replace("'", "\\'") + "'" for w in words) + ")"


def strip(text: Column) -> Column:
    """Drop leading and trailing Unicode white space."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def combined_text(title: Column | str = "title", body: Column | str = "body") -> Column:
    """``title + ' ' + body`` with missing parts as empty text."""
    title, body = (F.col(c) if isinstance(c, str) else c for c in (title, body))
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def scoring_text(title: Column | str = "title", body: Column | str = "body") -> Column:
    """Text that the fake-review rules look at: lower, body before title, stripped."""
    return strip(F.lower(combined_text(body, title)))


def analysis_text(form: str = "title_body") -> Column:
    """Text of a review as an analysis variant sees it."""
    return combined_text() if form == "title_body" else F.coalesce(F.col("body"), F.lit(""))


def split_words(text: Column) -> Column:
    """Lower-case words of a text; the edges may hold an empty string."""
    return F.split(F.lower(text), WORD_BREAK)


def split_space(text: Column) -> Column:
    """White-space tokens of an already stripped text."""
    return F.split(text, SPACE_CLASS + "+")


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when at least one of the words occurs as a substring."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def count_contained(text: Column, words: Iterable[str]) -> Column:
    """How many of the words occur as substrings."""
    total = F.lit(0)
    for word in words:
        total = total + text.contains(word).cast("int")
    return total


def count_occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a word."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def any_match(text: Column, patterns: Iterable[str]) -> Column:
    """True when one of the anchored patterns matches (case-insensitive).

    The anchor is stated once in front, so that a long text is tried at its
    start only and not at every place.
    """
    return text.rlike("(?i)^(?:" + "|".join(p.removeprefix("^") for p in patterns) + ")")


def _numeric_entities(text: Column) -> Column:
    """Decode numeric entities that cleaning keeps (ASCII and white space); it drops all other characters."""

    def char(code: Column) -> Column:
        number = F.when(code.rlike("^[xX]"), F.conv(F.substring(code, 2, 6), 16, 10)).otherwise(code).cast("int")
        return F.when(number.isin(*[ord(c) for c in SPACE_CHARS]), " ").when(number < 128, F.chr(number)).otherwise("")

    parts = F.split(text, NUMERIC_ENTITY, -1)
    chars = F.transform(F.regexp_extract_all(text, F.lit(NUMERIC_ENTITY), F.lit(1)), char)
    joined = F.array_join(F.transform(F.arrays_zip(parts.alias("part"), chars.alias("char")), lambda x: F.concat(x["part"], F.coalesce(x["char"], F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&#")), joined).otherwise(text)


def clean_text(text: Column, stopwords: Sequence[str] | None = None) -> Column:
    """Strip markup and URLs, lower, keep plain characters, collapse spaces."""
    out = F.coalesce(text, F.lit(""))
    out = F.regexp_replace(F.regexp_replace(out, COMMENT_PATTERN, ""), TAG_PATTERN, "")
    out = F.regexp_replace(_numeric_entities(out), DROPPED_ENTITIES, "")
    for name, char in _PLAIN_ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    out = F.regexp_replace(out, URL_PATTERN, "")
    out = F.regexp_replace(F.lower(out), DROP_PATTERN, "")
    out = strip(F.regexp_replace(out, SPREAD_PATTERN, " "))
    if stopwords is not None:
        kept = F.filter(clean_tokens(out), lambda w: ~w.isin(*stopwords))
        out = F.array_join(kept, " ")
    return out


def clean_tokens(cleaned: Column) -> Column:
    """Tokens of a cleaned text: words (with inner hyphens) and single marks."""
    return F.regexp_extract_all(cleaned, F.lit(r"([a-z0-9]+(?:-[a-z0-9]+)*|[.,!?-])"), F.lit(1))


def review_keywords(text: Column, stopwords: Sequence[str] | None = None) -> Column:
    """Keywords of one text: cleaned tokens without stopwords, longer than two."""
    stop = list(stopwords) if stopwords is not None else ENGLISH_STOPWORDS + REVIEW_STOPWORDS
    return F.filter(clean_tokens(clean_text(text)), lambda w: (F.length(w) > 2) & ~w.isin(*stop))


def truncate_text(text: Column, max_length: int = 100) -> Column:
    """Shorten to ``max_length`` characters, the last three being dots."""
    return F.when(
        F.length(text) > max_length, F.concat(F.substring(text, 1, max_length - 3), F.lit("..."))
    ).otherwise(F.coalesce(text, F.lit("")))
