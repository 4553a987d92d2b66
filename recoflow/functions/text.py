"""Column functions that normalise catalogue fields.

Every function takes and returns columns, so whole pipelines stay inside generated
code; the one exception is the entity decoder of HTML descriptions.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns, word lists and formats that results depend on.
LIST_SEPARATORS = r"[,/]+"
AUTHOR_SEPARATORS = r"\s*/\s*|\s*,\s*|\s+and\s+"
PARENTHETICAL = r"\([^)]*\)"
STANDALONE_NUMBER = r"\s*\b\d[\d.]*\b"
YEAR = r"\b(19|20)\d{2}\b"
EVENT_TAGS = (
    r"(?i)(comp)|(award)|(\d\d\d\d)|(transcript)|(xyzzy)|(spring thing)|(source available)|(prize)|(showcase)|(jam)|"
    r"(walkthrough)|(cover art)|(available)|(adrift)|(inform)|(windrift)|(twine)|(interactive fiction)|(top \d\d)|"
    r"(winner)|(playoff)|(inklewriter)|(storynexus)|(choicescript)|(ink)|(student project)"
)
MAX_TAGS = 20
PLACEHOLDERS = ("none", "n/a", "na", "null", "nan", "unknown")
LANGUAGE_NAMES = {
    "en": "English", "es": "Spanish", "fr": "French", "de": "German", "it": "Italian", "ru": "Russian",
    "cs": "Czech", "zh": "Chinese", "ja": "Japanese", "pt": "Portuguese", "sv": "Swedish", "sk": "Slovak",
    "nl": "Dutch", "hu": "Hungarian", "pl": "Polish", "sr": "Serbian", "sl": "Slovenian", "ca": "Catalan",
    "ko": "Korean", "da": "Danish", "hr": "Croatian", "eo": "Esperanto", "no": "Norwegian", "uk": "Ukrainian",
    "tr": "Turkish", "el": "Greek", "ro": "Romanian", "bs": "Bosnian", "ms": "Malay", "bn": "Bengali",
    "id": "Indonesian", "ar": "Arabic", "iu": "Inuktitut", "fi": "Finnish", "is": "Icelandic",
    "english": "English", "danish": "Danish", "rus": "Russian", "cat": "Catalan", "sco": "Scots",
    "jbo": "Lojban", "tok": "Toki Pona", "toki pona": "Toki Pona",
}
LANGUAGE_NOISE = ("+", "users choice", "mis", "und", "zxx", "n/a", "none", "nan")
BLOCK_END = r"(?i)<\s*(br|/p|/div|/li|/h[1-6])\s*/?>"
MARKUP = r"<[^>]*>"
#: Unicode white space and the information separators.
WHITE = r"(?U)[\s\x1c-\x1f]+"
EXCLUDED_AUTHORS = ("anonymous", "anonymous (first row software publishing inc.)", "failbetter games")
PROFILE_SYSTEMS, PROFILE_TAGS = "Systems: ", "Tags: "


def text_of(c: str | Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def split_values(c: str | Column, separators: str = LIST_SEPARATORS) -> Column:
    """Trimmed, non-empty parts of a multi-valued field (B1)."""
    return F.filter(F.transform(F.split(text_of(c), separators), lambda x: F.trim(x)), lambda x: x != "")


def joined(values: Column) -> Column:
    return F.array_join(values, ", ")


def clean_authors(c: str | Column) -> Column:
    """Distinct author names in order, case kept."""
    return F.array_distinct(split_values(F.trim(text_of(c)), AUTHOR_SEPARATORS))


def filtered_tags(c: str | Column, pattern: str = EVENT_TAGS) -> Column:
    """Lower-case distinct tags without those that hold an event or system pattern."""
    return F.array_distinct(F.transform(F.filter(split_values(c, ","), lambda x: ~x.rlike(pattern)), lambda x: F.lower(x)))


def genres(c: str | Column) -> Column:
    """Lower-case distinct genres."""
    return F.array_distinct(F.transform(split_values(c), lambda x: F.lower(x)))


def clean_systems(c: str | Column) -> Column:
    """Lower-case distinct systems without parentheticals and version numbers."""
    bare = F.lower(F.regexp_replace(text_of(c), PARENTHETICAL, ""))
    parts = F.transform(F.split(bare, LIST_SEPARATORS), lambda x: F.trim(F.regexp_replace(x, STANDALONE_NUMBER, "")))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def merged_tags(genre: str | Column, tags: str | Column, most: int = MAX_TAGS) -> Column:
    """Genres first, then filtered tags, at most ``most``."""
    return F.slice(F.array_distinct(F.concat(genres(genre), filtered_tags(tags))), 1, most)


def year_of(c: str | Column) -> Column:
    """First year from 1900 to 2099 in a text, null if there is none."""
    return F.regexp_extract(text_of(c), YEAR, 0).try_cast("int")


def language_names(c: str | Column) -> Column:
    """Displayable language names of a free-text field."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    tokens = F.transform(F.split(F.regexp_replace(text_of(c), PARENTHETICAL, " "), "[,;/]"), lambda x: F.lower(F.trim(x)))
    base_of = lambda t: F.trim(F.substring_index(F.substring_index(t, "-", 1), "_", 1))
    known = F.filter(tokens, lambda t: (t != "") & ~t.isin(*LANGUAGE_NOISE) & ~base_of(t).isin(*LANGUAGE_NOISE))
    name = lambda t, b: F.coalesce(F.try_element_at(names, b), F.try_element_at(names, t), F.when(F.char_length(b) <= 3, F.upper(b)).otherwise(titled(b)))
    return joined(F.array_distinct(F.transform(known, lambda t: name(t, base_of(t)))))


def titled(c: Column) -> Column:
    """Upper case for the first letter after each non-letter: words are cut there, so
    that o'x becomes O'X."""
    marked = F.regexp_replace(F.lower(c), r"([^\p{L}]+)", "$1\u0001")
    return F.array_join(F.transform(F.split(marked, "\u0001"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    from html import unescape

    return texts.map(unescape, na_action="ignore")


def description_text(c: str | Column, entities: bool = True) -> Column:
    """An HTML description as one line of plain text (B10).  Markup goes before and
    after entities are decoded; without ``entities`` all stays inside the JVM."""
    plain = F.regexp_replace(F.regexp_replace(text_of(c), BLOCK_END, " "), MARKUP, "")
    if entities:
        plain = F.regexp_replace(_unescaped(plain), MARKUP, "")
    return F.trim(F.regexp_replace(plain, WHITE, " "))


def without_placeholders(c: str | Column) -> Column:
    """Parts that only say that nothing is recorded go."""
    return joined(F.filter(split_values(c, ","), lambda x: ~F.lower(x).isin(*PLACEHOLDERS)))


def tokens(c: str | Column, separators: str = ",") -> Column:
    """Distinct lower-case parts."""
    return F.array_distinct(F.transform(split_values(c, separators), lambda x: F.lower(x)))


def profile_text(systems: Column, tags: Column) -> Column:
    """``Systems: a, b. Tags: c, d``, where an empty list gives no part."""
    part = lambda label, values: F.when(F.size(values) > 0, F.concat(F.lit(label), joined(values)))
    return F.concat_ws(". ", part(PROFILE_SYSTEMS, systems), part(PROFILE_TAGS, tags))


def parsed_profile(c: str | Column) -> Column:
    """Struct of systems and tags from a rendered profile."""
    parts = F.split(text_of(c), r"\. ")
    of = lambda label: split_values(F.array_join(F.transform(F.filter(parts, lambda p: p.startswith(label)), lambda p: F.substring(p, len(label) + 1, 1 << 30)), ","), ",")
    return F.struct(of(PROFILE_SYSTEMS.strip() + " ").alias("systems"), of(PROFILE_TAGS.strip() + " ").alias("tags"))


def document_text(title: str, authors: Column, systems: Column, tags: Column, description: str) -> Column:
    """The text of an item for an encoder (B17); description cut at 500 code points."""
    snippet = F.trim(F.substring(text_of(description), 1, 500))
    labelled = lambda label, values: F.when(F.size(values) > 0, F.concat(F.lit(label), joined(values)))
    return F.concat_ws(
        ". ",
        F.concat(F.lit("Title: "), text_of(title)),
        F.concat(F.lit("Author: "), joined(authors)),
        labelled(PROFILE_SYSTEMS, systems),
        labelled(PROFILE_TAGS, tags),
        F.when(snippet != "", F.concat(F.lit("Description: "), snippet)),
    )


def one_decimal(x: Column) -> Column:
    """A number from 0 to 50 with one decimal, rounded by its exact binary value, half to
    even."""
    tenths = (x * 2**54).cast("long") * 10
    whole, rest = F.shiftright(tenths, 54), tenths.bitwiseAND(F.lit(2**54 - 1))
    up = (rest > 2**53) | ((rest == 2**53) & (whole % 2 == 1))
    n = whole + up.cast("long")
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def rating_cell(average: str, count: str) -> Column:
    """``3.8 (2)``; a dash without ratings; empty where a value is missing."""
    return F.when(F.col(count) == 0, F.lit("—")).otherwise(F.coalesce(F.concat(one_decimal(F.col(average)), F.lit(" ("), F.col(count).cast("string"), F.lit(")")), F.lit("")))


def contains_any(values: Column, terms: Column) -> Column:
    """Whether any term is part of any value, in any case."""
    return F.exists(values, lambda v: F.exists(terms, lambda t: F.contains(F.lower(v), F.lower(t))))


def rounded(c: Column, digits: int = 2) -> Column:
    """Half to even on the scaled value."""
    return F.rint(c * 10**digits) / 10**digits


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
