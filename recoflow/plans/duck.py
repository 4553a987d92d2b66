"""DuckDB spellings of the field functions, for the oracles."""

from __future__ import annotations

from recoflow.functions import text as T


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def split(c: str, pattern: str = T.LIST_SEPARATORS) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({c}, ''), {quoted(pattern)}), lambda x: trim(x)), lambda x: x <> '')"


def distinct(values: str) -> str:
    """In order of first appearance."""
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


def lower(values: str) -> str:
    return f"list_transform({values}, lambda x: lower(x))"


def join(values: str) -> str:
    return f"coalesce(list_aggregate({values}, 'string_agg', ', '), '')"


AUTHORS = distinct(split("author", T.AUTHOR_SEPARATORS))
TAG_PATTERN = T.EVENT_TAGS.removeprefix("(?i)")
TAGS = distinct(lower(f"list_filter({split('tags', ',')}, lambda x: NOT regexp_matches(x, {quoted(TAG_PATTERN)}, 'i'))"))
GENRES = distinct(lower(split("genre")))
BARE = f"lower(regexp_replace(coalesce(system, ''), {quoted(T.PARENTHETICAL)}, '', 'g'))"
SYSTEMS = distinct(f"list_filter(list_transform(string_split_regex({BARE}, '[,/]+'), lambda x: trim(regexp_replace(x, {quoted(T.STANDALONE_NUMBER)}, '', 'g'))), lambda x: x <> '')")
BOTH = f"list_concat({GENRES}, {TAGS})"
MERGED = f"({distinct(BOTH)})[1:20]"
YEAR = f"TRY_CAST(regexp_extract(coalesce(published, ''), {quoted(T.YEAR)}, 0) AS INTEGER)"


def profile(systems: str, tags: str) -> str:
    return f"concat_ws('. ', CASE WHEN len({systems}) > 0 THEN 'Systems: ' || {join(systems)} END, CASE WHEN len({tags}) > 0 THEN 'Tags: ' || {join(tags)} END)"


#: Items with their field lists: authors_l, systems_l, tags_l (genres and tags), year.
FACTS = f"facts AS (SELECT *, {AUTHORS} AS authors_l, {SYSTEMS} AS systems_l, {MERGED} AS tags_l, {GENRES} AS genres_l, {YEAR} AS year FROM items)"
