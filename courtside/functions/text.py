"""Columns over names: keys, candidates, gender, competition and scope."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Spellings of a stage.
STAGE_ALIASES = {
    "pool": "pool",
    "preliminary": "preliminary",
    "preliminary round": "preliminary",
    "quarterfinal": "quarterfinal",
    "quarter-final": "quarterfinal",
    "qf": "quarterfinal",
    "semifinal": "semifinal",
    "semi-final": "semifinal",
    "sf": "semifinal",
    "bronze": "bronze",
    "bronze medal match": "bronze",
    "final": "final",
    "gold medal match": "final",
}
# Spellings of a gender.
GENDER_VALUES = {
    "men": "men", "man": "men", "male": "men", "m": "men", "0": "men",
    "women": "women", "woman": "women", "female": "women", "w": "women", "1": "women",
}
# Words that must all occur in a tournament name, and the competition they mean; first hit wins.
COMPETITION_WORDS = [
    (("nations", "league"), "Volleyball Nations League"),
    (("world", "championship"), "World Championship"),
    (("olympic",), "Olympic Games"),
    (("world", "cup"), "World Cup"),
    (("eurovolley",), "EuroVolley"),
    (("european", "championship"), "EuroVolley"),
    (("norceca",), "NORCECA Championship"),
    (("south", "american", "championship"), "South American Championship"),
    (("asian", "championship"), "Asian Championship"),
    (("african", "championship"), "African Championship"),
]
# Parts of a name that put a tournament out of scope.
OUT_OF_SCOPE = [
    "club", "u23", "u21", "u20", "u19", "u18", "u17", "u16", "u15", "u14", "youth", "junior", "beach",
    "military", "cism", "grand champions cup", "zonal", "central asian",
]


@F.pandas_udf(StringType())
def fold_accents(names: pd.Series) -> pd.Series:
    """Compatibility decomposition without the combining marks (no built-in does this)."""
    def fold(text):
        if text is None or text.isascii():
            return text
        return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return names.map(fold)


def squeeze(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def name_key(name: Column) -> Column:
    """Comparison key: lower case, no accents, single spaces.  Apply it to distinct names."""
    return squeeze(fold_accents(F.lower(squeeze(name))))


def name_candidates(name: Column) -> Column:
    """The name, without a trailing bracket, without dots, without both; distinct, in this order."""
    bare = F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""))
    no_dots = F.trim(F.replace(name, F.lit("."), F.lit("")))
    bare_no_dots = F.trim(F.replace(bare, F.lit("."), F.lit("")))
    extra = F.filter(F.array(bare, no_dots, bare_no_dots), lambda x: x != "")
    return F.array_distinct(F.concat(F.array(name), extra))


def mapped(value: Column, table: dict[str, str]) -> Column:
    """Lower-case, trimmed lookup in a small fixed map; null when absent."""
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(value)))


def stage_of(raw: Column) -> Column:
    return F.coalesce(mapped(raw, STAGE_ALIASES), F.lit("other"))


def gender_of(field: Column, name: Column) -> Column:
    """Gender from the field, else from the words of the tournament name, else null."""
    return F.coalesce(
        mapped(field, GENDER_VALUES),
        F.when(name.rlike(r"(?i)\bwomen'?s?\b"), F.lit("women")),
        F.when(name.rlike(r"(?i)\bmen'?s?\b"), F.lit("men")),
    )


def canonical_competition(name: Column) -> Column:
    lower = F.lower(name)
    hits = []
    for words, competition in COMPETITION_WORDS:
        found = F.lit(True)
        for word in words:
            found = found & lower.rlike(rf"\b{re.escape(word)}\b")
        hits.append(F.when(found, F.lit(competition)))
    return F.coalesce(*hits)


def in_scope(name: Column) -> Column:
    out = F.lower(name).rlike("|".join(re.escape(word) for word in OUT_OF_SCOPE))
    return F.coalesce(~out & canonical_competition(name).isNotNull(), F.lit(False))


def delete_variants(text: Column) -> Column:
    """The text with up to two characters left out.  Two texts within edit distance two share a variant."""
    def shorter(x):
        return F.when(F.length(x) > 0, F.transform(
            F.sequence(F.lit(1), F.length(x)),
            lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        ).otherwise(F.array().cast("array<string>"))
    once = shorter(text)
    twice = F.flatten(F.transform(once, shorter))
    return F.array_distinct(F.concat(F.array(text), once, twice))
