"""Small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from courtside.schemas import COMPETITION, GENDERS, columns
from courtside.session import small_table

# Competition id prefix, name and level; each exists for both genders.
COMPETITIONS = [
    ("VNL", "Volleyball Nations League", "nations_league"),
    ("WCH", "World Championship", "world_championship"),
    ("OG", "Olympic Games", "olympic_games"),
    ("WC", "World Cup", "world_cup"),
    ("EURO", "EuroVolley", "continental"),
    ("NORCECA", "NORCECA Championship", "continental"),
    ("SAMER", "South American Championship", "continental"),
    ("ASIA", "Asian Championship", "continental"),
    ("AFRICA", "African Championship", "continental"),
]
# Team codes of dissolved teams.
DEFUNCT_TEAMS = ["XSCG", "XSU", "XCS", "XYU", "ANT"]
# Names whose code differs from what a country list gives.
NAME_OVERRIDES = {
    "chinese taipei": "TPE",
    "ivory coast": "CIV",
    "cote d'ivoire": "CIV",
    "côte d'ivoire": "CIV",
    "dr congo": "COD",
    "democratic republic of the congo": "COD",
    "congo dr": "COD",
    "republic of congo": "COG",
    "congo": "COG",
    "cape verde": "CPV",
    "cabo verde": "CPV",
    "korea": "KOR",
    "korea republic": "KOR",
    "republic of korea": "KOR",
    "north korea": "PRK",
    "dpr korea": "PRK",
    "chinese hong kong": "HKG",
    "hong kong, china": "HKG",
    "macau": "MAC",
    "macau, china": "MAC",
    "usa": "USA",
    "united states": "USA",
    "brasil": "BRA",
    "brésil": "BRA",
    "alemania": "DEU",
    "deutschland": "DEU",
    "italia": "ITA",
    "espana": "ESP",
    "españa": "ESP",
    "polska": "POL",
    "francia": "FRA",
    "japon": "JPN",
    "japón": "JPN",
    "great britain": "GBR",
    "great britain and n. ireland": "GBR",
    "vatican": "VAT",
    "kosovo": "XKX",
    "chinese taipei (tpe)": "TPE",
    "st. vincent and the grenadines": "VCT",
    "saint vincent and the grenadines": "VCT",
    "st. kitts and nevis": "KNA",
    "saint kitts and nevis": "KNA",
    "st. lucia": "LCA",
    "saint lucia": "LCA",
    "us virgin islands": "VIR",
    "u.s. virgin islands": "VIR",
    "british virgin islands": "VGB",
    "myanmar": "MMR",
    "burma": "MMR",
    "laos": "LAO",
    "brunei": "BRN",
    "eswatini": "SWZ",
    "swaziland": "SWZ",
    "czechia": "CZE",
    "turkey": "TUR",
    "türkiye": "TUR",
    "turkiye": "TUR",
    "turkez": "TUR",
    "u.s.a.": "USA",
    "maldive islands": "MDV",
    "moldovia": "MDA",
    "samoa, western": "WSM",
    "netherlands antilles": "ANT",
    "china, people's rep. of": "CHN",
    "democratic republic of congo": "COD",
    "hongkong": "HKG",
    "kuweit": "KWT",
    "macao, china": "MAC",
    "mali republic": "MLI",
    "nertherlands": "NLD",
    "saudia arabia": "SAU",
    "soviet union": "XSU",
    "ussr": "XSU",
    "czechoslovakia": "XCS",
    "yugoslavia": "XYU",
    "west germany": "XFRG",
    "east germany": "XGDR",
    "serbia and montenegro": "XSCG",
}


def competition_table(spark: SparkSession) -> DataFrame:
    rows = [(f"{p}_{g.upper()}", name, g, level, False) for p, name, level in COMPETITIONS for g in GENDERS]
    return small_table(spark, rows, COMPETITION)


def override_table(spark: SparkSession) -> DataFrame:
    return small_table(spark, list(NAME_OVERRIDES.items()), columns("key string, code string"))


def defunct_table(spark: SparkSession) -> DataFrame:
    return small_table(spark, [(t,) for t in DEFUNCT_TEAMS], columns("team string"))
