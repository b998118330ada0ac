"""Text clean-up used by every source and by the screening keys.

Whitespace means what Python's ``str.split`` means by it: Unicode white space plus the four
ASCII separator controls, hence the explicit character class.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

WS = r"(?U)[\s\x1c-\x1f]+"
# The same characters one by one, for trimming.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Anything a clean-up step could change. Most values have nothing of the kind and skip the steps.
ODD = r"[^!-~ ]|  "
NON_ASCII = r"[^\x00-\x7F]"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _nfkc_cells(rows: pd.Series) -> pd.Series:
    def cell(items):
        return None if items is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in items]

    return rows.map(lambda cells: [cell(c) for c in cells], na_action="ignore")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), 0)


def word_list(items: Iterable[str]) -> Column:
    """A constant array as one literal: plans with long tables stay small."""
    return F.split(F.lit("\x01".join(items)), "\x01")


def lookup_table(mapping: Mapping[str, str]) -> Column:
    """A constant map, built the same way."""
    return F.map_from_arrays(word_list(mapping), word_list(mapping.values()))


def looked_up(key: Column, mapping: Mapping[str, str]) -> Column:
    """The value of a key in a constant mapping; null for other keys.

    A map is searched from its first key on. Here the keys are dealt to many small maps by their checksum, so that a
    look-up compares one key or two however long the mapping is.
    """
    size = 2 * len(mapping) + 1
    dealt: list[dict[str, str]] = [{} for _ in range(size)]
    for k, v in mapping.items():
        dealt[zlib.crc32(k.encode()) % size][k] = v
    maps = F.from_json(F.lit(json.dumps(dealt)), "array<map<string,string>>")
    return F.try_element_at(F.get(maps, (F.crc32(key) % size).cast("int")), key)


def nfkc(c) -> Column:
    """Unicode NFKC. Only non-ASCII values reach Python; the rest cross as nulls."""
    c = _col(c)
    return F.coalesce(_nfkc(F.when(c.rlike(NON_ASCII), c)), c)


def nfkc_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unicode NFKC of many text (or array of text) columns with one call to Python for each row that needs it."""
    listed = {c: df.schema[c].dataType.typeName() == "array" for c in columns}
    cells = F.array(*[F.col(c) if many else F.array(c) for c, many in listed.items()])
    odd = F.concat_ws("", *columns).rlike(NON_ASCII)
    df = df.withColumn("_cells", _nfkc_cells(F.when(odd, cells)))
    changed = {}
    for i, (c, many) in enumerate(listed.items()):
        found = F.get("_cells", i) if many else F.get(F.get("_cells", i), 0)
        changed[c] = F.when(F.col(c).isNotNull(), F.coalesce(found, c))
    return df.withColumns(changed).drop("_cells")


def strip(c) -> Column:
    return F.btrim(_col(c), F.lit(WHITESPACE))


def collapse_ws(c) -> Column:
    """One space for every run of whitespace, none at the ends."""
    c = _col(c)
    return F.trim(F.when(c.rlike(ODD), F.regexp_replace(c, WS, " ")).otherwise(c))


def blank_null(c) -> Column:
    """Null for the empty string."""
    c = _col(c)
    return F.when(c != "", c)


def fill(c) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def clean_text(c, normalized: bool = False) -> Column:
    """Null to empty, NFKC, whitespace collapsed and trimmed.

    ``normalized`` leaves NFKC out, for columns that went through :func:`nfkc_columns`.
    """
    return collapse_ws(fill(c if normalized else nfkc(c)))


def _name_steps(c: Column) -> Column:
    c = F.regexp_replace(strip(c), WS, " ")
    c = F.regexp_replace(c, r"[\x00-\x1f\x7f-\x9f]", "")
    c = F.translate(c, "‘’“”", "''\"\"")
    return strip(F.regexp_replace(c, r"\p{C}", ""))


def clean_name(c, normalized: bool = False) -> Column:
    """``clean_text`` for names: control characters dropped, quotes straightened."""
    c = F.trim(fill(c if normalized else nfkc(c)))
    return F.when(c.rlike(ODD), _name_steps(c)).otherwise(c)


def search_text(c) -> Column:
    """Search form: upper case, trimmed, whitespace collapsed."""
    return collapse_ws(F.upper(_col(c)))


def words(c) -> Column:
    """Whitespace-separated tokens, none of them empty."""
    return F.filter(F.split(_col(c), WS), lambda w: w != "")


def join_list(items: Column, separator: str = "; ") -> Column:
    """Trim the items, drop empty ones, join them. Null gives the empty string."""
    trimmed = F.transform(items, lambda x: strip(x))
    kept = F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_join(kept, separator), F.lit(""))


def join_parts(parts: Sequence[Column], separator: str) -> Column:
    """Join the non-empty columns; empty string when there are none."""
    return F.concat_ws(separator, *[blank_null(p) for p in parts])


def sorted_set(items: Column, separator: str = "; ") -> Column:
    """Distinct non-empty items in code-point order, joined."""
    kept = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_join(F.sort_array(F.array_distinct(kept)), separator), F.lit(""))


# Address words and their short forms, per source.
OFAC_ADDRESS_WORDS = [
    ("STREET", "ST"),
    ("AVENUE", "AVE"),
    ("BOULEVARD", "BLVD"),
    ("ROAD", "RD"),
    ("DRIVE", "DR"),
    ("LANE", "LN"),
    ("SUITE", "STE"),
    ("APARTMENT", "APT"),
    ("FLOOR", "FL"),
    ("UNITED STATES OF AMERICA", "USA"),
    ("UNITED STATES", "USA"),
    ("UNITED KINGDOM", "UK"),
    ("UNITED ARAB EMIRATES", "UAE"),
]
UK_ADDRESS_WORDS = [
    ("STREET", "ST"),
    ("AVENUE", "AVE"),
    ("BOULEVARD", "BLVD"),
    ("ROAD", "RD"),
    ("DRIVE", "DR"),
    ("LANE", "LN"),
    ("COURT", "CT"),
    ("PLACE", "PL"),
    ("SQUARE", "SQ"),
    ("APARTMENT", "APT"),
    ("APPT", "APT"),
    ("BUILDING", "BLDG"),
    ("FLOOR", "FL"),
    ("SUITE", "STE"),
    ("NUMBER", "NO"),
    ("NORTH", "N"),
    ("SOUTH", "S"),
    ("EAST", "E"),
    ("WEST", "W"),
]


def _shorten(c: Column, table: Sequence[tuple[str, str]]) -> Column:
    """The words of the table by their short forms, in any case, whole words only.

    No short form is part of another word of the table, so one pass that marks the words does for all of them.
    """
    # Of the words that begin alike the longest comes first in the table.
    found = rf"(?iU)\b({'|'.join(word for word, _ in table)})\b"

    def pieces(marked: Column) -> Column:
        # Of the letters that count as an i in any case, upper case leaves the dotted one.
        short = lambda w: F.coalesce(looked_up(F.upper(F.translate(w, "İ", "I")), dict(table)), w)
        return F.transform(F.split(marked, "\x01"), lambda w, i: F.when(i % 2 == 1, short(w)).otherwise(w))

    def one_by_one(text: Column) -> Column:
        for word, short in table:
            text = F.regexp_replace(text, rf"(?iU)\b{word}\b", short)
        return text

    def shortened(text: Column) -> Column:
        marked = F.regexp_replace(text, found, "\x01$1\x01")
        return F.when(text.contains("\x01"), one_by_one(text)).otherwise(F.array_join(pieces(marked), ""))

    return let(c, shortened)


def ofac_address(c, normalized: bool = False) -> Column:
    """Whitespace, NFKC, then the OFAC word replacements.

    ``normalized`` leaves the first two out, for columns that went through them.
    """
    return strip(_shorten(_col(c) if normalized else nfkc(collapse_ws(fill(c))), OFAC_ADDRESS_WORDS))


def uk_address(c) -> Column:
    """``clean_text``, ", " after commas, then the UK word replacements."""
    tidy = F.regexp_replace(clean_text(c), r"(?U)\s*,\s*", ", ")
    return strip(_shorten(tidy, UK_ADDRESS_WORDS))
