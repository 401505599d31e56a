"""Free-form name cleaning, keys and token lists."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NON_ASCII = r"[^\x00-\x7F]"
WHITESPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"

# Well-known misspellings and their accepted names.
DEFAULT_CORRECTIONS = {
    "Albizia zyia": "Albizia zygia",
    "Bagassa guiamensis": "Bagassa guianensis",
    "Hevea brasilensis": "Hevea brasiliensis",
    "Burckella obovati": "Burckella obovata",
    "Heritiera littoralin": "Heritiera littoralis",
    "Entandrophragma anolens": "Entandrophragma angolense",
}
# Texts that mean "no identifier".
MISSING_TOKENS = ("", "na", "n/a", "none", "null", "nan", "missing", "unknown")


@F.arrow_udf(T.StringType())
def _compatibility_form(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())


def to_col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def compatibility_form(value) -> Column:
    """Unicode NFKC. Only non-ASCII text is handed to the Arrow function; ASCII is already in that form."""
    text = to_col(value)
    return F.coalesce(_compatibility_form(F.when(text.rlike(NON_ASCII), text)), text)


def _base(value, unicode: bool) -> Column:
    text = F.coalesce(to_col(value), F.lit(""))
    return compatibility_form(text) if unicode else text


def _collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def strip_edges(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ .]+|[ .]+$", "")


def sanitize_name(value, unicode: bool = True) -> Column:
    """NFKC, underscores to spaces, single spaces, no blanks or dots at the ends."""
    return strip_edges(_collapse(F.translate(_base(value, unicode), "_", " ")))


def sanitize_meta(value, unicode: bool = True) -> Column:
    return _collapse(_base(value, unicode))


def canonical_name(value, unicode: bool = True) -> Column:
    """First word capitalised, every other letter lower-case."""
    clean = sanitize_name(value, unicode)
    return F.concat(F.upper(F.substring(clean, 1, 1)), F.lower(clean.substr(F.lit(2), F.length(clean))))


def name_key(value, unicode: bool = True) -> Column:
    return F.lower(canonical_name(value, unicode))


def name_key_loose(value, unicode: bool = True) -> Column:
    """The second key in use: lower-cased and trimmed before underscores become spaces."""
    text = F.lower(F.regexp_replace(_base(value, unicode), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return strip_edges(F.regexp_replace(F.translate(text, "_", " "), WHITESPACE, " "))


def genus_of(value, unicode: bool = True) -> Column:
    return F.substring_index(canonical_name(value, unicode), " ", 1)


def tokens(value, sep: str = ",") -> Column:
    """Distinct trimmed non-empty tokens of a delimited list."""
    parts = F.split(F.coalesce(to_col(value), F.lit("")), "[" + sep + "]")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def pipe_list(value) -> Column:
    """Pipe text to array, blanks dropped and repeats kept."""
    parts = F.split(F.coalesce(to_col(value), F.lit("")), "[|]")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def pipe_text(value) -> Column:
    return F.concat_ws("|", to_col(value))


def optional_id(value) -> Column:
    """Trimmed identifier, blank when the text only says that none exists."""
    text = F.trim(F.coalesce(to_col(value), F.lit("")))
    return F.when(F.lower(text).isin(*MISSING_TOKENS), F.lit("")).otherwise(text)


def non_blank(value) -> Column:
    """NULL instead of blank, for ``coalesce`` chains."""
    text = to_col(value)
    return F.when(text != "", text)
