"""String, JSON and array functions (C)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that say nothing about a substance, only about its form.
FORM_WORDS = ("acid", "acetate", "cation", "chloride", "dichloride", "hydrochloride", "hydrate", "ion", "maleate", "phosphate", "sodium", "sulfate", "tartrate")
#: Parts of names of biological substances, and their types.
BIOLOGIC_TERMS = (
    "albumin", "insulin", "interferon", "antibody", "immunoglobulin", "peptide", "heparin", "corticotropin", "romiplostim",
    "ecallantide", "exenatide", "nesiritide", "mipomersen", "ustekinumab", "ofatumumab", "liraglutide", "tesamorelin", "teduglutide",
)
BIOLOGIC_TYPES = ("Antibody", "Enzyme", "Oligosaccharide", "Protein")


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def casefold(c: Column | str) -> Column:
    """NFKC and case folding: built in for ASCII, one Arrow batch function for the rest."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), F.lower(c)).otherwise(_folded(c))


def normalize_text(c: Column | str) -> Column:
    """NFKC, trimmed, folded, white space collapsed."""
    return F.trim(F.regexp_replace(casefold(c), r"\s+", " "))


def normalize_dots(c: Column | str) -> Column:
    """As C1 with dots as spaces; the collapse comes after, without another trim."""
    return F.regexp_replace(F.replace(normalize_text(c), F.lit("."), F.lit(" ")), r"\s+", " ")


def normalize_alnum(c: Column | str) -> Column:
    """Letters a-z and digits only, single spaces between."""
    return F.trim(F.regexp_replace(casefold(c), "[^a-z0-9]+", " "))


def normalize_key(c: Column | str) -> Column:
    """C4: trimmed upper case."""
    return F.upper(F.trim(c))


def extract_cui(c: Column | str) -> Column:
    """The concept id of ``C1234567`` or ``UMLS:C1234567``, upper case, else null."""
    return F.nullif(F.upper(F.regexp_extract(F.trim(c), r"(?i)^(?:UMLS:)?(C\d{7})$", 1)), F.lit(""))


def namespace(node_id: Column, title: Column) -> Column:
    """Namespace by the id's prefix, else the ontology's title, else ``OTHER``."""
    return F.when(F.lower(node_id).startswith("meddra:"), "MEDDRA").when(F.upper(node_id).startswith("HP_"), "HPO").otherwise(F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("OTHER")))


def significant_tokens(c: Column | str) -> Column:
    """Distinct tokens of four letters or more that aren't form words."""
    return F.array_except(F.filter(F.split(normalize_alnum(c), " "), lambda t: F.length(t) >= 4), F.array(*map(F.lit, FORM_WORDS)))


def json_list(a: Column, spaced: bool = False) -> Column:
    """Strings as a JSON list in their order, compact or with a space after commas."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))), ", " if spaced else ","), F.lit("]"))


def json_ids(a: Column, spaced: bool = False) -> Column:
    """Sorted distinct ids as a JSON list, compact or with a space after commas."""
    return json_list(F.array_sort(F.array_distinct(F.filter(a, lambda x: x.isNotNull()))), spaced)


def by_casefold(a: Column) -> Column:
    """Strings in the order of their lower case, equal ones by themselves."""
    return F.array_sort(F.transform(a, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v"))))["v"]


def parse_ids(s: Column | str) -> Column:
    """A JSON list as an array; null or empty text is an empty list, anything else that
    isn't a list of strings an error."""
    s = F.col(s) if isinstance(s, str) else s
    got = F.from_json(s, "array<string>")
    blank = s.isNull() | (F.trim(s) == "")
    return F.when(blank, F.array().cast("array<string>")).when(got.isNull(), F.raise_error(F.lit("not a JSON list of strings"))).otherwise(got)


def ordered_fields(found: Column, order: tuple[str, ...]) -> Column:
    """The names found, in a fixed order, joined by ``;``."""
    return F.array_join(F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(found, x)), ";")


def anchor_id(prefix: str, i: Column) -> Column:
    """``PREFIX_007``."""
    return F.format_string(f"{prefix}_%03d", i)


def parse_bool(c: Column | str) -> Column:
    """C11: true/false, 1/0, yes/no in any case; anything else is an error."""
    x = F.lower(F.trim(c))
    return F.when(x.isin("true", "1", "yes"), True).when(x.isin("false", "0", "no"), False).otherwise(F.raise_error(F.lit("not a boolean")).cast("boolean"))


def has_any_term(c: Column, terms: tuple[str, ...]) -> Column:
    """Whether any term is part of the text."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(c, F.lit(t))
    return out


def is_combination(c: Column | str) -> Column:
    """A name that joins ingredients with ``and``."""
    return F.contains(F.concat(F.lit(" "), normalize_alnum(c), F.lit(" ")), F.lit(" and "))


def is_biologic(name: Column | str, types: Column) -> Column:
    """A name with a biologic term, or a candidate of a biologic type (an array of types)."""
    return has_any_term(normalize_alnum(name), BIOLOGIC_TERMS) | F.coalesce(F.arrays_overlap(types, F.array(*map(F.lit, BIOLOGIC_TYPES))), F.lit(False))
