"""Product codes, marketplace URLs and country lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.dictionaries import (
    CODE_PATTERNS,
    COUNTRY_DOMAINS,
    COUNTRY_NAMES,
    COUNTRY_SETS,
    DEFAULT_DOMAIN,
    MARKETPLACE_DOMAINS,
    PRODUCT_PATHS,
)
from reviewloom.functions.text import strip


def valid_asin(code: Column, mode: str = "strict") -> Column:
    """Ten characters; ``strict`` also wants a leading B, ``any`` upper case only."""
    pattern = r"^B[A-Za-z0-9]{9}\z" if mode == "strict" else r"^[A-Z0-9]{10}\z"
    return F.coalesce(code.rlike(pattern), F.lit(False))


def extract_asin(text: Column, mode: str = "strict") -> Column:
    """First product code found by the ordered patterns of the mode, else NULL."""
    value = strip(text)
    upper = F.upper(value)
    found = []
    for pattern in CODE_PATTERNS[mode]:
        code = F.upper(F.regexp_extract(value, "(?i)" + pattern, 1))
        usable = valid_asin(code) if mode == "strict" else code != ""
        found.append(F.when(usable, code))
    whole = valid_asin(value) if mode == "strict" else valid_asin(upper, "any")
    return F.coalesce(F.when(whole, upper), *found)


def is_marketplace_url(url: Column, mode: str = "domain") -> Column:
    """``domain``: one of the known domains; ``path``: also a product path."""
    text = F.coalesce(url, F.lit(""))
    found = F.lit(False)
    if mode == "domain":
        for domain in MARKETPLACE_DOMAINS:
            found = found | F.lower(text).contains(domain)
        return found
    for path in PRODUCT_PATHS:
        found = found | text.contains(path)
    return text.contains("amazon.") & found


def _lookup(code: Column, table: dict[str, str]) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(code == key, value) if out is None else out.when(code == key, value)
    return out


def country_domain(country: Column, form: str = "service") -> Column:
    """Domain of a country; unknown countries use the default one.

    The live form compares the code as given, the others fold its case.
    """
    known = {c: COUNTRY_DOMAINS[c] for c in COUNTRY_SETS[form]}
    code = country if form == "live" else F.upper(country)
    return F.coalesce(_lookup(code, known), F.lit(DEFAULT_DOMAIN))


def product_url(code: Column, country: Column, form: str = "service") -> Column:
    return F.concat(F.lit("https://www."), country_domain(country, form), F.lit("/dp/"), code)


def country_name(country: Column) -> Column:
    return F.coalesce(_lookup(F.upper(country), COUNTRY_NAMES), country)
