"""Identity keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from taktline.constants import (
    MISSING_SELECTOR_NO, PREFECTURE_NATIONWIDE, PREFECTURE_NATIONWIDE_CODE, PREFECTURE_UNKNOWN,
    PREFECTURES,
)
from taktline.functions.names import normalize_name
from taktline.functions.text import strip


def short_hash(c: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def url_host(url: Column) -> Column:
    """Lower-case host without one leading ``www.``; '' when there is none."""
    host = F.regexp_extract(
        F.coalesce(url, F.lit("")),
        r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/:?#]+)", 1,
    )
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def prefecture_name(code: Column) -> Column:
    """Prefecture name of a catalogue code."""
    names = F.array(*[F.lit(p) for p in PREFECTURES])
    return (
        F.when(code.between(1, len(PREFECTURES)), F.get(names, (code - 1).cast("int")))
        .when(code == PREFECTURE_NATIONWIDE_CODE, PREFECTURE_NATIONWIDE)
        .otherwise(PREFECTURE_UNKNOWN)
    )


def canonical_operator(
    name: Column, url: Column, prefecture: Column, org: Column, unicode_forms: bool = True
) -> Column:
    """Identity key: normal name plus web host, or publisher and prefecture."""
    host = url_host(url)
    provenance = F.concat(F.lit("publisher:"), org, F.lit("|pref:"), prefecture)
    return F.concat_ws(
        "|",
        normalize_name(name, unicode_forms=unicode_forms),
        F.when(host != "", host).otherwise(provenance),
    )


def operator_id(identity_key: Column) -> Column:
    return short_hash(identity_key)


def links_operator_id(
    name: Column, number: Column, location: Column, unicode_forms: bool = True
) -> Column:
    """Provisional company key; NULL when a row has neither name nor number."""
    known = (F.coalesce(name, F.lit("")) != "") | (F.coalesce(number, F.lit("")) != "")
    number = strip(F.coalesce(number, F.lit("")))
    by_name = F.concat_ws(
        "|",
        normalize_name(name, unicode_forms=unicode_forms),
        normalize_name(location, unicode_forms=unicode_forms),
    )
    source = F.when(number != "", number).otherwise(by_name)
    return F.when(known, F.concat(F.lit("L-"), short_hash(source)))


def selector_no(selector: Column) -> Column:
    """0 for ``current``, N for ``prev_N``, 999 when missing."""
    number = F.regexp_extract(F.coalesce(selector, F.lit("")), r"^prev_(\d+)$", 1).try_cast("int")
    return F.when(selector == "current", 0).otherwise(F.coalesce(number, F.lit(MISSING_SELECTOR_NO)))
