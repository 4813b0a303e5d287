"""Operator names: normal form, similarity, signals."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StringType

from taktline.constants import LEGAL_FORMS


@F.pandas_udf(StringType())
def nfkc(names: pd.Series) -> pd.Series:
    """Unicode NFKC, once per distinct value of the Arrow batch."""
    forms = {n: unicodedata.normalize("NFKC", n) for n in names.dropna().unique()}
    return pd.Series([forms.get(n) for n in names], dtype=object)


@F.pandas_udf(DoubleType())
def seq_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity; the order of the arguments matters."""
    return pd.Series(
        [difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64"
    )


def seq_ratio_from(threshold: float):
    """The similarity where it reaches ``threshold``; NULL where shared characters, counted once, already say no."""

    @F.pandas_udf(DoubleType())
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(a: str, b: str) -> float | None:
            matcher = difflib.SequenceMatcher(None, a, b)
            return matcher.ratio() if matcher.quick_ratio() >= threshold else None

        return pd.Series([one(a, b) for a, b in zip(left, right)], dtype="float64")

    return ratio


def normalize_name(c: Column, remove_legal: bool = True, unicode_forms: bool = True) -> Column:
    """NFKC, no white space, no legal form; NULL becomes ''.

    Only text beyond ASCII is handed to Python. ``unicode_forms=False`` leaves
    the NFKC step out, for names known to be in that form already.
    """
    text = F.coalesce(c, F.lit(""))
    if unicode_forms:
        beyond_ascii = F.when(text.rlike(r"[^\x00-\x7F]"), text)
        text = F.coalesce(nfkc(beyond_ascii), text)
    text = F.regexp_replace(text, r"(?U)[\s\x1c-\x1f　]+", "")
    if remove_legal:
        # Longest first and one after the other: a removal can make a new match.
        for form in sorted(LEGAL_FORMS, key=len, reverse=True):
            text = F.replace(text, F.lit(unicodedata.normalize("NFKC", form)), F.lit(""))
    return text


def name_signals(name: Column) -> dict[str, Column]:
    """Text signals only; they classify nothing."""
    return {
        "municipal_suffix": name.rlike("(市|区|町|村)$"),
        "council_name": name.contains("協議会"),
        "iyo_rail_check": name.contains("伊予鉄") | name.contains("いよてつ"),
    }
