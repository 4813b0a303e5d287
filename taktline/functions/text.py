"""Cell text: trimming, dates, file names, blanks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from taktline.constants import BLANK_MARKS

_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0　"


def strip(c: Column) -> Column:
    """Trim white space of every kind, not only blanks."""
    return F.btrim(c, F.lit(_SPACE))


def _first_date(c: Column, *patterns: str) -> Column:
    text = strip(c.cast("string"))
    return F.coalesce(*[F.try_to_date(text, p) for p in patterns])


def parse_date3(c: Column) -> Column:
    """Catalogue dates: dashes, compact or slashes; NULL when none fits."""
    return _first_date(c, "yyyy-M-d", "yyyyMMdd", "yyyy/M/d")


def parse_date2(c: Column) -> Column:
    """Timetable dates: compact or dashes; NULL when none fits."""
    return _first_date(c, "yyyyMMdd", "yyyy-M-d")


def safe_slug(c: Column) -> Column:
    """A path-safe spelling of an identifier."""
    cleaned = F.btrim(F.regexp_replace(c.cast("string"), r"[^0-9A-Za-z._-]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("blank"))


def slug_pair(org: Column, feed: Column) -> Column:
    """Path-safe name of a feed pair."""
    return F.concat_ws("__", safe_slug(org), safe_slug(feed))


def disposition_filename(content_disposition: Column, path: Column) -> Column:
    """File name announced by the server, else the last part of the path."""
    announced = F.regexp_extract(
        F.coalesce(content_disposition, F.lit("")), r"(?i)filename\s*=\s*([^;]+)", 1
    )
    base = F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)
    return F.when(announced != "", F.btrim(strip(announced), F.lit('"'))).otherwise(base)


def upload_datetime(file_name: Column) -> Column:
    """UTC upload time stamped at the end of an archive's file name."""
    stamp = F.regexp_extract(file_name, r"_(20\d{12})\.zip$", 1)
    return F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMddHHmmss"))


def effective_date(file_name: Column) -> Column:
    """Effective start date in front of the upload stamp."""
    day = F.regexp_extract(file_name, r"_(20\d{6})_20\d{12}\.zip$", 1)
    return F.try_to_date(F.nullif(day, F.lit("")), "yyyyMMdd")


def classify_dataset(file_name: Column) -> Column:
    """Which statistics table a file holds, by its name; first rule wins."""
    lower = F.lower(file_name)
    return (
        F.when(
            file_name.contains("概況") | lower.contains("jigyougaiyou") | lower.contains("busreport"),
            "business_overview",
        )
        .when(
            file_name.contains("輸送実績")
            | lower.contains("yusoujisseki")
            | lower.contains("transport"),
            "transport_performance",
        )
        .when(lower.contains("specification") | file_name.contains("仕様書"), "specification")
        .otherwise("other")
    )


def has_value(c: Column) -> Column:
    """False for NULL and for the marks that stand for a blank cell."""
    return c.isNotNull() & ~strip(c.cast("string")).isin(*BLANK_MARKS)


def infer_year(c: Column) -> Column:
    """First year 1900-2099 in a text, '' when there is none."""
    return F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"((?:19|20)\d{2})", 1)


def truth(c: Column) -> Column:
    """Text spelling of a boolean."""
    return F.coalesce(F.lower(strip(c.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def split_pairs(c: Column) -> Column:
    """``org/feed|org/feed`` as an array of pairs; cells without ``/`` are left out."""
    cells = F.filter(F.split(F.coalesce(c, F.lit("")), "\\|"), lambda x: x.contains("/"))
    return F.transform(
        cells,
        lambda x: F.struct(
            F.get(F.split(x, "/", 2), F.lit(0)).alias("organization_id"),
            F.get(F.split(x, "/", 2), F.lit(1)).alias("feed_id"),
        ),
    )
