"""Column functions. Everything is a built-in expression but for the two
Arrow functions ``nfkc`` and ``seq_ratio``."""

from taktline.functions.ids import (
    canonical_operator, links_operator_id, operator_id, prefecture_name, selector_no, short_hash,
    url_host,
)
from taktline.functions.measures import (
    fmt_time, gtfs_seconds, haversine_km, is_bus_route, num, pct_change, safe_rate,
)
from taktline.functions.names import name_signals, nfkc, normalize_name, seq_ratio, seq_ratio_from
from taktline.functions.text import (
    classify_dataset, disposition_filename, effective_date, has_value, infer_year, parse_date2,
    parse_date3, safe_slug, slug_pair, split_pairs, strip, truth, upload_datetime,
)

__all__ = [
    "canonical_operator", "classify_dataset", "disposition_filename", "effective_date", "fmt_time",
    "gtfs_seconds", "has_value", "haversine_km", "infer_year", "is_bus_route", "links_operator_id",
    "name_signals", "nfkc", "normalize_name", "num", "operator_id", "parse_date2", "parse_date3",
    "pct_change", "prefecture_name", "safe_rate", "safe_slug", "selector_no", "seq_ratio", "seq_ratio_from",
    "short_hash", "slug_pair", "split_pairs", "strip", "truth", "upload_datetime", "url_host",
]
