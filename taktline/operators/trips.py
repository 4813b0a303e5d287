"""Stop times: span of a trip, distance of a trip, stop pairs.

A trip is ordered by ``(stop_sequence, row_ix)``. The order is needed twice, and
neither use may put a very long trip into one task:

* first and last time: ``min_by`` / ``max_by``, combined on the map side;
* consecutive stops: ``lag`` inside *blocks* of a trip (a range of stop
  sequences), while the pair that bridges two blocks comes from the block
  summary. A block with more rows than ``hot_rows`` (many rows repeat the same
  sequence number) is cut again by sequence and by row number, which keeps the
  order. The list of such blocks has fewer than ``rows / hot_rows`` entries, so
  that it is small enough to broadcast by construction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from taktline.constants import ARCHIVE_KEYS
from taktline.functions import haversine_km
from taktline.workspace import Lazy, Workspace

A = list(ARCHIVE_KEYS)
TRIP = [*A, "trip_id"]
BLOCK = [*TRIP, "blk"]
PART = [*BLOCK, "sub_seq", "sub_row"]

BLOCK_WIDTH = 4096
HOT_BLOCK_ROWS = 1_000_000
PIECE_ROWS = 65_536
SLICE_ROWS = 1 << 25  # stop times, about, that get their coordinates in one step: what it shuffles, some 130 bytes a row, is on the disks at once


def _rows(stop_times: DataFrame) -> DataFrame:
    """Needed columns only; arrival counts before departure."""
    return stop_times.select(
        *TRIP,
        F.coalesce("stop_id", F.lit("")).alias("stop_id"),
        F.coalesce("stop_sequence", F.lit(0)).alias("stop_sequence"),
        F.coalesce("arrival_sec", "departure_sec").alias("t"),
        "row_ix",
    )


def _order() -> Column:
    return F.struct("stop_sequence", "row_ix")


def _first_last(rows: DataFrame, keys: list[str]) -> DataFrame:
    timed = F.when(F.col("t").isNotNull(), _order())
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.min_by("stop_id", _order()).alias("first_stop"),
        F.max_by("stop_id", _order()).alias("last_stop"),
        F.min_by("t", timed).alias("first_sec"),
        F.max_by("t", timed).alias("last_sec"),
    )


def trip_span(stop_times: DataFrame) -> DataFrame:
    """First and last known time of a trip and the seconds between them."""
    timed = F.when(F.col("t").isNotNull(), _order())
    return _rows(stop_times).groupBy(*TRIP).agg(
        F.min_by("t", timed).alias("first_sec"), F.max_by("t", timed).alias("last_sec")
    ).where("first_sec IS NOT NULL").withColumn(
        "seconds", F.greatest(F.lit(0), F.col("last_sec") - F.col("first_sec"))
    )


def _blocks(
    rows: DataFrame, width: int, hot_rows: int, piece_rows: int, workspace: Workspace | Lazy = Lazy()
) -> tuple[DataFrame, DataFrame]:
    """The rows with their part of the trip, and one summary row per part."""
    rows = rows.withColumn("blk", F.expr(f"stop_sequence div {width}"))
    per_block = workspace.keep(_first_last(rows, BLOCK), "trip_blocks")
    hot = F.broadcast(per_block.where(F.col("n_rows") > hot_rows).select(*BLOCK, F.lit(True).alias("hot")))
    pieces = {
        "sub_seq": F.when(F.col("hot"), F.col("stop_sequence")).otherwise(0),
        "sub_row": F.when(F.col("hot"), F.expr(f"row_ix div {piece_rows}")).otherwise(0),
    }
    parted = rows.join(hot, BLOCK, "left").withColumns(pieces).drop("hot")
    calm = per_block.where(F.col("n_rows") <= hot_rows).withColumns(
        {"sub_seq": F.lit(0), "sub_row": F.lit(0).cast("bigint")}
    )
    cut = _first_last(rows.join(hot, BLOCK).withColumns(pieces), PART)
    return parted, calm.unionByName(cut)


def _span_of_parts(parts: DataFrame) -> DataFrame:
    order = F.struct("blk", "sub_seq", "sub_row")
    timed = F.when(F.col("first_sec").isNotNull(), order)
    return parts.groupBy(*TRIP).agg(
        F.min_by("first_sec", timed).alias("first_sec"),
        F.max_by("last_sec", timed).alias("last_sec"),
    ).where("first_sec IS NOT NULL").withColumn(
        "seconds", F.greatest(F.lit(0), F.col("last_sec") - F.col("first_sec"))
    )


def _bridges(parts: DataFrame, carry: list[str]) -> DataFrame:
    """The pair that leads from one part of a trip into the next."""
    w = Window.partitionBy(*TRIP).orderBy("blk", "sub_seq", "sub_row")
    return parts.withColumn("from_stop", F.lag("last_stop").over(w)).where(
        "from_stop IS NOT NULL"
    ).select(*TRIP, *carry, "from_stop", F.col("first_stop").alias("to_stop"))


def _pairs_in_parts(parted: DataFrame, carry: list[str]) -> DataFrame:
    """Pairs inside a part; the first stop of a part has no predecessor."""
    w = Window.partitionBy(*PART).orderBy("stop_sequence", "row_ix")
    return parted.select(
        *TRIP, *carry, F.lag("stop_id").over(w).alias("from_stop"), F.col("stop_id").alias("to_stop")
    )


def _km_in_parts(placed: DataFrame, carry: list[str]) -> DataFrame:
    """Stops inside a part with the distance from the stop before, NULL where a coordinate or that stop is missing."""
    w = Window.partitionBy(*PART).orderBy("stop_sequence", "row_ix")
    before = [F.lag(c).over(w) for c in ("stop_lat", "stop_lon")]
    km = haversine_km(*before, F.col("stop_lat"), F.col("stop_lon"))
    return placed.select(*TRIP, *carry, F.col("stop_id").alias("to_stop"), km.alias("km"))


def stop_pairs(
    stop_times: DataFrame,
    width: int = BLOCK_WIDTH,
    hot_rows: int = HOT_BLOCK_ROWS,
    piece_rows: int = PIECE_ROWS,
    workspace: Workspace | Lazy = Lazy(),
) -> DataFrame:
    """Consecutive stops of every trip."""
    parted, parts = _blocks(_rows(stop_times), width, hot_rows, piece_rows, workspace)
    inside = _pairs_in_parts(parted, []).where("from_stop IS NOT NULL")
    return inside.unionByName(_bridges(parts, []))


def stop_coordinates(stops: DataFrame) -> DataFrame:
    """Stops with both coordinates; the last source row of an id wins."""
    return stops.where("stop_lat IS NOT NULL AND stop_lon IS NOT NULL").groupBy(*A, "stop_id").agg(
        F.max_by("stop_lat", "row_ix").alias("stop_lat"), F.max_by("stop_lon", "row_ix").alias("stop_lon")
    )


def join_segment_coords(pairs: DataFrame, stops: DataFrame) -> DataFrame:
    """Distance of stop pairs; a missing coordinate leaves the pair out."""
    return _between_points(pairs, stop_coordinates(stops))


def _between_points(pairs: DataFrame, points: DataFrame) -> DataFrame:
    start = points.withColumnsRenamed({"stop_id": "from_stop", "stop_lat": "lat1", "stop_lon": "lon1"})
    end = points.withColumnsRenamed({"stop_id": "to_stop", "stop_lat": "lat2", "stop_lon": "lon2"})
    return pairs.join(start, [*A, "from_stop"]).join(end, [*A, "to_stop"]).withColumn(
        "km", haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    ).drop("lat1", "lon1", "lat2", "lon2")


def trip_km(
    stop_times: DataFrame, stops: DataFrame, workspace: Workspace | Lazy = Lazy(), **block_args: int
) -> DataFrame:
    """Straight-line length of a trip; a trip without a valid pair is left out.

    Coordinates come to the stop times, so that both ends of a pair need one join; only the pairs that bridge two parts
    are looked up by themselves.
    """
    parted, parts = trip_blocks(stop_times, workspace=workspace, **block_args)
    inside = _km_in_parts(with_coordinates(parted, stops), []).where("km IS NOT NULL").select(*TRIP, "km")
    bridges = workspace.keep(_bridges(parts, []), "bridges")
    between = join_segment_coords(bridges, stops).select(*TRIP, "km")
    return inside.unionByName(between).groupBy(*TRIP).agg(
        F.sum("km").alias("km"), F.count("*").alias("valid_segments")
    )


def with_coordinates(rows: DataFrame, stops: DataFrame) -> DataFrame:
    """Rows with a ``stop_id`` and the coordinates of the stop, NULL where they are not known."""
    return rows.join(stop_coordinates(stops), [*A, "stop_id"], "left")


def _slices(parts: DataFrame, workspace: Workspace | Lazy) -> int:
    """How many steps the stop times of ``parts`` take; plans alone are one step."""
    if isinstance(workspace, Lazy):
        return 1
    return max(1, -(-(parts.agg(F.sum("n_rows")).first()[0] or 0) // SLICE_ROWS))


def _visits(parted: DataFrame, owned: DataFrame, points: DataFrame, owner: list[str]) -> DataFrame:
    """How often each agency and service comes to a stop inside parts, and over how many kilometres in all."""
    placed = parted.join(points, [*A, "stop_id"], "left").join(owned.select(*PART, *owner), PART)
    return _km_in_parts(placed, owner).groupBy(*A, *owner, "to_stop").agg(F.count("*").alias("n"), F.sum("km").alias("km"))


def trip_blocks(
    stop_times: DataFrame,
    width: int = BLOCK_WIDTH,
    hot_rows: int = HOT_BLOCK_ROWS,
    piece_rows: int = PIECE_ROWS,
    workspace: Workspace | Lazy = Lazy(),
) -> tuple[DataFrame, DataFrame]:
    """Stop times with their part of the trip, and one summary row per part."""
    return _blocks(_rows(stop_times), width, hot_rows, piece_rows, workspace)


def trip_facts(
    stop_times: DataFrame,
    lookup: DataFrame,
    width: int = BLOCK_WIDTH,
    hot_rows: int = HOT_BLOCK_ROWS,
    piece_rows: int = PIECE_ROWS,
    workspace: Workspace | Lazy = Lazy(),
    blocks: tuple[DataFrame, DataFrame] | None = None,
    stops: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Both views of the stop times that the service metrics need.

    ``spans``: first and last time per trip. ``segments``: how often each
    agency and service runs from a stop to the next one (``from_stop`` NULL:
    first stop of a part). With ``stops``: how often it comes to a stop and over
    how many kilometres in all (``km``, NULL where none is known).
    ``blocks``: result of ``trip_blocks`` for the same stop times, where it is known.
    """
    parted, parts = blocks or trip_blocks(stop_times, width, hot_rows, piece_rows, workspace)
    owned = parts.join(lookup, TRIP)
    owner = ["agency_id", "service_id"]
    spans = _span_of_parts(parts).join(lookup, TRIP)
    if stops is not None:
        points, slices = stop_coordinates(stops), _slices(parts, workspace)
        if slices == 1:
            visits = _visits(parted, owned, points, owner)
        else:  # one after the other: an archive is in one of them, with its stops
            points, at = workspace.keep(points, "points"), F.pmod(F.xxhash64(*A), F.lit(slices))
            made = [workspace.keep(_visits(*(t.where(at == i) for t in (parted, owned, points)), owner), f"visits_{i}") for i in range(slices)]
            visits = reduce(DataFrame.unionByName, made)
        between = _between_points(workspace.keep(_bridges(owned, owner), "bridges"), points)
        return spans, visits.unionByName(between.select(*A, *owner, "to_stop", F.lit(0).cast("bigint").alias("n"), "km"))
    rows = parted.join(owned.select(*PART, *owner), PART)
    pairs = _pairs_in_parts(rows, owner).unionByName(_bridges(owned, owner))
    segments = pairs.groupBy(*A, *owner, "from_stop", "to_stop").agg(F.count("*").alias("n"))
    return spans, segments


def join_stoptimes_trips(stop_times: DataFrame, lookup: DataFrame) -> DataFrame:
    """Stop times of bus trips with agency, service and route."""
    return stop_times.join(lookup, TRIP)
