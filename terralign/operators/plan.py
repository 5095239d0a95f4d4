"""Planning: projection, ground resolution, headings and the neighbour graph of frames.

Frames have frame_id, flight_id, lat, lon and an order column. All graphs are per flight; a flight of any size is spread
over grid cells, so no task holds a whole flight except where an operator says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.checkpoints import cut
from . import greedy, ordered

#: Flights of a wider reach are broadcast up to this number (a row of two columns each) and joined by a shuffle beyond.
BROADCAST = 1_000_000


def dominant_crs(frames: DataFrame, by: list[str]) -> DataFrame:
    """The UTM system of each group, from the upper medians of latitude and longitude, by selection over range partitions."""
    medians = [ordered.upper_median(frames, by, name, f"median_{name}") for name in ("lat", "lon")]
    return medians[0].join(medians[1], by).withColumn("epsg", geo.utm_epsg(F.col("median_lat"), F.col("median_lon")))


def target_resolution(frames: DataFrame, factor: float) -> DataFrame:
    """One row: factor times the median of the ground resolutions above 0, null without any."""
    middle = ordered.median(frames.filter("gsd > 0"), [], "gsd", "median_gsd")
    return middle.select((F.col("median_gsd") * factor).alias("target_gsd"))


def project_utm(frames: DataFrame, by: list[str]) -> DataFrame:
    """Adds epsg, easting and northing, in one system for each group."""
    both = frames.join(dominant_crs(frames, by).select(*by, "epsg"), by)
    east, north = geo.to_utm(F.col("lat"), F.col("lon"), F.col("epsg"))
    return both.withColumns({"easting": east, "northing": north})


def fill_headings(frames: DataFrame, by: list[str], order: list[str], x: str = "easting", y: str = "northing") -> DataFrame:
    """Fills yaw where it is null: the way to the next frame if that is over 2 m, for the last frame the way from the
    previous one; else 0. A next frame within 2 m gives 0, the previous one is not asked then. Tracks may be of any length."""
    def way(de: Column, dn: Column) -> Column:
        bearing = F.pmod(F.degrees(F.atan2(de, dn)) + 360.0, F.lit(360.0))
        return F.when(F.hypot(de, dn) > 2.0, bearing)

    def usable(a: Column, b: Column) -> Column:
        return F.coalesce((a != 0) & (b != 0), F.lit(False))

    def filled(w) -> dict[str, Column]:
        here, there = F.col(x), F.col(y)
        ahead = usable(here, F.lead(x).over(w))
        behind = usable(here, F.lag(x).over(w))
        forward = way(F.lead(x).over(w) - here, F.lead(y).over(w) - there)
        backward = way(here - F.lag(x).over(w), there - F.lag(y).over(w))
        guess = F.when(ahead, forward).when(behind, backward)
        return {"yaw": F.coalesce(F.col("yaw").cast("double"), guess, F.lit(0.0))}

    return ordered.beside(frames, by, order, [x, y], filled)


def near_pairs(frames: DataFrame, reach: float, x: str, y: str, by: list[str], at_most: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (u, v, distance) of one group nearer than reach, or at most as far, each once, u < v; with c_u and c_v for each c in keep. A
    grid of cells of that width, each frame looking at its own and the four cells ahead of it, makes the join an equi-join."""
    base = frames.withColumns({"x": F.col(x), "y": F.col(y)})
    base = base.select(*by, F.struct("frame_id", "x", "y", *keep).alias("__frame"), F.floor(F.col("x") / reach).cast("long").alias("cx"), F.floor(F.col("y") / reach).cast("long").alias("cy"))
    ahead = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    asks = base.withColumn("to", F.explode(ahead)).select(*by, F.col("__frame").alias("one"), (F.col("cx") + F.col("to.dx")).alias("cx"), (F.col("cy") + F.col("to.dy")).alias("cy"), ((F.col("to.dx") == 0) & (F.col("to.dy") == 0)).alias("own"))
    pairs = asks.join(base.withColumnRenamed("__frame", "two"), [*by, "cx", "cy"])
    pairs = pairs.filter((F.col("one.frame_id") < F.col("two.frame_id")) | (~F.col("own") & (F.col("one.frame_id") > F.col("two.frame_id"))))
    dx, dy = F.col("one.x") - F.col("two.x"), F.col("one.y") - F.col("two.y")
    pairs = pairs.withColumn("distance", F.sqrt(dx * dx + dy * dy)).filter(F.col("distance") <= reach if at_most else F.col("distance") < reach)
    first = F.col("one.frame_id") < F.col("two.frame_id")
    end = lambda a, b, c: F.when(first, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}"))
    ends = [("u", "one", "two"), ("v", "two", "one")]
    return pairs.select(*by, *(end(a, b, "frame_id").alias(s) for s, a, b in ends), "distance", *(end(a, b, c).alias(f"{c}_{s}") for c in keep for s, a, b in ends))


def _both_ways(*names: tuple[str, str, str, str]) -> Column:
    """A pair in both directions: for (u, v, a, b) the columns u and v as a and b, and as b and a."""
    there = F.struct(*(F.col(c).alias(d) for u, v, a, b in names for c, d in ((u, a), (v, b))))
    back = F.struct(*(F.col(c).alias(d) for u, v, a, b in names for c, d in ((v, a), (u, b))))
    return F.explode(F.array(there, back))


def candidate_pairs(frames: DataFrame, reach: float, x: str, y: str, by: list[str], at_most: bool = False) -> DataFrame:
    """Directed pairs (a, b, distance) of one group nearer than reach, or at most as far."""
    pairs = near_pairs(frames, reach, x, y, by, at_most)
    return pairs.select(*by, "distance", _both_ways(("u", "v", "a", "b")).alias("way")).select(*by, "way.a", "way.b", "distance")


def neighbor_graph(frames: DataFrame, k: int = 6, reach: float = 80.0, x: str = "x", y: str = "y", by: list[str] | None = None) -> DataFrame:
    """Undirected pairs (source_id < target_id) where one is among the k nearest of the other within reach metres, by distance."""
    by = by or []
    near = Window.partitionBy("a").orderBy(F.round("distance", 6), "b")
    ranked = candidate_pairs(frames, reach, x, y, by).withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)
    pair = ranked.select(*by, F.least("a", "b").alias("source_id"), F.greatest("a", "b").alias("target_id"), "distance")
    return pair.groupBy(*by, "source_id", "target_id").agg(F.min("distance").alias("distance_m")).orderBy("distance_m", "source_id", "target_id")


def flight_edges(frames: DataFrame, order: list[str], reach: float = 120.0) -> DataFrame:
    """Edges from each frame to the next of its flight if that is within reach; flights may be of any length."""

    def ahead(w) -> dict[str, Column]:
        return {"target_id": F.lead("frame_id").over(w), "distance_m": geo.haversine_m(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))}

    every = ordered.beside(frames, ["flight_id"], order, ["frame_id", "lat", "lon"], ahead)
    return every.filter(F.col("distance_m") <= reach).select("flight_id", F.col("frame_id").alias("source_id"), "target_id", "distance_m")


def expanded_reach(frames: DataFrame, reach: float, x: str, y: str, by: list[str], pairs: DataFrame | None = None) -> DataFrame:
    """(by, isolated, helped, reach): 1.5 times the reach where some frame has no other within the reach (isolated) and some
    frame, alone or not, has one within 1.5 times the reach (helped). Both limits are included; pairs: near_pairs at most that far, if known."""
    pairs = near_pairs(frames, 1.5 * reach, x, y, by, at_most=True) if pairs is None else pairs
    wide = pairs.select(*by, "distance", F.explode(F.array("u", "v")).alias("a")).groupBy(*by, "a").agg(F.min("distance").alias("nearest"))
    every = frames.select(*by, F.col("frame_id").alias("a")).join(wide, [*by, "a"], "left")
    alone = F.coalesce(F.col("nearest") > reach, F.lit(True))
    counted = every.groupBy(*by).agg(F.count_if(alone).alias("isolated"), F.count_if(F.col("nearest").isNotNull()).alias("helped"))
    return counted.withColumn("reach", F.when((F.col("isolated") > 0) & (F.col("helped") > 0), 1.5 * reach).otherwise(float(reach)))


def capped_graph(frames: DataFrame, order: list[str], reach: float = 120.0, cap: int = 6, flight_order: bool = True, expand: bool = True) -> DataFrame:
    """The greedy graph with a cap on degrees, in order of distance (four digits) and ids within each flight.

    Edges along the flight come first and aren't capped. Then frames in order take their nearest, 2 * cap at most, while
    both ends have room. With `expand`, a flight in which a frame is alone reaches 1.5 times as far if that helps any frame.
    Frames without position take no part. The choice is made by `greedy.capped`, so flights may have any number of frames.
    """
    known = frames.filter("lat IS NOT NULL AND lon IS NOT NULL").select("flight_id", "frame_id", "lat", "lon", *(c for c in order if c != "frame_id"))
    known = cut(ordered.ranked(ordered.dealt(known, ["flight_id"], order), ["flight_id"], order))
    middle = known.groupBy("flight_id").agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))
    px, py = geo.local_plane(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    placed = cut(known.join(middle, "flight_id").withColumns({"px": px, "py": py}).select("flight_id", "frame_id", "pos", "lat", "lon", "px", "py", ordered.PART))
    farthest = 1.5 * reach if expand else reach
    pairs = near_pairs(placed, farthest, "px", "py", ["flight_id"], at_most=True, keep=("pos", "lat", "lon"))
    metres = geo.haversine_m(F.col("lat_u"), F.col("lon_u"), F.col("lat_v"), F.col("lon_v"))
    pairs = cut(pairs.select("flight_id", "u", "v", F.col("pos_u").alias("pu"), F.col("pos_v").alias("pv"), "distance", metres.alias("metres")))
    if expand:
        own = cut(expanded_reach(placed, reach, "px", "py", ["flight_id"], pairs).filter(F.col("reach") > reach).select("flight_id", F.lit(True).alias("wide")))
        own = F.broadcast(own) if own.count() <= BROADCAST else own
    limit = F.when(F.col("wide"), farthest).otherwise(float(reach)) if expand else F.lit(float(reach))
    told = lambda e: (e.join(own, "flight_id", "left") if expand else e).withColumn("limit", limit)
    near = Window.partitionBy("flight_id", "pa").orderBy("distance", "pb")
    follows = (F.abs(F.col("pu") - F.col("pv")) == 1) & (F.col("metres") <= F.col("limit")) if flight_order else F.lit(False)
    spatial = told(pairs).filter(F.col("distance") < F.col("limit")).withColumn("follows", follows)
    spatial = spatial.select("flight_id", "u", "v", "pu", "pv", "distance", "metres", "follows", _both_ways(("pu", "pv", "pa", "pb")).alias("way")).withColumns({"pa": F.col("way.pa"), "pb": F.col("way.pb")})
    spatial = spatial.drop("way").withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= 2 * cap).filter("NOT follows")
    spatial = spatial.groupBy("flight_id", "u", "v", "pu", "pv", "metres").agg(F.min(F.col("pa") * (2 * cap + 1) + F.col("rank")).alias("key"))
    nodes = placed.select(F.col("flight_id").alias("g"), F.col("frame_id").alias("u"), F.col("pos").alias("pu"), F.lit(0).cast("long").alias("degree"))
    if flight_order:
        first = told(flight_edges(placed, ["pos"], farthest)).filter(F.col("distance_m") <= F.col("limit"))
        first = first.select("flight_id", F.least("source_id", "target_id").alias("u"), F.greatest("source_id", "target_id").alias("v"), F.col("distance_m").alias("metres"))
        first = cut(first.dropDuplicates(["flight_id", "u", "v"]))
        degree = first.select(F.col("flight_id").alias("g"), F.explode(F.array("u", "v")).alias("u")).groupBy("g", "u").agg(F.count(F.lit(1)).alias("along"))
        nodes = nodes.join(degree, ["g", "u"], "left").select("g", "u", "pu", F.coalesce("along", F.lit(0)).cast("long").alias("degree"))
    taken = greedy.capped(spatial.withColumnRenamed("flight_id", "g"), nodes, cap).withColumnRenamed("g", "flight_id")
    taken = taken.unionByName(first) if flight_order else taken
    out = taken.select("flight_id", F.col("u").alias("source_id"), F.col("v").alias("target_id"), F.col("metres").alias("distance_m"))
    return out.orderBy("flight_id", F.round("distance_m", 4), "source_id", "target_id")
