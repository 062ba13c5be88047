"""Latitude-longitude lattices as tables: specs, cells, costs, safety bands, overlays and neighbours.

A lattice table has ``lattice_id, row, col, lat, lon`` and, once classified, ``class_index, confidence, cost``. Many
lattices may share a table; rows are dealt by lattice and cell, and neighbours are found by exploding offsets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.functions.geo import haversine_km
from fairlead.functions.zones import CLASSES, IMPASSABLE, zone_cost
from fairlead.operators.shared import large, written
from fairlead.sources.mask import SIDE, Land, LandMask

# Defaults of a lattice and its costs.
RESOLUTION, MAX_CELLS, MARGIN = 0.25, 400_000, 2.0
BAND_CELLS, BAND_PENALTY, SNAP_CELLS = 1, 1.6, 40
OFFSETS = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))
KEY = ("lattice_id", "row", "col")


@dataclass(frozen=True)
class Spec:
    south: float
    west: float
    resolution: float
    rows: int
    cols: int

    @classmethod
    def around(cls, south: float, north: float, west: float, east: float, resolution: float = RESOLUTION, margin: float = MARGIN, max_cells: int = MAX_CELLS) -> Spec:
        """The box with a margin, clamped; the resolution is coarsened (by half, up to 4 degrees) to fit the budget."""
        south, north = max(-85.0, south - margin), min(85.0, north + margin)
        west, east = max(-180.0, west - margin), min(180.0, east + margin)
        size = lambda r: (max(2, round((north - south) / r) + 1), max(2, round((east - west) / r) + 1))
        while size(resolution)[0] * size(resolution)[1] > max_cells and resolution < 4.0:
            resolution = round(resolution * 1.5, 4)
        return cls(south, west, resolution, *size(resolution))


def specs_around(ports: DataFrame, resolution: float = RESOLUTION, margin: float = MARGIN, max_cells: int = MAX_CELLS) -> DataFrame:
    """:meth:`Spec.around` for many voyages at once: ``lattice_id, south, west, resolution, n_rows, n_cols`` of the box of
    each (``voyage_id, start_lat, start_lon, goal_lat, goal_lon``), a lattice each, named by the voyage."""
    steps = [resolution]
    while steps[-1] < 4.0:
        steps.append(round(steps[-1] * 1.5, 4))
    low = lambda x, least: F.greatest(F.lit(least), F.least(f"start_{x}", f"goal_{x}") - margin)
    high = lambda x, most: F.least(F.lit(most), F.greatest(f"start_{x}", f"goal_{x}") + margin)
    box = ports.select(F.col("voyage_id").cast("string").alias("lattice_id"), low("lat", -85.0).alias("south"), high("lat", 85.0).alias("north"), low("lon", -180.0).alias("west"), high("lon", 180.0).alias("east"))
    lines = lambda a, b, r: F.greatest(F.lit(2), F.rint((F.col(b) - F.col(a)) / r).cast("int") + 1)
    fits = F.filter(F.array(*map(F.lit, steps)), lambda r: lines("south", "north", r).cast("long") * lines("west", "east", r) <= max_cells)
    sized = box.withColumn("resolution", F.coalesce(F.get(fits, 0), F.lit(steps[-1])))
    return sized.select("lattice_id", "south", "west", "resolution", lines("south", "north", F.col("resolution")).alias("n_rows"), lines("west", "east", F.col("resolution")).alias("n_cols"))


def spec_for(points: DataFrame, **options) -> Spec:
    """For the bounds of ``latitude, longitude``."""
    r = points.agg(F.min("latitude").alias("a"), F.max("latitude").alias("b"), F.min("longitude").alias("c"), F.max("longitude").alias("d")).first()
    return Spec.around(r.a, r.b, r.c, r.d, **options)


def mesh(spark: SparkSession, spec: Spec, lattice_id: str = "lattice") -> DataFrame:
    i = F.col("id")
    row, col = F.floor(i / spec.cols).cast("int"), (i % spec.cols).cast("int")
    return spark.range(spec.rows * spec.cols).select(F.lit(lattice_id).alias("lattice_id"), row.alias("row"), col.alias("col"), (spec.south + row * spec.resolution).alias("lat"), (spec.west + col * spec.resolution).alias("lon"))


def meshes(specs: DataFrame) -> DataFrame:
    """The cells of many lattices, from ``lattice_id, south, west, resolution, n_rows, n_cols``. Rows of cells are dealt
    before cells are made, so a large lattice is spread over tasks."""
    lines = specs.select("lattice_id", "south", "west", "resolution", "n_cols", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row")).repartition("lattice_id", "row")
    cells = lines.select("*", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col"))
    return large(cells.select(*KEY, (F.col("south") + F.col("row") * F.col("resolution")).alias("lat"), (F.col("west") + F.col("col") * F.col("resolution")).alias("lon")))


def to_cell(lat, lon, spec: Spec) -> tuple[Column, Column]:
    """Nearest cell; halves go to the even one, and what lies outside to the border."""
    at = lambda x, low, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint((F.col(x) - low) / spec.resolution).cast("int")))
    return at(lat, spec.south, spec.rows), at(lon, spec.west, spec.cols)


def classify(cells: DataFrame, class_index: Column, confidence: Column) -> DataFrame:
    """Cells with a classifier's verdict; ``class_index`` may be a native rule or a pandas UDF over ``lat, lon``."""
    return cells.withColumn("class_index", class_index.cast("int")).withColumn("confidence", confidence.cast("double"))


def with_cost(cells: DataFrame, band: int = BAND_CELLS, penalty: float = BAND_PENALTY) -> DataFrame:
    """Adds ``cost``: the zone's, times the penalty for water within ``band`` moves (north, south, east, west) of land."""
    costed = cells.withColumn("cost", zone_cost("class_index"))
    if band <= 0 or penalty <= 1:
        return costed
    shifts = [(r, c) for r in range(-band, band + 1) for c in range(-band, band + 1) if 0 < abs(r) + abs(c) <= band]
    around = F.explode(F.array(*[F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in shifts]))
    near = costed.where(F.col("class_index") > 1).select("lattice_id", around.alias("n")).select("lattice_id", "n.row", "n.col").distinct().withColumn("near", F.lit(True))
    both = costed.join(large(near), list(KEY), "left")
    cost = F.when(F.col("near") & (F.col("cost") < IMPASSABLE), F.least(F.col("cost") * penalty, F.lit(IMPASSABLE - 1))).otherwise(F.col("cost"))
    return both.withColumn("cost", cost).drop("near")


def fuse_mask(cells: DataFrame, mask: DataFrame | None, share: float = 0.5, exempt: DataFrame | None = None, exempt_km: float = 30.0) -> DataFrame:
    """Water cells that the mask (``lattice_id, row, col, land_share``; none where ``cells`` have that column) calls land become coastline, unless a point of
    ``exempt`` (``lattice_id, lat0, lon0``, the ports) is within ``exempt_km``, or the point's own column of that name.

    Only cells that would change meet ports, in bands of latitude of their lattice as high as the radius."""
    found = cells if mask is None else cells.join(large(mask.select(*KEY, "land_share")), list(KEY), "left")
    override = (F.col("class_index") < 2) & (F.coalesce("land_share", F.lit(0.0)) >= share)
    if exempt is not None:
        ports = exempt if "exempt_km" in exempt.columns else exempt.withColumn("exempt_km", F.lit(float(exempt_km)))
        widest = ports.agg(F.max("exempt_km")).first()[0] or float(exempt_km)
        band = lambda x: F.floor(x / (widest / 110.0)).cast("long")
        near = ports.select("lattice_id", "lat0", "lon0", "exempt_km", F.explode(F.array(*[band(F.col("lat0")) + i for i in (-1, 0, 1)])).alias("band"))
        asked = found.where(override).select(*KEY, "lat", "lon", band(F.col("lat")).alias("band"))
        spared = large(asked).join(near, ["lattice_id", "band"]).where(haversine_km("lat", "lon", "lat0", "lon0") <= F.col("exempt_km")).select(*KEY, F.lit(True).alias("spared")).distinct()
        found = found.join(spared, list(KEY), "left")
        override = override & F.col("spared").isNull()
    return found.withColumn("class_index", F.when(override, F.lit(3)).otherwise(F.col("class_index"))).select(*cells.columns)


def statistics(cells: DataFrame) -> DataFrame:
    """By lattice: cells, navigable share, a count for each zone, mean confidence."""
    return cells.groupBy("lattice_id").agg(
        F.count(F.lit(1)).alias("cells"), F.avg((F.col("cost") < IMPASSABLE).cast("double")).alias("navigable_share"), *[F.count_if(F.col("class_index") == i).alias(c.lower()) for i, c in enumerate(CLASSES)],
        F.avg("confidence").alias("mean_confidence"),
    )


def overlay(cells: DataFrame, step: int) -> DataFrame:
    """Blocks of ``step`` x ``step`` cells: the majority class (ties: the lowest index) and the mean confidence."""
    block = [F.floor(F.col("row") / step).cast("int").alias("row"), F.floor(F.col("col") / step).cast("int").alias("col")]
    counts = [F.count_if(F.col("class_index") == i) for i in range(len(CLASSES))]
    found = cells.select("lattice_id", *block, "class_index", "confidence").groupBy("lattice_id", "row", "col").agg(F.array(*counts).alias("n"), F.avg("confidence").alias("confidence"))
    return found.select("lattice_id", "row", "col", (F.array_position("n", F.array_max("n")) - 1).cast("int").alias("class_index"), "confidence")


def mask_share(cells: DataFrame, land: Land, resolution: float | str, parts: int = 3) -> DataFrame:
    """``land_share``: how many of ``parts`` x ``parts`` points of each cell are on ``land``, a mask or a function of
    latitude and longitude. ``resolution``: degrees, or the column with them."""
    return land_shared(cells, land, resolution, parts, resolution if not isinstance(resolution, str) else None).select(*KEY, "land_share")


def land_shared(cells: DataFrame, land: Land, resolution: float | str, parts: int = 3, widest: float | None = None) -> DataFrame:
    """``cells`` with the ``land_share`` of :func:`mask_share`. ``widest``: the largest resolution, if known; where its cells are narrower
    than a mask's tile, as they mostly are, no row is shuffled."""
    step = F.col(resolution) if isinstance(resolution, str) else F.lit(resolution)
    shift = [(i + 0.5) / parts - 0.5 for i in range(parts)]
    if isinstance(land, LandMask):
        if widest is not None and widest * land.per_degree < SIDE:
            counted = land.counted(cells, [F.col("lat") + a * step for a in shift], [F.col("lon") + b * step for b in shift], "land_share")
            return counted.withColumn("land_share", F.col("land_share") / float(parts * parts))
        at = F.explode(F.array(*[F.struct((F.col("lat") + a * step).alias("lat"), (F.col("lon") + b * step).alias("lon")) for a in shift for b in shift]))
        tests = land.marked(cells.select(*KEY, at.alias("p")).select(*KEY, "p.*"))
        shares = tests.groupBy(*KEY).agg((F.count_if("on_land") / float(parts * parts)).alias("land_share"))
        return cells.join(large(shares), list(KEY))
    tests = F.array(*[land(F.col("lat") + a * step, F.col("lon") + b * step).cast("int") for a in shift for b in shift])
    return cells.withColumn("land_share", F.aggregate(tests, F.lit(0), lambda s, x: s + x) / float(parts * parts))


def corridor(cells: DataFrame, route: DataFrame, width_deg: float) -> DataFrame:
    """Cells within ``width_deg`` of a route cell (``lattice_id, lat0, lon0``), longitudes shrunk by the mean latitude.

    Cells and route points meet in buckets of the width; a cell's own and its neighbours are enough.
    """
    middle = cells.groupBy("lattice_id").agg(F.cos(F.radians(F.avg("lat"))).alias("shrink"))
    at = lambda c: F.floor(F.col(c) / width_deg).cast("int")
    flat = lambda c: F.floor(F.col(c) * F.col("shrink") / width_deg).cast("int")
    own = cells.join(middle, "lattice_id").withColumn("by", at("lat")).withColumn("bx", flat("lon"))
    nine = F.explode(F.array(*[F.struct((at("lat0") + i).alias("by"), (flat("lon0") + j).alias("bx")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    spread = route.join(middle, "lattice_id").select("lattice_id", "lat0", "lon0", nine.alias("b")).select("lattice_id", "lat0", "lon0", "b.by", "b.bx")
    d = F.sqrt(F.pow(F.col("lat") - F.col("lat0"), 2) + F.pow((F.col("lon") - F.col("lon0")) * F.col("shrink"), 2))
    return large(own).join(spread, ["lattice_id", "by", "bx"]).where(d <= width_deg + 1e-9).select(*KEY).distinct()


def nearest_navigable(cells: DataFrame, queries: DataFrame, max_radius: int = SNAP_CELLS) -> DataFrame:
    """For ``q_id, lattice_id, row, col``: the navigable cell in the nearest square ring, there the nearest by squared
    distance, then the first by row and column. ``q_id, row, col``; queries without one are missing.

    Cells meet queries in blocks of the radius, so a query sees its own block and the eight around it.
    """
    size = max_radius + 1
    block = lambda c: F.floor(F.col(c) / size).cast("int")
    open_ = cells.where(F.col("cost") < IMPASSABLE).select("lattice_id", F.col("row").alias("r"), F.col("col").alias("c")).withColumn("by", block("r")).withColumn("bx", block("c"))
    nine = F.explode(F.array(*[F.struct((block("row") + i).alias("by"), (block("col") + j).alias("bx")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = queries.select("q_id", "lattice_id", "row", "col", nine.alias("b")).select("q_id", "lattice_id", "row", "col", "b.by", "b.bx")
    dr, dc = F.col("r") - F.col("row"), F.col("c") - F.col("col")
    ring = F.greatest(F.abs(dr), F.abs(dc))
    met = asked.join(large(open_), ["lattice_id", "by", "bx"]).where(ring <= max_radius)
    best = F.min(F.struct(ring.alias("ring"), (dr * dr + dc * dc).alias("d2"), dr.alias("dr"), dc.alias("dc"), F.col("r"), F.col("c")))
    return met.groupBy("q_id").agg(best.alias("b")).select("q_id", F.col("b.r").alias("row"), F.col("b.c").alias("col"))


def step_edges(cells: DataFrame, diagonal: bool = True, resolution_col: str | None = None) -> DataFrame:
    """``lattice_id, row, col, to_row, to_col, km, cost`` between navigable neighbours: the length times the mean of both
    costs."""
    offsets = [o for o in OFFSETS if diagonal or 0 in o]
    open_ = cells.where(F.col("cost") < IMPASSABLE).select(*KEY, "lat", "lon", "cost")
    to = F.explode(F.array(*[F.struct((F.col("row") + r).alias("r"), (F.col("col") + c).alias("c")) for r, c in offsets]))
    a = open_.withColumn("to", to)
    b = open_.select("lattice_id", F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"), F.col("cost").alias("to_cost"))
    met = a.join(large(b), (a["lattice_id"] == b["lattice_id"]) & (F.col("to.r") == F.col("to_row")) & (F.col("to.c") == F.col("to_col"))).drop(b["lattice_id"])
    km = haversine_km("lat", "lon", "to_lat", "to_lon")
    return met.select(*KEY, "to_row", "to_col", km.alias("km"), (km * (F.col("cost") + F.col("to_cost")) / 2).alias("cost"))


def block_cells(cells: DataFrame, blocked: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """The cells of ``blocked`` (``lattice_id, row, col``), but for protected ones, made impassable."""
    b = blocked.select(*KEY).distinct()
    if protected is not None:
        b = b.join(protected.select(*KEY), list(KEY), "left_anti")
    marked = cells.join(large(b.withColumn("__b", F.lit(True))), list(KEY), "left")
    return marked.withColumn("cost", F.when(F.col("__b"), F.lit(IMPASSABLE)).otherwise(F.col("cost"))).drop("__b")


# Zooms of a pyramid, pixels along a tile's side, and how confidence becomes a blend of the class's colour.
ZOOMS, PIXELS, BLEND_FROM, BLEND_SPAN, BLEND_LEAST = 10, 32, 0.45, 0.45, 0.25


def pyramid(points: DataFrame, zooms: int = ZOOMS, pixels: int = PIXELS, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``z, x, y, px, py, n, class_index, confidence, blend``: for each pixel of each Web-Mercator tile with points
    (``class_index, confidence``), zooms 0 to ``zooms``: the majority class (ties: the lowest index), its mean
    confidence, and the share of its colour.

    Points are counted once, in pixels of the deepest zoom; all other zooms are made from those counts, since a pixel
    covers four of the next zoom, so later rows are pixels and not points. Latitudes are cut at 85.05 degrees.
    """
    side = float(pixels * (1 << zooms))
    rad = F.radians(F.greatest(F.lit(-85.05), F.least(F.lit(85.05), F.col(lat))))
    edge = lambda v: F.greatest(F.lit(0), F.least(F.lit(int(side) - 1), F.floor(v * side).cast("int")))
    gx, gy = edge((F.col(lon) + 180) / 360), edge((1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / F.pi()) / 2)
    deepest = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col("class_index").isNotNull())
    counts = written(deepest.groupBy(gx.alias("gx"), gy.alias("gy"), "class_index").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("s")), "pixels")
    up = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(zooms))).alias("up"))
    shifted = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("up"))).cast("int")
    merged = up.groupBy((zooms - F.col("up")).alias("z"), shifted("gx").alias("gx"), shifted("gy").alias("gy"), "class_index").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    best = merged.groupBy("z", "gx", "gy").agg(F.max_by(F.struct("class_index", "n", "s"), F.struct(F.col("n"), -F.col("class_index"))).alias("b"), F.sum("n").alias("all"))
    confidence = F.col("b.s") / F.col("b.n")
    blend = F.greatest(F.lit(BLEND_LEAST), F.least(F.lit(1.0), (confidence - BLEND_FROM) / BLEND_SPAN))
    tile, pixel = (lambda c: F.floor(F.col(c) / pixels).cast("int")), (lambda c: (F.col(c) % pixels).cast("int"))
    return best.select("z", tile("gx").alias("x"), tile("gy").alias("y"), pixel("gx").alias("px"), pixel("gy").alias("py"), F.col("all").alias("n"), "b.class_index", confidence.alias("confidence"), blend.alias("blend"))


def ordered(cells: DataFrame) -> DataFrame:
    return cells.withColumn("seq", F.row_number().over(Window.partitionBy("lattice_id").orderBy("row", "col")))
