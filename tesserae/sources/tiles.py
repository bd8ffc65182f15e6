"""Vector tiles: a decoder for the wire format, a reader over files, and buildings and water as rows in local metres."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import shapes
from tesserae.functions.constants import EARTH_RADIUS, NATIVE_ZOOM
from tesserae.functions.tags import DRY_CLASSES, WATER_CLASSES, WATER_CROSSINGS
from tesserae.operators import cells, spatial_join
from tesserae.operators.graph import connected_components
from tesserae.operators.overlay import INTERSECTION, POLYGONS, UNION, arrow_schema, enclosing_circle, from_rows, overlay, overlay_area, per_group, per_row, shape_area, to_rows

from .staging import stage

MAX_TILE_BYTES = 4 << 20


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a message's fields: whole numbers, or bytes of fixed and counted ones."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 2, 5):
            size = 8 if kind == 1 else 4
            if kind == 2:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
            if at > len(data):
                raise ValueError("a field ends beyond its message")
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield tag >> 3, value


def _packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = _varint(data, at)
        out.append(value)
    return out


def _value(data: bytes):
    for n, v in _fields(data):
        if n == 1:
            return v.decode()
        if n in (2, 3):
            return struct.unpack("<f" if n == 2 else "<d", v)[0]
        if n == 6:
            return (v >> 1) ^ -(v & 1)
        if n == 7:
            return bool(v)
        return v - (1 << 64) if n == 4 and v >> 63 else v
    return None


def _rings(commands: list[int]) -> list[list[tuple[int, int]]]:
    """Rings of a polygon's commands, each closed; anything but move, line and close of whole rings is malformed."""
    rings, ring, x, y, at = [], [], 0, 0, 0
    while at < len(commands):
        kind, count = commands[at] & 7, commands[at] >> 3
        at += 1
        if kind in (1, 2):
            for _ in range(count):
                x += (commands[at] >> 1) ^ -(commands[at] & 1)
                y += (commands[at + 1] >> 1) ^ -(commands[at + 1] & 1)
                at += 2
                ring = [(x, y)] if kind == 1 else [*ring, (x, y)]
        elif kind == 7:
            if len(ring) < 3:
                raise ValueError("a ring of fewer than three points")
            rings.append([*ring, ring[0]])
            ring = []
        else:
            raise ValueError(f"unknown command {kind}")
    if ring:
        raise ValueError("an open ring")
    return rings


def _turns(ring: list) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def decode_tile(data: bytes, wanted: str) -> list[tuple[dict, list]] | None:
    """(properties, polygons in tile fractions) of a layer's polygon features; None if the tile lacks the layer.

    Rings that turn the way the first one does begin a polygon, the others are its holes.
    """
    found = None
    for n, layer in _fields(data):
        if n != 3:
            continue
        parts = list(_fields(layer))
        if next((v for k, v in parts if k == 1), b"").decode() != wanted:
            continue
        keys, values = [v.decode() for k, v in parts if k == 3], [_value(v) for k, v in parts if k == 4]
        extent = next((v for k, v in parts if k == 5), 4096)
        found = found or []
        for feature in (dict(_fields(v)) for k, v in parts if k == 2):
            if feature.get(3) != 3:
                raise ValueError(f"layer {wanted} holds something other than polygons")
            tags = _packed(feature.get(2, b""))
            polygons, first = [], 0.0
            for ring in _rings(_packed(feature.get(4, b""))):
                turn = _turns(ring)
                if not turn:
                    continue
                scaled = [(x / extent, y / extent) for x, y in ring]
                first = first or turn
                if (turn > 0) == (first > 0):
                    polygons.append([scaled])
                else:
                    polygons[-1].append(scaled)
            found.append(({keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=True)}, polygons))
    return found


def _local(shape: list, z: int, x: int, y: int, lon0: float, lat0: float, basis: float | None = None) -> list:
    """A shape in tile fractions, in metres around a centre; longitudes shrink as at the latitude ``basis``, else as at the centre."""
    n, shrink = 2**z, max(1e-8, math.cos(math.radians(lat0 if basis is None else basis)))
    out = []
    for polygon in shape:
        rings = []
        for ring in polygon:
            points = []
            for px, py in ring:
                lon, lat = (x + px) / n * 360 - 180, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (y + py) / n))))
                points.append((math.radians((lon - lon0 + 180) % 360 - 180) * EARTH_RADIUS * shrink, math.radians(lat - lat0) * EARTH_RADIUS))
            rings.append(points)
        out.append(rings)
    return out


CORE = [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]]


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(z, x, y, content) of tile files under .../z/x/y.pbf or .mvt; files beyond the limit fail the job."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    place = lambda k: F.regexp_extract("path", r"/(\d+)/(\d+)/(\d+)\.(?:pbf|mvt)$", k).try_cast("int")
    sound = F.when(F.col("length") <= MAX_TILE_BYTES, F.col("content")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(": tile is too large"))).cast("binary"))
    return files.select(place(1).alias("z"), place(2).alias("x"), place(3).alias("y"), sound.alias("content")).where("z is not null")


def _inside(shape: list) -> bool:
    return all(0 <= px <= 1 and 0 <= py <= 1 for polygon in shape for px, py in polygon[0])


def tile_fragments(tiles: DataFrame, layer: str, lon: float | str, lat: float | str, basis: str | None = None, keep: tuple[str, ...] = (), distinct: bool = False) -> DataFrame:
    """(keep, z, x, y, nth, properties, polygons, area): a layer's features clipped to their tile's core, in metres around a centre.

    The centre is a pair of numbers or of columns, so tiles of many sectors go in one pass. A malformed tile fails the job; a tile without the layer, and a
    feature that lies in the buffer only, give no rows. If wanted, features of one tile that have the same shape are one, with the properties of the first.
    """

    def decode(r: dict) -> Iterator[dict]:
        seen = set()
        for nth, (properties, shape) in enumerate(decode_tile(r["content"], layer) or []):
            if distinct:
                own = tuple(tuple(map(tuple, polygon)) for polygon in shape)
                if own in seen:
                    continue
                seen.add(own)
            inside = shape if _inside(shape) else overlay(shape, CORE, INTERSECTION)
            if inside:
                metres = _local(inside, r["z"], r["x"], r["y"], r["__lon"], r["__lat"], r["__basis"])
                yield {"nth": nth, "properties": _texts(properties), "polygons": to_rows(metres), "area": shape_area(metres)}

    as_col = lambda c: F.col(c) if isinstance(c, str) else F.lit(float(c))
    rows = tiles.select(*keep, F.col("z").cast("int"), F.col("x").cast("int"), F.col("y").cast("int"), "content", as_col(lon).alias("__lon"), as_col(lat).alias("__lat"), as_col(lat if basis is None else basis).alias("__basis"))
    return _decoded(rows, decode, [*keep, "z", "x", "y"], f"nth int, properties map<string,string>, polygons {POLYGONS}, area double")


def _texts(properties: dict) -> dict[str, str]:
    return {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in properties.items()}


def _decoded(rows: DataFrame, decode: Callable[[dict], Iterator[dict]], keep: list[str], schema: str) -> DataFrame:
    """Kept columns and what ``decode`` yields for each tile, tile by tile."""
    ddl = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + f", {schema}"
    told = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (r,) = batch.slice(k, 1).to_pylist()
                found = [{**{c: r[c] for c in keep}, **d, "properties": list(d["properties"].items())} for d in decode(r)]
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=told)

    return rows.mapInArrow(run, ddl)


def _number(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _counted(field: int, data: bytes) -> bytes:
    return _number(field << 3 | 2) + _number(len(data)) + data


def encode_tile(layer: str, features: list[tuple[dict, list[list[tuple[int, int]]]]], extent: int = 4096) -> bytes:
    """A tile of one layer of polygons: features are properties (texts and numbers) and open rings of whole coordinates."""
    keys: dict[str, int] = {}
    values: dict[object, int] = {}
    body = bytearray()
    for properties, rings in features:
        tags = b"".join(_number(keys.setdefault(k, len(keys))) + _number(values.setdefault(v, len(values))) for k, v in properties.items())
        x = y = 0
        commands = b""
        for ring in rings:
            for k, (px, py) in enumerate(ring):
                commands += _number(1 << 3 | 1) if k == 0 else _number((len(ring) - 1) << 3 | 2) if k == 1 else b""
                commands += b"".join(_number(d << 1 if d >= 0 else (-d << 1) - 1) for d in (px - x, py - y))
                x, y = px, py
            commands += _number(1 << 3 | 7)
        body += _counted(2, _counted(2, tags) + _number(3 << 3) + _number(3) + _counted(4, commands))
    told = [_counted(1, v.encode()) if isinstance(v, str) else _number(3 << 3 | 1) + struct.pack("<d", v) for v in values]
    parts = [_number(15 << 3) + _number(2), _counted(1, layer.encode()), bytes(body), *(_counted(3, k.encode()) for k in keys), *(_counted(4, v) for v in told), _number(5 << 3) + _number(extent)]
    return _counted(3, b"".join(parts))


def water_features(tiles: DataFrame, lon: float, lat: float) -> DataFrame:
    """Mapped surface water by class; bridges, tunnels and aqueducts aren't; an unknown class fails the job."""
    rows = tile_fragments(tiles, "water", lon, lat)
    kind, crossing = F.col("properties")["class"], F.col("properties")["brunnel"]
    known = F.coalesce(kind.isin(*WATER_CLASSES, *DRY_CLASSES), F.lit(False))
    checked = F.when(known, kind.isin(*WATER_CLASSES)).otherwise(F.raise_error(F.concat(F.lit("unknown water class "), F.coalesce(kind, F.lit("null")))).cast("boolean"))
    return rows.where(checked & ~F.coalesce(crossing.isin(*WATER_CROSSINGS), F.lit(False)))


#: The properties that must agree for two parts to be one building across a seam.
ATTRIBUTES = ("render_height", "render_min_height", "colour", "hide_3d")
SIDES = {"left": (0, 0), "right": (0, 1), "top": (1, 0), "bottom": (1, 1)}
SEAM_EPS, AREA_EPS = 1e-10, 1e-14
RING_SHAPE = POLYGONS
FRAGMENT = f"nth int, properties map<string,string>, raw {RING_SHAPE}, core {RING_SHAPE}, seams array<struct<side:string,lo:double,hi:double>>"


def building_fragments(tiles: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, x, y, nth, properties, raw, core, seams): each building polygon of each tile (z, x, y, content), in units of tiles.

    ``raw`` is what the tile holds, its buffer included, ``core`` what lies in the tile itself; ``seams`` are the stretches, or single points, of the core's outline on
    each side of the tile. x is as given, so callers unwrap it where a set of tiles crosses the date line. Polygons without area in their tile are left out.
    """

    def decode(r: dict) -> Iterator[dict]:
        nth = 0
        for properties, shape in decode_tile(r["content"], "building") or []:
            for polygon in shape:
                core = [polygon] if _inside([polygon]) else overlay([polygon], CORE, INTERSECTION)
                if shape_area(core) > AREA_EPS:
                    moved = [[[[(px + r["x"], py + r["y"]) for px, py in ring] for ring in p] for p in s] for s in ([polygon], core)]
                    yield {"nth": nth, "properties": _texts(properties), "raw": to_rows(moved[0]), "core": to_rows(moved[1]), "seams": _seams(core, r["x"], r["y"])}
                nth += 1

    rows = tiles.select(*keep, F.col("x").cast("int"), F.col("y").cast("int"), "content")
    return _decoded(rows, decode, [*keep, "x", "y"], FRAGMENT)


def _seams(core: list, x: int, y: int) -> list[dict]:
    found = []
    for ring in (ring for polygon in core for ring in polygon):
        for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
            for side, (axis, edge) in SIDES.items():
                along = (y, x)[axis]
                if a != b and abs(a[axis] - edge) <= SEAM_EPS:
                    p = a[1 - axis] + along
                    q = b[1 - axis] + along if abs(b[axis] - edge) <= SEAM_EPS else p
                    found.append({"side": side, "lo": min(p, q), "hi": max(p, q)})
    return found


def whole_buildings(fragments: DataFrame, centers: DataFrame, by: tuple[str, ...] = (), label: str | None = None, most_metres: float = 1000.0) -> DataFrame:
    """(by, component, complete, fragments, label, height, polygons, area, center_x, center_y, radius): buildings put together across tiles, and certified.

    Fragments (``building_fragments``) of one tile are one building if they overlap. Across a seam, neighbours are if their attributes agree, they share a stretch of the seam,
    and what their tiles hold overlaps. A building is complete if its neighbours cover all of its parts' stretches of seams; one that isn't has no shape, as a part is never taken for a whole, nor has
    one that is wider or higher than ``most_metres``. Shapes are in metres around the centre (by, lon, lat, basis). The height is that of all parts, null where they differ. ``label`` names a property of which
    the smallest value among the parts is kept.
    """
    # no side of fragments is broadcast: what is staged is packed, so Spark takes it for far less than it is
    attributes = F.concat_ws("|", *(F.coalesce(F.try_element_at("properties", F.lit(a)), F.lit("")) for a in ATTRIBUTES))
    # a name that holds for fragments of a tile wherever they are read
    fid = F.concat_ws("/", *by, "x", "y", "nth")
    rows = fragments.withColumns({"fid": fid, "attributes": attributes})
    rows = rows.withColumns({"raw_box": shapes.bounds(shapes.outer_vertices(F.col("raw"))), "core_box": shapes.bounds(shapes.outer_vertices(F.col("core")))})
    rows = stage(rows, "fragments")
    boxed = rows.select(*by, "fid", "x", "y", "attributes", "raw", "core", "seams", "core_box", "raw_box.*")
    names = ("fid", "x", "y", "attributes", "raw", "core", "seams", "core_box")
    other = boxed.withColumnsRenamed({c: f"o_{c}" for c in names})
    dx, dy = F.col("o_x") - F.col("x"), F.col("o_y") - F.col("y")
    side = F.when(dx == 1, "right").when(dx == -1, "left").when(dy == 1, "bottom").otherwise("top")
    back = F.when(dx == 1, "left").when(dx == -1, "right").when(dy == 1, "top").otherwise("bottom")
    near = spatial_join.bbox_join(boxed, other, 1 / 32, F.col("fid") < F.col("o_fid"), by)
    shared = cells.interval_overlaps(F.filter("seams", lambda i: i["side"] == side), F.filter("o_seams", lambda i: i["side"] == back), SEAM_EPS)
    same = (dx == 0) & (dy == 0) & shapes.boxes_overlap(F.col("core_box"), F.col("o_core_box"), SEAM_EPS)
    across = (F.abs(dx) + F.abs(dy) == 1) & (F.col("attributes") == F.col("o_attributes"))
    near = near.withColumns({"side": side, "back": back, "shared": F.when(across, shared)}).where(same | (F.size("shared") > 0))
    tested = near.select("fid", "o_fid", "side", "back", "shared", F.when(F.col("shared").isNull(), F.col("core")).otherwise(F.col("raw")).alias("a"), F.when(F.col("shared").isNull(), F.col("o_core")).otherwise(F.col("o_raw")).alias("b"))
    meets = per_row(tested, "meets boolean", lambda r: {"meets": overlay_area(from_rows(r["a"]), from_rows(r["b"]), INTERSECTION) > AREA_EPS}, ["fid", "o_fid", "side", "back", "shared"])
    links = stage(meets.where("meets"), "fragment-links")
    loops = rows.select(F.col("fid").alias("a"), F.col("fid").alias("b"))
    component = connected_components(links.select(F.col("fid").alias("a"), F.col("o_fid").alias("b")).unionAll(loops))
    # what neighbours cover of each seam, and what they leave open
    matched = links.select(F.explode(F.array(F.struct("fid", "side"), F.struct(F.col("o_fid").alias("fid"), F.col("back").alias("side")))).alias("e"), F.explode("shared").alias("i")).select("e.*", "i.lo", "i.hi")
    covered = cells.interval_cover(matched.withColumn("seam", F.struct("fid", "side")), "seam", "lo", "hi", SEAM_EPS).select("seam.fid", "seam.side", F.col("lo").alias("from"), F.col("hi").alias("to"))
    asked = rows.select("fid", F.explode("seams").alias("i")).select("fid", "i.*")
    held = asked.join(covered.hint("merge"), ["fid", "side"], "left").groupBy("fid", "side", "lo", "hi").agg(F.bool_or((F.col("from") <= F.col("lo") + SEAM_EPS) & (F.col("to") >= F.col("hi") - SEAM_EPS)).alias("held"))
    open_ = held.where(~F.coalesce("held", F.lit(False))).select("fid").distinct().withColumn("open", F.lit(True))
    named = rows.join(component.hint("merge"), F.col("fid") == F.col("node")).drop("node").join(open_.hint("merge"), "fid", "left")
    value = F.try_element_at("properties", F.lit(label)) if label else F.lit(None).cast("string")
    told = named.groupBy(*by, "component").agg(
        F.bool_and(F.col("open").isNull()).alias("complete"), F.count("*").alias("fragments"), F.min(value).alias("label"),
        F.when(F.count_distinct("attributes") == 1, F.min(F.try_element_at("properties", F.lit("render_height")).cast("double"))).alias("height"),
    )
    sound = named.select("component", "core").join(told.where("complete").hint("merge"), "component")
    placed = sound.join(centers, list(by)) if by else sound.crossJoin(centers.limit(1))

    def build(own: list[dict]) -> list[dict]:
        union: list = []
        for r in own:
            union = overlay(union, from_rows(r["core"]), UNION) if union or len(own) > 1 else from_rows(r["core"])
        metres = _local(union, NATIVE_ZOOM, 0, 0, own[0]["lon"], own[0]["lat"], own[0]["basis"])
        xs, ys = zip(*(p for polygon in metres for p in polygon[0]), strict=True)
        if max(xs) - min(xs) > most_metres or max(ys) - min(ys) > most_metres:
            return []
        x, y, radius = enclosing_circle([p for polygon in metres for p in polygon[0]])
        return [{"polygons": to_rows(metres), "area": shape_area(metres), "center_x": x, "center_y": y, "radius": radius}]

    # a group is one building, whose size is bounded by what a building is; a larger one than any hole can take is left out
    whole = per_group(placed.select("component", "core", "lon", "lat", "basis"), ["component"], f"polygons {RING_SHAPE}, area double, center_x double, center_y double, radius double", build)
    return told.join(whole.hint("merge"), "component", "left").select(*by, "component", "complete", "fragments", "label", "height", "polygons", "area", "center_x", "center_y", "radius")
