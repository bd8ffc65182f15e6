"""Normalising map features: versions, members, completeness, duplicates, chunks, progress and search."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tesserae.functions.checks import fingerprint, required

from .spatial_join import BOX, bbox_join

OSM_SCHEMA = (
    "type string, id bigint, version int, tags map<string,string>, nodes array<bigint>, lat double, lon double, geometry array<struct<lat:double,lon:double>>, "
    "members array<struct<type:string,ref:bigint,role:string,geometry:array<struct<lat:double,lon:double>>>>"
)
MAX_BYTES, MAX_ELEMENTS = 40 << 20, 100_000


def read_osm_json(spark: SparkSession, path: str) -> DataFrame:
    """Elements of map extracts in JSON; a partial result (with a remark), malformed text or too many elements fail the job."""
    schema = f"remark string, elements array<struct<{', '.join(_colon(c) for c in _split(OSM_SCHEMA))}>>"
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length"), F.col("content").cast("string").alias("text"))
    parsed = files.select("path", "length", F.from_json("text", schema, {"mode": "FAILFAST"}).alias("j"))
    bad = (
        F.when(F.col("length") > MAX_BYTES, "the file is too large")
        .when(F.col("j.remark").isNotNull(), "the extract is partial")
        .when(F.col("j.elements").isNull(), "there are no elements")
        .when(F.size("j.elements") > MAX_ELEMENTS, "there are too many elements")
    )
    elements = F.when(bad.isNull(), F.col("j.elements")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(": "), bad)))
    return parsed.select(F.explode(elements).alias("e")).select("e.*")


def _split(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for k, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:k].strip())
            start = k + 1
    return [*out, schema[start:].strip()]


def _colon(field: str) -> str:
    name, kind = field.split(" ", 1)
    return f"{name}:{kind}"


def latest(rows: DataFrame, keys: list[str], version: str, tie: Column) -> DataFrame:
    """Of each key, the row with the highest version, ties by the smallest ``tie``: one map-side combined aggregate, without a sort."""
    value = F.struct(*rows.columns)
    order = F.struct((-F.coalesce(F.col(version), F.lit(0))).alias("v"), tie.alias("t"))
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias("__row")).select("__row.*")


def first_of(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of each key, the row that comes first in an order."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__row")).select("__row.*")


def way_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, line): coordinates of ways by their nodes, in order; null if a node is missing."""
    refs = ways.select("id", F.posexplode("nodes").alias("pos", "node"))
    placed = refs.join(nodes.select(F.col("id").alias("node"), F.struct("lon", "lat").alias("pt")), "node", "left")
    lines = placed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "pt"))).alias("ps"), F.bool_and(F.col("pt").isNotNull()).alias("whole"))
    return lines.select("id", F.when(F.col("whole"), F.transform("ps", lambda p: p["pt"])).alias("line"))


def complete_relations(members: DataFrame) -> DataFrame:
    """(rel, complete) of multipolygon members (rel, type, role, line): rings close, by the parity of line ends for each role."""
    used = members.withColumn("role", F.coalesce(F.nullif("role", F.lit("")), F.lit("outer"))).where(F.col("role").isin("outer", "inner"))
    first, last = F.element_at("line", 1), F.element_at("line", -1)
    closed = first == last
    sound = F.coalesce((F.col("type") == "way") & (F.size("line") >= F.when(closed, 4).otherwise(2)), F.lit(False))
    checked = used.withColumn("ok", sound)
    base = checked.groupBy("rel").agg(F.bool_and("ok").alias("ok"), F.count_if(F.col("role") == "outer").alias("outers"))
    ends = checked.where(F.col("ok") & ~closed).select("rel", "role", F.explode(F.array(first, last)).alias("end"))
    odd = ends.groupBy("rel", "role", "end").agg((F.count("*") % 2).alias("odd")).where("odd = 1").select("rel").distinct().withColumn("__odd", F.lit(True))
    return base.join(odd, "rel", "left").select("rel", (F.col("ok") & (F.col("outers") > 0) & F.col("__odd").isNull()).alias("complete"))


def lost_vertices(members: DataFrame, features: DataFrame) -> DataFrame:
    """(rel) whose member vertices aren't all in the assembled feature (rel, points)."""
    # relations are dealt to as many tasks as Spark is told to have before their vertices are rows; a side of vertices isn't broadcast, as its size isn't known
    dealt = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rel")
    want = dealt(members).select("rel", F.explode("line").alias("p")).distinct()
    have = dealt(features).select("rel", F.explode("points").alias("p")).distinct()
    return want.join(have.hint("merge"), ["rel", "p"], "left_anti").select("rel").distinct()


def chunk_index(buildings: DataFrame, chunk: float, arena: float, per_axis: int) -> DataFrame:
    """Buildings (x, y, area, box) by chunk: count, area, and the box as a zone map for pruning."""
    place = lambda c: F.least(F.lit(per_axis - 1), F.greatest(F.lit(0), F.floor((F.col(c) + arena / 2 + 1e-6) / chunk)))
    return buildings.groupBy(F.concat_ws("-", place("x").cast("string"), place("y").cast("string")).alias("chunk_id")).agg(
        F.count("*").alias("building_count"), F.sum("area").alias("area"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y")
    )


def write_chunks(buildings: DataFrame, path: str) -> None:
    """Buildings with a chunk_id as Parquet partitioned by it, each chunk in a file of its own."""
    buildings.repartition("chunk_id").write.mode("overwrite").partitionBy("chunk_id").parquet(path)


def read_chunks(spark: SparkSession, path: str, ids: list[str], version: str) -> DataFrame:
    """Chunks by id (partition pruning); rows of another version fail the job."""
    rows = spark.read.parquet(path).where(F.col("chunk_id").isin(*ids))
    ok = F.when(F.col("version") == version, F.col("version")).otherwise(F.raise_error(F.lit("chunk of another version")))
    return rows.withColumn("version", ok)


def insert_once(stored: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of ``new`` to add; a key that is stored with another digest fails the job."""
    known = stored.select(key, F.col(digest).alias("__old"))
    joined = new.join(known, key, "left")
    conflict = F.col("__old").isNotNull() & (F.col("__old") != F.col(digest))
    checked = joined.withColumn(digest, F.when(conflict, F.raise_error(F.lit("conflicting content for a stored key"))).otherwise(F.col(digest)))
    # the check comes before the filter, so it isn't optimised away with what it guards
    return checked.where(F.col("__old").isNull() | conflict | F.col(digest).isNull()).drop("__old")


def merge_best(runs: DataFrame, key: str, order: str) -> DataFrame:
    """Best record: the fastest run's values, with the highest score up to the last time a faster one came."""
    fastest = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marked = runs.withColumn("__best", F.min("elapsed").over(fastest)).withColumn("__new", F.col("__best").isNull() | (F.col("elapsed") < F.col("__best")))
    last = F.max(F.when(F.col("__new"), F.col(order))).over(Window.partitionBy(key))
    kept = marked.withColumn("__last", last).where(F.col(order) >= F.col("__last"))
    return kept.groupBy(key).agg(F.min("elapsed").alias("elapsed"), F.max("score").alias("score"))


def progress_upsert(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Progress only grows within one version: completed once, always; largest area."""
    return updates.groupBy(*keys).agg(F.bool_or("completed").alias("completed"), F.max("consumed_area").alias("consumed_area"))


def campaign_summary(sectors: DataFrame, progress: DataFrame, campaign: str = "campaign_id", sector: str = "sector_id") -> DataFrame:
    """Completed, prepared and total sectors, areas and percentages; sectors of unknown size stay out of the denominator."""
    joined = sectors.join(progress, sector, "left")
    known = F.coalesce(F.col("total_area") >= 0, F.lit(False))
    eaten = F.when(known, F.least(F.col("total_area"), F.greatest(F.lit(0.0), F.coalesce(F.col("consumed_area").cast("double"), F.lit(0.0)))))
    out = joined.groupBy(campaign).agg(
        F.count_if(F.coalesce("completed", F.lit(False))).alias("completed"), F.count("*").alias("total"), F.count_if(known).alias("prepared"),
        F.coalesce(F.sum(eaten), F.lit(0.0)).alias("consumed_area"), F.coalesce(F.sum(F.when(known, F.col("total_area"))), F.lit(0.0)).alias("known_area"),
    )
    percent = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)) * 100
    return out.withColumns({"completion_percent": percent(F.col("completed"), F.col("total")), "known_percent": percent(F.col("consumed_area"), F.col("known_area"))})


@F.pandas_udf(StringType())
def folded(names: pd.Series) -> pd.Series:
    """Names without accents, in lower case (compatibility decomposition, marks removed)."""
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s).lower() if not unicodedata.category(c).startswith("M"))
    return names.fillna("").map(plain)


def name_search(places: DataFrame, query: str, name: str = "name", text: str = "search_text", rank: str = "population", keep: int = 7) -> DataFrame:
    """Places whose folded text contains the folded query: exact names first, then the largest; ties by id."""
    wanted = "".join(c for c in unicodedata.normalize("NFKD", query.strip()).lower() if not unicodedata.category(c).startswith("M"))
    found = places.where(F.contains(F.col(text), F.lit(wanted)) if len(wanted) > 1 else F.lit(False))
    return found.orderBy(F.desc(F.col(name) == wanted), F.desc(F.coalesce(F.col(rank), F.lit(0))), "id").limit(keep)


def boundary_rank(areas: DataFrame, key: str, match: str) -> DataFrame:
    """Candidates in order: exact name matches first, then the smaller box."""
    size = (F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))
    return areas.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(match), size, "id")))


def take_within_budget(rows: DataFrame, key: str, order: list[str], cost: str, budget: int, most: int) -> DataFrame:
    """Rows picked in order while they fit a budget; one that doesn't fit is skipped, and later ones may still fit.

    Skipping depends on all picks before, so each key's candidates stream through one task in order, with two numbers as
    state; keys spread over tasks.
    """
    schema = rows.schema
    sorted_rows = rows.repartition(key).sortWithinPartitions(key, *order)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        present, left, taken = object(), 0, 0
        for batch in batches:
            kept = []
            for k, (name, price) in enumerate(zip(batch[key], batch[cost], strict=True)):
                if name != present:
                    present, left, taken = name, budget, 0
                if taken < most and price <= left:
                    left, taken = left - price, taken + 1
                    kept.append(k)
            yield batch.iloc[kept]

    return sorted_rows.mapInPandas(pick, schema)


def content_fingerprints(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, fingerprint) of each key's texts in order; nulls are left out. The digest is sequential by definition, so a key's rows, those of one chunk or sector, meet in one group."""
    held = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("__v"))
    return held.select(key, fingerprint(F.transform("__v", lambda x: x["v"])).alias("fingerprint"))


def geonames(spark: SparkSession, path: str) -> DataFrame:
    """Populated places of a 19-column tab-separated gazetteer, within the map, with up to three other names."""
    columns = "id bigint, name string, ascii string, alternate string, lat double, lon double, class string, code string, country string, cc2 string, a1 string, a2 string, a3 string, a4 string, population bigint, elevation string, dem string, tz string, modified string"
    raw = spark.read.schema(columns).option("sep", "\t").option("quote", "").option("mode", "FAILFAST").csv(path)
    others = F.filter(F.split(F.coalesce("alternate", F.lit("")), ","), lambda n: (n != "") & (n != F.col("name")))
    kept = raw.where((F.col("class") == "P") & F.col("lat").between(-84.9, 84.9))
    return kept.select("id", "name", "ascii", F.slice(F.array_sort(F.array_distinct(others)), 1, 3).alias("other_names"), "country", "lat", "lon", "population")


def without_members(ways: DataFrame, members: DataFrame, key: str = "id") -> DataFrame:
    """Ways that are no member of a relation that counts (``counts``): those members come in with their relation."""
    return ways.join(members.where("counts").select(key), key, "left_anti")


def rewards(taken: DataFrame, worth: DataFrame, run: str = "run", key: str = "id") -> DataFrame:
    """(run, area, rewarded): everything that a run took is worth its area once, however often it was reported."""
    return taken.select(run, key).distinct().join(worth.select(key, "area"), key).groupBy(run).agg(F.sum("area").alias("area"), F.count("*").alias("rewarded"))


def sector_totals(sectors: DataFrame, buildings: DataFrame, key: str, start: float = 18.0, tolerance: float = 1.06, few: int = 100) -> DataFrame:
    """Each sector's buildings, area, smallest radius, buildings that the first hole can take, the radius to begin with, and whether it suits.

    A sector without buildings is empty, one with fewer than ``few`` sparse, any other ready; without buildings there is no radius.
    """
    rows = sectors.select(key).join(buildings.select(key, "radius", "area"), key, "left")
    told = rows.groupBy(key).agg(
        F.count("radius").alias("buildings"), F.coalesce(F.sum("area"), F.lit(0)).alias("area"), F.min("radius").alias("least_radius"), F.count_if(F.col("radius") <= start * tolerance).alias("edible")
    )
    suits = F.when(F.col("buildings") == 0, "empty").when(F.col("buildings") < few, "sparse").otherwise("ready")
    return told.withColumns({"suggested_radius": F.ceil(F.col("least_radius") / tolerance + 1).cast("double"), "suitability": suits})


def content_digest(items: DataFrame, key: str, item: str) -> DataFrame:
    """(key, digest): SHA-256 over the JSON of each key's items in order, so the order they are read in plays no part."""
    return items.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("__items")).select(key, F.sha2(F.to_json("__items"), 256).alias("digest"))


def attached_members(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """(rel, nth, type, ref, role, line): members of relations (rel, members) in order, each with its own line or else that of the way it refers to."""
    rows = relations.select("rel", F.posexplode("members").alias("nth", "m")).select("rel", "nth", "m.*")
    named = ways.select(F.lit("way").alias("type"), F.col("id").alias("ref"), F.col("line").alias("__line"))
    return rows.join(named, ["type", "ref"], "left").select("rel", "nth", "type", "ref", "role", F.coalesce("line", "__line").alias("line"))


def exclusions(features: DataFrame, *reasons: tuple[str, Column]) -> DataFrame:
    """(reason, n): features by the first reason that excludes them; those that stay have the reason kept."""
    first = F.coalesce(*(F.when(F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in reasons), F.lit("kept"))
    return features.groupBy(first.alias("reason")).agg(F.count("*").alias("n"))


def parts_within(parts: DataFrame, parents: DataFrame, cell: float, contained: Callable[[Column, Column], Column]) -> DataFrame:
    """(part) of building parts whose centre's grid cell a parent's box meets, and that ``contained(part, parent)`` holds for.

    Parts have id, x, y and a struct ``shape``; parents have min_x to max_y and ``shape``. An equi-join on cells, never a cross join.
    Equal parts are looked at once, and so are equal parents.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    spread = parents.select("min_x", "min_y", "max_x", "max_y", "shape").distinct().withColumn("gx", F.explode(F.sequence(at("min_x"), at("max_x")))).withColumn("gy", F.explode(F.sequence(at("min_y"), at("max_y"))))
    own = parts.select("id", F.col("shape").alias("part"), at("x").alias("gx"), at("y").alias("gy"))
    met = own.drop("id").distinct().join(spread.select("gx", "gy", F.col("shape").alias("parent")).hint("merge"), ["gx", "gy"])
    within = met.where(contained(F.col("part"), F.col("parent"))).select("part", "gx", "gy").distinct()
    return own.join(within, ["part", "gx", "gy"], "left_semi").select("id").distinct()


def progress_of(cells: DataFrame, progress: DataFrame, key: str, total: int = 100_000) -> DataFrame:
    """Visible cells with their saved progress; those without any have consumed nothing of a usual total."""
    saved = progress.select(key, "consumed_area", "total_area")
    return cells.join(saved, key, "left").withColumns({"consumed_area": F.coalesce("consumed_area", F.lit(0)), "total_area": F.coalesce("total_area", F.lit(total))})


def most_recent(saved: DataFrame, when: str, key: str, keep: int = 40) -> DataFrame:
    """The latest of the saved campaigns."""
    return saved.orderBy(F.desc(when), key).limit(keep)


def within_limit(rows: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """Rows of lists (by key) that must not have more than so many; else the job fails."""
    size = rows.groupBy(key).agg(F.count("*").alias("__size"))
    checked = rows.join(size, key).withColumn(key, required(F.col(key), F.col("__size") <= most, "the list is too long").cast(rows.schema[key].dataType))
    return checked.drop("__size")


def free_spawn(blocked: DataFrame, by: str, step: float, rings: int) -> DataFrame:
    """(by, x, y): the first of the places on rings around the origin, ring by ring, that no box of the group meets; null if all are met.

    Place n of ring r is the point at distance r * step in the direction n of 8 r; ring 0 is the origin.
    """
    spark = blocked.sparkSession
    place = spark.range(rings + 1).withColumnRenamed("id", "r").withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("r") * 8 - 1, F.lit(0)))))
    turn = F.col("n") * 2 * math.pi / F.greatest(F.col("r") * 8, F.lit(1))
    place = place.select("r", "n", (F.col("r") * step * F.cos(turn)).alias("x"), (F.col("r") * step * F.sin(turn)).alias("y"))
    groups = blocked.select(by).distinct()
    tried = groups.crossJoin(F.broadcast(place))  # a fixed number of places for each group
    # places meet the boxes of their group that share a grid cell with them, so a group with very many boxes is many keys
    at = tried.withColumns({"min_x": F.col("x"), "max_x": F.col("x"), "min_y": F.col("y"), "max_y": F.col("y")})
    hit = bbox_join(at, blocked.select(by, *BOX).distinct(), 4 * step, by=(by,)).select(by, "r", "n").distinct()
    free = tried.join(hit, [by, "r", "n"], "left_anti").groupBy(by).agg(F.min(F.struct("r", "n", "x", "y")).alias("p"))
    return groups.join(free, by, "left").select(by, "p.x", "p.y")


def validation_report(stored: DataFrame, computed: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, problem): what stored totals differ in from those computed anew, what is missing and what nothing is stored for."""
    a = stored.select(key, F.struct(*values).alias("__stored"))
    b = computed.select(key, F.struct(*values).alias("__computed"))
    wrong = F.array_compact(F.array(*(F.when(~F.col(f"__stored.{v}").eqNullSafe(F.col(f"__computed.{v}")), F.lit(v)) for v in values)))
    problem = F.when(F.col("__stored").isNull(), "not stored").when(F.col("__computed").isNull(), "nothing there").otherwise(F.array_join(wrong, ","))
    return a.join(b, key, "full").select(key, problem.alias("problem")).where("problem <> ''")
