"""Growth, goals and progress of a run, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ARENA_HALF, ARENA_METRES, CELL_METRES, GOALS, GROWTH, MILESTONES, RADIUS_CAP, RADIUS_START


def growth_radius(area: Column) -> Column:
    return F.least(F.lit(RADIUS_CAP), F.sqrt(RADIUS_START**2 + GROWTH * area))


def score(area: Column) -> Column:
    return F.floor(area / 10)


def milestone_count(area: Column) -> Column:
    """Thresholds reached, and one more for every further five millions."""
    reached = F.size(F.filter(F.array(*map(F.lit, MILESTONES)), lambda m: area >= m))
    return reached + F.greatest(F.lit(0), F.floor(area / 5_000_000) - 1)


def goal_percent(area: Column, goal: Column) -> Column:
    return F.least(F.lit(100.0), F.coalesce(F.try_divide(F.greatest(area, F.lit(0)), goal), F.lit(0.0)) * 100)


def auto_goal(total: Column) -> Column:
    """The largest standard goal within a twentieth of the total, else 100 or the total, in whole cells of 4."""
    chosen = F.coalesce(*[F.when(F.lit(g) <= total * 0.05, F.lit(g)) for g in GOALS], F.least(F.lit(100), total))
    return F.greatest(F.lit(4), F.least(F.lit(GOALS[0]), total, F.floor(chosen / 4) * 4))


def sound_area(area: Column) -> Column:
    """Area made up of whole cells; anything else fails the job."""
    ok = (area >= 0) & (area % 4 == 0)
    return F.when(F.coalesce(ok, F.lit(False)), area).otherwise(F.raise_error(F.lit("area is not made up of cells")).cast("long"))


def compatible(saved_version: Column, version: Column) -> Column:
    return saved_version.isNull() | (saved_version == version)


def same_frame(lon: Column, lat: Column, basis: Column, lon2: Column, lat2: Column, basis2: Column) -> Column:
    """Frames that agree within 1e-7 degrees of the centre and 1e-9 of the basis."""
    return (F.abs(lon - lon2) <= 1e-7) & (F.abs(lat - lat2) <= 1e-7) & (F.abs(basis - basis2) <= 1e-9)


def prefetch_box(x: Column, y: Column, radius: Column, margin: float, dx: Column, dy: Column, lead: float = 100.0) -> Column:
    """The box to load around a hole: a margin all around, and a lead in the direction of movement, within the arena."""
    size = F.hypot(dx, dy)
    lx, ly = (F.when(size > 0, F.try_divide(d, size) * lead).otherwise(F.lit(0.0)) for d in (dx, dy))
    low = lambda p, d: F.greatest(F.lit(-ARENA_HALF), p - radius - margin + F.least(F.lit(0.0), d))
    high = lambda p, d: F.least(F.lit(ARENA_HALF), p + radius + margin + F.greatest(F.lit(0.0), d))
    return F.struct(low(x, lx).alias("min_x"), low(y, ly).alias("min_y"), high(x, lx).alias("max_x"), high(y, ly).alias("max_y"))



def run_frame(lon: Column, lat: Column, basis: Column, boundary: Column, region: Column, score_area: Column) -> Column:
    """The frame that a run is saved with; the basis is the centre's latitude where none is given."""
    return F.struct(lon.alias("lon"), lat.alias("lat"), F.coalesce(basis, lat).alias("basis"), F.lit(ARENA_METRES).alias("arena"), F.lit(CELL_METRES).alias("cell"), boundary.alias("boundary"), region.alias("region"), score_area.alias("score_area"))


def resumed(saved: Column, version: str, fresh: Column) -> Column:
    """A saved run of this version, else a fresh one."""
    return F.when(F.coalesce(compatible(saved["version"], F.lit(version)), F.lit(False)) & saved.isNotNull(), saved).otherwise(fresh)
