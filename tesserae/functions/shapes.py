"""Planar geometry over arrays of struct<x,y>: rings, polygons and multipolygons as higher-order expressions.

A polygon is an array of rings, the first of them the outer one; a multipolygon is an
array of polygons. Rings may be open or closed and wind either way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ARENA_HALF, BOUNDARY_EPS, EDGE_EPS, FIT_TOLERANCE, MOTION_EPS




def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x") if not isinstance(x, Column) else x.alias("x"), F.lit(y).cast("double").alias("y") if not isinstance(y, Column) else y.alias("y"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rectangle_ring(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """A closed counter-clockwise ring."""
    return F.array(point(min_x, min_y), point(max_x, min_y), point(max_x, max_y), point(min_x, max_y), point(min_x, min_y))


def edges(ring: Column) -> Column:
    """Edges (a, b) of a ring, with the one that closes it; each point and the next one."""
    following = lambda r: F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    # the ring may be an expression of its own, as in a chain of cuts, each of which would compute the one before several times
    return let(ring, lambda r: F.zip_with(r, following(r), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def outer_vertices(polygons: Column) -> Column:
    return F.flatten(F.transform(polygons, lambda p: F.try_element_at(p, F.lit(1))))


def bounds(points: Column) -> Column:
    """Smallest and largest coordinates; null without points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    found = F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))
    return F.when(F.size(points) > 0, found)


def signed_area(ring: Column) -> Column:
    """Positive if counter-clockwise; triangles fan out from the first point, which keeps large coordinates from cancelling."""
    return let(ring, _signed_area)


def _signed_area(ring: Column) -> Column:
    o = ring[0]
    pairs = F.zip_with(F.slice(ring, 2, F.greatest(F.size(ring) - 2, F.lit(0))), F.slice(ring, 3, F.greatest(F.size(ring) - 2, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    term = lambda e: (e["a"]["x"] - o["x"]) * (e["b"]["y"] - o["y"]) - (e["a"]["y"] - o["y"]) * (e["b"]["x"] - o["x"])
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, e: s + term(e)) / 2)


def polygon_area(polygon: Column) -> Column:
    """Outer area less the holes', at least 0."""
    holes = F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0)))
    taken = F.aggregate(F.transform(holes, lambda r: F.abs(signed_area(r))), F.lit(0.0), lambda s, a: s + a)
    return F.when(F.size(polygon) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.abs(signed_area(polygon[0])) - taken))


def multipolygon_area(polygons: Column) -> Column:
    return F.aggregate(F.transform(polygons, polygon_area), F.lit(0.0), lambda s, a: s + a)


def closest_on_edge(x: Column, y: Column, edge: Column) -> Column:
    """The point of an edge nearest to (x, y); edges may have length zero."""
    a, b = edge["a"], edge["b"]
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, size)))).otherwise(F.lit(0.0))
    return F.struct((a["x"] + t * dx).alias("x"), (a["y"] + t * dy).alias("y"))


def edge_distance(x: Column, y: Column, edge: Column) -> Column:
    p = closest_on_edge(x, y, edge)
    return F.hypot(x - p["x"], y - p["y"])


def on_ring(x: Column, y: Column, ring: Column, eps: float = BOUNDARY_EPS) -> Column:
    return F.exists(edges(ring), lambda e: edge_distance(x, y, e) <= eps)


def _crosses(x: Column, y: Column, e: Column) -> Column:
    a, b = e["a"], e["b"]
    at = F.try_divide((a["x"] - b["x"]) * (y - b["y"]), a["y"] - b["y"]) + b["x"]
    return ((a["y"] > y) != (b["y"] > y)) & F.coalesce(x < at, F.lit(False))


def in_ring(x: Column, y: Column, ring: Column, boundary: bool = True) -> Column:
    """Even-odd containment; what lies on the boundary counts as ``boundary`` says."""
    odd = F.size(F.filter(edges(ring), lambda e: _crosses(x, y, e))) % 2 == 1
    return F.when(F.size(ring) < 3, False).when(on_ring(x, y, ring), boundary).otherwise(odd)


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Solid membership: holes are empty inside, all edges are solid."""
    holes = F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0)))
    return F.when(F.size(polygon) == 0, False).otherwise(in_ring(x, y, polygon[0]) & ~F.exists(holes, lambda r: in_ring(x, y, r, False)))


def in_multipolygon(x: Column, y: Column, polygons: Column) -> Column:
    return F.exists(polygons, lambda p: in_polygon(x, y, p))


def fits_circle(polygons: Column, x: Column, y: Column, radius: Column, tolerance: float = FIT_TOLERANCE) -> Column:
    """Whether there are outer vertices and all of them lie within the radius, with some tolerance."""
    points, allowed = outer_vertices(polygons), radius * tolerance + BOUNDARY_EPS
    near = lambda p: (p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y) <= allowed * allowed
    return (radius >= 0) & (F.size(points) > 0) & F.forall(points, near)


def boxes_touch(a: Column, b: Column) -> Column:
    """Bounding boxes that overlap or touch."""
    return (a["min_x"] <= b["max_x"]) & (a["max_x"] >= b["min_x"]) & (a["min_y"] <= b["max_y"]) & (a["max_y"] >= b["min_y"])


def boxes_overlap(a: Column, b: Column, eps: float = 1e-10) -> Column:
    """Bounding boxes that share more than an edge."""
    return (a["min_x"] < b["max_x"] - eps) & (a["max_x"] > b["min_x"] + eps) & (a["min_y"] < b["max_y"] - eps) & (a["max_y"] > b["min_y"] + eps)


def nearest_boundary(x: Column, y: Column, polygon: Column) -> Column:
    """Distance to, and point of, the nearest boundary of a polygon, holes included."""
    every = F.flatten(F.transform(polygon, edges))
    found = F.transform(every, lambda e: F.struct(edge_distance(x, y, e).alias("distance"), closest_on_edge(x, y, e).alias("point")))
    return F.array_min(found)


def without_repeats(ring: Column) -> Column:
    """A ring without its closing point and without points that repeat the one before."""
    open_ring = F.when((F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    paired = let(open_ring, lambda r: F.transform(r, lambda p, i: F.struct(p.alias("p"), F.when(i > 0, F.get(r, i - 1)).alias("q"))))
    return F.filter(paired, lambda e: e["q"].isNull() | (e["p"] != e["q"]))


def canonical_ring(ring: Column, outer: bool | Column = True, measured: Callable[[Column], Column] = signed_area) -> Column:
    """Closed ring that starts at its smallest point and winds counter-clockwise, clockwise for holes; null if it has no area."""
    plain = let(ring, lambda r: F.transform(without_repeats(r), lambda e: e["p"]))

    def turned(wound: Column) -> Column:
        return let(F.array_position(wound, F.array_min(wound)).cast("int"), lambda k: F.concat(F.slice(wound, k, F.size(wound) - k + 1), F.slice(wound, F.lit(1), k)))

    def wind(p: Column) -> Column:
        return let(measured(p), lambda a: F.when((F.size(p) >= 3) & (F.abs(a) >= 1e-8), let(F.when((a > 0) == F.lit(outer), p).otherwise(F.reverse(p)), turned)))

    return let(plain, wind)


def canonical_polygon(polygon: Column) -> Column:
    """Canonical outer ring, then canonical holes in structural order."""
    holes = F.transform(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), lambda r: canonical_ring(r, False))
    return F.concat(F.array(canonical_ring(polygon[0])), F.array_sort(holes))


def canonical_line(line: Column) -> Column:
    """The smaller one of a line and its reverse."""
    return F.least(line, F.reverse(line))


def clip_half_plane(ring: Column, axis: str, edge, keep_above: bool) -> Column:
    """An open ring cut at a vertical or horizontal line (one step of clipping to a box)."""
    edge, other = F.lit(edge) if not isinstance(edge, Column) else edge, "y" if axis == "x" else "x"
    inside = lambda p: (p[axis] >= edge) if keep_above else (p[axis] <= edge)

    def cut(e: Column) -> Column:
        a, b = e["a"], e["b"]
        across = a[other] + (edge - a[axis]) * F.try_divide(b[other] - a[other], b[axis] - a[axis])
        crossing = point(edge, across) if axis == "x" else point(across, edge)
        empty = F.filter(F.array(a), lambda _: F.lit(False))
        return (
            F.when(inside(a) & inside(b), F.array(b))
            .when(inside(a), F.array(crossing))
            .when(inside(b), F.array(crossing, b))
            .otherwise(empty)
        )

    return F.flatten(F.transform(edges(ring), cut))


def clip_to_box(ring: Column, min_x, min_y, max_x, max_y) -> Column:
    """An open ring clipped to a box; areas are exact, and concave rings may keep bridges of no width."""
    for axis, edge, above in (("x", min_x, True), ("y", min_y, True), ("x", max_x, False), ("y", max_y, False)):
        ring = clip_half_plane(ring, axis, edge, above)
    return ring


def vertex_count(polygons: Column) -> Column:
    return F.aggregate(F.flatten(F.transform(polygons, lambda p: F.transform(p, F.size))), F.lit(0), lambda s, n: s + n)


def south_walls(polygons: Column) -> Column:
    """Number of outer edges that face south, as seen from below: west to east on a counter-clockwise ring."""
    walls = F.flatten(F.transform(polygons, lambda p: edges(p[0])))
    return F.size(F.filter(walls, lambda e: e["b"]["x"] > e["a"]["x"]))


def circumcircle(a: Column, b: Column, c: Column) -> Column:
    """Circle through three points; null if they lie on a line."""
    bx, by, cx, cy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - a["x"], c["y"] - a["y"]
    d = 2 * (bx * cy - by * cx)
    ux = F.try_divide(cy * (bx * bx + by * by) - by * (cx * cx + cy * cy), d)
    uy = F.try_divide(bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by), d)
    return F.when(F.abs(d) > 1e-12, F.struct((a["x"] + ux).alias("x"), (a["y"] + uy).alias("y"), F.hypot(ux, uy).alias("radius")))


def square(radius: Column) -> Column:
    """The box of the arena grown by a radius."""
    half = ARENA_HALF + radius
    return F.struct((-half).alias("min_x"), (-half).alias("min_y"), half.alias("max_x"), half.alias("max_y"))


def swept_box(x: Column, y: Column, dx: Column, dy: Column, radius: Column) -> Column:
    """The box that a circle covers on its way."""
    low = lambda p, d: F.least(p, p + d) - radius
    high = lambda p, d: F.greatest(p, p + d) + radius
    return F.struct(low(x, dx).alias("min_x"), low(y, dy).alias("min_y"), high(x, dx).alias("max_x"), high(y, dy).alias("max_y"))


def every_vertex(polygons: Column) -> Column:
    return F.flatten(F.flatten(polygons))


def mapped(polygons: Column, use: Callable[[Column], Column]) -> Column:
    """Polygons with each point replaced."""
    return F.transform(polygons, lambda p: F.transform(p, lambda r: F.transform(r, use)))


def seam_intervals(polygons: Column, axis: str, at, eps: float = 1e-10) -> Column:
    """Intervals of the outlines that run along a tile edge (the line where ``axis`` has this value), longer than ``eps``, in order."""
    other = "y" if axis == "x" else "x"
    every = F.flatten(F.transform(F.flatten(polygons), edges))
    along = F.filter(every, lambda e: (F.abs(e["a"][axis] - at) <= eps) & (F.abs(e["b"][axis] - at) <= eps) & (F.abs(e["a"][other] - e["b"][other]) > eps))
    return F.array_sort(F.transform(along, lambda e: F.struct(F.least(e["a"][other], e["b"][other]).alias("lo"), F.greatest(e["a"][other], e["b"][other]).alias("hi"))))


def crossing_shares(x: Column, y: Column, dx: Column, dy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Shares of a way (x, y) + t (dx, dy) at which it meets an edge: none, one, or the two ends of the part that it runs along the edge."""
    ex, ey, rx, ry = bx - ax, by - ay, ax - x, ay - y
    turn, size = dx * ey - dy * ex, dx * dx + dy * dy
    t, u = F.try_divide(rx * ey - ry * ex, turn), F.try_divide(rx * dy - ry * dx, turn)
    within = lambda s: s.between(-EDGE_EPS, 1 + EDGE_EPS)
    clamp = lambda s: F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))
    none = F.array().cast("array<double>")
    a, b = F.try_divide(rx * dx + ry * dy, size), F.try_divide((bx - x) * dx + (by - y) * dy, size)
    along = (F.abs(rx * dy - ry * dx) <= MOTION_EPS * F.sqrt(size)) & (size > 0) & (F.greatest(a, b) >= 0) & (F.least(a, b) <= 1)
    return F.when(turn != 0, F.when(within(t) & within(u), F.array(clamp(t))).otherwise(none)).when(F.coalesce(along, F.lit(False)), F.array(clamp(a), clamp(b))).otherwise(none)


def capsule(x: Column, y: Column, x2: Column, y2: Column, radius: Column) -> Column:
    """A swept circle: length of the way, square of the radius, the heights it spans, and the corners of the rectangle along the way, null for a circle at rest."""
    dx, dy = x2 - x, y2 - y
    size = F.hypot(dx, dy)
    nx, ny = F.try_divide(-dy, size) * radius, F.try_divide(dx, size) * radius
    corners = F.array(point(x + nx, y + ny), point(x2 + nx, y2 + ny), point(x2 - nx, y2 - ny), point(x - nx, y - ny))
    return F.struct(size.alias("length"), (radius * radius).alias("r2"), (F.least(y, y2) - radius).alias("min_y"), (F.greatest(y, y2) + radius).alias("max_y"), F.when(size > 0, corners).alias("corners"))


def outward_normal(x: Column, y: Column, edge: Column, polygon: Column, probe: float = 1e-4) -> Column:
    """The unit normal of an edge that points out of the polygon at a point of it: away from the side on which a point close by is inside."""
    dx, dy = edge["b"]["x"] - edge["a"]["x"], edge["b"]["y"] - edge["a"]["y"]
    size = F.hypot(dx, dy)
    nx, ny = F.try_divide(dy, size), F.try_divide(-dx, size)
    sign = F.when(in_polygon(x + nx * probe, y + ny * probe, polygon), -1.0).otherwise(1.0)
    return F.struct((nx * sign + 0.0).alias("x"), (ny * sign + 0.0).alias("y"))


def _opened(ring: Column) -> Column:
    """A ring without its closing point."""
    return F.when((F.size(ring) > 1) & (ring[0] == F.element_at(ring, -1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def _chains(ring: Column, axis: str, edge: Column, inside: Callable[[Column], Column]) -> Column:
    """The stretches of an open ring that lie inside, each with the points where it enters and leaves; the ring has points on both sides."""
    other = "y" if axis == "x" else "x"

    def crossing(a: Column, b: Column) -> Column:
        across = a[other] + (edge - a[axis]) * F.try_divide(b[other] - a[other], b[axis] - a[axis])
        return point(edge, across) if axis == "x" else point(across, edge)

    def cut(r: Column) -> Column:
        def stretches(held: Column) -> Column:
            n = F.size(r)
            following = lambda i: F.get(r, (i + 1) % n)
            at = lambda first: F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.get(held, i) == F.lit(not first)) & (F.get(held, (i + 1) % n) == F.lit(first)))
            chain = lambda i, j: F.struct(crossing(F.get(r, i), following(i)).alias("enter"), F.slice(r, i + 2, j - i).alias("within"), crossing(F.get(r, j), following(j)).alias("leave"))
            return F.zip_with(at(True), at(False), chain)

        return let(F.transform(r, inside), stretches)

    turned = let(F.array_position(F.transform(ring, inside), False).cast("int"), lambda k: F.concat(F.slice(ring, k, F.size(ring) - k + 1), F.slice(ring, F.lit(1), k - 1)))
    return let(turned, cut)


def _joined(chains: Column, other: str) -> Column:
    """Closed rings of chains: along the cut, where one leaves, the one that enters at the same rank goes on, as what is inside alternates there."""
    count = F.size(chains)
    ranked = lambda end: F.transform(F.array_sort(F.transform(chains, lambda c, k: F.struct(c[end][other].alias("at"), k.alias("k")))), lambda s: s["k"])

    def rings(following: Column) -> Column:
        every = F.sequence(F.lit(0), count - 1)
        least = F.aggregate(every, every, lambda held, _: F.transform(held, lambda x, k: F.least(x, F.get(held, F.element_at(following, k)))))
        none = F.filter(F.flatten(F.transform(chains, lambda c: c["within"])), lambda _: F.lit(False))

        def ring(first: Column) -> Column:
            start = F.struct(first.alias("at"), none.alias("points"), F.lit(False).alias("done"))

            def step(s: Column, _: Column) -> Column:
                c, then = F.get(chains, s["at"]), F.element_at(following, s["at"])
                points = F.concat(s["points"], F.array(c["enter"]), c["within"], F.array(c["leave"]))
                return F.struct(F.when(s["done"], s["at"]).otherwise(then).alias("at"), F.when(s["done"], s["points"]).otherwise(points).alias("points"), (s["done"] | (then == first)).alias("done"))

            return F.aggregate(every, start, step, lambda s: F.concat(s["points"], F.slice(s["points"], 1, 1)))

        return let(least, lambda held: F.transform(F.filter(every, lambda k: F.get(held, k) == k), ring))

    found = let(F.map_from_arrays(ranked("leave"), ranked("enter")), rings)
    return F.when(count > 0, found).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>"))


def cut_polygon(polygon: Column, axis: str, edge, keep_above: bool) -> Column:
    """What lies on one side of a vertical or horizontal line, as an array of polygons: a concave one falls into several, and a hole that the line meets becomes part of the outline."""
    edge, other = edge if isinstance(edge, Column) else F.lit(float(edge)), "y" if axis == "x" else "x"
    inside = lambda p: (p[axis] > edge) if keep_above else (p[axis] < edge)
    beside = lambda p: (p[axis] >= edge) if keep_above else (p[axis] <= edge)
    wound = F.transform(polygon, lambda r, k: let(_opened(r), lambda o: F.when((signed_area(o) > 0) == (k == 0), o).otherwise(F.reverse(o))))

    def cut(rings: Column) -> Column:
        met = F.filter(rings, lambda r: F.exists(r, inside) & F.exists(r, lambda p: ~inside(p)))
        holes = F.filter(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: F.forall(r, inside))
        closed = lambda r: F.concat(r, F.slice(r, 1, 1))
        pieces = let(F.flatten(F.transform(met, lambda r: _chains(r, axis, edge, inside))), lambda c: _joined(c, other))
        solid = F.filter(pieces, lambda r: F.abs(signed_area(r)) > 0)
        own = lambda r: F.concat(F.array(r), F.transform(F.filter(holes, lambda h: in_ring(h[0]["x"], h[0]["y"], r)), closed))
        return F.when(F.size(rings) == 0, F.array(rings)).when(F.forall(F.flatten(rings), beside), F.array(F.transform(rings, closed))).otherwise(F.transform(solid, own))

    return let(wound, cut)
