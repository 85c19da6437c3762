"""Planar geometry as Column expressions. Coordinates are metres in one projected plane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(*columns: str) -> Column:
    """Do all columns hold a number, neither NULL nor NaN nor infinite? Otherwise false, never NULL."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce((F.col(c) - F.col(c)) == 0, F.lit(False))
    return out


def point_dist2(x: Column, y: Column, px: Column, py: Column) -> Column:
    dx, dy = x - px, y - py
    return dx * dx + dy * dy


def segment_dist2(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance from a point to a segment; a zero-length segment counts as its first end."""
    dx, dy = x2 - x1, y2 - y1
    dd = dx * dx + dy * dy
    along = ((x - x1) * dx + (y - y1) * dy) / F.when(dd > 0, dd)
    u = F.least(F.greatest(F.coalesce(along, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return point_dist2(x, y, x1 + u * dx, y1 + u * dy)


def box_dist2(x: Column, y: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Squared distance to the nearest point of a box, 0 inside it."""
    dx = F.greatest(minx - x, x - maxx, F.lit(0.0))
    dy = F.greatest(miny - y, y - maxy, F.lit(0.0))
    return dx * dx + dy * dy


def box_far_dist2(x: Column, y: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Squared distance to the farthest corner of a box: nothing inside the box is farther."""
    dx = F.greatest(F.abs(x - minx), F.abs(x - maxx))
    dy = F.greatest(F.abs(y - miny), F.abs(y - maxy))
    return dx * dx + dy * dy


def ring_edges(rings: Column) -> Column:
    """array<array<struct<x,y>>> (each ring closed or open) -> array<struct<x1,y1,x2,y2>>."""

    def edges_of(ring: Column) -> Column:
        return F.transform(
            ring,
            lambda p, i: F.struct(
                p["x"].alias("x1"),
                p["y"].alias("y1"),
                ring[(i + 1) % F.size(ring)]["x"].alias("x2"),
                ring[(i + 1) % F.size(ring)]["y"].alias("y2"),
            ),
        )

    return F.flatten(F.transform(rings, edges_of))


def _edge_case(x: Column, y: Column, e: Column, start: Column, end: Column, side: Column) -> Column:
    """One of three values for a point beside an edge: it is nearest to its start, its end or its side."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    dot = (x - e["x1"]) * dx + (y - e["y1"]) * dy
    return F.when(dot <= 0, start).when(dot >= dx * dx + dy * dy, end).otherwise(side)


def _off_line(x: Column, y: Column, e: Column) -> Column:
    """Squared cross product of an edge and the way to the point: 0 exactly on the edge's line."""
    cross = (x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"])
    return F.pow(cross, F.lit(2.0))


def _edge_length2(e: Column) -> Column:
    return point_dist2(e["x1"], e["y1"], e["x2"], e["y2"])


def edge_near(x: Column, y: Column, e, reach2: Column) -> Column:
    """Does an edge (a struct or dict with x1, y1, x2, y2) come within the (squared) reach? Without division, so exact
    for whole numbers."""
    return _edge_case(
        x, y, e,
        point_dist2(x, y, e["x1"], e["y1"]) <= reach2,
        point_dist2(x, y, e["x2"], e["y2"]) <= reach2,
        _off_line(x, y, e) <= reach2 * _edge_length2(e),
    )


def edge_dist2(x: Column, y: Column, e) -> Column:
    """Squared distance from a point to an edge (a struct or dict with x1, y1, x2, y2)."""
    return _edge_case(
        x, y, e,
        point_dist2(x, y, e["x1"], e["y1"]),
        point_dist2(x, y, e["x2"], e["y2"]),
        _off_line(x, y, e) / _edge_length2(e),
    )


def with_edge_near(df: DataFrame, name: str, x: Column, y: Column, e, reach2: Column) -> DataFrame:
    """Add whether an edge comes within the (squared) reach, as edge_near has it, worked out in steps."""
    keep = df.columns
    df = settle(df, _kx=e["x2"] - e["x1"], _ky=e["y2"] - e["y1"], _ka=x - e["x1"], _kb=y - e["y1"], _kc=x - e["x2"], _kd=y - e["y2"])
    kx, ky, ka, kb, kc, kd = (F.col(f"_k{c}") for c in "xyabcd")
    df = settle(df, _dot=ka * kx + kb * ky, _long=kx * kx + ky * ky, _cross=ka * ky - kb * kx, _d1=ka * ka + kb * kb, _d2=kc * kc + kd * kd, _reach2=reach2)
    near = F.when(F.col("_dot") <= 0, F.col("_d1") <= F.col("_reach2")).when(F.col("_dot") >= F.col("_long"), F.col("_d2") <= F.col("_reach2"))
    return df.select(*keep, near.otherwise(F.col("_cross") * F.col("_cross") <= F.col("_reach2") * F.col("_long")).alias(name))


def area_edge_near(x: Column, y: Column, edges: Column, reach2: Column) -> Column:
    """Does any edge come within the (squared) reach?"""
    return F.exists(edges, lambda e: edge_near(x, y, e, reach2))


def area_holds(x: Column, y: Column, edges: Column) -> Column:
    """Is the point inside, by the parity of edges crossed on the way east? Holes count by parity too."""

    def crossed(e: Column) -> Column:
        west = (x - e["x1"]) * (e["y2"] - e["y1"]) < (y - e["y1"]) * (e["x2"] - e["x1"])
        return ((e["y1"] > y) != (e["y2"] > y)) & (west == (e["y2"] > e["y1"]))

    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != crossed(e))


def area_dist2(x: Column, y: Column, edges: Column) -> Column:
    """Squared distance from a point to an area, 0 inside."""
    rim = F.array_min(F.transform(edges, lambda e: edge_dist2(x, y, e)))
    return F.when(area_holds(x, y, edges), F.lit(0.0)).otherwise(rim)


def settle(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are worked out once per row, even if later filters and columns use them often: the
    optimizer copies plain columns into every use, which makes nested formulas grow without end."""
    row = F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("_row")
    return df.select("*", row).select(*df.columns, *[F.col(f"_row.{n}").alias(n) for n in cols])


def with_segment_dist2(df: DataFrame, seg: tuple[Column, Column, Column, Column], spots: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Add the squared distances from spots (output name -> x, y) to a segment, as segment_dist2 has them. Worked out
    in steps, each once per row: as one formula the compiled code grows beyond what the JVM translates."""
    x1, y1, x2, y2 = seg
    keep = df.columns
    df = settle(df, _gx=x2 - x1, _gy=y2 - y1)
    df = settle(df, _gg=F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))
    along = {f"_g{i}": ((x - x1) * F.col("_gx") + (y - y1) * F.col("_gy")) / F.when(F.col("_gg") > 0, F.col("_gg")) for i, (x, y) in enumerate(spots.values())}
    df = settle(df, **along)
    df = settle(df, **{f"_h{i}": F.least(F.greatest(F.coalesce(f"_g{i}", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) for i in range(len(spots))})
    off = {}
    for i, (x, y) in enumerate(spots.values()):
        off |= {f"_p{i}": x - (x1 + F.col(f"_h{i}") * F.col("_gx")), f"_q{i}": y - (y1 + F.col(f"_h{i}") * F.col("_gy"))}
    df = settle(df, **off)
    return df.select(*keep, *[(F.col(f"_p{i}") * F.col(f"_p{i}") + F.col(f"_q{i}") * F.col(f"_q{i}")).alias(n) for i, n in enumerate(spots)])


def with_circle_interval(df: DataFrame, x: str, y: str, r: float, seg: list[str], lo: str, hi: str) -> DataFrame:
    """Keep the rows whose segment (column names x1, y1, x2, y2) passes through the circle around (x, y),
    and add the part [lo, hi] of the segment inside it, as fractions of the segment."""
    x1, y1, x2, y2 = (F.col(c) for c in seg)
    dx, dy, fx, fy = x2 - x1, y2 - y1, x1 - F.col(x), y1 - F.col(y)
    df = settle(df, _a=dx * dx + dy * dy, _b=fx * dx + fy * dy, _c=fx * fx + fy * fy - F.lit(float(r) * float(r)))
    a, b = F.col("_a"), F.col("_b")
    df = settle(df.filter(a > 0), _disc=b * b - a * F.col("_c")).filter("_disc > 0")
    root = F.sqrt("_disc")
    ends = {lo: F.greatest(F.lit(0.0), (-b - root) / a), hi: F.least(F.lit(1.0), (root - b) / a)}
    return settle(df, **ends).filter(F.col(hi) > F.col(lo)).drop("_a", "_b", "_c", "_disc")


def _slab(p: Column, d: Column, lo: Column, hi: Column) -> dict[str, Column]:
    """First and last fraction of p + t*d between two parallel bounds; NULL if it never is."""
    moving = F.when(d != 0, d)
    inside = (p >= lo) & (p <= hi)
    return {
        "first": F.when(d != 0, F.least((lo - p) / moving, (hi - p) / moving)).when(inside, F.lit(float("-inf"))),
        "last": F.when(d != 0, F.greatest((lo - p) / moving, (hi - p) / moving)).when(inside, F.lit(float("inf"))),
    }


def with_capsule_interval(df: DataFrame, part: list[str], r: float, line: list[str], lo: str, hi: str) -> DataFrame:
    """Keep the rows whose segment `part` comes within r of segment `line` (both column names x1, y1, x2,
    y2), and add the fractions [lo, hi] of `part` between which it does.

    The points within r of a segment form a convex shape, so they cut `part` in one interval: the hull of
    what the circles around both ends and the rectangle between them cut out.
    """
    x1, y1, x2, y2 = (F.col(c) for c in part)
    ax, ay, bx, by = (F.col(c) for c in line)
    keep = df.columns
    dx, dy, ex, ey = x2 - x1, y2 - y1, bx - ax, by - ay
    fx, fy, gx, gy = x1 - ax, y1 - ay, x1 - bx, y1 - by
    rr = F.lit(float(r) * float(r))
    df = settle(
        df,
        _a=dx * dx + dy * dy,
        _len=F.sqrt(ex * ex + ey * ey),
        _b1=fx * dx + fy * dy,
        _c1=fx * fx + fy * fy - rr,
        _b2=gx * dx + gy * dy,
        _c2=gx * gx + gy * gy - rr,
        _p=fx * ex + fy * ey,
        _v=dx * ex + dy * ey,
        _q=fy * ex - fx * ey,
        _w=dy * ex - dx * ey,
    ).filter("_a > 0")
    # Across the line the bounds are -r and r; multiplied by its length like _q and _w.
    reach = F.col("_len") * F.lit(float(r))
    line_is_long = F.col("_len") > 0
    along = _slab(F.col("_p"), F.col("_v"), F.lit(0.0), F.col("_len") * F.col("_len"))
    across = _slab(F.col("_q"), F.col("_w"), -reach, reach)
    df = settle(
        df,
        _r1=F.sqrt(F.greatest(F.col("_b1") * F.col("_b1") - F.col("_a") * F.col("_c1"), F.lit(0.0))),
        _r2=F.sqrt(F.greatest(F.col("_b2") * F.col("_b2") - F.col("_a") * F.col("_c2"), F.lit(0.0))),
        _s0=F.when(line_is_long, along["first"]),
        _s1=F.when(line_is_long, along["last"]),
        _t0=F.when(line_is_long, across["first"]),
        _t1=F.when(line_is_long, across["last"]),
    )
    both = F.col("_s0").isNotNull() & F.col("_t0").isNotNull()
    zero, one = F.lit(0.0), F.lit(1.0)
    df = settle(
        df,
        _l1=F.greatest(zero, (-F.col("_b1") - F.col("_r1")) / F.col("_a")),
        _h1=F.least(one, (F.col("_r1") - F.col("_b1")) / F.col("_a")),
        _l2=F.greatest(zero, (-F.col("_b2") - F.col("_r2")) / F.col("_a")),
        _h2=F.least(one, (F.col("_r2") - F.col("_b2")) / F.col("_a")),
        _l3=F.when(both, F.greatest(zero, "_s0", "_t0")),
        _h3=F.when(both, F.least(one, "_s1", "_t1")),
    )
    cuts = [(F.col(f"_l{i}"), F.col(f"_h{i}")) for i in (1, 2, 3)]
    df = settle(
        df,
        **{
            lo: F.least(*[F.when(h > low, low) for low, h in cuts]),
            hi: F.greatest(*[F.when(h > low, h) for low, h in cuts]),
        },
    )
    return df.select(*keep, lo, hi).filter(F.col(hi) > F.col(lo))


def only_touching(df: DataFrame, a: tuple, b: tuple) -> DataFrame:
    """The rows whose closed segments a and b share a point, as segments_touch has it, worked out in steps."""
    keep = df.columns
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = a, b
    df = df.filter((F.least(ax1, ax2) <= F.greatest(bx1, bx2)) & (F.least(bx1, bx2) <= F.greatest(ax1, ax2)))
    df = df.filter((F.least(ay1, ay2) <= F.greatest(by1, by2)) & (F.least(by1, by2) <= F.greatest(ay1, ay2)))
    df = settle(df, _t1=_turn(bx1, by1, bx2, by2, ax1, ay1), _t2=_turn(bx1, by1, bx2, by2, ax2, ay2)).filter(F.col("_t1") * F.col("_t2") <= 0)
    df = settle(df, _t3=_turn(ax1, ay1, ax2, ay2, bx1, by1), _t4=_turn(ax1, ay1, ax2, ay2, bx2, by2)).filter(F.col("_t3") * F.col("_t4") <= 0)
    return df.select(*keep)


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_touch(a: tuple, b: tuple) -> Column:
    """Do two closed segments (x1, y1, x2, y2) share a point?"""
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    boxes = (
        (F.least(ax1, ax2) <= F.greatest(bx1, bx2))
        & (F.least(bx1, bx2) <= F.greatest(ax1, ax2))
        & (F.least(ay1, ay2) <= F.greatest(by1, by2))
        & (F.least(by1, by2) <= F.greatest(ay1, ay2))
    )
    splits_a = _turn(bx1, by1, bx2, by2, ax1, ay1) * _turn(bx1, by1, bx2, by2, ax2, ay2) <= 0
    splits_b = _turn(ax1, ay1, ax2, ay2, bx1, by1) * _turn(ax1, ay1, ax2, ay2, bx2, by2) <= 0
    return boxes & splits_a & splits_b
