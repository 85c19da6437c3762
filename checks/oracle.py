"""SQL twins of the registered queries: plain distance joins over the whole tables, without any grid."""

from __future__ import annotations

from checks.layers import ADDITION, COUNTY_NAMES, LATE
from checks.oracle_layers import near_box, near_square, pt_d2, seg_d2, square_d2, triangle_d2, with_layers, zones_by_edge

R_MI, R_HALF, R_QTR, R_CRASH, R_RAIL, R_CORR = (
    f"{r}::DOUBLE" for r in (1609.34, 804.672, 402.336, 152.4, 121.92, 60.96)
)
RANKED = ", ".join(f"'{n}'" for n in COUNTY_NAMES[:7])
PARTS: dict[str, str] = {}


def points_near(layer: str, r: str, sites: str = "sites", where: str = "TRUE") -> str:
    return (
        f"{sites} s JOIN {layer} p ON {near_square('s', 'p', r)} AND {pt_d2('s', 'p')} <= {r} * {r} AND {where}"
    )


def exists_point(layer: str, r: str, alias: str = "s", where: str = "TRUE") -> str:
    return (
        f"EXISTS (SELECT 1 FROM {layer} p WHERE {near_square(alias, 'p', r)}"
        f" AND {pt_d2(alias, 'p')} <= {r} * {r} AND {where})"
    )


def segs_near(layer: str, r: str, sites: str = "sites", where: str = "TRUE") -> str:
    return (
        f"{sites} s JOIN {layer} g ON {near_box('s', 'g', r)} AND {seg_d2('s.x', 's.y', 'g')} <= {r} * {r} AND {where}"
    )


def triangles_near(layer: str, r: str, sites: str = "sites", where: str = "TRUE") -> str:
    return (
        f"{sites} s JOIN {layer} a ON s.x BETWEEN a.ax - {r} AND a.ax + a.w + {r}"
        f" AND s.y BETWEEN a.ay - {r} AND a.ay + a.w + {r} AND {triangle_d2('s', 'a')} <= {r} * {r} AND {where}"
    )


def squares_near(layer: str, r: str, sites: str = "sites") -> str:
    return (
        f"{sites} s JOIN {layer} a ON s.x BETWEEN a.x0 - {r} AND a.x0 + a.side + {r}"
        f" AND s.y BETWEEN a.y0 - {r} AND a.y0 + a.side + {r} AND {square_d2('s', 'a')} <= {r} * {r}"
    )


def for_all(body: str, cols: str, sites: str = "sites") -> str:
    """Rows for every site; `body` gives some of them."""
    return f"SELECT s0.site_id, {cols} FROM {sites} s0 LEFT JOIN ({body}) f ON f.site_id = s0.site_id"


def region(layer: str, column: str, name: str, r: str, sites: str = "sites") -> str:
    body = (
        f"SELECT s.site_id, arg_min(a.{column}, row({square_d2('s', 'a')}, a.id)) AS v"
        f" FROM {squares_near(layer, r, sites)} GROUP BY s.site_id"
    )
    return for_all(body, f"f.v AS {name}", sites)


def counts(sites: str) -> dict[str, str]:
    """Feature statements of the study over a given site table."""
    one = f"SELECT s.site_id, %s FROM %s GROUP BY s.site_id"
    comments = one % (
        "count(*) FILTER (kml_name = 'improvement needed') AS wiki_probarea_qtr,"
        "count(*) FILTER (kml_name = 'suggested new crossing') AS wiki_new_xing_qtr,"
        "count(*) FILTER (gender = 'Female') AS wiki_women_qtr,"
        "count(*) FILTER (race_black IS NOT NULL OR race_asia IS NOT NULL) AS wiki_pplofcolor_qtr",
        points_near("comments", R_QTR, sites),
    )
    schools = one % (
        "count(*) FILTER (sch_type1 NOT LIKE 'COLLEGE%') AS schools_half,"
        "count(*) FILTER (sch_type1 LIKE 'COLLEGE%') AS colleges_half",
        points_near("schools", R_HALF, sites),
    )
    taz = one % (
        ", ".join(
            f"avg({c}) AS {n}"
            for n, c in (
                ("popden_2014", "popden2014"), ("popden_2040", "popden2040"), ("empden_2014", "empden2014"),
                ("empden_2040", "empden2040"), ("bw_modeshr", "bike_walk_modeshare"),
                ("age_65_plus_pct", "seniors_per"), ("age_under_15_pct", "pop_under_15_per"),
                ("zero_car_pct", "zero_car_housing_units_per"), ("ppl_of_color_pct", "ppl_of_color_percent"),
            )
        ),
        triangles_near("areas", R_HALF, sites),
    )
    return {
        "f_crash": one % ("count(*) AS bkpd_crash_500ft", points_near("crashes", R_CRASH, sites)),
        "f_comments": comments,
        "f_schools": schools,
        "f_parks": one % ("count(*) AS reg_parks_half", points_near("parks", R_HALF, sites)),
        "f_stops": one % ("sum(on_off)::DOUBLE AS trans_riders_qtr", points_near("stops", R_HALF, sites)),
        "f_cells": one % ("avg(value) AS avg_slope", points_near("cells", R_QTR, sites)),
        "f_taz": taz,
        "f_acp": one % ("10 AS acp", triangles_near("poverty", "0::DOUBLE", sites)),
        "f_acp50": one % ("10 AS acp50", squares_near("poverty50", "0::DOUBLE", sites)),
        "f_corridor": one % ("10 AS rbtn_corridor", triangles_near("corridors", "0::DOUBLE", sites)),
        "f_alignment": one % ("10 AS rbtn_alignment", segs_near("alignments", R_QTR, sites)),
        "f_rail": one % (
            f"arg_min(p.volume, row({pt_d2('s', 'p')}, p.id)) AS rail_volume",
            points_near("rail", R_RAIL, sites, "p.lvolu = 'D' AND p.volume <> 0"),
        ),
        "f_local": f"""SELECT site_id, sum(len_m) FILTER (regstat = 1) / 1609.344::DOUBLE AS ex_local_miles_qtr,
            sum(len_m) FILTER (regstat IN (2, 3)) / 1609.344::DOUBLE AS pl_local_miles_qtr
            FROM ({clipped('local_kept', R_QTR, sites, 'g.regstat')}) GROUP BY site_id""",
        "f_regional": f"""SELECT site_id, sum(len_m) / 1609.34::DOUBLE AS expl_reg_miles_half
            FROM ({clipped('trails', R_HALF, sites)}) GROUP BY site_id""",
        "f_clusters": f"""SELECT s.site_id,
            count(DISTINCT c.cluster_id) FILTER (c.status = 'Existing') AS ex_reg_fac_half,
            count(DISTINCT c.cluster_id) FILTER (c.status <> 'Existing') AS pl_reg_fac_half
            FROM {segs_near('trails', R_HALF, sites)} JOIN trail_clusters c ON c.line_id = g.line_id GROUP BY s.site_id""",
        "f_crossing": f"""SELECT s.site_id, min(row({pt_d2('s', 'p')}, p.id)) AS best
            FROM {sites} s, %s p GROUP BY s.site_id""",
    }


def clipped(layer: str, r: str, sites: str = "sites", extra: str = "g.seg_no") -> str:
    """Length of each segment inside each circle, by the roots of the circle equation along the segment."""
    return f"""
      SELECT * FROM (
        SELECT site_id, line_id, {extra.split('.')[-1]}, a,
          (least(1, (-b + sqrt(b * b - 4 * a * c)) / (2 * a)) - greatest(0, (-b - sqrt(b * b - 4 * a * c)) / (2 * a)))
            * sqrt(a) AS len_m
        FROM (
          SELECT s.site_id, g.line_id, {extra},
            (g.x2 - g.x1) ** 2 + (g.y2 - g.y1) ** 2 AS a,
            2 * ((g.x1 - s.x) * (g.x2 - g.x1) + (g.y1 - s.y) * (g.y2 - g.y1)) AS b,
            (g.x1 - s.x) ** 2 + (g.y1 - s.y) ** 2 - {r} * {r} AS c
          FROM {sites} s JOIN {layer} g ON {near_box('s', 'g', r)}
        ) WHERE a > 0 AND b * b - 4 * a * c > 0
      ) WHERE len_m > 0"""


def _root(sign: str, px: str, py: str) -> str:
    """Where bikeway segment b meets the circle of the corridor radius around (px, py), as a fraction."""
    fx, fy = f"(b.x1 - {px})", f"(b.y1 - {py})"
    half = f"({fx} * b.dx + {fy} * b.dy)"
    disc = f"({half} * {half} - b.dd * ({fx} * {fx} + {fy} * {fy} - {R_CORR} * {R_CORR}))"
    return f"CASE WHEN {disc} > 0 THEN (-{half} {sign} sqrt({disc})) / b.dd END"


def _slab(pos: str, speed: str, lo: str, hi: str, last: bool) -> str:
    pick, far = ("greatest", "'inf'") if last else ("least", "'-inf'")
    return (
        f"CASE WHEN {speed} <> 0 THEN {pick}(({lo} - {pos}) / nullif({speed}, 0), ({hi} - {pos}) / nullif({speed}, 0))"
        f" WHEN {pos} BETWEEN {lo} AND {hi} THEN {far}::DOUBLE END"
    )


PARTS["regional"] = "SELECT DISTINCT x1, y1, x2, y2 FROM (SELECT * FROM trails) UNION SELECT x1, y1, x2, y2 FROM alignments"
PARTS["bike_dirs"] = """SELECT *, x2 - x1 AS dx, y2 - y1 AS dy, (x2 - x1) ** 2 + (y2 - y1) ** 2 AS dd FROM bikeways"""
PARTS["reg_dirs"] = """SELECT *, (x2 - x1) / sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS ux,
    (y2 - y1) / sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS uy, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len FROM regional"""
PARTS["cut_pairs"] = f"""
    SELECT b.line_id, b.seg_no,
      {_root('-', 'g.x1', 'g.y1')} AS a0, {_root('+', 'g.x1', 'g.y1')} AS a1,
      {_root('-', 'g.x2', 'g.y2')} AS b0, {_root('+', 'g.x2', 'g.y2')} AS b1,
      (b.x1 - g.x1) * g.ux + (b.y1 - g.y1) * g.uy AS along, b.dx * g.ux + b.dy * g.uy AS v_along, g.len,
      (b.y1 - g.y1) * g.ux - (b.x1 - g.x1) * g.uy AS off, b.dy * g.ux - b.dx * g.uy AS v_off
    FROM bike_dirs b JOIN reg_dirs g
      ON least(b.x1, b.x2) <= greatest(g.x1, g.x2) + {R_CORR} AND greatest(b.x1, b.x2) >= least(g.x1, g.x2) - {R_CORR}
      AND least(b.y1, b.y2) <= greatest(g.y1, g.y2) + {R_CORR} AND greatest(b.y1, b.y2) >= least(g.y1, g.y2) - {R_CORR}"""
PARTS["cut_parts"] = f"""
    SELECT line_id, seg_no, a0 AS lo, a1 AS hi FROM cut_pairs UNION ALL
    SELECT line_id, seg_no, b0, b1 FROM cut_pairs UNION ALL
    SELECT line_id, seg_no, CASE WHEN p0 IS NOT NULL AND q0 IS NOT NULL THEN greatest(p0, q0) END,
      CASE WHEN p0 IS NOT NULL AND q0 IS NOT NULL THEN least(p1, q1) END
    FROM (SELECT line_id, seg_no,
      {_slab('along', 'v_along', '0', 'len', False)} AS p0, {_slab('along', 'v_along', '0', 'len', True)} AS p1,
      {_slab('off', 'v_off', '-' + R_CORR, R_CORR, False)} AS q0, {_slab('off', 'v_off', '-' + R_CORR, R_CORR, True)} AS q1
      FROM cut_pairs)"""
PARTS["cut_spans"] = """
    SELECT line_id, seg_no, lo, hi FROM (
      SELECT line_id, seg_no, greatest(lo, 0) AS lo, least(hi, 1) AS hi FROM cut_parts WHERE lo IS NOT NULL AND hi IS NOT NULL
    ) WHERE hi > lo
    UNION ALL SELECT line_id, seg_no, 0, 0 FROM bikeways UNION ALL SELECT line_id, seg_no, 1, 1 FROM bikeways"""
PARTS["local_kept"] = """
    SELECT b.line_id, b.seg_no, b.regstat, b.x1 + t0 * (b.x2 - b.x1) AS x1, b.y1 + t0 * (b.y2 - b.y1) AS y1,
      b.x1 + t1 * (b.x2 - b.x1) AS x2, b.y1 + t1 * (b.y2 - b.y1) AS y2
    FROM (SELECT line_id, seg_no, lo AS t1, max(hi) OVER (PARTITION BY line_id, seg_no ORDER BY lo, hi
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t0 FROM cut_spans) t
    JOIN bikeways b USING (line_id, seg_no)
    WHERE (t1 - t0) * sqrt((b.x2 - b.x1) ** 2 + (b.y2 - b.y1) ** 2) >= 0.00001::DOUBLE"""


def _turn(a: str, b: str, i: int) -> str:
    """On which side of segment a lies end i of segment b."""
    return f"sign(({a}.x2 - {a}.x1) * ({b}.y{i} - {a}.y1) - ({a}.y2 - {a}.y1) * ({b}.x{i} - {a}.x1))"


PARTS["trail_edges"] = f"""
    SELECT DISTINCT a.line_id AS u, b.line_id AS v FROM trails a JOIN trails b
      ON a.status = b.status AND a.line_id <> b.line_id
      AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2)
      AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2)
      AND {_turn('a', 'b', 1)} * {_turn('a', 'b', 2)} <= 0 AND {_turn('b', 'a', 1)} * {_turn('b', 'a', 2)} <= 0"""
PARTS["trail_reach"] = """
    SELECT DISTINCT line_id, line_id AS root FROM trails
    UNION SELECT e.u, r.root FROM trail_reach r JOIN trail_edges e ON e.v = r.line_id"""
PARTS["trail_clusters"] = """
    SELECT t.status, t.line_id, min(r.root) AS cluster_id FROM (SELECT DISTINCT status, line_id FROM trails) t
    JOIN trail_reach r ON r.line_id = t.line_id GROUP BY ALL"""

# --- roster -------------------------------------------------------------------------------------------
PARTS["gone"] = "SELECT x, y FROM removals WHERE ptstat <> 0 UNION ALL SELECT x, y FROM edits WHERE newpointty = 'Remove'"
PARTS["fresh_edits"] = (
    "SELECT x, y, newpointty AS point_type FROM edits WHERE assigned_county IS NULL AND newpointty <> 'Remove'"
)
PARTS["added"] = f"""
    SELECT x, y, min(point_type) AS point_type FROM (
      SELECT x, y, '{ADDITION}' AS point_type FROM study_additions UNION ALL SELECT * FROM fresh_edits
    ) s WHERE NOT {exists_point('gone', '2::DOUBLE')} GROUP BY x, y"""
PARTS["kept_base"] = f"""
    SELECT x, y, min(point_type) AS point_type FROM sites s
    WHERE NOT {exists_point('gone', '2::DOUBLE')} AND NOT {exists_point('existing', R_CRASH)} GROUP BY x, y"""
PARTS["unique_points"] = f"""
    SELECT x, y, coalesce(min(point_type), '{ADDITION}') AS point_type FROM (
      SELECT * FROM kept_base UNION ALL SELECT * FROM added UNION ALL SELECT * FROM fresh_edits) GROUP BY x, y"""
PARTS["roster"] = f"""
    SELECT x, y, min(point_type) AS point_type FROM (
      SELECT x, y, point_type FROM unique_points s
      WHERE NOT {exists_point('gone', '2::DOUBLE')} AND NOT {exists_point('late_removals', '2::DOUBLE')}
        AND NOT EXISTS (SELECT 1 FROM removal_areas a WHERE {square_d2('s', 'a')} <= 0)
      UNION ALL SELECT x, y, '{LATE}' FROM late_additions) GROUP BY x, y"""
PARTS["roster_sites"] = "SELECT row_number() OVER (ORDER BY x, y) AS site_id, x, y FROM roster"


# --- labels -------------------------------------------------------------------------------------------
def nearest_seg(layer: str, cols: str, sites: str, where: str = "TRUE") -> str:
    best = f"arg_min({cols}, row({seg_d2('s.x', 's.y', 'g')}, g.line_id))"
    return f"SELECT s.site_id, {best} AS v FROM {sites} s, {layer} g WHERE {where} GROUP BY s.site_id"


def labelled(sites: str) -> dict[str, str]:
    d2 = seg_d2("s.x", "s.y", "g")
    key = f"row({d2}, g.line_id)"
    cross = "concat_ws('/', g.f_xstreet, g.t_xstreet)"
    return {
        "l_type": nearest_seg("barriers", "g.source", sites),
        "l_rail": nearest_seg("barriers", "g.name", sites, "g.source = 'Railroads' AND g.name IS NOT NULL"),
        "l_named": f"""SELECT s.site_id,
            arg_min(g.name, {key}) FILTER (g.source = 'Streams' AND g.name IS NOT NULL) AS stream,
            min(row({d2}, g.line_id, g.name, CASE WHEN g.f_xstreet IS NOT NULL OR g.t_xstreet IS NOT NULL THEN {cross} END))
              FILTER (g.source = 'Expressways') AS expy
            FROM {segs_near('barriers', R_MI, sites)} GROUP BY s.site_id""",
        "l_road": f"""SELECT s.site_id, arg_min(g.streetall, {key}) AS road, min({d2}) AS d2
            FROM {segs_near('trails', R_MI, sites)} GROUP BY s.site_id""",
        "l_river": f"""SELECT DISTINCT s.site_id, 1 AS major_river FROM {segs_near('barriers', '100::DOUBLE', sites,
            "g.source = 'Streams' AND g.name IN ('Mississippi River', 'Minnesota River', 'St. Croix River')")}""",
        "l_desc": f"""SELECT s.site_id, t.v AS barrier_type,
            CASE t.v
              WHEN 'Streams' THEN concat(coalesce(n.stream, 'Unnamed Stream'), ' near ', r.road)
              WHEN 'Railroads' THEN concat(coalesce(w.v, 'RR'), ' near ', CASE WHEN r.d2 <= 640000 THEN r.road END)
              WHEN 'Expressways' THEN concat(n.expy[3], ' near ',
                coalesce(n.expy[4], CASE WHEN r.d2 <= 640000 THEN r.road END)) END AS barrier_desc
            FROM {sites} s LEFT JOIN l_type t USING (site_id) LEFT JOIN l_rail w USING (site_id)
            LEFT JOIN l_named n USING (site_id) LEFT JOIN l_road r USING (site_id)""",
        "l_county": region("counties", "cty_name", "county", R_MI, sites),
        "l_city": region("cities", "name", "city", R_MI, sites),
        "l_designation": region("counties", "designation", "community_designation", "0::DOUBLE", sites),
        "l_own": f"""SELECT s.site_id, arg_min(p.point_type, row({pt_d2('s', 'p')}, p.site_id)) AS point_type
            FROM {sites} s JOIN base_sites p ON {near_square('s', 'p', '0.5::DOUBLE')}
            AND {pt_d2('s', 'p')} <= 0.25::DOUBLE GROUP BY s.site_id""",
        "labelled": f"""SELECT s.site_id, s.x, s.y, o.point_type, county, city, community_designation, major_river,
            barrier_type, barrier_desc,
            concat(barrier_type, '   ', barrier_desc, '  -  ', city, ' , ', county, ' County') AS location_desc
            FROM {sites} s LEFT JOIN l_own o USING (site_id) JOIN l_county USING (site_id) JOIN l_city USING (site_id)
            JOIN l_designation USING (site_id) LEFT JOIN l_river USING (site_id) JOIN l_desc USING (site_id)
            WHERE county IS NULL OR county NOT IN ('Chisago', 'Wright')""",
    }


PARTS["base_sites"] = "SELECT * FROM sites"

# --- scoring ------------------------------------------------------------------------------------------
ZERO = [
    ("bkpd_crash_500ft", "scld__bkpd_crash_500ft"), ("rail_volume", "scld__rail_volume"),
    ("avg_slope", "scld__avg_slope"), ("wiki_probarea_qtr", "scld__wiki_probarea_qtr"),
    ("trans_riders_qtr", "scld_trans_riders_qtr"), ("schools_half", "scld__schools_half"),
    ("colleges_half", "scld__colleges_half"), ("reg_parks_half", "scld__regional_parks_half_mile"),
    ("wiki_new_xing_qtr", "scld__wiki_new_xing_qtr"), ("ex_local_miles_qtr", "scld__ex_local_miles_qtr"),
    ("pl_local_miles_qtr", "scld__pl_local_miles_qtr"), ("ex_reg_fac_half", "scld__ex_reg_fac_half"),
    ("pl_reg_fac_half", "scld__pl_reg_fac_half"), ("expl_reg_miles_half", "scld_expl_reg_miles_half"),
    ("wiki_women_qtr", "scld__wiki_women_qtr"), ("wiki_pplofcolor_qtr", "scld__wiki_pplofcolor_qtr"),
]
NULLED = [
    ("bw_modeshr", "scld__bw_modeshr"), ("popden_2014", "scld__popden_2014"), ("popden_2040", "scld__popden_2040"),
    ("empden_2014", "scld__empden_2014"), ("empden_2040", "scld__empden_2040"),
    ("dist2ex_crossing_m", "scld__dist2ex_crossing_m"), ("age_under_15_pct", "scld__age_under_15_pct"),
    ("age_65_plus_pct", "scld__age_65_plus_pct"), ("zero_car_pct", "scld__zero_car_pct"),
    ("ppl_of_color_pct", "scld__ppl_of_color_pct"),
]


def zero_scaled(c: str, top: str) -> str:
    return f"CASE WHEN {c} = 0 THEN 0.0::DOUBLE ELSE {c}::DOUBLE * (10.0::DOUBLE / nullif({top}, 0)) END"


def null_scaled(c: str, top: str) -> str:
    return f"({c}::DOUBLE * (10.0::DOUBLE / nullif({top}, 0)))"


def scored(source: str) -> str:
    """Scaled columns, factors, priority and ranks of a feature table."""
    scaled = ", ".join(
        [f"{zero_scaled(c, f'max({c}) OVER ()')} AS {o}" for c, o in ZERO]
        + [f"{null_scaled(c, f'max({c}) OVER ()')} AS {o}" for c, o in NULLED]
        + ["rbtn_corridor::DOUBLE AS scld_rbtn_corridor", "rbtn_alignment::DOUBLE AS scld_rbtn_alignment"]
    )
    return f"""
      SELECT *, CASE WHEN county IN ({RANKED}) THEN rank() OVER (PARTITION BY county ORDER BY priority_score DESC NULLS FIRST)
        END AS county_priority_rank
      FROM (SELECT *, rank() OVER (ORDER BY priority_score DESC NULLS FIRST) AS priority_rank
      FROM (SELECT *, priority_raw * (100.0::DOUBLE / nullif(max(priority_raw) OVER (), 0)) AS priority_score
      FROM (SELECT *, connectivity_score + demand_score + safety_score + equity_score AS priority_raw
      FROM (SELECT *, connectivity_raw * 4.825::DOUBLE AS connectivity_score, demand_raw * 2.425::DOUBLE AS demand_score,
        safety_raw * 1.525::DOUBLE AS safety_score, equity_raw * 1.225::DOUBLE AS equity_score
      FROM (SELECT *,
        (scld__pl_local_miles_qtr + scld__ex_local_miles_qtr + scld_expl_reg_miles_half + scld_rbtn_corridor
          + scld_rbtn_alignment + coalesce(scld__dist2ex_crossing_m, 0)) / 6 AS connectivity_raw,
        (scld__popden_2040 + scld__empden_2040 + scld_trans_riders_qtr + scld__schools_half + scld__colleges_half
          + scld__regional_parks_half_mile + scld__wiki_new_xing_qtr) / 7 AS demand_raw,
        (scld__bkpd_crash_500ft + scld__bw_modeshr + scld__popden_2014 + scld__empden_2014
          + scld__wiki_probarea_qtr) / 5 AS safety_raw,
        (acp + acp50 + scld__age_under_15_pct + scld__age_65_plus_pct + scld__zero_car_pct + scld__ppl_of_color_pct
          + scld__wiki_women_qtr + scld__wiki_pplofcolor_qtr) / 8 AS equity_raw
      FROM (SELECT *, {scaled} FROM {source}))))))"""


COUNTED = [
    "bkpd_crash_500ft", "wiki_probarea_qtr", "wiki_new_xing_qtr", "wiki_women_qtr", "wiki_pplofcolor_qtr",
    "schools_half", "colleges_half", "reg_parks_half", "ex_reg_fac_half", "pl_reg_fac_half",
]
FLAGS = ["acp", "acp50", "rbtn_corridor", "rbtn_alignment", "rail_volume"]
MEASURED = ["trans_riders_qtr", "ex_local_miles_qtr", "pl_local_miles_qtr", "expl_reg_miles_half"]
AVERAGED = [
    "avg_slope", "popden_2014", "popden_2040", "empden_2014", "empden_2040", "bw_modeshr", "age_65_plus_pct",
    "age_under_15_pct", "zero_car_pct", "ppl_of_color_pct",
]


def feature_columns(names: list[str]) -> str:
    out = []
    for n in names:
        if n in COUNTED:
            out.append(f"coalesce({n}, 0)::BIGINT AS {n}")
        elif n in FLAGS:
            out.append(f"coalesce({n}, 0)::INT AS {n}")
        elif n in MEASURED:
            out.append(f"coalesce({n}, 0.0::DOUBLE) AS {n}")
        else:
            out.append(f"{n}::DOUBLE AS {n}")
    return ", ".join(out)


STUDY = labelled("roster_sites") | {
    k.replace("f_", "g_"): v for k, v in counts("labelled").items() if k != "f_crossing"
}
STUDY["g_crossing"] = counts("labelled")["f_crossing"] % "crossings"
STUDY["features"] = f"""
    SELECT b.*, {feature_columns(COUNTED + FLAGS + MEASURED + AVERAGED)},
      best[2] AS nearest_crossing_id, sqrt(best[1]) AS dist2ex_crossing_m
    FROM labelled b {" ".join(
        f"LEFT JOIN {g} USING (site_id)" for g in STUDY if g.startswith("g_")
    )}"""
STUDY["all_scored"] = scored("features")
STUDY["away"] = "SELECT * FROM features WHERE major_river IS NULL"
STUDY["away_scored"] = scored("away")

# Four features over the plain site table, for the scoring and ranking operators.
FEW = {
    "few": f"""
      SELECT s.site_id, s.x, s.y, county, crashes, problems, CASE WHEN crashes > 0 THEN riders END AS riders, flag
      FROM sites s JOIN (
        {for_all(f"SELECT s.site_id, count(*) AS n FROM {points_near('crashes', R_CRASH)} GROUP BY ALL", 'coalesce(n, 0) AS crashes')}
      ) a USING (site_id) JOIN (
        {for_all(f"SELECT s.site_id, count(*) AS n FROM {points_near('comments', R_QTR, where=chr(10).join(["p.kml_name = 'improvement needed'"]))} GROUP BY ALL", 'coalesce(n, 0) AS problems')}
      ) b USING (site_id) JOIN (
        {for_all(f"SELECT s.site_id, sum(on_off)::BIGINT AS n FROM {points_near('stops', R_HALF)} GROUP BY ALL", 'coalesce(n, 0) AS riders')}
      ) c USING (site_id) JOIN (
        {for_all(f"SELECT DISTINCT s.site_id, 10 AS n FROM {segs_near('alignments', R_QTR)}", 'coalesce(n, 0) AS flag')}
      ) e USING (site_id) JOIN ({region('counties', 'cty_name', 'county', '0::DOUBLE')}) f USING (site_id)""",
    "few_scaled": f"""SELECT *, {zero_scaled('crashes', 'max(crashes) OVER ()')} AS s_crashes,
        {null_scaled('problems', 'max(problems) OVER ()')} AS s_problems,
        {zero_scaled('riders', 'max(riders) OVER ()')} AS s_riders, flag::DOUBLE AS s_flag FROM few""",
    "few_factors": """SELECT *, (s_crashes + s_problems) / 2 AS safety_raw, (s_crashes + s_problems) / 2 * 6.5::DOUBLE AS safety_score,
        (s_riders + s_flag) / 2 AS demand_raw, (s_riders + s_flag) / 2 * 3.5::DOUBLE AS demand_score FROM few_scaled""",
    "few_scored": """SELECT site_id, x, y, county, priority_raw,
        priority_raw * (100.0::DOUBLE / nullif(max(priority_raw) OVER (), 0)) AS priority_score
        FROM (SELECT *, safety_score + demand_score AS priority_raw FROM few_factors)""",
    "rankable": "SELECT site_id, x, y, county, round(priority_score, 6) AS priority_score FROM few_scored",
}

ORACLE: dict[str, str] = {}


def twin(name: str, sql: str, parts: dict[str, str] | None = None) -> None:
    ORACLE[name] = with_layers(sql, PARTS | (parts or {}))


def r6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


F = counts("sites")
B = labelled("sites")

twin("line_segments", "SELECT line_id, seg_no, x1, y1, x2, y2 FROM trails")
twin("multipoint_rows", "SELECT id, x, y FROM existing")
twin("raster_layer", "SELECT x, y, value FROM cells")
twin("site_sink", f"SELECT site_id, x, y, point_type, county FROM sites JOIN (\
{region('counties', 'cty_name', 'county', '0::DOUBLE')}) USING (site_id)")
twin("count_within", for_all(F["f_crash"], "coalesce(bkpd_crash_500ft, 0) AS n"))
twin("count_within_filtered", for_all(F["f_comments"], "coalesce(wiki_probarea_qtr, 0) AS problems,"
     " coalesce(wiki_new_xing_qtr, 0) AS suggested, coalesce(wiki_women_qtr, 0) AS women,"
     " coalesce(wiki_pplofcolor_qtr, 0) AS pplofcolor"))
twin("schools_within", for_all(F["f_schools"], "coalesce(schools_half, 0) AS schools_half,"
     " coalesce(colleges_half, 0) AS colleges_half"))
twin("sum_within", for_all(F["f_stops"], "coalesce(trans_riders_qtr, 0)::BIGINT AS riders"))
twin("point_pairs_within", f"SELECT s.site_id, p.id, round(sqrt({pt_d2('s', 'p')}), 6) AS dist FROM {points_near('parks', R_HALF)}")
twin("lines_within", f"SELECT s.site_id, g.line_id, round(sqrt(min({seg_d2('s.x', 's.y', 'g')})), 6) AS dist"
     f" FROM {segs_near('trails', R_QTR)} GROUP BY ALL")
twin("points_in_areas", f"SELECT s.site_id, a.id FROM {triangles_near('areas', '0::DOUBLE')}")
twin("areas_within", for_all(f"SELECT s.site_id, count(*) AS n FROM {triangles_near('areas', R_HALF)} GROUP BY ALL",
     "coalesce(n, 0) AS n"))
AREA_COLS = [c for c in AVERAGED if c != "avg_slope"]
twin("avg_areas_within", for_all(F["f_taz"], r6(*AREA_COLS)))
twin("town_stops_within", for_all(f"SELECT s.site_id, count(*) AS n, sum(p.id)::BIGINT AS ids FROM {points_near('town_stops', R_HALF)} GROUP BY s.site_id",
     "coalesce(n, 0) AS n, coalesce(ids, 0) AS ids"))
ZONES = {n: zones_by_edge(r) for n, r in (("zones_here", "0::DOUBLE"), ("zones_half", R_HALF), ("zones_mile", R_MI))}
twin("points_in_zones", "SELECT site_id, id FROM zones_here", ZONES)
twin("avg_zones_within", for_all("SELECT site_id, avg(value) AS v, count(*) AS n FROM zones_half GROUP BY site_id", "round(v, 6) AS value, coalesce(n, 0) AS n"), ZONES)
twin("flag_in_zones", for_all("SELECT DISTINCT site_id, 10 AS n FROM zones_here", "coalesce(n, 0)::INT AS in_zone"), ZONES)
twin("assign_zone", for_all("SELECT site_id, arg_min(name, row(d2, id)) AS v FROM zones_mile GROUP BY site_id", "f.v AS zone"), ZONES)
twin("exclude_within", f"SELECT * FROM sites s WHERE NOT {exists_point('removals', '2::DOUBLE')}")
twin("exclude_existing", f"SELECT * FROM sites s WHERE NOT {exists_point('existing', R_CRASH)}")
twin("keep_within", f"SELECT * FROM sites s WHERE EXISTS (SELECT 1 FROM removal_areas a WHERE {square_d2('s', 'a')} <= 0)")
twin("flag_within", for_all(f"SELECT DISTINCT s.site_id, 10 AS n FROM {segs_near('alignments', R_QTR)}",
     "coalesce(n, 0)::INT AS rbtn_alignment"))
twin("flag_in_areas", for_all(F["f_acp50"], "coalesce(acp50, 0)::INT AS acp50"))
twin("major_river_flag", for_all(B["l_river"], "major_river"))
TALLIED = [c for c in COUNTED if not c.endswith("fac_half")] + FLAGS[:4] + ["trans_riders_qtr"] + AVERAGED
TALLY_FROM = ["f_crash", "f_comments", "f_schools", "f_parks", "f_stops", "f_cells", "f_taz", "f_acp", "f_acp50", "f_corridor", "f_alignment"]
twin("tallied_features",
     "SELECT site_id, " + ", ".join(
         f"round({c}, 6) AS {c}" if c in AVERAGED + MEASURED else c for c in TALLIED)
     + f" FROM (SELECT s.site_id, {feature_columns(TALLIED)} FROM sites s "
     + " ".join(f"LEFT JOIN {f} USING (site_id)" for f in TALLY_FROM) + ")", F)
twin("lookup_nearest", for_all(F["f_rail"], "coalesce(rail_volume, 0)::INT AS rail_volume"))
twin("assign_county", region("counties", "cty_name", "county", R_MI))
twin("assign_city", region("cities", "name", "city", R_MI))
twin("nearest_line_within", for_all(
    f"SELECT s.site_id, min(row({seg_d2('s.x', 's.y', 'g')}, g.line_id, g.streetall)) AS v"
    f" FROM {segs_near('trails', '800::DOUBLE')} GROUP BY ALL",
    "v[2] AS line_id, v[3] AS road, round(sqrt(v[1]), 6) AS dist"))
twin("nearest_crossing", for_all(F["f_crossing"] % "crossings",
     "best[2] AS nearest_crossing_id, round(sqrt(best[1]), 6) AS dist2ex_crossing_m"))
twin("nearest_barrier", for_all(
    f"SELECT s.site_id, min(row({seg_d2('s.x', 's.y', 'g')}, g.line_id, g.source)) AS v FROM sites s, barriers g GROUP BY ALL",
    "v[2] AS line_id, v[3] AS barrier_type, round(sqrt(v[1]), 6) AS dist"))
twin("nearest_stop", for_all(F["f_crossing"] % "stops", "best[2] AS id, round(sqrt(best[1]), 6) AS dist"))
twin("nearest_town_stop", for_all(F["f_crossing"] % "town_stops", "best[2] AS id, round(sqrt(best[1]), 6) AS dist"))
twin("describe_site", "SELECT * FROM l_desc", B)
twin("label_sites_plan", "SELECT * FROM labelled", B)

twin("dedupe_points", """SELECT x, y, min(point_type) AS point_type FROM (
    SELECT x, y, point_type FROM sites UNION ALL SELECT x, y, newpointty FROM edits) GROUP BY x, y""")
twin("conflicting_duplicates", """SELECT * FROM removals r WHERE ptstat <> 0 OR NOT EXISTS (
    SELECT 1 FROM removals o WHERE o.x = r.x AND o.y = r.y AND o.ptstat <> 0)""")
twin("snapshot_diff", f"""
    SELECT site_id, x, y, 'removed' AS change FROM sites s WHERE NOT {exists_point('confirmed', '2::DOUBLE')}
    UNION ALL SELECT id, x, y, 'added' FROM confirmed s WHERE NOT {exists_point('sites', '2::DOUBLE')}""")
twin("recode_within", f"""SELECT id AS site_id, x, y, CASE WHEN ptstat = 0 AND NOT {exists_point('sites', '2::DOUBLE')}
    THEN 2 ELSE ptstat END AS ptstat FROM removals s""")
twin("recode_near", f"""SELECT id AS site_id, x, y, CASE WHEN ptstat = 0 AND {exists_point('sites', '2::DOUBLE')}
    THEN 2 ELSE ptstat END AS ptstat FROM removals s""")
twin("provenance", f"""SELECT site_id, CASE WHEN {exists_point('late_additions', '0.01::DOUBLE')} THEN 'new adds'
    WHEN {exists_point('confirmed', '2::DOUBLE')} THEN 'confirmed v2' END AS source_check FROM sites s""")
twin("point_type", f"""SELECT s0.site_id, coalesce(b.t, e.t, '{ADDITION}') AS point_type FROM sites s0
    LEFT JOIN (SELECT s.site_id, arg_min(b.point_type, row({pt_d2('s', 'p')}, p.id)) AS t
      FROM {points_near('typed_points', '0.5::DOUBLE')} JOIN sites b ON b.site_id = p.id
      GROUP BY s.site_id) b USING (site_id)
    LEFT JOIN (SELECT s.site_id, arg_min(p.newpointty, row({pt_d2('s', 'p')}, p.id)) AS t
      FROM {points_near('edits', '2::DOUBLE')} GROUP BY s.site_id) e USING (site_id)""")
twin("extended_crossing_layer", f"""SELECT x, y, NULL::VARCHAR AS source FROM crossings UNION ALL
    SELECT DISTINCT x, y, '{ADDITION}' FROM existing s WHERE NOT {exists_point('crossings', R_CRASH)}""")
twin("additions", "SELECT * FROM added")
twin("missed_removal_list", f"""SELECT x, y, min(point_type) AS point_type FROM sites s
    WHERE EXISTS (SELECT 1 FROM removal_areas a WHERE {square_d2('s', 'a')} <= 0) GROUP BY x, y""")
twin("study_roster", "SELECT x, y, point_type FROM roster")

twin("clip_pieces", f"SELECT site_id, line_id, seg_no, round(len_m, 6) AS len_m FROM ({clipped('trails', R_HALF)})")
twin("sum_pieces", for_all(f"""SELECT site_id, sum(len_m) FILTER (regstat = 1) / 1609.34::DOUBLE AS existing,
    sum(len_m) FILTER (regstat IN (2, 3)) / 1609.34::DOUBLE AS planned
    FROM ({clipped('bikeways', R_QTR, extra='g.regstat')}) GROUP BY site_id""",
    "round(coalesce(existing, 0), 6) AS existing, round(coalesce(planned, 0), 6) AS planned"))
twin("clip_miles", for_all(F["f_regional"], "round(coalesce(expl_reg_miles_half, 0), 6) AS expl_reg_miles_half"))
twin("erase_corridors", """SELECT line_id, regstat, round(coalesce(len_m, 0), 6) AS len_m
    FROM (SELECT DISTINCT line_id, regstat FROM bikeways) LEFT JOIN (
      SELECT line_id, regstat, sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) AS len_m FROM local_kept GROUP BY ALL)
    USING (line_id, regstat)""")
STREETS = {"street_spans": """
    SELECT regstat, east, across, lo, hi, max(hi) OVER (PARTITION BY regstat, east, across ORDER BY lo, hi
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
    FROM (SELECT regstat, east, CASE WHEN east THEN y1 ELSE x1 END AS across, CASE WHEN east THEN x1 ELSE y1 END AS lo,
      CASE WHEN east THEN x2 ELSE y2 END AS hi FROM streets)""",
    "street_once": """
    SELECT 0 AS line_id, regstat, CASE WHEN east THEN lo ELSE across END AS x1, CASE WHEN east THEN across ELSE lo END AS y1,
      CASE WHEN east THEN hi ELSE across END AS x2, CASE WHEN east THEN across ELSE hi END AS y2
    FROM (SELECT regstat, east, across, greatest(lo, coalesce(prev, lo)) AS lo, hi FROM street_spans) WHERE hi > lo"""}
twin("dissolved_length", """SELECT regstat, round(sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)), 3) AS len_m
    FROM street_once GROUP BY regstat""", STREETS)
twin("dissolved_diagonals", """SELECT regstat, sum(5 * (hi - greatest(lo, coalesce(prev, lo))))::DOUBLE AS len_m FROM (
    SELECT regstat, lo, hi, max(hi) OVER (PARTITION BY regstat, street ORDER BY lo, hi
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM diagonals)
    WHERE hi > coalesce(prev, lo) GROUP BY regstat""")
twin("dissolved_miles", for_all("SELECT site_id, " + ", ".join(
    f"sum(len_m) FILTER (regstat = '{s}') / 1609.344::DOUBLE AS {s.lower()}" for s in "FOP")
    + f" FROM ({clipped('street_once', R_QTR, extra='g.regstat')}) GROUP BY site_id",
    ", ".join(f"round(coalesce({s}, 0), 6) AS miles_{s}" for s in "fop")), STREETS)
twin("line_miles_plan", "SELECT s.site_id, " + ", ".join(
    f"round(coalesce({c}, 0), 6) AS {c}" for c in MEASURED[1:])
    + " FROM sites s LEFT JOIN f_local USING (site_id) LEFT JOIN f_regional USING (site_id)", F)
twin("line_clusters", "SELECT status, line_id, cluster_id FROM trail_clusters")
twin("clusters_within", for_all(F["f_clusters"], "coalesce(ex_reg_fac_half, 0) AS ex_reg_fac_half,"
     " coalesce(pl_reg_fac_half, 0) AS pl_reg_fac_half"))

twin("column_maxima", "SELECT max(crashes) AS crashes, max(problems) AS problems, max(riders) AS riders FROM few", FEW)
twin("scale_zero_filled", f"SELECT site_id, {r6('s_crashes')} FROM few_scaled", FEW)
twin("scale_null", f"SELECT site_id, round({null_scaled('riders', 'max(riders) OVER ()')}, 6) AS s_riders,"
     " NULL::DOUBLE AS s_nothing FROM few", FEW)
twin("factor_scores", f"SELECT site_id, {r6('safety_raw', 'safety_score', 'demand_raw', 'demand_score')} FROM few_factors", FEW)
twin("priority_score", f"SELECT site_id, {r6('priority_raw', 'priority_score')} FROM few_scored", FEW)
twin("regional_rank", "SELECT *, rank() OVER (ORDER BY priority_score DESC NULLS FIRST) AS priority_rank FROM rankable", FEW)
COUNTY_RANK = f"""SELECT site_id, county, CASE WHEN county IN ({RANKED}) THEN
    rank() OVER (PARTITION BY county ORDER BY priority_score DESC NULLS FIRST) END AS county_priority_rank FROM rankable"""
twin("county_rank", COUNTY_RANK, FEW)
twin("rank_against", f"""SELECT r.* FROM (SELECT site_id, county,
    rank() OVER (PARTITION BY county ORDER BY priority_score DESC NULLS FIRST) AS county_priority_rank FROM rankable) r
    WHERE site_id NOT IN (SELECT site_id FROM ({B['l_river']}))""", FEW)
GEO = f"""SELECT site_id, county, rank() OVER (PARTITION BY county ORDER BY y DESC, x ASC) AS geographic_rank
    FROM sites JOIN ({region('counties', 'cty_name', 'county', R_MI)}) USING (site_id)"""
ID = "left(county, 1) || lpad({r}::VARCHAR, greatest(length({r}::VARCHAR), 3)::INT, '0')"
twin("geographic_rank", GEO)
twin("county_id", f"""SELECT site_id, county, CASE WHEN county IN ({RANKED}) THEN {ID.format(r='geographic_rank')} END
    AS county_id FROM ({GEO})""")
twin("quartile_score", f"""SELECT site_id, riders, CASE WHEN riders = 0 THEN 0.0::DOUBLE WHEN riders < q1 THEN 2.5::DOUBLE
    WHEN riders < q2 THEN 5.0::DOUBLE WHEN riders < q3 THEN 7.5::DOUBLE ELSE 10.0::DOUBLE END AS scld_riders
    FROM riding, (SELECT quantile_cont(riders, 0.25) AS q1, quantile_cont(riders, 0.5) AS q2,
      quantile_cont(riders, 0.75) AS q3 FROM riding WHERE riders > 0)""",
     {"riding": for_all(F["f_stops"], "coalesce(trans_riders_qtr, 0)::BIGINT AS riders")})
twin("zonal_mean", for_all(F["f_cells"], r6("avg_slope")))
twin("tier_score", for_all(
    f"SELECT s.site_id, min(g.tier)::INT AS tier FROM {segs_near('trails', R_QTR)} GROUP BY s.site_id",
    "tier, CASE tier WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END AS scld_rbtn_corridor"))

LABELS = "county, city, community_designation, major_river, barrier_type, barrier_desc, location_desc"
RAW = ", ".join(
    ["x", "y", LABELS, *COUNTED, *FLAGS, "nearest_crossing_id", r6(*MEASURED, *AVERAGED, "dist2ex_crossing_m")]
)
SCORES = r6(
    *[o for _, o in ZERO + NULLED], "scld_rbtn_corridor", "scld_rbtn_alignment",
    *[f"{f}_{k}" for f in ("connectivity", "demand", "safety", "equity") for k in ("raw", "score")],
    "priority_raw", "priority_score",
)
twin("study_features", f"SELECT {RAW}, point_type FROM features", STUDY)
twin("prioritized_sites", f"SELECT {RAW}, point_type, {SCORES}, priority_rank, county_priority_rank FROM all_scored", STUDY)
SUBSET = f"""SELECT {RAW}, {SCORES}, priority_rank, county_priority_rank,
    CASE WHEN county IN ({RANKED}) THEN {ID.format(r='geo')} END AS county_id,
    coalesce(point_type, (SELECT arg_min(p.newpointty, row({pt_d2('s', 'p')}, p.id)) FROM edits p
      WHERE {near_square('s', 'p', '2::DOUBLE')} AND {pt_d2('s', 'p')} <= 4), '{ADDITION}') AS point_type,
    CASE WHEN {exists_point('late_additions', '0.01::DOUBLE')} THEN 'new adds'
      WHEN {exists_point('confirmed', '2::DOUBLE')} THEN 'confirmed v2' END AS source_check
    FROM (SELECT *, rank() OVER (PARTITION BY county ORDER BY y DESC, x ASC) AS geo FROM away_scored) s"""
twin("prioritized_subset", SUBSET, STUDY)
twin("subset_ranked_against", f"""SELECT p.* REPLACE (CASE WHEN p.county = 'Dakota' THEN a.theirs ELSE p.county_priority_rank END
    AS county_priority_rank) FROM ({SUBSET}) p
    LEFT JOIN (SELECT x AS ax, y AS ay, county_priority_rank AS theirs FROM all_scored) a ON p.x = ax AND p.y = ay""", STUDY)
