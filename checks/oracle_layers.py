"""The layers of `layers.py` in SQL, and a helper that puts the ones a statement names in front of it."""

from __future__ import annotations

import re

from checks.layers import COUNTY_NAMES


def spot(key: str, factor: int) -> str:
    return f"(CAST({key} AS BIGINT) * {factor} % 20000)::DOUBLE"


def xy(key: str, a: int, b: int, dx: str = "0") -> str:
    return f"{spot(key, a)} + {dx} AS x, {spot(key, b)} AS y"


def zigzag(table: str, key: str, a: int, b: int, attrs: str = "") -> str:
    across = "(k * k + j * j * 37 + k * j * 11) % 301 - 150"
    comma = ", " + attrs if attrs else ""
    names = ", " + ", ".join(p.split(" AS ")[-1] for p in re.split(r",(?![^(]*\))", attrs)) if attrs else ""
    return f"""
        SELECT line_id, j AS seg_no, x AS x1, y AS y1, x2, y2{names} FROM (
          SELECT *, lead(x) OVER (PARTITION BY line_id ORDER BY j) AS x2,
                 lead(y) OVER (PARTITION BY line_id ORDER BY j) AS y2
          FROM (
            SELECT k AS line_id, j{comma},
              ((k * k * {a}) % 20000 + CASE WHEN k % 2 = 0 THEN j * 200 ELSE {across} END)::DOUBLE AS x,
              ((k * k * {b} + k * 77) % 20000 + CASE WHEN k % 2 = 0 THEN {across} ELSE j * 200 END)::DOUBLE AS y
            FROM (SELECT *, CAST({key} AS BIGINT) AS k FROM {table}) b, (SELECT unnest([0, 1, 2, 3])::BIGINT AS j) v
          )
        ) WHERE x2 IS NOT NULL"""


def seg_d2(x: str, y: str, s: str) -> str:
    """Squared distance from (x, y) to the segment row s."""
    dx, dy = f"({s}.x2 - {s}.x1)", f"({s}.y2 - {s}.y1)"
    u = (
        f"least(greatest((({x} - {s}.x1) * {dx} + ({y} - {s}.y1) * {dy})"
        f" / nullif({dx} * {dx} + {dy} * {dy}, 0), 0), 1)"
    )
    return f"(({x} - ({s}.x1 + {u} * {dx})) ** 2 + ({y} - ({s}.y1 + {u} * {dy})) ** 2)"


def pt_d2(a: str, b: str) -> str:
    return f"(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"


def square_d2(p: str, a: str) -> str:
    """Squared distance from p to the square a (x0, y0, side)."""
    dx = f"greatest({a}.x0 - {p}.x, {p}.x - ({a}.x0 + {a}.side), 0)"
    dy = f"greatest({a}.y0 - {p}.y, {p}.y - ({a}.y0 + {a}.side), 0)"
    return f"({dx} * {dx} + {dy} * {dy})"


def triangle_d2(p: str, a: str) -> str:
    """Squared distance from p to the right triangle a (ax, ay, w)."""
    h, v = f"({p}.x - {a}.ax)", f"({p}.y - {a}.ay)"
    bottom = f"(({h} - least(greatest({h}, 0), {a}.w)) ** 2 + {v} ** 2)"
    side = f"({h} ** 2 + ({v} - least(greatest({v}, 0), {a}.w)) ** 2)"
    t = f"least(greatest(({h} - {v} + {a}.w) / 2, 0), {a}.w)"
    slope = f"(({h} - {t}) ** 2 + ({v} - ({a}.w - {t})) ** 2)"
    return (
        f"(CASE WHEN {h} >= 0 AND {v} >= 0 AND {h} + {v} <= {a}.w THEN 0.0"
        f" ELSE least({bottom}, {side}, {slope}) END)"
    )


def zones_by_edge(r: str, sites: str = "sites") -> str:
    """(site_id, id, name, value, d2): every zone within r of every site; d2 is 0 inside and at the rim to it."""
    return f"""SELECT site_id, id, name, value, CASE WHEN bool_or(d2 = 0) OR sum(crossed::INT) % 2 = 1 THEN 0 ELSE min(d2) END AS d2 FROM (
          SELECT *, CASE WHEN dot <= 0 THEN d1 WHEN dot >= long THEN dd ELSE turn * turn / long END AS d2,
                 CASE WHEN dot <= 0 THEN d1 <= {r} * {r} WHEN dot >= long THEN dd <= {r} * {r} ELSE turn * turn <= {r} * {r} * long END AS near,
                 ((y1 > y) <> (y2 > y)) AND ((turn < 0) = (y2 > y1)) AS crossed FROM (
            SELECT s.site_id, e.id, e.name, e.value, s.x, s.y, e.x1, e.y1, e.x2, e.y2,
                   (s.x - e.x1) * (e.x2 - e.x1) + (s.y - e.y1) * (e.y2 - e.y1) AS dot,
                   (e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1) AS long,
                   (s.x - e.x1) * (e.y2 - e.y1) - (s.y - e.y1) * (e.x2 - e.x1) AS turn,
                   (s.x - e.x1) * (s.x - e.x1) + (s.y - e.y1) * (s.y - e.y1) AS d1,
                   (s.x - e.x2) * (s.x - e.x2) + (s.y - e.y2) * (s.y - e.y2) AS dd
            FROM {sites} s, zone_edges e
            WHERE s.x BETWEEN e.x0 - {r} AND e.x0 + 1500 + {r} AND s.y BETWEEN e.y0 - {r} AND e.y0 + 1500 + {r}))
        GROUP BY ALL HAVING bool_or(near) OR sum(crossed::INT) % 2 = 1"""


def near_box(p: str, s: str, r: float) -> str:
    """Cheap box test in front of an exact distance."""
    return (
        f"{p}.x BETWEEN least({s}.x1, {s}.x2) - {r} AND greatest({s}.x1, {s}.x2) + {r}"
        f" AND {p}.y BETWEEN least({s}.y1, {s}.y2) - {r} AND greatest({s}.y1, {s}.y2) + {r}"
    )


def near_square(p: str, q: str, r: float) -> str:
    return f"{p}.x BETWEEN {q}.x - {r} AND {q}.x + {r} AND {p}.y BETWEEN {q}.y - {r} AND {q}.y + {r}"


_county = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(COUNTY_NAMES))

LAYERS = {
    "sites": f"SELECT c_custkey AS site_id, {xy('c_custkey', 7919, 104729)}, c_mktsegment AS point_type FROM customer",
    "removals": f"""SELECT o_orderkey AS id, {xy('o_custkey', 7919, 104729, '(o_orderkey * 13) % 211')},
        CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS ptstat FROM orders""",
    "edits": f"""SELECT p_partkey AS id, {xy('p_partkey', 7919, 104729, 'p_partkey % 11')},
        CASE WHEN p_size <= 16 THEN 'Remove' ELSE 'Add' END AS newpointty,
        CASE WHEN p_size >= 30 THEN p_brand END AS assigned_county FROM part""",
    "study_additions": f"SELECT s_suppkey AS id, {xy('s_suppkey', 2221, 6101)} FROM supplier",
    "existing": f"""SELECT s_suppkey AS id, {xy('s_suppkey', 4517, 9209)} FROM supplier
        UNION ALL SELECT s_suppkey, {xy('s_suppkey', 4517, 9209, '300')} FROM supplier""",
    "confirmed": f"""SELECT c_custkey AS id, {xy('c_custkey', 7919, 104729, '(c_custkey % 25 // 24) * 10')}
        FROM customer""",
    "late_additions": f"SELECT s_suppkey AS id, {xy('s_suppkey', 7919, 104729, '31')} FROM supplier",
    "late_removals": f"""SELECT o_orderkey AS id, {xy('o_custkey', 7919, 104729, '(o_orderkey * 29) % 1009')}
        FROM orders""",
    "crossings": f"SELECT s_suppkey AS id, {xy('s_suppkey', 6841, 15013)} FROM supplier",
    "crashes": f"SELECT event_id AS id, {xy('event_id', 6151, 12289)} FROM events",
    "comments": f"""SELECT event_id AS id, {xy('event_id', 6151, 12289)},
        CASE event_type WHEN 'error' THEN 'improvement needed' WHEN 'purchase' THEN 'suggested new crossing'
          ELSE event_type END AS kml_name,
        CASE WHEN user_id % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
        CASE WHEN user_id % 7 = 0 THEN 'y' END AS race_black,
        CASE WHEN user_id % 11 = 0 THEN 'y' END AS race_asia FROM events""",
    "stops": f"SELECT o_orderkey AS id, {xy('o_orderkey', 4409, 11003)}, o_orderkey % 500 AS on_off FROM orders",
    "rail": f"""SELECT event_id AS id, {xy('event_id', 6151, 12289)}, event_id % 40 AS volume,
        CASE WHEN event_type = 'signup' THEN 'D' ELSE 'U' END AS lvolu FROM events""",
    "schools": f"""SELECT s_suppkey AS id, {xy('s_suppkey', 5003, 17011)},
        CASE WHEN s_suppkey % 5 = 0 THEN 'COLLEGE 4YR' WHEN s_suppkey % 7 <> 0 THEN 'ELEMENTARY' END AS sch_type1
        FROM supplier""",
    "parks": f"SELECT s_suppkey AS id, {xy('s_suppkey', 4001, 9001)} FROM supplier",
    "cells": """SELECT ((o_orderkey * 37 % 400) + 0.5::DOUBLE) * 50 AS x,
        ((o_orderkey * 91 + o_orderkey // 400) % 400 + 0.5::DOUBLE) * 50 AS y,
        (o_orderkey * 31 % 45)::DOUBLE AS value FROM orders""",
    "counties": f"""SELECT CAST(n_nationkey AS BIGINT) AS id, CASE n_nationkey {_county} ELSE n_name END AS cty_name,
        'Region ' || n_regionkey AS designation,
        (n_nationkey % 5 * 4000 + 200)::DOUBLE AS x0, (n_nationkey // 5 * 4000 + 200)::DOUBLE AS y0,
        3600.0::DOUBLE AS side FROM nation""",
    "cities": f"""SELECT s_suppkey AS id, s_name AS name, {spot('s_suppkey', 7001)} AS x0,
        {spot('s_suppkey', 3001)} AS y0, 900.0::DOUBLE AS side FROM supplier""",
    "removal_areas": f"""SELECT s_suppkey AS id, {spot('s_suppkey', 3331)} AS x0, {spot('s_suppkey', 7717)} AS y0,
        300.0::DOUBLE AS side FROM supplier""",
    "areas": f"""SELECT p_partkey AS id, p_size AS size, {spot('p_partkey', 3571)} AS ax,
        {spot('p_partkey', 9973)} AS ay, (300 + 20 * p_size)::DOUBLE AS w,
        p_retailprice / 97.0::DOUBLE AS popden2014, (p_retailprice + p_size) / 97.0::DOUBLE AS popden2040,
        p_size * 2.0::DOUBLE / 97.0::DOUBLE AS empden2014, p_size * 3.0::DOUBLE / 97.0::DOUBLE AS empden2040,
        p_size / 97.0::DOUBLE AS bike_walk_modeshare, p_partkey % 17 / 17.0::DOUBLE AS seniors_per,
        CASE WHEN p_partkey % 13 <> 0 THEN p_partkey % 13 / 13.0::DOUBLE END AS pop_under_15_per,
        p_partkey % 7 / 7.0::DOUBLE AS zero_car_housing_units_per,
        p_partkey % 19 / 19.0::DOUBLE AS ppl_of_color_percent FROM part""",
    "poverty": f"""SELECT p_partkey AS id, {spot('p_partkey', 2609)} AS ax, {spot('p_partkey', 7411)} AS ay,
        (100 + 5 * p_size)::DOUBLE AS w FROM part""",
    "poverty50": f"""SELECT p_partkey AS id, {spot('p_partkey', 1867)} AS x0, {spot('p_partkey', 9413)} AS y0,
        150.0::DOUBLE AS side FROM part""",
    "typed_points": "SELECT id, x + CASE WHEN point_type = 'BUILDING' THEN 40 ELSE 0 END AS x, c.y AS y FROM confirmed c JOIN"
        " (SELECT site_id AS id, point_type FROM sites) t USING (id)",
    "town_stops": f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey = 7 THEN 5000000.0::DOUBLE
          WHEN o_orderkey % 3 = 0 THEN {spot('o_orderkey', 4409)} ELSE 9000 + o_orderkey * 4409 % 300 END AS x,
        CASE WHEN o_orderkey % 3 = 0 THEN {spot('o_orderkey', 11003)} ELSE 9000 + o_orderkey * 11003 % 300 END AS y FROM orders""",
    "diagonals": """SELECT o_orderstatus AS regstat, o_orderkey * 7 % 100 AS street, o_orderkey * 37 % 9000 AS lo,
        o_orderkey * 37 % 9000 + 100 AS hi FROM orders""",
    "zones": f"""SELECT s_suppkey AS id, s_name AS name, s_acctbal AS value, {spot('s_suppkey', 6007)} AS x0, {spot('s_suppkey', 2003)} AS y0 FROM supplier""",
    "zone_corners": """SELECT i, CASE i // 250 WHEN 0 THEN along WHEN 1 THEN 1500 - tooth WHEN 2 THEN 1500 - along ELSE tooth END AS cx,
          CASE i // 250 WHEN 0 THEN tooth WHEN 1 THEN along WHEN 2 THEN 1500 - tooth ELSE 1500 - along END AS cy
        FROM (SELECT i, (i % 250 * 6)::DOUBLE AS along, (i % 250 % 2 * 37)::DOUBLE AS tooth FROM range(1000) r(i))
        UNION ALL SELECT 1000 + i, [500.0, 900.0, 900.0, 500.0][i + 1]::DOUBLE, [500.0, 500.0, 900.0, 900.0][i + 1]::DOUBLE FROM range(4) r(i)""",
    "zone_edges": """SELECT z.id, z.name, z.value, z.x0, z.y0, z.x0 + a.cx AS x1, z.y0 + a.cy AS y1, z.x0 + b.cx AS x2, z.y0 + b.cy AS y2
        FROM zones z, zone_corners a, zone_corners b
        WHERE b.i = CASE a.i WHEN 999 THEN 0 WHEN 1003 THEN 1000 ELSE a.i + 1 END""",
    "corridors": f"""SELECT s_suppkey AS id, {spot('s_suppkey', 5441)} AS ax, {spot('s_suppkey', 13007)} AS ay,
        2500.0::DOUBLE AS w FROM supplier""",
    "trails": zigzag(
        "part", "p_partkey", 3571, 9973,
        "CASE WHEN k % 3 = 0 THEN 'Existing' WHEN k % 3 = 1 THEN 'Alternate' ELSE 'Planned' END AS status,"
        " p_name AS streetall, k % 2 + 1 AS tier",
    ),
    "alignments": zigzag("supplier", "s_suppkey", 1237, 4591),
    "bikeways": zigzag(
        "orders", "o_orderkey", 2729, 8123, "CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS regstat"
    ),
    "streets": """SELECT line_id, 0 AS seg_no, regstat, east, x1::DOUBLE AS x1, y1::DOUBLE AS y1,
        (x1 + CASE WHEN east THEN 500 ELSE 0 END)::DOUBLE AS x2, (y1 + CASE WHEN east THEN 0 ELSE 500 END)::DOUBLE AS y2
        FROM (SELECT o_orderkey AS line_id, o_orderstatus AS regstat, o_orderkey % 2 = 0 AS east,
          CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 37 % 20000 ELSE o_orderkey * 7 % 100 * 200 END AS x1,
          CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 7 % 100 * 200 ELSE o_orderkey * 37 % 20000 END AS y1
          FROM orders)""",
    "barriers": f"""SELECT s_suppkey AS line_id, 0 AS seg_no, {spot('s_suppkey', 5441)} AS x1,
        {spot('s_suppkey', 13007)} AS y1, {spot('s_suppkey', 5441)} + 1500 AS x2,
        {spot('s_suppkey', 13007)} + s_suppkey % 7 * 200 AS y2,
        CASE s_suppkey % 3 WHEN 0 THEN 'Streams' WHEN 1 THEN 'Railroads' ELSE 'Expressways' END AS source,
        CASE WHEN s_suppkey % 12 = 0 THEN 'Mississippi River' WHEN s_suppkey % 12 = 3 THEN 'Minnesota River'
          WHEN s_suppkey % 4 <> 0 THEN s_name END AS name,
        CASE WHEN s_suppkey % 5 <> 0 THEN 'F' END AS f_xstreet,
        CASE WHEN s_suppkey % 3 <> 2 THEN 'T' END AS t_xstreet FROM supplier""",
}


def with_layers(statement: str, parts: dict[str, str] | None = None) -> str:
    """The statement with a WITH clause of every named part it uses, in order of need."""
    known = LAYERS | (parts or {})
    order: list[str] = []

    open_names: set[str] = set()

    def need(text: str) -> None:
        for name in known:
            if name not in order and name not in open_names and re.search(rf"(?:\bFROM|\bJOIN|,)\s+{name}\b", text):
                open_names.add(name)
                need(known[name])
                order.append(name)

    need(statement)
    if not order:
        return statement
    itself = {n for n in order if re.search(rf"\bFROM\s+{n}\b", known[n])}
    recursive = "RECURSIVE " if itself else ""
    ctes = ",\n".join(f"{n} AS {'' if n in itself else 'MATERIALIZED '}({known[n]})" for n in order)
    return f"WITH {recursive}{ctes}\n{statement}"
