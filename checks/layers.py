"""Study layers made from the given tables by integer arithmetic on their keys.

Every layer uses all rows of its table. Coordinates are whole metres in a plane of about 20 by 20 km.
`oracle_layers.py` states the same layers in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siterank.functions.geometry import ring_edges
from siterank.plans import FeatureLayers, LabelLayers, RosterInputs
from siterank.plans.features import PROBLEM, SUGGESTED
from siterank.sources import line_segments, raster_cells, read_layer

SIZE = 20000
ADDITION = "study addition"
LATE = "late addition"
SPREAD = ("customer", "part", "supplier")  # small files of rows that each cause much work
COUNTY_NAMES = ("Anoka", "Carver", "Dakota", "Hennepin", "Ramsey", "Scott", "Washington", "Chisago", "Wright")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_layer(spark, f"{sf_dir}/{name}.parquet", spread=name in SPREAD)


def spot(key: Column, factor: int) -> Column:
    """Whole-number coordinate of a key, as double."""
    return ((key.cast("bigint") * factor) % SIZE).cast("double")


def _xy(key: Column, a: int, b: int, dx: Column | int = 0) -> list[Column]:
    return [(spot(key, a) + dx).alias("x"), spot(key, b).alias("y")]


def sites(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("site_id"), *_xy(k, 7919, 104729), F.col("c_mktsegment").alias("point_type")
    )


def base_points(spark, d) -> DataFrame:
    return sites(spark, d).withColumnRenamed("site_id", "id")


def removals(spark, d) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    shift = (F.col("o_orderkey") * 13) % 211
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), *_xy(F.col("o_custkey"), 7919, 104729, shift), status.alias("ptstat")
    )


def edits(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("id"),
        *_xy(k, 7919, 104729, k % 11),
        F.when(F.col("p_size") <= 16, "Remove").otherwise("Add").alias("newpointty"),
        F.when(F.col("p_size") >= 30, F.col("p_brand")).alias("assigned_county"),
    )


def study_additions(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), *_xy(k, 2221, 6101))


def existing(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    first = F.struct(*_xy(k, 4517, 9209))
    second = F.struct(*_xy(k, 4517, 9209, 300))
    return table(spark, d, "supplier").select(k.alias("id"), F.array(first, second).alias("points"))


def confirmed(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    moved = F.floor((k % 25) / 24) * 10
    return table(spark, d, "customer").select(k.alias("id"), *_xy(k, 7919, 104729, moved))


def late_additions(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), *_xy(k, 7919, 104729, 31))


def late_removals(spark, d) -> DataFrame:
    shift = (F.col("o_orderkey") * 29) % 1009
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), *_xy(F.col("o_custkey"), 7919, 104729, shift)
    )


def crossings(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), *_xy(k, 6841, 15013))


def crashes(spark, d) -> DataFrame:
    k = F.col("event_id")
    return table(spark, d, "events").select(k.alias("id"), *_xy(k, 6151, 12289))


def comments(spark, d) -> DataFrame:
    k, u, e = F.col("event_id"), F.col("user_id"), F.col("event_type")
    kind = F.when(e == "error", PROBLEM).when(e == "purchase", SUGGESTED).otherwise(e)
    return table(spark, d, "events").select(
        k.alias("id"),
        *_xy(k, 6151, 12289),
        kind.alias("kml_name"),
        F.when(u % 2 == 0, "Female").otherwise("Male").alias("gender"),
        F.when(u % 7 == 0, "y").alias("race_black"),
        F.when(u % 11 == 0, "y").alias("race_asia"),
    )


def stops(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), *_xy(k, 4409, 11003), (k % 500).cast("int").alias("on_off"))


def rail(spark, d) -> DataFrame:
    k = F.col("event_id")
    return table(spark, d, "events").select(
        k.alias("id"),
        *_xy(k, 6151, 12289),
        (k % 40).cast("int").alias("volume"),
        F.when(F.col("event_type") == "signup", "D").otherwise("U").alias("lvolu"),
    )


def schools(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    kind = F.when(k % 5 == 0, "COLLEGE 4YR").when(k % 7 != 0, "ELEMENTARY")
    return table(spark, d, "supplier").select(k.alias("id"), *_xy(k, 5003, 17011), kind.alias("sch_type1"))


def parks(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), *_xy(k, 4001, 9001))


def cells(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return raster_cells(
        table(spark, d, "orders"), (k * 37) % 400, (k * 91 + F.floor(k / 400)) % 400, (k * 31) % 45, 50.0
    )


def _ring(*points: tuple[Column, Column]) -> Column:
    return F.array(F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points]))


def square(x0: Column, y0: Column, side: int) -> Column:
    return ring_edges(_ring((x0, y0), (x0 + side, y0), (x0 + side, y0 + side), (x0, y0 + side)))


def triangle(x0: Column, y0: Column, w: Column) -> Column:
    return ring_edges(_ring((x0, y0), (x0 + w, y0), (x0, y0 + w)))


def counties(spark, d) -> DataFrame:
    k = F.col("n_nationkey").cast("bigint")
    name = F.coalesce(F.get(F.array(*[F.lit(n) for n in COUNTY_NAMES]), k.cast("int")), F.col("n_name"))
    return table(spark, d, "nation").select(
        k.alias("id"),
        name.alias("cty_name"),
        F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")).alias("designation"),
        square((k % 5) * 4000 + 200, F.floor(k / 5) * 4000 + 200, 3600).alias("edges"),
    )


def cities(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("id"), F.col("s_name").alias("name"), square(spot(k, 7001), spot(k, 3001), 900).alias("edges")
    )


def removal_areas(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), square(spot(k, 3331), spot(k, 7717), 300).alias("edges"))


def areas(spark, d) -> DataFrame:
    """Triangles that stand for traffic zones and for census areas."""
    k, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").select(
        k.alias("id"),
        size.alias("size"),
        (price / 97.0).alias("popden2014"),
        ((price + size) / 97.0).alias("popden2040"),
        (size * 2.0 / 97.0).alias("empden2014"),
        (size * 3.0 / 97.0).alias("empden2040"),
        (size / 97.0).alias("bike_walk_modeshare"),
        ((k % 17) / 17.0).alias("seniors_per"),
        F.when(k % 13 != 0, (k % 13) / 13.0).alias("pop_under_15_per"),
        ((k % 7) / 7.0).alias("zero_car_housing_units_per"),
        ((k % 19) / 19.0).alias("ppl_of_color_percent"),
        triangle(spot(k, 3571), spot(k, 9973), 300 + 20 * size).alias("edges"),
    )


def poverty(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("id"), triangle(spot(k, 2609), spot(k, 7411), 100 + 5 * F.col("p_size")).alias("edges")
    )


def poverty50(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), square(spot(k, 1867), spot(k, 9413), 150).alias("edges"))


def typed_points(spark, d) -> DataFrame:
    """Confirmed points with the type of the base point of the same key; buildings lie 40 m off."""
    types = base_points(spark, d).select("id", "point_type")
    off = F.when(F.col("point_type") == "BUILDING", 40).otherwise(0)
    return confirmed(spark, d).join(types, "id").withColumn("x", F.col("x") + off)


def town_stops(spark, d) -> DataFrame:
    """Two thirds of the stops in a town of 300 m, one very far away, the rest spread."""
    k = F.col("o_orderkey")
    spread = k % 3 == 0
    x = F.when(k == 7, 5000000.0).when(spread, spot(k, 4409)).otherwise(9000 + k * 4409 % 300)
    y = F.when(spread, spot(k, 11003)).otherwise(9000 + k * 11003 % 300)
    return table(spark, d, "orders").select(k.alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y"))


def diagonals(spark, d) -> DataFrame:
    """Streets of 500 m in direction (3, 4) on coordinates of UTM size, overlapping, every other one reversed."""
    k = F.col("o_orderkey")
    street, lo = k * 7 % 100, k * 37 % 9000
    x = lambda t: (480000 + 100 * street + 3 * t).cast("double")
    y = lambda t: (4980000 + 4 * t).cast("double")
    ahead = k % 2 == 0
    ends = {f"{n}{i}": F.when(ahead, f(a)).otherwise(f(b)) for n, f in (("x", x), ("y", y)) for i, a, b in ((1, lo, lo + 100), (2, lo + 100, lo))}
    return table(spark, d, "orders").select(
        k.alias("line_id"), F.lit(0).alias("seg_no"), *[c.alias(n) for n, c in ends.items()], F.col("o_orderstatus").alias("regstat")
    )


ZONE, TOOTH, STEP = 1500, 37, 6  # metres: a zone's side, its teeth and half their width


def zones(spark, d) -> DataFrame:
    """Squares with toothed sides of 1,000 corners, with a square hole."""
    k = F.col("s_suppkey")
    x0, y0 = spot(k, 6007), spot(k, 2003)

    def corner(i: Column) -> Column:
        along, tooth = (i % 250 * STEP).cast("double"), (i % 250 % 2 * TOOTH).cast("double")
        side = F.floor(i / 250)
        x = F.when(side == 0, along).when(side == 1, ZONE - tooth).when(side == 2, ZONE - along).otherwise(tooth)
        y = F.when(side == 0, tooth).when(side == 1, along).when(side == 2, ZONE - tooth).otherwise(ZONE - along)
        return F.struct((x0 + x).alias("x"), (y0 + y).alias("y"))

    rim = F.transform(F.sequence(F.lit(0), F.lit(999)), corner)
    hole = F.array(*[F.struct((x0 + x).alias("x"), (y0 + y).alias("y")) for x, y in ((500.0, 500.0), (900.0, 500.0), (900.0, 900.0), (500.0, 900.0))])
    rings = table(spark, d, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("value"), F.array(rim, hole).alias("rings"))
    return rings.select("id", "name", "value", ring_edges(F.col("rings")).alias("edges"))


def corridors(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("id"), triangle(spot(k, 5441), spot(k, 13007), F.lit(2500)).alias("edges")
    )


def _zigzag(df: DataFrame, key: str, a: int, b: int, *attrs: Column) -> DataFrame:
    """Three segments per key; even keys run east, odd keys north."""
    k = F.col(key).cast("bigint")

    def vertex(j: int) -> Column:
        along = F.lit(j * 200)
        across = (k * k + j * j * 37 + k * (j * 11)) % 301 - 150
        even = k % 2 == 0
        x = (k * k * a) % SIZE + F.when(even, along).otherwise(across)
        y = (k * k * b + k * 77) % SIZE + F.when(even, across).otherwise(along)
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    lines = df.select(k.alias("line_id"), *attrs, F.array(*[vertex(j) for j in range(4)]).alias("vertices"))
    return line_segments(lines)


def trails(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    status = F.when(k % 3 == 0, "Existing").when(k % 3 == 1, "Alternate").otherwise("Planned")
    return _zigzag(
        table(spark, d, "part"), "p_partkey", 3571, 9973,
        status.alias("status"), F.col("p_name").alias("streetall"), (k % 2 + 1).cast("int").alias("tier"),
    )


def alignments(spark, d) -> DataFrame:
    return _zigzag(table(spark, d, "supplier"), "s_suppkey", 1237, 4591)


def bikeways(spark, d) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3)
    return _zigzag(table(spark, d, "orders"), "o_orderkey", 2729, 8123, status.alias("regstat"))


def streets(spark, d) -> DataFrame:
    """Straight streets 500 m long on few latitudes and longitudes, so that many overlap."""
    k = F.col("o_orderkey")
    along = (k * 37) % SIZE
    across = ((k * 7) % 100) * 200
    east = k % 2 == 0
    x1 = F.when(east, along).otherwise(across).cast("double")
    y1 = F.when(east, across).otherwise(along).cast("double")
    return table(spark, d, "orders").select(
        k.alias("line_id"), F.lit(0).alias("seg_no"), x1.alias("x1"), y1.alias("y1"),
        (x1 + F.when(east, 500).otherwise(0)).alias("x2"), (y1 + F.when(east, 0).otherwise(500)).alias("y2"),
        F.col("o_orderstatus").alias("regstat"),
    )


def barriers(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    x1, y1 = spot(k, 5441), spot(k, 13007)
    source = F.when(k % 3 == 0, "Streams").when(k % 3 == 1, "Railroads").otherwise("Expressways")
    name = (
        F.when(k % 12 == 0, "Mississippi River")
        .when(k % 12 == 3, "Minnesota River")
        .when(k % 4 != 0, F.col("s_name"))
    )
    return table(spark, d, "supplier").select(
        k.alias("line_id"), F.lit(0).alias("seg_no"),
        x1.alias("x1"), y1.alias("y1"), (x1 + 1500).alias("x2"), (y1 + (k % 7) * 200).alias("y2"),
        source.alias("source"), name.alias("name"), name.alias("streetall"),
        F.when(k % 5 != 0, "F").alias("f_xstreet"), F.when(k % 3 != 2, "T").alias("t_xstreet"),
    )


def of_source(spark, d, source: str) -> DataFrame:
    return barriers(spark, d).filter(F.col("source") == source)


def roster_inputs(spark, d) -> RosterInputs:
    return RosterInputs(
        base=base_points(spark, d),
        coded_removals=removals(spark, d),
        edits=edits(spark, d),
        study_additions=study_additions(spark, d),
        existing=existing(spark, d),
        late_removals=late_removals(spark, d),
        late_additions=late_additions(spark, d),
        removal_areas=removal_areas(spark, d),
        addition_tag=ADDITION,
        late_tag=LATE,
    )


def label_layers(spark, d) -> LabelLayers:
    return LabelLayers(
        base=base_points(spark, d),
        counties=counties(spark, d),
        cities=cities(spark, d),
        designations=counties(spark, d),
        barriers=barriers(spark, d),
        streams=of_source(spark, d, "Streams"),
        railroads=of_source(spark, d, "Railroads"),
        expressways=of_source(spark, d, "Expressways"),
        roads=trails(spark, d),
    )


def feature_layers(spark, d) -> FeatureLayers:
    return FeatureLayers(
        crashes=crashes(spark, d),
        comments=comments(spark, d),
        schools=schools(spark, d),
        parks=parks(spark, d),
        stops=stops(spark, d),
        cells=cells(spark, d),
        rail=rail(spark, d),
        taz=areas(spark, d),
        demographics=areas(spark, d),
        poverty=poverty(spark, d),
        poverty50=poverty50(spark, d),
        corridors=corridors(spark, d),
        alignments=alignments(spark, d),
        trails=trails(spark, d),
        bikeways=bikeways(spark, d),
        crossings=crossings(spark, d),
        race_columns=("race_black", "race_asia"),
    )
