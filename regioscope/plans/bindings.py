"""Bindings of the reference's concepts to the driver's tables.

The reference's own data (business registry, census, polygons) is absent,
so each concept is derived from the TPC-H-like tables by Spark, and grows
with them:

* establishment      = ``customer`` (id, name + legal suffix, ...)
* scored business    = ``lineitem`` row, score ``abs(l_discount) * 10``
* neighbourhood      = ``orders`` row (holds scored lines; some hold none)
* municipality       = customer nation x order priority
* snapshot period    = month of ``o_orderdate``
* region x product   = supplier nation x part name, value = extended price
* polygons           = 5 x 5 sheared grid of quads keyed by ``n_nationkey``
* coordinates        = a rule on ``c_custkey``

Every binding below is an expression over the tables; the oracle SQL of the
plans spells the same rules for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regioscope.functions.geo import RINGS_TYPE
from regioscope.operators.joins import broadcast_if_small, broadcast_or_salted
from regioscope.session import table_path


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def r6(c, digits: int = 6) -> Column:
    """Round a computed double for value comparison: canonicalise to
    ``min(9, digits + 4)`` places first, so that summation-order noise
    cannot flip a half-way case, then round half-up to ``digits``."""
    return F.round(F.round(F.col(c) if isinstance(c, str) else c, min(9, digits + 4)), digits)


def r2(c) -> Column:
    """``round(x, 2)`` with the same canonicalisation."""
    return r6(c, 2)


# Fixed binding values (not from the reference): legal-name tails appended
# to customer names, picked by c_custkey % 15, and road / settlement types.
NAME_TAILS = [
    "SA DE CV", "S.A. DE C.V.", "S DE RL DE CV", "SC", "AC", "A.C.",
    "SAPI DE CV", "SAB DE CV", "SA DE CV SOFOM ENR", "SPR DE RL", "SCL", "INC",
    "SAS DE CV", "SA DE CV SFP", "",
]
ROAD_TYPES = ["CALLE", "AVENIDA", "CALLEJON", "CARRETERA", "PRIVADA"]
SIZE_CLASSES = ["0 a 5 personas", "6 a 10 personas", "11 a 30 personas",
                "31 a 50 personas", "51 a 100 personas", "101 a 250 personas",
                "251 y más personas"]


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def score(l_discount: Column) -> Column:
    """Business score in [0, 1]; ``abs`` removes the -0.0 of the source."""
    return F.abs(l_discount) * 10.0


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business registry derived from ``customer`` (one row per customer)."""
    c = load(spark, sf_dir, "customer")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    k = F.col("c_custkey")
    tail = _pick(NAME_TAILS, k % 15)
    month = k % 13 + 1
    # nation has 25 rows at every scale factor: a fixed broadcast bound
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left")
            .select(
                k.cast("string").alias("id"),
                F.when(k % 7 != 0, F.col("c_name")).alias("nom_estab"),
                F.concat_ws(" ", F.col("c_name"), tail).alias("raz_social"),
                F.concat(F.lit("46"), F.lpad((k % 97).cast("string"), 4, "0"))
                 .alias("codigo_act"),
                F.when(k % 11 != 0, _pick(SIZE_CLASSES, F.floor(F.abs(F.col("c_acctbal")) / 1500) % 7))
                 .alias("per_ocu"),
                F.when(k % 9 != 0, _pick(ROAD_TYPES, k % 5)).alias("tipo_vial"),
                F.when(k % 3 == 0, F.concat(F.lit("EDIFICIO "), k.cast("string")))
                 .alias("edificio"),
                F.when(k % 13 != 0, F.col("c_mktsegment")).alias("tipo_asent"),
                F.lpad(F.col("n_regionkey").cast("string"), 2, "0").alias("cve_ent"),
                F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("cve_mun"),
                F.col("n_name").alias("municipio"),
                F.when(k % 4 != 0, F.concat(F.lit("55"), F.lpad(k.cast("string"), 8, "0")))
                 .alias("telefono"),
                F.when(k % 6 != 0, F.concat(F.lit("c"), k.cast("string"), F.lit("@mail.mx")))
                 .alias("correoelec"),
                F.when(k % 8 == 0, F.concat(F.lit("www.c"), k.cast("string"), F.lit(".mx")))
                 .alias("www"),
                F.when(k % 10 == 0, F.lit("Semifijo")).otherwise(F.lit("Fijo"))
                 .alias("tipoUniEco"),
                F.concat((k % 13 + 2010).cast("string"), F.lit("-"),
                         F.lpad(month.cast("string"), 2, "0")).alias("fecha_alta"),
                (F.lit(19.10) + ((k * 91) % 1000) * 0.00045).alias("latitud"),
                (F.lit(-99.36) + ((k * 37) % 1000) * 0.0004).alias("longitud"),
            ))


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     score(F.col("l_discount")).alias("q"))


# polygons: a 5 x 5 grid over the coordinate box, sheared so that edges
# are not axis-parallel (x += (y - y0) * SHEAR).  Cell (i, j) belongs to
# nation key 5 * j + i.
GRID_X0, GRID_Y0, GRID_DX, GRID_DY, SHEAR = -99.36, 19.10, 0.08, 0.09, 0.1


def _corner(i: Column, j: Column, di: int, dj: int) -> Column:
    y = F.lit(GRID_Y0) + (j + dj) * GRID_DY
    x = F.lit(GRID_X0) + (i + di) * GRID_DX + (y - GRID_Y0) * SHEAR
    return F.struct(x.alias("x"), y.alias("y"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbourhood polygons ``(poly_id, n_name, n_regionkey, rings)``."""
    n = load(spark, sf_dir, "nation")
    i, j = F.col("n_nationkey") % 5, F.floor(F.col("n_nationkey") / 5)
    ring = F.array(_corner(i, j, 0, 0), _corner(i, j, 1, 0), _corner(i, j, 1, 1),
                   _corner(i, j, 0, 1), _corner(i, j, 0, 0))
    return n.select(F.col("n_nationkey").alias("poly_id"), "n_name", "n_regionkey",
                    F.array(ring).cast(RINGS_TYPE).alias("rings"))


def region_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(country, product, value)``: supplier 'nation, region' x part name, summed
    extended price.

    The supplier side (a dimension) is broadcast only behind a size check,
    else joined with salting so a hot supplier is split over many tasks;
    lineitem is then partially aggregated to (nation, part key) *before*
    the part join, so the large side shuffles only pre-aggregated rows.
    """
    li = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey",
                                                "l_extendedprice")
    s = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    # nation (25 rows) and region (5 rows) are fixed at every scale factor
    n = F.broadcast(load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    r = F.broadcast(load(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    s = s.withColumnRenamed("s_suppkey", "l_suppkey")
    by_part = (broadcast_or_salted(li, s, "l_suppkey")
               .groupBy("s_nationkey", "l_partkey")
               .agg(F.sum("l_extendedprice").alias("value")))
    return (by_part.join(p, by_part.l_partkey == p.p_partkey)
            .join(n, F.col("s_nationkey") == n.n_nationkey)
            .join(r, F.col("n_regionkey") == r.r_regionkey)
            # municipality, state (composite key)
            .groupBy(F.concat_ws(", ", "n_name", "r_name").alias("country"),
                     F.col("p_name").alias("product"))
            .agg(F.sum("value").alias("value")))


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-nation indicator table (the composite index's input)."""
    c = load(spark, sf_dir, "customer")
    o = load(spark, sf_dir, "orders")
    s = load(spark, sf_dir, "supplier")
    n = load(spark, sf_dir, "nation")
    cust = c.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).cast("double").alias("customers"),
        F.avg("c_acctbal").alias("mean_acctbal"),
        F.avg((F.col("c_acctbal") < 0).cast("double")).alias("share_negative"),
        F.avg((F.col("c_mktsegment") == "BUILDING").cast("double")).alias("share_building"))
    ords = o.join(c.select("c_custkey", "c_nationkey"), o.o_custkey == c.c_custkey) \
        .groupBy("c_nationkey").agg(
            F.avg("o_totalprice").alias("mean_order"),
            F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("share_urgent"),
            F.count(F.lit(1)).cast("double").alias("orders"))
    sup = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).cast("double").alias("suppliers"),
                                       F.sum("s_acctbal").alias("supplier_acctbal"))
    out = (n.select(F.col("n_nationkey"), F.col("n_name").alias("entidad"))
           .join(cust, F.col("n_nationkey") == cust.c_nationkey, "left").drop("c_nationkey")
           .join(ords, F.col("n_nationkey") == ords.c_nationkey, "left").drop("c_nationkey")
           .join(sup, F.col("n_nationkey") == sup.s_nationkey, "left").drop("s_nationkey"))
    return out.fillna(0.0, subset=INDICATOR_COLS)


INDICATOR_COLS = ["customers", "mean_acctbal", "share_negative", "share_building",
                  "mean_order", "share_urgent", "orders", "suppliers",
                  "supplier_acctbal"]
