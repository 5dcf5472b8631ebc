"""Cubes over the driver's tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cube import Cube
from .dimension import ALIAS, CONSOLIDATED, NUMERIC, TEXT, Dimension
from .functions import fixed

MEASURES = ("Quantity", "Gross", "Discount")
DERIVED = ("Net", "Tax", "Price", "Band", "Scored")
_made: dict[tuple, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _once(spark: SparkSession, sf_dir: str, what: str, make):
    """Metadata of a data set, made once per session; facts stay lazy."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def geo(spark: SparkSession, sf_dir: str) -> Dimension:
    def make() -> Dimension:
        nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()
        d = Dimension("Geo")
        d.define_attribute("Key", NUMERIC)
        d.define_attribute("Home", TEXT)
        d.define_attribute("Code", ALIAS)
        for r in nations:
            m = d.add(r["n_name"])
            d.set_attribute(m, "Key", r["n_nationkey"] * fixed.SCALE)
            d.set_attribute(m, "Home", r["r_name"])
            d.set_attribute(m, "Code", f"N{r['n_nationkey']}")
        regions = {r["r_name"]: r["r_regionkey"] for r in sorted(nations, key=lambda r: r["r_regionkey"])}
        for name in regions:
            d.add(name, CONSOLIDATED)
        world = d.add("World", CONSOLIDATED)
        for r in nations:
            d.add_child(d.exact(r["r_name"]), d.exact(r["n_name"]))
        for name in regions:
            d.add_child(world, d.exact(name))
        return d

    return _once(spark, sf_dir, "geo", make).copy()


def period(spark: SparkSession, sf_dir: str) -> Dimension:
    def make() -> Dimension:
        lo, hi = table(spark, sf_dir, "orders").agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
        months = [(y, m) for y in range(lo.year, hi.year + 1) for m in range(1, 13) if (lo.year, lo.month) <= (y, m) <= (hi.year, hi.month)]
        d = Dimension("Period")
        for y, m in months:
            d.add(f"{y}-{m:02d}")
        quarters = list(dict.fromkeys((y, (m + 2) // 3) for y, m in months))
        years = list(dict.fromkeys(y for y, _ in months))
        for y, q in quarters:
            d.add(f"{y}-Q{q}", CONSOLIDATED)
        for y in years:
            d.add(f"{y}", CONSOLIDATED)
        top = d.add("All Years", CONSOLIDATED)
        for y, m in months:
            d.add_child(d.exact(f"{y}-Q{(m + 2) // 3}"), d.exact(f"{y}-{m:02d}"))
        for y, q in quarters:
            d.add_child(d.exact(f"{y}"), d.exact(f"{y}-Q{q}"))
        for y in years:
            d.add_child(top, d.exact(f"{y}"))
        return d

    return _once(spark, sf_dir, "period", make).copy()


def segment(spark: SparkSession, sf_dir: str) -> Dimension:
    def make() -> Dimension:
        d = Dimension("Segment")
        names = [r[0] for r in table(spark, sf_dir, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
        for n in names:
            d.add(n)
        top = d.add("All Segments", CONSOLIDATED)
        for n in names:
            d.add_child(top, d.exact(n))
        return d

    return _once(spark, sf_dir, "segment", make).copy()


def measure() -> Dimension:
    d = Dimension("Measure")
    for n in (*MEASURES, *DERIVED):
        d.add(n)
    v = d.add("Variance", CONSOLIDATED)
    d.add_child(v, d.exact("Gross"), 1)
    d.add_child(v, d.exact("Discount"), -1)
    return d


def sales_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(geo, period, segment, measure, v): one row per coordinate.

    Lines are summed by order before anything is joined; the joins then run over orders, and the
    three sums become rows only after the last grouping.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(fixed.scaled(F.col("l_quantity"))).alias("Quantity"), F.sum(fixed.scaled(F.col("l_extendedprice"))).alias("Gross"), F.sum(fixed.scaled(F.col("l_extendedprice") * F.col("l_discount"))).alias("Discount")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("period"))
    buyers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("segment"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("geo"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    summed = joined.groupBy("c_nationkey", "period", "segment").agg(*[F.sum(m).alias(m) for m in MEASURES])
    wide = summed.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return wide.select("geo", "period", "segment", F.expr("stack(3, " + ", ".join(f"'{m}', {m}" for m in MEASURES) + ") AS (measure, v)"))


def sales(spark: SparkSession, sf_dir: str, rules: str = "") -> Cube:
    dims = [geo(spark, sf_dir), period(spark, sf_dir), segment(spark, sf_dir), measure()]
    cube = Cube.load(spark, "Sales", dims, sales_facts(spark, sf_dir), ["geo", "period", "segment", "measure"])
    return replace(cube, rules=rules)


def parts(spark: SparkSession, sf_dir: str) -> Cube:
    """Brand-and-type leaves under brands and under types, both under All: alternate rollups and a diamond."""
    rows = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.sum(fixed.scaled(F.col("p_retailprice"))).alias("Retail"), (F.count(F.lit(1)) * fixed.SCALE).alias("Count"))

    def make() -> Dimension:
        pairs = [(r[0], r[1]) for r in rows.select("p_brand", "p_type").orderBy("p_brand", "p_type").collect()]
        d = Dimension("Part")
        for b, t in pairs:
            d.add(f"{b}/{t}")
        for b in dict.fromkeys(b for b, _ in pairs):
            d.add(f"brand {b}", CONSOLIDATED)
        for t in sorted({t for _, t in pairs}):
            d.add(f"type {t}", CONSOLIDATED)
        top = d.add("All Parts", CONSOLIDATED)
        for b, t in pairs:
            d.add_child(d.exact(f"brand {b}"), d.exact(f"{b}/{t}"))
            d.add_child(d.exact(f"type {t}"), d.exact(f"{b}/{t}"))
        for m in list(d):
            if m.kind == CONSOLIDATED and m.id != top:
                d.add_child(top, m.id)
        return d

    m = Dimension("Measure")
    m.add("Retail")
    m.add("Count")
    facts = rows.select(F.concat_ws("/", "p_brand", "p_type").alias("part"), F.expr("stack(2, 'Retail', Retail, 'Count', Count) AS (measure, v)"))
    return Cube.load(spark, "Parts", [_once(spark, sf_dir, "part", make).copy(), m], facts, ["part", "measure"])


def targets(spark: SparkSession, sf_dir: str, rules: str = "") -> Cube:
    """Targets by nation: a small cube that rules and spreads write about."""
    m = Dimension("Metric")
    for n in ("Target", "World Gross", "Share"):
        m.add(n)
    facts = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("geo")).agg(F.sum(fixed.scaled(F.col("c_acctbal"))).alias("v"))
    cube = Cube.load(spark, "Targets", [geo(spark, sf_dir), m], facts.withColumn("metric", F.lit("Target")), ["geo", "metric"])
    return replace(cube, rules=rules)
