"""One query per operation over the driver's tables, with the DuckDB SQL that gives the same rows.

Values are scaled BIGINTs (v4: four decimals), so that results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import examples as ex
from .cube import Cube, attribute_frame, edge_frame, member_frame, with_names
from .flow import import_rows
from .functions import fixed
from .local import local_frame, scratch_path
from .mdx import language as mdx
from .mdx import sets
from .operators import masks, overlay, rollup, spread, writes
from .plans import view as views
from .plans.regions import Evaluator
from .rules import feeders, provenance
from .sources import readers
from .streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FACTS = """facts AS (
  SELECT n_name AS geo, r_name AS region, strftime(o_orderdate, '%Y-%m') AS period, c_mktsegment AS segment,
    CAST(year(o_orderdate) AS VARCHAR) AS yr, CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS qtr,
    CAST(SUM(CAST(ROUND(l_quantity * 10000) AS BIGINT)) AS BIGINT) AS qty,
    CAST(SUM(CAST(ROUND(l_extendedprice * 10000) AS BIGINT)) AS BIGINT) AS gross,
    CAST(SUM(CAST(ROUND(l_extendedprice * l_discount * 10000) AS BIGINT)) AS BIGINT) AS disc
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""
GEO = """geo AS (
  SELECT n_name AS leaf, n_name AS g FROM nation
  UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT n_name, 'World' FROM nation)"""
PERIOD = """per AS (
  SELECT DISTINCT period AS leaf, period AS p FROM facts UNION SELECT DISTINCT period, qtr FROM facts
  UNION SELECT DISTINCT period, yr FROM facts UNION SELECT DISTINCT period, 'All Years' FROM facts)"""
B = "CAST({} AS BIGINT)".format


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def ids(cube: Cube, dimension: str, names: Sequence[str]) -> list[int]:
    d = cube.dimension(dimension)
    return [d.resolve(n) for n in names]


def all_of(cube: Cube, dimension: str, kinds: Sequence[str] = ("leaf", "string", "consolidated")) -> list[int]:
    return [m.id for m in cube.dimension(dimension) if m.kind in kinds]


def shown(cube: Cube, frame: DataFrame, *keep: str) -> DataFrame:
    """Values by member names: the named dimensions and v4."""
    out = with_names(cube, frame)
    return out.select(*[F.col(k).alias(k.lower()) for k in keep], F.col("v").alias("v4"))


def grid_frame(cube: Cube, view: views.View, evaluator: Evaluator | None = None, rows: bool = False, columns: bool = False) -> DataFrame:
    cells = views.grid(cube, view, evaluator or Evaluator({cube.name: cube}))
    return views.suppressed(cells.select("r", "c", "v"), rows, columns)


def names_of(cube: Cube, dimension: str, members: Sequence[int]) -> tuple[str, ...]:
    return tuple(cube.dimension(dimension).members[m].name for m in members)


# Scans and reads


@query("cell_scan", f"WITH {FACTS} SELECT geo, period, segment, 'Quantity' AS measure, qty AS v4 FROM facts WHERE qty <> 0 UNION ALL SELECT geo, period, segment, 'Gross', gross FROM facts WHERE gross <> 0 UNION ALL SELECT geo, period, segment, 'Discount', disc FROM facts WHERE disc <> 0")
def cell_scan(spark, sf_dir):
    cube = ex.sales(spark, sf_dir)
    return shown(cube, cube.cells, "Geo", "Period", "Segment", "Measure")


@query("point_read", f"WITH {FACTS}, one AS (SELECT min(n_name) AS g FROM nation) SELECT {B('coalesce(sum(gross), 0)')} AS v4 FROM facts, one WHERE geo = g AND period = '1996-03' AND segment = (SELECT min(c_mktsegment) FROM customer)")
def point_read(spark, sf_dir):
    cube = ex.sales(spark, sf_dir)
    nation = min(m.name for m in cube.dimension("Geo") if m.kind == "leaf")
    at = [cube.dimension("Geo").exact(nation), cube.dimension("Period").exact("1996-03"), cube.dimension("Segment").order[0], cube.dimension("Measure").exact("Gross")]
    return cube.at(at).agg(F.coalesce(F.sum("v"), F.lit(0)).cast("bigint").alias("v4"))


@query("bulk_cell_read", f"WITH {FACTS}, s AS (SELECT min(c_mktsegment) AS s FROM customer) SELECT CAST(n_nationkey AS INT) AS ord, n_name AS geo, {B('coalesce((SELECT sum(gross) FROM facts, s WHERE facts.geo = n_name AND period = ' + chr(39) + '1997-05' + chr(39) + ' AND segment = s.s), 0)')} AS v4, 'numeric' AS kind, TRUE AS editable FROM nation")
def bulk_cell_read(spark, sf_dir):
    cube = ex.sales(spark, sf_dir)
    segment = cube.dimension("Segment").members[cube.dimension("Segment").order[0]].name
    asked = [{"Geo": m.name, "Period": "1997-05", "Segment": segment, "Measure": "Gross"} for m in cube.dimension("Geo") if m.kind == "leaf"]
    out = writes.bulk_read(cube, asked)
    return with_names(cube, out).select("ord", F.col("Geo").alias("geo"), F.col("v").alias("v4"), "kind", "editable")


@query("string_cells", "SELECT n_name AS geo, 'note ' || CAST(n_nationkey AS VARCHAR) AS s FROM nation WHERE n_nationkey % 3 = 0")
def string_cells(spark, sf_dir):
    cube = _notes(spark, sf_dir)
    return with_names(cube, cube.strings).where(F.col("s") != "").select(F.col("Geo").alias("geo"), "s")


def _notes(spark, sf_dir) -> Cube:
    m = ex.Dimension("Measure")
    m.add("Sales")
    comment = m.add("Comment", "string")
    geo = ex.geo(spark, sf_dir)
    rows = [(x.id, comment, f"note {k // fixed.SCALE}") for x in geo if isinstance(k := geo.attribute(x.id, "Key"), int) and k // fixed.SCALE % 3 == 0]
    cube = Cube.empty(spark, "Notes", [geo, m])
    return replace(cube, strings=local_frame(spark, rows, "d0 int, d1 int, s string"))


@query("string_point_read", "SELECT n_name AS geo, 'note ' || CAST(n_nationkey AS VARCHAR) AS s FROM nation WHERE n_nationkey = 3")
def string_point_read(spark, sf_dir):
    cube = _notes(spark, sf_dir)
    at = [cube.dimension("Geo").resolve("N3"), cube.dimension("Measure").exact("Comment")]
    return with_names(cube, cube.at(at, cube.strings)).select(F.col("Geo").alias("geo"), "s")


@query("dimension_scan", "SELECT CAST(i AS INT) AS idx, name, kind FROM (SELECT n_nationkey AS i, n_name AS name, 'leaf' AS kind FROM nation UNION ALL SELECT 25 + row_number() OVER (ORDER BY r_regionkey) - 1, r_name, 'consolidated' FROM region UNION ALL SELECT 30, 'World', 'consolidated')")
def dimension_scan(spark, sf_dir):
    return member_frame(spark, ex.geo(spark, sf_dir)).select("idx", "name", "kind")


@query("edge_scan", f"SELECT r_name AS parent, n_name AS child, {B('1')} AS weight FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'World', r_name, 1 FROM region")
def edge_scan(spark, sf_dir):
    d = ex.geo(spark, sf_dir)
    names = member_frame(spark, d).select("id", "name")
    e = edge_frame(spark, d)
    out = e.join(names.withColumnsRenamed({"id": "parent", "name": "p"}), "parent").join(names.withColumnsRenamed({"id": "child", "name": "c"}), "child")
    return out.select(F.col("p").alias("parent"), F.col("c").alias("child"), "weight")


@query("attribute_scan", f"SELECT n_name AS name, 'Key' AS attr, NULL::VARCHAR AS s, {B('n_nationkey * 10000')} AS n FROM nation UNION ALL SELECT n_name, 'Home', r_name, NULL FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'Code', 'N' || CAST(n_nationkey AS VARCHAR), NULL FROM nation")
def attribute_scan(spark, sf_dir):
    d = ex.geo(spark, sf_dir)
    return attribute_frame(spark, d).join(member_frame(spark, d).select("id", "name"), "id").select("name", "attr", "s", "n")


# Consolidation


@query("rollup_geo", f"WITH {FACTS}, {GEO} SELECT g AS geo, {B('sum(gross)')} AS v4 FROM facts JOIN geo ON geo = leaf GROUP BY g HAVING sum(gross) <> 0")
def rollup_geo(spark, sf_dir):
    cube = ex.sales(spark, sf_dir)
    region = [all_of(cube, "Geo"), ids(cube, "Period", ["All Years"]), ids(cube, "Segment", ["All Segments"]), ids(cube, "Measure", ["Gross"])]
    return shown(cube, rollup.consolidate(cube.cells, cube.dimensions, region), "Geo")


@query("rollup_time", f"WITH {FACTS}, {PERIOD} SELECT p AS period, {B('sum(qty)')} AS v4 FROM facts JOIN per ON period = leaf GROUP BY p HAVING sum(qty) <> 0")
def rollup_time(spark, sf_dir):
    cube = ex.sales(spark, sf_dir)
    region = [ids(cube, "Geo", ["World"]), all_of(cube, "Period"), ids(cube, "Segment", ["All Segments"]), ids(cube, "Measure", ["Quantity"])]
    return shown(cube, rollup.consolidate(cube.cells, cube.dimensions, region), "Period")


@query("rollup_geo_time", f"WITH {FACTS}, {GEO}, {PERIOD} SELECT g AS geo, p AS period, {B('sum(gross)')} AS v4 FROM facts JOIN geo ON geo = geo.leaf JOIN per ON period = per.leaf GROUP BY g, p HAVING sum(gross) <> 0")
def rollup_geo_time(spark, sf_dir):
    cube = ex.sales(spark, sf_dir)
    region = [all_of(cube, "Geo"), all_of(cube, "Period"), ids(cube, "Segment", ["All Segments"]), ids(cube, "Measure", ["Gross"])]
    return shown(cube, rollup.consolidate(cube.cells, cube.dimensions, region), "Geo", "Period")


@query("rollup_all_ancestors", f"WITH {FACTS}, {GEO}, {PERIOD}, seg AS (SELECT DISTINCT c_mktsegment AS leaf, c_mktsegment AS s FROM customer UNION ALL SELECT DISTINCT c_mktsegment, 'All Segments' FROM customer) SELECT g AS geo, p AS period, s AS segment, {B('sum(qty)')} AS v4 FROM facts JOIN geo ON facts.geo = geo.leaf JOIN per ON period = per.leaf JOIN seg ON segment = seg.leaf GROUP BY g, p, s HAVING sum(qty) <> 0")
def rollup_all_ancestors(spark, sf_dir):
    cube = ex.sales(spark, sf_dir)
    region = [all_of(cube, "Geo"), all_of(cube, "Period"), all_of(cube, "Segment"), ids(cube, "Measure", ["Quantity"])]
    return shown(cube, rollup.consolidate(cube.cells, cube.dimensions, region), "Geo", "Period", "Segment")


@query("weighted_variance", f"WITH {FACTS} SELECT geo, {B('sum(gross - disc)')} AS v4 FROM facts GROUP BY geo HAVING sum(gross - disc) <> 0")
def weighted_variance(spark, sf_dir):
    cube = ex.sales(spark, sf_dir)
    region = [all_of(cube, "Geo", ["leaf"]), ids(cube, "Period", ["All Years"]), ids(cube, "Segment", ["All Segments"]), ids(cube, "Measure", ["Variance"])]
    return shown(cube, rollup.consolidate(cube.cells, cube.dimensions, region), "Geo")


@query("alternate_rollup", f"SELECT 'brand ' || p_brand AS part, {B('sum(CAST(ROUND(p_retailprice * 10000) AS BIGINT))')} AS v4 FROM part GROUP BY p_brand UNION ALL SELECT 'type ' || p_type, {B('sum(CAST(ROUND(p_retailprice * 10000) AS BIGINT))')} FROM part GROUP BY p_type")
def alternate_rollup(spark, sf_dir):
    cube = ex.parts(spark, sf_dir)
    d = cube.dimension("Part")
    mid = [m.id for m in d if m.kind == "consolidated" and m.name != "All Parts"]
    return shown(cube, rollup.consolidate(cube.cells, cube.dimensions, [mid, ids(cube, "Measure", ["Retail"])]), "Part")


@query("diamond_rollup", f"SELECT 'Retail' AS measure, {B('sum(CAST(ROUND(p_retailprice * 10000) AS BIGINT))')} AS v4 FROM part UNION ALL SELECT 'Count', {B('count(*) * 10000')} FROM part")
def diamond_rollup(spark, sf_dir):
    cube = ex.parts(spark, sf_dir)
    return shown(cube, rollup.consolidate(cube.cells, cube.dimensions, [ids(cube, "Part", ["All Parts"]), all_of(cube, "Measure")]), "Measure")


@query("closure_large", f"WITH pair AS (SELECT DISTINCT p_brand AS b, p_type AS t, p_brand || '/' || p_type AS leaf FROM part) SELECT anc AS ancestor, leaf, {B('1')} AS weight FROM (SELECT leaf, leaf AS anc FROM pair UNION ALL SELECT leaf, 'brand ' || b FROM pair UNION ALL SELECT leaf, 'type ' || t FROM pair UNION ALL SELECT leaf, 'All Parts' FROM pair)")
def closure_large(spark, sf_dir):
    """All ancestors' leaves over a diamond, level by level as frames."""
    d = ex.parts(spark, sf_dir).dimension("Part")
    m = member_frame(spark, d)
    found = rollup.large_closure(spark, edge_frame(spark, d), m.where("kind = 'leaf'").select("id"), m.select("id"))
    n = m.select("id", "name")
    return found.join(n.withColumnsRenamed({"id": "ancestor", "name": "a"}), "ancestor").join(n.withColumnsRenamed({"id": "leaf", "name": "l"}), "leaf").select(F.col("a").alias("ancestor"), F.col("l").alias("leaf"), "weight")


@query("cell_counts", f"WITH {FACTS} SELECT {B('count(*) FILTER (WHERE qty <> 0) + count(*) FILTER (WHERE gross <> 0) + count(*) FILTER (WHERE disc <> 0)')} AS cells, {B('count(DISTINCT geo)')} AS nations FROM facts")
def cell_counts(spark, sf_dir):
    return ex.sales(spark, sf_dir).cells.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("d0").alias("nations"))


# Views

_REGIONS_VIEW = "regions_v AS (SELECT r_name AS region, row_number() OVER (ORDER BY r_regionkey) - 1 AS r FROM region)"


def _region_view(cube: Cube, measures=("Gross", "Discount"), **kw) -> views.View:
    d = cube.dimension("Geo")
    rows = names_of(cube, "Geo", [m.id for m in d if m.kind == "consolidated" and m.name != "World"])
    return views.View((views.Axis("Geo", rows),), (views.Axis("Measure", tuple(measures)),), (("Period", "All Years"), ("Segment", "All Segments")), **kw)


@query("view_explicit_members", f"WITH {FACTS}, {_REGIONS_VIEW} SELECT {B('r')} AS r, {B('c')} AS c, {B('coalesce(sum(CASE WHEN c = 0 THEN gross ELSE disc END), 0)')} AS v4 FROM regions_v CROSS JOIN (VALUES (0), (1)) AS m(c) LEFT JOIN facts ON facts.region = regions_v.region GROUP BY r, c")
def view_explicit_members(spark, sf_dir):
    cube = ex.sales(spark, sf_dir)
    return grid_frame(cube, _region_view(cube)).withColumnRenamed("v", "v4")


@query("view_nested_rows", f"WITH {FACTS}, seg AS (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY c_mktsegment) - 1 AS j FROM (SELECT DISTINCT c_mktsegment FROM customer)), {_REGIONS_VIEW} SELECT {B('r * (SELECT count(*) FROM seg) + j')} AS r, {B('0')} AS c, {B('coalesce(sum(gross), 0)')} AS v4 FROM regions_v CROSS JOIN seg LEFT JOIN facts ON facts.region = regions_v.region AND segment = s GROUP BY r, j")
def view_nested_rows(spark, sf_dir):
    cube = ex.sales(spark, sf_dir)
    segments = names_of(cube, "Segment", all_of(cube, "Segment", ["leaf"]))
    base = _region_view(cube)
    view = views.View((*base.rows, views.Axis("Segment", segments)), (views.Axis("Measure", ("Gross",)),), (("Period", "All Years"),))
    return grid_frame(cube, view).withColumnRenamed("v", "v4")


@query("view_context", f"WITH {FACTS} SELECT {B('0')} AS r, {B('0')} AS c, {B('coalesce(sum(gross), 0)')} AS v4 FROM facts WHERE yr = '1997'")
def view_context(spark, sf_dir):
    cube = ex.sales(spark, sf_dir)
    view = views.View((), (), (("Geo", "World"), ("Period", "1997"), ("Segment", "All Segments"), ("Measure", "Gross")))
    return grid_frame(cube, view).withColumnRenamed("v", "v4")


_SPARSE = f"WITH {FACTS}, n AS (SELECT n_name AS g, n_nationkey AS r FROM nation), m AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS c FROM (SELECT DISTINCT period AS p FROM facts WHERE yr = '1995')), s AS (SELECT min(c_mktsegment) AS s FROM customer), grid AS (SELECT r, c, {B('coalesce(sum(CASE WHEN facts.geo < ' + chr(39) + 'NATION_15' + chr(39) + ' THEN disc END), 0)')} AS v4 FROM n CROSS JOIN m LEFT JOIN facts ON facts.geo = g AND period = p AND segment = (SELECT s FROM s) GROUP BY r, c)"


def _sparse(spark, sf_dir) -> tuple[Cube, views.View]:
    """Some nations without cells, by months of 1995 and one segment."""
    cube = ex.sales(spark, sf_dir)
    d = cube.dimension("Geo")
    gone = [m.id for m in d if m.kind == "leaf" and not m.name < "NATION_15"]
    cube = replace(cube, cells=cube.cells.where(~F.col("d0").isin(gone)) if gone else cube.cells)
    months = [m.name for m in cube.dimension("Period") if m.kind == "leaf" and m.name.startswith("1995-")]
    rows = names_of(cube, "Geo", all_of(cube, "Geo", ["leaf"]))
    segment = cube.dimension("Segment").members[cube.dimension("Segment").order[0]].name
    return cube, views.View((views.Axis("Geo", rows),), (views.Axis("Period", tuple(months)),), (("Segment", segment), ("Measure", "Discount")))


@query("suppress_rows", f"{_SPARSE} SELECT {B('r')} AS r, {B('c')} AS c, v4 FROM grid WHERE r IN (SELECT r FROM grid WHERE v4 <> 0)")
def suppress_rows(spark, sf_dir):
    return grid_frame(*_sparse(spark, sf_dir), rows=True).withColumnRenamed("v", "v4")


@query("suppress_columns", f"{_SPARSE} SELECT {B('r')} AS r, {B('c')} AS c, v4 FROM grid WHERE c IN (SELECT c FROM grid WHERE v4 <> 0)")
def suppress_columns(spark, sf_dir):
    return grid_frame(*_sparse(spark, sf_dir), columns=True).withColumnRenamed("v", "v4")


@query("suppress_both", f"{_SPARSE} SELECT {B('r')} AS r, {B('c')} AS c, v4 FROM grid WHERE r IN (SELECT r FROM grid WHERE v4 <> 0) AND c IN (SELECT c FROM grid WHERE v4 <> 0)")
def suppress_both(spark, sf_dir):
    return grid_frame(*_sparse(spark, sf_dir), rows=True, columns=True).withColumnRenamed("v", "v4")


# MDX sets and queries

_MEMBERS = "geo_m AS (SELECT n_nationkey AS i, n_name AS name, n_nationkey AS k, r_name AS home FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 25 + row_number() OVER (ORDER BY r_regionkey) - 1, r_name, NULL, NULL FROM region UNION ALL SELECT 30, 'World', NULL, NULL)"


def set_query(name: str, text: str, sql: str) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        return sets.frame(spark, ex.geo(spark, sf_dir), mdx.parse_set(text)).select("pos", "name")


set_query("mdx_members", "[Geo].Members", f"WITH {_MEMBERS} SELECT {B('i')} AS pos, name FROM geo_m")
set_query("mdx_children", "[Geo].[World].Children", f"SELECT {B('row_number() OVER (ORDER BY r_regionkey) - 1')} AS pos, r_name AS name FROM region")
set_query("mdx_descendants", "Descendants([Geo].[World])", f"SELECT {B('row_number() OVER (ORDER BY k, j) - 1')} AS pos, name FROM (SELECT -1 AS k, -1 AS j, 'World' AS name UNION ALL SELECT r_regionkey, -1, r_name FROM region UNION ALL SELECT n_regionkey, n_nationkey, n_name FROM nation)")
set_query("mdx_set_literal", "{[Geo].[N3], [Geo].[World], [Geo].[N3], [Geo].[N1]}", "SELECT CASE n_nationkey WHEN 3 THEN 0::BIGINT ELSE 2::BIGINT END AS pos, n_name AS name FROM nation WHERE n_nationkey IN (1, 3) UNION ALL SELECT 1, 'World'")
set_query("mdx_filter_numeric", 'Filter([Geo].Members, [Geo].Properties("Key") >= 7 AND [Geo].Properties("Key") < 19)', f"WITH {_MEMBERS} SELECT {B('i')} AS pos, name FROM geo_m WHERE k >= 7 AND k < 19")
set_query("mdx_filter_text", 'Filter([Geo].Members, [Geo].Properties("Home") <> "ASIA")', f"WITH {_MEMBERS} SELECT {B('i')} AS pos, name FROM geo_m WHERE coalesce(home <> 'ASIA', false)")
set_query("mdx_filter_not_missing", 'Filter([Geo].Members, NOT [Geo].Properties("Key") < 20)', f"WITH {_MEMBERS} SELECT {B('i')} AS pos, name FROM geo_m WHERE NOT coalesce(k < 20, false)")
set_query("mdx_order_asc", 'Order([Geo].Members, "Home")', f"WITH {_MEMBERS} SELECT {B('row_number() OVER (ORDER BY home ASC NULLS FIRST, i) - 1')} AS pos, name FROM geo_m")
set_query("mdx_order_desc", 'Order([Geo].Members, "Key", DESC)', f"WITH {_MEMBERS} SELECT {B('row_number() OVER (ORDER BY k DESC NULLS LAST, i) - 1')} AS pos, name FROM geo_m")


@query("mdx_select_where", f"WITH {FACTS}, {GEO}, g AS (SELECT DISTINCT g FROM geo), o AS (WITH {_MEMBERS} SELECT i, name FROM geo_m) SELECT {B('i')} AS r, {B('0')} AS c, g.g AS geo, {B('coalesce(sum(gross), 0)')} AS v4 FROM g JOIN o ON o.name = g.g LEFT JOIN geo ON geo.g = g.g LEFT JOIN facts ON facts.geo = leaf GROUP BY ALL")
def mdx_select_where(spark, sf_dir):
    """The flagship query: all members of a hierarchy by one measure."""
    cube = ex.sales(spark, sf_dir)
    text = "SELECT {[Measure].[Gross]} ON COLUMNS, [Geo].Members ON ROWS FROM [Sales] WHERE ([Period].[All Years], [Segment].[All Segments])"
    view = views.view_of(cube, mdx.parse_query(text))
    return views.long_form(cube, view, grid_frame(cube, view)).select("r", "c", F.col("Geo").alias("geo"), F.col("v").alias("v4"))


@query("mdx_crossjoin3", f"WITH {FACTS}, ys AS (SELECT DISTINCT yr FROM facts), y AS (SELECT yr, row_number() OVER (ORDER BY yr) - 1 AS i, count(*) OVER () AS n FROM ys), seg AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS j, count(*) OVER () AS n FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)), {_REGIONS_VIEW} SELECT {B('(regions_v.r * max(y.n) + y.i) * max(seg.n) + j')} AS r, {B('0')} AS c, {B('coalesce(sum(qty), 0)')} AS v4 FROM regions_v CROSS JOIN y CROSS JOIN seg LEFT JOIN facts ON facts.region = regions_v.region AND facts.yr = y.yr AND segment = s GROUP BY regions_v.r, y.i, j")
def mdx_crossjoin3(spark, sf_dir):
    cube = ex.sales(spark, sf_dir)
    text = "SELECT {[Measure].[Quantity]} ON COLUMNS, [Geo].[World].Children * [Period].[All Years].Children * [Segment].[All Segments].Children ON ROWS FROM [Sales]"
    return grid_frame(cube, views.view_of(cube, mdx.parse_query(text))).withColumnRenamed("v", "v4")


# Rules

NET = "['Measure':'Net'] = value['Measure':'Gross'] - value['Measure':'Discount'];"
TAX = "['Measure':'Tax'] = value['Measure':'Gross'] * 0.0725;"
PRICE = "['Measure':'Price'] = IF value['Measure':'Quantity'] = 0 THEN 0 ELSE value['Measure':'Gross'] / value['Measure':'Quantity'];"
BAND = "['Measure':'Band'] = IF value['Measure':'Quantity'] > 500 AND NOT value['Measure':'Discount'] > 30000 THEN 2 ELSE IF value['Measure':'Quantity'] > 100 THEN 1;"


def leaf_rule(cube: Cube, measure: str) -> DataFrame:
    region = [*(all_of(cube, d, ["leaf"]) for d in ("Geo", "Period", "Segment")), ids(cube, "Measure", [measure])]
    return shown(cube, Evaluator({cube.name: cube}).values(cube.name, region), "Geo", "Period", "Segment")


def half_even(num: str, den: str) -> str:
    """SQL for num / den of integers, half to even (both positive)."""
    q, r = f"(CAST({num} AS HUGEINT) // ({den}))", f"(CAST({num} AS HUGEINT) % ({den}))"
    return f"CAST({q} + CASE WHEN 2 * {r} > ({den}) OR (2 * {r} = ({den}) AND {q} % 2 <> 0) THEN 1 ELSE 0 END AS BIGINT)"


@query("rule_leaf", f"WITH {FACTS} SELECT geo, period, segment, gross - disc AS v4 FROM facts WHERE gross - disc <> 0")
def rule_leaf(spark, sf_dir):
    return leaf_rule(ex.sales(spark, sf_dir, NET), "Net")


@query("rule_mul_half_even", f"WITH {FACTS} SELECT * FROM (SELECT geo, period, segment, {half_even('gross::HUGEINT * 725', '10000')} AS v4 FROM facts) WHERE v4 <> 0")
def rule_mul_half_even(spark, sf_dir):
    return leaf_rule(ex.sales(spark, sf_dir, TAX), "Tax")


@query("rule_div_half_even", f"WITH {FACTS} SELECT * FROM (SELECT geo, period, segment, {half_even('gross::HUGEINT * 10000', 'qty')} AS v4 FROM facts WHERE qty <> 0) WHERE v4 <> 0")
def rule_div_half_even(spark, sf_dir):
    return leaf_rule(ex.sales(spark, sf_dir, PRICE), "Price")


@query("rule_if_else", f"WITH {FACTS} SELECT * FROM (SELECT geo, period, segment, {B('CASE WHEN qty > 5000000 AND NOT disc > 300000000 THEN 20000 WHEN qty > 1000000 THEN 10000 ELSE 0 END')} AS v4 FROM facts) WHERE v4 <> 0")
def rule_if_else(spark, sf_dir):
    return leaf_rule(ex.sales(spark, sf_dir, BAND), "Band")


@query("rule_rollup_of_rule", f"WITH {FACTS}, {GEO} SELECT g AS geo, {B('sum(v)')} AS v4 FROM (SELECT geo, {half_even('gross::HUGEINT * 725', '10000')} AS v FROM facts) f JOIN geo ON f.geo = leaf GROUP BY g HAVING sum(v) <> 0")
def rule_rollup_of_rule(spark, sf_dir):
    cube = ex.sales(spark, sf_dir, TAX)
    region = [all_of(cube, "Geo"), ids(cube, "Period", ["All Years"]), ids(cube, "Segment", ["All Segments"]), ids(cube, "Measure", ["Tax"])]
    return shown(cube, Evaluator({"Sales": cube}).values("Sales", region), "Geo")


@query("rule_override", f"WITH {FACTS}, {GEO} SELECT g AS geo, {B('CASE WHEN g = ' + chr(39) + 'ASIA' + chr(39) + ' THEN 420000 ELSE sum(gross) END')} AS v4 FROM facts JOIN geo ON facts.geo = leaf GROUP BY g")
def rule_override(spark, sf_dir):
    """A rule on a consolidated member replaces its total only: World still sums the nations."""
    cube = ex.sales(spark, sf_dir, "['Geo':'ASIA', 'Period':'All Years', 'Segment':'All Segments', 'Measure':'Gross'] = 42;")
    region = [all_of(cube, "Geo"), ids(cube, "Period", ["All Years"]), ids(cube, "Segment", ["All Segments"]), ids(cube, "Measure", ["Gross"])]
    return shown(cube, Evaluator({"Sales": cube}).values("Sales", region), "Geo")


@query("rule_first_match", f"WITH {FACTS} SELECT * FROM (SELECT geo, period, segment, CASE WHEN yr = '1996' THEN disc ELSE gross END AS v4 FROM facts) WHERE v4 <> 0")
def rule_first_match(spark, sf_dir):
    rules = "['Measure':'Net', 'Period':{descendants of '1996'}] = value['Measure':'Discount'];\n['Measure':'Net'] = value['Measure':'Gross'];"
    return leaf_rule(ex.sales(spark, sf_dir, rules), "Net")


@query("rule_attrnum", f"WITH {FACTS}, n AS (SELECT n_name, n_nationkey AS k FROM nation) SELECT * FROM (SELECT geo, period, segment, {half_even('qty::HUGEINT * k * 10000', '10000')} AS v4 FROM facts JOIN n ON n_name = geo) WHERE v4 <> 0")
def rule_attrnum(spark, sf_dir):
    rules = "['Measure':'Scored'] = value['Measure':'Quantity'] * AttrNum('Geo', 'Key');"
    return leaf_rule(ex.sales(spark, sf_dir, rules), "Scored")


@query("rule_area_predicate", f"WITH {FACTS}, n AS (SELECT n_name, n_nationkey AS k FROM nation) SELECT geo, period, segment, gross AS v4 FROM facts JOIN n ON n_name = geo WHERE k < 5 AND gross <> 0")
def rule_area_predicate(spark, sf_dir):
    rules = "['Measure':'Net', 'Geo':@'Key' < 5] = value['Measure':'Gross'];"
    return leaf_rule(ex.sales(spark, sf_dir, rules), "Net")


@query("rule_cross_cube", f"WITH {FACTS}, w AS (SELECT {B('sum(gross)')} AS w FROM facts) SELECT n_name AS geo, 'World Gross' AS metric, w AS v4 FROM nation, w")
def rule_cross_cube(spark, sf_dir):
    sales = ex.sales(spark, sf_dir)
    targets = ex.targets(spark, sf_dir, "['Metric':'World Gross'] = 'Sales'!['Geo':'World', 'Period':'All Years', 'Segment':'All Segments', 'Measure':'Gross'];")
    region = [all_of(targets, "Geo", ["leaf"]), ids(targets, "Metric", ["World Gross"])]
    return shown(targets, Evaluator({"Sales": sales, "Targets": targets}).values("Targets", region), "Geo", "Metric")


@query("rule_chained", f"WITH {FACTS} SELECT * FROM (SELECT geo, period, segment, {half_even('(gross - disc)::HUGEINT * 725', '10000')} AS v4 FROM facts) WHERE v4 <> 0")
def rule_chained(spark, sf_dir):
    rules = NET + "\n['Measure':'Tax'] = value['Measure':'Net'] * 0.0725;"
    return leaf_rule(ex.sales(spark, sf_dir, rules), "Tax")


@query("feeders_inferred", f"WITH {FACTS} SELECT geo, period, segment FROM facts WHERE gross <> 0 OR disc <> 0")
def feeders_inferred(spark, sf_dir):
    cube = ex.sales(spark, sf_dir, NET)
    fed = feeders.infer({"Sales": cube}, "Sales").fed
    return with_names(cube, fed).select(F.col("Geo").alias("geo"), F.col("Period").alias("period"), F.col("Segment").alias("segment"))


_THIN = "['Measure':'Scored'] = IF value['Measure':'Quantity'] > 100 THEN value['Measure':'Discount'];"


@query("feeders_under", "SELECT CAST(NULL AS VARCHAR) AS geo, CAST(NULL AS VARCHAR) AS period, CAST(NULL AS VARCHAR) AS segment WHERE false")
def feeders_under(spark, sf_dir):
    cube = ex.sales(spark, sf_dir, _THIN)
    return with_names(cube, feeders.validate({"Sales": cube}, "Sales").under).select(F.col("Geo").alias("geo"), F.col("Period").alias("period"), F.col("Segment").alias("segment"))


@query("feeders_over", f"WITH {FACTS} SELECT geo, period, segment FROM facts WHERE (qty <> 0 OR disc <> 0) AND NOT (qty > 1000000 AND disc <> 0)")
def feeders_over(spark, sf_dir):
    cube = ex.sales(spark, sf_dir, _THIN)
    return with_names(cube, feeders.validate({"Sales": cube}, "Sales").over).select(F.col("Geo").alias("geo"), F.col("Period").alias("period"), F.col("Segment").alias("segment"))


@query("consolidate_fed", f"WITH {FACTS}, {GEO} SELECT g AS geo, {B('sum(gross - disc)')} AS v4 FROM facts JOIN geo ON facts.geo = leaf GROUP BY g HAVING sum(gross - disc) <> 0")
def consolidate_fed(spark, sf_dir):
    cube = ex.sales(spark, sf_dir, NET)
    fed = feeders.infer({"Sales": cube}, "Sales").fed
    leaves = [all_of(cube, d.name, ["leaf"]) for d in cube.dimensions]
    values = Evaluator({"Sales": cube}).values("Sales", leaves).select(*cube.keys, "v")
    region = [all_of(cube, "Geo"), ids(cube, "Period", ["All Years"]), ids(cube, "Segment", ["All Segments"]), ids(cube, "Measure", ["Net"])]
    return shown(cube, rollup.consolidate_fed(cube, fed, values, region), "Geo")


@query("explain_contributions", f"WITH {FACTS} SELECT geo, period, segment, {B('1')} AS weight, gross AS v4 FROM facts WHERE region = 'ASIA' AND yr = '1996' AND gross <> 0")
def explain_contributions(spark, sf_dir):
    cube = ex.sales(spark, sf_dir)
    at = [cube.dimension("Geo").exact("ASIA"), cube.dimension("Period").exact("1996"), cube.dimension("Segment").exact("All Segments"), cube.dimension("Measure").exact("Gross")]
    out = with_names(cube, provenance.contributions(Evaluator({"Sales": cube}), "Sales", at))
    return out.select(F.col("Geo").alias("geo"), F.col("Period").alias("period"), F.col("Segment").alias("segment"), "weight", F.col("v").alias("v4"))


# Spreading


def spread_query(name: str, method: str, value: int, sql: str) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        cube = ex.targets(spark, sf_dir)
        target = [cube.dimension("Geo").exact("World"), cube.dimension("Metric").exact("Target")]
        out = spread.spread(cube, target, value, method)
        return with_names(cube, out).select(F.col("Geo").alias("geo"), "ord", F.col("v").alias("v4"))


_BASIS = "b AS (SELECT n_name AS geo, n_nationkey AS ord, CAST(coalesce(sum(CAST(ROUND(c_acctbal * 10000) AS BIGINT)), 0) AS HUGEINT) AS w FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)"
spread_query("spread_equal", "equal", 10_000_003, f"SELECT n_name AS geo, {B('n_nationkey')} AS ord, {B('10000003 // 25 + CASE WHEN n_nationkey < 10000003 % 25 THEN 1 ELSE 0 END')} AS v4 FROM nation")
spread_query("spread_proportional", "proportional", 123_456_789, f"WITH {_BASIS}, t AS (SELECT sum(w) AS t FROM b), s AS (SELECT geo, ord, CAST(123456789::HUGEINT * w // t AS BIGINT) AS v FROM b, t), l AS (SELECT 123456789 - sum(v) AS l FROM s) SELECT geo, {B('ord')} AS ord, {B('v + CASE WHEN ord < l THEN 1 ELSE 0 END')} AS v4 FROM s, l")
spread_query("spread_repeat", "repeat", 77_000, f"SELECT n_name AS geo, {B('n_nationkey')} AS ord, {B('77000')} AS v4 FROM nation")
spread_query("spread_clear", "clear", 1, f"SELECT n_name AS geo, {B('n_nationkey')} AS ord, {B('0')} AS v4 FROM nation")


# Sandboxes


def _boxed(spark, sf_dir) -> Cube:
    """Overrides for all nations' targets: nothing for keys divisible by 4, else 1000 a key."""
    cube = ex.targets(spark, sf_dir)
    d = cube.dimension("Geo")
    metric = cube.dimension("Metric").exact("Target")
    rows = [(m.id, metric, 0 if k // fixed.SCALE % 4 == 0 else k // fixed.SCALE * 1000 * fixed.SCALE) for m in d if isinstance(k := d.attribute(m.id, "Key"), int) and k // fixed.SCALE % 2 == 0]
    return replace(cube, sandboxes={"plan": local_frame(spark, rows, "d0 int, d1 int, v bigint")})


_BOX = f"WITH {_BASIS}, o AS (SELECT geo, ord, CASE WHEN ord % 4 = 0 THEN 0 WHEN ord % 2 = 0 THEN ord * 10000000 ELSE w END AS v FROM b)"


@query("sandbox_read", f"{_BOX} SELECT geo, {B('v')} AS v4 FROM o WHERE v <> 0")
def sandbox_read(spark, sf_dir):
    cube = _boxed(spark, sf_dir)
    return shown(cube, overlay.overlaid(cube, "plan"), "Geo")


@query("sandbox_rollup", f"{_BOX}, {GEO} SELECT g AS geo, {B('sum(v)')} AS v4 FROM o JOIN geo ON o.geo = leaf GROUP BY g HAVING sum(v) <> 0")
def sandbox_rollup(spark, sf_dir):
    cube = _boxed(spark, sf_dir)
    e = Evaluator({"Targets": cube}, sandbox="plan", target="Targets")
    return shown(cube, e.values("Targets", [all_of(cube, "Geo"), ids(cube, "Metric", ["Target"])]), "Geo")


@query("sandbox_commit", f"{_BOX} SELECT geo, {B('v')} AS v4 FROM o WHERE v <> 0")
def sandbox_commit(spark, sf_dir):
    cube = overlay.commit(_boxed(spark, sf_dir), "plan")
    return shown(cube, cube.cells, "Geo")


@query("sandbox_flags", "SELECT n_name AS geo, n_nationkey % 2 = 0 AS overlaid FROM nation")
def sandbox_flags(spark, sf_dir):
    cube = _boxed(spark, sf_dir)
    metric = cube.dimension("Metric").exact("Target")
    asked = local_frame(spark, [(m, metric) for m in all_of(cube, "Geo", ["leaf"])], "d0 int, d1 int")
    return with_names(cube, overlay.flags(cube, "plan", asked)).select(F.col("Geo").alias("geo"), "overlaid")


# Access


def _mask(cube: Cube) -> masks.Mask:
    return masks.Mask({0: ids(cube, "Geo", ["N3", "N8"])})


@query("mask_axis", f"WITH {GEO}, {_MEMBERS}, bad AS (SELECT DISTINCT g FROM geo JOIN nation ON leaf = n_name WHERE n_nationkey IN (3, 8)) SELECT name AS geo FROM geo_m WHERE name NOT IN (SELECT g FROM bad)")
def mask_axis(spark, sf_dir):
    cube = ex.targets(spark, sf_dir)
    gone = _mask(cube).tainted(0, cube.dimensions[0])
    denied = local_frame(spark, [(m,) for m in gone], "id int")
    return member_frame(spark, cube.dimensions[0]).join(F.broadcast(denied), "id", "left_anti").select(F.col("name").alias("geo"))


@query("mask_rollup", f"WITH {_BASIS}, {GEO}, bad AS (SELECT DISTINCT g FROM geo JOIN nation ON leaf = n_name WHERE n_nationkey IN (3, 8)) SELECT g AS geo, {B('sum(w)')} AS v4 FROM b JOIN geo ON b.geo = leaf WHERE g NOT IN (SELECT g FROM bad) GROUP BY g HAVING sum(w) <> 0")
def mask_rollup(spark, sf_dir):
    cube = ex.targets(spark, sf_dir)
    e = Evaluator({"Targets": cube}, mask=_mask(cube), strict=True, target="Targets")
    return shown(cube, e.values("Targets", [all_of(cube, "Geo"), ids(cube, "Metric", ["Target"])]), "Geo")


# Writes and imports


@query("batch_last_write_wins", f"SELECT n_name AS geo, {B('max_by(CAST(ROUND(c_acctbal * 10000) AS BIGINT), c_custkey)')} AS v4 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING max_by(CAST(ROUND(c_acctbal * 10000) AS BIGINT), c_custkey) <> 0")
def batch_last_write_wins(spark, sf_dir):
    cube = ex.targets(spark, sf_dir)
    names = member_frame(spark, cube.dimensions[0]).select(F.col("id").alias("d0"), F.col("name").alias("n_name"))
    rows = ex.table(spark, sf_dir, "customer").join(F.broadcast(ex.table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(names), "n_name")
    batch = rows.select("d0", F.lit(cube.dimension("Metric").exact("Target")).alias("d1"), fixed.scaled(F.col("c_acctbal")).alias("v"), F.col("c_custkey").alias("ord"))
    out = writes.write_cells(cube, batch)
    return shown(out, out.cells, "Geo")


@query("csv_import", f"SELECT e AS kind, {B('max_by(CAST(ROUND(value * 10000) AS BIGINT), event_id)')} AS v4 FROM (SELECT event_type AS e, value, event_id FROM events) GROUP BY e HAVING max_by(CAST(ROUND(value * 10000) AS BIGINT), event_id) <> 0")
def csv_import(spark, sf_dir):
    """CSV files: members are made, and the last row of a coordinate wins."""
    from .dimension import Dimension
    from .engine import Engine

    engine = Engine(spark)
    kind, metric = Dimension("Kind"), Dimension("Metric")
    metric.add("Value")
    engine.create_cube("Events", [kind, metric])
    path = scratch_path(spark, "events")
    ex.table(spark, sf_dir, "events").select("event_id", "event_type", F.format_string("%.4f", "value").alias("value")).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    rows = readers.read_csv(spark, path)
    cube = import_rows(engine, "Events", rows.withColumn("n", F.col("event_id").cast("bigint")), {"Kind": "event_type"}, "value", {"Metric": "Value"}, "n")
    return with_names(cube, cube.cells).select(F.col("Kind").alias("kind"), F.col("v").alias("v4"))


@query("json_import", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def json_import(spark, sf_dir):
    return readers.read_json_column(ex.table(spark, sf_dir, "events"), "props", ["k"]).select("event_id", "k")


# Structure


@query("reorder_remap", f"SELECT CAST(24 - n_nationkey AS INT) AS idx, n_name AS geo, {B('coalesce(sum(CAST(ROUND(c_acctbal * 10000) AS BIGINT)), 0)')} AS v4 FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def reorder_remap(spark, sf_dir):
    """A new order changes places, never cells."""
    cube = ex.targets(spark, sf_dir)
    d = cube.dimensions[0]
    leaves = [m.name for m in d if m.kind == "leaf"]
    out = writes.edited(cube, "Geo", "reorder", [*reversed(leaves), *[m.name for m in d if m.kind != "leaf"]])
    places = member_frame(spark, out.dimensions[0]).where("kind = 'leaf'").select("idx", F.col("id").alias("d0"), F.col("name").alias("geo"))
    return places.join(out.cells, "d0", "left").select("idx", "geo", F.coalesce("v", F.lit(0).cast("bigint")).alias("v4"))


@query("delete_member", f"WITH {_BASIS}, {GEO} SELECT g AS geo, {B('sum(w)')} AS v4 FROM b JOIN geo ON b.geo = leaf WHERE ord <> 3 GROUP BY g HAVING sum(w) <> 0")
def delete_member(spark, sf_dir):
    cube = ex.targets(spark, sf_dir)
    out = writes.edited(cube, "Geo", "delete", cube.dimension("Geo").resolve("N3"))
    return shown(out, rollup.consolidate(out.cells, out.dimensions, [all_of(out, "Geo"), ids(out, "Metric", ["Target"])]), "Geo")


@query("set_kind_clears", f"WITH {_BASIS} SELECT geo, {B('w')} AS v4 FROM b WHERE ord <> 3 AND w <> 0")
def set_kind_clears(spark, sf_dir):
    cube = ex.targets(spark, sf_dir)
    out = writes.edited(cube, "Geo", "set_kind", cube.dimension("Geo").resolve("N3"), "string")
    return shown(out, out.cells, "Geo")


@query("reparent", f"WITH {_BASIS} SELECT r_name AS geo, {B('sum(w)')} AS v4 FROM b JOIN nation ON geo = n_name JOIN region ON r_regionkey = CASE WHEN n_nationkey = 3 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END GROUP BY r_name HAVING sum(w) <> 0")
def reparent(spark, sf_dir):
    cube = ex.targets(spark, sf_dir)
    d = cube.dimension("Geo")
    regions = [m.id for m in d if m.kind == "consolidated" and m.name != "World"]
    child = d.resolve("N3")
    new = regions[(regions.index(d.parents(child)[0]) + 1) % len(regions)]
    out = writes.edited(cube, "Geo", "reparent", child, new)
    return shown(out, rollup.consolidate(out.cells, out.dimensions, [regions, ids(out, "Metric", ["Target"])]), "Geo")


# Jobs, ledger, audit

MILLIS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"


def _ledger(spark, sf_dir) -> DataFrame:
    """Events as a ledger: a run is a user's action kind, its records the events."""
    e = ex.table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("run"), F.col("event_type").alias("job"),
        F.when(F.col("event_id") % 3 == 0, F.lit("succeeded")).otherwise(F.lit("failed")).alias("state"), F.expr(MILLIS).alias("fire_ms"), F.expr(MILLIS).alias("at_ms"), F.lit("").alias("message"),
    )


_L = "l AS (SELECT event_id AS seq, event_type || '-' || CAST(user_id AS VARCHAR) AS run, event_type AS job, CASE WHEN event_id % 3 = 0 THEN 'succeeded' ELSE 'failed' END AS state, epoch_us(ts) // 1000 AS fire_ms FROM events)"


@query("due_jobs", f"WITH {_L}, s AS (SELECT job, max(fire_ms) AS last_ms FROM l WHERE state = 'succeeded' GROUP BY job), j AS (SELECT DISTINCT job FROM l UNION ALL SELECT 'never') SELECT job, 'ops' AS owner, {B('coalesce(last_ms + 86400000, 0)')} AS next_due, job || '@' || CAST(coalesce(last_ms + 86400000, 0) AS VARCHAR) AS run FROM j LEFT JOIN s USING (job) WHERE coalesce(last_ms + 86400000, 0) <= 4102444800000")
def due_jobs(spark, sf_dir):
    log = _ledger(spark, sf_dir)
    names = log.select("job").distinct().union(local_frame(spark, [("never",)], "job string"))
    table = names.select("job", F.lit("ops").alias("owner"), F.lit(86_400_000).cast("bigint").alias("interval_ms"), F.lit(True).alias("enabled"))
    return jobs.due(table, log, 4_102_444_800_000)


@query("latest_runs", f"WITH {_L} SELECT run, {B('max(seq)')} AS seq, max_by(state, seq) AS state FROM l GROUP BY run")
def latest_runs(spark, sf_dir):
    return jobs.latest_runs(_ledger(spark, sf_dir)).select("run", "seq", "state")


@query("recent_runs", f"WITH {_L}, r AS (SELECT run, {B('max_by(fire_ms, seq)')} AS fire_ms FROM l GROUP BY run) SELECT run, fire_ms FROM r ORDER BY fire_ms DESC, run LIMIT 20")
def recent_runs(spark, sf_dir):
    return jobs.recent_runs(_ledger(spark, sf_dir), 20).select("run", "fire_ms")


@query("ledger_retention", f"WITH {_L}, r AS (SELECT run, max_by(job, seq) AS job, max_by(fire_ms, seq) AS f FROM l GROUP BY run), k AS (SELECT run FROM (SELECT run, row_number() OVER (PARTITION BY job ORDER BY f DESC, run DESC) AS n FROM r) WHERE n <= 10) SELECT seq, run FROM l WHERE run IN (SELECT run FROM k)")
def ledger_retention(spark, sf_dir):
    return jobs.retained(_ledger(spark, sf_dir), 10).select("seq", "run")


@query("audit_query", "SELECT event_id AS seq, event_type AS action FROM events WHERE event_type = 'error' ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC LIMIT 50")
def audit_query(spark, sf_dir):
    from .security import audit_query as run

    e = ex.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.expr(MILLIS).alias("at_ms"), F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("action"), F.lit("").alias("object"), F.lit("ok").alias("outcome"))
    return run(e, {"action": "error"}, limit=50).select("seq", "action")


@query("version_changes", "SELECT n_name AS geo, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after FROM (SELECT n_name, coalesce(sum(CAST(ROUND(c_acctbal * 10000) AS BIGINT)), 0) AS before, CASE WHEN n_nationkey < 5 THEN 10000 ELSE coalesce(sum(CAST(ROUND(c_acctbal * 10000) AS BIGINT)), 0) END AS after FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey) WHERE before <> after")
def version_changes(spark, sf_dir):
    old = ex.targets(spark, sf_dir)
    metric = old.dimension("Metric").exact("Target")
    new = writes.write_cells(old, writes.batch(old, [((m, metric), fixed.SCALE) for m in ids(old, "Geo", [f"N{i}" for i in range(5)])]))
    both = old.cells.withColumnRenamed("v", "before").join(new.cells.withColumnRenamed("v", "after"), old.keys, "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return with_names(old, both.select(*old.keys, zero("before"), zero("after")).where("before <> after")).select(F.col("Geo").alias("geo"), "before", "after")


@query("member_search", "SELECT n_name AS name FROM nation WHERE lower(n_name) LIKE '%1%'")
def member_search(spark, sf_dir):
    from .operators.members import search

    return search(member_frame(spark, ex.geo(spark, sf_dir)).where("kind = 'leaf'"), "*1").select("name")


@query("leaves_only", "SELECT n_name AS name FROM nation")
def leaves_only(spark, sf_dir):
    from .operators.members import without_children

    d = ex.geo(spark, sf_dir)
    return without_children(member_frame(spark, d), edge_frame(spark, d)).select("name")


from . import model_queries  # noqa: E402, F401  registers its queries
