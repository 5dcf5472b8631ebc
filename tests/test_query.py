import random
from dataclasses import replace

import pytest

from cubeloom.cube import scaled
from cubeloom.errors import CellError, CubeError, Denied, ParseError, TypeMismatch, UnknownName, Unsupported
from cubeloom.functions import fixed
from cubeloom.mdx import language as mdx
from cubeloom.mdx import sets
from cubeloom.operators import writes
from cubeloom.operators.masks import Mask
from cubeloom.plans import view as views
from cubeloom.plans.regions import Evaluator, subtract
from cubeloom.plans.view import Axis, View
from cubeloom.rules import feeders, language, provenance
from cubeloom.rules.compiled import compile_rules, dependencies
from cubeloom.rules.testing import RuleTest, run

from .fixtures import cube, measure, region, sales


def at(c, names):
    return tuple(d.resolve(n) for d, n in zip(c.dimensions, names))


def read(cubes, name, *names, **kw):
    e = Evaluator(cubes, target=name, **kw)
    rows = e.values(name, [[m] for m in at(cubes[name], names)]).collect()
    return (rows[0]["err"] or fixed.format(rows[0]["v"])) if rows else "0"


# MDX

SETS = {
    "[Region].Members": ["North", "South", "East", "Total"],
    "[Region].[Total].Children": ["North", "South", "East"],
    "Descendants([Region].[Total])": ["Total", "North", "South", "East"],
    "{East, [Region].[North], East}": ["East", "North"],
    "{}": [],
    "Northern": ["North"],
    'Filter([Region].Members, [Region].CurrentMember.Properties("Pop") > 100)': ["North", "East"],
    'Filter([Region].Members, NOT [Region].Properties("Pop") > 100)': ["South", "Total"],
    "Filter([Region].Members, [Region].Properties('Code') = 'N' OR [Region].Properties('Pop') <= 100)": ["North", "South"],
    'Order([Region].Members, "Pop")': ["Total", "South", "East", "North"],
    'Order([Region].Members, "Pop", BDESC)': ["North", "East", "South", "Total"],
}


@pytest.mark.parametrize("text,names", SETS.items())
def test_sets(spark, text, names):
    d = region()
    tree = mdx.parse_set(text)
    assert [d.members[m].name for m in sets.members(d, tree)] == names
    assert [r["name"] for r in sets.frame(spark, d, tree).orderBy("pos").collect()] == names
    assert mdx.parse_set(mdx.show(tree)) == tree or "Properties" in text
    assert mdx.show(mdx.parse_set(mdx.show(tree))) == mdx.show(tree)


@pytest.mark.parametrize("text", ["", "{", "Filter([R].Members)", "[A].", "{a,}", "Order(x)", "a b", "[unclosed", "{" * 200 + "}" * 200])
def test_set_errors(text):
    with pytest.raises(ParseError):
        mdx.parse_set(text)


def test_set_type_errors():
    d = region()
    with pytest.raises(TypeMismatch):
        sets.members(d, mdx.parse_set('Filter([Region].Members, [Region].Properties("Pop") = "x")'))
    with pytest.raises(UnknownName):
        sets.members(d, mdx.parse_set("[Other].[North]"))
    with pytest.raises(UnknownName):
        sets.members(d, mdx.parse_set('Order([Region].Members, "None")'))
    with pytest.raises(Unsupported):
        sets.members(d, mdx.parse_set("Crossjoin(North, South)"))
    # Both sides are looked at, so the error isn't hidden by the left one.
    with pytest.raises(TypeMismatch):
        sets.members(d, mdx.parse_set("Filter([Region].[North], [R].Properties('Pop') < 0 AND [R].Properties('Pop') = 'x')"))


def test_select(spark):
    c = sales(spark)
    out = views.select({"Sales": c}, "SELECT {[Measure].[Sales], [Measure].[Margin]} ON COLUMNS, [Region].[Total].Children ON ROWS FROM [Sales]")
    assert out.rows == [("North",), ("South",), ("East",)] and out.texts() == [["100", "40"], ["200", "50"], ["0", "0"]]
    for bad in ("SELECT FROM [Sales]", "SELECT [Region].Members ON ROWS, [Region].Members ON ROWS FROM [Sales]"):
        with pytest.raises(ParseError):
            views.select({"Sales": c}, bad)
    for bad in ("SELECT [Region].Members ON ROWS FROM [Sales]", "SELECT [Region].Members ON 5, [Measure].[Sales] ON 0 FROM [Sales]", "SELECT {North} ON ROWS, {[Measure].[Sales]} ON COLUMNS FROM [Sales]", "SELECT [Region].Members ON ROWS FROM [Other]"):
        with pytest.raises(CubeError):
            views.select({"Sales": c}, bad)


def test_query_text_round_trip():
    text = views.query_text("A]b", [Axis("R", ("x", "y]"))], [Axis("M", ("s",))], [("P", "q")])
    q = mdx.parse_query(text)
    assert q.cube.segments == ("A]b",) and mdx.parse_query(mdx.show(q)) == q


# Views


def region_rows(*names):
    return (Axis("Region", names or ("North", "South", "East", "Total")),)


def test_suppression(spark):
    c = sales(spark)
    base = View(region_rows(), (Axis("Measure", ("Sales", "Tax", "Cost")),))
    full = views.execute({"Sales": c}, "Sales", base)
    assert len(full.rows) == 4 and len(full.columns) == 3
    rows = views.execute({"Sales": c}, "Sales", replace(base, suppress_rows=True))
    assert [r[0] for r in rows.rows] == ["North", "South", "Total"] and rows.suppressed_rows == 1
    both = views.execute({"Sales": c}, "Sales", replace(base, suppress_rows=True, suppress_columns=True))
    assert both.columns == [("Sales",), ("Cost",)] and both.texts() == [["100", "60"], ["200", "150"], ["300", "210"]]
    none = views.execute({"Sales": c}, "Sales", View(region_rows("East"), (Axis("Measure", ("Sales",)),), (), True, True))
    assert none.rows == [] and none.columns == [("Sales",)]


def test_empty_axes_and_coverage(spark):
    c = sales(spark)
    empty = views.execute({"Sales": c}, "Sales", View((Axis("Region", ()),), (Axis("Measure", ("Sales",)),)))
    assert empty.rows == [] and empty.values() == []
    one = views.execute({"Sales": c}, "Sales", View((), (), (("Region", "Total"), ("Measure", "Sales"))))
    assert one.rows == [()] and one.texts() == [["300"]]
    with pytest.raises(CubeError):
        views.execute({"Sales": c}, "Sales", View(region_rows()))
    text = views.execute({"Sales": c}, "Sales", View(region_rows("North"), (Axis("Measure", ("Comment",)),)))
    assert text.texts() == [["0"]]


def test_masks(spark):
    c = sales(spark)
    mask = Mask({0: at(c, ("South", "Sales"))[:1]})
    out = views.execute({"Sales": c}, "Sales", View(region_rows(), (Axis("Measure", ("Sales",)),)), mask=mask)
    assert [r[0] for r in out.rows] == ["North", "East"]
    with pytest.raises(Denied):
        views.execute({"Sales": c}, "Sales", View((), (Axis("Measure", ("Sales",)),), (("Region", "Total"),)), mask=mask)


def test_view_equals_point_reads(spark):
    rules = "['Measure':'Extra'] = value['Measure':'Sales'] * 0.5;\n['Region':'Total', 'Measure':'Tax'] = 7;"
    c = sales(spark, rules)
    view = View(region_rows(), (Axis("Measure", ("Sales", "Extra", "Tax", "Margin")),))
    out = views.execute({"Sales": c}, "Sales", view)
    for r, row in zip(out.rows, out.texts()):
        for m, text in zip(out.columns, row):
            assert read({"Sales": c}, "Sales", r[0], m[0]) == text


# Rules

SOURCES = [
    "['M':'a'] = 1;",
    "['M':{children of 'T'}, 'R':@'Pop' >= -1.5] = -value['M':'b'] * (1 + 2) - 3 / 4;",
    "['M':'it''s'] = IF NOT value > 1 AND ['M':'b'] = 2 OR 1 <> 2 THEN IF 1 = 1 THEN 2 ELSE 3 ELSE 'C'!['x':'y'];",
    "['M':{leaves}] = AttrNum('R', 'Pop') + Undef();",
    "['M':{all}] = 'C'!['x':!'y'] with ('a'->'b');",
]


@pytest.mark.parametrize("source", SOURCES)
def test_rules_print_and_parse(source):
    tree = [(r.area, r.formula) for r in language.parse(source)]
    assert [(r.area, r.formula) for r in language.parse(language.text(language.parse(source)))] == tree


@pytest.mark.parametrize("source", ["[", "['M':'a'] 1;", "['M':'a'] = ;", "['M':'a'] = 1", "['M':'a','M':'b'] = 1;", "['M':{some}] = 1;", "['M':'a'] = IF 1 THEN 2;", "['M':'a'] = " + "(" * 200 + "1" + ")" * 200 + ";", "['M':'a'] = Foo(1);"])
def test_rules_errors(source):
    with pytest.raises(ParseError):
        language.parse(source)


@pytest.mark.parametrize("formula", ["'text'", "Attr('Region','Pop')", "IsLeaf()", "value['Measure':!'Pop']", "'Sales'!['Measure':'Cost'] with ('a'->'b')"])
def test_unsupported_constructs(spark, formula):
    with pytest.raises(Unsupported):
        compile_rules(sales(spark), {"Sales": sales(spark)}, f"['Measure':'Tax'] = {formula};")


def test_errors_have_places():
    with pytest.raises(ParseError) as e:
        language.parse("['M':'a'] = 1;\n['M':'b'] = ?;")
    assert (e.value.line, e.value.column) == (2, 13)


def test_rule_values(spark):
    c = sales(spark, "['Measure':'Extra'] = value['Measure':'Sales'] - value['Measure':'Cost'];")
    cubes = {"Sales": c}
    assert [read(cubes, "Sales", r, "Extra") for r in ("North", "South", "Total")] == ["40", "50", "90"]


def test_consolidated_override_leaves_higher_totals_alone(spark):
    c = sales(spark, "['Region':'Total', 'Measure':'Sales'] = 7;")
    assert read({"Sales": c}, "Sales", "Total", "Sales") == "7"
    assert read({"Sales": c}, "Sales", "North", "Sales") == "100"
    # An omitted dimension means leaves: Total isn't touched.
    d = sales(spark, "['Measure':'Sales'] = 1;")
    assert read({"Sales": d}, "Sales", "North", "Sales") == "1" and read({"Sales": d}, "Sales", "Total", "Sales") == "3"


def test_first_rule_wins_and_beats_stored_and_overlay(spark):
    c = sales(spark, "['Region':'North', 'Measure':'Sales'] = 1;\n['Measure':'Sales'] = 2;")
    cubes = {"Sales": c}
    assert read(cubes, "Sales", "North", "Sales") == "1" and read(cubes, "Sales", "South", "Sales") == "2"
    boxed = replace(c, sandboxes={"b": spark.createDataFrame([(0, 0, 99), (0, 1, 5)], "d0 int, d1 int, v bigint")})
    assert read({"Sales": boxed}, "Sales", "North", "Sales", sandbox="b") == "1"
    assert read({"Sales": boxed}, "Sales", "North", "Cost", sandbox="b") == "0.0005"


def test_lazy_errors(spark):
    c = sales(spark, "['Measure':'Extra'] = IF value['Measure':'Cost'] = 0 THEN 0 ELSE value['Measure':'Sales'] / value['Measure':'Cost'];\n['Measure':'Tax'] = 1 / value['Measure':'Sales'];")
    cubes = {"Sales": c}
    assert read(cubes, "Sales", "North", "Extra") == "1.6667" and read(cubes, "Sales", "East", "Extra") == "0"
    assert read(cubes, "Sales", "East", "Tax") == "division by zero" and read(cubes, "Sales", "North", "Tax") == "0.01"
    assert read(cubes, "Sales", "Total", "Tax") == "division by zero"
    with pytest.raises(CellError):
        views.execute(cubes, "Sales", View(region_rows(), (Axis("Measure", ("Tax",)),)))
    assert views.execute(cubes, "Sales", View(region_rows("North", "South"), (Axis("Measure", ("Tax",)),))).texts() == [["0.01"], ["0.005"]]
    short = sales(spark, "['Measure':'Tax'] = IF 1 = 1 OR 1 / 0 = 1 THEN 3;\n['Measure':'Extra'] = IF 1 = 2 AND 1 / 0 = 1 THEN 3;")
    assert read({"Sales": short}, "Sales", "North", "Tax") == "3" and read({"Sales": short}, "Sales", "North", "Extra") == "0"


def test_cycles_are_errors_only_where_reached(spark):
    c = sales(spark, "['Measure':'Extra'] = IF value['Measure':'Sales'] > 150 THEN 5 ELSE value['Measure':'Tax'];\n['Measure':'Tax'] = value['Measure':'Extra'];")
    cubes = {"Sales": c}
    assert read(cubes, "Sales", "South", "Tax") == "5"
    assert read(cubes, "Sales", "North", "Tax") == "cycle"


def test_overflow_is_an_error(spark):
    c = cube(spark, "Sales", [region(), measure("Sales", "Tax")], [("North", "Sales", 900_000_000_000_000)], "['Measure':'Tax'] = value['Measure':'Sales'] * 10;")
    assert read({"Sales": c}, "Sales", "North", "Tax") == "overflow"


def test_attribute_rules(spark):
    c = sales(spark, "['Measure':'Extra', 'Region':@'Pop' >= 200] = AttrNum('Region', 'Pop');\n['Measure':'Tax', 'Region':@'Code' = 'S'] = 4;\n['Measure':'Cost', 'Region':@'Pop' = 'x'] = 9;")
    cubes = {"Sales": c}
    assert [read(cubes, "Sales", r, "Extra") for r in ("North", "South", "Total")] == ["300", "0", "500"]
    assert read(cubes, "Sales", "South", "Tax") == "4" and read(cubes, "Sales", "North", "Cost") == "60"


def test_cross_cube(spark):
    s = sales(spark, "['Measure':'Extra'] = value['Measure':'Sales'] - value['Measure':'Cost'];")
    n = cube(spark, "Nat", [measure("A", "B")], [], "['Measure':'A'] = 'Sales'!['Region':'Total','Measure':'Extra'];\n['Measure':'B'] = 'Sales'!['Region':'North','Measure':'Extra'];")
    cubes = {"Sales": s, "Nat": n}
    assert read(cubes, "Nat", "A") == "90" and read(cubes, "Nat", "B") == "40"
    assert dependencies(cubes, "Nat") == ["Nat", "Sales"] and dependencies(cubes, "Sales") == ["Sales"]
    with pytest.raises(Unsupported):
        compile_rules(n, cubes, "['Measure':'A'] = 'Sales'!['Measure':'Extra'];")
    with pytest.raises(UnknownName):
        compile_rules(n, cubes, "['Measure':'A'] = 'None'!['Measure':'Extra'];")


def test_subtract_covers_each_coordinate_once():
    rng = random.Random(1)
    for _ in range(200):
        r = tuple(frozenset(rng.sample(range(5), rng.randint(1, 5))) for _ in range(3))
        a = tuple(frozenset(rng.sample(range(5), rng.randint(0, 5))) for _ in range(3))
        every = {(x, y, z) for x in r[0] for y in r[1] for z in r[2]}
        want = {p for p in every if not all(m in s for m, s in zip(p, a))}
        parts = [p for q in subtract(r, a) for p in ((x, y, z) for x in q[0] for y in q[1] for z in q[2])]
        assert len(parts) == len(set(parts)) and set(parts) == want


def test_rules_against_a_recursive_evaluator(spark):
    """Every coordinate of a small model equals a plain per-cell recursion."""
    from cubeloom.rules.compiled import Cell, Constant

    rules = "['Measure':'Extra', 'Region':'East'] = value['Region':'North'] + 1;\n['Measure':'Extra'] = value['Measure':'Sales'] * 0.25 + value['Region':'Total', 'Measure':'Cost'] / 3;\n['Measure':'Tax', 'Region':{all}] = IF value['Measure':'Extra'] > 100 THEN -value['Measure':'Cost'] ELSE 2;"
    c = sales(spark, rules)
    compiled = compile_rules(c, {"Sales": c})
    stored = {(r["d0"], r["d1"]): r["v"] for r in c.cells.collect()}

    def value(p):
        k = compiled.first_match(p)
        if k is not None:
            return expr(compiled.rules[k].formula, p)
        if all(d.kind(m) == "leaf" for d, m in zip(c.dimensions, p)):
            return stored.get(p, 0)
        return sum(wa * wb * value((x, y)) for x, wa in c.dimensions[0].leaf_weights(p[0]).items() for y, wb in c.dimensions[1].leaf_weights(p[1]).items())

    def expr(x, p):
        if isinstance(x, Constant):
            return x.value
        if isinstance(x, Cell):
            return value(tuple(p[i] if q is None else q for i, q in enumerate(x.pins)))
        if isinstance(x, language.Negative):
            return -expr(x.of, p)
        if isinstance(x, language.Choice):
            return expr(x.then, p) if expr(x.condition.left, p) > expr(x.condition.right, p) else expr(x.otherwise, p)
        a, b = expr(x.left, p), expr(x.right, p)
        return a + b if x.op == "+" else a - b if x.op == "-" else fixed.div_half_even(a * b, fixed.SCALE) if x.op == "*" else fixed.div_half_even(a * fixed.SCALE, b)

    rows = Evaluator({"Sales": c}).values("Sales", [list(d.members) for d in c.dimensions]).collect()
    got = {(r["d0"], r["d1"]): r["v"] for r in rows if r["v"]}
    assert all(r["err"] is None for r in rows)
    assert got == {(a, b): v for a in c.dimensions[0].order for b in c.dimensions[1].order if (v := value((a, b)))}


def test_explain(spark):
    c = sales(spark, "['Measure':'Extra'] = IF value['Measure':'Tax'] = 0 THEN value['Measure':'Sales'] - value['Measure':'Cost'];")
    e = Evaluator({"Sales": c})
    t = provenance.explain(e, "Sales", at(c, ("North", "Extra")), 5)
    assert t.source == "rule" and t.value == scaled(40) and [x.value for x in t.inputs] == [scaled(100), scaled(60)]
    total = provenance.explain(e, "Sales", at(c, ("Total", "Sales")))
    assert total.source == "consolidated" and [(x.coordinate[0], x.weight) for x in total.inputs] == [("North", 1), ("South", 1)]
    assert len(provenance.explain(e, "Sales", at(c, ("Total", "Extra")), 32).rows()) == 1 + 2 * 3


def test_feeders(spark):
    rules = "['Measure':'Extra'] = value['Measure':'Sales'] - value['Measure':'Cost'];\n['Measure':'Tax'] = value['Measure':'Extra'] * 2;"
    c = sales(spark, rules)
    fed = feeders.infer({"Sales": c}, "Sales")
    assert {tuple(r) for r in fed.fed.collect()} == {at(c, (r, m)) for r in ("North", "South") for m in ("Extra", "Tax")}
    v = feeders.validate({"Sales": c}, "Sales", fed)
    assert v.counts() == {"fed": 4, "under_fed": 0, "over_fed": 0, "over_fed_bytes": 0}
    n = cube(spark, "Nat", [measure("A")], [], "['Measure':'A'] = 'Sales'!['Region':'Total','Measure':'Extra'];")
    assert feeders.infer({"Sales": c, "Nat": n}, "Nat").opaque == [(0, "reads other cubes only")]
    assert feeders.validate({"Sales": c, "Nat": n}, "Nat").counts()["under_fed"] == 1
    base = sales(spark, "['Measure':'Tax'] = 3;")
    assert feeders.infer({"Sales": base}, "Sales").fed.count() == 3
    over = sales(spark, "['Measure':'Tax'] = value['Measure':'Sales'] - value['Measure':'Sales'];")
    assert feeders.validate({"Sales": over}, "Sales").counts()["over_fed"] == 2


def test_rule_tests(spark):
    c = sales(spark, "['Measure':'Extra'] = value['Measure':'Sales'] * 2;")
    good = RuleTest("t", (({"Region": "Northern", "Measure": "Sales"}, "3"),), (({"Region": "Total", "Measure": "Extra"}, "6"),))
    assert run(c, good) == []
    bad = run(c, replace(good, expectations=(({"Region": "Total", "Measure": "Extra"}, "7"),)))
    assert bad[0].actual == "6"


def test_string_members_never_roll_up(spark):
    c = sales(spark)
    c = writes.set_string(c, c.coordinate({"Region": "North", "Measure": "Comment"}), "x")
    assert read({"Sales": c}, "Sales", "Total", "Comment") == "0"
