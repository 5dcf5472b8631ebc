import random
from dataclasses import replace

import pytest

from cubeloom.cube import Cube, edge_frame, member_frame, scaled
from cubeloom.dimension import CONSOLIDATED, LEAF, STRING, Dimension
from cubeloom.errors import Conflict, CubeError, InvalidEdit, InvalidWrite, LimitExceeded, UnknownName
from cubeloom.operators import members, overlay, rollup, spread, writes
from cubeloom.store import Store

from .fixtures import cube, measure, region, sales, value


def test_consolidation_and_weights(spark):
    c = sales(spark)
    assert value(c, Region="Total", Measure="Sales") == scaled(300)
    assert value(c, Region="North", Measure="Margin") == scaled(40)
    assert value(c, Region="Total", Measure="Margin") == scaled(90)
    assert value(c, Region="East", Measure="Sales") == 0
    assert value(c, Region="Total", Measure="Comment") == 0


def test_diamond_counts_once_with_the_shortest_path():
    d = Dimension("R")
    east, south, north = (d.add(n) for n in ("East", "South", "North"))
    coastal, total = d.add("Coastal", CONSOLIDATED), d.add("Total", CONSOLIDATED)
    d.add_child(coastal, east)
    for m in (east, south, north, coastal):
        d.add_child(total, m, 2 if m == east else 1)
    assert d.leaf_weights(total) == {east: 2, south: 1, north: 1}
    d.edges[coastal, east] = 5
    d._reindex()
    assert d.leaf_weights(total)[east] == 2
    assert d.leaf_weights(coastal) == {east: 5}
    assert d.leaf_weights(east) == {east: 1}


def test_zero_net_weight_is_dropped_and_products_saturate():
    d = Dimension("R")
    a, b, top = d.add("a"), d.add("b", CONSOLIDATED), d.add("top", CONSOLIDATED)
    d.add_child(b, a, 2**62)
    d.add_child(top, b, 4)
    assert d.leaf_weights(top) == {a: 2**63 - 1}
    e = Dimension("S")
    x, t = e.add("x"), e.add("t", CONSOLIDATED)
    e.add_child(t, x, 0)
    assert e.leaf_weights(t) == {}


def test_large_closure_equals_the_driver_search(spark):
    rng = random.Random(3)
    d = Dimension("R")
    leaves = [d.add(f"l{i}") for i in range(8)]
    nodes = list(leaves)
    for i in range(10):
        n = d.add(f"c{i}", CONSOLIDATED)
        for child in rng.sample(nodes, min(3, len(nodes))):
            d.add_child(n, child, rng.choice([1, 2, -1, 3]))
        nodes.append(n)
    m = member_frame(spark, d)
    got = rollup.large_closure(spark, edge_frame(spark, d), m.where("kind = 'leaf'").select("id"), m.select("id"), lambda f: f.persist())
    assert {tuple(r) for r in got.collect()} == set(d.closure(d.members))


def test_random_grid_equals_brute_force(spark):
    rng = random.Random(2024)
    dims = []
    for i in range(2):
        d = Dimension(f"D{i}")
        ids = [d.add(f"m{j}") for j in range(rng.randint(2, 5))]
        t = d.add("Total", CONSOLIDATED)
        for j in ids:
            d.add_child(t, j, rng.choice([1, 1, -2]))
        dims.append(d)
    c = Cube.empty(spark, "G", dims)
    cells = {(i, j): rng.randint(0, 999) for i in dims[0].leaves() for j in dims[1].leaves() if rng.random() < 0.5}
    c = writes.write_cells(c, writes.batch(c, cells.items()))
    rows = rollup.consolidate(c.cells, c.dimensions, [d.order for d in dims]).collect()
    got = {(r["d0"], r["d1"]): r["v"] for r in rows if r["v"]}
    want = {}
    for a in dims[0].order:
        for b in dims[1].order:
            v = sum(wa * wb * cells.get((x, y), 0) for x, wa in dims[0].leaf_weights(a).items() for y, wb in dims[1].leaf_weights(b).items())
            if v:
                want[a, b] = v
    assert got == want


def test_sums_between_joins_change_nothing(spark, monkeypatch):
    c = sales(spark)
    whole = [list(d.members) for d in c.dimensions]
    plain = sorted(map(tuple, rollup.consolidate(c.cells, c.dimensions, whole).collect()))
    monkeypatch.setattr(rollup, "MOST_FANOUT", 0.5)
    assert sorted(map(tuple, rollup.consolidate(c.cells, c.dimensions, whole).collect())) == plain


def test_writes(spark):
    c = sales(spark)
    at = c.coordinate({"Region": "North", "Measure": "Sales"})
    assert writes.set_leaf(c, at, 5).get_leaf(at) == 5
    assert writes.set_leaf(c, at, 0).cells.count() == c.cells.count() - 1
    with pytest.raises(InvalidWrite):
        writes.set_leaf(c, c.coordinate({"Region": "Total", "Measure": "Sales"}), 1)
    with pytest.raises(InvalidWrite):
        writes.set_leaf(c, c.coordinate({"Region": "North", "Measure": "Comment"}), 1)
    with pytest.raises(InvalidWrite):
        writes.write_cells(c, spark.createDataFrame([(3, 0, 1, 0)], "d0 int, d1 int, v bigint, ord int"))
    with pytest.raises(Conflict):
        writes.write_cells(c, writes.batch(c, [(at, 1)]), base=c.version - 1)
    many = writes.write_cells(c, writes.batch(c, [(at, 1), (at, 2), (at, 3)]))
    assert many.get_leaf(at) == 3 and many.version == c.version + 1
    note = c.coordinate({"Region": "North", "Measure": "Comment"})
    s = writes.set_string(c, note, "fine")
    assert s.get_string(note) == "fine" and writes.set_string(s, note, "").get_string(note) is None
    with pytest.raises(InvalidWrite):
        writes.set_string(c, at, "x")
    with pytest.raises(CubeError):
        c.coordinate({"Region": "North"})
    with pytest.raises(UnknownName):
        c.coordinate({"Region": "Northern", "Measure": "Sales"})  # no aliases here


def test_spread(spark):
    c = sales(spark)
    total = c.coordinate({"Region": "Total", "Measure": "Sales"})
    values = lambda f: [r["v"] for r in f.orderBy("ord").collect()]
    assert values(spread.spread(c, total, scaled(100), "equal")) == [333334, 333333, 333333]
    assert values(spread.spread(c, total, -scaled(100), "equal")) == [-333334, -333333, -333333]
    assert values(spread.spread(c, total, scaled(100), "proportional")) == [333334, 666666, 0]
    assert values(spread.spread(c, total, 7, "repeat")) == [7, 7, 7] and values(spread.spread(c, total, 7, "clear")) == [0, 0, 0]
    cost = c.coordinate({"Region": "Total", "Measure": "Tax"})
    assert values(spread.spread(c, cost, scaled(1), "proportional")) == [3334, 3333, 3333]
    with pytest.raises(CubeError):
        spread.spread(c, c.coordinate({"Region": "Total", "Measure": "Margin"}), 1, "equal")
    with pytest.raises(LimitExceeded):
        spread.spread_leaves(c, total, most=2)


@pytest.mark.parametrize("seed", range(4))
def test_spread_is_exact(spark, seed):
    rng = random.Random(seed)
    basis = [("North", "Sales", rng.randint(-50, 90)), ("South", "Sales", rng.randint(1, 90)), ("East", "Sales", rng.randint(0, 90))]
    c = cube(spark, "S", [region(), measure("Sales")], basis)
    v = rng.randint(-10**7, 10**7)
    for method in ("equal", "proportional"):
        out = spread.spread(c, c.coordinate({"Region": "Total", "Measure": "Sales"}), v, method).collect()
        assert sum(r["v"] for r in out) == v


def test_sandbox(spark):
    c = sales(spark)
    at = c.coordinate({"Region": "North", "Measure": "Sales"})
    c = overlay.write(c, "plan", [(at, 0)])
    c = overlay.write(c, "plan", [(c.coordinate({"Region": "East", "Measure": "Sales"}), scaled(9))])
    assert c.get_leaf(at) == scaled(100)
    over = replace(c, cells=overlay.overlaid(c, "plan"))
    assert value(over, Region="Total", Measure="Sales") == scaled(209)
    done = overlay.commit(c, "plan")
    assert done.get_leaf(at) == 0 and done.sandboxes["plan"].count() == 0
    assert "plan" not in overlay.discard(c, "plan").sandboxes
    with pytest.raises(InvalidWrite):
        overlay.write(c, "plan", [(c.coordinate({"Region": "Total", "Measure": "Sales"}), 1)])
    with pytest.raises(UnknownName):
        overlay.discard(c, "none")


def test_structural_edits(spark):
    c = sales(spark)
    d = c.dimension("Region")
    north, south, total = d.exact("North"), d.exact("South"), d.exact("Total")
    r = writes.edited(c, "Region", "reorder", ["Total", "East", "South", "North"])
    assert [m.name for m in r.dimension("Region")] == ["Total", "East", "South", "North"]
    assert value(r, Region="North", Measure="Sales") == scaled(100)
    gone = writes.edited(c, "Region", "delete", north)
    assert value(gone, Region="Total", Measure="Sales") == scaled(200) and gone.cells.where(f"d0 = {north}").count() == 0
    with pytest.raises(InvalidEdit):
        writes.edited(c, "Region", "delete", total)
    text = writes.edited(c, "Region", "set_kind", north, STRING)
    assert text.cells.where(f"d0 = {north}").count() == 0
    moved = writes.edited(c, "Region", "reparent", south, north)
    assert moved.dimension("Region").kind(north) == CONSOLIDATED
    assert value(moved, Region="Total", Measure="Sales") == scaled(200)
    with pytest.raises(InvalidEdit):
        writes.edited(moved, "Region", "attach", total, north)
    cut = writes.edited(c, "Region", "detach", south, total)
    assert value(cut, Region="Total", Measure="Sales") == scaled(100)
    assert writes.edited(cut, "Region", "detach", south, total).dimension("Region").edges == cut.dimension("Region").edges
    new = writes.edited(c, "Region", "add", "West", LEAF, 0)
    assert [m.name for m in new.dimension("Region")][0] == "West" and value(new, Region="North", Measure="Sales") == scaled(100)
    assert writes.edited(c, "Region", "pin", north).dimension("Region").members[north].pinned
    with pytest.raises(InvalidEdit):
        region().add("North", STRING)


def test_aliases():
    d = region()
    assert d.resolve("Northern") == d.exact("North")
    with pytest.raises(InvalidEdit):
        d.set_attribute(d.exact("South"), "Label", "Northern")
    with pytest.raises(InvalidEdit):
        d.set_attribute(d.exact("South"), "Pop", "many")
    with pytest.raises(UnknownName):
        d.set_attribute(d.exact("South"), "None", "x")


def test_members_table(spark):
    d = region()
    m = member_frame(spark, d)
    assert {r["name"] for r in members.search(m, "*OUT").collect()} == {"South"}
    assert {r["name"] for r in members.without_children(m, edge_frame(spark, d)).collect()} == {"North", "South", "East"}
    assert members.forest(d, ["Total"])[1] == ("Total/North", 1, "North") and members.expandable(d) == ["Total"]
    assert members.selection(m, [0], keep=False).count() == 3
    assert [r["name"] for r in members.ordered(m, "name", True).collect()][0] == "Total"
    assert members.slug("A b/c!") == "a-b-c" and members.slug("!!") == "unnamed"


def test_many_dimensions(spark):
    dims = []
    for i in range(65):
        d = Dimension(f"D{i}")
        d.add("only")
        dims.append(d)
    c = Cube.empty(spark, "Wide", dims)
    c = writes.write_cells(c, writes.batch(c, [((0,) * 65, 7)]))
    assert c.get_leaf((0,) * 65) == 7


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    c = overlay.write(sales(spark), "plan", [((0, 0), 1)])
    one = store.commit(c, base=0, partition_by="Measure")
    two = store.commit(writes.set_leaf(one, (0, 0), scaled(5)), base=1)
    assert store.versions("Sales") == [1, 2] and two.version == 2
    assert value(store.load("Sales", 1), Region="Total", Measure="Sales") == scaled(300)
    assert value(store.load("Sales"), Region="Total", Measure="Sales") == scaled(205)
    assert [(r["before"], r["after"]) for r in store.changes("Sales", 1, 2).collect()] == [(scaled(100), scaled(5))]
    assert store.load("Sales", 1).dimension("Region").leaf_weights(3) == one.dimension("Region").leaf_weights(3)
    with pytest.raises(Conflict):
        store.commit(two, base=1)
    # A commit that broke off before its last file isn't seen.
    (tmp_path / "Sales" / "v00000003").mkdir()
    assert store.versions("Sales") == [1, 2]
    store.compact("Sales")
    assert store.versions("Sales") == [2]
