"""Small models that tests share."""

from dataclasses import replace

from cubeloom.cube import Cube, scaled
from cubeloom.dimension import ALIAS, CONSOLIDATED, NUMERIC, STRING, TEXT, Dimension
from cubeloom.operators import writes


def region(east=True) -> Dimension:
    d = Dimension("Region")
    names = ["North", "South", "East"] if east else ["North", "South"]
    ids = [d.add(n) for n in names]
    total = d.add("Total", CONSOLIDATED)
    for i in ids:
        d.add_child(total, i)
    d.define_attribute("Pop", NUMERIC)
    d.define_attribute("Code", TEXT)
    d.define_attribute("Label", ALIAS)
    for i, pop in zip(ids, (300, 100, 200)):
        d.set_attribute(i, "Pop", scaled(pop))
        d.set_attribute(i, "Code", d.members[i].name[0])
        d.set_attribute(i, "Label", d.members[i].name + "ern")
    return d


def measure(*names) -> Dimension:
    d = Dimension("Measure")
    for n in names:
        d.add(n, STRING if n == "Comment" else "leaf")
    return d


def cube(spark, name, dims, cells, rules="") -> Cube:
    c = Cube.empty(spark, name, dims)
    rows = [(c.coordinate(dict(zip([d.name for d in dims], at))), scaled(v)) for *at, v in cells]
    return replace(writes.write_cells(c, writes.batch(c, rows)), rules=rules)


def sales(spark, rules="") -> Cube:
    """North 100/60, South 200/150, East 0/0; Margin = Sales - Cost is a consolidation with weight -1."""
    m = measure("Sales", "Cost", "Extra", "Tax", "Comment")
    margin = m.add("Margin", CONSOLIDATED)
    m.add_child(margin, m.exact("Sales"), 1)
    m.add_child(margin, m.exact("Cost"), -1)
    cells = [("North", "Sales", 100), ("North", "Cost", 60), ("South", "Sales", 200), ("South", "Cost", 150)]
    return cube(spark, "Sales", [region(), m], cells, rules)


def value(c, **at):
    from cubeloom.operators import rollup

    return rollup.get(c, [d.resolve(at[d.name]) for d in c.dimensions])
