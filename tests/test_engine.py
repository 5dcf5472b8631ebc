from dataclasses import replace

import pytest

from cubeloom.cube import scaled
from cubeloom.dimension import CONSOLIDATED, Dimension
from cubeloom.engine import Engine
from cubeloom.errors import Conflict, CubeError, Denied, InvalidEdit, InvalidWrite, LimitExceeded, UnknownName
from cubeloom.flow import FlowTest, apply, authorize, import_rows, run, run_test
from cubeloom.plans.view import Axis, View
from cubeloom.rules.testing import RuleTest
from cubeloom.security import Audit, Policy, retained, shared_denials
from cubeloom.sources import modeltext, readers
from cubeloom.store import Store
from cubeloom.streaming import feed, jobs

from .fixtures import measure, region, sales

NORTH = {"Region": "North", "Measure": "Sales"}
TOTAL = {"Region": "Total", "Measure": "Sales"}
VIEW = View((Axis("Region", ("North", "Total")),), (Axis("Measure", ("Sales",)),))


@pytest.fixture()
def engine(spark):
    e = Engine(spark)
    e.publish(sales(spark))
    return e


def v(engine, at, **kw):
    return engine.read_cells("Sales", [at], **kw).first()["v"]


def test_cells(engine):
    before = engine.cube("Sales").version
    engine.write_cells("Sales", [(NORTH, "1.5"), (NORTH, "2.5")], base=before)
    assert v(engine, TOTAL) == scaled("202.5") and engine.events[-1][1:3] == ("Sales", "cells")
    with pytest.raises(Conflict):
        engine.write_cells("Sales", [(NORTH, "1")], base=before)
    with pytest.raises(InvalidWrite):
        engine.write_cells("Sales", [(NORTH, "9"), (TOTAL, "1")])
    assert v(engine, NORTH) == scaled("2.5")
    engine.write_string("Sales", {"Region": "North", "Measure": "Comment"}, "ok")
    row = engine.read_cells("Sales", [{"Region": "North", "Measure": "Comment"}, TOTAL]).orderBy("ord").collect()
    assert (row[0]["s"], row[0]["kind"], row[1]["kind"], row[1]["editable"]) == ("ok", "string", "consolidated", False)


def test_spread_and_sandbox(engine):
    engine.spread("Sales", TOTAL, "100")
    assert v(engine, NORTH) == 333334
    engine.create_sandbox("Sales", "plan")
    engine.write_cells("Sales", [(NORTH, "0")], sandbox="plan")
    assert v(engine, TOTAL, sandbox="plan") == 666666 and v(engine, TOTAL) == scaled(100)
    assert engine.read_cells("Sales", [NORTH], sandbox="plan").first()["overlaid"]
    engine.spread("Sales", TOTAL, "9", "proportional", sandbox="plan")
    assert v(engine, TOTAL, sandbox="plan") == scaled(9) and v(engine, NORTH, sandbox="plan") == 0
    engine.commit_sandbox("Sales", "plan")
    assert v(engine, TOTAL) == scaled(9)
    engine.discard_sandbox("Sales", "plan")
    with pytest.raises(UnknownName):
        engine.commit_sandbox("Sales", "plan")


def test_views_are_cached_by_every_version_they_read(engine, spark):
    m = measure("A")
    engine.publish(replace(modeltext.Model(sales(spark)).cube, name="Other"))
    n = engine.create_cube("Nat", [m])
    engine.define_rules("Nat", "['Measure':'A'] = 'Sales'!['Region':'Total','Measure':'Sales'];")
    view = View((Axis("Measure", ("A",)),))
    first = engine.execute("Nat", view)
    assert first.texts() == [["300"]] and engine.execute("Nat", view) is first
    engine.write_cells("Sales", [(NORTH, "0")])
    assert engine.execute("Nat", view).texts() == [["200"]]
    assert n.name == "Nat"


def test_catalog(engine):
    engine.define_subset("Sales", "two", "Region", ["Northern", "South", "North"])
    engine.define_subset("Sales", "big", "Region", 'Filter([Region].Members, [Region].Properties("Pop") > 150)')
    assert engine.subset("Sales", "two") == ["North", "South"] and engine.subset("Sales", "big") == ["North", "East"]
    assert engine.preview_set("Sales", "Region", "[Region].[Total].Children") == ["North", "South", "East"]
    engine.define_view("Sales", "v", VIEW)
    assert engine.execute_view("Sales", "v").texts() == [["100"], ["300"]]
    assert engine.mdx("SELECT {[Measure].[Sales]} ON COLUMNS, {[Region].[North]} ON ROWS FROM [Sales]").texts() == [["100"]]
    engine.delete("Sales", "view", "v")
    with pytest.raises(UnknownName):
        engine.delete("Sales", "view", "v")
    with pytest.raises(UnknownName):
        engine.execute_view("Sales", "v")
    assert engine.preview_rules("Sales", "['Measure':'None'] = 1;") and engine.preview_rules("Sales", "['Measure':'Tax'] = 1;") is None
    with pytest.raises(CubeError):
        engine.define_rules("Sales", "['Measure':'None'] = 1;")
    engine.define_rules("Sales", "['Measure':'Tax'] = value['Measure':'Sales'] * 2;")
    engine.define_test("Sales", RuleTest("t", ((NORTH, "1"),), (({"Region": "North", "Measure": "Tax"}, "2"),)))
    assert engine.run_tests("Sales") == {"t": []}
    assert engine.explain("Sales", {"Region": "North", "Measure": "Tax"}).source == "rule"
    assert engine.feeders("Sales").counts()["fed"] == 2


def test_shared_dimensions(engine):
    engine.create_dimension(region())
    for n in ("A", "B"):
        engine.create_cube(n, ["Region", measure("X")])
    with pytest.raises(InvalidEdit):
        engine.delete_dimension("Region")
    with pytest.raises(InvalidEdit):
        engine.edit("A", "Region", "pin", 0)
    assert engine.edit_dimension("Region", "add", "West") == []
    assert all("West" in [m.name for m in engine.cube(n).dimension("Region")] for n in "AB")
    assert engine.shared["Region"].generation == 2
    for n in "AB":
        engine.delete_cube(n)
    engine.delete_dimension("Region")
    engine.promote("Sales", "Measure")
    assert engine.shared["Measure"].cubes == {"Sales"}


def test_model_text_round_trip(spark):
    c = sales(spark, "['Measure':'Tax'] = 1;")
    c = replace(c, strings=spark.createDataFrame([(0, 4, 'say "hi"\n')], "d0 int, d1 int, s string"), sandboxes={"p": spark.createDataFrame([(0, 0, 0)], "d0 int, d1 int, v bigint")})
    m = modeltext.Model(c, {"s": ("Region", ("North",)), "d": ("Region", "[Region].Members")}, {"v": VIEW}, {"t": RuleTest("t", ((NORTH, "1"),), ((NORTH, "1"),))})
    text = modeltext.write(m)
    again = modeltext.read(spark, text)
    assert modeltext.write(again) == text
    assert again.views == m.views and again.subsets == m.subsets and again.tests == m.tests
    with pytest.raises(CubeError):
        modeltext.read(spark, text.replace(modeltext.FORMAT, "nope"))


def test_engine_over_a_store(spark, tmp_path):
    e = Engine(spark, Store(spark, f"file://{tmp_path}"))
    e.publish(sales(spark))
    e.write_cells("Sales", [(NORTH, "5")], base=1)
    with pytest.raises(Conflict):
        e.publish(e.cube("Sales"), base=1)
    assert v(e, TOTAL) == scaled(205)
    f = Engine(spark, e.store)
    f.models["Sales"] = modeltext.Model(f.store.load("Sales"))
    assert v(f, TOTAL) == scaled(205)


CSV = [
    ("a,b\n1,2", [{"a": "1", "b": "2"}]),
    ('a,b\n"x,1","q""z"\n', [{"a": "x,1", "b": 'q"z'}]),
    ('a\r\n"l1\nl2"\r\n\r\n', [{"a": "l1\nl2"}]),
    ("a,b\n1\n1,2,3\n", [{"a": "1", "b": ""}, {"a": "1", "b": "2"}]),
    ('a\nx"y,z"w', [{"a": "xy,zw"}]),
    ("a,b\n", []),
    ("", []),
]


@pytest.mark.parametrize("text,rows", CSV)
def test_csv(spark, text, rows):
    assert [r.asDict() for r in readers.read_csv_text(spark, text).collect()] == rows


def test_sources(spark, tmp_path):
    with pytest.raises(LimitExceeded):
        readers.read_csv_text(spark, "a\n1\n2\n", most=1)
    rows = readers.parse_output(spark, '{"d": {"rows": [{"a": 1, "b": null}, {"a": true, "c": {"x": [1, 2]}}]}}', "json", "d.rows").collect()
    assert [r.asDict() for r in rows] == [{"a": "1", "b": "", "c": ""}, {"a": "true", "b": "", "c": '{"x":[1,2]}'}]
    assert readers.parse_output(spark, "", "json").count() == 0
    for bad in ('{"d": 1}', "[1]"):
        with pytest.raises(CubeError):
            readers.read_json_text(spark, bad, "d" if "{" in bad else "")
    with pytest.raises(Denied):
        readers.run_command(["echo", "hi"])
    assert readers.run_command(["echo", "hi"], allowed=True) == "hi\n"
    with pytest.raises(CubeError):
        readers.run_command(["false"], allowed=True)
    with pytest.raises(CubeError):
        readers.run_command(["sleep", "5"], allowed=True, timeout=0.2)
    with pytest.raises(LimitExceeded):
        readers.run_command(["echo", "hello"], allowed=True, most=2)
    with pytest.raises(Denied):
        readers.fetch("http://example.org/x", hosts=["other.org"])
    (tmp_path / "f.csv").write_text('a,b\n"x, y",\n')
    assert readers.read_csv(spark, f"file://{tmp_path}/f.csv").collect()[0].asDict() == {"a": "x, y", "b": ""}
    assert readers.preview(spark.range(100)).count() == 20
    with pytest.raises(CubeError):
        readers.as_text(spark.sql("SELECT array(1) AS a"))


class Load:
    """Grows the region from rows and writes them."""

    def schema(self, ctx):
        h = ctx.cube("Sales")
        for r in ctx.input().select("Region").distinct().orderBy("Region").collect():
            h.ensure_element("Region", r[0])
            h.add_child("Region", "Total", r[0])

    def rows(self, ctx):
        ctx.cube("Sales").write_cells(ctx.input().withColumn("m", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("Sales")), {"Region": "Region", "Measure": "m"}, "Value")

    def finalize(self, ctx):
        ctx.cube("Sales").write_cell({"Region": "North", "Measure": "Comment"}, f"at {ctx.now}")
        ctx.log(ctx.cube("Sales").read_cell(NORTH))


def test_flows(engine, spark):
    rows = readers.read_csv_text(spark, "Region,Value\nWest,40\nMid,60.5\n")
    ctx = run(engine, Load(), {"data": rows}, now=7)
    assert v(engine, TOTAL) == scaled(300) and ctx.lines == ["100"]
    policy = Policy(grants={("ann", "Sales"): "write"})
    authorize(policy, "ann", ctx)
    for who in ("bob", None):
        with pytest.raises(CubeError):
            authorize(policy, who, ctx)
    test = FlowTest(Load(), {"data": rows}, {}, (("Sales", TOTAL, "400.5"), ("Sales", NORTH, "1")))
    assert run_test(engine, test) == [("Sales", NORTH, "1", "100")]
    assert v(engine, TOTAL) == scaled(300)
    apply(ctx)
    assert v(engine, TOTAL) == scaled("400.5") and engine.cube("Sales").get_string((0, 4)) == "at 7"


def test_import(engine, spark):
    rows = readers.read_csv_text(spark, "Region,Value,n\nWest,40,1\nWest,41,2\nFar,,3\n")
    c = import_rows(engine, "Sales", rows, {"Region": "Region"}, "Value", {"Measure": "Sales"}, "n")
    assert {m.name for m in c.dimension("Region")} >= {"West", "Far"}
    assert v(engine, {"Region": "West", "Measure": "Sales"}) == scaled(41) and v(engine, NORTH) == scaled(100)
    with pytest.raises(CubeError):
        import_rows(engine, "Sales", rows, {"Region": "Region"}, "Value")


def test_policy(engine):
    p = Policy(admins={"root"}, groups={"staff": {"ann"}}, grants={("staff", "Sales"): "write", ("bob", "Sales"): "read"}, members={("Sales", "Region", "South"): {"bob": "read"}})
    c = engine.cube("Sales")
    assert (p.level("root", "Sales"), p.level("ann", "Sales"), p.level("bob", "Sales"), p.level("eve", "Sales")) == ("admin", "write", "read", "none")
    assert not p.mask("root", c) and not p.mask("eve", c) and not p.mask("bob", c)
    assert p.mask("ann", c).denied == {0: frozenset([1])}
    from cubeloom.operators import writes

    p.check_writes("ann", c, writes.batch(c, [((0, 0), 1)]))
    with pytest.raises(Denied):
        p.check_writes("ann", c, writes.batch(c, [((1, 0), 1)]))
    with pytest.raises(Denied):
        p.check_writes("bob", c, writes.batch(c, [((0, 0), 1)]))
    assert p.can_read("ann", False, "ann") and not p.can_read("ann", False, "bob")
    assert shared_denials(p, "ann", [c], "Region") == {"South"}


def test_audit(spark, tmp_path):
    log = Audit(spark, f"file://{tmp_path}/audit")
    for i in range(5):
        log.append(i * 10, "ann" if i % 2 else "bob", "write", "Sales")
    assert [r["seq"] for r in log.query({"actor": "bob"}, since=10, limit=5).collect()] == [4, 2]
    assert retained(log.frame(), 40, 15).count() == 2


def test_scheduler(spark):
    done = []

    def boom(now):
        raise CubeError("broken")

    s = jobs.Scheduler(spark, [jobs.Job("b", "ann", 100, (done.append,)), jobs.Job("a", "ann", 50, (boom, done.append)), jobs.Job("c", None, 10, ()), jobs.Job("off", "ann", 1, (), False)])
    assert s.tick(1000) == ["a@0", "b@0", "c@0"] and done == [1000]
    states = {r["job"]: r["state"] for r in jobs.latest_runs(s.ledger()).collect()}
    assert states == {"a": "failed", "b": "succeeded", "c": "failed"}
    assert s.tick(1050) == ["a@0", "c@0"] and s.tick(1100) == ["a@0", "c@0", "b@1100"]
    s._note("hang@1", "off", jobs.RUNNING, 1, 1)
    assert s.recover(2000) == 1 and s.recover(2000) == 0
    assert [r["run"] for r in jobs.recent_runs(s.ledger(), 1).collect()] == ["a@0"]
    assert jobs.retained(s.ledger(), 1).select("run").distinct().count() == 4


def test_busy_jobs_wait(spark):
    table = spark.createDataFrame([("a", "x", 10, True)], jobs.JOBS)
    log = spark.createDataFrame([(0, "a@0", "a", "running", 0, 0, "")], jobs.LEDGER)
    assert jobs.due(table, log, 99).count() == 0


def test_streams(engine, spark, tmp_path):
    at = feed.append_changes(engine, f"file://{tmp_path}/log")
    engine.write_cells("Sales", [(NORTH, "1")])
    feed.append_changes(engine, f"file://{tmp_path}/log", at)
    q = feed.follow(spark, f"file://{tmp_path}/log", "Sales").writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 2
    src = f"{tmp_path}/in"
    spark.createDataFrame([(0, 0, scaled(1)), (0, 0, scaled(2))], "d0 int, d1 int, v bigint").coalesce(1).write.parquet(f"file://{src}")
    stream = spark.readStream.schema("d0 int, d1 int, v bigint").parquet(f"file://{src}")
    q = feed.ingest(stream, engine, "Sales", lambda b: b, f"file://{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert v(engine, NORTH) == scaled(4)


def test_windowed_counts(spark, tmp_path):
    spark.sql("SELECT TIMESTAMP '2024-01-01 10:00:00' AS ts, 'view' AS event_type, 1.5D AS value UNION ALL SELECT TIMESTAMP '2024-01-01 11:00:00', 'view', 2.25D").coalesce(1).write.parquet(f"file://{tmp_path}/e")
    s = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"file://{tmp_path}/e")
    q = feed.windowed_counts(s).writeStream.format("memory").outputMode("complete").queryName("win").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["n"], r["v4"]) for r in spark.table("win").collect()] == [(2, 37500)]


def test_consolidated_members_by_flow(engine):
    class Grow:
        def init(self, ctx):
            ctx.cube("Sales").ensure_consolidated("Region", "West Coast")
            ctx.cube("Sales").add_child("Region", "West Coast", "North")

    apply(run(engine, Grow()))
    assert engine.cube("Sales").dimension("Region").kind(engine.cube("Sales").dimension("Region").exact("West Coast")) == CONSOLIDATED
    assert v(engine, {"Region": "West Coast", "Measure": "Sales"}) == scaled(100)
    assert isinstance(engine.cube("Sales").dimension("Region"), Dimension)


def test_worksheet_reads_and_writes(engine):
    assert engine.read("Sales", "Measure=Sales", "Region = Total") == "300"
    engine.write_grid("Sales", [["Region", "Measure", "Value"], ["North", "Sales", "7.5"], ["", " ", ""], ["East", "Sales", "1"]])
    assert engine.read("Sales", "Measure=Sales", "Region=Total") == "208.5"
    for bad in (["Region"], ["Region=North", "Region=South"]):
        with pytest.raises(CubeError):
            engine.read("Sales", *bad)
    with pytest.raises(CubeError):
        engine.write_grid("Sales", [["Region", "Value"], ["North", "1"]])


def test_connections(spark, tmp_path):
    from cubeloom.sources import connections as cn

    (tmp_path / "f.json").write_text('[{"a": 1, "b": "x"}, {"a": null, "b": "y"}]')
    known = {"echo": cn.Connection("command", ("printf", "a,b\\n1,2"), timeout=5), "web": cn.Connection("http", url="http://h/x", auth="basic", user="u", secret="s"), "file": cn.Connection("json", url=f"file://{tmp_path}/f.json")}
    local = {"mine": cn.Connection("inline", text='{"r": [{"k": "v"}]}', format="json", json_path="r")}
    got = cn.inputs(spark, ["echo", "local.mine", "file"], known, local, may=cn.Permissions(commands=True))
    assert [f.count() for f in got.values()] == [1, 1, 2] and [tuple(r) for r in got["file"].orderBy("b").collect()] == [("1", "x"), ("", "y")]
    with pytest.raises(Denied):
        cn.rows(spark, known["echo"])
    with pytest.raises(Denied):
        cn.rows(spark, known["web"], cn.Permissions(secrets={"s": "p"}))
    with pytest.raises(UnknownName):
        cn.inputs(spark, ["none"], known)
    assert cn.authorization(known["web"], {"s": "p"}) == {"Authorization": "Basic dTpw"}
    assert list(cn.inputs(spark, ["echo"], known, csv="a\n1")) == ["echo"]
    text = cn.write_text(known, {"j": ("ann", 60000, True)})
    assert cn.read_text(text) == (known, {"j": ("ann", 60000, True)}) and cn.write_text(*cn.read_text(text)) == text


def test_commits_are_deltas_until_a_whole_version_is_due(spark, tmp_path, monkeypatch):
    from cubeloom import store as stored

    monkeypatch.setattr(stored, "MOST_DELTAS", 3)
    e = Engine(spark, Store(spark, f"file://{tmp_path}"))
    e.publish(sales(spark))
    for i in range(6):
        e.write_cells("Sales", [(NORTH, str(i)), (NORTH, str(i + 1))], base=e.cube("Sales").version)
    written = sorted(p.name for v in sorted((tmp_path / "Sales").iterdir()) for p in v.iterdir() if p.name in ("cells", "delta"))
    assert written == ["cells", "cells", "delta", "delta", "delta", "delta", "delta"]
    assert v(e, NORTH) == scaled(6) and v(e, TOTAL) == scaled(206)
    assert e.store.load("Sales", 2).get_leaf((0, 0)) == scaled(1) and e.store.changes("Sales", 1, 7).count() == 1
    e.write_cells("Sales", [(NORTH, "0")])
    e.store.compact("Sales")
    again = Store(spark, f"file://{tmp_path}").load("Sales")
    assert again.version == 8 and again.get_leaf((0, 0)) == 0 and again.cells.where("d0 = 0").count() == e.cube("Sales").cells.where("d0 = 0").count()
    (tmp_path / "Sales" / "v00000009" / "delta").mkdir(parents=True)  # a commit that broke off
    assert e.store.load("Sales").version == 8
    e.write_cells("Sales", [(NORTH, "9")])
    assert v(e, NORTH) == scaled(9)
    with pytest.raises(Conflict):
        e.write_cells("Sales", [(NORTH, "1")], base=3)


def test_plans_of_many_writes_stay_short(engine):
    for i in range(40):
        engine.write_cells("Sales", [(NORTH, str(i))])
    plan = engine.cube("Sales").cells._jdf.queryExecution().analyzed().toString()
    assert v(engine, NORTH) == scaled(39) and plan.count("Union") < 20


def test_ledger_outlives_the_process(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    s = jobs.Scheduler(spark, [jobs.Job("a", "ann", 50, (lambda now: None,))], path)
    s.tick(1000)
    s._note("a@1050", "a", jobs.RUNNING, 1050, 1050)
    later = jobs.Scheduler(spark, [jobs.Job("a", "ann", 50, (lambda now: None,))], path)
    assert later.records == s.records and later.tick(1050) == []
    assert later.recover(1060) == 1 and later.tick(1070) == ["a@1050"]


def test_stream_batches_count_once_over_processes(spark, tmp_path):
    rows = "d0 int, d1 int, v bigint"
    src, root, cp = (f"file://{tmp_path}/{x}" for x in ("in", "store", "cp"))
    e = Engine(spark, Store(spark, root))
    e.publish(sales(spark))
    spark.createDataFrame([(0, 0, scaled(1))], rows).coalesce(1).write.parquet(src)

    def run_once(engine, checkpoint):
        q = feed.ingest(spark.readStream.schema(rows).parquet(src), engine, "Sales", lambda b: b, cp) if checkpoint == cp else feed.ingest(spark.readStream.schema(rows).parquet(src), engine, "Sales", lambda b: b, checkpoint)
        q.processAllAvailable()
        q.stop()

    run_once(e, cp)
    assert v(e, NORTH) == scaled(101)
    import shutil

    shutil.rmtree(f"{tmp_path}/cp/commits")  # the batch was committed to the cube but not acknowledged
    later = Engine(spark, Store(spark, root))
    later.models["Sales"] = modeltext.Model(later.store.load("Sales"))
    run_once(later, cp)
    assert v(later, NORTH) == scaled(101)


def test_closures_of_large_dimensions_are_found_by_spark(spark, monkeypatch):
    from cubeloom.operators import rollup

    c = sales(spark)
    region = [[m.id for m in d if m.kind != "string"] for d in c.dimensions]
    want = sorted(map(tuple, rollup.consolidate(c.cells, c.dimensions, region).collect()))
    monkeypatch.setattr(rollup, "DRIVER_MEMBERS", 0)
    assert sorted(map(tuple, rollup.consolidate(c.cells, c.dimensions, region).collect())) == want


def test_long_member_lists_are_joined(spark, monkeypatch):
    from cubeloom import cube as cubes
    from cubeloom.operators import masks, writes

    c = sales(spark)
    want = writes.drop_members(c, "Region", {1}).cells.collect()
    for m in (cubes, writes):
        monkeypatch.setattr(m, "MOST_LITERALS", 0)
    assert sorted(writes.drop_members(c, "Region", {1}).cells.collect()) == sorted(want)
    assert masks.allowed(c, masks.Mask({0: [1]}), c.cells).where("d0 = 1").count() == 0
    writes.check_kinds(c, writes.batch(c, [((0, 0), 1)]))
    for bad in ((3, 0), (0, 4), (99, 0)):
        with pytest.raises(InvalidWrite):
            writes.check_kinds(c, writes.batch(c, [(bad, 1)]))
