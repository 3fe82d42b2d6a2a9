"""Sessions, catalogs, schema, codecs, surfaces, services and streaming ingest."""

import asyncio
import json
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lattica.catalog import GraphCatalog, GraphSession
from lattica.errors import GraphAlreadyExistsError, GraphError, GraphNotFoundError, GraphQueryError, checked_label
from lattica.functions import agtype, literals
from lattica.functions.paths import path_is_empty, path_length, path_steps
from lattica.graph import Graph
from lattica.model import EMPTY_PATH, Edge, Path, Vertex
from lattica.options import EngineConfig, GraphExportOptions, GraphImportOptions, NeighborOptions
from lattica.schema import EdgeLabel, VertexLabel
from lattica.services.code_graph import CodeGraph
from lattica.services.network import Network
from lattica.streaming.ingest import envelopes, ingest
from lattica.streaming.surfaces import AsyncSurface, FutureSurface, RawSession


def test_crud(spark):
    s = GraphSession(spark)
    alice = s.create_vertex("Person", {"name": "Alice", "age": 30, "city": "Seoul", "gone": None})
    bob = s.create_vertex("Person", {"name": "Bob", "age": "30", "city": "Busan", "tags": ["a", "b"], "ok": True})
    assert s.find_vertex_by_id("Person", alice.id).properties == {"name": "Alice", "age": 30, "city": "Seoul"}
    assert s.find_vertex_by_id("Car", alice.id) is None and s.find_vertex_by_id("Person", "999") is None
    find = lambda **f: [v.id for v in s.find_vertices_by_label("Person", f)]
    assert find(city="Seoul") == [alice.id] and find(age=30) == [alice.id] and find(age=30.0) == [alice.id] and find(age="30") == [bob.id]
    assert find(tags=["a", "b"]) == find(ok=True) == [bob.id] and find(name=None) == find(nothing=1) == find(ok="true") == []
    assert s.count_vertices("Person") == 2 and s.count_vertices("Ghost") == 0
    assert s.update_vertex("Person", alice.id, {"age": 31, "city": None, "new": "x"}).properties == {"name": "Alice", "age": 31, "new": "x"}
    assert s.update_vertex("Person", alice.id, {}).properties["age"] == 31 and s.update_vertex("Person", "999", {"a": 1}) is None
    edge = s.create_edge(alice.id, bob.id, "KNOWS", {"since": 2020})
    assert [e.properties for e in s.find_edges_by_label("KNOWS", {"since": 2020})] == [{"since": 2020}] and s.find_edges_by_label("KNOWS", {"since": "2020"}) == []
    with pytest.raises(GraphQueryError):
        s.create_edge(alice.id, "999", "KNOWS")
    for bad in ("", "  "):
        with pytest.raises(ValueError):
            s.create_vertex(bad)
    assert not s.delete_edge("OTHER", edge.id) and s.delete_edge("KNOWS", edge.id) and not s.delete_edge("KNOWS", edge.id)
    s.create_edge(bob.id, alice.id, "KNOWS")
    assert s.delete_vertex("Person", alice.id) and not s.delete_vertex("Person", alice.id)
    assert s.find_edges_by_label("KNOWS") == [] and s.count_vertices("Person") == 1
    assert s.sql("SELECT count(*) AS n FROM vertices").first()["n"] == 1
    s.close()


def test_missing_ends_in_bulk(spark):
    graph = Graph.from_rows(spark, [("a", "V"), ("b", "V")])
    new = spark.createDataFrame([("1", "E", "a", "b"), ("2", "E", "a", "z"), ("3", "E", "y", "z")], "id string, label string, src string, dst string")
    assert [r["id"] for r in graph.add_edges(new).edges.collect()] == ["1"]
    assert sorted(r["id"] for r in graph.missing_endpoints(new).collect()) == ["2", "3"]


def test_catalog(spark, tmp_path):
    for root in (None, f"file://{tmp_path}/graphs"):
        catalog = GraphCatalog(spark, EngineConfig(root))
        assert not catalog.graph_exists("g")
        catalog.create_graph("g"), catalog.create_graph("g")
        with pytest.raises(GraphAlreadyExistsError):
            catalog.create_graph("g", exist_ok=False)
        catalog.save("g", Graph.from_rows(spark, [("a", "V", {"x": 1})]))
        assert catalog.graph("g").count_vertices("V") == 1 and catalog.graph_exists("g")
        if root:
            assert GraphCatalog(spark, EngineConfig(root)).graph("g").count_vertices("V") == 1
        catalog.close()
        catalog.drop_graph("g"), catalog.drop_graph("g")
        assert not catalog.graph_exists("g")
        with pytest.raises(GraphNotFoundError):
            catalog.graph("g")
        with pytest.raises(ValueError):
            catalog.create_graph(" ")
    assert issubclass(GraphQueryError, GraphError) and issubclass(GraphError, RuntimeError)


def test_schema(spark):
    person = VertexLabel("Person")
    person.string("name"), person.integer("age"), person.string_list("tags"), person.local_date("born"), person.enum("kind", ["A", "B"]), person.json("extra")
    knows = EdgeLabel("KNOWS", person, person)
    knows.boolean("close")
    assert [f.name for f in person.to_struct()] == ["name", "age", "tags", "born", "kind", "extra"]
    graph = Graph.from_rows(spark, [("1", "Person", {"name": "A", "age": 3, "tags": ["x"], "born": date(2020, 1, 2), "kind": "A", "extra": {"k": 1}}), ("2", "Person", {"age": "old", "kind": "C"}), ("3", "Car", {})])
    rows = {r["id"]: r for r in person.typed(graph.vertices).collect()}
    assert (rows["1"]["age"], rows["1"]["tags"], rows["1"]["born"]) == (3, ["x"], date(2020, 1, 2)) and rows["2"]["age"] is None
    assert sorted((r["id"], r["property"]) for r in person.violations(graph.vertices).collect()) == [("2", "age"), ("2", "kind")]
    with pytest.raises(ValueError):
        VertexLabel(" ")


def test_literals(spark):
    value = literals.cypher_value
    assert value(None) == "null" and value("Alice") == "'Alice'" and value("O'Re\\il\n\r\tly") == "'O\\'Re\\\\il\\n\\r\\tly'"
    assert value({"a b": 1, "x`y": 2, "}) DETACH DELETE (n": 3}) == "{`a b`: 1, `x``y`: 2, `}) DETACH DELETE (n`: 3}"
    assert (value(42), value(1.5), value(True), value([1, "a"]), value({"k": False})) == ("42", "1.5", "true", "[1, 'a']", "{k: false}")
    assert value(date(2024, 1, 2)) == "'2024-01-02'" and value(datetime(2024, 1, 2, 3, 4, 5)) == "'2024-01-02T03:04:05'" and value(Path) == f"'{Path}'".replace("'lattica", "\\'lattica").replace("Path'>", "Path\\'>")
    assert literals.cypher_props({}) == "" and literals.cypher_props({"a": 1, "b": "x"}) == "{a: 1, b: 'x'}"
    texts = ["plain", "O'Re\\il\n\r\tly", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(literals.cypher_string(F.col("t")).alias("x"))
    assert [r["x"] for r in df.collect()] == [value(t) for t in texts]
    assert checked_label("Person_1") == "Person_1"
    with pytest.raises(ValueError, match="Invalid label"):
        checked_label("Person'; DROP TABLE foo--")


def test_agtype(spark):
    v = '{"id": 1, "label": "Person", "properties": {"name": "Alice", "age": 30}}::vertex'
    e = '{"id": 2, "label": "KNOWS", "start_id": 1, "end_id": 3, "properties": {"since": 2023}}::edge'
    texts = [v, e, f"[{v}, {e}, {v}]::path", "[]::path", "nonsense", "{bad::vertex", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    rows = df.select(agtype.is_vertex(t).alias("v"), agtype.is_edge(t).alias("e"), agtype.is_path(t).alias("p"), agtype.parse_vertex(t).alias("pv"), agtype.parse_edge(t).alias("pe"), agtype.parse_path(t).alias("pp")).collect()
    assert [(r["v"], r["e"], r["p"]) for r in rows[:4]] == [(True, False, False), (False, True, False), (False, False, True), (False, False, True)]
    assert rows[0]["pv"].id == "1" and json.loads(rows[0]["pv"].properties) == {"name": "Alice", "age": 30}
    assert (rows[1]["pe"].src, rows[1]["pe"].dst, rows[1]["pe"].label) == ("1", "3", "KNOWS")
    assert [s.kind for s in rows[2]["pp"]] == ["vertex", "edge", "vertex"] and rows[3]["pp"] == []
    assert all(r["pv"] is r["pe"] is r["pp"] is None for r in rows[4:])


def test_paths(spark):
    a, b = Vertex("a", "V"), Vertex("b", "V")
    path = Path((a, Edge("1", "E", "a", "b"), b))
    assert path.length == 1 and path.vertices == [a, b] and not path.is_empty and Path.of(a, b).length == 0 and EMPTY_PATH.is_empty
    r = spark.sql("select array('a', 'b') as vertex_ids, array('1') as edge_ids").select(path_length().alias("n"), path_is_empty().alias("e"), path_steps().alias("s")).first()
    assert r["n"] == 1 and not r["e"] and [(x.kind, x.id) for x in r["s"]] == [("vertex", "a"), ("edge", "1"), ("vertex", "b")]


def test_surfaces(spark):
    s = GraphSession(spark, Graph.from_rows(spark, [("a", "V"), ("b", "V")], [("1", "E", "a", "b")]))
    futures = FutureSurface(s)
    assert [v.id for v in futures.neighbors("a").result()] == ["b"] and futures.count_vertices("V").result() == 2
    assert futures.find_vertex_by_id("V", "zz").result() is None
    futures.close()

    async def run():
        aio = AsyncSurface(s)
        found = [r["id"] async for r in AsyncSurface.stream(s.graph.vertices.orderBy("id"))]
        return await aio.count_vertices("V"), await aio.neighbors("a", NeighborOptions()), found

    assert asyncio.run(run()) == (2, [Vertex("b", "V")], ["a", "b"])


def test_raw_session(spark):
    s = GraphSession(spark, Graph.from_rows(spark, [("a", "V", {"n": 1}), ("b", "V")], [("1", "E", "a", "b")]))

    async def run():
        raw = RawSession(s)
        with pytest.raises(RuntimeError):
            await raw.write(lambda g: (_ for _ in ()).throw(RuntimeError("no")))
        await asyncio.gather(*[raw.write(lambda g, i=i: g.with_vertex(f"x{i}", "W")) for i in range(3)])
        labels = [(r["label"], r["n"]) async for r in raw.rows("SELECT label, count(*) AS n FROM vertices GROUP BY label ORDER BY label")]
        with pytest.raises(ValueError):
            await raw.one("SELECT id FROM vertices")
        return labels, await raw.read(lambda g: g.edges.count()), (await raw.one("SELECT src FROM edges"))["src"], await raw.one("SELECT id FROM vertices WHERE label = 'none'")

    assert asyncio.run(run()) == ([("V", 2), ("W", 3)], 1, "a", None)


def test_results_hold_whole_elements(spark):
    v = [(x, "Person", {"name": x.upper()}) for x in "abcd"]
    e = [("1", "KNOWS", "a", "b", {"since": 1}), ("2", "KNOWS", "b", "c"), ("3", "KNOWS", "c", "a", {"since": 3}), ("4", "LIKES", "d", "a")]
    s = GraphSession(spark, Graph.from_rows(spark, v, e))
    path = s.shortest_path("a", "d")
    assert [(x.id, x.label, x.properties) for x in path.vertices] == [("a", "Person", {"name": "A"}), ("d", "Person", {"name": "D"})]
    assert [(x.id, x.label, x.src, x.dst) for x in path.edges] == [("4", "LIKES", "d", "a")]
    both = s.all_paths("a", "c")
    assert sorted(tuple(x.properties.get("since") for x in p.edges) for p in both) == [(1, None), (3,)]
    assert s.shortest_path("a", "zz") is None and s.all_paths("a", "zz") == []
    scores = s.page_rank()
    assert [x.vertex.properties["name"] for x in scores][0] == "A" and abs(sum(x.score for x in scores) - 1) < 1e-9
    (component,) = s.connected_components()
    assert component.component_id == "a" and component.size == 4 and [x.properties["name"] for x in component.vertices] == list("ABCD")
    assert [(x.vertex.properties["name"], x.depth, x.parent_id) for x in s.bfs("a")] == [("A", 0, None), ("B", 1, "a"), ("C", 2, "b")]
    assert [x.vertex.label for x in s.dfs("d")] == ["Person"] * 4 and s.bfs("zz")[0].vertex == Vertex("zz", "")
    for cycles in (s.detect_cycles(), s.cycles_through("b")):
        assert [[x.properties["name"] for x in c.path.vertices] for c in cycles] == [list("ABCA")] and [x.id for x in cycles[0].path.edges] == ["1", "2", "3"]


def test_files_as_futures_and_coroutines(spark, tmp_path):
    from lattica.sources.bulk import BulkIo

    graph = Graph.from_rows(spark, [("1", "P", {"name": "é"}), ("2", "P")], [("9", "KNOWS", "1", "2")])
    options = GraphExportOptions(frozenset({"P"}), frozenset({"KNOWS"}))
    io, at = BulkIo(spark), str(tmp_path)
    ways = [("csv", [f"{at}/v", f"{at}/e"]), ("ndjson", [f"{at}/n"]), ("graphml", [f"{at}/g"])]
    futures = FutureSurface(io)
    written = [getattr(futures, f"export_{kind}")(graph, *paths, options) for kind, paths in ways]
    assert [(w.result().vertices_written, w.result().edges_written) for w in written] == [(2, 1)] * 3
    read = [getattr(futures, f"import_{kind}")(*paths) for kind, paths in ways]
    assert [(r.result()[1].vertices_created, r.result()[1].edges_created) for r in read] == [(2, 1)] * 3
    futures.close()

    async def run():
        aio = AsyncSurface(io)
        reports = [await getattr(aio, f"export_{kind}")(graph, *(p + "2" for p in paths), options) for kind, paths in ways]
        return reports, await asyncio.gather(*[getattr(aio, f"import_{kind}")(*(p + "2" for p in paths)) for kind, paths in ways])

    reports, back = asyncio.run(run())
    assert [r.vertices_written for r in reports] == [2] * 3 and [r.edges_created for _, r in back] == [1] * 3


def test_records_as_streams(spark, tmp_path):
    from lattica.streaming.records import RecordReader

    (tmp_path / "v.csv").write_text("id,label,prop.x\nb,P,1\na,,\nb,P,2\n")
    (tmp_path / "e.csv").write_text("id,label,from,to\n1,E,a,b\n")
    (tmp_path / "n.jsonl").write_text('{"type":"edge","id":"1","from":"a","to":"b"}\nbroken\n{"type":"vertex","id":"a","properties":{"x":[1],"y":null}}\n')

    async def run(reader):
        return [r async for r in reader.records()]

    got = asyncio.run(run(RecordReader.of_csv(spark, str(tmp_path / "v.csv"), str(tmp_path / "e.csv"))))
    assert [(r.id, r.label, r.properties) for r in got] == [("b", "P", {"x": "1"}), ("a", "Vertex", {}), ("b", "P", {"x": "2"}), ("1", "E", {})]
    got = asyncio.run(run(RecordReader.of_ndjson(spark, str(tmp_path / "n.jsonl"))))
    assert [(r.id, r.label, r.properties) for r in got] == [("a", "Vertex", {"x": [1]}), ("1", "Edge", {})] and got[1].src == "a"


def test_config_and_health(spark, tmp_path):
    spark.conf.set("lattica.root", f"file://{tmp_path}/graphs")
    try:
        config = EngineConfig.of(spark)
    finally:
        spark.conf.unset("lattica.root")
    assert config == EngineConfig(f"file://{tmp_path}/graphs", 8) and EngineConfig.of(spark) == EngineConfig()
    catalog = GraphCatalog(spark, config)
    catalog.create_graph("one"), catalog.create_graph("two")
    assert catalog.names() == ["one", "two"] and catalog.health() == {"status": "UP", "root": config.root, "graphs": 2}
    assert GraphCatalog(spark, EngineConfig("nosuch://x/y")).health()["status"] == "DOWN"


def test_code_graph(spark):
    g = CodeGraph(GraphSession(spark))
    core, middle, app = (g.add_module(n, version="1") for n in ("core", "middle", "app"))
    g.add_dependency(middle, core, dependencyType="compile"), g.add_dependency(app, middle)
    names = lambda vs: sorted(v.properties["name"] for v in vs)
    assert names(g.dependencies(app)) == ["middle"] and names(g.dependents(core)) == ["middle"]
    assert names(g.transitive_dependencies(app)) == ["core", "middle"] and names(g.impacted_modules(core)) == ["app", "middle"]
    assert [v.id for v in g.dependency_path(app, core).vertices] == [app.id, middle.id, core.id]
    assert g.circular_dependencies(core) == []
    g.add_dependency(core, app)
    assert [c.length for c in g.circular_dependencies(core)] == [3]
    assert names(g.find_module("core")) == ["core"]
    dog, mammal = g.add_class("Dog"), g.add_class("Mammal")
    g.add_extends(dog, mammal), g.add_belongs_to(dog, core), g.add_implements(dog, mammal)
    assert names(g.inheritance_chain(dog)) == ["Mammal"] and names(g.find_class("Dog")) == ["Dog"]
    f, h = g.add_function("f"), g.add_function("h")
    g.add_call(f, h, callCount=2)
    assert names(g.call_chain(f)) == ["h"]


def test_network(spark):
    n = Network(GraphSession(spark))
    a, b, c, d = (n.add_person(x) for x in ("Alice", "Bob", "Carol", "Dave"))
    n.connect(a, b), n.connect(b, c), n.connect(c, d)
    acme = n.add_company("Acme")
    n.add_work_experience(a, acme, role="dev", isCurrent=True), n.follow(d, a)
    names = lambda vs: sorted(v.properties["name"] for v in vs)
    assert names(n.direct_connections(b)) == ["Alice", "Carol"] and names(n.connections_within(a, 2)) == ["Alice", "Bob", "Carol"]
    assert [v.id for v in n.connection_path(a, d).vertices] == [a.id, b.id, c.id, d.id]
    assert len(n.all_connection_paths(a, c)) == 4  # each friendship is two edges
    assert names(n.employees(acme)) == ["Alice"] and names(n.followers(a)) == ["Dave"] and names(n.find_person("Bob")) == ["Bob"]


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ['{"type":"vertex","id":"a","label":"P","properties":{"x":1}}', '{"type":"vertex","id":"b"}', "", "broken", '{"type":"edge","from":"a","to":"b","label":"E"}']
    (tmp_path / "in/1.jsonl").write_text("\n".join(lines))
    out = [f"file://{tmp_path}/{x}" for x in ("v", "e", "checkpoint")]
    for _ in range(2):  # a second start finds nothing new
        ingest(envelopes(spark, f"file://{tmp_path}/in"), *out).awaitTermination(60)
    graph = Graph(spark.read.parquet(out[0]).drop("batch"), spark.read.parquet(out[1]).drop("batch"))
    assert sorted((v.id, v.label, v.properties.get("x")) for v in Graph.vertices_of(graph.vertices)) == [("a", "P", 1), ("b", "Vertex", None)]
    assert [(e.src, e.dst, e.label) for e in Graph.edges_of(graph.edges)] == [("a", "b", "E")]


def test_option_defaults():
    i, e = GraphImportOptions(), GraphExportOptions()
    assert (i.batch_size, i.max_edge_buffer_size, i.default_vertex_label, i.default_edge_label) == (1000, None, "Vertex", "Edge") and e.include_empty_properties
    for bad in ({"batch_size": 0}, {"max_edge_buffer_size": 0}, {"default_vertex_label": " "}):
        with pytest.raises(ValueError):
            GraphImportOptions(**bad)
    with pytest.raises(ValueError):
        GraphExportOptions(frozenset({""}))


def test_age_text():
    from lattica.functions import age_text as t
    from lattica.model import Direction

    assert t.create_graph("g") == "SELECT ag_catalog.create_graph('g')" and "'o''g', true" in t.drop_graph("o'g") and "ag_graph" in t.graph_exists("g")
    assert t.create_vertex("g", "P", {"n": "O'x"}) == "SELECT * FROM ag_catalog.cypher('g', $$ CREATE (v:P {n: 'O\\'x'}) RETURN v $$) AS (v agtype)"
    assert "(v:P)" in t.match_vertices("g", "P") and "id(v) = 7" in t.match_vertex_by_id("g", "P", "7") and "SET v.a = 1, v.b = null" in t.update_vertex("g", "P", "7", {"a": 1, "b": None})
    assert "DETACH DELETE" in t.delete_vertex("g", "P", "1") and "count(v)" in t.count_vertices("g", "P") and "[e:K {s: 1}]" in t.create_edge("g", "1", "2", "K", {"s": 1})
    assert "-[e]->" in t.match_edges("g") and "DELETE e" in t.delete_edge("g", "K", "3") and "<-[:K*1..2]-" in t.neighbors("g", "1", "K", Direction.INCOMING, 2)
    assert "ORDER BY length(p) LIMIT 1" in t.paths("g", "1", "2", None, 4, shortest=True) and "OPTIONAL MATCH" in t.degree("g", "1", "K")
    for bad in (lambda: t.match_vertices("g", "P) DETACH DELETE (x"), lambda: t.match_vertex_by_id("g", "P", "1 OR 1"), lambda: t.cypher("g", "$$"), lambda: t.update_vertex("g", "P", "1", {})):
        with pytest.raises(ValueError):
            bad()


def test_many_mutations(spark, monkeypatch):
    """Ten thousand creates leave a plan of constant size, and none of them is a job."""
    from lattica import delta

    monkeypatch.setattr(delta, "LOG_ROWS", 15_000)
    s = GraphSession(spark)
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    shown = lambda: len(s.graph.vertices._jdf.queryExecution().toString().splitlines())
    before = jobs()
    ids = [s.create_vertex("P", {"n": i}).id for i in range(10)]
    small = shown()
    ids += [s.create_vertex("P", {"n": i}).id for i in range(10, 10_000)]
    for a, b in zip(ids[:2000], ids[1:]):
        s.create_edge(a, b, "NEXT", {"w": 1})
    assert jobs() == before and shown() == small
    assert s.count_vertices("P") == 10_000 and s.graph.edges.count() == 2000
    assert s.find_vertex_by_id("P", ids[7]).properties == {"n": 7} and jobs() > before


def test_mutations_against_a_model(spark, monkeypatch):
    """Random mutations of a graph at rest, with and without folding the log."""
    from lattica import delta
    from lattica.errors import GraphQueryError

    rng = random.Random(4)
    start = Graph.from_rows(spark, [(str(i), "PQ"[i % 2], {"n": i, "gone": 1}) for i in range(1, 9)], [(str(100 + i), "E", str(i), str(i + 1), {"w": i}) for i in range(1, 8)])
    monkeypatch.setattr(delta, "LOG_ROWS", 17)
    s = GraphSession(spark, start)
    v = {str(i): ("PQ"[i % 2], {"n": i, "gone": 1}) for i in range(1, 9)}
    e = {str(100 + i): ("E", str(i), str(i + 1)) for i in range(1, 8)}
    for _ in range(60):
        i, label = rng.choice([*v, "77"]), rng.choice("PQ")
        own = v.get(i)
        kind = rng.randrange(6)
        if kind == 0:
            v[s.create_vertex(label, {"n": 5, "none": None}).id] = (label, {"n": 5})
        elif kind == 1:
            got = s.update_vertex(label, i, {"n": 9, "gone": None, "new": "x"})
            assert (got is not None) == (own is not None and own[0] == label)
            if got is not None:
                v[i] = (label, {k: x for k, x in own[1].items() if k != "gone"} | {"n": 9, "new": "x"})
                assert got.properties == v[i][1]
        elif kind == 2 and rng.random() < 0.4:
            assert s.delete_vertex(label, i) == (own is not None and own[0] == label)
            if own is not None and own[0] == label:
                del v[i]
                e = {k: x for k, x in e.items() if i not in x[1:]}
        elif kind == 3:
            j = rng.choice(list(v))
            if own is None:
                with pytest.raises(GraphQueryError, match="no such vertex: 77"):
                    s.create_edge(i, j, "F")
            else:
                e[s.create_edge(i, j, "F", {"w": 2}).id] = ("F", i, j)
        elif kind == 4 and e:
            k = rng.choice(list(e))
            assert not s.delete_edge("Z", k) and s.delete_edge(e[k][0], k) and not s.delete_edge(e[k][0], k)
            del e[k]
        else:
            found = s.find_vertex_by_id(label, i)
            assert (found.properties if found else None) == (own[1] if own and own[0] == label else None)
    assert {x.id: (x.label, x.properties) for x in Graph.vertices_of(s.graph.vertices)} == v
    assert {x.id: (x.label, x.src, x.dst) for x in Graph.edges_of(s.graph.edges)} == e
    native = GraphSession(spark, Graph(spark.createDataFrame([("a", "P", "x")], "id string, label string, name string"), spark.createDataFrame([], "id string, label string, src string, dst string")))
    b = native.create_vertex("P", {"name": "y"})
    assert native.update_vertex("P", "a", {"name": "z"}).properties == {"name": "z"} and native.create_edge("a", b.id, "E")
    assert sorted((r["id"], r["name"]) for r in native.graph.vertices.collect()) == sorted([("a", "z"), (b.id, "y")]) and native.graph.edges.count() == 1
    with pytest.raises(ValueError):
        native.create_vertex("P", {"other": 1})


def test_components_of_a_growing_graph(spark, tmp_path):
    """Labels after each batch equal a full run; a batch that is run again changes nothing."""
    from lattica.operators.components import connected_components
    from lattica.streaming.components import ComponentLabels

    rng = random.Random(12)
    labels = ComponentLabels(spark, str(tmp_path / "cc"))
    assert labels.labels().count() == 0
    seen_v, seen_e = [], []
    shown = lambda: sorted(map(tuple, labels.labels().select("component_id", "vertex_id").collect()))
    for number in range(4):
        edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(14)]
        alone = [(f"n{rng.randrange(70)}",) for _ in range(5)]
        update = lambda n=number, v=alone, e=edges: labels.update(n, spark.createDataFrame(v, "id string"), spark.createDataFrame([*e, (None, "n1")], "src string, dst string"))
        update()
        seen_v += [i for i, in alone] + [i for pair in edges for i in pair]
        seen_e += edges
        whole = Graph.from_rows(spark, [(i, "V") for i in sorted(set(seen_v))], [(str(k), "E", a, b) for k, (a, b) in enumerate(seen_e)])
        want = sorted(map(tuple, connected_components(whole).select("component_id", "vertex_id").collect()))
        assert shown() == want
        if number == 2:
            update()
            assert shown() == want
    assert len({c for c, _ in want}) > 2
