"""Round trips of the file formats and the rules on faulty input."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.options import CsvOptions, CsvPropertyMode, DuplicatePolicy, GraphExportOptions, GraphImportOptions, GraphMlExportOptions, GraphMlImportOptions, MissingEndpointPolicy, UnsupportedElementPolicy
from lattica.plans.storage import Scratch
from lattica.sources import graphml_events
from lattica.sources.csv_io import export_csv, import_csv
from lattica.sources.graphml_io import export_graphml, import_graphml
from lattica.sources.ndjson_io import export_ndjson, import_ndjson
from lattica.sources.report import Severity, Status
from lattica.sources.staging import DuplicateVertexError

ALL = GraphExportOptions(frozenset({"P", "Q"}), frozenset({"KNOWS"}))
SKIP = GraphImportOptions(on_duplicate_vertex_id=DuplicatePolicy.SKIP, on_missing_edge_endpoint=MissingEndpointPolicy.SKIP_EDGE)


@pytest.fixture(scope="module")
def graph(spark):
    return Graph.from_rows(
        spark,
        [("1", "P", {"name": "A, \"q\" <&>\n'x'", "age": 30, "price": 9.5}), ("2", "P", {"name": "é", "ok": True}), ("3", "Q", {}), ("4", "Z", {"name": "left out"})],
        [("9", "KNOWS", "1", "2", {"since": 2024}), ("8", "KNOWS", "2", "3"), ("7", "OTHER", "1", "2")],
    )


def shown(graph, drop=("_graphIoExternalId",)):
    external = {v.id: v.properties["_graphIoExternalId"] for v in Graph.vertices_of(graph.vertices)}
    own = lambda p: {k: v for k, v in p.items() if k not in drop}
    v = sorted((external[v.id], v.label, json.dumps(own(v.properties), sort_keys=True)) for v in Graph.vertices_of(graph.vertices))
    e = sorted((external[e.src], external[e.dst], e.label, json.dumps(own(e.properties))) for e in Graph.edges_of(graph.edges))
    return v, e


def want(as_text=False):
    t = (lambda p: {k: v if isinstance(v, str) else json.dumps(v) for k, v in p.items()}) if as_text else dict
    v = [("1", "P", {"name": "A, \"q\" <&>\n'x'", "age": 30, "price": 9.5}), ("2", "P", {"name": "é", "ok": True}), ("3", "Q", {})]
    e = [("1", "2", "KNOWS", {"since": 2024}), ("2", "3", "KNOWS", {})]
    return [(i, x, json.dumps(t(p), sort_keys=True)) for i, x, p in v], [(a, b, x, json.dumps(t(p))) for a, b, x, p in e]


def check(report, status=Status.COMPLETED, **counts):
    assert report.status is status, report
    assert {k: getattr(report, k) for k in counts} == counts


def lines_of(path):
    return [line for f in sorted(glob.glob(f"{path}/part-*")) for line in open(f, encoding="utf-8").read().splitlines()]


def test_csv(spark, graph, tmp_path):
    v, e = str(tmp_path / "v"), str(tmp_path / "e")
    r = export_csv(graph, v, e, ALL)
    assert (r.vertices_written, r.edges_written) == (3, 2)
    assert lines_of(v)[0] == "id,label,prop.age,prop.name,prop.ok,prop.price" and lines_of(e)[0] == "id,label,from,to,prop.since"
    back, report = import_csv(spark, v, e)
    check(report, vertices_read=3, vertices_created=3, edges_read=2, edges_created=2)
    assert shown(back) == want(as_text=True)
    raw = CsvOptions(CsvPropertyMode.RAW_JSON)
    export_csv(graph, v, e, ALL, raw)
    assert shown(import_csv(spark, v, e, csv=raw)[0]) == want()
    export_csv(graph, v, e, ALL, CsvOptions(CsvPropertyMode.NONE))
    assert lines_of(v)[0] == "id,label"
    export_csv(graph, v, e, GraphExportOptions())
    assert import_csv(spark, v, e)[1].vertices_created == 0
    with pytest.raises(ValueError):
        CsvOptions(prefix=" ")


@pytest.mark.parametrize("charset", ["UTF-8", "ISO-8859-1"])
def test_streams_and_charsets(spark, tmp_path, charset):
    import io

    graph = Graph.from_rows(spark, [("1", "P", {"name": "é, \"q\"\nü", "age": 3}), ("2", "P", {"name": "ø"})], [("9", "KNOWS", "1", "2", {"since": 2024})])
    want = (["ø", "é, \"q\"\nü"], 1)
    names = lambda g: (sorted((v.properties["name"] for v in Graph.vertices_of(g.vertices)), key=len), g.edges.count())
    v, e, n, x = (io.BytesIO() for _ in range(4))
    export_csv(graph, v, e, ALL, charset=charset), export_ndjson(graph, n, ALL, charset=charset), export_graphml(graph, x, ALL, GraphMlExportOptions(encoding=charset))
    assert v.getvalue().decode(charset).count("prop.name") == 1 and "ø" in n.getvalue().decode(charset) and x.getvalue().decode(charset).count("<?xml") == 1
    for s in (v, e, n, x):
        assert not s.closed and not s.seek(0)
    assert names(import_csv(spark, v, e, charset=charset)[0]) == want
    assert names(import_ndjson(spark, n, charset=charset)[0]) == want
    assert names(import_graphml(spark, x, charset=charset)[0]) == want
    with pytest.raises(ValueError):
        export_ndjson(graph, str(tmp_path / "x"), ALL, charset="UTF-16")


def test_csv_is_split_where_it_can_be(spark, tmp_path):
    """Lines that hold whole records are read by several tasks; a record over several lines by one a file."""
    (tmp_path / "v.csv").write_text("id,label,prop.x\n" + "".join(f'{i},P,"a ""quoted"" {i}"\n' for i in range(3000)))
    (tmp_path / "e.csv").write_text("id,label,from,to\n" + "".join(f"{i},E,{i},{(i + 1) % 3000}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        graph, report = import_csv(spark, str(tmp_path / "v.csv"), str(tmp_path / "e.csv"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    check(report, vertices_created=3000, edges_created=3000)
    assert graph.edges.select("id").distinct().count() == 3000


def test_every_rejected_record_is_told(spark, tmp_path, monkeypatch):
    from lattica.sources import report as reports

    monkeypatch.setattr(reports, "LISTED", 2)
    files = csv_of(tmp_path, "a,P\n" * 6, "".join(f"{i},E,a,z\n" for i in range(5)))
    _, report = import_csv(spark, *files, SKIP)
    check(report, Status.PARTIAL, skipped_vertices=5, skipped_edges=5)
    assert len(report.failures) == 4 and sorted((r["phase"], r["record_id"]) for r in report.rejected.collect()) == sorted([("create_vertex", "a")] * 5 + [("create_edge", str(i)) for i in range(5)])


def csv_of(tmp_path, vertices, edges):
    for name, text in (("v.csv", "id,label\n" + vertices), ("e.csv", "id,label,from,to\n" + edges)):
        (tmp_path / name).write_text(text)
    return str(tmp_path / "v.csv"), str(tmp_path / "e.csv")


def test_csv_rules(spark, tmp_path):
    files = csv_of(tmp_path, "a,P\n,P\nb,P\n", "1,E,a,b\n")
    check(import_csv(spark, *files)[1], Status.FAILED, vertices_created=1, edges_created=0)
    files = csv_of(tmp_path, "a,P\na,P\nb,\n", "1,E,a,b\n2,,a,z\n3,E,b,a\n")
    with pytest.raises(DuplicateVertexError, match="Duplicate vertex externalId=a"):
        import_csv(spark, *files)
    graph, report = import_csv(spark, *files, SKIP)
    check(report, Status.PARTIAL, vertices_read=3, vertices_created=2, skipped_vertices=1, edges_read=3, edges_created=2, skipped_edges=1)
    assert [f.severity for f in report.failures] == [Severity.WARN] * 2 and {v.label for v in Graph.vertices_of(graph.vertices)} == {"P", "Vertex"}
    files = csv_of(tmp_path, "a,P\nb,P\n", "1,E,a,b\n2,E,a,z\n3,E,b,a\n")
    check(import_csv(spark, *files)[1], Status.FAILED, edges_read=2, edges_created=1)


def test_ndjson(spark, graph, tmp_path):
    at = str(tmp_path / "g")
    export_ndjson(graph, at, ALL)
    assert json.loads(lines_of(at)[0])["type"] == "vertex"
    back, report = import_ndjson(spark, at)
    check(report, vertices_created=3, edges_created=2)
    assert shown(back) == want()
    more, report = import_ndjson(spark, at, graph=back)
    assert more.vertices.count() == 6 and more.vertices.select("id").distinct().count() == 6


def test_ndjson_rules(spark, tmp_path):
    at = tmp_path / "x.jsonl"
    v = lambda i: json.dumps({"type": "vertex", "id": i, "label": "P", "properties": {"n": {"deep": [1, 2.5]}}})
    e = lambda a, b: json.dumps({"type": "edge", "from": a, "to": b})
    read = lambda *lines, **o: at.write_text("\n".join(lines)) and import_ndjson(spark, str(at), GraphImportOptions(**o) if o else SKIP)
    graph, report = read(e("a", "b"), v("a"), "", v("b"), '{"type":"what"}')
    check(report, vertices_created=2, edges_created=1)
    assert [f.severity for f in report.failures] == [Severity.WARN] and [tuple(r) for r in report.rejected.collect()] == [("read_vertex", None, "Unknown type what")]
    assert Graph.vertices_of(graph.vertices)[0].properties["n"] == {"deep": [1, 2.5]}
    _, report = read(v("a"), e("a", "a"), "{oops", v("b"))
    check(report, Status.FAILED, vertices_created=1, edges_created=0, edges_read=1)
    assert report.failures[0].line == 3
    _, report = read(v("a"), *[e("a", "a")] * 3, max_edge_buffer_size=2)
    check(report, Status.FAILED, vertices_created=1, edges_created=0)
    assert "maxEdgeBufferSize" in report.failures[0].message
    _, report = read(v("a"), v("a"), e("a", "z"))
    check(report, Status.PARTIAL, vertices_created=1, skipped_vertices=1, skipped_edges=1)
    assert len(report.failures) == 1  # duplicates are only counted here
    _, report = read(v("a"), e("a", "a"), e("a", "z"), e("a", "a"), max_edge_buffer_size=10)
    check(report, Status.FAILED, edges_created=1, edges_read=3)
    with pytest.raises(ValueError):
        read('{"type":"vertex","label":"P"}')


def test_graphml(spark, graph, tmp_path):
    at = str(tmp_path / "g")
    export_graphml(graph, at, ALL)
    back, report = import_graphml(spark, at)
    check(report, vertices_created=3, edges_created=2)
    assert shown(back) == want()
    export_graphml(graph, at, ALL, GraphMlExportOptions(label_attr_name="kind", graph_id="H", legacy_string_types=True))
    text = "\n".join(lines_of(at))
    assert text.startswith("<?xml") and text.endswith("</graphml>") and text.index("<node") < text.index("<edge")
    assert '<graph id="H" edgedefault="directed">' in text and 'attr.type="long"' not in text
    assert shown(import_graphml(spark, at, xml=GraphMlImportOptions(label_attr_name="kind"))[0]) == want(as_text=True)
    export_graphml(graph, at, ALL, GraphMlExportOptions(one_file=True))
    assert len(glob.glob(f"{at}/part-*")) == 1 and shown(import_graphml(spark, at)[0]) == want()


def test_graphml_rules(spark, tmp_path):
    at = tmp_path / "x.graphml"
    at.write_text("""<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">
        <key id="d0" for="node" attr.name="age" attr.type="int"/><key id="d1" for="node" attr.name="label" attr.type="string"/>
        <graph id="G" edgedefault="directed">
        <node id="a"><data key="d0">7</data><data key="d1">P</data><data key="free">x</data></node><node id="b"><data key="d0">old</data></node><node><data key="d0">1</data></node>
        <edge source="a" target="b"/><edge id="e2" target="b"/><hyperedge/></graph></graphml>""")
    graph, report = import_graphml(spark, str(at))
    check(report, vertices_created=2, edges_created=1)
    assert len(report.failures) == 2 and sorted((r["phase"], r["record_id"]) for r in report.rejected.collect()) == [("read_edge", "e2"), ("read_vertex", None)]
    got = {v.properties.pop("_graphIoExternalId"): (v.label, v.properties) for v in Graph.vertices_of(graph.vertices)}
    assert got == {"a": ("P", {"age": 7, "free": "x"}), "b": ("Vertex", {"age": "old"})}
    assert [(e.label, e.properties) for e in Graph.edges_of(graph.edges)] == [("EDGE", {})]
    check(import_graphml(spark, str(at), xml=GraphMlImportOptions(unsupported_element_policy=UnsupportedElementPolicy.FAIL))[1], Status.FAILED, vertices_created=0)


NESTED = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE graphml [ <!ELEMENT x (a|b)> ]>
<g:graphml xmlns:g="http://graphml.graphdrawing.org/xmlns">
  <!-- <hyperedge > and <node id="no"> don't count, <port/> neither -->
  <g:key id="d0" for="node" attr.name="n" attr.type="int"/><key id='d1' for="all" attr.name="label"><default>D</default></key>
  <?note <node id="no"/> ?><graph id="G" edgedefault="directed">
    <node id="a&gt;&#x41;&quot;>"><data key="d0">1</data><data key="t"><![CDATA[<node id="no"/> ]] > &amp; ]]> &lt;x&gt;>&#233;</data>
      <graph id="in"><node id="b"><data key="d1">Q</data><data key="d0">2</data><data key="d0">3</data></node>
        <edge source="b" target="c"/><node id="c"/></graph>
      <data key="last">after</data></node>
    <edge id='e' source='a>A">' target='b'><data key="d0">x</data></edge>
    <node id=" "/>
  </graph></g:graphml>
"""


def nested(graph):
    v = {x.properties.pop("_graphIoExternalId"): (x.label, x.properties) for x in Graph.vertices_of(graph.vertices)}
    e = sorted((x.label, json.dumps(x.properties)) for x in Graph.edges_of(graph.edges))
    assert v == {'a>A">': ("Vertex", {"n": 1, "t": '<node id="no"/> ]] > &amp;  <x>>é', "last": "after"}), "b": ("Q", {"n": 3}), "c": ("Vertex", {})}
    assert e == [("EDGE", '{"_graphIoExternalId": "e", "n": "x"}'), ("EDGE", "{}")]


def test_nested_graphml(spark, tmp_path):
    at = tmp_path / "n.graphml"
    at.write_text(NESTED)
    graph, report = import_graphml(spark, str(at))
    check(report, vertices_created=3, edges_created=2)
    nested(graph)
    assert len(report.failures) == 1
    fail = GraphMlImportOptions(unsupported_element_policy=UnsupportedElementPolicy.FAIL)
    _, report = import_graphml(spark, str(at), xml=fail)
    check(report, Status.FAILED, vertices_created=0)
    assert report.failures[0].message == "Unsupported element graph"
    flat = NESTED.replace('<graph id="in">', "").replace('target="c"/><node id="c"/></graph>', 'target="c"/><node id="c"/>')
    at.write_text(flat)
    check(import_graphml(spark, str(at), xml=fail)[1], vertices_created=3)
    for bad in (NESTED.replace("</graph></g:graphml>", "</g:graphml>"), NESTED.replace("</g:graphml>", ""), "<graphml><!-- </graphml>"):
        at.write_text(bad)
        with pytest.raises(Exception, match="closes|ends within"):
            import_graphml(spark, str(at))


def test_graphml_is_read_in_blocks(spark, tmp_path):
    """Blocks may begin anywhere: within comments, CDATA, attributes, open elements and inner graphs."""
    at = tmp_path / "n.graphml"
    at.write_text(NESTED)
    keep = Scratch()
    want = sorted((r["kind"], sorted(r["attributes"].items()), r["data"]) for r in graphml_events.read_events(spark, str(at), "UTF-8", keep).collect())
    assert len(want) == 9
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(NESTED.encode()) // 11))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        events = graphml_events.read_events(spark, str(at), "UTF-8", keep)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes"), spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r["kind"], sorted(r["attributes"].items()), r["data"]) for r in events.collect()) == want
    assert events.select("block").distinct().count() > 3


def test_events_of_every_cut():
    """A document cut behind any > gives the same records, from the states in which the blocks before end."""
    pieces = NESTED.split(">")
    last = pieces.pop()
    assert not last.strip()

    def records(cuts):
        state, rows = (graphml_events.TEXT, ""), []
        for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(pieces)])):
            reader = graphml_events.Reader(state)
            for p in pieces[a:b]:
                reader.feed(p)
            state = (reader.mode, reader.held)
            reader.end()
            rows += [{"file": "f", "block": i, "n": n, "kind": k, "attributes": x, "data": [{"key": a, "value": b} for a, b in d]} for n, k, x, d in reader.rows]
        whole = [r for r in rows if r["kind"] in (*graphml_events.RECORDS, "unsupported")]
        made = graphml_events._put_together([r for r in rows if r not in whole])
        return sorted((kind, sorted(a.items()), [tuple(x.values()) for x in d]) for kind, a, d in [*((r["kind"], r["attributes"], r["data"]) for r in whole), *((m[3], m[4], m[5]) for m in made)])

    want = records([])
    assert len(want) == 9
    for i in range(1, len(pieces)):
        assert records([i]) == want, i
    for cut in ([3, 9, 20], list(range(1, len(pieces), 2)), list(range(1, len(pieces)))):
        assert records(cut) == want


def test_a_failed_export_changes_nothing(spark, graph, tmp_path):
    """Targets are replaced as a whole, both folders of CSV together."""
    v, e, n, x = (str(tmp_path / k) for k in "venx")
    export_csv(graph, v, e, ALL), export_ndjson(graph, n, ALL), export_graphml(graph, x, ALL)
    before = {k: lines_of(k) for k in (v, e, n, x)}
    bad = Graph(graph.vertices, graph.edges.withColumn("dst", F.when(F.col("id") == "8", F.raise_error(F.lit("broken"))).otherwise(F.col("dst"))))
    for export in (lambda: export_csv(bad, v, e, ALL), lambda: export_ndjson(bad, n, ALL), lambda: export_graphml(bad, x, ALL)):
        with pytest.raises(Exception, match="broken"):
            export()
    assert {k: lines_of(k) for k in (v, e, n, x)} == before
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == sorted("venx")
    export_ndjson(graph, n, ALL, append=True)
    assert sorted(lines_of(n)) == sorted(before[n] * 2)
    export_ndjson(import_ndjson(spark, n, SKIP)[0], n, ALL)
    assert len(lines_of(n)) == len(before[n]) + len([x for x in before[n] if '"edge"' in x])


def test_saved_graphs_are_laid_out_for_look_ups(spark, tmp_path):
    import pyarrow.parquet as pq

    from lattica.catalog import GraphCatalog
    from lattica.options import EngineConfig

    vertices = spark.range(5000).selectExpr("concat('v', lpad(id, 5, '0')) as id", "if(id % 2 = 0, 'P', 'Q') as label", "id as n")
    edges = vertices.selectExpr("concat('e', n) as id", "'E' as label", "id as src", "'v00000' as dst")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        saved = GraphCatalog(spark, EngineConfig(str(tmp_path))).save("g", Graph(vertices, edges))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = saved.find_vertex_by_id("P", "v00042")
    assert found.first()["n"] == 42 and "EqualTo(id,v00042)" in found._jdf.queryExecution().executedPlan().toString()
    files = [pq.ParquetFile(f).metadata.row_group(0) for f in glob.glob(f"{tmp_path}/g/*/vertices/*.parquet")]
    ranges = sorted((g.column(1).statistics.min, g.column(0).statistics.min, g.column(0).statistics.max, g.column(1).statistics.max) for g in files)
    assert len(ranges) > 3 and sum(lo <= "v00042" <= hi and label == "P" for label, lo, hi, _ in ranges) <= 2
