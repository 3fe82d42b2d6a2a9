"""What grows with the input, seen on small graphs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lattica.graph import Graph
from lattica.llm import fingerprints
from lattica.operators import cycles, depth_first
from lattica.operators.components import connected_components
from lattica.operators.pagerank import page_rank
from lattica.options import UNBOUNDED, BfsDfsOptions, CycleOptions, PageRankOptions
from lattica.plans import storage


def graph_of(spark, names, pairs) -> Graph:
    return Graph.from_rows(spark, [(v, "N") for v in names], [(f"e{i}", "E", a, b) for i, (a, b) in enumerate(pairs)])


@pytest.fixture
def rows_stored(monkeypatch):
    """[(name, rows)] of tables stored with their rows seen, in order."""
    seen, real = [], storage.stored_seeing

    def spy(df, name, **facts):
        out, found = real(df, name, **facts)
        seen.append((name, found.get("n")))
        return out, found

    monkeypatch.setattr(storage, "stored_seeing", spy)
    return seen


def test_components_move_fewer_edges_each_round(spark, monkeypatch, rows_stored):
    monkeypatch.setattr("lattica.plans.components.SMALL", 0)
    names = [f"{i:03}" for i in range(90)]
    rows = connected_components(graph_of(spark, [*names, "alone", "alone"], list(zip(names, names[1:])))).collect()
    assert {r["vertex_id"] for r in rows if r["component_id"] == "000" and r["size"] == 90} == set(names)
    assert [r["size"] for r in rows if r["vertex_id"] == "alone"] == [2, 2]
    edges = [n for name, n in rows_stored if name == "cc"]
    assert edges == sorted(edges, reverse=True) and sum(edges) <= 5 * 89


def test_ranks_alike_to_some_decimals_are_ties(spark):
    """Shares added in another order differ in their last bits only; the smaller id goes first all the same."""
    pairs = [("hub", "b"), ("hub", "a"), ("x", "b"), ("y", "a"), ("b", "hub"), ("a", "hub"), ("z", "a"), ("x", "x")]
    graph = graph_of(spark, ["hub", "a", "b", "x", "y", "z"], pairs)
    exact = [r["vertex_id"] for r in page_rank(graph, PageRankOptions(iterations=3, top_k=6)).collect()]
    tied = [r["vertex_id"] for r in page_rank(graph, PageRankOptions(iterations=3, top_k=6, tie_digits=0)).collect()]
    assert exact[0] == "hub" and tied == sorted(tied)


def test_cycles_through_a_vertex_leave_the_rest_of_the_graph_alone(spark, monkeypatch):
    monkeypatch.setattr(cycles, "STRONG_FROM", 0), monkeypatch.setattr(cycles, "strong_roots", None)
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("p", "q"), ("q", "p"), ("c", "c")]
    got = cycles.cycles_through(graph_of(spark, "abcpq", pairs), "a", CycleOptions(max_depth=5)).collect()
    assert [r["vertex_ids"] for r in got] == [["a", "b", "a"], ["a", "b", "c", "a"]]


def test_depth_first_on_a_short_chain_leaves_the_rest_of_the_graph_alone(spark, monkeypatch):
    monkeypatch.setattr(depth_first, "_one_way_in", None)
    names = [f"v{i:02}" for i in range(15)]
    rows = depth_first.dfs(graph_of(spark, [], [*zip(names, names[1:]), ("x", "y")]), "v00", BfsDfsOptions(max_depth=UNBOUNDED, max_vertices=UNBOUNDED)).collect()
    assert sorted((r["visit_order"], r["vertex_id"], r["depth"]) for r in rows) == [(i, v, i) for i, v in enumerate(names)]


def test_large_stored_tables_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(storage, "SENT", 5)
    plan = lambda n: (lambda t: t.join(t.select("id", (t.id * 2).alias("x")), "id")._jdf.queryExecution().optimizedPlan().toString())(storage.stored_seeing(spark.range(n), "t", n=F.count("*"))[0])
    assert "merge" in plan(6) and "merge" not in plan(5)


def test_likeness_of_long_texts_is_taken_from_full_sets(spark):
    a = " ".join(f"w{i}" for i in range(1000))
    b = " ".join(f"w{i + 300}" for i in range(1000))
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_report(df, whole=True).collect()}
    assert got[1]["near_next"] == got[2]["near_next"] == 696 / 996
    shares = queries()["fingerprint_likeness"](spark, "/root/testdata/sf0.001")
    assert shares.where("near_edited is null or near_next is null").isEmpty()


def test_shingles_are_made_behind_the_sort_and_not_from_slices(spark):
    """Only texts are moved and sorted; a run of words is not cut out as an array first, which took most of the time."""
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "b c d e f")], "doc_id long, text string")
    out = fingerprints.fingerprint_report(df, whole=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "slice(" not in plan and "transform(" in plan and "transform(" not in plan.split("Sort [bucket")[1]
    assert [(r["n_shingles"], r["near_next"]) for r in out.orderBy("doc_id").collect()] == [(2, 1.0), (1, 1.0)]


def test_rows_of_large_tables_are_dealt_before_they_are_grouped(spark, monkeypatch):
    """Tasks that put rows into hash tables get so many bytes of a table, not a split of its files; the degrees are the same."""
    degree_all = queries()["degree_all"]
    whole = sorted(map(tuple, degree_all(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr("lattica.plans.views.PIECE", 1_000)
    dealt = degree_all(spark, "/root/testdata/sf0.001")
    assert dealt._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
    assert sorted(map(tuple, dealt.collect())) == whole
