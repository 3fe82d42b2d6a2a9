"""Named queries over the views of :mod:`lattica.plans.views`, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lattica.functions import agtype
from lattica.functions.literals import cypher_string
from lattica.functions.paths import path_text
from lattica.graph import Graph
from lattica.model import Direction
from lattica.operators.components import connected_components
from lattica.operators.cycles import cycles_through, detect_cycles
from lattica.operators.degree import degree_centrality, degrees
from lattica.operators.depth_first import dfs
from lattica.operators.pagerank import page_rank
from lattica.operators.reach import distances_from, reached_by
from lattica.operators.search import bfs
from lattica.operators.traversal import all_paths, count_paths, neighbors, shortest_path, shortest_path_lengths
from lattica.options import UNBOUNDED, BfsDfsOptions, ComponentOptions, CsvOptions, CsvPropertyMode, CycleOptions, DegreeOptions, DuplicatePolicy, GraphExportOptions, GraphImportOptions, MissingEndpointPolicy, NeighborOptions, PageRankOptions, PathOptions
from lattica.plans import views
from lattica.plans.storage import fresh_path
from lattica.sources.csv_io import export_csv, import_csv
from lattica.sources.graphml_io import export_graphml, import_graphml, whole_documents
from lattica.sources.ndjson_io import export_ndjson, import_ndjson

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# The views in SQL --------------------------------------------------------------------------------------------------

GEO = """gv AS (
    SELECT 'region:' || r_regionkey AS id, 'Region' AS label, r_name AS name, CAST(NULL AS DOUBLE) AS balance FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name, NULL FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'Customer', c_name, c_acctbal FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', s_name, s_acctbal FROM supplier
), ge AS (
    SELECT 'in:' || n_nationkey AS id, 'IN_REGION' AS label, 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation
    UNION ALL SELECT 'lives:' || c_custkey, 'LIVES_IN', 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
    UNION ALL SELECT 'based:' || s_suppkey, 'BASED_IN', 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
)"""
TRADE = """te AS (
    SELECT DISTINCT 'nation:' || s_nationkey AS src, 'nation:' || c_nationkey AS dst
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE s_nationkey <> c_nationkey
), tv AS (SELECT 'nation:' || n_nationkey AS id FROM nation), origin AS (SELECT min(src) AS v FROM te)"""
BIPARTITE = """be AS (SELECT DISTINCT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst FROM lineitem),
    bv AS (SELECT 'supplier:' || s_suppkey AS id FROM supplier UNION ALL SELECT 'part:' || p_partkey FROM part)"""
SALES = """sv AS (
    SELECT 'customer:' || c_custkey AS id, 'Customer' AS label, c_mktsegment AS kind, c_acctbal AS amount FROM customer
    UNION ALL SELECT 'order:' || o_orderkey, 'Order', o_orderstatus, o_totalprice FROM orders
    UNION ALL SELECT 'part:' || p_partkey, 'Part', p_brand, p_retailprice FROM part
), se AS (
    SELECT 'placed:' || o_orderkey AS id, 'PLACED' AS label, 'customer:' || o_custkey AS src, 'order:' || o_orderkey AS dst, CAST(NULL AS VARCHAR) AS flag, CAST(NULL AS DOUBLE) AS quantity FROM orders
    UNION ALL SELECT concat_ws(':', 'item', l_orderkey, l_partkey, l_returnflag), 'CONTAINS', 'order:' || l_orderkey, 'part:' || l_partkey, l_returnflag, sum(l_quantity)
    FROM lineitem GROUP BY l_orderkey, l_partkey, l_returnflag
)"""
HANDOFF = """he AS (
    SELECT DISTINCT src, dst FROM (
        SELECT 'user:' || user_id AS src, lead('user:' || user_id) OVER (ORDER BY ts, event_id) AS dst FROM events WHERE event_type = 'purchase'
    ) WHERE dst <> src
), hv AS (SELECT DISTINCT 'user:' || user_id AS id FROM events WHERE event_type = 'purchase')"""

CHAINS = """ce AS (SELECT src || '>' || dst AS id, src, dst FROM (
        SELECT 'order:' || o_orderkey AS src, 'order:' || lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders
    ) WHERE dst IS NOT NULL), cv AS (SELECT 'order:' || o_orderkey AS id FROM orders)"""
HABITS = """ae AS (SELECT DISTINCT src, dst FROM (
        SELECT concat_ws(':', 'habit', user_id, event_type) AS src, concat_ws(':', 'habit', user_id, lead(event_type) OVER w) AS dst, event_type AS a, lead(event_type) OVER w AS b,
            epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    ) WHERE gap <= 7200000000 AND a <> b), av AS (SELECT DISTINCT concat_ws(':', 'habit', user_id, event_type) AS id FROM events)"""


def _query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return keep


def _origin(graph: Graph) -> str:
    """The smallest source of an edge."""
    return graph.edges.agg(F.min("src")).first()[0] or "nation:0"


# Vertices and edges --------------------------------------------------------------------------------------------------


@_query(f"WITH {GEO} SELECT id, name, balance FROM gv WHERE label = 'Supplier'")
def find_vertices_by_label(spark, sf_dir):
    return views.geo(spark, sf_dir).find_vertices_by_label("Supplier").select("id", "name", "balance")


@_query(f"WITH {SALES} SELECT id, amount FROM sv WHERE label = 'Customer' AND kind = 'BUILDING'")
def find_vertices_filter(spark, sf_dir):
    return views.sales(spark, sf_dir).find_vertices_by_label("Customer", {"kind": "BUILDING"}).select("id", "amount")


@_query(f"WITH {GEO} SELECT id, label, name FROM gv WHERE id = 'customer:7' AND label = 'Customer'")
def find_vertex_by_id(spark, sf_dir):
    return views.geo(spark, sf_dir).find_vertex_by_id("Customer", "customer:7").select("id", "label", "name")


@_query(f"WITH {SALES} SELECT label, count(*) AS vertices FROM sv GROUP BY label")
def count_vertices_by_label(spark, sf_dir):
    return views.sales(spark, sf_dir).counts_by_label()


@_query(f"WITH {GEO} SELECT id, src, dst FROM ge WHERE label = 'BASED_IN'")
def find_edges_by_label(spark, sf_dir):
    return views.geo(spark, sf_dir).find_edges_by_label("BASED_IN").select("id", "src", "dst")


@_query(f"WITH {SALES} SELECT id, src, dst, quantity FROM se WHERE label = 'CONTAINS' AND flag = 'R'")
def find_edges_filter(spark, sf_dir):
    return views.sales(spark, sf_dir).find_edges_by_label("CONTAINS", {"flag": "R"}).select("id", "src", "dst", "quantity")


@_query(f"WITH {SALES} SELECT label, count(*) AS edges FROM se GROUP BY label")
def edge_counts_by_label(spark, sf_dir):
    return views.sales(spark, sf_dir).edge_counts_by_label()


@_query(f"WITH {SALES} SELECT id, label, CASE WHEN label = 'Customer' AND kind = 'BUILDING' THEN 'HOUSING' ELSE kind END AS kind, CASE WHEN label = 'Customer' AND kind = 'BUILDING' THEN NULL ELSE amount END AS amount FROM sv")
def update_vertex_merge(spark, sf_dir):
    hit = F.col("kind") == "BUILDING"
    graph = views.sales(spark, sf_dir).update_vertices("Customer", {"amount": None}, where=hit)
    return graph.update_vertices("Customer", {"kind": "HOUSING"}, where=hit).vertices


@_query(f"""WITH {SALES}, gone AS (SELECT id FROM sv WHERE label = 'Customer' AND kind = 'BUILDING')
    SELECT label, count(*) AS elements FROM (SELECT label FROM sv WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT label FROM se WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)) GROUP BY label""")
def delete_vertex_detach(spark, sf_dir):
    graph = views.sales(spark, sf_dir)
    left = graph.delete_vertices(graph.find_vertices_by_label("Customer", {"kind": "BUILDING"}))
    return left.vertices.select("label").union(left.edges.select("label")).groupBy("label").agg(F.count("*").alias("elements"))


@_query(f"WITH {SALES} SELECT label, count(*) AS edges FROM se WHERE flag IS DISTINCT FROM 'R' GROUP BY label")
def delete_edge(spark, sf_dir):
    graph = views.sales(spark, sf_dir)
    return graph.delete_edges(graph.find_edges_by_label("CONTAINS", {"flag": "R"})).edge_counts_by_label()


@_query(f"WITH {GEO} SELECT id, label, name FROM gv UNION ALL SELECT 'part:' || p_partkey, 'Part', p_name FROM part")
def create_vertices_bulk(spark, sf_dir):
    parts = views.table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.lit("Part").alias("label"), F.col("p_name").alias("name"))
    return views.geo(spark, sf_dir).add_vertices(parts).vertices.select("id", "label", "name")


_NEW_EDGES = "SELECT 'order:' || o_orderkey AS id, 'customer:' || o_custkey AS src, 'nation:' || (o_custkey % 40) AS dst FROM orders"


def _new_edges(spark, sf_dir) -> DataFrame:
    key = F.col("o_custkey")
    return views.table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("id"), F.lit("SENT_TO").alias("label"), F.concat(F.lit("customer:"), key).alias("src"), F.concat(F.lit("nation:"), key % 40).alias("dst"))


@_query(f"WITH {GEO}, n AS ({_NEW_EDGES}) SELECT id, src, dst FROM n WHERE src IN (SELECT id FROM gv) AND dst IN (SELECT id FROM gv)")
def create_edges_bulk(spark, sf_dir):
    graph = views.geo(spark, sf_dir).add_edges(_new_edges(spark, sf_dir))
    return graph.find_edges_by_label("SENT_TO").select("id", "src", "dst")


@_query(f"WITH {GEO}, n AS ({_NEW_EDGES}) SELECT id, src, dst FROM n WHERE src NOT IN (SELECT id FROM gv) OR dst NOT IN (SELECT id FROM gv)")
def missing_endpoints(spark, sf_dir):
    return views.geo(spark, sf_dir).missing_endpoints(_new_edges(spark, sf_dir)).select("id", "src", "dst")


# Traversals ----------------------------------------------------------------------------------------------------------

_STEPS = {"out": "SELECT src AS a, dst AS b FROM te", "in": "SELECT dst AS a, src AS b FROM te", "both": "SELECT src AS a, dst AS b FROM te UNION ALL SELECT dst, src FROM te"}
_WAYS = {"out": Direction.OUTGOING, "in": Direction.INCOMING, "both": Direction.BOTH}


def _neighbor_query(way: str, depth: int):
    sql = f"""WITH RECURSIVE {TRADE}, steps AS ({_STEPS[way]}), walk AS (SELECT v, 0 AS d FROM origin UNION SELECT b, d + 1 FROM walk JOIN steps ON a = v WHERE d < {depth})
        SELECT DISTINCT v AS id FROM walk WHERE d > 0"""

    @_query(sql, f"neighbors_{way}_d{depth}")
    def run(spark, sf_dir):
        graph = views.trade(spark, sf_dir)
        return neighbors(graph, _origin(graph), NeighborOptions("TRADES", _WAYS[way], depth)).select("id")


for _way in _WAYS:
    for _depth in (1, 2, 3):
        _neighbor_query(_way, _depth)


@_query(f"WITH {GEO} SELECT src AS id FROM ge WHERE dst = 'nation:3' UNION SELECT dst FROM ge WHERE src = 'nation:3'")
def neighbors_any_label(spark, sf_dir):
    return neighbors(views.geo(spark, sf_dir), "nation:3", NeighborOptions(direction=Direction.BOTH)).select("id")


def _levels_sql(edges: str, depth: int, start: str, name: str = "l") -> str:
    """Levels {name}0, {name}1, ... of a search over edges of either direction, with the levels before them as {name}s."""
    parts = [f"{name}0 AS (SELECT ({start}) AS v, 0 AS d), {name}s0 AS (SELECT * FROM {name}0)"]
    for i in range(1, depth + 1):
        parts.append(f"""{name}{i} AS MATERIALIZED (SELECT DISTINCT b AS v, {i} AS d FROM {edges} JOIN {name}{i - 1} ON a = v WHERE b NOT IN (SELECT v FROM {name}s{i - 1})),
            {name}s{i} AS MATERIALIZED (SELECT * FROM {name}s{i - 1} UNION ALL SELECT * FROM {name}{i})""")
    return ", ".join(parts)


_BOTH = "steps AS MATERIALIZED (SELECT src AS a, dst AS b, src || '>' || dst AS e FROM be UNION ALL SELECT dst, src, src || '>' || dst FROM be)"
_LEVELS = f"WITH {BIPARTITE}, {_BOTH}, {_levels_sql('steps', 10, 'SELECT min(src) FROM be')}"


@_query(_LEVELS + " SELECT v AS id, CAST(d AS INTEGER) AS distance FROM ls10")
def shortest_path_lengths_all(spark, sf_dir):
    graph = views.bipartite(spark, sf_dir).stored()
    return shortest_path_lengths(graph, _origin(graph), PathOptions("SUPPLIES", 10))


_PAIR = f"WITH {BIPARTITE}, {_BOTH}, s AS (SELECT min(src) AS v FROM be), {_levels_sql('steps', 6, 'SELECT v FROM s')}, t AS (SELECT max(v) AS v FROM ls6 WHERE d > 0)"


def _shortest_sql(depth: int, head: str = _PAIR) -> str:
    """Of each vertex on a level, back from the end, the best rest of a path."""
    levels = f"ls{depth}"
    parts = [f"{head}, r{depth} AS (SELECT v, [v] AS p, CAST([] AS VARCHAR[]) AS es FROM {levels} WHERE v = (SELECT v FROM t) AND d = {depth})"]
    for i in range(depth - 1, -1, -1):
        step = f"SELECT a AS v, list_prepend(a, p) AS p, list_prepend(e, es) AS es FROM steps JOIN l{i} ON a = l{i}.v JOIN r{i + 1} ON b = r{i + 1}.v"
        end = f" UNION ALL SELECT v, [v], CAST([] AS VARCHAR[]) FROM {levels} WHERE v = (SELECT v FROM t) AND d = {i}"
        parts.append(f"r{i} AS MATERIALIZED (SELECT v, m.p AS p, m.es AS es FROM (SELECT v, min({{'p': p, 'es': es}}) AS m FROM ({step}{end}) GROUP BY v))")
    return ", ".join(parts) + " SELECT array_to_string(p, '>') AS path, CAST(len(es) AS INTEGER) AS length FROM r0 WHERE v = (SELECT v FROM s)"


def _far_pair(spark, sf_dir) -> tuple[Graph, str, str]:
    graph = views.bipartite(spark, sf_dir).stored()
    start = _origin(graph)
    return graph, start, shortest_path_lengths(graph, start, PathOptions("SUPPLIES", 6)).where("distance > 0").agg(F.max("id")).first()[0]


@_query(_shortest_sql(6), "shortest_path")
def _shortest(spark, sf_dir):
    graph, a, b = _far_pair(spark, sf_dir)
    return shortest_path(graph, a, b, PathOptions("SUPPLIES", 6)).select(path_text().alias("path"), "length")


def _walks_sql(head: str, depth: int) -> str:
    """All simple paths of up to ``depth`` edges from s to t, edge by edge; they end at the goal."""
    parts = [f"{head}, p0 AS (SELECT [v] AS p, v FROM s)"]
    for i in range(1, depth + 1):
        end = "b = (SELECT v FROM t) AND " if i == depth else ""
        parts.append(f"p{i} AS (SELECT list_append(p, b) AS p, b AS v FROM p{i - 1} JOIN steps ON a = v WHERE {end}v <> (SELECT v FROM t) AND NOT list_contains(p, b))")
    every = " UNION ALL ".join(f"SELECT p FROM p{i} WHERE v = (SELECT v FROM t)" for i in range(1, depth + 1))
    return ", ".join(parts) + f" SELECT array_to_string(p, '>') AS path, CAST(len(p) - 1 AS INTEGER) AS length FROM ({every})"


_TO_PART = _PAIR.replace("WHERE d > 0)", "WHERE d > 0 AND v LIKE 'part:%')")


def _part_pair(spark, sf_dir) -> tuple[Graph, str, str]:
    graph = views.bipartite(spark, sf_dir).stored()
    start = _origin(graph)
    return graph, start, shortest_path_lengths(graph, start, PathOptions("SUPPLIES", 6)).where("distance > 0 and id like 'part:%'").agg(F.max("id")).first()[0]


# of up to 3 edges: those of 5 are many millions between a supplier and a part
@_query(_walks_sql(_TO_PART, 3), "all_paths")
def _all_paths(spark, sf_dir):
    graph, start, end = _part_pair(spark, sf_dir)
    return all_paths(graph, start, end, PathOptions("SUPPLIES", 3)).select(path_text().alias("path"), "length")


def _counted_sql(head: str, depth: int) -> str:
    """How many simple paths of each length lead from s to t: all walks, step by step, with each vertex unlike those before."""
    parts, counts = [f"{head}, w0 AS (SELECT v AS v0 FROM s)"], []
    for n in range(1, depth + 1):
        seen = ", ".join(f"v{k}" for k in range(n))
        step = f"FROM w{n - 1} JOIN steps ON a = v{n - 1} WHERE b NOT IN ({seen})"
        counts.append(f"SELECT CAST({n} AS INTEGER) AS length, (SELECT count(*) {step} AND b = (SELECT v FROM t)) AS paths")
        parts.append(f"w{n} AS MATERIALIZED (SELECT {seen}, b AS v{n} {step} AND b <> (SELECT v FROM t))")
    return f"{', '.join(parts[:-1])} SELECT length, paths FROM ({' UNION ALL '.join(counts)}) WHERE paths > 0"


# between two suppliers, as halves of 2 edges are enough there; those of 3 from a supplier are millions themselves
@_query(_counted_sql(_PAIR, 4))
def path_counts(spark, sf_dir):
    graph, start, end = _far_pair(spark, sf_dir)
    return count_paths(graph, start, end, PathOptions("SUPPLIES", 4))


# Algorithms ----------------------------------------------------------------------------------------------------------


def _rank_sql(view: str, v: str, e: str, rounds: int, end: str) -> str:
    """Unrolled rounds without tolerance."""
    d = 0.85
    parts = [f"WITH {view}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {v}), od AS (SELECT src, count(*) AS k FROM {e} GROUP BY src)", f"r0 AS (SELECT id, 1.0 / n AS r FROM {v}, n)"]
    for i in range(rounds):
        parts.append(f"""r{i + 1} AS MATERIALIZED (SELECT t.id, (1 - {d}) / n + {d} * (SELECT coalesce(sum(r), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM od)) / n + coalesce(g, 0) AS r
            FROM {v} t CROSS JOIN n LEFT JOIN (SELECT dst, sum({d} * r / k) AS g FROM {e} JOIN od USING (src) JOIN r{i} ON r{i}.id = src GROUP BY dst) x ON x.dst = t.id)""")
    return ", ".join(parts) + ("" if end.startswith(",") else " ") + end.replace("{r}", f"r{rounds}")


def _rounded():
    return F.round("score", 6).alias("score")


@_query(_rank_sql(HANDOFF, "hv", "he", 20, "SELECT id AS vertex_id, round(r, 6) AS score FROM {r}"))
def pagerank(spark, sf_dir):
    return page_rank(views.handoff(spark, sf_dir), PageRankOptions(tolerance=0.0)).select("vertex_id", _rounded())


def _tolerant_sql(view: str, v: str, e: str, rounds: int, tolerance: float) -> str:
    """The first round whose total change is below the tolerance, else the last."""
    changes = ", ".join(f"d{i} AS (SELECT sum(abs(a.r - b.r)) AS d FROM r{i} a JOIN r{i - 1} b USING (id))" for i in range(1, rounds + 1))
    first = f", {changes}, k AS (SELECT min(k) AS k FROM (" + " UNION ALL ".join(f"SELECT {i} AS k FROM d{i} WHERE d < {tolerance}" for i in range(1, rounds + 1)) + f" UNION ALL SELECT {rounds}))"
    every = " UNION ALL ".join(f"SELECT id, r FROM r{i} WHERE (SELECT k FROM k) = {i}" for i in range(1, rounds + 1))
    return _rank_sql(view, v, e, rounds, first + f" SELECT id AS vertex_id, round(r, 6) AS score, row_number() OVER (ORDER BY r DESC, id) AS rank FROM ({every})")


@_query(_tolerant_sql(HANDOFF, "hv", "he", 20, 0.05).replace(" , ", ", "))
def pagerank_tolerance(spark, sf_dir):
    return page_rank(views.handoff(spark, sf_dir), PageRankOptions(tolerance=0.05)).select("vertex_id", _rounded(), "rank")


@_query(_rank_sql(SALES, "sv", "se", 4, "SELECT id AS vertex_id, round(r * 1000000, 4) AS score FROM {r}"))
def pagerank_sales(spark, sf_dir):
    return page_rank(views.sales(spark, sf_dir), PageRankOptions(iterations=4, tolerance=0.0)).select("vertex_id", F.round(F.col("score") * 1_000_000, 4).alias("score"))


@_query(_rank_sql(TRADE, "tv", "te", 5, "SELECT id AS vertex_id, round(r, 6) AS score, row_number() OVER (ORDER BY r DESC, id) AS rank FROM {r} ORDER BY r DESC, id LIMIT 5"))
def pagerank_topk(spark, sf_dir):
    return page_rank(views.trade(spark, sf_dir), PageRankOptions(iterations=5, tolerance=0.0, top_k=5)).select("vertex_id", _rounded(), "rank")


@_query(_rank_sql(GEO + ", fv AS (SELECT id FROM gv WHERE label IN ('Nation', 'Supplier')), fe AS (SELECT src, dst FROM ge WHERE label = 'BASED_IN')", "fv", "fe", 8, "SELECT id AS vertex_id, round(r, 6) AS score FROM {r}"))
def pagerank_label_filtered(spark, sf_dir):
    graph = views.geo(spark, sf_dir)
    own = Graph(graph.vertices.where("label in ('Nation', 'Supplier')"), graph.edges)
    return page_rank(own, PageRankOptions(edge_label="BASED_IN", iterations=8, tolerance=0.0)).select("vertex_id", _rounded())


def _degree_query(name: str, direction: Direction, into: int, out: int):
    one = f"""WITH {TRADE}, c AS (SELECT {into} * (SELECT count(*) FROM te WHERE dst = v) AS i, {out} * (SELECT count(*) FROM te WHERE src = v) AS o, v FROM origin)
        SELECT v AS vertex_id, CAST(i AS INTEGER) AS in_degree, CAST(o AS INTEGER) AS out_degree, CAST(i + o AS INTEGER) AS total FROM c"""

    @_query(one, f"degree_{name}")
    def run(spark, sf_dir):
        graph = views.trade(spark, sf_dir)
        return degree_centrality(graph, _origin(graph), DegreeOptions("TRADES", direction))


for _name, _direction, _into, _out in (("both", Direction.BOTH, 1, 1), ("in", Direction.INCOMING, 1, 0), ("out", Direction.OUTGOING, 0, 1)):
    _degree_query(_name, _direction, _into, _out)


@_query(f"""WITH {SALES}, i AS (SELECT dst AS id, count(*) AS n FROM se GROUP BY dst), o AS (SELECT src AS id, count(*) AS n FROM se GROUP BY src)
    SELECT sv.id AS vertex_id, CAST(coalesce(i.n, 0) AS INTEGER) AS in_degree, CAST(coalesce(o.n, 0) AS INTEGER) AS out_degree, CAST(coalesce(i.n, 0) + coalesce(o.n, 0) AS INTEGER) AS total
    FROM sv LEFT JOIN i ON i.id = sv.id LEFT JOIN o ON o.id = sv.id""")
def degree_all(spark, sf_dir):
    return degrees(views.sales(spark, sf_dir))


def _components_sql(rounds: int, view: str = BIPARTITE, v: str = "bv", e: str = "be") -> str:
    """The smallest id spreads over the edges; ``rounds`` is more than the graph's diameter at the scale of the check."""
    parts = [f"WITH {view}, steps AS MATERIALIZED (SELECT src AS a, dst AS b FROM {e} UNION ALL SELECT dst, src FROM {e}), c0 AS (SELECT id AS v, id AS r FROM {v})"]
    for i in range(1, rounds + 1):
        parts.append(f"c{i} AS MATERIALIZED (SELECT c.v, least(c.r, coalesce(m, c.r)) AS r FROM c{i - 1} c LEFT JOIN (SELECT b, min(r) AS m FROM steps JOIN c{i - 1} ON a = v GROUP BY b) ON b = c.v)")
    return ", ".join(parts) + f", c AS (SELECT v AS vertex_id, r AS component_id FROM c{rounds})"


_COMPONENTS = _components_sql(12)


@_query(_COMPONENTS + " SELECT component_id, vertex_id FROM c")
def components(spark, sf_dir):
    return connected_components(views.bipartite(spark, sf_dir)).select("component_id", "vertex_id")


@_query(_COMPONENTS + " SELECT component_id, count(*) AS size FROM c GROUP BY component_id")
def component_sizes(spark, sf_dir):
    return connected_components(views.bipartite(spark, sf_dir)).select("component_id", "size").distinct()


@_query(_COMPONENTS + " SELECT component_id, vertex_id FROM c WHERE component_id IN (SELECT component_id FROM c GROUP BY component_id HAVING count(*) >= 4)")
def components_min_size(spark, sf_dir):
    return connected_components(views.bipartite(spark, sf_dir), ComponentOptions(min_size=4)).select("component_id", "vertex_id")


@_query(f"""WITH RECURSIVE {TRADE}, reach AS (SELECT id AS v, id AS r FROM tv UNION SELECT dst, r FROM reach JOIN te ON src = v)
    SELECT min(x.r) AS component_id, x.v AS vertex_id FROM reach x JOIN reach y ON x.v = y.r AND x.r = y.v GROUP BY x.v""")
def components_strong(spark, sf_dir):
    return connected_components(views.trade(spark, sf_dir), ComponentOptions(weakly=False)).select("component_id", "vertex_id")


@_query(_components_sql(14, SALES, "sv", "se") + " SELECT component_id, vertex_id FROM c")
def components_sales(spark, sf_dir):
    return connected_components(views.sales(spark, sf_dir)).select("component_id", "vertex_id")


@_query(f"""WITH RECURSIVE {HANDOFF}, reach AS (SELECT id AS v, id AS r FROM hv UNION SELECT dst, r FROM reach JOIN he ON src = v)
    SELECT min(x.r) AS component_id, x.v AS vertex_id FROM reach x JOIN reach y ON x.v = y.r AND x.r = y.v GROUP BY x.v""")
def components_strong_users(spark, sf_dir):
    return connected_components(views.handoff(spark, sf_dir), ComponentOptions(weakly=False)).select("component_id", "vertex_id")


_SALES_LEVELS = f"WITH {SALES}, steps AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM se UNION SELECT dst, src FROM se), {_levels_sql('steps', 3, 'SELECT min(src) FROM se')}"


@_query(_SALES_LEVELS + " SELECT v AS vertex_id, CAST(d AS INTEGER) AS depth FROM ls3")
def bfs_sales(spark, sf_dir):
    graph = views.sales(spark, sf_dir).bare().stored()
    return bfs(graph, _origin(graph), BfsDfsOptions(direction=Direction.BOTH, max_depth=3, max_vertices=UNBOUNDED)).select("vertex_id", "depth")


@_query(f"""WITH RECURSIVE {HANDOFF}, s AS (SELECT min(src) AS v FROM he), walk AS (SELECT v, 0 AS d FROM s UNION SELECT dst, d + 1 FROM walk JOIN he ON src = v WHERE d < 3)
    SELECT v AS vertex_id, CAST(min(d) AS INTEGER) AS depth FROM walk GROUP BY v""")
def bfs_levels(spark, sf_dir):
    graph = views.handoff(spark, sf_dir)
    return bfs(graph, _origin(graph), BfsDfsOptions("HANDS_TO", max_depth=3, max_vertices=UNBOUNDED)).select("vertex_id", "depth")


def _bfs_sql(levels: int, cap: int) -> str:
    """Queue order, level by level: the first finder of a vertex is its parent."""
    parts = [f"WITH {HANDOFF}, b0 AS (SELECT min(src) AS v, 0 AS o, 0 AS d, CAST(NULL AS VARCHAR) AS p FROM he)"]
    seen = "SELECT v FROM b0"
    for i in range(1, levels + 1):
        parts.append(f"""f{i} AS (SELECT dst AS v, b{i - 1}.v AS p, b{i - 1}.o AS po, src || '>' || dst AS e, row_number() OVER (PARTITION BY dst ORDER BY b{i - 1}.o, src || '>' || dst) AS k
            FROM b{i - 1} JOIN he ON src = b{i - 1}.v WHERE dst NOT IN ({seen})),
            b{i} AS (SELECT v, (SELECT max(o) FROM ({' UNION ALL '.join(f'SELECT o FROM b{j}' for j in range(i))})) + row_number() OVER (ORDER BY po, e) AS o, {i} AS d, p FROM f{i} WHERE k = 1)""")
        seen += f" UNION ALL SELECT v FROM b{i}"
    every = " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(levels + 1))
    return ", ".join(parts) + f" SELECT CAST(o AS BIGINT) AS visit_order, v AS vertex_id, CAST(d AS INTEGER) AS depth, p AS parent_id FROM ({every}) WHERE o < {cap}"


@_query(_bfs_sql(3, 10**9))
def bfs_parents(spark, sf_dir):
    graph = views.handoff(spark, sf_dir)
    return bfs(graph, _origin(graph), BfsDfsOptions("HANDS_TO", max_depth=3, max_vertices=UNBOUNDED))


@_query(_bfs_sql(3, 12))
def bfs_capped(spark, sf_dir):
    graph = views.handoff(spark, sf_dir)
    return bfs(graph, _origin(graph), BfsDfsOptions("HANDS_TO", max_depth=3, max_vertices=12))


@_query(f"""WITH {GEO}, n AS (SELECT src AS v, dst AS p, row_number() OVER (ORDER BY id) AS k FROM ge WHERE label = 'IN_REGION' AND dst = 'region:1'),
    l AS (SELECT src AS v, dst AS p, n.k, id AS e FROM ge JOIN n ON dst = n.v),
    every AS (SELECT 'region:1' AS v, 0 AS d, NULL AS p, 0 AS k, '' AS e UNION ALL SELECT v, 1, p, k, '' FROM n UNION ALL SELECT v, 2, p, k, e FROM l)
    SELECT row_number() OVER (ORDER BY k, e) - 1 AS visit_order, v AS vertex_id, CAST(d AS INTEGER) AS depth, p AS parent_id FROM every""")
def dfs_tree_order(spark, sf_dir):
    return dfs(views.geo(spark, sf_dir), "region:1", BfsDfsOptions(direction=Direction.INCOMING, max_depth=3, max_vertices=UNBOUNDED))


_CYCLES = f"""WITH RECURSIVE {TRADE}, c AS (SELECT src AS s, dst AS v, [src, dst] AS p FROM te WHERE dst >= src
    UNION ALL SELECT s, dst, list_append(p, dst) FROM c JOIN te ON src = v WHERE v <> s AND len(p) <= {{depth}} AND (dst = s OR (dst > s AND NOT list_contains(p, dst)))),
    done AS (SELECT array_to_string(p, '>') AS cycle, CAST(len(p) - 1 AS INTEGER) AS length, p FROM c WHERE v = s)"""


@_query(_CYCLES.format(depth=3) + " SELECT cycle, length FROM done")
def cycles_le3(spark, sf_dir):
    return detect_cycles(views.trade(spark, sf_dir), CycleOptions(max_depth=3, max_cycles=UNBOUNDED)).select(path_text().alias("cycle"), "length")


@_query(_CYCLES.format(depth=4) + " SELECT cycle, length FROM done")
def cycles_le4(spark, sf_dir):
    return detect_cycles(views.trade(spark, sf_dir), CycleOptions(max_depth=4, max_cycles=UNBOUNDED)).select(path_text().alias("cycle"), "length")


@_query(_CYCLES.format(depth=3) + " SELECT cycle, length FROM done ORDER BY p LIMIT 5")
def cycles_capped(spark, sf_dir):
    return detect_cycles(views.trade(spark, sf_dir), CycleOptions(max_depth=3, max_cycles=5)).select(path_text().alias("cycle"), "length")


@_query(_CYCLES.format(depth=3) + " SELECT cycle, length FROM done WHERE list_contains(p, (SELECT v FROM origin))")
def cycles_through_vertex(spark, sf_dir):
    graph = views.trade(spark, sf_dir)
    return cycles_through(graph, _origin(graph), CycleOptions(max_depth=3, max_cycles=UNBOUNDED)).select(path_text().alias("cycle"), "length")


# Many components and few edges ---------------------------------------------------------------------------------------

_CHAIN_COMPONENTS = "WITH c AS (SELECT min('order:' || o_orderkey) OVER (PARTITION BY o_custkey) AS component_id, 'order:' || o_orderkey AS vertex_id FROM orders)"


@_query(_CHAIN_COMPONENTS + " SELECT component_id, vertex_id FROM c")
def chain_components(spark, sf_dir):
    return connected_components(views.chains(spark, sf_dir)).select("component_id", "vertex_id")


@_query(_CHAIN_COMPONENTS + " SELECT component_id, count(*) AS size FROM c GROUP BY component_id HAVING count(*) >= 10")
def chain_sizes(spark, sf_dir):
    return connected_components(views.chains(spark, sf_dir), ComponentOptions(min_size=10)).select("component_id", "size").distinct()


def _first_order(graph: Graph) -> str:
    """The smallest vertex that an edge leaves and none enters."""
    return graph.edges.join(graph.edges.select(F.col("dst").alias("src")), "src", "left_anti").agg(F.min("src")).first()[0] or "order:0"


_FIRST_ORDER = f"WITH RECURSIVE {CHAINS}, f AS (SELECT min(src) AS v FROM ce WHERE src NOT IN (SELECT dst FROM ce)), walk AS (SELECT v, 0 AS d, CAST(NULL AS VARCHAR) AS p FROM f UNION ALL SELECT dst, d + 1, src FROM walk JOIN ce ON src = v)"


@_query(_FIRST_ORDER + " SELECT CAST(d AS BIGINT) AS visit_order, v AS vertex_id, CAST(d AS INTEGER) AS depth, p AS parent_id FROM walk")
def chain_dfs(spark, sf_dir):
    graph = views.chains(spark, sf_dir).stored()
    return dfs(graph, _first_order(graph), BfsDfsOptions("NEXT", max_depth=UNBOUNDED, max_vertices=UNBOUNDED))


@_query(_FIRST_ORDER + " SELECT v AS id FROM walk WHERE d BETWEEN 1 AND 3")
def chain_neighbors(spark, sf_dir):
    graph = views.chains(spark, sf_dir).stored()
    return neighbors(graph, _first_order(graph), NeighborOptions("NEXT", max_depth=3)).select("id")


@_query(f"""WITH RECURSIVE {HABITS}, steps AS (SELECT src AS a, dst AS b FROM ae UNION ALL SELECT dst, src FROM ae), reach AS (SELECT id AS v, id AS r FROM av UNION SELECT b, r FROM reach JOIN steps ON a = v)
    SELECT min(r) AS component_id, v AS vertex_id FROM reach GROUP BY v""")
def habit_components(spark, sf_dir):
    return connected_components(views.habits(spark, sf_dir)).select("component_id", "vertex_id")


_HABITS_STRONG = f"""WITH RECURSIVE {HABITS}, reach AS (SELECT id AS v, id AS r FROM av UNION SELECT dst, r FROM reach JOIN ae ON src = v),
    c AS (SELECT min(x.r) AS component_id, x.v AS vertex_id FROM reach x JOIN reach y ON x.v = y.r AND x.r = y.v GROUP BY x.v)"""


@_query(_HABITS_STRONG + " SELECT component_id, vertex_id FROM c")
def habit_components_strong(spark, sf_dir):
    return connected_components(views.habits(spark, sf_dir), ComponentOptions(weakly=False)).select("component_id", "vertex_id")


@_query(_HABITS_STRONG + " SELECT component_id, vertex_id FROM c WHERE component_id IN (SELECT component_id FROM c GROUP BY component_id HAVING count(*) >= 4)")
def habit_components_min_size(spark, sf_dir):
    return connected_components(views.habits(spark, sf_dir), ComponentOptions(weakly=False, min_size=4)).select("component_id", "vertex_id")


_HABIT_CYCLES = _CYCLES.replace(TRADE, HABITS).replace(" te ", " ae ")


@_query(_HABIT_CYCLES.format(depth=5) + " SELECT cycle, length FROM done")
def habit_cycles(spark, sf_dir):
    return detect_cycles(views.habits(spark, sf_dir), CycleOptions(max_depth=5, max_cycles=UNBOUNDED)).select(path_text().alias("cycle"), "length")


@_query(_HABIT_CYCLES.format(depth=4) + " SELECT cycle, length FROM done ORDER BY p LIMIT 40")
def habit_cycles_capped(spark, sf_dir):
    return detect_cycles(views.habits(spark, sf_dir), CycleOptions(max_depth=4, max_cycles=40)).select(path_text().alias("cycle"), "length")


@_query(_rank_sql(HABITS, "av", "ae", 6, "SELECT id AS vertex_id, round(r * 1000, 6) AS score, row_number() OVER (ORDER BY round(r, 12) DESC, id) AS rank FROM {r} ORDER BY round(r, 12) DESC, id LIMIT 10"))
def habit_ranks(spark, sf_dir):
    return page_rank(views.habits(spark, sf_dir), PageRankOptions(iterations=6, tolerance=0.0, top_k=10, tie_digits=12)).select("vertex_id", F.round(F.col("score") * 1000, 6).alias("score"), "rank")


@_query(f"""WITH {HABITS}, i AS (SELECT dst AS id, count(*) AS n FROM ae GROUP BY dst), o AS (SELECT src AS id, count(*) AS n FROM ae GROUP BY src)
    SELECT av.id AS vertex_id, CAST(coalesce(i.n, 0) AS INTEGER) AS in_degree, CAST(coalesce(o.n, 0) AS INTEGER) AS out_degree, CAST(coalesce(i.n, 0) + coalesce(o.n, 0) AS INTEGER) AS total
    FROM av LEFT JOIN i ON i.id = av.id LEFT JOIN o ON o.id = av.id""")
def habit_degrees(spark, sf_dir):
    return degrees(views.habits(spark, sf_dir))


# Files ---------------------------------------------------------------------------------------------------------------

_ALL_GEO = GraphExportOptions(frozenset({"Nation", "Supplier", "Region", "Customer"}), frozenset({"IN_REGION", "BASED_IN", "LIVES_IN"}))
_TRIP = f"""WITH {GEO} SELECT label, name AS text, balance AS number FROM gv
    UNION ALL SELECT e.label, a.name || '>' || b.name, NULL FROM ge e JOIN gv a ON a.id = e.src JOIN gv b ON b.id = e.dst"""


def _trip(graph: Graph, text: str = "name") -> DataFrame:
    """What came back, told by names or another property of vertices: ids are new."""
    get = lambda name, kind: F.try_variant_get("properties", f"$.{name}", kind)
    v = graph.vertices.select("id", "label", get(text, "string").alias("text"), get("balance", "double").alias("number"))
    ends = v.select("id", "text")
    e = graph.edges.join(ends.select(F.col("id").alias("src"), F.col("text").alias("a")), "src").join(ends.select(F.col("id").alias("dst"), F.col("text").alias("b")), "dst")
    return v.drop("id").union(e.select("label", F.concat("a", F.lit(">"), "b"), F.lit(None).cast("double")))


def _csv(spark, sf_dir, options: GraphExportOptions, csv: CsvOptions = CsvOptions(), text: str = "name") -> DataFrame:
    at = fresh_path(spark, "csv")
    export_csv(views.geo(spark, sf_dir), f"{at}/v", f"{at}/e", options, csv)
    return _trip(import_csv(spark, f"{at}/v", f"{at}/e", csv=csv)[0], text)


@_query(_TRIP)
def csv_roundtrip(spark, sf_dir):
    return _csv(spark, sf_dir, _ALL_GEO)


@_query(_TRIP)
def csv_roundtrip_raw_json(spark, sf_dir):
    return _csv(spark, sf_dir, _ALL_GEO, CsvOptions(CsvPropertyMode.RAW_JSON))


# no property is written: what comes back are labels, ends and the ids that the files had
@_query(f"WITH {GEO} SELECT label, id AS text, CAST(NULL AS DOUBLE) AS number FROM gv UNION ALL SELECT label, src || '>' || dst, NULL FROM ge")
def csv_roundtrip_none(spark, sf_dir):
    return _csv(spark, sf_dir, _ALL_GEO, CsvOptions(CsvPropertyMode.NONE), GraphImportOptions().preserve_external_id_property)


def _ndjson(spark, sf_dir, options: GraphExportOptions) -> DataFrame:
    at = fresh_path(spark, "ndjson")
    export_ndjson(views.geo(spark, sf_dir), at, options)
    return _trip(import_ndjson(spark, at, GraphImportOptions())[0])


@_query(_TRIP)
def ndjson_roundtrip(spark, sf_dir):
    return _ndjson(spark, sf_dir, _ALL_GEO)


def _graphml(spark, sf_dir, options: GraphExportOptions) -> DataFrame:
    at = fresh_path(spark, "graphml")
    export_graphml(views.geo(spark, sf_dir), at, options)
    return _trip(import_graphml(spark, at)[0])


@_query(_TRIP)
def graphml_roundtrip(spark, sf_dir):
    return _graphml(spark, sf_dir, _ALL_GEO)


@_query("SELECT 'nation:' || n_nationkey AS external, 'Nation' AS label, n_name AS name, NULL AS balance FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'Customer', c_name, c_acctbal FROM customer")
def graphml_nested(spark, sf_dir):
    """Nations whose customers stand in a graph within the nation's node."""
    nation, customer = views.table(spark, sf_dir, "nation"), views.table(spark, sf_dir, "customer")
    data = lambda key, value: F.concat(F.lit(f'<data key="{key}">'), value.cast("string"), F.lit("</data>"))
    key, line = F.col("key"), lambda n, *parts: F.struct(F.lit(n).alias("n"), F.concat(*parts).alias("line"))
    opening = line(0, F.lit('<node id="nation:'), key.cast("string"), F.lit('">'), data("l", F.lit("Nation")), F.lit('<graph edgedefault="directed"><!-- <node> -->'))
    closing = line(2, F.lit("</graph>"), data("n", F.col("name")), F.lit("</node>"))
    inner = line(1, F.lit('<node id="customer:'), F.col("c_custkey").cast("string"), F.lit('">'), data("l", F.lit("Customer")), data("n", F.col("c_name")), data("b", F.col("c_acctbal")), F.lit("</node>"))
    lines = nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).select("key", F.explode(F.array(opening, closing)).alias("x")).union(customer.select(F.col("c_nationkey"), inner))
    head = '<graphml><key id="l" attr.name="label"/><key id="n" attr.name="name"/><key id="b" attr.name="balance" attr.type="double"/><graph edgedefault="directed">'
    at = fresh_path(spark, "nested")
    placed = lines.select("key", "x.*").repartitionByRange("key").sortWithinPartitions("key", "n")
    placed.select(F.col("line").alias("value")).mapInArrow(whole_documents(head, "</graph></graphml>", False), "value string").write.text(at)
    get = lambda name, kind: F.try_variant_get("properties", f"$.{name}", kind)
    return import_graphml(spark, at)[0].vertices.select(get("_graphIoExternalId", "string").alias("external"), "label", get("name", "string").alias("name"), get("balance", "double").alias("balance"))


def _faulty(spark, sf_dir) -> str:
    """Envelopes with each nation twice and edges to nations that aren't there."""
    nation, customer = views.table(spark, sf_dir, "nation"), views.table(spark, sf_dir, "customer")
    line = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()])).alias("value")
    key = F.concat(F.lit("n"), "n_nationkey")
    v = nation.select(line(type=F.lit("vertex"), id=key, label=F.lit("Nation"), properties=F.struct(F.col("n_name").alias("name"))))
    e = customer.select(line(**{"type": F.lit("edge"), "from": F.concat(F.lit("n"), "c_nationkey"), "to": F.concat(F.lit("n"), F.col("c_custkey") % 30), "label": F.lit("TO")}))
    at = fresh_path(spark, "faulty")
    v.union(v).union(e).write.text(at)
    return at


_LENIENT = GraphImportOptions(on_duplicate_vertex_id=DuplicatePolicy.SKIP, on_missing_edge_endpoint=MissingEndpointPolicy.SKIP_EDGE)


@_query("SELECT 'Nation' AS label, n_name AS name FROM nation")
def import_skip_duplicates(spark, sf_dir):
    graph, _ = import_ndjson(spark, _faulty(spark, sf_dir), _LENIENT)
    return graph.vertices.select("label", F.try_variant_get("properties", "$.name", "string").alias("name"))


@_query("SELECT a.n_name AS src, b.n_name AS dst FROM customer JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = c_custkey % 30")
def import_skip_missing_endpoint(spark, sf_dir):
    graph, _ = import_ndjson(spark, _faulty(spark, sf_dir), _LENIENT)
    names = graph.vertices.select("id", F.try_variant_get("properties", "$.name", "string").alias("name"))
    ends = graph.edges.join(names.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst")
    return ends.select(F.col("a").alias("src"), F.col("b").alias("dst"))


@_query("""SELECT 'partial' AS status, 2 * n AS vertices_read, n AS vertices_created, n AS skipped_vertices, c AS edges_read, g AS edges_created, c - g AS skipped_edges
    FROM (SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM customer JOIN nation ON n_nationkey = c_custkey % 30) AS g)""")
def import_report(spark, sf_dir):
    _, r = import_ndjson(spark, _faulty(spark, sf_dir), _LENIENT)
    row = (r.status.value, r.vertices_read, r.vertices_created, r.skipped_vertices, r.edges_read, r.edges_created, r.skipped_edges)
    return spark.createDataFrame([row], "status string, vertices_read long, vertices_created long, skipped_vertices long, edges_read long, edges_created long, skipped_edges long")


# Text forms ----------------------------------------------------------------------------------------------------------


@_query("SELECT CAST(c_custkey AS VARCHAR) AS id, 'Customer' AS label, c_name AS name, c_acctbal AS balance FROM customer")
def agtype_parse(spark, sf_dir):
    text = F.concat(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.lit("Customer").alias("label"), F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("properties"))), F.lit("::vertex"))
    v = views.table(spark, sf_dir, "customer").select(agtype.parse_vertex(text).alias("v")).select("v.*")
    return v.select("id", "label", F.get_json_object("properties", "$.name").alias("name"), F.get_json_object("properties", "$.balance").cast("double").alias("balance"))


def _ag_vertex(kind: str, key: str, label: str, name: str):
    return F.struct(F.concat(F.lit(f"{kind}:"), F.col(key)).alias("id"), F.lit(label).alias("label"), F.struct(F.col(name).alias("name")).alias("properties"))


def _placed_agtype(spark, sf_dir) -> tuple[DataFrame, object, object, object]:
    """Orders with their customers, and a vertex, an edge and a vertex in JSON."""
    rows = views.table(spark, sf_dir, "orders").join(views.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    edge = F.struct(F.concat(F.lit("placed:"), "o_orderkey").alias("id"), F.lit("PLACED").alias("label"), F.concat(F.lit("order:"), "o_orderkey").alias("end_id"), F.concat(F.lit("customer:"), "c_custkey").alias("start_id"), F.struct(F.col("o_totalprice").alias("total")).alias("properties"))
    return rows, F.to_json(_ag_vertex("customer", "c_custkey", "Customer", "c_name")), F.to_json(edge), F.to_json(_ag_vertex("order", "o_orderkey", "Order", "o_orderstatus"))


@_query("SELECT 'placed:' || o_orderkey AS id, 'PLACED' AS label, 'customer:' || o_custkey AS src, 'order:' || o_orderkey AS dst, o_totalprice AS total FROM orders JOIN customer ON c_custkey = o_custkey")
def agtype_parse_edges(spark, sf_dir):
    rows, _, edge, _ = _placed_agtype(spark, sf_dir)
    e = rows.select(agtype.parse_edge(F.concat(edge, F.lit("::edge"))).alias("e")).select("e.*")
    return e.select("id", "label", "src", "dst", F.get_json_object("properties", "$.total").cast("double").alias("total"))


@_query("""SELECT o_orderkey AS path, unnest([0, 1, 2]) AS step, unnest(['vertex', 'edge', 'vertex']) AS kind, unnest(['customer:' || c_custkey, 'placed:' || o_orderkey, 'order:' || o_orderkey]) AS id,
    unnest([NULL, 'customer:' || c_custkey, NULL]) AS src, unnest([c_name, NULL, o_orderstatus]) AS name FROM orders JOIN customer ON c_custkey = o_custkey""")
def agtype_parse_paths(spark, sf_dir):
    rows, customer, edge, order = _placed_agtype(spark, sf_dir)
    text = F.concat(F.lit("["), customer, F.lit("::vertex, "), edge, F.lit("::edge, "), order, F.lit("::vertex]::path"))
    steps = rows.select(F.col("o_orderkey").alias("path"), F.posexplode(agtype.parse_path(text)).alias("step", "s"))
    return steps.select("path", "step", "s.kind", "s.id", "s.src", F.get_json_object("s.properties", "$.name").alias("name"))


@_query(r"SELECT event_id, '''' || replace(replace(props, '\', '\\'), '''', '\''') || '''' AS literal FROM events WHERE props IS NOT NULL UNION ALL SELECT event_id, 'null' FROM events WHERE props IS NULL")
def cypher_literal(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", cypher_string(F.col("props")).alias("literal"))


# Domain services in bulk -----------------------------------------------------------------------------------------------


@_query(f"""WITH {SALES} SELECT c.id AS customer, p.dst AS part, count(*) AS times FROM sv c JOIN se o ON o.src = c.id AND o.label = 'PLACED' JOIN se p ON p.src = o.dst AND p.label = 'CONTAINS'
    WHERE c.label = 'Customer' AND c.kind = 'MACHINERY' GROUP BY 1, 2""")
def two_hop_pattern(spark, sf_dir):
    graph = views.sales(spark, sf_dir)
    c = graph.find_vertices_by_label("Customer", {"kind": "MACHINERY"}).select(F.col("id").alias("customer"))
    placed = graph.find_edges_by_label("PLACED").select(F.col("src").alias("customer"), F.col("dst").alias("order"))
    contains = graph.find_edges_by_label("CONTAINS").select(F.col("src").alias("order"), F.col("dst").alias("part"))
    return c.join(placed, "customer").join(contains, "order").groupBy("customer", "part").agg(F.count("*").alias("times"))


KNOWN = """ke AS (
    SELECT c_custkey AS a, c_custkey + 1 AS b, 'KNOWS' AS label FROM customer UNION SELECT c_custkey, c_custkey * 2, 'KNOWS' FROM customer UNION SELECT c_custkey, c_custkey * 3, 'FOLLOWS' FROM customer
), ne AS (
    SELECT 'customer:' || a AS src, 'customer:' || b AS dst, label FROM ke WHERE b IN (SELECT c_custkey FROM customer)
    UNION SELECT 'customer:' || b, 'customer:' || a, label FROM ke WHERE label = 'KNOWS' AND b IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'WORKS_AT' FROM customer
)"""
CODE = """ce AS (
    SELECT DISTINCT 'part:' || a AS src, 'part:' || b AS dst FROM (
        SELECT p_partkey AS a, p_partkey // 2 AS b FROM part UNION SELECT p_partkey, p_partkey // 3 FROM part UNION SELECT p_partkey, p_partkey * 2 FROM part WHERE p_partkey % 5 = 0
    ) WHERE b IN (SELECT p_partkey FROM part)
)"""


def _reach_sql(view: str, edges: str, start: str, depth: int) -> str:
    return f"""WITH RECURSIVE {view}, steps AS ({edges}), walk AS (SELECT '{start}' AS v, 0 AS d UNION SELECT b, d + 1 FROM walk JOIN steps ON a = v WHERE d < {depth})
        SELECT DISTINCT v AS id FROM walk WHERE d > 0"""


def _reach_query(name: str, view, sql: str, start: str, options: NeighborOptions) -> None:
    """A service's question about whom one vertex reaches, with the service's own options."""
    _query(sql, name)(lambda spark, sf_dir: neighbors(view(spark, sf_dir), start, options).select("id"))


_KNOWS, _WORKS = "SELECT src AS a, dst AS b FROM ne WHERE label = 'KNOWS'", "SELECT dst AS a, src AS b FROM ne WHERE label = 'WORKS_AT'"
_DEPENDS, _IMPACTS = "SELECT src AS a, dst AS b FROM ce", "SELECT dst AS a, src AS b FROM ce"
_reach_query("network_connections", views.network, _reach_sql(KNOWN, _KNOWS, "customer:9", 1), "customer:9", NeighborOptions("KNOWS"))
_reach_query("network_connections_within", views.network, _reach_sql(KNOWN, _KNOWS, "customer:9", 3), "customer:9", NeighborOptions("KNOWS", max_depth=3))
_reach_query("network_employees", views.network, _reach_sql(KNOWN, _WORKS, "nation:3", 1), "nation:3", NeighborOptions("WORKS_AT", Direction.INCOMING))
_reach_query("code_dependencies", views.code, _reach_sql(CODE, _DEPENDS, "part:90", 1), "part:90", NeighborOptions("DEPENDS_ON"))
_reach_query("code_transitive_dependencies", views.code, _reach_sql(CODE, _DEPENDS, "part:90", 5), "part:90", NeighborOptions("DEPENDS_ON", max_depth=5))
_reach_query("code_impacted_modules", views.code, _reach_sql(CODE, _IMPACTS, "part:2", 3), "part:2", NeighborOptions("DEPENDS_ON", Direction.INCOMING, 3))

_KNOW_BOTH = """steps AS MATERIALIZED (SELECT src AS a, dst AS b, 'knows:' || split_part(src, ':', 2) || ':' || split_part(dst, ':', 2) AS e FROM ne WHERE label = 'KNOWS'
    UNION ALL SELECT dst, src, 'knows:' || split_part(src, ':', 2) || ':' || split_part(dst, ':', 2) FROM ne WHERE label = 'KNOWS')"""


@_query(_walks_sql(f"WITH {KNOWN}, {_KNOW_BOTH}, s AS (SELECT 'customer:9' AS v), t AS (SELECT 'customer:20' AS v)", 3))
def network_all_connection_paths(spark, sf_dir):
    return all_paths(views.network(spark, sf_dir), "customer:9", "customer:20", PathOptions("KNOWS", 3)).select(path_text().alias("path"), "length")


_FOLLOWED = "SELECT dst AS a, src AS b FROM ne WHERE label = 'FOLLOWS'"
_reach_query("network_followers", views.network, _reach_sql(KNOWN, _FOLLOWED, "customer:12", 1), "customer:12", NeighborOptions("FOLLOWS", Direction.INCOMING))
_reach_query("code_dependents", views.code, _reach_sql(CODE, _IMPACTS, "part:12", 1), "part:12", NeighborOptions("DEPENDS_ON", Direction.INCOMING))


def _between_sql(view: str, steps: str, start: str, end: str, depth: int) -> str:
    return _shortest_sql(depth, f"WITH {view}, {steps}, s AS (SELECT '{start}' AS v), t AS (SELECT '{end}' AS v), {_levels_sql('steps', depth, 'SELECT v FROM s')}")


@_query(_between_sql(KNOWN, _KNOW_BOTH, "customer:9", "customer:50", 6))
def network_connection_path(spark, sf_dir):
    return shortest_path(views.network(spark, sf_dir), "customer:9", "customer:50", PathOptions("KNOWS", 6)).select(path_text().alias("path"), "length")


_DEPEND_BOTH = """steps AS MATERIALIZED (SELECT src AS a, dst AS b, 'depends:' || split_part(src, ':', 2) || ':' || split_part(dst, ':', 2) AS e FROM ce
    UNION ALL SELECT dst, src, 'depends:' || split_part(src, ':', 2) || ':' || split_part(dst, ':', 2) FROM ce)"""


@_query(_between_sql(CODE, _DEPEND_BOTH, "part:90", "part:161", 10))
def code_dependency_path(spark, sf_dir):
    return shortest_path(views.code(spark, sf_dir), "part:90", "part:161", PathOptions("DEPENDS_ON", 10)).select(path_text().alias("path"), "length")


@_query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_name = (SELECT max(c_name) FROM customer)")
def network_find_person(spark, sf_dir):
    graph = views.network(spark, sf_dir)
    name = graph.vertices.where("label = 'Person'").agg(F.max("name")).first()[0]
    return graph.find_vertices_by_label("Person", {"name": name}).select("id")


@_query("SELECT 'part:' || p_partkey AS id FROM part WHERE p_name = (SELECT max(p_name) FROM part)")
def code_find_module(spark, sf_dir):
    graph = views.code(spark, sf_dir)
    name = graph.vertices.where("label = 'Module'").agg(F.max("name")).first()[0]
    return graph.find_vertices_by_label("Module", {"name": name}).select("id")


@_query(f"""WITH RECURSIVE {CODE}, walk AS (SELECT ['part:10'] AS p, 'part:10' AS v UNION ALL SELECT list_append(p, dst), dst FROM walk JOIN ce ON src = v WHERE len(p) <= 5 AND (len(p) = 1 OR v <> 'part:10') AND (dst = 'part:10' OR NOT list_contains(p, dst))),
    done AS (SELECT p[1:-2] AS r, CAST(len(p) - 1 AS INTEGER) AS length FROM walk WHERE len(p) > 1 AND v = 'part:10'),
    turned AS (SELECT r[list_position(r, list_min(r)):] || r[:list_position(r, list_min(r)) - 1] || [list_min(r)] AS p, length FROM done)
    SELECT array_to_string(p, '>') AS cycle, length FROM turned""")
def code_circular_dependencies(spark, sf_dir):
    return cycles_through(views.code(spark, sf_dir), "part:10", CycleOptions("Module", "DEPENDS_ON", 5, UNBOUNDED)).select(path_text().alias("cycle"), "length")


# Distances from many starts ----------------------------------------------------------------------------------------------


def _distances_sql(view: str, edges: str, starts: str, depth: int, ending: str) -> str:
    return f"""WITH RECURSIVE {view}, steps AS MATERIALIZED ({edges}), walk AS (SELECT v AS r, v, 0 AS d FROM ({starts}) UNION SELECT r, b, d + 1 FROM walk JOIN steps ON a = v WHERE d < {depth}),
        near AS (SELECT r AS start, v AS id, CAST(min(d) AS INTEGER) AS distance FROM walk GROUP BY r, v) {ending}"""


_PERSONS = "SELECT 'customer:' || c_custkey AS v FROM customer"


@_query(_distances_sql(KNOWN, _KNOWS, _PERSONS, 3, "SELECT start, id, distance FROM near"))
def network_distances_all(spark, sf_dir):
    graph = views.network(spark, sf_dir)
    return distances_from(graph, graph.find_vertices_by_label("Person"), NeighborOptions("KNOWS", max_depth=3))


@_query(_distances_sql(KNOWN, _KNOWS, _PERSONS + " WHERE c_nationkey = 3", 4, "SELECT id, distance, count(*) AS starts FROM near GROUP BY id, distance"))
def network_employee_reach(spark, sf_dir):
    graph = views.network(spark, sf_dir)
    employees = neighbors(graph, "nation:3", NeighborOptions("WORKS_AT", Direction.INCOMING))
    return reached_by(graph, employees, NeighborOptions("KNOWS", max_depth=4))


@_query(_distances_sql(HABITS, "SELECT src AS a, dst AS b FROM ae", "SELECT id AS v FROM av", 10, "SELECT start, id, distance FROM near WHERE distance > 0"))
def habit_distances(spark, sf_dir):
    graph = views.habits(spark, sf_dir)
    return distances_from(graph, graph.vertices, NeighborOptions("THEN", max_depth=10, include_start=False))


@_query(f"WITH {SALES} SELECT label, round(sum(amount), 2) AS amount FROM sv GROUP BY label")
def sql_over_views(spark, sf_dir):
    return views.sales(spark, sf_dir).sql("SELECT label, round(sum(amount), 2) AS amount FROM vertices GROUP BY label")
