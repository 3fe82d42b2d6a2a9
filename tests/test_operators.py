"""Algorithms against a small model in plain Python, on hand-made and random graphs."""

import random

import pytest

from lattica.errors import GraphQueryError
from lattica.graph import Graph
from lattica.model import Direction
from lattica.operators import cycles, depth_first, pagerank, reach, traversal
from lattica.operators.components import connected_components
from lattica.operators.cycles import cycles_through, detect_cycles
from lattica.operators.degree import degree_centrality, degrees
from lattica.operators.depth_first import dfs
from lattica.operators.pagerank import page_rank
from lattica.operators.reach import distances_from, reached_by
from lattica.operators.search import bfs
from lattica.operators.traversal import all_paths, count_paths, neighbors, shortest_path
from lattica.options import UNBOUNDED, BfsDfsOptions, ComponentOptions, CycleOptions, DegreeOptions, NeighborOptions, PageRankOptions, PathOptions
from lattica.plans.components import star_contract
from lattica.plans.numbering import numbered
from lattica.plans.storage import Scratch


def make(spark, vertices, pairs, label="E"):
    return Graph.from_rows(spark, [(v, "Node") for v in vertices], [(str(i), label, a, b) for i, (a, b) in enumerate(pairs)])


def split(text):
    return [tuple(p.split(">")) for p in text.split()]


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def visits(df):
    return [(r["vertex_id"], r["depth"], r["parent_id"]) for r in df.orderBy("visit_order").collect()]


def random_pairs(seed, n=9, m=16):
    rng = random.Random(seed)
    names = [str(i) for i in range(n)]
    return names, [(rng.choice(names), rng.choice(names)) for _ in range(m)]


# Plain models --------------------------------------------------------------------------------------------------------


def ahead_of(pairs, direction):
    out = {}
    for a, b in pairs:
        if direction is not Direction.INCOMING:
            out.setdefault(a, []).append(b)
        if direction is not Direction.OUTGOING:
            out.setdefault(b, []).append(a)
    return out


def model_walks(pairs, direction, start, depth):
    ahead, level, seen = ahead_of(pairs, direction), {start}, set()
    for _ in range(depth):
        level = {b for a in level for b in ahead.get(a, [])}
        seen |= level
    return sorted(seen)


def model_bfs(pairs, start, depth, cap):
    ahead, out, seen = ahead_of(pairs, Direction.OUTGOING), [(start, 0, None)], {start}
    at = 0
    while at < len(out):
        v, d, _ = out[at]
        at += 1
        if d < depth:
            for b in ahead.get(v, []):
                if b not in seen:
                    seen.add(b)
                    out.append((b, d + 1, v))
    return out[:cap]


def model_dfs(pairs, start, depth, cap):
    ahead, out, seen, stack = ahead_of(pairs, Direction.OUTGOING), [], set(), [(start, 0, None)]
    while stack and len(out) < cap:
        v, d, p = stack.pop()
        if v not in seen:
            seen.add(v)
            out.append((v, d, p))
            if d < depth:
                stack += [(b, d + 1, v) for b in reversed(ahead.get(v, []))]
    return out


def model_paths(pairs, a, b, depth):
    out, held = [], [([a], [])]
    for _ in range(depth):
        grown = []
        for vs, es in held:
            for i, (x, y) in enumerate(pairs):
                for u, w in {(x, y), (y, x)}:
                    if u == vs[-1] and w not in vs:
                        grown.append(([*vs, w], [*es, str(i)]))
        out += [p for p in grown if p[0][-1] == b]
        held = [p for p in grown if p[0][-1] != b]
    return sorted(out, key=lambda p: (len(p[0]), p))


def model_cycles(names, pairs, depth):
    found = set()

    def walk(path):
        for a, b in set(pairs):
            if a == path[-1]:
                if b == path[0]:
                    found.add(tuple([*path, b]))
                elif b > path[0] and b not in path and len(path) < depth:
                    walk([*path, b])

    for v in names if depth else []:
        walk([v])
    return sorted(found)


def model_rank(names, pairs, rounds, d=0.85, tolerance=1e-4):
    n, ahead = len(names), ahead_of(pairs, Direction.OUTGOING)
    r = dict.fromkeys(names, 1 / n)
    for _ in range(rounds):
        new = dict.fromkeys(names, (1 - d) / n + d * sum(r[v] for v in names if v not in ahead) / n)
        for v, bs in ahead.items():
            for b in bs:
                new[b] += d * r[v] / len(bs)
        delta, r = sum(abs(new[v] - r[v]) for v in names), new
        if delta < tolerance:
            break
    return r


# Traversals ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("direction", list(Direction))
def test_neighbors(spark, direction):
    for seed in range(2):
        names, pairs = random_pairs(seed)
        graph = make(spark, names, pairs)
        for depth in (0, 1, 2, 4):
            assert ids(neighbors(graph, "3", NeighborOptions(None, direction, depth))) == model_walks(pairs, direction, "3", depth)


def test_neighbors_details(spark):
    graph = make(spark, "ABC", split("A>B B>C"), "KNOWS").add_vertices(Graph.from_rows(spark, [("D", "Other")]).vertices)
    assert ids(neighbors(graph, "A", NeighborOptions("KNOWS", max_depth=2))) == ["B", "C"]
    assert ids(neighbors(graph, "A", NeighborOptions("FOLLOWS"))) == []
    assert ids(neighbors(graph, "B", NeighborOptions(direction=Direction.BOTH, max_depth=2))) == ["A", "B", "C"]
    assert ids(neighbors(graph, "B", NeighborOptions(direction=Direction.BOTH, max_depth=2, include_start=False))) == ["A", "C"]
    assert ids(neighbors(graph, "nowhere")) == []
    with pytest.raises(ValueError):
        neighbors(graph, " ")


def test_paths(spark):
    for seed in (1, 5):
        names, pairs = random_pairs(seed, 7, 9)
        graph = make(spark, names, pairs)
        for a, b, depth in (("0", "6", 4), ("2", "5", 3), ("1", "1", 3), ("0", "x", 3)):
            want = model_paths(pairs, a, b, depth) if a != b else []
            got = sorted(((r["vertex_ids"], r["edge_ids"]) for r in all_paths(graph, a, b, PathOptions(max_depth=depth)).collect()), key=lambda p: (len(p[0]), p))
            assert got == want
            shortest = [(r["vertex_ids"], r["edge_ids"], r["length"]) for r in shortest_path(graph, a, b, PathOptions(max_depth=depth)).collect()]
            assert shortest == [(*p, len(p[1])) for p in want[:1]]


def test_shortest_path_grows_from_both_ends(spark):
    """A hub at one end isn't opened if the other end gets there first."""
    rim = [("hub", f"h{i}") for i in range(200)] + [(f"h{i}", f"g{i}") for i in range(200)]
    line = [("l0", "l1"), ("l1", "l2"), ("l2", "l3"), ("l3", "h7")]
    graph = make(spark, [*{x for p in rim + line for x in p}], rim + line).stored()
    keep = Scratch()
    steps = graph.steps(keep, Direction.BOTH).where("a <> b")
    (near, far), sizes = traversal._meet(graph, keep, steps, ("l0", "hub"), 10)
    assert len(near) - 1 == 5 and len(far) == 1 and sizes[1] == [1] and max(sizes[0]) <= 2
    brooms = make(spark, [], [("a", f"a{i}") for i in range(9)] + [("b", f"b{i}") for i in range(9)] + [("a0", "m"), ("m", "b0")])
    brooms = Graph(brooms.edges.selectExpr("explode(array(src, dst)) as id", "'V' as label").distinct(), brooms.edges, at_rest=True)
    (near, far), sizes = traversal._meet(brooms, keep, brooms.steps(keep, Direction.BOTH).where("a <> b"), ("a", "b"), 10)
    assert sizes == [[1, 9, 1, 1], [1, 9]] and (len(near), len(far)) == (4, 2)
    r = shortest_path(graph, "l0", "hub").first()
    assert r["vertex_ids"] == ["l0", "l1", "l2", "l3", "h7", "hub"] and r["length"] == 5
    assert shortest_path(graph, "l0", "hub", PathOptions(max_depth=4)).count() == 0
    assert shortest_path(graph, "hub", "g9").first()["vertex_ids"] == ["hub", "h9", "g9"] and shortest_path(graph, "hub", "nowhere").count() == 0


def test_paths_are_counted_and_listed_alike(spark):
    """Dense graphs with parallel edges, loops and both directions, up to 6 edges: halves of 3 that share up to 2 vertices."""
    for seed in (2, 7):
        names, pairs = random_pairs(seed, 7, 16)
        pairs += pairs[:3]
        graph = make(spark, names, pairs).stored()
        for a, b in (("0", "6"), ("3", "4")):
            want = model_paths(pairs, a, b, 6)
            assert sorted(((r["vertex_ids"], r["edge_ids"]) for r in all_paths(graph, a, b, PathOptions(max_depth=6)).collect()), key=lambda p: (len(p[0]), p)) == want
            lengths = [len(p[1]) for p in want]
            assert sorted(tuple(r) for r in count_paths(graph, a, b, PathOptions(max_depth=6)).collect()) == sorted({(n, lengths.count(n)) for n in lengths})
    assert count_paths(graph, "1", "1").count() == 0 and count_paths(graph, "0", "x").count() == 0 and count_paths(graph, "0", "6", PathOptions("OTHER")).count() == 0


def test_paths_give_up(spark):
    graph = make(spark, "abcdef", [(a, b) for a in "abcdef" for b in "abcdef" if a < b])
    with pytest.raises(GraphQueryError):
        all_paths(graph, "a", "f", PathOptions(max_rows=5))


# Search --------------------------------------------------------------------------------------------------------------


def test_search_on_random_graphs(spark):
    for seed in (0, 3):
        names, pairs = random_pairs(seed)
        graph = make(spark, names, pairs)
        for depth, cap in ((2, 100), (5, 4)):
            options = BfsDfsOptions(max_depth=depth, max_vertices=cap)
            assert visits(bfs(graph, "0", options)) == model_bfs(pairs, "0", depth, cap)
            assert visits(dfs(graph, "0", options)) == model_dfs(pairs, "0", depth, cap)


def test_dfs_over_pages(spark, monkeypatch):
    """Beyond GATHERED steps the walk reads its steps by pages and tells its visits in pieces; the order is the same."""
    rng = random.Random(5)
    ids = [f"v{i:02d}" for i in range(25)]
    edges = [(str(n), "E", rng.choice(ids), rng.choice(ids)) for n in range(70)]
    graph = Graph.from_rows(spark, [(i, "V") for i in ids], edges)
    for options in (BfsDfsOptions(max_depth=4), BfsDfsOptions(max_depth=3, max_vertices=7, direction=Direction.BOTH), BfsDfsOptions(max_depth=6, max_vertices=UNBOUNDED)):
        want = [tuple(r) for r in dfs(graph, "v03", options).orderBy("visit_order").collect()]
        with monkeypatch.context() as m:
            for name, value in (("GATHERED", 3), ("PAGE", 4), ("PAGES_HELD", 3), ("PAGES_AT_ONCE", 2), ("PIECE", 5), ("FEW_LEVELS", 1), ("MANY_LEVELS", 2)):
                m.setattr(depth_first, name, value)
            assert [tuple(r) for r in dfs(graph, "v03", options).orderBy("visit_order").collect()] == want and len(want) > 5
            assert [tuple(r) for r in dfs(graph, "nowhere", options).collect()] == [(0, "nowhere", 0, None)]


def test_dfs_pages_serve_many_visits(spark, monkeypatch):
    rng = random.Random(7)
    n = 6000
    pairs = [(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(5 * n)]
    graph = make(spark, [], pairs)
    fetched = []
    fetch = depth_first._Pages.fetch
    monkeypatch.setattr(depth_first._Pages, "fetch", lambda self, wanted: (fetched.append(len(wanted)), fetch(self, wanted)))
    monkeypatch.setattr(depth_first, "GATHERED", 1000)
    monkeypatch.setattr(depth_first, "PAGE", 1500)
    start = pairs[0][0]
    got = visits(dfs(graph, start, BfsDfsOptions(max_depth=10**6, max_vertices=UNBOUNDED)))
    assert got == model_dfs(pairs, start, 10**6, 10**9) and len(got) > 5000
    assert 1 <= len(fetched) <= 25


@pytest.mark.parametrize("few", [0, 8])
def test_dfs_of_forests(spark, monkeypatch, few):
    """A shallow tree is sorted by paths, a deep forest ranked along its Euler tour."""
    monkeypatch.setattr(depth_first, "FEW_LEVELS", few)
    monkeypatch.setattr(depth_first, "_walked", None), monkeypatch.setattr(depth_first, "_paged_walk", None)
    rng = random.Random(few)
    n, back = (40, 1) if few else (300, 30)
    names = [str(i) for i in range(n)]
    rng.shuffle(names)
    pairs = [(names[max(0, i - 1 - rng.randrange(back))], names[i]) for i in range(1, n)]
    pairs += [("x", "y"), ("y", "z"), ("p", "q"), ("q", "p"), (names[-1], names[0])]
    rng.shuffle(pairs)
    graph = make(spark, [], pairs)
    for start, depth, cap in ((names[0], 10**6, 10**6), (names[0], 7, 25), (names[3], 12, UNBOUNDED), ("q", 10**6, UNBOUNDED)):
        assert visits(dfs(graph, start, BfsDfsOptions(max_depth=depth, max_vertices=cap))) == model_dfs(pairs, start, depth, cap)


def test_dfs_of_a_long_chain(spark):
    """Jobs grow with the logarithm of the chain, not with its length."""
    n = 20_000
    edges = spark.range(n).selectExpr("cast(id as string) as id", "'E' as label", "concat('v', id) as src", "concat('v', id + 1) as dst")
    graph = Graph(edges.selectExpr("src as id", "'V' as label"), edges)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    rows = dfs(graph, "v0", BfsDfsOptions(max_depth=10**6, max_vertices=UNBOUNDED)).orderBy("visit_order").collect()
    after = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert [(r["vertex_id"], r["depth"]) for r in rows] == [(f"v{i}", i) for i in range(n + 1)] and rows[5]["parent_id"] == "v4"
    assert len(set(after) - set(before)) < 150


def test_search_details(spark):
    diamond = make(spark, "abcde", split("a>b a>c b>d c>d d>e"))
    assert [v[0] for v in visits(bfs(diamond, "a", BfsDfsOptions(max_depth=3)))] == list("abcde")
    assert [v[0] for v in visits(dfs(diamond, "a", BfsDfsOptions(max_depth=3)))] == list("abdec")
    trap = make(spark, "abcd", split("a>b a>c b>c c>d"))
    assert "d" not in [v[0] for v in visits(dfs(trap, "a", BfsDfsOptions(max_depth=2)))]
    assert "d" in [v[0] for v in visits(bfs(trap, "a", BfsDfsOptions(max_depth=2)))]
    assert visits(bfs(trap, "absent")) == visits(dfs(trap, "absent")) == [("absent", 0, None)]
    for bad in ({"max_depth": -1}, {"max_vertices": 0}):
        with pytest.raises(ValueError):
            BfsDfsOptions(**bad)


# Algorithms ----------------------------------------------------------------------------------------------------------


def test_cycles(spark):
    shown = lambda df: sorted(tuple(r["vertex_ids"]) for r in df.collect())
    for seed in (0, 2):
        names, pairs = random_pairs(seed, 7, 14)
        graph = make(spark, names, pairs)
        for depth in (0, 1, 4):
            assert shown(detect_cycles(graph, CycleOptions(max_depth=depth, max_cycles=10_000))) == model_cycles(names, pairs, depth)
    square = make(spark, "abcd", split("a>b b>c c>d d>a"))
    assert shown(detect_cycles(square, CycleOptions(max_depth=3))) == []
    assert shown(cycles_through(square, "c", CycleOptions(max_depth=4))) == [tuple("abcda")]
    loops = make(spark, "abc", split("a>a b>b c>c"))
    assert shown(detect_cycles(loops, CycleOptions(max_cycles=2))) == [("a", "a"), ("b", "b")]
    assert detect_cycles(square, CycleOptions("Other")).count() == 0


def test_page_rank(spark):
    for seed in (0, 1):
        names, pairs = random_pairs(seed)
        got = {r["vertex_id"]: r["score"] for r in page_rank(make(spark, names, pairs)).collect()}
        assert got == pytest.approx(model_rank(names, pairs, 20), abs=1e-9)
    star = page_rank(make(spark, "abcde", split("a>e b>e c>e d>e")), PageRankOptions(top_k=3)).orderBy("rank").collect()
    assert [r["vertex_id"] for r in star] == ["e", "a", "b"]
    assert page_rank(Graph.empty(spark)).count() == 0
    assert page_rank(make(spark, "a", [])).first()["score"] == pytest.approx(1.0)
    filtered = Graph.from_rows(spark, [("a", "P"), ("b", "P"), ("c", "Q")], [("1", "X", "a", "b"), ("2", "X", "c", "b"), ("3", "Y", "b", "a")])
    got = {r["vertex_id"]: r["score"] for r in page_rank(filtered, PageRankOptions("P", "X")).collect()}
    assert got == pytest.approx(model_rank(["a", "b"], [("a", "b")], 20), abs=1e-9)
    for bad in ({"iterations": 0}, {"top_k": 0}, {"damping_factor": 1.5}):
        with pytest.raises(ValueError):
            PageRankOptions(**bad)


def test_page_rank_of_hubs(spark, monkeypatch):
    """A hub's edges in several partitions give the same ranks; ranks count from 1 without gaps."""
    rng = random.Random(9)
    ids = [f"v{i:03d}" for i in range(60)]
    graph = Graph.from_rows(spark, [(i, "V") for i in ids], [(str(n), "E", rng.choice(ids[:4] + ids), rng.choice(ids)) for n in range(300)])
    plain = {r["vertex_id"]: (round(r["score"], 10), r["rank"]) for r in page_rank(graph).collect()}
    monkeypatch.setattr(pagerank, "HUB", 3)
    assert {r["vertex_id"]: (round(r["score"], 10), r["rank"]) for r in page_rank(graph).collect()} == plain
    assert sorted(rank for _, rank in plain.values()) == list(range(1, 61))
    order = sorted(plain, key=lambda v: (-plain[v][0], v))
    assert [plain[v][1] for v in order] == sorted(plain[v][1] for v in order)
    top = page_rank(graph, PageRankOptions(top_k=5)).collect()
    assert [(r["vertex_id"], r["rank"]) for r in top] == [(v, i + 1) for i, v in enumerate(order[:5])]


def test_numbers_are_dense(spark):
    df = spark.range(1000).selectExpr("id", "pmod(hash(id), 50) as k").repartition(7)
    got = numbered(df, [df["k"].desc(), df["id"].asc()], "number", 5).orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(5, 1005)) and [(r["k"], r["id"]) for r in got] == sorted(((r["k"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert numbered(df.where("false"), [df["id"]], "number").count() == 0


def model_distances(names, pairs, direction, depth):
    ahead, out = ahead_of(pairs, direction), []
    for start in names:
        near, level = {start: 0}, [start]
        for d in range(1, depth + 1):
            level = [v for v in dict.fromkeys(b for a in level for b in ahead.get(a, [])) if v not in near]
            near |= dict.fromkeys(level, d)
        out += [(start, v, d) for v, d in near.items()]
    return sorted(out)


@pytest.mark.parametrize("merged_from", [1, 8])
def test_distances_from_many_starts(spark, monkeypatch, merged_from):
    """150 starts fill more than two words; levels are merged or not."""
    monkeypatch.setattr(reach, "MERGED_FROM", merged_from)
    names, pairs = random_pairs(4, 150, 260)
    graph = make(spark, names, pairs)
    for direction in (Direction.OUTGOING, Direction.BOTH)[: 2 if merged_from == 8 else 1]:
        told = model_distances(names, pairs, direction, 5)
        options = NeighborOptions("E", direction, 5)
        got = distances_from(graph, graph.vertices, options)
        assert sorted(map(tuple, got.select("start", "id", "distance").collect())) == told
    counts = {}
    for _, v, d in told:
        counts[v, d] = counts.get((v, d), 0) + 1
    assert {(r["id"], r["distance"]): r["starts"] for r in reached_by(graph, graph.vertices, options).collect()} == counts


def test_distances_from_odd_starts(spark):
    """Repeated, null and unknown starts, no start, an empty graph, self loops, parallel edges and no depth."""
    graph = make(spark, "abc", split("a>b a>b b>b b>c c>a"))
    starts = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("nobody", 4)], "id string, distance int")
    triples = lambda df: sorted(map(tuple, df.select("start", "id", "distance").collect()))
    assert triples(distances_from(graph, starts, NeighborOptions(max_depth=9))) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]
    assert triples(distances_from(graph, starts, NeighborOptions(max_depth=1, include_start=False))) == [("a", "b", 1)]
    assert triples(distances_from(graph, starts, NeighborOptions(max_depth=0))) == [("a", "a", 0)]
    assert triples(distances_from(graph, starts, NeighborOptions(max_depth=0, include_start=False))) == []
    assert triples(distances_from(graph, starts.where("false"), NeighborOptions(max_depth=3))) == []
    assert reached_by(Graph.empty(spark), starts, NeighborOptions(max_depth=3)).count() == 0


def test_cycles_within_strong_components(spark, monkeypatch):
    monkeypatch.setattr(cycles, "STRONG_FROM", 0)
    for seed in range(3):
        names, pairs = random_pairs(seed, 8, 15)
        found = detect_cycles(make(spark, names, pairs), CycleOptions(max_depth=5, max_cycles=UNBOUNDED)).collect()
        assert sorted(tuple(r["vertex_ids"]) for r in found) == sorted(model_cycles(names, pairs, 5))


def test_cycles_make_no_path_that_cannot_close(spark, monkeypatch):
    """12 diamonds in a row and one edge back: 4,096 ways round of 25 edges, none of up to 10, so no path is held; a short ring on the side is found."""
    held = []
    seeing = Scratch.stored_seeing

    def watched(self, df, name, **facts):
        out, seen = seeing(self, df, name, **facts)
        held.extend([seen["n"]] if name == "cycles" else [])
        return out, seen

    monkeypatch.setattr(Scratch, "stored_seeing", watched)
    spine = [f"d{i:02}" for i in range(13)]
    pairs = [p for i, (a, b) in enumerate(zip(spine, spine[1:])) for side in ("x", "y") for p in ((a, f"{side}{i:02}"), (f"{side}{i:02}", b))]
    pairs += [(spine[-1], spine[0]), ("d03", "z1"), ("z1", "z2"), ("z2", "d03")]
    graph = make(spark, sorted({v for p in pairs for v in p}), pairs)
    found = [tuple(r["vertex_ids"]) for r in detect_cycles(graph, CycleOptions(max_depth=10, max_cycles=UNBOUNDED)).collect()]
    assert found == [("d03", "z1", "z2", "d03")] and held and max(held) <= 1


def test_cycles_by_turns(spark, monkeypatch):
    """The first cycles are the same however few starts are searched at first."""
    rng = random.Random(4)
    ids = [f"v{i:02d}" for i in range(14)]
    graph = Graph.from_rows(spark, [(i, "V") for i in ids], [(str(n), "E", rng.choice(ids), rng.choice(ids)) for n in range(45)])
    every = [tuple(r["vertex_ids"]) for r in detect_cycles(graph, CycleOptions(max_depth=5, max_cycles=UNBOUNDED)).collect()]
    monkeypatch.setattr(cycles, "FIRST_STARTS", 1)
    monkeypatch.setattr(cycles, "MORE", 2)
    for n in (1, 7, 10**6):
        assert [tuple(r["vertex_ids"]) for r in detect_cycles(graph, CycleOptions(max_depth=5, max_cycles=n)).collect()] == every[:n]
    for v in ids[:3]:
        got = [tuple(r["vertex_ids"]) for r in cycles_through(graph, v, CycleOptions(max_depth=5, max_cycles=UNBOUNDED)).collect()]
        assert got == [c for c in every if v in c]


def test_degrees(spark):
    graph = make(spark, "ABC", split("A>B C>A A>A"), "KNOWS")
    one = lambda v, **o: tuple(degree_centrality(graph, v, DegreeOptions(**o)).first())[1:]
    assert one("A") == (2, 2, 4)
    assert one("A", direction=Direction.OUTGOING) == (0, 2, 2)
    assert one("A", direction=Direction.INCOMING) == (2, 0, 2)
    assert one("A", edge_label="OTHER") == one("nobody") == (0, 0, 0)
    assert sorted(map(tuple, degrees(graph).collect())) == [("A", 2, 2, 4), ("B", 1, 0, 1), ("C", 0, 1, 1)]


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["component_id"], []).append(r["vertex_id"])
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("small", [50_000, 0])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr("lattica.plans.components.SMALL", small)
    rng = random.Random(1)
    names = [str(i) for i in range(60)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(45)]
    root = {v: v for v in names}
    for _ in names:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = {}
    for v in names:
        want.setdefault(root[v], []).append(v)
    graph = make(spark, names, pairs)
    assert groups(connected_components(graph)) == {k: sorted(v) for k, v in want.items()}
    assert groups(connected_components(graph, ComponentOptions(min_size=3))) == {k: sorted(v) for k, v in want.items() if len(v) >= 3}
    path = [(f"{i:03}", f"{i + 1:03}") for i in range(90)]
    rng.shuffle(path)
    assert {r["root"] for r in star_contract(make(spark, [], path).edges.selectExpr("src as a", "dst as b")).collect()} == {"000"}


def test_strong_components(spark):
    names, pairs = random_pairs(4, 10, 17)
    reach = {v: {v, *model_walks(pairs, Direction.OUTGOING, v, 20)} for v in names}
    want = {}
    for v in names:
        want.setdefault(min(w for w in names if w in reach[v] and v in reach[w]), []).append(v)
    assert groups(connected_components(make(spark, names, pairs), ComponentOptions(weakly=False))) == want
