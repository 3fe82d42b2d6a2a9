"""Queries over whole tables, held against brute force on a few rows."""

import itertools

import pytest

from lattica.plans.views import handoff
from lattica.queries import QUERIES

#: (order, part, supplier): a square with a tail, a pair, and a part and a supplier without line items
ITEMS = [(1, 1, 1), (1, 2, 1), (2, 1, 2), (2, 2, 2), (2, 3, 2), (3, 3, 3), (4, 4, 4), (4, 4, 4)]
PARTS, SUPPLIERS, CUSTOMERS = range(1, 6), range(1, 6), {1: 2, 2: 3, 3: 1, 4: 4}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    save = lambda rows, ddl, name: spark.createDataFrame(rows, ddl).write.parquet(f"{at}/{name}.parquet")
    save([(o, p, s, 1.0, 0.0, "N") for o, p, s in ITEMS], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_returnflag string", "lineitem")
    save([(p,) for p in PARTS], "p_partkey long", "part")
    save([(s, s, f"S{s}", 2.5) for s in SUPPLIERS], "s_suppkey long, s_nationkey long, s_name string, s_acctbal double", "supplier")
    save([(c, n, f"C{c}", 1.5) for c, n in CUSTOMERS.items()], "c_custkey long, c_nationkey long, c_name string, c_acctbal double", "customer")
    save([(o, o) for o in CUSTOMERS], "o_orderkey long, o_custkey long", "orders")
    save([(n, f"N{n}", 0) for n in range(6)], "n_nationkey long, n_name string, n_regionkey long", "nation")
    save([(0, "R0")], "r_regionkey long, r_name string", "region")
    return at


def rows(spark, sf_dir, name):
    return sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()), key=lambda r: [(x is not None, x) for x in r])


def steps():
    out = {}
    for _, p, s in ITEMS:
        out.setdefault(f"supplier:{s}", set()).add(f"part:{p}")
        out.setdefault(f"part:{p}", set()).add(f"supplier:{s}")
    return out


def test_components(spark, sf_dir):
    ahead, want = steps(), []
    for v in [f"supplier:{s}" for s in SUPPLIERS] + [f"part:{p}" for p in PARTS]:
        seen, stack = {v}, [v]
        while stack:
            stack += (new := ahead.get(stack.pop(), set()) - seen)
            seen |= new
        want.append((min(seen), v, len(seen)))
    assert rows(spark, sf_dir, "components") == sorted(w[:2] for w in want)
    assert rows(spark, sf_dir, "component_sizes") == sorted({(c, n) for c, _, n in want})
    assert rows(spark, sf_dir, "components_min_size") == sorted(w[:2] for w in want if w[2] >= 4)


def test_paths(spark, sf_dir):
    def walks(goal, depth):
        done, held = [], [("supplier:1",)]
        for _ in range(depth):
            held = [(*p, b) for p in held for b in ahead[p[-1]] if b not in p]
            done += [p for p in held if p[-1] == goal]
            held = [p for p in held if p[-1] != goal]
        return sorted((">".join(p), len(p) - 1) for p in done)

    ahead = steps()
    # the last part and the last vertex that supplier 1 reaches
    want = walks("part:3", 3)
    assert len(want) == 2 and rows(spark, sf_dir, "all_paths") == want
    assert rows(spark, sf_dir, "shortest_path") == walks("supplier:3", 6)[:1]
    lengths = [n for _, n in walks("supplier:3", 4)]
    assert rows(spark, sf_dir, "path_counts") == sorted((n, lengths.count(n)) for n in set(lengths)) != []


def test_trade(spark, sf_dir):
    edges = {(s, CUSTOMERS[o]) for o, _, s in ITEMS if s != CUSTOMERS[o]}
    loops = [c for n in (2, 3) for c in itertools.permutations(range(6), n) if c[0] == min(c) and {*zip(c, c[1:] + c[:1])} <= edges]
    assert rows(spark, sf_dir, "cycles_le3") == sorted((">".join(f"nation:{v}" for v in (*c, c[0])), len(c)) for c in loops) != []
    assert [r[0] for r in rows(spark, sf_dir, "neighbors_out_d1")] == ["nation:2"]


@pytest.mark.parametrize("kind", ["csv", "ndjson", "graphml"])
def test_round_trips(spark, sf_dir, kind):
    want = [("Region", "R0", None), *(("Nation", f"N{n}", None) for n in range(6)), *(("IN_REGION", f"N{n}>R0", None) for n in range(6))]
    want += [x for s in SUPPLIERS for x in (("Supplier", f"S{s}", 2.5), ("BASED_IN", f"S{s}>N{s}", None))]
    want += [x for c, n in CUSTOMERS.items() for x in (("Customer", f"C{c}", 1.5), ("LIVES_IN", f"C{c}>N{n}", None))]
    assert sorted(map(repr, rows(spark, sf_dir, f"{kind}_roundtrip"))) == sorted(map(repr, want))


def test_hot_user(spark, tmp_path):
    n = 10_050  # user 0 hands to each of them
    events = spark.range(2 * n).selectExpr("id as event_id", "timestamp_seconds(id) as ts", "if(id % 2 = 0, 0, (id + 1) div 2) as user_id", "'purchase' as event_type")
    events.write.parquet(f"{tmp_path}/events.parquet")
    for name in ("bfs_levels", "bfs_parents"):
        assert QUERIES[name](spark, str(tmp_path)).count() == n + 1


def test_handoff_over_days(spark, tmp_path):
    """The last purchase of a day hands over to the first of the next day that has any."""
    rows = [(1, "2024-01-01 10:00:00", 1), (2, "2024-01-01 23:00:00", 2), (3, "2024-01-04 01:00:00", 3), (4, "2024-01-04 02:00:00", 3), (5, "2024-01-05 02:00:00", 1)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "'purchase' as event_type")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert sorted((r["src"], r["dst"]) for r in handoff(spark, str(tmp_path)).edges.collect()) == [("user:1", "user:2"), ("user:2", "user:3"), ("user:3", "user:1")]
