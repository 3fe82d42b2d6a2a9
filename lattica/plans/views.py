"""Property graphs over the relational test tables, with native property columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lattica.graph import Graph
from lattica.plans.numbering import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files that go to one task where all of its rows meet in a hash table: some hundred thousand rows.
PIECE = 4 << 20


def _dealt(frame: DataFrame, *keys: str) -> DataFrame:
    """The rows of a table, dealt by keys to as many tasks as its files have pieces; one of no more pieces than cores is left as it is.

    Neither a split of the files nor what is packed for a shuffle bounds the hash tables of a task well: rows take ten times as much there.
    """
    pieces = -(-int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // PIECE)
    return frame.repartition(pieces, *keys) if pieces > frame.sparkSession.sparkContext.defaultParallelism else frame


def _id(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def _vertices(frame: DataFrame, kind: str, label: str, key: str, name: str, balance: str | None = None) -> DataFrame:
    money = F.col(balance) if balance else F.lit(None).cast("double")
    return frame.select(_id(kind, key).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name"), money.alias("balance"))


def _edges(frame: DataFrame, label: str, kind: str, key: str, src, dst) -> DataFrame:
    return frame.select(_id(kind, key).alias("id"), F.lit(label).alias("label"), src.alias("src"), dst.alias("dst"))


def geo(spark: SparkSession, sf_dir: str) -> Graph:
    """A tree: nations in regions, customers and suppliers in nations."""
    region, nation, customer, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))
    vertices = (
        _vertices(region, "region", "Region", "r_regionkey", "r_name")
        .union(_vertices(nation, "nation", "Nation", "n_nationkey", "n_name"))
        .union(_vertices(customer, "customer", "Customer", "c_custkey", "c_name", "c_acctbal"))
        .union(_vertices(supplier, "supplier", "Supplier", "s_suppkey", "s_name", "s_acctbal"))
    )
    edges = (
        _edges(nation, "IN_REGION", "in", "n_nationkey", _id("nation", "n_nationkey"), _id("region", "n_regionkey"))
        .union(_edges(customer, "LIVES_IN", "lives", "c_custkey", _id("customer", "c_custkey"), _id("nation", "c_nationkey")))
        .union(_edges(supplier, "BASED_IN", "based", "s_suppkey", _id("supplier", "s_suppkey"), _id("nation", "s_nationkey")))
    )
    return Graph(vertices, edges)


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations; an edge from a supplier's to a customer's nation for any line item."""
    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # nations are few: line items come down to (order, supplier's nation) before they meet orders
    sold = items.join(supplier.select("s_suppkey", "s_nationkey"), items["l_suppkey"] == F.col("s_suppkey")).select("l_orderkey", "s_nationkey").distinct()
    bought = orders.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    joined = sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = joined.where("s_nationkey <> c_nationkey").select(_id("nation", "s_nationkey").alias("src"), _id("nation", "c_nationkey").alias("dst")).distinct()
    edges = pairs.select(F.concat("src", F.lit(">"), "dst").alias("id"), F.lit("TRADES").alias("label"), "src", "dst")
    return Graph(_vertices(nation, "nation", "Nation", "n_nationkey", "n_name").drop("balance"), edges)


def bipartite(spark: SparkSession, sf_dir: str) -> Graph:
    """All suppliers and parts; an edge for any line item."""
    supplier, part = (table(spark, sf_dir, t) for t in ("supplier", "part"))
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().select(_id("supplier", "l_suppkey").alias("src"), _id("part", "l_partkey").alias("dst"))
    edges = items.select(F.concat("src", F.lit(">"), "dst").alias("id"), F.lit("SUPPLIES").alias("label"), "src", "dst")
    vertices = supplier.select(_id("supplier", "s_suppkey").alias("id"), F.lit("Supplier").alias("label")).union(part.select(_id("part", "p_partkey"), F.lit("Part")))
    return Graph(vertices, edges)


def sales(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders placed by customers, and what they contain."""
    customer, orders, part = (table(spark, sf_dir, t) for t in ("customer", "orders", "part"))
    items = _dealt(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_returnflag")
    vertices = (
        customer.select(_id("customer", "c_custkey").alias("id"), F.lit("Customer").alias("label"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("amount"))
        .union(orders.select(_id("order", "o_orderkey"), F.lit("Order"), "o_orderstatus", "o_totalprice"))
        .union(part.select(_id("part", "p_partkey"), F.lit("Part"), "p_brand", "p_retailprice"))
    )
    placed = _dealt(orders, "o_orderkey").select(_id("placed", "o_orderkey").alias("id"), F.lit("PLACED").alias("label"), _id("customer", "o_custkey").alias("src"), _id("order", "o_orderkey").alias("dst"), F.lit(None).cast("string").alias("flag"), F.lit(None).cast("double").alias("quantity"))
    number = F.concat_ws(":", F.lit("item"), "l_orderkey", "l_partkey", "l_returnflag")
    contains = items.groupBy("l_orderkey", "l_partkey", "l_returnflag").agg(F.sum("l_quantity").alias("quantity")).select(number.alias("id"), F.lit("CONTAINS").alias("label"), _id("order", "l_orderkey").alias("src"), _id("part", "l_partkey").alias("dst"), F.col("l_returnflag").alias("flag"), "quantity")
    return Graph(vertices, placed.union(contains))


def handoff(spark: SparkSession, sf_dir: str) -> Graph:
    """Users; an edge to the user of the next purchase.

    Purchases are ordered day by day, in parallel; the last of a day is followed by the first of the next day that has any.
    """
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.to_date("ts").alias("day"), "ts", "event_id", _id("user", "user_id").alias("src"))
    firsts = events.groupBy("day").agg(F.min(F.struct("ts", "event_id", "src")).alias("first"))
    # one row a day
    next_day = F.broadcast(firsts.select("day", F.lead("first.src").over(Window.orderBy("day")).alias("tomorrow")))
    following = F.lead("src").over(Window.partitionBy("day").orderBy("ts", "event_id"))
    pairs = events.withColumn("dst", following).join(next_day, events["day"].eqNullSafe(next_day["day"])).select("src", F.coalesce("dst", "tomorrow").alias("dst"))
    pairs = pairs.where("dst is not null and dst <> src").distinct()
    edges = pairs.select(F.concat("src", F.lit(">"), "dst").alias("id"), F.lit("HANDS_TO").alias("label"), "src", "dst")
    vertices = events.select(F.col("src").alias("id"), F.lit("User").alias("label")).distinct()
    return Graph(vertices, edges)


def _followed(rows: DataFrame, key: str, order: list) -> DataFrame:
    """Rows with the columns of the next one of the same key, as next_...; numbered over all keys, so that no task has to hold a key's rows."""
    placed = numbered(rows, [F.col(key), *map(F.col, order)], "_k")
    after = placed.select((F.col("_k") - 1).alias("_k"), *[F.col(c).alias(f"next_{c}") for c in rows.columns])
    return placed.join(after, "_k").where(F.col(key) == F.col(f"next_{key}")).drop("_k")


def chains(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders; an edge to the same customer's next order: a chain for each customer."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    pairs = _followed(orders, "o_custkey", ["o_orderdate", "o_orderkey"]).select(_id("order", "o_orderkey").alias("src"), _id("order", "next_o_orderkey").alias("dst"))
    edges = pairs.select(F.concat("src", F.lit(">"), "dst").alias("id"), F.lit("NEXT").alias("label"), "src", "dst")
    return Graph(orders.select(_id("order", "o_orderkey").alias("id"), F.lit("Order").alias("label")), edges)


def habits(spark: SparkSession, sf_dir: str) -> Graph:
    """What each user does (a vertex for each type of event); an edge to what the user does next within two hours, if it is something else."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    name = lambda user, kind: F.concat_ws(":", F.lit("habit"), F.col(user).cast("string"), kind)
    soon = F.unix_micros("next_ts") - F.unix_micros("ts") <= 2 * 3600 * 1_000_000
    pairs = _followed(events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", ["ts", "event_id"]).where(soon & (F.col("event_type") != F.col("next_event_type")))
    pairs = pairs.select(name("user_id", "event_type").alias("src"), name("user_id", "next_event_type").alias("dst")).distinct()
    edges = pairs.select(F.concat("src", F.lit(">"), "dst").alias("id"), F.lit("THEN").alias("label"), "src", "dst")
    return Graph(events.select(name("user_id", "event_type").alias("id"), F.lit("Habit").alias("label")).distinct(), edges)


def network(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers as persons, nations as companies: c knows c + 1 and 2c (an edge each way), follows 3c and works at its nation."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    to = lambda label, end: F.struct(F.lit(label).alias("label"), end.alias("b"))
    pairs = customer.select(key.alias("a"), F.explode(F.array(to("KNOWS", key + 1), to("KNOWS", key * 2), to("FOLLOWS", key * 3))).alias("e"))
    pairs = pairs.select("a", "e.*").distinct().join(customer.select(key.alias("b")), "b", "left_semi")
    link = lambda a, b: [F.concat_ws(":", F.lower("label"), a, b).alias("id"), "label", _id("customer", a).alias("src"), _id("customer", b).alias("dst")]
    edges = pairs.select(*link("a", "b")).union(pairs.where("label = 'KNOWS'").select(*link("b", "a"))).distinct()
    works = customer.select(_id("works", "c_custkey").alias("id"), F.lit("WORKS_AT").alias("label"), _id("customer", "c_custkey").alias("src"), _id("nation", "c_nationkey").alias("dst"))
    vertices = _vertices(customer, "customer", "Person", "c_custkey", "c_name").union(_vertices(nation, "nation", "Company", "n_nationkey", "n_name"))
    return Graph(vertices.drop("balance"), edges.union(works))


def code(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts as modules: p depends on p div 2 and p div 3, and every fifth one on 2p, which closes rings."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    ends = F.array(F.floor(key / 2), F.floor(key / 3), F.when(key % 5 == 0, key * 2))
    pairs = part.select(key.alias("a"), F.explode(ends).alias("b")).where("b is not null").distinct().join(part.select(key.alias("b")), "b", "left_semi")
    edges = pairs.select(F.concat_ws(":", F.lit("depends"), "a", "b").alias("id"), F.lit("DEPENDS_ON").alias("label"), _id("part", "a").alias("src"), _id("part", "b").alias("dst"))
    return Graph(_vertices(part, "part", "Module", "p_partkey", "p_name").drop("balance"), edges)
