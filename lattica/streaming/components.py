"""Weak components of a graph that grows batch by batch.

Every vertex is written once, with the root that it had when it came.  What has
become of roots since is a table of its own: a batch maps its edges to the roots of their ends, contracts these few pairs and adds
what was merged.  So a batch rewrites merged roots, never vertices.  State is kept by number of
batch, and a batch reads that of earlier ones only: run again it writes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lattica.errors import require
from lattica.plans.components import star_contract
from lattica.plans.storage import Scratch


class ComponentLabels:
    """State below ``path``: nodes/batch=N (node, root), merged/batch=N (root, now)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, table: str, schema: str, before: int | None, latest: bool) -> DataFrame:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        fs = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = lambda s: fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        batches = sorted(int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(place) if done(s)) if fs.exists(place) else []
        batches = [b for b in batches if before is None or b < before][-1 if latest else 0 :]
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{table}/batch={b}" for b in batches])

    def _state(self, before: int | None = None) -> tuple[DataFrame, DataFrame]:
        return self._read("nodes", "node string, root string", before, False), self._read("merged", "root string, now string", before, True)

    @staticmethod
    def _now(nodes: DataFrame, merged: DataFrame) -> DataFrame:
        return nodes.join(merged, "root", "left").select("node", F.coalesce("now", "root").alias("root"))

    def labels(self) -> DataFrame:
        """(component_id, vertex_id): the smallest id of the component, as after a full run over all batches."""
        return self._now(*self._state()).select(F.col("root").alias("component_id"), F.col("node").alias("vertex_id"))

    def update(self, number: int, vertices: DataFrame, edges: DataFrame) -> None:
        """Take in a batch: ``vertices`` (id), ``edges`` (src, dst).  Ends that were never given as vertices count as such; nulls are left out."""
        require(number >= 0, "batches are numbered from 0")
        keep = Scratch()
        nodes, merged = self._state(number)
        pairs = keep.stored(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "batch-edges")
        ids = vertices.select(F.col("id").alias("node")).union(pairs.select(F.explode(F.array("src", "dst")))).where("node is not null").distinct()
        # what is known of the batch's ids; the rest is new
        roots = keep.stored(ids.join(self._now(nodes.join(ids, "node", "left_semi"), merged), "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.col("root").isNull().alias("new")), "batch-roots")
        of = lambda end, to: roots.select(F.col("node").alias(end), F.col("root").alias(to))
        contracted = keep.stored(star_contract(pairs.join(of("src", "a"), "src").join(of("dst", "b"), "dst").select("a", "b")).select("node", F.col("root").alias("now")).where("node <> now"), "contracted")
        fresh = roots.where("new").select("node").join(contracted, "node", "left").select("node", F.coalesce("now", "node").alias("root"))
        fresh.write.mode("overwrite").parquet(f"{self.path}/nodes/batch={number}")
        moved = contracted.select(F.col("node").alias("now"), F.col("now").alias("later"))
        older = merged.join(moved, "now", "left").select("root", F.coalesce("later", "now").alias("now"))
        gone = contracted.join(roots.where("not new").select(F.col("root").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("root"), "now")
        older.union(gone).write.mode("overwrite").parquet(f"{self.path}/merged/batch={number}")
        keep.discard()
