"""Continuous ingest of NDJSON envelopes into the Parquet tables of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.streaming.components import ComponentLabels

ENVELOPE = "type string, id string, label string, `from` string, `to` string, properties string"


def envelopes(spark: SparkSession, path: str, files_per_trigger: int = 1_000) -> DataFrame:
    """A stream of parsed envelopes; malformed lines come with a null type."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path).where("trim(value) <> ''")
    v = F.try_parse_json("value")
    field = lambda name: F.try_variant_get(v, f"$.{name}", "string").alias(name)
    return lines.select(field("type"), field("id"), field("label"), field("from"), field("to"), F.coalesce(F.to_json(F.try_variant_get(v, "$.properties", "variant")), F.lit("{}")).alias("properties"))


def ingest(stream: DataFrame, vertices_path: str, edges_path: str, checkpoint: str, components_path: str | None = None, **trigger) -> StreamingQuery:
    """Append vertices and edges of each micro-batch; a batch that is run again replaces what it wrote.

    With ``components_path`` the weak components are kept as well (:class:`lattica.streaming.components.ComponentLabels`).
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        v = batch.where("type = 'vertex' and id is not null").select("id", F.coalesce("label", F.lit("Vertex")).alias("label"), "properties")
        e = batch.where("type = 'edge' and `from` is not null and `to` is not null")
        e = e.select(F.coalesce("id", F.concat_ws(">", "from", "to", "label")).alias("id"), F.coalesce("label", F.lit("Edge")).alias("label"), F.col("from").alias("src"), F.col("to").alias("dst"), "properties")
        for frame, path in ((v, vertices_path), (e, edges_path)):
            frame.withColumn("properties", F.parse_json("properties")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if components_path is not None:
            ComponentLabels(batch.sparkSession, components_path).update(number, v, e)
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def label_counts(stream: DataFrame, time_column: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Envelopes of each type and label in tumbling windows; later ones than the watermark are left out."""
    return stream.withWatermark(time_column, late).groupBy(F.window(time_column, width), "type", "label").agg(F.count("*").alias("n"))
