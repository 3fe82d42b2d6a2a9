"""All importers and exporters as calls of one object, which the asynchronous surfaces can wrap."""

from __future__ import annotations

from functools import partial

from pyspark.sql import SparkSession

from lattica.sources import csv_io, graphml_io, ndjson_io


class BulkIo:
    """``FutureSurface(BulkIo(spark)).import_csv(...)`` gives a Future, ``await AsyncSurface(BulkIo(spark)).export_ndjson(...)`` a report."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.export_csv, self.export_ndjson, self.export_graphml = csv_io.export_csv, ndjson_io.export_ndjson, graphml_io.export_graphml
        self.import_csv, self.import_ndjson, self.import_graphml = (partial(f, spark) for f in (csv_io.import_csv, ndjson_io.import_ndjson, graphml_io.import_graphml))
