"""Files that keep arriving in a folder, each batch analysed as it comes.

This takes the place of an upload form: whoever drops a file into the folder
gets its validation findings in the report table.
"""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.numeric import nan_to_null
from ..plans.validation import validate


def validate_arrivals(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    out: str,
    checkpoint: str,
    target: str | None = None,
    config: Any = None,
    fmt: str = "parquet",
    available_now: bool = True,
) -> StreamingQuery:
    """Validate every micro-batch of new files and keep its findings.

    A batch writes to a folder of its own number, so a batch that is run again
    after a failure replaces its findings instead of doubling them.
    """

    def check(batch, number):
        rows = nan_to_null(batch).persist()
        try:
            found = validate(rows, target, config)
            report = found.report.withColumn("status", F.lit(found.status))
            report.write.mode("overwrite").parquet(os.path.join(out, f"batch={number}"))
        finally:
            rows.unpersist()

    arriving = spark.readStream.schema(schema).format(fmt).load(folder)
    writer = arriving.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
