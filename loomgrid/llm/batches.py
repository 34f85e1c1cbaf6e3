"""Small Arrow batches for texts."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a batch that may hold whole texts; Spark's default of 10,000 is meant for narrow rows.
TEXT_ROWS = 500
KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(docs: DataFrame) -> DataFrame:
    """``docs``, whose session from now on sends at most ``TEXT_ROWS`` rows to Python at once.

    The setting is read when a plan runs, so it stays; a smaller one is left alone.
    """
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(KEY, "10000")) <= TEXT_ROWS:
        conf.set(KEY, str(TEXT_ROWS))
    return docs
