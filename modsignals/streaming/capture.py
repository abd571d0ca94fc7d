"""Pass 1 over files that keep arriving: S9's input, P5 unchanged, K2's table as sink.

Each drop file holds raw submissions with the time they were fetched. The batch operators do the work; only the
source, the sink and the removal of repeated captures differ.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import run_id
from ..operators.cohort import pass1_rows
from ..schemas import RAW_SUBMISSION

DROP_SCHEMA = RAW_SUBMISSION + ", captured_at timestamp"


def read_drops(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Drop files (JSON lines) as a stream with a fixed schema."""
    return spark.readStream.schema(DROP_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def capture(drops: DataFrame, authors: DataFrame, delay: str = "1 day") -> DataFrame:
    """Pass-1 rows of a stream; within ``delay`` a post fetched again is not captured again.

    State is kept per post id and dropped once the watermark has passed it.
    """
    rows = pass1_rows(drops, authors, F.col("captured_at"))
    return rows.withWatermark("captured_at_utc", delay).dropDuplicatesWithinWatermark(["post_fullname"])


def write_captures(rows: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append to a table foldered by capture day and community, exactly once through ``checkpoint``.

    Without ``interval`` everything present is processed and the query ends.
    """
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    day = F.date_trunc("day", "captured_at_utc")
    return (
        rows.withColumn("run_id", run_id(day))
        .writeStream.format("parquet")
        .partitionBy("run_id", "subreddit")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .trigger(**trigger)
        .start()
    )
