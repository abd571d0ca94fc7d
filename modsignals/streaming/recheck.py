"""Pass 2 over files that keep arriving: J1 as a join of two streams, A19 as state kept per post.

The first captures and the re-checks are folders that grow. A capture waits for re-checks up to a horizon. When the watermark
of both has passed that, a capture without any comes out with null status, as in the left join of the batch (T12).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cohort import STATUS_FIELDS, latest_status, status_flags
from ..operators.topk import last_per_key
from ..schemas import PASS1, RAW_STATUS, STATUS, names

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """State of streams started from now on lies on the executors' disks instead of in their memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def read_captures(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Pass-1 rows of a snapshot table, as its files arrive."""
    table = spark.readStream.schema(f"{PASS1}, run_id string").option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return table.select(*names(PASS1))


def read_rechecks(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Raw statuses of a folder as its files arrive, with their flags."""
    return status_flags(spark.readStream.schema(RAW_STATUS).option("maxFilesPerTrigger", files_per_batch).parquet(folder))


# ---- J1 -------------------------------------------------------------------------------------------------------------


def recheck(captures: DataFrame, rechecks: DataFrame, horizon: str = "30 days", delay: str = "1 day") -> DataFrame:
    """J1 of two streams: every capture with each re-check within ``horizon`` after it, or with nulls if there is none.

    Rows that come later than ``delay`` after newer ones can be missed. State holds the captures and re-checks of the
    last ``horizon`` and ``delay``, whatever the length of the streams.
    """
    first = captures.withWatermark("captured_at_utc", delay)
    later = rechecks.withWatermark("rechecked_at_utc", delay).withColumnRenamed("post_fullname", "_post")
    within = f"rechecked_at_utc >= captured_at_utc AND rechecked_at_utc <= captured_at_utc + INTERVAL {horizon}"
    joined = first.join(later, F.expr(f"post_fullname = _post AND {within}"), "leftOuter")
    return joined.select(*names(PASS1), *STATUS_FIELDS)


def closing_row(spark: SparkSession, ddl: str, time: str, at: str, **more) -> DataFrame:
    """A row without anything but a time, and what ``more`` gives. Arriving last in both streams, it lets the watermark pass all
    rows before it.

    Among captures it needs no id. Re-checks without an id are left out of the join before their time is seen, so there it needs
    one that no capture has. It matches nothing and stays in the state.
    """
    values = {time: F.lit(at), **{name: F.lit(value) for name, value in more.items()}}
    fields = [field.split(" ", 1) for field in ddl.split(", ")]
    return spark.range(1).select(*[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])


def write_rows(rows: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Appends a stream's rows to a table, exactly once through ``checkpoint``; without ``interval`` what is there, then ends."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(**trigger).start()


def last_rechecks(spark: SparkSession, path: str) -> DataFrame:
    """The written join with the last re-check of every capture only."""
    rows = spark.read.schema(f"{PASS1}, {STATUS.split(', ', 1)[1]}").parquet(path)
    return last_per_key(rows.where(F.col("post_fullname").isNotNull()), ["post_fullname"], ["rechecked_at_utc"])


# ---- A19 ------------------------------------------------------------------------------------------------------------


def write_status(rechecks: DataFrame, changes: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keeps the last status of every post as the state of a stream; each batch meets the state, never the history.

    The posts that a batch has met go to ``changes`` with their last status, a folder per batch, so a repeated batch replaces its own
    folder. The order of arrival does not matter: an older re-check that comes late changes nothing.
    """

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{changes}/batch={batch}")

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    kept = latest_status(rechecks).writeStream.outputMode("update").foreachBatch(keep)
    return kept.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_status(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The last status of every post, read from the state itself: one row per post, however long the history was."""
    state = spark.read.format("statestore").load(checkpoint)
    columns = [name for name in names(STATUS) if name != "post_fullname"]
    # The state of the one aggregate is the row picked, then what it was picked by.
    row = state.select("key.post_fullname", "value.*").toDF("post_fullname", "_row", "_order").select("post_fullname", "_row.*")
    return row.select("post_fullname", *columns)
