"""Writers, the only place where the library runs actions: K1-K7."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..constants import NOT_AVAILABLE
from ..functions.times import as_timestamp, run_id
from ..schemas import COUNT_FIELDS
from .readers import CSV_OPTIONS
from .replace import replace_folder

CSV_WRITE_OPTIONS = {
    **CSV_OPTIONS,
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, path: str) -> bool:
    """K1, K3: CSV with header, replacing what is there; without rows, what is there stays.

    The rows are computed once: they are written beside ``path`` and counted on the way, and put in place if there are any.
    A write that fails or dies on the way leaves the old rows, which readers then find (``replace``).
    """
    def write(aside: str) -> bool:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.options(**CSV_WRITE_OPTIONS).csv(aside)
        return seen.get["rows"] > 0

    return replace_folder(df.sparkSession, path, write)


def write_snapshot(df: DataFrame, path: str, run_ts=None, fmt: str = "parquet") -> None:
    """K2, K3, K5: one folder per run and community; the combined table is the same path read whole.

    ``fmt`` is ``parquet`` or ``csv``; the CSV form is read back with ``read_pass1`` or ``read_complete``.
    Rewriting a run replaces only its own folders, so a repeated job does no harm. Rebalancing gives each folder
    few files and lets adaptive execution cut a large community into several tasks.
    """
    stamped = df.withColumn("run_id", run_id(as_timestamp(run_ts)))
    (
        stamped.hint("rebalance", "run_id", "subreddit")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**(CSV_WRITE_OPTIONS if fmt == "csv" else {}))
        .partitionBy("run_id", "subreddit")
        .format(fmt)
        .save(path)
    )


def write_partials(partials: DataFrame, path: str, run: str) -> None:
    """Partial sums of one run, in its own folder; writing a run again replaces them."""
    partials.write.mode("overwrite").parquet(f"{path}/run_id={run}")


def write_cohort_ids(id_lists: DataFrame, path: str) -> None:
    """K4: one JSON object per line, mapping a community to its ids."""
    one = F.create_map("subreddit", "post_fullnames")
    id_lists.select(F.to_json(one).alias("value")).write.mode("overwrite").text(path)


def _or_not_available(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(NOT_AVAILABLE))


def render_counts(records: DataFrame) -> DataFrame:
    """Counts as text, absent ones as ``N/A``, for the JSON edge only."""
    def rendered(video: Column) -> Column:
        for name in COUNT_FIELDS:
            video = video.withField(name, _or_not_available(video[name]))
        return video

    return records.withColumn("video_details", F.transform("video_details", rendered))


def write_term_records(records: DataFrame, path: str, run_ts=None) -> None:
    """K6: nested records as JSON lines, one folder per collection date."""
    dated = render_counts(records).withColumn("collect_date", F.to_date(as_timestamp(run_ts)))
    (
        dated.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("ignoreNullFields", False)
        .partitionBy("collect_date")
        .json(path)
    )


def write_report(lines: DataFrame, path: str) -> None:
    """K7: the text lines of ``report_lines`` in one file; there are fewer than twenty."""
    lines.select("value").write.mode("overwrite").text(path)
