"""Summary report: K7 from A1, A8 and A9."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FOLLOWER_BUCKETS, REPORT_BLANKS, REPORT_BUCKETS, REPORT_HEAD, REPORT_RULE, REPORT_THIN_RULE
from ..functions.buckets import bucket_dimension, bucket_ord
from ..functions.rates import fraction
from ..functions.times import as_timestamp
from ..small import small_table

_TOTAL, _BY_BUCKET, _BY_TERM = "overall", "follower_bucket", "top_term"


def summary_report(posts: DataFrame) -> DataFrame:
    """K7: rows (ord, section, key, value), always with the bucket section (T21); rates are fractions.

    The posts are counted once by term and bucket; grouping sets over those few counts give all three sections. Order numbers: 1-3 totals, 4 best term, 5-8 buckets.
    """
    flagged = posts.select(
        "has_moderation", "search_term", bucket_ord(F.col("author_followers")).alias("bucket_ord")
    )
    counts = flagged.groupBy("search_term", "bucket_ord").agg(
        F.count("*").alias("n"), F.count_if(F.col("has_moderation")).alias("m"), F.count("has_moderation").alias("known")
    )
    return report_of_counts(counts)


def report_of_counts(counts: DataFrame) -> DataFrame:
    """K7 from counts by term and bucket (n, m moderated, known flags)."""
    sets = counts.groupingSets(
        [[], [F.col("search_term")], [F.col("bucket_ord")]], "search_term", "bucket_ord"
    ).agg(
        F.sum("n").alias("n"),
        F.sum("m").alias("m"),
        F.sum("known").alias("known"),
        F.grouping("search_term").alias("no_term"),
        F.grouping("bucket_ord").alias("no_bucket"),
    )
    overall = (F.col("no_term") == 1) & (F.col("no_bucket") == 1)
    by_term = (F.col("no_term") == 0) & F.col("search_term").isNotNull() & (F.col("known") > 0)
    by_bucket = (F.col("no_bucket") == 0) & F.col("bucket_ord").isNotNull()
    section = F.when(overall, _TOTAL).when(by_term, _BY_TERM).when(by_bucket, _BY_BUCKET)

    dimension = bucket_dimension(counts.sparkSession)
    # Sections that must appear even without any post behind them.
    always = small_table(
        counts.sparkSession,
        [(_TOTAL, None, None, 0, 0, 0), *[(_BY_BUCKET, None, b[0], 0, 0, 0) for b in FOLLOWER_BUCKETS]],
        "section string, search_term string, bucket_ord int, n bigint, m bigint, known bigint",
    )
    rate = fraction(F.col("m"), F.col("known"))
    best = F.struct((-rate).alias("below"), "search_term")
    kept = (
        sets.select(section.alias("section"), "search_term", "bucket_ord", "n", "m", "known")
        .where(F.col("section").isNotNull())
        .unionByName(always)
        .groupBy("section", "bucket_ord")
        .agg(
            F.sum("n").alias("n"),
            F.sum("m").alias("m"),
            F.sum("known").alias("known"),
            F.min_by("search_term", best).alias("best_term"),
            F.max(rate).alias("best_rate"),
        )
    )
    labelled = kept.join(F.broadcast(dimension), "bucket_ord", "left")

    def line(number, key, value):
        return F.struct(
            F.lit(number).cast("int").alias("ord") if isinstance(number, int) else number.alias("ord"),
            key.alias("key"),
            value.cast("double").alias("value"),
        )

    totals = F.array(
        line(1, F.lit("total_posts"), F.col("n")),
        line(2, F.lit("moderated_posts"), F.col("m")),
        line(3, F.lit("moderation_rate"), fraction(F.col("m"), F.col("n"))),
    )
    term = F.array(line(4, F.col("best_term"), F.col("best_rate")))
    bucket = F.array(line(F.col("bucket_ord") + 4, F.col("follower_category"), rate))
    lines = F.when(F.col("section") == _TOTAL, totals).when(F.col("section") == _BY_TERM, term).otherwise(bucket)
    eight = labelled.select("section", F.inline(lines)).select("ord", "section", "key", "value")
    return eight.coalesce(1).sortWithinPartitions("ord")


def report_lines(report: DataFrame, title: str, run_ts=None) -> DataFrame:
    """The report as text lines (ord, value), numbers with two decimals."""
    pct = F.when(F.col("value").isNull(), "nan%").otherwise(
        # Rounded half-even beforehand, as the formatter would round halves up.
        F.format_string("%.2f%%", F.bround(F.col("value") * 100, 2))
    )
    count = F.format_string("%d", F.col("value").cast("bigint"))
    text = (
        F.when(F.col("ord") == 1, F.concat(F.lit("Total posts: "), count))
        .when(F.col("ord") == 2, F.concat(F.lit("Moderated posts: "), count))
        .when(F.col("ord") == 3, F.concat(F.lit("Moderation rate: "), pct))
        .when(
            F.col("ord") == 4,
            F.concat(F.lit("1. Search term '"), F.col("key"), F.lit("' had highest moderation rate ("), pct, F.lit(")")),
        )
        .otherwise(F.concat(F.lit("   - "), F.col("key"), F.lit(": "), pct))
    )
    body = report.select((F.col("ord") * 10).alias("ord"), text.alias("value"))
    fixed = small_table(
        report.sparkSession,
        [
            (1, title), (2, REPORT_RULE), (32, REPORT_HEAD), (33, REPORT_THIN_RULE), (45, REPORT_BUCKETS),
            *((at, "") for at in REPORT_BLANKS),
        ],
        "ord int, value string",
    )
    stamp = small_table(report.sparkSession, [(1000,)], "ord int").select(
        "ord", F.concat(F.lit("Generated: "), as_timestamp(run_ts).cast("string")).alias("value")
    )
    return body.unionByName(fixed).unionByName(stamp).coalesce(1).sortWithinPartitions("ord")
