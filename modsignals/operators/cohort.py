"""Two-pass cohorts: S4, S5, S9, S10, P5, P6, F3, F5, F6, J1, J6, J7, A13, A18, A19, A20."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DELETED, POSTS_PER_COMMUNITY, REMOVED
from ..functions.rates import percent
from ..functions.text import body_cut
from ..functions.times import age_seconds, as_timestamp, from_epoch
from ..schemas import PASS1, STATUS, names
from .authors import with_author
from .joins import CHECKED_ROWS, broadcast_checked, join_hot
from .topk import last_per_key, top_k_per_group

REQUIRED = ("fullname", "created_utc")
# Ids in one list of the id table, about.
IDS_PER_LIST = 10_000
STATUS_FIELDS = names(STATUS)[1:]


# ---- pass 1 ----------------------------------------------------------------------------------------------------

def newest_submissions(raw: DataFrame, k: int = POSTS_PER_COMMUNITY) -> DataFrame:
    """The newest ``k`` submissions of every community."""
    order = [F.desc("created_utc"), F.desc("fullname")]
    return top_k_per_group(raw, ["subreddit"], order, k)


def _complete() -> Column:
    test = F.col(REQUIRED[0]).isNotNull()
    for name in REQUIRED[1:]:
        test = test & F.col(name).isNotNull()
    return test


def rejected_submissions(raw: DataFrame) -> DataFrame:
    """F3, the other side: rows that cannot become a pass-1 row, for a quarantine table."""
    return raw.where(~_complete())


def pass1_rows(raw: DataFrame, authors: DataFrame, run_ts=None) -> DataFrame:
    """P5: the 19 columns of a first capture. Incomplete submissions are dropped."""
    captured = as_timestamp(run_ts)
    created = from_epoch(F.col("created_utc"))
    computed = {
        "post_fullname": F.col("fullname"),
        "created_utc": created,
        "captured_at_utc": captured,
        "post_age_seconds_at_capture": age_seconds(captured, created),
        "selftext": body_cut(F.col("selftext")),
        "initial_score": F.col("score"),
        "initial_num_comments": F.col("num_comments"),
        "initial_upvote_ratio": F.col("upvote_ratio"),
    }
    own = [n for n in names(PASS1) if not n.startswith("author_")]
    # The body is cut and every other own column is made before the join, so nothing longer is shuffled.
    rows = raw.where(_complete()).select(*[computed[n].alias(n) if n in computed else n for n in own], "author")
    return with_author(rows, authors, key="post_fullname").select(*names(PASS1))


def newest_cohort(raw: DataFrame, authors: DataFrame, run_ts=None, k: int = POSTS_PER_COMMUNITY) -> DataFrame:
    """S9 with P5: cut to the newest rows first, so only those meet the author dimension.

    Bodies are cut before that, which keeps long ones out of the sort.
    """
    short = raw.withColumn("selftext", body_cut(F.col("selftext")))
    return pass1_rows(newest_submissions(short, k), authors, run_ts)


def cohort_ids(pass1: DataFrame, run_ts=None) -> DataFrame:
    """The id table of a run, one row per post."""
    return pass1.select(as_timestamp(run_ts).alias("run_ts"), "subreddit", "post_fullname")


def cohort_id_lists(ids: DataFrame, most: int = IDS_PER_LIST) -> DataFrame:
    """Ids of each community as sorted lists; communities without ids are absent.

    A community with more than about ``most`` ids gets several lists, dealt out by a hash of the id, so that no list grows
    with the data.
    """
    ids = ids.where(F.col("post_fullname").isNotNull()).select("subreddit", "post_fullname")
    lists = ids.groupBy("subreddit").agg(F.ceil(F.count("*") / most).alias("_lists"))
    dealt = join_hot(ids, lists, ["subreddit"], "inner").withColumn("_list", F.expr("pmod(xxhash64(post_fullname), _lists)"))
    grouped = dealt.groupBy("subreddit", "_list").agg(F.array_sort(F.collect_list("post_fullname")).alias("post_fullnames"))
    return grouped.drop("_list")


# ---- choosing the run --------------------------------------------------------------------------------------------

def latest_run(runs: DataFrame, by: str = "run_ts") -> DataFrame:
    """Rows of the newest run. A scalar subquery, so a table partitioned by run reads only that run."""
    return runs.where(F.col(by) == runs.agg(F.max(by)).scalar())


def latest_per_community(pass1: DataFrame, by: str = "run_ts", check_size: bool = False) -> DataFrame:
    """Rows of the newest run of each community, matched by exact name.

    ``by`` should be a time or a number; the maximum of text needs its input sorted. With ``check_size`` the communities
    are counted beforehand, by a job of its own, and the snapshots are not shuffled if there are few.
    """
    newest = pass1.groupBy("subreddit").agg(F.max(by).alias(by))
    if check_size:
        newest = broadcast_checked(newest)
    return join_hot(pass1, newest, ["subreddit", by], "inner")


# ---- pass 2 ----------------------------------------------------------------------------------------------------

def status_flags(raw: DataFrame) -> DataFrame:
    """P6 with F6a-f: the 13 status fields of a re-check. Comparisons are null-safe."""
    official = "removed_by_category IS NOT NULL"
    removed_content = f"(selftext <=> '{REMOVED}' OR title <=> '{REMOVED}')"
    deleted_content = f"selftext <=> '{DELETED}'"
    deleted_author = f"(author IS NULL OR author = '{DELETED}')"
    source = {
        "post_fullname": "fullname",
        "final_score": "score",
        "final_num_comments": "num_comments",
        "final_upvote_ratio": "upvote_ratio",
        "is_removed_official": official,
        "is_removed_content": removed_content,
        "is_removed_inferred": f"{official} OR {removed_content} OR is_robot_indexable <=> false",
        "is_deleted": f"{deleted_author} OR {deleted_content}",
        "is_deleted_author": deleted_author,
        "is_deleted_content": deleted_content,
        "is_locked": "locked",
        "is_archived": "archived",
    }
    return raw.selectExpr(*[f"{source.get(n, n)} AS {n}" for n in names(STATUS)])


def latest_status(status: DataFrame, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """One row per post, the last re-check wins (T19). Equal times are told apart by ``tie_break``, then by the row."""
    return last_per_key(status, ["post_fullname"], ["rechecked_at_utc", *tie_break])


def cohort_status(status: DataFrame, ids: DataFrame, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """The latest status of cohort posts only.

    The history is cut to the cohort before it is grouped, so what is not asked for is neither sorted nor grouped. The join
    stays balanced when one post is re-checked very often.
    """
    asked = ids.select("post_fullname").distinct()
    return last_per_key(join_hot(status, asked, ["post_fullname"], "left_semi"), ["post_fullname"], ["rechecked_at_utc", *tie_break])


def started_communities(
    pass1: DataFrame, ids: DataFrame, communities: Sequence[str] | None = None, check_size: bool = False
) -> DataFrame:
    """Pass-1 rows of communities that have ids. ``pass1`` holds one run, the same as ``ids``.

    A literal list of communities prunes partitions of both tables before the join, and as it bounds the rows of
    the id side, that side is broadcast. Without a list, ``check_size`` counts the communities first, by a job of its own;
    otherwise Spark decides while it runs.
    """
    started = ids.where(F.col("post_fullname").isNotNull())
    if communities is not None:
        started = started.where(F.col("subreddit").isin(list(communities)))
        pass1 = pass1.where(F.col("subreddit").isin(list(communities)))
    started = started.select("subreddit").distinct()
    if communities is not None and len(communities) <= CHECKED_ROWS:
        started = F.broadcast(started)
    elif check_size:
        started = broadcast_checked(started)
    return join_hot(pass1, started, ["subreddit"], "left_semi")


def complete_cohort(
    pass1: DataFrame,
    ids: DataFrame,
    status: DataFrame,
    communities: Sequence[str] | None = None,
    tie_break: tuple[str, ...] = (),
    check_size: bool = False,
) -> DataFrame:
    """J7 then J1: pass-1 rows with their status where there is one; others keep nulls."""
    started = started_communities(pass1, ids, communities, check_size)
    checked = cohort_status(status, ids, tie_break)
    extra = [c for c in pass1.columns if c != "post_fullname"]
    return started.join(checked, "post_fullname", "left").select("post_fullname", *extra, *STATUS_FIELDS)


def _rates() -> list[Column]:
    def rate(flag: str) -> Column:
        return percent(F.count_if(F.col(flag)), F.count(flag))

    return [
        F.count("*").alias("n_cohort"),
        F.count("is_removed_official").alias("n_checked"),
        rate("is_removed_official").alias("official_pct"),
        rate("is_removed_inferred").alias("inferred_pct"),
        rate("is_locked").alias("locked_pct"),
    ]


def removal_rates(complete: DataFrame) -> DataFrame:
    """Rates over the posts that were found again (T12), with both bases beside them."""
    return complete.agg(*_rates(), F.countDistinct("subreddit").alias("subreddits"))


def community_totals(complete: DataFrame) -> DataFrame:
    """Posts of each community, and how many have a status."""
    return complete.groupBy("subreddit").agg(
        F.count("*").alias("n_cohort"), F.count("is_removed_official").alias("n_checked")
    )


def combine_snapshots(*frames: DataFrame) -> DataFrame:
    """Union by column name; a column missing in one frame is null there."""
    combined = frames[0]
    for frame in frames[1:]:
        combined = combined.unionByName(frame, allowMissingColumns=True)
    return combined
