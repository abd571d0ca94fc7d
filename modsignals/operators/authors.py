"""Author snapshots and their join to posts: P4, P10, P11, P21, J3, W5."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DELETED, ERROR
from ..functions.times import age_days, as_timestamp, from_epoch
from .joins import join_hot
from .topk import first_per_key, last_per_key

SNAPSHOT_FIELDS = (
    "account_age_days", "link_karma", "comment_karma", "total_karma", "is_verified", "author_unavailable",
)


def author_snapshot(raw_authors: DataFrame, run_ts=None, only_run=None) -> DataFrame:
    """One row per (run_ts, lookup_name); ``username`` is what a post of that author shows.

    With ``only_run`` the sightings of that run alone are read and the result, without ``run_ts``, has one row per name.

    The first sighting of a run wins, also when it failed (T18). No creation time means the account is unavailable;
    a normal account without karma numbers is an ``[error]`` row; ``[deleted]`` is not looked up.
    ``run_ts`` is the column of the input unless given.
    """
    named = raw_authors.where(F.col("username").isNotNull() & (F.col("username") != DELETED))
    if only_run is not None:
        named = named.where(F.col("run_ts") == as_timestamp(only_run))
    # Grouped by the name alone, a single run is known to be unique by name, and a join that shows no author is dropped.
    keys = ["username"] if only_run is not None else ["run_ts", "username"]
    first = first_per_key(named, keys, ["seen_no"])
    now = F.col("run_ts") if run_ts is None else as_timestamp(run_ts)
    usable = "created_utc IS NOT NULL AND link_karma IS NOT NULL AND comment_karma IS NOT NULL"
    columns = {
        "username": f"CASE WHEN usable OR created_utc IS NULL THEN username ELSE '{ERROR}' END",
        "account_age_days": "CASE WHEN usable THEN age END",
        "link_karma": "CASE WHEN usable THEN link_karma END",
        "comment_karma": "CASE WHEN usable THEN comment_karma END",
        "total_karma": "CASE WHEN usable THEN link_karma + comment_karma END",
        "is_verified": "CASE WHEN usable THEN coalesce(is_verified, false) END",
        "author_unavailable": "NOT usable",
    }
    shown = [] if only_run is not None else ["run_ts"]
    return (
        first.withColumns({"usable": F.expr(usable), "age": age_days(now, from_epoch(F.col("created_utc")))})
        .selectExpr(*shown, "username AS lookup_name", *[f"{e} AS {n}" for n, e in columns.items()])
    )


def with_author(
    posts: DataFrame, snapshot: DataFrame, author: str = "author", key: str = "fullname", run_ts=None
) -> DataFrame:
    """Posts with the seven author fields, prefixed ``author_``.

    A post gets one author row at most. Of a ``snapshot`` that holds several runs, ``run_ts`` names the one to use;
    without it each author's newest row is used. A snapshot without a ``run_ts`` column holds one run.

    A null or ``[deleted]`` author becomes the deleted row and an author without
    snapshot an unavailable one.
    One author may hold very many posts, and so may deleted ones, which have nothing to look up and are dealt
    out by ``key``.
    """
    if "run_ts" in snapshot.columns:
        if run_ts is not None:
            snapshot = snapshot.where(F.col("run_ts") == as_timestamp(run_ts))
        else:
            snapshot = last_per_key(snapshot, ["lookup_name"], ["run_ts"])
    name = F.col(author)
    known = name.isNotNull() & (name != DELETED)
    left = posts.withColumn("_author", F.when(known, name))
    fields = {"username": "_name", **{f: f"_{f}" for f in SNAPSHOT_FIELDS}}
    right = snapshot.selectExpr("lookup_name AS _author", *[f"{f} AS {short}" for f, short in fields.items()])
    joined = join_hot(left, right, ["_author"], "left", spread=F.col(key))
    return joined.selectExpr(
        *[f"`{c}`" for c in posts.columns],
        f"coalesce(_name, _author, '{DELETED}') AS author_username",
        *[f"_{f} AS author_{f}" for f in SNAPSHOT_FIELDS if f != "author_unavailable"],
        "coalesce(_author_unavailable, true) AS author_unavailable",
    )
