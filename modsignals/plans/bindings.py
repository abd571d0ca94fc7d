"""The given tables seen as posts, users, submissions, statuses and videos.

Bindings only project and join; the operators they feed are the library's own. Whatever is derived from a long text
is computed before a join, so texts do not travel through shuffles for queries that never show them.
"""

from pyspark.sql import DataFrame, SparkSession

from ..operators.terms import with_terms
from ..schemas import RAW_LABELS
from ..small import small_table

TERMS = ("license", "@", "free", "token", "the", "that", "de", "spam")
# A long list; two letters are shorter than a piece.
MANY_TERMS = tuple(a + b + c for a in "aeiou" for b in "lmnrst" for c in ("", "a", "e", "i", "u"))
RUN_TS = "2024-03-01 00:00:00"
FIRST_CHECK = "2024-02-01 00:00:00"
SECOND_CHECK = "2024-02-02 00:00:00"
RUNS = (FIRST_CHECK, SECOND_CHECK, RUN_TS)

# Event times carry no zone and are read as UTC.
_EVENT_MICROS = "unix_micros(CAST(ts AS timestamp))"
_EVENT_K = "CAST(get_json_object(props, '$.k') AS bigint)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _one_label(when: str, value: str, created: str) -> str:
    label = f"array(named_struct('val', {value}, 'cts', CAST({created} AS string)))"
    return f"CAST(CASE WHEN {when} THEN {label} ELSE array() END AS {RAW_LABELS})"


# ---- posts ----------------------------------------------------------------------------------------------------------

def _raw_posts(spark: SparkSession, folder: str, documents: DataFrame, search_term: str = "search_term") -> DataFrame:
    toxic, low = _one_label("toxic = 1", "'toxic'", "NULL"), _one_label("quality = 0", "'low_quality'", "lang")
    return documents.join(table(spark, folder, "labels"), "doc_id", "left").selectExpr(
        search_term,
        "CAST(doc_id AS string) AS uri",
        "n_chars AS likeCount",
        "CAST(quality AS bigint) AS repostCount",
        "CAST(toxic AS bigint) AS replyCount",
        """named_struct('handle', source, 'displayName', CAST(NULL AS string), 'followersCount', n_chars,
           'followsCount', CAST(length(source) AS bigint), 'postsCount', CAST(NULL AS bigint)) AS author""",
        "named_struct('text', text, 'createdAt', lang) AS record",
        f"{toxic} AS labels",
        f"CASE WHEN quality IS NOT NULL THEN named_struct('labels', {low}) END AS embed",
        "doc_id AS row_no",
    )


def raw_posts(spark: SparkSession, folder: str, shown: str = "text") -> DataFrame:
    """Every document once, as a nested post found under its language.

    ``shown`` is what is needed of the text; it is made before the join to the labels, so no more than that is shuffled.
    """
    return _raw_posts(spark, folder, table(spark, folder, "documents").selectExpr("* EXCEPT (text)", f"{shown} AS text", "lang AS search_term"))


def searched_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Every (term, document) match, as a nested post.

    The texts are searched before the join and a document crosses it once, however many terms it matches.
    """
    found = with_terms(table(spark, folder, "documents"), TERMS, "text")
    return _raw_posts(spark, folder, found, "explode_outer(search_terms) AS search_term")


def event_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as flat posts with three numeric engagement metrics; errors count as moderated."""
    return table(spark, folder, "events").selectExpr(
        "event_type = 'error' AS has_moderation",
        "CAST(rint(value * 100.0D) AS bigint) AS likes_count",
        f"{_EVENT_K} AS repost_count",
        "CAST(length(event_type) AS bigint) AS reply_count",
    )


def balance_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as posts whose follower count is the account balance, negatives included."""
    return table(spark, folder, "customer").selectExpr(
        "c_acctbal AS author_followers", "c_mktsegment = 'BUILDING' AS has_moderation"
    )


# ---- users ----------------------------------------------------------------------------------------------------------

def handles(spark: SparkSession, folder: str) -> DataFrame:
    """Every user of the event table, and one handle nobody knows."""
    users = table(spark, folder, "events").selectExpr("CAST(user_id AS string) AS handle").distinct()
    return users.unionByName(small_table(spark, [("-1",)], "handle string"))


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        "CAST(c_custkey AS string) AS handle",
        "c_name AS displayName",
        "CAST(floor(c_acctbal) AS bigint) AS followersCount",
        "CAST(c_nationkey AS bigint) AS followsCount",
        "CAST(NULL AS bigint) AS postsCount",
    )


def user_posts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "CAST(user_id AS string) AS handle",
        "event_id AS uri",
        f"{_EVENT_MICROS} AS created",
        f"{_one_label('event_type IN (' + repr('error') + ', ' + repr('signup') + ')', 'event_type', 'NULL')} AS labels",
        f"named_struct('labels', CAST(array() AS {RAW_LABELS})) AS embed",
    )


# ---- submissions ----------------------------------------------------------------------------------------------------

def raw_authors(spark: SparkSession, folder: str) -> DataFrame:
    """Each order is one sighting of an account; some sightings fail in one of two ways. Urgent ones belong to an earlier run as well."""
    runs = f"array(TIMESTAMP '{RUN_TS}', CASE WHEN o_orderpriority = '1-URGENT' THEN TIMESTAMP '{FIRST_CHECK}' END)"
    return table(spark, folder, "orders").selectExpr("*", f"explode(filter({runs}, r -> r IS NOT NULL)) AS run_ts").selectExpr(
        "run_ts",
        "o_orderkey AS seen_no",
        "CAST(o_custkey AS string) AS username",
        "CASE WHEN o_orderstatus <> 'P' THEN unix_micros(CAST(o_orderdate AS timestamp)) / 1000000.0D END AS created_utc",
        "CAST(floor(o_totalprice) AS bigint) AS link_karma",
        "CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderkey END AS comment_karma",
        "CASE o_orderpriority WHEN '2-HIGH' THEN true WHEN '5-LOW' THEN false END AS is_verified",
    )


def changing_authors(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as sightings in three runs: the first sees urgent ones only, the second also high and medium ones, the last all."""
    seen = ["o_orderpriority < '2'", "o_orderpriority < '4'", "true"]
    runs = ", ".join(f"CASE WHEN {test} THEN TIMESTAMP '{run}' END" for run, test in zip(RUNS, seen, strict=True))
    return table(spark, folder, "orders").selectExpr("*", f"explode(array_compact(array({runs}))) AS run_ts").selectExpr(
        "run_ts",
        "o_orderkey AS seen_no",
        "CAST(o_custkey AS string) AS username",
        "CASE WHEN o_orderstatus <> 'P' THEN unix_micros(CAST(o_orderdate AS timestamp)) / 1000000.0D END AS created_utc",
        "CAST(floor(o_totalprice / 100000) AS bigint) AS link_karma",
        "CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderkey % 2 END AS comment_karma",
        "o_orderpriority = '2-HIGH' AS is_verified",
    )


def event_submissions(spark: SparkSession, folder: str) -> DataFrame:
    """Events as submissions of the community named by their type."""
    return table(spark, folder, "events").selectExpr("*", f"{_EVENT_K} AS k").selectExpr(
        "concat('e', event_id) AS fullname",
        f"{_EVENT_MICROS} / 1000000.0D AS created_utc",
        "event_type AS subreddit",
        "concat(event_type, ' ', event_id) AS title",
        "CASE WHEN k >= 50 THEN props END AS selftext",
        "'self' AS domain",
        "CAST(floor(value) AS bigint) AS score",
        "k AS num_comments",
        "k / 100.0D AS upvote_ratio",
        "CAST(NULL AS string) AS link_flair_text",
        "CASE WHEN k >= 10 THEN CAST(user_id AS string) WHEN k >= 5 THEN '[deleted]' END AS author",
    )


def document_submissions(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as submissions of the community named by their language."""
    return table(spark, folder, "documents").selectExpr(
        "CAST(doc_id AS string) AS fullname",
        "1704067200.0D + n_chars / 8.0D AS created_utc",
        "lang AS subreddit",
        "concat(source, ' ', doc_id) AS title",
        "text AS selftext",
        "source AS domain",
        "n_chars AS score",
        "CAST(length(source) AS bigint) AS num_comments",
        "0.5D AS upvote_ratio",
        "CAST(NULL AS string) AS link_flair_text",
        "source AS author",
    )


def order_submissions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as submissions; pending ones have no creation time yet."""
    return table(spark, folder, "orders").selectExpr(
        "CAST(o_orderkey AS string) AS fullname",
        "CASE WHEN o_orderstatus <> 'P' THEN unix_micros(CAST(o_orderdate AS timestamp)) / 1000000.0D END AS created_utc",
        "o_orderpriority AS subreddit",
    )


def raw_status(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents, checked twice: clean the first time, with their true marks the second."""
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    checked = documents.join(table(spark, folder, "labels"), "doc_id").selectExpr(
        "*",
        f"""inline(array(named_struct('checked_at', TIMESTAMP '{FIRST_CHECK}', 'marked', false),
                         named_struct('checked_at', TIMESTAMP '{SECOND_CHECK}', 'marked', true)))""",
    )
    return checked.selectExpr(
        "CAST(doc_id AS string) AS fullname",
        """CASE WHEN marked AND source = 'src1' THEN '[removed]' WHEN marked AND source = 'src2' THEN '[deleted]'
                ELSE lang END AS selftext""",
        "CASE WHEN marked AND lang = 'de' AND quality = 0 THEN '[removed]' ELSE source END AS title",
        """CASE WHEN marked AND source = 'src3' THEN '[deleted]'
                WHEN NOT marked OR source <> 'src4' THEN source END AS author""",
        "CASE WHEN marked AND toxic = 1 THEN 'moderator' END AS removed_by_category",
        "CASE WHEN marked AND lang = 'fr' THEN toxic = 0 WHEN lang = 'en' THEN true END AS is_robot_indexable",
        "marked AND quality = 0 AS locked",
        "false AS archived",
        "CASE WHEN marked THEN n_chars ELSE 0 END AS score",
        "CAST(quality AS bigint) AS num_comments",
        "0.5D AS upvote_ratio",
        "checked_at AS rechecked_at_utc",
    )


# ---- videos ---------------------------------------------------------------------------------------------------------

def videos(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").selectExpr(
        "doc_id AS id",
        "CASE WHEN lang = 'en' THEN 'US' ELSE upper(lang) END AS region",
        "'video' AS type",
        "concat(source, ' ', doc_id) AS title",
        "source AS channel",
        "text AS search_text",
        "doc_id AS relevance_pos",
    )


def video_details(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").selectExpr(
        "doc_id AS id",
        """named_struct('viewCount', concat(quality, toxic, '7'), 'likeCount', CASE WHEN quality = 1 THEN '12' ELSE 'x' END,
           'commentCount', CAST(NULL AS string)) AS statistics""",
        """named_struct('embeddable', quality = 1, 'publicStatsViewable', CASE WHEN quality = 1 THEN toxic = 0 END,
           'madeForKids', toxic = 1) AS status""",
    )
