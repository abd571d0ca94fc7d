"""SQL twins of the queries over stored tables and streams."""

from .bindings import FIRST_CHECK, RUN_TS, RUNS, SECOND_CHECK, TERMS
from .oracle import (
    _COMPLETE,
    _DOCUMENT_POSTS,
    _DOCUMENT_SUBMISSIONS,
    _SNAPSHOT,
    _STATUS,
    ORACLE_SQL as _BATCH,
    _with_author,
)

_TERM_ROWS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TERMS))
_TIED_STATUS = _STATUS.replace(f"TIMESTAMP '{SECOND_CHECK}', true", f"TIMESTAMP '{FIRST_CHECK}', true").replace(
    "ORDER BY rechecked_at_utc DESC", "ORDER BY rechecked_at_utc DESC, final_score DESC"
)

# What each of the three runs saw of an account, as the binding has it.
_VERSIONS = f"""
sightings AS (
  SELECT o.*, r.run_ts FROM orders o JOIN (VALUES (TIMESTAMP '{RUNS[0]}', '2'), (TIMESTAMP '{RUNS[1]}', '4'), (TIMESTAMP '{RUNS[2]}', '9')) r(run_ts, below)
    ON o.o_orderpriority < r.below
), first_seen AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_ts, o_custkey ORDER BY o_orderkey) AS rn FROM sightings) WHERE rn = 1
), raw AS (
  SELECT run_ts, CAST(o_custkey AS VARCHAR) AS lookup_name, o_orderstatus <> 'P' AS has_time, CAST(floor(o_totalprice / 100000) AS BIGINT) AS link_karma,
         CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(o_orderkey % 2 AS BIGINT) END AS comment_karma, o_orderpriority = '2-HIGH' AS is_verified
  FROM first_seen
), snapshot AS (
  SELECT run_ts, lookup_name, CASE WHEN usable OR NOT has_time THEN lookup_name ELSE '[error]' END AS username,
         CASE WHEN usable THEN link_karma END AS link_karma, CASE WHEN usable THEN comment_karma END AS comment_karma,
         CASE WHEN usable THEN link_karma + comment_karma END AS total_karma, CASE WHEN usable THEN is_verified END AS is_verified, NOT usable AS author_unavailable
  FROM (SELECT *, has_time AND link_karma IS NOT NULL AND comment_karma IS NOT NULL AS usable FROM raw)
), numbered AS (
  SELECT *, lag(run_ts) OVER w IS NULL OR (username, link_karma, comment_karma, is_verified, author_unavailable)
         IS DISTINCT FROM (lag(username) OVER w, lag(link_karma) OVER w, lag(comment_karma) OVER w, lag(is_verified) OVER w, lag(author_unavailable) OVER w) AS starts
  FROM snapshot WINDOW w AS (PARTITION BY lookup_name ORDER BY run_ts)
)"""

ORACLE_SQL: dict[str, str] = {
    "newest_ids_roundtrip": "SELECT lang AS subreddit, CAST(doc_id AS VARCHAR) AS post_fullname FROM documents",
    "newest_rows_roundtrip": _BATCH["newest_files_roundtrip"],
    "post_row_numbers": f"""{_DOCUMENT_POSTS}
SELECT row_number() OVER (ORDER BY row_no) - 1 AS row_no, post_uri, has_moderation FROM posts""",
    "sample_from_files": f"""{_DOCUMENT_POSTS}
SELECT post_no, author_handle, author_followers, substring(post_text, 1, 100) || '...' AS text_preview, search_term, label_values, likes_count, repost_count
FROM (SELECT *, row_number() OVER (ORDER BY row_no) AS post_no FROM posts) WHERE has_moderation ORDER BY post_no LIMIT 5""",
    "label_top_from_files": """
WITH values_ AS (SELECT doc_id, 0 AS pos, 'toxic' AS value FROM labels JOIN documents USING (doc_id) WHERE toxic = 1
                 UNION ALL SELECT doc_id, 1, 'low_quality' FROM labels JOIN documents USING (doc_id) WHERE quality = 0)
SELECT value, CAST(count(*) AS BIGINT) AS n FROM values_ GROUP BY value ORDER BY n DESC, min(doc_id * 2 + pos) LIMIT 10""",
    "json_object_roundtrip": _BATCH["json_roundtrip"],
    "listed_terms": f"""
SELECT CAST(term_no AS INTEGER) AS term_no, t.search_term, CAST(count(d.doc_id) AS BIGINT) AS hits, min(d.doc_id) AS first_doc
FROM (VALUES {_TERM_ROWS}) t(term_no, search_term) LEFT JOIN documents d ON contains(lower(d.text), lower(t.search_term)) GROUP BY ALL""",
    "skipped_community": f"""{_COMPLETE}
SELECT subreddit, CAST(count(*) AS BIGINT) AS n_cohort, CAST(count(is_removed_official) AS BIGINT) AS n_checked
FROM complete WHERE subreddit <> 'es' GROUP BY subreddit""",
    "status_ties": f"WITH {_TIED_STATUS} SELECT * FROM status",
    "bucketed_status": _BATCH["cohort_status_left"],
    "basic_stats_of_runs": _BATCH["basic_stats"],
    "report_of_runs": _BATCH["summary_report"],
    "removal_rates_of_runs": _BATCH["removal_rates"],
    "author_versions": f"""WITH {_VERSIONS}
SELECT lookup_name, username, link_karma, comment_karma, total_karma, is_verified, author_unavailable, epoch_us(run_ts) AS valid_from,
       epoch_us(lead(run_ts) OVER (PARTITION BY lookup_name ORDER BY run_ts)) AS valid_to FROM numbered WHERE starts""",
    "captured_stream": f"""WITH {_SNAPSHOT}, {_DOCUMENT_SUBMISSIONS}, {_with_author("submissions")}
SELECT subreddit, fullname AS post_fullname, title, score AS initial_score, epoch_us(TIMESTAMP '{RUN_TS}') AS captured_at_utc, author_username FROM authored""",
    "recheck_stream": f"""{_COMPLETE}
SELECT subreddit, post_fullname, final_score, final_num_comments, final_upvote_ratio, is_removed_official, is_removed_content, is_removed_inferred,
       removed_by_category, is_deleted, is_deleted_author, is_deleted_content, is_locked, is_archived FROM complete""",
    "status_state": _BATCH["status_flags"],
}
