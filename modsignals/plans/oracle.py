"""SQL twins of the registered queries, for a second engine over the same tables."""

from .bindings import FIRST_CHECK, MANY_TERMS, RUN_TS, SECOND_CHECK, TERMS

_TERM_VALUES = ", ".join(f"('{t}')" for t in TERMS)

# ---- shared parts ---------------------------------------------------------------------------------------------------

_TERMS = f"terms AS (SELECT * FROM (VALUES {_TERM_VALUES}) t(search_term))"


def _posts(source: str) -> str:
    return f"""
posts AS (
  SELECT d.search_term, CAST(d.doc_id AS VARCHAR) AS post_uri, coalesce(d.text, '') AS post_text,
         coalesce(d.source, '') AS author_handle, '' AS author_display_name,
         coalesce(d.n_chars, 0) AS author_followers, CAST(coalesce(length(d.source), 0) AS BIGINT) AS author_following,
         CAST(0 AS BIGINT) AS author_posts, coalesce(d.n_chars, 0) AS likes_count,
         CAST(coalesce(l.quality, 0) AS BIGINT) AS repost_count, CAST(coalesce(l.toxic, 0) AS BIGINT) AS reply_count,
         coalesce(l.toxic = 1, false) OR coalesce(l.quality = 0, false) AS has_moderation,
         coalesce(d.lang, '') AS created_at,
         CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END + CASE WHEN l.quality = 0 THEN 1 ELSE 0 END AS n_labels,
         concat_ws('|', CASE WHEN l.toxic = 1 THEN 'post:toxic:unknown' END,
                   CASE WHEN l.quality = 0 THEN 'embed:low_quality:' || coalesce(d.lang, 'unknown') END) AS label_text,
         concat_ws(', ', CASE WHEN l.toxic = 1 THEN 'toxic' END,
                   CASE WHEN l.quality = 0 THEN 'low_quality' END) AS label_values,
         d.doc_id AS row_no
  FROM ({source}) d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


_DOCUMENT_POSTS = "WITH " + _posts("SELECT *, lang AS search_term FROM documents")
_FOUND_POSTS = f"WITH {_TERMS}, " + _posts(
    "SELECT d.*, t.search_term FROM documents d JOIN terms t ON contains(lower(d.text), lower(t.search_term))"
)

_RATE4 = "round_even({part}::DOUBLE / nullif({whole}, 0) * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE * 100.0::DOUBLE"


def _rate4(part: str, whole: str) -> str:
    return _RATE4.format(part=part, whole=whole)


def _pct(part: str, whole: str) -> str:
    return f"CAST({part} AS DOUBLE) / nullif({whole}, 0) * 100.0::DOUBLE"


def _frac(part: str, whole: str) -> str:
    return f"CAST({part} AS DOUBLE) / nullif({whole}, 0)"


_MODERATED = "CAST(count(*) FILTER (WHERE has_moderation) AS BIGINT)"

_BUCKETS = """
buckets AS (SELECT * FROM (VALUES (1, '<100', 0, 100), (2, '100-1K', 100, 1000), (3, '1K-10K', 1000, 10000),
                                  (4, '>10K', 10000, NULL)) t(bucket_ord, follower_category, lo, hi))"""


def _bucket_counts(source: str) -> str:
    return f"""
counted AS (
  SELECT b.bucket_ord, b.follower_category, CAST(count(p.has_moderation) FILTER (WHERE p.has_moderation) AS BIGINT) AS moderated,
         CAST(count(p.has_moderation) AS BIGINT) AS total
  FROM buckets b LEFT JOIN {source} p ON p.author_followers > b.lo AND (b.hi IS NULL OR p.author_followers <= b.hi)
  GROUP BY b.bucket_ord, b.follower_category
)"""


_FLAT = """search_term, post_uri, {text}, author_handle, {display}, author_followers, author_following, author_posts,
  likes_count, repost_count, reply_count, has_moderation, created_at, CAST(n_labels AS BIGINT) AS n_labels, label_text"""

_USER_POSTS = """
ranked AS (
  SELECT CAST(user_id AS VARCHAR) AS handle, event_id, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events
), feed AS (SELECT * FROM ranked WHERE rn <= 50)"""

_RUN_US = f"epoch_us(TIMESTAMP '{RUN_TS}')"

_SNAPSHOT = f"""
sightings AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders
), raw_authors AS (
  SELECT CAST(o_custkey AS VARCHAR) AS lookup_name,
         CASE WHEN o_orderstatus <> 'P' THEN epoch_us(o_orderdate) END AS created_us,
         CAST(floor(o_totalprice) AS BIGINT) AS link_karma,
         CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderkey END AS comment_karma,
         CASE o_orderpriority WHEN '2-HIGH' THEN true WHEN '5-LOW' THEN false END AS is_verified
  FROM sightings WHERE rn = 1
), snapshot AS (
  SELECT lookup_name,
         CASE WHEN created_us IS NOT NULL AND comment_karma IS NULL THEN '[error]' ELSE lookup_name END AS username,
         CASE WHEN usable THEN CAST(floor(({_RUN_US} - created_us) / 86400000000) AS BIGINT) END AS account_age_days,
         CASE WHEN usable THEN link_karma END AS link_karma,
         CASE WHEN usable THEN comment_karma END AS comment_karma,
         CASE WHEN usable THEN link_karma + comment_karma END AS total_karma,
         CASE WHEN usable THEN coalesce(is_verified, false) END AS is_verified,
         NOT usable AS author_unavailable
  FROM (SELECT *, created_us IS NOT NULL AND link_karma IS NOT NULL AND comment_karma IS NOT NULL AS usable
        FROM raw_authors)
)"""


def _with_author(source: str) -> str:
    return f"""
authored AS (
  SELECT p.*,
         CASE WHEN p.author IS NULL OR p.author = '[deleted]' THEN '[deleted]'
              ELSE coalesce(a.username, p.author) END AS author_username,
         a.account_age_days AS author_account_age_days, a.link_karma AS author_link_karma,
         a.comment_karma AS author_comment_karma, a.total_karma AS author_total_karma,
         a.is_verified AS author_is_verified, coalesce(a.author_unavailable, true) AS author_unavailable
  FROM {source} p LEFT JOIN snapshot a ON a.lookup_name = p.author
)"""


_EVENT_SUBMISSIONS = """
submissions AS (
  SELECT 'e' || CAST(event_id AS VARCHAR) AS fullname, epoch_us(ts) / 1000000.0::DOUBLE AS created_utc,
         event_type AS subreddit, event_type || ' ' || CAST(event_id AS VARCHAR) AS title,
         CASE WHEN k >= 50 THEN props END AS selftext, 'self' AS domain, CAST(floor(value) AS BIGINT) AS score,
         k AS num_comments, k / 100.0::DOUBLE AS upvote_ratio, CAST(NULL AS VARCHAR) AS link_flair_text,
         CASE WHEN k >= 10 THEN CAST(user_id AS VARCHAR) WHEN k >= 5 THEN '[deleted]' END AS author
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""

_NEWEST = """
newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY created_utc DESC, fullname DESC) AS rn
                 FROM submissions) WHERE rn <= 100
)"""

_DOCUMENT_SUBMISSIONS = """
submissions AS (
  SELECT CAST(doc_id AS VARCHAR) AS fullname, 1704067200.0::DOUBLE + n_chars / 8.0::DOUBLE AS created_utc,
         lang AS subreddit, source || ' ' || CAST(doc_id AS VARCHAR) AS title, text AS selftext, source AS domain,
         n_chars AS score, CAST(length(source) AS BIGINT) AS num_comments, 0.5::DOUBLE AS upvote_ratio,
         CAST(NULL AS VARCHAR) AS link_flair_text, source AS author
  FROM documents
)"""

_CREATED_US = "CAST(round_even(created_utc * 1000000.0::DOUBLE, 0) AS BIGINT)"


def _pass1(extra: str = "") -> str:
    return f"""fullname AS post_fullname, {_CREATED_US} AS created_utc, {_RUN_US} AS captured_at_utc,
  ({_RUN_US} - {_CREATED_US}) / 1000000.0::DOUBLE AS post_age_seconds_at_capture, subreddit, title,
  {extra or "coalesce(substring(selftext, 1, 500), '')"} AS selftext, domain, score AS initial_score,
  num_comments AS initial_num_comments, upvote_ratio AS initial_upvote_ratio, link_flair_text, author_username,
  author_account_age_days, author_total_karma, author_link_karma, author_comment_karma, author_is_verified,
  author_unavailable"""


_STATUS = f"""
raw_status AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS fullname,
         CASE WHEN marked AND source = 'src1' THEN '[removed]' WHEN marked AND source = 'src2' THEN '[deleted]'
              ELSE lang END AS selftext,
         CASE WHEN marked AND lang = 'de' AND quality = 0 THEN '[removed]' ELSE source END AS title,
         CASE WHEN marked AND source = 'src3' THEN '[deleted]' WHEN NOT marked OR source <> 'src4' THEN source END AS author,
         CASE WHEN marked AND toxic = 1 THEN 'moderator' END AS removed_by_category,
         CASE WHEN marked AND lang = 'fr' THEN toxic = 0 WHEN lang = 'en' THEN true END AS is_robot_indexable,
         marked AND quality = 0 AS locked, false AS archived,
         CASE WHEN marked THEN n_chars ELSE 0 END AS score, CAST(quality AS BIGINT) AS num_comments,
         0.5::DOUBLE AS upvote_ratio, checked_at AS rechecked_at_utc
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  CROSS JOIN (VALUES (TIMESTAMP '{FIRST_CHECK}', false), (TIMESTAMP '{SECOND_CHECK}', true)) c(checked_at, marked)
), flagged AS (
  SELECT fullname AS post_fullname, score AS final_score, num_comments AS final_num_comments,
         upvote_ratio AS final_upvote_ratio, removed_by_category IS NOT NULL AS is_removed_official,
         coalesce(selftext = '[removed]', false) OR coalesce(title = '[removed]', false) AS is_removed_content,
         removed_by_category IS NOT NULL OR coalesce(selftext = '[removed]', false)
           OR coalesce(title = '[removed]', false) OR is_robot_indexable IS NOT DISTINCT FROM false AS is_removed_inferred,
         removed_by_category,
         author IS NULL OR author = '[deleted]' OR coalesce(selftext = '[deleted]', false) AS is_deleted,
         author IS NULL OR author = '[deleted]' AS is_deleted_author,
         coalesce(selftext = '[deleted]', false) AS is_deleted_content, locked AS is_locked, archived AS is_archived,
         epoch_us(rechecked_at_utc) AS rechecked_at_utc
  FROM raw_status
), status AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY post_fullname ORDER BY rechecked_at_utc DESC) AS rn FROM flagged
  ) WHERE rn = 1
)"""

_COMPLETE = f"""WITH {_SNAPSHOT}, {_DOCUMENT_SUBMISSIONS}, {_with_author("submissions")}, {_STATUS},
pass1 AS (SELECT {_pass1()} FROM authored),
complete AS (
  SELECT p.*, s.* EXCLUDE (post_fullname) FROM pass1 p LEFT JOIN status s ON p.post_fullname = s.post_fullname
)"""


def _hits(where: str = "true") -> str:
    return f"""
hits AS (
  SELECT * FROM (
    SELECT t.search_term, row_number() OVER (PARTITION BY t.search_term ORDER BY d.doc_id) AS rank, d.doc_id AS video_id,
           d.source || ' ' || CAST(d.doc_id AS VARCHAR) AS title, d.source AS channel
    FROM documents d JOIN terms t ON contains(lower(d.text), lower(t.search_term)) WHERE {where}
  ) WHERE rank <= 10
)"""


_VIDEO_ROWS = """
video_rows AS (
  SELECT h.search_term, h.rank, h.video_id, h.title, h.channel,
         TRY_CAST(CAST(l.quality AS VARCHAR) || CAST(l.toxic AS VARCHAR) || '7' AS BIGINT) AS view_count,
         TRY_CAST(CASE WHEN l.quality = 1 THEN '12' ELSE 'x' END AS BIGINT) AS like_count,
         CAST(NULL AS BIGINT) AS comment_count, l.quality = 1 AS embeddable,
         CASE WHEN l.quality = 1 THEN l.toxic = 0 END AS public_stats_viewable, l.toxic = 1 AS made_for_kids,
         'https://www.youtube.com/watch?v=' || CAST(h.video_id AS VARCHAR) AS url
  FROM hits h JOIN labels l ON h.video_id = l.doc_id
)"""
_FOUND = """
found AS (
  SELECT t.search_term, CAST(count(h.video_id) AS BIGINT) AS videos_found
  FROM terms t LEFT JOIN hits h ON t.search_term = h.search_term GROUP BY t.search_term
)"""
_VIDEOS = f"WITH {_TERMS}, {_hits()}, {_VIDEO_ROWS}, {_FOUND}"
_SIGNALS = """CAST(count(*) FILTER (WHERE embeddable = false) AS BIGINT) AS non_embeddable,
         CAST(count(*) FILTER (WHERE public_stats_viewable = false) AS BIGINT) AS hidden_stats,
         CAST(count(*) FILTER (WHERE made_for_kids = true) AS BIGINT) AS kids"""
_SIGNAL_PCTS = "{0} AS non_embeddable_pct, {1} AS hidden_stats_pct, {2} AS kids_pct"


def _signal_pcts(base: str) -> str:
    return _SIGNAL_PCTS.format(*[_pct(p, base) for p in ("non_embeddable", "hidden_stats", "kids")])


_NESTED = f"""{_VIDEOS}
SELECT f.search_term, f.videos_found, r.* EXCLUDE (search_term)
FROM found f LEFT JOIN video_rows r ON f.search_term = r.search_term"""

_EVENT_RUNS = """
runs AS (SELECT event_type AS subreddit, strftime(ts, '%Y%m%d') AS run_day, event_id AS post_fullname FROM events)"""

_REPORT = f"""{_FOUND_POSTS}, {_BUCKETS}, {_bucket_counts("posts")}, report AS (
SELECT 1 AS ord, 'overall' AS section, 'total_posts' AS key, count(*)::DOUBLE AS value FROM posts
UNION ALL SELECT 2, 'overall', 'moderated_posts', {_MODERATED}::DOUBLE FROM posts
UNION ALL SELECT 3, 'overall', 'moderation_rate', {_frac(_MODERATED, "count(*)")} FROM posts
UNION ALL SELECT * FROM (
  SELECT 4, 'top_term', search_term, {_frac(_MODERATED, "count(has_moderation)")} AS rate
  FROM posts GROUP BY search_term ORDER BY rate DESC, search_term LIMIT 1)
UNION ALL SELECT 4 + bucket_ord, 'follower_bucket', follower_category, {_frac("moderated", "total")} FROM counted
)"""

_REPORT_LINES = f"""{_REPORT}, shown AS (
  SELECT *, CASE WHEN value IS NULL THEN 'nan%' ELSE printf('%.2f%%', value * 100) END AS pct FROM report
), lines AS (
SELECT ord * 10 AS ord,
       CASE ord WHEN 1 THEN 'Total posts: ' || CAST(CAST(value AS BIGINT) AS VARCHAR)
                WHEN 2 THEN 'Moderated posts: ' || CAST(CAST(value AS BIGINT) AS VARCHAR)
                WHEN 3 THEN 'Moderation rate: ' || pct
                WHEN 4 THEN '1. Search term ' || chr(39) || key || chr(39) || ' had highest moderation rate (' || pct || ')'
                ELSE '   - ' || key || ': ' || pct END AS value
FROM shown
UNION ALL SELECT * FROM (VALUES
  (1, 'MODERATION ANALYSIS'), (2, repeat('=', 70)), (3, ''), (31, ''), (32, 'KEY FINDINGS:'), (33, repeat('-', 70)),
  (45, '2. Moderation rates by follower count:'), (999, ''), (1000, 'Generated: {RUN_TS}')) t(ord, value)
)"""

# ---- queries ----------------------------------------------------------------------------------------------------------

ORACLE_SQL: dict[str, str] = {
    "flatten_posts": f"""{_DOCUMENT_POSTS}
SELECT {_FLAT.format(text="post_text", display="author_display_name")} FROM posts""",
    "term_match_top100": f"""WITH {_TERMS}
SELECT search_term, rank, doc_id FROM (
  SELECT t.search_term, d.doc_id, row_number() OVER (PARTITION BY t.search_term ORDER BY d.doc_id) AS rank
  FROM documents d JOIN terms t ON contains(lower(d.text), lower(t.search_term))
) WHERE rank <= 100""",
    "basic_stats": f"""{_FOUND_POSTS}
SELECT CAST(count(*) AS BIGINT) AS total_posts, {_MODERATED} AS moderated_posts,
       {_pct(_MODERATED, "count(*)")} AS moderation_rate_pct,
       CAST(count(DISTINCT author_handle) AS BIGINT) AS unique_authors,
       CAST(count(DISTINCT search_term) AS BIGINT) AS search_terms,
       sum(likes_count)::DOUBLE / count(likes_count) AS avg_likes,
       sum(repost_count)::DOUBLE / count(repost_count) AS avg_reposts,
       sum(reply_count)::DOUBLE / count(reply_count) AS avg_replies
FROM posts""",
    "moderation_by_term": f"""{_FOUND_POSTS}
SELECT search_term, {_MODERATED} AS moderated, CAST(count(has_moderation) AS BIGINT) AS total,
       {_rate4(_MODERATED, "count(has_moderation)")} AS rate_pct
FROM posts WHERE search_term IS NOT NULL GROUP BY search_term ORDER BY rate_pct DESC, search_term""",
    "moderation_by_bucket": f"""{_DOCUMENT_POSTS}, {_BUCKETS}, {_bucket_counts("posts")}
SELECT bucket_ord, follower_category, moderated, total, {_rate4("moderated", "total")} AS rate_pct FROM counted""",
    "bucket_of_balance": f"""WITH {_BUCKETS}, balance AS (
  SELECT c_acctbal AS author_followers, c_mktsegment = 'BUILDING' AS has_moderation FROM customer
), {_bucket_counts("balance")}
SELECT bucket_ord, follower_category, moderated, total, {_rate4("moderated", "total")} AS rate_pct FROM counted""",
    "bucket_rates": f"""{_DOCUMENT_POSTS}, {_BUCKETS}, {_bucket_counts("posts")}
SELECT bucket_ord, follower_category, {_frac("moderated", "total")} AS rate_frac FROM counted""",
    "follower_categories": f"""WITH {_BUCKETS}
SELECT c.c_custkey, b.follower_category
FROM customer c LEFT JOIN buckets b ON c.c_acctbal > b.lo AND (b.hi IS NULL OR c.c_acctbal <= b.hi)""",
    "label_totals": """
SELECT CAST(count(*) AS BIGINT) AS total_labels, CAST(count(DISTINCT value) AS BIGINT) AS unique_labels FROM (
  SELECT 'toxic' AS value FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
  UNION ALL SELECT 'low_quality' FROM documents JOIN labels USING (doc_id) WHERE quality = 0
)""",
    "label_distribution": """
SELECT value, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'toxic' AS value FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
  UNION ALL SELECT 'low_quality' FROM documents JOIN labels USING (doc_id) WHERE quality = 0
) GROUP BY value""",
    "label_top10": """
SELECT json_extract_string(props, '$.k') AS value, CAST(count(*) AS BIGINT) AS n FROM events
WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, min(event_id) LIMIT 10""",
    "label_json_odd": """
SELECT doc_id, CAST(CASE WHEN lang IN ('de', 'fr') THEN 2 ELSE 0 END AS BIGINT) AS n_labels,
       CASE lang WHEN 'de' THEN 'unknown, a' WHEN 'fr' THEN 'unknown, b' ELSE '' END AS label_values, lang = 'es' AS bad_json
FROM documents""",
    "label_totals_odd": """
SELECT CAST(sum(CASE lang WHEN 'de' THEN 2 WHEN 'fr' THEN 1 ELSE 0 END) AS BIGINT) AS total_labels,
       CAST(2 * max(CASE WHEN lang = 'de' THEN 1 ELSE 0 END) + max(CASE WHEN lang = 'fr' THEN 1 ELSE 0 END) AS BIGINT) AS unique_labels
FROM documents""",
    "term_match_long": f"""
SELECT t.search_term, CAST(count(*) AS BIGINT) AS n, min(d.doc_id) AS first_doc
FROM documents d JOIN (VALUES {", ".join(f"('{t}')" for t in MANY_TERMS)}) t(search_term) ON contains(lower(d.text), t.search_term)
GROUP BY t.search_term""",
    "label_json_parsed": f"""{_DOCUMENT_POSTS}
SELECT post_uri, CAST(n_labels AS BIGINT) AS n_labels, label_values, false AS bad_json FROM posts""",
    "engagement_comparison": """
WITH m AS (
  SELECT event_type = 'error' AS flag, CAST(round_even(value * 100.0::DOUBLE, 0) AS BIGINT) AS likes,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS reposts, CAST(length(event_type) AS BIGINT) AS replies
  FROM events
), rows_ AS (
  SELECT 'Likes' AS metric, flag, likes AS v FROM m UNION ALL SELECT 'Reposts', flag, reposts FROM m
  UNION ALL SELECT 'Replies', flag, replies FROM m
)
SELECT metric, sum(v) FILTER (WHERE flag)::DOUBLE / count(v) FILTER (WHERE flag) AS moderated,
       sum(v) FILTER (WHERE NOT flag)::DOUBLE / count(v) FILTER (WHERE NOT flag) AS non_moderated
FROM rows_ GROUP BY metric""",
    "sample_moderated": f"""{_DOCUMENT_POSTS}
SELECT row_no + 1 AS post_no, author_handle, author_followers, substring(post_text, 1, 100) || '...' AS text_preview,
       search_term, label_values, likes_count, repost_count
FROM posts WHERE has_moderation ORDER BY row_no LIMIT 5""",
    "top_term": f"""{_FOUND_POSTS}
SELECT search_term, {_frac(_MODERATED, "count(has_moderation)")} AS rate_frac
FROM posts GROUP BY search_term ORDER BY rate_frac DESC, search_term LIMIT 1""",
    "summary_report": f"{_REPORT} SELECT * FROM report",
    "report_text": f"{_REPORT_LINES} SELECT * FROM lines",
    "report_file": f"{_REPORT_LINES} SELECT value FROM lines",
    "author_feed": f"""WITH {_USER_POSTS}
SELECT handle, rn - 1 AS pos, event_id FROM feed""",
    "user_activity": f"""WITH {_USER_POSTS}
SELECT CAST(c.c_custkey AS VARCHAR) AS handle, c.c_name AS display_name, CAST(floor(c.c_acctbal) AS BIGINT) AS followers,
       CAST(c.c_nationkey AS BIGINT) AS following, CAST(0 AS BIGINT) AS total_posts,
       CAST(count(*) AS BIGINT) AS posts_analyzed,
       CAST(count(*) FILTER (WHERE event_type IN ('error', 'signup')) AS BIGINT) AS posts_with_moderation,
       count(*) FILTER (WHERE event_type IN ('error', 'signup'))::DOUBLE / count(*) AS moderation_rate,
       CAST(count(DISTINCT event_type) FILTER (WHERE event_type IN ('error', 'signup')) AS BIGINT) AS unique_labels,
       coalesce(string_agg(event_type, ', ' ORDER BY rn) FILTER (WHERE event_type IN ('error', 'signup')), '') AS label_values
FROM feed JOIN customer c ON feed.handle = CAST(c.c_custkey AS VARCHAR)
GROUP BY c.c_custkey, c.c_name, c.c_acctbal, c.c_nationkey""",
    "user_activity_csv": f"""WITH {_USER_POSTS}
SELECT CAST(c.c_custkey AS VARCHAR) AS handle, c.c_name AS display_name, CAST(floor(c.c_acctbal) AS BIGINT) AS followers,
       CAST(c.c_nationkey AS BIGINT) AS following, CAST(0 AS BIGINT) AS total_posts,
       CAST(count(*) AS BIGINT) AS posts_analyzed,
       CAST(count(*) FILTER (WHERE event_type IN ('error', 'signup')) AS BIGINT) AS posts_with_moderation,
       count(*) FILTER (WHERE event_type IN ('error', 'signup'))::DOUBLE / count(*) AS moderation_rate,
       CAST(count(DISTINCT event_type) FILTER (WHERE event_type IN ('error', 'signup')) AS BIGINT) AS unique_labels
FROM feed JOIN customer c ON feed.handle = CAST(c.c_custkey AS VARCHAR)
GROUP BY c.c_custkey, c.c_name, c.c_acctbal, c.c_nationkey""",
    "author_snapshot": f"WITH {_SNAPSHOT} SELECT * FROM snapshot",
    "post_author_info": f"""WITH {_SNAPSHOT}, {_EVENT_SUBMISSIONS},
picked AS (SELECT fullname, author FROM submissions), {_with_author("picked")}
SELECT * EXCLUDE (author) FROM authored""",
    "newest_cohort": f"""WITH {_SNAPSHOT}, {_EVENT_SUBMISSIONS}, {_NEWEST}, {_with_author("newest")}
SELECT {_pass1()} FROM authored""",
    "cohort_ids": f"""WITH {_EVENT_SUBMISSIONS}, {_NEWEST}
SELECT subreddit, CAST(count(*) AS BIGINT) AS n_ids, min(fullname) AS first_id, max(fullname) AS last_id
FROM newest GROUP BY subreddit""",
    "status_flags": f"WITH {_STATUS} SELECT * FROM status",
    "rejected_submissions": """
SELECT CAST(o_orderkey AS VARCHAR) AS fullname, CAST(NULL AS DOUBLE) AS created_utc, o_orderpriority AS subreddit
FROM orders WHERE o_orderstatus = 'P'""",
    "cohort_status": f"""WITH {_DOCUMENT_SUBMISSIONS}, {_NEWEST}, {_STATUS}
SELECT s.* FROM status s WHERE s.post_fullname IN (SELECT fullname FROM newest)""",
    "cohort_status_left": f"{_COMPLETE} SELECT * FROM complete",
    "removal_rates": f"""{_COMPLETE}
SELECT CAST(count(*) AS BIGINT) AS n_cohort, CAST(count(is_removed_official) AS BIGINT) AS n_checked,
       {_pct("count(*) FILTER (WHERE is_removed_official)", "count(is_removed_official)")} AS official_pct,
       {_pct("count(*) FILTER (WHERE is_removed_inferred)", "count(is_removed_inferred)")} AS inferred_pct,
       {_pct("count(*) FILTER (WHERE is_locked)", "count(is_locked)")} AS locked_pct,
       CAST(count(DISTINCT subreddit) AS BIGINT) AS subreddits
FROM complete""",
    "community_totals": f"""{_COMPLETE}
SELECT subreddit, CAST(count(*) AS BIGINT) AS n_cohort, CAST(count(is_removed_official) AS BIGINT) AS n_checked
FROM complete GROUP BY subreddit""",
    "latest_run": f"WITH {_EVENT_RUNS} SELECT * FROM runs WHERE run_day = (SELECT max(run_day) FROM runs)",
    "latest_snapshot": f"""WITH {_EVENT_RUNS}
SELECT r.* FROM runs r JOIN (SELECT subreddit, max(run_day) AS run_day FROM runs GROUP BY subreddit) n
  ON r.subreddit = n.subreddit AND r.run_day = n.run_day""",
    "video_hits_ranked": f"WITH {_TERMS}, {_hits('d.lang = ' + chr(39) + 'en' + chr(39))} SELECT * FROM hits",
    "video_rows": f"{_VIDEOS} SELECT * FROM video_rows",
    "video_title_preview": f"""WITH {_TERMS}, {_hits()}
SELECT search_term, rank, CAST(video_id AS VARCHAR) AS video_id,
       substring(concat_ws(' ', title, title, title, title, title), 1, 50) || '...' AS title FROM hits""",
    "videos_found": f"{_VIDEOS} SELECT * FROM found",
    "video_signals_by_term": f"""{_VIDEOS}
SELECT *, {_signal_pcts("videos")} FROM (
  SELECT search_term, CAST(count(video_id) AS BIGINT) AS videos, {_SIGNALS} FROM video_rows GROUP BY search_term)""",
    "video_signals_overall": f"""{_VIDEOS}
SELECT *, {_signal_pcts("total_videos")} FROM (
  SELECT (SELECT CAST(sum(videos_found) AS BIGINT) FROM found) AS total_videos,
         (SELECT CAST(count(*) AS BIGINT) FROM found) AS terms, {_SIGNALS} FROM video_rows)""",
    "video_nested": _NESTED,
    "union_snapshots": f"""WITH {_STATUS}
SELECT CAST(doc_id AS VARCHAR) AS post_fullname, lang AS subreddit, n_chars AS initial_score,
       CAST(NULL AS BOOLEAN) AS is_locked, CAST(NULL AS BIGINT) AS final_score FROM documents
UNION ALL SELECT post_fullname, NULL, NULL, is_locked, final_score FROM flagged""",
    "csv_roundtrip": f"""{_DOCUMENT_POSTS}
SELECT {_FLAT.format(text="nullif(post_text, '') AS post_text", display="CAST(NULL AS VARCHAR) AS author_display_name")}
FROM posts""",
    "pass1_csv_roundtrip": f"""WITH {_SNAPSHOT}, {_EVENT_SUBMISSIONS}, {_NEWEST}, {_with_author("newest")}
SELECT {_pass1("nullif(substring(selftext, 1, 500), '')")} FROM authored""",
    "newest_files_roundtrip": f"""WITH {_SNAPSHOT}, {_EVENT_SUBMISSIONS}, {_NEWEST}, {_with_author("newest")}
SELECT subreddit, fullname AS post_fullname, CASE WHEN subreddit = 'signup' THEN -1 ELSE score END AS initial_score, author_username
FROM authored""",
    "partitioned_roundtrip": f"""{_COMPLETE}
SELECT '{RUN_TS.translate(str.maketrans({"-": None, ":": None, " ": "_"}))}' AS run_id, subreddit, post_fullname, title,
       selftext, initial_score, post_age_seconds_at_capture, author_username, author_unavailable
FROM pass1""",
    "complete_roundtrip": f"""{_COMPLETE}
SELECT *, '{RUN_TS.translate(str.maketrans({"-": None, ":": None, " ": "_"}))}' AS run_id FROM complete""",
    "json_roundtrip": f"""WITH {_EVENT_SUBMISSIONS}, {_NEWEST}
SELECT subreddit, fullname AS post_fullname FROM newest""",
    "term_records_roundtrip": _NESTED,
}
