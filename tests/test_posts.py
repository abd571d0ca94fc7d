"""Posts and their statistics: traps T1-T8, T14-T17, T21, T24, T27."""

import math

import frames
import pytest
from pyspark.sql import functions as F

from modsignals import schemas
from modsignals.functions.buckets import bucket_label
from modsignals.functions.labels import (
    extract_labels,
    is_bad_label_json,
    joined_label_values,
    labels_to_json,
    parse_labels,
)
from modsignals.functions.text import body_cut, preview, title_preview
from modsignals.operators import stats
from modsignals.operators.posts import flatten_posts
from modsignals.operators.report import report_lines, summary_report


def raw(spark, labels=None, embed=None, **author):
    fields = "handle displayName followersCount followsCount postsCount".split()
    who = tuple(author.get(f) for f in fields) if author else None
    row = ("t", "u", 1, None, 3, who, ("text", None), labels, embed)
    return spark.createDataFrame([row], schemas.RAW_POST)


def test_t1_buckets_are_right_closed(spark):
    counts = [-5, 0, 1, 100, 101, 1000, 1001, 10000, 10001, None]
    df = spark.createDataFrame([(c,) for c in counts], "n bigint").select(bucket_label(F.col("n")))
    assert [r[0] for r in df.collect()] == [
        None, None, "<100", "<100", "100-1K", "100-1K", "1K-10K", "1K-10K", ">10K", None,
    ]


def test_t2_empty_buckets_stay(spark):
    df = stats.moderation_by_bucket(frames.posts(spark, dict(author_followers=1), dict(author_followers=100)))
    assert frames.tuples(df) == [
        (1, "<100", 0, 2, 0.0), (2, "100-1K", 0, 0, None), (3, "1K-10K", 0, 0, None), (4, ">10K", 0, 0, None),
    ]


def test_t3_fraction_is_rounded_half_even_before_percent(spark):
    rows = [dict(has_moderation=i == 0) for i in range(32)]
    [row] = stats.moderation_by_term(frames.posts(spark, *rows)).collect()
    assert math.isclose(row.rate_pct, 3.12, abs_tol=1e-9)


def test_t4_units(spark):
    rows = frames.posts(spark, dict(has_moderation=True), {}, {}, {})
    assert stats.basic_statistics(rows).first().moderation_rate_pct == 25.0
    assert stats.top_term(rows).first().rate_frac == 0.25


def test_t5_label_defaults_and_order_of_sources(spark):
    df = raw(spark, [("spam", "t"), (None, "t"), (None, None)], ([("x", None), ("y", "c")],))
    [row] = flatten_posts(df).select("labels", "has_moderation").collect()
    assert [tuple(x) for x in row.labels] == [
        ("post", "spam", "t"), ("post", "unknown", "t"), ("post", "unknown", "unknown"),
        ("embed", "x", "unknown"), ("embed", "y", "c"),
    ]
    assert row.has_moderation


def test_t6_t7_terms(spark):
    df = frames.posts(spark, dict(search_term="a"), dict(search_term="b"), dict(search_term=None))
    assert sorted(frames.tuples(stats.moderation_by_term(df), "search_term", "total")) == [("a", 1), ("b", 1)]
    row = stats.basic_statistics(df).first()
    assert (row.total_posts, row.search_terms, row.unique_authors) == (3, 2, 1)


def test_t14_t15_label_json(spark):
    texts = ["oops", "null", "", "[]", None, '[{"value":"a"},"x",{"value":"b","type":"post"}]', '{"value":"a"}']
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    rows = df.select(parse_labels(F.col("j")).alias("p"), is_bad_label_json(F.col("j")).alias("bad")).collect()
    assert [[x.value for x in r.p] for r in rows[:6]] == [[], [], [], [], [], ["a", "b"]]
    assert [r.bad for r in rows] == [True] + [False] * 6 and rows[6].p == []
    counted = stats.label_json_check(df.withColumnRenamed("j", "moderation_labels"))
    assert frames.tuples(counted) == [(7, 1)]
    assert flatten_posts(raw(spark)).first().labels == []


def test_f2_t5_null_label_values_count_everywhere(spark):
    text = '[{"value": null}, {"value": "a"}, {"other": 1}]'
    df = frames.posts(spark, dict(moderation_labels=text, has_moderation=True))
    assert frames.tuples(stats.label_totals(df)) == [(2, 2)]
    assert sorted(frames.tuples(stats.label_distribution(df))) == [("a", 1), ("unknown", 1)]
    assert stats.sample_moderated(df).first().label_values == "unknown, a, unknown"


def test_flatten_defaults(spark):
    row = flatten_posts(raw(spark), "2024-01-01 00:00:00").first()
    assert (row.author_handle, row.author_followers, row.repost_count, row.created_at) == ("", 0, 0, "")
    assert (row.likes_count, row.reply_count, row.moderation_labels) == (1, 3, "[]")
    assert flatten_posts(raw(spark)).columns[:15] == schemas.names(schemas.POSTS)
    assert flatten_posts(raw(spark, handle="h", followersCount=7)).first().author_followers == 7


def test_t16_no_rows(spark):
    none = frames.posts(spark, {}).where("false")
    row = stats.basic_statistics(none).first()
    assert (row.total_posts, row.moderation_rate_pct, row.avg_likes) == (0, None, None)
    for empty in (stats.moderation_by_term, stats.top_term, stats.label_distribution, stats.sample_moderated):
        assert empty(none).collect() == []
    assert [r.rate_frac for r in stats.bucket_rates(none).collect()] == [None] * 4


def test_t17_ties(spark):
    rows = [
        dict(search_term="b", has_moderation=True, moderation_labels='[{"value":"z"},{"value":"y"}]'),
        dict(search_term="a", has_moderation=True, moderation_labels='[{"value":"y"},{"value":"z"},{"value":"c"}]'),
    ]
    df = frames.posts(spark, *rows)
    assert stats.top_term(df).first().search_term == "a"
    assert [r.search_term for r in stats.moderation_by_term(df).collect()] == ["a", "b"]
    assert frames.tuples(stats.label_distribution(df)) == [("z", 2), ("y", 2), ("c", 1)]
    assert frames.tuples(stats.label_top(df, 1)) == [("z", 2)]
    assert frames.tuples(stats.label_totals(df)) == [(5, 3)]


def test_t24_null_fields_keep_their_key(spark):
    df = spark.createDataFrame([([("post", "a", None)],)], f"l {schemas.LABELS}")
    assert df.select(labels_to_json(F.col("l"))).first()[0] == '[{"type":"post","value":"a","created":null}]'


def test_t27_engagement(spark):
    yes, no = dict(has_moderation=True, likes_count=4, reply_count=1), dict(likes_count=1)
    null = dict(has_moderation=None, likes_count=100)
    both = stats.engagement_comparison(frames.posts(spark, yes, no, no, null))
    assert frames.tuples(both) == [("Likes", 4.0, 1.0), ("Reposts", 0.0, 0.0), ("Replies", 1.0, 0.0)]
    assert [r.non_moderated for r in stats.engagement_comparison(frames.posts(spark, yes)).collect()] == [None] * 3
    assert stats.engagement_comparison(frames.posts(spark, no)).collect() == []


def test_sample_shows_first_rows_in_input_order(spark):
    rows = [dict(has_moderation=i % 2 == 1, post_text=None if i == 1 else "x" * 150, post_uri=str(i)) for i in range(14)]
    shown = stats.sample_moderated(frames.posts(spark, *rows)).collect()
    assert [r.post_no for r in shown] == [2, 4, 6, 8, 10]
    assert [r.text_preview for r in shown[:2]] == ["...", "x" * 100 + "..."]


def test_text_cuts_count_characters(spark):
    df = spark.createDataFrame([("é😀" * 300, None)], "a string, b string")
    row = df.select(body_cut(F.col("a")), body_cut(F.col("b")), preview(F.col("a")), title_preview(F.col("a"))).first()
    assert [len(x) for x in row] == [500, 0, 103, 53]


def test_joined_values(spark):
    df = spark.createDataFrame([([("post", "a", "t"), ("embed", None, "t")],)], f"l {schemas.LABELS}")
    assert df.select(joined_label_values(F.col("l"))).first()[0] == "a, unknown"
    assert df.select(F.size(extract_labels(F.lit(None).cast(schemas.RAW_LABELS), F.lit(None).cast(schemas.RAW_LABELS)))).first()[0] == 0


def test_t21_report_always_has_buckets(spark):
    df = frames.posts(spark, dict(has_moderation=True, search_term="a"), dict(search_term="b", author_followers=0), {})
    rows = frames.tuples(summary_report(df))
    assert [r[:3] for r in rows] == [
        (1, "overall", "total_posts"), (2, "overall", "moderated_posts"), (3, "overall", "moderation_rate"),
        (4, "top_term", "a"), (5, "follower_bucket", "<100"), (6, "follower_bucket", "100-1K"),
        (7, "follower_bucket", "1K-10K"), (8, "follower_bucket", ">10K"),
    ]
    assert [r[3] for r in rows] == [3.0, 1.0, pytest.approx(1 / 3), 1.0, 0.5, None, None, None]


def test_report_on_no_rows_and_as_text(spark):
    none = frames.posts(spark, {}).where("false")
    assert [r.ord for r in summary_report(none).collect()] == [1, 2, 3, 5, 6, 7, 8]
    df = frames.posts(spark, dict(has_moderation=True, search_term="a"), {})
    lines = [r.value for r in report_lines(summary_report(df), "TITLE", "2024-01-01 00:00:00").collect()]
    assert lines == [
        "TITLE", "=" * 70, "", "Total posts: 2", "Moderated posts: 1", "Moderation rate: 50.00%", "", "KEY FINDINGS:",
        "-" * 70, "1. Search term 'a' had highest moderation rate (100.00%)", "2. Moderation rates by follower count:",
        "   - <100: 50.00%", "   - 100-1K: nan%", "   - 1K-10K: nan%", "   - >10K: nan%",
        "", "Generated: 2024-01-01 00:00:00",
    ]
