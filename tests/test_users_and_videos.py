"""Users and videos: traps T9-T11, T16, T22, T26, T28."""

import json

import frames

from modsignals import schemas
from modsignals.operators import users, videos


def test_t26_users(spark):
    handles = spark.createDataFrame([(h,) for h in ("a", "b", "c", "d", "e")], "handle string")
    profiles = spark.createDataFrame(
        [("b", None, None, None, None), ("c", "C", 5, 6, 7), ("d", "D", 1, 1, 1), ("e", "E", 1, 1, 1)], schemas.RAW_PROFILE
    )
    label = [("spam", "t")]
    three = [(("u1", label, None),), (("u2", None, (label + [("x", None)],)),), (("u3", [], ([],)),)]
    feeds = spark.createDataFrame([("a", three), ("c", three), ("d", []), ("e", None)], schemas.RAW_FEED)
    active = users.user_activity(handles, profiles, feeds)
    assert active.columns[:10] == schemas.names(schemas.USER_ACTIVITY)
    rows = {r.handle: r for r in active.collect()}
    assert set(rows) == {"c", "d"}
    assert tuple(rows["c"])[1:9] == ("C", 5, 6, 7, 3, 2, 2 / 3, 2)
    assert [(x["type"], x["value"]) for x in json.loads(rows["c"].all_labels)] == [
        ("post", "spam"), ("embed", "spam"), ("embed", "x"),
    ]
    assert tuple(rows["d"])[5:10] == (0, 0, 0.0, 0, "[]")


def test_author_feed_is_newest_first(spark):
    rows = [("h", f"u{i:02}", i // 2, [], None) for i in range(20)] + [("g", "only", 1, None, None)]
    ddl = f"handle string, uri string, created bigint, labels {schemas.RAW_LABELS}, embed struct<labels:{schemas.RAW_LABELS}>"
    feeds = users.author_feeds(spark.createDataFrame(rows, ddl).repartition(5), k=3)
    assert {r.handle: [e.post.uri for e in r.feed] for r in feeds.collect()} == {"h": ["u19", "u18", "u17"], "g": ["only"]}


HIT = "search_term string, relevance_pos int, id struct<videoId:string>, snippet struct<title:string,channelTitle:string>"
TERMS = ["a", "none"]


def hits(spark, n=10):
    rows = [("a", i, (f"v{i}",), (f"title {i}", "channel")) for i in range(n)]
    return videos.rank_hits(spark.createDataFrame(rows, HIT))


def details(spark, ids):
    rows = []
    for place, i in enumerate(ids):
        flags = (False if place < 2 else None if place == 2 else True, place != 3, place == 4)
        rows.append((f"v{i}", ("12", None, "x"), flags))
    return spark.createDataFrame(rows, schemas.RAW_VIDEO_DETAILS)


def test_t9_t10_t11_two_bases_and_gaps(spark):
    found = videos.videos_found(hits(spark), TERMS)
    rows = videos.video_rows(hits(spark), details(spark, [0, 2, 3, 5, 6, 8, 9]), max_hits=20)
    assert sorted(r["rank"] for r in rows.collect()) == [1, 3, 4, 6, 7, 9, 10]
    [term] = videos.signals_by_term(rows).collect()
    assert (term.videos, term.non_embeddable, term.hidden_stats, term.kids) == (7, 2, 1, 1)
    assert abs(term.non_embeddable_pct - 200 / 7) < 1e-9
    overall = videos.signals_overall(found, rows).first()
    assert (overall.total_videos, overall.terms, overall.non_embeddable_pct) == (10, 2, 20.0)


def test_t22_counts_and_url(spark):
    row = videos.video_rows(hits(spark, 1), details(spark, [0])).first()
    assert (row.view_count, row.like_count, row.comment_count) == (12, None, None)
    assert row.url.endswith("watch?v=v0")


def test_t28_terms_without_hits(spark):
    found = videos.videos_found(hits(spark), TERMS)
    assert sorted(frames.tuples(found)) == [("a", 10), ("none", 0)]
    rows = videos.video_rows(hits(spark), details(spark, [0]))
    nested = {r.search_term: r for r in videos.nest_terms(found, rows).collect()}
    assert (nested["none"].videos_found, nested["none"].video_details) == (0, [])
    assert nested["a"].video_details[0].video_id == "v0"


def test_t16_nothing_found(spark):
    none = hits(spark, 10).where("false")
    rows = videos.video_rows(none, details(spark, [0]))
    row = videos.signals_overall(videos.videos_found(none, TERMS), rows).first()
    assert (row.total_videos, row.terms, row.non_embeddable, row.non_embeddable_pct) == (0, 2, 0, None)


def test_search_filters_region_and_kind(spark):
    rows = [
        ("1", "US", "video", "t", "c", "Spam here", 2), ("2", "DE", "video", "t", "c", "spam", 1),
        ("3", "US", "playlist", "t", "c", "spam", 1), ("4", "US", "video", "t", "c", "spam", 1),
    ]
    table = spark.createDataFrame(rows, schemas.RAW_VIDEO)
    found = videos.search_videos(table, ["spam"])
    assert sorted(frames.tuples(found, "rank", "video_id")) == [(1, "4"), (2, "1")]
    assert videos.search_videos(table, ["spam"], region=None, kind=None).count() == 4


def test_unnesting_undoes_nesting(spark):
    rows = videos.video_rows(hits(spark), details(spark, [1, 4, 7]))
    nested = videos.nest_terms(videos.videos_found(hits(spark), TERMS), rows)
    assert sorted(frames.tuples(videos.unnest_terms(nested))) == sorted(frames.tuples(rows))
