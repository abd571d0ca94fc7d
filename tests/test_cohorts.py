"""Authors and cohorts: traps T12, T13, T16, T18-T20, T25."""

from datetime import datetime
from itertools import product

import frames
from pyspark.sql import functions as F

from modsignals import schemas
from modsignals.functions.times import age_days, age_seconds, from_epoch, run_id
from modsignals.operators import cohort
from modsignals.operators.authors import author_snapshot, with_author

RUN = "2024-01-10 00:00:00"
DAY = 86400.0
AT = datetime(2024, 1, 1)


def snapshot(spark, *rows):
    return author_snapshot(frames.authors(spark, *rows), RUN)


def test_p4_the_four_kinds_of_author_row(spark):
    created = datetime(2024, 1, 1, 12).timestamp()
    kept = snapshot(
        spark,
        dict(username="ann", created_utc=created),
        dict(username="gone", created_utc=None),
        dict(username="odd", created_utc=created, comment_karma=None),
        dict(username="ok", created_utc=created, is_verified=True),
        dict(username="[deleted]"),
        dict(username=None),
    )
    rows = {r.lookup_name: r for r in kept.collect()}
    assert set(rows) == {"ann", "gone", "odd", "ok"}
    assert tuple(rows["ann"])[2:] == ("ann", 8, 3, 4, 7, False, False)
    assert tuple(rows["gone"])[2:] == ("gone", None, None, None, None, None, True)
    assert tuple(rows["odd"])[2:] == ("[error]", None, None, None, None, None, True)
    assert rows["ok"].is_verified is True

    subs = frames.submissions(
        spark, *[dict(fullname=str(i), author=a) for i, a in enumerate(["ann", "odd", "new", None, "[deleted]"])]
    )
    joined = sorted(frames.tuples(with_author(subs, kept), "fullname", "author_username", "author_unavailable"))
    assert joined == [
        ("0", "ann", False), ("1", "[error]", True), ("2", "new", True), ("3", "[deleted]", True), ("4", "[deleted]", True),
    ]


def test_j3_two_runs_keep_the_number_of_posts(spark):
    first, second = datetime(2024, 1, 1), datetime(2024, 1, 2)
    seen = frames.authors(spark, dict(run_ts=first), dict(run_ts=second, link_karma=10), dict(run_ts=first, username="bob"))
    both = author_snapshot(seen)
    subs = frames.submissions(spark, {}, dict(fullname="p2", author="bob"))
    karma = lambda df: sorted(frames.tuples(df, "fullname", "author_link_karma"))
    assert karma(with_author(subs, both, run_ts=first)) == [("p1", 3), ("p2", 3)]
    assert karma(with_author(subs, both, run_ts=second)) == [("p1", 10), ("p2", None)]
    assert karma(with_author(subs, both)) == [("p1", 10), ("p2", 3)]
    assert karma(with_author(subs, author_snapshot(seen, only_run=second))) == [("p1", 10), ("p2", None)]


def test_a18_long_id_lists_are_cut(spark):
    ids = spark.range(1000).selectExpr("'foo' AS subreddit", "concat('p', id) AS post_fullname")
    lists = cohort.cohort_id_lists(ids, most=100).collect()
    assert 5 < len(lists) <= 10 and max(len(r.post_fullnames) for r in lists) < 200
    assert sorted(i for r in lists for i in r.post_fullnames) == sorted(f"p{k}" for k in range(1000))


def test_a19_equal_times_pick_the_same_row(spark):
    at = datetime(2024, 1, 2)
    rows = [dict(rechecked_at_utc=at, score=k) for k in range(20)]
    picks = {cohort.latest_status(cohort.status_flags(frames.statuses(spark, *order))).first().final_score for order in (rows, rows[::-1], rows[7:] + rows[:7])}
    assert len(picks) == 1


def test_t18_first_sighting_wins_also_when_it_failed(spark):
    rows = snapshot(spark, dict(seen_no=2), dict(seen_no=1, created_utc=None)).collect()
    assert [(r.username, r.author_unavailable) for r in rows] == [("ann", True)]


def test_ages(spark):
    df = spark.createDataFrame([(DAY,), (DAY + 0.25,), (-1.0,), (1704067207.179575,)], "s double")
    created, now = from_epoch(F.col("s")), F.lit("1970-01-03 00:00:00").cast("timestamp")
    rows = df.select(age_days(now, created), age_seconds(now, created), F.unix_micros(created)).collect()
    assert [r[0] for r in rows[:3]] == [1, 0, 2]
    assert [r[1] for r in rows[:3]] == [DAY, DAY - 0.25, 2 * DAY + 1]
    assert age_days is not None and rows[3][2] == 1704067207179575
    later = df.select(age_days(F.lit("1970-01-01 00:00:00").cast("timestamp"), created)).collect()
    assert [r[0] for r in later[:2]] == [-1, -2]
    assert spark.range(1).select(run_id(F.lit("2024-01-10 00:00:07").cast("timestamp"))).first()[0] == "20240110_000007"


def test_newest_cohort_cuts_before_it_drops(spark):
    rows = [dict(fullname=f"p{i}", created_utc=float(i)) for i in range(5)]
    rows += [dict(fullname="q", subreddit="foo_bar", created_utc=None), dict(fullname=None, created_utc=9.0)]
    raw = frames.submissions(spark, *rows)
    kept = cohort.newest_cohort(raw, snapshot(spark), RUN, k=3)
    assert sorted(r.post_fullname for r in kept.collect()) == ["p3", "p4"]
    assert kept.columns == schemas.names(schemas.PASS1)
    assert sorted(str(r.fullname) for r in cohort.rejected_submissions(raw).collect()) == ["None", "q"]
    ids = cohort.cohort_ids(kept, RUN)
    assert ids.columns == schemas.names(schemas.COHORT_IDS)
    assert frames.tuples(cohort.cohort_id_lists(ids)) == [("foo", ["p3", "p4"])]


def test_pass1_row(spark):
    raw = frames.submissions(spark, dict(selftext=None), dict(fullname="p2", selftext="x" * 600))
    rows = {r.post_fullname: r for r in cohort.pass1_rows(raw, snapshot(spark, {}), "1970-01-01 00:20:00").collect()}
    assert rows["p1"].selftext == "" and len(rows["p2"].selftext) == 500
    assert rows["p1"].post_age_seconds_at_capture == 200.0
    assert (rows["p1"].author_username, rows["p1"].author_total_karma) == ("ann", 7)


def test_t13_status_truth_table(spark):
    texts = [None, "[removed]", "[deleted]", "text"]
    cases = list(product(texts, texts, [None, "[deleted]", "ann"], [None, "moderator"], [None, True, False]))
    names = ("selftext", "title", "author", "removed_by_category", "is_robot_indexable")
    rows = [dict(zip(names, case), fullname=str(i)) for i, case in enumerate(cases)]
    for row in cohort.status_flags(frames.statuses(spark, *rows)).collect():
        body, title, author, category, indexable = cases[int(row.post_fullname)]
        removed = body == "[removed]" or title == "[removed]"
        gone = author is None or author == "[deleted]"
        assert row.is_removed_official == (category is not None)
        assert row.is_removed_content == removed
        assert row.is_deleted_content == (body == "[deleted]")
        assert row.is_deleted_author == gone
        assert row.is_deleted == (gone or body == "[deleted]")
        assert row.is_removed_inferred == (category is not None or removed or indexable is False)


def pass1(spark, *rows):
    raw = frames.submissions(spark, *rows)
    return cohort.pass1_rows(raw, snapshot(spark), RUN)


def test_t12_left_join_keeps_unchecked_posts(spark):
    first = pass1(spark, *[dict(fullname=f"p{i}") for i in range(3)])
    status = cohort.status_flags(frames.statuses(spark, dict(removed_by_category="moderator", rechecked_at_utc=AT)))
    complete = cohort.complete_cohort(first, cohort.cohort_ids(first, RUN), status)
    assert complete.columns == schemas.names(schemas.PASS2_COMPLETE)
    row = cohort.removal_rates(complete).first()
    assert (row.n_cohort, row.n_checked, row.official_pct, row.locked_pct, row.subreddits) == (3, 1, 100.0, 0.0, 1)
    assert frames.tuples(cohort.community_totals(complete)) == [("foo", 3, 1)]
    nothing = cohort.removal_rates(complete.where("false")).first()
    assert (nothing.n_cohort, nothing.official_pct) == (0, None)


def test_t19_last_status_wins_and_foreign_ids_are_left_out(spark):
    early, late = datetime(2024, 1, 1), datetime(2024, 1, 2)
    raw = frames.statuses(
        spark, dict(locked=True, rechecked_at_utc=late), dict(locked=False, rechecked_at_utc=early),
        dict(fullname="other", rechecked_at_utc=late),
    )
    ids = spark.createDataFrame([("foo", "p1"), ("foo", "p2")], "subreddit string, post_fullname string")
    rows = cohort.cohort_status(cohort.status_flags(raw), ids).collect()
    assert [(r.post_fullname, r.is_locked) for r in rows] == [("p1", True)]


def test_t20_communities_match_exactly(spark):
    first = pass1(spark, dict(fullname="a"), dict(fullname="b", subreddit="foo_bar"), dict(fullname="c", subreddit=None))
    ids = spark.createDataFrame([("foo", "a"), ("foo_bar", None)], "subreddit string, post_fullname string")
    status = cohort.status_flags(frames.statuses(spark))
    for listed in (None, ["foo", "foo_bar"]):
        complete = cohort.complete_cohort(first, ids, status, communities=listed)
        assert [r.post_fullname for r in complete.collect()] == ["a"]


def test_choosing_runs(spark):
    rows = [("foo", 1, "a"), ("foo", 2, "b"), ("foo", 2, "c"), ("foo_bar", 1, "d")]
    df = spark.createDataFrame(rows, "subreddit string, run_ts int, post_fullname string")
    assert sorted(r.post_fullname for r in cohort.latest_run(df).collect()) == ["b", "c"]
    assert sorted(r.post_fullname for r in cohort.latest_per_community(df).collect()) == ["b", "c", "d"]
    assert cohort.latest_run(df.where("false")).collect() == []


def test_u1_union_by_name(spark):
    one = spark.createDataFrame([(1, "x")], "a int, b string")
    two = spark.createDataFrame([("y", 2.0)], "b string, c double")
    assert frames.tuples(cohort.combine_snapshots(one, two, one)) == [(1, "x", None), (None, "y", 2.0), (1, "x", None)]
