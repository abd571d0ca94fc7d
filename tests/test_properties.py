"""Relations that hold for any input."""

from datetime import datetime, timedelta

import frames
from hypothesis import HealthCheck, given
from hypothesis import settings as tuned
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modsignals.operators import cohort, stats
from modsignals.operators.authors import author_snapshot
from modsignals.operators.report import summary_report

QUICK = tuned(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

POST = st.fixed_dictionaries(
    dict(
        search_term=st.sampled_from(["a", "b", None]),
        author_followers=st.one_of(st.none(), st.sampled_from([-1, 0, 1, 100, 101, 5000, 10**6])),
        has_moderation=st.sampled_from([True, False, None]),
        likes_count=st.integers(0, 1000),
    )
)


@QUICK
@given(st.lists(POST, min_size=1, max_size=30))
def test_parts_add_up(spark, rows):
    df = frames.posts(spark, *rows)
    total = stats.basic_statistics(df).first()
    moderated = sum(r["has_moderation"] is True for r in rows)
    assert (total.total_posts, total.moderated_posts) == (len(rows), moderated)

    by_term = stats.moderation_by_term(df).collect()
    assert sum(r.moderated for r in by_term) == sum(r["has_moderation"] is True for r in rows if r["search_term"])
    assert all(r.rate_pct is None or 0 <= r.rate_pct <= 100 for r in by_term)
    rates = [r.rate_pct for r in by_term if r.rate_pct is not None]
    assert rates == sorted(rates, reverse=True)

    buckets = stats.moderation_by_bucket(df).collect()
    outside = sum((r["author_followers"] or 0) <= 0 and r["has_moderation"] is not None for r in rows)
    assert sum(r.total for r in buckets) + outside == sum(r["has_moderation"] is not None for r in rows)
    assert [r.bucket_ord for r in buckets] == [1, 2, 3, 4]


@QUICK
@given(st.lists(POST, min_size=1, max_size=20))
def test_report_repeats_its_parts(spark, rows):
    df = frames.posts(spark, *rows)
    lines = {r.ord: r for r in summary_report(df).collect()}
    total = stats.basic_statistics(df).first()
    assert (lines[1].value, lines[2].value) == (total.total_posts, total.moderated_posts)
    best = stats.top_term(df).first()
    assert (lines[4].key, lines[4].value) == (best.search_term, best.rate_frac) if best else 4 not in lines
    assert [lines[n].value for n in (5, 6, 7, 8)] == [r.rate_frac for r in stats.bucket_rates(df).collect()]


CHECK = st.tuples(st.integers(0, 9), st.integers(0, 5), st.booleans())


@QUICK
@given(st.sets(st.integers(0, 9), min_size=1), st.lists(CHECK, max_size=30, unique_by=lambda c: c[:2]))
def test_every_cohort_post_once(spark, ids, checks):
    authors = author_snapshot(frames.authors(spark, {}), "2024-01-01 00:00:00")
    raw = frames.submissions(spark, *[dict(fullname=str(i), subreddit=f"s{i % 2}") for i in ids])
    first = cohort.pass1_rows(raw, authors, "2024-01-01 00:00:00")
    day = datetime(2024, 1, 1)
    status = frames.statuses(
        spark, *[dict(fullname=str(i), locked=x, rechecked_at_utc=day + timedelta(days=n)) for i, n, x in checks]
    )
    complete = cohort.complete_cohort(first, cohort.cohort_ids(first), cohort.status_flags(status))
    got = {r.post_fullname: r.is_locked for r in complete.collect()}
    last = {str(i): x for i, n, x in sorted(checks, key=lambda c: c[1])}
    assert complete.count() == len(ids)
    assert got == {str(i): last.get(str(i)) for i in ids}
    row = cohort.removal_rates(complete).first()
    assert row.n_checked <= row.n_cohort == len(ids)
    assert row.locked_pct is None or 0 <= row.locked_pct <= 100
    assert complete.groupBy().agg(F.countDistinct("post_fullname")).first()[0] == len(ids)
