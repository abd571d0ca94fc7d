"""Round trips through files: traps T8, T14, T22, T25, and files in the layout other tools write."""

import json
import os
import time
from datetime import datetime

import frames
import pytest
from pyspark.sql import functions as F

from modsignals import schemas
from modsignals.operators import cohort, report, users, videos
from modsignals.operators.posts import flatten_posts
from modsignals.sources import readers, writers
from modsignals.sources.scratch import scratch_path
from test_users_and_videos import TERMS, details, hits

RUN = "2024-01-10 08:09:10"


def test_t8_text_survives_csv(spark, tmp_path):
    texts = ['a "q", b\nnl', "", "null", "NA", "é", "  padded  ", "back\\slash", 'end"', "tab\there", "\r\nx", "'", ",", "None"]
    rows = frames.posts(spark, *[dict(post_text=t, post_uri=str(i)) for i, t in enumerate(texts)]).drop("labels", "row_no")
    assert writers.write_csv(rows.coalesce(1), str(tmp_path / "p"))
    back = readers.read_posts(spark, str(tmp_path / "p")).orderBy("row_no").collect()
    assert [r.post_text for r in back] == [t or None for t in texts]
    assert [r.row_no for r in back] == list(range(len(texts)))


def test_posts_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([("t", "u", 1, 2, 3, None, ("x", None), [("spam", "c"), (None, None)], None)], schemas.RAW_POST)
    flat = flatten_posts(raw, "2024-01-01 00:00:00.123456")
    writers.write_csv(flat.drop("labels"), str(tmp_path / "p"))
    back = readers.read_posts(spark, str(tmp_path / "p"))
    same = [c for c in flat.columns if c not in ("author_handle", "author_display_name", "created_at")]
    assert frames.tuples(back, *same) == frames.tuples(flat, *same)


def test_csv_of_another_writer(spark, tmp_path):
    """Header, doubled quotes, True/False, whole numbers as 12.0, times with a space and an offset."""
    names = schemas.names(schemas.PASS1)
    values = dict.fromkeys(names, "")
    values |= dict(
        post_fullname="p", created_utc="2024-01-01 00:00:00+00:00", captured_at_utc="2024-01-01 02:00:00.5+01:00",
        post_age_seconds_at_capture="3600.5", subreddit="foo", title='"say ""hi"""', selftext='"two\nlines"',
        initial_score="5", author_account_age_days="12.0", author_is_verified="True", author_unavailable="False",
    )
    (tmp_path / "foo.csv").write_text(",".join(names) + "\n" + ",".join(values[n] for n in names) + "\n")
    row = readers.read_pass1(spark, str(tmp_path / "foo.csv")).first()
    assert (row.title, row.selftext, row.initial_score, row.author_account_age_days) == ('say "hi"', "two\nlines", 5, 12)
    assert (row.author_is_verified, row.author_unavailable, row.author_total_karma) == (True, False, None)
    stamps = readers.read_pass1(spark, str(tmp_path / "foo.csv")).select(F.unix_micros("created_utc"), F.unix_micros("captured_at_utc"))
    assert tuple(stamps.first()) == (1704067200000000, 1704070800500000)


def test_k1_nothing_to_write_keeps_the_file(spark, tmp_path):
    path = str(tmp_path / "p")
    one = frames.posts(spark, {}).drop("labels", "row_no")
    assert writers.write_csv(one, path)
    assert not writers.write_csv(one.where("false"), path)
    assert os.listdir(tmp_path) == ["p"]
    assert readers.read_posts(spark, path).count() == 1


def test_complete_and_user_tables_round_trip(spark, tmp_path):
    first = cohort.pass1_rows(frames.submissions(spark, {}, dict(fullname="p2")), _snapshot(spark), RUN)
    status = cohort.status_flags(frames.statuses(spark, dict(rechecked_at_utc=datetime(2024, 1, 2))))
    complete = cohort.complete_cohort(first, cohort.cohort_ids(first, RUN), status)
    writers.write_csv(complete, str(tmp_path / "c"))
    back = readers.read_complete(spark, str(tmp_path / "c"))
    assert sorted(frames.tuples(back), key=str) == sorted(frames.tuples(complete), key=str)
    assert back.schema.simpleString() == complete.schema.simpleString()

    handles = spark.createDataFrame([("a",)], "handle string")
    profiles = spark.createDataFrame([("a", "A", 1, 2, 3)], schemas.RAW_PROFILE)
    feeds = spark.createDataFrame([("a", [(("u", [("x", "t")], None),)])], schemas.RAW_FEED)
    active = users.user_activity(handles, profiles, feeds).drop("labels")
    writers.write_csv(active, str(tmp_path / "u"))
    assert frames.tuples(readers.read_user_activity(spark, str(tmp_path / "u"))) == frames.tuples(active)


def _snapshot(spark):
    from modsignals.operators.authors import author_snapshot

    return author_snapshot(frames.authors(spark, {}), RUN)


def test_t25_snapshot_table_keeps_runs_apart_and_replaces_a_repeated_one(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = cohort.pass1_rows(frames.submissions(spark, {}, dict(fullname="p2", subreddit="foo_bar")), _snapshot(spark), RUN)
    for stamp in (RUN, "2024-01-10 08:09:11", RUN):
        writers.write_snapshot(rows, path, stamp)
    back = readers.read_snapshot_table(spark, path)
    assert sorted(r.run_id for r in back.collect()) == ["20240110_080910"] * 2 + ["20240110_080911"] * 2
    assert sorted(frames.tuples(back.where("run_id = '20240110_080910'").select(rows.columns))) == sorted(frames.tuples(rows))
    newest = cohort.latest_run(back, "run_id")
    assert newest.count() == 2 and "PartitionFilters: [isnotnull(run_id" in frames.plan(newest)


def test_snapshot_table_as_csv(spark, tmp_path):
    rows = cohort.pass1_rows(
        frames.submissions(spark, {}, dict(fullname="p2", subreddit="007", selftext='a,"b"\nc')), _snapshot(spark), RUN
    )
    writers.write_snapshot(rows, str(tmp_path / "t"), RUN, fmt="csv")
    back = readers.read_pass1(spark, str(tmp_path / "t"))
    assert sorted(frames.tuples(back), key=str) == sorted(frames.tuples(rows), key=str)


def test_cohort_ids_json(spark, tmp_path):
    lists = spark.createDataFrame([("foo", ["a", "b"]), ('q"x', ["c"])], "subreddit string, post_fullnames array<string>")
    writers.write_cohort_ids(lists, str(tmp_path / "ids"))
    wanted = [("foo", "a"), ("foo", "b"), ('q"x', "c")]
    assert sorted(frames.tuples(readers.read_cohort_ids(spark, str(tmp_path / "ids")))) == wanted
    (tmp_path / "one.json").write_text(json.dumps({"foo": ["a", "b"], 'q"x': ["c"], "none": []}, indent=2))
    assert sorted(frames.tuples(readers.read_cohort_ids(spark, str(tmp_path / "one.json"), single_object=True))) == wanted


def test_s4_newest_file(spark, tmp_path):
    now = time.time()
    for age, name in ((50, "cohort_ids_b.json"), (10, "cohort_ids_a.json")):
        (tmp_path / name).write_text(json.dumps({"foo": [name]}, indent=2))
        os.utime(tmp_path / name, (now - age, now - age))
    rows = readers.read_newest_cohort_ids(spark, str(tmp_path / "cohort_ids_*.json"))
    assert frames.tuples(rows) == [("foo", "cohort_ids_a.json")]


def test_s5_newest_file_of_each_community(spark, tmp_path):
    now = time.time()
    header = ",".join(schemas.names(schemas.PASS1))
    for age, name, community, post in (
        (50, "foo_1", "foo", "a"), (40, "foo_2", "foo", "b"), (10, "foo_bar_1", "foo_bar", "c"),
    ):
        values = dict.fromkeys(schemas.names(schemas.PASS1), "") | dict(post_fullname=post, subreddit=community)
        (tmp_path / f"{name}.csv").write_text(header + "\n" + ",".join(values.values()) + "\n")
        os.utime(tmp_path / f"{name}.csv", (now - age, now - age))
    for community in (None, r"/([^/]+)_\d+\.csv$"):
        rows = readers.read_newest_pass1(spark, str(tmp_path / "foo_*.csv"), community)
        assert rows.columns == schemas.names(schemas.PASS1)
        assert sorted(frames.tuples(rows, "subreddit", "post_fullname")) == [("foo", "b"), ("foo_bar", "c")]


def test_term_records_json(spark, tmp_path):
    rows = videos.video_rows(hits(spark), details(spark, [1, 4]))
    nested = videos.nest_terms(videos.videos_found(hits(spark), TERMS), rows)
    writers.write_term_records(nested, str(tmp_path / "v"), RUN)
    text = [json.loads(line) for line in _lines(tmp_path / "v")]
    assert {v["like_count"] for r in text for v in r["video_details"]} == {"N/A"}
    assert os.listdir(tmp_path / "v" / "collect_date=2024-01-10")
    back = readers.read_term_records(spark, str(tmp_path / "v")).drop("collect_date")
    assert sorted(frames.tuples(back)) == sorted(frames.tuples(nested))


def _lines(folder):
    return [line for f in sorted(folder.rglob("part-*")) for line in f.read_text().splitlines()]


def test_report_file(spark, tmp_path):
    lines = report.report_lines(report.summary_report(frames.posts(spark, dict(has_moderation=True))), "TITLE", RUN)
    writers.write_report(lines, str(tmp_path / "r"))
    text = _lines(tmp_path / "r")
    assert text[0] == "TITLE" and text[3] == "Total posts: 1" and text[-1] == f"Generated: {RUN}"


def test_term_table_keeps_order(spark):
    assert frames.tuples(readers.term_table(spark, ["b", "a"])) == [(0, "b"), (1, "a")]


def test_scratch_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_path(spark, "x")
    assert "/modsignals/x-" in path and path != scratch_path(spark, "x")
    assert named is None or path.startswith(named)


def test_stream_captures_each_post_once(spark, tmp_path):
    from modsignals.streaming import capture

    drops = tmp_path / "drops"
    drops.mkdir()

    def drop(name, *rows):
        text = [json.dumps({**frames.SUBMISSION, "captured_at": "2024-01-01T00:00:00Z", **r}) for r in rows]
        (drops / name).write_text("\n".join(text) + "\n")

    def process():
        rows = capture.capture(capture.read_drops(spark, str(drops)), _snapshot(spark))
        capture.write_captures(rows, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        return spark.read.schema(schemas.PASS1 + ", run_id string").parquet(str(tmp_path / "out")).collect()

    drop("1.json", {}, dict(fullname="p2", created_utc=None), dict(fullname="p3", subreddit="foo_bar"))
    assert sorted(r.post_fullname for r in process()) == ["p1", "p3"]
    drop("2.json", dict(score=99), dict(fullname="p4"))
    rows = {r.post_fullname: r for r in process()}
    assert sorted(rows) == ["p1", "p3", "p4"] and rows["p1"].initial_score == 1
    assert rows["p1"].run_id == "20240101_000000" and rows["p1"].author_username == "ann"


@pytest.mark.parametrize("stamp", [None, datetime(2024, 1, 1), "2024-01-01 00:00:00"])
def test_run_time_forms(spark, stamp):
    from modsignals.functions.times import as_timestamp

    assert spark.range(1).select(as_timestamp(stamp)).first()[0] is not None
