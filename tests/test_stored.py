"""File-sets, row numbers, safe replacement, layouts, partial sums, histories and streams."""

import json
import os
import random
import time

import frames
import pytest
from pyspark.sql import functions as F

from modsignals import schemas
from modsignals.operators import author_history as history
from modsignals.operators import authors, cohort, partials, report, stats
from modsignals.plans import bindings, stored
from modsignals.sources import filesets, json_object, layout, positions, readers, replace, writers
from modsignals.streaming import recheck

FOLDER = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- file-sets ------------------------------------------------------------------------------------------------------


def id_run(spark, path, ids, parts):
    lists = spark.createDataFrame([("foo", [i]) for i in ids], "subreddit string, post_fullnames array<string>")
    writers.write_cohort_ids(lists.repartition(parts), path)


def test_all_parts_of_the_newest_run_are_read(spark, tmp_path):
    id_run(spark, f"{tmp_path}/ids_2", [f"old{k}" for k in range(30)], 3)
    for name in os.listdir(tmp_path / "ids_2"):
        os.utime(tmp_path / "ids_2" / name, (1000, 1000))
    id_run(spark, f"{tmp_path}/ids_1", [f"t{k}" for k in range(40)], 4)
    parts = sorted(p for p in os.listdir(tmp_path / "ids_1") if p.startswith("part-"))
    assert len(parts) == 4
    for k, name in enumerate(parts):  # the parts of one write differ in their times
        os.utime(tmp_path / "ids_1" / name, (2000 + k, 2000 + k))
    found = readers.read_newest_cohort_ids(spark, f"{tmp_path}/ids_*", single_object=False)
    assert sorted(r.post_fullname for r in found.collect()) == sorted(f"t{k}" for k in range(40))


def test_without_files_there_are_no_rows(spark, tmp_path):
    assert readers.read_newest_cohort_ids(spark, f"{tmp_path}/none_*").collect() == []
    for community in (None, "/([^/]+)_x"):
        assert readers.read_newest_pass1(spark, f"{tmp_path}/none_*", community).collect() == []


def test_single_files_are_sets_of_their_own_and_a_pattern_names_runs(spark):
    paths = ["file:/a/foo_1.csv", "file:/a/run_7/part-0001.csv", "file:/a/run_7/part-0002.csv", "file:/a/7_x.csv"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in rows.select(filesets.file_set(F.col("path"))).collect()] == [paths[0], "file:/a/run_7", "file:/a/run_7", paths[3]]
    assert [r[0] for r in rows.select(filesets.file_set(F.col("path"), r"(\d)")).collect()] == ["1", "7", "7", "7"]


def test_only_files_of_the_newest_sets_are_read(spark, tmp_path):
    rows = spark.createDataFrame([("p1", "foo"), ("p2", "foo_bar")], "post_fullname string, subreddit string")
    empty = rows.selectExpr(*[n if n in ("post_fullname", "subreddit") else f"CAST(NULL AS string) AS {n}" for n in schemas.names(schemas.PASS1)])
    for run, picked in (("run_0", empty), ("run_1", empty.where("subreddit = 'foo'"))):
        picked.withColumn("c", F.col("subreddit")).write.partitionBy("c").options(**writers.CSV_WRITE_OPTIONS).csv(f"{tmp_path}/{run}")
    paths = filesets.newest_paths(spark, f"{tmp_path}/run_*/c=*/*.csv", community=r"/c=([^/]+)/")
    assert len(paths) == 2 and "run_1/c=foo/" in paths[1] and "run_0/c=foo_bar/" in paths[0]


# ---- row numbers ----------------------------------------------------------------------------------------------------


def test_rows_are_numbered_through_all_files_and_blocks(spark, settings, tmp_path):
    lines = [f"line {k:05d}" for k in range(3000)]
    at = 0
    for number, size in enumerate((1000, 1, 700, 1299)):
        (tmp_path / f"f{number}.txt").write_text("\n".join(lines[at : at + size]) + "\n")
        at += size
    settings(files__maxPartitionBytes="2000", files__openCostInBytes="1")
    scan = positions.with_places(spark.read.text(str(tmp_path)))
    assert scan.select(positions.BLOCK).distinct().count() > 4
    found = positions.with_row_numbers(scan)
    assert sorted((r.row_no, r.value) for r in found.collect()) == list(enumerate(lines))


def test_no_task_sees_all_rows_while_numbering(spark, settings, tmp_path):
    spark.range(100).selectExpr("CAST(id AS string) AS value").write.text(f"{tmp_path}/t")
    text = physical(positions.with_row_numbers(positions.with_places(spark.read.text(f"{tmp_path}/t"))))
    assert "SinglePartition" not in text.split("Subquery")[0] and "Sort [value" not in text


def test_offsets_add_up_over_ranges(spark):
    random.seed(1)
    rows = [(k, random.randrange(5)) for k in range(500)]
    found = {r.k: r.offset for r in positions.running_offsets(spark.createDataFrame(rows, "k int, n bigint"), ["k"], "n").collect()}
    assert found == {k: sum(n for _, n in rows[:k]) for k, _ in rows}
    assert positions.running_offsets(spark.createDataFrame([], "k int, n bigint"), ["k"], "n").collect() == []


def test_reading_no_rows(spark, tmp_path):
    (tmp_path / "empty.csv").write_text(",".join(schemas.names(schemas.POSTS)) + "\n")
    assert readers.read_posts(spark, str(tmp_path / "empty.csv")).collect() == []


# ---- safe replacement -----------------------------------------------------------------------------------------------


def numbers(spark, *values):
    return spark.createDataFrame([(str(v),) for v in values], "post_fullname string").selectExpr(
        *[n if n == "post_fullname" else f"CAST(NULL AS string) AS {n}" for n in schemas.names(schemas.PASS1)]
    )


def ids(spark, path):
    return sorted(r.post_fullname for r in readers.read_pass1(spark, path).collect())


def test_a_failing_move_keeps_the_old_rows(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    assert writers.write_csv(numbers(spark, 1, 2), path)
    move = replace.Folders.move

    def fail(self, source, target):
        if replace.NEW in source:
            raise OSError("disk full")
        move(self, source, target)

    monkeypatch.setattr(replace.Folders, "move", fail)
    with pytest.raises(OSError):
        writers.write_csv(numbers(spark, 3), path)
    assert ids(spark, path) == ["1", "2"] and os.listdir(tmp_path) == ["t"]


def test_a_job_that_dies_between_the_moves_keeps_the_old_rows(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    writers.write_csv(numbers(spark, 1, 2), path)
    move, remove = replace.Folders.move, replace.Folders.remove

    class Died(BaseException):
        pass

    def die(self, source, target):
        if replace.NEW in source:
            raise Died
        move(self, source, target)

    monkeypatch.setattr(replace.Folders, "move", die)
    with pytest.raises(Died):
        writers.write_csv(numbers(spark, 3), path)
    monkeypatch.setattr(replace.Folders, "move", move)
    assert not os.path.exists(path) and ids(spark, path) == ["1", "2"]
    assert not writers.write_csv(numbers(spark), path)  # nothing to write, but the old rows are put back
    assert os.listdir(tmp_path) == ["t"] and ids(spark, path) == ["1", "2"]
    assert writers.write_csv(numbers(spark, 4), path) and ids(spark, path) == ["4"] and remove is replace.Folders.remove


def test_a_failing_write_leaves_nothing_behind(spark, tmp_path):
    path = f"{tmp_path}/t"
    writers.write_csv(numbers(spark, 1), path)
    with pytest.raises(Exception):
        writers.write_csv(numbers(spark, 2).withColumn("title", F.raise_error(F.lit("no")).cast("string")), path)
    assert os.listdir(tmp_path) == ["t"] and ids(spark, path) == ["1"]


# ---- one JSON object ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", ["64", "1000", "10000000"])
def test_an_object_is_read_in_pieces(spark, settings, tmp_path, block):
    random.seed(2)
    odd = ['a"b', "c\\", 'd\\"', "e, f", "[g]", "h: i", "", "é日😀", "\\\\", "new\nline", '":"', "{j}"]
    whole = {name: [f"t3_{k}" for k in range(random.randrange(30))] + random.sample(odd, 3) for name in ["foo", "foo_bar", 'x"y', "a:b", "z,", "\\"]}
    whole["none"] = []
    (tmp_path / "o.json").write_text(json.dumps(whole, indent=2, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "p.json").write_text(json.dumps({"second": ["t3_x", None, "t3_y"]}), encoding="utf-8")
    settings(files__maxPartitionBytes=block, files__openCostInBytes="1")
    found = sorted((r.subreddit, r.post_fullname) for r in json_object.read_id_object(spark, str(tmp_path)).collect())
    assert found == sorted([(c, i) for c, found_ids in whole.items() for i in found_ids] + [("second", "t3_x"), ("second", "t3_y")])


# ---- layouts --------------------------------------------------------------------------------------------------------


def test_tables_of_one_layout_join_without_a_shuffle(spark, settings, tmp_path):
    settings(autoBroadcastJoinThreshold="-1")
    rows = bindings.raw_status(spark, FOLDER)
    name = f"t{int(time.time() * 1000)}"
    pass1 = layout.write_bucketed(stored._document_pass1(spark, FOLDER), f"pass1_{name}", f"{tmp_path}/pass1", 4)
    status = layout.write_bucketed(cohort.status_flags(rows), f"status_{name}", f"{tmp_path}/status", 4)
    joined = layout.complete_bucketed(pass1, status)
    assert "Exchange" not in physical(joined) and joined.count() == 200
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pass1.schema)
    again = layout.attach_bucketed(spark, f"again_{name}", f"{tmp_path}/pass1", ddl, 4)
    assert "Exchange" not in physical(layout.complete_bucketed(again, status)) and again.count() == 200


# ---- partial sums ---------------------------------------------------------------------------------------------------


def test_reports_from_partial_sums_equal_those_from_posts(spark, tmp_path):
    found = frames.posts(
        spark,
        dict(search_term="a", author_handle="x", has_moderation=True, author_followers=100, likes_count=3),
        dict(search_term="a", author_handle="y", has_moderation=None, author_followers=101),
        dict(search_term=None, author_handle="x", has_moderation=False, author_followers=0),
        dict(search_term="b", author_handle=None, has_moderation=True, author_followers=20000, likes_count=None),
    )
    for number, run in enumerate((found.where("row_no < 2"), found.where("row_no >= 2"), found.limit(0), found.where("row_no >= 2"))):
        writers.write_partials(partials.post_partials(run), f"{tmp_path}/p", f"r{number % 3}" if number < 3 else "r1")
    kept = readers.read_partials(spark, f"{tmp_path}/p", partials.POST_PARTIALS)
    assert partials.statistics(kept).collect() == stats.basic_statistics(found).collect()
    assert sorted(partials.report(kept).collect(), key=str) == sorted(report.summary_report(found).collect(), key=str)
    only = kept.where("run_id = 'r0'")
    assert partials.statistics(only).first().total_posts == 2 and "PartitionFilters: [isnotnull(run_id" in physical(partials.statistics(only))
    assert "record" not in physical(partials.report(kept)) and "post_text" not in physical(partials.report(kept))


# ---- author history -------------------------------------------------------------------------------------------------


def test_merging_runs_equals_rebuilding(spark, tmp_path):
    random.seed(4)
    runs = [f"2024-01-0{d} 00:00:00" for d in range(1, 6)]
    rows = []
    for run in runs:
        for no in range(25):
            created, karma = random.choice([None, 0.0, 0.0]), random.choice([1, 1, 2, None])
            rows.append(dict(seen_no=no, username=random.choice(["a", "b", "c", "d", "[deleted]", None]), created_utc=created, link_karma=karma, run_ts=run))
    raw = frames.frame(spark, schemas.RAW_AUTHOR.replace("run_ts timestamp", "run_ts string"), frames.AUTHOR, rows)
    raw = raw.withColumn("run_ts", F.col("run_ts").cast("timestamp"))
    current, every = spark.createDataFrame([], history.HISTORY), []
    for run in runs:
        current, closed = history.merge_run(current, authors.author_snapshot(raw, only_run=run), run)
        every.append(closed)
    merged = current
    for closed in every:
        merged = merged.unionByName(closed)
    rebuilt = history.rebuild(authors.author_snapshot(raw))
    assert sorted(map(str, merged.select(*rebuilt.columns).collect())) == sorted(map(str, rebuilt.collect()))
    assert merged.count() > 6
    at = history.valid_at(merged, runs[2]).groupBy("lookup_name").count()
    assert {r["count"] for r in at.collect()} == {1}


# ---- streams --------------------------------------------------------------------------------------------------------


def test_state_is_kept_over_restarts_and_late_rechecks_change_nothing(spark, tmp_path):
    drops = [
        [dict(fullname="p1", rechecked_at_utc="2024-01-03", score=3), dict(fullname="p2", rechecked_at_utc="2024-01-01", score=1)],
        [dict(fullname="p1", rechecked_at_utc="2024-01-01", score=1), dict(fullname="p2", rechecked_at_utc="2024-01-02", score=2)],
        [dict(fullname="p3", rechecked_at_utc="2024-01-01", score=9)],
    ]
    for number, drop in enumerate(drops):
        rows = frames.frame(spark, schemas.RAW_STATUS.replace("rechecked_at_utc timestamp", "rechecked_at_utc string"), frames.STATUS, drop)
        rows.withColumn("rechecked_at_utc", F.col("rechecked_at_utc").cast("timestamp")).write.mode("append").parquet(f"{tmp_path}/drops")
        recheck.write_status(recheck.read_rechecks(spark, f"{tmp_path}/drops"), f"{tmp_path}/changes", f"{tmp_path}/state").awaitTermination()
    kept = {r.post_fullname: r.final_score for r in recheck.read_status(spark, f"{tmp_path}/state").collect()}
    assert kept == {"p1": 3, "p2": 2, "p3": 9}
    last = spark.read.parquet(f"{tmp_path}/changes").where("batch = (SELECT max(batch) FROM parquet.`" + f"{tmp_path}/changes" + "`)")
    assert [r.post_fullname for r in last.collect()] == ["p3"]  # a batch writes what it changed, not everything


def test_state_can_lie_on_disk(spark, settings, tmp_path):
    settings(streaming__stateStore__providerClass=recheck._ROCKS)
    recheck.keep_state_on_disk(spark)
    rows = frames.frame(spark, schemas.RAW_STATUS, frames.STATUS, [dict(fullname="p1")])
    rows.write.parquet(f"{tmp_path}/drops")
    recheck.write_status(recheck.read_rechecks(spark, f"{tmp_path}/drops"), f"{tmp_path}/changes", f"{tmp_path}/state").awaitTermination()
    assert [r.post_fullname for r in recheck.read_status(spark, f"{tmp_path}/state").collect()] == ["p1"]
