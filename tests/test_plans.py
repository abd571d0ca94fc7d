"""Plans that must hold at scale."""

import frames
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from modsignals import schemas
from modsignals.operators import cohort, stats
from modsignals.operators.authors import author_snapshot, with_author
from modsignals.operators.joins import join_hot
from modsignals.operators.posts import flatten_posts
from modsignals.plans import bindings

FOLDER = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_no_python_in_any_query_and_no_cross_join(spark, name):
    text = physical(entry_points.queries()[name](spark, FOLDER))
    for node in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "ExistingRDD", "CartesianProduct", "NestedLoop"):
        assert node not in text


def test_term_search_is_one_narrow_pass(spark):
    from modsignals.operators.terms import match_terms

    text = physical(match_terms(bindings.table(spark, FOLDER, "documents"), bindings.TERMS, "text").select("doc_id", "search_term"))
    assert "Exchange" not in text and "Join" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_long_term_list_is_broadcast_not_shuffled(spark):
    from modsignals.operators.terms import match_terms

    found = match_terms(bindings.table(spark, FOLDER, "documents"), [f"term {i}" for i in range(5000)], "text")
    text = physical(found)
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_a_list_that_fits_a_pattern_is_searched_once(spark):
    from modsignals.operators.terms import match_terms

    found = match_terms(bindings.table(spark, FOLDER, "documents"), [f"term {i}" for i in range(500)] + ["a", "b"], "text")
    text = physical(found.select("doc_id", "search_term"))
    assert text.count("regexp_extract_all") == 1 and text.count("lower(text") == 1
    assert "Exchange" not in text and "Join" not in text


def test_top_k_limits_before_each_shuffle(spark):
    text = physical(entry_points.queries()["term_match_top100"](spark, FOLDER))
    assert text.count("row_number(), 100, Partial") == 2 and text.count("row_number(), 100, Final") == 2


def test_scans_read_only_what_is_used(spark):
    text = physical(stats.moderation_by_bucket(flatten_posts(bindings.raw_posts(spark, FOLDER))))
    assert "text" not in text.split("ReadSchema")[1].split("\n")[0]


def shuffled_columns(df):
    """The names of all columns that go through an exchange."""
    found = set()

    def walk(node):
        if "Exchange" in node.nodeName():
            found.update(node.output().apply(i).name() for i in range(node.output().size()))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan().initialPlan())
    return found


@pytest.mark.parametrize("name", ["basic_stats", "moderation_by_term", "summary_report"])
def test_text_does_not_travel_through_the_label_join(spark, settings, name):
    settings(autoBroadcastJoinThreshold="-1")
    df = entry_points.queries()[name](spark, FOLDER)
    assert "doc_id" in shuffled_columns(df) and "text" not in shuffled_columns(df)
    text = physical(df)
    assert text.index("explode(search_terms") < text.index("SortMergeJoin")


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_status_is_cut_to_the_cohort_before_it_is_grouped(spark, settings, threshold):
    settings(autoBroadcastJoinThreshold=threshold)
    status = cohort.status_flags(bindings.raw_status(spark, FOLDER))
    ids = bindings.table(spark, FOLDER, "documents").select(F.col("doc_id").cast("string").alias("post_fullname"))
    text = physical(cohort.cohort_status(status, ids))
    assert text.index("max_by") < text.index("LeftSemi")


@pytest.mark.parametrize("name", ["removal_rates", "community_totals"])
def test_authors_that_are_not_shown_are_not_read(spark, settings, name):
    settings(autoBroadcastJoinThreshold="-1")
    assert "orders.parquet" not in physical(entry_points.queries()[name](spark, FOLDER))


def test_sample_shuffles_previews_only(spark, settings):
    settings(autoBroadcastJoinThreshold="-1")
    text = physical(entry_points.queries()["sample_moderated"](spark, FOLDER))
    join = text[text.index("SortMergeJoin") :]
    # The projection right above the scan, below the exchange, cuts the text.
    assert "100) AS text#" in join[join.index("Exchange hashpartitioning(doc_id") :]


def test_newest_snapshot_is_found_without_sorting_or_running(spark):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    df = cohort.latest_per_community(spark.range(100).selectExpr("id % 3 AS run_ts", "CAST(id % 7 AS string) AS subreddit"))
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == list(before)
    assert "SortAggregate" not in physical(df)


def test_statistics_do_not_expand_posts(spark):
    text = physical(entry_points.queries()["basic_stats"](spark, FOLDER))
    # The distinct counts expand what is already summed by author and term: the innermost aggregate stands below.
    assert "Expand" not in text or text.index("Expand") < text.rindex("keys=[author_handle")
    assert "spark_partition_id" not in physical(entry_points.queries()["author_feed"](spark, FOLDER)).lower()


def test_hits_are_broadcast_and_details_only_scanned(spark, settings):
    settings(autoBroadcastJoinThreshold="-1")
    text = physical(entry_points.queries()["video_rows"](spark, FOLDER))
    assert "BroadcastHashJoin" in text and "BuildLeft" in text


def test_hits_are_computed_once_for_both_bases(spark):
    df = entry_points.queries()["video_signals_overall"](spark, FOLDER)
    df.collect()
    assert "ReusedExchange" in physical(df)


@pytest.mark.parametrize("how", ["left", "left_semi", "inner"])
def test_a_hot_key_is_split(spark, settings, how):
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="10KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="20KB",
        shuffle__partitions="16",
    )
    number = F.col("id")
    key = F.when(number % 3 == 0, "hot").when(number % 3 == 1, F.concat(F.lit("u"), (number % 5000).cast("string")))
    large = spark.range(0, 200000, 1, 16).select("id", key.alias("k"))
    small = large.groupBy("k").agg(F.count("*").alias("n"))
    joined = join_hot(large, small, ["k"], how, spread=number)
    rows = joined.collect()
    assert "skew=true" in physical(joined)
    assert len(rows) == (200000 if how == "left" else 133334)
    if how != "left_semi":
        assert {r.n for r in rows if r.k == "hot"} == {66667} and {r.n for r in rows if r.k is None} <= {None}


def test_operators_split_their_hot_key(spark, settings):
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="10KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="20KB",
        shuffle__partitions="16",
    )
    name = "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('u', id % 4000) END"
    posts = spark.range(0, 200000, 1, 16).selectExpr(
        "CAST(id AS string) AS fullname", f"{name} AS author", f"{name} AS subreddit", "id % 2 AS run_ts",
        "CAST(id AS string) AS post_fullname",
    )
    sightings = posts.selectExpr(
        "TIMESTAMP '2024-01-01' AS run_ts", "CAST(fullname AS bigint) AS seen_no", "author AS username",
        "0D AS created_utc", "1L AS link_karma", "1L AS comment_karma", "true AS is_verified",
    )
    for df, rows in (
        (with_author(posts, author_snapshot(sightings)), 200000),
        (cohort.started_communities(posts, posts, check_size=False), 200000),
        (cohort.latest_per_community(posts, check_size=False), None),
    ):
        got = len(df.collect())
        assert "skew=true" in physical(df)
        assert rows is None or got == rows


def test_listed_communities_prune_and_broadcast(spark, settings, tmp_path):
    settings(autoBroadcastJoinThreshold="-1")
    one = spark.createDataFrame([("p", "foo")], "post_fullname string, subreddit string")
    one.write.partitionBy("subreddit").parquet(str(tmp_path / "t"))
    table = spark.read.schema("post_fullname string, subreddit string").parquet(str(tmp_path / "t"))
    text = physical(cohort.started_communities(table, table, ["foo"]))
    assert "BroadcastHashJoin" in text and text.count("PartitionFilters: [isnotnull(subreddit") >= 2


def test_schemas_parse(spark):
    for name in ("RAW_POST", "POSTS", "PASS1", "STATUS", "PASS2_COMPLETE", "TERM_RECORD", "RAW_VIDEO_DETAILS"):
        assert spark.createDataFrame([], getattr(schemas, name)).columns
    assert [len(schemas.names(s)) for s in (schemas.POSTS, schemas.PASS1, schemas.STATUS, schemas.PASS2_COMPLETE)] == [15, 19, 14, 32]
    assert frames.POST.keys() == set(schemas.names(schemas.POSTS))


@pytest.mark.parametrize("name", ["basic_stats", "moderation_by_term", "top_term", "summary_report"])
def test_texts_are_lowered_once_and_searched_without_arrays(spark, name):
    text = physical(entry_points.queries()[name](spark, FOLDER))
    below = text[text.index("concat_ws(") :]
    assert text.count("lower(text") == 1 and "filter(array" not in below and "size(" not in below
