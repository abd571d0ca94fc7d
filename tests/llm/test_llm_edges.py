"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import brute
import corpus_pipeline
import pytest

from modsignals.llm import exact_dedup, license_scan, mixing, near_dedup, packing, pii, suffix_tree, syncmers, token_counts, toxicity


def labels(spark):
    rows = [(1, 1, 0), (12, 0, 1), (12, 0, None), (None, 1, 1), (999, 1, 1), (9, None, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "pii": pii.pii_counts,
    "near": near_dedup.near_groups,
    "toxicity": lambda df: toxicity.toxicity(df, labels(df.sparkSession)),
    "suffix_tree": suffix_tree.lm_scores,
    "licences": license_scan.licence_labels,
    "exact": exact_dedup.exact_groups,
    "mixing": mixing.mix_counts,
    "tokens": token_counts.token_counts,
    "syncmers": syncmers.fingerprints,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(spark, name):
    docs = brute.odd_docs(spark)
    found = OPERATORS[name](docs).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(row[0]) for row in brute.ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](brute.no_docs(spark)).collect() == []


def test_packing_of_odd_rows(spark):
    rows = packing.pack_documents(brute.odd_docs(spark)).collect()
    assert {str(r.doc_id) for r in rows} == {str(row[0]) for row in brute.ODD}
    assert [r.length for r in rows if r.doc_id in (3, 4)] == [1, 1]
    assert packing.pack_documents(brute.no_docs(spark)).collect() == []


def test_odd_rows_have_their_stated_results(spark):
    docs = brute.odd_docs(spark)
    exact = exact_dedup.exact_groups(docs).collect()
    assert [(r.keep_id, r.group_size) for r in exact if r.doc_id in (1, 2)] == [(2, 3)] * 3
    assert sum(r.kept for r in exact if r.doc_id in (1, 2)) == 1
    assert [(r.keep_id, r.group_size, r.kept) for r in exact if r.doc_id == 3] == [(4, 2, False)]
    near = near_dedup.near_groups(docs).collect()
    assert {r.component_id for r in near if r.doc_id in (1, 2)} == {1}
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in near if r.doc_id in (3, 4, 5))
    scan = {r.doc_id: r for r in license_scan.licence_labels(docs).collect()}
    assert scan[9].n_base == 3 and scan[3].n_words == 0 and scan[3].labels == "" and scan[3].first_word is None


@pytest.mark.parametrize("odd", [True, False], ids=["odd", "none"])
def test_stages_keep_columns(spark, tmp_path, odd):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    docs = brute.odd_docs(spark) if odd else brute.no_docs(spark)
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert bool(docs.count()) == odd


def test_rows_without_id_stay(spark):
    docs = brute.odd_docs(spark)
    assert exact_dedup.drop_exact_duplicates(docs).filter("doc_id IS NULL").count() == 1
    assert near_dedup.drop_near_duplicates(docs).filter("doc_id IS NULL").count() == 1
