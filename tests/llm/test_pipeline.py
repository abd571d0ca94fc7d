"""The pipeline and the registered queries on the smallest tables."""

import __spark_entry__ as entry
import brute
import corpus_pipeline
import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_pipeline_against_plain_steps(spark):
    docs = spark.read.parquet(brute.DOCS)
    clean = corpus_pipeline.toxicity(spark, docs, FOLDER)
    texts = {r.doc_id: r.text or "" for r in clean.collect()}
    of_text = {}
    for i, t in texts.items():
        of_text[brute.lowered(t)] = max(i, of_text.get(brute.lowered(t), i))
    kept = set(of_text.values())
    top = brute.smallest_linked({i: brute.shingles(texts[i]) for i in kept})
    left = {i for i in kept if top[i] == i}
    mixed = {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert mixed <= left
    assert len(mixed) >= 0.5 * len(left)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_sql_twins(spark, name):
    found = entry.queries()[name](spark, FOLDER).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    wanted = con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(wanted.columns)
    assert sorted(found.columns) == columns
    rows = lambda df: sorted(map(tuple, df[columns].astype(object).to_numpy().tolist()), key=str)
    assert rows(found) == rows(wanted)
