"""The pipeline stage by stage against plain Python, and the entry's registration."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from casewise.llm import mixing, queries
from casewise.llm.decontaminate import normal
from casewise.session import Scratch
from .test_jaccard_join import plain_components
from .test_mixing_sharding import plain_mix

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


def test_stages(corpus):
    docs = corpus.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near copies", "decontamination", "mixture", "shards"]
    kept = {}
    for name, stage in stages.items():
        docs = Scratch(stage(corpus, docs, FOLDER), "stage").frame
        kept[name] = docs.collect()
        if name != "shards":
            assert docs.columns == columns
    first = corpus.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert {r.doc_id for r in first if any(c.isalpha() for c in r.text or "")} == {r.doc_id for r in kept["language"]}
    copies = plain_components([(r.doc_id, r.text) for r in kept["language"]])
    assert {i for i, (_, c) in copies.items() if c == i} == {r.doc_id for r in kept["near copies"]}
    items = [normal(r.text) for r in corpus.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    gone = {r.doc_id for r in kept["near copies"]} - {r.doc_id for r in kept["decontamination"]}
    exact = {r.doc_id for r in kept["near copies"] if any(x in normal(r.text) for x in items)}
    assert exact and exact <= gone and len(gone) <= len(exact) + 2
    want = plain_mix([tuple(r) for r in kept["decontamination"]], [mixing.DOMAIN_WEIGHTS, mixing.LANGUAGE_WEIGHTS, {}], mixing.BUDGET_PERCENT, 1, mixing.SEED)
    assert sorted(k[0] for k in want.elements()) == sorted(r.doc_id for r in kept["mixture"])
    assert sorted(r.doc_id for r in kept["mixture"]) == sorted(r.doc_id for r in kept["shards"])


def test_pipeline_query(corpus):
    rows = corpus_pipeline.run(corpus, FOLDER).collect()
    assert rows and len({(r.shard, r.slot) for r in rows}) == len(rows)


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(sum(name.startswith(f"op{n}_") for name in names) == 1 for n in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(corpus, name):
    duck = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = queries.QUERIES[name](corpus, FOLDER)
    result = duck.sql(queries.ORACLE[name])
    columns = sorted(frame.columns)
    assert columns == sorted(result.columns)
    at = [result.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)
