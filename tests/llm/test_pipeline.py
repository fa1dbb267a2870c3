"""The registered training-data queries against SQL, and the pipeline against plain rules."""

import pytest
from check_queries import compare, connect

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tallyguard.llm.queries import QUERIES, SQL
from tallyguard.llm.sharding import SHARDS

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    df = queries()[name](spark, SF)
    res = connect(SF).execute(oracle_sql()[name])
    assert compare([tuple(r) for r in df.collect()], res.fetchall(), df.columns, [d[0] for d in res.description]) == ""


def test_registry():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] > seen[3] > 0.5 * seen[0]
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*columns, "shard", "slot"]
    rows = out.groupBy("shard").count().collect()
    assert len(rows) == SHARDS and max(r["count"] for r in rows) - min(r["count"] for r in rows) <= 1
