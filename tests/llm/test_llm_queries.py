import pytest

from oracle import SMALL, assert_matches
from riskspan.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    assert_matches(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name, label, least", [("op1_toxicity", "toxic", 0.95), ("op8_quality_classifier", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    sf_dir = SMALL.replace("0.001", "0.01")
    out = queries.QUERIES[name](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(out) > 50
    assert sum(r["predicted"] == r[label] for r in out) >= least * len(out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
