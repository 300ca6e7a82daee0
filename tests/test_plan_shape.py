"""The plans that a cluster would run."""

import pytest

from tagloom.catalog import QUERIES
from tagloom.plans import segments

SLOW_FITS = ("ovr_logreg_predict", "stream_score")
# Viterbi runs over Arrow batches.
ARROW = ("tag_sequence",)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SLOW_FITS) - set(ARROW)))
def test_no_python_worker_and_no_cross_join(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for operator in ("PythonUDF", "ArrowEval", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


def test_scoring_reads_two_columns_and_shuffles_once(spark, sf_dir, training):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "cast(doc_id as string) as appId", "text as description", "source"
    )
    answered = segments.batch_segments(docs, segments.train(training))
    plan = plan_of(answered)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    # One exchange of the records; the other one prepares the broadcast term table.
    assert plan.count("Exchange hashpartitioning(appId") == 1
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("BroadcastHashJoin") == 1


def test_numeric_filter_reaches_the_scan(spark, sf_dir):
    docs = QUERIES["filter_ascii_english"](spark, sf_dir).where("n_chars > 1000")
    assert "GreaterThan(n_chars,1000)" in plan_of(docs)
