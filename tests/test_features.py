from collections import Counter

import pytest

from tagloom.operators import features

ROWS = [
    ("a", ["x", "y", "x"]), ("b", ["y", None, "", ""]), ("c", []), ("d", None), ("e", [None]), ("f", ["w"] * 5000 + ["v"]),
]


def counted(spark, rows):
    docs = spark.createDataFrame(rows, "id string, tokens array<string>")
    return features.term_counts(docs, "id")


@pytest.mark.parametrize("more", [[], [("a", ["x", "z"]), ("a", ["x", "z"]), (None, ["x"]), (None, ["x", "q"])]])
def test_term_counts(spark, more):
    rows = ROWS + more
    got = [tuple(row) for row in counted(spark, rows).collect()]
    expected = Counter((name, word) for name, words in rows for word in words or () if word is not None)
    assert len(got) == len(expected)
    assert {(name, word): n for name, word, n in got} == expected


def test_terms_of_distinct_ids_stay_where_they_are(spark):
    plan = counted(spark, ROWS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
