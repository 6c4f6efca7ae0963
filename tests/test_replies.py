import pytest
from pyspark.sql import functions as F

from quire.functions import replies


@pytest.mark.parametrize(
    ("of", "parses"),
    [
        (lambda r: replies.reviewed(F.lit("x"), r), 2),  # as it is, and with backslashes doubled
        (lambda r: replies.detected(r, F.lit(1200), F.lit(1600)), 1),
        (lambda r: replies.actions(r, F.lit(3)), 1),
    ],
)
def test_replies_are_parsed_once(spark, of, parses):
    plan = spark.range(1).select(F.concat(F.lit("[]"), F.col("id").cast("string")).alias("reply")).select(of(F.col("reply")).alias("got"))
    told = plan._jdf.queryExecution().optimizedPlan().toString()
    assert told.lower().count("parse_json(") + told.lower().count("parsejson(") == parses
    assert told.count("regexp_replace(") == 2


def test_odd_reviews(spark):
    told = ['{"score": 7, "issues": ["a", 1]}', '```json\n{"score": "12"}\n```', '{"score": null, "issues": []}', '{"score": "x"}', "[1]", "no", None, '{"issues": ["\\d"], "score": 3.9}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "i int, reply string")
    got = {r.i: (r.r.score, r.r.issues) for r in rows.select("i", replies.reviewed(F.lit("x"), F.col("reply")).alias("r")).collect()}
    assert got[0] == (7, ["a", "1"]) and got[1] == (12, []) and got[7] == (3, ["\\d"])
    assert all(got[i] == (80, []) for i in (3, 4, 5, 6))
