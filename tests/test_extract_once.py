"""A text is searched once for its facts, and offsets hold whatever characters it has."""
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import extract as ex
from lectern.operators import corpus as cp
from lectern.plans import reports

ROWS = [(1, "s1", "due 2024-01-05, fuel $8.00 and 2024-01-09", False), (2, "s2", "Paid 3.25 EUR on May 2, 2024. Fuel surcharge: $7.50", False),
        (3, "s3-20240301", "fuel $1.00", False), (4, "s4", "nothing", False), (5, "s5", None, False)]
COLUMNS = "idx bigint, source string, text string, tombstone boolean"


def searches(df, pattern):
    """How often a pattern of matches stands in the optimized plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count(pattern)


@pytest.fixture()
def passages(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    yield spark.createDataFrame(ROWS, COLUMNS)
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_texts_are_searched_once(passages):
    one = searches(passages.select(ex.dates_of(F.col("text")).alias("d")), ex.COMPACT[0])
    items = cp.extracted(passages, False, False)
    assert one > 0
    assert searches(cp.date_range(items), ex.COMPACT[0]) == one
    assert searches(cp.time_gaps(items, 1), ex.COMPACT[0]) == one
    first = searches(passages.select(ex.first_date(F.col("text"), F.col("source")).alias("d")), ex.COMPACT[0])
    assert searches(reports.financial_rollup(passages, "", "category", "2024-01-01", "2024-12-31"), ex.COMPACT[0]) == first
    assert searches(reports.trend(passages), ex.COMPACT[0]) == 0     # read from the written series


def test_dates_and_amounts_together(passages):
    items = cp.extracted(passages, False, False)
    assert [str(v) for v in cp.date_range(items).first()] == ["3", "2024-01-05", "2024-05-02"]
    got = reports.trend(passages).collect()
    assert sorted((r.point, r.n, str(r.total), r.too_few_points) for r in got) == [
        ("2024-01-01", 1, "8.0000", False), ("2024-03-01", 1, "1.0000", False), ("2024-05-01", 1, "7.5000", False)]


@pytest.mark.parametrize("pattern", [ex.ISO[0], r"\$\s*" + ex.AMOUNT, ex.DAY_FIRST[0]])
@pytest.mark.parametrize("text", [
    "2024-01-02", "12024-01-02 2024-01-02 2024-01-02x 2024-01-023", "é𝒳\x01 2024-01-02 — \x01\x01$5 3 May 2024 $ 1,234.50", "$5$6 ($7)", "\x01", "",
    "a 3 MAY 2024, 3rd may 2024; x3 May 2024 13 May 2024"])
def test_spans_are_those_of_the_pattern(spark, pattern, text):
    got = spark.createDataFrame([(text,)], "text string").select(ex.spans(F.col("text"), pattern).alias("r")).first()["r"]
    assert [tuple(g) for g in got] == [(m.group(), m.start(), m.end()) for m in re.finditer(pattern, text, re.ASCII)]


def test_no_pattern_is_compiled_for_every_row(spark):
    """Only a text that holds the mark is split by the pattern itself."""
    plan = spark.createDataFrame([("x",)], "text string").select(ex.spans(F.col("text"), ex.ISO[0]).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 1 and "CASE WHEN Contains(text" in plan
