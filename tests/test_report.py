"""Profile, schema, rules, score and statistics on tiny frames with known answers."""

from __future__ import annotations

import json
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablecheck import Limits, Rule, TableMetrics, quality_report
from tablecheck.operators import frequencies
from tablecheck.operators.duplicates import candidates, duplicate_rows
from tablecheck.operators.ranks import order_statistics
from tablecheck.plans import eda, profile, rules, schema
from tablecheck.session import small_frame

STUDENTS = [
    ("A", 20.0, 85.0, "Mumbai"), ("B", 21.0, None, "Pune"), ("C", None, 78.0, "Delhi"),
    ("D", 22.0, 90.0, None), ("E", 20.0, 88.0, "Bangalore"),
]


@pytest.fixture(scope="module")
def students(spark):
    rows = spark.createDataFrame(STUDENTS, "name string, age double, marks double, city string")
    return quality_report(rows)


def by_column(frame):
    return {r["column"]: r.asDict() for r in frame.collect()}


def one(frame):
    return frame.first().asDict()


# ------------------------------------------------------------------ the students table


def test_students_statistics(students):
    found = by_column(students.numeric_summary)
    age, marks = found["age"], found["marks"]
    assert [age[k] for k in ("mean", "median", "std", "q1", "q3", "skewness", "kurtosis", "cv")] == [
        20.75, 20.5, 0.9574, 20.0, 21.25, 0.8546, -1.2893, 0.0461
    ]
    assert [marks[k] for k in ("mean", "median", "std", "q1", "q3", "skewness", "kurtosis", "cv")] == [
        85.25, 86.5, 5.252, 83.25, 88.5, -1.1649, 1.0851, 0.0616
    ]
    assert students.outlier_analysis.count() == 0
    assert students.histograms.count() == 0
    assert students.strong_correlations.first()["correlation"] == 0.803
    text = by_column(students.categorical_summary)
    assert (text["name"]["entropy"], text["city"]["entropy"]) == (2.3219, 2.0)


def test_students_score_and_advice(students):
    assert one(students.score) == {
        "score": 100.0, "status": "PASS", "total_weight": 125.0, "passed_weight": 125.0
    }
    advice = [(r["column"], r["issue"], r["severity"]) for r in students.recommendations.collect()]
    assert advice == [
        ("name", "High Cardinality", "LOW"), ("age", "Missing Values", "LOW"),
        ("marks", "Missing Values", "LOW"), ("city", "Missing Values", "LOW"),
    ]
    assert students.summary.first()[0].startswith(
        "Dataset contains 5 rows and 4 columns. Overall Data Quality Score: 100.0/100 — PASS."
    )


def test_students_report_is_json(students):
    report = json.loads(students.as_json().first()[0])
    assert report["table"]["row_count"] == 5
    assert [c["column"] for c in report["column_profile"]] == ["name", "age", "marks", "city"]
    assert report["failed_rules"] == []


# ------------------------------------------------------------------ profile and schema


def test_profile_counts(spark):
    m = TableMetrics(spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, "z")], "a int, b string"))
    assert (m.row_count, m.duplicate_rows) == (4, 1)
    assert [m.distinct(c) for c in m.columns] == [3, 3]


def test_missing_percentage(spark):
    m = TableMetrics(spark.createDataFrame([(1,), (None,), (3,), (None,)], "a int"))
    assert m.missing_pct(m.columns[0]) == 50.0


def test_empty_table(spark):
    found = quality_report(spark.createDataFrame([], "a double, b string, c boolean"))
    assert found.table_profile.first()["row_count"] == 0
    assert one(found.score)["score"] == 77.78
    assert [r["missing_pct"] for r in found.column_profile.collect()] == [None] * 3
    assert found.insights.count() == 0
    json.loads(found.as_json().first()[0])


def test_no_columns(spark):
    found = quality_report(spark.range(3).select())
    assert found.table_profile.first()["duplicate_rows"] == 0
    assert found.insights.count() == 0


def test_all_null_column_counts_as_numeric(spark):
    frame = spark.range(4).select(F.lit(None).alias("v"), "id")
    found = by_column(quality_report(frame).column_schema)
    assert found["v"]["semantic_type"] == "numeric"
    assert found["v"]["is_constant"] and found["v"]["missing_pct"] == 100.0


def test_boolean_with_nulls_stays_boolean(spark):
    frame = spark.createDataFrame([(True,), (None,), (False,), (True,)], "active boolean")
    row = by_column(profile.column_profile(TableMetrics(frame)))["active"]
    assert (row["true_count"], row["false_count"], row["true_pct"], row["unique_count"]) == (2, 1, 66.67, 2)


def test_nested_and_map_columns(spark):
    frame = spark.sql(
        "SELECT * FROM VALUES (array(1, 2), map('a', 1), named_struct('x', 1)), "
        "(array(1, 2), map('a', 1), named_struct('x', 1)), (array(3), map('b', 2), NULL) AS t(l, m, s)"
    )
    m = TableMetrics(frame)
    assert [m.distinct(c) for c in m.columns] == [2, 2, 1]
    assert m.duplicate_rows == 1
    assert {schema.semantic_type(c) for c in m.columns} == {"unknown"}
    json.loads(quality_report(frame).as_json().first()[0])


def test_non_finite_numbers(spark):
    values = [(float("nan"),), (float("inf"),), (1.0,), (2.0,), (3.0,), (None,)]
    m = TableMetrics(spark.createDataFrame(values, "v double"))
    [c] = m.columns
    assert m.missing(c) == 2
    assert m.quartile(c, 0.5) == 2.5
    assert m.mean(c) is None and m.std(c) is None
    assert eda.histograms(m).count() == 0
    assert eda.numeric_summary(m).first()["max"] is None


def test_awkward_column_names(spark):
    frame = spark.createDataFrame([(1, "x"), (2, "y")], "`a.b` int, `c d``e` string")
    found = quality_report(frame)
    assert [r["column"] for r in found.column_profile.collect()] == ["a.b", "c d`e"]
    json.loads(found.as_json().first()[0])


@pytest.mark.parametrize(
    "name, ddl, meaning",
    [
        ("age", "int", "numeric"), ("city", "string", "categorical"), ("active", "boolean", "boolean"),
        ("day", "date", "datetime"), ("ip", "string", "ip_address"), ("status", "boolean", "http_status"),
        ("timestamp", "string", "timestamp"), ("method", "int", "http_method"), ("IP", "string", "categorical"),
        ("tags", "array<int>", "unknown"),
    ],
)
def test_semantic_types(spark, name, ddl, meaning):
    frame = spark.createDataFrame([], f"`{name}` {ddl}")
    assert schema.semantic_type(TableMetrics(frame).columns[0]) == meaning


def test_invalid_status_in_mixed_text(spark):
    frame = spark.createDataFrame([("200",), ("404",), ("999",), ("abc",)], "status string")
    row = by_column(schema.column_schema(TableMetrics(frame)))["status"]
    assert row["invalid_status_pct"] == 50.0
    numbers = spark.createDataFrame([(200.7,), (float("inf"),), (None,), (99.0,)], "status double")
    m = TableMetrics(numbers)
    assert schema.invalid_status_pct(m, m.columns[0]) == 75.0


def test_samples_are_capped(spark):
    frame = spark.createDataFrame([(i,) for i in (5, 4, 3, 2, 1)], "col int")
    assert by_column(schema.column_schema(TableMetrics(frame)))["col"]["sample_values"] == ["1", "2", "3"]
    ordered = spark.createDataFrame([(1, 9), (2, 9), (3, 7), (4, 1)], "k int, col int")
    row = by_column(schema.column_schema(TableMetrics(ordered), order_by="k"))["col"]
    assert row["sample_values"] == ["9", "9", "7"]


def test_error_rate_of_text_status_is_zero(spark):
    frame = spark.createDataFrame([("500",), ("200",)], "status string")
    assert profile.error_rate(TableMetrics(frame)) == 0.0


# ------------------------------------------------------------------ statistics against pandas


def test_statistics_match_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(
        {
            "a": rng.normal(1e6, 3, 400), "b": rng.exponential(2, 400).round(1),
            "c": rng.integers(0, 5, 400).astype(float), "flat": 0.1,
        }
    )
    pdf["d"] = pdf["a"] * -2 + rng.normal(0, 1, 400)
    pdf.loc[rng.choice(400, 60, replace=False), "b"] = np.nan
    pdf.loc[rng.choice(400, 30, replace=False), "d"] = np.nan
    m = TableMetrics(spark.createDataFrame(pdf))
    for c in m.columns:
        s = pdf[c.name].dropna()
        assert m.mean(c) == pytest.approx(s.mean(), rel=1e-12)
        assert m.std(c) == pytest.approx(s.std(), rel=1e-9, abs=1e-12)
        assert m.skewness(c) == pytest.approx(s.skew(), rel=1e-7, abs=1e-9)
        assert m.kurtosis(c) == pytest.approx(s.kurtosis(), rel=1e-7, abs=1e-9)
        for p in (0.25, 0.5, 0.75):
            assert m.quartile(c, p) == s.quantile(p)
        edges, counts = m.histograms[c.ordinal]
        want, want_edges = np.histogram(s, bins=min(20, len(s) // 5))
        assert counts == list(want)
        assert np.allclose(edges, want_edges)
    corr = pdf.corr()
    for a in m.columns:
        for b in m.columns:
            want = corr.loc[a.name, b.name]
            got = m.correlation(a, b)
            assert got is None if math.isnan(want) else got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("size, skewness, kurtosis", [(1, None, None), (2, None, None), (3, 0.0, None), (4, 0.0, 0.0)])
def test_moments_of_constant_columns(spark, size, skewness, kurtosis):
    m = TableMetrics(spark.createDataFrame([(0.1,)] * size, "v double"))
    [c] = m.columns
    assert (m.skewness(c), m.kurtosis(c)) == (skewness, kurtosis)


def test_wide_table_correlation_by_blocks(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(200, 20)), columns=[f"x{i}" for i in range(20)])
    pdf[pdf > 1.5] = np.nan
    m = TableMetrics(spark.createDataFrame(pdf))
    corr = pdf.corr()
    for a in m.columns[:5]:
        for b in m.columns:
            assert m.correlation(a, b) == pytest.approx(corr.loc[a.name, b.name], abs=1e-9)


def test_co_missing_beyond_one_mask(spark):
    names = [f"c{i}" for i in range(70)]
    rows = [tuple(None if (r + i) % 7 == 0 else i for i in range(70)) for r in range(14)]
    m = TableMetrics(spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)))
    expected = {
        (i, j): n
        for i in range(70) for j in range(i + 1, 70)
        if (n := sum(rows[r][i] is None and rows[r][j] is None for r in range(14)))
    }
    assert m.co_missing == expected


# ------------------------------------------------------------------ ways of large tables


@pytest.mark.parametrize("values", ["spread", "hot", "two", "infinite"])
def test_rank_refinement_is_exact(spark, values):
    rng = np.random.default_rng(11)
    numbers = {
        "spread": rng.normal(size=3000) * 10.0 ** rng.integers(-3, 9, 3000),
        "hot": np.where(rng.random(3000) < 0.4, 7.0, rng.normal(size=3000)),
        "two": np.where(rng.random(3000) < 0.3, 1.0, 2.0),
        "infinite": np.where(rng.random(3000) < 0.3, np.inf, rng.normal(size=3000)),
    }[values]
    frame = spark.createDataFrame(pd.DataFrame({"x": numbers})).select(F.lit(0).alias("i"), "x")
    wanted = {0, 1, 749, 750, 1500, 2249, 2998, 2999}
    found = order_statistics(frame, {0: 3000}, {0: wanted}, fetch_budget=20, sample_rows=100)
    ordered = np.sort(numbers)
    assert found[0] == {r: ordered[r] for r in wanted}


def test_rank_refinement_reads_the_data_a_few_times(spark):
    total, seen = 200_000, spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    numbers = spark.range(total).selectExpr("0 AS i", "cast(pmod(xxhash64(id), 1000003) AS double) AS x")
    values = numbers.mapInArrow(counted, "i int, x double")
    wanted = {1_999, 2_000, 50_000, 100_000, 150_000, 197_999}
    found = order_statistics(values, {0: total}, {0: wanted}, fetch_budget=50, sample_rows=100)
    ordered = sorted(r.x for r in numbers.collect())
    assert found[0] == {r: ordered[r] for r in wanted}
    assert seen.value < 6 * total


@pytest.mark.parametrize("verify, bits", [(True, 1 << 25), (True, 64), (False, 64)])
def test_duplicates_by_fingerprint(spark, verify, bits):
    rows = [(None, "a"), ("a", None), (None, "a"), ("a", "b"), ("ab", None), ("a", "b"), ("a", "b")]
    frame = spark.createDataFrame(rows, "x string, y string")
    assert duplicate_rows(frame, verify=verify, filter_bits=bits) == 3


def test_rows_without_an_equal_stay_out_of_the_shuffle(spark):
    rows = spark.range(5000).selectExpr("if(id % 100 = 0, 0, id) AS k", "repeat('x', 50) AS t")
    found = candidates(rows)
    assert found.count() == 50 and found.distinct().count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    # whole rows meet the filter before any exchange of theirs
    keyed, filtered = re.search(r"Join \[h1#", plan), re.search(r"BroadcastHashJoin \[word#", plan)
    assert keyed.start() < filtered.start()  # a plan names what comes first last


def test_top_values_of_long_texts(spark):
    same = "s" * 40
    texts = [f"{same}{k % 30}" for k in range(90)] + ["short"] * 3 + [same[:32]] * 3 + ["t" * 50] * 7
    frame = spark.createDataFrame([(t, "u" * 33 + str(k)) for k, t in enumerate(texts)], "t string, u string")
    m = TableMetrics(frame)
    found = frequencies.top_values(m.data, m.columns, 10)
    for place, column in enumerate(("t", "u")):
        counts = Counter(r[place] for r in frame.collect())
        wanted = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:10]
        assert found[place] == [(k, v, n) for k, (v, n) in enumerate(wanted, 1)]
    plan = frequencies.digest_counts(m.data, m.columns)._jdf.queryExecution().executedPlan().toString()
    moved = next(x for x in plan.splitlines() if "Exchange hashpartitioning(i" in x)
    assert "start" in moved and "value" not in moved
    m.release()


def test_hot_value_in_text_column(spark):
    frame = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), "id")).alias("t")
    )
    m = TableMetrics(frame)
    [c] = m.columns
    assert m.top(c)[0] == (1, "hot", 1000)
    assert m.distinct(c) == 2001
    assert len(m.top(c)) == 10


# ------------------------------------------------------------------ rules on stub metrics


def stub(spark, missing=5.0, unique=10, rows=1000, dups=0, rate=None):
    prof = small_frame(
        spark,
        [{"ordinal": 0, "column": "c", "missing_pct": missing, "unique_count": unique}],
        "ordinal int, column string, missing_pct double, unique_count bigint",
    )
    table = small_frame(
        spark,
        [{"row_count": rows, "duplicate_rows": dups,
          "duplicate_pct": dups / rows * 100 if rows else 0.0, "error_rate_pct": rate}],
        "row_count bigint, duplicate_rows bigint, duplicate_pct double, error_rate_pct double",
    )
    return prof, table


def evaluate(spark, rule, column=None, limit=0.0, **facts):
    prof, table = stub(spark, **facts)
    row = {"rule_id": 1, "rule": rule, "column": column, "limit": limit, "weight": 10.0}
    one_rule = small_frame(
        spark, [row], "rule_id int, rule string, column string, limit double, weight double"
    )
    result = rules.evaluate_rules(one_rule, prof, table).first()
    return result.passed, result.message


@pytest.mark.parametrize(
    "rule, column, limit, facts, passed, message",
    [
        (rules.MISSING, "c", 10, {"missing": 5.0}, True, "c: missing within limit"),
        (rules.MISSING, "c", 10, {"missing": 45.0}, False, "c: 45.0% missing"),
        (rules.MISSING, "nope", 10, {}, False, "Column 'nope' not found"),
        (rules.DUPLICATE, None, 5, {"dups": 200}, False, "20.00% duplicate rows"),
        (rules.DUPLICATE, None, 5, {"dups": 50}, True, "Duplicate rows within limit"),
        (rules.DUPLICATE, None, 5, {"rows": 0}, True, "Duplicate rows within limit"),
        (rules.ERRORS, None, 2, {"rate": 1.5}, True, "Error rate acceptable"),
        (rules.ERRORS, None, 2, {"rate": 12.5}, False, "Error rate 12.5%"),
        (rules.ERRORS, None, 2, {}, False, "Error rate missing"),
        (rules.TRAFFIC, None, 100, {"rows": 3}, False, "Only 3 rows"),
        (rules.TRAFFIC, None, 100, {"rows": 100}, True, "Sufficient data volume"),
        (rules.CONSTANT, "c", 1, {"unique": 1}, False, "c is constant"),
        (rules.CONSTANT, "c", 1, {"unique": 2}, True, "c varies"),
        (rules.CONSTANT, "nope", 1, {}, False, "Column 'nope' not found"),
    ],
)
def test_rules(spark, rule, column, limit, facts, passed, message):
    assert evaluate(spark, rule, column, float(limit), **facts) == (passed, message)


@pytest.mark.parametrize(
    "outcomes, score, status",
    [
        ([], 0.0, "NO_RULES"), ([(True, 10.0)], 100.0, "PASS"), ([(False, 10.0)], 0.0, "FAIL"),
        ([(True, 10.0), (False, 10.0)], 50.0, "FAIL"), ([(True, 80.0), (False, 20.0)], 80.0, "WARNING"),
    ],
)
def test_score(spark, outcomes, score, status):
    frame = small_frame(
        spark, [{"passed": p, "weight": w} for p, w in outcomes], "passed boolean, weight double"
    )
    found = one(rules.score(frame))
    assert (found["score"], found["status"]) == (score, status)


def test_weights_limits_and_custom_rules(spark):
    frame = spark.createDataFrame([(i, "k") for i in range(10)], "id int, unit string")
    found = quality_report(
        frame,
        semantic_overrides={"id": "id-like", "unit": "unit"},
        limits=Limits(min_rows=10, traffic_weight=6.0),
        custom_rules=[Rule("MaxId", F.col("max") < 5, F.lit("id too large"), 4.0, "id")],
    )
    got = [(r["rule"], r["column"], r["passed"], r["weight"]) for r in found.rule_results.collect()]
    assert got == [
        ("MissingValueRule", "id", True, 30.0), ("ConstantColumnRule", "id", True, 20.0),
        ("MissingValueRule", "unit", True, 20.0), ("DuplicateRowRule", None, True, 15.0),
        ("TrafficVolumeRule", None, True, 6.0), ("MaxId", "id", False, 4.0),
    ]
    assert one(found.score)["score"] == 95.79
