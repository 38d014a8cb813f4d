import pytest

from tesserae.plans.dialect import UnsafeSQLError, rewrite


def test_plain_statements_stay():
    for sql in ("SELECT a FROM t", "SELECT 'QUALIFY x' AS a FROM t ORDER BY a", 'SELECT "qualify" FROM t', "SELECT (1) UNION SELECT 2"):
        assert rewrite(sql) == sql


def test_strftime_in_nested_calls():
    assert rewrite("SELECT strftime(coalesce(a, b), '%Y-%m') FROM t") == "SELECT date_format(coalesce(a, b), 'yyyy-MM') FROM t"
    assert rewrite("SELECT strftime(f('x, y'), '%dT%H')") == "SELECT date_format(f('x, y'), 'dd''T''HH')"
    for bad in ("SELECT strftime(a, '%Q')", "SELECT strftime(a)", "SELECT strftime(a, b)", "SELECT (1"):
        with pytest.raises(UnsafeSQLError):
            rewrite(bad)


@pytest.mark.parametrize(
    "sql, want",
    [
        ("SELECT k, v FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC) = 1 ORDER BY k", [("a", 3), ("b", 5)]),
        ("SELECT DISTINCT ON (k) k, v FROM t ORDER BY k DESC, v", [("b", 4), ("a", 1)]),
        ("SELECT DISTINCT ON (k) v FROM t -- first\nORDER BY k, v DESC LIMIT 1", [(3,)]),
        ("WITH u AS (SELECT * FROM t QUALIFY rank() OVER (ORDER BY v) <= 2) SELECT count(*) FROM u", [(2,)]),
        ("SELECT k, sum(v) AS s FROM t GROUP BY k QUALIFY max(sum(v)) OVER () = sum(v) ORDER BY s + 0", [("b", 9)]),
    ],
)
def test_rewritten_statements_run(spark, sql, want):
    spark.createDataFrame([("a", 1), ("a", 3), ("b", 4), ("b", 5)], "k string, v int").createOrReplaceTempView("t")
    assert [tuple(r) for r in spark.sql(rewrite(sql)).collect()] == want
