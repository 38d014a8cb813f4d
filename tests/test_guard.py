import pytest

from tesserae.plans.guard import QueryTimeout, Sandbox, UnsafeSQLError, extract_sql, referenced_columns, validate_sql

UNSAFE = [
    "DROP TABLE sales", "DELETE FROM sales", "UPDATE sales SET revenue = 0", "INSERT INTO sales VALUES (1)",
    "CREATE TABLE x AS SELECT 1", "COPY sales TO 'out.csv'", "ATTACH 'other.db'", "PRAGMA database_list", "INSTALL httpfs",
    "LOAD httpfs", "SET enable_external_access = true", "SELECT 1; DROP TABLE sales", "SELECT * FROM read_csv('C:/secrets.csv')",
    "SELECT * FROM read_parquet('x.parquet')", "SELECT * FROM 'C:/data/secret.parquet'", "SELECT * FROM glob('*')",
    "SELECT getenv('PATH')", "SELECT * FROM read_text('C:/Windows/win.ini')", "SELECT * FROM duckdb_settings()",
    "SELECT * FROM other_table", "SELECT * FROM main.sales", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM range(10)",
    "SELECT reflect('java.lang.System', 'getenv')", "SELECT (SELECT java_method('a', 'b'))",
    "SELECT * FROM sales WHERE revenue IN (SELECT x FROM other)", "SELECT input_file_name() FROM sales",
]


@pytest.mark.parametrize("sql", UNSAFE)
def test_unsafe_sql_is_rejected(spark, sql):
    with pytest.raises(UnsafeSQLError):
        validate_sql(sql, {"sales"}, spark)


def test_limits(spark):
    assert validate_sql("SELECT region FROM sales", {"sales"}, spark).endswith("LIMIT 200")
    assert "LIMIT 1000" in validate_sql("SELECT * FROM sales LIMIT 99999", {"sales"}, spark)
    assert validate_sql("WITH t AS (SELECT * FROM sales) SELECT COUNT(*) FROM t", {"sales"}, spark).startswith("WITH")
    assert referenced_columns('SELECT "region" FROM sales WHERE revenue > 1', {"sales"}, spark) == {"region", "revenue"}
    assert extract_sql("Sure:\n```sql\nSELECT 1;\n```\nDone") == "SELECT 1"


def test_sandbox(spark):
    df = spark.createDataFrame(
        [("EU", 10, False, 2), ("US", 20, False, 3), ("EU", 30, False, 4), ("Total", 60, True, 5)],
        "region string, revenue long, _is_total boolean, _row long",
    )
    with Sandbox(spark, {"sales": df}) as box:
        rows = box.run('SELECT region, SUM(revenue) AS r FROM sales WHERE NOT "_is_total" GROUP BY 1 ORDER BY 1')
        assert rows == [{"region": "EU", "r": 40}, {"region": "US", "r": 20}]
        assert box.distinct_values("sales", "region") == ["EU", "Total", "US"] and box.text_columns("sales") == ["region"]


def test_timeout(spark):
    df = spark.range(3000).toDF("x")
    with Sandbox(spark, {"big": df}, timeout_s=0.5) as box, pytest.raises(QueryTimeout):
        box.run("SELECT COUNT(*) FROM big a CROSS JOIN big b CROSS JOIN big c WHERE a.x + b.x + c.x = -1")
