import json

from pyspark.sql import functions as F

from tesserae import cli
from tesserae.operators import answers, memory
from tesserae.plans import table_agent as A
from tesserae.sources import golden, ocr


def sales(spark):
    df = spark.createDataFrame([("EU", 10, False, 2), ("US", 20, False, 3)], "region string, revenue long, _is_total boolean, _row long")
    return A.NamedTable("sales", df, "Table `sales`", "d", "s.xlsx", sheet="S")


def test_table_agent_repairs(spark):
    t = sales(spark)
    replies = iter(["DROP TABLE sales", "SELECT revenue FROM sales WHERE region = 'Europe'", "SELECT sum(revenue) AS r FROM sales WHERE region = 'EU'"])
    seen = []
    got = A.answer(spark, "EU?", [t], lambda talk: seen.append(talk[-1]["content"]) or next(replies))
    assert got.rows == [{"r": 10}] and got.retries == 2 and "EU | US" in seen[2]
    e = A.as_evidence("EU?", [t], got)
    assert e["score"] == 0.85 and "RESULT: r = 10" in e["content"] and e["location"] == "sheet S"
    spec = json.dumps({"table": "sales", "aggregations": [{"column": "revenue", "func": "max"}]})
    replies = iter(["no", "no", "no", f"```json\n{spec}\n```"])
    got = A.answer(spark, "most?", [t], lambda talk: next(replies))
    assert got.method == "spec" and got.rows == [{"max_revenue": 20}] and A.answer(spark, "q", [], None) is None
    assert A.row_span([1, 2]) == "1, 2" and A.row_span(list(range(9))).endswith("(9 rows)") and A.format_value(2.0) == "2"


def test_memory(spark):
    rows = [("t", i, f"q{i}", f"a{i}", None if i else "SELECT 1", ["d"] if i == 1 else None) for i in range(5)]
    df = spark.createDataFrame(rows, "thread_id string, turn int, question string, answer string, sql string, doc_ids array<string>")
    got = {r.turn: r for r in memory.carried(memory.history_text(df)).collect()}
    assert got[0].history == "" and got[4].history.startswith("User: q1") and got[4].last_sql == "SELECT 1" and got[2].active_docs == ["d"]
    marks = spark.range(20).select("id", memory.summarises(F.col("id")).alias("s")).filter("s").collect()
    assert [r.id + 1 for r in marks] == [12, 16, 20]


def test_stream_of_turns(spark, tmp_path):
    df = spark.createDataFrame([("t", f"q{i}", "a") for i in range(8)], "thread_id string, question string, answer string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = memory.stream_turns(stream).writeStream.outputMode("update").format("memory").queryName("turns").start()
    q.processAllAvailable()
    q.stop()
    [row] = spark.table("turns").collect()
    assert row.n == 8 and len(json.loads(row.history)) == memory.KEEP


def test_ocr_blocks(spark):
    rows = [("p", "b", 0.8, 0.0, 12.0, 9.0, 22.0), ("p", "a", 1.0, 0.0, 0.0, 10.0, 10.0), ("p", "c", 0.5, 1.0, 60.0, 5.0, 70.0)]
    lines = spark.createDataFrame(rows, "page_id string, text string, conf double, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.text, r.y1, r.conf) for r in ocr.group_lines(lines).collect())
    assert got == [("a\nb", 22.0, 0.9), ("c", 70.0, 0.5)]


def test_answers(spark):
    s = spark.createDataFrame([(1, 2, "f", "two"), (1, 1, None, "one")], "qid long, s int, label string, content string")
    assert answers.format_sources(s).first().prompt == "[S1] \none\n\n[S2] f\ntwo"
    r = spark.createDataFrame([(1, "c", "f.png", "OBSERVATION: bars\nANSWER: 7"), (1, "d", "g.png", "NOT_IN_IMAGE")], "qid long, chunk_id string, file_name string, reply string")
    [v] = answers.vision_evidence(r).collect()
    assert v.content.endswith("image: 7") and "bars" in v.content
    h = spark.createDataFrame([("q", "t")], "question string, text string")
    assert answers.rerank(h, lambda: lambda q, t: [0.0] * len(q)).first()["rerank"] == 0.5
    o = spark.createDataFrame([(1, 0, None, "", 0, 0), (2, 1, "low_relevance", "", 0, 0), (3, 1, None, "NOT_FOUND", 0, 0), (4, 1, None, "x", 0, 2), (5, 1, None, "x", 1, 2)], "qid long, n_documents int, reason string, draft string, n_supported int, n_factual int")
    assert [r.status for r in answers.outcome(o).orderBy("qid").collect()] == ["no_documents", "low_relevance", "not_found", "unverified", "answered"]


def test_golden_and_report(spark, tmp_path):
    p = tmp_path / "golden.jsonl"
    items = [{"id": "a", "question": "q", "reference": "r", "type": "lookup", "must_cite": [{"file": "f", "page": 1}], "expected_numbers": ["412"]}, {"id": "b", "question": "q", "reference": "", "type": "none", "answerable": False}]
    p.write_text("\n".join(map(json.dumps, items)))
    g = golden.read_golden(spark, str(p))
    assert golden.expected_sources(g).collect()[0].file == "f"
    got = spark.createDataFrame([("a", "There are 412.", False, 0.9, ["f"], 1.0), ("b", "", True, 0.1, [], 3.0)], "qid string, answer string, abstained boolean, confidence double, cited_files array<string>, seconds double")
    rep = golden.report(golden.judge(g, got))
    assert rep["correct"] == 1 and rep["abstain_recall"] == 1 and rep["citation_recall"] == 1 and rep["p50"] == 2.0
    golden.write_report(rep, str(tmp_path / "r.json"))


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# Robots\n\nThe robot fleet counts 412 machines.\n\n# Food\n\nLunch is at noon.")
    assert cli.main(["ingest", str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    cli.main(["search", str(tmp_path / "out"), "how many robots"])
    spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "t"))
    cli.main(["sql", "SELECT x FROM t", f"t={tmp_path / 't'}"])
    out = capsys.readouterr().out.strip().split("\n")
    assert "412" in json.loads(out[1])[0]["text"] and json.loads(out[2]) == [{"x": 1}]
