from tesserae.operators import catalog, chunking, evidence, retrieval
from tesserae.sources import formats, ingest


def _files(tmp_path, spark, names):
    for name, content in names.items():
        (tmp_path / name).write_bytes(content)
    return formats.scan(spark, str(tmp_path), exclude=("manifest.json",))


def test_registered_parsers_run_on_executors_and_fall_back(spark, tmp_path):
    files = _files(tmp_path, spark, {"a.pdf": b"one", "b.pdf": b"bad", "c.png": b"x", "manifest.json": b"{}"})

    def broken(name, content):
        raise RuntimeError("no engine")

    def plain(name, content):
        if content == b"bad":
            raise RuntimeError("unreadable")
        return [{"kind": "paragraph", "text": content.decode(), "page": 1}]

    formats.register("pdf", plain)
    formats.register("pdf", broken)
    try:
        parsed = ingest.parse(files).cache()
        got = {r.file_name: (r.kind, r.text, r.error) for r in parsed.collect()}
        assert got["a.pdf"] == ("paragraph", "one", None)
        assert got["b.pdf"][2] == "RuntimeError: unreadable" and "no parser is registered for image" in got["c.png"][2]
        states, rows = ingest.outcome(parsed, files)
        assert {r.file_name: (r.status, r.elements) for r in states.collect()} == {"a.pdf": ("ready", 1), "b.pdf": ("error", 0), "c.png": ("error", 0)}
        assert [r.file_name for r in rows.collect()] == ["a.pdf"]
    finally:
        formats.unregister("pdf")


def test_delimited_files_in_ingest(spark, tmp_path):
    files = _files(tmp_path, spark, {"t.csv": b'\xef\xbb\xbfid; name\n1; "x\n;y"\n2;\n', "e.tsv": b"\n", "zero.csv": b"", "old.xls": b"\xd0\xcf"})
    parsed = ingest.parse(files)
    assert "zero.csv" not in [r.file_name for r in files.collect()]
    rows = sorted(((r.sheet.split(":")[1], r.row, r.cells) for r in ingest.sheet_rows(parsed).collect() if ":t" in r.sheet))
    assert rows == [("t", 0, ["id", "name"]), ("t", 1, ["1", "x\n;y"]), ("t", 2, ["2", None])]
    states = {r.file_name: (r.status, r.sheets) for r in ingest.outcome(parsed, files)[0].collect()}
    assert states == {"t.csv": ("ready", 1), "e.tsv": ("ready", 1), "old.xls": ("error", 0)}


def test_retrieval_run(spark):
    lines = [("d1", 0, "The harvest robot picks apples in autumn."), ("d1", 1, "Its battery lasts nine hours."), ("d2", 0, "Invoices are due after thirty days.")]
    rows = [(d, f"{d}.md", s, "paragraph", t) for d, s, t in lines]
    elements = spark.createDataFrame(rows, "doc_id string, file_name string, seq long, kind string, text string")
    for name, kind in (("heading_level", "int"), ("page", "int"), ("line_start", "int"), ("line_end", "int"), ("symbol", "string")):
        elements = elements.selectExpr("*", f"CAST(NULL AS {kind}) AS {name}")
    chunks = chunking.chunks(chunking.sections(elements)).cache()
    asked = spark.createDataFrame([(1, "when are invoices due"), (2, "apples robot")], "qid long, question string")
    got = retrieval.run(chunks, asked).collect()
    best = {}
    for r in sorted(got, key=lambda r: -r.score):
        best.setdefault(str(r.qid), r.doc_id)
    assert best == {"1": "d2", "2": "d1"}
    assert retrieval.probe(chunks, asked).count() >= len(got)
    named = spark.createDataFrame([("d2:0",), ("d9:0",), ("nothing",)], "chunk_id string")
    assert [r.doc_id for r in catalog.chunks_by_id(chunks, named).collect()] == ["d2"]


def test_deletes_and_symbols(spark):
    docs = spark.createDataFrame([("a", 1, "ready"), ("b", None, "error"), ("c", 3, "ready")], "doc_id string, added_at int, status string")
    gone = docs.where("doc_id = 'a'")
    left = catalog.delete_documents({"documents": docs, "symbols": docs}, gone, keep_row=True)
    assert left["documents"].count() == 3 and left["symbols"].count() == 2
    assert [r.doc_id for r in catalog.recent_documents(docs).collect()] == ["c", "a", "b"]
    assert [r.doc_id for r in catalog.recent_documents(docs, "ready").collect()] == ["c", "a"]
    old = spark.createDataFrame([("a", "f"), ("a", "g"), ("b", "h")], "doc_id string, symbol string")
    new = spark.createDataFrame([("a", "f2")], "doc_id string, symbol string")
    assert sorted(r.symbol for r in catalog.add_symbols(old, new).collect()) == ["f2", "h"]


def test_unsupported_sentences_go(spark):
    rows = [("- Good one.\n- Bad one.\n\nStays.", ["Bad one."]), (None, ["x"]), ("All.", None), ("Gone.", ["Gone."])]
    df = spark.createDataFrame(rows, "answer string, unsupported array<string>")
    got = [r.supported for r in evidence.without_unsupported(df).collect()]
    assert got == ["- Good one.\n\nStays.", None, "All.", ""]
