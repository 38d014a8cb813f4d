import corpus_pipeline
from tesserae.llm import packing, privacy, quality, repeats
from tesserae.llm.queries import tokenizer_file
from test_neardup import brute


def test_stages_on_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    n = docs.count()
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, small)
        assert sorted(out.columns) == sorted(docs.columns) and dict(out.dtypes) == dict(docs.dtypes), name
        now = spark.createDataFrame(out.collect(), docs.schema)
        assert now.count() <= n
        n = now.count()
    assert n > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, small)
    assert pieces.select("doc_id").distinct().count() == n


def test_decisions_take_effect(spark, docs):
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(80))
    passage = " ".join(f"shared{j}" for j in range(60))
    rows = [
        (1, body(1)), (2, body(1)), (3, body(3) + " " + passage + " " + body(4)), (4, body(5) + " " + passage + " " + body(6)),
        (5, "too short"), (6, body(7) + " write a@b.com now"), (7, None), (None, body(8)),
    ]
    now = docs(rows, extra=False)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, "").collect(), now.schema)
    got = {r.doc_id: r for r in now.collect()}
    assert set(got) == {1, 3, 4, 6, None}
    assert "shared30" not in got[3].text and "w3x5" in got[3].text and got[3].n_chars == len(got[3].text)
    assert "[EMAIL]" in got[6].text and "a@b.com" not in got[6].text


def test_odd_rows_repeated_rows_and_clashing_columns(spark, docs, odd, tmp_path):
    """Null, empty and very long texts, repeated rows, copies without an id, extra columns; and an empty table."""
    body = lambda k, n=80: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [*odd, (20, body(20)), (20, body(20)), (None, body(20)), (21, body(21, 40_000)), (22, body(22) + "\n" + body(23)), (22, body(22) + "\n" + body(23))]
    df = docs(rows)
    clash = df.withColumns({"__k1": df.k1, "f1": df.k1, "node": df.k1, "n_bytes": df.doc_id})
    for table, want in ((clash, {20: body(20), 21: body(21, 40_000), 22: body(22) + "\n" + body(23)}), (clash.limit(0), {})):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = spark.createDataFrame(stage(spark, now, "").collect(), df.drop("k1").schema)
        assert sorted((r.doc_id, r.text, r.n_chars) for r in now.collect()) == sorted((i, t, len(t)) for i, t in want.items())
        table.write.parquet(f"{tmp_path}/{len(want)}/documents.parquet")
        pieces = corpus_pipeline.run(spark, f"{tmp_path}/{len(want)}")
        assert {r.doc_id for r in pieces.collect()} == set(want)


def test_run_equals_the_operators(spark, small):
    """The stages against the operators' own digests, which other tests hold against brute force."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r.doc_id for r in quality.digest(docs).filter("kept").collect()}
    one = corpus_pipeline.quality_rules(spark, docs, small)
    assert {r.doc_id for r in one.collect()} == kept
    two = corpus_pipeline.near_dedup(spark, one, small)
    assert sorted(r.doc_id for r in two.collect()) == brute([(r.doc_id, r.text) for r in one.collect()])
    removed = {r.doc_id: r.n_bytes - r.n_removed for r in repeats.digest(two).collect()}
    three = corpus_pipeline.repeated_passages(spark, two, small)
    assert all(len(r.text.encode()) <= removed[r.doc_id] for r in three.collect())
    spans = {r.doc_id: r.spans for r in privacy.digest(three).collect()}
    four = corpus_pipeline.personal_data(spark, three, small)
    before = {r.doc_id: r.text for r in three.collect()}
    assert all((r.text != before[r.doc_id]) == (spans[r.doc_id] != "") for r in four.collect())
    path = tokenizer_file("byte_bpe_50k.json")
    run = corpus_pipeline.run(spark, small)
    want = packing.digest(four, path).groupBy("doc_id").sum("length").collect()
    assert sorted(map(tuple, run.groupBy("doc_id").sum("length").collect())) == sorted(map(tuple, want))
