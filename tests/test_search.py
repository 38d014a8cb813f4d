import math
from datetime import datetime

from pyspark.sql import functions as F

from tesserae.operators import catalog, evaluation, index
from tesserae.plans import router
from tesserae.streaming import events


def test_bm25_saturates(spark):
    df = spark.createDataFrame([(1, "robot"), (2, "robot " * 50)], "id long, text string")
    w = {r.id: r.weight for r in index.postings(df, "id", "text").collect()}
    assert w[1] < w[2] < index.K1 + 1


def test_fusion_against_a_plain_model(spark):
    d = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 2, 0.8), (1, "c", 3, 0.7)], "qid long, id string, rank int, score double")
    s = spark.createDataFrame([(1, "c", 1, 9.0), (1, "x", 2, 8.0)], "qid long, id string, rank int, score double")
    got = [(r.id, r.score) for r in index.fuse(d, s, 10).orderBy("rank").collect()]
    want = {"a": 1 / 61, "b": 1 / 62, "c": 1 / 63 + 1 / 61, "x": 1 / 62}
    assert [i for i, _ in got] == ["c", "a", "b", "x"] and all(math.isclose(v, want[i]) for i, v in got)


def test_filters_tell_none_from_empty(spark):
    df = spark.createDataFrame([("d1", "code"), ("d2", "table")], "doc_id string, kind string")
    assert index.restrict(df).count() == 2 and index.restrict(df, doc_ids=[]).count() == 0
    assert index.restrict(df, kinds=["code"]).count() == 1 and index.restrict(df, ["d2"], []).count() == 1


def test_dense_topk_leaves_odd_vectors_out(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [1.0]), (6, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "qid long, q array<double>")
    got = index.dense_topk(v, q, 5).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 6] and got[0].score == 1.0


def test_hash_embedding(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, None)], "id long, text string")
    got = {r.id: r.embedding for r in index.hash_embedding(df, "id", "text").collect()}
    assert math.isclose(sum(x * x for x in got[1]), 1) and got[2][0] == 1.0 and got[3][0] == 1.0


def test_interval_join_finds_each_pair_once(spark):
    a = spark.createDataFrame([("d", 1, 500), ("d", 600, 610)], "doc string, a int, b int")
    b = spark.createDataFrame([("d", 400, 700), ("d", 501, 599), ("e", 1, 9)], "doc string, c int, e int")
    assert index.interval_join(a, b, "doc", ("a", "b"), ("c", "e")).count() == 2


def test_ece(spark):
    good = spark.createDataFrame([(0.9, True)] * 9 + [(0.9, False)], "confidence double, correct boolean")
    bad = spark.createDataFrame([(0.95, False)] * 10, "confidence double, correct boolean")
    assert evaluation.calibration_error(good).first()[0] < 0.15 and evaluation.calibration_error(bad).first()[0] > 0.8


def test_catalog(spark):
    docs = spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "doc_id string, v int")
    assert sorted(map(tuple, catalog.upsert(docs, new, ["doc_id"]).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    m = spark.createDataFrame([("t", 0, "x")], "thread_id string, idx int, text string")
    add = spark.createDataFrame([("t", "y"), ("u", "z")], "thread_id string, text string")
    assert sorted(map(tuple, catalog.append_messages(m, add, "text").collect())) == [("t", 0, "x"), ("t", 1, "y"), ("u", 0, "z")]
    s = spark.createDataFrame([("A.f",), ("B.C.g",)], "symbol string")
    assert catalog.find_symbols(s, ["f", "C.g"]).count() == 2
    assert {r.name for r in catalog.symbol_names(s).collect()} == {"A.f", "B.C.g", "f", "g"}


def test_routing(spark):
    q = spark.createDataFrame([(1, "How many orders per region?"), (2, "hello"), (3, "Summarize the report")], "qid long, question string")
    probe = spark.createDataFrame([(i, 1, 1, "paragraph", None, "d") for i in (1, 2, 3)], "qid long, rank int, sparse_rank int, kind string, table_name string, doc_id string")
    t = spark.createDataFrame([("orders", "orders by region")], "name string, card string")
    s = spark.createDataFrame([("run_all",)], "name string")
    docs = spark.createDataFrame([("d", "annual_report.pdf")], "doc_id string, file_name string")
    named = router.mentioned_documents(q, docs)
    got = {r.qid: r for r in router.route(q, probe, t, s, named).collect()}
    assert got[1].intent == "table" and got[1].tables == ["orders"] and got[2].intent == "chitchat" and got[3].intent == "summary"
    plans = router.route(q, probe, t, s, named)
    assert router.sub_queries(plans, q, named, probe).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, datetime(2025, 1, 1, i % 5, i % 60), i % 3, "a", 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = events.tumbling(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    key = lambda x: sorted(map(tuple, x.collect()))
    assert key(spark.table("tumbled")) == key(events.tumbling(df, "1 hour"))


def test_hashed_vectors_against_a_plain_model(spark):
    import math
    import zlib
    from collections import Counter

    from tesserae.functions import text as T

    rows = [(i, t) for i, t in enumerate(["", None, "tide tables", "Tide tide harbour-master 2031 quay " * 9, "é 你好 ünïcode x1"])]
    df = spark.createDataFrame(rows, "id int, text string").repartition(2)
    tokens = {r.id: r.t or [] for r in df.select("id", T.tokens("text").alias("t")).collect()}
    for got in index.hash_embedding(df, "id", "text", 32).collect():
        cells = Counter()
        for t in tokens[got.id]:
            h = zlib.crc32(t.encode())
            cells[h % 32] += 1 if h >> 20 & 1 else -1
        norm = math.sqrt(sum(v * v for v in cells.values()))
        want = [cells[i] / norm if norm else float(i == 0) for i in range(32)]
        assert all(abs(a - b) < 1e-12 for a, b in zip(got.embedding, want, strict=True))


def test_latency_ranks_are_exact(spark):
    import random

    from tesserae.operators import evaluation

    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([None, *(rng.randint(0, 9) / 2 for _ in range(20))])) for _ in range(301)] + [("c", 1.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    for got in evaluation.latency(df, ["k"], "v").collect():
        v = sorted(x for k, x in rows if k == got.k and x is not None)
        n = len(v)
        assert got.p50 == (v[(n - 1) // 2] + v[n // 2]) / 2 and got.p95 == v[int(0.95 * (n - 1))]


def test_chunks_of_a_document_are_replaced(spark, tmp_path):
    from tesserae.operators import catalog

    path = f"{tmp_path}/chunks"
    make = lambda rows: spark.createDataFrame(rows, "doc_id string, ordinal int, text string")
    catalog.save_chunks(make([(f"d{i}", j, "old") for i in range(30) for j in range(3)]), path, 4)
    catalog.save_chunks(make([("d3", 0, "new"), ("d99", 0, "new")]), path, 4)
    got = [(r.doc_id, r.text) for r in spark.read.parquet(path).collect()]
    assert len(got) == 29 * 3 + 2 and got.count(("d3", "new")) == 1 and ("d3", "old") not in got
    assert len(list((tmp_path / "chunks").glob("bucket=*"))) <= 4
