"""Catalog tables as DataFrames: versions, upserts, threads, symbols, lookups.

There is no table format with row updates here, so mutation is append plus latest-by-key on read,
or rewriting the affected partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.runtime import settle


def content_id(content: str | Column) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(F.col(content) if isinstance(content, str) else content, 256), 1, 16)


def index_key(chunker: str, parser: Column, ocr: Column, embedder: Column) -> Column:
    return F.concat_ws("|", F.lit(f"chunker{chunker}"), parser, ocr, embedder)


def new_documents(batch: DataFrame, known: DataFrame, key: str = "doc_id", version: str = "index_key") -> DataFrame:
    """Rows of ``batch`` to ingest: one a content id, without those ready under the same version."""
    done = known.filter("status = 'ready'").select(key, version).distinct()
    return batch.dropDuplicates([key]).join(done, [key, version], "left_anti")


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The newest row of each key."""
    order = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in by])
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key is not among them."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame, keep_row: bool = False) -> dict[str, DataFrame]:
    """Every table without the rows of these documents (doc_id); ``keep_row`` spares the table ``documents``."""
    return {n: t if keep_row and n == "documents" else delete(t, gone, ["doc_id"]) for n, t in tables.items()}


def delete_threads(threads: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Threads and their messages without these thread ids."""
    return delete(threads, gone, ["thread_id"]), delete(messages, gone, ["thread_id"])


def add_symbols(symbols: DataFrame, new: DataFrame) -> DataFrame:
    """Symbols of newly parsed documents replace those held for them."""
    return upsert(symbols, new, ["doc_id"])


def recent_documents(documents: DataFrame, status: str | None = None) -> DataFrame:
    """Documents, newest first."""
    kept = documents.filter(F.col("status") == status) if status else documents
    return kept.orderBy(F.col("added_at").desc_nulls_last(), "doc_id")


def chunks_by_id(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks named as ``doc:ordinal`` in ``wanted.chunk_id``; the document is what stands before the last colon."""
    key = F.col("chunk_id")
    parts = wanted.select(
        F.expr("left(chunk_id, length(chunk_id) - length(substring_index(chunk_id, ':', -1)) - 1)").alias("doc_id"),
        F.substring_index(key, ":", -1).try_cast("long").alias("ordinal"),
    ).distinct()
    return chunks.join(parts, ["doc_id", "ordinal"], "left_semi")


def touch_threads(threads: DataFrame, seen: DataFrame) -> DataFrame:
    """Upsert of (thread_id, title, created_at, updated_at): of known threads only updated_at moves."""
    both = threads.unionByName(seen)
    return both.groupBy("thread_id").agg(
        F.min_by("title", "created_at").alias("title"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
    )


def append_messages(messages: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """New messages numbered on from the last of their thread."""
    last = messages.groupBy("thread_id").agg(F.max("idx").alias("last"))
    w = Window.partitionBy("thread_id").orderBy(order)
    numbered = new.join(last, "thread_id", "left").withColumn(
        "idx", F.coalesce("last", F.lit(-1)) + F.row_number().over(w)
    )
    return messages.unionByName(numbered.select(*messages.columns))


def with_documents(rows: DataFrame, documents: DataFrame, how: str = "inner") -> DataFrame:
    """Catalog rows with their document's file name; with how = left a missing one is empty."""
    named = documents.select("doc_id", "file_name")
    joined = rows.join(named, "doc_id", how)
    return joined.withColumn("file_name", F.coalesce("file_name", F.lit(""))) if how == "left" else joined


def find_symbols(symbols: DataFrame, names: list[str], documents: DataFrame | None = None) -> DataFrame:
    """Symbols of these names, whole or after the first dot."""
    tail = F.expr("substring(symbol, instr(symbol, '.') + 1)")
    found = symbols.filter(F.col("symbol").isin(names) | tail.isin(names))
    return with_documents(found, documents) if documents is not None else found


def symbol_names(symbols: DataFrame) -> DataFrame:
    """All names, whole and after the last dot."""
    last = symbols.select(F.substring_index("symbol", ".", -1).alias("name"))
    return symbols.select(F.col("symbol").alias("name")).union(last).distinct()


def library_totals(documents: DataFrame) -> DataFrame:
    return documents.filter("status = 'ready'").agg(
        F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.sum("tables").alias("tables"), F.sum("pages").alias("pages")
    )


def cited_rows(table: DataFrame, row_ids: list[int]) -> DataFrame:
    return table.filter(F.col("_row").isin(row_ids))


def code_evidence(chunks: DataFrame, symbols: DataFrame, most: int = 4) -> DataFrame:
    """Code chunks whose lines overlap a symbol's, at most ``most`` symbols a question."""
    order = Window.partitionBy("qid").orderBy("symbol", "doc_id", "line_start")
    few = symbols.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n")
    s = few.select("qid", "doc_id", "symbol", F.col("line_start").alias("s_start"), F.col("line_end").alias("s_end"))
    return chunks.filter("kind = 'code'").join(s, "doc_id").filter("line_start <= s_end AND line_end >= s_start")


def save_table(df: DataFrame, root: str, name: str) -> str:
    """Parquet under ``root``; the path is returned."""
    path = f"{root.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def save_chunks(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Upsert by document into ``buckets`` folders by a hash of doc_id: a document written again replaces
    its chunks. Only buckets that are touched are rewritten; rows of other documents there stay."""
    spark, bucket = chunks.sparkSession, F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    fresh = settle(chunks.withColumn("bucket", bucket), "chunks-fresh")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        touched, written = fresh.select("bucket").distinct(), fresh.select("doc_id").distinct()
        held = spark.read.schema(fresh.schema).parquet(path).join(F.broadcast(touched), "bucket", "left_semi")  # at most ``buckets`` rows
        fresh = settle(fresh.unionByName(held.join(written, "doc_id", "left_anti").select(*fresh.columns)), "chunks-merged")
    fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
