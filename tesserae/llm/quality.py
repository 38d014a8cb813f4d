"""Quality rules: statistics of each text, and cross-document line frequency.

Lines are normalised (ASCII lower case, white space to single spaces) and hashed. For each host
(the ``source``) the distinct documents that hold a line are counted, documents that agree in all
their normalised lines as one, so exact copies do not deplete each other. Lines found in more than
``limit`` documents, the larger of ``min_docs`` and ``share`` of the host's distinct documents, are
boilerplate and are removed. A document that loses more than half its words is depleted and
rejected, and so is one that fails the base rules. Near copies count as documents of their own: a
group of them that is larger than the limit is boilerplate by this rule.

All of it is Catalyst expressions. Words in repeated windows are found inside a row by sorting
window hashes that carry their position in the low bits; equal neighbours are then checked on the
words themselves, so the count is exact and costs n log n. Only line hashes are shuffled; distinct
(line, document) pairs spread by both, counts combine before their shuffle, and the join with the
boilerplate lines is salted, so a line that a third of all documents hold spreads over ``SALTS``
keys. Line hashes have 64 bits: a line meets only the boilerplate lines of its own host.

Defined results: a null text counts as empty and fails the base rules; a null source is a host of
its own; a document whose only line is boilerplate is depleted; documents without a word do not
count for their host; a line found in just ``limit`` documents stays; rows repeated in full each
get the same verdict; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.runtime import discard, settle

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_DOCS, SHARE, SALTS, FEW = 10, 0.01, 16, 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES, -1), "")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), SPACES, " "))


def _marked(rows: Column, same) -> Column:
    """Of a sorted array, the elements that have an equal neighbour."""
    last = F.size(rows) - 1
    keep = F.filter(
        F.sequence(F.lit(0), last),
        lambda j: ((j > 0) & same(rows[F.greatest(j - 1, F.lit(0))], rows[j]))
        | ((j < last) & same(rows[F.least(j + 1, last)], rows[j])),
    )
    return F.transform(keep, lambda j: rows[j])


def repeat_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more, the first one included."""

    def by_sorting(h: Column) -> Column:
        """Positions of hashes that may be found twice: sorted with the position in the low bits."""
        bits = F.ceil(F.log2(F.size(h) + 3)).cast("int")
        high = lambda x: F.call_function("shiftright", x, bits)
        low = (F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("long")
        keyed = F.transform(h, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long")))
        maybe = let(F.sort_array(keyed), lambda s: _marked(s, lambda a, b: high(a) == high(b)))
        return F.transform(maybe, lambda x: x.bitwiseAND(low).cast("int"))

    def maybe_twice(h: Column) -> Column:
        """With few hashes found twice, as in most texts, looking each position up among them is cheaper."""

        def of(twice: Column) -> Column:
            looked_up = F.filter(
                F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(twice, h[i])
            )
            return F.when(F.size(twice) <= FEW, looked_up).otherwise(by_sorting(h))

        found = let(F.sort_array(h), lambda s: F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))))
        return let(F.array_distinct(found), of)

    def positions(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])
        )

        def sure(h: Column) -> Column:
            exact = F.transform(
                maybe_twice(h), lambda p: F.struct(F.concat_ws(" ", w[p], w[p + 1], w[p + 2]).alias("g"), p.alias("p"))
            )
            same = let(F.sort_array(exact), lambda s: F.when(F.size(s) > 0, _marked(s, lambda a, b: a["g"] == b["g"])))
            return F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(same, lambda x: x["p"])))

        return let(hashes, sure)

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            at,
            zero,
            lambda acc, p: F.struct(
                (acc["n"] + (p + 3 - F.greatest(acc["end"], p)).cast("long")).alias("n"), (p + 3).alias("end")
            ),
            lambda acc: acc["n"],
        )

    found = let(words, lambda w: F.when(F.size(w) > 3, covered(positions(w))))
    return F.coalesce(found, F.lit(0).cast("long"))


def _keys(id_col: str, text_col: str, host_col: str) -> dict[str, Column]:
    """128 bits over a row's id, host and text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    i, host = F.col(f"`{id_col}`"), F.col(f"`{host_col}`")
    return {"k1": F.xxhash64(i, host, text), "k2": F.xxhash64(F.lit(1), text, host, i)}


def _keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"),
        F.col(f"`{host_col}`").alias("host"),
        *(c.alias(n) for n, c in _keys(id_col, text_col, host_col).items()),
    )


def statistics(t: Column) -> dict[str, Column]:
    """The base columns of a text that is not null."""
    words, lines = words_of(t), lines_of(t)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words),
    }


def _hashed_lines(t: Column) -> Column:
    """struct(all, lines): a hash over all lines with a word, and struct(at, h, n) of each: its place
    among all lines, the hash of its normalised form and its words."""
    flat = F.regexp_replace(F.translate(t, UPPER, LOWER), r"[\x20\x09\x0B-\x0D]+", " ")
    trimmed = F.transform(F.split(flat, "\n", -1), lambda x, i: F.struct(i.alias("at"), F.trim(x).alias("x")))
    lines = F.transform(
        F.filter(trimmed, lambda r: r["x"] != ""),
        lambda r: F.struct(
            r["at"].alias("at"),
            F.xxhash64(r["x"]).alias("h"),
            (F.length(r["x"]) - F.length(F.translate(r["x"], " ", "")) + 1).alias("n"),
        ),
    )
    return let(lines, lambda x: F.struct(F.xxhash64(F.transform(x, lambda r: r["h"])).alias("all"), x.alias("lines")))


def boilerplate(keyed: DataFrame, min_docs: int, share: float) -> DataFrame:
    """``(k1, k2, lost, cut)``: the places of a document's boilerplate lines and how many words they hold."""
    scratch: list[DataFrame] = []
    # made inside the row and before the explode: an expression above it would run once a line
    found = keyed.select("k1", "k2", "host", _hashed_lines(F.col("t")).alias("f"))
    rows = settle(found.select("k1", "k2", "host", F.col("f.all").alias("doc"), F.inline("f.lines")), "quality-lines", scratch)
    rows = rows.select("*", F.coalesce("host", F.lit("")).alias("g"), F.col("host").isNull().alias("g0"))
    counts = rows.select("g", "g0", "h", "doc").distinct().groupBy("g", "g0", "h").agg(F.count("*").alias("found"))
    hosts = rows.select("g", "g0", "doc").distinct().groupBy("g", "g0").agg(F.count("*").alias("docs"))
    over = counts.filter(F.col("found") > min_docs).join(hosts, ["g", "g0"]).filter(F.col("found") > F.col("docs") * share)
    salted = over.select("g", "g0", "h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = settle(salted, "quality-frequent", scratch)
    hit = rows.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int")).join(salted, ["g", "g0", "h", "salt"])
    once = hit.groupBy("k1", "k2", "at").agg(F.max("n").alias("n"))  # rows repeated in full count once
    lost = once.groupBy("k1", "k2").agg(F.sum("n").alias("lost"), F.collect_list("at").alias("cut"))
    lost = settle(lost, "quality-lost")
    discard(scratch)
    return lost


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    share: float = SHARE,
) -> DataFrame:
    """Per row of ``docs``: k1, k2 (its key by content), id, the statistics, base_failed, lost, cut, kept."""
    keyed = _keyed(docs, id_col, text_col, host_col)
    base = keyed.select("k1", "k2", "id", *(c.alias(n) for n, c in statistics(F.col("t")).items()))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return (
        base.join(boilerplate(keyed, min_docs, share), ["k1", "k2"], "left")
        .withColumn("lost", F.coalesce("lost", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("lost") * 2 <= F.col("n_words")))
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; ``lost_words`` follows them."""
    return judged(docs).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.col("lost").alias("lost_words"),
    )


def keep(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns; boilerplate lines are gone from their texts."""
    id_col, text_col, host_col = (
        options.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("host_col", "source"))
    )
    passed = judged(docs, **options).filter("kept")
    passed = passed.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("cut").alias("__cut"))
    passed = settle(passed.dropDuplicates(["__k1", "__k2"]), "quality-passed")
    keyed = docs.withColumns({f"__{n}": c for n, c in _keys(id_col, text_col, host_col).items()})

    def without(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__cut")
        return F.array_join(F.transform(stay, lambda i: lines[i]), "\n")

    t = F.col(f"`{text_col}`")
    clean = F.when(F.col("__cut").isNotNull(), let(F.split(t, "\n", -1), without)).otherwise(t)
    joined = keyed.join(passed, ["__k1", "__k2"])
    return joined.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


#: The same result in DuckDB's SQL.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source AS host,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g) WHERE n > 1
), rep AS (SELECT r, count(DISTINCT i + j) AS n FROM c, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r
), l AS (SELECT r, host, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d
), lw AS (
  SELECT r, host, line, pos, md5(x) AS h, len(string_split(x, ' ')) AS n
  FROM (SELECT r, host, line, pos,
          trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS x
        FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]'))
), dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY r
), whole AS (SELECT r, host, md5(string_agg(h, '' ORDER BY pos)) AS doc FROM lw GROUP BY r, host
), found AS (SELECT host, h, count(DISTINCT doc) AS n FROM lw JOIN (SELECT r, doc FROM whole) USING (r) GROUP BY host, h
), hosts AS (SELECT host, count(DISTINCT doc) AS docs FROM whole GROUP BY host
), over_limit AS (
  SELECT f.host, f.h FROM found f JOIN hosts k ON f.host IS NOT DISTINCT FROM k.host
  WHERE f.n > 10 AND f.n > k.docs * 0.01
), lost AS (
  SELECT r, sum(n) AS n FROM lw JOIN over_limit o ON lw.h = o.h AND lw.host IS NOT DISTINCT FROM o.host GROUP BY r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost_words * 2 <= n_words AS kept, lost_words
FROM (
  SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed
  FROM (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
      CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
      CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
      CAST(coalesce(lost.n, 0) AS BIGINT) AS lost_words
    FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r)))
"""
