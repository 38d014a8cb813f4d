"""Personal data: base patterns, and terms that give a protected entity away.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. The method adds spans
of terms by information-theoretic sanitisation. An entity is a normalised match: an address in lower
case, the digits of a number. Over the whole corpus it is counted in how many distinct texts a term
stands, and in how many of them together with an entity, anywhere in the text. With ``SMOOTH`` added
to the texts of the term, that estimates P(entity given term), and the term's pointwise mutual
information with the entity as a share of the entity's information content. A term that exceeds both
thresholds, ``CHANCE`` and ``SHARE``, discloses the entity and is generalised wherever it stands, in
texts without the entity too. Terms are words (letters and digits) and pairs of neighbouring words,
so names of two words count also where each word is common; a pair is left out where one of its
words discloses already.

Witnesses: a term's texts with an entity count once per context (``AROUND`` words before the term
and after it where it first stands), so copies of one text are one witness, near copies hardly more, and disclose nothing
by themselves. An entity in a single text therefore has no disclosing terms.

All of it is Catalyst expressions. Matches and the gaps between them give positions: ``split`` and
``regexp_extract_all`` run the same matcher loop; positions are prefix sums, made in blocks of
sqrt(n) so that a text of many matches costs n * sqrt(n) at most. The patterns have possessive
quantifiers and a look-behind where that cannot change a match: no backtracking over long runs.

Scale: only entities in two distinct texts or more are followed, and only terms that stand beside
such an entity in two contexts and are not too frequent among the texts with followed entities
alone. Hashes of these candidates are looked up in all texts, by a broadcast up to
``sized_broadcast``'s bound and by a shuffle beyond; their counts combine before they are shuffled,
each copy of a text counted as its share of one. Texts are keyed by a 128-bit hash, so a hot group of copies is one key of one small row.

Defined results: null texts are empty; rows repeated in full repeat their spans; a text of white
space has none; words inside base spans are no evidence; an empty table gives an empty result; columns
other than id and text are ignored by ``spans`` and kept by ``sanitise``; ties of P or information
at a threshold disclose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.quality import let
from tesserae.runtime import discard, settle, sized_broadcast

KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"[\p{L}\p{N}]++"
CHANCE, SHARE, SMOOTH, WITNESSES, AROUND = 0.5, 0.75, 2.0, 2, 3


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _ip_holds(match: Column) -> Column:
    plain = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(
        F.split(match, r"\."),
        lambda p: (F.length(plain(p)) <= 3) & (F.coalesce(plain(p).try_cast("int"), F.lit(0)) <= 255),
    )


def _luhn(match: Column) -> Column:
    def total(digits: Column) -> Column:
        n = F.length(digits)
        return F.aggregate(
            F.sequence(F.lit(1), n),
            F.lit(0),
            lambda acc, i: let(
                F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1),
                lambda d: acc + d - F.when(d > 9, 9).otherwise(0),
            ),
        )

    return let(_digits(match), lambda d: F.when(F.length(d).between(14, 19), total(d) % 10 == 0).otherwise(False))


def _phone_holds(match: Column) -> Column:
    return F.length(_digits(match)).between(10, 15)


def _prefix(values: Column, zero: Column, join) -> Column:
    """Running ``join`` of an array, each element included, in blocks of sqrt(n)."""

    def run(xs: Column, first: Column) -> Column:
        none = F.filter(F.array(zero), lambda _: F.lit(False))
        step = lambda acc, x: F.concat(acc, F.array(join(F.coalesce(F.try_element_at(acc, F.lit(-1)), first), x)))
        return F.aggregate(xs, none, step)

    def whole(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        starts = F.sequence(F.lit(1), F.size(v), width)
        blocks = F.transform(starts, lambda at: run(F.slice(v, at, width), zero))

        def joined(inner: Column) -> Column:
            ahead = run(F.transform(inner, lambda b: F.element_at(b, -1)), zero)
            return let(
                ahead,
                lambda a: F.flatten(
                    F.transform(
                        inner, lambda b, k: F.transform(b, lambda x: F.when(k == 0, x).otherwise(join(F.get(a, k - 1), x)))
                    )
                ),
            )

        return F.when(F.size(v) > 0, let(blocks, joined)).otherwise(F.filter(F.array(zero), lambda _: F.lit(False)))

    return let(values, whole)


def located(text: Column, pattern: str, shape, keep=None) -> Column:
    """Array of ``shape(start, end, match)`` over the matches that ``keep``; code points, end exclusive."""

    def walk(gaps: Column, hits: Column) -> Column:
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))

        def placed(ends: Column) -> Column:
            kept = F.sequence(F.lit(0), F.size(hits) - 1)
            if keep is not None:
                kept = F.filter(kept, lambda i: keep(hits[i]))
            return F.transform(kept, lambda i: shape(ends[i] - F.length(hits[i]), ends[i], hits[i]))

        return let(_prefix(sizes, F.lit(0), lambda x, y: x + y), placed)

    none = F.filter(F.array(shape(F.lit(0), F.lit(0), F.lit(""))), lambda _: F.lit(False))
    return let(
        F.regexp_extract_all(text, F.lit(pattern), 0),
        lambda hits: F.when(
            F.size(hits) > 0, let(F.split(text, pattern, -1), lambda gaps: walk(gaps, hits))
        ).otherwise(none),
    )


def _matches(text: Column, shape) -> list[Column]:
    """For each kind the array of ``shape(kind, start, end, match)`` of its matches; ``text`` is not null."""

    def of(kind: int, pattern: str, maybe: Column, keep=None) -> Column:
        own = lambda start, end, match: shape(F.lit(kind), start, end, match)
        none = F.filter(F.array(own(F.lit(0), F.lit(0), F.lit(""))), lambda _: F.lit(False))
        return F.when(maybe, located(text, pattern, own, keep)).otherwise(none)

    return [
        of(0, EMAIL, F.contains(text, F.lit("@"))),
        of(1, IP, text.rlike(r"[0-9]\.[0-9]"), _ip_holds),
        of(2, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), _luhn),
        of(3, PHONE, F.contains(text, F.lit("+")), _phone_holds),
    ]


def base_spans(text: Column) -> Column:
    """Sorted array of struct(start, kind, end), kind as a place in KINDS; ``text`` is not null."""
    shape = lambda kind, start, end, _: F.struct(start.alias("start"), kind.alias("kind"), end.alias("end"))
    return F.sort_array(F.concat(*_matches(text, shape)))


def _replaced(text: Column, found: Column, labels: Column) -> Column:
    """``text`` with the sorted spans ``found`` replaced by ``labels[kind]``; spans that overlap become one.

    A block of sqrt(n) spans is cut out of the text first and its pieces out of the block, since a
    substring costs its distance from the beginning."""

    def pieces(ends: Column) -> Column:
        n = F.size(found)
        width = F.ceil(F.sqrt(n)).cast("int")

        def block(first: Column) -> Column:
            last = F.least(first + width, n) - 1
            begin = F.when(first == 0, 0).otherwise(F.get(ends, first - 1))
            part = F.substring(text, begin + 1, F.get(ends, last) - begin)

            def cut(p: Column) -> Column:
                def one(i: Column) -> Column:
                    ahead = F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
                    plain = F.substring(p, ahead - begin + 1, found[i]["start"] - ahead)
                    return F.when(found[i]["start"] >= ahead, F.concat(plain, labels[found[i]["kind"]])).otherwise("")

                return F.array_join(F.transform(F.sequence(first, last), one), "")

            return let(part, cut)

        told = F.transform(F.sequence(F.lit(0), n - 1, width), block)
        rest = F.substring(text, F.element_at(ends, -1) + 1, F.length(text))
        return F.array_join(F.concat(told, F.array(rest)), "")

    ends = _prefix(F.transform(found, lambda s: s["end"]), F.lit(0), lambda x, y: F.greatest(x, y))
    return F.when(F.size(found) > 0, let(ends, pieces)).otherwise(text)


def _entities(text: Column) -> Column:
    """Hashes of the distinct normalised matches."""

    def entity(kind: Column, start: Column, end: Column, match: Column) -> Column:
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        number = F.when(kind == 1, F.array_join(parts, ".")).otherwise(_digits(match))
        return F.xxhash64(kind, F.when(kind == 0, F.lower(match)).otherwise(number))

    return F.array_distinct(F.concat(*_matches(text, entity)))


def _words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: F.xxhash64(F.lower(w)))


def _pair(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _terms(text: Column) -> Column:
    """Hashes of the distinct words and pairs of neighbouring words."""
    pairs = lambda w: F.transform(w, lambda x, i: F.when(i > 0, _pair(F.get(w, i - 1), x)))
    return let(_words(text), lambda w: F.array_compact(F.array_distinct(F.concat(w, pairs(w)))))


def _in_context(text: Column) -> Column:
    """struct(t, at, c): terms, their places and a hash of the words before and after each."""

    def all_of(w: Column) -> Column:
        ahead = lambda i: F.slice(w, F.greatest(i - AROUND, F.lit(0)) + 1, F.least(i, F.lit(AROUND)))
        told = lambda t, i, j: F.struct(t.alias("t"), i.alias("at"), F.xxhash64(ahead(i), F.lit(0), F.slice(w, j + 2, F.lit(AROUND))).alias("c"))
        single = F.transform(w, lambda x, i: told(x, i, i))
        double = F.transform(w, lambda x, i: F.when(i > 0, told(_pair(F.get(w, i - 1), x), F.greatest(i - 1, F.lit(0)), i)))
        return F.array_compact(F.concat(single, double))

    return let(_words(text), all_of)


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(t.alias("t")).select("t", F.xxhash64("t").alias("k1"), F.xxhash64(F.lit(1), "t").alias("k2"))


def disclosing(docs: DataFrame, text_col: str = "text") -> DataFrame | None:
    """``(k1, k2, tells)``: for each text that holds disclosing terms, their hashes; None if no term can be one."""
    texts = _keyed(docs, text_col)
    scratch: list[DataFrame] = []
    told = texts.select("k1", "k2", F.explode(_entities(F.col("t"))).alias("e"))
    held = settle(told, "privacy-entities", scratch)
    rare = held.distinct().groupBy("e").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= WITNESSES)
    spread = settle(rare, "privacy-spread", scratch)
    if spread.isEmpty():
        discard(scratch)
        return None
    follow = settle(held.distinct().join(sized_broadcast(spread), "e"), "privacy-followed", scratch)
    wanted = settle(follow.select("k1", "k2").distinct(), "privacy-wanted", scratch)
    near = texts.join(sized_broadcast(wanted), ["k1", "k2"])
    blank = F.array(*[F.lit("\n")] * len(KINDS))
    near = near.withColumn("t", let(base_spans(F.col("t")), lambda b: _replaced(F.col("t"), b, blank)))
    seen = near.select("k1", "k2", F.inline(_in_context(F.col("t"))))
    seen = settle(seen.groupBy("k1", "k2", "t").agg(F.min(F.struct("at", "c")).alias("first")), "privacy-seen", scratch)
    # texts with any followed entity already hold some terms too often: they need no count over all texts
    beside = seen.groupBy("t").agg(F.count("*").alias("n_beside"))
    together = follow.join(seen, ["k1", "k2"]).groupBy("e", "n_e", "t", "first.c").agg(F.count("*").alias("n"))
    together = together.groupBy("e", "n_e", "t").agg(F.count("*").alias("witnesses")).filter(F.col("witnesses") >= WITNESSES)
    together = together.join(beside, "t").filter(F.col("witnesses") >= (F.col("n_beside") + SMOOTH) * CHANCE)
    together = settle(together, "privacy-together", scratch)
    candidates = settle(together.select("t").distinct(), "privacy-candidates", scratch)
    copies = settle(texts.groupBy("k1", "k2").agg(F.count("*").alias("copies")).filter("copies > 1"), "privacy-copies", scratch)
    weighed = texts.join(sized_broadcast(copies), ["k1", "k2"], "left").withColumn("part", 1 / F.coalesce("copies", F.lit(1)))
    every = weighed.select("part", F.explode(_terms(F.col("t"))).alias("t")).join(sized_broadcast(candidates), "t")
    counts = every.groupBy("t").agg(F.round(F.sum("part")).alias("n_t"))  # copies of a text add up to one
    total = texts.select("k1", "k2").distinct().agg(F.count("*").alias("total"))
    chance = F.col("witnesses") / (F.col("n_t") + SMOOTH)
    content = F.log2(F.col("total") / F.col("n_e"))
    shared = F.log2(chance * F.col("total") / F.col("n_e"))
    telling = (
        together.join(counts, "t")
        .join(F.broadcast(total))  # one row
        .filter((chance >= CHANCE) & (content > 0) & (shared >= content * SHARE))
        .select("t")
        .distinct()
    )
    telling = settle(telling, "privacy-telling", scratch)
    tells = None
    if not telling.isEmpty():
        found = texts.select("k1", "k2", F.explode(_terms(F.col("t"))).alias("t")).join(sized_broadcast(telling), "t")
        tells = settle(found.groupBy("k1", "k2").agg(F.collect_set("t").alias("tells")), "privacy-tells")
    discard(scratch)
    return tells


def _term_spans(text: Column, tells: Column) -> Column:
    """Spans of the words whose hash is among ``tells``, and of such pairs of other words."""
    shape = lambda start, end, m: let(
        F.xxhash64(F.lower(m)),
        lambda t: F.struct(t.alias("t"), start.alias("start"), end.alias("end"), F.array_contains(tells, t).alias("told")),
    )
    span = lambda start, end: F.struct(start.alias("start"), F.lit(4).alias("kind"), end.alias("end"))

    def of(w: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.get(w, i - 1)
            pair = (i > 0) & ~before["told"] & F.array_contains(tells, _pair(before["t"], x["t"]))
            return F.when(x["told"], span(x["start"], x["end"])).when(pair, span(before["start"], x["end"]))

        return F.array_compact(F.transform(w, one))

    return let(located(text, WORD, shape), of)


def _marked(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``__base`` and ``__terms``, sorted arrays of struct(start, kind, end)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    with_base = docs.withColumn("__base", base_spans(text))
    none = F.filter("__base", lambda _: F.lit(False))
    tells = disclosing(docs, text_col)
    if tells is None:
        return with_base.withColumn("__terms", none)
    tells = tells.withColumnsRenamed({"k1": "__k1", "k2": "__k2", "tells": "__tells"})
    keyed = with_base.withColumns({"__k1": F.xxhash64(text), "__k2": F.xxhash64(F.lit(1), text)})
    joined = keyed.join(sized_broadcast(tells, 20_000), ["__k1", "__k2"], "left")
    terms = F.when(F.col("__tells").isNotNull(), F.sort_array(_term_spans(text, F.col("__tells"))))
    return joined.withColumn("__terms", F.coalesce(terms, none)).drop("__k1", "__k2", "__tells")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, base, terms)`` per row: sorted arrays of struct(start, kind, end)."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))
    return _marked(slim, "t").select("id", F.col("__base").alias("base"), F.col("__terms").alias("terms"))


def _told(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return spans(docs).select(
        F.col("id").alias("doc_id"),
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])),
        F.sha2(_told(F.col("base")), 256).alias("base_sha256"),
        _told(F.sort_array(F.concat("base", "terms"))).alias("spans"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span in ``text_col`` generalised to its kind in brackets; spans that
    overlap become one. A null text stays null."""
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    t = F.col(f"`{text_col}`")
    clean = let(F.sort_array(F.concat("__base", "__terms")), lambda found: _replaced(t, found, labels))
    made = F.when(t.isNotNull(), clean)
    return _marked(docs, text_col).select(*[made.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
