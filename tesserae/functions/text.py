"""Text functions as Column expressions: tokens, numbers, claims, citations, question classes.

Everything here is Catalyst; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words, patterns, scales.
STOP_WORDS = (
    "a an and are as at be but by for from has have he her his i if in into is it its of on or our she so than that "
    "the their them then there these they this to was we were what when where which who will with you your do does "
    "did can could should would how"
).split()
TOKEN = r"(?U)\w+(?:[-./']\w+)*"
THOUSANDS = r"(?U)(?<=\d),(?=\d{3}\b)"
CAMEL = r"(?<=[a-z0-9])(?=[A-Z])"
CITATION = r"(?U)\[\s*(S?\d+(?:\s*[,;]\s*S?\d+)*)\s*\]"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9(*\"'])|(?<=\])\s+(?=[A-Z0-9(*\"'])"
QUOTE_END = r"(?<=[.!?])\s+(?!\[)|(?<=\])\s+(?=[A-Z0-9(*\"'])|\n+"
LIST_MARK = r"^\s*(?:[-*•]|\d+[.)])\s+"
TABLE_RULE = r"^\s*\|?\s*:?-{2,}"
NUMBER = (
    r"(?U)(?<![\w.])[-+]?[$€£¥₹]?\d[\d,]*(?:\.\d+)?\s*(?:%|percent|million|billion|thousand|[kKmMbB]\b)?"
)
SCALES = {"thousand": 1e3, "k": 1e3, "million": 1e6, "m": 1e6, "billion": 1e9, "b": 1e9}
NEGATION = r"(?i)\b(not|never|no|none|neither|nor|without|cannot|nobody|nothing)\b|n't\b"
FOLLOW_UP = (
    r"(?i)\b(it|its|they|them|their|those|these|that|this|he|she|his|her|same|above|previous|earlier|former|latter|"
    r"last one|the other)\b|^(and|also|what about|how about|why|so|then|now|ok(ay)?|compare|same)\b"
)
AGGREGATE = (
    r"(?i)\b(how many|how much|total|sum|average|avg|mean|median|count|number of|max(imum)?|min(imum)?|highest|lowest|"
    r"largest|smallest|most|least|top \d*|bottom|rank|per (region|product|month|quarter|year|customer|category)|"
    r"by (region|product|month|quarter|year|customer|category)|group|breakdown|distribution|percentage|share|growth|"
    r"trend|compare .* (sales|revenue)|missed|exceed|above|below|greater than|less than|between|sorted|list all|"
    r"which .* (had|have))\b"
)
VISION = (
    r"(?i)\b(chart|graph|plot|figure|fig\.?|image|picture|photo|screenshot|dashboard|diagram|visual|scan(ned)?|logo|"
    r"drawing|slide image)\b"
)
CODE = (
    r"(?i)\b(code|function|method|class|bug|error|exception|implement(ation|ed)?|variable|return(s)?|parameter|"
    r"argument|module|api|refactor|pagination|algorithm|loop|call(s|ed)?)\b|\w+\(\)|`[^`]+`"
)
COMPARE = (
    r"(?i)\b(compare|comparison|difference|differ|vs\.?|versus|across|both|each (document|file)|all (the )?"
    r"(documents|files)|conflict|disagree|consistent|contradict)\b"
)
SUMMARY = (
    r"(?i)\b(summari[sz]e|summary|overview|key (points|takeaways)|tl;?dr|what is (this|the) (document|file) about|"
    r"main points)\b"
)
CHITCHAT = r"(?i)^\s*(hi|hello|hey|thanks|thank you|ok|okay|good (morning|evening))\W*$"
CONNECTOR = r"(?i)\b(and also|as well as|and then|additionally|plus|respectively)\b|;"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def stem(token: Column) -> Column:
    """Light plural stemming of letter-only tokens longer than four characters."""
    n = F.length(token)
    plain = (n > 4) & token.rlike(r"^\p{L}+$")
    # the cheap tests first: most tokens are short or end otherwise
    return (
        F.when((n <= 4) | ~token.endswith("s"), token)
        .when(plain & token.endswith("ies"), F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y")))
        .when(plain & token.endswith("s") & ~token.rlike("(ss|us|is)$"), F.substring(token, F.lit(1), n - 1))
        .otherwise(token)
    )


def tokens(text: Column | str) -> Column:
    """Array of search tokens, in order: words whole and in parts, without stop words, stemmed."""
    def expand(raw: Column) -> Column:
        parts = F.filter(F.split(F.regexp_replace(raw, CAMEL, "_"), "[-./_']"), lambda p: p != "")
        whole = let(parts, lambda p: F.when(F.size(p) == 1, F.array(raw)).otherwise(F.concat(F.array(raw), p)))
        return F.when(raw.rlike(r"[-./_']|[a-z0-9][A-Z]"), whole).otherwise(F.array(raw))

    words = F.regexp_extract_all(F.regexp_replace(col(text), THOUSANDS, ""), F.lit(TOKEN), 0)
    low = F.transform(F.flatten(F.transform(words, expand)), F.lower)
    kept = F.filter(
        low, lambda t: ~t.isin(*STOP_WORDS) & ((F.length(t) > 1) | t.rlike(r"^\p{Nd}$"))
    )
    return F.transform(kept, stem)


def term_index(token: Column | str) -> Column:
    return F.crc32(col(token).cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF)).cast("long")


def estimate_tokens(text: Column | str) -> Column:
    """One token for 3.2 code points, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.char_length(col(text)) / F.lit(3.2))).cast("int")


def strip_citations(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(col(text), CITATION, ""), r"\s+([.,;:!?])", "$1"))


def cited_ids(text: Column | str) -> Column:
    """Source numbers in the order they are cited."""
    groups = F.regexp_extract_all(col(text), F.lit(CITATION), 1)
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, "[,;]")))
    return F.transform(parts, lambda p: F.regexp_replace(F.trim(p), "^[Ss]+", "").try_cast("int"))


def canonical(value: Column) -> Column:
    """Integers without a fraction; else six significant digits, without trailing zeros."""
    power = F.floor(F.log10(F.abs(value))).cast("int")
    factor = F.pow(F.lit(10.0), F.greatest(F.lit(0), F.lit(5) - power))
    rounded = F.rint(value * factor) / factor
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.12f", rounded), "0+$", ""), r"\.$", "")
    return F.when(value == F.floor(value), F.format_string("%.0f", value)).otherwise(plain)


def numbers(text: Column | str) -> Column:
    """Set of canonical numbers in a text, as written and scaled by their unit."""
    found = F.regexp_extract_all(strip_citations(text), F.lit(NUMBER), 0)
    scale = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])

    def forms(raw: Column) -> Column:
        raw = F.trim(raw)
        unit = F.lower(F.regexp_extract(raw, r"(%|percent|million|billion|thousand|[kKmMbB])$", 1))
        value = F.regexp_replace(raw, r"[^0-9.\-]", "").try_cast("double")
        factor = F.when(unit != "", F.try_element_at(scale, unit))
        return let(
            value,
            lambda v: F.array_compact(F.array(canonical(v), F.when(factor.isNotNull(), canonical(v * factor)))),
        )

    return F.array_distinct(F.flatten(F.transform(found, forms)))


def is_factual(claim: Column | str) -> Column:
    """Has four words or a number, and does not end in a colon."""
    plain = strip_citations(claim)
    words = F.size(F.array_remove(F.split(plain, r"\s+"), ""))
    return ((words >= 4) | (F.size(numbers(plain)) > 0)) & ~plain.endswith(":")


def negated(text: Column | str) -> Column:
    return col(text).rlike(NEGATION)


def negation_mismatch(a: Column | str, b: Column | str) -> Column:
    return negated(a) != negated(b)


def term_coverage(claim_tokens: Column, source_tokens: Column) -> Column:
    """Share of the claim's distinct terms found in the source; 0 for a claim without terms."""
    n = F.size(F.array_distinct(claim_tokens))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(claim_tokens, source_tokens)) / n)


def is_year(number: Column | str) -> Column:
    return col(number).rlike("^(19|20)..$")


def split_claims(text: Column | str) -> Column:
    """Sentences, bullet items and table rows of an answer."""

    def units(line: Column) -> Column:
        bare = F.regexp_replace(line, LIST_MARK, "")
        cut = F.filter(F.transform(F.split(bare, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")
        return F.when(line.startswith("|"), F.array(line)).otherwise(cut)

    lines = F.transform(F.split(col(text), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.flatten(F.transform(F.filter(lines, lambda x: (x != "") & ~x.rlike(TABLE_RULE)), units))


def sentences(text: Column | str) -> Column:
    """Candidate sentences for a quote."""
    cut = F.transform(F.split(col(text), QUOTE_END), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(cut, lambda s: F.length(s) > 3)


def is_followup(question: Column | str, turns_before: Column) -> Column:
    q = col(question)
    short = F.size(F.array_remove(F.split(q, r"\s+"), "")) <= 5
    return (turns_before > 0) & (q.rlike(FOLLOW_UP) | short)


def is_multi_part(question: Column | str) -> Column:
    q = col(question)
    words = F.size(F.array_remove(F.split(q, r"\s+"), ""))
    return (words > 14) & ((F.regexp_count(q, F.lit(r"\?")) > 1) | q.rlike(CONNECTOR))


def intent(question: Column | str, has_table: Column, has_code: Column, has_vision: Column) -> Column:
    """summary > compare > table > code > vision > lookup; chit-chat before all."""
    q = col(question)
    return (
        F.when(q.rlike(CHITCHAT), "chitchat")
        .when(q.rlike(SUMMARY), "summary")
        .when(q.rlike(COMPARE), "compare")
        .when(has_table, "table")
        .when(has_code, "code")
        .when(has_vision, "vision")
        .otherwise("lookup")
    )


def is_not_found(text: Column | str) -> Column:
    return col(text).rlike(r"^\W*NOT[_ ]FOUND\b")


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), col(x)))))


def reflow(text: Column | str) -> Column:
    """Joins hyphenated line ends, then lines."""
    joined = F.regexp_replace(col(text), r"(?U)(\w)-\n(\p{Ll})", "$1$2")
    return F.trim(F.regexp_replace(joined, r"\s*\n\s*", " "))


def numbered(text: Column | str, first: Column | int = 1) -> Column:
    """Lines with right-aligned line numbers."""
    first = F.lit(first) if isinstance(first, int) else first
    rows = F.transform(
        F.split(col(text), "\n"), lambda line, i: F.concat(F.lpad((first + i).cast("string"), 4, " "), F.lit(" | "), line)
    )
    return F.array_join(rows, "\n")


def parse_number(text: Column | str) -> Column:
    """Numbers written as text: currency signs, thousands, percent signs, brackets for negative."""
    t = F.trim(F.regexp_replace(col(text).cast("string"), " ", " "))
    tight = F.regexp_replace(t, " ", "")
    shaped = tight.rlike(r"^\(?-?[$€£¥₹]?\s*-?[\d,]*\.?\d+\s*%?\)?$")
    plain = F.regexp_replace(t, r"[()$€£¥₹,%\s]", "").try_cast("double")
    return F.when(shaped, F.when(t.startswith("(") & t.endswith(")"), -plain).otherwise(plain))


def is_total_label(text: Column | str) -> Column:
    return F.coalesce(col(text).cast("string").rlike(r"(?i)^\s*(grand\s+|sub-?)?totals?\b"), F.lit(False))


def extract_json(text: Column | str) -> Column:
    """The first object or list in a model's reply, without fences and thoughts; null if there is none."""
    bare = F.regexp_replace(col(text), r"(?s)<think>.*?</think>", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner)


def safe_filename(name: Column | str) -> Column:
    """Last path element without characters that file systems reserve, at most 120 characters."""
    base = F.regexp_extract(F.regexp_replace(col(name), r"\\", "/"), r"([^/]*)$", 1)
    clean = F.regexp_replace(F.regexp_replace(base, r'[<>:"|?*\x00-\x1f]', "_"), r"^[\s.]+|[\s.]+$", "")
    reserved = clean.rlike(r"(?i)^(con|prn|aux|nul|com\d|lpt\d)(\..*)?$")
    named = F.when(clean == "", "file").when(reserved, F.concat(F.lit("_"), clean)).otherwise(clean)
    return F.substring(named, 1, 120)


def markdown_escape(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"([\\`*_{}\[\]()#+!|$~<>-])", r"\\$1")


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def location(page_start, page_end, approx, fmt, line_start, line_end, sheet) -> Column:
    """Where a chunk stands: page, pages, slide, lines or sheet."""
    one = F.when(col(fmt) == "pptx", F.concat(F.lit("slide "), col(page_start).cast("string")))
    mark = F.when(col(approx), F.lit("≈p.")).otherwise(F.lit("p."))
    pages = F.concat(
        mark,
        col(page_start).cast("string"),
        F.when(col(page_end) > col(page_start), F.concat(F.lit("-"), col(page_end).cast("string"))).otherwise(""),
    )
    return F.coalesce(
        F.when(col(page_start).isNotNull(), F.coalesce(one, pages)),
        F.when(
            col(line_start).isNotNull(),
            F.concat(F.lit("L"), col(line_start).cast("string"), F.lit("-"), col(line_end).cast("string")),
        ),
        F.when(col(sheet).isNotNull(), F.concat(F.lit("sheet "), col(sheet))),
        F.lit(""),
    )
