"""Information-theoretic sanitisation of personal data, in built-in functions only.

Four patterned kinds (email, ip, card, phone) are the protected entities. All counts are of documents:
N all, c(e) those with entity e, c(t) those with term t, c(t, e) those that hold both, wherever they
stand. A term is asked about an entity if it stands within ``context`` code points of it in some document.
How far t gives e away is the share of e's information that t carries,

    disclosure(t; e) = ln(P(e | t) / P(e)) / IC(e),  P(e) = c(e) / N,  IC(e) = -ln P(e),

which is PMI(t; e) over IC(e): 1 where t occurs only with e, near 0 where both are independent. Small counts
are smoothed instead of dropped: P(e | t) = (c(t, e) + prior P(e)) / (c(t) + prior), as if t had been seen in
``prior`` more documents of average kind. So one joint occurrence reaches 1 - ln 2 / IC(e), which passes
a threshold of 0.9 for an entity of one document in 1,024 or less. A term that reaches ``threshold`` becomes
a ``term`` span wherever it stands, in every document, beside e or not. Entities of less than
``min_entity_bits`` bits (public addresses that many documents carry) are not identifying and disclose
nothing.

Scale: one pass finds the entities and their neighbourhoods (pairs are linear in the text), one counts terms
with map-side partial counts. As c(t, e) is at most the lesser of c(t) and c(e), pairs whose bound stays under
the threshold go before anything is joined by document, which leaves terms about as rare as their entity.
Their postings are written once, serve c(t, e), and tell which texts are searched for the spans; bitmaps of
hashes, of at most 16 MiB, keep nearly all other words and texts from being shuffled for that. Keys of the
joins are (entity, term) pairs, terms and documents, so an entity that many documents hold is dealt over
its terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textspark.llm.common import cut, text_or_empty
from textspark.llm.text_spans import SPAN, joined, listed, located

#: The contract's patterns. Look-behinds and possessive runs only spare the matcher starts that cannot
#: match, and recursion on long runs; ``\G`` keeps the start right after the match before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: What a span of a kind is replaced by.
LABELS = {kind: f"[{kind.upper()}]" for kind in (*KINDS, "term")}
TERM = r"\p{L}{4,}+"
PAIR = "array<struct<entity:string,term:string,start:bigint,end:bigint>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when((n - i) % 2 == 1, F.element_at(doubled, digit + 1)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _entity(kind: str, match: Column) -> Column:
    value = _digits(match) if kind in ("card", "phone") else F.lower(match)
    return F.concat(F.lit(f"{kind}:"), value)


def _beside(text: Column, entity: Column, span: Column, context: int) -> Column:
    """The terms wholly inside the neighbourhood of span, with their places in the text.

    Each side is read with one more code point at its outer edge, a blank where the text ends, so that
    the look-around tells a whole word there from one that the edge cuts."""
    start, end = span["start"], span["end"]
    at = F.greatest(start - context, F.lit(0))
    left = F.when(at > 0, F.substring(text, at.cast("int"), (start - at + 1).cast("int"))).otherwise(F.concat(F.lit(" "), F.substring(text, F.lit(1), start.cast("int"))))
    right = F.substring(text, end.cast("int") + 1, F.lit(context + 1))
    right = F.when(F.char_length(right) > context, right).otherwise(F.concat(right, F.lit(" ")))

    def terms(origin: Column, side: Column, pattern: str) -> Column:
        found = located(side, F.regexp_extract_all(side, F.lit(pattern), F.lit(0)), pattern)
        return F.transform(
            found,
            lambda x: F.struct(
                entity.alias("entity"), F.lower(x["match"]).alias("term"), (origin + x["start"]).alias("start"), (origin + x["end"]).alias("end")
            ),
        )

    return F.concat(
        terms(at - 1, left, rf"(?<=\P{{L}}){TERM}"),
        terms(end, right, rf"{TERM}(?=\P{{L}})"),
    )


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = 80) -> DataFrame:
    """id, key (a hash that tells rows of one id apart), an array of spans by kind, and ``pairs``."""
    none = F.array().cast("array<string>")
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    hints = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    rows = rows.withColumns(
        {
            f"_m_{k}": F.when(hints.get(k, F.lit(True)), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none)
            for k, p in PATTERNS.items()
        }
    )

    def valid(kind: str) -> Column:
        return F.filter(located(text, F.col(f"_m_{kind}"), PATTERNS[kind]), lambda x: _valid(kind, x["match"]))

    def beside(kind: str) -> Column:
        return F.flatten(F.transform(kind, lambda x: _beside(text, _entity(kind, x["match"]), x, context)))

    def entities(kind: str) -> Column:
        return F.transform(kind, lambda x: _entity(kind, x["match"]))

    rows = rows.withColumns({k: valid(k) for k in KINDS})
    return rows.select(
        "_id",
        F.xxhash64("_text").alias("_key"),
        *KINDS,
        F.concat(*map(beside, KINDS)).cast(PAIR).alias("pairs"),
        F.array_distinct(F.concat(*map(entities, KINDS))).alias("entities"),
    )


def _disclosure(joint: Column, prior: float) -> Column:
    """The disclosure of joint = c(t, e), from columns n, c_t and c_e."""
    share = F.col("c_e") / F.col("n")
    return F.log((joint + prior * share) / (F.col("c_t") + prior) / share) / F.log(1 / share)


def candidate_terms(docs: DataFrame, base: DataFrame, text_col: str, threshold: float, prior: float, min_entity_bits: float) -> DataFrame:
    """(entity, term, n, c_e, c_t) of the pairs seen beside each other whose counts can reach the threshold."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(text_col)), F.lit(TERM), F.lit(0)))
    terms = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("c_t"))
    entities = base.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("c_e"))
    total = base.agg(F.count(F.lit(1)).cast("double").alias("n"))
    telling = entities.join(F.broadcast(total)).filter(F.log2(F.col("n") / F.col("c_e")) >= min_entity_bits)  # total is one row
    once = F.array_distinct(F.transform("pairs", lambda x: F.struct(x["entity"].alias("entity"), x["term"].alias("term"))))
    pairs = base.select(F.inline(once)).distinct().join(telling, "entity").join(terms, "term")
    return pairs.filter(_disclosure(F.least("c_t", "c_e"), prior) >= threshold - 1e-9).select("entity", "term", "n", "c_e", "c_t")


def among(rows: DataFrame, column: str) -> Column:
    """A test of the column of that name: true for all values in rows, a written table, and for few others. A bitmap of
    hashes has 16 bits to a row, 2**27 at most, and is one row that Spark hands to the tasks with the plan."""
    size = min(max((16 * rows.count() - 1).bit_length(), 12), 27)
    place = F.shiftrightunsigned(F.xxhash64(column), 64 - size)
    word, bit = F.shiftright(place, 6), place.bitwiseAND(63).cast("int")
    some = rows.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("b"))
    all_words = rows.sparkSession.range(1 << size - 6).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b"))
    words = some.unionByName(all_words).groupBy("w").agg(F.bit_or("b").alias("b"))
    bits = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits")).scalar()  # 2**21 words at most
    return F.call_function("shiftrightunsigned", F.get(bits, word.cast("int")), bit).bitwiseAND(1) == 1


def postings(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _key, term, forms, rows): the texts that hold each of terms as a whole word, in which spellings, and
    how many rows bear that id and text."""
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).withColumn("_key", F.xxhash64("_text"))
    words = F.array_distinct(F.regexp_extract_all("_text", F.lit(TERM), F.lit(0)))
    held = texts.select("_id", "_key", F.explode(words).alias("form")).withColumn("term", F.lower("form"))
    held = held.filter(among(terms, "term")).join(terms, "term")
    each = held.groupBy("_id", "_key", "term", "form").agg(F.count(F.lit(1)).alias("rows"))
    return each.groupBy("_id", "_key", "term").agg(F.collect_set("form").alias("forms"), F.max("rows").alias("rows"))  # spellings of one word


def disclosing_terms(base: DataFrame, candidates: DataFrame, held: DataFrame, threshold: float, prior: float) -> DataFrame:
    """(entity, term, c_te, disclosure) of the candidates that reach the threshold."""
    entities = base.select("_id", "_key", F.explode("entities").alias("entity")).distinct()
    entities = entities.select(F.col("_id").alias("_eid"), F.col("_key").alias("_ekey"), "entity")
    asked = held.join(candidates, "term").select("_id", "_key", "rows", "term", F.col("entity").alias("_asked"), "n", "c_e", "c_t")
    meets = (F.col("_key") == F.col("_ekey")) & (F.col("_asked") == F.col("entity")) & F.col("_id").eqNullSafe(F.col("_eid"))
    joint = asked.join(entities, meets).groupBy("entity", "term", "n", "c_e", "c_t").agg(F.sum("rows").alias("c_te"))
    return joint.withColumn("disclosure", _disclosure(F.col("c_te"), prior)).filter(F.col("disclosure") >= threshold).select("entity", "term", "c_te", "disclosure")


def occurrences(docs: DataFrame, held: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _key, start, end) of every place in docs where one of the spellings in held, a postings() table, stands."""
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).withColumn("_key", F.xxhash64("_text"))
    forms = held.groupBy(F.col("_id").alias("_hid"), F.col("_key").alias("_hkey")).agg(F.flatten(F.collect_set("forms")).alias("_forms"))  # at most one text's words
    forms = cut(forms, "pii-forms")
    texts = texts.filter(among(forms.select(F.col("_hkey").alias("_key")), "_key"))
    both = texts.join(forms, F.col("_id").eqNullSafe(F.col("_hid")) & (F.col("_key") == F.col("_hkey")))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("_forms", "|"), F.lit(r")(?!\p{L})"))  # forms are letters
    found = located(F.col("_text"), F.regexp_extract_all("_text", pattern, F.lit(0)), pattern)
    return both.select("_id", "_key", F.explode(found).alias("x")).select("_id", "_key", "x.start", "x.end")


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = 80, threshold: float = 0.9, prior: float = 1.0, min_entity_bits: float = 5.0
) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, n_term, base_spans and all_spans
    (arrays of start, rank, end, kind in code points, sorted by start and kind).

    Null texts count as empty and have no spans. Rows with equal ids, null ids included, keep their own
    spans; rows that repeat id and text count once each in N and all counts. Ties of spans go by start, then
    kind. Texts of any length are searched whole. An empty table gives an empty result with the same columns.
    Other columns of the input, whatever their names, are not looked at. A letter run that an entity's span
    begins inside is a term only up to there.
    """
    base = cut(base_spans(docs, id_col, text_col, context), "pii")
    candidates = cut(candidate_terms(docs, base, text_col, threshold, prior, min_entity_bits), "pii-candidates")
    held = cut(postings(docs, cut(candidates.select("term").distinct(), "pii-asked"), id_col, text_col), "pii-held")
    telling = cut(disclosing_terms(base, candidates, held, threshold, prior).select("term").distinct(), "pii-terms")
    beside = base.select("_id", "_key", F.inline("pairs")).join(telling, "term").select("_id", "_key", "start", "end")
    flagged = (
        beside.unionByName(occurrences(docs, held.join(telling, "term"), id_col, text_col))
        .groupBy(F.col("_id").alias("_fid"), F.col("_key").alias("_fkey"))
        .agg(F.collect_set(F.struct("start", "end")).alias("_terms"))  # at most one text's words
    )
    both = base.join(flagged, F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_key") == F.col("_fkey")), "left")
    terms = F.transform(F.coalesce("_terms", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("").alias("match"))).cast(SPAN)
    entities = F.concat(*KINDS)
    both = both.withColumn("term", F.filter(terms, lambda x: ~F.exists(entities, lambda y: (x["start"] < y["start"]) & (y["start"] < x["end"]))))
    kinds = [(k, F.col(k)) for k in KINDS]
    return both.select(
        F.col("_id").alias(id_col),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in (*KINDS, "term")),
        joined(kinds).alias("base_spans"),
        joined([*kinds, ("term", F.col("term"))]).alias("all_spans"),
        F.col("_key").alias("text_key"),
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from find_personal_data."""
    return found.select(
        id_col, "n_email", "n_ip", "n_card", "n_phone", F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("all_spans")).alias("spans"), "n_term"
    )


def redacted(text: Column, spans: Column) -> Column:
    """text with its spans generalised to their kind's label; of overlapping spans the first holds."""
    labels = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    piece = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))

    def step(acc: Column, x: Column) -> Column:
        ahead = x["start"] >= acc["at"]
        return F.struct(
            F.when(ahead, F.concat(acc["out"], piece(acc["at"], x["start"]), labels[x["kind"]])).otherwise(acc["out"]).alias("out"),
            F.when(ahead, x["end"]).otherwise(acc["at"]).alias("at"),
        )

    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs with personal data and disclosing terms generalised in the text column; other columns unchanged.

    A text without a find, null included, stays as it is; nulls, ties, repeated rows, long texts and empty tables
    are as in find_personal_data. Columns may have any names: they travel in one struct."""
    found = find_personal_data(docs, id_col, text_col, **settings).select(
        F.col(id_col).alias("_sid"), F.col("text_key").alias("_skey"), F.col("all_spans").alias("_spans")
    ).filter(F.size("_spans") > 0).dropDuplicates(["_sid", "_skey"])
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    own = F.col("_row")[text_col]
    both = rows.join(found, F.col("_row")[id_col].eqNullSafe(F.col("_sid")) & (F.xxhash64(F.coalesce(own, F.lit(""))) == F.col("_skey")), "left")
    clean = F.when(F.col("_spans").isNull(), own).otherwise(redacted(own, F.col("_spans")))
    return both.select(*(clean.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns))
