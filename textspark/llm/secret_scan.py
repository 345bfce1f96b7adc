"""Secret scan: three patterned kinds, and strings that a randomness test battery finds.

A candidate is a maximal run of 20 or more code points of ``[A-Za-z0-9+/_-]``, and one or two ``=`` after
it if those end it; an ``=`` before a run or inside ``name=value`` only parts runs. From its characters an encoding of k symbols is inferred, and over the symbols' indices three tests run:

* chi-squared uniformity of the alphabet, X = k/L * sum(n_i^2) - L on k - 1 degrees of freedom;
* the runs test on indices below and above the middle of the alphabet;
* the lag-one serial correlation of the indices.

Those three must not reject randomness (Bonferroni over the three at ``alpha``). Passing says little of
a short string, so each candidate also gets a p-value under the opposite hypothesis, that it is written
language in that encoding: X is then about non-central chi-squared, and the non-centrality is L times
the distance of language from uniformity, so that power, and with it the p-value, depends on the
length. Benjamini-Hochberg over the candidates of the whole corpus bounds the share of false finds by
``fdr``; p-values are rounded up to bins of a hundredth of a decade, so its input is one bounded
histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textspark.llm.common import cut, text_or_empty
from textspark.llm.text_spans import joined, listed, located

#: The contract's patterns; hex and access are narrowed to the lengths that pass.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
KINDS = tuple(PATTERNS)
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings, tried in this order: pattern, alphabet, and how far written language is from uniform in
#: it, sum(p_i^2 / u) - 1 with sum(p_i^2) = 0.0655 for the letters of European languages and 0.1 for digits.
ENCODINGS = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", DIGIT + "abcdef", 16 * 0.1 - 1),
    "base32": (r"^[A-Z2-7]+$", UPPER + "234567", 32 * 0.0655 - 1),
    "base36": (r"^(?:[0-9a-z]+|[0-9A-Z]+)$", DIGIT + LOWER, 36 * 0.0655 - 1),
    "base64": (r"", UPPER + LOWER + DIGIT + "+/", 64 * 0.0655 - 1),
}
DEEPEST = 4000  # bins: 40 decades


#: Polynomial of Abramowitz and Stegun 26.2.17, by falling power.
_TAIL = (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530)


def _phi(z: Column) -> Column:
    """The normal distribution function, to a relative error under 0.0001 in the lower tail down to z = -14.

    The upper tail Q(|z|) is the density times a polynomial up to |z| = 3 and a continued fraction of
    Mills' ratio beyond, where an error that is small only in absolute terms would be larger than Q."""

    def upper(x: Column) -> Column:
        near, far = F.lit(0.0), x
        for c in _TAIL:
            near = (near + c) / (1 + 0.2316419 * x)
        for k in range(8, 0, -1):
            far = x + k / far
        return F.exp(-x * x / 2) * 0.3989422804014327 * F.when(x < 3, near).otherwise(1 / far)

    one = F.transform(F.array(z), lambda v: F.struct(v.alias("z"), F.least(F.abs(v), F.lit(14.0)).alias("x")))  # bound once, used often
    return F.get(F.transform(one, lambda v: F.when(v["z"] < 0, upper(v["x"])).otherwise(1 - upper(v["x"]))), F.lit(0))


def battery(token: Column) -> Column:
    """struct(encoding, z_chi, z_runs, z_serial, p_random, bin) of a token: the tests, the corrected
    p-value of randomness, and -100 log10 of the p-value of language, rounded down."""
    body = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    names = list(ENCODINGS)
    case = None
    for k, name in enumerate(names[:-1]):
        test = F.rlike(body, F.lit(ENCODINGS[name][0]))
        case = F.when(test, F.lit(k)) if case is None else case.when(test, F.lit(k))
    code = case.otherwise(F.lit(len(names) - 1))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), code + 1)
    alphabet = pick([ENCODINGS[n][1] for n in names])
    folded = F.when(code == 3, body).when(code == 1, body).otherwise(F.lower(body))
    k, far, n = F.length(alphabet).cast("double"), pick([ENCODINGS[n][2] for n in names]), F.length(folded).cast("double")
    squares = F.aggregate(
        F.sequence(F.lit(1), F.length(alphabet)),
        F.lit(0.0),
        lambda s, i: s + F.pow(n - F.length(F.replace(folded, F.substring(alphabet, i, F.lit(1)), F.lit(""))), F.lit(2.0)),
    )
    chi, nu = k * squares / n - n, k - 1
    z_chi = (F.pow(chi / nu, F.lit(1 / 3)) - (1 - 2 / (9 * nu))) / F.sqrt(2 / (9 * nu))
    indices = F.transform(F.split(folded, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    steps = F.arrays_zip(F.slice(indices, F.lit(1), F.size(indices) - 1).alias("a"), F.slice(indices, F.lit(2), F.size(indices) - 1).alias("b"))
    mean, variance = (k - 1) / 2, (k * k - 1) / 12
    sums = F.aggregate(
        steps,
        F.struct(F.lit(0.0).alias("runs"), F.lit(0.0).alias("product")),
        lambda s, x: F.struct(
            (s["runs"] + ((x["a"] < k / 2) != (x["b"] < k / 2)).cast("double")).alias("runs"),
            (s["product"] + (x["a"] - mean) * (x["b"] - mean)).alias("product"),
        ),
    )
    z_runs = (sums["runs"] + 1 - (n + 1) / 2) / F.sqrt((n - 1) / 4)
    z_serial = sums["product"] / variance / F.sqrt(n - 1)
    worst = F.greatest(z_chi, F.abs(z_runs), F.abs(z_serial))
    p_random = F.least(F.lit(1.0), 6 * _phi(-worst))
    shift = n * far
    p_language = _phi((chi - nu - shift) / F.sqrt(2 * (nu + 2 * shift)))
    depth = F.floor(F.least(-100 * F.log10(F.greatest(p_language, F.lit(1e-40))), F.lit(float(DEEPEST)))).cast("int")
    return F.struct(pick(names).alias("encoding"), z_chi.alias("z_chi"), z_runs.alias("z_runs"), z_serial.alias("z_serial"), p_random.alias("p_random"), depth.alias("bin"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.001) -> DataFrame:
    """id, the base kinds' spans, and ``candidates``: spans with their tests."""
    none = F.array().cast("array<string>")
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    access = F.contains(text, F.lit("AKIA"))
    rows = rows.withColumns(
        {f"_m_{k}": F.when(access if k == "access" else F.lit(True), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, p in PATTERNS.items()}
        | {"_values": F.regexp_extract_all(text, F.lit(PATTERNS["assign"]), F.lit(1)), "_m_candidate": F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))}
    )
    spans = {k: located(text, F.col(f"_m_{k}"), p) for k, p in PATTERNS.items()}
    spans["assign"] = F.filter(spans["assign"], lambda x, i: F.length(F.get("_values", i)) >= 6)
    rows = rows.select("_id", *(spans[k].alias(k) for k in KINDS), located(text, F.col("_m_candidate"), CANDIDATE).alias("_found"))
    base = F.concat(*KINDS)
    apart = F.filter("_found", lambda x: ~F.exists(base, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    rows = rows.withColumn("_apart", apart)
    tested = F.transform("_apart", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), battery(x["match"]).alias("test")))
    return rows.select("_id", *KINDS, tested.alias("candidates"))


def discovery_bin(candidates: DataFrame, alpha: float, fdr: float) -> DataFrame:
    """One row: the least bin that Benjamini-Hochberg declares (null: none). The input's bins are few."""
    bins = candidates.groupBy("bin").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("p_random") >= alpha).alias("n"))
    deeper = bins.alias("a").join(F.broadcast(bins).alias("b"), F.col("b.bin") >= F.col("a.bin"))  # at most DEEPEST bins
    sums = deeper.groupBy("a.bin").agg(F.sum("b.n").alias("found"))
    total = bins.agg(F.sum("all").alias("m"))
    return (
        sums.join(F.broadcast(total))
        .filter(F.pow(F.lit(10.0), -F.col("bin") / 100) * F.col("m") <= fdr * F.col("found"))
        .agg(F.min("bin").alias("least_bin"))
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.001, fdr: float = 0.01) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, n_random, base_spans and all_spans.

    Null texts count as empty and have no spans; texts of any length are scanned whole. A candidate that
    overlaps a base span is left to that span. Repeated rows, equal and null ids get their own answers, and each
    row's candidates count in the discovery rate. Ties of spans go by start, then kind. An empty table gives an
    empty result with the same columns. Other columns of the input, whatever their names, are not looked at.
    """
    rows = cut(scan(docs, id_col, text_col), "secrets")
    tests = rows.select(F.explode("candidates").alias("c")).select("c.test.bin", "c.test.p_random")
    least = discovery_bin(tests, alpha, fdr)
    both = rows.join(F.broadcast(least))  # one row
    random = F.filter("candidates", lambda x: (x["test"]["p_random"] >= alpha) & (x["test"]["bin"] >= F.coalesce(F.col("least_bin"), F.lit(DEEPEST + 1))))
    both = both.withColumn("random", random)
    kinds = [(k, F.col(k)) for k in KINDS]
    return both.select(
        F.col("_id").alias(id_col),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in (*KINDS, "random")),
        joined(kinds).alias("base_spans"),
        joined([*kinds, ("random", F.col("random"))]).alias("all_spans"),
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from find_secrets."""
    return found.select(
        id_col, "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("all_spans")).alias("spans"), "n_random"
    )
