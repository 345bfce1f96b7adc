"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.llm import exact_dedup, mixing, ngram_jaccard, packing, pii, quality_rules, secret_scan, substring_dedup, toxicity, warc
from textspark.llm.common import scratch_path, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op2_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


#: Target weights of the mix; names that are not listed weigh 1.
MIX_WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}


def mix_domain() -> Column:
    """The test corpus has no domain column: its numbered sources fall into four domains."""
    name = F.coalesce("source", F.lit(""))
    return F.concat(F.lit("domain"), ((F.length(name) * 7 + F.ascii(F.right(F.concat(F.lit("0"), name), F.lit(1)))) % 4).cast("string"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mix_domain(), weights=MIX_WEIGHTS)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), scratch_path(spark, "warc")).drop("target_uri", "archive", "start", "end")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_pii_sanitisation": op2_pii_sanitisation,
    "op3_mixing": op3_mixing,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_warc_salvage": op6_warc_salvage,
    "op7_quality_rules": op7_quality_rules,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_toxicity": op10_toxicity,
}

_WORD = r"'[^\x20\x09-\x0D]+'"
_LIST = f"w AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS t FROM documents)"


def _ngram_places(n: int) -> str:
    """Words inside n-grams that a text holds twice or more: (r, place)."""
    return f"""(WITH g AS (SELECT r, i, array_to_string(t[i:i + {n - 1}], ' ') AS g FROM (SELECT r, t, unnest(range(1, len(t) - {n - 2})) AS i FROM w)),
        s AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1) SELECT DISTINCT r, i + unnest(range(0, {n})) AS p FROM s)"""


def _quality_sql() -> str:
    shares = {n: round(100 * share) for n, share in quality_rules.COVERAGE.items()}
    covered = ", ".join(f"c{n} AS (SELECT r, count(*) AS n_words, sum(length(t[p])) AS chars FROM {_ngram_places(n)} JOIN w USING (r) GROUP BY r)" for n in shares)
    joins = " ".join(f"LEFT JOIN c{n} USING (r)" for n in shares)
    columns = ", ".join(f"coalesce(c{n}.chars, 0)::BIGINT AS dup_{n}gram_chars" for n in shares)
    passed = " AND ".join(f"100 * (dup_{n}gram_chars - CASE WHEN n_dup_lines = 1 THEN 2 * dup_line_chars ELSE 0 END) <= {share} * word_chars" for n, share in shares.items())
    return f"""WITH {_LIST}, l AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY k) AS again FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM w) WHERE regexp_matches(line, {_WORD})),
        d AS (SELECT r, count(*) AS n, sum(length(array_to_string(regexp_extract_all(line, {_WORD}), ''))) AS chars FROM l WHERE again > 1 GROUP BY r), {covered},
        m AS (SELECT doc_id, len(t) AS n_words, length(array_to_string(t, '')) AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(d.n, 0) AS n_dup_lines,
          coalesce(c5.n_words, 0) AS n_repeat_words, coalesce(d.chars, 0)::BIGINT AS dup_line_chars, {columns} FROM w LEFT JOIN d USING (r) {joins})
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * dup_line_chars <= 20 * word_chars AND {passed} AS kept FROM m"""


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(sha, {5 * g + 1}, 5))::BIGINT >> {s} & 31)::INT + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))

ORACLE_SQL = {
    "op1_substring_dedup": f"""
        WITH {_LIST}, g AS (SELECT r, i, md5(array_to_string(t[i:i + 34], ' ')) AS g FROM (SELECT r, t, unnest(range(1, len(t) - 33)) AS i FROM w)),
        s AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY g) > 1), c AS (SELECT DISTINCT r, i + unnest(range(0, 35)) AS p FROM s),
        x AS (SELECT r, unnest(t) AS word, generate_subscripts(t, 1) AS p FROM w),
        k AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.p) AS kept FROM x ANTI JOIN c ON x.r = c.r AND x.p = c.p GROUP BY x.r),
        e AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM c), n AS (SELECT r, count(*) AS n, count(*) FILTER (before IS NULL OR before < p - 1) AS spans FROM e GROUP BY r)
        SELECT doc_id, len(t) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(spans, 0) AS n_spans FROM w LEFT JOIN k USING (r) LEFT JOIN n USING (r)
    """,
    "op5_ngram_jaccard_join": f"""
        WITH RECURSIVE {_LIST.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
        q AS (SELECT DISTINCT doc_id, t FROM w), g AS (SELECT DISTINCT doc_id, md5(array_to_string(t[i:i + 4], ' ')) AS g FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 4, 1) + 1)) AS i FROM q WHERE len(t) > 0)),
        z AS (SELECT doc_id, list(g ORDER BY g) AS s, count(*) AS n FROM g GROUP BY doc_id), cl AS (SELECT min(doc_id) AS c, s, n FROM z GROUP BY s, n), cg AS (SELECT c, n, unnest(s) AS g FROM cl),
        f AS (SELECT g FROM cg GROUP BY g HAVING count(*) > 1), o AS (SELECT cg.c, n, g, row_number() OVER (PARTITION BY cg.c ORDER BY d, g) AS k FROM cg JOIN (SELECT g, count(*) AS d FROM cg GROUP BY g) USING (g)),
        pf AS (SELECT c, n, g FROM o SEMI JOIN f USING (g) WHERE k <= n - (75 * n + 99) // 100 + 1), pr AS (SELECT DISTINCT x.c AS a, y.c AS b FROM pf x JOIN pf y ON x.g = y.g AND x.c < y.c AND 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n)),
        sz AS (SELECT c, n, s FROM cl), lk AS (SELECT a, b FROM (SELECT a, b, x.n AS na, y.n AS nb, len(list_intersect(x.s, y.s)) AS i FROM pr JOIN sz x ON a = x.c JOIN sz y ON b = y.c) WHERE 100 * i >= 75 * (na + nb - i)),
        both_ways AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk), reach AS (SELECT c AS a, c AS b FROM cl UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a), root AS (SELECT a AS c, min(b) AS root FROM reach GROUP BY a),
        tx AS (SELECT cl.c, count(DISTINCT d.text) AS k FROM documents d JOIN z USING (doc_id) JOIN cl ON z.s = cl.s GROUP BY cl.c), nl AS (SELECT x.c, (any_value(x.k) - 1 + coalesce(sum(y.k), 0))::BIGINT AS n_links FROM tx x LEFT JOIN both_ways e ON e.a = x.c LEFT JOIN tx y ON y.c = e.b GROUP BY x.c)
        SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(root.root, d.doc_id) AS component_id, coalesce(nl.n_links, 0) AS n_links FROM documents d LEFT JOIN z USING (doc_id) LEFT JOIN cl ON z.s = cl.s LEFT JOIN root ON cl.c = root.c LEFT JOIN nl ON cl.c = nl.c
    """,
    "op6_warc_salvage": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS sha FROM pages), g AS (SELECT h, max(page_id) AS m FROM p GROUP BY h)
        SELECT page_id, strlen(p.h) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = m OR m IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM p JOIN g ON p.h = g.h
    """,
    "op7_quality_rules": _quality_sql(),
    "op3_mixing": mixing.oracle(MIX_WEIGHTS, "'domain' || (length(coalesce(source, '')) * 7 + ascii(right('0' || coalesce(source, ''), 1))) % 4", 60, 2, 1),
    "op8_exact_dedup": """
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS text_sha256 FROM documents) d
        JOIN (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1) g ON d.t = g.t
    """,
}
