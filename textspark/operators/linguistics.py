"""Linguistic layers on imported tags, trees and scores: token spans and annotation graphs, chunks, contractions,
features, language decisions and routing, tree decoding, checks of imported syntax."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textspark.functions import patterns as P
from textspark.functions import segmentation as S
from textspark.functions import text as T
from textspark.operators.lexical import ranked

# Contractions and the words that treebanks tag for them.
CONTRACTIONS = {
    "de": {
        "am": "an dem", "ans": "an das", "aufs": "auf das", "beim": "bei dem", "durchs": "durch das", "fürs": "für das", "hinterm": "hinter dem", "im": "in dem", "ins": "in das",
        "übers": "über das", "überm": "über dem", "ums": "um das", "unterm": "unter dem", "vom": "von dem", "vorm": "vor dem", "vors": "vor das", "zum": "zu dem", "zur": "zu der",
    },
    "es": {"al": "a el", "del": "de el"},
}
# Universal tags.
UPOS = "ADJ ADP ADV AUX CCONJ DET INTJ NOUN NUM PART PRON PROPN PUNCT SCONJ SYM VERB X".split()
# Operations that a pipeline reports on, by sentence.
OPERATIONS = ("tokens", "pos", "lemmas", "morphology", "dependencies", "chunks", "entities")
NOT_BUILT = ("coreference", "events", "discourse", "topics", "style")
LATIN_LANGUAGES = ("en", "de", "es", "fr", "it", "nl", "pt")


def token_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, token, start, end) in code points; ids tell documents apart. Starts are running sums of the lengths of
    what lies before, over the exploded tokens of a document."""
    text = F.coalesce(text_col, F.lit(""))
    gaps = F.transform(F.split(text, f"(?U){P.TOKEN}", -1), F.length)
    found = F.arrays_zip(T.token_array(text).alias("t"), F.slice(gaps, F.lit(1), F.size(T.token_array(text))).alias("g"))
    rows = docs.select(F.col(id_col), F.posexplode(found).alias("pos", "x")).select(id_col, "pos", F.col("x.t").alias("token"), F.col("x.g").alias("_g"))
    upto = F.sum(F.col("_g") + F.length("token")).over(Window.partitionBy(id_col).orderBy("pos"))
    return rows.select(id_col, "pos", "token", (upto - F.length("token")).alias("start"), upto.alias("end"))


def sentence_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ordinal, start, end) of sentences."""
    rows = docs.select(F.col(id_col), F.posexplode(S.sentence_spans_udf(F.coalesce(text_col, F.lit("")))).alias("ordinal", "s"))
    return rows.select(id_col, "ordinal", F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("end"))


def within(inner: DataFrame, outer: DataFrame, name: str, id_col: str = "doc_id") -> DataFrame:
    """inner's rows with the first of outer's ordinals whose span holds theirs, as ``name``; null without one."""
    spans = outer.select(F.col(id_col).alias("_d"), F.col("ordinal").alias("_o"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    holds = (F.col(id_col) == F.col("_d")) & (F.col("start") >= F.col("_a")) & (F.col("end") <= F.col("_b"))
    return inner.join(spans, holds, "left").groupBy(*inner.columns).agg(F.min("_o").alias(name))


def token_sentences(tokens: DataFrame, sentences: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """tokens with ``sentence``, the last one that begins before the token does, if the token begins inside it. An as-of
    join: sentences and tokens are merged by place, and each token takes the latest sentence."""
    one = tokens.select(id_col, F.col("start").alias("_at"), F.lit(1).alias("_t"), F.struct(*tokens.columns).alias("_row"), F.lit(None).cast("struct<o:int,b:bigint>").alias("_s"))
    two = sentences.select(id_col, F.col("start").alias("_at"), F.lit(0).alias("_t"), F.lit(None).cast(one.schema["_row"].dataType).alias("_row"), F.struct(F.col("ordinal").alias("o"), F.col("end").alias("b")).cast("struct<o:int,b:bigint>").alias("_s"))
    latest = F.last("_s", ignorenulls=True).over(Window.partitionBy(id_col).orderBy("_at", "_t"))
    rows = one.unionByName(two).withColumn("_l", latest).filter("_t = 1")
    return rows.select("_row.*", F.when(F.col("_at") < F.col("_l.b"), F.col("_l.o")).alias("sentence"))


def annotation_graph(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, DataFrame]:
    """tokens, sentences and paragraphs by document with running ids (tokens first, then sentences, then paragraphs);
    tokens name their sentence, the document's first where none holds them, sentences their paragraph."""
    tokens, sentences, paragraphs = token_spans(docs, id_col, text_col), sentence_spans(docs, id_col, text_col), T.paragraph_spans(docs, id_col, text_col)
    n_tokens = tokens.groupBy(id_col).agg(F.count(F.lit(1)).alias("_nt"))
    n_sentences = sentences.groupBy(id_col).agg(F.count(F.lit(1)).alias("_ns"))
    offsets = docs.select(id_col).join(n_tokens, id_col, "left").join(n_sentences, id_col, "left").fillna(0, ["_nt", "_ns"])
    nodes = within(tokens, sentences, "_s", id_col).join(offsets, id_col)
    one = nodes.select(id_col, F.col("pos").cast("bigint").alias("node_id"), "token", "start", "end", F.when(F.col("_ns") > 0, F.coalesce("_s", F.lit(0)) + F.col("_nt")).alias("sentence_id"))
    two = within(sentences, paragraphs, "_p", id_col).join(offsets, id_col).select(id_col, (F.col("ordinal") + F.col("_nt")).alias("node_id"), "start", "end", (F.col("_p") + F.col("_nt") + F.col("_ns")).alias("paragraph_id"))
    three = paragraphs.join(offsets, id_col).select(id_col, (F.col("ordinal") + F.col("_nt") + F.col("_ns")).alias("node_id"), "start", "end")
    return {"tokens": one, "sentences": two, "paragraphs": three}


def node(graph: dict[str, DataFrame], layer: str, node_id: int) -> DataFrame:
    return graph[layer].filter(F.col("node_id") == node_id)


def aligned_subwords(subwords: DataFrame, tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, subword, pos): the tokens that each subword's span overlaps. Empty subwords (special pieces) align with none."""
    spans = tokens.select(F.col(id_col).alias("_d"), "pos", F.col("start").alias("_a"), F.col("end").alias("_b"))
    meets = (F.col(id_col) == F.col("_d")) & (F.col("start") < F.col("_b")) & (F.col("_a") < F.col("end"))
    return subwords.filter("start < end").join(spans, meets).select(id_col, "subword", "pos")


def tokenizer_policy(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """requests (request_id, task, family, language) with ``policy``: of policies (level, key, policy) that of the task,
    else of the model family, the language, else the default one."""
    rows, chosen = requests, []
    for level in ("task", "family", "language"):
        own = policies.filter(F.col("level") == level).select(F.col("key").alias(f"_{level}k"), F.col("policy").alias(f"_{level}"))
        rows = rows.join(F.broadcast(own) if False else own, F.col(level) == F.col(f"_{level}k"), "left")
        chosen.append(F.col(f"_{level}"))
    default = policies.filter("level = 'default'").agg(F.first("policy").alias("_default"))
    return rows.join(F.broadcast(default)).select(*requests.columns, F.coalesce(*chosen, F.col("_default")).alias("policy"))  # one row


def split_contraction(language: Column, word: Column) -> Column:
    """The two words of a contraction, null for others. English clitics keep their host's case; German and Spanish
    ones are looked up."""
    low = F.lower(word)
    table = F.create_map(*(F.lit(x) for lang, words in CONTRACTIONS.items() for form, parts in words.items() for x in (f"{lang}:{form}", parts)))
    host = r"^([\p{L}\p{N}]+)"
    negated = F.regexp_extract(word, rf"{host}([nN]['’][tT])$", 1)
    clitic = rf"{host}(['’](?i:s|m|re|ve|ll|d))$"
    english = (
        F.when(low == "cannot", F.array(F.left(word, F.lit(3)), F.substring(word, 4, 3)))
        .when(negated != "", F.array(negated, F.right(word, F.lit(3))))
        .when(F.rlike(word, F.lit(clitic)), F.array(F.regexp_extract(word, clitic, 1), F.regexp_extract(word, clitic, 2)))
    )
    return F.when(language == "en", english).otherwise(F.split(table[F.concat_ws(":", language, low)], " "))


#: Letters of the tags that make phrases, and the phrases.
_CODES = {"DET": "D", "ADJ": "N", "NOUN": "N", "PROPN": "N", "PRON": "N", "VERB": "V", "AUX": "V", "ADV": "A", "PART": "T", "ADP": "P"}
PHRASES = "P[DN]*|[DN]N*|[VA][VAT]*"


def phrase_chunks(tags: DataFrame, by: list[str]) -> DataFrame:
    """(by, kind, token_start, token_end, head) from tags (by, pos, upos): noun phrases end in their head, the first verb
    heads a verb phrase, the preposition its phrase. A sentence's tags become one letter each, and phrases are
    the leftmost longest runs of a pattern over them."""
    code = F.coalesce(F.create_map(*(F.lit(x) for pair in _CODES.items() for x in pair))[F.col("upos")], F.lit("x"))
    rows = tags.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", code.alias("c")))).alias("_p"))  # one sentence
    rows = rows.select(*by, F.get("_p", F.lit(0))["pos"].alias("_first"), F.array_join(F.transform("_p", lambda x: x["c"]), "").alias("_codes"))
    found, gaps = F.regexp_extract_all("_codes", F.lit(PHRASES), F.lit(0)), F.transform(F.split("_codes", PHRASES, -1), F.length)
    rows = rows.select(*by, "_first", gaps.alias("_g"), F.transform(found, F.length).alias("_n"), F.posexplode(found).alias("_k", "_m"))
    upto = lambda c, k: F.aggregate(F.slice(c, F.lit(1), k), F.lit(0), lambda s, x: s + x)
    start = F.col("_first") + upto(F.col("_g"), F.col("_k") + 1) + upto(F.col("_n"), F.col("_k"))
    end = start + F.length("_m")
    first = F.left("_m", F.lit(1))
    kind = F.when(first == "P", "prepositional").when(first.isin("D", "N"), "noun").otherwise("verb")
    verb = F.instr("_m", "V")
    head = F.when(first == "P", start).when(first.isin("D", "N"), end - 1).otherwise(F.when(verb > 0, start + verb - 1).otherwise(start))
    return rows.select(*by, kind.alias("kind"), start.alias("token_start"), end.alias("token_end"), head.alias("head"))


def features(text: Column) -> Column:
    """Key=Value|Key=Value as a map; '_' and blanks are empty."""
    return F.when(F.coalesce(text, F.lit("_")).isin("_", ""), F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(text, F.lit(r"\|"), F.lit("=")))


def feature_text(values: Column) -> Column:
    """A feature map in its standard form: keys in order, '_' if there are none."""
    pairs = F.array_sort(F.transform(F.map_entries(values), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.when(F.size(pairs) > 0, F.array_join(pairs, "|")).otherwise("_")


def with_feature(values: Column, key: str, value: str) -> Column:
    return F.map_concat(F.map_filter(values, lambda k, _: k != key), F.create_map(F.lit(key), F.lit(value)))


def universal_tag(tag: Column) -> Column:
    return F.when(F.upper(F.trim(tag)).isin(*UPOS), F.upper(F.trim(tag))).otherwise("X")


def relation(deprel: Column) -> Column:
    """struct(base, subtype) of a relation such as nsubj:pass."""
    return F.struct(F.get(F.split(deprel, ":", 2), F.lit(0)).alias("base"), F.get(F.split(deprel, ":", 2), F.lit(1)).alias("subtype"))


def entity_label(label: Column) -> Column:
    """struct(prefix, entity_type) of a piece label: B- or I- before a type, O outside, a bare type inside."""
    inside = F.regexp_extract(label, r"^([BIESLU])-(.+)$", 2)
    return F.struct(
        F.when(label == "O", "O").when(inside != "", F.left(label, F.lit(1))).otherwise("I").alias("prefix"), F.when(label == "O", F.lit(None).cast("string")).when(inside != "", inside).otherwise(label).alias("entity_type")
    )


def primary_subtag(language: Column) -> Column:
    return F.lower(F.get(F.split(F.trim(language), "[-_]"), F.lit(0)))


def stop_words(spark) -> DataFrame:
    """(language, term): the lexicon's stop words, a small fixed table."""
    return spark.createDataFrame([(lang, w) for lang, words in P.STOP_WORDS.items() for w in words], "language string, term string")


def language_decisions(texts: DataFrame, scores: DataFrame, least_words: int = 2, margin: float = 0.25, alternatives: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, status, language, confidence, margin, candidates) from imported language scores (id, language, score).

    A text whose largest script is not Latin is 'unsupported_script'; one of fewer words with a letter than
    least_words is 'too_short'; else the best language is 'detected' if it leads by margin, else 'ambiguous'."""
    text = F.coalesce(text_col, F.lit(""))
    script = T.script_profile(text)["dominant"]
    words = F.size(F.filter(T.token_array(text), lambda t: F.rlike(t, F.lit(r"\p{L}"))))
    top = ranked(scores, [id_col], [F.desc("score"), F.asc("language")], alternatives)
    best = top.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", "language", "score"))).alias("_c"))
    rows = texts.select(F.col(id_col), script.alias("_script"), words.alias("_w")).join(best, id_col, "left")
    first, second = F.get("_c", F.lit(0)), F.get("_c", F.lit(1))
    lead = first["score"] - F.coalesce(second["score"], F.lit(0.0))
    status = (
        F.when(F.col("_script").isNotNull() & (F.col("_script") != "Latin"), "unsupported_script").when((F.col("_w") < least_words) | F.col("_c").isNull(), "too_short").when(lead >= margin, "detected").otherwise("ambiguous")
    )
    known = status.isin("detected", "ambiguous")
    return rows.select(
        id_col, status.alias("status"), F.when(status == "detected", first["language"]).alias("language"), F.when(known, first["score"]).alias("confidence"), F.when(known, lead).alias("margin"),
        F.when(known, F.transform("_c", lambda x: x["language"])).alias("candidates"),
    )


def language_profile(decisions: DataFrame, sentence_decisions: DataFrame, scripts: DataFrame, close: float = 0.12, id_col: str = "doc_id") -> DataFrame:
    """(id, language, status, sentence_languages, is_mixed): a text is mixed if its script is (id, is_mixed), if its
    sentences have several detected languages, or if the runner-up is within ``close``."""
    spoken = sentence_decisions.filter("language IS NOT NULL").groupBy(id_col).agg(F.array_sort(F.collect_set("language")).alias("sentence_languages"))
    rows = decisions.join(spoken, id_col, "left").join(scripts.select(id_col, F.col("is_mixed").alias("_m")), id_col, "left")
    mixed = F.coalesce("_m", F.lit(False)) | F.coalesce(F.size("sentence_languages") > 1, F.lit(False)) | F.coalesce((F.col("margin") <= close) & (F.size("candidates") > 1), F.lit(False))
    return rows.select(id_col, "language", "status", F.coalesce("sentence_languages", F.array().cast("array<string>")).alias("sentence_languages"), mixed.alias("is_mixed"))


def routed(sentence_decisions: DataFrame, decisions: DataFrame, pinned: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, sentence, language, route): the pinned language, else the sentence's, else the document's."""
    whole = decisions.select(id_col, F.col("language").alias("_d"))
    rows = sentence_decisions.select(id_col, "sentence", F.col("language").alias("_s")).join(whole, id_col, "left")
    fixed = F.lit(pinned).cast("string")
    route = F.when(fixed.isNotNull(), "pinned").when(F.col("_s").isNotNull(), "sentence").when(F.col("_d").isNotNull(), "document").otherwise("none")
    return rows.select(id_col, "sentence", primary_subtag(F.coalesce(fixed, F.col("_s"), F.col("_d"))).alias("language"), route.alias("route"))


def operation_reports(routes: DataFrame, producers: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, sentence, operation, support, producer, reason) of every sentence and operation; producers (operation,
    language, support, producer) say what imported layers there are. The list of operations is fixed."""
    rows = routes.select(id_col, "sentence", "language", F.explode(F.array(*map(F.lit, OPERATIONS))).alias("operation"))
    both = rows.join(producers, ["operation", "language"], "left")
    reason = F.when(F.col("support").isNotNull(), F.lit(None).cast("string")).when(F.col("language").isNull(), F.lit("no language")).otherwise(F.concat(F.lit("no layer for "), "language"))
    return both.select(id_col, "sentence", "operation", F.coalesce("support", F.lit("unsupported")).alias("support"), "producer", reason.alias("reason"))


def kept_sentences(layer: DataFrame, reports: DataFrame, operation: str, id_col: str = "doc_id") -> DataFrame:
    """layer's rows (id, sentence) whose sentence's report of the operation is supported or partial."""
    good = reports.filter((F.col("operation") == operation) & F.col("support").isin("supported", "partial")).select(id_col, "sentence")
    return layer.join(good, [id_col, "sentence"], "left_semi")


def syntax_request(routes: DataFrame, sentences: DataFrame, languages: list[str], id_col: str = "doc_id") -> DataFrame:
    """The sentences (id, sentence, text) that a syntax backend for these languages should receive, with their language."""
    return sentences.join(routes.filter(F.col("language").isin(*languages)).select(id_col, "sentence", "language"), [id_col, "sentence"])


def not_built(operation: str) -> None:
    """Operations that no version offers raise."""
    if operation in NOT_BUILT:
        raise NotImplementedError(f"{operation} is not available")
    if operation not in OPERATIONS:
        raise ValueError(f"operations are {OPERATIONS}")


def analysis_quality(layers: dict[str, DataFrame], model_layers: bool, id_col: str = "doc_id") -> DataFrame:
    """(id, confidence, provenance): the mean of all layers' confidences (id, confidence), alignments counting once as
    0.85, 0 without any; Model if a model made a layer, else RuleBased."""
    parts = [df.select(id_col, F.col("confidence").cast("double").alias("c")) for name, df in layers.items() if name != "alignments"]
    if "alignments" in layers:
        parts.append(layers["alignments"].select(id_col).distinct().withColumn("c", F.lit(0.85)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy(id_col).agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("confidence")).withColumn("provenance", F.lit("Model" if model_layers else "RuleBased"))


def innermost(spans: DataFrame, containers: DataFrame, by: str = "sentence_id") -> DataFrame:
    """spans (by, span_id, start, end) with ``container_id``: the narrowest container (by, container_id, start, end) that
    holds it and that it does not hold as well; ties to the smaller id."""
    outer = containers.select(F.col(by).alias("_g"), "container_id", F.col("start").alias("_a"), F.col("end").alias("_b"))
    holds = (F.col(by) == F.col("_g")) & (F.col("start") >= F.col("_a")) & (F.col("end") <= F.col("_b")) & ((F.col("start") > F.col("_a")) | (F.col("end") < F.col("_b")))
    best = F.min(F.struct((F.col("_b") - F.col("_a")).alias("w"), F.col("container_id").alias("c")))
    return spans.join(outer, holds, "left").groupBy(*spans.columns).agg(best.alias("_m")).select(*spans.columns, F.col("_m.c").alias("container_id"))


def roots(spans: DataFrame) -> DataFrame:
    """The outermost of spans that innermost() has placed."""
    return spans.filter("container_id IS NULL")


def cyclic(words: Sequence[int], heads: Sequence[int]) -> list[int]:
    """The words whose way over their heads never ends; it ends at 0 and at a head that is no word. Each word is walked
    over once."""
    head = dict(zip(words, heads, strict=True))
    ends: dict[int, bool] = {0: True}
    for word in words:
        path, at = [], word
        while at not in ends and at in head:
            ends[at] = False  # until its way is known to end
            path.append(at)
            at = head[at]
        if ends.get(at, True):
            ends.update(dict.fromkeys(path, True))
    return [w for w in head if not ends[w]]


def cyclic_udf(words: str, heads: str) -> Column:
    return F.pandas_udf(lambda w, h: pd.Series([cyclic(x.tolist(), y.tolist()) for x, y in zip(w, h, strict=True)]), "array<bigint>")(words, heads)


def syntax_violations(words: DataFrame, by: str = "sentence_id") -> DataFrame:
    """(by, word_id, problem) of imported words (by, word_id, head, start, end): ids from 1 without a hole, heads among
    them or 0 and not the word itself, one root, spans in order, no cycle. A sentence is gathered for the last."""
    order = Window.partitionBy(by).orderBy("word_id")
    whole = Window.partitionBy(by)
    rows = words.withColumns({"_k": F.row_number().over(order), "_n": F.count(F.lit(1)).over(whole), "_roots": F.count_if(F.col("head") == 0).over(whole), "_before": F.lag("start").over(order)})
    trees = words.groupBy(by).agg(F.collect_list("word_id").alias("_w"), F.collect_list(F.coalesce("head", F.lit(0))).alias("_h"))  # one sentence
    caught = trees.select(by, F.explode(cyclic_udf("_w", "_h")).alias("word_id")).select(by, F.col("word_id").cast(words.schema["word_id"].dataType).alias("word_id"), F.lit(True).alias("_cyclic"))
    rows = rows.join(caught, [by, "word_id"], "left")
    rules = {
        "ids have a hole": F.col("word_id") != F.col("_k"), "its head is no word": ~F.col("head").between(0, F.col("_n")), "it is its own head": F.col("head") == F.col("word_id"),
        "not one root": (F.col("_roots") != 1) & (F.col("_k") == 1), "its span goes back": F.col("start") < F.col("_before"), "its span ends before it starts": F.col("end") < F.col("start"), "it is in a cycle": F.col("_cyclic"),
    }
    found = F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items())), lambda p: p.isNotNull())
    return rows.select(by, "word_id", F.explode(found).alias("problem"))


def best_tree(scores: np.ndarray, single_root: bool = True) -> list[int]:
    """Heads of words 1..n (0 is the root) of the arborescence of highest score; scores[d, h] is that of head h for word d.
    With single_root one word alone hangs on the root: every candidate is tried, the best total stays."""

    def arborescence(w: np.ndarray) -> list[int]:
        n = len(w)
        head = [0] + [int(np.argmax(w[d])) for d in range(1, n)]
        color, cycle = [0] * n, []
        for d in range(1, n):
            path, at = [], d
            while at and not color[at]:
                color[at] = d
                path.append(at)
                at = head[at]
            if at and color[at] == d and at in path:
                cycle = path[path.index(at) :]
                break
        if not cycle:
            return head
        inside = set(cycle)
        rest = [v for v in range(n) if v not in inside]
        place = {v: i for i, v in enumerate(rest)}
        c = len(rest)
        small = np.full((c + 1, c + 1), -np.inf)
        into, out = {}, {}
        loop = sum(w[v][head[v]] for v in cycle)
        for d in rest:
            for h in rest:
                if d and d != h:
                    small[place[d], place[h]] = w[d][h]
            if d:
                h = max(cycle, key=lambda v: w[d][v])  # noqa: B023
                small[place[d], c], out[d] = w[d][h], h
        for h in rest:
            v = max(cycle, key=lambda v: w[v][h] - w[v][head[v]])  # noqa: B023
            small[c, place[h]], into[h] = loop + w[v][h] - w[v][head[v]], v
        found = arborescence(small)
        result = list(head)
        for d in rest[1:]:
            h = found[place[d]]
            result[d] = out[d] if h == c else rest[h]
        entry = rest[found[c]]
        result[into[entry]] = entry
        return result

    w = np.array(scores, float)
    n = len(w)
    np.fill_diagonal(w, -np.inf)
    w[0] = -np.inf
    if not single_root or n < 3:
        return arborescence(w)[1:]
    best, total = [], -np.inf
    for r in range(1, n):
        v = w.copy()
        v[1:, 0] = -np.inf
        v[r] = -np.inf
        v[r, 0] = w[r, 0]
        heads = arborescence(v)
        value = sum(w[d, heads[d]] for d in range(1, n))
        if value > total:
            best, total = heads, value
    return best[1:]


def decode_trees(scores: DataFrame, id_col: str = "sentence_id") -> DataFrame:
    """(id, word_id, head) from arc scores (id, dependent, head, score), head 0 the root: one tree a sentence."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(max(rows.dependent.max(), rows["head"].max())) + 1
        w = np.full((n, n), -1e9)
        w[rows.dependent, rows["head"]] = rows.score
        heads = best_tree(w)
        return pd.DataFrame({id_col: rows[id_col].iloc[0], "word_id": range(1, n), "head": heads})

    kind = scores.schema[id_col].dataType.simpleString()
    return scores.groupBy(id_col).applyInPandas(run, f"{id_col} {kind}, word_id int, head int")  # a group is a sentence


def token_tree(words: DataFrame, by: str = "sentence_id") -> DataFrame:
    """(by, token, head_token, deprel, upos, feats) from words (by, word_id, token, head, deprel, upos, feats): of a token's
    words the one whose head lies outside it dominates, the first of several; a head inside is followed out."""
    own = words.select(by, F.col("word_id").alias("_w"), F.col("token").alias("_ht"))
    rows = words.join(own, (words[by] == own[by]) & (words["head"] == own["_w"]), "left").drop(own[by]).drop("_w")
    outside = (F.col("head") == 0) | (F.col("_ht") != F.col("token"))
    best = F.min(F.when(outside, F.struct("word_id", F.when(F.col("head") == 0, F.lit(-1)).otherwise(F.col("_ht")).alias("h"), "deprel", "upos", "feats")))
    return rows.groupBy(by, "token").agg(best.alias("b")).select(by, "token", F.nullif(F.col("b.h"), F.lit(-1)).alias("head_token"), "b.deprel", "b.upos", "b.feats")
