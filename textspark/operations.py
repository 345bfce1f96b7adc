"""Named operations, ``library/operation``: what a client can call, over DataFrames instead of JSON."""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textspark.functions import text as T
from textspark.functions.segmentation import nfkc
from textspark.operators import annotations, answers, generation, index, lexical, linguistics, markov, predictions, reports, search, semantic, similarity, summaries, vectors
from textspark.operators.predictions import MissingModel
from textspark.sources import contracts, transcripts


def _normalize(docs: DataFrame, text_col: str = "text", lowercase: bool = True, ascii_only: bool = False) -> DataFrame:
    out = nfkc(text_col)
    out = F.lower(out) if lowercase else out
    return docs.withColumn(text_col, T.collapse_whitespace(T.drop_non_ascii(out) if ascii_only else out))


def _needs_model(name: str) -> Callable[..., DataFrame]:
    def operation(*_: object, **__: object) -> DataFrame:
        raise MissingModel(f"{name} needs a model; import its vectors or predictions instead")

    return operation


#: library/operation, the function, and what it takes.
OPERATIONS: dict[str, Callable[..., DataFrame]] = {
    "core/text.statistics": reports.text_stats,
    "core/text.normalize": _normalize,
    "core/text.tokenize": T.tokens,
    "core/text.boundaries": summaries.sentences,
    "lexical/lexical.analyze": lexical.enriched_stats,
    "lexical/lexical.keywords": lexical.keywords,
    "lexical/lexical.corpusSearch": search.bm25,
    "lexical/lexical.corpusStats": lexical.corpus_stats,
    "index/index.build": index.chunked,
    "index/index.open": index.loaded,
    "index/index.addDocuments": index.upserted,
    "index/index.removeDocuments": index.removed,
    "index/index.search": index.index_search,
    "index/index.fuzzySearch": index.fuzzy_search,
    "index/index.inspect": index.inspected,
    "index/index.snapshotPlan": index.inspected,
    "retrieval/retrieval.chunk": index.chunked,
    "retrieval/retrieval.rerank": search.overlap_rerank,
    "retrieval/retrieval.search": _needs_model("retrieval.search"),
    "retrieval/retrieval.snapshotPlan": _needs_model("retrieval.snapshotPlan"),
    "embeddings/embeddings.backends": predictions.catalog,
    "embeddings/embeddings.relatedTerms": lexical.related_terms,
    "embeddings/embeddings.semanticSearch": vectors.top_k,
    "embeddings/embeddings.embed": _needs_model("embeddings.embed"),
    "embeddings/embeddings.similarity": _needs_model("embeddings.similarity"),
    "classification/classification.models": predictions.catalog,
    "classification/classification.schema": predictions.catalog,
    "classification/classification.classify": predictions.classify,
    "classification/classification.sentiment": predictions.sentiment,
    "classification/classification.zeroShot": predictions.zero_shot,
    "qa/qa.models": predictions.catalog,
    "qa/qa.answer": answers.imported_answers,
    "qa/qa.answerWithIndex": answers.answer_with_index,
    "qa/qa.answerWithRetrieval": answers.answer_with_retrieval,
    "qa/qa.answerBatch": answers.answered_batch,
    "transcripts/transcripts.parse": transcripts.parse_subtitles,
    "transcripts/transcripts.normalize": contracts.normalized,
    "transcripts/transcripts.importWhisperX": contracts.parse_whisperx,
    "transcripts/transcripts.formatSrt": transcripts.format_srt,
    "transcripts/transcripts.formatWebVtt": transcripts.format_webvtt,
    "transcripts/transcripts.toTextSegments": contracts.text_segments,
    "generation/generation.markovPredict": markov.predict,
    "generation/generation.markovGenerate": markov.generate,
    "generation/generation.perplexity": markov.perplexity,
    "generation/generation.synthesizeTerms": generation.synthesize,
    "generation-linguistics/generationLinguistics.analysisTerms": generation.analysis_terms,
    "generation-linguistics/generationLinguistics.synthesizeFromAnalysis": generation.synthesize,
    "generation-linguistics/generationLinguistics.trainAnalysis": generation.analysis_tokens,
    "linguistics/linguistics.analyze": linguistics.operation_reports,
    "linguistics/linguistics.entities": annotations.decode_entities,
    "linguistics/linguistics.language": linguistics.language_decisions,
    "analysis/analysis.document": reports.document_report,
    "analysis/analysis.corpus": reports.corpus_report,
    "analysis/analysis.similarity": similarity.near_duplicate_pairs,
    "analysis/analysis.semantic-map": semantic.report,
    "analysis/analysis.semantic-corpus": semantic.corpus_semantics,
    "analysis/analysis.stanza-request": linguistics.syntax_request,
}


def schema() -> list[dict[str, object]]:
    """Name, library, and parameters with their defaults of every operation."""
    out = []
    for name, function in sorted(OPERATIONS.items()):
        parameters = {p.name: None if p.default is p.empty else repr(p.default) for p in signature(function).parameters.values() if p.kind is not p.VAR_KEYWORD}
        out.append({"name": name, "library": name.split("/")[0], "parameters": parameters})
    return out


def validate(name: str, options: dict[str, object]) -> None:
    """Raises if there is no such operation or it has no such option."""
    if name not in OPERATIONS:
        library = name.split("/")[0]
        raise ValueError(f"no operation {name}; {library} has {[n for n in describe() if n.startswith(f'{library}/')]}")
    known = signature(OPERATIONS[name]).parameters
    unknown = [] if any(p.kind is p.VAR_KEYWORD for p in known.values()) else sorted(set(options) - set(known))
    if unknown:
        raise ValueError(f"{name} has no option {unknown}")


def describe() -> list[str]:
    return sorted(OPERATIONS)


def dispatch(name: str, *inputs: DataFrame, **options: object) -> DataFrame:
    """Runs an operation by name after validate()."""
    validate(name, options)
    return OPERATIONS[name](*inputs, **options)
