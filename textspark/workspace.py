"""A workspace over one folder: documents that can be added and replaced, the index made of them, reports and searches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.operators import index, reports, search
from textspark.sources import contracts


class Workspace:
    """Tables under ``path``, which driver and executors share. A change writes a new version of the documents and
    drops the index, which is built when it is next asked for."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._documents: str | None = None
        self._chunks: str | None = None

    def documents(self) -> DataFrame:
        if self._documents is None:
            return index.index_documents(self.spark.createDataFrame([], "id string, body string"))
        return self.spark.read.parquet(self._documents)

    def ingest(self, rows: DataFrame, shape: str = "documents") -> Workspace:
        """Adds or replaces rows by id: documents (id, text), index documents (id, body), segments (stream_id,
        segment_index, text, start_seconds) or texts (value, ids doc-0 and so on)."""
        if shape == "documents":
            new = index.index_documents(rows, "id", "text")
        elif shape == "index":
            new = index.index_documents(rows)
        elif shape == "segments":
            new = index.from_segments(rows)
        elif shape == "texts":
            new = index.index_documents(rows.select(F.concat(F.lit("doc-"), F.monotonically_increasing_id().cast("string")).alias("id"), "value"), "id", "value")
        else:
            raise ValueError("shape is documents, index, segments or texts")
        return self._replace(self.documents().join(new.select("id"), "id", "left_anti").unionByName(new))

    def remove(self, ids: DataFrame) -> Workspace:
        return self._replace(self.documents().join(ids.select("id"), "id", "left_anti"))

    def _replace(self, docs: DataFrame) -> Workspace:
        target = f"{self.path}/documents-{uuid.uuid4().hex}"
        docs.write.parquet(target)
        self._documents, self._chunks = target, None
        return self

    def chunks(self, size: int = 256, overlap: int = 32) -> DataFrame:
        if self._chunks is None:
            target = f"{self.path}/chunks-{uuid.uuid4().hex}"
            index.chunked(self.documents(), size=size, overlap=overlap).write.parquet(target)
            self._chunks = target
        return self.spark.read.parquet(self._chunks)

    def search(self, queries: DataFrame, options: index.IndexQuery | None = None, **vectors: DataFrame) -> DataFrame:
        return index.index_search(self.chunks(), queries, options or index.IndexQuery.lexical(), **vectors)

    def fuzzy(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        return index.fuzzy_search(self.chunks(), queries, top_k)

    def analyze(self, **layers: DataFrame) -> dict[str, DataFrame]:
        return reports.document_report(self.documents().withColumnRenamed("body", "text"), id_col="id", **layers)

    def corpus(self, **inputs: DataFrame) -> dict[str, DataFrame]:
        return reports.corpus_report(self.documents().withColumnRenamed("body", "text"), id_col="id", **inputs)

    def facets(self, columns: list[str]) -> DataFrame:
        return search.facets(self.documents(), columns)

    def snapshot(self, path: str, chunk_vectors: DataFrame | None = None) -> None:
        empty = self.spark.createDataFrame([], "chunk_id string, vector array<double>")
        index.saved(path, self.documents(), self.chunks(), chunk_vectors if chunk_vectors is not None else empty)


def ingest_stream(segments: DataFrame, workspace: Workspace, checkpoint: str, **trigger: object):
    """Starts a stream of segments into a workspace: final ones are added or replaced in each micro-batch by stream and
    index, so that a batch that is run again changes nothing."""

    def add(batch: DataFrame, _: int) -> None:
        final = batch.filter("is_final").dropDuplicates(["stream_id", "segment_index"])
        if not final.isEmpty():
            workspace.ingest(final, "segments")

    return segments.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def transcript_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents (id, text) of all transcript files under path, normalized."""
    return contracts.joined_texts(contracts.read_normalized(spark, path)).withColumnRenamed("stream_id", "id")
