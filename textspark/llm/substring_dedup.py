"""Substring deduplication by De Bruijn compaction.

Every window of k consecutive words is an edge of the corpus's De Bruijn graph, from the node of its
first k - 1 words to that of its last. Edges that occur once are dropped; what is left are the repeated
passages. The graph is built as large assemblers build it:

1. Each text is cut into super-k-mers, runs of consecutive edges with one minimiser (the least hash of
   their m-word windows), so equal edges have equal minimisers wherever they stand. A map task first
   counts edges among its own texts, so a passage that a third of all texts share leaves it once a batch.
2. Super-k-mers go to the bucket of their minimiser as packed arrays, eight bytes an edge. In a bucket,
   edges are equal if minimiser and edge hash are, 64 bits each, so that edges around a common phrase, which
   share its minimiser, are still told apart by 64 bits; an edge that came from two source
   coordinates or more is repeated. Consecutive repeated edges of a super-k-mer whose counts agree share
   a nonbranching node and compact into one path: its text, start and length.
3. A Spark join on the text brings its paths together; paths that meet or overlap in source coordinates
   compact into spans, and the words under them are removed.

Texts that occur more than once are worked on once, and all their edges are repeated. What is shuffled is
about 10 bytes a word, and the texts once, for the removal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textspark.llm import words as W
from textspark.llm.distinct_texts import KEY, copied_texts, keyed, representatives

MINIMISER_WORDS = 8
#: Whole text: the mark of a path over all words of a copied text.
WHOLE = -1


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive entries."""
    done, m = 1, h
    while 2 * done <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    rest = width - done
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def runs_of(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs that begin where breaks is true (its first entry is)."""
    starts = np.flatnonzero(breaks)
    return starts, np.diff(np.append(starts, len(breaks)))


def graph_batch(texts: list[str], k1: np.ndarray, k2: np.ndarray, k: int, buckets: int, hashes: W.HashCache) -> Iterator[tuple[int, bytes]]:
    """Packed (bucket, blob) of the batch's super-k-mers; bucket -1 - b: paths that are known already."""
    found = [W.WORDS.findall(t) for t in texts]
    keep = [i for i, ws in enumerate(found) if len(ws) >= k]
    if not keep:
        return
    a = np.concatenate([hashes.of(found[i]) for i in keep])
    sizes = np.array([len(found[i]) for i in keep])
    k1, k2 = k1[keep], k2[keep]
    del found
    first_word = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    owner = np.repeat(np.arange(len(keep), dtype=np.int32), sizes)
    m = min(MINIMISER_WORDS, k)
    at = np.flatnonzero(owner[: len(a) - k + 1] == owner[k - 1 :])  # windows inside one text
    edge = W.windows(a, k)[at]
    anchor = sliding_min(W.windows(a, m), k - m + 1)[at]
    text, place = owner[at], (at - first_word[owner[at]]).astype(np.int32)
    # edges of this batch, each once
    order = np.argsort(edge, kind="stable")
    s_edge, s_anchor = edge[order], anchor[order]
    fresh = np.concatenate(([True], (s_edge[1:] != s_edge[:-1]) | (s_anchor[1:] != s_anchor[:-1])))
    head, count = runs_of(fresh)
    total = np.empty(len(edge), np.int64)
    total[order] = np.repeat(count, count)
    sent = np.zeros(len(edge), bool)
    sent[order[head]] = True
    twice = np.flatnonzero(total > 1)
    if len(twice):
        t, p, c = text[twice], place[twice], total[twice]
        starts, n = runs_of(np.concatenate(([True], (t[1:] != t[:-1]) | (p[1:] != p[:-1] + 1) | (c[1:] != c[:-1]))))
        yield -1 - int(k1[0] % buckets), _paths(k1[t[starts]], k2[t[starts]], p[starts], n)
    i = np.flatnonzero(sent)
    text, place, anchor, edge = text[i], place[i], anchor[i], edge[i]
    starts, n = runs_of(np.concatenate(([True], (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1) | (anchor[1:] != anchor[:-1]))))
    bucket = (W.mixed(anchor[starts]) % np.uint64(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    edges_by = np.argsort(np.repeat(bucket, n), kind="stable")
    sorted_edges = edge[edges_by]
    cuts, _ = runs_of(np.concatenate(([True], bucket[by][1:] != bucket[by][:-1])))
    edge_at = 0
    for lo, hi in zip(cuts, np.append(cuts[1:], len(by)), strict=True):
        part = by[lo:hi]
        n_edges = int(n[part].sum())
        who, index = np.unique(text[starts[part]], return_inverse=True)
        yield int(bucket[part[0]]), b"".join(
            (
                np.array([len(who), len(part), n_edges], "<i4").tobytes(),
                k1[who].tobytes(),
                k2[who].tobytes(),
                index.astype("<i4").tobytes(),
                place[starts[part]].astype("<i4").tobytes(),
                n[part].astype("<i4").tobytes(),
                anchor[starts[part]].tobytes(),
                sorted_edges[edge_at : edge_at + n_edges].tobytes(),
            )
        )
        edge_at += n_edges


def _paths(k1: np.ndarray, k2: np.ndarray, start: np.ndarray, n: np.ndarray) -> bytes:
    return np.stack([k1.view("<i8"), k2.view("<i8"), start.astype("<i8"), n.astype("<i8")]).tobytes()


def bucket_paths(blobs: list[bytes]) -> Iterator[np.ndarray]:
    """Paths (k1, k2, start, edges) of a bucket's repeated edges."""
    k1, k2, place, n, anchor, edge = [], [], [], [], [], []
    for blob in blobs:
        texts, runs, edges = np.frombuffer(blob, "<i4", 3)
        at = 12
        keys = np.frombuffer(blob, "<u8", 2 * texts, at)
        at += 16 * texts
        ints = np.frombuffer(blob, "<i4", 3 * runs, at).reshape(3, runs)
        at += 12 * runs
        k1.append(keys[ints[0]])
        k2.append(keys[texts + ints[0]])
        place.append(ints[1])
        n.append(ints[2])
        anchor.append(np.frombuffer(blob, "<u8", runs, at))
        edge.append(np.frombuffer(blob, "<u8", edges, at + 8 * runs))
    k1, k2, place, n, anchor, edge = map(np.concatenate, (k1, k2, place, n, anchor, edge))
    run = np.repeat(np.arange(len(n), dtype=np.int32), n)
    anchors = anchor[run]
    order = np.argsort(edge, kind="stable")  # equal edges of different minimisers are not to be expected, and are told apart below
    s_edge, s_anchor = edge[order], anchors[order]
    fresh = np.concatenate(([True], (s_edge[1:] != s_edge[:-1]) | (s_anchor[1:] != s_anchor[:-1])))
    _, count = runs_of(fresh)
    total = np.empty(len(edge), np.int32)
    total[order] = np.repeat(count, count)
    twice = np.flatnonzero(total > 1)
    if len(twice):
        inside = np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n)
        r, p, c = run[twice], inside[twice], total[twice]
        starts, edges = runs_of(np.concatenate(([True], (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1) | (c[1:] != c[:-1]))))
        r = r[starts]
        yield np.stack([k1[r].view("<i8"), k2[r].view("<i8"), place[r].astype("<i8") + p[starts], edges.astype("<i8")])


def repeated_paths(reps: DataFrame, k: int, buckets: int) -> DataFrame:
    """Compacted paths of the texts in reps (rows of _text and KEY): KEY, start and edges."""

    def to_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = W.HashCache()
        for batch in batches:
            for part in W.slices(batch, 0, 4_000_000):
                keys = [part.column(c).to_numpy().view(np.uint64) for c in (1, 2)]
                rows = list(graph_batch(part.column(0).to_pylist(), *keys, k, buckets, hashes))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

    def packed(paths: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in paths], [*KEY, "start", "edges"])

    def in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = blob.as_buffer().to_pybytes()
                if bucket < 0:
                    yield packed(np.frombuffer(data, "<i8").reshape(4, -1))
                    continue
                if bucket != now:
                    for paths in bucket_paths(blobs) if blobs else ():
                        yield packed(paths)
                    now, blobs = bucket, []
                blobs.append(data)
        for paths in bucket_paths(blobs) if blobs else ():
            yield packed(paths)

    sent = reps.select("_text", *KEY).mapInArrow(to_buckets, "bucket int, blob binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(in_buckets, "_k1 bigint, _k2 bigint, start bigint, edges bigint")


def spans_of(paths: list[dict] | None, words: int, k: int) -> list[tuple[int, int]]:
    """Word spans [start, end) under paths, those that meet or overlap as one."""
    if not paths:
        return []
    out: list[list[int]] = []
    for start, edges in sorted((0, words - k + 1) if p["edges"] == WHOLE else (p["start"], p["edges"]) for p in paths):
        if edges <= 0:
            continue
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + edges + k - 1)
        else:
            out.append([start, start + edges + k - 1])
    return [(a, b) for a, b in out]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 35, buckets: int | None = None, with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, n_spans (and kept_text): the words that no
    repeated window covers, joined by a space each.

    Windows are judged on the input. A null text is empty: no words, nothing removed. Texts of fewer than k
    words lose nothing, however often they repeat; rows that repeat a text lose all words of a longer one. Long
    texts are cut whole; there are no ties, as every occurrence goes. Equal and null ids keep their own rows; an
    empty table gives an empty result with the same columns; other columns of the input, whatever their names,
    are not looked at.
    """
    buckets = buckets or max(64, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = keyed(docs, id_col, text_col)
    copied = copied_texts(rows)
    paths = repeated_paths(representatives(rows, copied), k, buckets)
    whole = copied.select(*KEY, F.lit(0).cast("bigint").alias("start"), F.lit(WHOLE).cast("bigint").alias("edges"))
    by_text = (
        paths.unionByName(whole)
        .groupBy(F.col("_k1").alias("_p1"), F.col("_k2").alias("_p2"))
        .agg(F.collect_list(F.struct("start", "edges")).alias("_paths"))  # of one text
    )
    joined = rows.join(by_text, (F.col("_k1") == F.col("_p1")) & (F.col("_k2") == F.col("_p2")), "left").select("_id", "_text", "_paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, 1):
                out: list[list] = [[] for _ in range(5)]
                for text, paths in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = W.WORDS.findall(text)
                    spans = spans_of(paths, len(words), k)
                    kept, at = [], 0
                    for start, end in spans:
                        kept += words[at:start]
                        at = end
                    kept_text = " ".join(kept + words[at:])
                    row = (len(words), len(words) - len(kept) - len(words[at:]), hashlib.sha256(kept_text.encode()).hexdigest(), len(spans), kept_text)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                arrays = [part.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True))]
                yield pa.RecordBatch.from_arrays(arrays[: 5 + with_text], names)

    names = [id_col, "n_words", "n_removed", "kept_sha256", "n_spans"] + ["kept_text"] * with_text
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string, n_spans bigint" + ", kept_text string" * with_text
    return joined.mapInArrow(run, schema)
