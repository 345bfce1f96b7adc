"""N-gram Jaccard join by T-occurrence search.

Two texts link when their sets of n-word shingles have a Jaccard similarity of at least 3/4 (or another
ratio). A partner of a text of s shingles shares at least T = ceil(3 s / 4) of them, which prunes before
anything is compared, and without loss:

1. Each distinct text becomes its set of 64-bit shingle hashes. Map tasks send packed postings (five bytes
   of hash, two of a batch-local number) to hash buckets; a bucket answers with those that two texts or
   more hold, and with how many hold them. A text of which fewer than T shingles come back has no partner.
2. In the global order of rising document frequency, the first s - T + 1 shingles of two partners must
   meet. Those not shared with anyone come first, so what is left of this prefix is short and rare. Texts
   of one prefix list are joined to the list's first text only, not to each other; the components of these
   stars are blocks, and partners always fall into one block.
3. Within a block every text is a query to an inverted index of the block (DivideSkip): its longest lists
   are set aside, the short ones merged; texts with T less the number of long lists occurrences are probed
   by binary search in the long lists, and those that reach the overlap link. A block too large for one
   task is dealt into chunks, every pair of which is one task. A task returns one row per text, the
   smallest text that it reaches and its number of links, never the pairs.
4. Components of those rows over all tasks are the classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textspark.llm import words as W
from textspark.llm.common import WORD, cut, own, unused
from textspark.llm.components import connected_components
from textspark.llm.distinct_texts import KEY, copied_texts, keyed, representatives

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bits of a hash that a posting carries besides its bucket.
POSTING_BITS = 40
#: Postings that a block's task may hold before the block is dealt into chunks.
MOST_POSTINGS = 3_000_000


class _ByteHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= W.LARGEST_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str, n: int, hashes: _ByteHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles, A-Z in lower case; of a shorter text the whole sequence's."""
    found = _WORDS.findall(text.encode("utf-8", "surrogatepass").lower())  # bytes.lower touches A-Z alone
    if not found:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    if len(a) < n:
        return W.mixed(W.windows(a, len(a)) + np.uint64(len(a)))
    return np.unique(W.windows(a, n))


def required(size: int, percent: int) -> int:
    """The least overlap of a set of ``size`` with any set that links with it."""
    return -(-percent * size // 100)


def _cuts(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return starts, np.append(starts[1:], len(sorted_values))


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], "<i4").tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(data: bytes, *types: str) -> list[np.ndarray]:
    out, at = [], 4 * len(types)
    for n, t in zip(np.frombuffer(data, "<i4", len(types)), types, strict=True):
        out.append(np.frombuffer(data, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def _five(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).ravel()


def _from_five(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = data.reshape(-1, 5)
    return out.view("<u8").ravel()


def text_sets(reps: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """(node, size, ids, prefix) of each text in reps (_id, _text): its number of shingles and, where it may
    have a partner, the shingles that other texts hold too as packed 64-bit ids, rarest first, of which the
    first ``prefix`` must meet those of a partner; else ids is null."""

    def to_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = _ByteHashes(), 0
        for batch in batches:
            for part in W.slices(batch, 1, 4_000_000):
                for start in range(0, part.num_rows, 60_000):  # local numbers have 16 bits
                    number += 1
                    yield sent(part.slice(start, 60_000), number, hashes)

    def sent(part: pa.RecordBatch, number: int, hashes: _ByteHashes) -> pa.RecordBatch:
        nodes = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        sets = [shingles(t, n, hashes) for t in part.column(1).to_pylist()]
        sizes = np.array([len(s) for s in sets], "<i4")
        uid = int(np.frombuffer(xxhash.xxh3_64_digest(f"{TaskContext.get().partitionId()}:{number}"), "<i8")[0])
        h = np.concatenate(sets)
        local = np.repeat(np.arange(len(sets), dtype="<u2"), sizes)
        bucket = (h % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        short = (h // np.uint64(buckets)) & np.uint64((1 << POSTING_BITS) - 1)
        keys, blobs = [-1], [_pack(np.array([uid], "<i8"), nodes, sizes)]
        if len(h):
            for lo, hi in zip(*_cuts(bucket[order]), strict=True):
                at = order[lo:hi]
                keys.append(int(bucket[at[0]]))
                blobs.append(_pack(np.array([uid], "<i8"), local[at], _five(short[at])))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = blob.as_buffer().to_pybytes()
                if bucket < 0:
                    yield answer([(int(_unpack(data, "<i8", "<i8", "<i4")[0][0]), -1, data)])
                    continue
                if bucket != now:
                    if blobs:
                        yield answer(shared(now, blobs))
                    now, blobs = bucket, []
                blobs.append(data)
        if blobs:
            yield answer(shared(now, blobs))

    def answer(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["uid", "bucket", "blob"]
        )

    def shared(bucket: int, blobs: list[bytes]) -> list[tuple[int, int, bytes]]:
        parts = [_unpack(b, "<i8", "<u2", "u1") for b in blobs]
        local, short = np.concatenate([p[1] for p in parts]), _from_five(np.concatenate([p[2] for p in parts]))
        source = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[1]) for p in parts])
        order = np.argsort(short)
        starts, ends = _cuts(short[order])
        df = np.empty(len(short), np.int32)
        df[order] = np.repeat(ends - starts, ends - starts)
        at = np.flatnonzero(df > 1)
        if not len(at):
            return []
        code = np.minimum(8 * np.log2(df[at]), 255).astype(np.uint8)
        out = []
        for lo, hi in zip(*_cuts(source[at]), strict=True):
            i = at[lo:hi]
            out.append((int(parts[source[i[0]]][0][0]), bucket, _pack(local[i], _five(short[i]), code[lo:hi])))
        return out

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, answers = None, None, []
        for batch in batches:
            for uid, bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if uid != now:
                    if table is not None:
                        yield sets(table, answers)
                    now, table, answers = uid, None, []
                data = blob.as_buffer().to_pybytes()
                if bucket < 0:
                    table = data
                else:
                    answers.append((bucket, data))
        if table is not None:
            yield sets(table, answers)

    def sets(table: bytes, answers: list[tuple[int, bytes]]) -> pa.RecordBatch:
        _, nodes, sizes = _unpack(table, "<i8", "<i8", "<i4")
        ids: list[bytes | None] = [None] * len(nodes)
        prefix = np.zeros(len(nodes), np.int32)
        if answers:
            parts = [_unpack(data, "<u2", "u1", "u1") for _, data in answers]
            local = np.concatenate([p[0] for p in parts])
            code = np.concatenate([p[2] for p in parts])
            held = np.concatenate([_from_five(p[1]) | np.uint64(b << POSTING_BITS) for (b, _), p in zip(answers, parts, strict=True)])
            order = np.lexsort((held, code, local))
            for lo, hi in zip(*_cuts(local[order]), strict=True):
                i = int(local[order[lo]])
                size = int(sizes[i])
                least = required(size, percent)
                if hi - lo >= least:
                    ids[i] = held[order[lo:hi]].astype("<u8").tobytes()
                    prefix[i] = size - least + 1 - (size - (hi - lo))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(sizes), pa.array(ids, pa.binary()), pa.array(prefix)], ["node", "size", "ids", "prefix"])

    postings = reps.select("_id", "_text").mapInArrow(to_buckets, "bucket int, blob binary")
    dealt = postings.withColumn("_to", F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("blob"), F.lit(buckets))).otherwise(F.col("bucket")))
    answers = dealt.repartition("_to").sortWithinPartitions("bucket").select("bucket", "blob").mapInArrow(in_buckets, "uid bigint, bucket int, blob binary")
    return answers.repartition("uid").sortWithinPartitions("uid").mapInArrow(to_sets, "node bigint, size int, ids binary, prefix int")


def prefix_stars(sets: DataFrame) -> DataFrame:
    """(a, b): each text with the first text of each of its prefix lists."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column(2).to_numpy()
            lists = [np.frombuffer(x.as_buffer(), "<i8")[:p] for x, p in zip(batch.column(1), prefix, strict=True)]
            ids = np.concatenate(lists) if lists else np.empty(0, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.repeat(batch.column(0).to_numpy(), prefix))], ["id", "node"])

    lists = sets.filter("ids IS NOT NULL").select("node", "ids", "prefix").mapInArrow(entries, "id bigint, node bigint")
    first = lists.groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("_last")).filter("b < _last").select("id", "b")
    return lists.join(first, "id").filter("node != b").select(F.col("node").alias("a"), "b").distinct()


def divide_skip(nodes: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], second: np.ndarray, percent: int, mu: float = 0.01) -> Iterator[tuple[int, np.ndarray]]:
    """(query, partners) by position, for each query with partners. Positions where ``second`` is true form the
    index and the others the queries; if none is, every text queries the texts after it."""
    lengths = np.array([len(s) for s in sets])
    all_ids, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), lengths)
    crossed = bool(second.any())
    if crossed:
        mask = second[owner]
        all_ids, owner = all_ids[mask], owner[mask]
    order = np.lexsort((owner, all_ids))
    postings, ids = owner[order], all_ids[order]
    keys, starts = np.unique(ids, return_index=True)
    ends = np.append(starts[1:], len(ids))
    for q in np.flatnonzero(~second):
        least = required(int(sizes[q]), percent)
        found = np.searchsorted(keys, sets[q])
        found = found[(found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] == sets[q])] if len(keys) else found[:0]
        if len(found) < least:
            continue
        found = found[np.argsort(ends[found] - starts[found], kind="stable")]
        longest = int(ends[found[-1]] - starts[found[-1]])
        skip = min(least - 1, len(found) - 1, int(least / (mu * log2(longest + 1) + 1))) if longest > 1 else 0
        short, long = found[: len(found) - skip], found[len(found) - skip :]
        merged = np.concatenate([postings[starts[k] : ends[k]] for k in short])
        if not crossed:
            merged = merged[merged > q]
        near, count = np.unique(merged, return_counts=True)  # the short lists' merge
        keep = (count >= least - skip) & (100 * np.minimum(sizes[near], sizes[q]) >= percent * np.maximum(sizes[near], sizes[q]))
        near, count = near[keep], count[keep]
        for k in long:
            if not len(near):
                break
            row = postings[starts[k] : ends[k]]
            at = np.minimum(np.searchsorted(row, near), len(row) - 1)
            count = count + (row[at] == near)
        links = near[100 * count >= percent * (sizes[near] + sizes[q] - count)]
        links = links[nodes[links] != nodes[q]]
        if len(links):
            yield int(q), links


def _task(nodes: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], second: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest node reached, number of links) of each text of a task."""
    parent = np.arange(len(nodes))
    links = np.zeros(len(nodes), np.int64)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for q, partners in divide_skip(nodes, sizes, sets, second, percent):
        links[q] += len(partners)
        links[partners] += 1
        for p in partners:
            a, b = root(q), root(int(p))
            if a != b:
                parent[b if nodes[a] <= nodes[b] else a] = a if nodes[a] <= nodes[b] else b
    return nodes[[root(i) for i in range(len(nodes))]], links


def block_links(sets: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """(node, root, links): every task's rows for the texts that have links in it."""
    members = sets.filter("ids IS NOT NULL").join(blocks, "node").select("node", "size", "ids", F.col("label").alias("block"))
    weight = members.groupBy("block").agg(F.sum(F.octet_length("ids") / 8).alias("_w"))
    weight = weight.select("block", F.greatest(F.lit(1), F.ceil(F.col("_w") / MOST_POSTINGS)).cast("int").alias("_chunks"))
    dealt = members.join(weight, "block").withColumn("_chunk", F.pmod(F.xxhash64("node"), F.col("_chunks")).cast("int"))
    tasks = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_other")).select(
        "block",
        F.least("_chunk", "_other").alias("i"),
        F.greatest("_chunk", "_other").alias("j"),
        (F.col("_chunk") > F.col("_other")).alias("second"),
        "node",
        "size",
        "ids",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for block, i, j, second, node, size, ids in zip(*columns, batch.column(6), strict=True):
                if (block, i, j) != now:
                    if len(held) > 1:
                        yield linked(held)
                    now, held = (block, i, j), []
                held.append((node, size, second, np.frombuffer(ids.as_buffer().to_pybytes(), "<u8")))
        if len(held) > 1:
            yield linked(held)

    def linked(held: list[tuple]) -> pa.RecordBatch:
        nodes, sizes, second = (np.array([h[k] for h in held]) for k in range(3))
        roots, links = _task(nodes, sizes, [h[3] for h in held], second, percent)
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (nodes, roots, links)], ["node", "root", "links"])

    return tasks.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j").mapInArrow(run, "node bigint, root bigint, links bigint")


#: Rows without an id are numbered from here, so that every id comes before them.
NAMELESS = 1 << 62


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, buckets: int | None = None) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links, its own
    included) and n_links (different texts that the row's text links with).

    A null, empty or blank text has no shingles and links with nothing, not even its copies; other copies
    link. Rows with a null id take part, and component_id is null only where no row of the component has an
    id. Rows that share an id but not the text count as one document: what links with one text of it is in its
    component. n_shingles is then that of the row's text, or of the largest of those that no other id has.
    Texts of any length are compared whole. Ids are integers; others raise TypeError. An empty table gives an
    empty result with the same columns; other columns of the input, whatever their names, are not looked at.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is not an integer column")
    buckets = buckets or max(64, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    nameless = F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64(F.coalesce(own(text_col), F.lit(""))), 2)
    named = docs.select(F.coalesce(own(id_col).cast("bigint"), nameless).alias("_doc"), own(text_col).alias("_body"))
    rows = keyed(named, "_doc", "_body")
    copied = copied_texts(rows)
    sets = cut(text_sets(representatives(rows, copied), n, percent, buckets), "sets")
    blocks = connected_components(prefix_stars(sets))
    found = cut(block_links(sets, blocks, percent), "links")
    each = cut(rows.join(copied, list(KEY), "left").select("_id", F.coalesce("_rep", "_id").alias("node"), F.rlike("_text", F.lit(WORD)).alias("_worded")), "nodes")
    several = each.filter("_worded").groupBy("_id").agg(F.min("node").alias("b"), F.max("node").alias("_last")).filter("b < _last").select("_id", "b")
    same_id = each.filter("_worded").join(several, "_id").select(F.col("node").alias("a"), "b")  # of ids whose rows differ in text
    classes = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(same_id))
    degree = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    texts = (
        sets.groupBy("node")
        .agg(F.max("size").cast("bigint").alias("n_shingles"))
        .join(classes, "node", "left")
        .join(degree, "node", "left")
    )
    named_only = lambda c: F.when(c < NAMELESS, c)
    worded = lambda c, other: F.when(F.col("_worded"), c).otherwise(other)
    zero = F.lit(0).cast("bigint")
    return each.join(texts, "node").select(
        named_only(F.col("_id")).alias(id_col),
        worded(F.col("n_shingles"), zero).alias("n_shingles"),
        named_only(worded(F.coalesce("label", "node"), F.col("_id"))).alias("component_id"),
        worded(F.coalesce("n_links", zero), zero).alias("n_links"),
    )


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs, all columns unchanged, that are the first of their component or link with nothing.

    Rows with a null id stay, and so do rows without a word; rows that share the first id of a component all
    stay. Long texts are compared whole. An empty table gives an empty one. Columns may have any names."""
    (stays,) = unused([*docs.columns, "first"], "_stays")
    stay = near_duplicates(docs.filter(own(id_col).isNotNull()), id_col, text_col, n, percent)
    stay = stay.groupBy(own(id_col).alias(stays)).agg(F.min("component_id").alias("first")).filter(F.col(stays) == F.col("first")).select(stays)
    named = docs.join(stay, own(id_col) == F.col(stays), "left_semi")
    return named.unionByName(docs.filter(own(id_col).isNull()))
