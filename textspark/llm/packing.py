"""Best-fit packing into bins of several permitted lengths.

Documents become pieces of at most the largest length. Pieces go by falling length: each into the open bin
with the least space that still holds it. If none does, a bin is opened at the permitted length of least
cost: a bin of length c costs c and an overhead for the sequence, and the cost is taken per token that it
can be expected to hold, the piece and what the pieces not yet placed can still fill. In the end each bin
shrinks to the least permitted length that holds its contents.

Pieces are dealt by a hash of document, piece and, for rows that repeat, a number into shards of about ``shard_pieces`` pieces, and each shard is
packed on its own, so a shard's memory is bounded and shards run in parallel at any size of corpus; the
share of bins that a shard leaves partly filled is about one bin of each length. Texts are not shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textspark.llm.common import WORD, cut, own

CAPACITIES = (512, 1024, 2048)
OVERHEAD = 64


def pack(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the final length of each bin, for pieces sorted by falling length, each of
    1 to max(capacities) tokens."""
    capacities = sorted(capacities)
    waiting = np.bincount(lengths, minlength=capacities[-1] + 1)
    # tokens not yet placed in pieces of at most s tokens: a Fenwick tree over lengths
    top = len(waiting)
    tree = np.zeros(top + 1, np.int64)
    for s, n in enumerate((waiting * np.arange(top)).tolist(), 1):
        tree[s] += n
        if s + (s & -s) <= top:
            tree[s + (s & -s)] += tree[s]
    tree = tree.tolist()

    def waiting_upto(s: int) -> int:
        s, total = s + 1, 0
        while s:
            total += tree[s]
            s &= s - 1
        return total

    spaces: list[int] = []  # the distinct spaces of open bins, sorted
    open_bins: dict[int, list[int]] = {}  # by space
    used: list[int] = []
    limit: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        s = length + 1
        while s <= top:
            tree[s] -= length
            s += s & -s
        k = bisect_left(spaces, length)
        if k < len(spaces):
            space = spaces[k]
            b = open_bins[space].pop()
            if not open_bins[space]:
                del open_bins[space], spaces[k]
        else:
            fits = [c for c in capacities if c >= length]
            space = min(fits, key=lambda c: ((overhead + c) / (length + min(c - length, waiting_upto(c - length))), c))
            b = len(used)
            used.append(0)
            limit.append(space)
        bins[i], offsets[i] = b, used[b]
        used[b] += length
        space = limit[b] - used[b]
        if space:
            if space not in open_bins:
                insort(spaces, space)
                open_bins[space] = []
            open_bins[space].append(b)
    final = np.array([capacities[bisect_left(capacities, u)] for u in used], np.int64)
    return bins, offsets, final


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, shard_pieces: int = 20_000
) -> DataFrame:
    """One row per piece: id, piece, start (token in the document), n_tokens, bin_id, bin_offset, bin_capacity.

    Tokens are words, or counted by ``tokens``. A document of no tokens, null texts included, has one piece of 0
    tokens in no bin (bin columns null); a long one has as many pieces as it needs. Equal pieces are placed in
    order of id and text. Repeated rows, equal and null ids are packed each on their own; ids may have any type. An
    empty table gives an empty result with the same columns; other columns of the input, whatever their names,
    are not looked at."""
    largest = max(capacities)
    counted = tokens if tokens is not None else F.regexp_count(own(text_col), F.lit(WORD))
    sizes = docs.select(own(id_col).alias("id"), F.coalesce(counted, F.lit(0)).cast("bigint").alias("size"), F.xxhash64(own(text_col)).alias("tie"))
    items = cut(sizes.groupBy("id", "tie", "size").agg(F.count(F.lit(1)).alias("rows")), "items")  # rows that repeat are told apart below
    pieces = items.agg(F.sum(F.col("rows") * F.greatest(F.lit(1), F.ceil(F.col("size") / largest)))).first()[0] or 0  # a number
    shards = max(1, -(-int(pieces) // shard_pieces))
    items = items.select("id", "tie", "size", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("again"))
    cuts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / largest) - 1).cast("int")))
    rows = items.select("id", "tie", "size", "again", cuts.alias("piece")).withColumns(
        {
            "start": F.col("piece").cast("bigint") * largest,
            "n": F.least(F.lit(largest).cast("bigint"), F.col("size") - F.col("piece").cast("bigint") * largest),
            "shard": F.pmod(F.xxhash64("id", "tie", "piece", "again"), F.lit(shards)).cast("int"),
        }
    )
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start bigint, n_tokens bigint, bin_id bigint, bin_offset bigint, bin_capacity bigint"
    names = [id_col, "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_capacity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            shard = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(shard)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(shard)], strict=True):
                if hi == lo:
                    continue
                if shard[lo] != now:
                    if held:
                        yield packed(now, held)
                    now, held = int(shard[lo]), []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield packed(now, held)

    def packed(shard: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        n = t.column("n").to_numpy()
        bins, offsets, final = pack(n[n > 0], capacities, overhead)  # rows come by falling length
        some = np.concatenate((np.ones(len(bins), bool), np.zeros(len(n) - len(bins), bool)))
        pad = lambda x: pa.array(np.concatenate((x, np.zeros(len(n) - len(bins), np.int64))), mask=~some)
        one = lambda c: t.column(c).combine_chunks()
        return pa.RecordBatch.from_arrays([one("id"), one("piece"), one("start"), one("n"), pad((shard << 32) + bins), pad(offsets), pad(final[bins] if len(bins) else bins)], names)

    dealt = rows.select("shard", "n", "id", "tie", "piece", "start", "again").repartition("shard").sortWithinPartitions("shard", F.desc("n"), "id", "tie", "again", "piece")
    return dealt.mapInArrow(run, schema)
