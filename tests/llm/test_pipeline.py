"""The pipeline's stages against plain Python on rows with nulls, ties, repeated rows, repeated ids in several
leaves, and columns whose names the operators use themselves."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from textspark.llm import mixing, packing
from textspark.llm.queries import MIX_WEIGHTS

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ["_id", "copies", "_stays", "_dd_len", "_dd_sha", "_row", "domain", "epochs", "last", "name", "_keep_id", "copy", "n_tokens", "tie", "node"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in NAMES) + ", `a.b` string"
text = lambda n, start=0: " ".join(f"w{i}" for i in range(start, start + n))


def rows():
    texts = [None, "", " \t", text(40), text(40), text(41), text(300, 500), text(7, 90), text(6, 900), "x " * 5000, text(2500, 5000)]
    out = []
    for i in range(66):
        out.append((None if i % 9 == 4 else i % 50, texts[i % 11], ("en", "de", None)[i % 3], (f"src{i % 4}", None)[i % 5 == 0], None, *(f"{n}{i}" for n in NAMES), "dot"))
    return out + out[3:6]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def taken(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_clean_language_keeps_rows_whole(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.clean_language(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and taken(kept) == Counter(rows())


def test_exact_copies(spark, docs):
    best = {}
    for r in rows():
        k = r[1] or ""
        if k not in best or (r[0] is not None and (best[k] is None or r[0] > best[k])):
            best[k] = r[0]
    found = taken(corpus_pipeline.exact_copies(spark, docs, ""))
    assert sum(found.values()) == len(best) and not found - Counter(rows())
    assert {(r[1] or ""): r[0] for r in found} == best


def test_near_copies(spark, docs):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := WORDS.findall(r[1] or "")) else frozenset() for r in rows()]
    named = [k for k, r in enumerate(rows()) if r[0] is not None]
    by_doc = defaultdict(set)
    for k in named:
        by_doc[rows()[k][0]].add(k)
    group = {d: d for d in by_doc}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    for a in named:
        for b in named:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(rows()[a][0]), root(rows()[b][0])
                group[max(x, y)] = min(x, y)
    want = Counter(r for r in rows() if r[0] is None or root(r[0]) == r[0])
    assert taken(corpus_pipeline.near_copies(spark, docs, "")) == want


def fill(children, budget):
    """Water-filling by trying every level: children (capacity, weight) by name."""
    full = set()
    while True:
        weight = sum(w for n, (_, w) in children.items() if n not in full)
        left = budget - sum(children[n][0] for n in full)
        over = sorted((c / w, n) for n, (c, w) in children.items() if n not in full and c * weight <= left * w)
        if not over or not weight:
            return {n: c if n in full else min(c, left * w // weight) for n, (c, w) in children.items()}
        full.add(over[0][1])


def mixed(all_rows, seed=1):
    """(row, copies) of the mix by walking the tree and each leaf's permutation."""

    def leaf(r):
        name = r[3] or ""
        return (f"domain{(len(name) * 7 + ord(('0' + name)[-1])) % 4}", r[2] or "", name)

    n = [len(WORDS.findall(r[1] or "")) for r in all_rows]
    tokens = Counter()
    for r, k in zip(all_rows, n, strict=True):
        tokens[leaf(r)] += k
    budgets = {(): sum(tokens.values()) * 60 // 100}
    for depth, level in enumerate(mixing.LEVELS):
        weights = MIX_WEIGHTS.get(level, {})
        for parent in {p[:depth] for p in tokens}:
            below = defaultdict(int)
            for path, k in tokens.items():
                if path[:depth] == parent:
                    below[path[: depth + 1]] += 2 * k
            budgets |= fill({p: (c, weights.get(p[-1], 1)) for p, c in below.items()}, budgets[parent])
    out = []
    for path, total in tokens.items():
        inside = [(r, k) for r, k in zip(all_rows, n, strict=True) if leaf(r) == path]
        epochs, rest = divmod(budgets[path], total) if total else (0, 0)
        order = lambda r: hashlib.md5(f"{seed}:{epochs}:{'' if r[0] is None else r[0]}".encode()).hexdigest()  # noqa: B023, E731
        for r, k in inside:
            upto = sum(j for s, j in inside if order(s) <= order(r))
            out.append((r, epochs + (upto <= rest) if k else 0))
    return out


def test_target_mix(spark, docs):
    want = Counter()
    for r, copies in mixed(rows()):
        want[r] += copies
    found = corpus_pipeline.target_mix(spark, docs, "")
    assert found.columns == docs.columns and taken(found) == +want
    assert len({r[0] for r in want if r[0] is None}) == 1  # rows without an id take part


def best_fit(pieces, capacities=packing.CAPACITIES, overhead=packing.OVERHEAD):
    """The bins of pieces in falling order, by trying all open bins: (bin, offset) of each and the bins' lengths."""
    bins, placed = [], []
    for i, size in enumerate(pieces):
        fits = [(cap - sum(inside), -k) for k, (cap, inside) in enumerate(bins) if cap - sum(inside) >= size]
        if fits:
            space = min(fits)[0]
            k = max(-x for s, x in fits if s == space and True)
            k = [j for j in recent if bins[j][0] - sum(bins[j][1]) == space][-1]
        else:
            wait = pieces[i + 1 :]
            cost = lambda c: ((overhead + c) / (size + min(c - size, sum(x for x in wait if x <= c - size))), c)  # noqa: B023, E731
            bins.append((min((c for c in capacities if c >= size), key=cost), []))
            k = len(bins) - 1
            recent = [] if k == 0 else recent
        placed.append((k, sum(bins[k][1])))
        bins[k][1].append(size)
        recent = [j for j in recent if j != k] + [k]
    return placed, [min(c for c in capacities if c >= sum(inside)) for _, inside in bins]


def test_best_fit_places_like_trying_all_bins():
    import numpy as np

    for seed in range(8):
        sizes = np.sort(np.random.default_rng(seed).integers(1, 2049, 200))[::-1]
        bins, offsets, final = packing.pack(sizes)
        placed, lengths = best_fit([int(x) for x in sizes])
        assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == placed and final.tolist() == lengths


def test_sequences(spark, docs):
    found = corpus_pipeline.sequences(spark, docs, "").collect()
    sizes = sorted((len(WORDS.findall(r[1] or "")) for r in rows()), reverse=True)
    pieces = sorted((min(2048, n - 2048 * k) for n in sizes for k in range(max(1, -(-n // 2048)))), reverse=True)
    assert sorted((r.n_tokens for r in found), reverse=True) == pieces
    placed, lengths = best_fit([n for n in pieces if n])
    assert Counter(r.bin_capacity for r in {r.bin_id: r for r in found if r.bin_id is not None}.values()) == Counter(lengths)


def test_empty_tables_keep_their_columns(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    nothing = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, nothing, str(tmp_path))
        assert found.count() == 0 and found.schema.simpleString() == nothing.schema.simpleString(), name
    packed = corpus_pipeline.sequences(spark, nothing, "")
    assert packed.count() == 0 and packed.columns == ["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_capacity"]


def test_run_is_the_stages_one_after_the_other(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, str(tmp_path)).collect(), docs.schema)
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens, r.start)
    assert sorted(map(key, whole.collect())) == sorted(map(key, corpus_pipeline.sequences(spark, step, "").collect()))
