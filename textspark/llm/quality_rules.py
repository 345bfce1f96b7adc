"""Quality rules with repetition coverage.

For n-grams of several lengths, rolling hashes of word windows find those that occur twice or more in a
text; the share of the text's word characters that lie inside them, and inside lines that repeat an
earlier line, is its repetition coverage. A text in which one line alone repeats, and once (a signature, a
refrain), is not judged on that line's n-grams: both of its copies are taken off the n-grams' characters, and
the limit on duplicated lines decides. A whole batch of texts is measured with a few array passes:
windows that cross from one text to the next are masked, and a text's number is mixed into its hashes.
Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textspark.llm import words as W

SYMBOLS = "#*$%&|<>"
#: The largest share of characters that duplicated n-grams of each length may cover. All are below the base
#: rule's 20% of words, which would leave higher ones nothing to reject.
COVERAGE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_COVERAGE = 0.20
COLUMNS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, "
    "dup_line_chars bigint, " + ", ".join(f"dup_{n}gram_chars bigint" for n in COVERAGE)
)


def measure(texts: list[str | None], hashes: W.HashCache) -> dict[str, np.ndarray]:
    """The columns of COLUMNS but for the verdicts, for texts in order."""
    n = len(texts)
    n_words, symbols, dup_lines, dup_line_chars = (np.zeros(n, np.int64) for _ in range(4))
    parts, lengths = [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        found = W.WORDS.findall(text)
        n_words[i] = len(found)
        parts.append(hashes.of(found))
        lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
        symbols[i] = sum(map(text.count, SYMBOLS))
        seen: set[str] = set()
        for line in text.split("\n"):
            if line in seen:
                dup_lines[i] += 1
                dup_line_chars[i] += sum(map(len, W.WORDS.findall(line)))
            elif W.WORDS.search(line):
                seen.add(line)
    a = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    size = np.concatenate(lengths) if lengths else np.empty(0, np.int64)
    owner = np.repeat(np.arange(n), n_words)
    out = {"n_words": n_words, "word_chars": np.bincount(owner, size, n).astype(np.int64), "n_symbols": symbols, "n_dup_lines": dup_lines, "dup_line_chars": dup_line_chars}
    for k in COVERAGE:
        if len(a) < k:
            out[f"dup_{k}gram_chars"] = np.zeros(n, np.int64)
            if k == 5:
                out["n_repeat_words"] = np.zeros(n, np.int64)
            continue
        whole = np.flatnonzero(owner[k - 1 :] == owner[: len(owner) - k + 1])
        h = W.windows(a, k)[whole] ^ W.mixed(owner[whole].astype(np.uint64) + np.uint64(1))
        starts = np.zeros(len(a), bool)
        starts[whole[W.repeated(h)]] = True
        inside = W.covered(starts, k, len(a))
        out[f"dup_{k}gram_chars"] = np.bincount(owner, size * inside, n).astype(np.int64)
        if k == 5:
            out["n_repeat_words"] = np.bincount(owner, inside, n).astype(np.int64)
    return out


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    passed = m["dup_line_chars"] <= LINE_COVERAGE * m["word_chars"]
    one_line = np.where(m["n_dup_lines"] == 1, 2 * m["dup_line_chars"], 0)
    for k, share in COVERAGE.items():
        passed &= m[f"dup_{k}gram_chars"] - one_line <= share * m["word_chars"]
    return failed, ~failed & passed


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, the base measures, base_failed, kept, and characters inside duplicated
    lines and n-grams.

    A null or empty text has no words and fails the base rules. Lines count as repeated if an earlier
    line of the same text is equal and has a word; ties do not arise, as each text is judged on its own. A long
    text is measured whole. Repeated rows, equal and null ids get their own rows; an empty table gives an empty
    result with the same columns; other columns of the input, whatever their names, are not looked at.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = W.HashCache()
        for batch in batches:
            for part in W.slices(batch, 1):
                m = measure(part.column(1).to_pylist(), hashes)
                m["base_failed"], m["kept"] = verdicts(m)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(m[c]) for c in names)], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {COLUMNS}")
