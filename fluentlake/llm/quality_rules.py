"""Op 1: quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths in numpy find every n-gram that occurs twice or more in a text and
measure the share of the text's word characters inside such n-grams, and inside lines that repeat an earlier line.
Narrow: one pass of mapInArrow over the two columns it reads, no shuffle; a text is handled whole, in blocks of texts of
about 2 MB (a longer text alone).

The verdict beyond the base rule is by coverage alone; symbols are counted and reported. Null and empty texts have no words:
all counts 0, base_failed true, kept false. Shares that equal a limit pass. Repeated rows each get their own row; an empty
table gives an empty table. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluentlake.llm.shared import SPACE, mix, span_hashes, sums_between, text_blocks, text_bytes, word_spans

#: Largest share of word characters inside repeated n-grams of n words, by n. Each limit lies a tenth or so above what any
#: of the 3,243 labelled good documents of sf0.1 that pass the base rule has (0.276 for n up to 9, 0.177 for 10).
MAX_SHARE = {5: 0.30, 6: 0.30, 7: 0.30, 8: 0.30, 9: 0.30, 10: 0.20}
#: Largest share of word characters inside lines that repeat an earlier line (0.138 in those documents).
MAX_LINE_SHARE = 0.16
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STEPS = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    ordered = np.sort(values)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    return np.isin(values, np.unique(twice)) if len(twice) else np.zeros(len(values), bool)


def covered_words(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a window of n words that occurs twice or more in its text."""
    count = len(hashes)
    if count < n:
        return np.zeros(count, bool)
    grams = hashes[: count - n + 1] * _STEPS[0]
    for k in range(1, n):
        grams = mix(grams) + hashes[k : count - n + 1 + k] * _STEPS[k]
    grams = mix(grams ^ mix(owner[: count - n + 1].astype(np.uint64) + _STEPS[63]))
    whole = np.flatnonzero(owner[: count - n + 1] == owner[n - 1 :])
    found = whole[repeated(grams[whole])]
    change = np.zeros(count + 1, np.int32)
    np.add.at(change, found, 1)
    np.add.at(change, found + n, -1)
    return np.cumsum(change)[:-1] > 0


def measure(data: np.ndarray, bounds: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The figures of each text of a block."""
    starts, ends, first = word_spans(data, bounds)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    chars = lead[ends] - lead[starts]
    word_chars = sums_between(chars, first)
    hashes = span_hashes(data, starts, ends)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": sums_between(_SYMBOL[data], bounds)}

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]))
    line_owner = np.sort(np.concatenate([np.arange(len(n_words)), np.searchsorted(bounds[1:], breaks, "right")]))
    line_ends = np.append(line_starts[1:], len(data))
    same_owner = np.append(line_owner[1:] == line_owner[:-1], False)
    line_ends = np.where(same_owner, line_ends - 1, bounds[1:][line_owner])
    line_words = np.searchsorted(starts, line_ends) - np.searchsorted(starts, line_starts)
    full = np.flatnonzero(line_words > 0)
    keys = mix(span_hashes(data, line_starts[full], line_ends[full]) ^ mix(line_owner[full].astype(np.uint64) + _STEPS[62]))
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(full), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    out["n_dup_lines"] = np.bincount(line_owner[full][again], minlength=len(n_words))
    by_word = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(chars, out=by_word[1:])
    line_chars = by_word[np.searchsorted(starts, line_ends[full])] - by_word[np.searchsorted(starts, line_starts[full])]
    safe = np.maximum(word_chars, 1)
    out["line_share"] = np.bincount(line_owner[full][again], line_chars[again], len(n_words)) / safe

    out["n_repeat_words"] = sums_between(covered_words(hashes, owner, 3), first)
    for n in lengths:
        out[f"share_{n}"] = sums_between(np.where(covered_words(hashes, owner, n), chars, 0), first) / safe
    return out


def repetition_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    max_share: dict[int, float] = MAX_SHARE,
    max_line_share: float = MAX_LINE_SHARE,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """One row per document: its id, the counts, base_failed, kept, line_share and share_<n> for each length.

    kept is false if base_failed, else true unless a share is above its limit."""
    lengths = tuple(sorted(max_share))
    id_type = docs.schema[doc_id].dataType
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = ["line_share", *(f"share_{n}" for n in lengths)]
    schema = f"doc_id {id_type.simpleString()}, {', '.join(f'{c} long' for c in counts)}, {', '.join(f'{c} double' for c in shares)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in text_blocks(batch, "text"):
                found = measure(data, bounds, lengths)
                ids = batch.column(0)[rows]
                columns = [pa.array(found[c], pa.int64()) for c in counts] + [pa.array(found[c], pa.float64()) for c in shares]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *counts, *shares])

    found = docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(run, schema)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    bad = F.col("line_share") > max_line_share
    for n in lengths:
        bad = bad | (F.col(f"share_{n}") > max_share[n])
    return found.select("doc_id", *counts, failed.alias("base_failed"), (~failed & ~bad).alias("kept"), *shares)
