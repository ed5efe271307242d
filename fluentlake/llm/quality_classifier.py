"""Op 10: quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the votes of
all documents estimates each labeller's accuracy per class and the classes' shares; as there are few patterns of votes, it
works on a table of patterns and counts. Posterior labels of a bounded sample train a linear scorer over hashed byte
trigrams and hashed runs of kinds of characters, which scores every whole text. Votes are no features of the scorer.

The sample (MAX_SAMPLE documents, about) are those whose hash of id and text is below a bound that follows from the number
of rows, so no task sends more than its share. Tasks return their documents' sparse features; no text goes to the driver.

Three narrow passes over the texts; the shuffles have a row per pattern and task, and the sample. Null and empty texts get
only the vote of the labeller of length, and a score like all others. Very long texts are handled whole, in blocks of their
own. Rows that repeat count in the expectation, are one row of the sample, and get their own rows; hashes that tie beyond
that are a chance of 2**-64. An empty table gives an empty table. Columns of docs may have any names, also those used here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from fluentlake.llm.quality_rules import covered_words
from fluentlake.llm.shared import SPACE, give_back, mix, span_hashes, sums_between, text_blocks, text_bytes, word_spans

MAX_SAMPLE = 3000
BUCKETS = 1 << 13
#: Below a half, as the classes weigh alike in training although good texts are commoner.
THRESHOLD = 0.35
#: Texts whose features are worked out at once, and bytes of texts in a block (a longer text alone).
TEXTS, BLOCK = 64, 1 << 19
#: Name, figure, bad from, good up to. A figure between both gives no vote; where good is None, the labeller knows only bad.
LABELLERS = (
    ("symbols", "symbols_per_word", 0.20, None),
    ("capitals", "capital_share", 0.60, None),
    ("exclamations", "exclamations_per_word", 0.50, None),
    ("no_letters", "letterless_words", 0.25, None),
    ("unclean", "unclean_words", 0.30, 0.10),
    ("repeated", "repeated_words", 0.60, None),
    ("same_word", "same_word_follows", 0.30, 0.02),
    ("few_words", "fewness", -1.0, None),
)


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOLS, _EXCLAIM = _table(b"#*$%&|<>"), _table(b"!")
_CAPITAL, _SMALL = _table(bytes(range(65, 91))), _table(bytes(range(97, 123)))
_LETTER = _CAPITAL | _SMALL | (np.arange(256) >= 128)


def votes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Votes (texts x labellers) of a block of texts: 2 good, 1 bad, 0 nothing."""
    starts, ends, first = word_spans(data, bounds)
    n = np.diff(first)
    some = np.maximum(n, 1)
    owner = np.repeat(np.arange(len(n)), n)
    hashes = span_hashes(data, starts, ends)
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    capital = sums_between(_CAPITAL[data], bounds)
    follows = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])]) if len(hashes) else np.zeros(0, bool)
    figures = {
        "symbols_per_word": sums_between(_SYMBOLS[data], bounds) / some,
        "capital_share": capital / np.maximum(capital + sums_between(_SMALL[data], bounds), 1),
        "exclamations_per_word": sums_between(_EXCLAIM[data], bounds) / some,
        "unclean_words": sums_between(((ends - starts) - (letters[ends] - letters[starts]) >= 2) | (letters[ends] == letters[starts]), first) / some,
        "letterless_words": sums_between(letters[ends] == letters[starts], first) / some,
        "repeated_words": sums_between(covered_words(hashes, owner, 3), first) / some,
        "same_word_follows": sums_between(follows, first) / some,
        "fewness": -n.astype(float),
    }
    out = np.zeros((len(n), len(LABELLERS)), np.uint8)
    for k, (_, figure, bad, good) in enumerate(LABELLERS):
        out[:, k] = np.where(figures[figure] >= bad, 1, np.where(figures[figure] <= (-np.inf if good is None else good), 2, 0))
        if figure != "fewness":
            out[n == 0, k] = 0
    return out


def codes(table: np.ndarray) -> np.ndarray:
    return table.astype(np.int64) @ (3 ** np.arange(table.shape[1]))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """From vote patterns and their counts: the posterior of good for each pattern, P(vote | class) of each labeller
    (labellers x classes x votes), and the share of good. Starts with bad where a labeller says so, as most know only
    one kind of bad; 1 is added to all counts, and one more in favour of the class that the vote names, so classes keep
    their meaning."""
    posterior = np.where((patterns == 1).any(axis=1), 0.05, 0.95)
    rates = np.zeros((patterns.shape[1], 2, 3))
    share = 0.5
    for _ in range(rounds):
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        share = float((weight[1].sum() + 1) / (weight.sum() + 2))
        for k in range(patterns.shape[1]):
            for y in (0, 1):
                found = np.bincount(patterns[:, k], weight[y], 3) + np.array([1.0, 1.0 + (y == 0), 1.0 + (y == 1)])
                rates[k, y] = found / found.sum()
        logs = np.log(np.array([1 - share, share]))[:, None] + sum(np.log(rates[k][:, patterns[:, k]]) for k in range(patterns.shape[1]))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return posterior, rates, share


#: Kinds of bytes: white space, capital, small, not ASCII, digit, punctuation, exclamation mark, other.
_KIND = np.full(256, 7, np.int64)
_KIND[SPACE] = 0
_KIND[_CAPITAL], _KIND[_SMALL], _KIND[128:], _KIND[_table(b"0123456789")] = 1, 2, 3, 4
_KIND[_table(b".,;:?'\"()-")], _KIND[_EXCLAIM] = 5, 6
_RUN_BUCKETS = (mix(np.arange(8**4, dtype=np.uint64) + np.uint64(1 << 52)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts x BUCKETS: roots of the shares of a text's byte trigrams and of its runs of four kinds of characters."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    out = np.zeros((n, BUCKETS), np.float32)
    d, kind = data.astype(np.uint64), _KIND[data]
    for width in (3, 4):
        if len(data) < width:
            continue
        if width == 3:
            at = (mix((d[:-2] << np.uint64(16)) | (d[1:-1] << np.uint64(8)) | d[2:]) & np.uint64(BUCKETS - 1)).astype(np.int64)
        else:
            at = _RUN_BUCKETS[((kind[:-3] * 8 + kind[1:-2]) * 8 + kind[2:-1]) * 8 + kind[3:]]
        first, last = owner[: len(at)], owner[width - 1 :]
        inside = first == last
        counts = np.bincount(first[inside] * BUCKETS + at[inside], minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
        out += np.sqrt(counts / np.maximum(counts.sum(axis=1), 1)[:, None])
    return out


def feature_runs(data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """features of a block, TEXTS at a time."""
    for k in range(0, len(bounds) - 1, TEXTS):
        part = bounds[k : k + TEXTS + 1]
        yield features(data[part[0] : part[-1]], part - part[0])


def train_scorer(starts: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels, classes weighing alike, by accelerated gradient descent. Rows are sparse: row
    k has the values x in the buckets at from starts[k] to starts[k + 1]."""
    w = v = np.zeros(BUCKETS)
    b = c = 0.0
    if not len(y):
        return w, b
    cost = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    cost = cost / cost.sum()
    row = np.repeat(np.arange(len(y)), np.diff(starts))
    rate = 4.0 / (1 + float((cost[row] * x * x).sum()))
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * v[at], len(y)) + c, -30, 30)))
        miss = cost * (p - y)
        new_w, new_b = v - rate * (np.bincount(at, x * miss[row], BUCKETS) + ridge * v), c - rate * float(miss.sum())
        momentum = k / (k + 3)
        v, c = new_w + momentum * (new_w - w), new_b + momentum * (new_b - b)
        w, b = new_w, new_b
    return w, b


def _voter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, bounds in text_blocks(batch, "text", BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array(codes(votes(data, bounds)), pa.int64())], ["pattern"])
        give_back()


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, bounds in text_blocks(batch, "text", BLOCK):
            at, x = [], []
            for found in feature_runs(data, bounds):
                for row in found:
                    some = np.flatnonzero(row)
                    at.append(some.astype(np.uint16).tobytes())
                    x.append(row[some].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0)[rows], pa.array(codes(votes(data, bounds)), pa.int64()), pa.array(at, pa.binary()), pa.array(x, pa.binary())], ["draw", "pattern", "at", "x"])


def _scorer(weights: np.ndarray, bias: float, posterior: np.ndarray, threshold: float, names: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, own = weights.astype(np.float32), len(names) - 4
        for batch in batches:
            for rows, data, bounds in text_blocks(batch, text, BLOCK):
                z = np.concatenate([x @ vector for x in feature_runs(data, bounds)]).astype(np.float64) + bias
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                code = codes(votes(data, bounds))
                keep = [batch.column(k)[rows] for k in range(own)]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(score), pa.array(score >= threshold), pa.array(code, pa.int64()), pa.array(posterior[code])], names)
            give_back()

    return run


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, most: int = MAX_SAMPLE) -> DataFrame:
    """docs' columns as c0, c1 and so on, and score (1: good), kept, votes (pattern) and posterior (of the pattern)."""
    texts = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), text_bytes(text).alias("text"))
    found = texts.select("text").mapInArrow(_voter, "pattern long").groupBy("pattern").count().collect()
    size = len(LABELLERS)
    every = np.arange(3**size)
    table = np.stack([every // 3**k % 3 for k in range(size)], axis=1)
    counts = np.zeros(3**size)
    for r in found:
        counts[r["pattern"]] = r["count"]
    posterior, _, _ = expectation_maximisation(table, counts)

    bound = min(2**63 - 1, int(2**64 * min(1.0, most / max(1.0, counts.sum()))) - 2**63)
    drawn = texts.select(F.xxhash64("id", "text").alias("draw"), "text").where(F.col("draw") <= F.lit(bound))
    rows = drawn.mapInArrow(_sampler, "draw long, pattern long, at binary, x binary").dropDuplicates(["draw"]).orderBy("draw").limit(most).collect()
    at, x = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[c], kind) for r in rows)]) for c, kind in (("at", np.uint16), ("x", np.float32)))
    starts = np.cumsum([0, *(len(r["at"]) // 2 for r in rows)])
    y = posterior[np.array([r["pattern"] for r in rows], np.int64)]
    weights, bias = train_scorer(starts, at.astype(np.int64), x.astype(np.float64), y)

    names = [f"c{k}" for k in range(len(docs.columns))]
    verdict = [StructField("score", DoubleType()), StructField("kept", BooleanType()), StructField("votes", LongType()), StructField("posterior", DoubleType())]
    schema = StructType([*(StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)), *verdict])
    read, at = docs.toDF(*names), names[docs.columns.index(text)]
    if isinstance(schema[at].dataType, StringType):  # a null has no bytes, as an empty text
        return read.mapInArrow(_scorer(weights, bias, posterior, threshold, schema.names, at), schema)
    return read.select("*", text_bytes(at).alias("text")).mapInArrow(_scorer(weights, bias, posterior, threshold, schema.names, "text"), schema)


def quality_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, most: int = MAX_SAMPLE) -> DataFrame:
    """One row per document: doc_id, score, kept, posterior (of good, by the votes alone), votes (their pattern)."""
    found = classify(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), threshold=threshold, most=most)
    return found.select(F.col("c0").alias("doc_id"), "score", "kept", "posterior", "votes")


def accepted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that the classifier keeps, with docs' own columns. The verdict joins no rows: texts pass through."""
    return classify(docs, doc_id, text).where("kept").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
