"""Op 2: toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words is the gap-weighted subsequence kernel of order ORDER (Lodhi et al., 2002): it counts common
subsequences, those with gaps for less, so inserted characters only weaken a match. A word has a mark at each end; a run
of single characters between spaces counts as one word. Landmarks are substrings of training words, chosen by how well
they tell the classes apart, and some of common clean words. A word's features are its kernel values with the landmarks
(relative to the landmark's own, to a power), mapped by the inverse root of the landmarks' kernel matrix (Nyström); a
sentence has the sum of its words'. The machine learns on sentences of labelled documents (multiple instances: a toxic
document has some toxic sentence), and a logistic curve of the sentences' margins gives the document's score.

As the machine is linear in its features, a word has one weight, worked out once per distinct word and worker. Scoring is
narrow: one pass of mapInArrow over whole texts. The training sample is bounded: MAX_SAMPLE documents of each class, drawn
by hash; lang, source and ids are not inputs.

Word features are not those of a symmetric kernel: they are relative to the landmark's own value alone, so that a long word
with a landmark inside counts in full; the landmarks' matrix is relative to both. The map is a Nyström map up to that.

Null and empty texts have no words and get the score of an empty text. Very long texts are scored whole. Ties in the choice
of landmarks go to those that begin a word, then to longer ones, then by code point. Repeated rows get their own rows. An
empty table gives an empty table, no labels a constant score. Other columns of either table may have any names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluentlake.llm.shared import crc_mod, text_bytes

#: Labelled documents of each class that the machine learns from, at most.
MAX_SAMPLE = 1000
ORDER, DECAY, POWER = 4, 0.75, 3
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 24, 8
#: Longer words are looked at in overlapping windows.
WINDOW = 32
#: Words whose kernel values are worked out at once, few enough for the processor's cache.
ROWS = 256
MAX_WORDS = 400_000
_SPELT = re.compile(rb"(?:(?<=\s)|^)\S(?: \S){2,}(?=\s|\Z)")
_EDGES = re.compile(r"^\W+|\W+$")


def words_of(raw: bytes) -> list[bytes]:
    """The words of a text; single characters in a row are one word."""
    if _SPELT.search(raw):
        raw = _SPELT.sub(lambda m: m.group().replace(b" ", b""), raw)
    return raw.split()


def plain(word: bytes) -> str:
    """Lower case, without punctuation at the ends."""
    lowered = word.decode("utf-8", "replace").lower()
    return lowered if lowered.isalnum() else _EDGES.sub("", lowered)


def windows(word: str) -> list[str]:
    marked = f"^{word}$"
    return [marked] if len(marked) <= WINDOW else [marked[k : k + WINDOW] for k in range(0, len(marked) - WINDOW // 2, WINDOW // 2)]


def subsequence_kernel(words: list[str], marks: list[str]) -> np.ndarray:
    """Gap-weighted subsequence kernel of order ORDER of each word with each mark."""
    out = np.zeros((len(words), len(marks)), np.float32)
    width = max(map(len, marks))
    span = width - ORDER + 1
    if span < 1:
        return out
    codes = np.zeros((len(marks), width), np.int32)
    for k, m in enumerate(marks):
        codes[k, : len(m)] = [ord(c) for c in m]
    # match[b, x, k]: whether place b of mark k has the character x of the marks; the last x stands for all others
    letters = np.unique(codes[codes > 0])
    match = np.zeros((width, len(letters) + 1, len(marks)), np.float32)
    match[:, :-1] = (codes.T[:, None, :] == letters[None, :, None]) * np.float32(DECAY * DECAY)
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for begin in range(0, len(at), ROWS):
            rows = at[begin : begin + ROWS]
            chars = np.frombuffer("".join(words[k] for k in rows).encode("utf-32-le"), np.int32).reshape(len(rows), n)
            letter = np.minimum(np.searchsorted(letters, chars), len(letters) - 1)
            letter[letters[letter] != chars] = len(letters)
            # level[i][b]: weight of common subsequences of length i in the word so far and the mark before place b + i;
            # where fewer than ORDER - i characters of the mark or of the word are left, it is of no use
            level = [np.zeros((span, len(rows), len(marks)), np.float32) for _ in range(ORDER)]
            total, fresh, part = np.zeros((len(rows), len(marks)), np.float32), np.empty_like(level[0]), np.empty_like(level[0][0])
            for a in range(n):
                same = match.take(letter[:, a], axis=1)
                if a >= ORDER - 1:
                    np.multiply(same[ORDER - 1 :], level[ORDER - 1], out=fresh)
                    for b in range(span):
                        total += fresh[b]
                for i in range(min(ORDER - 1, a + 1), max(0, a + ORDER - n), -1):
                    if i == 1:
                        fresh[:] = same[:span]
                    else:
                        np.multiply(same[i - 1 : i - 1 + span], level[i - 1], out=fresh)
                    for b in range(1, span):
                        fresh[b] += np.multiply(fresh[b - 1], np.float32(DECAY), out=part)
                    level[i] *= np.float32(DECAY)
                    level[i] += fresh
            out[rows] = total
    return out


def features(words: list[str], marks: list[str], own: np.ndarray) -> np.ndarray:
    parts = [windows(w) for w in words]
    flat = [p for ps in parts for p in ps]
    found = np.minimum(subsequence_kernel(flat, marks) / own, 1) ** POWER if flat else np.zeros((0, len(marks)), np.float32)
    return np.maximum.reduceat(found, np.cumsum([0, *map(len, parts[:-1])]), axis=0) if len(words) else found


class ToxicityModel:
    """marks, the weight of each, and the logistic curve of a document's figures."""

    def __init__(self, marks: list[str], own: np.ndarray, weights: np.ndarray, bias: float, curve: np.ndarray):
        self.marks, self.own, self.weights, self.bias, self.curve = marks, own, weights, bias, curve
        self.known: dict[bytes, int] = {}
        self.weight: list[float] = []
        self.ends: list[bool] = []

    def learn_words(self, words: set[bytes]) -> None:
        new = list(words - self.known.keys())
        if len(self.known) + len(new) > MAX_WORDS:
            self.known, self.weight, self.ends, new = {}, [], [], list(words)
        own = [plain(w) for w in new]
        forms = sorted(set(own))
        weight = dict(zip(forms, (features(forms, self.marks, self.own) @ self.weights).tolist(), strict=True))
        self.known.update(zip(new, range(len(self.weight), len(self.weight) + len(new)), strict=True))
        self.weight.extend(map(weight.__getitem__, own))
        self.ends.extend(w.endswith((b".", b"!", b"?")) for w in new)

    def figures(self, texts: list[bytes]) -> np.ndarray:
        """For each text: sum of words' positive weights, the best margin of a sentence, that sum by root of length, and
        the logarithm of the length."""
        split = [words_of(x) for x in texts]
        self.learn_words(set().union(*split))
        weight, ends = np.array(self.weight + [0.0]), np.array([*self.ends, True])
        out = np.zeros((len(texts), 4))
        for k, ws in enumerate(split):
            best, total = self.bias, 0.0
            if ws:
                at = np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))
                w, stop = weight[at], ends[at]
                begin = np.concatenate([[0], np.flatnonzero(stop[:-1]) + 1])
                best = float(np.add.reduceat(w, begin).max()) + self.bias
                total = float(np.maximum(w, 0).sum())
            out[k] = total, best, total / np.sqrt(len(ws) + 1), np.log1p(len(ws))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = self.figures(texts) @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _landmarks(toxic: list[set[str]], clean: list[set[str]]) -> list[str]:
    """Substrings of marked words, picked one after the other: the one that tells the toxic documents not yet told best
    from the clean ones; then substrings of common clean words."""

    def pieces(words: set[str]) -> set[str]:
        return {m[k : k + n] for w in words for m in windows(w) for n in (5, 6, 7, 8) for k in range(len(m) - n + 1)}

    # Counters by hash first: no more than one document's substrings are held until the frequent ones are known.
    counts, least = np.zeros(1 << 22, np.int32), max(4, 0.008 * len(toxic))

    def cells(found: list[str]) -> np.ndarray:
        return np.fromiter((zlib.crc32(p.encode()) & (1 << 22) - 1 for p in found), np.int64, len(found))

    for x in toxic:
        counts[np.unique(cells(list(pieces(x))))] += 1
    per_toxic = []
    for x in toxic:
        found = sorted(pieces(x))
        often = counts[cells(found)] >= least
        per_toxic.append({p for p, frequent in zip(found, often, strict=True) if frequent})
    wanted = set().union(*per_toxic)
    against = Counter(p for x in clean for p in pieces(x) & wanted)
    left, marks = list(per_toxic), []
    while len(marks) < TOXIC_LANDMARKS and left:
        count = Counter(p for ps in left for p in ps)
        rate = {p: (c - 2 * len(toxic) / len(clean) * against[p]) for p, c in count.items() if not any(p in m or m in p for m in marks)}
        if not rate:
            break
        best = max(rate, key=lambda p: (rate[p], p[0] == "^", len(p), p))
        if rate[best] < 3:
            break
        marks.append(best)
        left = [ps for ps in left if sum(m in ps for m in marks) < 3]
    common = Counter(w for x in clean for w in x if len(w) >= 5)
    return marks + [f"^{w}"[:7] for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:CLEAN_LANDMARKS]]


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 400, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Squared hinge loss by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = v = np.zeros(x.shape[1])
    cost = cost / cost.sum()
    rate = 0.5 / ((cost[:, None] * x * x).sum() + ridge)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = ridge * v - 2 * x.T @ (cost * y * slack)
        new = v - rate * grad
        v = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) / 100 * np.eye(len(w)) + 1e-6 * np.eye(len(w))
        w = w - np.linalg.solve(hessian, z.T @ (p - y) + ridge * len(x) / 100 * w)
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def train(texts: list[bytes], labels: np.ndarray) -> ToxicityModel:
    """Fits landmarks, the machine and the curve on labelled texts."""
    split = [words_of(x) for x in texts]
    forms = [[plain(w) for w in ws] for ws in split]
    marks = _landmarks([{w for w in f if w} for f, y in zip(forms, labels, strict=True) if y], [{w for w in f if w} for f, y in zip(forms, labels, strict=True) if not y]) if labels.any() and not labels.all() else []
    if not marks:
        return ToxicityModel(["^none$"], np.ones(1, np.float32), np.zeros(1), 0.0, np.array([0, 0, 0, 0, -3.0 if not labels.any() else 3.0]))
    own = np.diagonal(subsequence_kernel(marks, marks)).copy()
    vocabulary = sorted({w for f in forms for w in f})
    place = {w: k for k, w in enumerate(vocabulary)}
    raw = np.concatenate([features(vocabulary[k : k + 20000], marks, own) for k in range(0, len(vocabulary), 20000)])
    values, vectors = np.linalg.eigh(features_of_marks(marks, own))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    sentences, owner = [], []
    for k, (ws, f) in enumerate(zip(split, forms, strict=True)):
        if ws:
            stop = np.array([w[-1:] in (b".", b"!", b"?") for w in ws])
            begin = np.concatenate([[0], np.flatnonzero(stop[:-1]) + 1])
            sentences.append(np.add.reduceat(raw[[place[w] for w in f]], begin, axis=0))
            owner += [k] * len(begin)
    x, owner = np.concatenate(sentences).astype(np.float64) @ root, np.array(owner)
    bag = labels[owner].astype(bool)
    y = np.where(bag, 1.0, -1.0)
    for _ in range(4):
        cost = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum()))
        w, bias = _svm(x, y, cost)
        margin = x @ w + bias
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner, margin)
        y = np.where(bag & ((margin > 0) | (margin >= top[owner])), 1.0, -1.0)
    model = ToxicityModel(marks, own, root @ w, bias, np.zeros(5))
    figures = np.concatenate([model.figures(texts[k : k + 256]) for k in range(0, len(texts), 256)])
    model.curve = _logistic(figures, labels.astype(float))
    model.known, model.weight, model.ends = {}, [], []
    return model


def features_of_marks(marks: list[str], own: np.ndarray) -> np.ndarray:
    k = (subsequence_kernel(marks, marks) / np.sqrt(own[:, None] * own[None, :])) ** POWER
    return (k + k.T) / 2


_models: dict[bytes, ToxicityModel] = {}


def _scorer(packed: bytes, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        from fluentlake.llm import toxicity

        if packed not in toxicity._models:
            toxicity._models.clear()
            toxicity._models[packed] = pickle.loads(packed)
        model = toxicity._models[packed]
        for batch in batches:
            k, scores = 0, []
            while k < len(batch):
                part, size = [], 0
                while k < len(batch) and (not part or size < 1 << 22):
                    part.append(batch.column(2)[k].as_py())
                    size += len(part[-1])
                    k += 1
                scores.append(model.scores(part))
            found = np.concatenate([np.zeros(0), *scores])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def training_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, modulus: int, held: int, most: int) -> tuple[list[bytes], np.ndarray]:
    """At most `most` labelled documents of each class that aren't held out, drawn by a hash of the id. Ids that repeat in docs
    give all their texts, up to four rows a drawn id in all, which keeps the sample bounded."""
    usable = labels.where((crc_mod("doc_id", modulus) != held) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    drawn = [usable.where(F.col("toxic") == y).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(most) for y in (0, 1)]
    chosen = drawn[0].union(drawn[1]).toDF("_id", "_toxic")
    rows = docs.select(F.col(doc_id).alias("_id"), text_bytes(text).alias("_text")).join(F.broadcast(chosen), "_id").orderBy(F.md5(F.col("_id").cast("string").cast("binary")), "_id", "_text").limit(4 * most).select("_text", "_toxic").collect()
    return [bytes(r["_text"]) for r in rows], np.array([r["_toxic"] for r in rows], np.int64)


def toxicity_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 3, held: int = 1, threshold: float = 0.7, most: int = MAX_SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. labels: doc_id, toxic (0 or 1)."""
    import pickle

    texts, y = training_sample(docs, labels, doc_id, text, modulus, held, most)
    packed = pickle.dumps(train(texts, y))
    read = docs.select(F.col(doc_id).alias("doc_id"), (crc_mod(doc_id, modulus) == held).alias("held_out"), text_bytes(text).alias("text"))
    return read.mapInArrow(_scorer(packed, threshold), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, held_out boolean, score double, predicted int")
