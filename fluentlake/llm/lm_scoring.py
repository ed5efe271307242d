"""Op 3: language-model scores by a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Tokens are words and one end per text. Counts are of all training tokens, and exact. The model is a tree: it predicts a
token's class from the `context` tokens before it, then the token's group within the class, then the token within the
group, each by a softmax over the children of one node: log P = log P(class | context) + log P(group | class, context) +
log P(token | group, context). The most common words and the end are classes of their own; other words share classes by
the size of their count and the end of the word, unknown words with those of count 1. Every word of count 7 or more has a
vector of its own, so the vocabulary with vectors grows with the corpus; groups have about GROUP words, and a class as many
groups as it needs. The rarer words of a class follow its counts: log10((c + 1) / mass of the class). A context is the
classes of the tokens before. A matrix product of a batch of predicted vectors with the vectors of a node's children
gives the normalised probabilities.

1. Blocks of texts are encoded with a dictionary of their own: a row per document (numbers of its words, common words
   first, compressed) and a row per distinct word of the block (its training count there). This is written once.
2. Counts per word are summed, and joined back to the blocks' dictionaries, but for words with count 1, whose class
   follows from how they end; each block's documents meet their dictionary by a cogroup, whose groups are bounded by the
   block. It writes a row per document, and one with the block's tokens, from which the tokens that pass each node are
   taken when they are dealt. Nothing that grows with the corpus is broadcast.
3. Each training round of the model of classes, every task trains on the documents that it reads, from the same start, and
   the parameters are averaged by tokens, in two levels. All training documents take part. Then tokens are dealt by node and
   part of a node (a part has about PART_TOKENS), and each node learns the vectors of its children, with the classes' vectors
   as contexts. A task holds one node at a time. A node of one part scores its tokens, held out or not, as soon as it has
   learnt, so they are dealt once; nodes of several parts are averaged as before, and their tokens dealt again.
4. The nodes' scores, summed per document over the nodes of a task, meet those of the classes by block.

Scores depend on how the input is split among tasks, as training does; with the same split reruns agree up to rounding.
Null text counts as empty, a null id as an empty one. Repeated rows count and are scored again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluentlake.llm.shared import crc_mod, delete_between, made, stored, text_bytes

#: Words that are classes of their own, and classes of all others: by count (6) and by the word's last two bytes (10).
COMMON, BY_COUNT, BY_END = 195, 6, 10
CLASSES = 1 + COMMON + BY_COUNT * BY_END
CONTEXT, WIDTH, NOISE, BATCH = 3, 24, 64, 2048
#: Text of a block, about: runs of rows are cut into even blocks.
BLOCK_BYTES = 10 << 20
#: Words with vectors of their own within a class (those of count 7 or more), the size of their groups, the tokens of a node
#: that one task trains on at a time, and the start of AdaGrad's sums.
VECTORS = f"cls >= {1 + COMMON + 2 * BY_END}"
GROUP, PART_TOKENS, NODE_BATCH, DAMPING = 256, 1 << 22, 1024, 4.0
#: Tokens after a class from which on the sums of a softmax are made for all contexts that end with it; see Softmax.
OFTEN = 2000
#: Tokens of a node that are scored at once, of some blocks.
SCORED = 1 << 15
#: Parts of a group at most (of 13 bits), and documents whose sums a task holds before it hands them on.
MOST_PARTS, SUMS = 4096, 1 << 20
_TOKEN = 8 + 2 * CONTEXT
_MEAN = "node long, n long, children long, params binary"
#: Class, group and one, place in the group and parts of a word, in one number.
_PLACE = "cls + shiftleft(grp + 1L, 8) + shiftleft(cast(slot as long), 32) + shiftleft(cast(parts as long), 50)"
_BLOCKS = "block long, doc_id long, held_out boolean, ids binary, ends binary, idx int, word binary, count long"


_press, _open = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def press(data: bytes | np.ndarray) -> bytes:
    return _press.compress(data)


def opened(raw: bytes) -> bytes:
    return _open.decompress(raw)


def pack(ids: np.ndarray) -> bytes:
    """Compressed numbers: all lowest bytes first, then the next ones."""
    return press(ids.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(opened(raw), np.uint8).reshape(4, -1).T).view("<i4").ravel()


class _Endings(dict):
    """Classes of words by their ends."""

    def __missing__(self, end: bytes) -> int:
        self[end] = place = zlib.crc32(end) % BY_END
        return place


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of texts as bytes: tokens per text, numbers of all tokens and the words with these numbers, in the order in which they
    come, after the end of a text with 0. Words are those of bytes.lower().split(): Arrow's blanks of ASCII are the same."""
    kind = pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()
    lower = pc.ascii_lower(pa.Array.from_buffers(kind, len(texts), texts.buffers(), offset=texts.offset))
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(lower))
    coded = pa.concat_arrays([pa.array([""], kind), split.flatten()]).dictionary_encode()
    codes, lengths = coded.indices.to_numpy()[1:], split.value_lengths().to_numpy()
    lengths = lengths - (codes[np.cumsum(lengths) - 1] == 0)  # an empty text gives one empty word
    codes, lengths = codes[codes > 0], lengths + 1
    tokens, inner = np.zeros(len(codes) + len(lengths), np.int32), np.ones(len(codes) + len(lengths), bool)
    inner[np.cumsum(lengths) - 1] = False
    tokens[inner] = codes
    return lengths, tokens, coded.dictionary.cast(pa.binary())


def _encode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    names = ["block", "doc_id", "held_out", "ids", "ends", "idx", "word", "count"]
    number, ending = TaskContext.get().partitionId() << 24, _Endings()
    for batch in batches:
        sizes = pc.binary_length(batch.column(2)).to_pylist()
        k, total = 0, sum(sizes)
        most = total / max(1, -(-total // BLOCK_BYTES))
        while k < len(batch):
            size, begin = 0, k
            while k < len(batch) and (k == begin or size < most):
                size += sizes[k]
                k += 1
            n = k - begin
            lengths, tokens, words = _words(batch.column(2).slice(begin, n))
            m, away = len(words), np.array([bool(x) for x in batch.column(1).slice(begin, n).to_pylist()])
            counts = np.bincount(tokens[np.repeat(~away, lengths)], minlength=m)
            common = np.argsort(-np.bincount(tokens, minlength=m), kind="stable")
            place = np.empty(m, np.int32)
            place[common] = np.arange(m)
            last = pc.binary_slice(words, -2).dictionary_encode()
            ends = np.empty(m, np.uint8)
            ends[place] = np.array([ending[w] for w in last.dictionary.to_pylist()], np.uint8)[last.indices.to_numpy()]
            cut, whole = np.cumsum(lengths).tolist(), np.frombuffer(planes(place[tokens]), np.uint8).reshape(4, -1)
            encoded = [press(whole[:, a:b].tobytes()) for a, b in zip([0, *cut[:-1]], cut, strict=True)]  # as pack has it
            nothing = lambda count, kind: pa.nulls(count, kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), batch.column(0).slice(begin, n), batch.column(1).slice(begin, n), pa.array(encoded, pa.binary()), pa.array([zstandard.compress(ends.tobytes(), 1)] + [None] * (n - 1), pa.binary()), nothing(n, pa.int32()), nothing(n, pa.binary()), nothing(n, pa.int64())], names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number)), nothing(m, pa.int64()), nothing(m, pa.bool_()), nothing(m, pa.binary()), nothing(m, pa.binary()), pa.array(place, pa.int32()), words, pa.array(counts, pa.int64())], names)
            number += 1


def planes(numbers: np.ndarray) -> bytes:
    """All lowest bytes first, then the next ones: the high bytes are mostly alike. For rows, those of a column together."""
    return b"".join((column >> 8 * k).astype(np.uint8).tobytes() for column in (numbers.T if numbers.ndim > 1 else [numbers]) for k in range(numbers.itemsize))


def _whole(parts: np.ndarray, kind: type) -> np.ndarray:
    """Numbers from their planes."""
    out = parts[0].astype(kind)
    for k in range(1, len(parts)):
        if parts[k].any():
            out |= parts[k].astype(kind) << 8 * k
    return out


def tokens_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents (places in the block, kept as steps), children and contexts of the tokens of a node; see _passing."""
    data = np.frombuffer(opened(raw), np.uint8).reshape(_TOKEN, -1)
    seen = np.stack([_whole(data[k : k + 2], np.int64) for k in range(8, _TOKEN, 2)])
    return np.cumsum(_whole(data[:4], np.int32), dtype=np.int32), _whole(data[4:8], np.int64), seen.T


def _score_counts(total: float, mass: np.ndarray):
    """For a block: its documents and its dictionary with corpus counts, classes and places of the words in their groups.
    A row per document, and one for the block with the lengths of its documents, their sides of the split, and its tokens."""

    def run(key: tuple, docs: pa.Table, words: pa.Table) -> pa.Table:
        block, n = key[0].as_py(), len(docs)
        ends = np.frombuffer(zstandard.decompress(next(x for x in docs.column("ends").to_pylist() if x is not None)), np.uint8)
        c, cls = np.ones(len(ends), np.int64), (1 + COMMON + ends).astype(np.uint8)  # as words with count 1, which have no row
        at = words.column("idx").to_numpy()
        place = words.column("place").to_numpy()  # see _PLACE
        c[at], cls[at] = words.column("c").to_numpy(), place & 255
        spot = cls.astype(np.int64)
        spot[at] = place
        base = np.log10((c + 1) / total)
        within = np.where(spot < 256, np.log10((c + 1) / mass[cls]), 0)  # words without vectors
        texts = [unpack(raw) for raw in docs.column("ids").to_pylist()]
        tokens, lengths = np.concatenate(texts), np.array([len(ids) for ids in texts])
        starts, cut = np.cumsum(lengths) - lengths, cls[tokens].tobytes()
        known, bases, rare = (np.add.reduceat(x[tokens], starts) for x in ((c > 0).astype(np.int64), base, within))
        rows = pa.table({"block": np.full(n, block), "pos": pa.array(np.arange(n), pa.int32()), "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(lengths, pa.int64()), "n_known": pa.array(known), "base_score": pa.array(bases), "within": pa.array(rare), "classes": pa.array([cut[a : a + k] for a, k in zip(starts.tolist(), lengths.tolist(), strict=True)], pa.binary()), "data": pa.nulls(n, pa.binary())})
        data = zstandard.compress(np.array([n], "<i8").tobytes() + lengths.astype("<i4").tobytes() + np.asarray(docs.column("held_out"), np.uint8).tobytes() + planes(spot[tokens]), 1)
        whole = pa.table({f.name: pa.array([{"block": block, "data": data}.get(f.name)], f.type) for f in rows.schema})
        return pa.concat_tables([rows, whole])

    return run


def _passing(groups: np.ndarray, class_parts: np.ndarray, split: bool = False):
    """From the tokens of blocks, a row per node of the tree and side of the split with the tokens that pass it. They are
    not stored, as they take far more room than the blocks. split: of nodes of several parts alone."""
    offsets = np.cumsum(groups + 1) - groups - 1  # nodes numbered one after the other

    def rows_of(block: int, raw: bytes) -> pa.RecordBatch | None:
        whole = opened(raw)
        n = int(np.frombuffer(whole, "<i8", 1)[0])
        lengths, away = np.frombuffer(whole, "<i4", n, 8), np.frombuffer(whole, np.uint8, n, 8 + 4 * n)
        spot = _whole(np.frombuffer(whole, np.uint8, -1, 8 + 5 * n).reshape(8, -1), np.int64)
        cls = spot.astype(np.uint8)
        places = np.flatnonzero(spot >= 256)  # tokens with vectors
        spot = spot[places]
        k, group, parts = spot & 255, (spot >> 8 & (1 << 24) - 1) - 1, spot >> 50
        below, inner = np.flatnonzero(parts > split), np.flatnonzero((groups[k] > 1) & (class_parts[k] > split))  # classes of several groups have a node that predicts the group
        if not len(below) + len(inner):
            return None
        dense = np.concatenate([(offsets[k] + group + 1)[below], offsets[k[inner]]])
        child = np.concatenate([(spot >> 32 & (1 << 18) - 1)[below], group[inner]])
        of = np.concatenate([parts[below], class_parts[k[inner]]])
        doc = np.repeat(np.arange(n, dtype=np.int32), lengths)
        places = np.concatenate([places[below], places[inner]])
        dense = dense * 2 + away[doc[places]]
        order = np.argsort(dense.astype(np.uint16), kind="stable")
        if dense.max() >> 16:
            order = order[np.argsort((dense >> 16).astype(np.uint32)[order], kind="stable")]
        side = dense[order]
        cuts = np.flatnonzero(np.diff(side, prepend=-1))
        first, side = order[cuts], side[cuts]
        kind = np.searchsorted(offsets, side >> 1, "right") - 1
        node, number = (kind << 40) + (side >> 1) - offsets[kind], zlib.crc32(b"%d" % block)
        places, child = places[order], child[order].astype("<i4")
        steps = np.diff(doc[places], prepend=np.int32(0))
        steps[cuts] = doc[places[cuts]]
        seen = contexts_of(cls, lengths)
        whole = np.concatenate([np.frombuffer(planes(x), np.uint8).reshape(-1, len(order)) for x in (steps, child, *(x.astype("<u2")[places] for x in seen))])
        data = [press(np.ascontiguousarray(whole[:, a:b])) for a, b in zip(cuts, [*cuts[1:], len(order)][: len(cuts)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array((number % of[first]).astype(np.int32)), pa.array(np.full(len(cuts), block)), pa.array((side & 1).astype(bool)), pa.array(data, pa.binary())], ["node", "part", "block", "held_out", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0), batch.column(1), strict=True):
                if (rows := rows_of(block.as_py(), raw.as_py())) is not None:
                    yield rows

    return run


_cells = np.arange(WIDTH // 2).reshape(1, WIDTH // 2)


def _sum_rows(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """n rows: the sums of the rows with the same place. Two columns are added at a time, as a complex number."""
    global _cells
    if len(_cells) < n:
        _cells = np.arange(n * (WIDTH // 2)).reshape(n, WIDTH // 2)
    total = np.zeros((n, WIDTH), np.float32)
    np.add.at(total.reshape(-1).view(np.complex64), _cells.take(at, axis=0).reshape(-1), rows.reshape(-1).view(np.complex64))
    return total


_room: dict[str, np.ndarray] = {}


def _buffer(name: str, rows: int, columns: int) -> np.ndarray:
    """Memory that the steps of a worker use again."""
    if name not in _room or _room[name].size < rows * columns:
        _room[name] = np.empty(rows * columns, np.float32)
    return _room[name][: rows * columns].reshape(rows, columns)


def _log_softmax(q: np.ndarray, rows: np.ndarray, child: np.ndarray) -> np.ndarray:
    """Natural logarithms of the normalised probabilities of children, from predicted vectors, for scores of any size."""
    out, most = np.empty(len(child), np.float32), max(16, (1 << 17) // len(rows))
    for k in range(0, len(child), most):
        scores = q[k : k + most] @ rows.T
        scores -= scores.max(axis=1)[:, None]
        out[k : k + most] = scores[np.arange(len(scores)), child[k : k + most]] - np.log(np.exp(scores).sum(axis=1))
    return out


class Softmax:
    """Natural logarithms of the normalised probabilities of a node's children, by the classes of the context. A score is a
    sum over the places of the context, so its exponential is a product of a factor for each place, and the sum over the
    children is a product of three rows of factors. For a class that comes often right before, a matrix product makes these
    sums for all pairs of classes in the other places."""

    def __init__(self, places: np.ndarray, rows: np.ndarray):
        self.places, self.rows, self.n = places, rows, len(rows)
        self.scores = places @ rows.T
        self.factors = np.exp(self.scores) if np.abs(self.scores).max(axis=(1, 2)).sum() < 60 else None  # else out of the range of floats
        self.sums, self.met, self.made = None, np.zeros(CLASSES + 1, np.int64), np.zeros(CLASSES + 1, bool)

    def __call__(self, seen: np.ndarray, child: np.ndarray) -> np.ndarray:
        """seen: by place of the context, the last class first; child: both as whole numbers of 64 bits."""
        if self.factors is None:
            return _log_softmax(_predicted(self.places, seen), self.rows, child)
        picked = self.scores[0].reshape(-1).take(seen[0] * self.n + child)
        for k in range(1, CONTEXT):
            picked += self.scores[k].reshape(-1).take(seen[k] * self.n + child)
        return picked - self.log_sums(seen)

    def log_sums(self, seen: np.ndarray) -> np.ndarray:
        last, later, (first, *rest) = seen[0], seen[1:], self.factors
        self.met += np.bincount(last, minlength=CLASSES + 1)
        for x in np.flatnonzero(~self.made & (self.met > OFTEN)):
            if self.sums is None:
                self.sums = np.empty((CLASSES + 1,) * CONTEXT, np.float32)
            self.sums[x] = np.log((rest[0] * first[x]) @ rest[1].T)
            self.made[x] = True
        if self.sums is None:
            return self._few(seen)
        known = self.made.take(last)
        out = self.sums.reshape(-1).take(((last * (CLASSES + 1) + later[0]) * (CLASSES + 1) + later[1]) * known)
        if not known.all():
            others = np.flatnonzero(~known)
            out[others] = self._few(seen[:, others])
        return out

    def _few(self, seen: np.ndarray) -> np.ndarray:
        out, most = np.empty(seen.shape[1], np.float32), max(16, (1 << 16) // self.n)  # few rows at once stay in the processor's cache
        for k in range(0, len(out), most):
            some = seen[:, k : k + most]
            product = self.factors[0].take(some[0], axis=0, out=_buffer("product", some.shape[1], self.n), mode="clip")
            product *= self.factors[1].take(some[1], axis=0, out=_buffer("factor", some.shape[1], self.n), mode="clip")
            out[k : k + most] = np.vecdot(product, self.factors[2].take(some[2], axis=0, out=_buffer("factor", some.shape[1], self.n), mode="clip"))
        return np.log(out)


def _predicted(places: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Predicted vectors and a one each, from contexts by place (CONTEXT x tokens)."""
    out = places[0].take(seen[0], axis=0)
    for k in range(1, CONTEXT):
        out += places[k].take(seen[k], axis=0)
    return out


def _contrast(q: np.ndarray, rows: np.ndarray, log_share: np.ndarray, child: np.ndarray, noise: np.ndarray, pull: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Noise-contrastive estimation: for a batch with shared noise words, the gradients of the rows (vector and bias) and, if
    asked for, those of the predicted vectors. Noise counts as wrong; a word that is drawn often is worked out once."""
    times = np.bincount(noise, minlength=len(rows)).astype(np.float32)
    noise = np.flatnonzero(times)
    odds = rows.copy()
    odds[:, WIDTH] -= log_share
    true, drawn = odds.take(child, axis=0), odds.take(noise, axis=0)
    times = times.take(noise)[:, None]
    by_column, weighed = np.ascontiguousarray(-drawn.T), drawn[:, :WIDTH] * times
    up = 1 / (1 + np.exp(np.minimum((q * true) @ np.ones(WIDTH + 1, np.float32), 80)))
    wrong, most = np.zeros((len(noise), WIDTH + 1), np.float32), 1024  # rows at once stay in the processor's cache
    dq = up[:, None] * true[:, :WIDTH] if pull else None
    for k in range(0, len(child), most):
        some = q[k : k + most]
        share = np.matmul(some, by_column, out=_buffer("share", len(some), len(noise)))
        with np.errstate(over="ignore"):  # beyond the range of floats the share is 0
            np.exp(share, out=share)
        share += 1
        np.reciprocal(share, out=share)
        wrong -= share.T @ some
        if pull:
            dq[k : k + most] -= share @ weighed
    grad = np.empty_like(rows)
    grad[:, :WIDTH] = _sum_rows(child, up[:, None] * q[:, :WIDTH], len(rows))
    grad[:, WIDTH] = np.bincount(child, up, len(rows))
    grad[noise] += wrong * times
    return grad, dq


class LogBilinear:
    """Class vectors as context and as target, a diagonal weight per place of the context, and a bias per target class, which
    is the last column of the targets' rows."""

    def __init__(self, share: np.ndarray, params: np.ndarray | None = None):
        self.share, self.log_share, self.drawn = share, np.log(share * NOISE).astype(np.float32), np.cumsum(share)
        self.drawn /= self.drawn[-1]
        shapes = [(CLASSES + 1, WIDTH), (CLASSES, WIDTH + 1), (CONTEXT, WIDTH)]
        if params is None:
            rng = np.random.default_rng(3)
            context, target = rng.normal(0, 0.1, shapes[0]), rng.normal(0, 0.1, (CLASSES, WIDTH))
            params = np.concatenate([context.ravel(), np.column_stack([target, np.log(share)]).ravel(), np.full(CONTEXT * WIDTH, 0.5)])
        self.flat = params.astype(np.float32)
        self.cut = lambda flat: (flat[a:b].reshape(s) for a, b, s in zip(cuts[:-1], cuts[1:], shapes, strict=True))
        cuts = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
        self.context, self.rows, self.place = self.cut(self.flat)

    def places(self) -> np.ndarray:
        """Class vectors weighed for each place of the context, with a column whose sum over the places is one."""
        out = np.zeros((CONTEXT, CLASSES + 1, WIDTH + 1), np.float32)
        np.multiply(self.context, self.place[:, None], out=out[:, :, :WIDTH])
        out[0, :, WIDTH] = 1
        return out

    def predicted(self, seen: np.ndarray) -> np.ndarray:
        """Predicted vectors from contexts (tokens x CONTEXT)."""
        return _predicted(self.places(), by_place(seen))[:, :WIDTH]

    def log_probabilities(self, seen: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithms of the normalised probabilities of the target classes."""
        return Softmax(self.places(), self.rows)(by_place(seen), targets)

    def train(self, seen: np.ndarray, targets: np.ndarray, rate: float, state: np.ndarray, rng: np.random.Generator) -> None:
        """A step of noise-contrastive estimation (AdaGrad) on a batch (contexts by place); the noise words are shared by the
        batch."""
        noise = self.drawn.searchsorted(rng.random(NOISE), "right")
        grad, ones = np.zeros_like(self.flat), np.ones(CLASSES + 1, np.float32)
        g_context, g_rows, g_place = self.cut(grad)
        g_rows[:], dq = _contrast(_predicted(self.places(), seen), self.rows, self.log_share, targets, noise, True)
        for k in range(CONTEXT):
            sums = _sum_rows(seen[k], dq, CLASSES + 1)
            g_place[k] = ones @ (sums * self.context)
            g_context += sums * self.place[k]
        grad /= len(targets)
        state += grad * grad
        self.flat += rate * grad / np.sqrt(state + 1e-8)


def by_place(seen: np.ndarray) -> np.ndarray:
    """Contexts (tokens x CONTEXT) by place, as indices."""
    return np.ascontiguousarray(seen.T, np.int64)


def contexts_of(classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """By place of the context, the classes before each token of texts of these lengths. Before a text, the extra class
    CLASSES."""
    starts = (np.cumsum(lengths) - lengths)[np.asarray(lengths) > 0]
    seen = np.full((CONTEXT, len(classes)), CLASSES, np.int64)
    for k in range(CONTEXT):
        seen[k, k + 1 :] = classes[: -k - 1]
        for j in range(k + 1):
            at = starts + j
            seen[k, at[at < len(classes)]] = CLASSES
    return seen


def contexts(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts (tokens x CONTEXT) and targets of texts given as classes, and where texts begin."""
    lengths = np.array([len(x) for x in raw])
    classes = np.frombuffer(b"".join(raw), np.uint8)
    return contexts_of(classes, lengths).T, classes.astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])


def _runs(column: pa.Array, most: int = 1 << 17) -> Iterator[tuple[int, list[bytes]]]:
    k = 0
    while k < len(column):
        begin, part, size = k, [], 0
        while k < len(column) and (not part or size < most):
            part.append(column[k].as_py())
            size += len(part[-1])
            k += 1
        yield begin, part


def _train(share: np.ndarray, params: np.ndarray | None, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rng, count = LogBilinear(share, params), np.random.default_rng(11), 0
        state = np.zeros_like(model.flat)
        for batch in batches:
            for _, part in _runs(batch.column(0)):
                seen, targets, _ = contexts(part)
                order = rng.permutation(len(targets))
                seen, targets = by_place(seen).take(order, axis=1), targets[order]
                for k in range(0, len(order), BATCH):
                    model.train(seen[:, k : k + BATCH], targets[k : k + BATCH], rate, state, rng)
                count += len(targets)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([(model.flat.astype(np.float64) * count).tobytes()], pa.binary())], ["n", "params"])

    return run


def _sum_params(key: tuple, table: pa.Table) -> pa.Table:
    total = None
    for x in table.column("params").to_pylist():
        total = np.frombuffer(x, np.float64) + (0 if total is None else total)
    return pa.table({"salt": pa.array([0], pa.int32()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "params": pa.array([total.tobytes()], pa.binary())})


class Node:
    """The children of a node of the tree: vectors and biases, which begin as the counts have it. The context's predicted
    vector comes from the model of classes."""

    def __init__(self, counts: np.ndarray, params: bytes | None = None):
        n = len(counts)
        self.share = (counts + 1e-3) / (counts + 1e-3).sum()
        self.flat = np.column_stack([np.zeros((n, WIDTH)), np.log(self.share)]).astype(np.float32).ravel() if params is None else np.frombuffer(params, np.float32)
        self.rows = self.flat.reshape(n, WIDTH + 1)  # the last column has the biases
        self.log_share, self.drawn = np.log(self.share * NOISE).astype(np.float32), np.cumsum(self.share)
        self.drawn /= self.drawn[-1]
        self.state = np.full((n, WIDTH + 1), DAMPING, np.float32)

    def log_probabilities(self, q: np.ndarray, child: np.ndarray) -> np.ndarray:
        return _log_softmax(_with_ones(q), self.rows, child)

    def train(self, q: np.ndarray, child: np.ndarray, rate: float, rng: np.random.Generator) -> None:
        """A step of noise-contrastive estimation (AdaGrad); a word's first steps are short, as the state begins at DAMPING."""
        noise = self.drawn.searchsorted(rng.random(NOISE), "right")
        grad, _ = _contrast(q if q.shape[1] > WIDTH else _with_ones(q), self.rows, self.log_share, child, noise, False)
        self.state += grad * grad
        self.rows += rate * grad / np.sqrt(self.state)


def _with_ones(q: np.ndarray) -> np.ndarray:
    return np.column_stack([q, np.ones(len(q), np.float32)])


class Sums:
    """Log10 probabilities per document of a block, summed over the nodes of a task as far as they fit."""

    def __init__(self):
        self.held, self.size = {}, 0

    def add(self, softmax: Softmax, found: list[tuple[int, bytes]]) -> None:
        """found: tokens of the node by block. Those of some blocks are scored at once, as a block has few."""
        held, size = [], 0
        for k, (block, data) in enumerate(found):
            held.append((block, *tokens_of(data)))
            size += len(held[-1][1])
            if size >= SCORED or k == len(found) - 1:
                logs = softmax(by_place(np.concatenate([x[3] for x in held])), np.concatenate([x[2] for x in held])).astype(np.float64)
                logs /= np.log(10)
                for block, doc, *_ in held:
                    self._sum(block, doc, logs[: len(doc)])
                    logs = logs[len(doc) :]
                held, size = [], 0

    def _sum(self, block: int, doc: np.ndarray, logs: np.ndarray) -> None:
        total = self.held.get(block, np.zeros(0))
        if len(total) <= doc[-1]:  # documents ascend
            longer = np.zeros(max(int(doc[-1]) + 1, 2 * len(total)))
            longer[: len(total)] = total
            self.size += len(longer) - len(total)
            self.held[block] = total = longer
        begin = np.flatnonzero(np.diff(doc, prepend=-1))
        total[doc[begin]] += np.add.reduceat(logs, begin)

    def rows(self) -> list[tuple[int, bytes, bytes]]:
        out = [(block, pack(at := np.flatnonzero(total)), total[at].astype(np.float32).tobytes()) for block, total in self.held.items()]
        self.held, self.size = {}, 0
        return out


_LEARNT = "node long, part int, n long, children long, params binary, block long, pos binary, logs binary"


def _learn_nodes(share: np.ndarray, params: np.ndarray, rate: float):
    """Rows come by node and part, the counts of its children first. Tokens are taken in batches across blocks; then a node
    of one part scores its tokens, those of held-out documents too, and one of several hands on its parameters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, at, node, size, held, kept, sums = LogBilinear(share, params).places(), None, None, 0, [], [], Sums()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in _LEARNT.split(", ")]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        def step() -> int:
            child, seen = np.concatenate([x for x, _ in held]), by_place(np.concatenate([x for _, x in held]))
            held.clear()
            order = np.random.default_rng(len(child)).permutation(len(child))
            for k in range(0, len(order), NODE_BATCH):
                some = order[k : k + NODE_BATCH]
                node.train(_predicted(places, seen.take(some, axis=1)), child[some], rate, rng)
            return len(child)

        def done() -> list[tuple]:
            n = size + (step() if held else 0)
            if at[2] > 1:
                return [(*at[:2], n, len(node.share), node.flat.tobytes(), None, None, None)]
            sums.add(Softmax(places, node.rows), kept)
            kept.clear()
            return [(None,) * 5 + x for x in sums.rows()] if sums.size > SUMS else []

        for batch in batches:
            for key, part, parts, children, counts, data, block, away in zip(*(batch.column(k) for k in range(8)), strict=True):
                if data.as_py() is None:
                    if node is not None and (rows := done()):
                        yield table(rows)
                    at, size, rng, children = (key.as_py(), part.as_py(), parts.as_py()), 0, np.random.default_rng(11), np.array(children.as_py())
                    of = np.zeros(children.max() + 1)
                    of[children] = counts.as_py()
                    node = Node(of)
                    continue
                if at[2] == 1:
                    kept.append((block.as_py(), data.as_py()))
                if not away.as_py():
                    held.append(tokens_of(data.as_py())[1:])
                    if sum(len(x) for x, _ in held) >= 16 * NODE_BATCH:
                        size += step()
        if node is not None and (rows := done() + [(None,) * 5 + x for x in sums.rows()]):
            yield table(rows)

    return run


def _mean_params(key: tuple, table: pa.Table) -> pa.Table:
    n = table.column("n").to_numpy() + 1
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) * w for x, w in zip(table.column("params").to_pylist(), n, strict=True))
    return pa.table({"node": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([int(n.sum())], pa.int64()), "children": table.column("children")[:1], "params": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())})


def _score_nodes(share: np.ndarray, params: np.ndarray):
    """Rows come by node and part, its parameters first: sums of log10 probabilities per document of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, softmax, kept, sums = LogBilinear(share, params).places(), None, [], Sums()
        table = lambda: pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*sums.rows(), strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "pos", "logs"])
        for batch in batches:
            for block, children, learnt, data in zip(*(batch.column(k) for k in range(4)), strict=True):
                if data.as_py() is None:
                    if kept:
                        sums.add(softmax, kept)
                        kept.clear()
                    softmax = Softmax(places, Node(np.ones(children.as_py()), learnt.as_py()).rows)
                    continue
                kept.append((block.as_py(), data.as_py()))
                if len(kept) >= 16:
                    sums.add(softmax, kept)
                    kept.clear()
                if sums.size > SUMS:
                    yield table()
        if kept:
            sums.add(softmax, kept)
        if sums.size:
            yield table()

    return run


_DOCUMENT = "block long, pos int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score_classes(share: np.ndarray, params: np.ndarray):
    """What the model of classes and the rare words' counts say of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LogBilinear(share, params)
        softmax = Softmax(model.places(), model.rows)
        for batch in batches:
            found, docs = np.zeros(len(batch)), pa.Table.from_batches([batch])
            for begin, part in _runs(batch.column(batch.schema.get_field_index("classes"))):
                seen, targets, bounds = contexts(part)
                logs = softmax(by_place(seen), targets)
                found[begin : begin + len(part)] = np.add.reduceat(logs.astype(np.float64), bounds[:-1]) / np.log(10)
            found += docs.column("within").to_numpy()
            yield from docs.drop_columns(["classes", "within"]).append_column("score", pa.array(found)).to_batches()

    return run


def _add_sums(key: tuple, docs: pa.Table, sums: pa.Table) -> pa.Table:
    """For a block: its documents, and what the nodes of the tree add to them."""
    more = np.zeros(len(docs))
    for pos, logs in zip(sums.column("pos").to_pylist(), sums.column("logs").to_pylist(), strict=True):
        more[unpack(pos)] += np.frombuffer(logs, np.float32)
    scores = docs.column("score").to_numpy() + more[docs.column("pos").to_numpy()]
    return pa.table({c: docs.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")} | {"score": pa.array(scores)})


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 7, held: int = 2, rates: tuple[float, ...] = (0.1, 0.03), node_rate: float = 0.1) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). Documents whose
    crc32(id) modulo `modulus` is `held` are held out. rates: the learning rate of each round over the model of classes;
    node_rate: that of the one round over the nodes below them."""
    spark, mark = docs.sparkSession, made()
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (crc_mod(doc_id, modulus) == held).alias("held_out"), text_bytes(text).alias("text"))
    blocks = stored(read.mapInArrow(_encode_blocks, _BLOCKS), "blocks", "zstd")
    words = blocks.where("word is not null").select("block", "idx", "word", "count")
    counts = stored(words.groupBy("word").agg(F.sum("count").alias("c")), "counts", "zstd")
    encoded = made()
    told = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    top = [r["word"] for r in counts.where("word != X'' and c > 0").orderBy(F.desc("c"), "word").limit(COMMON).select("word").collect()]
    own = spark.createDataFrame([(b"", 0), *((bytes(w), k + 1) for k, w in enumerate(top))], "word binary, own int")
    size = F.least(F.greatest(F.floor(F.log2(F.col("c") + 1)), F.lit(1)), F.lit(BY_COUNT)).cast("int") - 1
    ending = F.expr(f"cast(crc32(substring(word, greatest(1, length(word) - 1), 2)) % {BY_END} as int)")
    classed = counts.join(F.broadcast(own), "word", "left").select("word", "c", F.coalesce("own", F.lit(1 + COMMON) + size * BY_END + ending).alias("cls"))
    mass = np.zeros(CLASSES)
    seen = np.full(CLASSES, 0.5)
    for r in classed.where("c > 0").groupBy("cls").agg(F.sum(F.col("c") + 1).alias("mass"), F.sum("c").alias("tokens")).collect():
        mass[r["cls"]], seen[r["cls"]] = r["mass"], r["tokens"] + 0.5
    mass[1 + COMMON : 1 + COMMON + BY_END] += 1  # one unknown word for each class of words that end alike
    mass = np.maximum(mass, 1)
    share = seen / seen.sum()

    # words with vectors: groups within their classes by hash, a place in the group, and how many parts train it
    classes = np.arange(CLASSES)
    members, tokens = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in classed.where(VECTORS).groupBy("cls").agg(F.count("*").alias("n"), F.sum("c").alias("tokens")).collect():
        members[r["cls"]], tokens[r["cls"]] = r["n"], r["tokens"]
    groups, class_parts = np.maximum(1, -(-members // GROUP)), 1 + tokens // PART_TOKENS
    by_class = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cls") + 1)
    in_group = Window.partitionBy("cls", "grp")
    own = classed.where(VECTORS).withColumn("grp", F.crc32("word") % by_class(groups))
    own = own.withColumn("slot", F.row_number().over(in_group.orderBy("word")) - 1).withColumn("parts", F.least(F.floor(F.sum("c").over(in_group) / PART_TOKENS) + 1, F.lit(MOST_PARTS)))
    own = stored(own.select("word", "c", "cls", "grp", "slot", "parts"), "vectors", "zstd")
    by_counts = classed.where(f"not ({VECTORS}) and (c != 1 or cls <= {COMMON})").select("word", "c", F.col("cls").cast("long").alias("place"))
    dictionary = words.select("block", "idx", "word").join(own.select("word", "c", F.expr(_PLACE).alias("place")).unionByName(by_counts), "word").select("block", "idx", "c", "place")
    documents = blocks.where("ids is not null").select((F.col("block") + 0).alias("doc_block"), "doc_id", "held_out", "ids", "ends")
    schema = "block long, pos int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, classes binary, data binary"
    ready = stored(documents.groupBy("doc_block").cogroup(dictionary.groupBy("block")).applyInArrow(_score_counts(told["n"] + told["v"] + 1.0, mass), schema), "classes", "zstd")
    delete_between(spark, mark, encoded)  # no later plan reads the encoded blocks and the counts
    docs_ready = ready.where("data is null")
    passing = lambda split: ready.where("data is not null").select("block", "data").mapInArrow(_passing(groups, class_parts, split), "node long, part int, block long, held_out boolean, data binary")

    # the model of classes, by all tasks
    params = None
    for rate in rates:
        learnt = docs_ready.where("not held_out").select("classes").mapInArrow(_train(share, params, rate), "n long, params binary")
        level = learnt.withColumn("salt", F.spark_partition_id() % 32).groupBy("salt").applyInArrow(_sum_params, "salt int, n long, params binary")
        if found := level.groupBy("salt").applyInArrow(_sum_params, "salt int, n long, params binary").collect():
            params = np.frombuffer(found[0]["params"], np.float64) / found[0]["n"]
    params = LogBilinear(share).flat if params is None else params

    # the nodes below the classes, each by the tasks that have its parts
    listed = lambda child: F.array_sort(F.collect_list(F.struct(child, "c")))
    words_of = own.groupBy("cls", "grp").agg(listed("slot").alias("x"), F.first("parts").alias("parts")).select((F.shiftleft(F.col("cls").cast("long"), 40) + F.col("grp") + 1).alias("node"), "parts", F.col("x.slot").cast("array<long>").alias("at"), F.col("x.c").alias("counts"))
    sizes = own.groupBy("cls", "grp").agg(F.sum("c").alias("c")).where(by_class(groups) > 1)
    groups_of = sizes.groupBy("cls").agg(listed("grp").alias("x")).select(F.shiftleft(F.col("cls").cast("long"), 40).alias("node"), by_class(class_parts).cast("long").alias("parts"), F.col("x.grp").alias("at"), F.col("x.c").alias("counts"))
    each_part = F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part")
    heads = stored(words_of.unionByName(groups_of).select("node", each_part, "parts", "at", "counts"), "heads", "zstd")
    sent = heads.select("node", "part", "parts", "at", "counts", F.lit(None).cast("binary").alias("data"), F.lit(-1).cast("long").alias("block"), F.lit(False).alias("held_out"))
    train = sent.unionByName(passing(False).select("node", "part", "data", "block", "held_out"), allowMissingColumns=True)
    dealt = lambda rows, *columns: rows.repartition("node", "part").sortWithinPartitions("node", "part", "block").select(*columns)
    learnt = dealt(train, "node", "part", "parts", "at", "counts", "data", "block", "held_out").mapInArrow(_learn_nodes(share, params, node_rate), _LEARNT)
    first = stored(learnt, "nodes", "zstd", batch=1000)
    sums, split = first.where("block is not null").select("block", "pos", "logs"), heads.where("parts > 1").select("node", "part")
    if not split.isEmpty():  # nodes of several parts score after their parameters are averaged
        halfway = first.where("node is not null").groupBy("node", (F.col("part") % 64).alias("salt")).applyInArrow(_mean_params, _MEAN)
        models = halfway.groupBy("node").applyInArrow(_mean_params, _MEAN).join(split, "node")
        score = models.select("node", "part", "children", "params", F.lit(None).cast("binary").alias("data"), F.lit(-1).cast("long").alias("block"))
        score = score.unionByName(passing(True).select("node", "part", "data", "block"), allowMissingColumns=True)
        sums = sums.unionByName(dealt(score, "block", "children", "params", "data").mapInArrow(_score_nodes(share, params), "block long, pos binary, logs binary"))
    known = docs_ready.select("block", "pos", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "within", "classes").mapInArrow(_score_classes(share, params), _DOCUMENT)
    scored = known.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(_add_sums, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(told["n"]).cast("long").alias("train_tokens"), "base_score", "score")
