"""Op 9: byte-level BPE encoding and decoding by corpus-level merge replay.

All new distinct pieces of a block of texts lie one after the other in one array of tokens. An inverted index holds, for
each rank, the positions whose pair merges to that rank. Ranks are applied in ascending order, each to all its positions
at once; only the neighbours of merged positions are looked up again and enter the index. Pieces that are tokens
themselves are taken whole, as the public library does.

A merge may in principle create a pair of lower rank than its own, which would have to come at once; pieces where that
happens are encoded one by one, lowest rank first from the left, which is the definition.

Narrow: one pass of mapInArrow, no shuffle. Encoded words stay in a bounded table of the Python worker. A text is taken
whole, its matches in runs, so memory is bounded by the text and one run. Null and empty texts have no ids. Rows that repeat
get their own rows, an empty table gives an empty one, and other columns may have any names. Pairs of equal rank merge from
the left. The vocabulary is learnt per worker: a word is replayed once per worker and table, not once per corpus, as joining
ids back to the documents would cost a shuffle of the texts.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluentlake.llm.shared import give_back, text_bytes, worker_tables

#: Encoded words that a worker keeps, in either table; beyond it, those stay that were in more than one block.
MAX_CHUNKS = 120_000
#: Matches that are handled at once in texts that aren't cut into words.
RUN = 200_000
#: Characters from which a text isn't cut into words, but handled in runs of matches.
LONG = 1 << 22
#: Bytes of texts whose new words are learnt at once.
BLOCK = 1 << 23


class MergeReplay:
    """Encoder and decoder of one file of ranks (lines of base64 and rank)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        #: Of this pattern it is known that no match crosses the start of a word and its space, or a line break that stands alone.
        self.by_words = pattern == public_tokenizers.PATTERN
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.width = max(self.tokens) + 1
        pairs = []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append((left * self.width + right, rank))
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], np.int64)
        pairs = np.arange(65536)
        self.byte_pairs = self.rank_of(self.byte_rank[pairs >> 8], self.byte_rank[pairs & 255])
        #: Ids of words that follow a space, with that space, and of words that begin a line.
        self.tails: dict[str, tuple[int, ...]] = {}
        self.heads: dict[str, tuple[int, ...]] = {}
        #: Words of the tables that a later block had too.
        self.often: tuple[set[str], set[str]] = (set(), set())
        #: One object for each id, as millions of equal numbers would take more memory than the words.
        self.numbers = list(range(self.width))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's concatenation, -1 if it is no token."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def one(self, piece: bytes) -> list[int]:
        """A piece by the definition: the leftmost pair of the lowest rank, again and again (a heap over linked tokens)."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(len(parts) - 1) if (r := self.ranks.get(parts[k] + parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            m = after[k]
            if m < 0 or parts[k] != a or parts[m] != b:
                continue
            parts[k], parts[m] = a + b, b""
            after[k] = after[m]
            after[m] = -1
            if after[k] >= 0:
                before[after[k]] = k
            for x in (before[k], k):
                if x >= 0 and after[x] >= 0 and (r := self.ranks.get(parts[x] + parts[after[x]])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[after[x]]))
        return [self.ranks[p] for p in parts if p]

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        tokens = self.byte_rank[data]
        piece_of = np.repeat(np.arange(len(pieces)), sizes)
        count = len(tokens)
        after = np.arange(1, count + 1)
        before = np.arange(-1, count - 1)
        ends = np.cumsum(sizes)
        after[ends - 1] = count
        before[(ends - sizes)] = -1
        live = np.ones(count, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        odd: set[int] = set()

        def enter(at: np.ndarray, rank: np.ndarray, now: int) -> None:
            """Puts the pairs that begin at these positions, with these ranks, into the index."""
            found = rank >= 0
            at, rank = at[found], rank[found]
            if not len(at):
                return
            if int(rank.min()) < now:
                odd.update(piece_of[at[rank < now]].tolist())
                at, rank = at[rank >= now], rank[rank >= now]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)]
            for k, r in enumerate(rank[cuts[:-1]].tolist()):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(at[cuts[k] : cuts[k + 1]])

        at = np.flatnonzero(after < count)
        enter(at, self.byte_pairs[(data[at].astype(np.int64) << 8) | data[after[at]]], -1)
        while heap:
            r = heapq.heappop(heap)
            groups = index.pop(r)
            at = np.sort(np.concatenate(groups)) if len(groups) > 1 else groups[0]
            at = at[live[at]]
            at = at[after[at] < count]
            if not len(at):
                continue
            right = after[at]
            fits = self.rank_of(tokens[at], tokens[right]) == r
            fits[1:] &= at[1:] != at[:-1]
            at, right = at[fits], right[fits]
            if not len(at):
                continue
            if len(at) > 1 and (clash := right[:-1] == at[1:]).any():
                start = np.concatenate([[True], ~clash])
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                at, right = at[nth % 2 == 0], right[nth % 2 == 0]
            live[right] = False
            tokens[at] = r
            beyond = after[right]
            after[at] = beyond
            inner = beyond < count
            here, beyond = at[inner], beyond[inner]
            before[beyond] = here
            left = before[at]
            back = left >= 0
            left, mid = left[back], at[back]
            enter(np.concatenate([left, here]), self.rank_of(np.concatenate([tokens[left], tokens[here]]), np.concatenate([tokens[mid], tokens[beyond]])), r)
        cuts = np.cumsum(np.bincount(piece_of[live], minlength=len(pieces)))
        flat = list(map(self.numbers.__getitem__, tokens[live].tolist()))
        out = [flat[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
        for k in odd:
            out[k] = self.one(pieces[k])
        return out

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each piece: tokens are taken whole, the rest is replayed together."""
        ids: dict[str, tuple[int, ...]] = {}
        rest, data = [], []
        for p in set(pieces):
            raw = p.encode()
            if (rank := self.ranks.get(raw)) is not None:
                ids[p] = (rank,)
            else:
                rest.append(p)
                data.append(raw)
        if rest:
            ids.update(zip(rest, map(tuple, self.replay(data)), strict=True))
        return ids

    def learn(self, tails: set[str], heads: set[str]) -> None:
        """Enters words that follow a space, and words that begin a line, into the tables of known ones."""
        self.tails = self._kept(self.tails, tails, self.often[0])
        self.heads = self._kept(self.heads, heads, self.often[1])
        new = list(tails - self.tails.keys())
        matches = self.pattern.findall("".join([" " + x for x in new]))
        first = {x: self.pattern.findall(x) for x in heads - self.heads.keys()}
        ids = self.encode_pieces(chain(matches, chain.from_iterable(first.values())))
        get = ids.__getitem__
        starts = [k for k, x in enumerate(matches) if x[0] == " "]
        for word, begin, end in zip(new, starts, [*starts[1:], len(matches)][: len(starts)], strict=True):
            self.tails[word] = get(matches[begin]) if end == begin + 1 else tuple(chain.from_iterable(map(get, matches[begin:end])))
        for word, pieces in first.items():
            self.heads[word] = tuple(chain.from_iterable(map(get, pieces)))

    @staticmethod
    def _kept(table: dict[str, tuple[int, ...]], words: set[str], often: set[str]) -> dict[str, tuple[int, ...]]:
        """The table to which words are added: where it gets too large, what is often seen, or nothing, stays."""
        often |= words & table.keys()
        if len(table) + len(words) <= MAX_CHUNKS:
            return table
        found = {w: table[w] for w in often} if len(often) <= MAX_CHUNKS // 2 else {w: table[w] for w in words & table.keys()}
        often.clear()
        return found

    def lines(self, text: str) -> list[list[str]] | None:
        """The words of each line, if the only white space is single spaces and line breaks between other characters: then
        no match crosses the start of a word and its space, or a line break. None for other texts and very long ones, and for
        other patterns than the one of which this is known."""
        if not self.by_words or len(text) > LONG:
            return None
        words = text.split()
        between = len(words) - 1
        if text.count(" ") + text.count("\n") != between or sum(map(len, words)) + between != len(text):
            return None
        return [line.split(" ") for line in text.split("\n")]

    def encode_all(self, texts: Iterable[str]) -> Iterator[Iterator[list[int]]]:
        """For each text the runs of its ids. The new words of all these texts are learnt at once."""
        texts = list(texts)
        tails: set[str] = set()
        heads: set[str] = set()
        for text in texts:
            for line in self.lines(text) or ():
                heads.add(line[0])
                tails.update(line)
        self.learn(tails, heads)
        for text in texts:
            yield iter((self._from_words(lines),)) if (lines := self.lines(text)) else self._from_matches(text)

    def _from_words(self, lines: list[list[str]]) -> list[int]:
        get, out, newline = self.tails.__getitem__, [], self.ranks[b"\n"]
        for line in lines:
            out.extend(self.heads[line[0]])
            out.extend(chain.from_iterable(map(get, islice(line, 1, None))))
            out.append(newline)
        out.pop()
        return out

    def _from_matches(self, text: str) -> Iterator[list[int]]:
        matches = (m.group() for m in self.pattern.finditer(text))
        while run := list(islice(matches, RUN)):
            ids = self.encode_pieces(run)
            yield list(chain.from_iterable(map(ids.__getitem__, run)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@worker_tables(2)
def replayer(path: str, pattern: str) -> MergeReplay:
    """One for each worker, until it turns to another operator."""
    return MergeReplay(path, pattern)


def _encoded(coder: MergeReplay, texts: pa.Array) -> Iterator[Iterator[list[int]]]:
    """For each text the runs of its ids; texts of about BLOCK bytes are taken together."""
    k = 0
    while k < len(texts):
        block, size = [], 0
        while k < len(texts) and (not block or size < BLOCK):
            raw = texts[k].as_py()
            block.append(raw.decode("utf-8", "replace"))
            size += len(raw)
            k += 1
        yield from coder.encode_all(block)


def encode_documents(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = replayer(path, pattern)
        for batch in batches:
            ids: list[list[int]] = []
            begin = 0
            for k, runs in enumerate(_encoded(coder, batch.column(1))):
                ids.append(list(chain.from_iterable(runs)))
                if len(ids) == 256 or k == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(ids)), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
                    begin, ids = k + 1, []

    id_type = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(run, f"doc_id {id_type}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """From doc_id and ids: doc_id, data binary (the decoded bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = replayer(path, pattern)
        for batch in batches:
            data = [coder.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, data binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes each text, decodes the ids, and returns doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = replayer(path, pattern)
        digits = [str(i) for i in range(coder.width)]
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for runs in _encoded(coder, batch.column(1)):
                n, ids_hash, data_hash = 0, hashlib.sha256(), hashlib.sha256()
                for ids in runs:
                    ids_hash.update(((b"," if n else b"") + ",".join(map(digits.__getitem__, ids)).encode()) if ids else b"")
                    data_hash.update(coder.decode(ids))
                    n += len(ids)
                counts.append(n)
                encoded.append(ids_hash.hexdigest())
                decoded.append(data_hash.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            give_back()

    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(run, schema)
