"""Op 6: n-gram Jaccard join as a grouped prefix join.

A document's set is its distinct word shingles (64-bit hashes). Sets link at Jaccard similarity of `percent` or more, so
two linked sets share a shingle among their first n - ceil(percent * n) + 1 in any fixed order. The order is by how common
a shingle is, rarest first: a table of 2**20 counters over all documents (a bounded sketch; any order gives the same
result, only the work differs), then by hash.

1. Documents with the same set form a class, and classes with the same size and the same prefix a group: one row each.
2. Hub round: in each posting list (a prefix shingle and a band of sizes) the members are paired with the list's smallest
   one, and classes of a group with the group's smallest. This is linear in the postings. Pairs pass the bitmap filter, are
   verified on their whole sets, and give preliminary components.
3. Completion: only lists whose members are still in different components are looked at again, one of those with the
   same members. All pairs of different
   components and fitting sizes in such a list are filtered by parity bitmaps, in blocks, an upper bound of the overlap
   that drops no true pair; a pair that is in many lists belongs to the first of them. Lists of up to CHUNK members are sorted by size
   and compared many at once, each member with those that follow and are not too large. A longer list is cut into chunks
   of bounded size, and pairs of chunks are separate groups, so no list is collected into one task.
   The members on a pair that is left meet their whole sets, and the pairs of a list (or pair of chunks) are verified
   where its members are. Only links that join components there go out, fewer than members: pairs, of which a large group
   has very many, never are rows.
4. Connected components by large-star and small-star steps over DataFrames.

A class may have a third of all rows: it is one row from the first aggregate on, and its rows get their component by a join
that broadcasts the few large classes. In the star steps a large component's smallest id is a skewed key of a plain join,
which adaptive execution splits.

Null and empty texts have no set and link with nothing; texts with fewer words than a shingle have their sequence as one.
Rows that repeat are in one class. Rows of one id with different texts are one document: it links where any of its texts
does. Ties have no effect, as the smallest id names a component. Ids are integers; null ids are left out of the join and
get their own row with a null component. Long texts are handled whole. An empty table gives an empty table; other columns
may have any names. A collision of 64-bit hashes could merge two shingles: about one in 3 billion shingles has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluentlake.llm.shared import give_back, mix, rows_at_once, span_hashes, spread_join, stored, text_blocks, text_bytes, word_spans

#: Bytes of texts in a block, and rows with whole texts or sets that a Python worker gets at once.
BLOCK, ROWS = 1 << 19, 1000
CELLS = 1 << 20
CELL_BLOCK = 1 << 14
#: Bits of a bitmap at least; sets of more shingles have more, by powers of two up to MOST_BITS.
LEAST_BITS, MOST_BITS = 256, 4096
#: Members of a posting list that are compared with each other at once.
CHUNK = 1024
#: Lists by which a pair that is in many lists is told apart: the first ones of each member.
HEADS = 8
#: Shingles of a chunk whose whole sets are compared (or one set, if larger).
SHINGLES = 1 << 20
#: Shingles of a group from which its worker returns the memory at once.
MANY = 1 << 16
#: Pairs of a pair of chunks that are compared at once.
MATRIX = 1 << 14
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32
_COLUMNS = ["token", "within", "id", "n", "bits", "comp", "heads"]
_MEMBER = "token long, within int, id long, n long, bits binary, comp long, heads array<long>"
_PLACES = mix(np.arange(1, 5, dtype=np.uint64))


def steps(n: int) -> np.ndarray:
    """Odd factors of the places of a shingle; the last one is for texts shorter than a shingle."""
    return mix(np.arange(100, 101 + n, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text of a block the sorted hashes of its distinct shingles."""
    data = _UPPER[data]
    starts, ends, first = word_spans(data, bounds)
    words, step = span_hashes(data, starts, ends), steps(n)
    if len(words) >= n:
        grams = mix(words[: len(words) - n + 1] * step[0])
        for k in range(1, n):
            grams = mix(grams + words[k : len(words) - n + 1 + k] * step[k])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            short = mix(np.array([b - a], np.uint64) + step[n])
            for k in range(a, b):
                short = mix(short + words[k : k + 1] * step[k - a])
            yield short
        else:
            yield np.zeros(0, np.uint64)


def set_mark(found: np.ndarray) -> bytes:
    """128 bits that name a set."""
    places = _PLACES[:2, None] + np.arange(len(found), dtype=np.uint64)
    return np.bitwise_xor.reduce(mix(found[None, :] + mix(places)), axis=1).tobytes() if len(found) else b""


def least_overlap(size: np.ndarray | int, percent: int):
    """Shingles that a linked set shares with one of this size, at least: ceil(percent * size / 100)."""
    return -(-size * percent // 100)


def bitmap(hashes: np.ndarray) -> bytes:
    """Parity bitmap: bit h mod b is the parity of the number of shingles there."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, len(hashes)) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bytes) folded to a smaller width in bytes: exact, as parities add up."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def may_link(sizes_a, bits_a, sizes_b, bits_b, percent: int) -> np.ndarray:
    """For aligned sets, whether the overlap may be large enough: the parities that differ are at most the elements that
    differ, and linked sets of sizes a and b differ in a + b - 2 * ceil(percent * (a + b) / (100 + percent)) at most."""
    differ = np.bitwise_count(bits_a ^ bits_b).sum(axis=-1, dtype=np.int64)
    total = sizes_a + sizes_b
    return differ <= total - 2 * -(-(percent * total) // (100 + percent))


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, data, bounds in text_blocks(batch, "text", BLOCK):
                found = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(data, bounds, n)])
                counts += np.bincount((found >> np.uint64(44)).astype(np.int64), minlength=CELLS)
        parts = [counts[k : k + CELL_BLOCK].astype(np.int32).tobytes() for k in range(0, CELLS, CELL_BLOCK)]
        full = [k for k, p in enumerate(parts) if any(p)]
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([parts[k] for k in full], pa.binary())], ["block", "counts"])

    return run


def _add_sketches(dtype):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(CELL_BLOCK, np.int64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(x, dtype)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    return run


def commonness(texts: DataFrame, n: int) -> np.ndarray:
    """log2 of the counters over all documents, as bytes (1 MB, whatever the input)."""
    partial = texts.mapInArrow(_sketch(n), "block int, counts binary").withColumn("salt", F.spark_partition_id() % 16)
    summed = partial.groupBy("block", "salt").applyInArrow(_add_sketches(np.int32), "block int, counts binary")
    level = np.zeros(CELLS, np.uint8)
    with rows_at_once(texts.sparkSession, ROWS):
        total = summed.groupBy("block").applyInArrow(_add_sketches(np.int64), "block int, counts binary").collect()
    for row in total:
        counts = np.frombuffer(row["counts"], np.int64)
        level[row["block"] * CELL_BLOCK : (row["block"] + 1) * CELL_BLOCK] = np.minimum(255, np.round(8 * np.log2(counts + 1)))
    return level


def _features(n: int, percent: int, level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.frombuffer(level.value, np.uint8)
        for batch in batches:
            for rows, data, bounds in text_blocks(batch, "text", BLOCK):
                sizes, marks, prefixes, bits = [], [], [], []
                for found in shingle_sets(data, bounds, n):
                    size = len(found)
                    sizes.append(size)
                    order = np.argsort(common[(found >> np.uint64(44)).astype(np.int64)], kind="stable")[: size - least_overlap(size, percent) + 1 if size else 0]
                    prefixes.append(found[order].view(np.int64))
                    marks.append(set_mark(found))
                    bits.append(bitmap(found) if size else b"")
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes]), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), lists, pa.array(bits, pa.binary())], ["doc_id", "n", "mark", "prefix", "bits"])
        give_back()

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in text_blocks(batch, "text", BLOCK):
                found = list(shingle_sets(data, bounds, n))
                marks, items = [set_mark(x) for x in found], [x.tobytes() for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], pa.array(marks, pa.binary()), pa.array(items, pa.binary())], ["id", "mark", "items"])
        give_back()

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))
        give_back()

    return run


def _fitting(percent: int):
    """Keeps the pairs that the sizes and bitmaps allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            good = np.zeros(len(batch), bool)
            for k, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                width = min(len(x), len(y))
                x, y = (fold(np.frombuffer(z, np.uint8)[None, :], width) for z in (x, y))
                good[k] = may_link(na[k], x, nb[k], y, percent)[0]
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])
        give_back()

    return run


def first_lists(table: pa.Table):
    """For rows of posting lists with `heads`, the smallest HEADS tokens of the lists that the member is in: a function of
    places i, j and the token of the list at hand, whether the pair belongs to this list. That is the first list of the
    heads that both have, so one list of many keeps the pair; pairs without such a list belong to all of theirs."""
    column = table.column("heads").combine_chunks()
    some = np.arange(HEADS) < np.diff(column.offsets.to_numpy())[:, None]
    heads = np.zeros(some.shape, np.int64)
    heads[some] = column.flatten().to_numpy()

    def mine(i: np.ndarray, j: np.ndarray, token) -> np.ndarray:
        both = ((heads[i][:, :, None] == heads[j][:, None, :]) & some[i][:, :, None] & some[j][:, None, :]).any(axis=2)
        first = np.where(both, heads[i], np.iinfo(np.int64).max).min(axis=1)
        return ~both.any(axis=1) | (first == token)

    return mine


def _chunk_members(percent: int):
    """For a pair of chunks of one posting list: the members on a pair of different components that sizes and bitmaps allow."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, comps, sizes = (table.column(c).to_numpy() for c in ("id", "comp", "n"))
        left, right = (np.flatnonzero(table.column("side").to_numpy() == s) for s in (0, 1))
        inner = not len(right)
        right = left if inner else right
        raw = table.column("bits").to_pylist()
        widths = np.array([len(x) for x in raw])
        mine, token = first_lists(table), key[0].as_py()
        on = np.zeros(len(table), bool)
        for wa in np.unique(widths[left]):
            for wb in np.unique(widths[right]):
                la, rb, width = left[widths[left] == wa], right[widths[right] == wb], int(min(wa, wb))
                bits_a = fold(np.frombuffer(b"".join(raw[k] for k in la), np.uint8).reshape(len(la), -1), width).view(np.uint64)
                bits_b = fold(np.frombuffer(b"".join(raw[k] for k in rb), np.uint8).reshape(len(rb), -1), width).view(np.uint64)
                for k in range(0, len(la), step := max(1, MATRIX // max(1, len(rb)))):
                    x = la[k : k + step, None]
                    fits = (comps[rb] != comps[x]) & (100 * np.minimum(sizes[x], sizes[rb]) >= percent * np.maximum(sizes[x], sizes[rb]))
                    if inner:
                        fits &= ids[rb] > ids[x]
                    i, j = np.nonzero(fits)
                    i += k
                    good = may_link(sizes[la[i]], bits_a[i], sizes[rb[j]], bits_b[j], percent)
                    i, j = la[i[good]], rb[j[good]]
                    good = mine(i, j, token)
                    on[i[good]] = on[j[good]] = True
        return table.select(_COLUMNS).filter(pa.array(on))

    return run


def _window_members(percent: int):
    """As _chunk_members, for rows sorted by list, size and id: whole lists of CHUNK members at most, many of them at once.
    Each member meets the next one, the next but one and so on, as long as list and sizes fit."""

    def compare(rows: pa.Table) -> pa.Table:
        comps, sizes = (rows.column(c).to_numpy() for c in ("comp", "n"))
        same = np.zeros(len(rows), bool)
        for c in ("token", "within"):
            x = rows.column(c).to_numpy()
            same[1:] |= x[1:] != x[:-1]
        group = np.cumsum(same)
        raw = rows.column("bits").to_pylist()
        widths = np.array([len(x) for x in raw], np.int64)
        by_width = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}
        own = {w: np.frombuffer(b"".join(raw[k] for k in at), np.uint8).reshape(len(at), w) for w, at in by_width.items()}
        folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def at_width(width: int) -> tuple[np.ndarray, np.ndarray]:
            """Bitmaps of this width of all rows that have as many bits, and which row's is where."""
            if width not in folded:
                wider = [w for w in own if w >= width]
                place = np.zeros(len(rows), np.int64)
                place[np.concatenate([by_width[w] for w in wider])] = np.arange(sum(len(by_width[w]) for w in wider))
                folded[width] = np.concatenate([fold(own[w], width) for w in wider]).view(np.uint64), place
            return folded[width]

        on, mine, tokens = np.zeros(len(rows), bool), first_lists(rows), rows.column("token").to_numpy()

        def check(i: np.ndarray, j: np.ndarray) -> None:
            least = np.minimum(widths[i], widths[j])
            for width in np.unique(least).tolist():
                bits, place = at_width(width)
                x, y = i[least == width], j[least == width]
                for k in range(0, len(x), MATRIX):
                    p, q = x[k : k + MATRIX], y[k : k + MATRIX]
                    good = may_link(sizes[p], bits[place[p]], sizes[q], bits[place[q]], percent)
                    p, q = p[good], q[good]
                    good = mine(p, q, tokens[p])
                    on[p[good]] = on[q[good]] = True

        waiting, held, near, step = [], 0, np.arange(len(rows)), 1
        while len(near):
            near = near[near + step < len(rows)]
            near = near[(group[near + step] == group[near]) & (percent * sizes[near + step] <= 100 * sizes[near])]
            i = near[comps[near] != comps[near + step]]
            waiting.append((i, i + step))
            held += len(i)
            if held >= MATRIX or not len(near):
                check(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                waiting, held = [], 0
            step += 1
        return rows.select(_COLUMNS).filter(pa.array(on))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            token, within = (rows.column(c).to_numpy() for c in ("token", "within"))
            last = np.flatnonzero((token != token[-1:]) | (within != within[-1:]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last list may go on in the next batch
            if cut:
                yield from compare(rows.slice(0, cut)).to_batches()
            rest = rows.slice(cut)
        if rest is not None and len(rest):
            yield from compare(rest).to_batches()
        give_back()

    return run


def _join_components(percent: int):
    """For whole sets of the members of a posting list, or of a pair of its chunks: links that join components, one for each
    two that become one. Pairs within a component need no look, so what is found first saves the rest."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), ("id", "ascending")])
        ids, sizes, side = (table.column(c).to_numpy() for c in ("id", "n", "side"))
        comp = np.unique(table.column("comp").to_numpy(), return_inverse=True)[1]
        items = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        number = np.unique(np.concatenate(items), return_inverse=True)[1]
        items = np.split(number, np.cumsum(sizes)[:-1])
        raw = table.column("bits").to_pylist()
        widths = np.array([len(x) for x in raw], np.int64)  # ascend, as sizes do
        mine, token, inner = first_lists(table), key[0].as_py(), not side.any()
        at, folded, own = 0, np.zeros((0, 0), np.uint64), np.zeros(len(number), bool)
        out: list[tuple[int, int]] = []
        ends = np.searchsorted(sizes, 100 * sizes // percent, "right")
        for x in range(len(ids)):
            if not x or widths[x] != widths[x - 1]:  # bitmaps of all rows from here on, at this row's width
                at, cuts = x, [x, *(np.flatnonzero(np.diff(widths[x:])) + x + 1), len(ids)]
                folded = np.concatenate([fold(np.frombuffer(b"".join(raw[a:b]), np.uint8).reshape(b - a, -1), int(widths[x])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]).view(np.uint64)
            left = np.arange(x + 1, ends[x])
            left = left[(comp[left] != comp[x]) & (inner | (side[left] != side[x]))]
            for k in range(0, len(left), MATRIX):
                near = left[k : k + MATRIX]
                near = near[may_link(sizes[x], folded[x - at], sizes[near], folded[near - at], percent)]
                near, step = near[mine(np.full(len(near), x), near, token)], 16
                own[items[x]] = True
                while len(near := near[comp[near] != comp[x]]):
                    now, near, step = near[:step], near[step:], 2 * step
                    both = np.add.reduceat(own[np.concatenate([items[y] for y in now])], np.cumsum(sizes[now]) - sizes[now], dtype=np.int64)
                    for y in now[100 * both >= percent * (sizes[x] + sizes[now] - both)]:
                        if comp[y] != comp[x]:
                            comp[comp == comp[y]] = comp[x]
                            out.append((ids[x], ids[y]))
                own[items[x]] = False
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        if len(number) >= MANY:
            del table, items, raw, own, folded
            give_back()
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def dealt_chunks(listed: DataFrame, band, weight) -> DataFrame:
    """Rows of long posting lists, cut into chunks of a weight of about CHUNK within bands of sizes: a row for each group
    that it is in. A group is (list, lower band lo, upper band hi, chunk i of the lower, chunk j of the upper); side 0 is the
    lower one. Groups of one component are left out."""
    listed = listed.withColumn("band", band)
    own = listed.groupBy("token", "within", "band").agg(F.sum(weight).alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    below = own.select("token", "within", (F.col("band") + 1).alias("band"), F.col("c").alias("c1"), F.col("low").alias("low1"), F.col("high").alias("high1"))
    above = own.select("token", "within", (F.col("band") - 1).alias("band"), F.col("c").alias("c2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    plan = own.join(below, ["token", "within", "band"], "left").join(above, ["token", "within", "band"], "left")
    chunks = lambda c: F.ceil(F.coalesce(F.col(c), F.lit(0)) / CHUNK).cast("int")
    mixed = lambda a, b: (F.least(F.col("low"), F.col(a)) != F.greatest(F.col("high"), F.col(b)))
    plan = plan.select("token", "within", "band", chunks("c").alias("k"), F.when(mixed("low1", "high1"), chunks("c1")).otherwise(0).alias("k1"), F.when(mixed("low2", "high2"), chunks("c2")).otherwise(0).alias("k2"), (F.col("low") != F.col("high")).alias("own")).where("own or k1 > 0 or k2 > 0")
    placed = listed.join(plan, ["token", "within", "band"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    c, b = F.col("chunk"), F.col("band")
    count = lambda k: F.when(F.col(k) > 0, F.sequence(F.lit(0), F.col(k) - 1)).otherwise(F.array().cast("array<int>"))
    inside = F.transform(F.when(F.col("own"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array().cast("array<int>")), lambda x: F.struct(b.alias("lo"), b.alias("hi"), F.least(c, x).alias("i"), F.greatest(c, x).alias("j"), F.when(c <= x, 0).otherwise(1).alias("side")))
    up = F.transform(count("k2"), lambda x: F.struct(b.alias("lo"), (b + 1).alias("hi"), c.alias("i"), x.alias("j"), F.lit(0).alias("side")))
    down = F.transform(count("k1"), lambda x: F.struct((b - 1).alias("lo"), b.alias("hi"), x.alias("i"), c.alias("j"), F.lit(1).alias("side")))
    return placed.select(*_COLUMNS, F.explode(F.concat(inside, up, down)).alias("g")).select(*_COLUMNS, "g.*")


def components(edges: DataFrame, name: str, rounds: int = 50) -> DataFrame:
    """From edges (a, b), a != b: (id, comp) with the smallest id reachable, for each id on an edge. Large-star and
    small-star steps (Kiveris et al., 2014), each written to the shared folder, until nothing changes."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            pairs = pairs.union(pairs.select("b", "a"))
        else:
            pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        moved = pairs.join(least, "a").select(F.when(F.col("b") > F.col("a") if large else F.lit(True), F.col("b")).alias("x"), "low", "a")
        linked = moved.where("x is not null and x != low").select(F.col("x").alias("a"), F.col("low").alias("b"))
        return linked if large else linked.union(least.where("a != low").select("a", F.col("low").alias("b")))

    pairs = stored(edges.select("a", "b").where("a != b").distinct(), f"{name}-edges")
    state = None
    for k in range(rounds):
        big = star(pairs, True).distinct()
        pairs = stored(star(big, False).distinct(), f"{name}-{k}")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(pairs.select("b", "b").distinct())


def whole_sets(wanted: DataFrame, docs: DataFrame, n: int, name: str) -> DataFrame:
    """(id, mark, items) for the texts of these ids; only those are read again."""
    sets = docs.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text").mapInArrow(_sets(n), "id long, mark binary, items binary")
    return stored(sets, f"{name}-sets", batch=ROWS).dropDuplicates(["id", "mark"])


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) of document ids whose whole sets link."""
    pairs = stored(pairs.select("a", "b").distinct(), f"{name}-pairs")
    sets = whole_sets(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), docs, n, name)
    found = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    return stored(found.select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long"), f"{name}-links", batch=ROWS)


def linked_members(near: DataFrame, docs: DataFrame, band, n: int, percent: int) -> DataFrame:
    """For members of posting lists: links (a, b) that join all components that links within the lists join."""
    sets = whole_sets(near.select(F.col("id").alias("doc_id")).distinct(), docs, n, "rest").select("id", F.expr("cast(length(items) div 8 as long)").alias("n"), "items")
    weight = F.greatest(F.lit(1.0), F.col("n") * CHUNK / SHINGLES)
    large = F.broadcast(near.groupBy("token", "within").agg(F.sum(weight).alias("c")).where(F.col("c") > CHUNK).select("token", "within"))
    zero = F.lit(0)
    whole = near.join(large, ["token", "within"], "left_anti").select(*_COLUMNS, zero.alias("lo"), zero.alias("hi"), zero.alias("i"), zero.alias("j"), zero.alias("side"))
    groups = whole.unionByName(dealt_chunks(near.join(large, ["token", "within"], "left_semi"), band, weight)).join(sets, ["id", "n"])
    return stored(groups.groupBy("token", "within", "lo", "hi", "i", "j").applyInArrow(_join_components(percent), "a long, b long"), "rest-links", batch=ROWS)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    level = spark.sparkContext.broadcast(commonness(texts, n).tobytes())
    rows = stored(texts.mapInArrow(_features(n, percent, level), "doc_id long, n long, mark binary, prefix array<long>, bits binary"), "features", batch=ROWS)

    linkable = rows.where("n > 0 and doc_id is not null")
    # Equal sets have equal prefixes and bitmaps, so any row's will do.
    found = linkable.groupBy("n", "mark").agg(F.min("doc_id").alias("id"), F.count("*").alias("size"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    classes = stored(found.select("*", F.xxhash64("prefix").alias("key"), F.md5(F.to_json("prefix")).alias("prefix_mark")), "classes")
    sized = classes.select("n", "mark", "id", "size")
    groups = classes.groupBy("n", "prefix_mark").agg(F.min("id").alias("gid"))
    members = stored(classes.join(groups, ["n", "prefix_mark"]).select("id", "gid", "n", "prefix", "bits"), "members")
    # Sizes of linked sets are in the same band or in the next one; the factor leaves room for rounding.
    band = F.floor(F.log(F.col("n").cast("double")) / (1.000001 * F.log(F.lit(100.0 / percent)))).cast("int")
    postings = members.where("id = gid").select("id", "n", band.alias("band"), F.explode("prefix").alias("token"))
    shared = postings.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    postings = stored(postings.join(shared, "token"), "postings")

    hubs = postings.groupBy("token", "band").agg(F.min(F.struct("id", "n")).alias("hub")).select("token", "band", F.col("hub.id").alias("hub"))
    near = hubs.select("token", F.explode(F.array("band", F.col("band") + 1)).alias("band"), "hub")
    hub_pairs = postings.join(near, ["token", "band"]).where("hub != id").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    hub_pairs = hub_pairs.union(members.where("id != gid").select("gid", "id")).distinct()
    held = members.select("id", "n", "bits")
    fitting = hub_pairs.join(held.toDF("a", "na", "xa"), "a").join(held.toDF("b", "nb", "xb"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    hub_links = verified(fitting.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_fitting(percent), "a long, b long"), texts, n, percent, "hub")
    first = components(hub_links, "first")

    labelled = members.select("id", "gid", "n", "bits").join(first, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    labelled = stored(labelled, "labelled")
    own_group = labelled.groupBy("gid").agg(F.count("*").alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    by_group = labelled.join(own_group.select("gid", "low", "high"), "gid")
    spread = postings.select("token", F.col("id").alias("gid"), "band").join(own_group, "gid").groupBy("token").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("groups"), F.sum("c").alias("length"), F.bit_xor(F.xxhash64("gid")).alias("m1"), F.bit_xor(F.xxhash64("gid", F.lit(1))).alias("m2")
    ).where("low != high").groupBy("groups", "m1", "m2").agg(F.min("token").alias("token"), F.max("length").alias("length")).select("token", "length")  # lists of the same members: one of them
    kept = stored(postings.join(spread, "token").select("token", "length", F.col("id").alias("gid")), "kept")
    heads = kept.groupBy("gid").agg(F.slice(F.array_sort(F.collect_list("token")), 1, HEADS).alias("heads"))
    # Members of a group are in the same lists; only where there is none, the group is a list of its own.
    wide = own_group.where("low != high").join(heads, "gid", "left_anti").select("gid", F.col("gid").alias("token"), F.col("c").alias("length"))
    columns = [*_COLUMNS, "length"]
    listed = kept.join(heads, "gid").withColumn("within", F.lit(0)).join(by_group, "gid").select(columns)
    listed = stored(listed.union(wide.withColumn("within", F.lit(1)).withColumn("heads", F.array().cast("array<long>")).join(by_group, "gid").select(columns)), "listed")
    short = listed.where(F.col("length") <= CHUNK).drop("length").repartition("token", "within").sortWithinPartitions("token", "within", "n", "id")
    near = short.mapInArrow(_window_members(percent), _MEMBER)
    # Longer lists are cut into chunks by size and id.
    dealt = dealt_chunks(listed.where(F.col("length") > CHUNK), band, F.lit(1))
    near = near.union(dealt.groupBy("token", "within", "lo", "hi", "i", "j").applyInArrow(_chunk_members(percent), _MEMBER))
    near = stored(near.dropDuplicates(["token", "within", "id", "n", "bits"]), "near")
    more = linked_members(near, texts, band, n, percent)

    # An id with several texts ties their classes together.
    total = linkable.count()
    several = linkable.select("doc_id", "n", "mark").distinct().groupBy("doc_id").count().where("count > 1").select("doc_id")
    own = stored(linkable.select("doc_id", "n", "mark").join(several, "doc_id", "left_semi"), "several")
    ties = spread_join(own, sized, ["n", "mark"], "size", total).select(F.least("doc_id", "id").alias("a"), F.greatest("doc_id", "id").alias("b"))
    final = components(hub_links.union(more).union(ties), "final")
    told = stored(sized.join(final, "id", "left").select("n", "mark", "size", F.coalesce("comp", "id").alias("component_id")), "told")
    linked = spread_join(linkable.select("doc_id", "n", "mark"), told, ["n", "mark"], "size", total)
    alone = rows.where("not (n > 0 and doc_id is not null)").withColumn("component_id", F.col("doc_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone.select("doc_id", "n", "component_id"))


ORACLE_SQL = r"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
shingles as (
  select distinct doc_id, case when len(w) >= 3 then array_to_string(w[i:i+2], ' ') else array_to_string(w, ' ') end s
  from words, unnest(range(1, greatest(1, len(w) - 2) + 1)) t(i) where len(w) > 0),
sizes as (select doc_id, count(*) n from shingles group by doc_id),
common as (select s from shingles group by s having count(*) > 1),
few as (select doc_id, s from shingles semi join common using (s)),
pairs as (select a.doc_id x, b.doc_id y, count(*) c from few a join few b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 90 * (p.n + q.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, b.y from reach r join both_ways b on r.other = b.x),
lowest as (select doc_id, min(other) component_id from reach group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint n_shingles, component_id from documents d left join sizes using (doc_id) left join lowest using (doc_id)
"""
