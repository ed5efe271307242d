"""Op 8: exact deduplication by a cuckoo-filter index of live digests.

Spark computes the digest (SHA-256 of the text with A-Z lower-cased) in the JVM, once; digest, id and a number of the row are
written to the shared folder. Each task first runs the rows it reads through an index of its own and sends one row per
digest, so a group of copies that holds a third of all rows crosses the shuffle once per task. Then digests are dealt by
value into shards, and an index per shard merges them. A hit of the filter is verified against the full digest stored in
the bucket; when an insertion overflows, the index is rebuilt with twice the buckets from the stored keys. Rows get their
group's verdict by a join that broadcasts the few large groups, so their rows stay where they are.

Null and empty texts are equal. Null ids are below all others. Of rows with equal text and equal (or null) id, one stays. A
text is hashed whole, however long. An empty table gives an empty table. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluentlake.llm.shared import ascii_lower, hot_groups, spread_join, stored


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket, with the full key and a value beside each.

    insert, get, delete and update work on live keys; a fingerprint that matches is verified against the stored key.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 64):
        self.mask = (1 << max(1, (buckets - 1).bit_length())) - 1
        self.size = 0
        self.resizes = 0
        self._clear()

    def _clear(self) -> None:
        self.prints: list[list[int]] = [[] for _ in range(self.mask + 1)]
        self.items: list[list[tuple[bytes, object]]] = [[] for _ in range(self.mask + 1)]

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") | 1 << 16
        one = int.from_bytes(key[2:10], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & self.mask)

    def _find(self, key: bytes) -> tuple[int, int] | None:
        mark, one, two = self._place(key)
        for b in (one, two):
            prints = self.prints[b]
            if mark in prints:
                for s, p in enumerate(prints):
                    if p == mark and self.items[b][s][0] == key:
                        return b, s
        return None

    def get(self, key: bytes, default=None):
        at = self._find(key)
        return default if at is None else self.items[at[0]][at[1]][1]

    def __contains__(self, key: bytes) -> bool:
        return self._find(key) is not None

    def update(self, key: bytes, value) -> bool:
        """Changes the value of a live key; false if there is none."""
        if (at := self._find(key)) is None:
            return False
        self.items[at[0]][at[1]] = (key, value)
        return True

    def delete(self, key: bytes) -> bool:
        if (at := self._find(key)) is None:
            return False
        b, s = at
        for table in (self.prints[b], self.items[b]):
            table[s] = table[-1]
            table.pop()
        self.size -= 1
        return True

    def insert(self, key: bytes, value=None) -> None:
        """Adds a key that isn't live; on overflow, the table doubles and is filled again from the stored keys."""
        self.size += 1
        homeless = self._put(key, value)
        if homeless is None:
            return
        pending = [item for bucket in self.items for item in bucket] + [homeless]
        while pending is not None:
            self.mask = self.mask * 2 + 1
            self.resizes += 1
            self._clear()
            pending = next((pending for item in pending if self._put(*item) is not None), None)

    def _put(self, key: bytes, value) -> tuple[bytes, object] | None:
        """None, or the item that found no place: then it isn't in the table, and all others are."""
        mark, one, two = self._place(key)
        for b in (one, two):
            if len(self.prints[b]) < self.SLOTS:
                self.prints[b].append(mark)
                self.items[b].append((key, value))
                return None
        item, b = (key, value), two
        for kick in range(self.KICKS):
            s = (kick + item[0][5]) % self.SLOTS
            mark, self.prints[b][s] = self.prints[b][s], mark
            item, self.items[b][s] = self.items[b][s], item
            b = self._other(b, mark)
            if len(self.prints[b]) < self.SLOTS:
                self.prints[b].append(mark)
                self.items[b].append(item)
                return None
        return item

    def __iter__(self) -> Iterator[tuple[bytes, object]]:
        for bucket in self.items:
            yield from bucket

    def __len__(self) -> int:
        return self.size


#: Live digests of an index at most before it hands on what it has; later rows of the same digest merge behind it.
MAX_LIVE = 400_000
_SCHEMA = "digest binary, keep_id long, keep_row long, group_size long"


def _merge(handed_on: bool):
    """Merges rows of (digest, keep_id, keep_row, group_size) in an index: the largest id, by row number on a tie.
    handed_on: an index that is full may be emptied, as another one follows."""

    def emit(index: CuckooIndex) -> pa.RecordBatch:
        rows = list(index)
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        columns = [[k for k, _ in rows], *([v[c] for _, v in rows] for c in range(3))]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["digest", "keep_id", "keep_row", "group_size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex(1024)
        for batch in batches:
            for key, keep, row, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (old := index.get(key)) is None:
                    index.insert(key, (keep, row, n))
                else:
                    best = max((old[0] is not None, old[0] or 0, old[1]), (keep is not None, keep or 0, row))
                    index.update(key, (best[1] if best[0] else None, best[2], old[2] + n))
            if handed_on and len(index) > MAX_LIVE:
                yield emit(index)
                index = CuckooIndex(1024)
        yield emit(index)

    return run


def digest_of(text: str = "text"):
    return F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), 256))


def live_digests(keyed: DataFrame, rows: int, rows_per_shard: int = MAX_LIVE) -> DataFrame:
    """From (digest, doc_id, row) of `rows` rows, one row per digest: the row to keep and the number of rows.

    Shards get about rows_per_shard rows at most; digests are uniform, and after the first index a digest has a row per
    task at most, so shards are even."""
    single = keyed.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    shards = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return single.mapInArrow(_merge(True), _SCHEMA).repartition(max(shards, -(-rows // rows_per_shard)), "digest").mapInArrow(_merge(False), _SCHEMA)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256. Ids are integers."""
    keyed = stored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest_of(text).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    live = stored(live_digests(keyed, rows := keyed.count()), "live")
    found = spread_join(keyed, live, ["digest"], "group_size", rows)
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with docs' own columns.

    Texts cross one shuffle, but for copies in large groups, which are dropped where they are. Of several rows with the text
    and id to keep, any one stays, picked by an aggregate that collapses them before the shuffle."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    keyed = docs.select(digest_of(text).alias("digest"), F.col(doc_id).cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("own"))
    told = stored(keyed.select("digest", "doc_id", F.monotonically_increasing_id().alias("row")), "digests")
    rows = told.count()
    live = stored(live_digests(told, rows), "live")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    again = stored(spread_join(told, live, ["digest"], "group_size", rows).where(stays).groupBy("digest").count().where("count > 1").select("digest"), "again")
    alone = live.join(again, "digest", "left_anti").select("digest", "keep_id")
    large = live.where(hot_groups("group_size", rows)).join(again.withColumn("again", F.lit(True)), "digest", "left")
    large = F.broadcast(large.select("digest", F.col("keep_id").alias("large_id"), F.col("again").isNull().alias("single")))
    few = keyed.join(large, "digest", "left").where(F.col("single").isNull() | (F.col("single") & F.col("doc_id").eqNullSafe(F.col("large_id"))))
    kept = few.join(alone, "digest").where(stays).select("own")
    if not again.isEmpty():
        repeated = spread_join(keyed, live.join(again, "digest", "left_semi"), ["digest"], "group_size", rows).where(stays)
        kept = kept.union(repeated.groupBy("digest").agg(F.first("own").alias("own")).select("own"))
    return kept.select(*[F.col(f"own.{n}").alias(c) for n, c in zip(names, docs.columns, strict=True)])


ORACLE_SQL = """
with hashed as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) text_sha256 from documents)
select doc_id, max(doc_id) over g keep_id, count(*) over g group_size, doc_id = max(doc_id) over g kept, text_sha256
from hashed window g as (partition by text_sha256)
"""
