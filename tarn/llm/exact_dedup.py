"""Exact duplicates through a bucketed cuckoo-filter index with insertion and deletion of live digests.

Texts are equal when they are identical after each run of space characters is replaced by one space. The key of a
text is the SHA-256 of that form. Keys are spread over buckets; a bucket holds a cuckoo filter of 16-bit
fingerprints and, as its content, the full keys with their keeper and number of rows. A filter miss proves a key new.
A hit is verified against the bucket's content. When an insertion finds no place the filter is rebuilt at twice the
size from the stored keys; when buckets hold more than BUCKET_KEYS keys on average, a stored index is dealt anew over
twice as many (or more).

A stored index has a second table, the live rows (key, doc_id, n), so that a deletion promotes the smallest doc_id
that is left, and rows that were never inserted are refused. Both are plain tables; a hot key's rows are aggregated
by partial sums and never gathered.

Defined cases: a null text counts as empty; a null doc_id sorts after all others and stays only if no other row has
the text; repeated doc_ids are rows of their own; an empty table gives an empty result; other columns are ignored;
deletions of what isn't live are ignored; changes of one (text, doc_id) apply in order of seq, ties insertions first.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import SPACE, materialize, spread_join

SLOTS, KICKS, BUCKET_KEYS = 4, 200, 50_000


class CuckooFilter:
    """Fingerprints of 32-byte keys, four to a place, each at one of two places."""

    def __init__(self, places: int = 64):
        self.places, self.table, self.used = places, array("H", bytes(2 * SLOTS * places)), 0

    def _where(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[:8], "little") & (self.places - 1)
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return place ^ (mark * 0x9E3779B1 >> 7) & (self.places - 1)

    def __contains__(self, key: bytes) -> bool:
        mark, a, b = self._where(key)
        return mark in self.table[a * SLOTS : a * SLOTS + SLOTS] or mark in self.table[b * SLOTS : b * SLOTS + SLOTS]

    def _put(self, place: int, mark: int) -> bool:
        for i in range(place * SLOTS, place * SLOTS + SLOTS):
            if not self.table[i]:
                self.table[i] = mark
                return True
        return False

    def insert(self, key: bytes) -> bool:
        """False: no place was found; the filter must be rebuilt, as one fingerprint is out."""
        mark, a, b = self._where(key)
        self.used += 1
        if self._put(a, mark) or self._put(b, mark):
            return True
        place = a
        for kick in range(KICKS):
            i = place * SLOTS + kick % SLOTS
            mark, self.table[i] = self.table[i], mark
            place = self._other(place, mark)
            if self._put(place, mark):
                return True
        return False

    @classmethod
    def stored(cls, places: int, table: bytes) -> CuckooFilter:
        out = cls(0)
        out.places, out.table = places, array("H", table)
        out.used = len(out.table) - out.table.count(0)
        return out

    def delete(self, key: bytes) -> bool:
        mark, a, b = self._where(key)
        for place in (a, b):
            for i in range(place * SLOTS, place * SLOTS + SLOTS):
                if self.table[i] == mark:
                    self.table[i] = 0
                    self.used -= 1
                    return True
        return False


class Bucket:
    """A filter over live keys with the content that verifies its hits: key -> [smallest doc_id, rows]."""

    def __init__(self, content: dict[bytes, list] | None = None, places: int = 64, fingerprints: bytes | None = None):
        """fingerprints: the stored filter of the content; without them it is built."""
        self.content = content or {}
        self.false_hits = self.resizes = 0
        if fingerprints is not None:
            self.filter = CuckooFilter.stored(places, fingerprints)
        else:
            self._rebuild(places)

    def _rebuild(self, places: int) -> None:
        while True:
            self.filter = CuckooFilter(places)
            if all(self.filter.insert(k) for k in self.content):
                return
            places *= 2

    def get(self, key: bytes) -> list | None:
        if key not in self.filter:
            return None
        found = self.content.get(key)
        self.false_hits += found is None
        return found

    def _new(self, key: bytes, value: list) -> None:
        self.content[key] = value
        if not self.filter.insert(key):
            self.resizes += 1
            self._rebuild(self.filter.places * 2)

    def add(self, key: bytes, doc_id: int | None, n: int = 1) -> None:
        """n more rows of a key."""
        if (found := self.get(key)) is None:
            self._new(key, [doc_id, n])
            return
        found[1] += n
        if doc_id is not None and (found[0] is None or doc_id < found[0]):
            found[0] = doc_id

    def put(self, key: bytes, doc_id: int | None, n: int) -> None:
        """A key's keeper and rows as they are now; without rows the key goes, and its fingerprint."""
        if (found := self.get(key)) is None:
            if n > 0:
                self._new(key, [doc_id, n])
        elif n > 0:
            found[:] = [doc_id, n]
        else:
            self.remove(key)

    def remove(self, key: bytes) -> bool:
        if self.get(key) is None:
            return False
        del self.content[key]
        return self.filter.delete(key)


def text_key(text: str = "text"):
    """The binary key of a text column."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " "), 256))


def _collapse(batches):
    """Copies within one partition to (key, smallest doc_id, rows), in bounded memory."""
    seen: dict[bytes, list] = {}

    def out():
        keys = list(seen)
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array([seen[k][0] for k in keys], pa.int64()), pa.array([seen[k][1] for k in keys], pa.int64())], names=["key", "doc_id", "n"])
        seen.clear()

    for batch in batches:
        for key, doc, n in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "n")), strict=True):
            if (x := seen.get(key)) is None:
                seen[key] = [doc, n]
            else:
                x[1] += n
                if doc is not None and (x[0] is None or doc < x[0]):
                    x[0] = doc
        if len(seen) > 200_000:
            yield from out()
    if seen:
        yield from out()


def _index(batches):
    """Rows sorted by bucket through that bucket's index: a row for each live key."""
    now, bucket = None, Bucket()

    def out():
        items = list(bucket.content.items())
        for i in range(0, len(items), 20_000):
            part = items[i : i + 20_000]
            yield pa.record_batch([pa.array([k for k, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())], names=["key", "keep_id", "group_size"])

    for batch in batches:
        for b, key, doc, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "doc_id", "n")), strict=True):
            if b != now:
                yield from out()
                now, bucket = b, Bucket()
            bucket.add(key, doc, n)
    yield from out()


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def buckets_for(keys: int, bucket_keys: int = BUCKET_KEYS) -> int:
    return max(64, 1 << (max(1, keys) // bucket_keys).bit_length())


def exact_groups(keys: DataFrame, buckets: int) -> DataFrame:
    """(key, keep_id, group_size) of (key, doc_id) rows. Copies collapse before the shuffle, so a hot text sends one row a task."""
    one = keys.select("key", "doc_id", F.lit(1).cast("long").alias("n")).mapInArrow(_collapse, "key binary, doc_id long, n long")
    dealt = one.withColumn("bucket", bucket_of("key", buckets)).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_index, "key binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("key")), "keys")
    groups = exact_groups(keys, buckets_for(keys.count(), bucket_keys)).where("group_size > 1").withColumnRenamed("key", "group_key")
    joined = spread_join(keys, groups, "key", "group_key", "doc_id", "left")
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("key")).alias("text_sha256"))


INDEX_SCHEMA = "buckets long, bucket long, places long, fingerprints binary, content array<struct<key:binary,keep_id:long,n:long>>"
LIVE_SCHEMA = "key binary, doc_id long, n long"


def live_rows(live: DataFrame, changes: DataFrame) -> DataFrame:
    """The live rows (LIVE_SCHEMA) after changes (op, key, doc_id, seq), deletions of what isn't live left out."""
    step = F.struct("seq", F.when(F.col("op") == "insert", 0).otherwise(1).alias("late"))
    x = changes.groupBy("key", "doc_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    x = x.select(F.col("key").alias("_key"), F.col("doc_id").alias("_doc"), "steps")
    y = live.join(x, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "full")
    had = F.coalesce("n", F.lit(0).cast("long"))
    steps = F.coalesce("steps", F.array().cast("array<struct<seq:long,late:int>>"))
    now = F.aggregate(steps, had, lambda n, s: F.greatest(F.lit(0).cast("long"), n + 1 - 2 * s["late"]))
    return y.select(F.coalesce("key", "_key").alias("key"), F.when(F.col("key").isNotNull(), F.col("doc_id")).otherwise(F.col("_doc")).alias("doc_id"), now.alias("n")).where("n > 0")


def deal_anew(index: DataFrame, buckets: int) -> DataFrame:
    """A stored index over another number of buckets, its filters made from the stored keys."""
    keys = index.select(F.explode("content").alias("c")).select("c.*")
    dealt = keys.withColumns({"bucket": bucket_of("key", buckets), "buckets": F.lit(buckets).cast("long")})

    def build(pdf):
        return stored_bucket(buckets, pdf["bucket"].iloc[0], Bucket({bytes(k): [whole(d), n] for k, d, n in pdf[["key", "keep_id", "n"]].itertuples(index=False)}))

    return dealt.groupBy("bucket").applyInPandas(build, INDEX_SCHEMA)


def whole(x) -> int | None:
    import pandas as pd

    return None if pd.isna(x) else int(x)


def stored_bucket(buckets: int, bucket: int, b: Bucket):
    import pandas as pd

    rows = [{"key": k, "keep_id": v[0], "n": v[1]} for k, v in b.content.items()]
    return pd.DataFrame({"buckets": [buckets], "bucket": [bucket], "places": [b.filter.places], "fingerprints": [b.filter.table.tobytes()], "content": [rows]})


def update_index(index: DataFrame, live: DataFrame, changes: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, DataFrame]:
    """A stored index and its live rows with changes applied, as new tables: write them under new paths, then drop the old ones.

    ``index``: INDEX_SCHEMA and ``live``: LIVE_SCHEMA, may be empty. ``changes``: op ('insert' or 'delete'), doc_id, seq, text.
    """
    todo = materialize(changes.select("op", F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"), text_key().alias("key")), "changes")
    live = materialize(live_rows(live, todo), "live")
    touched = todo.select("key").distinct()
    state = live.join(touched, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("n"))
    state = touched.join(state, "key", "left").select("key", "keep_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    now = index.agg(F.max("buckets").alias("b"), F.sum(F.size("content")).alias("n")).first()
    buckets = max(now["b"] or 0, buckets_for((now["n"] or 0) + touched.count(), bucket_keys))
    if now["b"] not in (None, buckets):
        index = deal_anew(index, buckets)

    def apply(key, old, new):
        content = {bytes(r["key"]): [whole(r["keep_id"]), r["n"]] for c in old["content"] for r in c}
        bucket = Bucket(content, int(old["places"].iloc[0]), bytes(old["fingerprints"].iloc[0])) if len(old) else Bucket()
        for k, keep, n in new[["key", "keep_id", "n"]].itertuples(index=False):
            bucket.put(bytes(k), whole(keep), int(n))
        return stored_bucket(buckets, key[0], bucket)

    dealt = state.withColumn("bucket", bucket_of("key", buckets))
    return index.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInPandas(apply, INDEX_SCHEMA), live


def sha256_hex(text: str | None) -> str:
    """The key of one text in plain Python, for tests."""
    import re

    return hashlib.sha256(re.sub(SPACE, " ", text or "").encode()).hexdigest()


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM d
"""
