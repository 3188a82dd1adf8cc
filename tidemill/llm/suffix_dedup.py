"""Removal of repeated passages with a logarithmic family of suffix arrays.

A byte goes if a string of WINDOW bytes that covers it also starts in a document with a smaller id.

1. Each text is cut into segments: in each window the leftmost smallest hash of K bytes is its
   anchor, and the windows of one anchor are one segment. Equal windows have equal anchors, so only
   segments with one anchor hash can hold equal windows. The hash places a segment and decides
   nothing else; every match is found by comparing bytes.
2. Buckets of documents ask shards of anchors which of their anchors other documents have too. A
   bucket has a fixed size, so it sends a bounded number of messages, and their sum is linear.
3. Segments with a shared anchor go on with their bytes, dealt by anchor. Where one anchor has more
   than HEAVY segments, its segments are cut further by the second smallest hash of each window, so
   that a frequent anchor is spread over many tasks.
4. Of the segments of one key, by ascending doc_id, equal ones stand for each other; the suffixes of
   the others (cut to one window) come in batches, each a sorted suffix array with the smallest
   document of each suffix. A batch is merge-scanned against the levels of the index for matches in
   smaller documents and becomes a level; levels of equal size merge, so a suffix is merged a
   logarithmic number of times. A task drops its levels between two keys once they hold LIMIT suffixes.
5. The answers meet the texts again by bucket, where covered bytes are removed.

``covered`` and ``deduplicated`` judge one table and keep no index, so a segment whose anchor nobody
shares never becomes a suffix. ``extended`` keeps one: its levels lie in a folder, every segment is
indexed, and each new table is merge-scanned against the levels of those before.

Defined cases: a null text is empty; a text below WINDOW bytes is kept whole; rows with one doc_id
never match each other; a null doc_id comes before every other id; repeated rows are judged alike; an
empty table gives no rows; other columns are left out by ``covered`` and kept by ``deduplicated``,
whatever their names. A very long text is one row of its bucket and is held whole by one task, with
about 40 bytes for each of its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemill.llm.common import fewer_rows, stable, table

WINDOW = 50
K = 20
#: Bytes of text in a bucket, the unit that one Python call holds, on average.
BUCKET_BYTES = 4 << 20
#: Bytes of text for each task of the index and for each shard of anchors.
PART_BYTES, SHARD_BYTES = 32 << 20, 64 << 20
#: Unlike segments of one anchor, summed over the buckets, beyond which they are cut by a second hash.
HEAVY = 2000
#: Segments in a batch of the index, and suffixes beyond which a task drops the levels of finished keys.
BATCH, LIMIT = 1 << 11, 1 << 16
NULL_ID = -(1 << 63)
_rng = np.random.default_rng(11)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, for as many places as asked."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.up) < n:
            m = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(_BASE, m, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * np.uint64(pow(_INVERSE, m, 1 << 64))])
        return cls.up[:n], cls.down[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def hashes(data: np.ndarray, k: int = K) -> np.ndarray:
    """The hash of each string of k bytes."""
    n = len(data)
    up, down = Powers.get(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=prefix[1:])
    return _mix((prefix[k:] - prefix[:-k]) * down[: n - k + 1])


def segments(data: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first and last window start of each segment, the hash of its anchor, a hash of its two ends."""
    n, w = len(data), window - k + 1
    if n < window:
        empty = np.empty(0, np.int64)
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    h = hashes(data, k)
    least, size = h, 1
    while size < w:  # smallest of ever wider windows
        step = min(size, w - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    # the leftmost smallest changes where it leaves the window or a smaller one enters
    cut = np.flatnonzero((h[: len(least) - 1] == least[:-1]) | (h[w:] < least[:-1])) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(least)]]) - 1
    return first, last, least[first], _mix(h[first] ^ h[last + w - 1] * np.uint64(3))


def finer(data: bytes, anchor: int) -> list[tuple[int, int, int]]:
    """(first, last, key) of the runs of windows of a segment that have one second smallest hash, the
    smallest of the others than the anchor's. Equal windows have it in common."""
    h = hashes(np.frombuffer(data, np.uint8))
    h = np.where(h == np.uint64(anchor), np.uint64((1 << 64) - 1), h)
    second = np.lib.stride_tricks.sliding_window_view(h, WINDOW - K + 1).min(1)
    first = np.concatenate([[0], np.flatnonzero(second[1:] != second[:-1]) + 1])
    last = np.append(first[1:], len(second)) - 1
    keys = _mix(second[first] + np.uint64(anchor))
    return list(zip(first.tolist(), last.tolist(), keys.tolist(), strict=True))


class Bucket:
    """The documents of a bucket with their segments; the same rows always give the same numbering."""

    def __init__(self, ids: list[int], texts: list[bytes]) -> None:
        order = self.order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        parts = [segments(np.frombuffer(t, np.uint8)) for t in self.texts]
        self.count = np.array([len(p[0]) for p in parts], np.int64)
        join = lambda k, kind: np.concatenate([p[k] for p in parts]) if parts else np.empty(0, kind)
        self.first, self.last, self.anchor, self.ends = join(0, np.int64), join(1, np.int64), join(2, np.uint64), join(3, np.uint64)
        self.row = np.repeat(np.arange(len(parts)), self.count)
        self.doc = np.array(self.ids, np.int64)[self.row]
        # each anchor once, and whether several documents have it
        order = np.argsort(self.anchor, kind="stable")
        s, d = self.anchor[order], self.doc[order]
        new = np.ones(len(order), bool)
        new[1:] = s[1:] != s[:-1]
        at = np.flatnonzero(new)
        self.anchors = s[at]
        self.several = d[np.append(at[1:], len(s)) - 1] > d[at]  # rows ascend by document
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1

    def sizes(self) -> np.ndarray:
        """How many unlike segments each anchor has, as far as their ends tell."""
        order = np.lexsort((self.ends, self.number))
        a, e = self.number[order], self.ends[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (e[1:] != e[:-1])
        return np.bincount(a[new], minlength=len(self.anchors))

    def shards(self, n: int) -> list[tuple[int, np.ndarray]]:
        """(shard, numbers of the anchors sent there), in ascending order."""
        if not len(self.anchors):
            return []
        shard = (self.anchors % np.uint64(n)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        values, at = np.unique(shard[order], return_index=True)
        return list(zip(values.tolist(), np.split(order, at[1:]), strict=True))

    def leads(self, which: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Of the segments ``which``: those with bytes that none before them has, these bytes, and for each
        segment the place of the one that stands for it."""
        seen: dict[bytes, int] = {}
        lead, own, data = np.empty(len(which), np.int64), [], []
        texts = self.texts
        for i, (r, f, e) in enumerate(zip(self.row[which].tolist(), self.first[which].tolist(), (self.last[which] + WINDOW).tolist(), strict=True)):
            x = texts[r][f:e]
            k = seen.setdefault(x, len(own))
            if k == len(own):
                own.append(i)
                data.append(x)
            lead[i] = k
        own = which[np.array(own, np.int64)] if own else which[:0]
        return own, data, lead


def _bucket(t: pa.Table) -> Bucket:
    return Bucket(t.column("doc").to_pylist(), t.column("text").to_pylist())


def _send(n: int):
    """Bucket -> for each shard: 31 bits of each anchor and whether several documents of the bucket have it,
    then the numbers of segments (255: so many or more)."""

    def run(t: pa.Table) -> pa.Table:
        b = _bucket(t)
        shards, blobs, size = [], [], b.sizes()
        for shard, which in b.shards(n):
            marks = (b.anchors[which] >> np.uint64(33)).astype(np.uint32) << np.uint32(1) | b.several[which].astype(np.uint32)
            sizes = zlib.compress(np.minimum(size[which], 255).astype(np.uint8).tobytes(), 1)
            shards.append(shard)
            blobs.append(len(which).to_bytes(8, "little") + marks.astype("<u4").tobytes() + sizes)
        key = t.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([key] * len(shards), pa.int64()), "shard": pa.array(shards, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def _answer(t: pa.Table) -> pa.Table:
    """Shard -> for each bucket a status for each anchor sent: 1 another document has it too, 2 with
    many segments, 0 nothing to do. Two anchors with the same 31 bits only cost a needless comparison."""
    marks, sizes, own = [], [], []
    for blob in t.column("blob").to_pylist():
        n = int.from_bytes(blob[:8], "little")
        own.append(n)
        marks.append(np.frombuffer(blob, "<u4", n, 8))
        sizes.append(np.frombuffer(zlib.decompress(blob[8 + 4 * n :]), np.uint8))
    mark, size = np.concatenate(marks), np.concatenate(sizes).astype(np.int64)
    _, place, count = np.unique(mark >> np.uint32(1), return_inverse=True, return_counts=True)
    shared = count > 1
    shared[place[(mark & np.uint32(1)) == 1]] = True
    status = (shared[place] + (shared & (np.bincount(place, size) > HEAVY))[place]).astype(np.uint8)
    pieces = np.split(status, np.cumsum(own)[:-1])
    return pa.table({"bucket": t.column("bucket"), "shard": t.column("shard"), "status": pa.array([zlib.compress(p.tobytes(), 1) for p in pieces], pa.binary())})


def _statuses(b: Bucket, t: pa.Table, n: int) -> np.ndarray:
    """The status of each segment."""
    out = np.zeros(len(b.anchors), np.uint8)
    got = dict(zip(t.column("shard").to_pylist(), t.column("status").to_pylist(), strict=True))
    for shard, which in b.shards(n):
        out[which] = np.frombuffer(zlib.decompress(got[shard]), np.uint8)
    return out[b.number]


SEGMENTS = "bucket long, segment long, doc long, key long, place long, bytes binary"


def _rows(bucket: int, b: Bucket, own: np.ndarray, data: list[bytes], heavy: np.ndarray) -> pa.Table:
    """SEGMENTS of the segments own; of heavy ones their parts, ``place`` being the part's first window."""
    key, place, segment, doc = b.anchor[own].view(np.int64), np.zeros(len(own), np.int64), own, b.doc[own]
    if heavy.any():
        out = []
        for i, k, x, many in zip(range(len(own)), b.anchor[own].tolist(), data, heavy.tolist(), strict=True):
            out += [(i, f, c, x[f : e + WINDOW]) for f, e, c in finer(x, k)] if many else [(i, 0, k, x)]
        at = np.array([r[0] for r in out], np.int64)
        key, place = np.array([r[2] for r in out], np.uint64).view(np.int64), np.array([r[1] for r in out], np.int64)
        segment, doc, data = own[at], b.doc[own][at], [r[3] for r in out]
    numbers = {"bucket": np.full(len(segment), bucket, np.int64), "segment": segment, "doc": doc, "key": key, "place": place}
    return pa.table({c: pa.array(v, pa.int64()) for c, v in numbers.items()} | {"bytes": pa.array(data, pa.binary())})


def _segments(n: int | None):
    """Bucket and its answers -> the segments to compare; without shards all of them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or (n and not right.num_rows):
            return pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in SEGMENTS.split(", ")]).empty_table()
        b = _bucket(left)
        status = _statuses(b, right, n) if n else np.ones(len(b.doc), np.uint8)
        own, data, _ = b.leads(np.flatnonzero(status))
        return _rows(left.column("bucket")[0].as_py(), b, own, data, status[own] > 1)

    return run


class SuffixLevels:
    """Sorted suffix arrays of growing size with the smallest document of each suffix."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def _array(suffix: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted array, the smallest document of each suffix, and the place of each given suffix in it."""
        order = np.argsort(suffix, kind="stable")  # two sorted runs merge in one pass
        sorted_ = suffix[order]
        new = np.ones(len(suffix), bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        place = np.empty(len(suffix), np.int64)
        place[order] = np.cumsum(new) - 1
        return sorted_[new], np.minimum.reduceat(doc[order], np.flatnonzero(new)), place

    def add(self, suffix: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which suffixes a smaller document holds, of this batch or of an earlier one."""
        own, first, place = self._array(suffix, doc)
        for old, old_doc in self.levels:
            at = np.minimum(np.searchsorted(old, own), len(old) - 1)
            first = np.where(old[at] == own, np.minimum(first, old_doc[at]), first)
        covered = first[place] < doc
        self.levels.append((own, first))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self._array(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))[:2])
        return covered


def windows(data: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the segments as fixed strings, and how many each has. UTF-8 has no byte 255, which stands for 0."""
    flat = np.frombuffer(b"".join(data), np.uint8)
    flat = np.where(flat == 0, np.uint8(255), flat)
    size = np.array([len(x) for x in data], np.int64)
    start = np.cumsum(size) - size
    count = size - window + 1
    at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
    view = np.lib.stride_tricks.sliding_window_view(flat, window)
    return np.ascontiguousarray(view[at]).view(f"S{window}").ravel(), count


def _masks(covered: np.ndarray, count: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(count)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.bincount(owner, covered * 2.0**place, len(count)).astype(np.int64)  # at most 31 places: exact


class Scanner:
    """Segments by key and ascending document -> the windows of each that a smaller document holds."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]] | None = None, keep: bool = False) -> None:
        self.index, self.keep, self.key, self.seen = SuffixLevels(), keep, None, {}
        self.index.levels = levels or []

    def __call__(self, key: np.ndarray, doc: np.ndarray, data: list[bytes]) -> np.ndarray:
        """A mask for each segment. A call ends where a key ends, or within one key."""
        if not len(key):
            return np.empty(0, np.int64)
        if not self.keep and key[0] != self.key and sum(len(x[0]) for x in self.index.levels) > LIMIT:
            self.index = SuffixLevels()
        seen = self.seen if key[0] == self.key else {}
        first = np.array([seen.setdefault(x, d) for x, d in zip(data, doc.tolist(), strict=True)], np.int64)
        size = np.array([len(x) for x in data], np.int64) - WINDOW + 1
        out = np.where(first < doc, (1 << size) - 1, 0)
        # a segment alone with its key meets nobody, unless its key goes on or the index outlives the table
        alone = np.ones(len(key), bool)
        same = key[1:] == key[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        alone &= (key != self.key) & (key != key[-1])
        which = np.flatnonzero((out == 0) & (~alone | self.keep))
        if len(which):
            suffix, count = windows([data[i] for i in which.tolist()])
            out[which] = _masks(self.index.add(suffix, np.repeat(doc[which], count)), count)
        last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
        if key[-1] != self.key:
            self.key, self.seen = key[-1], {}
        for x, d in zip(data[last:], first[last:].tolist(), strict=True):
            self.seen.setdefault(x, d)
        return out


def _answers_of(scanner: Scanner, t: pa.RecordBatch | pa.Table) -> tuple[list[np.ndarray], Scanner]:
    """bucket, segment, mask of the segments with covered windows."""
    bucket, segment, doc, key, place = (t.column(c).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(c).to_numpy() for c in ("bucket", "segment", "doc", "key", "place"))
    data, masks = t.column("bytes").to_pylist(), np.zeros(len(key), np.int64)
    for at in range(0, len(key), BATCH):
        masks[at : at + BATCH] = scanner(key[at : at + BATCH], doc[at : at + BATCH], data[at : at + BATCH])
    hit = masks != 0
    return [bucket[hit], segment[hit], (masks << place)[hit]], scanner


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        out, scanner = _answers_of(scanner, batch)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["bucket", "segment", "mask"])


def _spans(b: Bucket, shared: np.ndarray, masks: dict[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row: (row, starts, ends) of its maximal covered runs. shared: the segments that were compared."""
    cover = np.zeros(len(b.doc), np.int64)
    own, _, lead = b.leads(shared)
    if len(shared):
        got = np.array([masks.get(i, 0) for i in own.tolist()], np.int64)[lead]
        every = (np.int64(1) << (b.last[shared] - b.first[shared] + 1)) - 1
        cover[shared] = np.where(b.doc[own][lead] < b.doc[shared], every, got)
    at = 0
    for row, n in enumerate(b.count.tolist()):
        mark = np.zeros(len(b.texts[row]) + 1, np.int32)
        part = cover[at : at + n]
        live = at + np.flatnonzero(part)
        if len(live):
            o = np.arange(WINDOW - K + 1)
            hit = (cover[live][:, None] >> o & 1).astype(bool)
            start = (b.first[live][:, None] + o)[hit]
            np.add.at(mark, start, 1)
            np.add.at(mark, start + WINDOW, -1)
        at += n
        on = np.cumsum(mark[:-1]) > 0
        edge = np.diff(np.concatenate([[False], on, [False]]).astype(np.int8))
        yield row, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(n: int | None, schema: pa.Schema, carried: bool):
    """Bucket with its texts and answers -> the digests, or the other columns with the text that stays."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        b = _bucket(left)
        status = _statuses(b, right.filter(pa.compute.is_valid(right.column("status"))), n) if n else np.ones(len(b.doc), np.uint8)
        found = right.filter(pa.compute.is_valid(right.column("mask")))
        masks: dict[int, int] = {}
        for s, m in zip(found.column("segment").to_pylist(), found.column("mask").to_pylist(), strict=True):
            masks[s] = masks.get(s, 0) | m
        rows, texts = [], []
        for row, starts, ends in _spans(b, np.flatnonzero(status), masks):
            text, at, kept = b.texts[row], 0, []
            for x, y in zip(starts.tolist(), ends.tolist(), strict=True):
                kept.append(text[at:x])
                at = y
            left_over = b"".join(kept) + text[at:] if kept else text
            if carried:
                texts.append(left_over.decode("utf-8", "ignore"))
            else:
                doc = None if b.ids[row] == NULL_ID else b.ids[row]
                rows.append((doc, len(text), len(text) - len(left_over), len(starts), hashlib.sha256(left_over).hexdigest()))
        if not carried:
            return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rest = left.select([c for c in left.column_names if c.startswith("c_")]).take(b.order)
        return pa.table([pa.array(texts, pa.string()), *rest.columns], schema=schema)

    return run


def _replies(placed: DataFrame, total: int, shards: int) -> DataFrame:
    """For each bucket: the statuses of its anchors by shard, and the covered windows of single segments."""
    narrow = placed.select("bucket", "doc", "text")
    sent = narrow.groupBy("bucket").applyInArrow(_send(shards), "bucket long, shard long, blob binary")
    answers = sent.groupBy("shard").applyInArrow(_answer, "bucket long, shard long, status binary")
    dealt = narrow.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_segments(shards), SEGMENTS)
    found = dealt.repartition(_tasks(placed.sparkSession, total), "key").sortWithinPartitions("key", "doc").mapInArrow(_scan, "bucket long, segment long, mask long")
    nothing = lambda kind: F.lit(None).cast(kind)
    return answers.select("bucket", "shard", "status", nothing("long").alias("segment"), nothing("long").alias("mask")).unionByName(
        found.select("bucket", nothing("long").alias("shard"), nothing("binary").alias("status"), "segment", "mask")
    )


def _tasks(spark: SparkSession, total: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))


def _bytes(docs: DataFrame) -> int:
    fewer_rows(docs.sparkSession)
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def _placed(docs: DataFrame, total: int, carry: list[str]) -> DataFrame:
    """Texts dealt to buckets by document and text, so that rows without an id spread as well."""
    text, doc = F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    bucket = F.pmod(F.xxhash64(doc, text), F.lit(max(1, -(-total // BUCKET_BYTES))))
    return docs.select(bucket.alias("bucket"), doc.alias("doc"), text.alias("text"), *[F.col(f"`{c}`").alias(f"c_{k}") for k, c in enumerate(carry)])


def _apply(docs: DataFrame, carry: list[str]) -> DataFrame:
    """One plan: the texts are dealt to buckets once, and that exchange is read by each of the three steps."""
    total = _bytes(docs)
    shards = max(1, -(-total // SHARD_BYTES), min(64, -(-total // BUCKET_BYTES)))
    placed = _placed(docs, total, carry)
    if carry:
        kinds = [("text", T.StringType()), *[(f"c_{k}", docs.schema[c].dataType) for k, c in enumerate(carry)]]
    else:
        kinds = [(f.name, f.dataType) for f in T.StructType.fromDDL(DIGESTS)]
    schema = T.StructType([T.StructField(c, k) for c, k in kinds])
    replies = _replies(placed, total, shards)
    return placed.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(_finish(shards, to_arrow_schema(schema), bool(carry)), schema)


LEVELS = "shard long, level int, size long, suffixes binary, docs binary"


def _indexed(left: pa.Table, right: pa.Table) -> pa.Table:
    """A shard's new segments and its levels -> the answers and the levels as they then are."""
    levels = sorted(zip(*(right.column(c).to_pylist() for c in ("level", "size", "suffixes", "docs")), strict=True)) if right.num_rows else []
    levels = [(np.frombuffer(s, f"S{WINDOW}"), np.frombuffer(d, np.int64)) for _, n, s, d in levels]
    shard = (left if left.num_rows else right).column("shard")[0].as_py()
    order = np.lexsort((left.column("doc").to_numpy(), left.column("key").to_numpy())) if left.num_rows else []
    (bucket, segment, mask), scanner = _answers_of(Scanner(levels, keep=True), left.take(pa.array(order, pa.int64())))
    held, n = scanner.index.levels, len(bucket)
    none = [None] * len(held)
    return pa.table({
        "bucket": pa.array([*bucket.tolist(), *none], pa.int64()), "segment": pa.array([*segment.tolist(), *none], pa.int64()), "mask": pa.array([*mask.tolist(), *none], pa.int64()),
        "shard": pa.array([shard] * (n + len(held)), pa.int64()), "level": pa.array([None] * n + list(range(len(held))), pa.int32()), "size": pa.array([None] * n + [len(s) for s, _ in held], pa.int64()),
        "suffixes": pa.array([None] * n + [s.tobytes() for s, _ in held], pa.binary()), "docs": pa.array([None] * n + [d.tobytes() for _, d in held], pa.binary()),
    })


def extended(docs: DataFrame, folder: str, shards: int = 64) -> DataFrame:
    """``covered`` against these documents and all that were added to the index in ``folder`` before; they
    are added themselves. Documents judged earlier are not judged anew, so ids should ascend.

    ``folder`` is shared by all executors; each call writes one generation of levels there and reads
    the one before, so a call that fails leaves the index as it was. A task holds the suffixes of one
    shard, about 60 bytes for each byte of text that falls to it: choose ``shards`` for all that will come.
    """
    spark, total = docs.sparkSession, _bytes(docs)
    placed = _placed(docs, total, [])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(f.getPath().getName().rpartition("-")[2]) for f in (files.listStatus(path) if files.exists(path) else []) if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    before = max(done, default=-1)
    levels = spark.read.parquet(f"{folder}/generation-{before}") if done else spark.createDataFrame([], LEVELS)
    narrow = placed.select("bucket", "doc", "text")
    dealt = narrow.groupBy("bucket").applyInArrow(lambda t: _segments(None)(t, t), SEGMENTS)
    dealt = dealt.withColumn("shard", F.pmod("key", F.lit(shards)))
    both = dealt.groupBy("shard").cogroup(levels.groupBy("shard")).applyInArrow(_indexed, "bucket long, segment long, mask long, " + LEVELS)
    both = stable(both)
    both.filter("level IS NOT NULL").select(*[c.split()[0] for c in LEVELS.split(", ")]).write.mode("overwrite").parquet(f"{folder}/generation-{before + 1}")
    schema = T.StructType.fromDDL(DIGESTS)
    return placed.groupBy("bucket").cogroup(both.filter("level IS NULL").select("bucket", "segment", "mask").groupBy("bucket")).applyInArrow(_finish(None, to_arrow_schema(schema), False), schema)


def covered(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each row of docs."""
    return _apply(docs.select("doc_id", "text"), [])


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes taken out of their texts; the rest of a character cut through goes too.

    A text of which nothing is left stays as an empty row; a null text becomes empty; ``n_chars``
    follows the text where it is a column.
    """
    carry = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = _apply(docs, carry).select("text", *[F.col(f"c_{k}").alias(c) for k, c in enumerate(carry)])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covered(table(spark, sf_dir, "documents"))
