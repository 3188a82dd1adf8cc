r"""Near duplicates by one-permutation MinHash with optimal densification.

Each document's set of five-word shingles is hashed once; its hashes fall into BINS bins by their
leading bits, a bin keeps its smallest, and an empty bin borrows from the first filled bin in a
random order of its own. Groups of ROWS bins are the bands. Documents with equal sets are one class
from the start. In each bucket of a band, members are tied to its smallest member and to one drawn by
a hash of the bucket (a star, so candidate pairs grow with the members); pairs whose set sizes
exclude the threshold go, and the rest are confirmed on their full sets. Buckets that still hold
more than one component are then settled in full: in those of up to SMALL members every pair across
components that was not yet compared is confirmed like the others; larger ones are dealt by salts
into blocks, and each pair of salts is compared as a whole, by products of 0/1 matrices of the
shingles that more than one of its members holds. A block gives a forest of links, so rows grow with
the members and not with their pairs. Components are found by contraction of the links.

A pair at the threshold shares no band with probability (1 - 0.85**6)**42, about 2e-9, and at 0.8
about 3e-6. Every pair that shares a band is compared or in one component already.

Defined cases: a null or blank text has an empty set and links with nothing; fewer than five words
are one shingle; a null doc_id links with nothing, has no component and is kept; repeated rows form one
component; an empty table gives no rows; other columns are ignored, whatever their names. A text is
held whole by one task, with eight bytes for each word; nothing is cut from it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import CACHED_CHARS, by_key, few_at_once, frequent, stable, table, texts
from tidemill.llm.components import components

WORDS = 5
BINS, BANDS, ROWS = 256, 42, 6
PERCENT = 85
CACHE_WORDS = 150_000
#: Members of a bucket whose pairs are rows; members and shingles for each salt of a larger one; columns of a matrix.
SMALL, MEMBERS, WEIGHT, COLUMNS = 16, 1024, 1 << 20, 1024
#: Pairs of one document that meet its text in one task, on average; the text goes once to each such share.
SHARE = 1024
_M1, _M2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(7)
_ORDER = np.argsort(_rng.random((BINS, BINS)), axis=1).astype(np.int64)
_ODD = _rng.integers(1, 1 << 62, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(56)).astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * _M1
    x = (x ^ x >> np.uint64(33)) * _M2
    return x ^ x >> np.uint64(33)


class Shingles:
    """Sorted distinct hashes of a text's shingles; A-Z are lowered and words split at ASCII white space."""

    def __init__(self, words: int = WORDS, cache_words: int = CACHE_WORDS) -> None:
        self.words, self.cache_words, self.known = words, cache_words, {}

    def __call__(self, text: str) -> np.ndarray:
        words, known = text.encode("utf-8", "surrogatepass").lower().split(), self.known
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        try:
            w = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        except KeyError:
            if len(known) > self.cache_words:
                known.clear()
            fresh = {x: xxhash.xxh64_intdigest(x) for x in words if x not in known}
            w = np.fromiter((known[x] if x in known else fresh[x] for x in words), np.uint64, n)
            known.update((x, h) for x, h in fresh.items() if len(x) <= CACHED_CHARS)
        m = min(self.words, n)
        h = np.full(n - m + 1, m, np.uint64)
        for k in range(m):
            h = _mix(h * _STEP + w[k : n - m + 1 + k])
        return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    """Smallest hash of each bin; an empty bin copies the first filled bin in its own random order."""
    at = np.searchsorted(s, _EDGES)
    ends = np.append(at[1:], len(s))
    full = ends > at
    out = s[np.minimum(at, len(s) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _ORDER[empty]
        source = order[np.arange(len(empty)), full[order].argmax(1)]
        out[empty] = out[source]
    return out


def bands(s: np.ndarray) -> np.ndarray:
    rows = signature(s)[: BANDS * ROWS].reshape(BANDS, ROWS)
    return _mix((rows * _ODD).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _STEP).view(np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingles()
    for batch in batches:
        n, digest, keys = [], [], []
        for text in batch.column(1):
            s = shingles(text.as_py())
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            keys.append(bands(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.binary())], ["doc_id", "n", "digest", "bands"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
        ids, n = (np.repeat(batch.column(k).to_numpy(zero_copy_only=False), BANDS) for k in (0, 1))
        for at in range(0, len(flat), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 18)]) for x in (flat, ids, n)], ["key", "id", "n"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, held = Shingles(), None, None
        for batch in batches:
            a_out, b_out = [], []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, held = a, shingles(x.as_py())
                other = shingles(y.as_py())
                both = len(np.intersect1d(held, other, assume_unique=True))
                if 100 * both >= percent * (len(held) + len(other) - both):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return run


def common(sets: list[np.ndarray], first: int, second: int) -> np.ndarray:
    """Numbers of shingles that each of sets[:first] shares with each of sets[second:]."""
    held, at = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(held, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    at, column = at[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    at, column = at[order], column[order]
    out = np.zeros((first, len(sets) - second), np.int32)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, (k, k + COLUMNS)))
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[at[part], column[part] - k] = 1
        out += (x[:first] @ x[second:].T).astype(np.int32)
    return out


def _links(rows: list[tuple[int, int, bool, np.ndarray]], one_salt: bool, percent: int) -> list[tuple[int, int]]:
    """Rows (id, component, of the lower salt, shingles) of a block -> links that join whatever components its pairs join."""
    rows = sorted((r for r in rows if len(r[3])), key=lambda r: not r[2])
    first = len(rows) if one_salt else sum(r[2] for r in rows)
    second = 0 if one_salt else first
    labels = np.array([r[1] for r in rows], np.int64)
    if not first or second == len(rows) or (labels == labels[0]).all():
        return []
    both, n, out = common([r[3] for r in rows], first, second), np.array([len(r[3]) for r in rows]), []
    for i in range(first):
        near = second + np.flatnonzero(100 * both[i].astype(np.int64) >= percent * (n[i] + n[second:] - both[i]))
        joined, which = np.unique(labels[near], return_index=True)
        if (other := joined != labels[i]).any():
            out += [(rows[i][0], rows[near[k]][0]) for k in which[other]]
            labels[np.isin(labels, joined)] = labels[i]
    return out


def _blocks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, rows = Shingles(), None, []

        def ended() -> pa.RecordBatch:
            links = _links(rows, last[1] == last[2], percent) if last else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for key, lo, hi, lower, i, c, text in zip(*(x.to_pylist() for x in batch.columns[:-1]), batch.columns[-1], strict=True):
                if (key, lo, hi) != last:
                    yield ended()
                    last, rows = (key, lo, hi), []
                rows.append((i, c, lower, shingles(text.as_py())))
        yield ended()

    return run


def _sizes_allow(percent: int):
    return 100 * F.least("n", "m") >= percent * F.greatest("n", "m")


def _confirmed(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) -> those whose full sets meet the threshold; held has the texts (doc_id, text) of both.

    A leader is in the pairs of its whole bucket, on either side, so the pairs of a frequent one are dealt to shares."""
    joined = pairs
    for side, other in (("b", "a"), ("a", "b")):
        hot = frequent(pairs.groupBy(side).agg(F.count("*").alias("n")), side, SHARE)
        shares = F.coalesce(F.ceil(F.col("hot_n") / SHARE), F.lit(1).cast("long"))
        every = held.join(hot, F.col("doc_id") == F.col("hot_key"), "left")
        every = every.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}"), F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"))
        dealt = joined.join(hot, F.col(side) == F.col("hot_key"), "left").withColumn("share", F.pmod(F.xxhash64(other), shares)).drop("hot_key", "hot_n")
        joined = dealt.join(every, [side, "share"]).drop("share")
    return joined.select("a", "b", "text_a", "text_b").sortWithinPartitions("a").mapInArrow(_confirm(percent), "a long, b long")


def _settled(ties: DataFrame, found: DataFrame, pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join whatever the buckets of several components still hold apart.

    ties (key, id, n) are the members of the buckets, found (id, component), pairs (a, b) those compared before, held the texts of all members.
    """
    labels = found.select(F.col("id").alias("i"), "component")
    labelled = ties.join(labels, F.col("id") == F.col("i"), "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
    mixed = labelled.groupBy(F.col("key").alias("k")).agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("members"), F.sum("n").alias("weight")).filter("least < most")
    open_ = stable(labelled.join(mixed, F.col("key") == F.col("k")).select("key", "id", "n", "c", "members", "weight"))
    small = open_.filter(F.col("members") <= SMALL).select("key", "id", "n", "c")
    other = small.select(F.col("key").alias("k"), F.col("id").alias("b"), F.col("n").alias("m"), F.col("c").alias("d"))
    apart = small.join(other, (F.col("key") == F.col("k")) & (F.col("id") < F.col("b")) & (F.col("c") != F.col("d")))
    apart = apart.filter(_sizes_allow(percent)).select(F.col("id").alias("a"), "b").distinct()
    links = stable(_confirmed(stable(apart.join(pairs, ["a", "b"], "left_anti")), held, percent))
    large = open_.filter(F.col("members") > SMALL)
    if large.limit(1).count() == 0:
        return links
    salts = F.greatest(F.ceil(F.col("members") / MEMBERS), F.ceil(F.col("weight") / WEIGHT))
    salted = large.select("key", "id", "c", salts.alias("salts")).distinct().withColumn("salt", F.pmod(F.xxhash64("id", "key"), F.col("salts")))
    dealt = salted.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    dealt = dealt.select("key", F.least("salt", "with").alias("lo"), F.greatest("salt", "with").alias("hi"), (F.col("salt") <= F.col("with")).alias("lower"), "id", "c")
    rows = dealt.join(held, F.col("id") == F.col("doc_id")).select("key", "lo", "hi", "lower", "id", "c", "text")
    blocks = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return links.union(stable(blocks.mapInArrow(_blocks(percent), "a long, b long")))


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs."""
    with few_at_once(docs.sparkSession):
        return _classes(docs, percent)


def _classes(docs: DataFrame, percent: int) -> DataFrame:
    source = texts(docs)
    scanned = stable(source.mapInArrow(_scan, "doc_id long, n long, digest binary, bands binary"))
    known = scanned.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    firsts = stable(known.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    # a repeated doc_id with different texts is several classes under one id; their links are the id's
    reps = known.join(firsts.select(F.col("digest").alias("d"), "id"), (F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("d"))).select("id", "n", "bands")
    keys = reps.mapInArrow(_unpack, "key long, id long, n long")
    stars = keys.groupBy("key").agg(
        F.min(F.struct("id", "n")).alias("low"),
        F.min(F.struct(F.xxhash64("key", "id").alias("h"), "id", "n")).alias("drawn"),
        F.max("id").alias("high"),
    ).filter(F.col("low.id") < F.col("high"))
    ties = stable(keys.join(stars.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("key", "id", "n", "low", F.struct("drawn.id", "drawn.n").alias("drawn")))
    tied = ties.select("id", "n", F.explode(F.array("low", "drawn")).alias("lead")).filter("lead.id <> id")
    tied = tied.select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b"), "n", F.col("lead.n").alias("m"))
    pairs = stable(tied.filter(_sizes_allow(percent)).select("a", "b").distinct())
    # only copies: a set of its own has no one to be tied to
    copied = firsts.filter("n > 1").select("digest", "id")
    same = by_key(known.select("digest", "doc_id"), copied, "digest", frequent(firsts.select("digest", "n"), "digest"))
    same = same.select(F.col("doc_id").alias("a"), F.col("id").alias("b")).filter("a <> b").distinct()
    # the texts are shuffled once, those of bucket members stay for all that is compared
    members = stable(ties.select(F.col("id").alias("doc_id")).distinct())
    held = stable(source.join(members, "doc_id").distinct())
    edges = stable(_confirmed(pairs, held, percent))
    found = components(edges.union(same))
    gained = _settled(ties.select("key", "id", "n"), found, pairs, held, percent)
    if gained.limit(1).count():
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(gained))
    found = found.withColumnRenamed("id", "doc_id")
    out = scanned.select("doc_id", "n").join(found, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
