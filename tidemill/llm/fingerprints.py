"""Document fingerprints by quartile bucket digest.

Hashed byte triplets of a five-byte sliding window are counted in 128 buckets. The digest holds the
length on a log scale, the ratios of the count quartiles, and two bits for each bucket that say
between which quartiles its count lies. Two digests differ by a bounded score, turned into a
likeness of 0 to 1.

Defined cases: a null text is empty; a text under five bytes has no triplet and gets the digest of
its length alone; equal texts have equal digests and likeness 1; an empty table gives no rows; a
single document is its own next one. Rows with one doc_id (or none, which come first) are ordered by
a hash of the text and then by the text, so that many of them spread over tasks. Other columns of the input are
ignored, whatever their names. A very long text is counted in blocks of a million bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import few_at_once, stable, table, texts

BUCKETS = 128
#: Offsets of the triplets in the window, each with a multiplier of its own.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263, 374761393, 2869860233)
#: Difference at which two digests count as wholly unlike.
FAR = 320.0
ROWS = "kind int, part int, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def digest(text: str) -> str:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    counts = np.zeros(BUCKETS, np.int64)
    block = 1 << 20
    for at in range(0, max(0, n - 4), block):  # in blocks, so that a long text needs little memory
        wide = data[at : at + block + 4].astype(np.uint32)
        m = len(wide) - 4
        for (a, b, c), k in zip(TRIPLETS, MULTIPLIERS, strict=True):
            v = wide[a : a + m] | wide[b : b + m] << np.uint32(8) | wide[c : c + m] << np.uint32(16)
            counts += np.bincount((v * np.uint32(k)) >> np.uint32(25), minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = (codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6).astype(np.uint8)
    size = min(255, round(8 * math.log2(n + 1)))
    r1, r2 = (15 * int(q1) // int(q3), 15 * int(q2) // int(q3)) if q3 else (0, 0)
    return f"{size:02x}{r1:x}{r2:x}{body.tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 from a difference of FAR on."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(d), np.uint8) for d in (a, b))
    gap = np.abs(((x[2:, None] >> np.arange(0, 8, 2)) & 3).astype(int) - ((y[2:, None] >> np.arange(0, 8, 2)) & 3))
    score = int(gap.sum()) + 3 * int((gap == 3).sum())
    score += 2 * abs(int(x[0]) - int(y[0])) + 2 * abs(int(x[1] >> 4) - int(y[1] >> 4)) + 2 * abs(int(x[1] & 15) - int(y[1] & 15))
    return max(0.0, 1.0 - score / FAR)


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _row(doc_id, text: str, own: str, after: str, after_own: str) -> tuple:
    new = edited(text, after)
    fp = digest(new)
    return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own, fp, likeness(own, fp), likeness(own, after_own))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    names = [x.split()[0] for x in ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: a finished row. Kind 1, 2: the partition's first and last text, for the neighbours."""
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            own = digest(text)
            if held is None:
                rows.append((1, part, key, text, None, None, None, None, None, None))
            else:
                rows.append((0, part, held[0], None, *_row(*held, text, own)[1:]))
            held = (key, text, own)
        yield _batch(rows)
    if held is not None:
        yield _batch([(2, part, *held[:2], None, None, None, None, None, None)])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(0, 0, key, None, *_row(key, text, digest(text), after, digest(after))[1:]) for key, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield _batch(rows)


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness, by ascending doc_id.

    One range shuffle by doc_id brings neighbours together; only the texts at the borders of the
    partitions (two each) are joined afterwards.
    """
    hashed = texts(docs).withColumn("tie", F.xxhash64("text"))
    ordered = hashed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    with few_at_once(docs.sparkSession):
        rows = stable(ordered.mapInArrow(_scan, ROWS))
    heads, tails = (rows.filter(F.col("kind") == k).select("part", "doc_id", "text") for k in (1, 2))
    order = Window.orderBy("part")  # a row for each partition, without its text
    first = F.min("part").over(Window.partitionBy())
    follow = tails.select("part").select("part", F.coalesce(F.lead("part").over(order), first).alias("after"))
    ends = (
        tails.join(follow, "part")
        .join(heads.select(F.col("part").alias("after"), F.col("text").alias("after_text")), "after")
        .select("doc_id", "text", "after_text")
        .mapInArrow(_ends, ROWS)
    )
    return rows.filter(F.col("kind") == 0).select(*RESULT).unionByName(ends.select(*RESULT))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))
