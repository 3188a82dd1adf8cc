r"""Phrase collocations: phrases of up to four words counted over suffix arrays of word ids, merged by phrase, and scored.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\x0A-\x0D]`` and these into words ``[^\x20\x09]+``. A shard is
a run of texts of up to SHARD_WORDS words in a task. Its words get ids, and numpy's prefix doubling orders the
suffixes of the id array by their first two, then four words; runs of neighbours that share n words (LCP intervals
of depth n) are the phrases of n words and their counts. Each shard sends a row for each of its phrases, so a frequent phrase
costs as many rows as there are shards, and the counts are summed by phrase.

A phrase of at least ``least`` occurrences holds only such phrases, so three passes over the texts send little: sums by hash of
words; sums by hash of pairs of frequent words; then the words, pairs, and phrases of three and four words that may be frequent, as
text. Hashes only leave out what cannot be frequent: their sums are never too small, a bitmap of FILTER_BITS bits, of
fixed size whatever the corpus, tells shards which hashes are frequent, and what it lets through by
mistake is removed by the exact count of the text, so results depend on neither.

Defined cases: a null text has no words; a null lang is ``und``; empty texts count nothing; repeated rows count
again; ties of score and count go by the bytes of the phrase; an empty table gives no rows; other columns are ignored, whatever
their names. A very long text is one shard of its own and is counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import by_key, few_at_once, frequent, private, stable, table

LEAST, LONGEST, TOP, COVER_PERCENT = 30, 4, 2000, 80
#: Words of a shard, but for a longer text.
SHARD_WORDS = 1_000_000
#: File splits that a task takes: what repeats within a task is sent once.
SPLITS_PER_TASK = 2
#: Bits of the bitmap that a task holds (8 MB).
FILTER_BITS = 1 << 26
SEGMENT_BITS = 1 << 19
#: Bits of a hash of a word or pair; fewer bits cost less to send and let more through.
HASH_BITS = 40
_BYTES = bytearray(range(256))
for _b in b".,;:!?\x0a\x0b\x0c\x0d":
    _BYTES[_b] = 0x0A
_BYTES[0x09] = 0x20
_BYTES = bytes(_BYTES)
BREAK = b"\n"


def words_of(text: str) -> list[bytes]:
    """Words of a text with BREAK between pieces; empty strings may stand among them."""
    return text.encode().lower().translate(_BYTES).replace(BREAK, b" \n ").split(b" ")


def _word_hash(word: bytes, lang: str) -> int:
    return xxhash.xxh3_64_intdigest(word, seed=xxhash.xxh32_intdigest(lang.encode()))


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs from those of their words (uint64, wraps around)."""
    mixed = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _key(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << HASH_BITS) - 1)).view(np.int64)


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a key."""
    k = keys.view(np.uint64)
    return (k % np.uint64(FILTER_BITS)).astype(np.int64), ((k * np.uint64(0x94D049BB133111EB) >> np.uint64(31)) % np.uint64(FILTER_BITS)).astype(np.int64)


class Bits:
    """Bitmap of the keys of frequent words or pairs, as bytes."""

    def __init__(self, raw: bytes) -> None:
        self.raw = np.frombuffer(raw, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        a, b = _places(_key(hashes))
        bit = lambda p: (self.raw[p >> 3] >> (p & 7).astype(np.uint8)) & 1
        return (bit(a) & bit(b)).astype(bool)


def _bitmap(keys: DataFrame) -> bytes:
    """FILTER_BITS bits with those of the column ``key`` set, put together in segments by tasks."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(_places(b.column("key").to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([pa.array(at // SEGMENT_BITS), pa.array((at % SEGMENT_BITS).astype(np.int32))], ["segment", "bit"])

    def segment(t: pa.Table) -> pa.Table:
        bits = np.zeros(SEGMENT_BITS, np.uint8)
        bits[t.column("bit").to_numpy()] = 1
        return pa.table({"segment": t.column("segment").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    rows = keys.mapInArrow(places, "segment long, bit int").distinct().groupBy("segment").applyInArrow(segment, "segment long, bits binary")
    out, size = bytearray(FILTER_BITS // 8), SEGMENT_BITS // 8
    for r in rows.toLocalIterator():  # FILTER_BITS bits at most
        out[r.segment * size : (r.segment + 1) * size] = r.bits
    return bytes(out)


# ---- one shard --------------------------------------------------------------------------------------


class _Ids(dict):
    """word -> id from 2 in the order of first sight; BREAK is 1, the empty string, which is no word, 0."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Shard:
    """Texts of one language as ids, 0 where a piece ends."""

    def __init__(self) -> None:
        self.word_ids, self.parts = _Ids({b"": 0, BREAK: 1}), []

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.word_ids.__getitem__, words), np.int32, len(words)))

    def ids(self) -> np.ndarray:
        joined = np.concatenate([x for p in self.parts for x in (p, np.ones(1, np.int32))])
        return joined[joined > 0] - 1

    def words(self) -> list[bytes]:
        """The word of each id."""
        return [b"", *list(self.word_ids)[2:]]


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs of ranks: one step of prefix doubling."""
    key = first.astype(np.int64) * (int(second.max(initial=0)) + 1) + second
    order = np.argsort(key, kind="stable")
    new = np.zeros(len(key), np.int32)
    if len(key):
        new[order] = np.cumsum(np.concatenate([[1], np.diff(key[order]) != 0]), dtype=np.int32)
    return new


def _ahead(x: np.ndarray, by: int) -> np.ndarray:
    """The value so many places further on, 0 past the end."""
    return np.concatenate([x[by:], np.zeros(min(by, len(x)), x.dtype)])


def intervals(ids: np.ndarray, pairs: np.ndarray, depths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, counts): for each phrase of n words without a break one place and how often it stands.

    Of the suffixes only those begin an interval that have depths[0] words whose neighbours are pairs of interest."""
    starts = np.ones(len(ids), bool)
    for k in range(depths[0] - 1):
        starts &= _ahead(pairs, k)
    at = np.flatnonzero(starts)
    if not len(at):
        return
    second = np.where(pairs, _ahead(ids, 1), 0)
    if depths[-1] > 2:  # the second doubling, of the suffixes that can begin an interval
        two = _ranks(ids, second)
        order = _ranks(two[at], np.where(_ahead(pairs, 1), _ahead(two, 2), 0)[at])
    else:
        order = _ranks(ids[at], second[at])
    suffixes = at[np.argsort(order, kind="stable")]
    run = np.minimum.accumulate([_ahead(pairs, k)[suffixes] for k in range(depths[-1] - 1)], axis=0)
    columns = [_ahead(ids, k)[suffixes] for k in range(depths[-1])]
    equal = np.ones(len(suffixes) - 1, bool)
    shared = []  # shared[n - 1]: neighbours have their first n words in common
    for c in columns:
        equal = equal & (c[1:] == c[:-1])
        shared.append(equal)
    for n in depths:
        has = run[n - 2]
        heads = np.flatnonzero(has & np.concatenate([[True], ~shared[n - 1]]))
        # with its first n words a suffix has them unbroken or not at all, so an interval ends where the next begins or one without begins
        ends = np.flatnonzero(np.concatenate([~(shared[n - 1] & has[1:]), [True]]) & has)
        yield n, suffixes[heads], ends - heads + 1


#: Phrases that a task holds as strings at once.
PHRASES_AT_ONCE = 50_000


def _pairs(ids: np.ndarray, hashes: np.ndarray, words: Bits) -> tuple[np.ndarray, np.ndarray]:
    """Whether a frequent word stands at each place, and before another."""
    known = words.has(hashes)
    known[0] = False
    known = known[ids]
    return known, known & _ahead(known, 1)


def hashed(shard: Shard, lang: str, words: Bits | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of the words of one language's texts in a shard, or of the pairs of frequent words."""
    ids, word = shard.ids(), shard.words()
    hashes = np.array([0] + [_word_hash(w, lang) for w in word[1:]], np.uint64)
    if words is None:
        yield _key(hashes[1:]), np.bincount(ids, minlength=len(word))[1:]
        return
    for _, at, count in intervals(ids, _pairs(ids, hashes, words)[1], (2,)):
        yield _key(_pair_hash(hashes[ids[at]], hashes[ids[at + 1]])), count


def counted(shard: Shard, lang: str, words: Bits, pairs: Bits) -> Iterator[tuple[list[str], np.ndarray]]:
    """(phrases, counts) of what may be frequent, of one word to LONGEST; the empty phrase counts all words."""
    ids, word = shard.ids(), shard.words()
    hashes = np.array([0] + [_word_hash(w, lang) for w in word[1:]], np.uint64)
    known, both = _pairs(ids, hashes, words)
    yield [""], np.array([(ids > 0).sum()])
    n = np.bincount(ids[known], minlength=len(word))
    found = np.flatnonzero(n)
    yield [word[i].decode() for i in found.tolist()], n[found]
    at = np.flatnonzero(both)
    both[at] = pairs.has(_pair_hash(hashes[ids[at]], hashes[ids[at + 1]]))
    for n, at, count in intervals(ids, both, (2, 3, 4)):
        for i in range(0, len(at), PHRASES_AT_ONCE):
            part = at[i : i + PHRASES_AT_ONCE]
            yield [b" ".join([word[k] for k in p]).decode() for p in zip(*(ids[part + k].tolist() for k in range(n)))], count[i : i + PHRASES_AT_ONCE]


def _shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[tuple[str, Shard]]:
    """(language, shard) of a task's texts."""
    held: dict[str, Shard] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            words = words_of(text.as_py())
            if size and size + len(words) > shard_words:
                while held:
                    yield held.popitem()
                size = 0
            held.setdefault(lang, Shard()).add(words)
            size += len(words)
    while held:
        yield held.popitem()


def frequent_keys(docs: DataFrame, least: int, words=None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """key of each word, or pair of the words of a bitmap, that stands least times or shares its key with others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words and Bits(words.value)
        for lang, shard in _shards(batches, shard_words):
            for keys, count in hashed(shard, lang, known):
                for i in range(0, len(keys), PHRASES_AT_ONCE):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + PHRASES_AT_ONCE]), pa.array(count[i : i + PHRASES_AT_ONCE].astype(np.int64))], ["key", "n"])

    return docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key")


def shard_counts(docs: DataFrame, words, pairs, shard_words: int = SHARD_WORDS) -> DataFrame:
    """phrase (language, tab, phrase) and n of what each shard counts; words and pairs are broadcast bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bits(words.value), Bits(pairs.value)
        for lang, shard in _shards(batches, shard_words):
            for phrases, count in counted(shard, lang, *known):
                yield pa.RecordBatch.from_arrays([pa.array([f"{lang}\t{p}" for p in phrases], pa.string()), pa.array(count.astype(np.int64))], ["phrase", "n"])

    return docs.mapInArrow(run, "phrase string, n long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, words, phrase, n of all phrases of up to LONGEST words that stand least times; words 0: all words of a language."""
    spark = docs.sparkSession
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).filter("text <> ''")
    read = read.coalesce(max(1, -(-read.rdd.getNumPartitions() // SPLITS_PER_TASK)))
    with few_at_once(spark):
        words = spark.sparkContext.broadcast(_bitmap(frequent_keys(read, least, None, shard_words)))
        pairs = spark.sparkContext.broadcast(_bitmap(frequent_keys(read, least, words, shard_words)))
        merged = shard_counts(read, words, pairs, shard_words).groupBy("phrase").agg(F.sum("n").alias("n"))
        # no phrase has a tab
        phrase = F.substring_index("phrase", "\t", -1)
        lang = F.expr("substring(phrase, 1, length(phrase) - length(substring_index(phrase, '\t', -1)) - 1)")
        split = merged.select(lang.alias("lang"), F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " "))).alias("words"), phrase.alias("phrase"), "n")
        found = stable(split.filter((F.col("words") == 0) | (F.col("n") >= least)))
    words.unpersist()
    pairs.unpersist()
    return found


# ---- scores -----------------------------------------------------------------------------------------


def _named(phrase: Column) -> Column:
    """Language and phrase in one; a phrase has no tab."""
    return F.concat(F.col("lang"), F.lit("\t"), phrase)


def _part(first: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, count), " ")


def scored(counts: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, score of each phrase of two words or more: its lowest cut, the first of equal ones."""
    parts = stable(counts.filter("words > 0").select(_named(F.col("phrase")).alias("key"), F.col("n").alias("f")))

    def looked_up(d: DataFrame, key: str, out: str) -> DataFrame:
        hot = frequent(d.groupBy(key).agg(F.count("*").alias("n")), key)
        return by_key(d, parts.select(F.col("key").alias(key), F.col("f").alias(out)), key, hot).drop(key)

    k, n = F.col("k"), F.col("words")
    cuts = counts.filter("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    cuts = cuts.withColumns({"first": _named(_part(F.lit(1), k)), "rest": _named(_part(k + 1, n - k))})
    cuts = looked_up(looked_up(cuts, "first", "l"), "rest", "r")
    score = F.expr("CAST(2000000 AS decimal(8,0)) * CAST(a AS decimal(20,0)) div (CAST(l AS decimal(20,0)) + CAST(r AS decimal(20,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "words", "phrase", "a", "b.l", "b.r", F.col("b.score").alias("score"))


def uncovered(candidates: DataFrame, percent: int = COVER_PERCENT) -> DataFrame:
    """Candidates that no longer candidate holds with percent of their count or more."""
    (hold,) = private(candidates, "held_a")
    starts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, m), " "))))
    inner = candidates.filter("words > 2").select("lang", F.explode(F.array_distinct(starts)).alias("phrase"), F.col("a").alias(hold))
    held = inner.groupBy("lang", "phrase").agg(F.max(hold).alias(hold))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    open_ = F.col(hold).isNull() | (wide(hold) * 100 < wide("a") * percent)
    return candidates.join(held, ["lang", "phrase"], "left").filter(open_).drop(hold)


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    counts = frequent_phrases(docs, least, shard_words)
    left = uncovered(scored(counts))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # Spark cuts each task's rows to the first ``top`` of a language before the shuffle
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, {n} AS words, array_to_string(w[i:i + {n - 1}], ' ') AS phrase FROM p, LATERAL (SELECT unnest(range(1, len(w) - {n - 2})) AS i)" for n in range(1, LONGEST + 1))
ORACLE_OP12 = rf"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS n FROM ({_GRAMS}) GROUP BY ALL
), total AS (SELECT lang, sum(n) AS n FROM f WHERE words = 1 GROUP BY lang
), often AS MATERIALIZED (SELECT * FROM f WHERE n >= {LEAST}
), c AS (SELECT *, string_split(phrase, ' ') AS w FROM often WHERE words > 1
), cut AS (SELECT lang, words, phrase, n, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest FROM c, range(1, {LONGEST}) t(k) WHERE k < words
), best AS (
  SELECT c.lang, c.words, c.phrase, c.n AS a, min({{'score': 2000000::HUGEINT * c.n // (x.n::HUGEINT + y.n), 'k': k, 'l': x.n, 'r': y.n}}) AS b
  FROM cut c JOIN often x ON x.lang = c.lang AND x.phrase = head JOIN often y ON y.lang = c.lang AND y.phrase = rest GROUP BY ALL
), held AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(n) AS n FROM c, range(2, {LONGEST}) s(m), range(1, {LONGEST}) t(i) WHERE m < words AND i + m - 1 <= words GROUP BY ALL
), ranked AS (
  SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY b.score DESC, a DESC, best.phrase) AS rank
  FROM best LEFT JOIN held USING (lang, phrase) WHERE held.n IS NULL OR 100 * held.n::HUGEINT < {COVER_PERCENT} * a
)
SELECT lang, rank, phrase, a, b.l AS l, b.r AS r, total.n::BIGINT AS n, b.score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
