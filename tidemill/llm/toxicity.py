r"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams and of itself, all hashed into
one table; a run of words has the mean of its words' vectors, which a linear softmax classifies.
Table and softmax are trained together in numpy. Only a document is labelled, so a document stands
by its highest run: after rounds over whole documents, training goes on with the best run of each
document (multiple-instance learning), and a text's score is the score of its best run. An unseen
misspelling shares n-gram vectors with the words it comes from. The bias is set so that the threshold
cuts best on rows that were left out. A word of over LONG characters with
its marks (scripts without spaces, joined or encoded runs) is cut into pieces of PIECE characters,
each a word of a run; they overlap so that every n-gram of the word is in a piece.

Labels come only from rows whose crc32(doc_id as text) mod 3 is not 1, and of those at most
``per_class`` of each label by the order of a hash: the bounded sample that one task trains on. The
trained table reaches the executors as one number for each bucket (BUCKETS floats, a fixed size).

Defined cases: a null or empty text has no run and scores as the bias alone; with one label or none
in the sample every text scores the share of toxic labels or 0; a very long text is scored whole; a null doc_id is not held out and
not labelled; repeated rows score alike; of repeated labels the largest holds; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import fewer_rows, table, texts

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
#: Words in a run.
RUN = 8
PER_CLASS = 1500
#: Toxic rows that each part needs for the threshold to be set on rows that were not learned.
LEAST_CALIBRATION = 10
THRESHOLD = 0.7
CACHE_WORDS = 400_000
#: Entries of a sparse sum of the training that are gathered at once, and words that its scorer remembers.
CHUNK, TRAINING_WORDS = 1 << 16, 20_000
LONG, PIECE = 200, 12
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def marked(word: str) -> str:
    return f"<{_EDGES.sub('', word.lower()) or word}>"


def units(text: str) -> list[str]:
    """The words of a text, a long one as its pieces, each behind a space, which no word has."""
    words = text.split()
    if max(map(len, words), default=0) <= LONG // 2 - 1:  # lower() doubles a length at most
        return words
    out, step = [], PIECE - max(GRAMS) + 1
    for w in words:
        if len(core := marked(w)) <= LONG:
            out.append(w)
        else:
            out += [f" {core[i : i + PIECE]}" for i in range(0, len(core) - PIECE + step, step)]
    return out


def buckets(word: str) -> list[int]:
    """Buckets of a word's (or piece's) n-grams and of itself; a word without letters or digits keeps its signs."""
    core = word[1:] if word[0] == " " else marked(word)
    crc, m = zlib.crc32, len(core)
    if core.isascii():
        flat = core.encode()
        parts = [flat] + [flat[i : i + n] for n in GRAMS for i in range(m - n + 1)]
        return [crc(p) % BUCKETS for p in parts]
    parts = [core] + [core[i : i + n] for n in GRAMS for i in range(m - n + 1)]
    return [crc(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


class Bags:
    """Texts as runs of word numbers, and words as bags of buckets."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        #: the buckets of all words in turn, and where each word's end
        self.grams, self.ends = array("i"), array("q", [0])

    def words(self, text: str) -> np.ndarray:
        out = array("i")
        for w in units(text):
            if (k := self.number.get(w)) is None:
                k = self.number[w] = len(self.number)
                self.grams.extend(buckets(w))
                self.ends.append(len(self.grams))
            out.append(k)
        return np.array(out, np.int32)


def summed(index: np.ndarray, values: Callable[[slice], np.ndarray], size: int) -> np.ndarray:
    """``np.bincount(index, values, size)`` to the last bit, with CHUNK of the values at a time."""
    out = np.zeros(size)
    for at in range(0, len(index), CHUNK):
        part = slice(at, at + CHUNK)
        np.add.at(out, index[part].astype(np.intp), values(part))
    return out


def train(rows: list[tuple[str, int]], seed: int = 0, noisy_rounds: int = 25, best_rounds: int = 50, rate: float = 1.0, least_docs: int = 2) -> tuple[np.ndarray, float]:
    """One number for each bucket (its vector times the softmax's difference) and the bias.

    First every run has its document's label, then only the best run of each document and runs of
    clean ones are learned. Buckets of fewer than ``least_docs`` documents are left at zero.
    """
    rng, bags = np.random.default_rng(seed), Bags()
    docs = [(bags.words(t), y) for t, y in rows]
    docs = [(w, y) for w, y in docs if len(w)]
    y = np.array([y for _, y in docs])
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    gram, ends = np.array(bags.grams, np.int32), np.array(bags.ends)
    del bags
    size = np.diff(ends)
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    held = np.zeros(BUCKETS, np.int64)  # documents of each bucket
    for w, _ in docs:
        held[np.unique(np.concatenate([gram[ends[k] : ends[k + 1]] for k in np.unique(w)]))] += 1
    live = held[gram] >= least_docs
    gram, owner = gram[live], owner[live]
    word = np.concatenate([w for w, _ in docs])
    runs = np.array([-(-len(w) // RUN) for w, _ in docs])
    first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    run_of = np.concatenate([(k + np.arange(len(w)) // RUN).astype(np.int32) for k, (w, _) in zip(first, docs, strict=True)])
    length, doc_run = np.bincount(run_of).astype(float), np.repeat(np.arange(len(docs)), runs)
    del docs, live
    run_y = y[doc_run].astype(float)
    vectors, soft, bias = np.zeros((BUCKETS, DIM)), rng.normal(0, 0.3, (DIM, 2)), 0.0
    vectors[:] = rng.normal(0, 0.01, (BUCKETS, DIM))
    vectors[held < least_docs] = 0
    used = np.unique(gram)
    sq_v, sq_s, sq_b = np.full(len(used), 1e-8), 1e-8, 1e-8

    def scores() -> np.ndarray:
        v = vectors @ (soft[:, 1] - soft[:, 0])
        a = summed(owner, lambda part: v[gram[part]], len(size)) / size
        return summed(run_of, lambda part: a[word[part]], len(length)) / length + bias

    def step(z: np.ndarray, weight: np.ndarray) -> None:
        nonlocal bias, sq_v, sq_s, sq_b
        u = soft[:, 1] - soft[:, 0]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - run_y) * weight
        per_word = g / length
        back = summed(word, lambda part: per_word[run_of[part]], len(size)) / size
        d = summed(gram, lambda part: back[owner[part]], BUCKETS)[used]
        grad = d[:, None] * u[None, :]
        size_g = (grad**2).sum(1)
        sq_v = sq_v + size_g
        ds = vectors[used].T @ d
        # a step in proportion to the gradient's size against the largest, so that rare buckets move less
        vectors[used] -= rate * grad / np.sqrt(sq_v + sq_v.mean())[:, None]
        sq_s += float((ds**2).sum())
        soft[:, 1] -= 0.1 * rate * ds / np.sqrt(sq_s)
        soft[:, 0] += 0.1 * rate * ds / np.sqrt(sq_s)
        sq_b += float(g.sum() ** 2)
        bias -= rate * g.sum() / np.sqrt(sq_b)

    def balanced(w: np.ndarray) -> np.ndarray:
        return np.where(run_y == 1, w / max(w[run_y == 1].sum(), 1e-9), w / max(w[run_y == 0].sum(), 1e-9))

    even = balanced(np.ones(len(length)))
    for _ in range(noisy_rounds):
        step(scores(), even)
    for _ in range(best_rounds):
        z = scores()
        best = np.zeros(len(length))
        best[np.lexsort((-z, doc_run))[first]] = 1
        step(z, balanced(best) + 0.5 * even * (run_y == 0))
    return (vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias)


def calibrated(rows: list[tuple[str, int]], clean_weight: float = 1.0, threshold: float = THRESHOLD) -> tuple[np.ndarray, float]:
    """``train`` with a bias for which the threshold is the best cut on rows that were not learned.

    A model that has seen all rows is surer of them than of others. So a third of the rows, chosen by a
    hash of their text, is first left out, and the cut of the best F0.5 on it (a clean row lost weighs more than
    a toxic one kept) becomes the threshold of the model of all rows. clean_weight says how many clean rows one of the sample stands for.
    """
    numbers, bias = train(rows)
    out = [zlib.crc32(t.encode("utf-8", "surrogatepass")) % 3 == 0 for t, _ in rows]
    seen, unseen = ([r for r, o in zip(rows, out, strict=True) if o == left] for left in (False, True))
    if min((sum(y for _, y in part) for part in (seen, unseen)), default=0) < LEAST_CALIBRATION or all(y for _, y in unseen) or all(y for _, y in seen):
        return numbers, bias
    scorer = Scorer(*train(seen), TRAINING_WORDS)
    z = sorted(((scorer.logit(t), y) for t, y in unseen), reverse=True)
    y = np.array([b for _, b in z], float)
    hits, wrong = np.cumsum(y), np.cumsum(1 - y) * clean_weight
    best = int(np.argmax(hits / (hits + wrong + 0.25 * y.sum())))
    cut = (z[best][0] + z[min(best + 1, len(z) - 1)][0]) / 2
    return numbers, float(bias + np.log(threshold / (1 - threshold)) - cut)


class Scorer:
    def __init__(self, numbers: np.ndarray, bias: float, cache_words: int = CACHE_WORDS) -> None:
        self.numbers, self.bias, self.cache_words, self.known = numbers.tolist(), bias, cache_words, {}

    def __call__(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -50, 50))))

    def logit(self, text: str) -> float:
        words, known, numbers = units(text), self.known, self.numbers
        if not words:
            return self.bias
        try:
            v = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        except KeyError:
            if len(known) > self.cache_words:
                known.clear()
            for w in set(words):
                if w not in known:
                    got = buckets(w)
                    known[w] = sum(map(numbers.__getitem__, got)) / len(got)
            v = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        at = np.arange(0, len(v), RUN)
        mean = np.add.reduceat(v, at) / np.diff(np.append(at, len(v)))
        return float(mean.max()) + self.bias


def held_out(key):
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Train on at most per_class rows of each label, in one task; the sample's ids are a table of bounded size, and
    the driver gets the model, not the texts."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    named = named.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    mark = F.xxhash64("doc_id")
    picked = [named.filter(c).orderBy(mark, "doc_id").limit(per_class) for c in (F.col("toxic") > 0, F.col("toxic") <= 0)]
    sample = texts(docs).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").select("doc_id", "text", "toxic")
    counted = {bool(r.toxic): r["count"] for r in named.select((F.col("toxic") > 0).alias("toxic")).groupBy("toxic").count().collect()}
    weight = max(1.0, counted.get(False, 0) / per_class) / max(1.0, counted.get(True, 0) / per_class)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["doc_id"], r["text"]))
        if rows:
            numbers, bias = calibrated([(r["text"], int(r["toxic"] > 0)) for r in rows], weight)
            yield pa.RecordBatch.from_pydict({"numbers": [numbers.tobytes()], "bias": [bias]})

    made = sample.repartition(1).mapInArrow(learn, "numbers binary, bias double").first()
    return (np.frombuffer(made.numbers, np.float32), made.bias) if made else calibrated([], weight)


def scored(docs: DataFrame, model: tuple[np.ndarray, float], cache_words: int = CACHE_WORDS) -> Column:
    """The scores of docs' texts as a column; one pass, no shuffle. A worker remembers cache_words words."""
    fewer_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(*shared.value, cache_words)
        for batch in batches:  # one text at a time is a Python string
            yield pa.array([scorer(t.as_py()) for t in batch], pa.float64())

    return run(F.coalesce(F.col("text"), F.lit("")))


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted."""
    out = docs.select("doc_id", scored(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def flagged(docs: DataFrame, model: tuple[np.ndarray, float], name: str, threshold: float = THRESHOLD, cache_words: int = CACHE_WORDS) -> DataFrame:
    """docs with a column ``name`` that says whether the text is called toxic."""
    return docs.withColumn(name, scored(docs, model, cache_words) >= threshold)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


__all__ = ["Scorer", "fit", "flagged", "held_out", "op10_toxicity", "score", "train"]
