"""Packing by power-of-two decomposition.

Each document's token ids are cut into pieces whose lengths are powers of two (the binary
expansion of its length, largest first, with as many full ``max_len`` pieces as fit). A piece is a
training sequence of its own: it needs no padding, crosses no document, and pieces of equal length
form buckets from which a trainer draws batches of one shape. Sequence ids are given out bucket by
bucket: the highest bits are the bucket's, then come a cell of the bucket, chosen by a hash of the
piece, and the place in the cell. So they follow from the documents and not from how the input is
split, one bucket's ids are a range of their own, and no task numbers a bucket alone.

Defined cases: a null or empty text gives the end id alone (one piece of length 1); a repeated row
is packed again under further sequence ids; an empty table gives no rows; other columns of the
input are ignored, whatever their names. A null doc_id is kept as it is. A very long text is tokenized
whole by one task, which holds its ids.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import CACHED_CHARS, fewer_rows, table, texts

MAX_LEN = 2048
END_ID = 1
#: Words whose ids a worker remembers; the cache is emptied beyond it, which only costs time.
CACHE_WORDS = 700_000
#: Bits of a sequence id for the cell in a bucket and for the place in a cell.
CELL_BITS, PLACE_BITS = 20, 36
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int"


#: Signs that may end a word and always form a token group of their own behind letters.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The tokenizer's printable stand-ins of bytes: those that print stand for themselves, the rest follow from 256 on.
_PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {x: x for x in _PRINT} | {x: 256 + k for k, x in enumerate(x for x in range(256) if x not in set(_PRINT))}


#: The steps before the model, a fixed value, for which the ids of a text are those of its words in a row.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordIds:
    """Ids of white-space separated words as little-endian unsigned 32-bit bytes, remembered by word.

    The tokenizer drops white space and no token spans it, so a text's ids are its words' ids in a
    row. Only blank and newline are split at; a word with other white space goes to the tokenizer
    as it stands, which gives the same ids. A word of Latin letters, with signs behind or not, goes
    to the tokenizer's model at once: its steps before the model lower it and map its bytes. A
    tokenizer with other steps than STEPS, or with tokens of its own that hold white space, gets the text as a whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        self.cache_words = cache_words
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.by_words = all(said.get(k) == v for k, v in STEPS.items()) and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in said["added_tokens"])
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}

    def _whole(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _letters(self, core: str) -> bytes:
        if (got := self.letters.get(core)) is None:
            if len(self.letters) > self.cache_words:
                self.letters.clear()
            ids = [x.id for x in self.model.tokenize(core.encode().decode("latin-1").translate(_BYTES))]
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(core) <= CACHED_CHARS:
                self.letters[core] = got
        return got

    def _word(self, word: str) -> bytes:
        core = word.rstrip(_SIGNS)
        if not core.isalpha() or max(core) >= "\u0130":
            return self._whole(word)
        if len(core) == len(word):
            return self._letters(core.lower())
        signs = word[len(core) :]
        if (tail := self.letters.get(signs)) is None:
            tail = self._whole(signs)
            if len(signs) <= CACHED_CHARS:
                self.letters[signs] = tail
        return self._letters(core.lower()) + tail

    def __call__(self, text: str) -> bytes:
        if not self.by_words:
            return self._whole(text)
        words = text.replace("\n", " ").split(" ")
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > self.cache_words:
                known.clear()
            long = {}
            for w in words:
                if w not in known:
                    (known if len(w) <= CACHED_CHARS else long)[w] = self._word(w)
            return b"".join([known[w] if w in known else long[w] for w in words])


_workers: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, cache_words: int = CACHE_WORDS) -> WordIds:
    """One for each tokenizer and worker process, kept from task to task."""
    if (path, cache_words) not in _workers:
        _workers[path, cache_words] = WordIds(path, cache_words)
    return _workers[path, cache_words]


def cuts(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of the power-of-two pieces of n tokens."""
    out, at = [], 0
    while n - at >= max_len:
        out.append((at, max_len))
        at += max_len
    rest = n - at
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID, with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Rows of pieces; ``bucket`` is log2 of the length, ``with_ids`` adds the ids themselves.

    One pass over the scan, then one shuffle of the pieces, which are a few numbers each (and their
    ids only if ``with_ids``). A worker remembers cache_words words, about 300 bytes each; fewer cost time only.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    fewer_rows(docs.sparkSession)
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, tail = word_ids(tokenizer, cache_words), end_id.to_bytes(4, "little")
        for batch in batches:
            doc, start, length, crc, total, bucket, ids = [], [], [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                flat = memoryview(ids_of(text.as_py()) + tail)
                n = len(flat) // 4
                for at, size in cuts(n, max_len):
                    piece = flat[4 * at : 4 * (at + size)]
                    doc.append(key)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    bucket.append(size.bit_length() - 1)
                    if with_ids:
                        ids.append(bytes(piece))
            cols = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)] + [pa.array(bucket, pa.int32())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"]
            if with_ids:
                cols.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return numbered(texts(docs).mapInArrow(run, schema))


def numbered(pieces: DataFrame) -> DataFrame:
    """Pieces with their sequence ids, bucket by bucket."""
    cell = F.shiftrightunsigned(F.xxhash64("doc_id", "start", "ids_crc32"), 64 - CELL_BITS)
    place = F.row_number().over(Window.partitionBy("bucket", "cell").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    number = F.shiftleft(F.col("bucket").cast("long"), CELL_BITS + PLACE_BITS) + F.shiftleft("cell", PLACE_BITS) + place
    return pieces.withColumn("cell", cell).withColumn("sequence_id", number).drop("cell").withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Lay the pieces out by length, one folder for each bucket."""
    pieces.write.partitionBy("bucket").parquet(path)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
