"""Token-ID output as wavelet matrices, one compressed file per shard.

Documents are dealt to shards by ranges of doc_id and encoded in that order. A shard is one Parquet file whose rows are
segments of whole documents: a segment's ids form a wavelet matrix, that is one bit plane for each bit of the ids from
the highest down, each plane stably sorted by the bits above it. With counts of ones before every 512 bits (rank), a file
answers token access, counts and occurrence lookup without unpacking it, and decodes to the ids.

Spark's own writer commits the files, so a lost executor's half-written shard is never seen, and any storage that Spark
reads will do. Global starts come from one small sum a shard.

Defined cases: null texts count as empty, so only the end id is stored; repeated doc_ids keep one entry a row, in the order
of their text; a null doc_id sorts first; an empty table writes no segment; extra columns are not stored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plasmaflow.llm.common import LOWER, SEPARATOR, Scratch, partitions, row_slices, utf8

RANK_EVERY = 512
SEGMENT_TOKENS = 1 << 19
#: Bytes of text whose chunks are looked up together.
SLICE_TEXT = 4 << 20
#: Estimated bytes of a worker's cache of chunks; a full one starts anew.
CACHE_BYTES = 192 << 20
#: Fields of a stored segment.
SEGMENT = "shard int, segment int, before long, n_tokens long, bits int, planes binary, ranks binary, zeros array<long>, doc_ids array<long>, doc_tokens array<long>"


@dataclass
class WaveletMatrix:
    """n ids over `bits` planes; planes[l] are packed bits, ranks[l][b] the ones before bit 512 * b, zeros[l] the plane's zeros."""

    n: int
    bits: int
    planes: np.ndarray
    ranks: np.ndarray
    zeros: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        n = len(ids)
        bits = max(1, int(ids.max(initial=0)).bit_length())
        rest = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        width = -(-n // RANK_EVERY) * (RANK_EVERY // 8)
        planes, ranks, zeros = np.zeros((bits, width), np.uint8), np.zeros((bits, width * 8 // RANK_EVERY + 1), np.uint32), []
        for level in range(bits):
            ones = (rest >> rest.dtype.type(bits - 1 - level) & rest.dtype.type(1)).astype(bool)
            packed = np.packbits(ones)
            planes[level, : len(packed)] = packed
            ranks[level, 1:] = np.cumsum(np.bitwise_count(planes[level]).reshape(-1, RANK_EVERY // 8).sum(axis=1, dtype=np.uint32))
            rest = np.concatenate([rest[~ones], rest[ones]])
            zeros.append(n - int(ranks[level, -1]))
        return cls(n, bits, planes, ranks, np.array(zeros, np.int64))

    @classmethod
    def read(cls, n: int, bits: int, planes: bytes, ranks: bytes, zeros: list[int]) -> "WaveletMatrix":
        return cls(n, bits, np.frombuffer(planes, np.uint8).reshape(bits, -1), np.frombuffer(ranks, np.uint32).reshape(bits, -1), np.array(zeros, np.int64))

    def ids(self) -> np.ndarray:
        """All ids in order: the planes' sorts undone from the lowest bit up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).view(bool)
            above = np.empty(self.n, kind)
            above[~ones] = out[: self.zeros[level]]
            above[ones] = out[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            out = above
        return out.astype(np.uint32)

    def _rank(self, level: int, at: int) -> int:
        """Ones among the first `at` bits of a plane."""
        block, rest = divmod(at, RANK_EVERY)
        part = self.planes[level, block * RANK_EVERY // 8 : at // 8]
        whole = int(self.ranks[level, block]) + int(np.bitwise_count(part).sum())
        return whole + (int(self.planes[level, at // 8] >> (8 - rest % 8)).bit_count() if rest % 8 else 0)

    def access(self, at: int) -> int:
        value = 0
        for level in range(self.bits):
            one = int(self.planes[level, at // 8]) >> (7 - at % 8) & 1
            before = self._rank(level, at)
            at = int(self.zeros[level]) + before if one else at - before
            value = value << 1 | one
        return value

    def _span(self, value: int, begin: int, end: int) -> tuple[int, int]:
        """Where the occurrences of value in [begin, end) lie below the last plane."""
        if value >> self.bits:
            return 0, 0
        for level in range(self.bits):
            low, high = self._rank(level, begin), self._rank(level, end)
            if value >> (self.bits - 1 - level) & 1:
                begin, end = int(self.zeros[level]) + low, int(self.zeros[level]) + high
            else:
                begin, end = begin - low, end - high
        return begin, end

    def count(self, value: int, begin: int = 0, end: int | None = None) -> int:
        """Occurrences of value in [begin, end)."""
        low, high = self._span(value, begin, self.n if end is None else end)
        return high - low

    def _select(self, level: int, one: int, k: int) -> int:
        """Place of the k-th (from 0) bit equal to `one` in a plane."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if one else np.arange(len(ranks)) * RANK_EVERY - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level, block * RANK_EVERY // 8 : (block + 1) * RANK_EVERY // 8])
        return block * RANK_EVERY + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def locate(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of value, -1 if there are fewer."""
        low, high = self._span(value, 0, self.n)
        if k >= high - low:
            return -1
        at = low + k
        for level in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - level) & 1
            at = self._select(level, one, at - int(self.zeros[level]) * one)
        return at


class WordIds(dict):
    """Ids of space-delimited chunks as packed 16-bit (or 32-bit) numbers; misses are encoded together by the library.

    The tokenizer drops white space and lower-cases, so a text may be cut at white space and its A-Z lower-cased before;
    only chunks with special strings, which it finds in the raw text, and chunks with combining marks, which it composes
    before it lower-cases, keep their case here. A slice of texts looks up each of its distinct chunks once."""

    MARK = "\x01"  # parts the chunks that are encoded together; a token of its own
    SIMPLE = re.compile("[a-zß-öø-ÿ]+")
    ENDS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"  # ASCII marks but ' and <

    def __init__(self, path: str):
        super().__init__()
        self.held = 0
        self.tool = Tokenizer.from_file(path)
        self.tool.no_padding()
        self.tool.no_truncation()
        self.kind = np.uint16 if self.tool.get_vocab_size() <= 1 << 16 else np.uint32
        self.letters, self.closes = self._letters_only()
        mark = self._direct(self.MARK)
        self.mark = int(mark[0]) if len(mark) == 1 else None

    def _letters_only(self) -> tuple[Tokenizer | None, np.ndarray]:
        """The same model for `SIMPLE` chunks, which normalise to themselves and are one pre-token, and which ids close a pre-token.

        None where the tokenizer marks no word ends or gives other ids for the probes."""
        parts = json.loads(self.tool.to_str())
        suffix, before = parts["model"].get("end_of_word_suffix"), (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        closes = np.zeros(self.tool.get_vocab_size(), bool)
        if not suffix or not before or before[-1]["type"] != "ByteLevel":
            return None, closes
        closes[[i for t, i in self.tool.get_vocab().items() if t.endswith(suffix)]] = True
        parts["normalizer"], parts["added_tokens"] = None, []
        parts["pre_tokenizer"]["pretokenizers"] = [{"type": "WhitespaceSplit"}, before[-1]]
        letters = Tokenizer.from_str(json.dumps(parts))
        probes = ["the quick brown", "x", "straße über", "naïve façade ÿ", "zzzzqqqq thingsøåæ"]
        same = all(letters.encode(p, add_special_tokens=False).ids == self.tool.encode(p, add_special_tokens=False).ids for p in probes)
        return (letters if same else None), closes

    def _direct(self, text: str) -> np.ndarray:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, self.kind)

    def learn(self, missing: list[str]) -> None:
        """Encode these distinct unknown chunks; a full cache starts anew."""
        size = sum(180 + 2 * len(c) for c in missing)
        if self.held + size > CACHE_BYTES:
            self.clear()
            self.held = 0
        self.held += size
        # marks after a letter, up to the chunk's end, are a pre-token of their own
        ended = [(c, bare) for c in missing if (bare := c.rstrip(self.ENDS)) != c and _ends_in_letter(bare) and "<|" not in c]
        whole = {c for c, _ in ended}
        parts = {p for c, bare in ended for p in (bare, c[len(bare) :])}
        wanted = [c for c in {*missing, *parts} if c not in whole and c not in self]
        plain, simple = [], []
        for chunk in wanted:
            if self.letters is not None and self.SIMPLE.fullmatch(chunk):
                simple.append(chunk)
            elif self.mark is None or self.MARK in chunk or "<|" in chunk:
                self[chunk] = self._direct(chunk).tobytes()
            else:
                plain.append(chunk)
        self._together(simple, self.letters, " ", lambda ids: np.flatnonzero(self.closes[ids]) + 1, 0)
        self._together(plain, self.tool, f" {self.MARK} ", lambda ids: np.append(np.flatnonzero(ids == self.mark), len(ids)), 1)
        for chunk, bare in ended:
            self[chunk] = self[bare] + self[chunk[len(bare) :]]

    def _together(self, chunks: list[str], tool: Tokenizer, between: str, ends_of, gap: int) -> None:
        """Encode many chunks in one text and part the ids where ends_of says, `gap` ids between them."""
        groups = [chunks[i : i + 512] for i in range(0, len(chunks), 512)]
        for group, found in zip(groups, tool.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False) if groups else [], strict=True):
            ids = np.array(found.ids, self.kind)
            packed, size = ids.tobytes(), ids.itemsize
            begin = 0
            for chunk, end in zip(group, (ends_of(ids) * size).tolist(), strict=True):
                self[chunk] = packed[begin:end]
                begin = end + gap * size

    def encode(self, texts: pa.Array, tail: int):
        """Slices of the rows' ids, each row's followed by `tail`, and the rows' numbers of ids."""
        data, at = utf8(texts)
        for i, j in row_slices(at, SLICE_TEXT):
            chunks, per_row = white_space_chunks(data[at[i] : at[j]], at[i : j + 1] - at[i])
            coded = chunks.dictionary_encode()
            words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            packed = list(map(self.get, words))
            new = [k for k, p in enumerate(packed) if p is None]
            self.learn([words[k] for k in new])
            for k in new:
                packed[k] = self[words[k]]
            flat = np.frombuffer(b"".join(packed) + np.array([tail], self.kind).tobytes(), self.kind)
            sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // flat.itemsize
            first = np.cumsum(sizes) - sizes
            # the tail is one more word, at the end of each row
            word = np.insert(coded.indices.to_numpy(), np.cumsum(per_row), len(words))
            sizes, first = np.append(sizes, 1), np.append(first, len(flat) - 1)
            own = sizes[word]
            ends = np.cumsum(own)
            row_ends = ends[np.cumsum(per_row + 1) - 1]
            yield flat[np.repeat(first[word] - (ends - own), own) + np.arange(ends[-1])], np.diff(row_ends, prepend=0)


def _ends_in_letter(text: str) -> bool:
    """Whether the text's last character, composed and lower-cased as the tokenizer does, ends in a letter."""
    return unicodedata.normalize("NFC", text[-1:]).lower()[-1:].isalpha()


def white_space_chunks(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The chunks between ASCII white space of rows data[at[i]:at[i+1]], A-Z lower-cased where `WordIds` allows, and chunks per row."""
    inside = ~SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    raw = data[inside]
    first = np.cumsum(inside)[starts] - 1 if len(starts) else np.zeros(0, np.int64)
    offsets = np.append(first, len(raw))
    low = LOWER[raw]
    cased = (raw == 0xCC) | (raw == 0xCD)  # U+0300 to U+037F
    cased[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
    for k in np.unique(np.searchsorted(first, np.flatnonzero(cased), "right") - 1).tolist():
        low[offsets[k] : offsets[k + 1]] = raw[offsets[k] : offsets[k + 1]]
    chunks = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(low))
    return chunks, np.diff(np.searchsorted(starts, at))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return WordIds(path)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None) -> None:
    """Encode docs(doc_id, text), append end_id to each, and write one wavelet-matrix file a shard to `path` in doc_id order."""

    def run(batches):
        from pyspark import TaskContext

        tool, shard, segment, before = word_ids(tokenizer), TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        lengths: list[int] = []

        def full():
            tree = WaveletMatrix.build(np.concatenate(held))
            values = [[shard], [segment], [before], [tree.n], [tree.bits], [tree.planes.tobytes()], [tree.ranks.tobytes()], [tree.zeros.tolist()], [ids], [lengths]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["shard", "segment", "before", "n_tokens", "bits", "planes", "ranks", "zeros", "doc_ids", "doc_tokens"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            done = 0
            for own, sizes in tool.encode(batch.column(1), end_id):
                held.append(own)
                lengths += sizes.tolist()
                ids += doc_ids[done : done + len(sizes)]
                done += len(sizes)
                if sum(map(len, held)) >= SEGMENT_TOKENS:
                    yield full()
                    before += sum(lengths)
                    held, ids, lengths, segment = [], [], [], segment + 1
        if held:
            yield full()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = source.repartitionByRange(shards or partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SEGMENT).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, unless told otherwise, ids of every stored document."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]

    def run(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids = WaveletMatrix.read(*(row[c] for c in ("n_tokens", "bits", "planes", "ranks", "zeros"))).ids()
                lengths = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends, lengths, strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    segments = spark.read.schema(SEGMENT).parquet(path)
    totals = segments.groupBy("shard").agg(F.sum("n_tokens").alias("size"))  # one row a shard, as for the window and the broadcast
    first = totals.select("shard", (F.sum("size").over(W.orderBy("shard")) - F.col("size")).alias("first"))
    placed = segments.join(F.broadcast(first), "shard").withColumn("base", F.col("first") + F.col("before"))
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def token_shards(docs: DataFrame, tokenizer: str, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Write docs as wavelet-matrix shards into the shared folder and read them back, as `read` does."""
    spark = docs.sparkSession
    path = f"{Scratch(spark, 'wavelet').path}/shards"
    write(docs, path, tokenizer, end_id)
    return read(spark, path, with_ids)
