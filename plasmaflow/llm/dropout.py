"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A pre-token starts as characters (bytes where the vocabulary lacks a character). An agenda holds the candidate merges of
neighbours, best score first, leftmost first among equals. A candidate that comes up is skipped with probability `dropout`;
otherwise it merges and its new neighbours enter the agenda. With dropout 0 this is the library's own segmentation. A part is a
stretch of a pre-token that no merge can leave, as no piece of the vocabulary holds the characters on both sides.

Candidate number k of the occurrence at `place` of a document is skipped if bit k of a word of keyed bits is set, each bit being
set with probability `dropout`; the bits follow from (seed, doc_id, place) alone. Occurrences that skip nothing take the plain
segmentation, which the library gives and a worker keeps. All others of a slice of documents run their agendas side by side, one
candidate of each a step, on arrays of symbols, costs and links. Decoding joins the pieces' bytes and drops the dummy prefix; a
literal U+2581 is encoded as bytes, so that every text comes back exactly.

Defined cases: null and empty texts have no tokens and decode to the empty text; repeated doc_ids get the same result for
the same text; a null doc_id hashes like the number 0; extra columns pass through `encode` unchanged, but for `text` and `tokens`, which are its input and output.
"""

from __future__ import annotations

import heapq
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plasmaflow.llm import pretokens
from plasmaflow.llm.common import mix64

CACHE_BYTES = 160 << 20  # of a worker's segmentations, as estimated; a full cache starts anew
SLICE_CHARS = 1 << 20  # of the documents that are encoded together
SHORT = 64  # parts up to which a scan beats a heap, and candidates that one word of bits decides
WIDTHS = (4, 6, 8, 11, 16, 24, 40, SHORT)  # of the arrays in which pre-tokens of about one length run their agendas
NEVER = float("inf")
NONE = np.iinfo(np.int32).max  # the rank of a pair that does not merge
ALL = (1 << SHORT) - 1


class Vocabulary:
    """Merge scores by piece, byte ids, and each id's bytes."""

    def __init__(self, path: str):
        model = pretokens.processor(path)
        self.ids: dict[str, int] = {}
        self.bytes: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                self.ids[piece] = i
                self.bytes.append(piece.replace(pretokens.SPACE, " ").encode())
        self.scores = {piece: -model.get_score(i) for piece, i in self.ids.items()}
        #: By id: whether it is no byte and no control, and whether its piece begins with a space.
        self.whole, self.heads = np.zeros(len(self.bytes), bool), np.zeros(len(self.bytes), bool)
        self.whole[list(self.ids.values())] = True
        self.heads[[i for p, i in self.ids.items() if p[0] == pretokens.SPACE]] = True
        #: By code point: its id, or -1 for a character that only bytes can give.
        self.symbols = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbols[ord(piece)] = i
        self.symbols[ord(" ")], self.symbols[ord(pretokens.SPACE)] = self.ids[pretokens.SPACE], -1
        self._index_pairs()

    def _index_pairs(self) -> None:
        """An open-addressed table from pairs of ids to the id of the piece that they merge to, and the ranks of all ids' scores."""
        ids, self.border = self.ids, len(self.bytes)  # border: no symbol, beyond both ends of a pre-token
        pairs = [(ids[p[:k]], ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        costs = np.array([self.scores[p] for p in ids])
        self.ranks = np.full(self.border + 1, NONE, np.int32)  # the last one for -1: no pair
        self.ranks[list(ids.values())] = np.unique(costs, return_inverse=True)[1]
        self.slot_bits = max(int(4 * len(pairs)).bit_length(), 4)
        self.slot_keys = np.full(1 << self.slot_bits, -1, np.int64)
        self.slot_ids = np.full(1 << self.slot_bits, -1, np.int32)
        keys = left * (self.border + 1) + right
        slots, rest = self._slots(keys), np.arange(len(keys))
        while len(rest):  # of the keys that want a free slot one gets it, the others try the next slot
            free = rest[self.slot_keys[slots[rest]] == -1]
            self.slot_keys[slots[free]] = keys[free]
            rest = rest[self.slot_keys[slots[rest]] != keys[rest]]
            slots[rest] = (slots[rest] + 1) & (len(self.slot_keys) - 1)
        self.slot_ids[slots] = merged

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids that pairs of ids merge to, -1 for none."""
        keys = left.astype(np.int64) * (self.border + 1) + right
        slots = self._slots(keys)
        found = self.slot_keys[slots]
        out = np.where(found == keys, self.slot_ids[slots], np.int32(-1))
        rest = np.flatnonzero((found != keys) & (found != -1))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & (len(self.slot_keys) - 1)
            found = self.slot_keys[slots[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.slot_ids[slots[rest[hit]]]
            rest = rest[~hit & (found != -1)]
        return out

    def merge_side_by_side(self, symbols: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The agendas of many pre-tokens at once. symbols: a row each, filled up with `border`; skips: a word of bits each.
        Returns the rows with the ids left in order (-1 where one has merged into another) and the rows that SHORT candidates didn't end."""
        n, width = symbols.shape
        row = width + 1  # the last place of a row stands for what is beyond both its ends
        parts = np.full((n, row), self.border, np.int32)
        parts[:, :width] = symbols
        merged = np.full((n, row), -1, np.int32)
        merged[:, :width] = self.merges(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, width)
        ranks = self.ranks[merged]
        after = np.tile(np.arange(1, row + 1), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        before[:, 0] = width
        table, live = ranks, np.arange(n)
        parts, merged, ranks, after, before = (x.reshape(-1) for x in (parts, merged, ranks, after, before))
        for k in range(SHORT + 1):
            least = table[live].argmin(1)  # the leftmost among equals
            at = live * row + least
            some = ranks[at] != NONE
            live, at = live[some], at[some]
            if not len(live) or k == SHORT:
                break
            skipped = (skips[live] >> np.uint64(k) & np.uint64(1)).astype(bool)
            ranks[at[skipped]] = NONE
            at, base = at[~skipped], live[~skipped] * row
            new, gone = merged[at], base + after[at]
            end = after[gone]
            parts[at], parts[gone], ranks[gone] = new, -1, NONE
            after[at] = end
            before[base + end] = at - base
            left = base + before[at]
            merged[at], merged[left] = self.merges(new, parts[base + end]), self.merges(parts[left], new)
            ranks[at], ranks[left] = self.ranks[merged[at]], self.ranks[merged[left]]
        parts = parts.reshape(n, row)[:, :width]
        return np.where(parts == self.border, -1, parts), live

    def segment(self, piece: str, skips: int | bytes) -> tuple[bytes, int]:
        """The ids of one pre-token as packed 32-bit integers, and how many candidates came up; those whose bit is set in `skips`
        (a number, or its little-endian bytes, in which a bit is found without a shift of them all) are skipped."""
        if isinstance(skips, int):
            skips = skips and skips.to_bytes(max(3 * len(piece), skips.bit_length()) // 8 + 1, "little")
        parts = [pretokens.SPACE if c == " " else "\0" + c if c == pretokens.SPACE else c for c in piece]
        parts, came = self._merge_short(parts, skips) if len(parts) <= SHORT else self._merge_long(parts, skips)
        ids = self.ids
        try:
            return array("i", [ids[p] for p in parts]).tobytes(), came
        except KeyError:  # characters outside the vocabulary become bytes
            out = array("i")
            for p in parts:
                known = ids.get(p)
                if known is not None:
                    out.append(known)
                else:
                    out.extend(self.byte_ids[b] for b in p.replace("\0" + pretokens.SPACE, pretokens.SPACE).encode())
            return out.tobytes(), came

    def _merge_short(self, parts: list[str], skips: bytes | int) -> tuple[list[str], int]:
        """The agenda as a plain list of the neighbours' costs: for a few parts its least one is found fastest by a scan."""
        get, came = self.scores.get, 0
        costs = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while costs:
            least = min(costs)
            if least == NEVER:
                break
            i = costs.index(least)
            came += 1
            if skips and skips[came - 1 >> 3] >> (came - 1 & 7) & 1:
                costs[i] = NEVER
                continue
            merged = parts[i] + parts.pop(i + 1)
            parts[i] = merged
            del costs[i]
            if i:
                costs[i - 1] = get(parts[i - 1] + merged, NEVER)
            if i < len(costs):
                costs[i] = get(merged + parts[i + 1], NEVER)
        return parts, came

    def _merge_long(self, symbols: list[str], skips: bytes | int) -> tuple[list[str], int]:
        """The same with a heap."""
        n, scores, came = len(symbols), self.scores, 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(scores[s], i, i + 1, len(s)) for i in range(n - 1) if (s := symbols[i] + symbols[i + 1]) in scores]
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, j, size = pop(agenda)
            if not symbols[i] or not symbols[j] or after[i] != j or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of them has merged meanwhile
            end = after[j]
            came += 1
            if skips and skips[came - 1 >> 3] >> (came - 1 & 7) & 1:
                continue
            symbols[i], symbols[j], after[i] = symbols[i] + symbols[j], "", end
            if end < n:
                before[end] = i
                if (s := symbols[i] + symbols[end]) in scores:
                    push(agenda, (scores[s], i, end, len(s)))
            p = before[i]
            if p >= 0 and (s := symbols[p] + symbols[i]) in scores:
                push(agenda, (scores[s], p, i, len(s)))
        return [s for s in symbols if s], came


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Codec:
    def __init__(self, path: str, dropout: float, seed: int):
        self.path, self.words, self.seed = path, vocabulary(path), seed
        self.rate = round(dropout * (1 << 16))
        self._forget()

    def _forget(self) -> None:
        """Start the cache anew: by number of a pre-token its characters' ids, whether the vocabulary lacks one, its plain ids and how many candidates came up."""
        self.numbers: dict[str, int] = {}
        self.symbols, self.symbol_ends, self.odd = array("i"), array("q", [0]), array("b")
        self.ids, self.id_ends, self.came = array("i"), array("q", [0]), array("q")
        self.held = 0

    def _bits(self, keys: np.ndarray) -> np.ndarray:
        """64 independent bits for each key, each set with probability rate / 2 ** 16: the binary digits of the rate decide how keyed words join."""
        if self.rate >= 1 << 16:
            return np.full(len(keys), ALL, np.uint64)
        out = np.zeros(len(keys), np.uint64)
        for digit in range(16):
            if not self.rate & ((2 << digit) - 1):
                continue  # no set digit so far: still no bit
            word = mix64(keys + np.uint64(digit + 1))
            out = out | word if self.rate >> digit & 1 else out & word
        return out

    def _learn(self, missing: set[str]) -> None:
        """Plain segmentations of unknown pre-tokens: words by the library, many in one text that is parted where a piece begins with
        a space; those with bytes, marks or no single space before them, and long ones, by the agenda."""
        words = [p for p in missing if p[0] == " " and 1 < len(p) <= SHORT and p[1] != " " and pretokens.SPACE not in p]
        ids = np.array(pretokens.processor(self.path).encode("".join(words)[1:]), np.int32)
        begins = np.flatnonzero(self.words.heads[ids])
        plain = np.logical_and.reduceat(self.words.whole[ids], begins) if len(begins) else np.zeros(0, bool)
        if len(begins) != len(words):
            words, ids, begins, plain = [], ids[:0], begins[:0], plain[:0]  # a vocabulary that parts words in another way
        sizes = np.diff(np.append(begins, len(ids)))
        self.ids.frombytes(ids[np.repeat(plain, sizes)].tobytes())
        new = [p for p, known in zip(words, plain.tolist(), strict=True) if known]
        sizes = sizes[plain]
        came = np.fromiter(map(len, new), np.int64, len(new)) - sizes
        others = missing.difference(new)
        segments = [self.words.segment(piece, 0) for piece in others]
        self.ids.frombytes(b"".join(packed for packed, _ in segments))
        new.extend(others)
        sizes = np.append(sizes, [len(packed) // 4 for packed, _ in segments]).astype(np.int64)
        self.came.frombytes(np.append(came, [n for _, n in segments]).astype(np.int64).tobytes())
        self.id_ends.frombytes((self.id_ends[-1] + np.cumsum(sizes)).tobytes())
        symbols = self.words.symbols[np.frombuffer("".join(new).encode("utf-32-le"), np.uint32)]
        ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        self.odd.frombytes(np.logical_or.reduceat(symbols < 0, np.append(0, ends[:-1])).astype(np.int8).tobytes())
        self.symbol_ends.frombytes((self.symbol_ends[-1] + ends).tobytes())
        self.symbols.frombytes(symbols.tobytes())
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
        self.held += 200 * len(new) + 12 * len(symbols) + 4 * int(sizes.sum())

    def encode_all(self, texts: list[str | None], doc_ids: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        ids, counts, i = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j] or "") <= SLICE_CHARS):
                chars += len(texts[j] or "")
                j += 1
            some, n = self._encode_slice(texts[i:j], doc_ids[i:j])
            ids.append(some)
            counts.append(n)
            i = j
        return np.concatenate(ids), np.concatenate(counts)

    def encode(self, text: str | None, doc_id: int | None) -> bytes:
        return self.encode_all([text], [doc_id])[0].tobytes()

    def _encode_slice(self, texts: list[str | None], doc_ids: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        parted = [pretokens.split(t or "") for t in texts]
        per_text = np.fromiter(map(len, parted), np.int64, len(parted))
        pieces = [p for one in parted for p in one]
        if self.held > CACHE_BYTES:
            self._forget()
        numbers = list(map(self.numbers.get, pieces))
        if None in numbers:
            self._learn({p for p, n in zip(pieces, numbers, strict=True) if n is None})
            numbers = list(map(self.numbers.__getitem__, pieces))
        numbers = np.array(numbers, np.int64)
        ends = np.frombuffer(self.id_ends, np.int64)
        starts, sizes = ends[numbers], ends[numbers + 1] - ends[numbers]
        pools = [np.frombuffer(self.ids, np.int32)]
        if self.rate and len(pieces):
            first = np.array([xxhash.xxh64_intdigest(b"%d" % (d or 0), self.seed) for d in doc_ids], np.uint64)
            places = np.arange(len(pieces)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
            keys = mix64(places.astype(np.uint64) + np.repeat(first, per_text))
            filled = len(pools[0])
            for rows, ids, n in self._skipping(pieces, numbers, keys):
                starts[rows], sizes[rows] = filled + np.cumsum(n) - n, n
                pools.append(ids)
                filled += len(ids)
        before = np.append(0, np.cumsum(sizes))
        out = np.concatenate(pools)[np.arange(before[-1]) + np.repeat(starts - before[:-1], sizes)]
        return out, np.diff(before[np.append(0, np.cumsum(per_text))])

    def _skipping(self, pieces: list[str], numbers: np.ndarray, keys: np.ndarray):
        """For the occurrences that skip a candidate: their places in `pieces`, ids in a row and numbers of ids, in groups."""
        came = np.frombuffer(self.came, np.int64)[numbers]
        asked = np.where(came < SHORT, (np.uint64(1) << np.minimum(came, SHORT - 1).astype(np.uint64)) - np.uint64(1), np.uint64(ALL))
        bits = self._bits(keys)
        rows = np.flatnonzero((bits & asked != 0) | (came > SHORT))
        ends = np.frombuffer(self.symbol_ends, np.int64)
        starts, lengths = ends[numbers[rows]], ends[numbers[rows] + 1] - ends[numbers[rows]]
        alone = (came[rows] > SHORT) | (lengths > SHORT) | (np.frombuffer(self.odd, np.int8)[numbers[rows]] != 0)
        single, symbols, least = [rows[alone]], np.frombuffer(self.symbols, np.int32), 0
        for width in WIDTHS:
            group = np.flatnonzero(~alone & (lengths > least) & (lengths <= width))
            least = width
            if not len(group):
                continue
            inside = np.arange(width) < lengths[group, None]
            grid = np.full(inside.shape, self.words.border, np.int32)
            grid[inside] = symbols[(starts[group, None] + np.arange(width))[inside]]
            left, open_ = self.words.merge_side_by_side(grid, bits[rows[group]])
            single.append(rows[group[open_]])
            done = np.ones(len(group), bool)
            done[open_] = False
            left = left[done]
            yield rows[group[done]], left[left >= 0], (left >= 0).sum(1)
        single = np.concatenate(single)
        packed = [self._long(pieces[i], keys[i]) for i in single.tolist()]
        yield single, np.frombuffer(b"".join(packed), np.int32), np.array([len(x) // 4 for x in packed], np.int64)

    def _long(self, piece: str, key: np.uint64) -> bytes:
        """A pre-token by itself, with as many words of bits as its length may ask for: n - 1 candidates at first, two more a merge."""
        words = self._bits(key + np.arange(3 * len(piece) // SHORT + 1, dtype=np.uint64) * np.uint64(1 << 32))
        return self.words.segment(piece, words.astype("<u8").tobytes())[0]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.words.bytes.__getitem__, array("i", ids)))
        return raw[1:].decode()


@lru_cache(maxsize=2)
def codec(path: str, dropout: float, seed: int) -> Codec:
    return Codec(path, dropout, seed)


def encode(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 13) -> DataFrame:
    """docs without text, with tokens (array<int>) in its place."""
    pretokens.check(path)
    others = [c for c in docs.columns if c not in ("text", "doc_id", "tokens")]
    schema = ", ".join(["doc_id long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), "tokens array<int>"])

    def run(batches):
        tool = codec(path, dropout, seed)
        for batch in batches:
            ids, counts = tool.encode_all(batch.column(1).to_pylist(), batch.column(0).to_pylist())
            tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], tokens], ["doc_id", *others, "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`") for c in others)).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text from rows of tokens(doc_id, tokens)."""

    def run(batches):
        tool = codec(path, 0.0, 0)
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            texts = [tool.decode(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "tokens").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 13) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers) and whether decoding gives the text back."""
    import zlib

    pretokens.check(path)

    def run(batches):
        tool = codec(path, dropout, seed)
        for batch in batches:
            rows, texts = [], batch.column(1).to_pylist()
            ids, counts = tool.encode_all(texts, batch.column(0).to_pylist())
            for t, one in zip(texts, np.split(ids, np.cumsum(counts)[:-1]) if texts else [], strict=True):
                packed = one.tobytes()
                rows.append((len(one), zlib.crc32(packed), tool.decode(packed) == (t or "")))
            n, crc, same = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "lossless"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, lossless boolean")
