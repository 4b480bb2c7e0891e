"""Language-model scoring from a log-frequency Bloom filter.

Counts of n-grams (two tokens by default, and single tokens) over the training texts are
quantised on a logarithmic scale, q(c) = 1 + floor(log_b c), and the n-gram enters a Bloom
filter once for each level 1..q(c). A count is read back by probing levels until one is
absent; the estimate is the mean of the level's range. False positives only ever raise a
count, by one level with the filter's error rate, two with its square.

Every n-gram enters, whatever the size of the input: the filter has the bits that its entries
need, 2^k with at most ``bits * ln 2 / probes`` entries, counted over the whole table. It is cut by
hash into pieces, which tasks write and which are kept in the shared folder. A filter of at most
``most_bytes`` (128 MB) is broadcast. The probes of a larger one are routed instead: each task
holds a part of it at a time, of at most ``most_bytes`` and one of several for every core, batches of
texts send their distinct n-grams there and get levels back. Both ways probe the same bits and so give the same scores.

Texts are cut into words and words are hashed in numpy, a block of texts at a time.

Text: A-Z lower-cased, words split at ASCII white space, then one end token. Probability of a
token: P1 = (c + 1) / (N + V + 1) for single tokens and, for longer contexts, interpolated
P(w | u) = (c(u w) + m * P(w)) / (c(u) + m), with c(u w) at most c(u). Counts in P(w | u) are
the filter's; N and V are exact.

The exact base score uses every token's exact count. The most frequent tokens (at most
``head``, known by 64-bit hashes) are broadcast; all others are joined by token, so the result
does not depend on where the border lies.

Null text is empty and has the end token alone. With no training rows all counts are zero.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, ship

#: The end of a text, and the context of its first token. Spaces keep it apart from any word.
END = b" end"

MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


#: The upper 48 bits of a hash tell n-grams apart; two in a million share them at 5e8 n-grams.
KEPT = np.uint64(0xFFFFFFFFFFFF0000)


def tokens(text: bytes | str | None) -> list[bytes]:
    """Words of a text, given as UTF-8 or str, and the end."""
    raw = text or b""
    return [*(raw.encode("utf-8", "replace") if isinstance(raw, str) else raw).lower().split(), END]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(31))
    x = x * MIX1
    x = x ^ (x >> np.uint64(29))
    x = x * MIX2
    return x ^ (x >> np.uint64(32))


#: By byte: whether it is part of a word.
WORD = np.ones(256, dtype=bool)
WORD[[9, 10, 11, 12, 13, 32]] = False
#: By length: the bytes of a word that its first eight are.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Words of more bytes are hashed one by one.
LONG = 64


def hash_words(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words at places of a text that has eight more bytes at its end."""
    at_byte = np.ndarray(max(len(text) - 7, 0), "<u8", text, strides=(1,))
    sizes = ends - starts
    out = mix((at_byte[starts] & MASKS[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * MIX1)
    more = np.flatnonzero(sizes > 8)
    for done in range(8, LONG, 8):
        more = more[sizes[more] > done]
        if not len(more):
            break
        out[more] = mix(out[more] * MIX2 + (at_byte[starts[more] + done] & MASKS[np.minimum(sizes[more] - done, 8)]))
    for k in np.flatnonzero(sizes > LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(text[starts[k] : ends[k]], 7)
    return out


def cut_words(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts in lower case one after another and eight more bytes, where words begin and end, each text's number of words."""
    text = b"\n".join([*texts, b" " * 8]).lower()
    inside = WORD[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.append(0, edges)
    starts, ends = edges[::2], edges[1::2]
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return text, starts, ends, np.diff(np.searchsorted(starts, begins))


class Hasher:
    """Hashes of tokens."""

    def __call__(self, words: list[bytes]) -> np.ndarray:
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        return hash_words(b"".join(words) + bytes(8), np.append(0, ends[:-1]) if len(words) else ends, ends)


@dataclass
class Block:
    """Texts one after another: their token hashes, each text's number of tokens, and where words stand."""

    text: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    sizes: np.ndarray
    #: Which tokens are words; the others are ends.
    is_word: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Block:
        text, starts, ends, sizes = cut_words(texts)
        sizes = sizes + 1
        is_word = np.ones(len(starts) + len(texts), dtype=bool)
        is_word[np.cumsum(sizes) - 1] = False
        hashes = np.full(len(is_word), Hasher()([END])[0], dtype=np.uint64)
        hashes[is_word] = hash_words(text, starts, ends)
        return cls(text, starts, ends, hashes, sizes, is_word)

    def tokens_at(self, places: np.ndarray) -> list[bytes]:
        word = np.cumsum(self.is_word)[places] - 1
        return [self.text[a:b] if w else END for w, a, b in zip(self.is_word[places].tolist(), self.starts[word].tolist(), self.ends[word].tolist())] if len(self.starts) else [END] * len(places)


def lay(texts: list[np.ndarray], order: int, end: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of texts one after another, each after ``order - 1`` ends; where tokens are."""
    return lay_out(np.concatenate(texts), np.array([len(t) for t in texts]), order, end)


def lay_out(hashes: np.ndarray, sizes: np.ndarray, order: int, end: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The same of texts that stand one after another."""
    real = np.ones(len(hashes) + (order - 1) * len(sizes), dtype=bool)
    starts = np.cumsum(sizes + order - 1) - sizes - order + 1
    for i in range(order - 1):
        real[starts + i] = False
    flat = np.full(len(real), end, dtype=np.uint64)
    flat[real] = hashes
    return flat, real


def grams(flat: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the n-grams that end at each place; the first ``order - 1`` mean nothing."""
    out = np.zeros(len(flat), dtype=np.uint64)
    for i in range(order):
        shift = order - 1 - i
        own = flat if not shift else np.concatenate([np.zeros(min(shift, len(flat)), np.uint64), flat[:-shift]])
        out = mix(out * MIX2 + own + np.uint64(i + 1))
    return out & KEPT


def pack_hashes(h: np.ndarray) -> bytes:
    """Six bytes a hash, all first bytes first: those of sorted hashes compress."""
    return h.view(np.uint8).reshape(-1, 8)[:, 2:].T.tobytes()


def unpack_hashes(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), dtype=np.uint8)
    out[:, 2:] = np.frombuffer(packed, np.uint8).reshape(6, -1).T
    return out.view(np.uint64)[:, 0]


# ------------------------------------------------------------------------- counting

def column(batch: pa.RecordBatch, i: int) -> Iterator:
    """The values of a column, a few rows at a time."""
    for lo in range(0, batch.num_rows, 128):
        yield from batch.column(i).slice(lo, 128).to_pylist()


def together(texts: Iterator[bytes], most: int) -> Iterator[list[bytes]]:
    """Texts put together up to a number of bytes, or one of more."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of tokens, a block of texts at a time."""
    for texts in together((x for batch in batches for x in column(batch, 0)), 3 << 20):
        text, starts, ends, _ = cut_words(texts)
        raw = np.frombuffer(text, np.uint8)
        offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[WORD[raw]])]).dictionary_encode()
        n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.dictionary.cast(pa.binary()), pa.array([END], pa.binary())]), pa.array(np.append(n, len(texts)), pa.int64())], ["token", "n"])


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where equal values begin."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)


def _packed_grams(batches: Iterator[pa.RecordBatch], order: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Counted n-gram hashes, dealt to shards: rows (shard, hashes, counts as uint16), packed."""
    end = Hasher()([END])[0]
    for texts in together((x for batch in batches for x in column(batch, 0)), 3 << 20):
        block = Block.of(texts)
        flat, real = lay_out(block.hashes, block.sizes, order, end)
        values = np.sort(np.concatenate([grams(flat, n)[real] for n in range(1, order + 1)]))
        first = runs(values)
        values, counts = values[first], np.diff(np.append(first, len(values)))
        over = counts > 0xFFFF
        if over.any():  # a larger count takes several entries
            times = -(-counts // 0xFFFF)
            last = counts - (times - 1) * 0xFFFF
            values, counts = np.repeat(values, times), np.full(int(times.sum()), 0xFFFF)
            counts[np.cumsum(times) - 1] = last
        # hashes are sorted: a shard is a range of them
        cuts = np.searchsorted(values, np.array([(s << 64) // shards for s in range(1, shards)], dtype=np.uint64))
        v, c = np.split(values, cuts), np.split(counts.astype(np.uint16), cuts)
        some = [s for s in range(shards) if len(v[s])]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pack_hashes(v[s]) for s in some], pa.binary()), pa.array([c[s].tobytes() for s in some], pa.binary())], ["shard", "hashes", "counts"])


def _merge(parts: list[np.ndarray], before: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and total counts of entries that have a count in the bits that a hash leaves free."""
    entries = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    values, counts = entries & KEPT, entries & ~KEPT
    if before is not None:
        values, counts = np.concatenate([before[0], values]), np.concatenate([before[1], counts])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
    first = runs(values)
    return values[first], np.add.reduceat(counts, first, dtype=np.uint64) if len(first) else counts


def _sum_shards(batches: Iterator[pa.RecordBatch], base: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard; the levels of a shard's total counts in packed rows of at most 2^18 n-grams."""
    now, parts, size, before = None, [], 0, None

    def out() -> Iterator[pa.RecordBatch]:
        values, counts = _merge(parts, before)
        for lo in range(0, len(values), 1 << 18):
            v, c = values[lo : lo + (1 << 18)], counts[lo : lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pack_hashes(v)], pa.binary()), pa.array([level_of(c, base).astype(np.uint8).tobytes()], pa.binary())], ["shard", "hashes", "levels"])

    for batch in batches:
        for shard, hashes, counts in zip(*(column(batch, i) for i in range(3))):
            if shard != now:
                if parts or before is not None:
                    yield from out()
                now, parts, size, before = shard, [], 0, None
            parts.append(unpack_hashes(hashes) | np.frombuffer(counts, np.uint16).astype(np.uint64))
            size += parts[-1].nbytes
            if size > 16 << 20:
                parts, size, before = [], 0, _merge(parts, before)
    if parts or before is not None:
        yield from out()


# ------------------------------------------------------------------------- the filter

def level_of(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts.astype(np.float64)) / math.log(base) + 1e-9).astype(np.int64)


def value_of(level: np.ndarray, base: float) -> np.ndarray:
    """The mean of a level's range of counts; 0 for level 0."""
    low = np.ceil(np.power(base, level - 1) - 1e-9)
    high = np.maximum(low, np.ceil(np.power(base, level) - 1e-9) - 1)
    return np.where(level > 0, (low + high) / 2, 0.0)


def places(h: np.ndarray, level: int, probes: int, bits: int, pieces: int) -> Iterator[np.ndarray]:
    """The filter's bits of n-grams at a level, probe by probe; both sizes are powers of two.

    An n-gram's bits all lie in the piece of its hash's top bits. Where the receiver sends
    positions back, only the n-grams there go on.
    """
    size = np.uint64(bits // pieces)
    base = piece_of(h, pieces) * size
    a = mix(h + np.uint64(0x632BE59BD9B4E019 * level & 0xFFFFFFFFFFFFFFFF))
    step = (a >> np.uint64(32)) | np.uint64(1)
    for _ in range(probes):
        ok = yield base + (a & (size - np.uint64(1)))
        if ok is not None:
            base, a, step = base[ok], a[ok], step[ok]
        a = a + step


def piece_of(h: np.ndarray, pieces: int) -> np.ndarray:
    return h >> np.uint64(65 - pieces.bit_length()) if pieces > 1 else np.zeros(len(h), np.uint64)


@dataclass
class Filter:
    data: np.ndarray
    bits: int
    probes: int
    base: float
    max_level: int
    pieces: int
    #: The bit that ``data`` begins with, where it is a part of the filter.
    start: int = 0

    def has(self, h: np.ndarray, level: int) -> np.ndarray:
        """Positions of the n-grams that are there at a level."""
        live = np.arange(len(h))
        asked = places(h, level, self.probes, self.bits, self.pieces)
        p = next(asked)
        for left in reversed(range(self.probes)):
            p = (p - np.uint64(self.start)).view(np.int64)
            ok = np.flatnonzero((self.data[p >> 3] >> (p & 7).astype(np.uint8)) & 1)
            live = live[ok]
            if left:
                p = asked.send(ok if len(ok) < len(p) else None)
        return live

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Levels are probed until one is absent."""
        level = np.zeros(len(h), dtype=np.int64)
        live = np.arange(len(h))
        for j in range(1, self.max_level + 1):
            live = live[self.has(h[live], j)]  # positions
            if not len(live):
                break
            level[live] = j
        return level

    def count(self, h: np.ndarray) -> np.ndarray:
        """Estimated counts; each distinct n-gram is probed once."""
        distinct, again = np.unique(h, return_inverse=True)
        return value_of(self.levels(distinct), self.base)[again]


@dataclass
class Answers:
    """The filter's levels of a batch's n-grams, sorted by hash: what probes would give."""

    hashes: np.ndarray
    level: np.ndarray
    base: float

    def count(self, h: np.ndarray) -> np.ndarray:
        return value_of(self.level[np.searchsorted(self.hashes, h)], self.base)


def _pieces(batches: Iterator[pa.RecordBatch], probes: int, bits: int, pieces: int) -> Iterator[pa.RecordBatch]:
    """The filter's set bits from counted n-grams, sorted by piece in each file, as bitmaps of pieces (piece, bitmap).

    A bitmap has all that stands together of a piece, so there are not many more than pieces; those of one piece
    are or-ed by who reads them.
    """
    size = bits // pieces
    now, bitmap = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bitmap, bitorder="little").tobytes()], pa.binary())], ["piece", "bitmap"])

    for batch in batches:
        for piece, hashes, levels in zip(*(column(batch, i) for i in range(3))):
            if piece != now:
                if bitmap is not None:
                    yield out()
                now, bitmap = piece, np.zeros(size, dtype=np.uint8)
            h, level = unpack_hashes(hashes), np.frombuffer(levels, np.uint8).astype(np.int64)
            for j in range(1, int(level.max(initial=0)) + 1):
                h, level = (h[level >= j], level[level >= j]) if j > 1 else (h, level)
                for p in places(h, j, probes, bits, pieces):
                    bitmap[(p & np.uint64(size - 1)).astype(np.int64)] = 1
    if bitmap is not None:
        yield out()


def lay_bitmap(data: np.ndarray, at: int, bitmap: bytes) -> None:
    """Ors a piece's bitmap into the filter's bytes."""
    data[at : at + len(bitmap)] |= np.frombuffer(bitmap, np.uint8)


# ------------------------------------------------------------------------- the operator

@dataclass
class Model:
    counts: DataFrame
    n: int
    v: int
    head: tuple[np.ndarray, np.ndarray]
    #: The whole filter, where it may be broadcast; else without data.
    filter: Filter
    #: Rows (piece, bitmap): the filter.
    pieces: DataFrame
    most_bytes: int
    order: int
    strength: float


def train(texts: DataFrame, stage: Stage, text: str = "text", order: int = 2, most_bytes: int = 1 << 27, probes: int = 4, base: float = 1.5, strength: float = 2.0, head: int = 1 << 18) -> Model:
    """Counts all training texts and builds the filter."""
    spark = texts.sparkSession
    ship(spark)
    rows = texts.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    partial = rows.mapInArrow(_token_counts, "token binary, n long")
    counts = stage.put(partial.groupBy("token").agg(F.sum("n").alias("c")), "tokens")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    # the head: all tokens from a count on, the least one that leaves at most `head` of them
    scale = F.floor(F.log2("c") * 16).cast("int")
    least, size = math.inf, 0
    for r in sorted(counts.groupBy(scale.alias("at")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r["at"]):  # 16 rows a doubling
        size += r["n"]
        if size > head:
            break
        least = r["c"]
    top = counts.filter(F.col("c") >= least).collect() if least < math.inf else []
    keys = Hasher()([bytes(r["token"]) for r in top])
    logs = np.array([math.log10(r["c"] + 1) for r in top])
    by_key = np.argsort(keys)
    # small shards: a task holds one at a time, of some millions of n-grams and bits at most
    shards = 1 << (max(2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), int(total["n"] or 0) >> 21) - 1).bit_length()
    packed = rows.mapInArrow(lambda b: _packed_grams(b, order, shards), "shard int, hashes binary, counts binary")
    dealt = packed.repartition(shards, "shard").sortWithinPartitions("shard")
    counted = stage.put(dealt.mapInArrow(lambda b: _sum_shards(b, base), "shard int, hashes binary, levels binary"), "grams")
    # how many n-grams have each level: a few rows
    of_level = dict(counted.mapInArrow(lambda b: _levels(b), "level int, n long").groupBy("level").agg(F.sum("n")).collect())
    max_level = max(of_level, default=1)
    # an n-gram of level q makes q entries; eight bits are a byte of a piece's
    entries = sum(q * n for q, n in of_level.items())
    bits = max(8 * shards, 1 << math.ceil(math.log2(max(entries * probes / math.log(2), 1))))
    pieces = stage.put(counted.mapInArrow(lambda b: _pieces(b, probes, bits, shards), "piece int, bitmap binary"), "filter")
    stage.drop("grams")
    data = np.zeros(bits // 8 if bits // 8 <= most_bytes else 0, dtype=np.uint8)
    if len(data):
        for r in pieces.toLocalIterator():  # most_bytes in all
            lay_bitmap(data, r["piece"] * (bits // shards // 8), bytes(r["bitmap"]))
    head = (keys[by_key], logs[by_key])
    return Model(counts, int(total["n"] or 0), int(total["v"] or 0), head, Filter(data, bits, probes, base, max_level, shards), pieces, most_bytes, order, strength)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for levels in column(batch, 2):
            values, n = np.unique(np.frombuffer(levels, np.uint8), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int32()), pa.array(n, pa.int64())], ["level", "n"])


def log_probability(flat: np.ndarray, real: np.ndarray, single: np.ndarray, f: Filter | Answers, n: int, v: int, order: int, strength: float) -> np.ndarray:
    """log10 probability of each real token after those before it, from probes of the filter.

    ``single`` has the filter's counts of single tokens.
    """
    p = ((single + 1) / (n + v + 1))[real]
    before = np.append(0.0, single[:-1])
    for k in range(2, order + 1):
        counts = np.zeros(len(flat))
        counts[real] = f.count(grams(flat, k)[real])
        seen = np.minimum(counts, before)
        p = (seen[real] + strength * p) / (before[real] + strength)
        before = np.append(0.0, seen[:-1])
    return np.log10(p)


def text_scores(hashes: np.ndarray, sizes: np.ndarray, distinct: np.ndarray, again: np.ndarray, end: np.uint64, f: Filter | Answers, n: int, v: int, order: int, strength: float) -> np.ndarray:
    """The log10 probability of each text, given as hashes of its tokens one text after another; these are ``distinct[again]``."""
    flat, real = lay_out(hashes, sizes, order, end)
    starts = np.cumsum(sizes + order - 1) - sizes - order + 1
    counts, logs = f.count(grams(distinct, 1)), np.zeros(len(flat))
    single = np.full(len(flat), counts[np.searchsorted(distinct, end)])
    single[real] = counts[again]
    for lo in range(0, len(flat), 1 << 17):  # memory does not grow with the text
        back = min(lo, 2 * order)
        own = slice(lo - back, lo + (1 << 17))
        found = np.zeros(len(flat[own]))
        found[real[own]] = log_probability(flat[own], real[own], single[own], f, n, v, order, strength)
        logs[lo : lo + (1 << 17)] = found[back:]
    return np.add.reduceat(logs, starts)


def all_grams(hashes: np.ndarray, sizes: np.ndarray, distinct: np.ndarray, end: np.uint64, order: int) -> np.ndarray:
    """The distinct n-grams that scoring asks for, sorted."""
    flat, real = lay_out(hashes, sizes, order, end)
    found = np.sort(np.concatenate([grams(distinct, 1), *[grams(flat, k)[real] for k in range(2, order + 1)]]))
    return found[runs(found)]


#: Bytes of texts that are scored at once.
BATCH = 1 << 20
#: Parts of a filter that is not broadcast, for every core.
ROUTES = 8
#: n-grams that a route answers at once.
ASKED = 1 << 19
#: Columns of what a task makes of its texts; batches of token hashes only where probes are routed: the distinct ones as
#: token, and which of them each token is.
PARTS = "key {}, row long, token binary, tf long, size long, known long, base double, score double, batch string, rows array<long>, sizes array<long>, codes binary"


def pack_codes(codes: np.ndarray, distinct: int) -> bytes:
    return codes.astype(np.uint16 if distinct <= 1 << 16 else np.uint32).tobytes()


def unpack_tokens(hashes: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a batch's tokens, and which of them each token is."""
    distinct = np.frombuffer(hashes, np.uint64)
    return distinct, np.frombuffer(codes, np.uint16 if len(distinct) <= 1 << 16 else np.uint32)


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_tokens, n_known, base_score, score) for every document.

    A task makes one row per document and one per document and distinct token beyond the head;
    those meet their counts by a join on the token. Scores come from the broadcast filter, or
    from levels that batches of n-grams get from the tasks that hold the filter's parts.
    """
    spark = docs.sparkSession
    ship(spark)
    routed = not len(model.filter.data)
    sent = spark.sparkContext.broadcast((model.filter.data, model.head))
    f, n, v, order, strength = model.filter, model.n, model.v, model.order, model.strength
    shape = (f.bits, f.probes, f.base, f.max_level, f.pieces)
    floor = math.log10(n + v + 1)
    rows = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    kind = dict(rows.dtypes)["key"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, head = sent.value
        filt = Filter(data, *shape)
        end = Hasher()([END])[0]
        for batch in batches:
            lo = 0
            for texts in together(column(batch, 2), BATCH):
                yield pack(batch.slice(lo, len(texts)), Block.of(texts), end, filt, head)
                lo += len(texts)

    def pack(batch: pa.RecordBatch, block: Block, end: np.uint64, filt: Filter, head: tuple) -> pa.RecordBatch:
        """A row per text, with what filter and head tell, and rows of its tokens beyond the head."""
        sizes = block.sizes
        starts = np.cumsum(sizes) - sizes
        distinct, again = np.unique(block.hashes, return_inverse=True)
        keys, values = head
        at = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
        hit = keys[at] == distinct if len(keys) else np.zeros(len(distinct), dtype=bool)
        base = np.add.reduceat((np.where(hit, values[at], 0.0) if len(keys) else np.zeros(len(distinct)))[again], starts)
        known = np.add.reduceat(hit[again].astype(np.int64), starts)
        total = np.zeros(len(sizes)) if routed else text_scores(block.hashes, sizes, distinct, again, end, filt, n, v, order, strength)
        beyond = np.flatnonzero(~hit[again])
        counts = Counter(zip((np.searchsorted(starts, beyond, side="right") - 1).tolist(), block.tokens_at(beyond)))
        m, own = len(counts), np.array([d for d, _ in counts], dtype=np.int64)
        docs, ids = pa.array(np.append(np.arange(len(sizes)), own)), batch.column(1).to_pylist()
        zeros = np.zeros(m + routed, dtype=np.int64)
        none = [None] * (len(sizes) + m)  # and a row with the batch itself, where it is routed
        more = pa.nulls(routed)
        columns = (
            pa.concat_arrays([batch.column(0).take(docs), more.cast(batch.schema.field(0).type)]),
            pa.concat_arrays([batch.column(1).take(docs), more.cast(pa.int64())]),
            [b" %d" % row for row in ids] + [w for _, w in counts] + [distinct.tobytes()] * routed,
            np.concatenate([np.zeros(len(sizes), np.int64), np.fromiter(counts.values(), np.int64, m), zeros[:routed]]),
            np.concatenate([sizes, zeros]),
            np.concatenate([known, zeros]),
            np.concatenate([base - sizes * floor, zeros.astype(np.float64)]),
            np.concatenate([total, zeros.astype(np.float64)]),
            none + [uuid.uuid4().hex] * routed,
            none + [ids] * routed,
            none + [sizes.tolist()] * routed,
            none + [pack_codes(again, len(distinct)) if routed else b""] * routed,
        )
        kinds = (batch.schema.field(0).type, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(columns, kinds)], ["key", "row", "token", "tf", "size", "known", "base", "score", "batch", "rows", "sizes", "codes"])

    parts = rows.mapInArrow(score, PARTS.format(kind))
    none = F.lit(None)
    if routed:
        stage = Stage(spark, "bloomscore")
        parts = stage.put(parts, "parts")
        routes = _routed(parts.filter("batch is not null").select("batch", "rows", "sizes", F.col("token").alias("hashes"), "codes"), model, stage)
        found = routes.select(none.cast(kind).alias("key"), "row", F.concat(F.lit(" "), F.col("row").cast("string")).cast("binary").alias("token"), *[F.lit(0).cast(t).alias(c) for c, t in (("tf", "long"), ("size", "long"), ("known", "long"), ("base", "double"))], "score")
        parts = parts.filter("batch is null").select(found.columns).union(found)
    met = parts.join(model.counts, "token", "left")
    tf, c = F.col("tf"), F.coalesce("c", F.lit(0))
    return (
        met.groupBy("row")
        .agg(
            F.max("key").alias("key"),
            F.sum("size").alias("n_tokens"),
            F.sum(F.col("known") + F.when(c > 0, tf).otherwise(0)).alias("n_known"),
            F.sum(F.col("base") + tf * F.log10(c + 1)).alias("base_score"),
            F.sum("score").alias("score"),
        )
        .select(F.col("key").alias(key), "n_tokens", "n_known", "base_score", "score")
    )


def routes_of(total: int, pieces: int, most_bytes: int, cores: int) -> int:
    """Parts that a filter of so many bytes is dealt out in: none above ``most_bytes`` but a piece, and some for every core."""
    return min(pieces, 1 << (max(-(-total // max(most_bytes, 1)), ROUTES * cores) - 1).bit_length())


def _routed(texts: DataFrame, model: Model, stage: Stage) -> DataFrame:
    """Rows (row, score) from batches (batch, rows, sizes, hashes, codes) of texts.

    A route is a run of the filter's pieces. Its task reads them first, and then answers the batches' n-grams
    that lie there with their levels. There are several routes for every core, whatever the filter's size.
    """
    f, n, v, order, strength = model.filter, model.n, model.v, model.order, model.strength
    shape = (f.bits, f.probes, f.base, f.max_level, f.pieces)
    total = f.bits // 8
    routes = routes_of(total, f.pieces, model.most_bytes, texts.sparkSession.sparkContext.defaultParallelism)
    part = total // routes
    schema = "route int, batch string, piece int, data binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = Hasher()([END])[0]
        for batch in batches:
            for name, sizes, hashes, codes in zip(*(column(batch, i) for i in (0, 2, 3, 4))):
                distinct, again = unpack_tokens(hashes, codes)
                own = all_grams(distinct[again], np.array(sizes), distinct, end, order)
                at = piece_of(own, routes)
                first = runs(at)
                k = len(first)
                cuts = [pack_hashes(x) for x in np.split(own, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int32), pa.int32()), pa.array([name] * k, pa.string()), pa.nulls(k, pa.int32()), pa.array(cuts, pa.binary())], ["route", "batch", "piece", "data"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, filt, names, held, size = None, None, [], [], 0

        def out() -> pa.RecordBatch:
            found = filt.levels(np.concatenate(held)).astype(np.uint8)
            cut = [x.tobytes() for x in np.split(found, np.cumsum([len(h) for h in held])[:-1])]
            return pa.RecordBatch.from_arrays([pa.array([now] * len(names), pa.int32()), pa.array(names, pa.string()), pa.array(cut, pa.binary())], ["route", "batch", "data"])

        for batch in batches:
            for route, name, piece, data in zip(*(column(batch, i) for i in range(4))):
                if held and (route != now or size > ASKED):
                    yield out()
                    names, held, size = [], [], 0
                if route != now:
                    now, filt = route, Filter(np.zeros(part, np.uint8), *shape, start=route * part * 8)
                if name is None:
                    lay_bitmap(filt.data, piece * (total // f.pieces) - route * part, data)
                else:
                    names.append(name)
                    held.append(unpack_hashes(data))
                    size += len(held[-1])
        if held:
            yield out()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = Hasher()([END])[0]
        name, rows, texts, parts = None, None, None, []

        def out() -> pa.RecordBatch:
            sizes, (distinct, again) = np.array(texts[0]), unpack_tokens(*texts[1:])
            hashes = distinct[again]
            level = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
            answers = Answers(all_grams(hashes, sizes, distinct, end, order), level, f.base)
            own = text_scores(hashes, sizes, distinct, again, end, answers, n, v, order, strength)
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(own, pa.float64())], ["row", "score"])

        for batch in batches:
            for one, route, ids, sizes, data, codes in zip(*(column(batch, i) for i in range(6))):
                if one != name:
                    if name is not None:
                        yield out()
                    name, parts = one, []
                if route is None:
                    rows, texts = ids, (sizes, data, codes)
                else:
                    parts.append(data)
        if name is not None:
            yield out()

    asked = texts.mapInArrow(ask, schema)
    filters = model.pieces.select(F.shiftright("piece", f.pieces.bit_length() - routes.bit_length()).alias("route"), F.lit(None).cast("string").alias("batch"), "piece", F.col("bitmap").alias("data"))
    # nulls come first: a route's pieces before its batches, a batch's texts before its answers
    answers = stage.put(asked.union(filters).repartition(routes, "route").sortWithinPartitions("route", "batch").mapInArrow(answer, "route int, batch string, data binary"), "answers")
    both = texts.select("batch", F.lit(None).cast("int").alias("route"), "rows", "sizes", F.col("hashes").alias("data"), "codes").union(
        answers.select("batch", "route", F.lit(None).cast("array<long>"), F.lit(None).cast("array<long>"), "data", F.lit(None).cast("binary"))
    )
    return both.repartition("batch").sortWithinPartitions("batch", "route").mapInArrow(finish, "row long, score double")
