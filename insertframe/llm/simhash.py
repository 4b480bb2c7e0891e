"""SimHash near-duplicates with bit-sliced comparison.

A text's words (A-Z lower-cased, split at ASCII white space) form 3-word shingles, repeats
included (the whole sequence if there are fewer words). Bit i of the 64-bit fingerprint is
set if it is set in over half of the shingles' XXH64 hashes (seed 42). A text without words
has fingerprint zero. Texts link if their fingerprints differ in at most ``radius`` (2) bits;
a document's component is the smallest key reachable over links.

Documents collapse to distinct fingerprints first, so a group of copies is one row however
large it is. Fingerprints within two bits agree in at least two of four 16-bit quarters:
each goes to the six buckets of its pairs of quarters. A bucket over ``hot`` rows splits again
by pairs of quarters of its remaining 32 bits, after which 48 bits are equal and at most
65,536 distinct fingerprints can share a bucket: no bucket grows without bound, and no link is
lost. Buckets are compared in blocks of 64 fingerprints stored as 64 bit planes: a query's
distances to a whole block add up in carry-save counters (ones, twos, more), and blocks whose
lanes all exceed the radius are abandoned. Each batch of buckets emits a spanning forest of
its links, not the links.

Null text is empty. Null keys make no row. Repeated keys make a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, ship
from .graph import components

SEED = 42
LANES = 64
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ------------------------------------------------------------------------ fingerprints

def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = len(words)
    if n < width:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=n - width + 1)
    total = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[lo : lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


# ------------------------------------------------------------------------ bit slices

def planes(fps: np.ndarray) -> np.ndarray:
    """Blocks of 64 fingerprints as bit planes (blocks, 64): bit j of plane i is bit i of lane j."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, LANES, 8), axis=2, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def near(queries: np.ndarray, blocks: np.ndarray, radius: int) -> np.ndarray:
    """For each query and its block's planes, the lanes within the radius, as bits.

    ``counters[k]`` has the lanes that differ in more than k bits so far; a new difference
    carries from one to the next.
    """
    out = np.zeros(len(queries), dtype=np.uint64)
    live = np.arange(len(queries))
    counters = [np.zeros(len(queries), dtype=np.uint64) for _ in range(radius + 1)]
    for i in range(64):
        flip = np.uint64(0) - ((queries >> np.uint64(i)) & np.uint64(1))
        differ = blocks[:, i] ^ flip
        for k in range(radius, 0, -1):
            counters[k] |= counters[k - 1] & differ
        counters[0] |= differ
        if i % 8 == 7 and i < 63:
            alive = counters[radius] != ALL
            if not alive.all():  # abandon what exceeds the radius in every lane
                live, queries, blocks = live[alive], queries[alive], blocks[alive]
                counters = [c[alive] for c in counters]
                if not len(live):
                    return out
    out[live] = ~counters[radius]
    return out


def link_chunks(fps: np.ndarray, group: np.ndarray, radius: int, chunk: int = 1 << 13) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within the radius that share a group, at most 64 * ``chunk`` at a
    time; rows sorted by group.

    Block pairs that hold no common group are never compared. Pairs of different groups that
    share a block pair and are within the radius are links as well, and are kept.
    """
    n = len(fps)
    n_blocks = -(-n // LANES)
    padded = np.zeros(n_blocks * LANES, dtype=np.uint64)
    padded[:n] = fps
    sliced = planes(padded)
    valid = np.full(n_blocks, ALL)
    if n % LANES:
        valid[-1] = (np.uint64(1) << np.uint64(n % LANES)) - np.uint64(1)
    # the last block that a query's group reaches
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]), n - 1)
    last = ends[np.searchsorted(ends, np.arange(n))] // LANES
    step = 0
    own = np.arange(n) // LANES
    active = np.arange(n)
    while len(active):
        active = active[own[active] + step <= last[active]]
        for lo in range(0, len(active), chunk):
            q = active[lo : lo + chunk]
            block = own[q] + step
            hits = near(fps[q], sliced[block], radius) & valid[block]
            if step == 0:  # lanes after the query's own
                lane = (q % LANES).astype(np.uint64)
                hits &= ~((np.uint64(2) << lane) - np.uint64(1))
            some = np.flatnonzero(hits)
            if len(some):
                bits = np.unpackbits(hits[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                row, lane = np.nonzero(bits)
                yield q[some[row]], block[some[row]] * LANES + lane
        step += 1


def links_in(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``link_chunks`` at once."""
    parts = list(link_chunks(fps, group, radius))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *[a for a, _ in parts]]), np.concatenate([none, *[b for _, b in parts]])


def forest(fps: np.ndarray, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints joined to the smallest one of their component.

    Links are merged into labels as they come, so memory holds a chunk of them at a time.
    """
    values, index = np.unique(fps, return_inverse=True)
    label = np.arange(len(values))
    for a, b in links:
        a, b = index[a], index[b]
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            low = np.minimum(x, y)
            # roots hook to smaller roots, then every label points to its root
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while not (label[label] == label).all():
                label = label[label]
    own = np.flatnonzero(label != np.arange(len(values)))
    return values[own], values[label[own]]


def compare_buckets(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (k, fp) sorted by bucket k; out: (a, b) spanning forests of the links.

    A bucket may run over batches: rows of the last bucket wait for the next batch.
    """
    kept_k, kept_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def flush(k: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(k) > 1:
            u = fp.view(np.uint64)
            x, y = forest(u, link_chunks(u, k, radius))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    for batch in batches:
        k = np.concatenate([kept_k, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([kept_fp, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(k):
            continue
        earlier = np.flatnonzero(k != k[-1])
        whole = int(earlier[-1]) + 1 if len(earlier) else 0
        kept_k, kept_fp = k[whole:], fp[whole:]
        yield from flush(k[:whole], fp[:whole])
    yield from flush(kept_k, kept_fp)


# ------------------------------------------------------------------------ the operator

def _quarter_pairs(fp, quarters: list[int], salt: int):
    """Bucket keys of a fingerprint: each pair of the quarters (bit offsets, sizes by gap)."""
    out = []
    for i, (x, y) in enumerate(combinations(quarters, 2)):
        part = lambda q: F.call_function("shiftrightunsigned", fp, F.lit(q)).bitwiseAND(F.lit(0xFFFF))
        out.append(F.shiftleft(part(x), 16).bitwiseOR(part(y)).bitwiseOR(F.lit((salt + i) << 32)))
    return out


def _split_again(fp, k):
    """Keys of a hot bucket: its own, with pairs of quarters of the 32 bits that it leaves open."""
    pairs = list(combinations(range(0, 64, 16), 2))
    out = None
    for i, (x, y) in enumerate(pairs):
        rest = [q for q in range(0, 64, 16) if q not in (x, y)]
        eighths = [rest[0], rest[0] + 8, rest[1], rest[1] + 8]
        part = lambda q: F.call_function("shiftrightunsigned", fp, F.lit(q)).bitwiseAND(F.lit(0xFF))
        keys = F.array(*[F.xxhash64(F.col("k"), F.lit(j), part(p), part(q)) for j, (p, q) in enumerate(combinations(eighths, 2))])
        of = F.shiftright(k, 32) == i
        out = F.when(of, keys) if out is None else out.when(of, keys)
    return out


def link_fingerprints(reps: DataFrame, stage: Stage, radius: int = 2, hot: int = 1024) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that span their links."""
    if radius != 2:
        raise ValueError("the buckets are those of radius 2")
    ship(reps.sparkSession)
    fp = F.col("fp")
    keyed = reps.select("fp", F.explode(F.array(*_quarter_pairs(fp, list(range(0, 64, 16)), 0))).alias("k"))
    # buckets of one row are compared with nothing; counts are summed in the tasks first
    counts = stage.put(keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    shared = keyed.join(counts, "k")
    keys = F.when(F.col("n") <= hot, F.array(F.col("k"))).otherwise(_split_again(fp, F.col("k")))
    rows = shared.select(F.explode(keys).alias("k"), "fp").repartition("k").sortWithinPartitions("k")
    return rows.mapInArrow(lambda batches: compare_buckets(batches, radius), "a long, b long")


def components_of(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, hot: int = 1024) -> DataFrame:
    """Rows (key, fp, component_id) for every document with a key."""
    spark = docs.sparkSession
    ship(spark)
    stage = Stage(spark, "simhash")
    of_text = F.pandas_udf(_fingerprints, "long")
    fps = stage.put(docs.filter(F.col(key).isNotNull()).select(F.col(key), of_text(F.col(text)).alias("fp")), "fingerprints")
    reps = stage.put(fps.groupBy("fp").agg(F.min(key).alias("first")), "distinct")
    edges = stage.put(link_fingerprints(reps.select("fp"), stage, radius, hot), "edges")
    found = components(edges, stage)
    # the component's key: the smallest of its fingerprints' smallest
    member = reps.join(found, reps["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    root = member.groupBy("component").agg(F.min("first").alias("component_id"))
    member = stage.put(member.join(root, "component").select("fp", "component_id"), "members")
    return fps.join(member, "fp").select(key, "fp", "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """One document of each component, the one of smallest key, with its columns as they were.

    Rows that repeat a key repeat in the result if the key stays; rows without a key stay.
    """
    found = components_of(docs, key, text, radius)
    gone = found.filter(F.col("component_id") < F.col(key)).select(F.col(key)).distinct()
    return docs.join(gone, key, "left_anti").select(docs.columns)


def hex_of(fp):
    """Sixteen lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
