"""Benchmark decontamination: rare n-gram seeds joined to passages, then Smith-Waterman alignment.

Texts become lower-case words without ASCII punctuation; an n-gram is its words' 64-bit hash. The
n-grams (3 words) of the test items are counted in the corpus. Seeds of an item are those of its
n-grams that occur at most ``few`` times or make up at most ``rare`` of the corpus's n-grams, and in any case the rarest
one that the corpus has of every stretch of ``stretch`` n-grams: a leak that very many documents repeat makes all its
n-grams frequent and stays visible, in each of its parts.
Occurrences of seeds in the corpus are joined with the seeds; around each one the item is aligned locally, word by
word, to the passage (match 2, mismatch and gap -1). The score is the best alignment's share of
a perfect one; passages at or above ``min_score`` are leaks, so edited and partly rewritten
copies count. A passage that has too few of the item's words to reach it is not aligned.

Items, n-grams, seeds and occurrences are tables; what tasks are sent whole are bitmaps of ``BITS`` bits
over hashes, which only keep rows from the network that can't meet any other. Occurrences are
those of distinct texts, so equal documents count once until the alignment. Joins that a
frequent seed, item or text could make uneven are salted. Items of one text are aligned in groups of
``block_words`` words at most (an item longer than that is a group of its own).

Null and empty texts have no leaks; items without words match nothing; an item shorter than n
words is its own seed. An item that occurs more than once in a text is reported once, at its
best alignment (the first of equal ones). Items that repeat an id are all searched, and the
best stands for the id; rows that repeat key and text are reported once. An empty benchmark gives
no rows and leaves all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, ship, unused
from .linededup import may_hold

_BREAK = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
MATCH, MISS, GAP = 2, -1, -1

#: Bits of the bitmap of n-grams that a scan is sent (2 MB).
BITS = 1 << 24
#: Parts of a row of the smaller side in a salted join.
SALTS = 16
#: Words whose hashes a task remembers, and n-grams whose counts it gathers, before it starts anew.
REMEMBERED = 1 << 18


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_BREAK).split()


class Hashes:
    """Hashes of words, remembered while they fit."""

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        words = tokens(text)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        seen = self.seen
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w, 7)
        return np.fromiter((seen[w] for w in words), np.uint64, len(words))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of hashed words, in order."""
    m = max(0, len(words) - n + 1)
    h = words[:m] + np.uint64(n)
    for i in range(1, n):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[i : m + i]
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score, and how far it reaches in item and passage (ends, exclusive)."""
    at = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, dtype=np.int64)
    best, end_i, end_j = 0, 0, 0
    for i, w in enumerate(item):
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(passage == w, MATCH, MISS), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        # gaps along the passage: a running maximum that loses a point a step
        row = np.maximum.accumulate(new - GAP * at) + GAP * at
        j = int(row.argmax())
        if row[j] > best:
            best, end_i, end_j = int(row[j]), i + 1, j
    return best, end_i, end_j


def best_passage(item: np.ndarray, words: np.ndarray, diagonals: list[int], min_score: float) -> tuple[float, int, int] | None:
    """The item's best alignment around its seeds: (score, start, end) in words."""
    slack = max(5, len(item) // 2)
    windows: list[list[int]] = []
    for d in diagonals:
        lo, hi = max(0, d - slack), min(len(words), d + len(item) + slack)
        # one window for overlapping ones, as long as it stays a few items long
        if windows and lo <= windows[-1][1] and hi - windows[-1][0] <= 4 * (len(item) + 2 * slack):
            windows[-1][1] = max(hi, windows[-1][1])
        else:
            windows.append([lo, hi])
    best = None
    for lo, hi in windows:
        passage = words[lo:hi]
        most = min(np.isin(passage, item).sum(), np.isin(item, passage).sum())
        if most / len(item) < min_score:
            continue
        score, end_i, end_j = align(item, passage)
        share = score / (MATCH * len(item))
        if share >= min_score and (best is None or share > best[0]):
            # backwards from its end, the same alignment ends at its start
            _, _, back = align(item[:end_i][::-1], passage[:end_j][::-1])
            best = (share, lo + end_j - back, lo + end_j)
    return best


def _hashed_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for batch in batches:
        keys, words = [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            own = hashes.of(text)
            if len(own):
                keys.append(row)
                words.append(own.view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int32())), pa.array(words, pa.list_(pa.int64()))], ["item", "words"])


def _items_grams(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ih, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.array(words, np.int64).view(np.uint64)
            grams = ngrams(own, min(n, len(own)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams), pa.array(np.full(len(grams), ih, np.int64)), pa.array(np.arange(len(grams), dtype=np.int32)), pa.array(np.full(len(grams), min(n, len(own)), np.int32))], ["gram", "ih", "at", "size"]
            )


def _held(grams: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = grams & np.int64(BITS - 1)
    return (bitmap[at >> np.int64(6)] >> (at & np.int64(63)).astype(np.uint64)) & np.uint64(1) == 1


def bitmap_of(rows: DataFrame) -> np.ndarray:
    """A bitmap of ``BITS`` bits over the n-grams of a table: at most BITS / 64 rows reach the driver, whatever its size."""
    at = F.col("gram").bitwiseAND(F.lit(BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    out = np.zeros(BITS // 64, np.int64)
    for r in rows.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def _count(batches: Iterator[pa.RecordBatch], sizes: list[int], bitmap) -> Iterator[pa.RecordBatch]:
    """Counts of the wanted n-grams, and under null that of all."""
    hashes, own, total = Hashes(), bitmap.value, 0
    gathered: list[np.ndarray] = []
    room = REMEMBERED

    def out() -> pa.RecordBatch:
        grams, counts = np.unique(np.concatenate(gathered or [np.zeros(0, np.int64)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([*grams.tolist(), None], pa.int64()), pa.array([*counts.tolist(), total], pa.int64())], ["gram", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = hashes.of(text)
            total += len(words)
            for n in sizes:
                grams = ngrams(words, n)
                grams = grams[_held(grams, own)]
                gathered.append(grams)
                room -= len(grams) + 1
            if room < 0:
                yield out()
                gathered, room, total = [], REMEMBERED, 0
    yield out()


def _occurrences(batches: Iterator[pa.RecordBatch], sizes: list[int], bitmap) -> Iterator[pa.RecordBatch]:
    hashes, own = Hashes(), bitmap.value
    for batch in batches:
        h1, h2 = (batch.column(c).to_numpy() for c in (0, 1))
        for row, text in enumerate(batch.column(2).to_pylist()):
            words = hashes.of(text)
            for n in sizes:
                grams = ngrams(words, n)
                at = np.flatnonzero(_held(grams, own))
                if len(at):
                    same = [pa.array(np.full(len(at), h[row], np.int64)) for h in (h1, h2)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(grams[at]), pa.array(at.astype(np.int32))], ["h1", "h2", "gram", "at"])


def _align_all(batches: Iterator[pa.RecordBatch], min_score: float) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    schema = None
    for batch in batches:
        rows: list[int] = []
        found: list[tuple] = []
        for row in range(batch.num_rows):
            words = hashes.of(batch.column("text")[row].as_py())
            for c in batch.column("items")[row].as_py():
                best = best_passage(np.array(c["words"], np.int64).view(np.uint64), words, sorted(c["diagonals"]), min_score)
                if best:
                    rows.append(row)
                    found.append((c["ih"], *best))
        take = pa.array(rows, pa.int32())
        kept = [batch.column(c).take(take) for c in ("k", "h1", "h2")]
        columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*kept, *columns], ["k", "h1", "h2", "ih", "score", "start", "end"])


def _meet(many: DataFrame, few: DataFrame, on: list[str], salt: Column) -> DataFrame:
    """An inner join whose larger side's equal keys are spread over ``SALTS`` tasks."""
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(few, [*on, "salt"]).drop("salt")


def _identity(text: Column) -> tuple[Column, Column]:
    """Two hashes that stand for a text."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit("again"), text)


def _leaks(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str = "text", n: int = 3, rare: float = 1e-6, few: int = 100, stretch: int = 3, min_score: float = 0.5, block_words: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """Rows (k, h1, h2, ih, score, start, end) of documents' rows and item texts, and (ih, item) of the items' ids."""
    spark = docs.sparkSession
    ship(spark)
    stage = Stage(spark, "leaks")
    kind = docs.select(F.col(key).alias("k")).schema["k"].dataType.simpleString()
    item_kind = benchmark.select(F.col(item).alias("i")).schema["i"].dataType.simpleString()
    h1, h2 = _identity(F.col(text))
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"), h1.alias("h1"), h2.alias("h2"))

    read = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).mapInArrow(_hashed_items, f"item {item_kind}, words array<long>")
    ids = stage.put(read.select(F.xxhash64("words").alias("ih"), "item", "words").distinct(), "ids")
    items = stage.put(ids.select("ih", "words").dropDuplicates(["ih"]), "items")
    grams = stage.put(items.mapInArrow(lambda b: _items_grams(b, n), "gram long, ih long, at int, size int"), "grams")
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # at most n of them

    # what of the items' n-grams the corpus has, how often, and which of them are an item's seeds
    sent = spark.sparkContext.broadcast(bitmap_of(grams))
    counted = stage.put(rows.select("text").mapInArrow(lambda b: _count(b, sizes, sent), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "counted")
    total = counted.filter("gram is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    place = F.row_number().over(Window.partitionBy("ih", F.floor(F.col("at") / stretch)).orderBy("n", F.xxhash64("gram", "ih"), "at"))
    seeds = grams.join(counted, "gram").withColumn("place", place).filter((F.col("n") <= max(few, rare * total)) | (F.col("place") == 1))
    seeds = stage.put(seeds.select("gram", "ih", F.col("at").alias("offset")), "seeds")
    sent_seeds = spark.sparkContext.broadcast(bitmap_of(seeds))

    # occurrences of seeds, of equal texts once, and the items that each text is to be aligned with
    hits = rows.select("h1", "h2", "text").mapInArrow(lambda b: _occurrences(b, sizes, sent_seeds), "h1 long, h2 long, gram long, at int").distinct()
    met = _meet(hits, seeds, ["gram"], F.col("h1")).groupBy("h1", "h2", "ih").agg(F.collect_set(F.col("at") - F.col("offset")).alias("diagonals"))
    met = _meet(met, items, ["ih"], F.col("h1"))
    room = F.sum(F.size("words")).over(Window.partitionBy("h1", "h2").orderBy("ih"))
    wanted = met.withColumn("block", F.floor((room - 1) / block_words)).groupBy("h1", "h2", "block").agg(F.collect_list(F.struct("ih", "words", "diagonals")).alias("items"))
    wanted = stage.put(wanted, "wanted")

    texts = may_hold(rows, F.col("h1"), wanted, F.col("h1"), BITS >> 4)
    found = _meet(texts, wanted.drop("block"), ["h1", "h2"], F.xxhash64("k")).select("k", "h1", "h2", "text", "items")
    return found.mapInArrow(lambda b: _align_all(b, min_score), f"k {kind}, h1 long, h2 long, ih long, score double, start int, end int"), ids.select("ih", "item")


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", **options) -> DataFrame:
    """Rows (key, item, score, start, end), words of the text; one per leaked item of a document."""
    found, ids = _leaks(docs, benchmark, key, text, item, **options)
    best = F.max_by(F.struct("score", "start", "end"), F.struct("score", -F.col("start"), -F.col("end"))).alias("best")
    named = _meet(found, ids, ["ih"], F.col("h1")).groupBy("k", "h1", "h2", "item").agg(best)
    return named.select(F.col("k").alias(key), F.col("item").alias(item), "best.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", **options) -> DataFrame:
    """The documents without a leak, with their columns as they were."""
    found, _ = _leaks(docs, benchmark, key, text, item, **options)
    a, b, salt = own = unused(docs, 3)
    leaked = found.select(F.col("h1").alias(a), F.col("h2").alias(b)).distinct().withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    h1, h2 = _identity(F.col(text))
    marked = docs.withColumns({a: h1, b: h2, salt: F.pmod(F.xxhash64(F.col(key)), F.lit(SALTS)).cast("int")})
    return marked.join(leaked, own, "left_anti").drop(*own)
