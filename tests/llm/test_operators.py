"""Corpus operators against brute force, and on odd input: nulls, empty, long, repeated, clashing."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from insertframe.llm import bloomlm, decontaminate, graph, langid, linededup, mixing, perspectives, pii, quality, registry, simhash, toxicity
from insertframe.llm.common import Stage, fold

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "benchmark", "conversations")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# ---------------------------------------------------------------------------------- SQL

@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()))


# ---------------------------------------------------------------------------------- op1

def test_decontamination(spark, odd, empty):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(6))
    items = [" ".join(word() for _ in range(30)) for _ in range(6)]
    edited = items[1].split()
    for i in range(3, 30, 7):
        edited[i] = "changed"
    filler = lambda n: " ".join(word() for _ in range(n))
    rows = [(1, filler(40) + " " + items[0].upper() + ", " + filler(40)), (2, filler(10) + " " + " ".join(edited)), (3, filler(200)), (4, " ".join(items[2].split()[:6]) + filler(50)), (5, None), (6, "")]
    rows += [(10 + i, items[3] + " " + filler(5)) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "!!")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(d, b).collect()}
    assert set(got) == {(1, 0), (2, 1)} | {(10 + i, 3) for i in range(300)}
    assert got[1, 0]["score"] == 1.0 and (got[1, 0]["start"], got[1, 0]["end"]) == (40, 70)
    assert 0.5 <= got[2, 1]["score"] < 1
    # blocks of items give the same
    again = decontaminate.find_leaks(d, b, block_words=70).collect()
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in again} == {(*k, r["score"]) for k, r in got.items()}
    assert {r["doc_id"] for r in decontaminate.clean_documents(d, b).collect()} == {3, 4, 5, 6}
    assert decontaminate.clean_documents(odd, b).columns == odd.columns and decontaminate.clean_documents(odd, b).count() == odd.count()
    assert decontaminate.find_leaks(empty, b).count() == 0 and decontaminate.find_leaks(d, b.filter("false")).count() == 0


def test_decontamination_against_brute_force(spark):
    """The whole query against every item aligned with every whole text."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("bcdfgaeiou") for _ in range(5)) for _ in range(400)]
    said = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: said(n) for i, n in enumerate((3, 8, 20, 40, 40, 80, 200))}
    items |= {7: items[4], 8: items[3][:38] + said(2), 9: ["short", "one"]}  # equal, nearly equal, shorter than an n-gram
    texts = [said(rng.randrange(60)) for _ in range(60)]
    for own in list(items.values()):
        for share in (0.0, 0.05, 0.1, 0.2):
            copy = [w for w in own for w in ([] if rng.random() < share / 3 else [rng.choice(vocabulary), w] if rng.random() < share / 3 else [rng.choice(vocabulary) if rng.random() < share / 3 else w])]
            texts.append(said(rng.randrange(30)) + copy + said(rng.randrange(30)))
    texts += [items[5] + said(3)] * 40 + [items[5][:60] + said(i) for i in range(40)]  # one item in a third of all rows
    docs = spark.createDataFrame([(i if i % 9 else None, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    number = {w: i for i, w in enumerate({w for t in [*items.values(), *texts] for w in t})}
    ints = {i: np.array([number[w] for w in t]) for i, t in items.items()}
    want = set()
    for at, t in enumerate(texts):
        for i, own in ints.items():
            share = decontaminate.align(own, np.array([number[w] for w in t], dtype=int))[0] / (2 * len(own)) if t else 0
            if share >= 0.5:
                want.add((at if at % 9 else None, " ".join(t), i, share))
    got = decontaminate.find_leaks(docs, bench).join(bench.select("item_id"), "item_id").collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["item_id"], r["score"]) for r in got)) == sorted((k is None, k or 0, i, s) for k, _, i, s in want)
    assert len(want) > 120
    leaked = {t for _, t, _, _ in want}
    kept = [r["text"] for r in decontaminate.clean_documents(docs, bench).collect()]
    assert sorted(kept) == sorted(t for t in map(" ".join, texts) if t not in leaked)


def test_smith_waterman_against_a_plain_model():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randrange(1, 12))]) for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        score, i, j = decontaminate.align(a, b)
        assert score == h.max() and (score == 0 or h[i, j] == score)


# ---------------------------------------------------------------------------------- op2

def test_mixing(spark, docs, odd, empty):
    labels = mixing.domains_of(spark.read.parquet(f"{SF}/labels.parquet"))
    rows = mixing.mix(docs, labels, mixing.TARGETS, tolerance=1e-3).collect()
    assert len(rows) == docs.count()
    total = sum(r["n_tokens"] for r in rows)
    for d, share in mixing.TARGETS.items():
        assert abs(sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in rows) / total - share) < 2e-3
    assert min(r["rate"] for r in rows) >= 0
    assert all(abs(sum(r[f"p_{d}"] for d in mixing.TARGETS) - 1) < 1e-9 for r in rows)
    assert [r["n_tokens"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [len(words(r["text"])) for r in docs.orderBy("doc_id").collect()]
    assert mixing.mix(odd, labels, mixing.TARGETS).count() == odd.count()
    assert mixing.mix(odd, labels.filter("false"), mixing.TARGETS).count() == odd.count()
    assert mixing.mix(empty, labels, mixing.TARGETS).count() == 0


def nearest(n, p, wanted, iterations=20_000):
    """The least squared residual of any nonnegative rates, by an accelerated method of its own on the dense system:
    variables are expected tokens, columns posteriors."""
    own = n > 0
    p, x = p[own], n[own].copy()
    size = np.linalg.eigvalsh(p.T @ p)[-1]
    y, t = x.copy(), 1.0
    for _ in range(iterations):
        new = np.maximum(0, y - p @ (p.T @ y - wanted) / size)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return ((p.T @ x - wanted) ** 2).sum()


def rates_of(spark, n, p, targets, **options):
    k = p.shape[1]
    members = spark.createDataFrame([(i, int(a), *map(float, q)) for i, (a, q) in enumerate(zip(n, p))], "i long, n_tokens long, " + ", ".join(f"p{j} double" for j in range(k)))
    fitted, reached, wanted = mixing.fit_rates(members, targets, **options)
    rate = np.array([r["rate"] for r in fitted.orderBy("i").collect()])
    assert (rate >= 0).all() and np.allclose((rate * n) @ p, reached, rtol=1e-9, atol=1e-6)
    return rate, np.array(reached), np.array(wanted)


@pytest.mark.filterwarnings("ignore:mixing")
@pytest.mark.parametrize("rare", [0.2, 0.01, 1e-3, 1e-4, 0.0])
def test_mixing_with_a_rare_domain(spark, rare):
    """Held against dense nonnegative least squares; never worse than rates of one, however little mass a domain has."""
    r = np.random.default_rng(3)
    n = r.integers(0, 900, 150)
    p = r.dirichlet([4, 2, 1], 150) * [1, 1, 0]
    p[:, 2] = rare * r.random(150)
    p /= p.sum(axis=1, keepdims=True)
    for targets in ([0.5, 0.3, 0.2], [0.9, 0.06, 0.04], [0.0, 0.0, 1.0]):
        rate, reached, wanted = rates_of(spark, n, p, targets)
        loss, best, ones = ((reached - wanted) ** 2).sum(), nearest(n, p, wanted), ((n @ p - wanted) ** 2).sum()
        assert loss <= ones and loss <= best * 1.02 + (2e-4 * n.sum()) ** 2, (targets, loss, best, ones)


def test_mixing_against_dense_least_squares(spark, docs):
    """The query's own members: targets are met, or missed by no more than any rates must."""
    labels = mixing.domains_of(spark.read.parquet(f"{SF}/labels.parquet"))
    rows = mixing.mix(docs, labels, mixing.TARGETS).collect()
    names = sorted(mixing.TARGETS)
    n = np.array([r["n_tokens"] for r in rows], float)
    p = np.array([[r[f"p_{d}"] for d in names] for r in rows])
    wanted = n.sum() * np.array([mixing.TARGETS[d] for d in names]) / sum(mixing.TARGETS.values())
    off = (np.array([r["rate"] for r in rows]) * n) @ p - wanted
    assert (off**2).sum() <= nearest(n, p, wanted) * 1.02 + (2e-4 * n.sum()) ** 2
    with pytest.raises(RuntimeError):
        mixing.mix(docs, labels, {"clean": 0.0, "low": 0.0, "toxic": 1.0}, max_steps=1, max_moves=1, strict=True)


# ---------------------------------------------------------------------------------- op3

def test_perspectives(spark):
    rows = [(1, 0, "anna", "hi <|x"), (1, 1, "bo", None), (1, 1, "bo", None), (1, None, "system", "be kind"), (2, 0, "system", "alone"), (None, 0, "anna", "lost"), (3, 0, None, ""), (4, 0, "a", "x"), (4, 300, "b", "y")]
    df = spark.createDataFrame([(*r, "c", "p") for r in rows], "conv_id long, turn long, role string, text string, c string, part string")
    got = {(r["conv_id"], r["participant"], r["part"]): r for r in perspectives.rotate(df).collect()}
    assert set(got) == {(1, "anna", 0), (1, "bo", 0), (3, "unknown", 0), (4, "a", 0), (4, "b", 0)}
    anna, bo = got[1, "anna", 0], got[1, "bo", 0]
    assert anna["rendering"].startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi <||x<|im_end|>\n<|im_start|>user name=bo\n")
    assert [anna["rendering"][s["start"] : s["end"]] for s in anna["mask"]] == ["hi <||x<|im_end|>"]
    assert bo["n_own"] == 2 and len(bo["mask"]) == 2 and bo["n_turns"] == 4
    # numbers may lie far apart: the dialogue is one all the same
    assert got[4, "a", 0]["rendering"] == "<|im_start|>assistant\nx<|im_end|>\n<|im_start|>user name=b\ny<|im_end|>\n" and got[4, "a", 0]["n_turns"] == 2
    assert spark.range(1).select(perspectives.unescape(perspectives.escape(F.lit("<| <|| |")))).first()[0] == "<| <|| |"
    assert perspectives.rotate(df.filter("false")).count() == 0


def rendered(rows, part_turns):
    """Rows (conversation, turn, speaker, text) by hand: (conversation, participant, part) to its rendering, own contents and number of turns."""
    talks, out = defaultdict(list), {}
    for c, n, who, text in rows:
        if c is not None:
            talks[c].append(((n is not None, n or 0), who or "unknown", text or ""))
    for c, own in talks.items():
        own.sort()
        for me in {w for _, w, _ in own} - {"system"}:
            for k in range(0, len(own), part_turns):
                before = [x for x in own[:k] if x[1] == "system"]
                before = before[:part_turns] if len(before) > part_turns else before
                turns = [(w, t.replace("<|", "<||")) for _, w, t in [*before, *own[k : k + part_turns]]]
                name = lambda w: "system" if w == "system" else "assistant" if w == me else f"user name={w}"  # noqa: B023, E731
                out[c, me, k // part_turns] = ("".join(f"<|im_start|>{name(w)}\n{t}<|im_end|>\n" for w, t in turns), [t + "<|im_end|>" for w, t in turns if w == me], len(own[k : k + part_turns]))
    return out


@pytest.mark.parametrize("part_turns", [1, 3, 7, 4096])
def test_perspectives_by_hand(spark, part_turns):
    """Turns numbered far apart, null and equal numbers, repeated rows, several system turns."""
    r = random.Random(part_turns)
    rows = [(r.choice([1, 2, 3, None]), r.choice([None, 0, 1000, 2000, 10**9, r.randrange(50)]), r.choice(["system", "anna", "bo", None]), r.choice(["x", "y", None, "<|im_end|>", f"t{k}"])) for k in range(160)]
    rows += [(4, 1000 * k, ("system" if k in (0, 5) else "anna" if k % 2 else "bo"), f"s{k}") for k in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {(x["conv_id"], x["participant"], x["part"]): (x["rendering"], [x["rendering"][m["start"] : m["end"]] for m in x["mask"]], x["n_turns"]) for x in perspectives.rotate(df, part_turns=part_turns).collect()}
    assert got == rendered(rows, part_turns)


def test_perspectives_of_long_dialogues(spark, tmp_path):
    """Two parts, the second with both system turns again; 4,500 null turns, equal ones among them; the SQL agrees."""
    rows = [(1, 60 * i, "system" if i in (0, 9) else ("anna", "bo")[i % 2], f"turn {i}") for i in range(4200)]
    rows += [(2, None, "anna", f"n{i // 3}") for i in range(4500)] + [(2, 5, "bo", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    own = registry.op3_chat_perspectives(spark, str(tmp_path))
    columns = sorted(own.columns)
    got = sorted(tuple(r[c] for c in columns) for r in own.collect())
    assert got == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES['op3_chat_perspectives']})").fetchall())
    second = next(r for r in own.collect() if (r["conv_id"], r["participant"], r["part"]) == (1, "anna", 1))
    assert second["rendering"].startswith("<|im_start|>system\nturn 0<|im_end|>\n<|im_start|>system\nturn 9<|im_end|>\n") and second["n_turns"] == 104


# ---------------------------------------------------------------------------------- op4

def test_lm_scoring(spark, docs, texts, odd, empty):
    rows = registry.op4_lm_scoring(spark, SF).collect()
    token = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), b" end"]
    c, pairs = Counter(), Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            w = token(t)
            c.update(w)
            pairs.update(zip([b" end", *w], w))
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(texts)
    gap = []
    for r in rows:
        w = token(texts[r["doc_id"]])
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r["base_score"] - base) <= 1e-9 * abs(base) + 1e-9
        exact = sum(math.log10((min(pairs[u, x], c[u]) + 2 * (c[x] + 1) / (n + v + 1)) / (c[u] + 2)) for u, x in zip([b" end", *w], w))
        gap.append((r["score"] - exact) / len(w))
    assert max(map(abs, gap)) < 0.3 and abs(sum(gap) / len(gap)) < 0.05
    model = bloomlm.train(odd, Stage(spark, "t"), head=2)
    assert bloomlm.score_documents(odd, model).count() == odd.count()
    none = bloomlm.train(empty, Stage(spark, "t"))
    assert bloomlm.score_documents(empty, none).count() == 0
    blank = {r["n_known"] for r in bloomlm.score_documents(odd, none).collect()}
    assert blank == {0}


@pytest.mark.parametrize("most_bytes", [1 << 16, 1 << 12, 1])
def test_lm_routed_probes(spark, docs, odd, empty, most_bytes):
    """A filter too large to broadcast gives the scores of one that is not, to the last bit, whatever
    the number of its parts; every n-gram is in it."""
    held = docs.filter(fold(F.col("doc_id"), 7) != 2)
    whole = bloomlm.train(held, Stage(spark, "t"))
    parts = bloomlm.train(held, Stage(spark, "t"), most_bytes=most_bytes)
    assert len(whole.filter.data) == whole.filter.bits // 8 == parts.filter.bits // 8 > most_bytes and not len(parts.filter.data)
    for df in (docs, odd, empty):
        rows = [sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in bloomlm.score_documents(df, m).collect()) for m in (whole, parts)]
        assert rows[0] == rows[1] and len(rows[0]) == df.count()


def test_lm_filter_grows(spark, texts):
    """The filter has room for all n-grams at any size: the rarest are told from those never seen."""
    sizes = []
    for n in (20, 100, 200):
        own = dict(list(sorted(texts.items()))[:n])
        m = bloomlm.train(spark.createDataFrame([*own.items()], "doc_id long, text string"), Stage(spark, "t"))
        pairs = np.unique(np.concatenate([bloomlm.grams(bloomlm.lay([h], 2, bloomlm.Hasher()([bloomlm.END])[0])[0], 2)[1:] for t in own.values() for h in [bloomlm.Hasher()(bloomlm.tokens(t))]]))
        assert (m.filter.count(pairs) >= 1).all()
        never = np.random.default_rng(n).integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2) & bloomlm.KEPT
        assert (m.filter.count(never) > 0).mean() < 0.08
        sizes.append(m.filter.bits)
    assert sizes == sorted(sizes) and sizes[-1] > sizes[0]


def test_lm_words_at_once():
    """Words cut and hashed in numpy are those of a text alone, whatever stands in it."""
    rng = np.random.default_rng(1)
    own = [b"", b" ", b"a", b"  A\tbc\x0bD\x1c\xc3\x89 \x00 \x00\x00", b"x" * 64 + b" " + b"x" * 65 + b" " + b"y" * 200, b"\n\n"]
    own += [bytes(rng.choice(np.frombuffer(b"aBc \n\xc3\x89\x85", np.uint8), 300)) for _ in range(50)]
    want = [bloomlm.tokens(t) for t in own]
    block, flat = bloomlm.Block.of(own), [w for t in want for w in t]
    assert block.sizes.tolist() == [len(t) for t in want] and block.tokens_at(np.arange(len(flat))) == flat
    assert (block.hashes == bloomlm.Hasher()(flat)).all() and len(set(block.hashes.tolist())) == len(set(flat))
    batch = bloomlm.pa.RecordBatch.from_arrays([bloomlm.pa.array(own, bloomlm.pa.binary())], ["text"])
    assert Counter({w: n for b in bloomlm._token_counts(iter([batch])) for w, n in zip(*(c.to_pylist() for c in b.columns))}) == Counter(flat)


def test_lm_routes_for_every_core(spark, docs, monkeypatch):
    """A filter a little too large to broadcast is answered by many tasks, not by one for every 128 MB of it."""
    kept, put = {}, Stage.put
    monkeypatch.setattr(Stage, "put", lambda self, df, name: kept.setdefault(name, put(self, df, name)))
    bits = bloomlm.train(docs, Stage(spark, "t")).filter.bits
    kept.clear()
    model = bloomlm.train(docs, Stage(spark, "t"), most_bytes=bits // 16)
    assert bloomlm.score_documents(docs, model).count() == docs.count()
    assert kept["answers"].select("route").distinct().count() >= min(model.filter.pieces, 4 * spark.sparkContext.defaultParallelism)


def test_lm_bitmaps_do_not_multiply():
    """What stands together of a piece makes one bitmap, however many rows it is."""
    h = [np.unique(np.random.default_rng(k).integers(0, 1 << 60, 500, dtype=np.uint64) & bloomlm.KEPT) for k in range(6)]
    rows = [[0] * 6, [bloomlm.pack_hashes(x) for x in h], [np.ones(len(x), np.uint8).tobytes() for x in h]]
    batch = bloomlm.pa.RecordBatch.from_arrays([bloomlm.pa.array(x, t) for x, t in zip(rows, (bloomlm.pa.int32(), bloomlm.pa.binary(), bloomlm.pa.binary()))], ["shard", "hashes", "levels"])
    (made,) = bloomlm._pieces(iter([batch]), 4, 1 << 18, 1)
    f = bloomlm.Filter(np.frombuffer(made.column(1)[0].as_py(), np.uint8), 1 << 18, 4, 1.5, 1, 1)
    assert all((f.levels(x) == 1).all() for x in h)


def test_bloom_filter_counts():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64) & bloomlm.KEPT)
    counts = rng.integers(1, 1000, len(h)).astype(np.uint64)
    level = bloomlm.level_of(counts, 1.5)
    bits = 1 << 22
    data = np.zeros(bits, dtype=np.uint8)
    for j in range(1, int(level.max()) + 1):
        for p in bloomlm.places(h[level >= j], j, 4, bits, 64):
            data[p.astype(np.int64)] = 1
    f = bloomlm.Filter(np.packbits(data, bitorder="little"), bits, 4, 1.5, int(level.max()), 64)
    got = f.count(h)
    want = bloomlm.value_of(level, 1.5)
    assert (got >= want).all() and (got == want).mean() > 0.99
    assert (f.count(np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64) & bloomlm.KEPT)) == 0).mean() > 0.97
    assert (bloomlm.unpack_hashes(bloomlm.pack_hashes(h)) == h).all()


# ---------------------------------------------------------------------------------- op5

def line_model(docs, min_words=5, least=0.8):
    """Brute force over all pairs of distinct lines, by edit similarity alone."""
    seen = {}
    for i in sorted(docs):
        for j, raw in enumerate(docs[i].split("\n")):
            n = re.sub(r"[^\w]+|_+", " ", raw.lower()).strip()
            if n and len(n.split(" ")) >= min_words:
                seen.setdefault(n, []).append((i, j))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    u = Union()
    names = {n: (n.split(" "), Counter(n.split(" "))) for n in sorted(seen)}
    for (a, (x, cx)), (b, (y, cy)) in combinations(names.items(), 2):
        longer = max(len(x), len(y))
        most = math.floor(longer * (1 - least) + 1e-9)
        # lines that differ in more words than may be edited need no more
        if longer - (cx & cy).total() <= most and distance(x, y) <= most:
            u.join(seen[a][0], seen[b][0])
    kept = {}
    groups = defaultdict(list)
    for n, at in seen.items():
        groups[u.find(at[0])] += at
    for root, at in groups.items():
        kept.update({x: min(at) for x in at if x != min(at)})
    return kept


def test_line_dedup(spark, odd, empty):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(5))
    lines = [" ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(60)]
    docs = {}
    for i in range(120):
        own = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(lines).split()
            if rng.random() < 0.4:
                line[rng.randrange(len(line))] = word()
            own.append((" ".join(line).title() + ".") if rng.random() < 0.5 else " ".join(line))
        docs[i] = "\n".join([*own, "short"])
    df = spark.createDataFrame([*docs.items()], "doc_id long, text string")
    want = line_model(docs)
    for most in (16, 2):
        got = {(r["k"], r["line"]): (r["kept"]["k"], r["kept"]["line"]) for r in linededup.dropped_lines(df, most=most).collect()}
        assert {*got} <= {*want} and len(got) >= len(want) - 3 * (most == 2), most
    left = {r["doc_id"]: r["text"] for r in linededup.deduplicate(df).collect()}
    for i, t in docs.items():
        keep = "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in want)
        assert left[i] == keep
    out = linededup.deduplicate(odd)
    assert out.columns == odd.columns and out.count() == odd.count() - 2  # two rows of the repeated text are one document
    assert linededup.deduplicate(empty).count() == 0 and linededup.report(empty).count() == 0
    assert linededup.report(odd).count() == odd.filter("doc_id is not null").count()


@pytest.mark.parametrize("common, own, changed", [(30, 9, 1), (60, 20, 2), (100, 30, 3)])
def test_families_of_lines(spark, common, own, changed):
    """Two hundred pairs with one long common beginning, each pair unlike the others: nine in ten are found."""
    r = random.Random(common)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    head, rows = [word() for _ in range(common)], []
    for k in range(200):
        tail = [word() for _ in range(own)]
        other = list(tail)
        for i in r.sample(range(own), changed):
            other[i] = word()
        rows += [(2 * k, " ".join(head + tail)), (2 * k + 1, " ".join(head + other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["k"]: r["kept"]["k"] for r in linededup.dropped_lines(df, **linededup.WHOLE).collect()}
    assert all(k % 2 and v == k - 1 for k, v in got.items())
    assert len(got) >= 180


@pytest.mark.parametrize("most", [2, 16])
def test_line_dedup_loses_no_link(spark, monkeypatch, most):
    """Against brute force: families whose lines share most windows, repeated words, short lines; blocks of a few lines."""
    monkeypatch.setattr(linededup, "BLOCK", 3)
    r = random.Random(most)
    word = lambda: r.choice(WORDS_OF_FAMILIES)
    docs = {}
    for common, own, changed in ((30, 9, 1), (30, 9, 4), (8, 3, 1), (3, 2, 1), (3, 3, 1), (2, 2, 1), (100, 30, 12)):
        head = [word() for _ in range(common)]
        for _ in range(12):
            tail = [word() for _ in range(own)]
            other = list(tail)
            for i in r.sample(range(own), min(changed, own)):
                other[i] = word()
            more = r.sample([*head, *other], common + own)
            docs |= {len(docs) + i: " ".join(x) for i, x in enumerate((head + tail, head + other, other + head, more, head + tail[:-1]))}
    for n in (5, 6, 9, 16):
        for _ in range(8):
            docs[len(docs)] = " ".join(r.choice("xyz") for _ in range(n))
    df = spark.createDataFrame([*docs.items()], "doc_id long, text string")
    got = {(x["k"], x["line"]): (x["kept"]["k"], x["kept"]["line"]) for x in linededup.dropped_lines(df, min_words=1, most=most).collect()}
    assert got == line_model(docs, min_words=1)


def test_line_dedup_single_rare_words(spark, monkeypatch):
    """Lines so long that they meet by one rare word, and those that may be similar to such ones, lose no link."""
    monkeypatch.setattr(linededup, "PAIRED", 11)
    test_line_dedup_loses_no_link(spark, monkeypatch, 1)


def test_line_dedup_unlike_family(spark, monkeypatch):
    """Lines that share most of their windows but are unlike are not all compared with each other."""
    r, rows, put = random.Random(5), {}, linededup.Stage.put

    def counted(self, df, name):
        out = put(self, df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(linededup.Stage, "put", counted)
    head = [f"h{i}" for i in range(30)]
    docs = [(i, " ".join(head + [f"w{r.randrange(100)}" for _ in range(16)])) for i in range(60)]
    assert linededup.dropped_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=1).count() == 0
    # a line has its eleven rarest words, by twos
    assert rows["met-words"] == 60 * 55 and rows["pairs-words"] < 60 * 59 / 2 / 10


WORDS_OF_FAMILIES = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha") for b in ("lo", "mi", "nu", "pa", "re", "so")]


# ---------------------------------------------------------------------------------- op6

def fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_simhash(spark, texts, odd, empty):
    rows = registry.op6_simhash(spark, SF).collect()
    fps = {i: fingerprint(t) for i, t in texts.items()}
    u = Union()
    for a in fps:
        for b in fps:
            if a <= b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                u.join(a, b)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{f:016x}", u.find(i)) for i, f in fps.items()}
    got = simhash.components_of(odd).collect()
    assert len(got) == odd.filter("doc_id is not null").count()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["fp"] == by[1]["fp"] == 0 and by[1]["component_id"] == 0 and by[7]["component_id"] == 6
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {None, 0, 100}
    assert simhash.components_of(empty).count() == 0


def near_fingerprints(rng, n):
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    out = [base]
    for _ in range(5):
        x = base.copy()
        for _ in range(2):
            flip = np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
            x = np.where(rng.random(n) < 0.7, x ^ flip, x)
        out.append(x)
    return np.concatenate(out)


@pytest.mark.parametrize("n,groups", [(1, 1), (10, 1), (70, 3), (40, 40)])
def test_bit_slices(n, groups):
    rng = np.random.default_rng(n)
    fps = near_fingerprints(rng, n)
    rng.shuffle(fps)
    g = np.sort(rng.integers(0, groups, len(fps)))
    a, b = simhash.links_in(fps, g, 2)
    near = lambda i, j: bin(int(fps[i] ^ fps[j])).count("1") <= 2
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    assert all(near(*p) for p in got)
    assert {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if g[i] == g[j] and near(i, j)} <= got


@pytest.mark.parametrize("hot", [1024, 2])
def test_fingerprint_links(spark, hot):
    rng = np.random.default_rng(3)
    fps = np.unique(near_fingerprints(rng, 60).view(np.int64))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    u, v = Union(), Union()
    for r in simhash.link_fingerprints(df, Stage(spark, "t"), hot=hot).collect():
        v.join(r["a"], r["b"])
    for i, x in enumerate(fps):
        for y in fps[i + 1 :]:
            if bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") <= 2:
                u.join(int(x), int(y))
    assert all(u.find(int(x)) == v.find(int(x)) for x in fps)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(1000, 1000 + i) for i in range(1, 300)]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), Stage(spark, "t")).collect()}
    assert got == {x: u.find(x) for e in edges if e[0] != e[1] for x in e}
    assert graph.components(spark.createDataFrame([], "a long, b long"), Stage(spark, "t")).count() == 0


# ---------------------------------------------------------------------------------- op7

def test_quality(spark, docs, odd, empty):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = quality.judge_documents(docs).collect()
    good = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert all(good)
    assert not any(r["kept"] for r in rows if labels.get(r["doc_id"]) == 0)
    judged = quality.judge_documents(odd).collect()
    assert len(judged) == odd.count() and not any(r["kept"] for r in judged)
    assert max(r["n_repeat_words"] for r in judged) == 60_000
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["kept"]}
    assert quality.filter_documents(odd).count() == 0 and quality.judge_documents(empty).count() == 0


def test_cascade_order():
    rules = quality.default_rules()[:3]
    measured = [{"rule": "too_short", "cost": 1.0, "rejected": 0.1}, {"rule": "too_repetitive", "cost": 10.0, "rejected": 0.5}, {"rule": "symbols", "cost": 0.1, "rejected": 0.1}]
    assert [r.name for r in quality.order(rules, measured)] == ["symbols", "too_short", "too_repetitive"]


# ---------------------------------------------------------------------------------- op8

def query_drops(spark, tmp_path, docs):
    """(doc, line) pairs that the registered query drops."""
    spark.createDataFrame([*docs.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.op5_line_dedup(spark, str(tmp_path)).collect()
    return {(r["doc_id"], int(j)) for r in rows for j in r["dropped_lines"].split(",") if j}


@pytest.mark.parametrize("n", [5, 6, 8, 12, 20, 40, 80, 200])
def test_line_dedup_recall(spark, tmp_path, n):
    """Of lines with a word, a tenth or a fifth of the words changed, or a word more, nine in ten
    are found at least; unlike lines stay."""
    rng = random.Random(n)
    word = lambda: f"w{rng.randrange(3000)}"
    docs, kinds = {}, {}
    for kind in ("one", "tenth", "fifth", "more"):
        for _ in range(40):
            a = [word() for _ in range(n)]
            b = [*a]
            if kind == "more":
                b.insert(rng.randrange(n + 1), word())
            else:
                for j in rng.sample(range(n), {"one": 1, "tenth": max(1, n // 10), "fifth": n // 5}[kind]):
                    b[j] = word()
            kinds[len(docs) + 1] = kind
            docs |= {len(docs): " ".join(a), len(docs) + 1: " ".join(b)}
    found = query_drops(spark, tmp_path, docs)
    hits = Counter(kinds[i] for i, _ in found)
    assert all(hits[k] >= 36 for k in ("one", "tenth", "fifth", "more")), hits


def test_line_dedup_recall_on_documents(spark, texts):
    """Against brute force over the lines of the documents: nine in ten of those that go, no other."""
    own = dict(list(sorted(texts.items()))[:120])
    df = spark.createDataFrame([*own.items()], "doc_id long, text string")
    got = {(r["k"], r["line"]) for r in linededup.dropped_lines(df, **linededup.WHOLE).collect()}
    want = set(line_model(own, min_words=1))
    assert got <= want and len(got) >= 0.9 * len(want) > 0


def test_line_dedup_frequent_pieces(spark, tmp_path):
    """Many lines with the same beginning: unlike ones stay, and edited copies go."""
    rng = random.Random(11)
    docs = {}
    for _ in range(60):
        a = "all rights reserved by the owner of this".split(" ") + [f"w{rng.randrange(10**6)}" for _ in range(14)]
        b = [*a]
        b[rng.randrange(8, 22)] = "edited"
        docs |= {len(docs): " ".join(a), len(docs) + 1: " ".join(b)}
    assert query_drops(spark, tmp_path, docs) == {(i, 0) for i in range(1, 120, 2)}


def test_line_dedup_permuted(spark, tmp_path):
    """Lines of the same words in another order are told apart."""
    rng = random.Random(6)
    docs, want = {}, set()
    for g in range(4):
        n = 10 + 7 * g
        a = [f"p{rng.randrange(10**6)}" for _ in range(n)]
        b = a[::-1]
        c = [b[1], b[0], *b[2:]]
        d = rng.sample(a, n)
        docs |= {len(docs) + i: " ".join(x) for i, x in enumerate((a, b, c, d))}
        want.add((len(docs) - 2, 0))
    assert query_drops(spark, tmp_path, docs) == want


def test_line_dedup_near_groups(spark):
    """Against brute force, with several lines of many SimHashes and near ones."""
    rng = random.Random(9)
    docs = {}
    for g in range(12):
        base = [f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 45))]
        for _ in range(10):
            line = [*base]
            if rng.random() < 0.5:  # another order
                random.Random(rng.randrange(3)).shuffle(line)
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = f"q{rng.randrange(10**6)}"
            if rng.random() < 0.5:
                i = rng.randrange(len(line) - 1)
                line[i], line[i + 1] = line[i + 1], line[i]
            docs[len(docs)] = " ".join(line)
    got = {(r["k"], r["line"]): (r["kept"]["k"], r["kept"]["line"]) for r in linededup.dropped_lines(spark.createDataFrame([*docs.items()], "doc_id long, text string")).collect()}
    assert got == line_model(docs)


def test_line_dedup_long_lines(spark, tmp_path):
    """An edited copy of a very long line goes, parts of it and its words in another order stay."""
    rng = random.Random(10)
    line = [f"l{rng.randrange(10**6)}" for _ in range(40_001)]
    edited = [*line[:20_000], "edited", *line[20_001:]]
    docs = {0: " ".join(line), 1: " ".join(edited), 2: " ".join(line[:16_383]), 3: " ".join(line[:16_384]), 4: " ".join(rng.sample(line, 20_000))}
    assert query_drops(spark, tmp_path, docs) == {(1, 0), (3, 0)}


def test_line_dedup_clashing_names(spark):
    """A caller's columns may have any name."""
    rows = [(1, "one two three four five\nsix", "x", 1), (2, "one two three four five\nseven", "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, own_0 string, OWN_1 int").withColumns({c: F.lit(1) for c in ("k", "th", "line", "at", "id", "ps", "n")})
    out = linededup.deduplicate(df)
    assert out.columns == df.columns and {r["text"] for r in out.collect()} == {rows[0][1], "seven"}


def test_line_dedup_short_lines(spark, tmp_path):
    """Equal lines of one to four words go but for the first; different ones and blank ones stay."""
    docs = {0: "Menu\nhome page\n\nread more about us\n--", 1: "\nmenu!\nhome pages\nRead more about us\n--", 2: "home, page\nread more about them"}
    assert query_drops(spark, tmp_path, docs) == {(1, 1), (1, 3), (2, 0)}
    assert [linededup.least_words(x) for x in (0.8, 0.9, 0.5)] == [4, 9, 1]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, x):
    d = re.sub("[^0-9]", "", x)
    luhn = sum(int(c) if i % 2 == 0 else (int(c) * 2 if int(c) < 5 else int(c) * 2 - 9) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in x.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


def base_spans(t):
    return [f"{k}:{m.start()}:{m.end()}" for k in PATTERNS for m in re.finditer(PATTERNS[k], t or "") if passes(k, m[0])]


def test_pii(spark, docs, texts, odd, empty):
    rng = random.Random(7)
    made = {-i: "".join(rng.choice("0123456789.+@- ()ab%_é") for _ in range(80)) for i in range(1, 400)}
    made |= {-1000: "a@b.c_x@d.e a@b a@@b.c .@-.-", -1001: "1.2.3.4.5.6.7.8 001.2.3.255 256.1.1.1 0000255.1.1.1 1.2.3", -1002: "4111 1111 1111 1111-2", -1003: "😀 +1 (555) 123-4567. 😀 x@y.zz", -1004: "9" * 30_000, -1005: "a" * 30_000 + "@"}
    every = docs.select("doc_id", "text").union(spark.createDataFrame([*made.items()], "doc_id long, text string"))
    model = pii.train(spark)
    rows = pii.digest(pii.detect(every, model)).collect()
    for r in rows:
        want = base_spans({**texts, **made}[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), r["doc_id"]
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(x.startswith(k + ":") for x in want) for k in PATTERNS]
        assert set(want) <= set(r["spans"].split(",")) | {""}
    extra = spark.createDataFrame([(1, "call me at (415) 555-2671. card 378282246310005 ok"), (2, "write to jane [at] mail [dot] org please"), (3, "server 2001:db8:85a3::8a2e:370:7334"), (4, "on 2024-01-02 at 12:30:45, version 1.2.3, isbn 9783161484100")], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(pii.detect(extra, model)).collect()}
    assert "phone:11:25" in spans[1] and "card:32:47" in spans[1] and "email:" in spans[2] and "ip:7:" in spans[3] and spans[4] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(odd, model).collect()}
    assert clean[9] == "<|im_end|> [CARD] [EMAIL]" and clean[0] is None and clean[3] == "word"
    assert pii.redact(odd, model).columns == odd.columns and pii.detect(empty, model).count() == 0


def test_pii_beside_other_digits(spark):
    """Numbers in lists and beside other digits are found whole, each by itself."""
    want = {
        "order 12 378282246310005": {"378282246310005"},
        "tel 415-555-2671 415-555-9999": {"415-555-2671", "415-555-9999"},
        "room 2024 (415) 555-2671": {"(415) 555-2671"},
        "(415) 555-2671 (415) 555-9999 (212) 555-1234": {"(415) 555-2671", "(415) 555-9999", "(212) 555-1234"},
    }
    rows = list(enumerate([*want, "7 " * 3000]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.digest(pii.detect(df, pii.train(spark))).collect()}
    for i, t in rows[:-1]:
        assert {t[int(a) : int(b)] for _, a, b in (x.split(":") for x in found[i].split(","))} == want[t], t
    proposed = df.filter("doc_id = 1").select(F.transform(pii.proposals(F.col("text"), "phone"), lambda m: m["value"]).alias("p")).first()["p"]
    assert {"415-555-2671", "555-2671 415", "415-555-2671 415", "415-555-9999"} <= set(proposed)


def test_pii_kinds_compete(spark):
    """A number is one thing: of proposals that overlap only the best one of all kinds is added."""
    df = spark.createDataFrame([(1, "my card is 4222222222222 ok"), (2, "call 4111111111116 now"), (3, "tel 415-555-2671, card 378282246310005"), (4, None)], "doc_id long, text string")
    found = {r["doc_id"]: [x.split(":") for x in r["spans"].split(",") if x] for r in pii.digest(pii.detect(df, pii.train(spark))).collect()}
    for spans in found.values():
        ranges = sorted((int(a), int(b)) for _, a, b in spans)
        assert all(b <= c for (_, b), (c, _) in zip(ranges, ranges[1:]))
    assert ["card", "11", "24"] in found[1] and len(found[1]) == 1 and len(found[2]) == 1 and found[4] == []
    assert [k for k, _, _ in found[3]] == ["card", "phone"]


#: Sentences in formats and words that the generated examples don't have: (text, kind, value), or no kind.
FOREIGN = [
    ("you can ring 030 2345 6789 after five", "phone", "030 2345 6789"),
    ("Phone 617.555.0142 x", "phone", "617.555.0142"),
    ("our fax (020) 7946 0958 is on", "phone", "(020) 7946 0958"),
    ("Appel 01 23 45 67 89 merci", "phone", "01 23 45 67 89"),
    ("mobile 07700 900 123", "phone", "07700 900 123"),
    ("Amex 3714 496353 98431 exp", "card", "3714 496353 98431"),
    ("paid by credit card 371449635398431", "card", "371449635398431"),
    ("old visa 4222 222 222 222 there", "card", "4222 222 222 222"),
    ("host fd12:3456:789a:1::1 up", "ip", "fd12:3456:789a:1::1"),
    ("ping 2607:f8b0:4005:805::200e twice", "ip", "2607:f8b0:4005:805::200e"),
    ("mail support (at) shop [dot] example please", "email", "support (at) shop [dot] example"),
    ("reach bob.smith[at]firm.co.uk today", "email", "bob.smith[at]firm.co.uk"),
    ("from 1914-1918 to 1939-1945 in all", None, ""),
    ("ISBN 978-3-16-148410-0 in print", None, ""),
    ("the ratio was 12:30:15 at noon", None, ""),
    ("we met at noon. Then we left", None, ""),
    ("price 1,234,567.89 or 12.50", None, ""),
    ("version 10.4.2.1-rc on 03/04/2021", None, ""),
    ("order 20240315001234 shipped", None, ""),
    ("a::b and std::vector", None, ""),
]


def test_pii_foreign_formats(spark):
    """Added spans on formats that no generated example has."""
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(FOREIGN)], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.digest(pii.detect(df, pii.train(spark))).collect()}
    right, wrong, due = Counter(), Counter(), Counter(k for _, k, _ in FOREIGN if k)
    for i, (t, kind, value) in enumerate(FOREIGN):
        for span in filter(None, found[i].split(",")):
            k, a, b = span.split(":")
            (right if (k, t[int(a) : int(b)]) == (kind, value) else wrong)[k] += 1
    print("right", dict(right), "wrong", dict(wrong), "of", dict(due), found)
    assert sum(right.values()) >= 0.7 * sum(due.values()) and sum(wrong.values()) <= 0.2 * sum(right.values())


# ---------------------------------------------------------------------------------- op9

def test_toxicity(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in registry.op9_toxicity(spark, sf).collect() if r["doc_id"] in labels and r["held_out"]]
    right = [r for r in rows if r["predicted"] == labels[r["doc_id"]]]
    assert len(right) >= 0.9 * len(rows) and not any(r["predicted"] for r in rows if not labels[r["doc_id"]])
    model = toxicity.Model(-1.0, {(b"word", 1): 2.0})
    got = toxicity.score_documents(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_documents(empty, model).count() == 0
    assert toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int")).weights == {}


def test_counterfactuals():
    rng = random.Random(3)
    fill = [f"w{i}" for i in range(50)]
    docs, labels = [], []
    for i in range(600):
        own = rng.sample(fill, 8)
        toxic = i % 4 == 0
        if toxic:
            own.append("vile")
        if rng.random() < (0.6 if toxic else 0.1):
            own.append("muslims")  # a group that toxic texts name more often
        docs.append(" ".join(sorted(own)).encode())
        labels.append(int(toxic))
    plain, fair = (toxicity.fit(docs, labels, penalty=p) for p in (0.0, 20.0))
    text = "neutral words about muslims today"
    gap = lambda m: m.score(text) - m.score(text.replace("muslims", "christians"))
    assert gap(plain) > 0.01 and abs(gap(fair)) < 0.2 * gap(plain)
    assert fair.score("so vile") > 0.5 > fair.score(text)


# ---------------------------------------------------------------------------------- op10

def parse_phrases(text, known):
    """Greedy longest phrases, by substring search."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in known:
            j += 1
        i, n = max(j - 1, i + 1), n + 1
    return n


def test_phrases_against_substring_search():
    rng = random.Random(2)
    known = tuple((name, "".join(rng.choice(letters + " ") for _ in range(300)).strip()) for name, letters in (("a", "abcd"), ("b", "bcde")))
    known = tuple((n, re.sub(" +", " ", t)) for n, t in known)
    p = langid.Parser(known, 50)
    texts = ["".join(rng.choice("abcdexé ") for _ in range(rng.randrange(1, 200))) for _ in range(80)]
    got = p.phrases([p.symbols(t) for t in texts])
    for t, row in zip(texts, got.tolist()):
        clean = re.sub(" +", " ", t)
        if not clean.strip():
            assert row == [0, 0]
            continue
        clean = clean.replace("x", "\0").replace("é", "\1")  # letters that no language knows
        want = [sum(parse_phrases(clean[i : i + langid.BLOCK], k) for i in range(0, len(clean), langid.BLOCK)) for _, k in known]
        assert row == want


def test_language(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in registry.op10_language(spark, sf).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.98 * len(rows)
    model = (("en", "the cat sat on the mat"), ("fr", "le chat est sur le tapis"))
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert {got[i]["lang_pred"] for i in (0, 1, 2, 8)} == {"und"} and got[0]["score"] == 0.0
    assert langid.predict(odd, ()).filter("lang_pred <> 'und'").count() == 0
    assert langid.predict(empty, model).count() == 0 and langid.train(empty) == ()
    assert langid.normal("Été,  2 cafés!") == "été cafés "


def test_language_marks_alone(spark):
    """A text of combining marks and no letter is undetermined."""
    docs = spark.createDataFrame([(i, "the cat sat on the mat", "en") for i in range(12)] + [(20, "\u0301\u0301 \u0300", "en"), (21, "e\u0301", "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, langid.train(docs)).collect()}
    assert got[20] == ("und", 0.0) and got[21][0] == "en"


def test_language_many_letters_and_languages(spark):
    """Every letter has a symbol, above the basic plane too, and every language is learned."""
    rng = random.Random(4)
    alphabets = {f"l{i:02d}": [chr(0x4E00 + 40 * i + j) for j in range(40)] for i in range(70)} | {"zz": [chr(0x20000 + j) for j in range(40)]}
    say = lambda name: "".join(rng.choice(alphabets[name]) for _ in range(60))
    rows = [(k, say(name), name) for k, name in enumerate(sorted(alphabets) * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert [name for name, _ in model] == sorted(alphabets)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, model).collect()}
    assert got == {k: name for k, _, name in rows}
    parsers = [langid.Parser(model, None, dense) for dense in (0, 1 << 20, 1 << 30)]
    assert parsers[0].near == 2 and parsers[2].near == parsers[2].size
    texts = [p.symbols(" ".join(t for _, t, _ in rows[:5])) for p in parsers]
    assert len({p.phrases([t]).tobytes() for p, t in zip(parsers, texts)}) == 1


def test_fold(spark):
    got = spark.range(50).select("id", fold(F.col("id"), 7).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 7 for r in got)
