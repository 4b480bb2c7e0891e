"""Conversation repair against an exhaustive search, BPE against the tokenizers library; odd input."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from insertframe.llm import bpe, convrepair, registry
from insertframe.llm.common import Stage

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


# ------------------------------------------------------------------------- conversation repair

def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Uniform-cost search over single edits, states being (turns read, initials' automaton): every
    cheapest audit is met, least first."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        for x, name in (("u", "user"), ("a", "assistant")):
            if x in after[state]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, after[state][x], (*out, (name, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                if role[:1] in after[state]:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, after[state][role[:1]], (*out, (role, text))))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if x in after[state]:
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, after[state][x], (*out, (name, text))))


def expected(rows):
    """Of rows (turn, role, text) in order."""
    turns = [t for t, _, _ in rows if t is not None]
    own = [(r, x) for _, r, x in rows]
    faults = faults_of(own)
    cost, audit, out = cheapest(own, faults)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(own, own[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


def damaged(rows):
    """Of rows (conv, turn, role, text), nulls as one space, those of each conversation in order."""
    out = {}
    for c, n, role, text in rows:
        out.setdefault(c, [])
        role, text = " " if role is None else role or " ", " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if n is None else n}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out[c] += [(n, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check(df, rows):
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}
    want = {c: expected(v) for c, v in damaged(rows).items()}
    assert got.keys() == want.keys()
    assert {c: (got[c], want[c]) for c in got if got[c] != want[c]} == {}


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(registry.op11_conversation_repair(spark, SF), rows)


def chats(n, seed):
    r = random.Random(seed)
    roles, said = ["user", "assistant", "system", "tool", "", None, "ü"], ["Yes.", "No!", "a", "", " ", None, "Why?\n", "x.\t", "tail . "]
    weights = [6, 6, 3, 1, 1, 1, 1]
    return [(c if c else None, r.choice([None, k, k, k, 3 * k]), r.choices(roles, weights)[0], r.choice(said) if r.random() < 0.6 else f"t{k}.") for c in range(n) for k in range(r.randrange(1, 14))]


SCHEMA = "conv_id long, turn long, role string, text string, c string, at string, block string"


@pytest.mark.parametrize("bits", [12, 1, 0])
def test_repair_by_brute_force(spark, monkeypatch, bits):
    """Also with blocks of one and two turns, so that conversations are put together from many."""
    monkeypatch.setattr(convrepair, "BLOCK_BITS", bits)
    rows = chats(150, bits)
    df = spark.createDataFrame([(*r, "c", "at", "b") for r in rows], SCHEMA)
    check(convrepair.report(df, convrepair.damage(df)), rows)


def test_long_conversation(spark, monkeypatch):
    """One conversation with nearly all rows: many blocks, equal to the search over the whole."""
    monkeypatch.setattr(convrepair, "BLOCK_BITS", 6)
    r = random.Random(5)
    rows = [(7, k // 2, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b", "", f"{k}.", f"{k}"])) for k in range(1500)] + [(8, 0, "user", "x.")]
    rows += [(7, 5000, "user", "same.")] * 300
    df = spark.createDataFrame([(*x, "c", "at", "b") for x in rows], SCHEMA)
    check(convrepair.report(df, convrepair.damage(df)), rows)


def test_price_against_search():
    r = random.Random(9)
    for _ in range(3000):
        rows = [(r.choice(["user", "assistant", "system", "x"]), "") for _ in range(r.randrange(8))]
        faults = [r.choice(["", "", "", "truncated", "blank"]) for _ in rows]
        ways = convrepair.price([(a[0], f == "blank", f == "truncated") for (a, _), f in zip(rows, faults)], " ")
        got = min((c + 2 * len(convrepair.AFTER[p]), a + "I" * len(convrepair.AFTER[p])) for p, (c, a) in ways.items())
        assert got == cheapest(rows, faults)[:2]


def test_repaired_turns(spark):
    """The operator's own output: turns that keep to the pattern, undamaged ones untouched."""
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    found = convrepair.Repair(convrepair.damage(turns), Stage(spark, "t"))
    out = {}
    for t in sorted(found.turns.collect(), key=lambda t: (t["c"], t["at"], t["part"])):
        out.setdefault(t["c"], []).append(t["role"][0])
    assert all(re.fullmatch("s?(ua)+", "".join(v)) for v in out.values())
    clean = spark.createDataFrame([(1, 0, "user", "A?"), (1, 1, "assistant", "B.")], "conv_id long, turn long, role string, text string")
    kept = convrepair.Repair(convrepair.as_rows(clean), Stage(spark, "t"))
    assert [(t["role"], t["text"], t["edit"]) for t in kept.turns.orderBy("at").collect()] == [("user", "A?", "K"), ("assistant", "B.", "K")]


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert convrepair.report(df, convrepair.damage(df)).collect() == []
    # 0:x drops every turn of this conversation
    n = next(k for k in range(1000) if zlib.crc32(f"1:{k}".encode()) % 20 == 0)
    one = spark.createDataFrame([(1, n, "user", "x.", "", "", "")], SCHEMA)
    assert [tuple(r) for r in convrepair.report(one, convrepair.damage(one)).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# ----------------------------------------------------------------------------------------- BPE

@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return bpe.Encoder(vocabulary)


def same(encoder, decoder, library, texts):
    for t in texts:
        own, ids = encoder.text(t), library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own, "<u4").tolist() == ids, t[:80]
        assert decoder.text(own) == library.decode(ids, skip_special_tokens=False), t[:80]


def test_bpe_on_all_characters(encoder, vocabulary, library):
    letters = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    same(encoder, bpe.Decoder(vocabulary), library, [letters[i : i + 61] for i in range(0, len(letters), 61)])


def test_bpe_on_random_texts(encoder, vocabulary, library):
    r = random.Random(3)
    letters = "aaabbcdeinthrqzxÉéΣσςÀ'1234!?<|/>w  \n日本語한글👍̣́ǅİßﬁ؀ཱི"
    texts = ["".join(r.choices(letters, k=r.randrange(60))) for _ in range(4000)]
    tokens = [s.replace("</w>", "") for s in vocabulary.strings[512:]]
    texts += [r.choice(tokens) + r.choice(tokens) for _ in range(4000)]
    texts += ["<|startoftext|>Hi<|endoftext|>x<|endoftext|", "a<|STARTOFTEXT|>b", "\x00\x1c\x85 \x1f a", "a" * 20_001, "!" * 3000, "ab" * 4000, "é" * 500, "I'LL can't 's's'"]
    same(encoder, bpe.Decoder(vocabulary), library, texts)


def test_bpe_tables_may_be_emptied(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "PAIRS", 8)
    monkeypatch.setattr(bpe, "WORDS", 3)
    same(bpe.Encoder(vocabulary), bpe.Decoder(vocabulary), library, ["several words of several lengths, several times: several words", "thermodynamics xyzzyqq " * 20])


def test_bpe_query(spark, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in registry.op12_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_on_odd_documents(spark, odd, empty, vocabulary, library):
    """Nulls, empty and long texts, repeated rows, clashing names: each row once, in both directions."""
    coded = bpe.encode_documents(odd, vocabulary)
    assert coded.columns == [*odd.columns, "ids"]
    back = bpe.encode_documents(odd, vocabulary, decoded="line")
    assert back.columns == [*odd.columns, "ids"]
    rows = bpe.decode_documents(coded.withColumn("list", bpe.unpack(F.col("ids"))), vocabulary, into="line").collect()
    assert len(rows) == odd.count() and sorted(r["line"] for r in rows) == sorted(r["line"] for r in back.collect())
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["list"] == ids and r["line"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(empty, vocabulary).count() == 0
    none = spark.createDataFrame([(None,), (np.array([70_000, 518], "<u4").tobytes(),)], "ids binary")
    assert [r["decoded"] for r in bpe.decode_documents(none, vocabulary).collect()] == ["", "the</w>"]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
