"""Token counts, BPE automaton and token records against the public libraries."""

import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from bindscape.llm import bpe_automaton as B
from bindscape.llm import token_counts as C
from bindscape.llm import token_records as R

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "   x", "a\n\n b\t c  ", "it's we'LL 12,345 ½ Ⅷ", "naïve über 漢字 🙂🙂", "<|endoftext|>x<|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaa", "--------========", "\x00​́", "x" * 5000, "▁▁ ▁", "<0x0A><s></s>"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(B.default_path())


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(ODD)] + [(None, "no id", "", ""), (3, ODD[3], "", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string")


def test_bpe_like_library(library):
    t, rng = B.tokenizer(B.default_path()), random.Random(5)
    words = [w for x in ODD if x for w in x.split()]
    texts = [x or "" for x in ODD] + ["".join(rng.choice("abcdehilnorst  \n.'é–漢") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(rng.choice(["the", "ing", "aa", " ", "0", "tion", rng.choice(words)]) for _ in range(20)) for _ in range(500)]
    for x in texts:
        ids = library.encode(x, add_special_tokens=False).ids
        assert t.encode(x) == ids, x
        assert t.decode(ids) == library.decode(ids, skip_special_tokens=False)
    whole = random.Random(6).sample(range(50257), 3000)
    assert all(t.decode(library.encode(library.decode([i], skip_special_tokens=False), add_special_tokens=False).ids) == library.decode([i], skip_special_tokens=False) for i in whole)


def test_pre_split_like_library(library):
    """Every character of Unicode, between letters and digits: the same words from our pattern as from the library."""
    words = B.word_split()
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(chars), 64):
        part = chars[k : k + 64]
        for x in (" ".join(f"a{c}b 1{c}2{c}" for c in part), *(f"a{c}b 1{c}2{c}" for c in part[:: 1 if k < 0x3000 else 64])):
            got = [x[s:e] for _, (s, e) in library.pre_tokenizer.pre_tokenize_str(x)]
            assert got == words.findall(x), hex(ord(part[0]))


def test_gadgets_in_full():
    """The compact automaton has exactly the arcs that the gadgets build, and accepts what merging gives."""
    rng, dead = random.Random(1), 0
    for _ in range(400):
        labels, merges = [bytes([x]) for x in b"abc"], []
        while len(merges) < 9:
            a, b = rng.randrange(len(labels)), rng.randrange(len(labels))
            if labels[a] + labels[b] not in labels:
                merges.append((a, b, len(labels)))
                labels.append(labels[a] + labels[b])
        auto = B.MergeAutomaton(labels, merges)
        states, first = B.explicit(labels, merges)

        def merged(word):
            ids = [labels.index(bytes([x])) for x in word]
            for a, b, c in merges:
                out, i = [], 0
                while i < len(ids):
                    if ids[i : i + 2] == [a, b]:
                        out.append(c)
                        i += 2
                    else:
                        out.append(ids[i])
                        i += 1
                ids = out
            return ids

        dead += len(auto.dead)
        for word in [labels[c] for c in auto.dead] + [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14))) for _ in range(60)]:
            ids = merged(word)
            assert list(auto.encode(word)) == ids and auto.dead.isdisjoint(ids), (labels, merges, word)
            at = first
            for t in ids:
                assert t in states[at], (labels, merges, word, ids)
                at = states[at][t]
    assert dead > 50


def test_bpe_query(spark, library, odd):
    got = {(r["doc_id"], r["decoded"]): r for r in B.bpe_round_trip(odd, B.default_path()).collect()}
    for i, x in enumerate(ODD):
        assert got[i, x or ""]["ids"] == library.encode(x or "", add_special_tokens=False).ids
    assert B.bpe_digests(odd.limit(0), B.default_path()).collect() == [] and B.bpe_round_trip(odd.limit(0), B.default_path()).collect() == []
    back = B.bpe_decode(B.bpe_encode(odd, B.default_path()), B.default_path())
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in back.collect()) == sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in odd.collect())
    import hashlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in B.op4_bpe(spark, SF).collect():
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.fixture(scope="module")
def unigram():
    from tokenizers.models import Unigram

    return Unigram([tuple(x) for x in C.vocabulary(C.default_vocab())], unk_id=0, byte_fallback=True)


def test_counts_like_library(spark, unigram, odd):
    counter, rng = C.CountViterbi(C.vocabulary(C.default_vocab())), random.Random(3)
    texts = [x or "" for x in ODD] + ["".join(rng.choice("abcdehilnorst  \n.'é–漢") for _ in range(rng.randrange(80))) for _ in range(1500)]
    for x in texts:
        assert counter.count(x) == (len(unigram.tokenize(C.SPACE + x.replace(" ", C.SPACE))) if x else 0), x
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]) for r in C.token_counts(odd, C.default_vocab()).collect())
    assert got == sorted([(i, counter.count(x or "")) for i, x in enumerate(ODD)] + [(-1, counter.count("no id")), (3, counter.count(ODD[3]))])
    assert C.token_counts(odd.limit(0), C.default_vocab()).collect() == []
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in C.op1_token_counts(spark, SF).collect():
        assert r["n_tokens"] == len(unigram.tokenize(C.SPACE + docs[r["doc_id"]].replace(" ", C.SPACE)))


def test_counts_ties():
    """Equal scores: the path whose last piece is longer stays, as the tokenizer has it."""
    from tokenizers.models import Unigram

    rng = random.Random(9)
    for _ in range(200):
        pieces = [("<unk>", 0.0)] + [(p, float(-rng.randrange(1, 4))) for p in {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for _ in range(8)}]
        mine, theirs = C.CountViterbi(tuple(pieces)), Unigram(pieces, unk_id=0, byte_fallback=False)
        word = "".join(rng.choice("abc") for _ in range(12))
        tokens = theirs.tokenize(word)
        fused = sum(len(t.value) if t.id == 0 and set(t.value) == {"c"} else 1 for t in tokens)
        if all(len(t.value) == 1 or t.id for t in tokens):
            assert mine.solve(word)[0] == fused, (pieces, word)


def test_records(spark, library, odd):
    index = R.with_starts(R.write_records(odd, B.default_path()))
    rows = sorted(index.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 0, 1, 2, 3, 3, *range(4, len(ODD))]
    want = {i: library.encode(x or "", add_special_tokens=False).ids + [0] for i, x in enumerate(ODD)}
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    back = R.read_records(index.orderBy(F.rand(3))).collect()  # a shuffled read
    assert len(back) == len(rows)
    for r in back:
        if r["doc_id"] is not None:
            assert list(struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"])) == want[r["doc_id"]]
    assert R.with_starts(R.write_records(odd.limit(0), B.default_path())).collect() == []


def test_records_checked():
    import numpy as np

    record = R.frame(7, np.array([1, 2, 65535]), False)
    assert R.unframe(record)[0] == 7 and list(R.unframe(record)[1]) == [1, 2, 65535]
    assert list(R.unframe(R.frame(None, np.array([70000]), True))[1]) == [70000]
    for k in range(len(record)):
        bad = bytearray(record)
        bad[k] ^= 1
        with pytest.raises((ValueError, struct.error)):
            R.unframe(bytes(bad))


def test_records_query(spark, library):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in R.op2_token_records(spark, SF).collect()}
    start = 0
    for doc_id, text in docs:
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_unread_parts_are_refused(tmp_path):
    """A file with parts that the automaton does not follow is refused by name, not coded wrongly."""
    with open(B.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    assert B.unread(spec) == []
    small = {**spec, "model": {**spec["model"], "vocab": {c: i for i, c in enumerate(B.byte_alphabet())}, "merges": []}, "added_tokens": [{**spec["added_tokens"][0], "id": 300}]}
    changes = {
        "normalizer": {"normalizer": {"type": "NFC"}},
        "pre_tokenizer": {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}},
        "decoder": {"decoder": None},
        "ignore_merges": {"model": {**small["model"], "ignore_merges": True}},
        "lstrip": {"added_tokens": [{**small["added_tokens"][0], "lstrip": True}]},
    }
    path = tmp_path / "t.json"
    path.write_text(json.dumps(small), encoding="utf-8")
    assert len(B.Tokenizer(str(path)).word("abc")) == 12
    for name, change in changes.items():
        path.write_text(json.dumps({**small, **change}), encoding="utf-8")
        with pytest.raises(ValueError, match=name):
            B.Tokenizer(str(path))
