"""Very long texts, ties and fractional vocabularies."""

import random
import struct
import zlib

import pytest

from bindscape.llm import bpe_automaton as B
from bindscape.llm import cgk_decontam as D
from bindscape.llm import license_scan as L
from bindscape.llm import link_trust as U
from bindscape.llm import token_counts as C
from bindscape.llm import token_records as R


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("etaoinshrdluéß漢") for _ in range(rng.randrange(1, 12)))
    return [" ".join(word() for _ in range(60_000)), "a" * 40_000, " \n" * 50_000, "漢字" * 30_000, "x" * 3000 + "<|endoftext|>" + "y z " * 20_000]


def test_long_texts_of_tokenizers(spark, long_texts):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    library = Tokenizer.from_file(B.default_path())
    docs = spark.createDataFrame(list(enumerate(long_texts)), "doc_id long, text string")
    want = [library.encode(t, add_special_tokens=False).ids for t in long_texts]
    for r in B.bpe_round_trip(docs, B.default_path()).collect():
        assert r["ids"] == want[r["doc_id"]] and r["decoded"] == long_texts[r["doc_id"]]
    for r in R.read_records(R.write_records(docs, B.default_path())).collect():
        assert r["ids"] == struct.pack(f"<{len(want[r['doc_id']]) + 1}I", *want[r["doc_id"]], 0) and zlib.crc32(r["ids"])
    unigram = Unigram([tuple(x) for x in C.vocabulary(C.default_vocab())], unk_id=0, byte_fallback=True)
    for r in C.token_counts(docs, C.default_vocab()).collect():
        assert r["n_tokens"] == len(unigram.tokenize(C.SPACE + long_texts[r["doc_id"]].replace(" ", C.SPACE)))


def test_long_texts_of_scans(spark, long_texts):
    notice = L.TEMPLATES[5][2]
    item = "the quick brown fox jumps over the lazy dog and runs far away from here"
    docs = spark.createDataFrame([(k, f"{t} {notice} {item} {t}") for k, t in enumerate(long_texts)], "doc_id long, text string")
    assert {(r["doc_id"], r["license"], r["containment"]) for r in L.license_scan(docs).collect()} >= {(k, "Apache-2.0", 1.0) for k in range(len(long_texts))}
    bench = spark.createDataFrame([(1, item), (2, "q" * 30), (3, item.replace("lazy", "lasy"))], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["distance"]) for r in D.contaminated(docs, bench).collect()}
    assert found == {(k, i, d) for k in range(len(long_texts)) for i, d in ((1, 0), (3, 1))}
    assert found == {(r["doc_id"], r["item_id"], r["distance"]) for r in D.contaminated(docs.where("doc_id > 0"), bench, exact=True).collect()} | {x for x in found if x[0] == 0}


def test_long_pages(spark):
    """A page of a million links and a url of a hundred thousand characters."""
    html = '<a href="http://bad.net/x">b</a>' * 50_000
    pages = spark.createDataFrame([(1, "http://long.org/" + "a" * 100_000, html), (2, "http://bad.net/es/", None), (3, "http://bad.net/es/1", None)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], len(r["path"]), r["verdict"]) for r in U.judge(pages).collect()}
    assert got == {1: ("long.org", 100_001, "block"), 2: ("bad.net", 4, "block"), 3: ("bad.net", 5, "block")}


def test_equal_shares_of_licenses():
    """Two templates of one license that a text holds whole: the first window of the smaller class is told."""
    scan = L.Scanner((("A", "x", "one two three four five"), ("A", "y", "six seven eight nine ten eleven twelve"))).scan
    got = scan("z six seven eight nine ten eleven twelve z one two three four five")
    assert got["A"][:2] == ("x", 1.0) and got == scan("z six seven eight nine ten eleven twelve z one two three four five")


def test_fractional_scores():
    """A true unigram vocabulary, with scores that are no whole numbers and pieces across the space mark."""
    from tokenizers.models import Unigram

    rng = random.Random(21)
    for _ in range(100):
        names = {"".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 5))) for _ in range(10)} | {"a", "b", "▁"}
        pieces = [("<unk>", 0.0)] + [(p, -rng.uniform(0.5, 9)) for p in sorted(names)]
        mine, theirs = C.CountViterbi(tuple(pieces)), Unigram(pieces, unk_id=0, byte_fallback=False)
        text = "".join(rng.choice("ab ") for _ in range(60))
        assert mine.count(text) == len(theirs.tokenize(C.SPACE + text.replace(" ", C.SPACE))), (pieces, text)
