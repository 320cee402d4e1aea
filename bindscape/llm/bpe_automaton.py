"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It starts with one state and an arc for each byte. Each merge (a, b -> c), in
order, applies one gadget: the state behind arc a loses its arc b (it is copied first, since other tokens may
lead to the old one), and wherever arc a leaves, an arc c is added that leads where a, b led. What it accepts
is exactly the token sequences that the merges produce, one for each byte string.

With tens of thousands of merges the arcs would fill gigabytes, so the copies are kept as differences: the
state behind each token is (the state copied, the merge at which it was copied) plus the arcs cut since; an
arc c holds (the arc it stands beside, the merge that made it). ``arc`` follows these records and the answers
go to a transition table. ``explicit`` makes the same automaton in full, for small vocabularies and tests.

Encoding a pre-split word is table-driven: each prefix of the word has exactly one live state. From the tokens
that end at a position (a reversed trie lists them) the one whose arc leaves the live state at its start is
taken. Decoding emits the arc labels, the bytes of each token.

A token whose merge finds no path left (dead) can never be made, by merging neither, so it has no arc.

Null text counts as empty and gives no ids; an empty table gives no rows. Special tokens in the text are single ids, as the
library has it. Very long texts are coded whole, in time linear in their words. Repeated rows are coded each by itself,
and only the two columns named are read, so others may have any name. There are no ties: the ids of a text are unique.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Split of a text into words before the merges; fixed by the tokenizer.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Transitions that a worker keeps before it starts its table again.
TABLE_ARCS = 600_000
#: Words whose digested form a worker keeps.
DIGESTED = 400_000


#: The same split for the re module, for texts in which its classes of letters, digits and spaces are the tokenizer's.
#: Its alternatives that start alike keep their order.
QUICK_SPLIT = r" ?[^\W\d_]++| ?\d++|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)++|\s+(?!\S)|\s+"


def char_class(chars) -> str:
    runs: list[list[int]] = []
    for o in sorted(map(ord, chars)):
        if runs and runs[-1][1] == o - 1:
            runs[-1][1] = o
        else:
            runs.append([o, o])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class WordSplit:
    """PRE_SPLIT as the tokenizer's library applies it.

    The modules re and regex know other versions of Unicode than the library. Letters and digits of the regex
    module that Python's tables lack are put to the library once; those it lacks as well (young) are symbols.
    Texts without a character in which re differs (odd, or beyond the basic plane) take re, twice as fast; those without a young
    one take regex as it is; the rest take a pattern that leaves the young ones out.
    """

    def __init__(self):
        from tokenizers.pre_tokenizers import ByteLevel

        every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        letters, digits, spaces = (set(regex.findall(p, every)) for p in (r"\p{L}", r"\p{N}", r"\s"))
        new = [c for c in chain(letters, digits) if unicodedata.category(c) == "Cn"]
        asked = "".join(f" a{c}b 1{c}2" for c in new)
        words = {asked[s:e] for _, (s, e) in ByteLevel(add_prefix_space=False).pre_tokenize_str(asked)}
        young = {c for c in new if f" a{c}b" not in words and f" 1{c}2" not in words}
        odd = young | ((letters - young) ^ set(re.findall(r"[^\W\d_]", every))) | ((digits - young) ^ set(re.findall(r"\d", every))) | (spaces ^ set(re.findall(r"\s", every)))
        self.quick, self.usual = re.compile(QUICK_SPLIT).findall, regex.compile(PRE_SPLIT).findall
        self.odd, self.young = re.compile(f"[{char_class(c for c in odd if c < chr(0x10000))}\U00010000-\U0010ffff]"), young
        ranges = char_class(young)
        self.rare = self.usual
        if young:
            rare = PRE_SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{ranges}])").replace(r"\p{L}+", rf"[\p{{L}}--[{ranges}]]+").replace(r"\p{N}+", rf"[\p{{N}}--[{ranges}]]+")
            self.rare = regex.compile(rare, regex.V1).findall

    def findall(self, text: str) -> list[str]:
        if not self.odd.search(text):
            return self.quick(text)
        return self.usual(text) if self.young.isdisjoint(text) else self.rare(text)


@lru_cache(maxsize=1)
def word_split() -> WordSplit:
    return WordSplit()


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies, by its rule: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class MergeAutomaton:
    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        """labels: the bytes of each token id; merges: (left, right, made) ids in order."""
        self.labels, n = labels, len(labels)
        self.left, self.right, self.born = [0] * n, [0] * n, [0] * n
        self.cut: dict[int, int] = {}
        self.table: dict[int, bool] = {}
        self.dead: set[int] = set()
        for at, (a, b, c) in enumerate(merges, 1):
            if a in self.dead or b in self.dead or not self.arc(a, b, at - 1):
                self.dead.add(c)  # no path a, b is left: the gadget adds no arc
            self.left[c], self.right[c], self.born[c] = a, b, at
            self.cut[a << 32 | b] = at
        self.whole, self.back = {}, {}
        basic = {t for t in range(n) if len(labels[t]) == 1} | {c for _, _, c in merges}
        for t in sorted(basic - self.dead):
            self.whole[labels[t]] = t
            node = self.back
            for byte in reversed(labels[t]):
                node = node.setdefault(byte, {})
            node[-1] = t

    def arc(self, u: int, t: int, until: int) -> bool:
        """Has the state behind token u an arc t once the first `until` merges are applied?"""
        born, cut = self.born, self.cut
        while True:
            if cut.get(u << 32 | t, until + 1) <= until:
                return False
            bu, bt = born[u], born[t]
            if bt >= bu:
                if not bt:
                    return True
                t, until = self.left[t], bt
            else:
                u, until = self.right[u], bu - 1

    def encode(self, word: bytes) -> tuple[int, ...]:
        if (t := self.whole.get(word)) is not None:
            return (t,)
        table, back, n = self.table, self.back, len(word)
        state, start = [-1] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            node, i = back, j
            while i:
                i -= 1
                node = node.get(word[i])
                if node is None:
                    break
                t = node.get(-1)
                if t is not None:
                    if i:
                        key = state[i] << 32 | t
                        ok = table.get(key)
                        if ok is None:
                            if len(table) >= TABLE_ARCS:
                                table.clear()
                            ok = table[key] = self.arc(state[i], t, 1 << 30)
                        if not ok:
                            continue
                    state[j], start[j] = t, i
                    break
        out, j = [], n
        while j:
            out.append(state[j])
            j = start[j]
        return tuple(out[::-1])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


def explicit(labels: list[bytes], merges: list[tuple[int, int, int]]) -> tuple[list[dict[int, int]], int]:
    """The automaton in full: (for each state, its arcs by token, to states; the first state)."""
    states: list[dict[int, int]] = [{t: 0 for t, x in enumerate(labels) if len(x) == 1}]
    for a, b, c in merges:
        led = [(p, arcs[a]) for p, arcs in enumerate(states) if a in arcs]
        beyond = {q: states[q][b] for _, q in led if b in states[q]}
        twin: dict[int, int] = {}
        for q in beyond:
            twin[q] = len(states)
            states.append({t: to for t, to in states[q].items() if t != b})
        old = len(states) - len(twin)
        for q, new in twin.items():  # arcs a lead to the copy without b
            for p, arcs in enumerate(states):
                if arcs.get(a) == q:
                    arcs[a] = new
        source = {new: q for q, new in twin.items()}
        for p, arcs in enumerate(states):
            if a in arcs and arcs[a] >= old and arcs[a] in source:
                arcs[c] = beyond[source[arcs[a]]]
    return states, 0


def unread(spec: dict) -> list[str]:
    """Parts of a tokenizer file that would change ids or texts and that this module does not follow."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    out = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    out += ["model"] if model.get("type", "BPE") != "BPE" else []
    out += ["normalizer"] if spec.get("normalizer") else []
    out += ["pre_tokenizer"] if split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True) else []
    out += ["decoder"] if (spec.get("decoder") or {}).get("type") != "ByteLevel" else []
    flags = ("single_word", "lstrip", "rstrip")
    return out + [f"{k} of {t['content']}" for t in spec.get("added_tokens", []) for k in flags if t.get(k)]


class Tokenizer:
    """Texts to ids and back with a byte-level BPE file. Files that ask for more than vocabulary, merges and plain added tokens are refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if more := unread(spec):
            raise ValueError(f"{path} has parts that are not followed: {', '.join(more)}")
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        labels = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            labels[i] = bytes(alphabet[c] for c in token) if token not in self.special else token.encode()
        for token, i in self.special.items():
            labels[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.automaton = MergeAutomaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.words = word_split()
        self.apart = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.memo = common.Memo(self.word)
        self.both = common.Memo(self.there_and_back)
        self.told = common.Memo(self.decimal_and_back, DIGESTED)
        self.decimal = [str(i).encode() for i in range(len(labels))]

    def word(self, word: str) -> bytes:
        """Ids as native 32-bit integers. A special token never comes out of a split as a word, since texts are cut at them."""
        i = self.special.get(word)
        return array("i", self.automaton.encode(word.encode()) if i is None else [i]).tobytes()

    def there_and_back(self, word: str) -> tuple[bytes, bytes]:
        """Ids of a word and the bytes that these decode to."""
        ids = self.word(word)
        return ids, self.automaton.decode(array("i", ids))

    def decimal_and_back(self, word: str) -> tuple[bytes, str]:
        """Ids of a word in decimal, joined by commas, and what they decode to: labels of a path are the word's bytes, so whole characters."""
        i = self.special.get(word)
        ids = self.automaton.encode(word.encode()) if i is None else (i,)
        back = self.automaton.decode(ids).decode()
        return b",".join(map(self.decimal.__getitem__, ids)), word if back == word else back

    def split(self, text: str) -> list[str]:
        if not self.apart or not any(x in text for x in self.special):
            return self.words.findall(text)
        parts, at = [], 0
        for m in self.apart.finditer(text):
            parts += self.words.findall(text[at : m.start()])
            parts.append(m[0])
            at = m.end()
        return parts + self.words.findall(text[at:])

    def packed(self, text: str) -> bytes:
        """The ids of text as native 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def round_trip(self, text: str) -> tuple[bytes, str]:
        """The ids, packed, and the text that they decode to."""
        ids, back = zip(*map(self.both.__getitem__, self.split(text))) if text else ((), ())
        return b"".join(ids), b"".join(back).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of the decoded text in UTF-8."""
        parts = zip(*map(self.told.__getitem__, self.split(text))) if text else ((), ())
        ids, back = (x.join(p) for x, p in zip((b",", ""), parts))
        return ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids) -> str:
        return self.automaton.decode(ids).decode("utf-8", errors="replace")


def id_lists(packed: list[bytes]) -> pa.ListArray:
    """array<int> of packed ids, without a Python object for each."""
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def tokenizer(path: str) -> Tokenizer:
    return common.held(("bpe", path), lambda: Tokenizer(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row; null text: no ids."""

    def make():
        t = tokenizer(path)
        return lambda b: {"doc_id": b.column(0), "ids": id_lists([t.packed(x or "") for x in b.column(1).to_pylist()])}

    df = common.id_text(docs, id_col, text_col)
    return common.arrow_map(df, make, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) for each row of ids; null ids: empty text. Bytes that are no UTF-8 become U+FFFD."""

    def make():
        t = tokenizer(path)
        return lambda b: {"doc_id": b.column(0), "text": [t.decode(x or ()) for x in b.column(1).to_pylist()]}

    df = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return common.arrow_map(df, make, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, text string")


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the text's ids and what these ids decode to, in one narrow pass."""

    def make():
        t = tokenizer(path)

        def each(b):
            got = [t.round_trip(x or "") for x in b.column(1).to_pylist()]
            return {"doc_id": b.column(0), "ids": id_lists([x for x, _ in got]), "decoded": [x for _, x in got]}

        return each

    df = common.id_text(docs, id_col, text_col)
    return common.arrow_map(df, make, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of what bpe_round_trip gives, taken where it is made: ids and texts stay in the worker."""

    def make():
        t = tokenizer(path)

        def each(b):
            n, ids, decoded = zip(*(t.digest(x or "") for x in b.column(1).to_pylist()), strict=True)
            return {"doc_id": b.column(0), "n_tokens": list(n), "ids_sha256": list(ids), "decoded_sha256": list(decoded)}

        return each

    df = common.id_text(docs, id_col, text_col)
    return common.arrow_map(df, make, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(common.table(spark, sf_dir, "documents"), default_path())
