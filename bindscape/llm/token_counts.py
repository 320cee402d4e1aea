"""Token counts: a Viterbi pass that carries only the best score and the number of pieces.

The vocabulary is read as a unigram model: pieces with scores. An Aho-Corasick automaton enumerates every
piece that ends at each character, longest first; dynamic programming keeps, for each end, the best score
and its piece count. Tie rule of the unigram tokenizer: a candidate replaces the kept one only if its score
is strictly higher, candidates come by rising start, so of equal paths into an end the one whose last piece
is longest stays. A character that no single piece covers may also be an unknown at (lowest score - 10);
with byte fallback it counts as its UTF-8 bytes.

Scores are integers in the vocabulary used, so double sums are exact and a text can be cut wherever no piece
crosses: before each run of the space mark and around characters that stand in no piece. Each segment is
then solved once per worker memo and the counts add up.

Null text counts as empty: 0 pieces. An empty text has 0 pieces too, an empty table no rows. Very long texts are counted
whole, segment by segment. Repeated rows are counted each by itself, and only the two columns named are read, whatever
else the table holds.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((sp.IdToPiece(i), sp.GetScore(i)) for i in range(sp.GetPieceSize()))


class CountViterbi:
    """Piece counts under a unigram vocabulary."""

    def __init__(self, pieces: tuple[tuple[str, float], ...]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes_known = {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in pieces}
        exact = all(float(s).is_integer() for _, s in pieces)
        if not exact or any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces):
            self.cut = re.compile(r"(?s).+")  # a piece may cross any place: solve each text whole
        else:
            alone = "".join(re.escape(c) for c in "\n\t\r\x0b\x0c" if not any(c in p for p, _ in pieces))
            self.cut = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+") if alone else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.memo = common.Memo(self.solve)

    def solve(self, s: str) -> tuple[int, float]:
        """(pieces, score) of the best path over s."""
        n, unknown = len(s), self.unknown
        best, count = [0.0] + [None] * n, [0] * (n + 1)
        found = self.automaton.iter(s)
        end, match = next(found, (n, None))
        for e in range(n):
            top, pieces, single = None, 0, False
            while end == e:
                length, score = match
                single = single or length == 1
                if (before := best[e + 1 - length]) is not None and (top is None or before + score > top):
                    top, pieces = before + score, count[e + 1 - length] + 1
                end, match = next(found, (n, None))
            if not single and (top is None or best[e] + unknown > top):
                top, pieces = best[e] + unknown, count[e] + (len(s[e].encode()) if self.bytes_known else 1)
            best[e + 1], count[e + 1] = top, pieces
        return count[n], best[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        memo = self.memo
        return sum([memo[x][0] for x in self.cut.findall(SPACE + text.replace(" ", SPACE))])


def counter_of(path: str) -> CountViterbi:
    return common.held(("counts", path), lambda: CountViterbi(vocabulary(path)))


def token_counts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) for each row of docs; a narrow pass, no shuffle."""

    def make():
        counter = counter_of(vocab_path)
        return lambda batch: {"doc_id": batch.column(0), "n_tokens": pa.array([counter.count(t) for t in batch.column(1).to_pylist()], pa.int64())}

    df = common.id_text(docs, id_col, text_col)
    return common.arrow_map(df, make, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"), default_vocab())
