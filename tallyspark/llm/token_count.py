"""Token counts of a unigram tokenizer, without building the tokens.

A text is cut into words as the tokenizer's word-boundary rule does: a blank
becomes the mark U+2581, a mark is put before a text that starts without one,
and every mark starts a new word.  In a word an Aho-Corasick automaton lists
the vocabulary pieces that end at each character; dynamic programming carries
the best score and the number of pieces of that best path, nothing else.

Ties follow the tokenizer: among paths of equal score into a character the one
whose last piece starts first stays.  A character that is no piece of its own
costs the smallest score of the vocabulary minus 10 and counts as its UTF-8
bytes (byte fallback) or, without fallback, as one token per run.

Words are independent of each other, so a task remembers the counts of up to
``cache`` words.

Vocabulary: any list of (piece, score).  ``zipf_vocabulary`` makes one from a
public sentencepiece file whose own scores are only ranks: log probabilities
by Zipf's law on the rank.  Nothing is trained.

Defined results: null and empty texts have 0 tokens; the whole text counts,
however long its words; repeated rows count alike; extra columns pass through,
and one called like the output column is replaced.
"""

from __future__ import annotations

from math import log

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import with_arrow_columns

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def zipf_vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece file in order; piece ``k`` (from 1) of
    ``n`` has the probability ``1 / (k * H(n))``."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    total = log(sum(1 / k for k in range(1, n + 1)))
    return [(model.id_to_piece(k), -log(k + 1) - total) for k in range(n)]


class Counter:
    """Counts pieces; one per task."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True,
                 cache: int = 1_000_000):
        self.automaton = ahocorasick.Automaton()
        pieces = dict(vocabulary)
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.single = {p for p in pieces if len(p) == 1}
        self.byte_fallback = byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.cache = cache
        self.words: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of the best path through one word."""
        n, single, unknown = len(word), self.single, self.unknown
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        ends_unknown = bytearray(n + 1)
        at = 0  # every character before ``at`` is settled

        def settle(upto: int) -> None:
            nonlocal at
            while at < upto:
                if word[at] not in single:
                    score = best[at] + unknown
                    if best[at + 1] is None or score > best[at + 1]:
                        best[at + 1] = score
                        if self.byte_fallback:
                            more = len(word[at].encode("utf-8", "surrogatepass"))
                        else:
                            more = 0 if ends_unknown[at] else 1
                        count[at + 1] = count[at] + more
                        ends_unknown[at + 1] = 1
                at += 1

        for end, (size, piece) in self.automaton.iter(word):
            settle(end)
            score = best[end + 1 - size] + piece  # longest first: smallest start first
            if best[end + 1] is None or score > best[end + 1]:
                best[end + 1] = score
                count[end + 1] = count[end + 1 - size] + 1
        settle(n)
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        if text[0] != MARK:
            text = MARK + text
        known, total = self.words, 0
        for word in text.split(MARK)[1:]:
            n = known.get(word)
            if n is None:
                if len(known) >= self.cache:
                    known.clear()
                n = self.word(MARK + word)
                if len(word) <= 64:
                    known[word] = n
            total += n
        return total


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], text_col: str = "text",
                 count_col: str = "n_tokens", byte_fallback: bool = True) -> DataFrame:
    """``docs`` with ``count_col`` long."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the tokenizer

    def make():
        counter = Counter(shared.value, byte_fallback)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([counter.text(t) for t in batch.column(text_col).to_pylist()], pa.int64())]

        return compute

    return with_arrow_columns(docs, [T.StructField(count_col, T.LongType())], text_col, make)
