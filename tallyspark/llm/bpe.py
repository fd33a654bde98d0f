"""Byte-level BPE: exact encoding by backtracking over longest matches, and
decoding through an offset table.

Encoding.  A text is split at the added (special) tokens, then by the
tokenizer's word pattern.  Inside a word a trie of the vocabulary finds the
longest token that starts at a byte.  A left-to-right search takes the longest
token, keeps it only if the pair with the token before it is *compatible* (BPE
applied to the two tokens' bytes would give just these two), otherwise tries
the next shorter token that is a prefix, and steps back when none is left.
Positions found to be dead ends are marked, so each is left at most once:
linear time, and the unique sequence in which all neighbours are compatible is
exactly what the merges give.

Defined results: a null text encodes as an empty list, null ids decode as an
empty text; ids outside the vocabulary decode to nothing; bytes that are not
UTF-8 decode to U+FFFD; whole texts of any length, row by row (no shuffle);
extra columns pass through, and a column already called like an output column
is replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .batches import give_back, with_arrow_columns

#: The byte-level word pattern (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of Latin-1 characters alone, for the faster engine.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_PATTERN = f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_FOREVER = 1 << 60
#: Text that is encoded before its ids go on.
SLICE_BYTES = 2 << 20


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level files:
    itself where Latin-1 prints it, else the next free one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE file (``tokenizers`` JSON) as tables.

    Tokens are numbered by rank inside: bytes 0-255, then the merges in order.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        shown = byte_alphabet()
        byte_of = {c: i for i, c in enumerate(shown)}
        text = list(shown)
        number = {c: i for i, c in enumerate(shown)}
        self.halves: list[tuple[int, int] | None] = [None] * 256
        self.rank: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair = (number[a], number[b])
            number.setdefault(a + b, len(text))
            text.append(a + b)
            self.halves.append(pair)
            self.rank[pair] = len(text) - 1
        self.bytes_of = [bytes(byte_of[c] for c in t) for t in text]
        self.id_of = [model["vocab"].get(t, -1) for t in text]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        by_id = {i: b for b, i in zip(self.bytes_of, self.id_of) if i >= 0}
        by_id.update({i: t.encode() for t, i in self.added.items()})
        sizes = [len(by_id.get(i, b"")) for i in range(max(by_id) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(len(sizes))), np.uint8)


class Remembered(dict):
    """Results by key: two generations of at most ``most`` keys, so that what is
    asked again stays while the rest goes.  Keys longer than 64 are not kept."""

    def __init__(self, compute: Callable, most: int):
        super().__init__()
        self.compute, self.most, self.before = compute, most, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > 64:
                return value
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Encodes texts; one per worker process.  ``cache`` bounds the remembered
    words of a generation and the remembered pairs."""

    def __init__(self, path: str, cache: int = 100_000, pairs: int = 250_000):
        v = self.v = Vocabulary(path)
        self.most_pairs = pairs
        self.words = Remembered(self._ids_of_word, cache)
        self.pairs: dict[int, bool] = {}
        self.id_bytes = [i.to_bytes(4, "little", signed=True) for i in v.id_of]
        self.size = [len(b) for b in v.bytes_of]
        self.most = max(self.size)
        # Bytes as Latin-1 text, which the trie takes.
        latin = [b.decode("latin-1") for b in v.bytes_of]
        self.number = {b: i for i, b in reversed(list(enumerate(latin)))}
        self.shorter = [self._prefix(b, self.number) for b in latin]
        trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for b, i in self.number.items():
            trie.add_word(b, i)
        self.in_trie = trie.longest_prefix
        self.split = regex.compile(PATTERN).findall
        self.split_latin = re.compile(LATIN_PATTERN).findall
        # Characters that this pattern engine does not know yet may be letters
        # for the library: texts with any are split by the library's pattern.
        self.unknown = regex.compile(r"\p{Cn}").search
        self.path = path
        marks = sorted(v.added, key=len, reverse=True)
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None

    @cached_property
    def library(self):
        splitter = Tokenizer.from_file(self.path).pre_tokenizer
        give_back()
        return splitter

    def forget(self) -> None:
        """Drops the remembered words and pairs, so that an idle worker is small."""
        self.words.before = {}
        self.words.clear()
        self.pairs.clear()

    @staticmethod
    def _prefix(b: str, number: dict[str, int]) -> int:
        return next((number[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in number), -1)

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the two tokens apart when they stand side by side.

        Only a merge across the seam can join them.  While the merges run,
        the piece left of the seam climbs ``a``'s right edge and the piece
        right of it climbs ``b``'s left edge, each replaced at the rank of
        the next piece up; a merge across happens if its rank comes before
        both (at equal ranks the left one goes first).
        """
        halves, rank = self.v.halves, self.v.rank
        left, right = [a], [b]
        while halves[left[-1]]:
            left.append(halves[left[-1]][1])
        while halves[right[-1]]:
            right.append(halves[right[-1]][0])
        i, j = len(left) - 1, len(right) - 1
        while True:
            until_left = left[i - 1] if i else _FOREVER
            until_right = right[j - 1] if j else _FOREVER
            across = rank.get((left[i], right[j]), _FOREVER)
            if across < until_left and across <= until_right and across < _FOREVER:
                return False
            if not i and not j:
                return True
            if until_left <= until_right:
                i -= 1
            else:
                j -= 1

    def word(self, data: bytes) -> list[int]:
        """Token numbers of one word, by backtracking."""
        text, n = data.decode("latin-1"), len(data)
        number, size, shorter, pairs = self.number.get, self.size, self.shorter, self.pairs
        token = number(text)
        if token is not None:
            return [token]
        dead: set[int] = set()
        out: list[int] = []
        pos, last = 0, -1
        while pos < n:
            k = self.in_trie(text[pos:pos + self.most])
            token = number(text[pos:pos + k])
            while token is None:  # the trie goes on after the longest token
                k -= 1
                token = number(text[pos:pos + k])
            while True:
                end = pos + size[token]
                if end not in dead:
                    if last < 0:
                        break
                    pair = last << 32 | token
                    good = pairs.get(pair)
                    if good is None:
                        if len(pairs) >= self.most_pairs:
                            pairs.clear()
                        good = pairs[pair] = self.compatible(last, token)
                    if good:
                        break
                token = shorter[token]
                while token < 0:  # no token fits here: this position is a dead end
                    dead.add(pos)
                    token = out.pop()
                    pos -= size[token]
                    last = out[-1] if out else -1
                    token = shorter[token]
            out.append(token)
            pos, last = end, token
        return out

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        if self.at_added is None:
            return self._plain(text)
        parts = self.at_added.split(text)
        return b"".join(np.int32(self.v.added[p]).tobytes() if k % 2 else self._plain(p)
                        for k, p in enumerate(parts))

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if _is_latin(text):
            words = self.split_latin(text)
        elif self.unknown(text):
            words = [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        else:
            words = self.split(text)
        return b"".join(map(self.words.__getitem__, words))

    def _ids_of_word(self, word: str) -> bytes:
        return b"".join(map(self.id_bytes.__getitem__, self.word(word.encode())))


class Decoder:
    """Decodes ids by gathering bytes from one blob through its offset table."""

    def __init__(self, path: str, chunk: int = 500_000):
        v = Vocabulary(path)
        self.blob, self.offsets, self.chunk = v.blob, v.offsets, chunk

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(self._gather(ids[k:k + self.chunk]) for k in range(0, len(ids), self.chunk))

    def _gather(self, ids: np.ndarray) -> bytes:
        ids = ids[(ids >= 0) & (ids < len(self.offsets) - 1)]
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        return self.blob[np.repeat(start - (ends - size), size) + np.arange(ends[-1])].tobytes()


# The tables of the last tokenizer stay in a worker process for its next task.
# What is left of the file, and of the worker's earlier tasks, goes first.
@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    encoder = Encoder(path)
    give_back()
    return encoder


@lru_cache(maxsize=1)
def decoder_of(path: str) -> Decoder:
    decoder = Decoder(path)
    give_back()
    return decoder


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text",
           ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` array<int>: the ids of the whole text."""

    def make():
        encoder = encoder_of(tokenizer_path)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            each = [encoder.ids(t) if t else b"" for t in _texts(batch, text_col)]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in each])]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(
                np.frombuffer(b"".join(each), np.int32)))]

        return compute

    return with_arrow_columns(docs, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))],
                              text_col, make, most_bytes=SLICE_BYTES,
                              end=lambda: encoder_of(tokenizer_path).forget())


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids",
           decoded_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``decoded_col`` string: the text of the ids."""
    keep = [c for c in encoded.columns if c != decoded_col]
    schema = T.StructType([encoded.schema[c] for c in keep]
                          + [T.StructField(decoded_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decoder_of(tokenizer_path)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                lists = batch.column(ids_col)
                flat = np.asarray(lists.flatten().fill_null(-1))
                sizes = np.asarray(pc.list_value_length(lists).fill_null(0))
                ends = np.cumsum(sizes)
                texts = [decoder.bytes_of(flat[e - n:e]).decode("utf-8", "replace")
                         for e, n in zip(ends, sizes)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in keep] + [pa.array(texts, pa.string())],
                    names=schema.fieldNames())
        give_back()

    return encoded.select(*keep).mapInArrow(run, schema)


def _texts(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(name).to_pylist()
