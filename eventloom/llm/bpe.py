"""Byte-pair encoding with a public vocabulary, in time linear in the text.

A text is cut by the tokenizer's pattern; each piece is encoded once and remembered.
A piece is encoded without running merges: bytes are mapped to Latin-1 characters, an
Aho-Corasick automaton gives the longest token that begins at each position, and a
walk takes the longest token whose border to the token before it is one that the
merges could have left standing. Where none fits it backs up, and never visits a
position again from which it had to leave. Whether a border may stand depends on the
two tokens only, so that answer is remembered too.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter of every operator that reads one.
TOKENIZERS = os.environ.get("EVENTLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
# Fixed value: the pattern by which the vocabulary's texts are cut.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII characters only, for the faster engine.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Where a text can't be cut at its spaces: a space that follows white space and doesn't lead a word, or follows two of them.
CROWDED = re.compile(r"\s (?:\s|\Z)|\s\s ").search
#: Remembered words, pieces and borders; when full they are forgotten and gathered anew.
MEMO = 500_000


class ByteBPE:
    """Encoder over ``ranks``: token bytes to id, where the id is the order of merging."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = {token.decode("latin-1"): i for token, i in ranks.items()}
        self.length = {i: len(token) for token, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.borders: dict[int, bool] = {}
        for token, i in sorted(self.ids.items(), key=lambda t: t[1]):
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None and left < i and right < i and self._stands(left, right):
                    self.pairs[left << 20 | right] = i
                    self.parts[i] = (left, right)
                    break
        self.borders.clear()
        self.shorter = self._shorter()
        self.pieces = _Memo(self.encode_piece)
        self.words = _Memo(lambda word: self._cut_and_encode(" " + word))
        self.cut = regex.compile(PATTERN).findall
        self.cut_ascii = re.compile(ASCII_PATTERN).findall

    def _shorter(self) -> dict[int, int]:
        """Of each token the longest other token that it begins with."""
        out = {}
        for token, i in self.ids.items():
            for n in range(len(token) - 1, 0, -1):
                if (j := self.ids.get(token[:n])) is not None:
                    out[i] = j
                    break
        return out

    def _stands(self, left: int, right: int) -> bool:
        """Whether merging would leave the border between two tokens.

        Undo the merges on both sides of the border, latest first: if at any moment the
        two tokens that touch would themselves merge, earlier than the merge undone
        last, the border would have been lost.
        """
        merge_of, parts_of = self.pairs.get, self.parts.get
        before = 1 << 60
        while True:
            if merge_of(left << 20 | right, before) < before:
                return False
            if left > right:
                if (parts := parts_of(left)) is not None:
                    before, left = left, parts[1]
                elif (parts := parts_of(right)) is not None:
                    before, right = right + 1, parts[0]
                else:
                    return True
            # of equal ranks the left occurrence merges first
            elif (parts := parts_of(right)) is not None:
                before, right = right + 1, parts[0]
            elif (parts := parts_of(left)) is not None:
                before, left = left, parts[1]
            else:
                return True

    def border(self, left: int, right: int) -> bool:
        pair = left << 20 | right
        known = self.borders.get(pair)
        if known is None:
            if len(self.borders) >= MEMO:
                self.borders.clear()
            known = self.borders[pair] = self._stands(left, right)
        return known

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Token ids of one piece of the pattern."""
        text = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.ids.get(text)
        if whole is not None:
            return (whole,)
        size = len(text)
        length, shorter, known = self.length, self.shorter, self.borders.get
        longest = [0] * size
        for end, i in self.automaton.iter(text):
            longest[end - length[i] + 1] = i  # ends come in order, so the longest is last
        usable = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while True:
                end = at + length[token]
                if usable[end] and (last < 0 or known(last << 20 | token) or self.border(last, token)):
                    out.append(token)
                    at = end
                    if at == size:
                        return tuple(out)
                    token = longest[at]
                    break
                nearer = shorter.get(token)
                if nearer is None:
                    usable[at] = 0
                    token = out.pop()
                    at -= length[token]
                    break
                token = nearer

    def _cut_and_encode(self, text: str) -> tuple[int, ...]:
        cut = self.cut_ascii if text.isascii() else self.cut
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, cut(text))))

    def parts_of(self, text: str) -> Iterator[tuple[int, ...]]:
        """Ids of the text, in parts. A space before a word belongs to the word whatever
        stands before it, so most texts are cut there first and whole words are looked up."""
        if CROWDED(text):
            cut = self.cut_ascii if text.isascii() else self.cut
            return map(self.pieces.__getitem__, cut(text))
        first, *rest = text.split(" ")
        return chain((self._cut_and_encode(first),), map(self.words.__getitem__, rest))

    def encode_into(self, text: str, into: array) -> None:
        into.extend(chain.from_iterable(self.parts_of(text)))

    def encode(self, text: str | None) -> list[int]:
        """Token ids; of a null or empty text none."""
        out = array("i")
        if text:
            self.encode_into(text, out)
        return out.tolist()

    def count(self, text: str | None) -> int:
        return sum(map(len, self.parts_of(text))) if text else 0


class _Memo(dict):
    """Ids of short strings, made on demand."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> tuple[int, ...]:
        ids = self.make(key)
        if len(key) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[key] = ids
        return ids


@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS, name: str = VOCABULARY) -> ByteBPE:
    """The encoder of a vocabulary, made once per Python worker."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return ByteBPE({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})


def token_ids(docs: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids): each text as token ids, special tokens as ordinary text.

    One row per row of ``docs``, repeated ids included; of a null or empty text the
    list is empty. No shuffle: one Arrow-batched pass, whole texts.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for text in batch.column(1).to_pylist():
                if text:
                    enc.encode_into(text, flat)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(flat), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_counts(docs: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of each text; 0 for null and empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for batch in batches:
            counts = pa.array([enc.count(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")
