"""Exact byte-pair encoding of whole tables by per-prefix dynamic programming (problem 7).

A text is cut by the vocabulary's own split pattern. Within a piece every prefix has exactly one last token in the
encoding of that prefix: among the vocabulary entries that end there (found by an automaton with suffix links), it is the
one whose start is itself reachable and that is compatible with the last token of the prefix before it. A pair of tokens
is compatible if encoding their joined bytes gives the pair back. Following the stored last tokens backwards
from the end of the piece gives its ids, the same as merging by rank would, in time linear in the piece's length.

Defined results: null and empty texts give an empty list; blank texts give the tokens of their white space; strings that
look like special tokens are ordinary text; repeated rows are encoded each; texts of any length are encoded whole.
Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabularies are; every entry point takes another folder.
TOKENIZER_DIR = "/opt/tokenizers"
#: The vocabulary of the stated query, as ranks.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered per Python worker; when full, the memory starts anew, which changes speed only.
REMEMBERED = 300_000
#: Rows per Arrow batch handed back to Spark.
_ENCODERS: dict[str, "PrefixEncoder"] = {}


class PrefixEncoder:
    """Encoder of one rank file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.word = {v: k for k, v in self.rank.items()}
        self.find = regex.compile(SPLIT).findall
        self.memory: dict[str, list[int]] = {}
        self.compatible: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()

    def merge(self, data: bytes) -> list[int]:
        """Encoding of a short byte string by merging the lowest rank first; the definition the tests compare with."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            low, at = min(((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if low == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 4_000_000:
                self.compatible.clear()
            known = self.compatible[key] = self.merge(self.word[left] + self.word[right]) == [left, right]
        return known

    def piece(self, text: str) -> list[int]:
        """Ids of one piece of the split."""
        data = text.encode("utf-8")
        whole = self.rank.get(data)
        if whole is not None:
            # An entry of the vocabulary need not be its own encoding; the pair test below would show that.
            if len(data) == 1 or self.merge(data) == [whole]:
                return [whole]
        n = len(data)
        last = [-1] * (n + 1)
        start = [0] * (n + 1)
        compatible = self.compatible
        for end, (rank, size) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - size
            if begin:
                left = last[begin]
                if left < 0:
                    continue
                ok = compatible.get(left << 20 | rank)
                if ok is None:
                    ok = self.fits(left, rank)
                if not ok:
                    continue
            elif size > 1 and not self.alone(rank):
                continue
            last[end] = rank
            start[end] = begin
        ids = []
        at = n
        while at:
            ids.append(last[at])
            at = start[at]
        ids.reverse()
        return ids

    def alone(self, rank: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        key = -1 - rank
        known = self.compatible.get(key)
        if known is None:
            known = self.compatible[key] = self.merge(self.word[rank]) == [rank]
        return known

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memory, out = self.memory, []
        for piece in self.find(text):
            ids = memory.get(piece)
            if ids is None:
                ids = self.piece(piece)
                if len(memory) >= REMEMBERED:
                    memory.clear()
                if len(piece) <= 64:
                    memory[piece] = ids
            out += ids
        return out


def encoder(path: str) -> PrefixEncoder:
    """The worker's encoder of `path`, built once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]


def encode_table(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """Rows (`key`, ids array<int>) of every row of `df`; no shuffle, one Python pass over whole texts."""
    path = os.path.join(tokenizer_dir, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        e = encoder(path)
        for batch in batches:
            flat: list[int] = []
            offsets = [0]
            for value in batch.column(1).to_pylist():
                flat += e.encode(value)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(offsets, dtype=np.int32)), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(df[key].alias("key"), df[text].cast("string").alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def count_table(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """Rows (`keep` columns, n_tokens bigint); null and empty texts have 0 tokens."""
    path = os.path.join(tokenizer_dir, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            n = pa.array([len(e.encode(v)) for v in batch.column(batch.num_columns - 1).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*[df[c] for c in keep], df[text].cast("string").alias("__text")).mapInArrow(run, f"{kinds}, n_tokens bigint")
