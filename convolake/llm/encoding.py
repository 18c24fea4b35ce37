"""Encoding a corpus with a public byte-level BPE tokenizer, and decoding it again.

Texts travel as Arrow batches. Where the file's own pre-tokenizer is that of PATTERN and nothing is normalised, a text is
first cut into its pre-tokens; no merge ever crosses their borders, so the ids of a text are those of its pre-tokens one after
another. Each distinct pre-token of a worker's recent input is encoded once by the tokenizers library and kept in a bounded
dictionary. Texts of any other tokenizer file are encoded whole by the library.

A null or an empty text has the empty list of ids. Strings that look like special tokens are plain text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BYTE_BPE = f"{FOLDER}/byte_bpe_50k.json"
#: Pre-tokens longer than this are not kept, and at most so many are: about 100 MB a worker.
KEPT_CHARS, KEPT = 64, 400_000
#: An Arrow batch that goes back has about so many ids.
BATCH_IDS = 1_000_000

# White space of Unicode, and the pattern of the vocabulary with it spelled out.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


class Encoder:
    """One vocabulary in one worker process."""

    _of: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        about = json.loads(self.lib.to_str())
        own = about.get("pre_tokenizer") or {}
        #: Whether texts may be cut by PATTERN, and whether tokens are spelled in the byte table.
        self.bytewise = own.get("type") == "ByteLevel" and not own.get("add_prefix_space")
        by_pattern = self.bytewise and own.get("use_regex", True) and not about.get("normalizer") and not about.get("truncation") and not about.get("padding")
        self.split = regex.compile(PATTERN).findall if by_pattern else None
        self.ids_of: dict[str, tuple[int, ...]] = {}
        self.size_of: dict[str, int] = {}
        self._bytes: dict[int, bytes] | None = None

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _learn(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of words that are not kept; those that are long or rare enough to fall out come back in the answer only."""
        return {w: tuple(e.ids) for w, e in zip(words, self.lib.encode_batch_fast(words, add_special_tokens=False))}

    def ids(self, texts: list[str | None]) -> Iterator[list[int]]:
        for text in texts:
            if not text:
                yield []
                continue
            if self.split is None:
                yield self.lib.encode(text, add_special_tokens=False).ids
                continue
            words = self.split(text)
            try:
                yield list(chain.from_iterable(map(self.ids_of.__getitem__, words)))
            except KeyError:
                new = self._learn([w for w in set(words) if w not in self.ids_of])
                out = [new[w] if w in new else self.ids_of[w] for w in words]
                if len(self.ids_of) + len(new) > KEPT:
                    self.ids_of.clear()
                self.ids_of |= {w: i for w, i in new.items() if len(w) <= KEPT_CHARS}
                yield list(chain.from_iterable(out))

    def sizes(self, texts: list[str | None]) -> Iterator[int]:
        for text in texts:
            if not text:
                yield 0
                continue
            if self.split is None:
                yield len(self.lib.encode(text, add_special_tokens=False).ids)
                continue
            words = self.split(text)
            try:
                yield sum(map(self.size_of.__getitem__, words))
            except KeyError:
                new = {w: len(i) for w, i in self._learn([w for w in set(words) if w not in self.size_of]).items()}
                yield sum(new[w] if w in new else self.size_of[w] for w in words)
                if len(self.size_of) + len(new) > KEPT:
                    self.size_of.clear()
                self.size_of |= {w: n for w, n in new.items() if len(w) <= KEPT_CHARS}

    def bytes_of(self) -> dict[int, bytes]:
        """The bytes of every id, by the byte table of byte-level BPE reversed."""
        if self._bytes is None:
            table = char_of_byte()
            back = {c: b for b, c in table.items()}
            self._bytes = {i: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for s, i in self.lib.get_vocab(with_added_tokens=True).items()}
        return self._bytes

    def offsets(self, text: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """The first character of each token, and the one after its last; a token with a part of a character covers it."""
        if not ids:
            return [], []
        if not self.bytewise:
            spans = self.lib.encode(text, add_special_tokens=False).offsets
            return [a for a, _ in spans], [b for _, b in spans]
        ends = np.fromiter(accumulate(len(self.bytes_of()[i]) for i in ids), np.int64, len(ids))
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        starts = np.concatenate([[0], ends[:-1]])
        return char[starts].tolist(), (char[ends - 1] + 1).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Bytes that make no whole character, as at the ends of a slice, become U+FFFD."""
        if not self.bytewise:
            return self.lib.decode(ids, skip_special_tokens=False)
        table = self.bytes_of()
        return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def char_of_byte() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is printable, else one from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


def encode(df: DataFrame, key: str, text: str, path: str = BYTE_BPE) -> DataFrame:
    """(key, ids array<int>) of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path)
        for batch in batches:
            keys, start, flat, sizes = batch.column(0), 0, [], []
            for n, ids in enumerate(encoder.ids(batch.column(1).to_pylist()), 1):
                flat.extend(ids)
                sizes.append(len(ids))
                if len(flat) >= BATCH_IDS or n == batch.num_rows:
                    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.array(flat, np.int32)))
                    yield pa.RecordBatch.from_arrays([keys.slice(start, n - start), lists], [key, "ids"])
                    start, flat, sizes = n, [], []

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def encode_with_offsets(df: DataFrame, key: str, text: str, path: str = BYTE_BPE) -> DataFrame:
    """(key, ids, starts, ends): with each id the characters that its token covers, from 0, the end after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = Encoder.at(path), pa.list_(pa.int32())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                ids = list(encoder.ids(texts))
                spans = [encoder.offsets(t or "", i) for t, i in zip(texts, ids)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, kind), pa.array([s for s, _ in spans], kind), pa.array([e for _, e in spans], kind)], [key, "ids", "starts", "ends"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(df: DataFrame, key: str, ids: str, path: str = BYTE_BPE) -> DataFrame:
    """(key, text) of lists of ids; a null list has a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path)
        for batch in batches:
            texts = [None if i is None else encoder.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(ids).alias("__ids")).mapInArrow(run, f"`{key}` {kind}, text string")


def token_counts(df: DataFrame, keep: list[str], text: str, path: str = BYTE_BPE) -> DataFrame:
    """The columns `keep` and tokens bigint, the number of ids of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path)
        for batch in batches:
            sizes = pa.array(list(encoder.sizes(batch.column(batch.num_columns - 1).to_pylist())), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], [*keep, "tokens"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"{schema}, tokens bigint")
