"""Encoding of texts with the vocabulary file of a public byte-level BPE tokenizer.

Workers receive Arrow batches. A text is cut into chunks where the tokenizer's
own splitting pattern always cuts: before a single blank between two characters
that are no blanks. Chunks recur all the time, so each worker puts a chunk's ids
together once and then looks them up; what the tokenizers library encodes is the
pre-tokens that a worker hasn't met yet. Concatenated, the ids of
the chunks are exactly those of the text (tests hold them against the library's
encoding of whole texts). Only short chunks are remembered, and no more than a
fixed number of bytes of them; long ones (texts without blanks) go straight to
the library. The same holds for vocabulary files with another splitting pattern.

Tokens are bytes in disguise: a token's string spells each byte as one printable
character. Offsets count bytes through that table and are turned into characters
of the text, so a token that holds only part of a character is recognised.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; every operator takes it as a parameter.
TOKENIZERS = "/opt/tokenizers"
MODEL = "byte_bpe_50k"
#: Chunks a worker remembers before it starts over.
REMEMBERED = 500_000
#: Bytes (as estimated) of chunks, pre-tokens and their ids that a worker remembers, and the longest remembered one.
REMEMBERED_BYTES, SHORT = 96 << 20, 64


# The splitting pattern of the vocabulary, for texts of printable ASCII, tabs and line ends.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
_IS_PLAIN = re.compile(r"[\t\n\r -~]*").fullmatch


_RARE = re.compile("[\\0\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a token's string stands for.

    Printable Latin-1 bytes stand for themselves; the others, in order, are
    spelled by the characters from U+0100 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


def chunks_of(text: str) -> list[str]:
    """Chunks of a text whose encodings concatenate to that of the text.

    A mark is set before each blank and taken back where another blank, tab or
    line end is next to it.
    """
    if _RARE.search(text):
        return _chunks_slowly(text)
    t = text.replace(" ", "\0 ")
    for w in " \n\t\r":
        behind, ahead = w + "\0 ", "\0 " + w
        while behind in t:
            t = t.replace(behind, w + " ")
        while ahead in t:
            t = t.replace(ahead, " " + w)
    return t.split("\0")


def _chunks_slowly(text: str) -> list[str]:
    """The same for texts with rare white space (or the mark itself)."""
    parts = text.split(" ")
    out, cur = [], parts[0]
    for p in parts[1:]:
        if p and cur and not p[0].isspace() and not cur[-1].isspace():
            out.append(cur)
            cur = " " + p
        else:
            cur = f"{cur} {p}"
    out.append(cur)
    return out


class Encoder:
    """Encodes texts chunk by chunk and decodes ids."""

    def __init__(self, root: str = TOKENIZERS, model: str = MODEL):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = os.path.join(root, f"{model}.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        pre = doc.get("pre_tokenizer") or {}
        # Whether the file splits texts as the chunks here do, so that they may be used.
        self.chunked = doc.get("normalizer") is None and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space")
        self.seen: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.held = 0

    @property
    @lru_cache(maxsize=1)  # noqa: B019 - one encoder per process
    def bytes_of(self) -> list[bytes]:
        """The bytes of each token id; special tokens stand for their own text."""
        if not self.chunked:
            raise ValueError("offsets and bytes need a byte-level vocabulary whose tokens spell the text as it is")
        table = byte_of_char()
        out = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        special = {i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        for text, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            out[i] = text.encode() if i in special else bytes(table[c] for c in text)
        return out

    def _library(self, texts: list[str]) -> Iterator[bytes]:
        for k in range(0, len(texts), 4096):
            for e in self.tokenizer.encode_batch_fast(texts[k : k + 4096], add_special_tokens=False):
                yield array("i", e.ids).tobytes()

    def _keep(self, memory: dict[str, bytes], found: dict[str, bytes]) -> None:
        short = {c: b for c, b in found.items() if len(c) <= SHORT}
        memory.update(short)
        # A string and a bytes object take about 100 bytes beside what they hold.
        self.held += sum(2 * len(c) + len(b) + 200 for c, b in short.items())

    def _learn(self, split: list[list[str]]) -> dict[str, bytes]:
        """Ids of the chunks that aren't remembered; short ones are from now on."""
        if self.held > REMEMBERED_BYTES or len(self.seen) > REMEMBERED or len(self.parts) > REMEMBERED:
            self.seen.clear()
            self.parts.clear()
            self.held = 0
        new = set().union(*split).difference(self.seen)
        # Chunks of plain characters are put together from their pre-tokens, of
        # which there are far fewer; others are left to the library as they are.
        parts = {c: _PLAIN.findall(c) if _IS_PLAIN(c) else [c] for c in new}
        todo = list(set().union(*parts.values()).difference(self.parts))
        fresh = dict(zip(todo, self._library(todo)))
        self._keep(self.parts, fresh)
        get, found = self.parts.__getitem__, {}
        for c, ps in parts.items():
            try:
                found[c] = b"".join(map(get, ps))
            except KeyError:  # with long pre-tokens
                found[c] = b"".join([fresh[p] if p in fresh else get(p) for p in ps])
        self._keep(self.seen, found)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as 32-bit integers in a row; none for null and empty texts."""
        if not self.chunked:
            return list(self._library([t or "" for t in texts]))
        split = [chunks_of(t) if t else [] for t in texts]
        found, get, out = self._learn(split), self.seen.__getitem__, []
        for s in split:
            try:
                out.append(b"".join(map(get, s)))
            except KeyError:  # with long chunks
                out.append(b"".join([found[c] if c in found else get(c) for c in s]))
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        """Number of ids of each text."""
        return [len(b) // 4 for b in self.encode(texts)]

    def decode(self, ids: list[int] | None) -> str | None:
        """Text of ids. Bytes that don't form a character (ids cut within one) become U+FFFD."""
        if ids is None:
            return None
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", errors="replace")

    @property
    @lru_cache(maxsize=1)  # noqa: B019 - one encoder per process
    def lengths(self) -> np.ndarray:
        """The number of bytes of each token id."""
        return np.array([len(b) for b in self.bytes_of], dtype=np.int64)

    def ends(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the end of each token: characters begun before it, whether a character ends there, and bytes up to it."""
        data = np.frombuffer(text.encode("utf-8", errors="surrogatepass"), dtype=np.uint8)
        starts = np.r_[(data & 0xC0) != 0x80, True]
        byte_ends = np.cumsum(self.lengths[np.frombuffer(ids, dtype=np.int32)])
        begun = np.r_[0, np.cumsum(starts[:-1])]
        return begun[byte_ends], starts[byte_ends], byte_ends

    def spans(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Characters [start, end) that each token touches; tokens that share a character all have it."""
        data = np.frombuffer(text.encode("utf-8", errors="surrogatepass"), dtype=np.uint8)
        ends = np.cumsum(self.lengths[np.frombuffer(ids, dtype=np.int32)])
        # Characters that begin before each byte position.
        begun = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        first = np.where(starts < len(data), begun[np.minimum(starts + 1, len(data))] - 1, begun[-1])
        return first, begun[ends]

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """`spans` of a list of ids, as pairs."""
        first, last = self.spans(text, array("i", ids).tobytes())
        return list(zip(first.tolist(), last.tolist()))


@lru_cache(maxsize=4)
def encoder(root: str = TOKENIZERS, model: str = MODEL) -> Encoder:
    """The encoder of this worker process."""
    return Encoder(root, model)


def _field(df: DataFrame, name: str) -> str:
    return dict(df.dtypes)[name]


def encode_ids(df: DataFrame, key: str, text: str, root: str = TOKENIZERS, model: str = MODEL) -> DataFrame:
    """key, ids (array<int>) of every row, without special tokens.

    A null and an empty text both give an empty list. One row out per row in;
    no shuffle. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(root, model)
        for batch in batches:
            for part in _slices(batch):
                coded = enc.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(coded)], names=["key", "ids"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {_field(df, key)}, ids array<int>").withColumnRenamed("key", key)


def _lists(coded: list[bytes] | list[np.ndarray]) -> pa.ListArray:
    """An Arrow list of 32-bit integers per entry."""
    bounds = np.zeros(len(coded) + 1, dtype=np.int64)
    np.cumsum([len(b) // 4 if isinstance(b, bytes) else len(b) for b in coded], out=bounds[1:])
    flat = np.frombuffer(b"".join(coded), dtype=np.int32) if all(isinstance(b, bytes) for b in coded) else np.concatenate(coded).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))


def encode_spans(df: DataFrame, key: str, text: str, root: str = TOKENIZERS, model: str = MODEL) -> DataFrame:
    """key, ids, starts, ends of every row: the characters [start, end) of the text that each token touches.

    A null and an empty text give empty lists. Tokens within one character all
    have that character. Only vocabularies whose tokens spell the text's bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(root, model)
        for batch in batches:
            for part in _slices(batch):
                texts = part.column(1).to_pylist()
                coded = enc.encode(texts)
                pairs = [enc.spans(t or "", b) for t, b in zip(texts, coded)]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(coded), _lists([a for a, _ in pairs]), _lists([b for _, b in pairs])], names=["key", "ids", "starts", "ends"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {_field(df, key)}, ids array<int>, starts array<int>, ends array<int>").withColumnRenamed("key", key)


def _slices(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each."""
    n = batch.num_rows
    if n == 0:
        return
    rows = max(1, min(n, int(n * most / max(1, batch.column(1).nbytes))))
    for k in range(0, n, rows):
        yield batch.slice(k, rows)


def count_tokens(df: DataFrame, key: str, text: str, root: str = TOKENIZERS, model: str = MODEL) -> DataFrame:
    """key, n_tokens of every row; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(root, model)
        for batch in batches:
            for part in _slices(batch):
                counts = enc.count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int32())], names=["key", "n_tokens"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {_field(df, key)}, n_tokens int").withColumnRenamed("key", key)


def decode_ids(df: DataFrame, key: str, ids: str, root: str = TOKENIZERS, model: str = MODEL) -> DataFrame:
    """key, text of every row's ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(root, model)
        for batch in batches:
            texts = [enc.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"key {_field(df, key)}, text string").withColumnRenamed("key", key)


def vocabulary_size(root: str = TOKENIZERS, model: str = MODEL) -> int:
    """Number of ids of a vocabulary file."""
    with open(os.path.join(root, f"{model}.json"), encoding="utf-8") as f:
        doc = json.load(f)
    return max([*doc["model"]["vocab"].values(), *[t["id"] for t in doc["added_tokens"]]]) + 1
