"""Problem 7: encoding the whole corpus with public tokenizers.

Method. A byte-level BPE vocabulary (a file of base64 token and rank) is serialised straight into a sentencepiece
model: each token becomes a piece of byte-mapped characters whose score is its negative rank, with identity
normalisation, so that sentencepiece's "best score first" merging is the rank order of byte-level BPE. Texts are cut
into pre-tokens by the vocabulary's pattern, each *different* pre-token of a worker is encoded once, and ids are
mapped back to bytes by the inverse of the byte map.

Defined results: null and empty text give an empty list; a text that consists of the spelling of a special token is
ordinary text; lone surrogates cannot occur in Spark strings. Input columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of every function below.
VOCABULARIES = os.environ.get("FOLIOSCOPE_TOKENIZERS", "/opt/tokenizers")
#: Pre-tokens that a worker keeps; beyond it the memo starts anew (a bound on memory, not on the result).
MEMO = 400_000
#: Fixed value: the pre-token pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> list[str]:
    """A printable character for each of the 256 bytes: visible Latin-1 stays, the rest moves above U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    mapped = {b: chr(b) for b in visible}
    for b in range(256):
        if b not in mapped:
            mapped[b] = chr(0x100 + len(mapped) - len(visible))
    return [mapped[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(rows)
    for token, rank in rows:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int) -> bytes:
    """One protobuf field: bytes are length-delimited, integers are varints."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks; the unknown piece follows them."""
    chars = byte_characters()
    pieces = [
        _field(1, _field(1, "".join(chars[b] for b in token).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)))
        for rank, token in enumerate(tokens)
    ]
    unknown = _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    minus_one = (1 << 64) - 1
    trainer += b"".join(_field(n, minus_one) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normalizer)


class ByteBPE:
    """Encoder and decoder of one byte-level vocabulary."""

    def __init__(self, path: str, memo: int = MEMO) -> None:
        import regex
        import sentencepiece

        tokens = read_ranks(path)
        self._bytes = tokens
        self._split = regex.compile(PATTERN).findall
        self._model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self._map = dict(enumerate(byte_characters()))
        self._memo: dict[str, list[int]] = {}
        self._limit = memo

    def _learn(self, new: list[str]) -> None:
        if len(self._memo) + len(new) > self._limit:
            self._memo.clear()
        mapped = [t.encode().decode("latin-1").translate(self._map) for t in new]
        self._memo.update(zip(new, self._model.encode(mapped, out_type=int, num_threads=1)))

    def _pre_tokens(self, texts: list[str | None]) -> tuple[list[list[str]], dict[str, list[int]]]:
        parts = [self._split(t) if t else [] for t in texts]
        different = set().union(*parts) if parts else set()
        known = self._memo
        new = [t for t in different if t not in known]
        if new:
            if len(known) + len(new) > self._limit:
                new = list(different)
            self._learn(new)
        return parts, self._memo

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; an empty list for null and empty texts."""
        parts, memo = self._pre_tokens(texts)
        out = []
        for tokens in parts:
            ids: list[int] = []
            for t in tokens:
                ids += memo[t]
            out.append(ids)
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        """Number of ids of each text, without building them."""
        parts, memo = self._pre_tokens(texts)
        return [sum([len(memo[t]) for t in tokens]) for tokens in parts]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self._bytes[i] for i in ids).decode("utf-8", "replace")


class _Library:
    """The other public vocabularies, through the library each belongs to."""

    def __init__(self, path: str) -> None:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self._t = Tokenizer.from_file(path)
            self._t.encode_special_tokens = True
            self._encode = lambda xs: [e.ids for e in self._t.encode_batch(xs, add_special_tokens=False)]
        else:
            import sentencepiece

            self._t = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda xs: self._t.encode(xs, num_threads=1)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        ids = self._encode([t or "" for t in texts])
        return [list(x) if t else [] for x, t in zip(ids, texts)]

    def count(self, texts: list[str | None]) -> list[int]:
        return [len(x) for x in self.encode(texts)]


@lru_cache(maxsize=4)
def tokenizer(name: str = "byte_bpe_50k", folder: str = VOCABULARIES):
    """The encoder of a public vocabulary, once per worker process.

    ``byte_bpe_50k`` and ``byte_bpe_multi_50k`` go through the serialised sentencepiece model, ``word_bpe_49k`` and
    ``piece_bpe_32k`` through their own libraries.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    ranks = os.path.join(folder, f"{name}.tiktoken")
    if os.path.exists(ranks):
        return ByteBPE(ranks)
    for ending in ("json", "model"):
        path = os.path.join(folder, f"{name}.{ending}")
        if os.path.exists(path):
            return _Library(path)
    raise FileNotFoundError(f"no vocabulary {name} in {folder}")


def _slices(batch: pa.RecordBatch, characters: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of bounded text size, so that very long texts do not meet in one encode call."""
    sizes = batch.column(1).cast(pa.large_string())
    ends = np.cumsum(np.diff(np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + characters, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``(id, ids array<int>)`` of every row; a map without any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(name, folder)
        for whole in batches:
            for b in _slices(whole):
                ids = t.encode(b.column(1).to_pylist())
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[id_col, "ids"])

    pair = df.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = pair.schema[id_col].dataType.simpleString()
    return pair.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``(id, n_tokens bigint)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(name, folder)
        for whole in batches:
            for b in _slices(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t.count(b.column(1).to_pylist()), pa.int64())], names=[id_col, "n_tokens"])

    pair = df.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = pair.schema[id_col].dataType.simpleString()
    return pair.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``(id, text)`` from ids of a byte-level vocabulary; a null list gives a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(name, folder)
        for b in batches:
            texts = [None if x is None else t.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    pair = df.select(id_col, ids_col)
    kind = pair.schema[id_col].dataType.simpleString()
    return pair.mapInArrow(run, f"`{id_col}` {kind}, text string")
