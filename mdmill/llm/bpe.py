"""Byte-level BPE through a sentencepiece model that is written from the ranks."""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdmill.llm.common import in_arrow, text_of
from mdmill.session import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens of one text that are held at a time.
BLOCK = 1 << 16
#: Bytes that the remembered pre-tokens and their ids may take, about; then a codec starts afresh.
REMEMBERED = 48 << 20
#: Bytes that an entry takes besides its characters, and those of one that remembers a count.
ENTRY_BYTES, COUNT_BYTES = 250, 160


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a tiktoken file, by rank (the file has under 1 MB)."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


def byte_letters() -> list[str]:
    """A printable character for each byte: its own where Latin-1 prints it, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = itertools.count(0x100)
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _int(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(pieces: list[bytes]) -> bytes:
    """The serialised model: byte-mapped pieces scored by negative rank, identity normalisation."""
    letters = byte_letters()
    body = [
        _bytes(
            1,
            _bytes(1, "".join(letters[b] for b in piece).encode())
            + _varint(2 << 3 | 5)
            + struct.pack("<f", -float(rank)),
        )
        for rank, piece in enumerate(pieces)
    ]
    unknown = _bytes(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _int(3, 2)
    trainer = _int(3, 2) + _int(4, len(pieces) + 1) + _int(40, len(pieces))
    normaliser = _bytes(1, b"identity") + _int(3, 0) + _int(4, 0) + _int(5, 0)
    return b"".join([*body, _bytes(1, unknown), _bytes(2, trainer), _bytes(3, normaliser)])


class Codec:
    """Encodes pre-tokens one by one and decodes ids by the inverse byte mapping."""

    def __init__(self, pieces: list[bytes], pattern: str):
        self.pieces = pieces
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(pieces))
        self.find = regex.compile(pattern).finditer
        self.table = dict(enumerate(byte_letters()))
        self.text = [str(i) for i in range(len(pieces))]
        self.seen: dict[str, str] = {}
        self.held = 0
        self.numbers: dict[str, int] = {}

    def pre_tokens(self, text: str):
        """Blocks of at most BLOCK pre-tokens."""
        matches = (m.group() for m in self.find(text))
        while block := list(itertools.islice(matches, BLOCK)):
            yield block

    def learn(self, block: list[str]) -> None:
        """Encode the pre-tokens that are new, in one call."""
        new = list(set(block).difference(self.seen))
        if not new:
            return
        if self.held > REMEMBERED:
            self.seen.clear()
            self.held = 0
            new = list(set(block))
        for word, ids in zip(new, self._ids(new)):
            self.seen[word] = " ".join([self.text[i] for i in ids])
            self.held += ENTRY_BYTES + len(word) + len(self.seen[word])

    def count(self, block: list[str]) -> np.ndarray:
        """How many ids each pre-token has; only counts are remembered, apart from the ids."""
        new = list(set(block).difference(self.numbers))
        if new:
            if len(self.numbers) * COUNT_BYTES > REMEMBERED:
                self.numbers.clear()
                new = list(set(block))
            self.numbers.update(zip(new, map(len, self._ids(new))))
        return np.fromiter(map(self.numbers.__getitem__, block), np.int64, len(block))

    def _ids(self, words: list[str]) -> list[list[int]]:
        mapped = [w.encode("utf-8", "replace").decode("latin-1").translate(self.table) for w in words]
        return self.model.encode(mapped, num_threads=1)

    def encode_blocks(self, text: str):
        """The ids of each block as decimal numbers joined by spaces."""
        for block in self.pre_tokens(text):
            self.learn(block)
            yield " ".join(map(self.seen.__getitem__, block))

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids in self.encode_blocks(text) for i in ids.split(" ")]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@functools.lru_cache(maxsize=1)
def _codec(pieces: tuple[bytes, ...], pattern: str) -> Codec:
    return Codec(list(pieces), pattern)


def worker_codec(pieces: list[bytes], pattern: str) -> Codec:
    """The one codec of a worker process: tasks that follow one another share it and what it remembers."""
    return _codec(tuple(pieces), pattern)


def _over_texts(vocabulary, pattern, each, schema):
    """A mapInArrow function over (doc_id, text) that calls each(codec, text) for every row."""

    def run(batches):
        codec = worker_codec(vocabulary.value, pattern)
        for batch in batches:
            rows = [each(codec, t or "") for t in (x.as_py() for x in batch.column(1))]
            columns = list(zip(*rows)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, kind) for c, kind in zip(columns, schema))],
                names=["doc_id", *(f"c{i}" for i in range(len(schema)))],
            )

    return run


def _digest(codec: Codec, text: str):
    n, first, ids_hash, bytes_hash = 0, True, hashlib.sha256(), hashlib.sha256()
    for ids in codec.encode_blocks(text):
        ids_hash.update((ids if first else " " + ids).encode())
        decoded = codec.decode(map(int, ids.split(" ")))
        bytes_hash.update(decoded)
        n, first = n + ids.count(" ") + 1, False
    return n, ids_hash.hexdigest(), bytes_hash.hexdigest()


def _pieces(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(read_ranks(path))


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """(doc_id, ids array<int>), a row for each row of docs.

    A null or empty text has no ids. Repeated rows and null ids pass through.
    Other columns are ignored. The ranks (under 1 MB) are broadcast; texts are
    encoded where they are read, with no shuffle.
    """
    each = lambda codec, text: (codec.encode(text),)
    run = _over_texts(_pieces(docs, path or public_tokenizers.path(VOCABULARY)), pattern, each, [pa.list_(pa.int32())])
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_arrow(rows, run, f"doc_id {kind}, c0 array<int>").withColumnRenamed("c0", "ids")


def decode(ids: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text): the inverse of encode. Null ids count as none."""
    vocabulary = _pieces(ids, path or public_tokenizers.path(VOCABULARY))

    def run(batches):
        pieces = vocabulary.value
        for batch in batches:
            texts = [
                b"".join(map(pieces.__getitem__, x.as_py() or ())).decode("utf-8", "replace")
                for x in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = ids.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return in_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode, and hash both, in blocks."""
    vocabulary = _pieces(docs, path or public_tokenizers.path(VOCABULARY))
    run = _over_texts(vocabulary, pattern, _digest, [pa.int64(), pa.string(), pa.string()])
    rows = docs.select("doc_id", text_of().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_arrow(rows, run, f"doc_id {kind}, c0 long, c1 string, c2 string").toDF(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    )


def op6_byte_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))
