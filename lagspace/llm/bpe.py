"""Byte-level BPE: encoding by reuse of content-defined chunks, and decoding.

Two layers, both exact with respect to the tokenizers library:

* A text is cut at *safe cuts*: a space between two printable ASCII characters.
  The pre-tokenizer's pattern always starts a new pre-token at such a space, so
  what stands on either side is encoded the same alone as in place. Encoded
  words are remembered in a bounded table.
* Chunks end where a rolling hash of the last 16 bytes has a given form, so a
  passage that several documents share gives the same chunks wherever it
  stands. A chunk is encoded once: its ids between its first and last safe cut
  hold in any surroundings. At a joint the left chunk's tail and the right
  chunk's head are encoded anew; a chunk without two safe cuts joins the region
  that is encoded anew, which so widens until both sides agree.

Tables live in the Python worker, so they are shared by all documents and tasks
that it sees; they are bounded in entries or bytes, and emptied when full, which
costs time but changes no result.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: The pre-tokenizer's pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SPACE_RUN = re.compile(rb" (?:[ \t\n\r\x0b\x0c]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)")
_BEYOND = re.compile(rb"[\xd0-\xff]")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    WORDS = 150_000
    CHUNK_BYTES = 40_000_000
    CHUNK_BITS = 9
    LONGEST_CHUNK = 8192

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k.encode(): array("I", [v]).tobytes() for k, v in special.items()}
        self.special_split = re.compile(b"(" + b"|".join(re.escape(k) for k in sorted(self.special, key=len, reverse=True)) + b")") if special else None
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.pieces = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        for text, i in special.items():
            self.pieces[i] = text.encode()
        self.decimals = [str(i).encode() for i in range(len(self.pieces))]
        merged = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        in_order = [spec["model"]["vocab"][a + b] for a, b in merged]
        #: The quick encoder merges by id; that is the file's order of merges only if the ids rise with it.
        self.quick = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order == sorted(in_order) else None
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, tuple[int, int, bytes] | None] = {}
        self.chunk_bytes = 0
        self.reused = self.encoded = 0
        rng = np.random.default_rng(20240229)
        self.gear = rng.integers(0, 1 << 32, 256, dtype=np.uint32)

    # -- encoding ---------------------------------------------------------------

    def _alone(self, text: bytes) -> bytes:
        if not text:
            return b""
        if self.quick is None or _BEYOND.search(text):
            return array("I", self.exact.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        return array("I", self.quick.encode_ordinary(text.decode("utf-8", "replace"))).tobytes()

    def plain(self, text: bytes) -> bytes:
        """Ids (unsigned 32-bit, little-endian) of a text without special tokens, word by word."""
        if text[-1:] == b" " or _SPACE_RUN.search(text):
            return self._alone(text)
        words = text.split(b" ")
        known = self.words
        out = list(map(known.get, words))
        out[0] = self._alone(words[0])
        if None in out:
            if len(known) > self.WORDS:
                known.clear()
            for i, ids in enumerate(out):
                if ids is None:
                    w = words[i]
                    out[i] = ids = known.get(w) or self._alone(b" " + w)
                    if len(w) <= 64:
                        known[w] = ids
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text, as unsigned 32-bit little-endian bytes."""
        return self._around_specials(text, self.plain)

    def encode_chunked(self, text: bytes) -> bytes:
        """The same ids, by reuse of chunks."""
        return self._around_specials(text, self._by_chunks)

    def _around_specials(self, text: bytes, encode) -> bytes:
        if self.special_split is None or not any(s in text for s in self.special):
            return encode(text) if text else b""
        return b"".join(self.special[x] if x in self.special else encode(x) for x in self.special_split.split(text) if x)

    def cuts(self, text: bytes) -> list[int]:
        """Ends of the content-defined chunks of a text; the last is its length."""
        n = len(text)
        h = self.gear[np.frombuffer(text, dtype=np.uint8)]
        for k in (1, 2, 4, 8):
            if n > k:
                h[k:] += h[:-k] << np.uint32(k)
        at = np.flatnonzero((h >> np.uint32(8)) & np.uint32((1 << self.CHUNK_BITS) - 1) == 0) + 1
        ends: list[int] = []
        last = 0
        for e in [*at.tolist(), n]:
            while e - last > self.LONGEST_CHUNK:
                last += self.LONGEST_CHUNK
                ends.append(last)
            if e > last:
                ends.append(e)
                last = e
        return ends

    def _chunk(self, chunk: bytes) -> tuple[int, int, bytes] | None:
        known = self.chunks.get(chunk, 0)
        if known != 0:
            self.reused += 1
            return known
        self.encoded += 1
        first, last = _first_cut(chunk), _last_cut(chunk)
        entry = (first, last, self.plain(chunk[first:last])) if 0 < first < last else None
        size = len(chunk) + (len(entry[2]) if entry else 0) + 300
        if self.chunk_bytes + size > self.CHUNK_BYTES:
            self.chunks.clear()
            self.chunk_bytes = 0
        self.chunks[chunk] = entry
        self.chunk_bytes += size
        return entry

    def _by_chunks(self, text: bytes) -> bytes:
        out, joint, begin = [], b"", 0
        for end in self.cuts(text):
            chunk = text[begin:end]
            begin = end
            entry = self._chunk(chunk)
            if entry is None:
                joint += chunk
                continue
            first, last, ids = entry
            out.append(self.plain(joint + chunk[:first]))
            out.append(ids)
            joint = chunk[last:]
        if joint:
            out.append(self.plain(joint))
        return b"".join(out)

    # -- decoding ---------------------------------------------------------------

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def _first_cut(chunk: bytes) -> int:
    i = chunk.find(b" ", 1)
    while i > 0:
        if 0x20 < chunk[i - 1] < 0x7F and i + 1 < len(chunk) and 0x20 < chunk[i + 1] < 0x7F:
            return i
        i = chunk.find(b" ", i + 1)
    return -1


def _last_cut(chunk: bytes) -> int:
    i = chunk.rfind(b" ", 1, len(chunk) - 1)
    while i > 0:
        if 0x20 < chunk[i - 1] < 0x7F and 0x20 < chunk[i + 1] < 0x7F:
            return i
        i = chunk.rfind(b" ", 1, i)
    return -1


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The worker's codec for a file; its tables serve all tasks of the worker."""
    return Codec(path)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(path: str):
    def run(batches):
        from lagspace.llm import bpe

        c = bpe.codec(path)
        for b in batches:
            n, a, d = [], [], []
            for text in common.as_bytes(b.column(1)):
                ids = array("I")
                ids.frombytes(c.encode_chunked(text))
                n.append(len(ids))
                a.append(hashlib.sha256(b",".join(map(c.decimals.__getitem__, ids))).hexdigest())
                d.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], schema=SCHEMA)

    return run


def _tokens(path: str):
    def run(batches):
        from lagspace.llm import bpe

        c = bpe.codec(path)
        for b in batches:
            ids = [np.frombuffer(c.encode_chunked(t), dtype="<u4").astype(np.int32) for t in common.as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int> of every text. A null text is empty and has no ids; repeated rows stay repeated."""
    return common.pick(docs, "doc_id", "text").mapInArrow(_tokens(path or common.tokenizer_path()), "doc_id long, ids array<int>")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text is the empty text: no ids, and both digests are those of the
    empty string. A null doc_id stays null. Other columns are ignored. There is
    no shuffle: each text is encoded where it is read.
    """
    return common.pick(docs, "doc_id", "text").mapInArrow(_digests(path or common.tokenizer_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
