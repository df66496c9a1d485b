"""Byte-pair encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can never be merged across, so it marks a
certain cut. Texts are cut there, the fragments are encoded each on its own by the tokenizers library,
and the results are concatenated. Fragments repeat, so a batch encodes those that it hasn't met.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_table, small_batches, texts, tidy

#: Fragments that a worker remembers, and their length in bytes; beyond that number it forgets all and
#: starts again. Between tasks it keeps the first of them only, as other work may follow in the process.
MEMO, MEMO_BYTES, KEPT = 600_000, 64, 150_000
#: White space beyond ASCII (Unicode White_Space), fixed values.
WIDE_SPACE = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WIDE = re.compile(b"|".join(c.encode() for c in WIDE_SPACE))


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def certain(tokens: list[bytes]) -> np.ndarray:
    """For each pair of bytes whether a text may be cut between them: no token has the pair inside.

    The pattern that splits texts before merging must see the same on both sides of a cut, so none is
    made inside a character, after white space or control characters (what follows may belong to
    them), after an apostrophe, or before one that may be in a run of marks (it may begin a suffix).
    """
    joined = np.zeros((256, 256), np.bool_)
    for token in tokens:
        row = np.frombuffer(token, np.uint8)
        joined[row[:-1], row[1:]] = True
    out, b = ~joined, np.arange(256)
    out[:, (b >= 0x80) & (b < 0xC0)] = False
    out[(b <= 0x20) | (b == 0x7F) | (b == ord("'"))] = False
    out[[not (x < 128 and chr(x).isalnum()) for x in b], ord("'")] = False
    return out


class ByteBPE:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {c: b for b, c in byte_letters().items()}
        raw = {bytes(byte_of[c] for c in token): k for token, k in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.table = [b""] * (max([*raw.values(), *self.special.values()]) + 1)
        for token, k in raw.items():
            self.table[k] = token
        for token, k in self.special.items():
            self.table[k] = token.encode()
        self.certain = certain([x for x in raw if len(x) > 1])
        self.stop = re.compile(b"|".join(re.escape(x.encode()) for x in self.special)) if self.special else None
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.memo: dict[bytes, bytes] = {}
        self.most = memo

    def fragments(self, data: bytes) -> list[bytes]:
        """The text (UTF-8) between certain cuts; joined they are the text."""
        if not data:
            return []
        row = np.frombuffer(data, np.uint8)
        cuts = np.flatnonzero(self.certain[row[:-1], row[1:]]) + 1
        if WIDE.search(data):
            cuts = np.setdiff1d(cuts, [x.end() for x in WIDE.finditer(data)])
        cuts = cuts.tolist()
        return [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]

    def pieces(self, data: bytes) -> list[bytes | str]:
        """Fragments of a text, and the special tokens in it as strings."""
        out, at = [], 0
        for found in self.stop.finditer(data) if self.stop else ():
            out += [*self.fragments(data[at : found.start()]), found[0].decode()]
            at = found.end()
        return out + self.fragments(data[at:])

    def encode_batch(self, values: list[bytes]) -> list[bytes]:
        """Token ids, as little-endian unsigned 32-bit integers, of texts in UTF-8."""
        split = [self.pieces(x) for x in values]
        known = self.memo
        fresh = list({x for pieces in split for x in pieces if x not in known})
        if len(known) + len(fresh) > self.most:
            known.clear()
            fresh = list({x for pieces in split for x in pieces})
        found = {x: self.special[x].to_bytes(4, "little") for x in fresh if isinstance(x, str)}
        plain = [x for x in fresh if x not in found]
        for x, ids in zip(plain, self.library.encode_batch_fast([x.decode() for x in plain], add_special_tokens=False)):
            found[x] = np.array(ids.ids, "<u4").tobytes()
        known.update((x, ids) for x, ids in found.items() if len(x) <= MEMO_BYTES)
        long = {x: ids for x, ids in found.items() if len(x) > MEMO_BYTES}
        get = (lambda x: known[x] if x in known else long[x]) if long else known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def decode_bytes(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become replacement characters."""
        data = b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            data.decode()
        except UnicodeDecodeError:
            return data.decode(errors="replace").encode()
        return data

    def shorten(self) -> None:
        """Keep the first of the remembered fragments only."""
        first = dict(itertools.islice(self.memo.items(), KEPT))
        self.memo.clear()
        self.memo.update(first)


_LOADED: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """The vocabulary at path, read once in each process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def vocabulary() -> str:
    """Where the default vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids (little-endian u32, binary).

    Null text is encoded as empty text: no ids, the digests of nothing. A special token's string in a
    text becomes that token. Ids may be null or repeat; rows stay apart. No other column is read.
    No shuffle: every text is encoded where it is read. path is looked up on the worker if None.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path or vocabulary())
        for batch in batches:
            n, ids_hash, text_hash, kept = [], [], [], []
            for ids in bpe.encode_batch(texts(batch.column(1))):
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
                kept.append(ids)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        bpe.shorten()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.select(id_col, text).mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text) of what encode() returned; null ids give null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path or vocabulary())
        for batch in batches:
            out = [None if x is None else bpe.decode_bytes(x).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids).mapInArrow(tidy(run), f"`{id_col}` {kind}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 over all documents."""
    return encode(read_table(spark, sf_dir, "documents"), keep_ids=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the encoded documents."""
    return encode(docs, keep_ids=False)
