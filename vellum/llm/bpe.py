"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (base64 token, rank) becomes a tokenizers BPE model: bytes map to printable characters, and each
token's merge is the pair that lower ranks leave of it. Texts are cut at blanks and line feeds into chunks
that no match of the split pattern crosses; a chunk is encoded once in a worker and then looked up. Decoding reverses
the byte table; tokens that split a character give their bytes, and text is made of whole byte strings only.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Known

#: The split pattern that the tokenizers library's ByteLevel step applies; the rank files are made for it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Blanks other than the space and the line feed, as any of the engines sees them: texts with one are encoded whole.
_ODD_BLANK = re.compile(r"[^\S \n]")


@cache
def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is printable, else the next from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merging by lower ranks leaves of a token; None if it never gets there."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], own))
        if ranks.get(parts[at] + parts[at + 1], own) >= own:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(parts)


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """A tokenizers model whose merges have the order of the ranks."""
    shown = byte_characters()
    say = lambda token: "".join(shown[b] for b in token)
    pairs = [p for t in sorted(ranks, key=ranks.get) if len(t) > 1 and (p := _last_pair(t, ranks))]
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": True},
        "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": True},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
                  "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {say(t): r for t, r in ranks.items()}, "merges": [[say(a), say(b)] for a, b in pairs]},
    })


class Coder:
    """Encodes and decodes in one worker; keeps the ids of the chunks that it has met, within the memory of ``Known``."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(model)
        self._known = Known()
        back = {c: b for b, c in byte_characters().items()}
        vocab = self._tokenizer.get_vocab()
        self._bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self._bytes[i] = bytes(back[c] for c in token)
        self._feed = vocab[byte_characters()[10]]
        self._lengths = np.array([len(b) for b in self._bytes], np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of new chunks. Those of a space and a word are encoded together, a line feed between them."""
        plain = [c for c in chunks if c[0] == " " and c[1:2] not in ("", " ") and "\n" not in c]
        found = {}
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = self._encode(["\n".join(some)])[0]
            ends = np.flatnonzero(ids == self._feed)
            if len(ends) != len(some) - 1:  # cannot be while a line feed is one token
                raise ValueError("line feeds merge in this vocabulary")
            raw, marks = ids.tobytes(), [-1, *ends.tolist(), len(ids)]
            found.update({c: raw[4 * (a + 1) : 4 * b] for c, a, b in zip(some, marks, marks[1:])})
        rest = [c for c in chunks if c not in found]
        found.update({c: i.tobytes() for c, i in zip(rest, self._encode(rest))} if rest else {})
        self._known.learn(found)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        odd = [i for i, t in enumerate(texts) if _ODD_BLANK.search(t)]
        for i, ids in zip(odd, self._encode([texts[i] for i in odd]) if odd else ()):
            out[i] = ids.tobytes()
        known = self._known
        rest = [i for i in range(len(texts)) if out[i] is None]
        cut = [_CHUNK.findall(texts[i]) for i in rest]
        new = {c for chunks in cut for c in chunks if c not in known}
        learnt = self._learn(list(new)) if new else {}
        look = known.__getitem__ if new <= known.keys() else lambda c: known.get(c) or learnt[c]
        for i, chunks in zip(rest, cut):
            out[i] = b"".join(map(look, chunks))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for; any cut of a text's ids gives its cut of the bytes."""
        return b"".join(map(self._bytes.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token's start and, last, the end."""
        return np.concatenate(([0], np.cumsum(self._lengths[ids])))


def character_offsets(data: bytes, byte_offsets: np.ndarray) -> np.ndarray:
    """The code point in which each byte offset lies; several tokens of one split character share it."""
    starts = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    before = np.concatenate(([0], np.cumsum(starts)))
    inside = np.concatenate((~starts, [False]))[byte_offsets]
    return before[byte_offsets] - inside


@cache
def coder(model: str) -> Coder:
    return Coder(model)


_SLICE_CHARS = 1 << 21


def _slices(texts: list[str]):
    first = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= _SLICE_CHARS:
            yield first, i + 1
            first, chars = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encoded(docs: DataFrame, ranks_path: str, with_ids: bool = True, with_offsets: bool = False) -> DataFrame:
    """Each row's ids and what they decode to.

    (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids][, starts]): the digests are of the ids as little-endian unsigned 32-bit
    integers and of the bytes that decoding them gives; ``starts`` holds the code point at which each token starts.
    Null texts are empty ones; rows that repeat an id are encoded one by one; an empty table gives an empty result. The rank
    file is read on the driver, and the model is sent to the tasks.
    """
    model = docs.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(ranks_path)))
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    fields += [pa.field("ids", pa.list_(pa.int64()))] * with_ids + [pa.field("starts", pa.list_(pa.int64()))] * with_offsets
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * with_ids + ", starts array<bigint>" * with_offsets

    def run(batches):
        code = coder(model.value)
        for batch in batches:
            every = batch.column(1).to_pylist()
            for first, last in _slices(every):
                texts, rows = every[first:last], []
                for raw in code.encode(texts):
                    ids = np.frombuffer(raw, "<u4")
                    data = code.decode(ids)
                    row = [len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(data).hexdigest()]
                    row += [ids.astype(np.int64)] * with_ids
                    row += [character_offsets(data, code.offsets(ids)[:-1])] * with_offsets
                    rows.append(row)
                columns = [batch.column(0).slice(first, last - first), *([r[i] for r in rows] for i in range(len(fields) - 1))]
                yield pa.RecordBatch.from_arrays([c if i == 0 else pa.array(c, f.type) for i, (c, f) in enumerate(zip(columns, fields))], schema=pa.schema(fields))

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, schema)


def decoded(tokens: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids: bytes joined first, so split characters come together; a character cut at
    either end becomes U+FFFD. Null ids give a null text."""
    model = tokens.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(ranks_path)))

    def run(batches):
        code = coder(model.value)
        for batch in batches:
            texts = [None if ids is None else code.decode(np.array(ids, np.int64)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), F.col(ids_col).cast("array<bigint>")).mapInArrow(run, "doc_id long, text string")
