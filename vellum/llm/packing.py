"""Online best-fit packing of token sequences with a bounded number of open bins.

Open bins hang on their free space, and a bitset marks which free spaces occur; the lowest marked bit at or above a
piece's length is its best fit. When all bins are open and none fits, the fullest closes. Pieces are taken as they
come, in an order that has nothing to do with their lengths.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Known, map_columns, slices, written

CAPACITY, OPEN_BINS, END_ID = 2048, 1024, 0
PIECES_PER_TASK = 50_000
_MARK = "\u0663"  # a digit
#: How the vocabulary normalizes and splits, if words of ``_SIMPLE`` characters may be split here.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_END = "</w>"
#: Printable ASCII and the letters of Latin-1, which NFC leaves and ``str.lower`` changes as the library does.
_SIMPLE = re.compile("^[!-~À-ÖØ-öø-ÿ]+$", re.M)
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")
_PIECE = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}


class Words:
    """Ids of texts by the tokenizers library, kept for each word met.

    The vocabulary's splitter drops blanks and never joins what they part, so a text's ids are those of its words in
    turn; words are encoded together, parted by a digit that stands alone. Simple words are lower-cased and split here, and
    the library only merges their parts, each of which ends in the one id whose token ends in ``</w>``. A text in which a
    special token of the vocabulary is spelt out is encoded whole, as the library reads it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._known = Known(256 << 20)
        self._mark = self._ids([_MARK])[0]
        self.by_word = self._parts_words()
        self._ends, self._merger = self._merges_parts(Tokenizer)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts_words(self) -> bool:
        """Whether this vocabulary is of the kind described; another one encodes whole texts."""
        probe = f"a b\n{_MARK} c1 {_MARK}d."
        return len(self._mark) > 0 and np.array_equal(self._ids([probe])[0], np.concatenate(self._ids(["a", "b", _MARK, "c1", _MARK, "d."])))

    def _merges_parts(self, tokenizer):
        """(whether each id ends a part, a tokenizer that merges parts split by blanks), or nothing for a vocabulary of another kind."""
        stated = json.loads(self._tokenizer.to_str())
        model = stated["model"]
        plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if not plain or model["type"] != "BPE" or model.get("end_of_word_suffix") != _END or stated["normalizer"] != _NORMALIZER or stated["pre_tokenizer"] != _SPLITTER:
            return None, None
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        ends[[i for token, i in model["vocab"].items() if token.endswith(_END)]] = True
        merger = tokenizer(self._tokenizer.model)
        merger.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        return ends, merger

    def _simple(self, words: list[str]) -> dict[str, bytes]:
        """The ids of those ``words``, without line feeds, that have simple characters only."""
        found = {}
        simple = _SIMPLE.findall("\n".join(words)) if self._merger else []
        for at in range(0, len(simple), 2000):
            some = simple[at : at + 2000]
            parts = _PARTS.sub(r"\g<0> ", "\n".join(some).lower())
            ids = np.array(self._merger.encode_batch_fast([parts], add_special_tokens=False)[0].ids, "<u4")
            last, counts = np.flatnonzero(self._ends[ids]) + 1, np.cumsum([x.count(" ") for x in parts.split("\n")])
            if len(last) == counts[-1]:
                raw, cuts = ids.tobytes(), (4 * last[counts - 1]).tolist()
                found.update({w: raw[a:b] for w, a, b in zip(some, [0, *cuts], cuts)})
        return found

    def _learn(self, words: list[str]) -> None:
        found = self._simple(words)
        plain = [w for w in words if w not in found and _MARK not in w]
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = self._ids([f" {_MARK} ".join(some)])[0]
            n = len(self._mark)
            same = np.ones(max(0, len(ids) - n + 1), bool)
            for i, x in enumerate(self._mark):
                same &= ids[i : i + len(same)] == x
            marks = np.flatnonzero(same).tolist()
            if len(marks) != len(some) - 1:
                found.update({w: i.tobytes() for w, i in zip(some, self._ids(some))})
                continue
            raw = ids.tobytes()
            found.update({w: raw[4 * a : 4 * b] for w, a, b in zip(some, [0, *(m + n for m in marks)], [*marks, len(ids)])})
        rest = [w for w in words if w not in found]
        found.update({w: i.tobytes() for w, i in zip(rest, self._ids(rest))} if rest else {})
        self._known.learn(found)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        plain = [self.by_word and not any(x in t for x in self._special) for t in texts]
        whole = iter([i.tobytes() for i in self._ids([t for t, p in zip(texts, plain) if not p])] if not all(plain) else ())
        cut = [t.replace("\n", " ").split(" ") if p else None for t, p in zip(texts, plain)]
        said = set(chain.from_iterable(filter(None, cut)))  # looked up once here: the table of all words is far larger than a cache
        own = dict(zip(said, map(self._known.get, said)))
        new = [w for w, ids in own.items() if ids is None]
        if new:
            self._learn(new)
            own.update(zip(new, map(self._known.__getitem__, new)))
        ids = own.__getitem__
        return [next(whole) if words is None else b"".join(map(ids, words)) for words in cut]


@cache
def words(path: str) -> Words:
    return Words(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut every ``capacity`` tokens.

    Null texts are empty and give the end id alone. Rows that repeat an id give pieces of their own.
    """

    def run(parts):
        coder = words(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for part in parts:
            for some in slices(part):
                out = []
                for doc_id, raw in zip(some["doc_id"], coder.encode(some["text"])):
                    raw += end
                    for piece, start in enumerate(range(0, len(raw), 4 * capacity)):
                        cut = raw[start : start + 4 * capacity]
                        out.append((doc_id, piece, start // 4, len(cut) // 4, zlib.crc32(cut)))
                yield dict(zip(_PIECE, zip(*out)))

    columns = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_columns(columns, run, _PIECE, keeps_words=True)


class OpenBins:
    """At most ``most`` bins that still take pieces; ``put`` gives the bin and the offset for a length."""

    def __init__(self, capacity: int, most: int):
        self._capacity, self._most = capacity, most
        self._marks = 0  # bit f: some open bin has f free
        self._by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = self.closed = 0  # closed: those that were closed to make room

    def _take(self, free: int) -> int:
        bins = self._by_free[free]
        number = bins.pop()
        if not bins:
            self._marks ^= 1 << free
        self.open -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        fitting = self._marks >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self._capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if self.open == self._most:
                self._take((self._marks & -self._marks).bit_length() - 1)  # the fullest closes
                self.closed += 1
            self._by_free[left].append(number)
            self._marks |= 1 << left
            self.open += 1
        return number, self._capacity - free


def packed(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """``cut`` with (sequence_id, offset, closed): whole pieces put into sequences of at most ``capacity`` tokens.

    Pieces are dealt evenly to tasks of about ``PIECES_PER_TASK``, whatever their ids, and a task takes them in the order of
    a hash. ``closed`` counts the bins that the task has closed so far because all were open. An empty table gives an empty result.
    """
    n = max(1, -(-cut.count() // PIECES_PER_TASK))
    ordered = cut.repartition(n).sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece", "length")

    def run(parts):
        from pyspark import TaskContext

        bins, task = OpenBins(capacity, open_bins), TaskContext.get().partitionId()
        for part in parts:
            placed = [(*bins.put(x), bins.closed) for x in part["length"]]
            yield part | {"sequence_id": [(task << 40) + b for b, _, _ in placed], "offset": [o for _, o, _ in placed], "closed": [c for _, _, c in placed]}

    return map_columns(ordered, run, _PIECE | {"sequence_id": pa.int64(), "offset": pa.int64(), "closed": pa.int64()}, keeps_words=True)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Tokenize, cut and pack ``docs``; only the pieces' lengths and digests are written and dealt out."""
    return packed(written(pieces(docs, tokenizer_path, capacity), "pieces"), capacity, open_bins)
