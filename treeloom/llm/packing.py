"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised and cut into pieces where they are read; only a row of numbers
for each piece goes on.  Pieces are dealt to groups of bounded size.  A group's packer takes
them as they come, in an order that hashes give, by way of a buffer of ``2 * open_bins``
pieces, which it empties longest first; a piece once placed stays.  Placing is bounded-space
best-fit: at most ``open_bins`` sequences are open, far fewer than a group fills; a bitset
holds the free spaces that open sequences have, the lowest set bit at or above a piece's
length is the best fit, and when too many are open the fullest closes.  Sequences that stay
badly filled at the end of the groups are taken apart and packed once more in fewer groups.

A null text counts as empty: one piece with the end id alone.  Repeated rows are packed
each; rows with a null id too.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + n) for n, b in enumerate(others)}


def _class(kind: str) -> str:
    """Latin characters of a general category, as the inside of a regular expression's class."""
    return "".join(f"\\u{c:04x}" for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


#: What the tokenizer takes for one word, for texts of Latin letters and common punctuation.
_WORD = re.compile(f"[{_class('L')}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_class('N')}]|[^\\s{_class('L')}{_class('N')}]+")
#: Other characters, control characters that are blanks to Python alone, and the starts of the tokenizer's own marks.
_OTHER = re.compile("[^\x00-\x1b\x20-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]|<\\|")
_CONTROL = re.compile("[\x1c-\x1f]")


class MemoTokenizer:
    """Token ids of whole texts as packed little-endian 32-bit numbers.

    Texts of Latin script are split into words as the tokenizer does; a word's ids are
    memoised (``memo`` words at most) and new words go to the merge model.  Any other text
    goes through the whole tokenizer.
    """

    def __init__(self, json: str, memo: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.seen = Tokenizer.from_str(json), memo, {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        spelled = word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(spelled)])

    def __call__(self, text: str) -> bytes:
        lowered = text.lower()
        plain = text.isascii() and "<|" not in text and not _CONTROL.search(text)
        if not plain and (_OTHER.search(text) or _OTHER.search(lowered)):  # some capitals' small letters lie elsewhere
            return self._direct(text)
        if len(self.seen) > self.memo:
            self.seen.clear()
        seen, words = self.seen, _WORD.findall(lowered)
        for new in set(words).difference(seen):
            seen[new] = self._word(new)
        return b"".join(map(seen.__getitem__, words))


#: The tokenizer of this Python worker, kept from task to task.
_KEPT: dict[int, MemoTokenizer] = {}


def kept_tokenizer(json: str) -> MemoTokenizer:
    key = zlib.crc32(json.encode())
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = MemoTokenizer(json)
    return _KEPT[key]


class BoundedBestFit:
    """Online best-fit with at most ``open_bins`` open bins; bins are numbered from 0 as they open."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.free_bits = self.open = self.bins = 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin a piece goes to and its offset there."""
        fitting = self.free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            own = self._take(free)
        else:
            free, own = self.capacity, self.bins
            self.bins += 1
        left = free - length
        if left:
            self.by_free[left].append(own)
            self.free_bits |= 1 << left
            self.open += 1
            if self.open > self.limit:  # the fullest closes
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
        return own, self.capacity - free

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        own = stack.pop()
        if not stack:
            self.free_bits &= ~(1 << free)
        self.open -= 1
        return own


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A row for each piece: ``doc_id, piece, start, length, ids_crc32``."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary, of fixed size
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = kept_tokenizer(shared.value)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = tokenizer(text if isinstance(text, str) else "") + end
                for k in range(0, len(ids), 4 * capacity):
                    own = ids[k : k + 4 * capacity]
                    rows.append((doc_id, k // (4 * capacity), k // 4, len(own) // 4, zlib.crc32(own)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(pieces, PIECES)


def _pack_groups(pieces: DataFrame, groups: int, capacity: int, open_bins: int, first: int) -> DataFrame:
    """Pack in ``groups`` groups; sequence ids start at ``first`` times 2**40, a range for each group."""

    def pack(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["arrival", "doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        buffer = own.index // (2 * open_bins)
        own = own.iloc[np.lexsort((-own["length"].to_numpy(), buffer))]
        bins = BoundedBestFit(capacity, open_bins)
        placed = [bins.place(int(n)) for n in own["length"]]
        where = np.array(placed, np.int64).reshape(-1, 2)
        filled = np.bincount(where[:, 0], own["length"].to_numpy(), bins.bins).astype(np.int64)
        return own.assign(
            sequence_id=(np.int64(first + int(key[0])) << 40) + where[:, 0], offset=where[:, 1], filled=filled[where[:, 0]]
        )[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "filled"]]

    dealt = pieces.withColumn("arrival", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()))
    return dealt.groupBy(F.pmod("arrival", F.lit(groups)).alias("pack_group")).applyInPandas(
        pack, f"{PIECES}, sequence_id long, offset long, filled long"
    )


def pack_pieces(pieces: DataFrame, capacity: int = 2048, open_bins: int = 512, group_rows: int = 8192) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; a row of ``pieces`` is read several times, so cut it before."""
    full = pieces.where(F.col("length") == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, rest.count() // group_rows)
    first = cut(_pack_groups(rest, groups, capacity, open_bins, 0))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    loose = F.col("filled") < capacity - capacity // 16
    left = first.where(loose).drop("sequence_id", "offset", "filled")
    again = _pack_groups(left, max(1, left.count() // group_rows), capacity, open_bins, groups)
    return full.select(keep).union(first.where(~loose).select(keep)).union(again.select(keep))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, open_bins: int = 512) -> DataFrame:
    """Tokenise, cut and pack every row of ``docs``."""
    return pack_pieces(cut(tokenize_pieces(docs, tokenizer_path, capacity)), capacity, open_bins)
