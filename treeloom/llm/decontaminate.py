"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, texts scanned once.

Words are runs of bytes that aren't ASCII separators, after lower-casing A-Z.  A normalised
text is its words with single blanks between and around them.  Every window of ``window``
consecutive words of an item is a pattern (an item of fewer words is one pattern), with the
blanks around it, so that matches are whole words.  Texts are scanned as UTF-8 bytes: one
table look-up for each byte normalises them, and one pass of the automaton finds all
windows.  Only texts with a match are gone over again, to map word numbers to places in the
original text.

The items travel to the tasks as a broadcast variable while their patterns take at most
``most_bytes``.  A larger benchmark is dealt into parts below that size by item; each part
has its own automaton and pass over the texts, and the parts' findings meet by row, so the
result is the same and no part's size depends on the benchmark's.

Edge cases: null texts and items have no words; an item's text may repeat under other ids
(all are reported) and an id may have several texts; an item without an id counts as the
id of the empty string; repeated documents are judged each; extra columns are ignored; an
empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: ASCII bytes outside words become blanks, capitals small letters, all others stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows_of(words: list[bytes], window: int) -> list[bytes]:
    """The patterns of one item; ``words`` isn't empty."""
    return [b" ".join([b"", *words[i : i + window], b""]) for i in range(max(1, len(words) - window + 1))]


class Leaks:
    """The automaton of all items' windows; a byte counts as one letter (Latin-1), as only equality matters."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.automaton, self.items = ahocorasick.Automaton(), [name for name, _ in items]
        held: dict[bytes, set[int]] = {}
        for at, (_, text) in enumerate(items):
            if words := words_of(text):
                for pattern in windows_of(words, window):
                    held.setdefault(pattern, set()).add(at)
        for pattern, own in held.items():
            self.automaton.add_word(pattern.decode("latin-1"), (pattern.count(b" ") - 1, tuple(own)))
        self.automaton.make_automaton()
        self.empty = not held

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit words as ranges ``[first, end)`` that don't meet, and the ids of the items found."""
        matches, found = [], set()
        if not self.empty and words:
            normal = b" ".join([b"", *words, b""]).decode("latin-1")
            end, at = 0, 0
            for last, (n, own) in self.automaton.iter(normal):  # in order of their ends
                end += normal.count(" ", at, last)  # as many words as blanks before the match's last one
                at = last
                matches.append((end - n, end))
                found.update(own)
        return [x[:2] for x in merged(matches)], {self.items[i] for i in found}


def merged(hits: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Ranges of words (``first, end``, then places of the text) put in order; those that meet become one."""
    out: list[tuple[int, ...]] = []
    for first, end, *place in sorted(hits):
        if out and first <= out[-1][1]:
            was = out.pop()
            out.append((was[0], max(was[1], end), *(was[2:3] + (max(was[3], place[1]),) if place else ())))
        else:
            out.append((first, end, *place))
    return out


def leaks_of(items: Broadcast, window: int) -> Leaks:
    """The automaton of a broadcast list of items, built once in each Python worker."""
    held = items.value
    if "leaks" not in held:
        held["leaks"] = Leaks(held["items"], window)
    return held["leaks"]


def placed(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Ranges of words with their places in the original text (code points, end exclusive)."""
    if not ranges:
        return []
    places = [m.span() for m in WORD.finditer(text.decode("utf-8", "surrogateescape"))]
    return [(first, end, places[first][0], places[end - 1][1]) for first, end in ranges]


HIT = ("first", "end", "start", "stop")
FOUND = "doc_id long, n_words long, hits array<struct<first: long, end: long, start: long, stop: long>>, items array<string>"
_HITS = pa.list_(pa.struct([(c, pa.int64()) for c in HIT]))


def found_batch(head: dict[str, pa.Array], hits: list[list[tuple[int, ...]]], items: list[list[str]]) -> pa.RecordBatch:
    rows = pa.array([[dict(zip(HIT, h, strict=True)) for h in own] for own in hits], _HITS)
    return pa.RecordBatch.from_pydict(head | {"hits": rows, "items": pa.array(items, pa.list_(pa.string()))})


def parts_of(items: DataFrame, window: int, most_bytes: int) -> int:
    """Into how many parts the benchmark must be dealt; windows are at most ``window`` times as large as the texts."""
    total = items.agg(F.sum(F.octet_length("item_text") + 16)).first()[0] or 0
    return max(1, -(-total * window // most_bytes))


def scan_texts(docs: DataFrame, items: Broadcast, window: int) -> DataFrame:
    """``key, doc_id, text`` to ``key`` and the columns of ``FOUND``; narrow."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaks = leaks_of(items, window)
        for b in batches:
            n, hits, names = [], [], []
            for text in b.column("text"):
                raw = text.as_py() or b""
                words = words_of(raw)
                ranges, found = leaks.find(words)
                n.append(len(words))
                hits.append(placed(raw, ranges))
                names.append(sorted(found))
            yield found_batch({"key": b.column("key"), "doc_id": b.column("doc_id"), "n_words": pa.array(n, pa.int64())}, hits, names)

    return docs.mapInArrow(scan, f"key long, {FOUND}")


def merge_parts(found: DataFrame) -> DataFrame:
    """Findings of several automata on the same texts to a row for each text."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [merged([tuple(h[c] for c in HIT) for part in own for h in part]) for own in b.column("hits").to_pylist()]
            names = [sorted({x for part in own for x in part}) for own in b.column("items").to_pylist()]
            yield found_batch({"doc_id": b.column("doc_id"), "n_words": b.column("n_words")}, hits, names)

    gathered = found.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items")
    )
    return gathered.drop("key").mapInArrow(merge, FOUND)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_bytes: int = 64 << 20) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans`` for every row of ``docs`` (``doc_id, text``).

    ``items`` are the sorted distinct item ids of which a window occurs, ``spans`` the hit
    passages of the original text (``start, end`` in code points), ``n_hit`` their words.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("item_text")
    ).where("item_text is not null")
    parts = parts_of(items, window, most_bytes)
    held = lambda rows: spark.sparkContext.broadcast({"items": [(r.item_id, bytes(r.item_text)) for r in rows.collect()]})
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    if parts == 1:
        found = scan_texts(read.select(F.lit(0).cast("long").alias("key"), "doc_id", "text"), held(items), window)
    else:
        keyed = cut(read.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"))
        part = F.pmod(F.xxhash64("item_id", "item_text"), F.lit(parts))
        found = merge_parts(reduce(DataFrame.union, [cut(scan_texts(keyed, held(items.where(part == p)), window)) for p in range(parts)]))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["first"])
    spans = F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["stop"].alias("end")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", spans.alias("spans"))
