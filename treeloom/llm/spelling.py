"""Spelling variants: words at one edit from each other, found by automata over word halves.

Where two words differ by one inserted, deleted or replaced code point, the edit lies in
one half of either, so the other half stands unchanged in both: a first half at the start,
a second half at the end.  Both halves of every word are dealt to shards by their hash; a
shard's halves make one Aho-Corasick automaton.  Every word visits the shards in which
halves of a word of fitting length could lie (at most four), and is scanned there once.  A
match counts if it lies at the right end of the word and belongs to a word whose length
differs by one at most.  The other halves are then one edit apart; the words of one half
are indexed by their other half (whole, with one place open, and with one place missing),
so verifying takes a few look-ups for each word however many words share the half, and
gives only true pairs, each once.

A half that more than a thousandth of all words share is spread over several shards; words
that could meet it visit all of them.  Only counts and the best near word of each visit
leave a task.

Edge cases: a null text has no words, a null doc_id counts as the empty string where the
run is hashed; repeated rows count each; extra columns are ignored; an empty table, or one
without words that are frequent enough, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, hot_keys

#: Letters of words; runs are lower-cased before they are found, so capitals needn't stand here.
RUN = r"[a-zÀ-ÿ]+"
#: A run whose hash this divides loses one letter.
SLIP = 97


def count_words(docs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """``word, n``: the words of the whole texts that are long and frequent enough."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
        F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"({RUN})"), F.lit(1))).alias("run"),
    )
    hashed = runs.select("run", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def without(word: str, at: int, mark: str = "") -> str:
    return word[:at] + mark + word[at + 1 :]


class Others:
    """The words of one length that share a half, by their other half."""

    def __init__(self):
        self.whole: dict[str, tuple[int, str]] = {}
        self.open: dict[str, list[tuple[int, str]]] = {}
        self.short: dict[str, list[tuple[int, str]]] = {}

    def add(self, other: str, found: tuple[int, str]) -> None:
        self.whole[other] = found
        for at in range(len(other)):
            self.open.setdefault(without(other, at, "\0"), []).append(found)
        for key in {without(other, at) for at in range(len(other))}:
            self.short.setdefault(key, []).append(found)

    def near(self, other: str, longer: int) -> Iterator[tuple[int, str]]:
        """Words whose other half is one edit away and ``longer`` by -1, 0 or 1."""
        if longer > 0:
            yield from self.short.get(other, ())
        elif longer < 0:
            for key in {without(other, at) for at in range(len(other))}:
                if key in self.whole:
                    yield self.whole[key]
        else:
            own = self.whole.get(other)
            for at in range(len(other)):
                for found in self.open.get(without(other, at, "\0"), ()):
                    if found is not own:
                        yield found


class Halves:
    """One shard: an automaton over the halves of its words."""

    def __init__(self):
        self.held: dict[str, dict[tuple[bool, int], Others]] = {}
        self.automaton = None

    def add(self, second: bool, word: str, n: int) -> None:
        middle = len(word) // 2
        half, other = (word[middle:], word[:middle]) if second else (word[:middle], word[middle:])
        self.held.setdefault(half, {}).setdefault((second, len(word)), Others()).add(other, (-n, word))

    def near(self, word: str) -> Iterator[tuple[int, str]]:
        """``-n, near word`` for the words of this shard that are one edit from ``word``, each once."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for half, groups in self.held.items():
                self.automaton.add_word(half, (len(half), groups))
            if self.held:
                self.automaton.make_automaton()
        if not self.held:
            return
        size = len(word)
        for last, (n, groups) in self.automaton.iter(word):
            for (second, length), others in groups.items():
                longer = length - size
                if not -1 <= longer <= 1:
                    continue
                if not second and last + 1 == n:
                    yield from others.near(word[n:], longer)
                elif second and last + 1 == size:
                    first = length - n
                    # where both halves stand, the first one has given the pair
                    yield from (f for f in others.near(word[: size - n], longer) if not word.startswith(f[1][:first]))


def _home(spot: Column, part: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(spot, part), F.lit(shards)).cast("int")


def near_words(words: DataFrame, shard_words: int = 20_000) -> DataFrame:
    """``word, n_near, neg_n, form``: for each word that has near words their number and the best of them.

    ``words`` has distinct ``word, n``.  The best is the one of largest n (``-neg_n``), then
    the smallest in code-point order.  A shard holds about ``shard_words`` halves at most.
    """
    spark = words.sparkSession
    shards = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * words.count() // shard_words))
    spot = lambda second, half: F.xxhash64(F.lit(second), half)
    size = F.length("word")
    head = lambda length: F.substring("word", F.lit(1), F.floor(length / 2).cast("int"))
    tail = lambda length: F.substring("word", (size - F.ceil(length / 2) + 1).cast("int"), size)

    halves = words.select("word", "n", F.posexplode(F.array(spot(0, head(size)), spot(1, tail(size)))).alias("second", "spot"))
    hot = hot_keys(halves.groupBy("spot").count(), "spot")
    table = F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]) if hot else None
    parts = lambda s: F.coalesce(table[s], F.lit(1)) if hot else F.lit(1)
    built = halves.select(
        _home(F.col("spot"), F.pmod(F.xxhash64("word"), parts(F.col("spot"))).cast("int"), shards).alias("shard"),
        F.lit(False).alias("asks"), "word", "n", (F.col("second") == 1).alias("second"),
    )
    lengths = [size - 1, size, size + 1]
    asked = F.array_distinct(F.array(*[spot(0, head(m)) for m in lengths], *[spot(1, tail(m)) for m in lengths]))
    homes = F.array_distinct(F.flatten(F.transform(asked, lambda s: F.transform(F.sequence(F.lit(0), parts(s) - 1), lambda p: _home(s, p, shards)))))
    asks = words.select(F.explode(homes).alias("shard"), F.lit(True).alias("asks"), "word", "n", F.lit(False).alias("second"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, halves = None, Halves()
        for b in batches:
            out = []
            for at, question, word, n, second in zip(b["shard"], b["asks"], b["word"], b["n"], b["second"], strict=True):
                if at != shard:
                    shard, halves = at, Halves()
                if not question:
                    halves.add(second, word, n)
                elif found := list(halves.near(word)):
                    out.append((word, len(found), *min(found)))
            yield pd.DataFrame(out, columns=["word", "n_near", "neg_n", "form"])

    dealt = built.union(asks).repartition("shard").sortWithinPartitions("shard", "asks")
    found = dealt.mapInPandas(scan, "word string, n_near long, neg_n long, form string")
    best = F.min(F.struct("neg_n", "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.neg_n", "best.form")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form`` rows: the last form that is reached.

    A form is at least twice as frequent as its word, so there are no circles; each round
    doubles the steps taken, and its result is written before the next.
    """
    found = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = cut(found.join(further, "root", "left").select("word", "root", "next"))
        if stepped.where("next is not null").isEmpty():
            return found
        found = stepped.select("word", F.coalesce("next", "root").alias("root"))


def group_spellings(docs: DataFrame, least_length: int = 5, least_count: int = 3, factor: int = 2, shard_words: int = 20_000) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every word of the texts.

    ``form`` is the near word of largest n if that is at least ``factor`` times (above 1)
    the word's own, else null; ``root`` is the end of the chain of forms, or the word.
    """
    if factor <= 1:
        raise ValueError("a form must be more frequent than its word, else chains may be circles")
    words = cut(count_words(docs, least_length, least_count))
    near = words.join(near_words(words, shard_words), "word", "left")
    takes = -F.col("neg_n") >= factor * F.col("n")
    named = cut(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("form")).alias("form"), F.when(takes, -F.col("neg_n")).alias("form_n"),
    ))
    ends = roots(named.where("form is not null"))
    return named.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
