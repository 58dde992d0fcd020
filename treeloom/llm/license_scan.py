"""License scans by ordered signature rules.

A prefilter (one alternation made from the rules, run where the text is read) passes the
few texts that may hold a license remark.  Those are turned into their lower-cased words,
each set between two blanks, and every rule whose keyword occurs is run on them.
Detections are intervals of words.  One that lies inside another of higher priority, inside
a longer one of the same priority, or has the words of an earlier rule of the same
priority, is suppressed; base phrases are always reported.  All of it
happens inside the row, with built-in expressions: no shuffle, no Python.

A null text is empty (no words, no labels, score 0).  Repeated rows and rows without an id
are each returned; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, whole_text
from .license_rules import PAIRS, STEMS, Rule, rules

# fixed values: what a word is, and the base phrases with their labels
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: The same words in a text that isn't lower-cased, and what stands between words.
_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOUND = "array<struct<first:int,last:int,priority:int,place:int,label:string,weight:double>>"


def prefilter(signatures: Sequence[Rule]) -> str:
    """One case-blind pattern that every text with a detection or a base phrase matches.

    It is made of the stems of license remarks and of the keywords of those rules that may
    match without any of them.
    """
    found = [*STEMS, *(_BETWEEN.join(words) for words in PAIRS)]
    known = re.compile("|".join(found).replace(_BETWEEN, " "))
    for rule in signatures:
        if not all(known.search(run) for run in rule.sure or (rule.keyword,)):
            found.append(re.escape(rule.keyword.strip()).replace(r"\ ", _BETWEEN))
    return "(?i)" + "|".join(dict.fromkeys(found))


def _in_words(piece: Column) -> Column:
    """Number of words in a run of blank-framed words."""
    return (F.length(piece) - F.length(F.translate(piece, " ", ""))).bitwiseAND(-2) / 2


def _intervals(framed: Column, pattern: Column, priority: Column, place: Column, label: Column, weight: Column) -> Column:
    """Word intervals ``first .. last`` of a pattern's matches."""
    found = F.regexp_extract_all(framed, pattern, F.lit(0))
    pieces = F.split(framed, pattern, -1)
    rows = F.arrays_zip(found.alias("m"), F.slice(pieces, F.lit(1), F.size(found)).alias("p"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))

    def step(state: Column, row: Column) -> Column:
        first = (state["at"] + _in_words(row["p"])).cast("int")
        behind = (first + _in_words(row["m"])).cast("int")
        one = F.struct(
            first.alias("first"), (behind - 1).alias("last"), priority.alias("priority"), place.alias("place"),
            label.alias("label"), weight.alias("weight"),
        )
        return F.struct(behind.alias("at"), F.array_append(state["out"], one).alias("out"))

    return F.aggregate(rows, start, step, lambda state: state["out"])


def _framed_phrase(phrase: str) -> str:
    return "".join(f" {w} " for w in phrase.split())


def standing(found: Column, levels: Sequence[int]) -> Column:
    """The detections that no other one suppresses, in one pass.

    Ordered by their first word, longer ones first, then by priority and place, everything
    that may suppress a detection comes before it.  So it is suppressed exactly if one
    before it, of its priority at least, reaches its last word or beyond; the furthest word
    reached is kept for each priority.
    """
    ordered = F.sort_array(F.transform(found, lambda d: F.struct(d["first"].alias("first"), (-d["last"]).alias("back"), (-d["priority"]).alias("above"), d["place"].alias("place"), d.alias("d"))))
    nothing = F.struct(*[F.lit(-1).alias(f"to{p}") for p in levels], F.array().cast(_FOUND).alias("out"))

    def step(state: Column, row: Column) -> Column:
        d, reached = row["d"], F.lit(-1)
        for p in levels:
            reached = F.when(d["priority"] == p, state[f"to{p}"]).otherwise(reached)
        further = [F.when(d["priority"] >= p, F.greatest(state[f"to{p}"], d["last"])).otherwise(state[f"to{p}"]).alias(f"to{p}") for p in levels]
        return F.struct(*further, F.when(reached >= d["last"], state["out"]).otherwise(F.array_append(state["out"], d)).alias("out"))

    return F.aggregate(ordered, nothing, step, lambda state: state["out"])


def scan_licenses(docs: DataFrame, signatures: Sequence[Rule] | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections`` for every row."""
    signatures = rules() if signatures is None else signatures
    text = whole_text()
    columns = ("label", "keyword", "pattern", "priority", "weight")
    table = F.array(
        *[F.struct(F.lit(n).alias("place"), *[F.lit(getattr(r, c)).alias(c) for c in columns]) for n, r in enumerate(signatures)]
    )
    framed = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), "  "), F.lit(" "))
    passed = docs.select(
        "doc_id",
        F.regexp_count(text, F.lit(_ANY_CASE)).cast("long").alias("n_words"),
        F.when(text.rlike(prefilter(signatures)), framed).alias("framed"),
    )

    def of_rule(r: Column) -> Column:
        hits = _intervals(F.col("framed"), r["pattern"], r["priority"], r["place"], r["label"], r["weight"])
        return F.when(F.rlike(F.col("framed"), r["pattern"]), hits).otherwise(F.array().cast(_FOUND))

    gated = F.filter(table, lambda r: F.contains(F.col("framed"), r["keyword"]))
    base = F.concat(
        *[_intervals(F.col("framed"), F.lit(_framed_phrase(p)), F.lit(0), F.lit(0), F.lit(label), F.lit(0.5)) for p, label in BASE.items()]
    )
    none = F.array().cast(_FOUND)
    seen = passed.select(
        "doc_id",
        "n_words",
        F.when(F.col("framed").isNotNull(), base).otherwise(none).alias("base"),
        F.when(F.col("framed").isNotNull(), F.array_distinct(F.flatten(F.transform(gated, of_rule)))).otherwise(none).alias("all"),
    )

    kept = seen.withColumn("detections", F.sort_array(standing(F.col("all"), sorted({r.priority for r in signatures}))))
    names = lambda found: F.array_distinct(F.transform(found, lambda d: d["label"]))
    base_names = names(F.col("base"))
    every = F.array_distinct(F.concat(base_names, names(F.col("detections"))))
    weights = F.transform(F.concat("base", "detections"), lambda d: d["weight"])
    return kept.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["first"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_names), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.coalesce(F.array_max(weights), F.lit(0.0)).alias("score"),
        F.array_join(
            F.transform("detections", lambda d: F.concat_ws(":", d["label"], d["first"].cast("string"), d["last"].cast("string"))), ","
        ).alias("detections"),
    )
