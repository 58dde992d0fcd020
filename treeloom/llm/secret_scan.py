"""Secret scans: fixed patterns, and Markov models of random strings against identifiers.

Two first-order character models are trained from labelled samples, one of random strings
and one of ordinary identifiers.  A long token is taken for a secret when its mean
log-likelihood ratio per character step is above a threshold.  Training counts character
pairs with a group-by (at most two times the squared alphabet comes to the driver);
scoring looks the ratios up in one array literal.  Everything is built-in expressions; the
scan needs no shuffle.  Only texts that the cheap prefilter lets through are taken apart.

Spans are in code points, the end exclusive.  A null text is empty; repeated rows and rows
without an id are each returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole_text

# fixed values: the base patterns, and the lengths their matches need
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX_RUN = r"[0-9a-f]{24,}"
LEAST_VALUE, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
SPAN = "array<struct<start:int,kind:int,end:int>>"

WORDS = """account action active address amount array async back base batch block body buffer build button byte cache call
cell change channel char check child class clear client close code color column command common config connect console
content context control copy count create current cursor data date debug default delete detail device dialog document
domain element empty enable encode end engine entry error event exception execute export factory field file filter find
first flag focus font format frame function generate global graph group handle handler header height hidden host image
import index info init input insert instance integer internal invalid item iterator job key label language last layer
layout length level library limit line link list listener load local lock login main manager map mask match memory menu
merge message method model module mouse move name network next node notify number object offset open option order output
owner package page panel parent parse path pattern pending pixel player point policy pool position previous print process
profile project property protocol provider query queue random range read record region register release remote remove
render replace report request reset resource response result return root route sample scale scene schedule schema screen
search section select sequence server service session setting shadow shape signal size sort source stack start state
status storage stream string style submit system table target task template text thread time timer title total track
transaction transform tree trigger type unique unit update upload user util valid value variable vector version view
visible volume widget width window worker wrapper write zone""".split()


#: Parts of longer words, by language.
PARTS = tuple(
    x.split()
    for x in (
        """ab auf aus bau beit berg bund chaft dienst ein en end ent er erung fahr freund gegen gemein ge geschwind haupt haus
        heit ich ig igkeit isch keit land lich markt nach ordnung post recht regel schaft schein schreib schul sch spiel staat
        stell straß t tag tung über um ung unter ver versicher verwalt vor wasser weise welt wirt wirtschaft zeit zu zug""".replace("ß", "ss").replace("ü", "ue"),
        """a able ac action age al ance ant anti com con de dis ed el en ence ent er est ful graph hood house hyper in ing inter
        ion ism ist ity ive land less light line logic ly man ment micro multi ness non of ology ous out over pre pro re semi
        ship some st super th time tion trans un under up ward water way wh wise with work""",
        """ai ait ant anti au ble ch chant con contre de des eau elle en ence ent er eur eux ier if ion ique ir is ison iste le
        lement ment mer mi non oi ou par que qui re res ois son sous sur té tion tre trice un ure vi vent""".replace("é", "e"),
        """a able aci ado al amiento ando ante ar as bre ci cion con contra dad de des do el en ente era es esta ez ia idad
        iendo ion ista lla los mente mi miento na ncia ndo no os para pro que re ro ta te tra ue un ura za""",
    )
)
UPPER, LOWER, DIGITS = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
#: What random strings are drawn from.
SYMBOLS = (
    ALPHABET[:62], ALPHABET[:64], LOWER + DIGITS, UPPER + DIGITS, UPPER + "234567", UPPER + LOWER, LOWER, UPPER,
)


@lru_cache(maxsize=1)
def labelled_strings(each: int = 1500) -> tuple[tuple[str, int], ...]:
    """The labelled samples, made by rule: random strings (1); ordinary identifiers, words, numbers and rules (0)."""

    def bits(name: str, i: int) -> bytes:
        return hashlib.sha256(f"{name}:{i}".encode()).digest() + hashlib.sha256(f"{i}:{name}".encode()).digest()

    out = []
    for i in range(each):
        b = bits("random", i)
        symbols = SYMBOLS[i % len(SYMBOLS)]
        out.append(("".join(symbols[x % len(symbols)] for x in b[: 24 + i % 24]), 1))
        b = bits("identifier", i)
        known = PARTS[i // 6 % len(PARTS)] if i % 3 == 0 else WORDS
        words = [known[(b[2 * j] * 256 + b[2 * j + 1]) % len(known)] for j in range(3 + i % 4)]
        number = str(b[60] % 100) if i % 5 == 0 else ""
        style = i % 6
        if style == 0:
            name = words[0] + "".join(w.title() for w in words[1:])
        elif style == 1:
            name = "".join(w.title() for w in words)
        elif style == 2:
            name = "_".join(words).upper()
        else:
            name = ("_", "-", "/")[style - 3].join(words)
        out.append((name + number, 0))
        if i % 6 == 1:  # a word of several parts
            known = PARTS[i // 6 % len(PARTS)]
            out.append(("".join(known[x % len(known)] for x in b[20:28]), 0))
        if i % 10 == 2:  # a number
            out.append(("".join(str(x % 10) for x in b[:24]), 0))
    return (*out, *((c * 24, 0) for c in ALPHABET for _ in range(4)))  # rules and fillers


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios, random over ordinary, for every pair of characters of ``ALPHABET``.

    ``samples`` has ``text`` and ``label`` (1 random, 0 ordinary); rows with nulls are left out.
    """
    n = len(ALPHABET)
    t = F.col("text")
    pairs = (
        samples.where("text is not null and label is not null and length(text) > 1")
        .select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: t.substr(i, F.lit(2)))).alias("pair"))
        .where(F.col("pair").rlike(r"\A[A-Za-z0-9+/_=-]{2}\z"))
        .groupBy("label", "pair")
        .count()
    )
    counts = [[[0.0] * n for _ in range(n)] for _ in range(2)]
    for row in pairs.collect():  # at most 2 n squared rows
        counts[int(row.label == 1)][ALPHABET.index(row.pair[0])][ALPHABET.index(row.pair[1])] += row["count"]

    def log_chances(own: list[list[float]]) -> list[list[float]]:
        # a row is smoothed towards the characters' overall shares
        every = [sum(column) + 1.0 for column in zip(*own, strict=True)]
        shares = [x / sum(every) for x in every]
        return [[math.log((c + 8 * s) / (sum(line) + 8)) for c, s in zip(line, shares, strict=True)] for line in own]

    ordinary, random = map(log_chances, counts)
    return [r - o for line_r, line_o in zip(random, ordinary, strict=True) for r, o in zip(line_r, line_o, strict=True)]


def default_ratios(spark: SparkSession) -> list[float]:
    return train(spark.createDataFrame(list(labelled_strings()), "text string, label int"))


def match_spans(text: Column, pattern: str, kind: int, keep=None, group: int | None = None) -> Column:
    """Spans of all matches, left to right; ``keep`` takes a match's text (or group) and says whether it counts."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    tested = found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(found.alias("m"), F.slice(pieces, F.lit(1), F.size(found)).alias("p"), tested.alias("t"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, row: Column) -> Column:
        begin = state["at"] + F.length(row["p"])
        end = begin + F.length(row["m"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        out = F.array_append(state["out"], span)
        return F.struct(end.alias("at"), (out if keep is None else F.when(keep(row["t"]), out).otherwise(state["out"])).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(rows, start, step, lambda state: state["out"])).otherwise(
        F.array().cast(SPAN)
    )


def token_ratio(token: Column, ratios: Sequence[float]) -> Column:
    """Mean log-likelihood ratio per step of a token over ``ALPHABET``."""
    n, table = len(ALPHABET), F.array(*[F.lit(float(x)) for x in ratios])
    numbers = F.transform(F.regexp_extract_all(token, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    steps = F.zip_with(numbers, F.slice(numbers, F.lit(2), F.length(token)), lambda a, b: F.get(table, a * n + b))
    total = F.aggregate(steps, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))  # nothing follows the last
    return total / (F.length(token) - 1)


def scan(docs: DataFrame, ratios: Sequence[float], threshold: float = 0.6) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans`` (arrays of start, kind, end, in order).

    Spans of random tokens that lie inside a base span are left out.  Columns of ``docs``
    with these names are replaced.
    """
    text = whole_text()
    base = F.sort_array(
        F.concat(
            match_spans(text, ASSIGN, 0, lambda v: F.length(v) >= LEAST_VALUE, group=2),
            match_spans(text, ACCESS, 1, lambda m: F.length(m) >= LEAST_ACCESS),
            match_spans(text, HEX_RUN, 2),
        )
    )
    random = match_spans(text, TOKEN, 3, lambda t: token_ratio(t, ratios) > threshold)
    return (
        docs.drop("base_spans", "spans")
        .withColumn("base_spans", base)
        .withColumn(
            "spans",
            F.sort_array(
                F.concat(
                    "base_spans",
                    F.filter(random, lambda r: ~F.exists("base_spans", lambda b: (b["start"] <= r["start"]) & (b["end"] >= r["end"]))),
                )
            ),
        )
    )


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans become one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        between = text.substr(state["at"] + 1, s["start"] - state["at"])
        out = F.when(s["start"] < state["at"], state["out"]).otherwise(F.concat(state["out"], between, F.lit(mark)))
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), out.alias("out"))

    rest = lambda state: F.concat(state["out"], text.substr(state["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, rest))
