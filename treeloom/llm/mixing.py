"""Mixing sources to target weights with soft domain membership.

1. A naive Bayes classifier over the presence of words is trained from a labelled table
   (document, domain): at most ``sample_rows`` labelled documents, ``vocabulary`` words.  It
   gives every document a posterior over the domains, tempered.
2. Documents whose posteriors fall into the same cell of a grid of ``1 / grain`` (at least
   four steps for each domain) get the same rate.  A cell holds its documents' tokens and
   expected domain tokens, added up from the posteriors themselves, so the grid ties rates
   together but rounds no total.
3. Nonnegative rates are fitted by accelerated projected gradient least squares: each
   iteration is one aggregation over the cells (expected domain tokens at the current
   rates); the rates are a function of the residuals seen so far, so nothing but a few
   numbers per iteration is kept.  The step follows from the largest eigenvalue of the
   token-weighted second moments of the posteriors, in the metric weighted by tokens.
4. ``copies`` rounds a rate up or down by a hash of the document, so that expected counts
   are kept.

A token is a word here: every row's expressions are built-in ones, and a tokenizer would
need Python.  Everything on the rows is built-in expressions.  A null or empty text has no tokens and
the prior as its posterior.  Repeated rows and rows without an id are each returned; a
labelled table without known domains gives equal posteriors; an empty table gives no rows.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_text

SLOTS = 4096
ADDED = ("mix_words", "mix_found", "mix_cell", "mix_tokens", "posterior", "rate", "copies")
#: Cells up to this number are sent to every task or fitted on the driver; more are joined and fitted by Spark.
FEW_CELLS = 100_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


class DomainModel:
    """Words' slots in a fixed table and, for each domain, log-odds by slot and a constant."""

    def __init__(self, domains: list[str], words: list[str], odds: list[list[float]], constants: list[float]):
        self.domains, self.words, self.odds, self.constants = domains, words, odds, constants


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], vocabulary: int = 512, sample_rows: int = 4000) -> DomainModel:
    """Presence naive Bayes from ``labelled`` (``doc_id, domain``), trained on the rows with the smallest id hashes."""
    chosen = (
        labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("domain").alias("domain"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    # ``sample_rows`` at most, so it may be broadcast
    sample = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    seen = sample.select("domain", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    counted = seen.groupBy("word").pivot("domain", domains).count().na.fill(0)
    sizes = {r.domain: r["count"] for r in sample.groupBy("domain").count().collect()}
    n = [sizes.get(d, 0) for d in domains]
    share = lambda k: (F.col(f"`{domains[k]}`") + 0.5) / (n[k] + 1.0)
    logs = [F.log(share(k)) for k in range(len(domains))]
    total = sum(F.col(f"`{d}`") for d in domains)
    spread = F.greatest(*logs) - F.least(*logs) if len(domains) > 1 else F.lit(0.0)
    top = (
        counted.withColumn("slot", F.pmod(F.xxhash64("word"), F.lit(SLOTS)))
        .where(total >= 3)
        .orderBy(F.desc(spread * F.sqrt(total)), "word")
        .limit(vocabulary)
        .collect()  # ``vocabulary`` rows at most
    )
    words, taken = [], set()
    odds = [[0.0] * SLOTS for _ in domains]
    constants = [math.log((x + 1) / (sum(n) + len(n))) for x in n]
    for row in top:
        if row.slot in taken:  # the stronger word keeps a shared slot
            continue
        taken.add(row.slot)
        words.append(row.word)
        for k, d in enumerate(domains):
            p = (row[d] + 0.5) / (n[k] + 1.0)
            odds[k][row.slot] = math.log(p / (1 - p))
            constants[k] += math.log(1 - p)
    return DomainModel(domains, words, odds, constants)


def with_cells(docs: DataFrame, model: DomainModel, grain: int = 32, temperature: float = 4.0) -> DataFrame:
    """``docs`` with ``mix_tokens``, ``posterior`` and ``mix_cell`` (the posterior in units of ``1 / grain``)."""
    grain = max(grain, 4 * len(model.domains))
    own = docs.drop(*ADDED).withColumn("mix_words", words_of(whole_text()))
    if model.words:
        vocabulary = F.array(*[F.lit(w) for w in model.words])
        slots = F.transform(F.array_intersect("mix_words", vocabulary), lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int"))
    else:
        slots = F.array().cast("array<int>")
    tables = [F.split(F.lit(",".join(map(repr, line))), ",").cast("array<double>") for line in model.odds]  # folded into one constant

    def cell(found: Column) -> Column:
        def added(table: Column, constant: float) -> Column:
            return F.aggregate(found, F.lit(constant), lambda a, i: a + F.get(table, i))

        scores = F.array(*[added(t, c) for t, c in zip(tables, model.constants, strict=True)])
        return _with(scores, lambda s: _with(
            F.transform(s, lambda x: F.exp((x - F.array_max(s)) / temperature)),
            lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)),
        ))

    return (
        own.withColumn("mix_tokens", F.size("mix_words").cast("long"))
        .withColumn("mix_found", _with(_with(slots, cell), lambda p: F.struct(p.alias("p"), F.transform(p, lambda x: F.round(grain * x).cast("int")).alias("cell"))))
        .drop("mix_words")
        .withColumns({"posterior": F.col("mix_found.p"), "mix_cell": F.col("mix_found.cell")})
        .drop("mix_found")
    )


def _with(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class RateFit:
    """The residuals seen by the fit; ``rate`` replays them for any posterior."""

    def __init__(self, step: float, least: float, most: float | None):
        self.step, self.least, self.most = step, least, most
        self.moves: list[tuple[float, list[float]]] = []

    def _bounded(self, r: Column) -> Column:
        r = F.greatest(F.lit(self.least), r)
        return r if self.most is None else F.least(F.lit(self.most), r)

    def _replay(self, posterior: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("was"))
        if not self.moves:
            return start
        moves = F.array(
            *[F.struct(F.lit(b).alias("b"), F.array(*[F.lit(x) for x in e]).alias("e")) for b, e in self.moves]
        )

        def move(state: Column, m: Column) -> Column:
            ahead = state["r"] + m["b"] * (state["r"] - state["was"])
            slope = F.aggregate(F.zip_with(posterior, m["e"], lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
            return F.struct(self._bounded(ahead - self.step * slope).alias("r"), state["r"].alias("was"))

        return F.aggregate(moves, start, move)

    def rate(self, posterior: Column) -> Column:
        return self._replay(posterior)["r"]

    def go_on(self, posteriors: np.ndarray, tokens: np.ndarray, target: np.ndarray, t: float, further: int, slack: float, close: float) -> None:
        """More of the same moves, over the cells' values themselves."""
        rate = was = np.ones(len(tokens))
        most = math.inf if self.most is None else self.most
        moved = lambda r, was, b, e: np.clip(r + b * (r - was) - self.step * (posteriors @ e), self.least, most)
        for b, e in self.moves:
            rate, was = moved(rate, was, b, np.array(e)), rate
        for n in range(further + 1):
            off = posteriors.T @ (tokens * rate) - target
            if (abs(off) <= np.maximum(close * target, slack)).all():
                return
            if n == further:
                break
            later = (1 + math.sqrt(1 + 4 * t * t)) / 2
            momentum = (t - 1) / later if self.moves else 0.0
            t = later
            residual = posteriors.T @ (tokens * (rate + momentum * (rate - was))) - target
            self.moves.append((float(momentum), [float(x) for x in residual]))
            rate, was = moved(rate, was, momentum, residual), rate
        got = posteriors.T @ (tokens * rate)
        warn_missed(got, target)

    def ahead(self, posterior: Column, momentum: float) -> Column:
        return _with(self._replay(posterior), lambda s: s["r"] + momentum * (s["r"] - s["was"]))


def warn_missed(got: np.ndarray, target: np.ndarray) -> None:
    shares = (got / max(got.sum(), 1e-300)).round(4).tolist()
    warnings.warn(f"targets missed: shares {shares}, not {(target / target.sum()).round(4).tolist()}", stacklevel=4)


def fit_rates(
    cells: DataFrame, shares: list[float], budget: float | None = None, least: float = 0.0, most: float | None = None,
    iterations: int = 40, tolerance: float = 1e-4, further: int = 0, close: float = 0.01,
) -> RateFit:
    """Fit rates to ``cells`` (``posterior array<double>, tokens``); ``budget``: total of the mixed tokens.

    While a domain is further than the share ``close`` from its target after ``iterations``,
    up to ``further`` more follow on the driver, over the bounded table of cells.  A warning
    gives the shares where the targets are missed all the same.
    """
    k = len(shares)
    at = lambda i: F.get("posterior", F.lit(i))
    moments = cells.agg(
        F.sum("tokens").alias("total"),
        *[F.sum(F.col("tokens") * at(i)).alias(f"n{i}") for i in range(k)],
        *[F.sum(F.col("tokens") * at(i) * at(j)).alias(f"m{i}_{j}") for i in range(k) for j in range(k)],
    ).first()
    if not moments.total:
        return RateFit(0.0, least, most)
    own = [moments[f"n{i}"] for i in range(k)]
    if budget is None:  # the least total that needs no domain thinned out
        budget = max(n / s for n, s in zip(own, shares, strict=True) if s > 0)
    target = [budget * s for s in shares]
    second = np.array([[moments[f"m{i}_{j}"] for j in range(k)] for i in range(k)])
    fit = RateFit(1.0 / float(np.linalg.eigvalsh(second).max()), least, most)
    t = 1.0
    for _ in range(iterations):
        later = (1 + math.sqrt(1 + 4 * t * t)) / 2
        momentum = (t - 1) / later if fit.moves else 0.0
        t = later
        rated = cells.withColumn("mix_rate", fit.ahead(F.col("posterior"), momentum))
        sums = rated.agg(*[F.sum(F.col("tokens") * at(i) * F.col("mix_rate")).alias(f"s{i}") for i in range(k)]).first()
        residual = [sums[f"s{i}"] - target[i] for i in range(k)]
        if max(map(abs, residual)) <= tolerance * budget:
            return fit
        fit.moves.append((momentum, residual))
    if further and cells.count() <= FEW_CELLS:
        rows = cells.select("posterior", "tokens").collect()
        fit.go_on(np.array([r.posterior for r in rows]), np.array([r.tokens for r in rows]), np.array(target), t, further, tolerance * budget, close)
        return fit
    final = cells.withColumn("mix_rate", fit.rate(F.col("posterior")))
    sums = final.agg(*[F.sum(F.col("tokens") * at(i) * F.col("mix_rate")).alias(f"s{i}") for i in range(k)]).first()
    got = [sums[f"s{i}"] for i in range(k)]
    if any(abs(g - x) > max(close * x, tolerance * budget) for g, x in zip(got, target, strict=True)):
        warn_missed(np.array(got), np.array(target))
    return fit


def mix(
    docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], keep_all: bool = False, most: float | None = None, grain: int = 32
) -> DataFrame:
    """``docs`` with ``mix_tokens, posterior, rate, copies``.

    ``targets``: weight of each domain in the mix.  The mix has as many tokens as ``docs``;
    with ``keep_all`` rates start at 1 and the mix is as large as that requires.  ``most``
    caps the rates; with it, a domain that needs more copies stays below its target.  Columns
    of ``docs`` named like the added ones are replaced.
    """
    domains = sorted(targets)
    total = sum(targets.values())
    shares = [targets[d] / total for d in domains]
    model = train(docs, labelled, domains)
    celled = with_cells(docs, model, grain)
    weighed = [F.sum(F.col("mix_tokens") * F.get("posterior", F.lit(i))).alias(f"w{i}") for i in range(len(domains))]
    cells = cut(celled.groupBy("mix_cell").agg(F.sum("mix_tokens").cast("double").alias("tokens"), F.min("posterior").alias("any"), *weighed))
    few = cells.count() <= FEW_CELLS
    mean = F.array(*[F.col(f"w{i}") / F.col("tokens") for i in range(len(domains))])
    cells = (cells.coalesce(1) if few else cells).select("mix_cell", F.when(F.col("tokens") > 0, mean).otherwise(F.col("any")).alias("posterior"), "tokens")
    budget = None if keep_all else cells.agg(F.sum("tokens")).first()[0] or 0.0
    fit = fit_rates(cells, shares, budget, 1.0 if keep_all else 0.0, most, further=360 if keep_all else 0)
    rates = cells.select("mix_cell", fit.rate(F.col("posterior")).alias("rate"))
    # every cell is found; an outer join needs no test for nulls, for which Spark would work out the cells twice
    rated = celled.join(F.broadcast(rates) if few else rates, "mix_cell", "left").drop("mix_cell")
    part = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1_000_000)) / 1_000_000.0
    copies = (F.floor("rate") + F.when(part < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return rated.withColumn("copies", copies).select(*[c for c in docs.columns if c not in ADDED], "mix_tokens", "posterior", "rate", "copies")
