"""MinHash near-duplicate detection with tensored banding and exact confirmation.

A document's set holds the hashes of its distinct word shingles.  Equal sets are folded
into one class first, so a group of copies costs one representative, however large it is.

Each representative gets two small collections of ``tables`` band values, every one made
of ``rows`` minhashes.  A table key is a *pair* (value i of the first, value j of the
second collection): ``tables ** 2`` tables of ``2 * rows`` minhashes each come from only
``2 * tables * rows`` minhashes.  Most band values occur once; they are sieved out before
pairs are formed, so only documents that share a value on both sides are expanded.

Inside a table's bucket all members are compared with one hub, the member that meets most
others (a star, linear in the bucket).  Members that are in different components after that
are compared with each other where their differences from the hub allow a link: a prefix
join over the differing shingles, which loses none (see ``loose_pairs``).  Every comparison
runs on full shingle sets.  Buckets, hubs, shingles and classes of copies that hold more
than a thousandth of the rows are spread over several tasks (``salted_join``).

Words are runs of non-blank bytes after lower-casing A-Z; a text with fewer words than a
shingle has one shingle, the whole sequence; a null text or one without words has an
empty set and is linked with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, salted_join


def _odd_constants(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _set_hash(items: np.ndarray) -> int:
    return int(_mix(items * np.uint64(3)).sum(dtype=np.uint64).view(np.int64))


class Shingler:
    """Distinct shingle hashes of a text; word hashes are memoised up to a fixed number of words."""

    def __init__(self, width: int, memo: int = 200_000):
        self.width, self.memo, self.seen = width, memo, {}
        self.factors = _odd_constants(width, 11)

    def _word(self, word: bytes) -> int:
        if len(self.seen) >= self.memo:
            self.seen.clear()
        value = xxhash.xxh3_64_intdigest(word)
        self.seen[word] = value
        return value

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        seen, slow = self.seen, self._word
        h = np.array([seen.get(w) or slow(w) for w in words], dtype=np.uint64)
        width = min(self.width, len(h))
        total = np.full(len(h) - width + 1, len(h) if width < self.width else 0, np.uint64)
        for k in range(width):
            total += _mix(h[k : k + len(total)] * self.factors[k])
        return np.unique(_mix(total))


def _bands(sets: np.ndarray, mul: np.ndarray, add: np.ndarray, rows: int, weights: np.ndarray) -> np.ndarray:
    """Band values of one set; long sets are taken in blocks to bound memory."""
    low = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 4096):
        block = sets[at : at + 4096, None] * mul[None, :] + add[None, :]
        np.minimum(low, (block ^ (block >> np.uint64(33))).min(axis=0), out=low)
    return _mix((_mix(low).reshape(-1, rows) * weights[None, :]).sum(axis=1, dtype=np.uint64)).view(np.int64)


def missed(percent: int, tables: int, rows: int) -> float:
    """Chance that a pair of exactly this similarity meets in no table: it must share a band value on both sides."""
    return 1 - (1 - (1 - (percent / 100) ** rows) ** tables) ** 2


def tables_for(percent: int, rows: int, miss: float = 1e-4) -> int:
    """The fewest band values of a side with which a pair at the threshold is missed with at most this chance."""
    if percent >= 100:  # equal sets are one class before banding
        return 1
    return math.ceil(math.log(1 - math.sqrt(1 - miss)) / math.log(1 - (percent / 100) ** rows))


def near_duplicates(
    docs: DataFrame, shingle: int = 3, percent: int = 85, tables: int | None = None, rows: int = 4, seed: int = 7
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents are linked when ``100 * |intersection| >= percent * |union|``; a component's
    id is its smallest doc_id and that document is kept.  ``tables`` and ``rows`` set the
    banding.  By default ``tables`` follows from ``percent`` so that a pair at the threshold
    itself meets in no table with a chance of at most 0.0001 (85: 14 tables, 0.00007; 80:
    19 tables, 0.00009); pairs above it are missed less.

    Repeated rows are each returned, with the same component.  Where rows of one doc_id have
    different texts, each gets the component of its own text, and each text is compared with
    all others: classes of equal sets have numbers of their own.  A row without a doc_id is
    in no component and is kept.  Extra columns are ignored; an empty table gives no rows.
    """
    tables = tables_for(percent, rows) if tables is None else tables
    mul, add = _odd_constants(2 * tables * rows, seed), _odd_constants(2 * tables * rows, seed + 1)
    weights = _odd_constants(rows, seed + 2)

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(shingle)
        for b in batches:
            n, set_a, set_b, bands = [], [], [], []
            for text in b["text"]:
                s = shingles(text)
                n.append(len(s))
                set_a.append(_set_hash(s))
                set_b.append(int(np.bitwise_xor.reduce(_mix(s + np.uint64(77))).view(np.int64)) if len(s) else 0)
                bands.append(_bands(s, mul, add, rows, weights) if len(s) else [])
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_shingles": n, "set_a": set_a, "set_b": set_b, "bands": bands})

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    features = cut(
        source.mapInPandas(featurise, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")
    )
    same_set = ["set_a", "set_b", "n_shingles"]
    linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    classes = cut(  # numbered once, as they are written
        features.where(linkable)
        .groupBy(*same_set)
        .agg(F.min("doc_id").alias("least"), F.count("*").alias("count"), F.min_by("bands", "doc_id").alias("bands"))
        .withColumn("rep", F.monotonically_increasing_id())
    )

    stars = cut(star_pairs(classes.select("rep", "bands"), tables))
    around = hot_keys(stars.groupBy("hub").count(), "hub")
    met = stars.select(F.explode(F.array("hub", "rep")).alias("rep")).distinct()
    sets = cut(shingle_sets(source, classes.join(met, "rep").select(F.col("least").alias("doc_id"), "set_a", "rep"), shingle))
    compared = cut(common_shingles(stars, sets, around))
    found = components(compared.where(alike(percent)).select(F.col("hub").alias("a"), F.col("rep").alias("b")))

    loose = cut(loose_pairs(compared, found, sets, percent, around))
    often = hot_keys(loose.groupBy("a").count(), "a")
    more = cut(common_shingles(loose, sets, often, "a", "b").where(alike(percent, "a", "b")).select("a", "b"))
    if not more.isEmpty():
        renamed = more.join(found.toDF("a", "ca"), "a", "left").join(found.toDF("b", "cb"), "b", "left")
        merged = components(renamed.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b"))
        every = found.union(more.select(F.explode(F.array("a", "b")).alias("node")).select("node", F.col("node").alias("component")))
        found = cut(
            every.groupBy("node").agg(F.min("component").alias("was"))
            .join(merged.toDF("was", "now"), "was", "left")
            .select("node", F.coalesce("now", "was").alias("component"))
        )

    # a component is called by the smallest doc_id of its classes
    linked = cut(classes.select("rep", "least").join(found.toDF("rep", "component"), "rep"))
    called = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("count"))
    crowded = hot_keys(called, "component")
    shared = salted_join(linked, called.drop("count"), "component", crowded, "rep").select("rep", "component_id")
    named = classes.join(shared, "rep", "left").select(*same_set, F.coalesce("component_id", "least").alias("component_id"))
    # copies of one text: a class with many rows is spread
    many = hot_keys(classes.select("set_a", "count").groupBy("set_a").agg(F.sum("count").alias("count")), "set_a")
    spread = features.where(linkable).select("doc_id", *same_set, F.rand(seed).alias("by"))
    placed = salted_join(
        spread, named.withColumnsRenamed({"set_b": "other_b", "n_shingles": "other_n"}), "set_a", many, "by"
    ).where("set_b = other_b and n_shingles = other_n")
    alone = features.where(~linkable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return (
        placed.select("doc_id", "n_shingles", "component_id")
        .union(alone)
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def star_pairs(classes: DataFrame, tables: int) -> DataFrame:
    """``hub, rep``: in each table's bucket every representative beside the one that meets most others.

    Representatives that share a band value with nobody on one of the sides, and those that
    are alone in their bucket, don't occur.
    """
    left = F.col("nth") < tables
    posted = classes.select("rep", F.posexplode("bands").alias("nth", "value")).select(
        "rep", "nth", F.xxhash64("nth", "value").alias("band")
    )
    several = lambda df, key: cut(df.groupBy(key).agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("count")).where("low < high").select(key, "count"))  # noqa: E731, E501
    shared = several(posted, "band")
    sides = (
        salted_join(posted, shared.select("band"), "band", hot_keys(shared, "band"), "rep")
        .groupBy("rep")
        .agg(F.collect_set(F.when(left, F.col("band"))).alias("left"), F.collect_set(F.when(~left, F.col("band"))).alias("right"))
    )
    keys = cut(
        sides.select("rep", F.explode("left").alias("l"), "right")
        .select("rep", "l", F.explode("right").alias("r"))
        .select("rep", F.xxhash64("l", "r").alias("key"))
    )
    shared = several(keys, "key")
    hot = hot_keys(shared, "key")
    met = cut(salted_join(keys, shared, "key", hot, "rep"))
    central = met.groupBy("rep").agg(F.sum("count").alias("meets"))
    hubs = met.join(central, "rep").groupBy("key").agg(F.max_by("rep", F.struct("meets", -F.col("rep"))).alias("hub"))
    return salted_join(met.select("key", "rep"), hubs, "key", hot, "rep").where("rep != hub").select("hub", "rep").distinct()


def shingle_sets(source: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``rep, items`` (sorted shingle hashes) of the wanted classes (``doc_id`` of a member, ``set_a``, ``rep``)."""

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(shingle)
        for b in batches:
            own = [shingles(t) for t in b["text"]]
            right = [_set_hash(s) == h for s, h in zip(own, b["set_a"], strict=True)]
            yield pd.DataFrame({"rep": b["rep"][right], "items": [s.view(np.int64) for s, r in zip(own, right, strict=True) if r]})

    return source.join(wanted, "doc_id").mapInPandas(to_sets, "rep long, items array<long>").dropDuplicates(["rep"])


def _with_sets(pairs: DataFrame, sets: DataFrame, hot: dict[int, int], a: str, b: str) -> DataFrame:
    side = lambda name: sets.select(F.col("rep").alias(name), F.col("items").alias(f"items_{name}"))
    return salted_join(pairs.join(side(b), b), side(a), a, hot, b)


def common_shingles(pairs: DataFrame, sets: DataFrame, hot: dict[int, int], a: str = "hub", b: str = "rep") -> DataFrame:
    """``a, b`` with the sizes of both full sets and of their intersection; ``hot``: values of ``a`` in many pairs."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x, y = rows[f"items_{a}"], rows[f"items_{b}"]
            both = [len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(x, y, strict=True)]
            yield pd.DataFrame({a: rows[a], b: rows[b], f"n_{a}": x.map(len), f"n_{b}": y.map(len), "both": both})

    return _with_sets(pairs.select(a, b), sets, hot, a, b).mapInPandas(
        compare, f"{a} long, {b} long, n_{a} long, n_{b} long, both long"
    )


def alike(percent: int, a: str = "hub", b: str = "rep") -> str:
    return f"100 * both >= {percent} * (n_{a} + n_{b} - both)"


def loose_pairs(compared: DataFrame, found: DataFrame, sets: DataFrame, percent: int, around: dict[int, int]) -> DataFrame:
    """``a, b``: pairs of one hub's members that may be linked though the components keep them apart.

    Let ``D`` be the shingles in which a member differs from its hub (those that it adds and
    those that it lacks), ``d`` their number, ``n`` the size of its set.  Two members differ
    in ``d + d' - 2 |D and D'|`` shingles, and a link allows ``q (n + n')`` with
    ``q = (100 - percent) / (100 + percent)``.  So a link needs an overlap of
    ``o = (s + s') / 2`` with ``s = d - q n``.  Members of different components can't both
    be linked to the hub; one is loose, which means ``s > q n_hub``.  From this follow

    * ``o >= 1``: the two share a shingle of their ``D``;
    * for a member beside a loose one ``o > (s + q n_hub) / 2``;
    * for a loose one beside anyone ``o >= (s - q n_hub) / (1 + q)``, as ``n' <= n_hub + d'``
      and ``o <= d'``.

    Only shingles met in several components can be shared.  They are ordered from rare to
    common, and by the prefix principle a pair that shares ``o`` of them shares one among
    all but the last ``o - 1`` of either; its first one leaves room for the others behind it.
    """
    over, under = 100 + percent, 100 - percent  # all figures below are times ``over``
    component = lambda name: found.select(F.col("node").alias(name), F.col("component").alias(f"c_{name}"))
    members = salted_join(compared.join(component("rep"), "rep", "left"), component("hub"), "hub", around, "rep", "left").select(
        "hub", "rep", F.col("n_rep").alias("n"), (F.col("n_hub") + F.col("n_rep") - 2 * F.col("both")).alias("d"),
        (under * F.col("n_hub")).alias("h"), (~F.expr(alike(percent))).alias("loose"),
        F.coalesce("c_rep", "rep").alias("component"), (F.coalesce("c_rep", "rep") != F.coalesce("c_hub", "hub")).alias("apart"),
    )
    members = cut(members.withColumn("s", over * F.col("d") - under * F.col("n")))
    apart = members.where("apart").select("hub").distinct()
    members = salted_join(members, apart, "hub", around, "rep").drop("apart")

    def differing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            own = [np.setxor1d(s, t, assume_unique=True) for s, t in zip(rows["items_hub"], rows["items_rep"], strict=True)]
            long = np.array([len(i) for i in own], dtype=np.int64)
            columns = {c: np.repeat(rows[c].to_numpy(), long) for c in ("hub", "rep", "component")}
            yield pd.DataFrame(columns | {"item": np.concatenate([*own, np.empty(0, np.int64)])})

    posted = cut(
        _with_sets(members.select("hub", "rep", "component"), sets, around, "hub", "rep")
        .mapInPandas(differing, "hub long, rep long, component long, item long")
        .select("hub", "rep", "component", F.xxhash64("hub", "item").alias("spot"))
    )
    shared = cut(
        posted.groupBy("spot")
        .agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("count"))
        .where("c0 < c1")
        .select("spot", "count")
    )
    hot = hot_keys(shared, "spot")
    listed = (
        salted_join(posted.select("hub", "rep", "spot"), shared, "spot", hot, "rep")
        .groupBy("hub", "rep")
        .agg(F.sort_array(F.collect_list(F.struct("count", "spot"))).alias("spots"))
        .join(members, ["hub", "rep"])
        .withColumn("m", F.size("spots"))
    )
    needs = lambda bound: F.greatest(F.lit(1), F.ceil(bound)).cast("int")
    beside_loose = needs((F.col("s") + F.col("h") + 1) / (2 * over))
    beside_any = needs((F.col("s") - F.col("h")) / 200)

    def prefix(rows: DataFrame, least: Column) -> DataFrame:
        kept = rows.withColumn("least", least).where("m >= least")
        cut_off = F.slice("spots", F.lit(1), F.col("m") - F.col("least") + 1)
        return kept.select("rep", "n", "d", "s", "m", "component", "loose", F.posexplode(cut_off).alias("at", "spot")).select(
            "rep", "n", "d", "s", (F.col("m") - F.col("at")).alias("behind"), "component", "loose", "spot.spot"
        )

    listed = cut(listed)
    x, y = prefix(listed.where("loose"), beside_any), prefix(listed, beside_loose)
    renamed = x.select("spot", *[F.col(c).alias(f"x_{c}") for c in x.columns if c != "spot"])
    return (
        salted_join(y, renamed, "spot", hot, "rep")
        .where(
            f"""component != x_component and (not loose or x_rep < rep)
            and 100 * least(n, x_n) >= {percent} * greatest(n, x_n)
            and {over} * abs(d - x_d) <= {under} * (n + x_n)
            and {2 * over} * least(behind, x_behind) >= s + x_s"""
        )
        .select(F.least("rep", "x_rep").alias("a"), F.greatest("rep", "x_rep").alias("b"))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node that has a link.

    Labels pass along the links and then jump to their label's label, so the number of
    rounds follows the logarithm of the longest path; each round cuts its lineage.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    while True:
        passed = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        stepped = labels.join(passed, F.col("node") == F.col("a")).select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("to")
        )
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("further"))
        moved = cut(
            stepped.join(jump, "to", "left").select("node", "was", F.least("to", "further").alias("component"))
        )
        labels = moved.select("node", "component")
        if moved.where("component < was").isEmpty():
            return labels
