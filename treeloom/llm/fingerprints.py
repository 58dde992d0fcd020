"""Document fingerprints from closed syncmers over words.

A k-mer of ``k`` words is chosen when the smallest hash among its inner runs of ``s`` words
belongs to the first or the last of them.  Whether a k-mer is chosen depends on its own
words alone, so the same passage gives the same anchors wherever it stands, and an edit
touches only the k-mers that cover it.  A fingerprint lists the anchors in text order as
``hash@word`` (8 hex digits, place of its first word); likeness is the Jaccard similarity
of two fingerprints' distinct hashes.

Words are runs of characters above the blank.  A text with fewer than ``k`` words has one
anchor, all of its words; one without words has an empty fingerprint.  Two empty
fingerprints are alike (1), an empty and another are not (0).  Everything is made of
built-in expressions; one shuffle brings each document beside its successor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text

K, S = 6, 2
_LEAST = -(1 << 63)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """``array<struct<word int, hash long>>``: the closed syncmers of a text; ``k`` is a multiple of ``s``."""
    words = F.filter(F.split(text, "[\\x00-\\x20]+"), lambda w: w != "")

    def chosen(w: Column) -> Column:
        # inner[i]: hash of the s words from i
        inner = F.transform(
            F.sequence(F.lit(0), F.size(w) - s), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(s)])
        )
        return _with(inner, lambda g: F.transform(F.filter(F.sequence(F.lit(0), F.size(w) - k), lambda i: edge(g, i)), lambda i: anchor(g, i)))

    def edge(g: Column, i: Column) -> Column:
        between = [F.get(g, i + j) for j in range(1, k - s)]
        edges = F.least(F.get(g, i), F.get(g, i + (k - s)))
        return edges <= (F.least(*between) if len(between) > 1 else between[0])

    def anchor(g: Column, i: Column) -> Column:
        return F.struct(
            i.alias("word"), F.xxhash64(*[F.get(g, i + j) for j in range(0, k, s)]).bitwiseAND(0xFFFFFFFF).alias("hash")
        )

    def short(w: Column) -> Column:
        whole = F.struct(F.lit(0).alias("word"), F.xxhash64(F.concat_ws(" ", w)).bitwiseAND(0xFFFFFFFF).alias("hash"))
        return F.when(F.size(w) > 0, F.array(whole)).otherwise(F.array().cast("array<struct<word:int,hash:bigint>>"))

    return _with(words, lambda w: F.when(F.size(w) >= k, chosen(w)).otherwise(short(w)))


def _with(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fingerprint_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda a: F.concat(F.lpad(F.lower(F.hex(a["hash"])), 8, "0"), F.lit("@"), a["word"].cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the anchors' distinct hashes, 0 to 1."""
    x, y = F.array_distinct(a["hash"]), F.array_distinct(b["hash"])
    both = F.size(F.array_intersect(x, y))
    every = F.size(x) + F.size(y) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def with_next_text(docs: DataFrame, rows_per_bucket: int = 512, most_buckets: int = 8192) -> DataFrame:
    """``order_key, doc_id, text, bucket, ghost, next_text``: each row beside its successor in descending doc_id.

    Rows go to buckets of neighbouring ids, cut at quantiles (at most ``most_buckets``
    numbers on the driver).  The largest row of a bucket is sent to the bucket above too, as
    a ghost behind its last row; the largest of all goes to the lowest bucket.  So one
    shuffle of the texts serves, and no task holds more than a few buckets.
    Rows without an id come last; rows of one id are ordered by their texts.
    """
    own = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("order_key"), F.col("doc_id"), whole_text().alias("text")
    )
    counted = own.agg(F.count("*").alias("n"), F.max("order_key").alias("top")).first()
    buckets = int(min(most_buckets, max(1, counted.n // rows_per_bucket)))
    bounds: list[int] = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        found = own.agg(F.percentile_approx("order_key", shares, max(10_000, 16 * buckets)).alias("q")).first()
        bounds = sorted({b for b in found.q if b < counted.top})
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    halving = [1 << j for j in reversed(range(max(1, len(bounds)).bit_length()))]
    key = F.col("order_key")

    def halve(low: Column, step: Column) -> Column:  # how many bounds lie below the key
        return F.when((low + step <= len(bounds)) & (F.get(edges, low + step - 1) < key), low + step).otherwise(low)

    bucket = F.aggregate(F.array(*[F.lit(h) for h in halving]), F.lit(0), halve)
    target = F.when(key == F.lit(counted.top), F.lit(0)).when(F.get(edges, F.col("bucket")) == key, F.col("bucket") + 1)
    places = F.when(
        target.isNotNull(),
        F.array(
            F.struct(F.col("bucket"), F.lit(False).alias("ghost")),
            F.struct(target.alias("bucket"), F.lit(True).alias("ghost")),
        ),
    ).otherwise(F.array(F.struct(F.col("bucket"), F.lit(False).alias("ghost"))))
    dealt = own.withColumn("bucket", bucket).select("order_key", "doc_id", "text", F.inline(places))
    return dealt.withColumn("next_text", F.lead("text").over(descending()))


def descending() -> Window:
    return Window.partitionBy("bucket").orderBy("ghost", F.desc("order_key"), "text")


def fingerprint_documents(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has its last ``floor(n / 2)`` code points replaced by the first as many
    of the next document.  A null text is empty; with a single row the next is itself;
    repeated rows are each returned; an empty table gives no rows; extra columns are ignored.
    """
    paired = with_next_text(docs).withColumn("found", anchors(F.col("text"), k, s))
    paired = paired.withColumn("next_found", F.lead("found").over(descending())).where(~F.col("ghost"))
    n = F.length("text")
    kept = (n - F.expr("length(text) div 2")).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), kept), F.col("next_text").substr(F.lit(1), F.expr("cast(length(text) div 2 as int)")))
    return (
        paired.withColumn("edited", edited)
        .withColumn("edited_found", anchors(F.col("edited"), k, s))
        .select(
            "doc_id",
            n.cast("long").alias("n_chars"),
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            fingerprint_text(F.col("found")).alias("fingerprint"),
            fingerprint_text(F.col("edited_found")).alias("edited_fingerprint"),
            likeness(F.col("found"), F.col("edited_found")).alias("near_edited"),
            likeness(F.col("found"), F.col("next_found")).alias("near_next"),
        )
    )
