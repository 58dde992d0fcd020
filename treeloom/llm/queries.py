"""The corpus operators as registered queries: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import find_leaks
from .filter_audit import audit_filters
from .fingerprints import fingerprint_documents
from .html_text import extract_pages
from .license_scan import scan_licenses
from .mixing import mix
from .neardup import near_duplicates
from .neighbours import nearest_neighbours
from .packing import pack_documents
from .quality import grade_documents
from .secret_scan import default_ratios, scan, span_text
from .sharding import shard_by_bytes
from .spelling import group_spellings


def tokenizer_path() -> str:
    """Where the public vocabulary file lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


#: Target weights of the languages in the training mix.
LANGUAGE_TARGETS = {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15}


def language_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of domains: the rated documents' languages."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")


def op2_domain_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs, language_labels(docs, table(spark, sf_dir, "labels")), LANGUAGE_TARGETS)
    return mixed.select("doc_id", F.col("mix_tokens").alias("n_tokens"), "posterior", "rate", "copies")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), default_ratios(spark))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_text(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op8_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "expected_grade", "tail_probability", "keep"
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_domain_mixing": op2_domain_mixing,
        "op3_sharding": op3_sharding,
        "op4_permutation_index": op4_permutation_index,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_html_extraction": op6_html_extraction,
        "op7_secret_scan": op7_secret_scan,
        "op8_syncmer_fingerprints": op8_syncmer_fingerprints,
        "op9_minhash_neardup": op9_minhash_neardup,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_filter_audit": op11_filter_audit,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_decontamination": op13_decontamination,
    }


#: Shingle sets, all linked pairs by their common shingles, and the smallest document reachable from each.
NEARDUP_SQL = r"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents
), sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s
    from words
), items as (
    select doc_id, unnest(s) as item from sets
), common as (
    select a.doc_id as x, b.doc_id as y, count(*) as n from items a join items b on a.item = b.item and a.doc_id < b.doc_id group by 1, 2
), links as (
    select x, y from common join sets a on a.doc_id = x join sets b on b.doc_id = y where 100 * n >= 85 * (len(a.s) + len(b.s) - n)
), steps as (
    select x, y from links union select y, x from links
), reached(doc_id, other) as (
    select doc_id, doc_id from sets union select r.doc_id, t.y from reached r join steps t on r.other = t.x
)
select doc_id, cast(any_value(len(s)) as bigint) as n_shingles, min(other) as component_id, min(other) = doc_id as kept
from sets join reached using (doc_id) group by doc_id
"""


#: Flags of every document, all orders, the first failing step of each, counts.
FILTER_AUDIT_SQL = r"""
with words as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
    from documents
), firsts as (
    select t, min(doc_id) as first from words group by t
), rated as (
    select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id
), flags as (
    select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
        concat(case when len(w) < 200 then 'A' else '' end,
            case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end,
            case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 'C' else '' end,
            case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end,
            case when doc_id > first then 'E' else '' end) as fails
    from words join firsts using (t) left join rated using (doc_id)
), letters as (
    select unnest(['A', 'B', 'C', 'D', 'E']) as x
), orders as (
    select a.x || b.x || c.x || d.x || e.x as filter_order
    from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), replayed as (
    select part, filter_order, fails, good, toxic,
        coalesce(list_min([case when contains(fails, filter_order[i]) then i end for i in range(1, 6)]), 6) as first
    from flags cross join orders
), counted as (
    select part, filter_order, cast(step as int) as step, filter_order[step] as own,
        count(*) filter (first > step) as kept, count(*) filter (first = step) as removed,
        count(*) filter (contains(fails, filter_order[step]) and first < step) as redundant,
        count(*) filter (fails = filter_order[step]) as unique_fails,
        count(*) filter (first = step and good) as good_lost, count(*) filter (first = step and toxic) as toxic_lost
    from replayed, range(1, 6) s(step) group by all
)
select * exclude (own), cast(sum(removed) over (partition by part, own) as bigint) as shapley from counted
"""

#: Words by place, windows of each length that an item has, the places of those that occur.
DECONTAMINATION_SQL = r"""
with texts as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
), items as (
    select coalesce(cast(item_id as varchar), '') as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark
), windows as (
    select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as passage
    from (select item_id, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from items where len(w) > 0)
), places as (
    select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as passage
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from texts, (select distinct n from windows) where len(w) >= n)
), matches as (
    select doc_id, i, n, item_id from places join windows using (n, passage)
), hit as (
    select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + n)) as place from matches) group by doc_id
), named as (
    select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from matches group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from texts left join hit using (doc_id) left join named using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are tested against plain Python in tests/llm."""
    return {
        "op9_minhash_neardup": NEARDUP_SQL,
        "op11_filter_audit": FILTER_AUDIT_SQL,
        "op13_decontamination": DECONTAMINATION_SQL,
    }
