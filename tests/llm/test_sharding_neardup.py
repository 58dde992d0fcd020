"""Sharding and near-duplicates against brute force on small fixtures."""

import random
import zlib

import pytest

from treeloom.llm.neardup import missed, near_duplicates, tables_for
from treeloom.llm.sharding import shard_by_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, rep long"


def frame(spark, texts):
    rows = [(i, t, "en", "s", 0, 1, 2) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def shingle_set(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def brute_components(texts, k=3, percent=85):
    sets = {i: shingle_set(t, k) for i, t in texts}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocab = [f"w{n}" for n in range(300)]
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one "), (5, "one two"), (6, "É é"), (7, "é é")]
    base = [rng.choice(vocab) for _ in range(120)]
    for i in range(8, 60):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        out.append((i, " ".join(words)))
    out += [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 60)))) for i in range(60, 120)]
    out += [(200 + i, out[100][1]) for i in range(20)]
    out.append((300, " ".join(rng.choice(vocab) for _ in range(20_000))))
    out.append((301, out[-1][1] + " more"))
    return out


def test_near_duplicates_equal_brute_force(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, texts).repartition(3)).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_edge_cases(spark):
    rows = near_duplicates(frame(spark, [(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (9, "a b c d")])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in rows) == [
        (False, 7, 7, True), (False, 7, 7, True), (False, 9, 7, False), (True, 0, None, True),
    ]
    assert near_duplicates(frame(spark, [])).count() == 0


def chained_copies(n, n_words, edits, seed):
    """Copies of one text with some of a few edits each: many lie near each other, fewer near the text itself."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**6)}" for _ in range(n_words)]
    changes = [(rng.randrange(n_words), f"c{k}") for k in range(edits)]
    out = []
    for i in range(n):
        words = list(base)
        for at, word in rng.sample(changes, rng.choice([0, 1, 2, 3, 5, 8])):
            words[at] = word
        if i % 3 == 0:
            words[rng.randrange(n_words)] = f"own{i}"
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80), (1, 94)])
def test_a_large_group_of_near_copies_equals_brute_force(spark, monkeypatch, k, percent):
    from treeloom.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 20)  # so that hubs, buckets and shingles of this group are spread
    texts = chained_copies(260, 90, 14, k) + [(1000 + i, t) for i, t in chained_copies(120, 40, 9, 7 + k)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, texts), k, percent).collect()}
    want = brute_components(texts, k, percent)
    assert len({c for _, c in want.values()}) > 4 and got == want


def test_words_with_equal_crc_are_different_words(spark):
    texts = [(1, "yhcbdjwhj one two three"), (2, "cfmwjcitz one two three")]
    assert zlib.crc32(b"yhcbdjwhj") == zlib.crc32(b"cfmwjcitz")
    assert all(r.kept for r in near_duplicates(frame(spark, texts), 3, 50).collect())


def test_one_id_with_several_texts(spark):
    rows = near_duplicates(frame(spark, [(5, "a b c d"), (5, "e f g h"), (5, "a b c d"), (9, "e f g h"), (10, "x y z")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(5, 5), (5, 5), (5, 5), (9, 5), (10, 10)]


def test_links_of_texts_that_share_an_id_with_others(spark):
    words = [f"w{n}" for n in range(60)]
    a, b, near = "x y z u v", " ".join(words), " ".join([*words[:-3], "p", "q", "r"])
    rows = near_duplicates(frame(spark, [(1, a), (1, b), (3, b), (4, near), (5, a)])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == [(1, 3, 1), (1, 58, 1), (3, 58, 1), (4, 58, 1), (5, 3, 1)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_ids_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [[f"g{g}w{n}" for n in range(80)] for g in range(5)]
    texts = []
    for _ in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 4, 7])):
            words[rng.randrange(80)] = f"e{rng.randrange(40)}"
        texts.append((rng.randrange(40), " ".join(words)))
    by_text = {t: min(i for i, u in texts if u == t) for _, t in texts}
    numbered = list(enumerate(by_text))  # one node for each text
    component = brute_components(numbered)
    least = {}
    for n, t in numbered:
        root = component[n][1]
        least[root] = min(least.get(root, 1 << 60), by_text[t])
    want = sorted((i, least[component[n][1]]) for i, t in texts for n, u in numbered if u == t)
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(frame(spark, texts)).collect()) == want


def pairs_at_threshold(pairs, n_words, changed, seed):
    """Groups of two texts that differ in their last words; no word occurs in two groups."""
    rng = random.Random(seed)
    word = lambda: f"{rng.getrandbits(60):x}"
    out = []
    for i in range(pairs):
        words = [word() for _ in range(n_words)]
        out += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: n_words - changed] + [word() for _ in range(changed)]))]
    return out


def test_pairs_at_the_threshold_are_compared(spark):
    from corpus_pipeline import minhash_neardup

    texts = pairs_at_threshold(1500, 40, 4, 3)  # 32 of 40 five-word shingles
    assert brute_components(texts[:80], 5, 80) == {i: (36, i // 2 * 2) for i, _ in texts[:80]}
    assert {r.doc_id for r in minhash_neardup(spark, frame(spark, texts), "").select("doc_id").collect()} == {i for i, _ in texts if i % 2 == 0}


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_tables_follow_from_the_similarity(percent):
    tables = tables_for(percent, 4)
    assert missed(percent, tables, 4) <= 1e-4 < missed(percent, tables - 1, 4)


def check_shards(rows, texts, shards):
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 8 for _, t in texts)
    assert {(r.doc_id, r.text_crc32) for r in rows} == {(i, zlib.crc32((t or "").encode())) for i, t in texts}
    total, most, by = sum(r.size for r in rows), max(r.size for r in rows), {}
    for r in rows:
        assert 0 <= r.shard < shards
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / shards) <= most


def test_shards_are_balanced_and_gapless(spark, texts):
    check_shards(shard_by_bytes(frame(spark, texts).repartition(5), 6).collect(), texts, 6)


def test_shards_split_a_group_of_copies(spark):
    many = [(i, "same text" if i % 3 else f"text {i}") for i in range(600)]
    rows = shard_by_bytes(frame(spark, many).repartition(4), 24).collect()
    check_shards(rows, many, 24)
    assert len({r.shard for r in rows}) == 24


def test_shards_edge_cases(spark):
    assert shard_by_bytes(frame(spark, []), 24).count() == 0
    rows = shard_by_bytes(frame(spark, [(None, None), (1, "a"), (1, "a")]), 2).collect()
    assert sorted(r.size for r in rows) == [8, 9, 9]


def test_hot_keys_of_either_size(spark):
    from treeloom.llm.common import salted_join

    many = spark.createDataFrame([(5, n) for n in range(9)] + [(1 << 40, n) for n in range(3)], "k long, n long")
    one = spark.createDataFrame([(5, "a"), (1 << 40, "b")], "k long, x string")
    for hot in ({5: 3}, {5: 3, 1 << 40: 2}):
        assert sorted((r.k, r.n, r.x) for r in salted_join(many, one, "k", hot, "n").collect()) == [(5, n, "a") for n in range(9)] + [(1 << 40, n, "b") for n in range(3)]
