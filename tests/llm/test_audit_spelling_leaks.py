"""Filter audit, spelling variants and decontamination beside plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations, product

import pytest

from treeloom.llm import spelling
from treeloom.llm.decontaminate import find_leaks
from treeloom.llm.filter_audit import audit_filters
from treeloom.llm.queries import op11_filter_audit, op12_spelling_variants, op13_decontamination

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
SF = "/root/testdata/sf0.001"


# --- filter audit


def audited(docs, labels):
    """Every order replayed document by document; ``docs`` are (doc_id, text, lang)."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out, shapley = Counter(), Counter()
    for i, text, lang in docs:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            fails.add("C")
        if set(text) & set("#$%&*|"):
            fails.add("D")
        if i is not None and i > first[text]:
            fails.add("E")
        good = any(q == 1 for d, q, _ in labels if d == i and i is not None)
        toxic = any(t == 1 for d, _, t in labels if d == i and i is not None)
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                key = (lang or "", order, step)
                here = f in fails and not gone
                out[key, "redundant"] += f in fails and gone
                gone = gone or here
                out[key, "kept"] += not gone
                out[key, "removed"] += here
                out[key, "unique_fails"] += fails == {f}
                out[key, "good_lost"] += here and good
                out[key, "toxic_lost"] += here and toxic
                shapley[lang or "", f] += here
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {k: tuple(out[k, c] for c in columns) + (shapley[k[0], k[1][k[2] - 1]],) for k in {k for k, _ in out}}


def result(df):
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in df.collect()}


def audit_corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["Abc", "Ärger", "50%", "a|b", "\U0001d538"]
    docs = [(i, " ".join(rng.choices(words[: rng.choice((20, 405))], k=rng.choice((5, 199, 200, 300)))), rng.choice(("en", "de", None, "")), "s", 0) for i in range(40)]
    docs += [(100 + i, docs[3][1], "en", "s", 0) for i in range(15)]  # a group of copies
    docs += [docs[3], docs[5], (None, docs[3][1], "en", "s", 0), (60, None, "fr", "s", 0), (61, "", "fr", "s", 0), (62, " \t \x0b", "fr", "s", 0), (63, "long " * 30_000, "fr", "s", 0)]
    return docs


def test_audit_equals_plain_replay(spark, monkeypatch):
    docs = audit_corpus()
    labels = [(i, i % 2, i % 3) for i in range(0, 110, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (3, None, None)]
    frame = spark.createDataFrame(docs, DOCS).withColumnsRenamed({"source": "first", "n_chars": "count"})  # clashing names
    want = audited([d[:3] for d in docs], labels)
    assert len(want) == 4 * 600
    assert result(audit_filters(frame, spark.createDataFrame(labels, LABELS))) == want
    monkeypatch.setattr("treeloom.llm.common.HOT_LEAST", 3)  # the copies are spread
    assert result(audit_filters(frame, spark.createDataFrame(labels, LABELS))) == want


def test_audit_of_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit_filters(none, labels).collect() == []
    one = result(audit_filters(spark.createDataFrame([(1, None, None, "s", 0)], DOCS), labels))
    assert len(one) == 600 and sum(v[1] for v in one.values()) == 120


def test_registered_audit(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert result(op11_filter_audit(spark, SF)) == audited(docs, labels)


# --- spelling variants


def plain_words(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 2 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (words[w], len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w in words}


def grouped(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def typo_corpus(seed):
    rng, letters = random.Random(seed), "abcdnéÿ"
    base = ["banana", "bandana", "cabana", "abcde", "aaaaa", "aaaaaa", "ababab", "abababa", "ddddd", "caféine", "dadÿada"]
    docs = []
    for i in range(150):
        words = []
        for w in rng.choices(base, k=40):
            w = list(w)
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                at = rng.randrange(len(w))
                kind = rng.randrange(3)
                w[at : at + (kind > 0)] = [] if kind == 1 else [rng.choice(letters)]
            words.append("".join(w) if rng.random() < 0.8 else "".join(w).upper())
        docs.append((i, rng.choice((" ", "-", "1")).join(words), "en", "s", 0))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_spellings_equal_plain_comparison(spark, monkeypatch, seed):
    docs = typo_corpus(seed) + [(None, "banana BANANA", "en", "s", 0), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    docs.append(docs[0])
    frame = spark.createDataFrame(docs, DOCS).withColumnsRenamed({"lang": "word", "source": "n"})
    want = plain_forms(plain_words([d[:2] for d in docs]))
    assert len(want) > 200 and any(v[2] for v in want.values())
    assert grouped(spelling.group_spellings(frame)) == want
    monkeypatch.setattr("treeloom.llm.common.HOT_LEAST", 3)
    monkeypatch.setattr("treeloom.llm.common.HOT_PARTS", 1000)
    assert grouped(spelling.group_spellings(frame, shard_words=10)) == want  # shared halves are spread over shards


def test_halves_find_each_pair_once():
    words = ["".join(p) for n in (5, 6) for p in product("ab", repeat=n)]
    shard = spelling.Halves()
    for w in words:
        shard.add(False, w, 1)
        shard.add(True, w, 1)
    for w in words:
        found = [v for _, v in shard.near(w)]
        assert sorted(found) == sorted(v for v in words if one_edit(w, v)), w


def test_spelling_edges(spark):
    none = spark.createDataFrame([], DOCS)
    assert spelling.group_spellings(none).collect() == []
    long = "x" * 300
    rows = spark.createDataFrame([(i, f"{long} {long}y {long}", "en", "s", 0) for i in range(4)], DOCS)
    assert grouped(spelling.group_spellings(rows)) == plain_forms(plain_words([(i, f"{long} {long}y {long}") for i in range(4)]))
    chain = " ".join(["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaabb"] * 12 + ["aabbb"] * 24 + ["abbbb"] * 50)
    got = grouped(spelling.group_spellings(spark.createDataFrame([(7, chain, "en", "s", 0)], DOCS)))
    assert got == plain_forms(plain_words([(7, chain)])) and got["aaaaa"][4] == "abbbb"
    with pytest.raises(ValueError):
        spelling.group_spellings(none, factor=1)


def test_registered_spellings(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert grouped(op12_spelling_variants(spark, SF)) == plain_forms(plain_words(docs))


# --- decontamination


def plain_leaks(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[at : at + window]), set()).add("" if i is None else str(i))
    lengths = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                if own := windows.get(tuple(w[at : at + n])):
                    hit |= set(range(at, at + n))
                    found |= own
        out.append((-1 if i is None else i, len(w), len(hit), sorted(found)))
    return sorted(out)


ITEMS = [
    (1, "What is the capital of the large country in the far north, and who rules it today?"),
    (2, "what IS the capital of the large country in the far north"),
    (3, "Short answer"), (4, "café answer"), (5, None), (6, "?!"), (None, "nameless item"), (7, "one"), (3, "Another text of item three"),
    (8, "answer"), (9, "short answer short answer short answer short answer short answer short"),
]
TEXTS = [
    (1, "Before. What is the capital of the LARGE country -- in the far north, and who? after"),
    (2, "short, answer! shortanswer shorté answer"), (3, None), (4, ""), (5, "..."), (6, "cafÉ answer café  answer"), (7, "Nameless\nitem"),
    (8, "clean words only stand here"), (9, "what is the capital of the large country in the far"), (10, "what is the capital of the large country in the far " * 3000),
    (11, "another text of item three"), (1, "repeated id one"), (None, "one by one"), (12, "short answer " * 12), (13, "\x00one\x7fone\U0001d538 one"),
]


@pytest.mark.parametrize("most_bytes", [64 << 20, 1500])
def test_leaks_equal_plain_search(spark, most_bytes):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in TEXTS], DOCS).withColumnsRenamed({"lang": "item_id", "source": "hits"})
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = find_leaks(docs, items, most_bytes=most_bytes).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows) == plain_leaks(TEXTS, ITEMS)
    spans = {(r.doc_id, r.n_words): r.spans for r in rows}
    text = dict(TEXTS[:1])[1]
    assert [text[s.start : s.end] for s in spans[1, 16]] == ["What is the capital of the LARGE country -- in the far north, and who"]
    assert [TEXTS[5][1][s.start : s.end] for s in spans[6, 4]] == ["answer café  answer"]


def test_leaks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in TEXTS], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and r["items"] == [] and r.spans == [] for r in find_leaks(docs, items).collect())
    assert find_leaks(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []


def test_registered_decontamination(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = op13_decontamination(spark, SF).collect()
    want = plain_leaks(docs, items)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in rows) == [(i, n, h, len(f)) for i, n, h, f in want]
    shas = {i: hashlib.sha256(",".join(f).encode()).hexdigest() for i, _, _, f in want}
    assert all(r.items_sha256 == shas[r.doc_id] and r.contaminated == (r.n_hit > 0) for r in rows) and any(r.contaminated for r in rows)
