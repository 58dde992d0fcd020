"""License scans, secret scans, fingerprints and page extraction against plain Python."""

import hashlib
import random
import time
import re
import time

import pytest
import xxhash

from treeloom.llm import fingerprints as fp
from treeloom.llm import secret_scan as ss
from treeloom.llm import html_text as ht
from treeloom.llm.html_text import extract_pages, main_text
from treeloom.llm.license_rules import Rule, rules
from treeloom.llm.license_scan import BASE, WORD, scan_licenses

SCHEMA = "doc_id long, text string, spans string, rules int, bucket int, framed string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in texts], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# --- licenses

LICENSED = [
    (1, "Licensed under CC BY-NC 4.0."), (2, "x GNU General Public License, version 3 or later y"), (3, "All rights reserved. ALL  RIGHTS\nreserved"),
    (4, "Released under the MIT license"), (5, "été cc—by cc by-sa"), (6, None), (7, ""), (8, "nothing here"), (8, "nothing here"), (None, "cc by"),
    (9, "Redistribution and use in source and binary forms, with or without modification, are permitted; the 3-clause BSD license"),
    (10, "SPDX-License-Identifier: Apache-2.0; licensed under the Apache License, Version 2.0"), (11, "word " * 20_000 + "general public license"),
]


def test_license_base_equals_plain_python(spark):
    got = scan_licenses(frame(spark, LICENSED)).collect()
    assert len(got) == len(LICENSED)
    want = []
    for i, t in LICENSED:
        words = re.findall(WORD, lower(t or ""))
        hits = [(k, label) for p, label in BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in hits]
        want.append((i or 0, len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got)
    assert all(0 <= r.score <= 1 for r in got)


def brute_detections(text):
    words = re.findall(WORD, lower(text or ""))
    framed = " " + "  ".join(words) + " "
    found = set()
    for n, r in enumerate(rules()):
        if r.keyword in framed:
            for m in re.finditer(r.pattern, framed):
                first = framed[: m.start()].count(" ") // 2
                found.add((first, first + m[0].count(" ") // 2 - 1, r.priority, n, r.label))

    def covered(d):
        rank = lambda x: (x[2], x[1] - x[0], -x[3])
        return any(e[0] <= d[0] and e[1] >= d[1] and rank(e) > rank(d) for e in found)

    return sorted(d for d in found if not covered(d))


def test_license_rules_equal_plain_python(spark):
    got = {r.doc_id: r.detections for r in scan_licenses(frame(spark, LICENSED[:5] + LICENSED[10:12])).collect()}
    for i, t in LICENSED[:5] + LICENSED[10:12]:
        assert got[i] == ",".join(f"{label}:{a}:{b}" for a, b, _, _, label in brute_detections(t)), i
    labels = {r.doc_id: r.labels for r in scan_licenses(frame(spark, LICENSED)).collect()}
    assert "cc-by-nc-4.0" in labels[1] and "gpl-3.0-or-later" in labels[2] and labels[4] == "mit" and labels[8] == "" and "apache-2.0" in labels[10] and "bsd-3-clause" in labels[9]


def example(pattern):
    """The shortest text that a rule's pattern matches."""
    plain = re.sub(r"\(\?: [^()]*\)(\?|\{0,\d+\})", "", pattern)
    plain = re.sub(r"\(\?:([^()|]*)\|[^()]*\)", r"\1", plain).replace("v?", "").replace("[^ ]+", "word")
    return " ".join(plain.split())


def test_every_rules_words_pass_the_prefilter(spark):
    own = [*rules(), Rule("house", "house", " house  terms ", 30, 0.5), Rule("two", " own  house ", " own  house  rules ", 30, 0.5)]
    texts = [(n, "It: " + example(r.pattern).upper().replace(" ", " - ")) for n, r in enumerate(own)]
    assert all(re.search(r.pattern, f" {'  '.join(example(r.pattern).split())} ") for r in own)
    got = {r.doc_id: r.detections for r in scan_licenses(frame(spark, texts), own).select("doc_id", "detections").collect()}
    assert [n for n in got if not got[n]] == []
    assert "bsd-3-clause" in scan_licenses(frame(spark, [(1, "Neither the name of X may be used to endorse or promote products")])).first().labels


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert scan_licenses(empty).count() == 0 and ss.scan(empty, [0.0] * len(ss.ALPHABET) ** 2).count() == 0
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_there_are_hundreds_of_rules():
    assert len(rules()) > 250 and all(re.compile(r.pattern) and r.keyword in r.pattern for r in rules())


# --- secrets

SECRETS = [
    (1, 'password = "hunter2hunter" and API_KEY:abc'), (2, "token=token=abcdefgh"), (3, 'secret=token: "abcdefgh"'), (4, "AKIA" + "A1" * 8 + " AKIASHORT"),
    (5, "é𝔘 " + "0f" * 20 + " cafe"), (6, None), (7, ""), (8, "key Xq7Rz2Lm9Vb4Tn8Kp3Wd6Yf end"), (9, "getUserAccountManagerFactory2Instance"), (9, "dup"), (None, "passwd:'123456'"),
    (10, "x" * 50_000 + " token: abcdef1"), (11, "secret: abcdef " * 40),
]


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(ss.ASSIGN.replace("(?i)", "(?ai)"), t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets_equal_plain_python(spark):
    got = ss.scan(frame(spark, SECRETS), ss.default_ratios(spark)).collect()
    want = {(i, t): base_spans(t or "") for i, t in SECRETS}
    assert len(got) == len(SECRETS)
    for r in got:
        assert [(s.start, s.kind, s.end) for s in r.base_spans] == want[r.doc_id, r.text]
        assert set(map(tuple, r.base_spans)) <= set(map(tuple, r.spans))
    random_kinds = {r.doc_id for r in got for s in r.spans if s.kind == 3}
    assert random_kinds == {8}


def test_markov_model_on_held_out_strings(spark):
    samples = ss.labelled_strings()
    ratios = ss.train(spark.createDataFrame(list(samples[::2]), "text string, label int"))
    rows = spark.createDataFrame(list(samples[1::2]), "text string, label int")
    scored = rows.select("label", ss.token_ratio(rows["text"], ratios).alias("r")).collect()
    right = sum((r.r > 0.6) == (r.label == 1) for r in scored)
    assert right / len(scored) > 0.98


HELD_OUT = "abstract adapter anchor archive binding bucket cluster compiler counter customer driver duration ledger migration namespace observer replica revision".split()


def test_the_ratio_decides_for_every_class_of_characters(spark):
    rng = random.Random(99)
    lower, upper, digits = ss.ALPHABET[26:52], ss.ALPHABET[:26], ss.ALPHABET[52:62]
    kinds = [lower + digits, upper + digits, upper + "234567", upper + lower, lower, upper, ss.ALPHABET[:62]]
    secrets = ["".join(rng.choice(kinds[i % 7]) for _ in range(20 + i % 20)) for i in range(700)]
    names = ["_-/"[i % 3].join(rng.choice(HELD_OUT) for _ in range(4)) if i % 2 else "".join(rng.choice(HELD_OUT).title() for _ in range(4)) for i in range(700)]
    names += ["Rechtsschutzversicherungsgesellschaften", "internationalization", "anticonstitutionnellement", "x" * 99, "=-" * 20, "-" * 40, "12345678901234567890"]
    texts = [f"the key {t} here" for t in secrets + names]
    got = {r.doc_id: r.spans for r in ss.scan(frame(spark, list(enumerate(texts))), ss.default_ratios(spark)).select("doc_id", "spans").collect()}
    missing = [t for i, t in enumerate(secrets) if [(x.start, x.end) for x in got[i]] != [(8, 8 + len(t))]]
    wrong = [t for i, t in enumerate(names, len(secrets)) if got[i]]
    assert len(missing) <= 7 and len(wrong) <= 1 and not {t for t in wrong if t in names[700:]}, (missing, wrong)


def test_redaction(spark):
    r = ss.scan(frame(spark, [(1, "a token: abcdef1 b"), (2, None)]), ss.default_ratios(spark))
    assert [x[0] for x in r.select(ss.redact(r["text"], r["spans"])).collect()] == ["a [secret] b", None]


# --- fingerprints


def neighbours(texts):
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    return [(i, t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order)]


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_edited_texts_follow_descending_ids(spark, bucket, monkeypatch):
    rng = random.Random(bucket)
    texts = [(i * 7, " ".join(rng.choice("abcdefé𝔘") * 2 for _ in range(rng.randrange(0, 40)))) for i in range(30)] + [(1000, None), (None, "no id here")]
    real = fp.with_next_text
    monkeypatch.setattr(fp, "with_next_text", lambda docs: real(docs, rows_per_bucket=bucket))
    got = {r.doc_id: r for r in fp.fingerprint_documents(frame(spark, texts).repartition(3)).collect()}
    assert len(got) == len(texts)
    for i, t, after in neighbours(texts):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest()), i
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1


def plain_anchors(text, k=6, s=2):
    """Closed syncmers by their definition; a hash of several values is chained through the seed."""

    def chained(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v, seed)
        return seed - (1 << 64) if seed >= 1 << 63 else seed

    words = [w.encode() for w in re.split("[\x00-\x20]+", text) if w]
    if len(words) < k:
        return [(0, chained([b" ".join(words)]) & 0xFFFFFFFF)] if words else []
    inner = [chained(words[i : i + s]) for i in range(len(words) - s + 1)]
    out = []
    for i in range(len(words) - k + 1):
        own = inner[i : i + k - s + 1]
        if min(own) in (own[0], own[-1]):
            out.append((i, chained([g.to_bytes(8, "little", signed=True) for g in own[::s]]) & 0xFFFFFFFF))
    return out


def test_fingerprints_equal_plain_python(spark):
    rng = random.Random(11)
    texts = [(i, " ".join(rng.choice(["ab", "é", "𝔘x", "w1", "w2", "w3", "long-word"]) for _ in range(n))) for i, n in enumerate([0, 1, 5, 6, 7, 40, 300, 41])] + [(20, None), (21, "\t a\n\nb ")]
    got = {r.doc_id: r for r in fp.fingerprint_documents(frame(spark, texts)).collect()}

    def likeness(a, b):
        x, y = {h for _, h in a}, {h for _, h in b}
        return len(x & y) / len(x | y) if x | y else 1.0

    for i, t, after in neighbours(texts):
        half = len(t) // 2
        own, edited, following = plain_anchors(t), plain_anchors(t[: len(t) - half] + after[:half]), plain_anchors(after)
        written = [",".join(f"{h:08x}@{at}" for at, h in found) for found in (own, edited)]
        assert [got[i].fingerprint, got[i].edited_fingerprint] == written, i
        assert (got[i].near_edited, got[i].near_next) == pytest.approx((likeness(own, edited), likeness(own, following)))


def test_closed_syncmers_are_context_free(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(50)}" for _ in range(200)]
    texts = [(1, " ".join(words)), (2, "x y z " + " ".join(words) + " q"), (3, " ".join(words)), (4, "few words"), (5, None)]
    found = {r.doc_id: r for r in fp.fingerprint_documents(frame(spark, texts)).collect()}
    hashes = {i: [a.split("@")[0] for a in found[i].fingerprint.split(",") if a] for i in found}
    assert found[1].fingerprint == found[3].fingerprint and found[5].fingerprint == ""
    assert set(hashes[1]) <= set(hashes[2]) and 0.2 < len(hashes[1]) / 200 < 0.6
    assert len(hashes[4]) == 1 and found[2].near_next > 0.9
    assert fp.fingerprint_documents(frame(spark, [])).count() == 0
    one = fp.fingerprint_documents(frame(spark, [(1, "abcd")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1


# --- pages

PAGES = [
    ("<html><body><nav><a>menu</a></nav><article><h1>T</h1><p>a &amp; b<br>c</p><p>d</article><footer>f</footer>", "T\na & b c\nd"),
    (None, ""), ("", ""), ("plain words only, no tags at all", "plain words only, no tags at all"),
    ("<body><div class='sidebar'>s</div><main><p>" + "long text " * 20 + "<p>short</main><div id=comments><article class=comment>hi there</article></div>", ("long text " * 20).strip() + "\nshort"),
    ("<body><header>head</header><div class=content><p>" + "words of content " * 10 + "</p><p>Be.</p><form><label>x</label></form><div class='ad'>buy</div></div><div class='cookie-notice'>cookies</div></body>", ("words of content " * 10).strip() + "\nBe."),
    ("<article><p>x<script>var a='<p>no</p>';</script>y</p><!-- c --><style>p{}</style></article>", "xy"),
    ("<article><p>" + "t " * 30_000 + "</p></article>", ("t " * 30_000).strip()),
]


@pytest.mark.parametrize("html, want", PAGES)
def test_main_text(html, want):
    assert main_text(html) == want


LONG = ("words of a sentence " * 12).strip()


def test_main_keeps_its_text_beside_teaser_articles():
    cards = "".join(f"<article><p>Card {i}, read on</p></article>" for i in range(3))
    got = main_text(f"<body><main><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>{cards}</main></body>").split("\n")
    assert got[:4] == ["Title", LONG, LONG, LONG]
    got = main_text(f"<body><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div><article><p>A card</p></article></div></body>")
    assert got.split("\n")[:3] == [LONG] * 3


@pytest.mark.parametrize(
    "names", ["wrapper has-sidebar", "content-side", "layout-with-nav", "entry-header", "post tags-linux", "no-sidebar", "sidebar", "related", "widget"]
)
def test_a_marked_wrapper_does_not_drop_the_page(names):
    page = f"<body><nav>menu</nav><div class='{names}'><article><h1>Title</h1><p>{LONG}</p></article></div><div class=ad>buy</div></body>"
    assert main_text(page) == f"Title\n{LONG}"
    assert main_text(page.replace("article>", "section>")) == f"Title\n{LONG}"


def test_headline_in_a_marked_element_of_an_article():
    assert main_text(f"<article><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p><div class='post-comments'>nice</div></article>") == f"Title\n{LONG}"
    assert main_text(f"<article class=post><p>{LONG}</p></article><div id=comments><p>{LONG}</p><p>{LONG} twice</p></div>") == LONG


def test_the_ratios_choose_the_region(monkeypatch):
    menu = "".join(f"<li><a href=x>entry {i}</a></li>" for i in range(30))
    page = f"<body><div><ul>{menu}</ul></div><div><h2><a href=y>Title</a></h2><p>{LONG}</p><p>{LONG}</p><p>End.</p></div><div><ul>{menu}</ul></div></body>"
    assert main_text(page) == f"Title\n{LONG}\n{LONG}\nEnd."
    smooth = ht.smoothed_ratios
    monkeypatch.setattr(ht, "smoothed_ratios", lambda lines: 0 * smooth(lines))
    assert [main_text(h) for h, _ in PAGES] == [""] * len(PAGES) and main_text(page) == ""


def test_random_mark_up_never_crashes():
    rng = random.Random(3)
    parts = ["<", ">", "<![foo[bar", "<![CDATA[", "]]>", "<!", "<?", "<!--", "-->", "<p>", "</p>", "<div class='ad", "'", '"', "<article>", "</article>", "&#x", "&amp", "text ", "<script>", "</script>", "<a href=", "</", "<b/>", "<!DOCTYPE [", "=", "\0", "é", "<table><td>", "</table>"]
    for _ in range(4000):
        assert isinstance(main_text("".join(rng.choices(parts, k=rng.randrange(1, 25)))), str)
    assert main_text("<p>x<![ foo") == "x" and main_text("<p>a<![foo[bar>b") == "ab"


@pytest.mark.parametrize("piece", ["<div>x", "<b>x", "</i><p>x", "<p><b>x", "<ul><li>x", "<table><td>x</b>", "<article>x", "<div class=ad><p>y"])
def test_deep_pages_take_linear_time(piece):
    began = time.process_time()
    main_text(piece * 20_000)
    assert time.process_time() - began < 5


def test_extract_pages_keeps_rows(spark):
    rows = [(i, "u", h, "t", 3) for i, (h, _) in enumerate(PAGES)] + [(0, "u", PAGES[0][0], "t", 3), (None, None, "<p>z", "t", 3)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)


def test_suppression_equals_plain_comparison(spark):
    from treeloom.llm.license_scan import _FOUND, standing

    rng = random.Random(12)
    rows = []
    for k in range(60):
        found = set()
        for _ in range(rng.choice((0, 1, 5, 40))):
            first, place = rng.randrange(30), rng.randrange(6)
            found.add((first, first + rng.randrange(8), (10, 20, 30)[place % 3], place, f"l{place}", 0.5))
        rows.append((k, sorted(found, key=lambda _: rng.random())))

    def covered(d, e):
        inside = e[0] <= d[0] and e[1] >= d[1]
        more = (e[1] - e[0]) - (d[1] - d[0])
        return inside and (e[2] > d[2] or (e[2] == d[2] and (more > 0 or (more == 0 and e[3] < d[3]))))

    frame = spark.createDataFrame(rows, f"k int, found {_FOUND}")
    got = {r.k: sorted(map(tuple, r.kept)) for r in frame.select("k", standing(frame["found"], [10, 20, 30]).alias("kept")).collect()}
    assert got == {k: sorted(d for d in found if not any(covered(d, e) for e in found if e != d)) for k, found in rows}


def test_a_text_of_many_notices_ends(spark):
    from treeloom.llm.license_scan import scan_licenses

    text = "Licensed under the Apache License, Version 2.0. All rights reserved. " * 1500
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_base == 1500 and row.detections.count(",") >= 1499


@pytest.mark.parametrize("piece", ['<a b="', "<!--", "<!-- >", "</", "<?", "<a ", "<!x", "<![x", "&", "<"])
def test_unfinished_marks_take_linear_time(piece):
    page = "<article><p>" + "word " * 50 + "</p></article>" + piece * (100_000 // len(piece))
    began = time.time()
    assert ht.main_text(page).startswith("word word")
    assert time.time() - began < 1
