"""Documents in pieces: any cut gives the rows of the whole, state stays small, unfinished ones are told."""

import json
import random

import pytest

from treeloom.sources.resumable import JsonReader, XmlReader, read_in_pieces
from treeloom.sources.tokenizer import DocumentParser, NodeRows

XML = [
    "<a/>",
    '<?xml version="1.0"?><!-- <!DOCTYPE x> --><!DOCTYPE a [<!ENTITY e "<i>x</i>&#38;lt;"><!-- ]> --><!ATTLIST a z CDATA "q">]>\r\n<a xmlns="u" xmlns:p="v">t&e;\r\nq<p:b c=">" d=\'"\'/>'
    "<![CDATA[ ]] <x> ]]>&amp;]<!-- - --><?pi d?><p:b>é\U0001d538</p:b></a> <!-- end --><?x?>\n",
    "<a><b>1</b><b><c/></b>two<b>3</b></a>",
    "<a>" + "x" * 50 + "&lt;" * 10 + "</a>",
]
BROKEN = ["", " ", "<a>", "<a>]]></a>", "<a><b></a>", "<a/><b/>", "<a>&x;</a>", "x<a/>", '<a b="1" b="2"/>', "<a></a>x", '<a/><?xml version="1.0"?>', "<!DOCTYPE a><!DOCTYPE a><a/>", "<a><!-- -- --></a>"]
JSON = ['[1, "a\\"b", {"x":[1,2,{"y":null}]}, [], -1.5e3, true]', '{"a":1}', "[]", "12", '"x"', '{"a":[1],"b":{}}', "[{}]", "[[],[[1]]]"]
BAD_JSON = ["[1,]", "[1] x", '{"a"}', "[1", '{"a":1,}', "[tru]", "[1 2]", "nul", "[01]", '["\\u12"]', "", "[1]]", '["a\tb"]']


def whole(xml):
    rows = NodeRows()
    DocumentParser(rows).parse(0, xml)
    c, out = rows.columns, []
    for k in range(len(rows)):
        a, b = rows.offsets[k : k + 2]
        attrs = [{"name": n, "value": v} for n, v in zip(rows.attr_names[a:b], rows.attr_values[a:b], strict=True)]
        out.append({n: c[n][k] for n in c if n != "doc_id"} | {"attrs": attrs})
    return out


def cuts(text, seed):
    rng = random.Random(seed)
    yield [text]
    yield list(text) or [""]
    for _ in range(30):
        at = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, rng.randrange(8))))
        yield [text[i:j] for i, j in zip([0, *at], [*at, len(text)], strict=True)]


@pytest.mark.parametrize("xml", XML)
def test_pieces_of_xml(xml):
    for pieces in cuts(xml, 1):
        assert sorted(read_in_pieces(XmlReader(), pieces), key=lambda r: r["pre"]) == whole(xml)


@pytest.mark.parametrize("xml", BROKEN)
def test_broken_xml_ends_with_one_error(xml):
    assert whole(xml)[0]["kind"] == "error"
    for pieces in cuts(xml, 2):
        kinds = [r["kind"] for r in read_in_pieces(XmlReader(), pieces)]
        assert kinds.count("error") == 1 and kinds[-1] == "error"


def test_long_texts_are_given_out_in_parts():
    xml = "<a>" + "x&amp;]" * 2000 + "</a>"
    rows = read_in_pieces(XmlReader(most_text=100), [xml[k : k + 37] for k in range(0, len(xml), 37)])
    texts = [r for r in rows if r["kind"] == "text"]
    assert len(texts) > 50 and "".join(r["value"] for r in texts) == "x&]" * 2000


def test_state_follows_depth_and_not_length():
    reader, largest = XmlReader(), 0
    reader.feed("<a>" + "<b>" * 5, False)
    for k in range(3000):
        reader.feed(f"<c n='{k}'>text {k}</c>", False)
        largest = max(largest, len(reader.dump()))
    assert largest < 1200
    items = JsonReader()
    items.feed("[", False)
    assert sum(len(items.feed('{"a": [1, 2]},', False)) for _ in range(2000)) == 2000 and len(items.dump()) < 200


@pytest.mark.parametrize("text", JSON)
def test_pieces_of_json(text):
    value = json.loads(text)
    for pieces in cuts(text, 3):
        rows = read_in_pieces(JsonReader(), pieces)
        assert [json.loads(r["item"]) for r in rows] == (value if isinstance(value, list) else [value]) and [r["number"] for r in rows] == list(range(len(rows)))


@pytest.mark.parametrize("text", BAD_JSON)
def test_bad_json_ends_with_one_error(text):
    for pieces in cuts(text, 4):
        errors = [r["error"] for r in read_in_pieces(JsonReader(), pieces)]
        assert errors[-1] and not any(errors[:-1])
