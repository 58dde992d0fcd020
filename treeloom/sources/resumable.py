"""Readers that take a document in pieces and can be put aside between any two of them.

``feed`` gives out what has become complete; ``dump`` and ``load`` carry the rest as a
small text: the open elements (or brackets), some counts, and the unfinished token.  The
size of that text follows the depth of the document and the longest token, not its length.
"""

from __future__ import annotations

import json
import re
from typing import Any
from xml.parsers import expat

from ..model import ERROR, XML_URI, XMLNS_URI
from .tokenizer import SUPPORTED_ENCODINGS

_TAG = re.compile(r"""<[^"'>]*(?:"[^"]*"[^"'>]*|'[^']*'[^"'>]*)*>""")
_INSIDE_DOCTYPE = re.compile(r"""<!--.*?-->|<\?.*?\?>|"[^"]*"|'[^']*'|[\[\]<>]""", re.DOTALL)
_ENDS = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>"))


def _doctype_end(text: str, at: int) -> int:
    """Where a document type declaration ends, -1 if it doesn't yet."""
    depth, brackets = 0, 0
    for m in _INSIDE_DOCTYPE.finditer(text, at):
        token = m[0]
        depth += (token == "<") - (token == ">")
        brackets += (token == "[") - (token == "]")
        if depth == 0 and brackets <= 0 and token == ">":
            return m.end()
    return -1


def complete_until(text: str, most_text: int) -> int:
    """Length of the leading part that holds whole tokens only.

    A run of text is whole when mark-up follows; of a run longer than ``most_text`` the part
    that can be told by itself is taken.
    """
    at = 0
    while True:
        opened = text.find("<", at)
        if opened < 0:
            if len(text) - at <= most_text:
                return at
            end = len(text)
            while end > at and text[end - 1] in "]\r":
                end -= 1
            reference = text.rfind("&", at, end)
            return end if reference < 0 or text.find(";", reference, end) >= 0 else reference
        way = next((w for w in _ENDS if text.startswith(w[0], opened)), None)
        if way:
            end = text.find(way[1], opened + len(way[0]))
            end = end + len(way[1]) if end >= 0 else -1
        elif text.startswith("<!D", opened):
            end = _doctype_end(text, opened)
        elif "<![CDATA[".startswith(text[opened : opened + 9]) or "<!--".startswith(text[opened : opened + 4]):
            end = -1
        else:
            m = _TAG.match(text, opened)
            end = m.end() if m else -1
        if end < 0:  # text is fed with the mark-up that ends it
            return opened if opened - at > most_text else at
        at = end


class XmlReader:
    """Node rows (dicts of ``NODES`` without ``doc_id``) of one document.

    A row is given out when its node is complete: an element's at its end tag, so rows come
    in another order than those of a whole parse, but are the same; text runs longer than
    ``most_text`` become several rows.  A fault gives one row of kind ``error``, after the
    rows that were complete before it, and ends the document.  External entities are not read.
    """

    def __init__(self, most_text: int = 1 << 20):
        self.most_text = most_text
        self.tail, self.prolog, self.fresh, self.failed = "", "", True, False
        self.pre, self.root_done = 0, False
        # open elements: name, pre, level, parent, sib, occ, uri, attrs, own prefixes, nodes so far, numbers by name
        self.frames: list[list] = []
        self.top: list = [0, {}]

    def dump(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def load(cls, state: str) -> XmlReader:
        out = cls.__new__(cls)
        out.__dict__ = json.loads(state)
        return out

    def feed(self, text: str, final: bool) -> list[dict]:
        if self.failed:
            return []
        self.tail += text
        cut = len(self.tail) if final else complete_until(self.tail, self.most_text)
        if cut == 0 and not final:
            return []
        piece, self.tail = self.tail[:cut], self.tail[cut:]
        rows: list[dict] = []
        try:
            self._parse(piece, final, rows)
        except (expat.ExpatError, ValueError) as e:
            self.failed, self.tail, self.frames = True, "", []
            told = expat.ErrorString(e.code) if isinstance(e, expat.ExpatError) else str(e)
            rows.append(self._row(ERROR, None, told, pre=self.pre))
        return rows

    def _path(self) -> str | None:
        return "".join(f"/{f[0]}" for f in self.frames)

    def _row(self, kind: str, name: str | None, value: str | None, attrs: list | None = None, pre: int | None = None) -> dict:
        """A leaf at the current place."""
        holder = self.frames[-1] if self.frames else None
        counts = holder[9:] if holder else self.top
        row = {
            "pre": self.pre if pre is None else pre, "post": self.pre if pre is None else pre, "level": len(self.frames), "parent": holder[1] if holder else -1, "sib": counts[0], "occ": 0,
            "kind": kind, "name": name, "ns_uri": None, "attrs": attrs or [], "value": value, "path": self._path(),
        }
        if pre is None:
            self._count(holder)
        return row

    def _count(self, holder: list | None) -> None:
        self.pre += 1
        if holder:
            holder[9] += 1
        else:
            self.top[0] += 1

    def _parse(self, piece: str, final: bool, rows: list[dict]) -> None:
        p = expat.ParserCreate("utf-8")
        p.ordered_attributes = p.buffer_text = True
        p.buffer_size = 1 << 16
        if hasattr(p, "SetReparseDeferralEnabled"):
            p.SetReparseDeferralEnabled(False)
        if not self.fresh:  # what is open is opened again, unseen
            opened = "".join(f"<{f[0]}>" for f in self.frames) if self.frames else "<r/>" if self.root_done else ""
            p.Parse(f" {self.prolog}{opened}" if not self.prolog.startswith("<?xml") else self.prolog + opened, False)
        if piece:
            self.fresh = False
        in_cdata: list[str] | None = None
        data = piece.removeprefix("﻿").encode("utf-8", "surrogatepass")
        doctype: list = []

        def start(name: str, attrs: list[str]) -> None:
            holder = self.frames[-1] if self.frames else None
            counts = holder[9:] if holder else self.top
            occ = counts[1].get(name, 0)
            counts[1][name] = occ + 1
            own = {attrs[k][6:]: attrs[k + 1] for k in range(0, len(attrs), 2) if attrs[k] == "xmlns" or attrs[k].startswith("xmlns:")}
            prefix = name.partition(":")[0] if ":" in name else ""
            uri = next((b[prefix] for b in (own, *(f[8] for f in reversed(self.frames)), {"xml": XML_URI, "xmlns": XMLNS_URI, "": ""}) if prefix in b), None)
            pairs = [{"name": attrs[k], "value": attrs[k + 1]} for k in range(0, len(attrs), 2)]
            frame = [name, self.pre, len(self.frames), holder[1] if holder else -1, counts[0], occ, uri, pairs, own, 0, {}]
            self._count(holder)
            self.frames.append(frame)

        def end(_name: str) -> None:
            path = self._path()
            name, pre, level, parent, sib, occ, uri, pairs, *_ = self.frames.pop()
            rows.append({"pre": pre, "post": self.pre - 1, "level": level, "parent": parent, "sib": sib, "occ": occ, "kind": "element", "name": name, "ns_uri": uri, "attrs": pairs, "value": None, "path": path})
            self.root_done = self.root_done or not self.frames

        def text(value: str) -> None:
            if in_cdata is not None:
                in_cdata.append(value)
            elif self.frames:
                rows.append(self._row("text", None, value))

        def cdata_start() -> None:
            nonlocal in_cdata
            in_cdata = []

        def cdata_end() -> None:
            nonlocal in_cdata
            rows.append(self._row("cdata", None, "".join(in_cdata)))
            in_cdata = None

        def declaration(version: str | None, encoding: str | None, standalone: int) -> None:
            if encoding and encoding.upper() not in SUPPORTED_ENCODINGS:
                raise ValueError(f"unsupported encoding: {encoding}")
            self.prolog = piece[: piece.index("?>") + 2].removeprefix("﻿")
            parts = [("version", version), ("encoding", encoding), ("standalone", {1: "yes", 0: "no"}.get(standalone))]
            rows.append(self._row("declaration", "xml", None, [{"name": n, "value": v} for n, v in parts if v is not None]))

        def comment(value: str) -> None:
            rows.append(self._row("comment", None, value))

        def instruction(target: str, value: str) -> None:
            rows.append(self._row("pi", target, value))

        def doctype_start(name: str, system_id: str | None, public_id: str | None, has_subset: int) -> None:
            doctype[:] = [name, public_id, system_id, has_subset, p.CurrentByteIndex]
            p.CommentHandler = p.ProcessingInstructionHandler = None

        def doctype_end() -> None:
            name, public_id, system_id, has_subset, _ = doctype
            opened = piece.index("<!DOCTYPE", self._prolog_offset(piece))
            whole = piece[opened : _doctype_end(piece, opened)]
            subset = whole[whole.index("[") + 1 : whole.rindex("]")] if has_subset else None
            self.prolog += whole
            parts = [("public_id", public_id), ("system_id", system_id)]
            rows.append(self._row("doctype", name, subset, [{"name": n, "value": v} for n, v in parts if v is not None]))
            p.CommentHandler, p.ProcessingInstructionHandler = comment, instruction

        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, text
        p.CommentHandler, p.ProcessingInstructionHandler = comment, instruction
        p.StartCdataSectionHandler, p.EndCdataSectionHandler = cdata_start, cdata_end
        p.XmlDeclHandler, p.StartDoctypeDeclHandler, p.EndDoctypeDeclHandler = declaration, doctype_start, doctype_end
        p.Parse(data, final)

    @staticmethod
    def _prolog_offset(piece: str) -> int:
        """Where the declaration of the document type can begin: behind comments and instructions that may quote one."""
        at = 0
        while True:
            opened = piece.find("<", at)
            way = next((w for w in _ENDS if piece.startswith(w[0], opened)), None)
            if way is None:
                return opened
            at = piece.index(way[1], opened + len(way[0])) + len(way[1])


class JsonReader:
    """The items of a JSON array (or the one value of a text), each given out as soon as it ends.

    A push-down lexer: brackets that are open, what may come next, the unfinished token and
    the tokens of the unfinished item are all that is kept.  Anything but blanks behind the
    end is an error, and so is an end too early; after an error nothing more is read.
    """

    _BLANKS = re.compile(r"[ \t\r\n]*")
    _TOKEN = re.compile(
        r'[{}\[\]:,]|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null'
    )
    #: A token that may go on in the next piece.
    _OPEN = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*(?:\\(?:u[0-9a-fA-F]{0,3})?)?|-?(?:[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]*)?)?|t(?:ru?)?|f(?:a(?:ls?)?)?|n(?:ul?)?')

    def __init__(self):
        self.stack, self.expects, self.tail, self.item, self.number, self.failed = "", "value", "", [], 0, False

    def dump(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def load(cls, state: str) -> JsonReader:
        out = cls.__new__(cls)
        out.__dict__ = json.loads(state)
        return out

    def feed(self, text: str, final: bool) -> list[dict]:
        """Rows ``number, item`` (JSON text), or one with ``error``."""
        if self.failed:
            return []
        text, at, rows = self.tail + text, 0, []
        self.tail = ""
        while True:
            at = self._BLANKS.match(text, at).end()
            if at == len(text):
                break
            if not final and self._OPEN.fullmatch(text, at):
                self.tail = text[at:]
                return rows
            m = self._TOKEN.match(text, at)
            if m is None or not self._step(m[0], rows):
                return self._fail(rows, f"unexpected {text[at : at + 12]!r}")
            at = m.end()
        if final and self.expects != "nothing":
            return self._fail(rows, "unexpected end")
        return rows

    def _fail(self, rows: list[dict], told: str) -> list[dict]:
        self.failed, self.item, self.stack = True, [], ""
        return [*rows, {"number": self.number, "item": None, "error": told}]

    def _step(self, token: str, rows: list[dict]) -> bool:
        first, expects = token[0], self.expects
        inside = len(self.stack)
        if first in "}]":
            if not self.stack or expects not in ("next", "key or end" if first == "}" else "value or end") or self.stack[-1] != ("{" if first == "}" else "["):
                return False
            self.stack = self.stack[:-1]
            self.expects = "next" if self.stack else "nothing"
        elif first == ",":
            if expects != "next":
                return False
            self.expects = "key" if self.stack[-1] == "{" else "value"
        elif first == ":":
            if expects != "colon":
                return False
            self.expects = "value"
        elif first == '"' and expects in ("key", "key or end"):
            self.expects = "colon"
        elif expects not in ("value", "value or end"):
            return False
        elif first in "{[":
            self.stack += first
            self.expects = "key or end" if first == "{" else "value or end"
        else:
            self.expects = "next" if self.stack else "nothing"
        listed = (self.stack or "").startswith("[") or (token == "]" and inside == 1)
        if listed and (inside == 0 or (inside == 1 and first in ",]")):
            return True  # the outer array's own brackets and commas
        self.item.append(token)
        if len(self.stack) == (1 if listed else 0) and self.expects in ("next", "nothing"):
            rows.append({"number": self.number, "item": "".join(self.item), "error": None})
            self.number, self.item = self.number + 1, []
        return True


def read_in_pieces(reader: Any, pieces: list[str]) -> list[dict]:
    """All rows of a text given in pieces, put aside and taken up again after each."""
    rows = []
    for k, piece in enumerate(pieces):
        rows += reader.feed(piece, k == len(pieces) - 1)
        reader = type(reader).load(reader.dump())
    return rows
