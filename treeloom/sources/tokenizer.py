"""Documents to node rows: the standard library's incremental parser behind Arrow batches.

A document that isn't well formed gives one row of kind ``error`` and no others.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator, Mapping, Sequence
from itertools import repeat
from typing import TYPE_CHECKING
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..model import ASSESSED, ERROR, NODES, XML_URI, XMLNS_URI

if TYPE_CHECKING:  # the compilers of grammars read their documents with this module
    from ..plans.assess import Grammar

SUPPORTED_ENCODINGS = frozenset(("UTF-8", "UTF-16", "UTF-16LE", "UTF-16BE"))
LARGEST_BATCH = 1 << 16
_BOM = "﻿"


class NodeRows:
    """Collects node rows as tuples, the ends of subtrees beside them, attributes as flat lists with offsets."""

    NAMES = ("doc_id", "pre", "level", "parent", "sib", "occ", "kind", "name", "ns_uri", "value", "path")

    def __init__(self):
        self.rows: list[tuple] = []
        self.posts: list[int] = []
        self.offsets, self.attr_names, self.attr_values = [0], [], []

    def __len__(self) -> int:
        return len(self.rows)

    def add(self, row: tuple, attrs=()) -> None:
        """A row of ``NAMES``; its subtree ends with itself until told otherwise."""
        self.rows.append(row)
        self.posts.append(row[1])
        if attrs:
            self.attr_names += attrs[::2]
            self.attr_values += attrs[1::2]
        self.offsets.append(len(self.attr_names))

    def cut_back(self, rows: int) -> None:
        del self.rows[rows:], self.posts[rows:]
        del self.offsets[rows + 1 :]
        del self.attr_names[self.offsets[-1] :], self.attr_values[self.offsets[-1] :]

    @property
    def columns(self) -> dict[str, list]:
        columns = zip(*self.rows, strict=True) if self.rows else ([] for _ in self.NAMES)
        return {n: list(c) for n, c in zip(self.NAMES, columns, strict=True)} | {"post": self.posts}

    def batch(self) -> pa.RecordBatch:
        integer = pa.int32()
        types = {"doc_id": pa.int64()} | dict.fromkeys(("pre", "post", "level", "parent", "sib", "occ"), integer)
        arrays = {n: pa.array(c, types.get(n, pa.string())) for n, c in self.columns.items()}
        pairs = pa.StructArray.from_arrays(
            [pa.array(self.attr_names, pa.string()), pa.array(self.attr_values, pa.string())], ["name", "value"]
        )
        arrays["attrs"] = pa.ListArray.from_arrays(pa.array(self.offsets, integer), pairs)
        return pa.RecordBatch.from_arrays([arrays[f.name] for f in NODES], [f.name for f in NODES])


class Assessed:
    """An element that is open: the grammar's state, what it said, the children and texts so far."""

    __slots__ = ("children", "note", "state", "texts")

    def __init__(self, state, note: list | None):
        self.state, self.note, self.children, self.texts = state, note, [], []

    def close(self, n_nodes: int) -> None:
        self.note[7:10] = "".join(self.children), "".join(self.texts), n_nodes


class AssessedRows(NodeRows):
    """Node rows with a grammar's findings beside them."""

    def __init__(self):
        super().__init__()
        self.notes: list[list | None] = []
        self.tokens: list[str | None] = []

    def add(self, row: tuple, attrs=(), note: list | None = None, tokens=()) -> None:
        super().add(row, attrs)
        self.notes.append(note)
        self.tokens += tokens or [None] * (len(attrs) // 2)

    def cut_back(self, rows: int) -> None:
        super().cut_back(rows)
        del self.notes[rows:], self.tokens[self.offsets[-1] :]

    def batch(self) -> pa.RecordBatch:
        plain = super().batch()
        empty = [None] * (len(ASSESSED) - 1)
        columns = zip(*[n or empty for n in self.notes], strict=True) if self.notes else [()] * len(empty)
        added = [pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, ASSESSED.fields[:-1], strict=True)]
        added.append(pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), pa.array(self.tokens, pa.string())))
        return pa.RecordBatch.from_arrays([*plain.columns, *added], [*plain.schema.names, *[f.name for f in ASSESSED]])


def enter(grammar: Grammar, parent: Assessed, ns: str, name: str, attrs: list[str], bound: Mapping[str, str]) -> tuple[Assessed, Sequence[str | None]]:
    """Open an element below ``parent``; its note has the fields of ``ASSESSED`` but the last, which is returned beside."""
    found = grammar.enter(parent.state, ns, name, attrs, bound)
    parent.children.append(grammar.token(ns, name))
    return Assessed(found[0], [*found[1:8], "", "", 0]), found[8]


class DocumentParser:
    """Parses one document after the other into shared rows.

    ``external`` maps system identifiers to the text of external entities; nothing else is
    ever fetched.  With a grammar the rows are ``AssessedRows``.  With ``paths`` only the
    elements of these paths and the leaves right below them are kept; places are counted
    over all nodes.  A reference to an entity that the document doesn't declare, where it
    names declarations elsewhere, becomes the text that ``entities`` has for it, or else a
    node of kind ``entity``.
    """

    def __init__(self, rows: NodeRows, external: Mapping[str, str] | None = None, grammar: Grammar | None = None, paths: Collection[str] | None = None, entities: Mapping[str, str] | None = None):
        self.rows, self.external, self.grammar, self.entities = rows, external or {}, grammar, entities or {}
        self.paths = None if paths is None else frozenset(paths)

    def parse(self, doc_id: int, chunks: list[str] | str | None, external: Mapping[str, str] | None = None) -> None:
        """``external`` holds texts for this document alone, before those for all."""
        first = len(self.rows)
        try:
            self._parse(doc_id, [chunks] if isinstance(chunks, str) else chunks, {**self.external, **external} if external else self.external)
        except (expat.ExpatError, ValueError) as e:
            self.rows.cut_back(first)
            self.rows.add((doc_id, 0, 0, -1, 0, 0, ERROR, None, None, str(e), None))

    def _parse(self, doc_id: int, chunks: list[str] | None, texts: Mapping[str, str]) -> None:
        if chunks is None:
            raise ValueError("no document")
        rows = self.rows
        posts, wanted, count = rows.posts, self.paths, 0
        p = expat.ParserCreate("utf-8")
        p.ordered_attributes = p.buffer_text = True
        p.buffer_size = 1 << 16
        if texts:
            p.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_ALWAYS)
        # for each open element: its place, path, bound prefixes, number of nodes, numbers by name, row
        frames: list[list] = [[-1, "", {"xml": XML_URI, "xmlns": XMLNS_URI, "": ""}, 0, {}, -1]]
        grammar = self.grammar
        opened = [Assessed(grammar.start(0), None)] if grammar else []
        in_cdata: list[str] | None = None
        run: list[str] = []  # pieces of a text that doesn't fit the parser's buffer
        subset_at = 0
        data = [c.encode("utf-8", "surrogatepass") for c in chunks]

        def leaf(kind: str, name: str | None, value: str | None, attrs: tuple | list = ()) -> None:
            nonlocal count
            frame = frames[-1]
            count += 1
            if wanted is not None and frame[1] not in wanted:
                frame[3] += 1
                return
            rows.add((doc_id, count - 1, len(frames) - 1, frame[0], frame[3], 0, kind, name, None, value, frame[1]), attrs)
            frame[3] += 1

        def end_of_text() -> None:
            whole = "".join(run)
            run.clear()
            leaf("text", None, whole)

        def start(name: str, attrs: list[str]) -> None:
            nonlocal count
            if run:
                end_of_text()
            frame = frames[-1]
            bound, named = frame[2], frame[4]
            for k in range(0, len(attrs), 2):
                if attrs[k][:5] == "xmlns" and (attrs[k] == "xmlns" or attrs[k][5] == ":"):
                    bound = bound | {attrs[k][6:]: attrs[k + 1]}
            occ = named.get(name, 0)
            named[name] = occ + 1
            pre, path = count, f"{frame[1]}/{name}"
            count += 1
            kept = wanted is None or path in wanted
            uri = bound.get(name.partition(":")[0] if ":" in name else "")
            row = (doc_id, pre, len(frames) - 1, frame[0], frame[3], occ, "element", name, uri, None, path)
            if grammar:
                own, tokens = enter(grammar, opened[-1], uri or "", name, attrs, bound)
                opened.append(own)
                if kept:
                    rows.add(row, attrs, own.note, tokens)
            elif kept:
                rows.add(row, attrs)
            frame[3] += 1
            frames.append([pre, path, bound, 0, {}, len(posts) - 1 if kept else -1])

        def end(_name: str) -> None:
            if run:
                end_of_text()
            frame = frames.pop()
            if frame[5] >= 0:
                posts[frame[5]] = count - 1
            if grammar:
                opened.pop().close(frame[3])

        def text(value: str) -> None:
            if in_cdata is not None:
                in_cdata.append(value)
            elif len(frames) > 1:
                run.append(value)
                if grammar:
                    opened[-1].texts.append(value)

        def cdata_start() -> None:
            nonlocal in_cdata
            if run:
                end_of_text()
            in_cdata = []

        def cdata_end() -> None:
            nonlocal in_cdata
            leaf("cdata", None, "".join(in_cdata))
            if grammar:
                opened[-1].texts.append("".join(in_cdata))
            in_cdata = None

        def text_declaration(version: str | None, encoding: str | None, standalone: int) -> None:
            if encoding and encoding.upper() not in SUPPORTED_ENCODINGS:
                raise ValueError(f"unsupported encoding: {encoding}")

        def declaration(version: str | None, encoding: str | None, standalone: int) -> None:
            text_declaration(version, encoding, standalone)
            parts = [("version", version), ("encoding", encoding), ("standalone", {1: "yes", 0: "no"}.get(standalone))]
            leaf("declaration", "xml", None, [x for part in parts if part[1] is not None for x in part])

        def doctype(name: str, system_id: str | None, public_id: str | None, has_subset: int) -> None:
            nonlocal subset_at
            subset_at = p.CurrentByteIndex if has_subset else -1
            doctype_row[:] = [name, public_id, system_id]
            p.CommentHandler = p.ProcessingInstructionHandler = None

        def doctype_end() -> None:
            name, public_id, system_id = doctype_row
            subset = None
            if subset_at >= 0:
                whole = b"".join(data)[: p.CurrentByteIndex + 1]
                bracket = whole.index(b"[", subset_at)
                subset = whole[bracket + 1 : whole.rindex(b"]")].decode("utf-8", "surrogatepass")
            parts = [("public_id", public_id), ("system_id", system_id)]
            leaf("doctype", name, subset, [x for part in parts if part[1] is not None for x in part])
            p.CommentHandler, p.ProcessingInstructionHandler = comment, pi

        def external(context: str, _base: str | None, system_id: str | None, public_id: str | None) -> int:
            found = texts.get(system_id or "", texts.get(public_id or ""))
            if found is None:
                if context:  # a general entity whose text isn't at hand: its name comes first in the context
                    skipped(context.partition("\f")[0] if "=" not in context.partition("\f")[0] else "", False)
                return 1
            if "\0" in found:
                raise ValueError("NUL in an external entity")
            child = p.ExternalEntityParserCreate(context)
            child.XmlDeclHandler = text_declaration
            if run:
                end_of_text()
            child.Parse(found.encode("utf-8", "surrogatepass"), True)
            if run:
                end_of_text()
            return 1

        def comment(value: str) -> None:
            if run:
                end_of_text()
            leaf("comment", None, value)

        def pi(target: str, value: str) -> None:
            if run:
                end_of_text()
            leaf("pi", target, value)

        def skipped(name: str, is_parameter: bool) -> None:
            if not is_parameter and len(frames) > 1:
                if run:
                    end_of_text()
                if name in self.entities:
                    text(self.entities[name])
                    end_of_text()
                else:
                    leaf("entity", name, None)

        doctype_row: list[str | None] = []
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, text
        p.CommentHandler, p.ProcessingInstructionHandler = comment, pi
        p.StartCdataSectionHandler, p.EndCdataSectionHandler = cdata_start, cdata_end
        p.XmlDeclHandler, p.StartDoctypeDeclHandler, p.EndDoctypeDeclHandler = declaration, doctype, doctype_end
        p.ExternalEntityRefHandler, p.SkippedEntityHandler = external, skipped
        for n, piece in enumerate(data):
            p.Parse(piece.removeprefix(_BOM.encode()) if n == 0 else piece, False)
        p.Parse(b"", True)


def parse(docs: DataFrame, external: Mapping[str, str] | None = None, grammar: Grammar | None = None, tasks: int | None = None, paths: Collection[str] | None = None, entities: Mapping[str, str] | None = None) -> DataFrame:
    """Node rows of ``docs`` (``doc_id, xml``), error rows included.

    ``paths`` keeps the elements of these paths (``/a/b``) with the leaves right below them,
    and leaves the rest out before it becomes rows; without it all nodes are given.

    ``entities`` has texts for entities that a document uses but doesn't declare; ``external``
    those of external entities by system or public identifier, and a column ``external``
    (such a map) the document's own (see ``with_external``).

    With a grammar, elements have the columns of ``ASSESSED`` too.  Documents are not moved,
    unless ``tasks`` asks for them to be dealt evenly first: parsing is the costly step, and
    many small documents in one file would otherwise be parsed by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = AssessedRows() if grammar else NodeRows()
        parser = DocumentParser(rows, external, grammar, paths, entities)
        for b in batches:
            own = b.column(2).to_pylist() if b.num_columns > 2 else repeat(None, b.num_rows)
            for doc_id, xml, texts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), own, strict=True):
                parser.parse(doc_id, xml, dict(texts) if texts else None)
                if len(rows) >= LARGEST_BATCH:
                    yield rows.batch()
                    parser.rows = rows = type(rows)()
        if len(rows):
            yield rows.batch()

    read = docs.select(F.col("doc_id").cast("long"), F.col("xml").cast("string"), *["external"] * ("external" in docs.columns))
    schema = T.StructType(NODES.fields + ASSESSED.fields) if grammar else NODES
    return (read.repartition(tasks) if tasks else read).mapInArrow(run, schema)


def assess(nodes: DataFrame, grammar: Grammar, number: str | None = None) -> DataFrame:
    """Elements of stored node rows with the columns of ``ASSESSED``; a grammar's number may come from a column.

    A document's rows are read in order by one task, which holds the open elements alone.
    """
    wanted = ["doc_id", "pre", "post", "level", "parent", "kind", "name", "ns_uri", "value", "attrs"]
    keyed = nodes.select(*wanted, (F.col(number) if number else F.lit(0)).cast("int").alias("number"))
    fields = [f for f in NODES.fields if f.name in wanted] + ASSESSED.fields
    schema = T.StructType(fields)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        open_: list[tuple[Assessed, dict, Mapping[str, str]]] = []
        top, doc = None, object()

        def close(until: int | None) -> None:
            while open_ and (until is None or until > open_[-1][1]["post"]):
                own, row, _ = open_.pop()
                own.close(row.pop("n"))
                done.append(row | dict(zip(arrow.names[-len(ASSESSED) : -1], own.note, strict=True)))

        for b in batches:
            for row in b.to_pylist():
                if row["doc_id"] != doc:
                    close(None)
                    doc, top = row["doc_id"], Assessed(grammar.start(row["number"] or 0), None)
                close(row["pre"])
                if open_:
                    open_[-1][1]["n"] += 1
                    if row["kind"] in ("text", "cdata"):
                        open_[-1][0].texts.append(row["value"] or "")
                if row["kind"] == "element":
                    parent, _, bound = open_[-1] if open_ else (top, None, {"xml": XML_URI, "xmlns": XMLNS_URI, "": ""})
                    attrs = [x for a in row["attrs"] or () for x in (a["name"], a["value"])]
                    own_names = {n[6:]: v for n, v in zip(attrs[::2], attrs[1::2], strict=True) if n == "xmlns" or n.startswith("xmlns:")}
                    bound = bound | own_names if own_names else bound
                    own, tokens = enter(grammar, parent, row["ns_uri"] or "", row["name"], attrs, bound)
                    kept = {f.name: row[f.name] for f in fields[: -len(ASSESSED)]}
                    open_.append((own, kept | {"tokens": list(tokens) or [None] * (len(attrs) // 2), "n": 0}, bound))
            if len(done) >= LARGEST_BATCH:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done.clear()
        close(None)
        yield pa.RecordBatch.from_pylist(done, arrow)

    return keyed.repartition("doc_id").sortWithinPartitions("doc_id", "pre").mapInArrow(run, schema)


def nodes_of(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("kind") != ERROR)


def status_of(parsed: DataFrame) -> DataFrame:
    """``doc_id, well_formed, error``: one row for each document."""
    return parsed.where((F.col("kind") == ERROR) | ((F.col("level") == 0) & (F.col("kind") == "element"))).select(
        "doc_id",
        (F.col("kind") != ERROR).alias("well_formed"),
        F.when(F.col("kind") == ERROR, F.regexp_replace("value", r": line \d+, column \d+$", "")).alias("error"),
    )


PSEUDO = re.compile(r"""([\w.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


def pseudo_attributes(data: str) -> dict[str, str]:
    """Name and value pairs of a processing instruction such as ``xml-model``."""
    return {m[1]: m[2] if m[2] is not None else m[3] for m in PSEUDO.finditer(data or "")}
