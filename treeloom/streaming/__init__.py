"""Documents that arrive in pieces: read piece by piece, put together, or counted in windows.

Chunks (``CHUNKS``) come in any order and any cut; those that come twice count once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import ERROR, NODES
from ..sources.resumable import JsonReader, XmlReader
from ..sources.tokenizer import parse

CHUNKS = "doc_id long, chunk int, last boolean, text string"
#: Chunks with the time of their arrival, for those that are waited for no longer than a given time.
TIMED_CHUNKS = f"{CHUNKS}, at timestamp"
DOCUMENT = "doc_id long, xml string, complete boolean"
ITEMS = "doc_id long, number long, item string, error string"
UNFINISHED = "document not finished"


def _watched(chunks: DataFrame, patience: str | None) -> DataFrame:
    return chunks.withWatermark("at", patience) if patience else chunks


def read_pieces(
    chunks: DataFrame, new: Callable[[], Any], load: Callable[[str], Any], schema: str | T.StructType, unfinished: dict, patience: str | None = None
) -> DataFrame:
    """Stream of chunks to a stream of the rows that a resumable reader gives out at each of them.

    State holds the reader put aside (open elements and the unfinished token) and chunks
    that came before their turn, not what has been read.  With ``patience`` (an interval;
    chunks then have a column ``at``) a document of which no chunk came for so long is given
    up: the row ``unfinished``, with the ``doc_id``, is given out and its state released.
    Without it an unfinished document stays state, a broken one as a short mark.
    """
    columns = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = columns.fieldNames()
    timeout = GroupStateTimeout.EventTimeTimeout if patience else GroupStateTimeout.NoTimeout
    wait = int(pd.Timedelta(patience).total_seconds() * 1000) if patience else 0

    def frame(rows: list[dict], doc_id: int) -> pd.DataFrame:
        return pd.DataFrame([r | {"doc_id": doc_id} for r in rows], columns=names)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            done = json.loads(state.get[0])["done"]
            state.remove()
            if not done:
                yield frame([unfinished], key[0])
            return
        kept = json.loads(state.get[0]) if state.exists else {"reader": None, "next": 0, "last": -1, "held": {}, "done": False, "over": False, "seen": 0}
        reader = load(kept["reader"]) if kept["reader"] else new()
        held = {int(k): v for k, v in kept["held"].items()}
        for b in batches:
            rows = []
            for chunk, ends, text in zip(b["chunk"], b["last"], b["text"], strict=True):
                if not kept["done"] and chunk >= kept["next"]:
                    held[int(chunk)] = text or ""
                    kept["last"] = int(chunk) if ends else kept["last"]
                while kept["next"] in held and not kept["done"]:
                    final = kept["next"] == kept["last"]
                    rows += reader.feed(held.pop(kept["next"]), final)
                    kept["next"] += 1
                    kept["done"], kept["over"] = final or reader.failed, final
            if patience and len(b):
                kept["seen"] = max(kept["seen"], int(b["at"].max().timestamp() * 1000))
            if rows:
                yield frame(rows, key[0])
        if kept["over"] and not patience:
            state.remove()
            return
        kept |= {"reader": None if kept["done"] else reader.dump(), "held": {} if kept["done"] else held}
        state.update((json.dumps(kept),))
        if patience:
            state.setTimeoutTimestamp(max(kept["seen"], state.getCurrentWatermarkMs()) + max(wait, 1))

    return _watched(chunks, patience).groupBy("doc_id").applyInPandasWithState(step, columns, "kept string", "append", timeout)


def parse_pieces(chunks: DataFrame, patience: str | None = None, most_text: int = 1 << 20) -> DataFrame:
    """Stream of chunks to a stream of node rows, given out while the document is still coming.

    The rows are those of a whole parse, in another order.  Of a document that isn't well
    formed, or not finished in time, the rows up to there are followed by an ``error`` row.
    """
    unfinished = {n: None for n in NODES.fieldNames()} | {"pre": 0, "post": 0, "level": 0, "parent": -1, "sib": 0, "occ": 0, "kind": ERROR, "value": UNFINISHED, "attrs": []}
    return read_pieces(chunks, lambda: XmlReader(most_text), XmlReader.load, NODES, unfinished, patience)


def json_items(chunks: DataFrame, patience: str | None = None) -> DataFrame:
    """Stream of chunks of JSON texts to a stream of their items (``ITEMS``), each as soon as it ends."""
    unfinished = {"number": None, "item": None, "error": UNFINISHED}
    return read_pieces(chunks, JsonReader, JsonReader.load, ITEMS, unfinished, patience)


def reassemble(chunks: DataFrame) -> DataFrame:
    """Stream of chunks to a stream of whole documents.

    A document is given out when its last chunk and all before it have come; until then
    its chunks are state.  ``parse_pieces`` needs less where nodes are wanted.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        numbers, texts, last = state.get if state.exists else ([], [], -1)
        held = dict(zip(numbers, texts, strict=True))
        for b in batches:
            for chunk, ends, text in zip(b["chunk"], b["last"], b["text"], strict=True):
                held[int(chunk)] = text
                last = int(chunk) if ends else last
        if last >= 0 and all(k in held for k in range(last + 1)):
            state.remove()
            yield pd.DataFrame({"doc_id": [key[0]], "xml": ["".join(held[k] for k in range(last + 1))], "complete": [True]})
        else:
            state.update((list(held), list(held.values()), last))

    return chunks.groupBy("doc_id").applyInPandasWithState(
        step, DOCUMENT, "numbers array<int>, texts array<string>, last int", "append", GroupStateTimeout.NoTimeout
    )


def parse_stream(chunks: DataFrame) -> DataFrame:
    """Stream of chunks to a stream of node rows, whole documents at a time."""
    return parse(reassemble(chunks).select("doc_id", "xml"))


def split_chunks(docs: DataFrame, size: int, text: str = "xml") -> DataFrame:
    """Documents cut into chunks of ``size`` characters, as a source for tests and replays."""
    # cut in one pass; a substring for each chunk would go through the text from its start each time
    cut = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    pieces = docs.select("doc_id", F.when(F.length(text) > 0, cut).otherwise(F.array(F.col(text))).alias("pieces"))
    each = pieces.select("doc_id", (F.size("pieces") - 1).alias("end"), F.posexplode("pieces").alias("chunk", "text"))
    return each.select("doc_id", "chunk", (F.col("chunk") == F.col("end")).alias("last"), "text")


def windowed_counts(records: DataFrame, time: str, width: str, late: str | None = None) -> DataFrame:
    """Records per tumbling window; with ``late`` a watermark lets a stream close its windows."""
    source = records.withWatermark(time, late) if late else records
    return source.groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
