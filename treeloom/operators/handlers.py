"""Custom handlers: a class with callbacks becomes a table function over documents."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf


class Handler:
    """Callbacks of a parse; ``rows`` are what the table function gives out."""

    def __init__(self):
        self.rows: list[tuple] = []

    def start(self, name: str, attrs: dict[str, str]) -> None: ...

    def end(self, name: str) -> None: ...

    def text(self, value: str) -> None: ...


def run_handler(handler: Handler, xml: str) -> list[tuple]:
    """Rows that a handler makes of one document; none where it isn't well formed."""
    p = expat.ParserCreate("utf-8")
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = handler.start, handler.end, handler.text
    try:
        p.Parse(xml.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError:
        return []
    return handler.rows


def table_function(handler: type[Handler], returns: str):
    """A Python table function ``f(doc_id, xml)`` with ``doc_id`` before the handler's columns."""

    class Function:
        def eval(self, doc_id: int, xml: str) -> Iterator[tuple]:
            for row in run_handler(handler(), xml or ""):
                yield (doc_id, *row)

    return udtf(Function, returnType=f"doc_id bigint, {returns}")


class CountHandler(Handler):
    """Elements and characters by name."""

    def start(self, name: str, attrs: dict[str, str]) -> None:
        self.rows.append((name, len(attrs)))


def register_count(spark: SparkSession, name: str = "count_elements") -> None:
    spark.udtf.register(name, table_function(CountHandler, "name string, n_attrs int"))


def apply_handler(spark: SparkSession, docs: DataFrame, name: str = "count_elements") -> DataFrame:
    register_count(spark, name)
    return spark.sql(f"select r.* from {{docs}} d, lateral {name}(d.doc_id, d.xml) r", docs=docs)
