"""Row types of the engine.

``docs``   one row for each document: ``doc_id, xml``
``nodes``  one row for each node in document order, region-encoded: a node ``d`` lies below
           ``a`` when ``d.pre > a.pre and d.pre <= a.post`` within a document
``status`` one row for each document: ``doc_id, well_formed, error``
"""

from __future__ import annotations

from pyspark.sql import types as T

XML_URI, XMLNS_URI = "http://www.w3.org/XML/1998/namespace", "http://www.w3.org/2000/xmlns/"
XSI = "http://www.w3.org/2001/XMLSchema-instance"

ATTRIBUTES = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))

NODES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("pre", T.IntegerType()),  # place in document order, from 0
        T.StructField("post", T.IntegerType()),  # pre of the last node of the subtree
        T.StructField("level", T.IntegerType()),  # 0 at the top
        T.StructField("parent", T.IntegerType()),  # pre of the parent, -1 at the top
        T.StructField("sib", T.IntegerType()),  # place among the parent's nodes, from 0
        T.StructField("occ", T.IntegerType()),  # place among equally named siblings, from 0
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),  # element or doctype name, PI target
        T.StructField("ns_uri", T.StringType()),
        T.StructField("attrs", ATTRIBUTES),  # in the order of the document; of a doctype or declaration its parts
        T.StructField("value", T.StringType()),  # text, comment, PI data; error message
        T.StructField("path", T.StringType()),  # /root/child of an element, its parent's path otherwise
    ]
)

#: What a grammar adds to elements; null for other nodes (see ``plans/assess``).
ASSESSED = T.StructType(
    [
        T.StructField("declared", T.IntegerType()),
        T.StructField("typed", T.IntegerType()),
        T.StructField("xsi_type", T.StringType()),
        T.StructField("nil", T.BooleanType()),
        T.StructField("loose", T.BooleanType()),
        T.StructField("skipped", T.BooleanType()),
        T.StructField("scope", T.MapType(T.StringType(), T.StringType())),  # prefixes and namespaces, where asked for
        T.StructField("sequence", T.StringType()),  # the children's tokens, each with a blank behind
        T.StructField("text", T.StringType()),  # text and CDATA right below
        T.StructField("n_nodes", T.IntegerType()),
        T.StructField("tokens", T.ArrayType(T.StringType())),  # one for each attribute
    ]
)

#: Kinds and the numbers under which other tools know them.
NODE_TYPES = {
    "document": 0, "element": 1, "attribute": 2, "cdata": 3, "comment": 4, "pi": 5, "text": 6, "entity": 7, "declaration": 8,
    "attlist": 9, "doctype": 10, "attdecl": 11, "elementdecl": 12, "internal_subset": 13, "notation": 14,
}

ERROR = "error"

VIOLATIONS = "doc_id long, pre int, rule string, message string"
