"""treeloom: a PySpark engine over large collections of XML documents."""
