"""chunkloom: a PySpark-native engine for code and knowledge retrieval.

DataFrames in, DataFrames out.  `operators` holds the relational and graph
operators, `functions` the column expressions, `sources` the readers and
writers, `streaming` the Structured Streaming twins, `plans` the registered
queries.  The optional subpackage `llm` holds training-data operators; nothing
else imports it.
"""

__version__ = "0.1.0"
