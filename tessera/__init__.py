"""tessera: a Spark-native corpus and document-classification toolkit.

Every operator is a function ``DataFrame -> DataFrame`` (or a ``Column``
expression), so stages chain with ``df.transform``.
"""

__version__ = "0.1.0"
