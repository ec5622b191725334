"""lodestrata: permission-aware retrieval analytics on PySpark.

Subpackages
-----------
``sources``    corpus listing, Markdown parsing, seeds, versioned Parquet store
``functions``  column expressions: text analysis, cleaning, vectors, ranking
``operators``  relational operators: ACL, dense / lexical search, fusion, ingest
``plans``      end-to-end plans and the query catalogue with its oracle SQL
``streaming``  incremental ingest trigger
``llm``        training-data operators (nothing else imports it)
"""

__version__ = "0.1.0"
