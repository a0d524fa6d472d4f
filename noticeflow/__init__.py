"""noticeflow: a Spark-native pipeline for public-procurement notices.

Every operator is a lazy ``DataFrame -> DataFrame`` (or ``DataFrame -> small
result DataFrame``) function built from Spark SQL expressions, so Catalyst
can push filters and prune columns through whole stage chains.

Sub-packages:

* ``sources``   -- ingestion, stage checkpoints, the cfc/can fixtures
* ``functions`` -- Column-level scalar expressions (parsing, flags, ids)
* ``operators`` -- row filters, matching, merging, bias analysis, cleaning,
                   ordered/prefix operators, sampling, profiling, evaluation
* ``plans``     -- stage chains (preparation -> golden table) and the
                   query registry used by ``__spark_entry__``
* ``streaming`` -- the stateless preparation stage wired to Structured
                   Streaming
"""

__all__ = ["session"]
