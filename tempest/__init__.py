"""tempest: weather-risk analytics as Spark DataFrame jobs.

Subpackages
- ``sources``   : schemas, file readers/writers, keyed store (upsert), fixture panels
- ``functions`` : Column-expression builders (calendar, weather indices, flags)
                  and small driver-side distribution helpers for p-values
- ``operators`` : DataFrame -> DataFrame operators (cleaning, features, aggregates,
                  joins, quality gates, statistics, models, marts)
- ``plans``     : composed jobs (layer runs, the registered query catalogue)
- ``streaming`` : Structured Streaming ingestion and roll-ups
"""

from tempest.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
