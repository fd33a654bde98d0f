"""Relation sources.

A *source* is any object with ``table(name) -> DataFrame`` for the 21
relation names in ``TestdataSource.RELATIONS``.  Reports only ever call
``source.table(...)``, so they run unchanged on the generated test tables
(``TestdataSource``) and on a production parquet catalog (``ParquetSource``).
"""

from tallyspark.sources.parquet import (  # noqa: F401
    ParquetSource, blank_strings_to_null, ingest_day, ingest_snapshot_day, materialize, normalise,
    replace_day, write_relation,
)
from tallyspark.sources.manifest import sweep  # noqa: F401
from tallyspark.sources.testdata import TestdataSource  # noqa: F401
