"""tallyspark: banking-ledger reports as Spark DataFrame pipelines.

Layout
------
``sources``    where relations come from (parquet catalog, test-data adapters)
``functions``  column helpers that reproduce Oracle semantics (NULL/'' rules,
               concatenation, exact rounding, weekday tests, date labels)
``operators``  reusable ``DataFrame -> DataFrame`` business operators
``plans``      the seven reports plus the query registry used for checking

Every public operator takes and returns DataFrames; nothing is collected to
the driver and no Python UDF sits in a hot path.
"""

from tallyspark.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
