from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tallyspark import build_session
    s = build_session("local[4]", app="tallyspark-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_source(spark):
    from tallyspark.sources import TestdataSource
    return TestdataSource(spark, SMALL)


def nullable(schema):
    from pyspark.sql import types as T
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


class FixtureSource:
    """A source made of hand-written DataFrames; relations not given are
    empty with the schema the generated source has."""

    def __init__(self, spark, template, **tables):
        self.spark = spark
        self.template = template
        self.tables = tables

    def table(self, name):
        from tallyspark.sources import derived
        if name in self.tables:
            df = self.tables[name]
            schema = nullable(self.template.table(name).schema)
            return self.spark.createDataFrame(df, schema) if isinstance(df, list) else df
        if name in derived.DERIVED:
            return derived.derive(name, self.table(derived.DERIVED_FROM.get(name, "ledger_entry")))
        return self.spark.createDataFrame([], nullable(self.template.table(name).schema))


@pytest.fixture
def fixture_source(spark, small_source):
    def make(**tables):
        return FixtureSource(spark, small_source, **tables)
    return make
