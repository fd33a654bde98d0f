"""A key holding a third of the rows: salted joins give the plain join's
result and spread that key over several reducers."""

from __future__ import annotations

from collections import Counter
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.relational import lookup_join, salted_join, split_sides


@pytest.fixture(scope="module")
def skewed(spark):
    rows = [("HOT", i, i % 7) for i in range(3000)]                 # 3000 of 6300 rows
    rows += [(f"k{i % 900}", i, i % 5) for i in range(3000)]
    rows += [(None, i, 0) for i in range(300)]
    big = spark.createDataFrame(rows, "key string, n long, v int")
    keyed = spark.createDataFrame([("HOT", 1)] + [(f"k{i}", i) for i in range(0, 900, 2)],
                                  "key string, w int")
    return big, keyed


@contextmanager
def conf(spark, **kv):
    old = {k: spark.conf.get(k, None) for k in kv}
    for k, v in kv.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(skewed, how):
    big, keyed = skewed
    got = Counter(map(tuple, salted_join(big, keyed, ["key"], how, salts=8).collect()))
    want = Counter(map(tuple, big.join(keyed, ["key"], how).collect()))
    assert got == want


def test_hot_key_is_spread_over_reducers(spark, skewed):
    big, keyed = skewed
    with conf(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1",
                        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                        "spark.sql.adaptive.coalescePartitions.enabled": "false",
                        "spark.sql.shuffle.partitions": "16"}):
        j = salted_join(big, keyed, ["key"], "inner", salts=8)
        parts = (j.where(F.col("key") == "HOT")
                 .groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert len(parts) >= 4
    assert max(r["count"] for r in parts) <= 3000 / 2


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_reduced_salted_join_equals_plain_join(skewed, how):
    big, keyed = skewed
    got = Counter(map(tuple, salted_join(big, keyed, ["key"], how, salts=4,
                                         reduce_keyed=True).collect()))
    want = Counter(map(tuple, big.join(keyed, ["key"], how).collect()))
    assert got == want


def hot_keys(spark, *keys, kind="key"):
    return spark.createDataFrame([(kind, k, 1, None) for k in keys], "kind string, key string, n long, trn_dt date")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("picked", [[], ["HOT"], ["HOT", "k3", "k4", "not there"]])
def test_any_pick_of_hot_keys_gives_the_plain_join(spark, skewed, how, picked):
    big, keyed = skewed
    got = salted_join(big, keyed, ["key"], how, salts=8, hot=hot_keys(spark, *picked))
    assert Counter(map(tuple, got.select("key", *[c for c in got.columns if c != "key"]).collect())) == Counter(
        map(tuple, big.join(keyed, ["key"], how).collect()))


def test_only_hot_keys_are_replicated_and_spread(spark, skewed):
    big, keyed = skewed
    left, right = split_sides(big, keyed, "key", 8, None, hot_keys(spark, "HOT"))
    cold, plain = split_sides(big, keyed, "key", 8, None, hot_keys(spark))
    copies = Counter(r["key"] for r in right.collect())
    assert copies.pop("HOT") == 8 and set(copies.values()) == {1}
    assert plain.count() == keyed.count()
    rows = left.groupBy("key").agg(F.countDistinct("_salt").alias("n")).collect()
    assert {r["key"]: r["n"] for r in rows if r["n"] > 1}.keys() == {"HOT", None}  # NULL meets nothing
    assert cold.where("key is not null").select("_salt").distinct().count() == 1


def test_hot_key_of_the_split_join_is_spread_over_reducers(spark, skewed):
    big, keyed = skewed
    with conf(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1",
                        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                        "spark.sql.adaptive.coalescePartitions.enabled": "false",
                        "spark.sql.shuffle.partitions": "16"}):
        j = salted_join(big, keyed, ["key"], "inner", salts=8, hot=hot_keys(spark, "HOT"))
        parts = (j.where(F.col("key") == "HOT")
                 .groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert len(parts) >= 4
    assert max(r["count"] for r in parts) <= 3000 / 2


def test_a_hot_transaction_comes_down_to_a_row_for_each_gl(spark):
    """Cash flag and nets of ``net_by_mode`` against the rows of ``classify_mode``,
    with a key that holds most rows and keys with NULLs."""
    from tallyspark.operators.ledger import classify_mode, net_by_mode
    rows = [("HOT", 5, "MMK", "001", f"g{i % 4}", "D" if i % 3 else "C", "5" if i % 500 == 0 else "1", i)
            for i in range(3000)]
    rows += [(f"T{i % 40}", i % 3, "USD" if i % 2 else "MMK", "002", f"g{i % 5}", "C", "5" if i % 11 == 0 else None, i)
             for i in range(600)]
    rows += [(None, 1, "MMK", "001", "g1", "D", "5", 1), (None, 1, "MMK", "001", "g2", "D", "1", 2),
             ("N", None, "MMK", "001", "g1", "D", "5", 3), ("N", None, "MMK", "001", "g2", "C", "2", None)]
    ds = spark.createDataFrame(rows, "trn_ref_no string, lcy_amount int, ac_ccy string, ac_branch string, "
                                     "gl_code string, drcr_ind string, type string, fcy_amount int")
    keys = ["gl_code", "ac_ccy", "drcr_ind", "trn_mode"]
    want = classify_mode(ds).groupBy(*keys).agg(F.sum("lcy_amount"), F.sum("fcy_amount"))
    assert Counter(map(tuple, net_by_mode(ds).collect())) == Counter(map(tuple, want.collect()))
    with conf(spark, **{"spark.sql.adaptive.enabled": "false"}):
        plan = net_by_mode(ds)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("HashAggregate") >= 4


def lookups(spark):
    """Accounts: one hot with two map rows and a term, one hot without any, cold
    ones mapped twice, by term only and not at all, and NULL on each side."""
    big = [("HOT", f"T{i}", i % 9) for i in range(3000)] + [("BARE", f"T{i}", 1) for i in range(500)]
    big += [(f"k{i % 40}", f"T{i}", i % 5) for i in range(400)] + [(None, f"T{i}", 1) for i in range(30)]
    mapped = [("HOT", "g1"), ("HOT", "g2"), ("k1", "g1"), ("k1", None), ("k2", "g3"), (None, "g9"), ("else", "g1")]
    term = [("HOT", 30), ("k2", 50), ("k2", None), ("k3", 90), (None, 7)]
    return (spark.createDataFrame(big, "ac_no string, trn_ref_no string, ac_entry_sr_no int"),
            spark.createDataFrame(mapped, "ac_gl_no string, ac_natural_gl string"),
            spark.createDataFrame(term, "acc string, orig_tenor_days int"))


@pytest.mark.parametrize("codes", [[], ["HOT"], ["HOT", "HOT", None, "BARE", "k2", "k3", "not there"]])
@pytest.mark.parametrize("picked", [[], ["BARE", "k1"]])
def test_natural_gl_is_the_same_whichever_accounts_are_hot(spark, codes, picked):
    from tallyspark.operators.ledger import with_natural_gl
    big, mapped, term = lookups(spark)
    chart = spark.createDataFrame([(c, "5") for c in codes], "gl_code string, type string")
    got = with_natural_gl(big, mapped, term, hot=hot_keys(spark, *picked, kind="ac_no"), gl_codes=chart)
    want = (big.join(mapped.withColumnRenamed("ac_gl_no", "ac_no").join(
                term.withColumnRenamed("acc", "ac_no"), "ac_no", "full"), "ac_no", "left")
            .select(*big.columns, "orig_tenor_days", F.coalesce("ac_natural_gl", "ac_no").alias("gl_code")))
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert Counter(map(tuple, with_natural_gl(big, mapped, term).select(want.columns).collect())) == Counter(
        map(tuple, want.collect()))


def test_entries_of_gl_accounts_are_dealt_evenly(spark):
    """Accounts of the chart hold most entries: without stored counts no task
    gets more than its share of them."""
    from tallyspark.operators.ledger import with_natural_gl
    big, mapped, term = lookups(spark)
    chart = spark.createDataFrame([("HOT",), ("BARE",)], "gl_code string")
    with conf(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1",
                        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                        "spark.sql.adaptive.coalescePartitions.enabled": "false",
                        "spark.sql.shuffle.partitions": "16"}):
        out = with_natural_gl(big, mapped, term, hot=hot_keys(spark), gl_codes=chart)
        parts = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(parts) == 16 and max(parts) <= 2 * sum(parts) / 16


def test_lookup_join_leaves_cold_keys_as_they_are(spark, skewed):
    big, keyed = skewed
    few = keyed.where("key = 'HOT'")
    got = lookup_join(big, keyed, few, "key", ["n"]).select("key", "n", "v", F.coalesce("w", "_hot_w"))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, big.join(keyed, "key", "left").collect()))
