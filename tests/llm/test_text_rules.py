"""Quality rules, decontamination, license scan and their edge cases."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, license_scan, quality_rules
from tests.llm.helpers import alnum_words, corpus, documents, leaked, words


def measures(text):
    w, t = words(text), text or ""
    windows = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    times, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if times[x] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered))


AWKWARD = [(900, "a b c a b c a b c"), (901, "x " * 3), (902, "#### $$ | x\n#### $$ | x\n\n\n"), (903, "a\tb\x0bc\x0cd\re"),
           (904, " ".join(f"v{k % 50}" for k in range(9000)))]


def test_quality_measures_equal_the_plain_rule(spark):
    rows = corpus() + AWKWARD
    got = quality_rules.apply_rules(documents(spark, rows).withColumn("n_words", F.lit("clash")))
    want = Counter((i, *measures(t)) for i, t in rows)
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter(tuple(r[c] for c in cols) for r in got.collect()) == want
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_equal_hashes_and_long_texts_take_the_exact_way(spark, monkeypatch):
    rows = corpus() + AWKWARD
    want = Counter((i, measures(t)[-1]) for i, t in rows)
    for bits in (3, 58):  # too few places for the text; hashes cut to a few bits
        monkeypatch.setattr(quality_rules, "PLACE_BITS", bits)
        got = quality_rules.measure(documents(spark, rows)).select("doc_id", "n_repeat_words")
        assert Counter(map(tuple, got.collect())) == want


def test_rules_are_one_projection_without_python(spark):
    plan = quality_rules.apply_rules(documents(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_junk_goes_and_prose_stays(spark):
    prose = " ".join(f"the word{k} of thing{k}" for k in range(40))
    junk = ["buy now!! " * 60, "a$$$ b### c&&& " * 40, " | ".join(f"w{k}" for k in range(100)), "short"]
    rows = [(0, prose)] + [(k + 1, t) for k, t in enumerate(junk)]
    got = dict(quality_rules.apply_rules(documents(spark, rows)).select("doc_id", "kept").collect())
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False}
    names = quality_rules.apply_rules(documents(spark, rows)).select(
        "doc_id", quality_rules.failed_rules().alias("f")).collect()
    assert {r["doc_id"]: r["f"] for r in names}[4] == ["too_short"]


ITEMS = [(1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa."), (2, "w1 w2"), (3, None), (4, "  "),
         (5, " ".join(f"q{k}" for k in range(200))), (1, "lambda mu nu xi omicron pi"), (6, "lambda mu nu xi omicron pi")]


def leaky_rows():
    q = [f"q{k}" for k in range(200)]
    broken = q.copy()
    for k in (20, 60, 100, 140, 180):
        broken[k] = "zz"
    return corpus() + [
        (700, "before ALPHA beta gamma-delta epsilon zeta eta theta iota kappa after"), (701, " ".join(broken)),
        (702, " ".join(q[:150])), (703, "so w1 w2 it is"), (704, "lambda mu nu xi omicron pi"),
        (705, "alpha beta gamma delta epsilon"), (706, ("noise " * 3000) + " ".join(q))]


@pytest.mark.parametrize("block_words", [2_000_000, 60])
def test_leaks_equal_the_plain_rule(spark, block_words):
    rows = leaky_rows()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.leaks(documents(spark, rows), items, block_words=block_words)
    found = Counter(tuple(r[c] for c in ("doc_id", "item_id", "n_shared", "n_item")) for r in got.collect())
    assert found == leaked(rows, ITEMS)
    assert {700, 701, 703, 704, 706} <= {k[0] for k in found} and 702 not in {k[0] for k in found}


def test_clean_drops_leaked_rows_only(spark):
    rows = leaky_rows()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    bad = {(k[0], t) for k in leaked(rows, ITEMS) for i, t in rows if i == k[0]
           and leaked([(i, t)], ITEMS)}
    got = decontaminate.clean(documents(spark, rows), items)
    assert got.columns == documents(spark, rows).columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(r for r in rows if r not in bad)


def test_decontamination_of_empty_tables(spark):
    none = documents(spark, []), spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.leaks(none[0], items).count() == 0
    assert decontaminate.leaks(documents(spark, leaky_rows()), none[1]).count() == 0


LICENSED = [(800, "MIT License"), (801, "x mit\nlicense mit license y"), (802, "the Apache-License; general public license"),
            (803, "mit apache license general license"), (804, "Licensed under CC BY-NC 4.0."),
            (805, "Licensed under CC 4.0 BY-NC"), (806, "mit"), (807, "MİT license. mit  license é"),
            (808, "This program is free software you can redistribute it and modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation"),
            (809, "general public license general public license")]


def base(text):
    w = alnum_words(text)
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        at = [k for k in range(len(w)) if w[k:k + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def test_license_base_equals_the_plain_rule(spark, monkeypatch):
    rows = corpus() + LICENSED
    cols = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    want = Counter((i, *base(t)) for i, t in rows)
    for most in (license_scan.BROADCAST_SPANS, 0):  # spans joined by broadcast and by shuffle
        monkeypatch.setattr(license_scan, "BROADCAST_SPANS", most)
        got = license_scan.scan(documents(spark, rows).withColumn("labels", F.lit(1))).collect()
        assert Counter(tuple(r[c] for c in cols) for r in got) == want
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[804]["labels"] == "cc,cc-by-nc" and by_id[804]["base_labels"] == ""
    assert by_id[805]["labels"] == "" and by_id[805]["score"] == 0
    assert by_id[808]["labels"] == "gpl" and by_id[808]["score"] == 1  # one word left out, exact phrase whole
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_license_scan_has_no_python(spark):
    df = license_scan.scan(documents(spark, corpus() + LICENSED))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan


def test_license_scan_of_an_empty_table(spark):
    assert license_scan.scan(documents(spark, [])).count() == 0


def license_text(label):
    return next(t for t, name in license_scan.TEXTS.items() if name == label)


def with_slips(text, every):
    return " ".join("zz" if k % every == every - 1 else w for k, w in enumerate(text.split()))


@pytest.mark.parametrize("label", sorted(license_scan.TEXTS.values()))
def test_whole_license_texts(spark, label):
    text = license_text(label)
    half = " ".join(text.split()[:len(text.split()) // 2])
    rows = [(1, text.upper()), (2, "some code\n" * 40 + with_slips(text, 40) + "\nmore code"), (3, with_slips(text, 4)),
            (4, half), (5, text + "\n" + "other words " * 30 + text)]
    got = {r["doc_id"]: r for r in license_scan.scan(documents(spark, rows)).collect()}
    has = {k: label in r["labels"].split(",") for k, r in got.items()}
    assert has == {1: True, 2: True, 3: False, 4: False, 5: True}
    assert got[1]["score"] == 1
    whole = [t.number for t in license_scan.templates() if t.label == label]
    found = license_scan.find_licenses(documents(spark, rows)).where(F.col("template").isin(whole)).select(
        "_id", "first", "stop").collect()
    n = len(text.split())
    assert {(1, 0, n), (5, 0, n), (5, n + 60, 2 * n + 60)} <= {tuple(r) for r in found}


def test_one_license_is_not_taken_for_another(spark):
    texts = list(license_scan.TEXTS.items())
    got = license_scan.scan(documents(spark, [(k, t) for k, (t, _) in enumerate(texts)])).collect()
    for r in got:
        assert {x for x in r["labels"].split(",") if x in license_scan.TEXTS.values()} == {texts[r["doc_id"]][1]}


def test_a_callers_long_template(spark):
    rng = __import__("random").Random(4)
    words_of = [f"v{rng.randrange(900)}" for _ in range(4000)]
    rows = [(1, "x y z " + " ".join(words_of)), (2, " ".join(words_of[:2000])), (3, " ".join(words_of[::-1]))]
    got = license_scan.scan(documents(spark, rows), wording={" ".join(words_of): "house"}).collect()
    assert {r["doc_id"]: r["labels"] for r in got} == {1: "house", 2: "", 3: ""}
