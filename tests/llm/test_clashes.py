"""Callers' columns that are called like the operators' own."""

from __future__ import annotations

from collections import Counter

import pytest

from tallyspark.llm import (bpe, decontaminate, html_extract, langid, license_scan, near_dup, quality_model,
                            quality_rules, substring_dup, token_count)

from .helpers import corpus, documents

NAMES = ["_id", "_th", "_n", "_pk", "_row", "_blocks", "_gone", "pk", "url", "starts", "node", "key", "keys", "comp",
         "sig", "h", "n", "c0", "c1", "item", "words", "template", "__text", "_text", "first", "stop"]


@pytest.fixture(scope="module")
def tables(spark):
    docs = documents(spark, corpus(seed=4, n=40)).cache()
    more = docs.selectExpr("'before' as `_th`", "*", *(f"'{c}' as `{c}`" for c in NAMES if c != "_th"))
    items = spark.createDataFrame([(1, " ".join(corpus(seed=4, n=40)[1][1].split()[:30]))],
                                  "item_id long, text string")
    return docs, more, items


def operators(items):
    return {
        "near_dup": near_dup.representatives,
        "clean": lambda d: decontaminate.clean(d, items),
        "licenses": license_scan.scan,
        "substring": lambda d: substring_dup.remove_repeats(d, window=35),
        "quality": quality_rules.keep_good,
        "bpe": lambda d: bpe.encode(d, __import__("public_tokenizers").path("byte_bpe_50k.json")),
        "langid": lambda d: langid.predict(d, langid.Filter([], [], {})),
        "model": lambda d: quality_model.score(d, quality_model.Model()),
        "tokens": lambda d: token_count.count_tokens(d, token_count.zipf_vocabulary(
            __import__("public_tokenizers").path("piece_bpe_32k.model"))),
    }


@pytest.mark.parametrize("name", sorted(operators(None)))
def test_no_column_is_lost_or_changed(tables, name):
    docs, more, items = tables
    run = operators(items)[name]
    plain, got = run(docs), run(more)
    assert [c for c in got.columns if c in more.columns and c not in plain.columns] == [
        c for c in more.columns if c not in docs.columns]
    cols = [c for c in plain.columns]
    one, two = ([tuple(map(str, r)) for r in x.select(*cols).collect()] for x in (plain, got))
    assert Counter(one) == Counter(two)
    extra = got.select(*[f"`{c}`" for c in NAMES]).distinct().collect()
    assert [tuple(r) for r in extra] == [tuple("before" if c == "_th" else c for c in NAMES)]


def test_extract_keeps_every_column(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>menu</p><p>text {k}</p>") for k in range(4)],
                                  "page_id long, address string, html string")
    more = pages.selectExpr("*", *(f"'{c}' as `{c}`" for c in NAMES))
    plain = html_extract.extract(pages, url_col="address")
    got = html_extract.extract(more, url_col="address")
    assert got.columns == ["page_id", "address", *NAMES, "text"]
    assert Counter(map(tuple, got.select(*plain.columns).collect())) == Counter(map(tuple, plain.collect()))
    assert {tuple(r) for r in got.select(*NAMES).collect()} == {tuple(NAMES)}


def test_output_names_of_the_caller_are_replaced(tables):
    docs, _, _ = tables
    cut = substring_dup.remove_repeats(docs.selectExpr("*", "'x' as kept_text", "'y' as n_words"), window=35)
    assert Counter(map(tuple, cut.select("doc_id", "kept_text", "n_words", "n_removed").collect())) == Counter(
        map(tuple, substring_dup.remove_repeats(docs, window=35).select(
            "doc_id", "kept_text", "n_words", "n_removed").collect()))
    assert cut.columns.count("kept_text") == 1
    path = __import__("public_tokenizers").path("byte_bpe_50k.json")
    decoded = bpe.decode(bpe.encode(docs.selectExpr("*", "'x' as decoded"), path), path)
    assert {r["decoded"] == (r["text"] or "") for r in decoded.collect()} == {True}
    vocabulary = token_count.zipf_vocabulary(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    counted = token_count.count_tokens(docs.selectExpr("*", "'x' as n_tokens"), vocabulary)
    assert dict(counted.dtypes)["n_tokens"] != "string"
