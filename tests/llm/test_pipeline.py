"""The corpus pipeline against plain Python, and the rules of its stages."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.helpers import SCHEMA, components, corpus, documents, leaked, without_repeats, words
from tests.llm.test_text_rules import measures


def plain_quality(rows):
    from tallyspark.llm.quality_rules import STOP_WORDS
    kept = []
    for i, t in rows:
        n, chars, symbols, dup, repeat = measures(t)
        lines = len([x for x in (t or "").split("\n") if words(x)])
        stop = sum(w in STOP_WORDS for w in words(t))
        if not (n < 50 or repeat > .5 * n or symbols > .2 * n or dup > .5 * lines or (t or "").count("!") > .5 * n
                or chars < 2 * n or chars > 20 * n or n >= 200 and stop < .01 * n):
            kept.append((i, t))
    return kept


def plain_dedup(rows):
    best = {}
    for (i, t), (n, c) in zip(rows, components(rows, 5, 80)):
        if i == c:
            best.setdefault(c, (i, t))
    return list(best.values())


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rows = [(i, None if t is None else " the of ".join(t.split(" ", 20))) for i, t in corpus(seed=6, n=90)
            if i is not None]
    items = [(1, " ".join(rows[1][1].split()[:40])), (2, "nowhere to be found at all in any text")]
    documents(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    want = plain_dedup(plain_quality(rows))
    cut = []
    for (i, t), (_, gone, kept) in zip(want, without_repeats(want, 35)):
        cut.append((i, " ".join(kept)))
    bad = {k[0] for k in leaked(cut, items)}
    want = {i: t for i, t in cut if i not in bad}
    assert {r["doc_id"]: " ".join(words(r["text"])) for r in got} == want and len(got) == len(want) > 20
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in got:
        assert r["ids"] == encode.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(r["ids"]) and r["n_chars"] == len(r["text"])


def test_the_last_stage_decodes_its_ids(spark):
    rows = [(1, "é ñ 😀 ﬁn\n two  blanks"), (2, ""), (3, None)]
    got = corpus_pipeline.STAGES[-1][1](spark, documents(spark, rows), "")
    assert {"ids", "n_tokens", "text"} < set(got.columns) and "_decoded" not in got.columns
    for r in got.collect():
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_the_last_stage_encodes_before_it_decodes(spark):
    """Two Arrow passes in one stage would hold two Python workers a core."""
    done = corpus_pipeline.STAGES[-1][1](spark, documents(spark, [(1, "a b"), (1, "a b"), (None, None)]), "")
    steps = re.findall(r"MapInArrow|Exchange", done._jdf.queryExecution().executedPlan().toString())
    assert steps == ["MapInArrow", "Exchange", "MapInArrow"]
    assert sorted(len(r["ids"]) for r in done.collect()) == [0, 2, 2]


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, corpus(n=20))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "minhash_dedup", "substring_dedup", "decontamination", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
