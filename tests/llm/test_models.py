"""Tokenizers by exact comparison, models by held-out accuracy."""

from __future__ import annotations

import random
import re
from pathlib import Path
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from tallyspark.llm import bpe, langid, quality_model, queries, token_count
from tallyspark.llm.batches import give_back
from tests.llm.helpers import corpus, documents

SF = "/root/testdata/sf0.01"
BPE = public_tokenizers.path(queries.BPE_FILE)
STRANGE = ["", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "\n\n  a\t b ", "é" * 300, "ab" * 3000,
           "՘࢏ a\x00b", "😀👨‍👩‍👧 " * 5, "don't WE'LL i'm 12 345", "   x", "𠀀𪚥", "ﬁ ｆｕｌｌ"]


def strange(n=300, seed=5):
    rng = random.Random(seed)
    pick = lambda: chr(rng.choice([rng.randint(32, 126), rng.randint(128, 0x24F), rng.randint(9, 13),
                                   rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)]))
    return STRANGE + ["".join(pick() for _ in range(rng.randint(1, 80))) for _ in range(n)]


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(BPE)
    rows = corpus(n=30) + [(1000 + k, t) for k, t in enumerate(strange())]
    got = bpe.decode(bpe.encode(documents(spark, rows).withColumn("ids", F.lit(1)), BPE), BPE).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)


def test_small_caches_and_latin_splits_change_no_id():
    """Two words a generation and two pairs: every word is asked again; Latin-1
    texts are split by a pattern of their own."""
    library, tight = Tokenizer.from_file(BPE), bpe.Encoder(BPE, cache=2, pairs=2)
    latin, whole = bpe.re.compile(bpe.LATIN_PATTERN).findall, bpe.regex.compile(bpe.PATTERN).findall
    rng = random.Random(9)
    texts = ["".join(chr(rng.choice([rng.randint(0, 255), 32, 32, 39, 115, 116, 101])) for _ in range(60)) for _ in range(400)]
    texts += [chr(c) + chr(d) for c in range(256) for d in range(256)]
    assert all(latin(t) == whole(t) for t in texts)
    for t in [*texts[:400], *strange(), "a" * 5000, "=-" * 700, "x" * 65 + " " + "x" * 65]:
        assert np.frombuffer(tight.ids(t), np.int32).tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(tight.words) <= 2 and len(tight.words.before) <= 2 and len(tight.pairs) <= 2


def test_a_worker_builds_its_tables_once_and_remembers_what_recurs():
    assert bpe.encoder_of(BPE) is bpe.encoder_of(BPE) and bpe.decoder_of(BPE) is bpe.decoder_of(BPE)
    asked = []
    known = bpe.Remembered(lambda k: asked.append(k) or k.upper(), 3)
    for k in ["often", "a", "b", "often", "c", "d", "often", "e", "f", "often", "g" * 65, "g" * 65]:
        assert known[k] == k.upper()
    assert asked.count("often") == 1 and asked.count("g" * 65) == 2


def test_a_worker_gives_freed_memory_back():
    def held_mb():
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    before = held_mb()
    blocks = [bytes(1000) for _ in range(200_000)]
    few = blocks[::200]  # so that the freed blocks are not the heap's end
    assert held_mb() > before + 150
    del blocks
    give_back()
    assert held_mb() < before + 50 and len(few) == 1000


def test_every_token_encodes_as_itself_and_decodes():
    encoder, decoder = bpe.Encoder(BPE), bpe.Decoder(BPE)
    assert all(encoder.word(b) == [k] for k, b in enumerate(encoder.v.bytes_of))
    assert decoder.bytes_of(np.array([-5, 10 ** 6, 50256])) == b"<|endoftext|>"


def test_bpe_of_null_ids_and_an_empty_table(spark):
    none = spark.createDataFrame([(1, None), (2, [None, 64])], "k long, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(none, BPE).orderBy("k").collect()] == ["", "a"]
    assert bpe.encode(documents(spark, []), BPE).count() == 0


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_counts_equal_the_library(spark, fallback):
    vocabulary = token_count.zipf_vocabulary(public_tokenizers.path(queries.UNIGRAM_FILE))
    library = Tokenizer(models.Unigram(vocabulary, 0, fallback))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rows = corpus(n=30) + [(1000 + k, t) for k, t in enumerate(strange() + ["<s><0x0A> <unk>", "  a  b "])]
    got = token_count.count_tokens(documents(spark, rows), vocabulary, byte_fallback=fallback)
    for r in got.collect():
        assert r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids), r["text"]


def test_unigram_ties_follow_the_library():
    rng = random.Random(8)
    for _ in range(40):  # few scores, so many paths tie
        pieces = {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))): -float(rng.randint(1, 3))
                  for _ in range(12)}
        vocabulary = [("<unk>", 0.0), *pieces.items()]
        library = Tokenizer(models.Unigram(vocabulary, 0, False))
        library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        counter = token_count.Counter(vocabulary, byte_fallback=False)
        for _ in range(30):
            text = "".join(rng.choice("aabbc ") for _ in range(rng.randint(0, 14)))
            assert counter.text(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_language_of_held_out_documents(spark):
    langs = {r["doc_id"]: r["lang"] for r in queries.read(spark, SF, "documents").collect()}
    got = queries.op1_language_id(spark, SF).collect()
    assert len(got) == len(langs)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en", None, 0), (2, "der Hund und die Katze", "de", None, 0),
            (3, None, "fr", None, 0), (4, "le chat", None, None, 0), (5, "the mouse", "en", None, 0)]
    schema = documents(spark, []).schema
    model = langid.train(spark.createDataFrame(rows, schema))
    assert sorted(model.languages) == ["de", "en"]
    texts = [(1, None), (2, ""), (3, "123 !!"), (4, "ქართული"), (5, "und der"), (6, "the dog " * 200_000), (None, "the")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(
        documents(spark, texts).withColumn("score", F.lit("x")), model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4] == ("en", 0.0) and got[5][0] == "de" and got[6][0] == "en" and got[None][0] == "en"
    nothing = langid.train(documents(spark, texts))
    assert [r["lang_pred"] for r in langid.predict(documents(spark, [(1, "the")]), nothing).collect()] == ["und"]


def test_more_languages_than_a_word_has_bits(spark):
    rng = random.Random(6)
    say = [[chr(0x4E00 + 20 * k + rng.randrange(20)) * 2 + chr(0x4E00 + 20 * k) for _ in range(6)] for k in range(150)]
    rows = [(300 * k + n, " ".join(say[k]), f"l{k:03}", None, 0) for k in range(150) for n in range(1 + k % 2)]
    model = langid.train(spark.createDataFrame(rows, documents(spark, []).schema))
    assert len(model.languages) == 150
    got = langid.predict(documents(spark, [(k, " ".join(say[k][:3])) for k in range(150)]), model).collect()
    assert all(r["lang_pred"] == f"l{r['doc_id']:03}" for r in got) and len(got) == 150


def test_blocks_of_languages_decide_like_one_filter(spark):
    rng = random.Random(7)
    say = [[chr(0x61 + rng.randrange(26)) + chr(0x61 + (3 * k + rng.randrange(9)) % 26) * 2 + chr(0xE0 + k) * (k % 2)
            for _ in range(12)] for k in range(23)]
    rows = [(100 * k + n, " ".join(say[k]), f"l{k:02}", None, 0) for k in range(23) for n in range(1 + k % 3)]
    labelled = spark.createDataFrame(rows, documents(spark, []).schema)
    texts = [(k, " ".join(rng.sample(say[k % 23], 5) + say[(k * 5) % 23][:2])) for k in range(200)]
    docs = documents(spark, [*texts, (1, None), (2, ""), (3, "12"), (4, "\u10e5")]).selectExpr(
        "*", "'x' as score", "1 as language", "2 as total", "3 as c0")
    one = langid.predict(docs, langid.train(labelled))
    for block in (1, 4, 10, 22):
        some = list(langid.filters(labelled, block=block))
        assert sum(len(f.languages) for f in some) == 23 and len(some) > 1
        got = langid.predict(docs, iter(some))
        assert got.columns == one.columns
        key = lambda r: (r["doc_id"], r["text"] or "")
        for a, b in zip(sorted(one.collect(), key=key), sorted(got.collect(), key=key), strict=True):
            assert a["score"] == pytest.approx(b["score"])
            assert a.asDict() | {"score": 0} == b.asDict() | {"score": 0}
    assert [f.languages for f in langid.filters(labelled.limit(0), block=4)] == [[]]


def test_filter_masks_and_chance():
    rng = np.random.default_rng(1)
    grams = {bit: rng.integers(-2 ** 63, 2 ** 63, 3000).tolist() for bit in range(20)}
    model = langid.Filter([f"l{k:02}" for k in range(20)], [1] * 20, grams, slots=1 << 14)
    for bit, h in grams.items():
        assert model.counts(np.array(h, np.int64).view(np.uint64))[bit] == len(h)
    other = model.counts(rng.integers(0, 2 ** 64, 200_000, dtype=np.uint64)) / 200_000
    assert np.allclose(other, model.chance, rtol=0.1)


def test_quality_of_held_out_documents(spark):
    label = {r["doc_id"]: r["quality"] for r in queries.read(spark, SF, "labels").collect()}
    got = queries.op3_quality_model(spark, SF).collect()
    assert len(got) == queries.read(spark, SF, "documents").count()
    held = [r for r in got if r["held_out"] and r["doc_id"] in label]
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == label[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_quality_edge_cases(spark):
    docs = documents(spark, corpus(n=20))
    none = quality_model.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality_model.score(docs.withColumn("score", F.lit(1)), none).collect()} == {0.5}
    one = quality_model.train(docs, spark.createDataFrame([(k, 1) for k in range(20)] + [(None, 0), (3, None)],
                                                          "doc_id long, quality int"))
    assert all(r["score"] > 0.9 for r in quality_model.score(docs, one).collect())
    assert quality_model.score(documents(spark, []), one).count() == 0


def test_pairs_are_learnt():
    rng = np.random.default_rng(2)
    x = np.zeros((4000, len(quality_model.FEATURES)))
    x[:, :3] = rng.random((4000, 3))
    y = ((x[:, 0] > .5) ^ (x[:, 1] > .5)).astype(float)
    model = quality_model.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) >= .5) == y[3000:]).mean() > 0.9


def test_slices_are_small_and_a_task_ends_once(spark, tmp_path):
    """What a worker holds at once is bounded by ``most_bytes``; ``end`` runs
    when the task has no more; a forgetful encoder gives the same ids."""
    from pyspark.sql import types as T
    from tallyspark.llm.batches import with_arrow_columns
    ended = str(tmp_path / "ended")
    make = lambda: lambda batch: [bpe.pa.array([batch.num_rows] * batch.num_rows, bpe.pa.int32())]

    def end():
        with open(ended, "a") as f:
            f.write("x")

    docs = documents(spark, [(k, "a" * 1000) for k in range(20)]).coalesce(1)
    got = with_arrow_columns(docs, [T.StructField("rows", T.IntegerType())], "text", make, most_bytes=2500, end=end)
    assert {r["rows"] for r in got.collect()} == {2} and open(ended).read() == "x"
    encoder = bpe.Encoder(BPE)
    before = encoder.ids("zqxj wvut zqxj")
    encoder.forget()
    assert not encoder.words and not encoder.words.before and not encoder.pairs
    assert encoder.ids("zqxj wvut zqxj") == before
