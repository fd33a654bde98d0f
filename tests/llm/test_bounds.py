"""Samples and blocks that hold their bounds, models against plain versions,
and keys that are wide enough."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, html_extract, langid, near_dup, quality_model, substring_dup

from .helpers import corpus, documents, leaked, prose, without_repeats, words

EN, DE = "the dog and the cat are in the house with {}", "der hund und die katze sind im haus mit {}"


@pytest.mark.parametrize("shared_id", [None, 0, 5])
@pytest.mark.parametrize("same_text", [False, True])
def test_rows_of_one_id_do_not_lose_a_language(spark, shared_id, same_text):
    rows = [(shared_id, EN.format("" if same_text else k), "en") for k in range(3000)]
    rows += [(k, DE.format(k), "de") for k in range(50)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_rows=200)
    assert model.languages == ["en", "de"]
    letters = langid.Letters()
    assert model.decide("the dog and the cat", letters)[0] == "en"
    assert model.decide("der hund und die katze", letters)[0] == "de"


def test_language_decision_equals_plain_sets(spark):
    """``decide`` against exact sets of n-grams, counted by plain Python."""
    rng = random.Random(1)
    rows = [(k, (EN if k % 2 else DE).format(prose(rng, 4, 30)), "en" if k % 2 else "de") for k in range(200)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    def grams(text, n):
        padded = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        out = []
        for k in range(len(padded) - n + 1):
            g = padded[k:k + n]
            inner = g[1:-1] if n > 2 else ""
            if (inner and inner.replace(" ", "") == inner) or (n == 2 and g.strip()):
                out.append(g)
        return out

    counts = defaultdict(Counter)
    for _, text, lang in rows:
        for n in langid.NGRAMS:
            counts[lang, n].update(grams(text, n))
    kept, cover = defaultdict(set), Counter()
    for n in langid.NGRAMS:
        share = {lang: {g: c / sum(counts[lang, n].values()) for g, c in counts[lang, n].items()} for lang in ("en", "de")}
        for lang in share:
            for g, f in share[lang].items():
                if f >= langid.LEAST_FREQUENCY and f >= langid.LEAST_RATIO * max(share[x].get(g, 0) for x in share):
                    kept[lang].add(g)
                    cover[lang] += f / len(langid.NGRAMS)
    assert model.cover.tolist() == pytest.approx([max(cover[x], 1e-9) for x in model.languages])
    for text in ("the cat", "katze und hund", "zzz the haus", "DER Hund, the DOG!", EN, DE):
        hits = {x: sum(g in kept[x] for n in langid.NGRAMS for g in grams(text, n)) / cover[x] for x in kept}
        got, score = model.decide(text, langid.Letters())
        best = max(hits.values())
        assert hits[got] == pytest.approx(best, rel=.02) and score == pytest.approx(best / sum(hits.values()), abs=.02)


def test_labelled_rows_are_bounded(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(7, prose(rng, 30)) for _ in range(2000)] + [(k, prose(rng, 30)) for k in range(20)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] * 50 + [(7, 0), (None, 1)] + [(k, k % 2) for k in range(20)],
                                   "doc_id long, quality int")
    seen = []
    real = quality_model.fit
    quality_model.fit = lambda x, y: seen.append((len(x), set(y.tolist()))) or real(x, y)
    try:
        quality_model.train(docs, labels, train_rows=100)
        quality_model.train(docs, labels.limit(0), train_rows=100)
    finally:
        quality_model.fit = real
    assert seen[0][0] == 100 and seen[1] == (0, set())


def plain_features(text):
    text = text or ""
    w = words(text)
    if not w:
        return [0.0] * len(quality_model.FEATURES)
    raw, n = text.encode(), len(w)
    windows = [tuple(w[k:k + 3]) for k in range(n - 2)]
    times = Counter(windows)
    covered = {k + i for k, x in enumerate(windows) if times[x] > 1 for i in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    per = {c: raw.count(c.encode()) / n for c in "#*$%&|<>{}[]\\^~_=+@"}
    return [np.log(1 + n), len(raw) / n, len(set(w)) / n, max(Counter(w).values()) / n, len(covered) / n,
            1 - len(set(lines)) / len(lines), n / len(lines), sum(per.values()), raw.count(b"!") / n,
            raw.count(b".") / n, sum(65 <= c <= 90 for c in raw) / len(raw), sum(48 <= c <= 57 for c in raw) / len(raw),
            sum(c > 127 for c in raw) / len(raw)]


def test_features_equal_plain_loops():
    texts = [t for _, t in corpus(seed=3, n=40)] + ["A b C a b C\nx\n\nx\n!!! 1.5 #@", "a b c a b c a b c", "É\u00a0é ß", "\x0b x",
                                                    "#*$%&|<>{}[]\\^~_=+@ . !"]
    got = quality_model.feature_matrix([None if t is None else t.encode() for t in texts])
    assert np.allclose(got, [plain_features(t) for t in texts])


def test_logit_is_the_sum_of_the_tables():
    rng = np.random.default_rng(3)
    x = rng.random((400, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > .8).astype(float)
    model = quality_model.fit(x, y)
    assert model.pairs

    def bin_of(edges, v):
        return sum(v > e for e in edges)

    for row in x[:60]:
        want = model.constant + sum(t[bin_of(e, v)] for e, t, v in zip(model.edges, model.tables, row))
        want += sum(t[bin_of(model.pair_edges[f], row[f]), bin_of(model.pair_edges[g], row[g])]
                    for (f, g), t in model.pairs.items())
        assert model.logit(row[None, :])[0] == pytest.approx(want)
    assert ((model.score(x) >= .5) == (y == 1)).mean() > .9


def test_equal_items_are_indexed_once(spark, monkeypatch):
    rng = random.Random(5)
    rows, passage = corpus(seed=2, n=30), prose(rng, 60)
    rows += [(500, "some words before " + passage), (501, passage)]
    items = [(k, passage) for k in range(300)] + [(1000 + k, prose(rng, 40)) for k in range(28)] + [(7, rows[3][1])]
    sizes = []
    real = decontaminate.share
    monkeypatch.setattr(decontaminate, "share", lambda s, index: sizes.append(len(index.ids)) or real(s, index))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(documents(spark, rows), table, block_words=400).select(
        "doc_id", "item_id", "n_shared", "n_item")
    assert Counter(map(tuple, got.collect())) == leaked(rows, items)
    assert sum(sizes) == 30 and max(sizes) < 12 and len(sizes) > 3


def test_each_size_class_has_its_own_index():
    rng = random.Random(8)
    index = decontaminate.ItemIndex([(str(n), prose(rng, n, 5000).encode()) for n in (3, 9, 20, 90, 400)], 5, 80)
    assert sorted(index.sketches) == [3, 5] and len(index.sketches[5]) == 4
    assert [len(values) for values, _ in index.sketches[5]] == sorted(len(values) for values, _ in index.sketches[5])


@pytest.mark.parametrize("kinds, flush", [(8, 3_000_000), (1, 3_000_000), (1 << 60, 60), (8, 2)])
def test_windows_whose_short_hashes_clash_stay_apart(spark, monkeypatch, kinds, flush):
    rows = corpus(seed=9, n=50)
    monkeypatch.setattr(substring_dup, "FLUSH", flush)
    real = substring_dup.Windows.first
    monkeypatch.setattr(substring_dup.Windows, "first", lambda self, w: real(self, w) % np.uint64(kinds))
    got = substring_dup.remove_repeats(documents(spark, rows), window=35)
    want = [(i, n, gone, " ".join(kept)) for (i, _), (n, gone, kept) in zip(rows, without_repeats(rows, 35))]
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], " ".join(words(r["kept_text"])))
                   for r in got.collect()) == Counter(want)


def test_only_outsiders_travel(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 50)
    m, k = 1000, 7
    rows = [(1, n, -1 if n >= k else n, 10) for n in range(m)] + [(2, n, -2, 10) for n in range(40)]
    dealt = near_dup.dealt_members(spark.createDataFrame(rows, "key long, node long, comp long, n int"))
    got = dealt.groupBy("key").agg(F.count("*").alias("rows"), F.countDistinct("block").alias("blocks"),
                                   F.count_if("home").alias("homes"), F.count_if("outside").alias("out")).collect()
    assert [(r["key"], r["rows"], r["blocks"], r["homes"], r["out"]) for r in got] == [
        (1, m + k * 19, 20, m, k * 20)]


@pytest.mark.parametrize("inside, text", [
    ('<header class="entry-header"><h1>Title</h1></header><p>x</p>', "Title\nx"),
    ('<header class="article-header"><h1>Title</h1></header><p>x</p>', "Title\nx"),
    ('<p class="notice-period">three months</p>', "three months"),
    ('<table class="search-stats"><tr><td>4</td></tr></table>', "4"),
    ('<div id="social-policy">text</div>', "text"),
    ('<div class="ad">buy</div><p>x</p><div class="box share">tweet</div>', "x"),
    ('<p role="alert">cookies</p><nav>menu</nav><p>x</p>', "x")])
def test_compound_classes_inside_an_article_stay(spark, inside, text):
    pages = spark.createDataFrame([(1, "http://h/1", f"<body><div class='site-header'>Site</div><article>{inside}"
                                                     "</article></body>")], "page_id long, url string, html string")
    assert [r["text"] for r in html_extract.extract(pages).collect()] == [text]
