"""Spelling forms against comparing all words."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import spelling as S

from .helpers import LOWER, documents


def is_letter(c):
    return "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ"


def plain_counts(rows, least_chars, every):
    out = Counter()
    for i, text in rows:
        for run in "".join(c if is_letter(c) else " " for c in text or "").split(" "):
            run = run.translate(LOWER)
            if run and every:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % every == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least_chars:
                out[run] += 1
    return out


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(a == b[:k] + b[k + 1:] for k in range(len(b)))


def plain(counts, least_n, ratio):
    words = {w: n for w, n in counts.items() if n >= least_n}
    form, near = {}, {}
    for w, n in words.items():
        near[w] = [x for x in words if one_apart(w, x)]
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()}


def got(df):
    return {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def misspelt(rng, w):
    k = rng.randrange(len(w))
    return rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("aeéxÿ") + w[k:], w[:k] + rng.choice("aeéxÿ") + w[k + 1:]])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = ["".join(rng.choice(["th", "er", "an", "re", "ón", "ß", "e", "a"]) for _ in range(rng.randrange(2, 8)))
            for _ in range(60)]
    out = []
    for i in range(150):
        words = [rng.choice(base[:20]) if rng.random() < 0.7 else rng.choice(base) for _ in range(60)]
        words = [misspelt(rng, w) if rng.random() < 0.08 else w for w in words]
        words = [misspelt(rng, w) if rng.random() < 0.02 and w else w for w in words]
        out.append((i, " ".join(w.title() if rng.random() < 0.1 else w + rng.choice(["", ".", "7"]) for w in words)))
    chain = "abcdefgh " * 2000 + "abcdefgx " * 200 + "abcdefxx " * 20 + "abcdexxx " * 2
    return out + [(900, chain), (901, "a" * 3000 + " " + "a" * 2999 + " " + "aaaaaaab " * 3 + "baaaaaaa " * 3),
                  (902, None), (903, ""), (904, "12 ?"), (3, out[3][1]), (None, out[5][1]), (905, "ÉCOLES× écoles× " * 3)]


@pytest.mark.parametrize("every", [None, 5])
@pytest.mark.parametrize("least_chars", [1, 7])
def test_equals_comparing_all_words(spark, rows, every, least_chars):
    df = S.spelling_forms(documents(spark, rows), least_chars=least_chars, least_n=2, ratio=10, slips_every=every)
    assert got(df) == plain(plain_counts(rows, least_chars, every), 2, 10)


def test_every_near_pair_shares_a_signature():
    rng = random.Random(2)
    for _ in range(400):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 14)))
        b = misspelt(rng, a)
        if a == b or not b:
            continue
        short, long = sorted((a, b), key=len)
        each = []
        for w, as_longer in ((short, False), (long, True)):
            x = S.Letters([w])
            sigs = {int(s[0]) for s in S.enumerated(x.cells(S.SAME_CELLS, S.SAME_SEGMENTS), x.n, 2, 0)}
            for g in range(S.GROWN_SEGMENTS):
                sums = x.cells(S.GROWN_CELLS, S.GROWN_SEGMENTS, g if as_longer else None)
                sigs |= {int(s[0]) for s in S.enumerated(sums, x.n - as_longer, 1, 1 + g)}
            each.append(sigs)
        assert each[0] & each[1], (a, b)


def test_letters_count_in_their_segment():
    x = S.Letters(["banana", "nabana", "ananab"])
    assert len({tuple(r) for r in x.cells(4, 3).tolist()}) == 3
    assert np.array_equal(x.n, [6, 6, 6])


def test_chain_counts_and_edges(spark, rows):
    df = S.spelling_forms(documents(spark, rows), slips_every=None)
    byword = {r["word"]: r for r in df.collect()}
    assert byword["abcdexxx"]["root"] == "abcdefgh" and byword["abcdexxx"]["form"] == "abcdefxx"
    clash = documents(spark, rows).selectExpr("*", "1 as n", "'x' as word", "2 as sig", "3 as root", "4 as id")
    assert got(S.spelling_forms(clash)) == got(df)
    assert S.spelling_forms(documents(spark, [])).count() == 0
    assert S.spelling_forms(documents(spark, [(1, None), (2, "")])).count() == 0
    with pytest.raises(ValueError):
        S.spelling_forms(clash, ratio=1)


def test_counts_are_passed_on_in_parts(spark, rows, monkeypatch):
    monkeypatch.setattr(S, "MOST_HELD", 10)
    df = S.word_counts(documents(spark, rows), least_chars=7)
    assert dict(df.collect()) == plain_counts(rows, 7, None)
