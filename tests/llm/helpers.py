"""Fixture texts with the awkward cases, and plain versions of the rules."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = text.translate(LOWER)
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def alnum(text):
    text = (text or "").translate(LOWER)
    return "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in text).split(" ") if text else []


def alnum_words(text):
    return [w for w in alnum(text) if w]


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def corpus(seed=0, n=60):
    """(doc_id, text) rows: prose, copies, near copies, shared passages, nulls,
    blanks, one word, a long text, repeated rows, a repeated and a null id."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(5, 160)) for _ in range(n)]
    passage = prose(rng, 45)
    out = []
    for i, t in enumerate(texts):
        if i % 7 == 3:
            t = texts[i - 1]
        elif i % 7 == 5:
            w = texts[i - 2].split(" ")
            for _ in range(max(1, len(w) // 25)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            t = " ".join(w)
        elif i % 11 == 4:
            t = t + " " + passage
        elif i % 11 == 8:
            t = passage + "\n" + t
        out.append((i, t))
    long = prose(rng, 6000, 4000)
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "one"), (n + 4, "One"), (n + 5, long),
            (n + 6, long + " end"), (n + 7, "É ñ 😀 ﬁn"), (n + 8, "same " * 80), (2, texts[2]), (2, texts[2]),
            (4, "another text with an id that is taken"), (None, "no id but words"), (None, None)]
    return out


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def components(rows, shingle, percent):
    """Per row: (set size, component's smallest id) by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = words(t, lower=True)
        sets.append({tuple(w[k:k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle
                    else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)].append(i)
    return [(len(sets[k]), (rows[k][0] if not sets[k] else min(least[root(k)], default=None)))
            for k in range(len(rows))]


def without_repeats(rows, window):
    """Per row: (words, removed words, kept words)."""
    each = [words(t) for _, t in rows]
    starts = Counter(tuple(w[k:k + window]) for w in each for k in range(len(w) - window + 1))
    out = []
    for w in each:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if starts[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        out.append((len(w), sum(gone), [x for x, g in zip(w, gone) if not g]))
    return out


def leaked(rows, items, shingle=5, percent=80):
    def shingles(text, k):
        w = alnum_words(text)
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}

    found = []
    for item_id, item in items:
        k = min(shingle, len(alnum_words(item)))
        want = shingles(item, k) if k else set()
        for doc_id, text in rows:
            shared = len(want & shingles(text, k)) if want else 0
            if want and 100 * shared >= percent * len(want):
                found.append((doc_id, item_id, shared, len(want)))
    return Counter(found)
