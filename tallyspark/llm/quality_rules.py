"""Quality rules: a threshold table compiled into one projection of built-in
functions (no user functions, no shuffle).

Measures of a text (words are ``[^\\x20\\x09-\\x0D]+``):

* ``n_words``, ``word_chars`` (code points in words), ``n_symbols``
  (characters of ``#*$%&|<>``), ``n_dup_lines`` (lines with a word that equal
  an earlier line), ``n_repeat_words`` (words inside three-word windows that
  occur twice or more in the text);
* for the verdict also ``n_lines`` (lines with a word), ``n_stop_words``
  (words that are a function word of one of the languages served), and
  ``n_marks`` (exclamation marks).

``RULES`` names per rule a measure, what it is divided by, the smallest and
largest ratio that is fine, and the least number of words from which the rule
speaks.  ``verdict`` compiles the table into one boolean expression; each
failed rule can be listed with ``failed_rules``.

The repeat measure sorts one number per window (hash and place); neighbours
with equal hashes are compared word by word, so the count is exact.

Defined results: a null, empty or blank text has all measures 0 and fails
``n_words``; the whole text counts, however long; repeated rows are judged
alike, each by itself; extra columns pass through, and one called like a
measure is replaced.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
PLACE_BITS = 24

#: Frequent function words of English, German, French, Spanish.
STOP_WORDS = (
    "the of and to in is that for it as with on be at by this are from "
    "der die das und in zu den ist von mit nicht auf ein im dem "
    "le la les de des et un une en du que est pour dans au "
    "el la los las de y en un una que por con para del se"
).split()


class Rule(NamedTuple):
    name: str
    measure: str
    per: str | None
    least: float | None
    most: float | None
    from_words: int = 0


#: The table.  The first two rules are the fixed base; the others were set on
#: the two ends of the measures of clean prose and of junk, half way between.
RULES = (
    Rule("too_short", "n_words", None, 50, None),
    Rule("repeats_itself", "n_repeat_words", "n_words", None, 0.5),
    Rule("symbols", "n_symbols", "n_words", None, 0.2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("exclamations", "n_marks", "n_words", None, 0.5),
    Rule("short_words", "word_chars", "n_words", 2.0, None),
    Rule("long_words", "word_chars", "n_words", None, 20.0),
    Rule("few_stop_words", "n_stop_words", "n_words", 0.01, None, from_words=200),
)
BASE = ("too_short", "repeats_itself")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_stop_words", "n_marks")


def _count(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{chars}]")).cast("long")


def _with_repeat_words(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` from ``_qr_words``, with built-in functions only.

    Each window becomes one number: 40 bits of its hash above 24 bits of its
    place.  Sorted, windows with equal hashes stand side by side.  Neighbours
    with equal hashes are compared word by word; should two different windows
    share a hash, or a text be too long for 24 bits, the text takes the slower
    way that sorts the windows themselves.
    """
    w, n = "_qr_words", f"(size(_qr_words) - {WINDOW - 1})"
    at = lambda i: ", ".join(f"get({w}, {i} + {k})" for k in range(WINDOW))
    place = f"{(1 << PLACE_BITS) - 1}L"
    key = lambda x: f"shiftright({x}, {PLACE_BITS})"
    packed = (f"CASE WHEN {n} < 2 OR {n} >= {1 << PLACE_BITS} THEN CAST(array() AS ARRAY<BIGINT>) ELSE "
              f"sort_array(transform(slice({w}, 1, {n}), (x, i) -> "
              f"shiftleft(xxhash64({at('i')}), {PLACE_BITS}) | CAST(i AS BIGINT))) END")
    hits = (f"filter(_qr_packed, (x, j) -> {key('x')} = {key('get(_qr_packed, j - 1)')} "
            f"OR {key('x')} = {key('get(_qr_packed, j + 1)')})")
    spot = lambda x: f"CAST({x} & {place} AS INT)"
    clash = (f"exists(transform(_qr_hits, (x, j) -> {key('x')} = {key('get(_qr_hits, j - 1)')} AND "
             f"NOT struct({at(spot('x'))}) <=> struct({at(spot('get(_qr_hits, j - 1)'))})), x -> x)")
    covered = lambda starts: (
        f"aggregate(sort_array({starts}), struct(0 AS n, -{WINDOW} AS last), "
        f"(acc, i) -> struct(acc.n + least({WINDOW}, i - acc.last) AS n, i AS last), acc -> acc.n)")
    fast = covered(f"transform(_qr_hits, x -> {spot('x')})")
    ordered = f"array_sort(transform(slice({w}, 1, {n}), (x, i) -> struct(struct({at('i')}) AS s, i AS i)))"
    slow = (f"aggregate(array({ordered}), 0, (acc, all) -> acc + "
            + covered("transform(filter(all, (x, j) -> x.s <=> get(all, j - 1).s OR x.s <=> get(all, j + 1).s), "
                      "x -> x.i)") + ")")
    return (df.withColumn("_qr_packed", F.expr(packed))
            .withColumn("_qr_hits", F.expr(hits))
            .withColumn("n_repeat_words", F.expr(
                f"CAST(CASE WHEN {n} < 2 THEN 0 WHEN {n} >= {1 << PLACE_BITS} OR {clash} THEN {slow} "
                f"WHEN size(_qr_hits) = 0 THEN 0 ELSE {fast} END AS BIGINT)")))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``MEASURES``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    got = _with_repeat_words(docs.withColumns({"_qr_words": words, "_qr_lines": lines}))
    size = lambda c: F.size(c).cast("long")
    return got.withColumns({
        "n_words": size("_qr_words"),
        "word_chars": F.length(F.array_join("_qr_words", "")).cast("long"),
        "n_symbols": _count(text, SYMBOLS),
        "n_dup_lines": size("_qr_lines") - size(F.array_distinct("_qr_lines")),
        "n_lines": size("_qr_lines"),
        "n_stop_words": size(F.filter("_qr_words", lambda w: w.isin(sorted(set(STOP_WORDS))))),
        "n_marks": _count(text, "!"),
    }).drop("_qr_words", "_qr_lines", "_qr_packed", "_qr_hits")


def _fails(rule: Rule) -> Column:
    value = F.col(rule.measure)
    # Products, not quotients: no division by an empty text.
    per = F.lit(1) if rule.per is None else F.col(rule.per)
    tests = []
    if rule.least is not None:
        tests.append(value < F.lit(rule.least) * per)
    if rule.most is not None:
        tests.append(value > F.lit(rule.most) * per)
    failed = tests[0] if len(tests) == 1 else tests[0] | tests[1]
    return failed & (F.col("n_words") >= rule.from_words) if rule.from_words else failed


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the failed rules, in the table's order."""
    return F.filter(F.array(*[F.when(_fails(r), F.lit(r.name)) for r in rules]),
                    lambda x: x.isNotNull())


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True if no rule fails."""
    kept = F.lit(True)
    for rule in rules:
        kept = kept & ~_fails(rule)
    return kept


def apply_rules(docs: DataFrame, text_col: str = "text",
                rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``."""
    base = [r for r in rules if r.name in BASE]
    failed = F.lit(False)
    for rule in base:
        failed = failed | _fails(rule)
    return measure(docs, text_col).withColumns({"base_failed": failed, "kept": verdict(rules)})


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns.

    The verdict comes out of a generator, because a filter is not pushed
    through one: pushed down, each rule would carry the whole expression of
    its measures, written out and evaluated again.
    """
    rows = docs.select(F.struct("*").alias("_qr_row"), F.col(text_col).alias("text"))
    judged = apply_rules(rows, "text", rules).select(
        "_qr_row", F.explode(F.array("kept")).alias("_qr_kept"))
    return judged.where("_qr_kept").select("_qr_row.*")
