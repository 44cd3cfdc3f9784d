"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Features are counts over the whole text.  The labelled documents of a stratum are
split in two by a hash of their ids.  The tuning half puts the (rule, cutoff) pairs
that reject bad documents in an order: those that reject the fewest good ones first.
The rejection sets of the first 1, 2, 3, ... pairs are nested, and each is tested on
the other half, the holdout: that it falsely rejects more than ``alpha`` of the good
documents is refuted where the exact binomial tail is at most ``delta`` divided by
the number of strata (Bonferroni).  The order does not depend on the holdout and the
tests stop at the first that fails (fixed-sequence testing), so they need no further
correction: with probability ``1 - delta`` at least, the rules of every stratum,
taken together, falsely reject at most ``alpha`` of its good documents.  Of the sets
that pass, the one is taken that rejects most bad documents net of good ones, the
smallest of equals; where none passes, only the base rules reject.

The guarantee holds for documents drawn like the labelled ones that pass the base rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm import storage

# Fixed values of the task: white space, symbols, and the base rules' limits.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

# Reject above a cutoff: feature -> grid.
GRIDS = {
    "symbol_ratio": [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3],
    "bang_ratio": [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3],
    "upper_ratio": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8],
    "dup_line_ratio": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8],
    "repeat_ratio": [0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4, 0.45],
}
FEATURES = "__quality"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that the text has twice or more.

    Windows are sorted with their places, by a hash and then by their words, so the
    cost is n log n in the words of one text and equal hashes do no harm."""
    window = lambda w: F.transform(
        F.sequence(F.lit(1), F.size(w) - 2),
        lambda i: F.struct(F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("h"), F.get(w, i - 1).alias("a"), F.get(w, i).alias("b"), F.get(w, i + 1).alias("c"), i.alias("p")),
    )
    equal = lambda x, y: (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    twice = lambda s: F.filter(
        s, lambda x, i: F.coalesce((i > 0) & equal(F.get(s, i - 1), x), F.lit(False)) | F.coalesce(equal(F.get(s, i + 1), x), F.lit(False))
    )
    covered = lambda s: F.aggregate(
        F.sort_array(F.transform(twice(s), lambda x: x["p"])),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return _let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(_let(F.sort_array(window(w)), covered)))


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column FEATURES; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(F.translate(text, SPACE[1:], " " * (len(SPACE) - 1)), " "), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    counts = _let(
        F.struct(words.alias("w"), lines.alias("l")),
        lambda x: F.struct(
            F.size(x["w"]).cast("long").alias("n_words"),
            F.size(x["l"]).cast("long").alias("n_lines"),
            (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
            _repeat_words(x["w"]).cast("long").alias("n_repeat_words"),
        ),
    )
    chars = F.struct(
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        without("!").cast("long").alias("n_bangs"),
        without(UPPER).cast("long").alias("n_upper"),
        F.coalesce(F.col("lang"), F.lit("")).alias("stratum"),
    )
    return docs.withColumn(FEATURES, F.struct(counts.alias("count"), chars.alias("char")))


def _feature(name: str) -> Column:
    count, char = F.col(FEATURES)["count"], F.col(FEATURES)["char"]
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {
        "symbol_ratio": ratio(char["n_symbols"], char["word_chars"]),
        "bang_ratio": ratio(char["n_bangs"], char["word_chars"]),
        "upper_ratio": ratio(char["n_upper"], char["word_chars"]),
        "dup_line_ratio": ratio(count["n_dup_lines"], count["n_lines"]),
        "repeat_ratio": ratio(count["n_repeat_words"], count["n_words"]),
    }[name]


def base_failed() -> Column:
    count = F.col(FEATURES)["count"]
    return (count["n_words"] < MIN_WORDS) | (100 * count["n_repeat_words"] > MAX_REPEAT_PERCENT * count["n_words"])


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact; 1 where k is not below the mean, which never passes."""
    step = lambda i: F.ln((n - i + 1) / i) + F.ln(F.lit(p)) - F.ln(F.lit(1 - p))
    first = n * F.ln(F.lit(1 - p))
    total = F.aggregate(
        F.sequence(F.lit(1).cast("long"), k),
        F.struct(first.alias("log"), F.exp(first).alias("sum")),
        lambda a, i: F.struct((a["log"] + step(i)).alias("log"), (a["sum"] + F.exp(a["log"] + step(i))).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(k >= n * p, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(total)


def labelled(featured: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, values (in the order of GRIDS), good and tuning of every labelled row that passes the base rules.

    All labelled rows count; a document with several labels is good if all are 1."""
    label = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    narrow = featured.where(~base_failed()).select("doc_id", F.col(FEATURES)["char"]["stratum"].alias("stratum"), F.array(*map(_feature, GRIDS)).alias("values"))
    tuning = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8"
    return narrow.join(label, "doc_id").where("quality IN (0, 1)").select("stratum", "values", (F.col("quality") == 1).alias("good"), tuning.alias("tuning"))


def thresholds(rows: DataFrame, alpha: float, delta: float) -> DataFrame:
    """One row for each stratum in ``rows`` (see :func:`labelled`): stratum and a cutoff (or null) for each rule."""
    pairs = [(i, float(c)) for i, grid in enumerate(GRIDS.values()) for c in grid]
    good, bad = F.col("good"), ~F.col("good")
    number = lambda when: F.count(F.when(when, 1))
    above = [F.get("values", F.lit(i)) > c for i, c in pairs]
    steps = F.array(*[F.struct(number(good & x).alias("k"), (-number(bad & x)).alias("miss"), F.lit(i).alias("rule"), F.lit(c).alias("cutoff")) for x, (i, c) in zip(above, pairs)])
    tuned = rows.where("tuning").groupBy("stratum").agg(steps.alias("steps")).withColumn("steps", F.sort_array(F.filter("steps", lambda s: s["miss"] < 0)))
    tuned = storage.table(tuned, "tuned-steps")
    # the first step that rejects a row; 0 where none does
    at = F.array_position(F.transform("steps", lambda s: F.get("values", s["rule"]) > s["cutoff"]), True)
    held = storage.join_small(rows.where(~F.col("tuning")), tuned, ["stratum"], "inner").withColumn("at", at)
    upto = lambda which: F.array(*[number(which & F.col("at").between(1, i)) for i in range(1, len(pairs) + 1)])
    counts = held.groupBy("stratum").agg(number(good).alias("n"), upto(good).alias("k"), upto(bad).alias("hits"))
    strata = max(1, tuned.count())
    each = F.transform(F.sequence(F.lit(1), F.size("steps")), lambda i: F.struct((F.element_at("hits", i) - F.element_at("k", i)).alias("net"), (-i).alias("i"), F.element_at("k", i).alias("k")))
    # k never falls from step to step, so the tests that pass are the first ones
    passed = F.filter(F.when(F.size("steps") > 0, each), lambda s: (s["net"] > 0) & (binomial_tail(s["k"], F.col("n"), alpha) <= delta / strata))
    best = counts.join(tuned, "stratum").withColumn("taken", F.slice("steps", F.lit(1), F.coalesce(-F.array_max(passed)["i"], F.lit(0))))
    cutoff = lambda i: F.array_min(F.transform(F.filter("taken", lambda s: s["rule"] == i), lambda s: s["cutoff"]))
    return best.select("stratum", *[cutoff(i).alias(r) for i, r in enumerate(GRIDS)])


def judge(featured: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """``featured`` with columns ``base_failed`` and ``kept``; it is read twice, so let it be a table."""
    cut = storage.table(thresholds(storage.table(labelled(featured, labels), "labelled"), alpha, delta), "thresholds")
    cut = cut.select(F.col("stratum").alias("__stratum"), F.struct(*GRIDS).alias("__cut"))
    out = featured.withColumn("__stratum", F.col(FEATURES)["char"]["stratum"])
    out = storage.join_small(out, cut, ["__stratum"], "left")
    rejected = reduce(lambda a, b: a | b, [F.coalesce(_feature(r) > F.col("__cut")[r], F.lit(False)) for r in GRIDS])
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected).drop("__stratum", "__cut")


def quality(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row of ``docs`` (doc_id, text, lang).

    A null or empty text has no words and fails; a null language is a stratum of its
    own; with no labels only the base rules reject.  Repeated rows and rows that share an
    id are judged one by one, and all count if the id is labelled.  Texts are counted
    whole.  An empty table gives no rows; other columns are not read, whatever their names."""
    featured = storage.table(with_features(docs.select("doc_id", "text", "lang")).drop("text", "lang"), "quality")
    count, char = F.col(FEATURES)["count"], F.col(FEATURES)["char"]
    return judge(featured, labels, alpha, delta).select(
        "doc_id", count["n_words"].alias("n_words"), char["word_chars"].alias("word_chars"), char["n_symbols"].alias("n_symbols"), count["n_dup_lines"].alias("n_dup_lines"), count["n_repeat_words"].alias("n_repeat_words"), "base_failed", "kept"
    )


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns, as :func:`quality` judges them.

    Other columns pass as they are, whatever their names and types."""
    own = ("doc_id", "text", "lang")
    held = storage.narrowed(docs, *own)
    good = judge(storage.table(with_features(held), "quality"), labels, alpha, delta).where("kept")
    return storage.widened(good, docs.columns, *own)
