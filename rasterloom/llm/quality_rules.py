"""Quality rules by a hashed n-gram log-likelihood ratio, native throughout.

Lower-cased words and word pairs of every whole text are hashed into 10,000 buckets. Two multinomials are counted over
them: one over all documents (the raw corpus), one over documents that are labelled good (the trusted target): all of those
up to `sample`, else about so many, chosen by a hash of their ids, which are broadcast. A document's score is the sum of
log(target / raw) over its n-grams divided by their number plus `prior`, which draws short texts towards 0. A document is
kept if it passes the base rules and its score reaches the threshold.

Counting is one pass with map-side combining into at most 10,000 rows, which are all that reaches the driver. They go
back as one literal array, so scoring and filtering are a scan without any shuffle.

Defined results: a null text has no words and fails the base rule; a text without n-grams scores 0; without labelled good
documents every score is 0; repeated rows and null ids are scored like any others; an empty table gives an empty table;
further columns are kept by `annotate` (its own columns replace any of the same name).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.text import SPACES, SPACE_RUN, bounded, words

BUCKETS = 10_000
THRESHOLD = -0.07
PRIOR = 10.0
#: Good documents that the target is counted over.
SAMPLE = 200_000
#: Symbols that the base rules count.
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_window_words(tokens: Column, width: int = 5) -> Column:
    """Words inside windows of `width` words that occur at least twice in the text, the first occurrence included."""

    def covered(windows: Column) -> Column:
        def flagged(order: Column) -> Column:
            def twin(x: Column, i: Column) -> Column:
                before = (i > 0) & (F.get(order, i - 1)["h"] == x["h"])
                return before | ((i < F.size(order) - 1) & (F.get(order, i + 1)["h"] == x["h"]))

            at = F.sort_array(F.transform(F.filter(order, twin), lambda x: x["i"]))
            step = lambda p: F.transform(p, lambda x, i: F.when(i < F.size(p) - 1, F.least(F.lit(width), F.get(p, i + 1) - x)).otherwise(F.lit(width)))
            return let(at, lambda p: F.aggregate(step(p), F.lit(0), lambda a, x: a + x))

        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, flagged))

    def windows(h: Column) -> Column:
        last = F.size(h) - width
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        return F.when(last < 1, F.lit(0)).otherwise(let(each, covered))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), windows).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    hashes = F.transform(lines, lambda x: F.xxhash64(x))
    return let(hashes, lambda h: F.size(h) - F.size(F.array_distinct(h))).cast("long")


def base_columns(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; words come from a column __words."""
    whole = F.coalesce(text, F.lit(""))
    # most texts have no symbol, which a search sees sooner than a translation
    symbols = F.when(whole.rlike(f"[{SYMBOLS}]"), F.char_length(whole) - F.char_length(F.translate(whole, SYMBOLS, ""))).otherwise(0)
    return {
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
        "n_symbols": symbols.cast("long"),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeated_window_words(F.col("__words")),
    }


def gram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of all lower-cased words and word pairs."""

    def both(h: Column) -> Column:
        one = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
        two = F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.pmod(F.xxhash64(F.get(h, i), F.get(h, i + 1)), F.lit(buckets)).cast("int"))
        return F.when(F.size(h) < 2, one).otherwise(F.concat(one, two))

    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACES))
    tokens = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))
    return let(F.transform(tokens, lambda w: F.xxhash64(w)), both)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, sample: int = SAMPLE) -> list[float]:
    """log(target / raw) by bucket. trusted: one column doc_id of the good documents; about `sample` of them are counted if there are more."""
    good = bounded(trusted.where("doc_id is not null").distinct(), sample).select(F.col("doc_id").alias("__id"), F.lit(1).alias("__good"))
    marked = docs.select("doc_id", "text").join(F.broadcast(good), F.col("doc_id") == F.col("__id"), "left")
    grams = marked.select(F.coalesce("__good", F.lit(0)).alias("good"), F.explode(gram_buckets(F.col("text"), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target")).collect()  # at most `buckets` rows
    raw, target = [0] * buckets, [0] * buckets
    for x in counts:
        raw[x["bucket"]], target[x["bucket"]] = x["raw"], x["target"]
    if not sum(target):
        return [0.0] * buckets
    shift = math.log(sum(raw) + buckets) - math.log(sum(target) + buckets)
    return [round(math.log(t + 1) - math.log(r + 1) + shift, 6) for t, r in zip(target, raw)]


def llr_score(text: Column, ratios: list[float], prior: float = PRIOR) -> Column:
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to a literal
    total = lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, b))
    return let(gram_buckets(text, len(ratios)), lambda g: total(g) / (F.size(g) + F.lit(prior)))


def annotate(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, prior: float = PRIOR, sample: int = SAMPLE) -> DataFrame:
    """docs with the base columns, base_failed, score and kept."""
    ratios = log_ratios(docs, trusted, buckets, sample)
    out = docs.withColumn("__words", words(F.col("text")))
    out = out.withColumns(base_columns(F.col("text")) | {"score": llr_score(F.col("text"), ratios, prior)}).drop("__words")
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))


def keep_good(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """The documents that pass; columns as in docs."""
    marked = annotate(docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text"), trusted, **options)
    return marked.where("kept").select("__row.*")
