"""Quality rules with adaptive thresholds from mergeable quantile sketches (operator 1), native.

Each measure of a document is an expression over its arrays of words and lines. Documents that pass the fixed base
rules feed one quantile sketch a measure for every (language, source), language, and all: Spark's percentile_approx is
a Greenwald-Khanna summary that is merged map side, so a hot source costs one small summary a task. A fence stands
beyond an upper quantile by a multiple of the distance to a lower one: quartiles where junk stands far out, the last
percentiles where most documents have none at all. ``LEAST`` is only the resolution of a measure, far below its
spread. A group's fences are drawn toward those of its language, and these toward those of all, by the weight of
``PRIOR_ROWS`` documents, so there is no size at which a group's thresholds change. Documents are then joined with the
fences of their group and filtered. The threshold table is broadcast only where it is small.

Defined results: a null or empty text has no words and fails the base rules. Null languages and sources are groups of
their own. A text of any length is measured whole. Repeated rows are judged alike. An empty table gives an empty
result. In ``filtered`` all columns of the documents pass through; a column of theirs must not begin with ``__q_``, the prefix of
its own (that is an error and not a silent change).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import boxed, cut, stored, unboxed

#: White space that separates words, as characters and as a regular expression class.
BLANKS = " \t\n\x0b\x0c\r"
BLANK = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Sketch accuracy: the rank error is one part in this many.
ACCURACY = 10_000
#: Documents that the group above weighs when fences are drawn toward it.
PRIOR_ROWS = 50
QUANTILES = [0.25, 0.75, 0.95, 0.99]
#: Measure -> (places of the lower and the upper quantile, distances that the fence stands beyond the upper one, the
#: least distance, whether there is a fence below the lower one too).
RULES = {
    "symbols": (0, 1, 4.0, 0.005, False),
    "repeats": (2, 3, 1.0, 0.01, False),
    "dup_lines": (2, 3, 1.0, 0.01, False),
    "word_length": (0, 1, 4.0, 0.25, True),
}
#: Groups up to which thresholds are broadcast (some 100 bytes each).
BROADCAST_GROUPS = 50_000


def after(values: Column, k: int) -> Column:
    """An array without its first ``k`` elements."""
    return F.slice(values, k + 1, F.greatest(F.size(values) - k, F.lit(0)))


def repeat_positions(rows: DataFrame, keep: list[str], windows: str, out: str) -> DataFrame:
    """Sorted places of the windows (hashes) that occur twice or more: neighbours in sorted order are equal."""
    rows = rows.select(*keep, F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i")))).alias(windows))
    placed = F.col(windows)
    same = F.zip_with(placed, after(placed, 1), lambda a, b: F.coalesce(a["x"] == b["x"], F.lit(False)))
    rows = rows.select(*keep, windows, same.alias("__q_same"))
    same = F.col("__q_same")
    either = F.zip_with(same, F.concat(F.array(F.lit(False)), same), lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))
    # ``either`` has one element more than ``placed``; the pair with no place drops out with the null.
    return rows.select(*keep, F.sort_array(F.array_compact(F.zip_with(either, placed, lambda e, p: F.when(e, p["i"])))).alias(out))


def covered(places: Column, width: int) -> Column:
    """Words that windows of ``width`` at sorted places cover."""
    gaps = F.zip_with(places, after(places, 1), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)


def measured(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all of them by default) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.

    Arrays are built in steps that hand them on as columns: an expression that a lambda uses must not be worked out
    for every element.
    """
    keep = docs.columns if keep is None else keep
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANK}]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    q = "__q_"
    step = docs.select(*keep, words.alias(q + "words"), lines.alias(q + "lines"), (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias(q + "n_symbols"))
    hashes = F.transform(q + "words", lambda w: F.xxhash64(w))
    step = step.select(
        *keep,
        F.size(q + "words").cast("long").alias(q + "n_words"),
        F.length(F.array_join(q + "words", "")).cast("long").alias(q + "word_chars"),
        q + "n_symbols",
        F.size(q + "lines").cast("long").alias(q + "n_lines"),
        (F.size(q + "lines") - F.size(F.array_distinct(q + "lines"))).cast("long").alias(q + "n_dup_lines"),
        hashes.alias(q + "h"),
    )
    pairs = F.zip_with(F.col(q + "h"), after(F.col(q + "h"), 1), lambda a, b: F.xxhash64(a, b))
    rest = [q + "n_words", q + "word_chars", q + "n_symbols", q + "n_lines", q + "n_dup_lines"]
    step = step.select(*keep, *rest, q + "h", pairs.alias(q + "p"))
    fours = F.zip_with(F.col(q + "p"), after(F.col(q + "p"), 2), lambda a, b: F.xxhash64(a, b))
    step = step.select(*keep, *rest, q + "h", fours.alias(q + "p"))
    fives = F.slice(F.zip_with(F.col(q + "p"), after(F.col(q + "h"), WINDOW - 1), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(q + "h") - WINDOW + 1, F.lit(0)))
    step = step.select(*keep, *rest, fives.alias(q + "w"))
    # Only texts with a repeated window are sorted; the others hand on an empty array.
    some = F.when(F.size(F.array_distinct(q + "w")) < F.size(q + "w"), F.col(q + "w")).otherwise(F.array().cast("array<bigint>"))
    step = repeat_positions(step.select(*keep, *rest, some.alias(q + "w")), [*keep, *rest], q + "w", q + "at")
    # A column that is not deterministic keeps filters above this step: pushed down, they would repeat it many times over.
    fence = F.when(F.monotonically_increasing_id() >= 0, F.col(q + "n_words")).alias(q + "n_words")
    return step.select(*keep, fence, *rest[1:], covered(F.col(q + "at"), WINDOW).alias(q + "n_repeat_words"))


def with_rates(rows: DataFrame) -> DataFrame:
    """Base verdict and the measures that the rules compare."""
    rate = lambda a, b: F.col(f"__q_{a}").cast("double") / F.greatest(F.col(f"__q_{b}"), F.lit(1)).cast("double")
    return rows.withColumns({
        "__q_base_failed": (F.col("__q_n_words") < LEAST_WORDS) | (100 * F.col("__q_n_repeat_words") > MOST_REPEATED * F.col("__q_n_words")),
        "__q_symbols": rate("n_symbols", "word_chars"),
        "__q_repeats": rate("n_repeat_words", "n_words"),
        "__q_dup_lines": rate("n_dup_lines", "n_lines"),
        "__q_word_length": rate("word_chars", "n_words"),
    })


def drawn(own: Column, toward: Column, n: Column) -> Column:
    """A fence drawn toward that of the group above."""
    return own + (toward - own) * (PRIOR_ROWS / (n + F.lit(PRIOR_ROWS)))


def thresholds(rows: DataFrame) -> DataFrame:
    """One row for each (lang, source): the fences high_* and low_* of the rules."""
    passed = rows.where("not __q_base_failed").select("lang", "source", *[f"__q_{m}" for m in RULES])
    sketches = [F.percentile_approx(f"__q_{m}", QUANTILES, ACCURACY).alias(m) for m in RULES]
    groups = cut(passed.rollup("lang", "source").agg(F.grouping_id().alias("above"), F.count("*").alias("n"), *sketches))
    fences = {}
    for m, (low, high, reach, least, below) in RULES.items():
        scale = reach * F.greatest(F.col(m)[high] - F.col(m)[low], F.lit(least))
        fences[f"high_{m}"] = F.col(m)[high] + scale
        if below:
            fences[f"low_{m}"] = F.col(m)[low] - scale
    at = lambda level, *names: groups.where(F.col("above") == level).select(*names, "n", *[c.alias(k) for k, c in fences.items()])
    every = at(3).drop("n").first()  # one row
    if every is None:
        return at(0, F.col("lang").alias("__t_lang"), F.col("source").alias("__t_source")).drop("n").withColumnsRenamed({k: f"__t_{k}" for k in fences})
    by_lang = at(1, "lang").select(F.col("lang").alias("__t_lang"), *[drawn(F.col(k), F.lit(every[k]), F.col("n")).alias(f"above_{k}") for k in fences])
    own = at(0, "lang", "source")
    joined = own.join(broadcast_few(by_lang), own["lang"].eqNullSafe(by_lang["__t_lang"]))
    return joined.select("__t_lang", F.col("source").alias("__t_source"), *[drawn(F.col(k), F.col(f"above_{k}"), F.col("n")).alias(f"__t_{k}") for k in fences])


def broadcast_few(groups: DataFrame) -> DataFrame:
    """Thresholds are broadcast only up to a number of groups."""
    return F.broadcast(groups) if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else groups


def verdicts(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__q_kept``, by the thresholds that their own measures give."""
    limits = cut(thresholds(rows))
    joined = rows.join(broadcast_few(limits), rows["lang"].eqNullSafe(limits["__t_lang"]) & rows["source"].eqNullSafe(limits["__t_source"]), "left")
    fine = ~F.col("__q_base_failed")
    for m, (*_, below) in RULES.items():
        fine = fine & (F.col(f"__q_{m}") <= F.col(f"__t_high_{m}"))
        if below:
            fine = fine & (F.col(f"__q_{m}") >= F.col(f"__t_low_{m}"))
    # Documents without a threshold row are in groups where all fail the base rules.
    return joined.withColumn("__q_kept", F.coalesce(fine, F.lit(False))).drop(*limits.columns)


def judged(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per document: id, lang, source, the measures, base_failed and kept (all but the first three with prefix ``__q_``)."""
    return verdicts(cut(with_rates(measured(docs, [id_column, "lang", "source"]))))


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns only, whatever their names.

    Every text is measured once: documents and measures are written to the shared folder, where the table stays as
    checkpoints do; the sketches then read the narrow columns alone.
    """
    rows = boxed(docs, "lang", "source")
    return unboxed(verdicts(stored(with_rates(measured(rows)))).where("__q_kept"), docs.columns)
