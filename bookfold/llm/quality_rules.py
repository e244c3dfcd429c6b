"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a document whose metric is over a cutoff. All rules together reject at most a share ``risk`` of a
stratum's good documents, in every stratum at once, with confidence 1 - ``delta``: each rule gets an equal part of the
risk (what several rules reject is at most the sum). Per stratum and rule, cutoffs are tried from the loosest to the
strictest on the labelled good documents, as long as an exact binomial (Clopper-Pearson) bound shows a false-rejection
rate of at most risk / rules: the chance of as few rejections as were seen, were that the rate, must not exceed
delta / (rules x strata). The order within a rule is fixed
beforehand, so no further correction is due there; over rules and strata it is Bonferroni's. A stratum with
too few labels to show it keeps every cutoff at infinity: its rule rejects nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

WINDOW = 8
#: False rejections of a stratum's good documents, all rules together.
RISK = 0.025
#: Rules and their cutoffs, loosest first.
CUTOFFS: dict[str, list[float]] = {
    "symbols_per_word": [3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05],
    "dup_lines_per_line": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "repeats_per_word": [0.29, 0.25, 0.2, 0.15, 0.1, 0.05],
    "chars_per_word": [100.0, 50.0, 25.0, 16.0, 12.0, 10.0, 9.0, 8.0],
    "words_per_char": [0.9, 0.7, 0.5, 0.4, 0.35, 0.3],
}


def window_hashes(words: Column, window: int = WINDOW) -> Column:
    """64-bit hashes of the windows of an array of words (by element, as ``slice`` copies its whole input)."""
    n = F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(window)]))
    return F.when(n >= window, hashes).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column, window: int) -> Column:
    """How many words are in windows whose hash occurs twice or more."""
    ordered = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def count(s: Column) -> Column:
        at = F.transform(s, lambda v, k: F.when((F.get(s, k - 1)["x"] == v["x"]) | (F.get(s, k + 1)["x"] == v["x"]), v["i"]))
        return F.sort_array(F.filter(at, lambda i: i.isNotNull()))

    places = F.get(F.transform(F.array(ordered), count), F.lit(0))
    return F.get(F.transform(F.array(places), lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(window), b - a)), F.lit(0), lambda a, b: a + b)), F.lit(0))


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str | None = "lang") -> DataFrame:
    """``doc_id, stratum`` and the counts of each text; null texts have no words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), (F.col(stratum).cast("string") if stratum else F.lit(None).cast("string")).alias("stratum"), text.alias("text"))
    split = base.select(
        "doc_id",
        "stratum",
        F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "").alias("words"),
        (F.size(F.split("text", "[#*$%&|<>]", -1)) - 1).alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    counted = split.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        window_hashes(F.col("words")).alias("hashes"),
    )
    again = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), _covered(F.col("hashes"), WINDOW)).otherwise(0)
    return counted.withColumn("n_repeat_words", again.cast("long")).drop("hashes")


def _ratio(name: str) -> Column:
    top, bottom = {
        "symbols_per_word": ("n_symbols", "n_words"),
        "dup_lines_per_line": ("n_dup_lines", "n_lines"),
        "repeats_per_word": ("n_repeat_words", "n_words"),
        "chars_per_word": ("word_chars", "n_words"),
        "words_per_char": ("n_words", "word_chars"),
    }[name]
    return F.coalesce(F.try_divide(F.col(top), F.col(bottom)), F.lit(0.0))


def _shown(rejected: Column, n: Column, risk: float, level: Column) -> Column:
    """Whether P(Binomial(n, risk) <= rejected) <= level, summed term by term from the logarithm of the first."""
    odds = risk / (1 - risk)
    start = F.struct((n * F.log1p(F.lit(-risk))).alias("log"), F.lit(0.0).cast("double").alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        step = F.when(i > 0, F.log((n - i + 1) / i * odds)).otherwise(0.0)
        return F.struct((acc["log"] + step).alias("log"), (acc["sum"] + F.exp(acc["log"] + step)).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(0), rejected.cast("int")), start, add, lambda acc: acc["sum"])
    return F.when((n > 0) & (rejected < n * risk), tail <= level).otherwise(False)


def thresholds(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", risk: float = RISK, delta: float = 0.05) -> DataFrame:
    """One row per stratum that has labelled good documents: its ``stratum, n_good`` and a cutoff per rule.

    A document is good if all its rows in ``labels`` say so. ``risk`` is that of all rules together."""
    says = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    good = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.min(says).alias("good")).where("good")
    # what the fixed rules reject isn't the thresholds' doing
    held = counts.join(good, F.col("doc_id") == F.col("k"), "left_semi").where(~base_failed())
    seen = [F.array(*[F.sum((_ratio(r) > c).cast("long")) for c in cuts]).alias(f"{r}_rejected") for r, cuts in CUTOFFS.items()]
    per = held.groupBy("stratum").agg(F.count("*").alias("n_good"), *seen)
    strata = per.agg(F.count("*").alias("strata"))
    level = F.lit(delta) / (F.col("strata") * len(CUTOFFS))
    out = per.crossJoin(F.broadcast(strata))  # one row
    chosen = []
    for r, cuts in CUTOFFS.items():
        passed = F.transform(f"{r}_rejected", lambda x: _shown(x, F.col("n_good"), risk / len(CUTOFFS), level))
        first_miss = F.array_position(passed, False)
        count = F.when(first_miss == 0, len(cuts)).otherwise(first_miss - 1).cast("int")
        chosen.append(F.coalesce(F.get(F.array(*map(F.lit, cuts)), count - 1), F.lit(float("inf"))).alias(r))
    return out.select("stratum", "n_good", *chosen)


def base_failed(least_words: int = 20, most_repeated: int = 30) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str | None = "lang", risk: float = RISK, delta: float = 0.05) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words``, the counts, ``base_failed, kept`` and ``failed_rules``.

    Null texts have no words and fail the base; a null stratum is a stratum; rows with equal ids are judged
    each by itself; very long texts are counted whole; labels without a document (or with null ids) are ignored and
    ones with null marks say no; other columns are not read; an empty table gives no rows.
    """
    counts = materialize(metrics(docs, id_col, text_col, stratum))
    cut = thresholds(counts, labels, id_col, risk, delta).withColumnRenamed("stratum", "s")
    judged = counts.join(cut, F.col("stratum").eqNullSafe(F.col("s")), "left")
    failed = F.filter(F.array(*[F.when(_ratio(r) > F.col(r), F.lit(r)) for r in CUTOFFS]), lambda x: x.isNotNull())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & (F.size(failed) == 0)).alias("kept"), F.array_join(failed, ",").alias("failed_rules"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
