"""Quality rules by weak supervision (operator 3): DataFrame functions only.

Each rule looks at one figure of a text and votes good, bad or abstains. Expectation-maximisation over the pattern
counts of all rows estimates how far each rule can be trusted; a text is kept when the posterior probability that it
is good reaches ``MIN_POSTERIOR``, not when it passes every rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .weak import fit_votes, posterior

WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = "!\"#$%&()*+/:;<=>?@[]^_`{|}~"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN = 8                   # words in a window
MIN_POSTERIOR = 0.5

FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_capitals", "n_marks",
           "n_stops", "n_distinct"]


def _pairwise(a: str, shift: int, n: Column, f) -> Column:
    """f over elements ``shift`` apart, for the first ``n`` positions of array column ``a``."""
    n = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(F.col(a), F.lit(1), n), F.slice(F.col(a), F.lit(shift + 1), n), f)


def _char_count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def text_figures(docs: DataFrame, text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and every figure of the whole text (null: a text without words).

    Windows of RUN words are compared by a 64-bit hash built in three doubling steps (1, 2, 4, 8 words). Only texts
    with a window that occurs twice go on to sort their windows. Each step is a projection of its own, so no array is
    computed twice.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    names = [f"keep_{i}" for i in range(len(keep))]
    df = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], t.alias("t"))
    line = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(*names, F.array_remove(F.split("t", WHITE, -1), "").alias("words"), line.alias("lines"),
                   (F.length("t") - _char_count(F.col("t"), WHITE_CHARS)).alias("word_chars"),
                   _char_count(F.col("t"), SYMBOLS).alias("n_symbols"),
                   _char_count(F.col("t"), CAPITALS).alias("n_capitals"),
                   _char_count(F.col("t"), MARKS).alias("n_marks"),
                   _char_count(F.col("t"), ".!?").alias("n_stops"))
    counts = ["word_chars", "n_symbols", "n_capitals", "n_marks", "n_stops"]
    base = [*names, *counts, "n_words", "n_lines", "n_dup_lines", "n_distinct"]
    df = df.select(*names, *counts, F.size("words").alias("n_words"),
                   F.size("lines").alias("n_lines"),
                   (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
                   F.transform("words", lambda w: F.xxhash64(w)).alias("w1"))
    df = df.select(*base[:-1], F.size(F.array_distinct("w1")).alias("n_distinct"),
                   _pairwise("w1", 1, F.col("n_words") - 1, lambda a, b: F.xxhash64(a, b)).alias("w2"))
    df = df.select(*base, _pairwise("w2", 2, F.col("n_words") - 3, lambda a, b: F.xxhash64(a, b)).alias("w4"))
    df = df.select(*base, _pairwise("w4", 4, F.col("n_words") - (RUN - 1), lambda a, b: F.xxhash64(a, b)).alias("w8"))
    # (hash, position) sorted, only where a window repeats
    df = df.select(*base, F.when(F.size(F.array_distinct("w8")) < F.size("w8"), F.array_sort(
        F.transform("w8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    same = _pairwise("s", 1, F.size("s") - 1,
                     lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    df = df.select(*base, F.when(F.col("s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(same)))).alias("at"))
    gaps = _pairwise("at", 1, F.size("at") - 1, lambda a, b: F.least(F.lit(RUN), b - a))
    covered = F.aggregate(gaps, F.lit(RUN), lambda x, y: x + y)
    df = df.select(*base, F.when(F.col("at").isNotNull(), covered).otherwise(F.lit(0)).alias("n_repeat_words"))
    return df.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], *[F.col(c).cast("long") for c in FIGURES])


def _vote(bad: Column, good: Column | None = None) -> Column:
    v = F.when(bad, F.lit(-1))
    return (v if good is None else v.when(good, F.lit(1))).otherwise(F.lit(0))


def rule_votes() -> dict[str, Column]:
    """Votes on the columns of ``text_figures``. Integer comparisons, so no rule depends on rounding. Rules about one
    kind of damage abstain where they do not see it: that it is absent says little about other kinds."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "v_word_length": _vote((chars * 2 < n * 5) | (chars > n * 14), (chars >= n * 3) & (chars <= n * 10)),
        "v_stops": _vote(F.col("n_stops") * 100 < n, (F.col("n_stops") * 40 >= n) & (F.col("n_stops") * 3 <= n)),
        "v_symbols": _vote(F.col("n_symbols") * 10 > n),
        "v_marks": _vote(F.col("n_marks") * 100 > chars * 8),
        "v_lines": _vote(F.col("n_dup_lines") * 2 > F.col("n_lines")),
        "v_repeats": _vote(F.col("n_repeat_words") * 100 > n * 30),
        "v_capitals": _vote(F.col("n_capitals") * 10 > chars * 3),
        "v_variety": _vote(F.col("n_distinct") * 100 < n * 8, F.col("n_distinct") * 3 >= n),
    }


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, the figures, ``base_failed``, ``p_good`` and ``kept``.

    A null or empty text has no words, fails the base and is not kept; rows that share an id are judged each by its
    own text; an empty table gives an empty result. The figures are stored once (numbers only) for the two passes
    over them.
    """
    spark = docs.sparkSession
    figures = stored(spark, text_figures(docs, text_col, (id_col,)), "text-figures")
    votes = rule_votes()
    voted = figures.select("*", *[c.alias(k) for k, c in votes.items()])
    model = fit_votes(voted, list(votes))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return (voted.withColumn("base_failed", failed).withColumn("p_good", posterior(model, list(votes)))
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= MIN_POSTERIOR)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 3 over all of ``documents``."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
