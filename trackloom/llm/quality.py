"""Quality rules: a threshold table compiled into one Spark projection.

Every rule is a row ``(name, metric, least, most)``; a document passes when each
metric lies within its bounds. All metrics are built-in expressions over the text,
so the whole operator is one map-side projection: no shuffle, no user function.

Defined results: a null text counts as empty; an empty text has zero counts, null
ratios (a null ratio breaks no rule) and fails the base rule on its word count.
Repeated rows are judged alike, each on its own. Extra columns are ignored by
``measured``/``judged`` and kept whole by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import numbered, take, words_of

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is it that for was with on as are by be this from at an "
    "der die und das ist von mit den zu ein im für sich nicht auf auch "
    "le la les de des et en un une du que qui pour dans par est au sur avec ce "
    "el los las y del se con no una su por lo como es al más"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject a document whose ``metric`` is below ``least`` or above ``most``.

    The rule asks this only of documents of ``words_from`` words and more and of at most
    ``bytes_a_char`` bytes a character.
    """

    name: str
    metric: str
    least: float | None = None
    most: float | None = None
    words_from: int = 0
    bytes_a_char: float | None = None


#: The production table. Stop words are asked of texts that are long enough for a share of 1 %, and in
#: scripts whose characters take few bytes: the list covers languages in Latin letters.
RULES = (
    Rule("word_length", "mean_word_length", 1.5, 20.0),
    Rule("symbols", "symbol_ratio", None, 0.25),
    Rule("shouting", "shout_ratio", None, 0.25),
    Rule("stop_words", "stop_word_ratio", 0.01, None, words_from=100, bytes_a_char=1.5),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.5),
)

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def _covered_words(z: Column) -> Column:
    """Words inside windows that occur again, from ``z``: (hash, position) in order."""
    same = lambda a, b: F.coalesce(a["h"] == F.get(z, b)["h"], F.lit(False))
    hits = F.filter(z, lambda x, i: same(x, i - 1) | same(x, i + 1))
    return F.sort_array(F.transform(hits, lambda x: x["i"]))


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: ``_id``, the base counts and the metrics the rules use."""
    df = take(docs, _id=doc_id, _text=text).withColumn(
        "_text", F.coalesce(F.col("_text").cast("string"), F.lit(""))
    )
    df = df.withColumns(
        {
            "_words": words_of(F.col("_text")),
            "_lines": F.split("_text", "\n"),
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long"),
            "n_shouts": F.regexp_count("_text", F.lit("!!")).cast("long"),
            "_wh": F.transform("_words", lambda w: F.xxhash64(w)),
            "_full": F.filter("_lines", lambda s: s.rlike("[^\\x20\\x09-\\x0D]")),
        }
    )
    df = df.withColumn(
        "_grams",
        F.when(
            F.col("n_words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("_wh") - WINDOW),
                lambda i: F.xxhash64(*[F.get("_wh", i + k) for k in range(WINDOW)]),
            ),
        ),
    )
    # Only texts with some repeated window pay for sorting (hash, position) pairs.
    df = df.withColumn(
        "_pairs",
        F.when(
            F.size(F.array_distinct("_grams")) < F.size("_grams"),
            F.sort_array(
                F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
            ),
        ),
    )
    df = df.withColumn("_at", _covered_words(F.col("_pairs")))
    stop = "(?i)(?<![^\\x20\\x09-\\x0D])(?:" + "|".join(STOP_WORDS) + ")(?![^\\x20\\x09-\\x0D])"
    n_full = F.size("_full").cast("long")
    df = df.withColumns(
        {
            "n_lines": n_full,
            "n_dup_lines": n_full - F.size(F.array_distinct("_full")),
            "n_repeat_words": F.coalesce(
                F.aggregate(
                    F.transform(
                        "_at",
                        lambda p, k: F.least(
                            F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - p, F.lit(WINDOW))
                        ).cast("long"),
                    ),
                    F.lit(0).cast("long"),
                    lambda a, x: a + x,
                ),
                F.lit(0).cast("long"),
            ),
            "n_stop_words": F.regexp_count("_text", F.lit(stop)).cast("long"),
            "n_bullets": F.size(F.filter("_full", lambda s: s.rlike("^[\\x20\\t]*[-*•][\\x20\\t]"))),
            "n_ellipsis": F.size(F.filter("_full", lambda s: s.rlike("(\\.\\.\\.|…)[\\x20\\t\\r]*$"))),
        }
    )
    n = F.col("n_words")
    return df.select(
        "_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_stop_words",
        "n_lines",
        _ratio(F.col("word_chars"), n).alias("mean_word_length"),
        _ratio(F.col("n_symbols"), n).alias("symbol_ratio"),
        _ratio(F.col("n_shouts"), n).alias("shout_ratio"),
        _ratio(F.col("n_stop_words"), n).alias("stop_word_ratio"),
        F.octet_length("_text").alias("n_bytes"),
        F.length("_text").alias("n_chars"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        _ratio(F.col("n_bullets"), F.col("n_lines")).alias("bullet_line_ratio"),
        _ratio(F.col("n_ellipsis"), F.col("n_lines")).alias("ellipsis_line_ratio"),
    )


def broken_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one expression: names of the rules that a row of metrics breaks."""

    def breaks(r: Rule) -> Column:
        low = F.col(r.metric) < r.least if r.least is not None else F.lit(False)
        high = F.col(r.metric) > r.most if r.most is not None else F.lit(False)
        bad = low | high
        if r.words_from:
            bad = bad & (F.col("n_words") >= r.words_from)
        if r.bytes_a_char is not None:
            bad = bad & (F.col("n_bytes") <= r.bytes_a_char * F.col("n_chars"))
        return F.when(bad, F.lit(r.name))

    return F.array_compact(F.array(*[breaks(r) for r in rules]))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``measured`` with ``base_failed``, ``reasons`` (broken rules) and ``kept``."""
    m = measured(docs, text, doc_id)
    base = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return (
        m.withColumn("base_failed", base)
        .withColumn("reasons", broken_rules(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; a map-side filter."""
    names = docs.columns
    packed = docs.toDF(*[f"_k{i}" for i in range(len(names))])
    packed = packed.select(F.struct("*").alias("_row"), numbered(names, text).alias("text"))
    # A column that is not deterministic keeps the optimizer from copying the whole chain of
    # expressions into the filter, once for each use of a metric.
    good = judged(packed, rules, "text", "_row").withColumn("_at", F.monotonically_increasing_id())
    good = good.filter("kept and _at >= 0")
    return good.select(*[F.col(f"_id._k{i}").alias(n) for i, n in enumerate(names)])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of query op8."""
    return judged(docs).select(
        F.col("_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )
