"""Quality rules: a threshold table compiled into one projection (operator 7).

No user functions: every measure is a Spark expression over the text, and the table of thresholds
becomes one array of the names of violated rules.

Words are runs of `[^\\x20\\x09-\\x0D]`; a null or empty text has none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WORD_BREAKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Frequent function words of the four languages the rules are meant for.
STOP_WORDS = (
    "the", "and", "of", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "are", "this",
    "at", "from", "or", "an", "a",
    "der", "die", "das", "und", "ist", "von", "den", "mit", "für", "auf", "ein", "eine", "des", "dem", "nicht", "zu",
    "le", "la", "les", "de", "et", "un", "une", "du", "que", "qui", "est", "pour", "dans", "par", "sur", "pas", "avec",
    "au", "en", "el", "los", "las", "y", "del", "se", "por", "con", "no", "su", "para", "al",
)
STOP_FORMS = STOP_WORDS + tuple(w.capitalize() for w in STOP_WORDS)


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule when `measure` is below `low` or above `high`."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The verdict beyond the base rules. Ratios are per word unless the name says line.
RULES = (
    Rule("too_long", "n_words", high=1_000_000),
    Rule("word_length", "mean_word_length", low=1.5, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.4),
    Rule("stop_words", "stop_word_ratio", low=0.03),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
)


def _next(values: Column, k: int) -> Column:
    """The array from its element k + 1 on."""
    return F.slice(values, F.lit(k + 1), F.greatest(F.size(values) - k, F.lit(0)))


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, measures): the four counts of the base rules and the ratios the table refers to.

    n_repeat_words covers words inside 8-word windows that occur twice or more in the text. Windows
    are compared by 64-bit hashes, built by doubling (2, 4, 8 words); only the windows of a text with
    a repeated one are sorted.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.select("doc_id", text.alias("text")).select(
        "doc_id", F.array_remove(F.split("text", WORD_BREAKS), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
    )
    joined = lambda a, k: F.zip_with(a, _next(a, k), lambda x, y: F.xxhash64(x, y))
    whole = lambda a, k: F.slice(a, F.lit(1), F.greatest(F.size(a) - (k - 1), F.lit(0)))
    counted = split.select(
        "doc_id", F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: w.isin(*STOP_FORMS))).cast("long").alias("n_stop_words"),
        joined(F.col("words"), 1).alias("h2"),
    )
    counted = counted.withColumn("h4", whole(joined(F.col("h2"), 2), 4)).drop("h2")
    # a repeated 8-word window repeats its first four words: most texts stop here
    counted = counted.withColumn("windows", F.when(
        F.size("h4") > F.size(F.array_distinct("h4")), whole(joined(F.col("h4"), 4), 5))).drop("h4")
    repeated = F.when(
        F.size("windows") > F.size(F.array_distinct("windows")),
        F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
    )
    ordered = counted.withColumn("ordered", repeated).drop("windows")
    nothing = F.array(F.lit(None).cast("struct<x:bigint,i:int>"))
    before = F.concat(nothing, "ordered")
    after = F.concat(_next(F.col("ordered"), 1), nothing)
    twins = F.zip_with(
        F.zip_with("ordered", before, lambda a, b: F.struct(a.alias("a"), (a["x"] == b["x"]).alias("same"))), after,
        lambda ab, c: F.when(ab["same"] | (ab["a"]["x"] == c["x"]), ab["a"]["i"]))
    at = ordered.withColumn("at", F.sort_array(F.filter(twins, lambda i: i.isNotNull()))).drop("ordered")
    steps = F.zip_with("at", _next(F.col("at"), 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)
    n = F.greatest(F.col("n_words"), F.lit(1))
    return at.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(total, F.lit(0)).cast("long").alias("n_repeat_words"),
        (F.col("word_chars") / n).alias("mean_word_length"), (F.col("n_symbols") / n).alias("symbol_ratio"),
        (F.col("n_stop_words") / n).alias("stop_word_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_ratio"),
    )


def _broken(rule: Rule) -> Column:
    m = F.col(rule.measure)
    tests = [m < rule.low] if rule.low is not None else []
    tests += [m > rule.high] if rule.high is not None else []
    bad = tests[0]
    for t in tests[1:]:
        bad = bad | t
    return F.when(bad, F.lit(rule.name))


def quality_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: measures, base_failed, failed_rules (names, table order) and kept.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated 8-word windows. kept:
    neither base_failed nor any rule of the table broken. Null and empty texts have zero in every
    measure and fail. Other columns of `docs` are ignored; repeated rows are judged one by one; an
    empty table gives no rows.
    """
    m = with_measures(docs, text_col)
    failed = F.filter(F.array(*[_broken(r) for r in rules]), lambda x: x.isNotNull())
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = m.withColumns({"base_failed": base, "failed_rules": failed if rules else F.array().cast("array<string>")})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
