"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a built-in expression over the words and lines of one row, so
nothing is shuffled and the rules run inside the scan. Lambdas address words by
position; repeated three-word windows are found by sorting (hash, position)
pairs, so a text of n words costs n log n.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, German, French, Spanish.
STOP_WORDS = (
    "the of and to in that it is was for on with as be at by this from are or an not "
    "der die das und zu den mit von ist im ein eine auf für nicht sich des dem als auch "
    "le la les de des et un une que qui dans pour sur pas est en du au avec par "
    "el los las y en del por con para se su una lo como más es no"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` of METRICS must lie in [low, high]; an open end is None."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


# The first two are the base rules. Ratios are per word, per line or per letter.
BASE_RULES = (
    Rule("too_few_words", "n_words", low=50),
    Rule("repeated_windows", "repeat_ratio", high=0.5),
)
RULES = (
    Rule("word_length", "mean_word_chars", low=2.0, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.25),
    Rule("capitals", "capital_ratio", high=0.5),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("stop_words", "stop_ratio", low=0.01),
)


def _passes(rule: Rule) -> Column:
    value = F.col(rule.measure)
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (value >= rule.low)
    if rule.high is not None:
        ok = ok & (value <= rule.high)
    return ok


def failed_rules(rules: tuple[Rule, ...]) -> Column:
    """Names of the rules that a row breaks, in table order."""
    return F.filter(F.array(*[F.when(~_passes(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())


def _repeat_words() -> list[tuple[str, Column]]:
    """Steps to the number of words inside three-word windows that occur twice or more.

    Windows are compared by 64-bit hash. Hash and position are packed into one
    long, so that a primitive sort brings equal windows together; neighbours
    are then compared by their whole hashes.
    """
    w, win, order, at, bits = (F.col(c) for c in ("_words", "_win", "_order", "_at", "_bits"))
    n = F.col("n_words").cast("int")
    windows = F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    some = F.size(F.array_distinct(win)) < F.size(win)
    pairs = F.transform(win, lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long")))
    index = lambda x: (x - F.call_function("shiftleft", F.call_function("shiftright", x, bits), bits)).cast("int")
    ordered = F.when(some, F.transform(F.sort_array(pairs), index))
    hashes = F.transform(order, lambda i: F.get(win, i))
    sorted_win = F.col("_sorted")
    twice = F.array_compact(F.transform(
        sorted_win, lambda h, j: F.when((h == F.get(sorted_win, j - 1)) | (h == F.get(sorted_win, j + 1)), F.get(order, j))
    ))
    covered = F.aggregate(
        F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))),
        F.lit(0), lambda a, x: a + x,
    )
    return [
        ("_win", windows),
        ("_bits", F.length(F.bin(n.cast("long")))),
        ("_order", ordered),
        ("_sorted", hashes),
        ("_at", F.sort_array(twice)),
        ("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")),
    ]


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of ``METRICS`` to every row. A null or empty text has zero words."""
    body = F.coalesce(F.col("_text"), F.lit(""))
    n = F.col("n_words")
    per_word = lambda c: F.when(n > 0, c / n).otherwise(F.lit(0.0))
    lines = F.col("_lines")
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({
        "_words": F.array_remove(F.split(body, SPACE), ""),
        "_lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, f"[{SYMBOLS}]+", ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_capitals": F.length(F.regexp_replace(body, "[^A-Z]+", "")).cast("long"),
        "n_stop_words": F.size(F.filter("_words", lambda x: x.isin(STOP_WORDS))).cast("long"),
    })
    for name, step in _repeat_words():
        df = df.withColumn(name, step)
    return df.withColumns({
        "repeat_ratio": per_word(F.col("n_repeat_words").cast("double")),
        "mean_word_chars": per_word(F.col("word_chars").cast("double")),
        "symbol_ratio": per_word(F.col("n_symbols").cast("double")),
        "capital_ratio": F.when(F.col("word_chars") > 0, F.col("n_capitals") / F.col("word_chars")).otherwise(0.0),
        "dup_line_ratio": F.when(F.col("n_lines") > 0, F.col("n_dup_lines") / F.col("n_lines")).otherwise(0.0),
        "stop_ratio": per_word(F.col("n_stop_words").cast("double")),
    }).drop("_text", "_words", "_lines", "_win", "_order", "_sorted", "_bits", "_at")


METRICS = [
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_capitals", "n_stop_words", "n_repeat_words",
    "repeat_ratio", "mean_word_chars", "symbol_ratio", "capital_ratio", "dup_line_ratio", "stop_ratio",
]


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``docs`` once, with measures, ``base_failed``, ``failed`` (rule names) and ``kept``.

    Columns of ``docs`` that carry the name of an output column are replaced.
    Null texts count as empty; repeated rows are judged one by one.
    """
    out = METRICS + ["base_failed", "failed", "kept"]
    keep = [c for c in docs.columns if c == text or (c not in out and not c.startswith("_"))]
    df = measures(docs.select(*[F.col(f"`{c}`") for c in keep]), text)
    df = df.withColumn("failed", failed_rules(BASE_RULES + tuple(rules)))
    names = [r.name for r in BASE_RULES]
    return df.withColumns({
        "base_failed": F.arrays_overlap("failed", F.array(*map(F.lit, names))),
        "kept": F.size("failed") == 0,
    })


def passing(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that every rule keeps, unchanged.

    The filter also reads a row number: a predicate is not pushed below a
    projection that makes one. Pushed down, it would repeat the expressions of
    every measure inside the measures that build on them.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    judged = quality(docs.select(row.alias("row"), F.col(f"`{text}`").alias("text")), "text", rules)
    kept = judged.select("row", "kept", F.monotonically_increasing_id().alias("number")).filter("kept AND number >= 0")
    return kept.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
