"""Quality rules with thresholds that follow the data of each language and source.

Every measure of a document goes into a quantile sketch of its group. A sketch is a table of counts
per bin, bins being whole numbers cut to their leading bits, so two sketches merge by adding counts
and a bin is within 1/32 of any value in it. The number of bins of a group is bounded by the bits of
a long, whatever the rows. Groups with few documents use the sketch of their language, or of all.
The fences of a group are joined back to its documents.

The spread of a fence is that of the eighths of the sketch, over texts counted once, and at least
one event in the document itself.

Built-in DataFrame functions only.

Defined cases: null text has no words, lines or symbols; null language and null source are groups
of their own; repeated rows are judged one by one; an empty table gives an empty result; further
columns of the input are kept as they are, unless they have the name of a measure, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegauge.functions.staging import once
from pagegauge.llm.base import SPACE

SYMBOLS = r"[#*$%&|<>]"
LEADING_BITS = 6
#: Measure, and whether small values are fenced off too.
MEASURES = {"symbol_rate": False, "mean_length": True, "dup_line_rate": False, "repeat_rate": False}
#: What one event makes of a measure in a document: a symbol, a repeated line, two equal windows or the
#: words of its repeated lines; of a mean length, what it errs by over so many words.
EVENTS = {
    "symbol_rate": "ceil(10000 / greatest(n_words, 1))",
    "mean_length": "CAST(mean_length_sketch.mid / (2 * sqrt(greatest(n_words, 1))) AS BIGINT)",
    "dup_line_rate": "ceil(10000 / greatest(n_lines, 1))",
    "repeat_rate": "greatest(ceil(60000 / greatest(n_words, 1)), dup_line_rate)",
}
#: One event in the shortest document that the base rules pass, one in fifty.
LEAST_RATE = 200


def _repeat_words(df: DataFrame) -> DataFrame:
    """Words inside 3-word windows that the text has twice or more.

    Hashes of the windows, packed with their positions, are sorted as longs; windows with an equal
    neighbour are compared again by their words.
    """
    df = once(df, {"_n": F.size("_words").cast("long")})
    df = once(
        df,
        {
            "_sorted": F.expr(
                "sort_array(transform(IF(_n < 3, CAST(array() AS ARRAY<BIGINT>), sequence(0L, _n - 3)), i -> "
                "pmod(xxhash64(get(_words, CAST(i AS INT)), get(_words, CAST(i + 1 AS INT)), get(_words, CAST(i + 2 AS INT))), "
                "4611686018427387904 div _n) * _n + i))"
            )
        },
    )
    df = once(
        df,
        {
            "_maybe": F.expr(
                "transform(filter(_sorted, (x, i) -> coalesce(x div _n = get(_sorted, i - 1) div _n, false) "
                "OR coalesce(x div _n = get(_sorted, i + 1) div _n, false)), x -> CAST(x % _n AS INT))"
            )
        },
    )
    df = once(
        df,
        {
            "_windows": F.expr(
                "sort_array(transform(_maybe, p -> struct(get(_words, p) AS a, get(_words, p + 1) AS b, get(_words, p + 2) AS c, p AS p)))"
            )
        },
    )
    same = "(get(_windows, {0}).a = x.a AND get(_windows, {0}).b = x.b AND get(_windows, {0}).c = x.c)"
    df = once(
        df,
        {
            "_starts": F.expr(
                f"sort_array(transform(filter(_windows, (x, i) -> coalesce({same.format('i - 1')}, false) "
                f"OR coalesce({same.format('i + 1')}, false)), x -> x.p))"
            )
        },
    )
    return once(
        df,
        {
            "n_repeat_words": F.expr(
                "aggregate(_starts, struct(0L AS n, -3 AS last), (s, p) -> "
                "struct(s.n + least(3, p - s.last) AS n, p AS last), s -> s.n)"
            )
        },
    )


def measured(docs: DataFrame, text_col: str = "text", min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """The input with its counts, base verdict and measures (whole numbers)."""
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", *MEASURES]
    steps = ["_text", "_words", "_lines", "_n", "_sorted", "_maybe", "_windows", "_starts"]
    names = [c for c in docs.columns if c not in [*made, *steps]]
    df = docs.select(*[docs[c] for c in names], F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    df = once(
        df,
        {
            "_words": F.array_remove(F.split("_text", f"[{SPACE}]+"), ""),
            "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
        },
    )
    df = once(
        df,
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.regexp_replace("_text", f"[{SPACE}]+", "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", f"{SYMBOLS}+", ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        },
    )
    df = _repeat_words(df)
    words = F.greatest(F.col("n_words"), F.lit(1))
    df = df.withColumns(
        {
            "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")),
            "symbol_rate": F.expr("n_symbols * 10000 div greatest(n_words, 1)"),
            "mean_length": F.expr("word_chars * 1000 div greatest(n_words, 1)"),
            "dup_line_rate": F.expr("n_dup_lines * 10000 div greatest(n_lines, 1)"),
            "repeat_rate": F.expr("n_repeat_words * 10000 div greatest(n_words, 1)"),
        }
    )
    return df.select(*names, *made)


def binned(value: Column) -> Column:
    """A whole number cut to its leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - LEADING_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measures: DataFrame, groups: list[str]) -> DataFrame:
    """Counts per group, measure and bin of the documents that pass the base rules."""
    rows = measures.filter(~F.col("base_failed")).select(
        *[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)],
        F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), binned(F.col(m)).alias("bin")) for m in MEASURES])),
    )
    return rows.groupBy(*[f"g{i}" for i in range(len(groups))], "measure", "bin").agg(F.count("*").alias("n"))


def _ranked(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of every level, with the documents up to each bin and in all."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(len(keys)))).alias("level")
    merged = (
        sketch.select("*", levels)
        .select(
            *[F.when(F.col("level") > i, F.col(k)).alias(k) for i, k in enumerate(keys)], "level", "measure", "bin", "n"
        )
        .groupBy(*keys, "level", "measure", "bin")
        .agg(F.sum("n").alias("n"))
    )
    whole = Window.partitionBy(*keys, "level", "measure")
    return merged.withColumns(
        {
            "upto": F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)),
            "total": F.sum("n").over(whole),
        }
    )


def distinct_texts(measures: DataFrame, groups: list[str], text_key: str) -> DataFrame:
    """Groups, base verdict and measures of every text of a group once; ``text_key`` tells texts apart."""
    return measures.select(*groups, text_key, "base_failed", *MEASURES).distinct()


def upper_fences(sketch: DataFrame, groups: int, min_docs: int = 100) -> DataFrame:
    """One row per group: the eighths that each measure's fences start from and their distance to the median.

    Every measure takes the finest sketch with enough documents whose spread is not 0; where all are
    0, the finest with enough documents.
    """
    keys = [f"g{i}" for i in range(groups)]
    eighth = lambda k: F.min(F.when(8 * F.col("upto") >= k * F.col("total"), F.col("bin")))
    table = (
        _ranked(sketch, keys)
        .groupBy(*keys, "level", "measure")
        .agg(eighth(1).alias("low"), eighth(4).alias("mid"), eighth(7).alias("high"), F.max("total").alias("total"))
    )
    levels = F.explode(F.sequence(F.lit(0), F.lit(groups))).alias("at")
    asked = table.filter(F.col("level") == groups).select(
        *[F.col(k).alias(f"own_{k}") for k in keys], F.col("measure").alias("own_measure"), levels
    )
    asked = asked.select("*", *[F.when(F.col("at") > i, F.col(f"own_{k}")).alias(f"asked_{k}") for i, k in enumerate(keys)])
    on = (F.col("at") == F.col("level")) & (F.col("own_measure") == F.col("measure"))
    for k in keys:
        on &= F.col(f"asked_{k}").eqNullSafe(F.col(k))
    met = asked.join(table, on).filter((F.col("total") >= min_docs) | (F.col("level") == 0))
    best = met.groupBy(*[f"own_{k}" for k in keys], "own_measure").agg(
        F.max_by(F.struct("low", "mid", "high"), F.struct(F.col("high") > F.col("mid"), F.col("level"))).alias("best")
    )
    return best.groupBy(*[F.col(f"own_{k}").alias(k) for k in keys]).agg(
        *[F.max(F.when(F.col("own_measure") == m, F.col("best"))).alias(f"{m}_sketch") for m in MEASURES]
    )


def judged_by_sketch(measures: DataFrame, bounds: DataFrame, groups: list[str], width: int = 3) -> DataFrame:
    """``measures`` with ``kept``, under the fences of ``upper_fences``.

    A fence is ``width`` spreads outside its eighth. The spread is the sketch's, and at least one
    event in the document or in the shortest one that the base rules pass.
    """
    on = F.lit(True)
    for i, g in enumerate(groups):
        on &= measures[g].eqNullSafe(bounds[f"g{i}"])
    inside = ~F.col("base_failed")
    for m, both in MEASURES.items():
        low, mid, high = (F.col(f"{m}_sketch.{x}") for x in ("low", "mid", "high"))
        least = F.greatest(F.lit(LEAST_RATE), F.expr(EVENTS[m]))
        inside &= F.col(m) <= high + width * F.greatest(high - mid, least)
        if both:
            inside &= F.col(m) >= low - width * F.greatest(mid - low, least)
    names = [c for c in measures.columns if c != "kept"]
    return measures.join(bounds, on, "left").select(*[measures[c] for c in names], F.coalesce(inside, F.lit(False)).alias("kept"))


def verdicts(measures: DataFrame, groups: list[str], text_key: str, min_docs: int = 100) -> DataFrame:
    """``measures`` with ``kept``: not failed by the base rules, and inside the fences of their group's sketch."""
    bounds = upper_fences(sketches(distinct_texts(measures, groups, text_key), groups), len(groups), min_docs)
    return judged_by_sketch(measures, bounds, groups)
