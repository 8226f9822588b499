"""Quality rules with thresholds taken from quantile sketches per language and source.

Every text is measured with array expressions, and the measures are written once. Each
rule's value is a whole number (a share in thousandths). Its sketch is a histogram with
logarithmic bins, whose width is 1/32 of the value: counts per (language, source, rule,
bin). Adding counts merges sketches, so the sketch of a language or of the corpus is the
sum of its sources' sketches, and the result does not depend on the order of rows. From
the quartiles come fences instead of fixed cutoffs:

    upper = q75 + 3 * max(q75 - q25, spread),  lower = q25 - 3 * max(q75 - q25, spread)

`spread` keeps a fence from closing in on a source whose rows are all alike. One rule
holds at every size: the quartiles of a source are those of its own rows and `min_rows`
rows more that are distributed as its language, and a language counts as its own rows and
`min_rows` rows distributed as the corpus. So what is inherited fades as rows come in, and
no row count switches it off. The thresholds are joined back to filter the rows.

Defined cases: a null text has no words and fails the base rule; null languages and
sources are groups of their own; repeated ids and rows are judged row by row; an empty
table gives an empty one; an input column named like a measure is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import broadcast_if_small, let, pass_through, words
from labelloom.session import materialize

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW_WORDS = 8
SYMBOLS = "[#*$%&|<>]"
MIN_ROWS = 200  # what an inherited sketch counts for
FENCE = 3
BIN_BITS = 5  # values up to 2^(bits + 1) are exact, larger ones to 2^-bits

# Rule: value (a whole number), least spread, whether low values are rejected too.
RULES = {
    "symbols": ("1000 * n_symbols div greatest(n_words, 1)", 50, False),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", 50, False),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", 50, False),
    "word_length": ("100 * word_chars div greatest(n_words, 1)", 100, True),
}
MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "base_failed",
)


def measure(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The input with the measures of every whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(
        F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    )
    return (
        pass_through(docs, MEASURES)
        .withColumn("__words", words(F.col(text_col)))
        .withColumn("__lines", lines)
        .withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn(
            "n_dup_lines",
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        )
        .withColumn("n_repeat_words", _repeat_words(F.col("__words")).cast("long"))
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        )
        .drop("__words", "__lines")
    )


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of 8 words that occur twice or more in the text."""
    last = F.size(words) - WINDOW_WORDS
    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW_WORDS)]),
    )
    return F.when(last < 1, F.lit(0)).otherwise(
        let(
            windows,
            lambda w: F.when(
                F.size(F.array_distinct(w)) == F.size(w), F.lit(0)
            ).otherwise(_covered(w)),
        )
    )


def _covered(windows: Column) -> Column:
    """Sorting (hash, place) puts equal windows side by side; their places, sorted again,
    each cover 8 words or as many as there are up to the next place."""
    pairs = F.sort_array(
        F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    places = let(
        pairs,
        lambda p: F.filter(
            F.transform(
                p,
                lambda x, k: F.when(
                    (F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False)))
                    | (F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))),
                    x["i"],
                ),
            ),
            lambda i: i.isNotNull(),
        ),
    )
    return let(
        F.sort_array(places),
        lambda p: F.aggregate(
            F.transform(
                p,
                lambda i, k: F.least(
                    F.lit(WINDOW_WORDS),
                    F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW_WORDS)),
                ),
            ),
            F.lit(0),
            lambda total, x: total + x,
        ),
    )


def sketch_bin(value: Column) -> Column:
    """Number of the value's bin: whole numbers only, so any engine gets the same."""
    shift = F.greatest(F.length(F.bin(value)) - BIN_BITS - 1, F.lit(0))
    return (
        shift * (1 << BIN_BITS) + F.call_function("shiftright", value, shift)
    ).cast("long")


def bin_start(number: Column) -> Column:
    """The least value of a bin, which stands for the bin's values."""
    step = 1 << BIN_BITS
    shift = F.greatest(F.floor(number / step) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", number - shift * step, shift)


def sketches(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, rule, bin, n): counts of the rows that pass the base rule."""
    rules = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.expr(value).cast("long").alias("value"))
            for rule, (value, _, _) in RULES.items()
        ]
    )
    return (
        measured.where(~F.col("base_failed"))
        .select(
            F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(rules).alias("r")
        )
        .groupBy("lang", "source", F.col("r.rule"), sketch_bin(F.col("r.value")).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fences(bins: DataFrame, *, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per (lang, source): `lower` and `upper`, each a map from rule to fence.

    Sketches are merged upwards and then weigh in downwards. An array holds the bins of one
    group and rule, whose number is bounded by the binning, and the joins run over groups,
    not over documents. Ranks are compared as whole numbers.
    """
    own = _histograms(bins, ["lang", "source"]).alias("own")
    lang = _histograms(bins, ["lang"]).alias("by_lang")
    every = _histograms(bins, []).alias("every")
    more = _whole(F.lit(min_rows))
    lang_rows, all_rows = _whole(F.col("by_lang.rows")), _whole(F.col("every.rows"))
    # Every bin with the rows up to it in the language, inherited ones included, in units
    # of 1 / `unit` rows.
    inherited = lang.join(every, F.col("by_lang.rule") == F.col("every.rule")).select(
        F.col("by_lang.lang").alias("lang"),
        F.col("by_lang.rule").alias("rule"),
        ((lang_rows + more) * all_rows).alias("unit"),
        F.transform(
            "every.bins",
            lambda x: F.struct(
                x["bin"].alias("bin"),
                (
                    _upto(F.col("by_lang.bins"), x["bin"]) * all_rows
                    + more * _upto(F.col("every.bins"), x["bin"])
                ).alias("upto"),
            ),
        ).alias("bins"),
    ).alias("up")
    joined = own.join(
        inherited,
        F.col("own.lang").eqNullSafe(F.col("up.lang"))
        & (F.col("own.rule") == F.col("up.rule")),
    )

    def quantile(percent: int) -> Column:
        # Nearest rank: the first bin that holds at least this part of the rows.
        least = percent * (_whole(F.col("own.rows")) + more) * F.col("up.unit")
        reached = F.filter(
            "up.bins",
            lambda x: 100
            * (_upto(F.col("own.bins"), x["bin"]) * F.col("up.unit") + more * x["upto"])
            >= least,
        )
        return bin_start(F.get(reached, 0)["bin"])

    spreads = F.create_map(
        *[F.lit(x) for rule, (_, spread, _) in RULES.items() for x in (rule, spread)]
    )
    reach = FENCE * F.greatest(
        F.col("q75") - F.col("q25"), F.element_at(spreads, F.col("rule")).cast("long")
    )
    return (
        joined.select(
            F.col("own.lang").alias("of_lang"),
            F.col("own.source").alias("of_source"),
            F.col("own.rule").alias("rule"),
            quantile(25).alias("q25"),
            quantile(75).alias("q75"),
        )
        .groupBy("of_lang", "of_source")
        .agg(
            *[
                F.max(F.when(F.col("rule") == rule, F.col("q75") + reach)).alias(
                    f"upper_{rule}"
                )
                for rule in RULES
            ],
            *[
                F.max(F.when(F.col("rule") == rule, F.col("q25") - reach)).alias(
                    f"lower_{rule}"
                )
                for rule, (_, _, both) in RULES.items()
                if both
            ],
        )
    )


def _histograms(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Each group's and rule's `rows`, and its `bins` (bin, n) in order."""
    return (
        bins.groupBy(*keys, "rule", "bin")
        .agg(F.sum("n").alias("n"))
        .groupBy(*keys, "rule")
        .agg(
            F.sum("n").alias("rows"),
            F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"),
        )
    )


def _whole(rows: Column) -> Column:
    """A row count whose products with two others are exact."""
    return rows.cast("decimal(12,0)")


def _upto(bins: Column, last: Column) -> Column:
    """Rows in the bins up to and with `last`."""
    return _whole(
        F.aggregate(
            F.filter(bins, lambda x: x["bin"] <= last),
            F.lit(0).cast("long"),
            lambda total, x: total + x["n"],
        )
    )


def judge(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """The input's columns, the measures and `kept`.

    Measures are written once to the shared folder with the columns of the input, so
    select what is needed first; `text_col` itself is part of it only if it is wanted in
    the result (see `judge_ids`).
    """
    return _decide(
        materialize(measure(docs, text_col=text_col), "quality-measures"),
        lang_col,
        source_col,
        min_rows,
    )


def judge_ids(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """As `judge`, for the id, language and source of each row, without the text."""
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(lang_col).alias("lang"),
        F.col(source_col).alias("source"),
        F.col(text_col).alias("__text"),
    )
    measured = measure(narrow, text_col="__text").drop("__text")
    return _decide(
        materialize(measured, "quality-measures"), "lang", "source", min_rows
    )


def filter_quality(docs: DataFrame, **options) -> DataFrame:
    """The rows that pass, with the columns of the input."""
    columns = docs.columns
    inner = docs.select(*[F.col(c).alias(f"in_{c}") for c in columns])
    names = {
        name: f"in_{options.get(name, default)}"
        for name, default in (
            ("text_col", "text"),
            ("lang_col", "lang"),
            ("source_col", "source"),
        )
    }
    judged = judge(inner, **(options | names))
    return judged.where("kept").select(*[F.col(f"in_{c}").alias(c) for c in columns])


def _decide(measured: DataFrame, lang: str, source: str, min_rows: int) -> DataFrame:
    limits = materialize(
        fences(sketches(measured, lang, source), min_rows=min_rows), "quality-fences"
    )
    outside = F.lit(False)
    for rule, (value, _, both) in RULES.items():
        value = F.expr(value).cast("long")
        outside = outside | F.coalesce(value > F.col(f"upper_{rule}"), F.lit(False))
        if both:
            outside = outside | F.coalesce(value < F.col(f"lower_{rule}"), F.lit(False))
    limit_columns = limits.columns
    return (
        measured.withColumn("kept", F.lit(True))
        .join(
            broadcast_if_small(limits),
            F.col(lang).eqNullSafe(F.col("of_lang"))
            & F.col(source).eqNullSafe(F.col("of_source")),
            "left",
        )
        .withColumn("kept", ~F.col("base_failed") & ~outside)
        .drop(*limit_columns)
    )
