"""Quality rules as one Spark projection, compiled from a table of thresholds; no user functions.

Base figures come first (see op6); a document that passes the base rule is then held against RULES. Ratios over words
or lines of a text without any are 0. A text in which no 8-word window repeats, which comparing window hashes shows
for sure, has no repeat words; else the windows' own words are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import fresh

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: ASCII white space and symbols.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Frequent short words of the corpus languages.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "with", "was", "are", "be"],
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "ist", "im", "nicht"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "que", "est"],
    "es": ["el", "la", "los", "de", "que", "y", "en", "un", "una", "se", "del", "con"],
}
#: (ratio, lowest, highest): a document is kept if each ratio lies within.
RULES = (
    ("mean_word_chars", 1.5, 30.0),
    ("symbols_per_word", 0.0, 0.25),
    ("dup_line_share", 0.0, 0.5),
    ("repeat_word_share", 0.0, 0.3),
    ("stop_word_share", 0.01, 1.0),
    ("upper_share", 0.0, 0.7),
)


def _as_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _tied(hashes: Column) -> Column:
    """The positions of the windows whose hash occurs again, in no order; null if there are none."""
    placed = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), (k + 1).alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), placed)


def _sorted_windows(words: Column, tied: Column) -> Column:
    """(words, position) in order of the windows that have a neighbour of the same hash."""
    same = lambda x, k: F.coalesce(F.get(tied, k)["h"] == x["h"], F.lit(False))
    at = F.filter(tied, lambda x, k: same(x, k - 1) | same(x, k + 1))
    return F.array_sort(F.transform(at, lambda x: F.struct(F.array_join(F.slice(words, x["i"], WINDOW), " ").alias("w"), x["i"].alias("i"))))


def _repeated(windows: Column) -> Column:
    """The positions of windows equal to a neighbour in the sorted order, in order."""
    same = lambda x, k: F.coalesce(F.get(windows, k)["w"] == x["w"], F.lit(False))
    return F.array_sort(F.filter(F.transform(windows, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])), lambda i: i.isNotNull()))


def _covered(starts: Column) -> Column:
    """Words that lie in a window that starts at one of the positions."""
    step = lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n"), (i + WINDOW).alias("end"))
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda s: s["n"])


def quality_figures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long), and the ratios of RULES.

    A null or empty text has no words: all figures are 0. Rows stand alone, so repeated rows, ties and an empty table
    need no rule. Input columns named like an added one give way to it.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(r for r, _, _ in RULES)]
    kept = [c for c in docs.columns if c.lower() not in names]
    t, w, h, lines = (fresh([*docs.columns, *names], x) for x in ("rules_text", "rules_words", "rules_hashes", "rules_lines"))
    step = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(t))
    step = step.withColumn(w, _as_words(F.col(t)))
    step = step.withColumn(h, F.transform(F.col(w), lambda x: F.xxhash64(x)))
    step = step.withColumn(h, F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(*(F.get(F.col(h), i + (k - 1)) for k in range(WINDOW))))))
    step = step.withColumn(lines, F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    step = step.withColumn(h, _tied(F.col(h)))
    step = step.withColumn(h, _sorted_windows(F.col(w), F.col(h)))
    step = step.withColumn(h, _repeated(F.col(h)))
    step = step.select(
        *(F.col(f"`{c}`") for c in kept),
        F.col(t),
        # spark_partition_id() keeps filters on the figures from being pushed below, which would compute them twice
        F.when(F.spark_partition_id() >= 0, F.size(w)).cast("long").alias("n_words"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col(h)), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).alias(lines),
        F.size(F.filter(w, lambda x: x.isin(sorted({s for v in STOP_WORDS.values() for s in v})))).alias(w),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n = F.col("n_words")
    return step.select(
        *(F.col(f"`{c}`") for c in [*kept, *names[:5]]),
        share(F.col("word_chars"), n).alias("mean_word_chars"),
        share(F.col("n_symbols"), n).alias("symbols_per_word"),
        share(F.col("n_dup_lines"), F.col(lines)).alias("dup_line_share"),
        share(F.col("n_repeat_words"), n).alias("repeat_word_share"),
        share(F.col(w), n).alias("stop_word_share"),
        share(F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")), F.col("word_chars")).alias("upper_share"),
    )


def compiled(rules=RULES) -> Column:
    """The table of thresholds as one condition."""
    verdict = F.lit(True)
    for name, low, high in rules:
        verdict = verdict & F.col(name).between(low, high)
    return verdict


def apply_rules(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """quality_figures(docs) with base_failed and kept (boolean)."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return quality_figures(docs, text_col).withColumn("base_failed", failed).withColumn("kept", ~failed & compiled(rules))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = apply_rules(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL_OP6 = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
win AS (SELECT rid, unnest(range(1, len(ws) - 6)) AS i, ws FROM w),
winkey AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS k FROM win),
rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS c FROM winkey) WHERE c >= 2),
cov AS (SELECT rid, count(DISTINCT i + d) AS n FROM rep, range(8) AS r(d) GROUP BY rid),
f AS (
  SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) AS n_upper,
         len(list_filter(ws, lambda x: list_contains([STOP], x))) AS n_stop
  FROM w LEFT JOIN cov ON cov.rid = w.rid),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND RULES AS kept
FROM b
""".replace("[STOP]", str(sorted({s for v in STOP_WORDS.values() for s in v}))).replace(
    "RULES",
    " AND ".join(
        f"(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END BETWEEN {low} AND {high})"
        for (_, low, high), (a, b) in zip(RULES, (("word_chars", "n_words"), ("n_symbols", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_stop", "n_words"), ("n_upper", "word_chars")), strict=True)
    ),
)
