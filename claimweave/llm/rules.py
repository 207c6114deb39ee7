"""Quality rules: a threshold table compiled into Spark projections of length, symbol, stop-word and line ratios.

Only DataFrame functions are used. Nulls and empty texts have no words and so fail; texts of any length are
measured whole; repeated rows are judged one by one. judged() puts `measures` and `failed` in the place of columns of these names;
kept_documents() has no column of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import SPACES, documents

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in is that for it as was with be by on not are this from or an at a have has but they you which he",
    "fr": "de la le et les des un une du en que est pour dans qui sur pas au par plus il se ne elle avec",
    "de": "der die und den von zu das mit dem des auf für ist im nicht ein eine als auch es an werden aus er hat sich",
    "es": "de la que el en y los las por con una un su para es del lo al como más o no se",
}


@dataclass(frozen=True)
class Rule:
    """A document fails where measure lies outside least..most; a null measure never fails."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Measures are those that measured() names. Stop words count whatever their case and the signs around them.
RULES = (
    Rule("few_words", "n_words", least=10),
    Rule("repeated_windows", "repeat_share", most=0.2),
    Rule("word_length", "mean_word_chars", least=2, most=15),
    Rule("symbols", "symbols_per_word", most=0.1),
    Rule("stop_words", "stop_share", least=0.04),
    Rule("capitals", "capital_share", most=0.3),
    Rule("doubled_words", "doubled_share", most=0.3),
    Rule("repeated_lines", "dup_line_share", most=0.5),
    Rule("ellipsis_lines", "ellipsis_line_share", most=0.3),
    Rule("bullet_lines", "bullet_line_share", most=0.9),
)
#: The rules whose failure is the contract's base failure.
BASE = ("few_words", "repeated_windows")
#: Words in a window whose second occurrence counts as repetition.
WINDOW = 5


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def _is_stop(word: Column, stops: list[str]) -> Column:
    """Whether a word is a stop word in any case, with nothing but signs around it. Only words with something else than a-z at an end are searched for signs."""
    plain = F.left(word, F.lit(1)).between("a", "z") & F.right(word, F.lit(1)).between("a", "z")
    return F.lower(word).isin(stops) | (~plain & F.regexp_replace(F.lower(word), r"^[^\p{L}]++|[^\p{L}]++$", "").isin(stops))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column `measures`. Each select stages what the next one uses more than once."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "measures"]
    stops = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    trimmed = F.btrim(whole, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    step = docs.select(F.struct(*others).alias("_row"), words.alias("w"), lines.alias("l"), F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).alias("n_symbols"))
    step = step.select(
        "_row", "w", "n_symbols", F.size(F.filter("w", lambda x: _is_stop(x, stops))).alias("n_stop"), F.size("w").alias("n"), F.size("l").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.size(F.filter("w", lambda x: x.rlike(r"^\p{Lu}\p{Lu}+\P{L}*$"))).alias("n_capital"),
        F.size(F.filter("w", lambda x, i: x == F.get("w", i - 1))).alias("n_doubled"),
        F.size(F.filter("l", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).alias("n_ellipsis"),
        F.size(F.filter("l", lambda x: x.rlike(r"^\s*[-*•]\s"))).alias("n_bullet"),
        F.when(F.size("w") < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice("w", 1, F.greatest(F.size("w") - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get("w", i + k) for k in range(1, WINDOW))))).alias("h"),
    )
    kept = [c for c in step.columns if c not in ("w", "h")]
    step = step.select(*kept, F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("p"))
    same = lambda a, b: F.coalesce(a.getField("x") == b.getField("x"), F.lit(False))
    starts = F.filter("p", lambda x, k: same(x, F.get("p", k - 1)) | same(x, F.get("p", k + 1)))
    step = step.select(*kept, F.sort_array(F.transform(starts, lambda x: x.getField("i"))).alias("s"))
    covered = F.aggregate("s", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")), lambda a, x: F.struct((a.getField("n") + F.least(F.lit(WINDOW), x - a.getField("at"))).alias("n"), x.alias("at")), lambda a: a.getField("n"))
    step = step.select(*kept, F.coalesce(covered, F.lit(0)).alias("n_repeat"))
    long = lambda c: F.col(c).cast("long").alias(c)
    return step.select(
        "_row.*",
        F.struct(
            F.col("n").cast("long").alias("n_words"), long("word_chars"), long("n_symbols"), long("n_dup_lines"), F.col("n_repeat").cast("long").alias("n_repeat_words"),
            _ratio(F.col("n_repeat"), F.col("n")).alias("repeat_share"), _ratio(F.col("word_chars"), F.col("n")).alias("mean_word_chars"), _ratio(F.col("n_symbols"), F.col("n")).alias("symbols_per_word"),
            _ratio(F.col("n_stop"), F.col("n")).alias("stop_share"), _ratio(F.col("n_capital"), F.col("n")).alias("capital_share"), _ratio(F.col("n_doubled"), F.col("n")).alias("doubled_share"),
            _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"), _ratio(F.col("n_ellipsis"), F.col("n_lines")).alias("ellipsis_line_share"), _ratio(F.col("n_bullet"), F.col("n_lines")).alias("bullet_line_share"),
        ).alias("measures"),
    )


def verdict(rules: tuple[Rule, ...] = RULES, measures: str = "measures") -> Column:
    """The table as one array of the names of the rules that fail, in the table's order."""

    def fails(rule: Rule) -> Column:
        value, out = F.col(f"{measures}.{rule.measure}"), F.lit(False)
        if rule.least is not None:
            out = out | (value < rule.least)
        if rule.most is not None:
            out = out | (value > rule.most)
        return F.when(F.coalesce(out, F.lit(False)), F.lit(rule.name))

    return F.array_compact(F.array(*(fails(rule) for rule in rules)))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with `measures`, and `failed`: the names of failed rules, empty where the document is kept."""
    return measured(docs.drop("failed"), text).withColumn("failed", verdict(rules))


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents that no rule rejects; all their columns as they came, whatever their names."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col(f"`{text}`").alias("text"))
    # a number that depends on the row's place keeps the optimizer from moving the filter below the staged
    # selects, where it would write every measure out again inside itself
    rows = judged(rows, rules).withColumn("_place", F.monotonically_increasing_id())
    return rows.where((F.size("failed") == 0) & (F.col("_place") >= 0)).select(*(F.col("_doc").getField(c).alias(c) for c in docs.columns))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's counts and verdict for each document. Words in repeated windows are compared by 100 and 20 in whole numbers."""
    m = judged(documents(spark, sf_dir, "doc_id", "text"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    other = F.size(F.array_except("failed", F.array(*map(F.lit, BASE)))) == 0
    out = m.select("doc_id", "measures.n_words", "measures.word_chars", "measures.n_symbols", "measures.n_dup_lines", "measures.n_repeat_words", other.alias("passes"), "failed")
    return out.select(*out.columns[:6], base.alias("base_failed"), (~base & F.col("passes")).alias("kept"), F.array_join("failed", ",").alias("failed_rules"))
