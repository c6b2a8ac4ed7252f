"""Quality rules: a table of thresholds compiled into one projection.

Every rule compares two whole-number measures of a text, `measure` against `percent`
hundredths of `per`, so no rounding differs between engines. No user functions run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from mailloom.llm.common import blank_words

WINDOW = 5

# Frequent function words of four languages.
STOP_WORDS = (
    "the of and to in is was for on that with as by at from this be are or an it not have has"
    " der die das und ist von den dem mit sich des auf für nicht ein eine als auch im zu es werden"
    " le la les et de des un une est dans que qui pour pas sur au du par avec plus en ne se"
    " el los las y del que por con para una su al lo como más o no sus"
).split()


@dataclass(frozen=True)
class Rule:
    """Rejects a text where 100 * measure is beyond percent * per (`least`: falls short of)."""

    name: str
    measure: str
    percent: int
    per: str
    least: bool = False
    base: bool = False

    def rejects(self, m: dict[str, Column]) -> Column:
        left, right = F.lit(100) * m[self.measure], F.lit(self.percent) * m[self.per]
        return left < right if self.least else left > right

    def sql(self) -> str:
        return f"100 * {self.measure} {'<' if self.least else '>'} {self.percent} * {self.per}"


TABLE = (
    Rule("too_few_words", "n_words", 1000, "one", least=True, base=True),
    Rule("repeated_windows", "n_repeat_words", 20, "n_words", base=True),
    Rule("short_words", "word_chars", 200, "n_words", least=True),
    Rule("long_words", "word_chars", 1500, "n_words"),
    Rule("symbols", "n_symbols", 20, "n_words"),
    # One more than the stop words, so that a text of 25 words or fewer may have none.
    Rule("few_stop_words", "stop_words_and_one", 4, "n_words", least=True),
    Rule("repeated_lines", "n_dup_lines", 40, "n_lines"),
)

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_stop_words", "n_lines"]


def _stages(text: Column) -> list[dict[str, Column]]:
    """Columns by stage; a stage reads what earlier ones hold, so nothing is computed twice."""
    c = F.col
    n = F.size("__words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(
        F.array().cast("array<int>"))
    split = F.split(F.coalesce(c("__text"), F.lit("")), "\n")
    # A line has a word unless it is blank.
    lines = F.filter(split, lambda line: F.btrim(line, F.lit(" \t\x0b\x0c\r")) != "")
    same = lambda e, i: (
        (e["h"] == F.get("__sorted", i - 1)["h"]) | (e["h"] == F.get("__sorted", i + 1)["h"]))
    stop = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})
    symbols = F.regexp_replace(F.coalesce(c("__text"), F.lit("")), r"[^#*$%&|<>]+", "")
    return [
        {"__text": text},
        {"__words": blank_words(c("__text")), "__lines": lines, "__n_symbols": F.char_length(symbols)},
        {"__windows": F.transform(starts, lambda i: F.xxhash64(F.slice("__words", i, WINDOW)))},
        # Few texts hold a window twice; only those are sorted.
        {"__sorted": F.when(
            F.size(F.array_distinct("__windows")) < F.size("__windows"),
            F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))},
        {"__twice": F.sort_array(F.transform(F.filter("__sorted", same), lambda e: e["i"]))},
        {
            "__n_words": n.cast("long"),
            "__word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
            "__n_symbols": c("__n_symbols").cast("long"),
            "__n_lines": F.size("__lines").cast("long"),
            "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__n_stop_words": F.size(F.filter("__words", lambda w: w.isin(stop))).cast("long"),
            "__n_repeat_words": F.coalesce(F.aggregate(
                F.transform("__twice", lambda p, i: F.least(
                    F.lit(WINDOW), F.coalesce(F.get("__twice", i + 1) - p, F.lit(WINDOW)))),
                F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
        },
    ]


def measured(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = TABLE) -> DataFrame:
    """`df` with a column `__quality`: the measures, failed rule names, base_failed, kept.

    Null and empty texts have no words and fail too_few_words. Rows are judged one by one,
    so repeated rows and ties get equal verdicts, and texts of any length are read whole.
    Own columns of `df` stay as they are; its names must not start with two underscores.
    A window is compared by its 64-bit hash within one text.
    """
    own = df.columns
    for stage in _stages(F.col(text)):
        df = df.withColumns(stage)
    # A row number is not deterministic, so a filter on a verdict stays above this projection;
    # pushed below it, the filter would repeat every measure for each of its uses.
    df = df.withColumn("__row", F.monotonically_increasing_id())
    m = {k: F.col(f"__{k}") for k in MEASURES}
    m |= {"one": F.lit(1), "stop_words_and_one": m["n_stop_words"] + 1}
    fails = [F.when(r.rejects(m), F.lit(r.name)) for r in rules]
    base = F.lit(False)
    for r in rules:
        base = (base | r.rejects(m)) if r.base else base
    failed = F.filter(F.array(*fails), lambda x: x.isNotNull())
    quality = F.struct(*[m[k].alias(k) for k in MEASURES], failed.alias("failed_rules"),
                       base.alias("base_failed"), ((F.size(failed) == 0) & (F.col("__row") >= 0)).alias("kept"))
    return df.select(*own, quality.alias("__quality"))


def quality_report(df: DataFrame, rules: tuple[Rule, ...] = TABLE) -> DataFrame:
    """doc_id with its measures, failed rules and verdict; one row for each row of `df`."""
    return measured(df.select("doc_id", "text"), rules=rules).select("doc_id", "__quality.*")


def keep_good(df: DataFrame, rules: tuple[Rule, ...] = TABLE) -> DataFrame:
    """The rows of `df` that no rule rejects, with its own columns."""
    return measured(df, rules=rules).filter("__quality.kept").drop("__quality")
