"""Quality rules as a short-circuit cascade.

Every rule is a column over a document. What each rule costs and rejects is measured on a sample; the rules then run in the order of
rejections per cost, each counted on what the ones before it leave, and a document is tested by no rule
behind the first one that rejects it. The order never changes a verdict, only the work.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm.columns import BLANKS, staged, whole

#: Documents that costs and rejections are measured on, about, and how often each cost is taken.
SAMPLE_ROWS, TRIALS = 4000, 3
SYMBOLS = "#*$%&|<>"
#: Gets a text, never NULL, and the array of its words.
Measure = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets a look-up of measures by name and gives a boolean column; NULL rejects nothing."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(chars)).cast("bigint")


def words(text: Column) -> Column:
    """Runs of characters other than white space. Replacing single characters is quicker than translating or a pattern."""
    for blank in BLANKS.replace(" ", ""):
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def repeat_words(found: Column, size: int = 5) -> Column:
    """Words, of the array ``found``, inside windows of ``size`` words that it holds twice or more.

    Windows are compared by 64-bit hashes. Only texts with an equal pair of them sort them.
    """

    def covered(windows: Column) -> Column:
        marked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(marked, lambda s: _let(
            F.sort_array(F.transform(
                F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]).eqNullSafe(F.lit(True)) | (x["h"] == F.get(s, j + 1)["h"]).eqNullSafe(F.lit(True))),
                lambda x: x["i"])),
            lambda p: F.aggregate(
                F.transform(p, lambda v, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - v, F.lit(size))).cast("bigint")),
                F.lit(0).cast("bigint"), lambda a, x: a + x)))

    def windows(hashes: Column) -> Column:
        long_enough = F.size(hashes) >= size
        starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - size, F.lit(0)))
        return F.when(long_enough, F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)])))

    return _let(F.transform(found, lambda x: F.xxhash64(x)), lambda hashes: _let(
        windows(hashes),
        lambda h: F.when(h.isNull() | (F.size(F.array_distinct(h)) == F.size(h)), F.lit(0).cast("bigint")).otherwise(covered(h))))


def duplicate_lines(text: Column) -> Column:
    return _let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


#: What rules ask of a text.
MEASURES: dict[str, Measure] = {
    "n_words": lambda t, w: F.size(w).cast("bigint"),
    "word_chars": lambda t, w: F.char_length(F.array_join(w, "")).cast("bigint"),
    "n_symbols": lambda t, w: _count(t, f"[{SYMBOLS}]"),
    "n_dup_lines": lambda t, w: duplicate_lines(t),
    "n_repeat_words": lambda t, w: repeat_words(w),
    "n_lines": lambda t, w: F.size(_lines(t)).cast("bigint"),
    "n_upper": lambda t, w: _count(t, "[A-Z]"),
    "n_lower": lambda t, w: F.char_length(t).cast("bigint") - F.char_length(F.regexp_replace(t, "[a-z]+", "")),
    "n_shouts": lambda t, w: _count(t, "!"),
    "n_digits": lambda t, w: _count(t, "[0-9]"),
    "n_cut_lines": lambda t, w: F.size(F.filter(_lines(t), lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("bigint"),
    "longest_word": lambda t, w: F.coalesce(F.array_max(F.transform(w, lambda x: F.char_length(x))), F.lit(0)).cast("bigint"),
}
#: Base rules, then those of the method. All bounds are on whole numbers, so the order of sums can't change a verdict.
RULES = (
    Rule("few_words", lambda m: m("n_words") < 10),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 15 * m("n_words"))),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > 40 * m("n_lines")),
    Rule("capitals", lambda m: 100 * m("n_upper") > 60 * (m("n_upper") + m("n_lower"))),
    Rule("shouting", lambda m: 10 * m("n_shouts") > 3 * m("n_words")),
    Rule("digits", lambda m: 100 * m("n_digits") > 60 * m("word_chars")),
    Rule("cut_lines", lambda m: 100 * m("n_cut_lines") > 50 * m("n_lines")),
    Rule("longest_word", lambda m: m("longest_word") > 1000),
)


def _asked(ready: tuple[str, ...], measures: dict[str, Measure]) -> Callable[[str], Column]:
    """Look-up of measures over the rows of ``measured``."""
    return lambda name: F.col(f"measure.{name}") if name in ready else measures[name](F.col("_text"), F.col("_words"))


def measured(docs: DataFrame, names: tuple[str, ...], text: str = "text", measures: dict[str, Measure] | None = None) -> DataFrame:
    """(doc, measure, _text, _words): every row in a struct beside a struct of the named measures. NULL text is empty."""
    full = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(whole(docs).alias("doc"), full.alias("_text")).withColumn("_words", words(F.col("_text")))
    ask = _asked((), measures or MEASURES)
    return rows.select("doc", F.struct(F.lit(0).alias("_none"), *[ask(n).alias(n) for n in names]).alias("measure"), "_text", "_words")


def best_order(masks: list[tuple[int, int]], costs: list[float]) -> list[int]:
    """Rules by rejections per cost, each counted on what the ones before it leave.

    ``masks`` are (bits of the rules that reject, documents). Ties go to the rule named first.
    """
    left, order = list(range(len(costs))), []
    while left:
        gain = {r: sum(n for bits, n in masks if bits >> r & 1) / costs[r] for r in left}
        best = max(left, key=lambda r: (gain[r], -r))
        order.append(best)
        left.remove(best)
        masks = [(bits, n) for bits, n in masks if not bits >> best & 1]
    return order


def plan(docs: DataFrame, rules: tuple[Rule, ...], report: tuple[str, ...], text: str, measures: dict[str, Measure],
         sample_rows: int = SAMPLE_ROWS) -> list[int]:
    """Order of the rules, from a sample of about ``sample_rows`` documents."""
    total = docs.count()
    if not total:
        return list(range(len(rules)))
    picked = docs.select(F.col(f"`{text}`").alias(text)).sample(min(1.0, sample_rows / total), seed=7)
    # A scan has a task for every file part; the sample is brought together in a few.
    sample = staged(measured(staged(picked.repartition(4), "cascade-sample"), report, text, measures), "cascade-measures")
    ask = _asked(report, measures)
    tests = [F.coalesce(r.rejects(ask), F.lit(False)) for r in rules]
    bits = sum((t.cast("bigint") * (1 << i) for i, t in enumerate(tests)), F.lit(0).cast("bigint"))
    masks = [(r["bits"], r["count"]) for r in sample.groupBy(bits.alias("bits")).count().collect()]

    def seconds(test: Column) -> float:
        took = []
        for _ in range(TRIALS):
            start = time.perf_counter()
            sample.agg(F.count_if(test)).collect()
            took.append(time.perf_counter() - start)
        return min(took)

    idle = seconds(F.octet_length("_text") < 0)
    return best_order(masks, [max(seconds(t) - idle, 1e-3) for t in tests])


def screen(docs: DataFrame, rules: tuple[Rule, ...] = RULES, report: tuple[str, ...] = (), text: str = "text",
           measures: dict[str, Measure] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc, measure, rejected_by, kept): each row in a struct, the reported measures, the rule that rejected it or NULL.

    Measures that are reported are taken for every row and rules reuse them; all others are taken only where the cascade gets to
    their rule. One row per input row, repeated ones too; NULL text is empty; an empty table gives no rows. When several
    rules reject a document, the first in the measured order is named, so ``rejected_by`` may differ between runs and
    ``kept`` may not.
    """
    measures = measures or MEASURES
    order = plan(docs, rules, report, text, measures, sample_rows)
    ask = _asked(report, measures)
    verdict = F.lit(None).cast("string")
    for i in reversed(order):
        verdict = F.when(F.coalesce(rules[i].rejects(ask), F.lit(False)), F.lit(rules[i].name)).otherwise(verdict)
    judged = measured(docs, report, text, measures).select("doc", "measure", verdict.alias("rejected_by"))
    return judged.withColumn("kept", F.col("rejected_by").isNull())
