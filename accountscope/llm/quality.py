"""Quality rules: an ordered decision list of threshold conjunctions, learned by sequential covering.

Every rule says "reject". Grown one condition at a time for the best gain over the labelled documents that no earlier
rule covers, pruned on the third of them that growing didn't see, and kept only where its smoothed precision on all
of them is high; then the next rule. All counts are Spark aggregates over a narrow table of bin numbers; the driver
sees one small row per measure and bin.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountscope.llm.common import SPACES, let, or_empty, pairs_of
from accountscope.session import materialise

#: Measures that rules may use, each from the facts of a text.
MEASURES = {
    "n_words": lambda f: f["n_words"].cast("double"),
    "word_length": lambda f: F.try_divide(f["word_chars"], f["n_words"]),
    "symbol_share": lambda f: F.try_divide(f["n_symbols"], f["word_chars"]),
    "dup_line_share": lambda f: F.try_divide(f["n_dup_lines"], f["n_lines"]),
    "repeat_word_share": lambda f: F.try_divide(f["n_repeat_words"], f["n_words"]),
    "capital_share": lambda f: F.try_divide(f["n_capitals"], f["word_chars"]),
    "punctuation_share": lambda f: F.try_divide(f["n_punctuation"], f["word_chars"]),
    "digit_share": lambda f: F.try_divide(f["n_digits"], f["word_chars"]),
    "line_words": lambda f: F.try_divide(f["n_words"], f["n_lines"]),
}


@dataclass(frozen=True)
class CoverConfig:
    """Settings of the covering search.

    sample_rows bounds the labelled rows fitted on (chosen by a hash of the id, so that reruns agree); cuts is the
    number of candidate thresholds of a measure; precision is what a rule must reach on growing and pruning rows.
    """

    sample_rows: int = 20_000
    cuts: int = 24
    max_rules: int = 8
    max_conditions: int = 3
    precision: float = 0.92
    min_covered: int = 5


@dataclass(frozen=True)
class Condition:
    """``measure > cut`` or ``measure <= cut``."""

    measure: str
    above: bool
    cut: float

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.cut:g}"


Rule = tuple[Condition, ...]


def _without(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, ""))


def _repeat_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, the first occurrence included.

    Windows are compared by 64-bit hashes. Only texts in which one repeats are sorted to find where.
    """
    windows = F.when(F.size(ws) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
    )).otherwise(F.array().cast("array<bigint>"))

    def starts(hs: Column) -> Column:
        """Positions of windows that are not alone, ascending."""
        def twins(s: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(
                (F.get(s, i)["h"] == F.get(s, i - 1)["h"]) | (F.get(s, i)["h"] == F.get(s, i + 1)["h"]),
                F.get(s, i)["h"] == F.get(s, i - 1)["h"], F.get(s, i)["h"] == F.get(s, i + 1)["h"], F.lit(False)))
            return F.sort_array(F.transform(at, lambda i: F.get(s, i)["i"]))

        return let(F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twins)

    def covered(at: Column) -> Column:
        steps = F.transform(pairs_of(at), lambda i: F.least(F.lit(3), F.get(at, i) - F.get(at, i - 1)))
        return F.when(F.size(at) > 0, F.aggregate(steps, F.lit(3).cast("bigint"), lambda a, x: a + x)).otherwise(F.lit(0).cast("bigint"))

    return let(windows, lambda hs: F.when(
        F.size(F.array_distinct(hs)) < F.size(hs), let(starts(hs), covered)).otherwise(F.lit(0).cast("bigint")))


def facts(text: Column) -> Column:
    """Counts of one whole text as a struct of longs; NULL has none of anything (and no line with a word)."""
    t = or_empty(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def long(x: Column, name: str) -> Column:
        return x.cast("bigint").alias(name)

    return let(F.array_remove(F.split(t, SPACES), ""), lambda ws: let(lines, lambda ls: F.struct(
        long(F.size(ws), "n_words"),
        long(_without(t, SPACES), "word_chars"),
        long(_without(t, r"[^#*$%&|<>]+"), "n_symbols"),
        long(F.size(ls) - F.size(F.array_distinct(ls)), "n_dup_lines"),
        long(_repeat_words(ws), "n_repeat_words"),
        long(F.size(ls), "n_lines"),
        long(_without(t, r"\P{Lu}+"), "n_capitals"),
        long(_without(t, r"\P{P}+"), "n_punctuation"),
        long(_without(t, r"[^0-9]+"), "n_digits"),
    )))


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def measures(f: Column) -> Column:
    """Array of measures in the order of ``MEASURES``; undefined ones (no words) are 0."""
    return F.array(*[F.coalesce(m(f), F.lit(0.0)) for m in MEASURES.values()])


def condition(c: Condition, values: Column) -> Column:
    value = F.get(values, F.lit(list(MEASURES).index(c.measure)))
    return value > c.cut if c.above else value <= c.cut


def rule_number(rules: list[Rule], values: Column) -> Column:
    """The decision list as one conditional expression: number of the first rule that holds, else NULL."""
    out = None
    for k, rule in enumerate(rules):
        holds = condition(rule[0], values)
        for c in rule[1:]:
            holds = holds & condition(c, values)
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(None).cast("int") if out is None else out


def labelled_sample(docs: DataFrame, labels: DataFrame, cfg: CoverConfig, id_col: str = "doc_id") -> DataFrame:
    """At most about ``cfg.sample_rows`` labelled documents: ``id, values, bad, failed``. One label per id, the worst."""
    one = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(
        F.col(id_col).alias("id")).agg((F.min("quality") == 0).alias("bad"))
    n = one.count()
    share = min(1.0, cfg.sample_rows / n) if n else 1.0
    chosen = one.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # Broadcast: bounded by the sample size.
    known = docs.select(F.col(id_col).alias("id"), F.col("text").alias("text")).join(F.broadcast(chosen), "id")
    known = known.select("id", facts(F.col("text")).alias("f"), "bad")
    return known.select("id", measures(F.col("f")).alias("values"), "bad", base_failed(F.col("f")).alias("failed"))


def learn(sample: DataFrame, cfg: CoverConfig | None = None) -> list[Rule]:
    """Rules in order, from ``id, values, bad, failed``. No bad or no good rows that pass the base limits: no rules."""
    cfg = cfg or CoverConfig()
    # Written first and filtered then: pushed below the join, the filter would measure every text.
    kept = materialise(sample, "quality-sample").where("NOT failed")
    points = kept.agg(*[F.percentile_approx(F.get("values", F.lit(i)), [k / cfg.cuts for k in range(cfg.cuts + 1)], 10_000)
                        for i in range(len(MEASURES))],
                      *[F.percentile_approx(F.when(F.col("bad"), F.get("values", F.lit(i))), [k / cfg.cuts for k in range(cfg.cuts + 1)], 10_000)
                        for i in range(len(MEASURES))]).first()
    m = len(MEASURES)
    # Cuts lie midway between neighbouring quantiles of all rows and of bad rows, so that they keep a margin.
    marks = [sorted(set(points[i] or []) | set(points[i + m] or [])) for i in range(m)]
    cuts = [[(a + b) / 2 for a, b in zip(x, x[1:])] for x in marks]
    if not any(cuts):
        return []

    def bin_of(i: int) -> Column:
        value = F.get("values", F.lit(i))
        return F.size(F.filter(F.lit([float(c) for c in cuts[i]]), lambda c: c < value)) if cuts[i] else F.lit(0)

    grow = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)) != 0
    binned = materialise(kept.select("id", F.array(*[bin_of(i) for i in range(m)]).alias("bins"), "bad",
                                     grow.alias("grow")).coalesce(4), "quality-bins")

    def counts(rows: DataFrame) -> dict:
        """(measure, bin, bad, grow) -> rows: a bounded table whatever the number of rows."""
        cells = rows.select("bad", "grow", F.posexplode("bins").alias("m", "b")).groupBy("m", "b", "bad", "grow").count()
        return {(r["m"], r["b"], r["bad"], r["grow"]): r["count"] for r in cells.collect()}

    def total(cells: dict, bad: bool, parts: tuple) -> int:
        return sum(n for (i, _, x, g), n in cells.items() if i == 0 and x == bad and g in parts)

    def covers(cond: tuple[int, int, bool]) -> Column:
        i, b, above = cond
        value = F.get("bins", F.lit(i))
        return value > b if above else value <= b

    def side(cells: dict, cond: tuple[int, int, bool], parts: tuple) -> tuple[int, int]:
        i, b, above = cond
        hit = [(x, n) for (j, c, x, g), n in cells.items() if j == i and g in parts and (c > b) == above]
        return sum(n for x, n in hit if x), sum(n for x, n in hit if not x)

    rules: list[Rule] = []
    left = binned
    for _ in range(cfg.max_rules):
        cells = counts(left)
        rule: list[tuple[int, int, bool]] = []
        history = []  # pruning counts after each condition
        while len(rule) < cfg.max_conditions:
            p0, n0 = total(cells, True, (True,)), total(cells, False, (True,))
            if not p0 or not n0:
                break
            best, gain = None, 1e-9
            for i in range(m):
                for b in range(len(cuts[i])):
                    for above in (True, False):
                        p, n = side(cells, (i, b, above), (True,))
                        if p < cfg.min_covered or (p, n) == (p0, n0):
                            continue
                        g = p * (math.log2((p + 1) / (p + n + 2)) - math.log2((p0 + 1) / (p0 + n0 + 2)))
                        if g > gain:
                            best, gain = (i, b, above), g
            if best is None:
                break
            rule.append(best)
            history.append((side(cells, best, (False,)), side(cells, best, (True, False))))
            hit = left
            for cond in rule:
                hit = hit.where(covers(cond))
            cells = counts(hit)
        if not rule:
            break
        # Prune: the shortest beginning that is best on the rows that growing didn't see.
        def worth(k: int) -> float:
            p, n = history[k][0]
            return (p - n) / (p + n + 2)

        keep = max(range(len(rule)), key=lambda k: (round(worth(k), 6), -k))
        p, n = history[keep][1]
        if p < cfg.min_covered or (p + 1) / (p + n + 2) < cfg.precision:
            break
        rule = rule[: keep + 1]
        names = list(MEASURES)
        # Bin numbers count the cuts below a value: bin > b means value > cuts[b].
        rules.append(tuple(Condition(names[i], above, float(cuts[i][b])) for i, b, above in rule))
        gone = covers(rule[0])
        for cond in rule[1:]:
            gone = gone & covers(cond)
        left = left.where(~gone)
    return rules


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, ``base_failed``, ``rule`` (NULL: none fired) and ``kept``."""
    f = F.col("f")
    own = docs.select(F.col(id_col).alias("id"), facts(F.col(text_col)).alias("f"))
    own = own.withColumn("rule", let(measures(f), lambda v: rule_number(rules, v)))
    return own.select(
        F.col("id").alias(id_col), *[f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(f).alias("base_failed"), (~base_failed(f) & F.col("rule").isNull()).alias("kept"), "rule")


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that no base limit and no rule rejects."""
    # One expression, so that the counts are made once: as a column, the filter would take on a copy for every use.
    return docs.where(let(facts(F.col(text_col)), lambda f: ~base_failed(f) & let(
        measures(f), lambda v: rule_number(rules, v)).isNull()))
