"""Quality rules (6): a learned decision list over text statistics, emitted as ordered Spark conditions.

Statistics are DataFrame expressions on whole texts. The list is grown by sequential covering on a bounded sample of
labelled rows (``most_labelled``, the rows of smallest id hash outside the held-out fold): a rule's threshold conditions are added by
information gain on two thirds of the sample, its last conditions pruned on the other third, and it is kept only if it is
precise there. No Python runs on the executors.

Null texts count as empty (no words: the base rule fails them); long texts are read whole, in time that grows with their length
(n log n where they repeat themselves); repeated rows are judged alike and teach as often as they come; the first rule that
holds names the verdict, so rules never tie. An empty table gives no rows, and without labels the list is empty, so only the
base rule rejects. Columns beside id and text are passed through; the statistics and verdicts replace columns of the same names,
inner columns get names that no other has. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import is_held_out

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test: name -> numerator and denominator over the statistics.
FEATURES = {
    "n_words": ("n_words", None),
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_lines": ("n_dup_lines", None),
    "repeated_share": ("n_repeat_words", "n_words"),
}


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the five statistics of each whole text.

    Each array is a column of its own before it is indexed, so it is built once a row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = "_"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    w, x, y, z, g = (mark + c for c in ("words", "lines", "windows", "sorted", "again"))
    a = df.withColumns({w: F.array_remove(F.split(text, SPACES, -1), "")})
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    last = F.size(w) - 3
    at = lambda i: F.get(F.col(w), i)
    a = a.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        x: lines,
        y: F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).otherwise(F.array().cast("array<bigint>")),
    }).drop(w)
    a = a.withColumns({
        "n_dup_lines": (F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        z: F.when(F.size(y) > F.size(F.array_distinct(y)), F.sort_array(F.transform(y, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    }).drop(x, y)
    hash_at = lambda k: F.get(F.col(z), k).getField("h")
    again = F.filter(z, lambda e, k: F.coalesce(e["h"] == F.when(k > 0, hash_at(k - 1)), F.lit(False)) | F.coalesce(e["h"] == hash_at(k + 1), F.lit(False)))
    a = a.withColumn(g, F.sort_array(F.transform(again, lambda e: e["i"]))).drop(z)
    covered = F.transform(g, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col(g), k + 1) - p, F.lit(3))))
    total = F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda s, v: s + v), F.lit(0).cast("long"))
    # a filter on this column must not be pushed below the columns above, which would put their expressions into its lambdas
    return a.withColumn("n_repeat_words", F.when(F.monotonically_increasing_id() >= 0, total).otherwise(total)).drop(g)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    value = F.col(top).cast("double")
    return value if bottom is None else F.coalesce(value / F.nullif(F.col(bottom).cast("double"), F.lit(0.0)), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return (row[self.name] > self.threshold) == self.above

    def column(self) -> Column:
        return feature(self.name) > self.threshold if self.above else feature(self.name) <= self.threshold


Rule = tuple[Condition, ...]


def learn_rules(rows: Sequence[dict[str, float]], bad: Sequence[bool], most_rules: int = 12, least_precision: float = 0.9, cuts: int = 40) -> list[Rule]:
    """Rules whose conjunctions find bad rows, in the order in which they were found."""
    covers = lambda rule, r: all(c.holds(r) for c in rule)
    left = list(range(len(rows)))
    rules: list[Rule] = []
    while len(rules) < most_rules:
        grow, prune = [i for i in left if i % 3], [i for i in left if i % 3 == 0]
        if sum(bad[i] for i in grow) < 5:
            break
        rule: Rule = ()
        inside = grow
        while any(not bad[i] for i in inside) and len(rule) < 4:
            p0 = sum(bad[i] for i in inside)
            before, best = math.log2(p0 / len(inside)), (1e-9, None)
            for name in FEATURES:
                values = sorted({rows[i][name] for i in inside})
                step = max(1, len(values) // cuts)
                for lower, upper in zip(values[::step], values[1::step], strict=False):
                    for above in (True, False):
                        c = Condition(name, above, (lower + upper) / 2)
                        kept = [i for i in inside if c.holds(rows[i])]
                        p = sum(bad[i] for i in kept)
                        if p >= 3:
                            gain = p * (math.log2(p / len(kept)) - before)
                            if gain > best[0]:
                                best = (gain, c)
            if best[1] is None:
                break
            rule = (*rule, best[1])
            inside = [i for i in inside if best[1].holds(rows[i])]
        if not rule:
            break

        def worth(k: int, rule: Rule = rule, prune: list[int] = prune) -> tuple[float, int]:
            hit = [i for i in prune if covers(rule[:k], rows[i])]
            p = sum(bad[i] for i in hit)
            return ((2 * p - len(hit)) / len(hit) if hit else -1.0, -k)

        rule = rule[: max(range(1, len(rule) + 1), key=worth)]
        hit = [i for i in left if covers(rule, rows[i])]
        tested = [i for i in hit if i % 3 == 0]
        if not hit or sum(bad[i] for i in hit) < least_precision * len(hit) or sum(bad[i] for i in tested) < least_precision * len(tested):
            break
        rules.append(rule)
        gone = set(hit)
        left = [i for i in left if i not in gone]
    return rules


def rejecting(rules: Sequence[Rule]) -> Column:
    """The number of the first rule that holds, as one ordered conditional expression; null if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None).cast("int"))


def labelled_statistics(docs: DataFrame, labels: DataFrame, most_labelled: int = 3000) -> DataFrame:
    """The statistics and label of at most ``most_labelled`` labelled documents outside the held-out fold."""
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~is_held_out())
        .select("doc_id", (F.col("quality") == 0).alias("bad"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_labelled)
    )
    return with_statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")).drop("text")


def learn_from(docs: DataFrame, labels: DataFrame, most_labelled: int = 3000, **how) -> list[Rule]:
    found = labelled_statistics(docs, labels, most_labelled).select("doc_id", "bad", base_failed().alias("failed"), *(feature(n).alias(n) for n in FEATURES if n != "n_words"), F.col("n_words").cast("double").alias("n_words")).collect()
    found = sorted((r for r in found if not r["failed"]), key=lambda r: r["doc_id"])
    return learn_rules([r.asDict() for r in found], [r["bad"] for r in found], **how)


def judge(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``rule`` (its number in the list, or null) and ``kept``."""
    return with_statistics(docs, text_col).withColumn("base_failed", base_failed()).withColumn("rule", rejecting(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
