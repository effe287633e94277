"""Quality rules: a learned decision list over document statistics.

Statistics come from one vectorised pass. Rules are learned by sequential
covering on a bounded sample of labelled documents: a conjunction of
thresholds is grown on two thirds of the sample by information gain, pruned on
the rest, kept if it is precise enough there, and the rows it covers are
removed before the next one is grown. The ordered rules become one Spark CASE
expression, so applying them is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm import kernels as K
from corpuslab.llm import columns, scratch

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_bytes", "n_upper", "n_digits", "n_marks")
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
MARK = np.zeros(256, dtype=bool)
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

#: Features of the rules, each a ratio so that they do not depend on length alone.
FEATURES = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
}


def _sums(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[bounds])


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = K.text_buffers(column)
    n = len(offsets) - 1
    out = {c: np.zeros(n, np.int64) for c in (*COUNTS, *MORE)}
    for i, j in K.chunks(offsets):
        w = K.Words(data, offsets, i, j)
        at = slice(i, j)
        b, bounds = w.bytes, w.bounds
        out["n_words"][at] = w.counts
        out["n_bytes"][at] = np.diff(bounds)
        out["word_chars"][at] = _sums(~K.SPACE[b] & ((b & 0xC0) != 0x80), bounds)
        for name, table in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_digits", DIGIT), ("n_marks", MARK)):
            out[name][at] = _sums(table[b], bounds)
        out["n_lines"][at] = _sums(b == 10, bounds) + 1
        raw = b.tobytes()
        for r in range(j - i):
            lines = raw[bounds[r] : bounds[r + 1]].split(b"\n")
            if len(lines) > 1:
                lines = [x for x in lines if not x.isspace() and x]
                out["n_dup_lines"][i + r] = len(lines) - len(set(lines))
        h = w.hashes()
        if len(h) >= 3:
            ok = K.inside(w.first, 3, len(h))
            starts = np.flatnonzero(ok)
            key = K.gram_hashes(h, 3)[starts] ^ K.mix64(w.row[starts].astype(K.U64) + K.U64(1))
            order = np.argsort(key)
            s = key[order]
            same = s[1:] == s[:-1]
            again = np.zeros(len(s), dtype=bool)
            again[1:] |= same
            again[:-1] |= same
            hit = np.zeros(len(h), dtype=bool)
            at3 = starts[order[again]]
            for step in range(3):
                hit[at3 + step] = True
            out["n_repeat_words"][at] = _sums(hit, w.first)
    return out


COUNTS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in (*COUNTS, *MORE)])


@F.arrow_udf(COUNTS_TYPE)
def _text_counts(text: pa.Array) -> pa.Array:
    got = text_counts(text)
    K.tidy()
    return pa.StructArray.from_arrays([pa.array(v) for v in got.values()], names=list(got))


def counts(text: Column) -> Column:
    """A struct of the base counts of a text; null counts as empty."""
    return _text_counts(text)


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, c: Column) -> Column:
        top, under = FEATURES[self.feature]
        value = F.try_divide(c[top].cast("double"), c[under].cast("double"))
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; a text that meets all conditions of any rule is rejected."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def rejects(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(next(iter(x.values()))), dtype=bool)
        for rule in self.rules:
            out |= np.logical_and.reduce([c.mask(x) for c in rule])
        return out

    def verdict(self, c: Column) -> Column:
        """CASE WHEN rule 1 THEN false WHEN rule 2 THEN false ... ELSE true."""
        out = None
        for rule in self.rules:
            met = F.lit(True)
            for condition in rule:
                met = met & condition.column(c)
            out = F.when(met, False) if out is None else out.when(met, False)
        return F.lit(True) if out is None else out.otherwise(True)


def features(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    with np.errstate(divide="ignore", invalid="ignore"):
        return {k: rows[a].astype(float) / rows[b].astype(float) for k, (a, b) in FEATURES.items()}


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray, live: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold with the largest information gain among the rows still covered."""
    p0, n0 = (bad & live).sum(), (~bad & live).sum()
    before = np.log2(p0 / (p0 + n0))
    best, found = 0.0, None
    for name, values in x.items():
        v, y = values[live], bad[live]
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        p, n = np.cumsum(y)[cut], np.cumsum(~y)[cut]
        for above in (False, True):
            pp, nn = (p0 - p, n0 - n) if above else (p, n)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - before), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best + 1e-9:
                best, found = float(gain[k]), Condition(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return best, found


def _covered(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return np.logical_and.reduce([c.mask(x) for c in rule]) if rule else np.ones(n, dtype=bool)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, max_rules: int = 16, min_precision: float = 0.95, min_cover: int = 2) -> DecisionList:
    """Sequential covering; every third row is held back to prune with.

    Rows must come in an order unrelated to the label (here: hash order).
    """
    ok = np.isfinite(np.stack(list(x.values()))).all(axis=0) if len(bad) else np.zeros(0, dtype=bool)
    x, bad = {k: v[ok] for k, v in x.items()}, bad[ok]
    held = np.arange(len(bad)) % 3 == 2
    grow_x, grow_y = {k: v[~held] for k, v in x.items()}, bad[~held]
    test_x, test_y = {k: v[held] for k, v in x.items()}, bad[held]
    left, left_test, rules = np.ones(len(grow_y), dtype=bool), np.ones(len(test_y), dtype=bool), []
    while len(rules) < max_rules and (grow_y & left).sum() >= min_cover:
        rule: list[Condition] = []
        live = left.copy()
        while (~grow_y & live).any() and len(rule) < 6:
            gain, condition = _best_condition(grow_x, grow_y, live)
            if condition is None:
                break
            rule.append(condition)
            live &= condition.mask(grow_x)
        if not rule:
            break

        def worth(r: list[Condition]) -> float:
            got = _covered(r, test_x, len(test_y)) & left_test
            p, n = (test_y & got).sum(), (~test_y & got).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        got, got_test = _covered(rule, grow_x, len(grow_y)) & left, _covered(rule, test_x, len(test_y)) & left_test
        p = (grow_y & got).sum() + (test_y & got_test).sum()
        n = (~grow_y & got).sum() + (~test_y & got_test).sum()
        if p < min_cover or p < min_precision * (p + n) or worth(rule) < 0:
            break
        rules.append(tuple(rule))
        left &= ~got
        left_test &= ~got_test
    return DecisionList(tuple(rules))


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000
) -> DecisionList:
    """Learn from at most ``max_labelled`` labelled documents, those with the least id hash.

    Null ids and labels do not count; conflicting labels of one id count as the
    worst. With no labels, or labels of one class, the list is empty.
    """
    scratch.small_batches(docs.sparkSession, scratch.BATCH_BYTES)
    key, label = columns.col(id_col), columns.col(label_col)
    votes = labels.where(key.isNotNull() & label.isNotNull()).groupBy(key.alias("__id")).agg(F.min(label).alias("__y"))
    votes = votes.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    texts = docs.select(columns.col(id_col).alias("__id"), columns.col(text_col).alias("__text")).join(F.broadcast(votes), "__id")
    # Written first: else the filter on the counts goes below the join, and all texts of the corpus are counted,
    # and each task counts in two Python workers, once for the filter and once for what passes it.
    counted = scratch.stage(texts.select("__id", "__y", counts(F.col("__text")).alias("c")), "labelled-counts")
    seen = counted.where(~base_failed(F.col("c"))).groupBy("__id").agg(F.first("__y").alias("__y"), F.min_by("c", F.col("c.n_words")).alias("c"))
    rows = seen.select("__id", "__y", "c.*").toPandas()
    scratch.discard(counted)
    if not len(rows):
        return DecisionList()
    rows["o"] = (rows["__id"].to_numpy().astype("int64").view("uint64") * np.uint64(0x9E3779B97F4A7C15)).view("uint64")
    rows = rows.sort_values("o")
    bad = rows["__y"].to_numpy() == 0
    if bad.all() or not bad.any():
        return DecisionList()
    return learn(features({c: rows[c].to_numpy() for c in (*COUNTS, *MORE)}), bad)


def judge(docs: DataFrame, rules: DecisionList, *, text_col: str = "text") -> DataFrame:
    """``docs`` and, as the last three columns, ``__counts``, ``__base_failed`` and ``__kept``.

    A null, empty or blank text has no words and fails the base rules. Columns
    of ``docs`` pass through; where one has such a name, the new column gets
    underscores at its end (``columns.fresh`` gives the names). Repeated rows
    are judged one by one; an empty table gives an empty table.
    """
    c, failed, kept = columns.fresh(docs, "__counts", "__base_failed", "__kept")
    out = docs.withColumn(c, counts(columns.col(text_col)))
    out = out.withColumn(failed, base_failed(F.col(c)))
    return out.withColumn(kept, ~F.col(failed) & rules.verdict(F.col(c)))
