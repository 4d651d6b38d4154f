"""Quality rules: decision lists learned from labelled statistics, given out as ordered Spark conditions.

A first pass makes statistics of every text.  Sequential covering then learns rules from labelled ones: a rule grows by
the threshold that gains most, is pruned on rows held out from growing, and takes the rows that it covers out of the
next rule's way.  The list becomes one conditional expression over the statistics, so judging is a projection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .common import bounded, lean
from .shingles import numbered, spans

#: Labelled rows that a list is learned from, those with the least hash of their id.  The bound of the sample.
MOST_LABELLED = 20_000
#: Words of the windows that tell repetition.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_marks", "n_letters"]

#: The ratios that rules may ask about.
RATIOS: dict[str, tuple[str, str]] = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "n_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "upper_share": ("n_upper", "n_chars"),
    "digit_share": ("n_digits", "n_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "letter_share": ("n_letters", "n_chars"),
    "words_per_line": ("n_words", "n_lines"),
}


def _per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[ends[1:]] - sums[ends[:-1]]


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _MARK, _DIGIT = _table(SYMBOLS), _table(MARKS), _table("0123456789")


def _twice(words: np.ndarray) -> np.ndarray:
    """Whether each window of WINDOW words comes twice or more; words are numbers."""
    h = shingles.runs(words, WINDOW)
    order = np.argsort(h, kind="stable")
    a, b = order[:-1], order[1:]
    same = h[a] == h[b]
    a, b = a[same], b[same]
    if any((words[a + k] != words[b + k]).any() for k in range(WINDOW)):  # hashes alike, words not
        _, inverse, counts = np.unique(np.lib.stride_tricks.sliding_window_view(words, WINDOW), axis=0, return_inverse=True, return_counts=True)
        return counts[inverse.ravel()] > 1
    out = np.zeros(len(h), dtype=bool)
    out[a] = out[b] = True
    return out


def statistics_of(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS for each text of a column; all 0 for null and empty texts.

    Characters are code points and words runs without blanks; n_lines counts lines with a word, n_dup_lines those of them
    that are equal to an earlier line, n_repeat_words the words in windows of WINDOW words that come twice or more in the
    text.  Upper-case and letters are told for Latin letters; others count as neither.
    """
    data, ends = shingles.texts_of(column)
    out: dict[str, np.ndarray] = {}
    lead = (data & 0xC0) != 0x80
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    out["n_chars"] = _per_text(lead, ends)
    out["word_chars"] = out["n_chars"] - _per_text(blank, ends)
    out["n_symbols"], out["n_marks"], out["n_digits"] = (_per_text(t[data], ends) for t in (_SYMBOL, _MARK, _DIGIT))
    after_c3 = np.concatenate([[False], data[:-1] == 0xC3]) if len(data) else np.empty(0, dtype=bool)
    upper = ((data >= 65) & (data <= 90)) | (after_c3 & (data >= 0x80) & (data <= 0x9E) & (data != 0x97))
    lower = ((data >= 97) & (data <= 122)) | (after_c3 & (data >= 0x9F) & (data != 0xB7))
    out["n_upper"], out["n_letters"] = _per_text(upper, ends), _per_text(upper | lower, ends)

    starts, stops = spans(data, ends)
    words, _ = numbered(data, starts, stops)
    bounds = np.searchsorted(starts, ends)
    out["n_words"] = np.diff(bounds)
    n_texts = len(column)
    # lines: from one line feed, or the start of the text, to the next
    feeds = np.flatnonzero(data == 10)
    line_starts = np.union1d(ends[:-1], feeds + 1)
    line_starts = line_starts[line_starts < len(data)]
    line_stops = np.minimum(np.concatenate([line_starts[1:], [len(data)]]) if len(line_starts) else line_starts, len(data))
    worded = np.searchsorted(starts, line_stops) > np.searchsorted(starts, line_starts)
    line_starts, line_stops = line_starts[worded], line_stops[worded]
    ended = data[line_stops - 1] == 10 if len(line_stops) else np.empty(0, dtype=bool)
    lines, _ = numbered(data, line_starts, line_stops - ended)
    line_bounds = np.searchsorted(line_starts, ends)
    out["n_lines"] = np.diff(line_bounds)

    distinct, repeated, dup_lines = (np.zeros(n_texts, dtype=np.int64) for _ in range(3))
    for i in range(n_texts):
        a, b = bounds[i], bounds[i + 1]
        distinct[i] = len(np.unique(words[a:b]))
        if b - a > WINDOW and distinct[i] < b - a:
            twice = np.flatnonzero(_twice(words[a:b]))
            if len(twice):
                edges = np.zeros(b - a + 1, dtype=np.int64)
                np.add.at(edges, twice, 1)
                np.add.at(edges, twice + WINDOW, -1)
                repeated[i] = np.count_nonzero(np.cumsum(edges)[:-1])
        a, b = line_bounds[i], line_bounds[i + 1]
        if b - a > 1:
            dup_lines[i] = b - a - len(np.unique(lines[a:b]))
    out["n_distinct_words"], out["n_repeat_words"], out["n_dup_lines"] = distinct, repeated, dup_lines
    return out


def with_statistics(docs: DataFrame, out: str = "stats", text_col: str = "text") -> DataFrame:
    """docs, all columns kept, with a struct `out` of COUNTS; a column of that name is replaced."""
    docs = docs.drop(out)
    fields = ", ".join(f"{c}: bigint" for c in COUNTS)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                made = statistics_of(batch.column(names.index(text_col)))
                struct = pa.StructArray.from_arrays([pa.array(made[c].astype(np.int64)) for c in COUNTS], names=COUNTS)
                yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*names, out])

    return bounded(docs).mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(out, T._parse_datatype_string(f"struct<{fields}>"))]))


def base_failed(stats: str = "stats") -> Column:
    """Too short, or more than 30 % of the words in repeated windows."""
    n, repeated = F.col(stats)["n_words"], F.col(stats)["n_repeat_words"]
    return (n < 20) | (100 * repeated > 30 * n)


def ratio(name: str, stats: str = "stats") -> Column:
    """A ratio of RATIOS over statistics; 0 where what it divides by is 0."""
    top, bottom = RATIOS[name]
    return F.coalesce(F.col(stats)[top] / F.nullif(F.col(stats)[bottom], F.lit(0)), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    """A ratio at or beyond a threshold."""

    name: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.name] >= self.threshold if self.above else values[self.name] <= self.threshold

    def column(self, stats: str) -> Column:
        value = ratio(self.name, stats)
        return value >= F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Rules in order; the first whose conditions all hold rejects a document, and one that none covers is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rejects(self, values: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(next(iter(values.values()))), dtype=bool)
        for rule in self.rules:
            out |= np.logical_and.reduce([c.holds(values) for c in rule])
        return out

    def kept(self, stats: str = "stats") -> Column:
        """The list as conditions in order, over a struct of statistics."""
        out = F.lit(True)
        for rule in reversed(self.rules):
            test = rule[0].column(stats)
            for condition in rule[1:]:
                test = test & condition.column(stats)
            out = F.when(test, F.lit(False)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join([*(f"reject if {' and '.join(map(str, r))}" for r in self.rules), "keep"])


def ratios_of(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out = {}
    for name, (top, bottom) in RATIOS.items():
        below = np.asarray(counts[bottom], dtype=float)
        out[name] = np.divide(np.asarray(counts[top], dtype=float), below, out=np.zeros(len(below)), where=below != 0)
    return out


def _best_condition(values: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> tuple[float, Condition | None]:
    """The condition with the greatest information gain for bad rows among `rows`."""
    p0, n0 = bad[rows].sum(), (~bad[rows]).sum()
    best, found = 1e-9, None
    before = np.log2(p0 / (p0 + n0))
    for name, column in values.items():
        v = column[rows]
        order = np.argsort(v, kind="stable")
        ordered, flags = v[order], bad[rows][order]
        ends = np.flatnonzero(np.concatenate([ordered[1:] != ordered[:-1], [False]]))  # between unequal neighbours
        if not len(ends):
            continue
        p, n = np.cumsum(flags)[ends], np.cumsum(~flags)[ends]
        middle = (ordered[ends] + ordered[ends + 1]) / 2
        for above, (pp, nn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
            gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1) / np.maximum(pp + nn, 1)) - before), -1)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = float(gain[k]), Condition(name, above, float(middle[k]))
    return best, found


def learn(values: dict[str, np.ndarray], bad: np.ndarray, held_out: np.ndarray, most_conditions: int = 4, most_rules: int = 12, least_precision: float = 0.95, least_covered: int = 5) -> DecisionList:
    """A list that rejects bad rows: rules grow on rows not held out and are pruned and accepted on those that are.

    values: ratios by name; bad, held_out: flags.  A rule is kept if it covers held-out rows and at least least_precision
    of them are bad; the first that is not ends the list.  Of equal gains the first ratio's, and there the lower threshold,
    is taken.  One class only gives an empty list.
    """
    left = np.ones(len(bad), dtype=bool)
    out = DecisionList()
    while len(out.rules) < most_rules:
        grow = np.flatnonzero(left & ~held_out)
        if bad[grow].sum() < least_covered or not (~bad[grow]).any():
            break
        rule, rows = [], grow
        while len(rule) < most_conditions and (~bad[rows]).any():
            _, condition = _best_condition(values, bad, rows)
            if condition is None:
                break
            rule.append(condition)
            rows = rows[condition.holds({k: v[rows] for k, v in values.items()})]
        if not rule:
            break

        def worth(conditions: list[Condition]) -> tuple[float, int, int]:
            covered = np.logical_and.reduce([c.holds(values) for c in conditions]) & left
            p, n = (int((covered & held_out & f).sum()) for f in (bad, ~bad))
            return (p - n) / (p + n) if p + n else -1.0, p, n

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: worth(r)[0])
        covered = np.logical_and.reduce([c.holds(values) for c in rule]) & left
        _, p, n = worth(rule)
        if p + n == 0 or int((covered & bad).sum()) < least_covered or p < least_precision * (p + n):
            break
        out.rules.append(rule)
        left &= ~covered
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_labelled: int = MOST_LABELLED) -> DecisionList:
    """Learns a list from labelled documents (label 0: to be rejected).

    Null labels and ids are left out, and rows that the base rules fail anyway.  Of repeated labels of an id the mean
    counts, of rows with one id that with the least statistics.  At most most_labelled labelled ids are taken, those with
    the least hash; a third of them, by another hash, is held out for pruning.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg((F.avg(F.col(label_col)) < 0.5).alias("bad"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    told = with_statistics(rows).where(~base_failed()).groupBy("doc_id", "bad").agg(F.min("stats").alias("stats"))
    table = told.select("doc_id", "bad", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)).alias("fold"), "stats.*").toPandas()  # at most the sample's rows
    if not len(table):
        return DecisionList()
    table = table.sort_values("doc_id", kind="stable")
    return learn(ratios_of({c: table[c].to_numpy() for c in COUNTS}), table["bad"].to_numpy(dtype=bool), table["fold"].to_numpy() == 0)


def judged(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """docs with a struct stats, base_failed and kept, in place of columns of these names.

    Rows, repeated ones too, are judged each on its own text; null and empty texts have no words and fail.
    """
    return with_statistics(docs, "stats", text_col).withColumns({"base_failed": base_failed(), "kept": ~base_failed() & rules.kept()})


def passed(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with their columns as they are."""
    name = "stats"
    while name in docs.columns:
        name += "_"
    return with_statistics(docs, name, text_col).where(~base_failed(name) & rules.kept(name)).drop(name)
