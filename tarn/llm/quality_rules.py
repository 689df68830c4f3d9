"""Quality rules: a decision list over text statistics, learned by sequential covering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, arrow_schema, docs_of, slices_of, staged, text_bytes

SYMBOLS = b"#*$%&|<>"
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MORE = "n_distinct long, n_lines long, n_upper long, n_lower long, n_digits long, n_punct long, n_stops long"


def repeat_words(ids: np.ndarray, width: int = 3) -> int:
    """Words that lie in a run of ``width`` words found twice or more in the text; words are numbers from zero on."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    code, kinds = ids[:n], int(ids.max()) + 1
    for k in range(1, width):
        code = np.unique(code * kinds + ids[k : k + n], return_inverse=True)[1]
    begin = np.flatnonzero(np.bincount(code)[code] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[begin] += 1
    edge[begin + width] -= 1
    return int((np.cumsum(edge) > 0).sum())


def statistics_of(text: bytes, size: int = SLICE) -> tuple[int, ...]:
    """``size`` bytes of a long text are split at a time; what is held of its words is a number for each."""
    number: dict[bytes, int] = {}
    ids, kinds, chars, ends = [np.zeros(0, np.int64)], np.zeros(7, np.int64), 0, 0
    for x in slices_of(text, size):
        words = x.split()
        for w in words:
            if w not in number:
                number[w] = len(number)
        ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        flat = b"".join(words)
        kinds += np.bincount(CLASS[np.frombuffer(flat, np.uint8)], minlength=7)
        chars += len(flat)
        ends += sum(w.endswith((b".", b"!", b"?", b":")) for w in words)
    own, lines = np.concatenate(ids), [x for x in text.split(b"\n") if x and not x.isspace()]
    # bytes that continue a code point are not counted
    return (len(own), chars - int(kinds[6]), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(own),
            len(number), len(lines), int(kinds[1]), int(kinds[2]), int(kinds[3]), int(kinds[4]), ends)


#: Of each byte: 1 upper, 2 lower, 3 digit, 4 other printable ASCII, 6 continues a code point, 0 the rest.
CLASS = np.zeros(256, np.int64)
CLASS[33:127] = 4
CLASS[48:58] = 3
CLASS[65:91] = 1
CLASS[97:123] = 2
CLASS[128:192] = 6


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of each whole text; a null text has no words. Counting is per text: nothing is shuffled."""
    ddl = f"{BASE}, {MORE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for b in batches:
            x = np.array([statistics_of(t) for t in text_bytes(b.column(1))], np.int64).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in x.T)], schema=schema)

    return docs_of(df, id_col, (text_col, "text")).mapInArrow(run, ddl)


def features() -> dict[str, Column]:
    """What conditions look at: ratios of the counts, all defined for texts without words."""
    c, words = F.col, F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars, lines = F.greatest(c("word_chars"), F.lit(1)).cast("double"), F.greatest(c("n_lines"), F.lit(1)).cast("double")
    letters = F.greatest(c("n_upper") + c("n_lower"), F.lit(1)).cast("double")
    return {
        "n_words": c("n_words").cast("double"), "word_length": c("word_chars") / words, "symbol_ratio": c("n_symbols") / words, "dup_line_ratio": c("n_dup_lines") / lines,
        "repeat_ratio": c("n_repeat_words") / words, "distinct_ratio": c("n_distinct") / words, "line_words": c("n_words") / lines, "upper_ratio": c("n_upper") / letters,
        "digit_ratio": c("n_digits") / chars, "punct_ratio": c("n_punct") / chars, "stop_ratio": c("n_stops") / words,
    }


# -- the learner ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self, f: dict[str, Column]) -> Column:
        return f[self.feature] >= self.threshold if self.above else f[self.feature] < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """All conditions hold: the document is of low quality."""

    conditions: tuple[Condition, ...]

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.mask(x) for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a document that none covers is kept."""

    rules: tuple[Rule, ...]

    def column(self) -> Column:
        """An ordered conditional: true where a document is kept."""
        f, out = features(), None
        for r in self.rules:
            hit = None
            for c in r.conditions:
                hit = c.column(f) if hit is None else hit & c.column(f)
            out = F.when(hit, False) if out is None else out.when(hit, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values())))
        low = np.zeros(n, bool)
        for r in self.rules:
            low |= r.mask(x)
        return ~low

    def __str__(self) -> str:
        return "\n".join([*(f"if {r}: drop" for r in self.rules), "else: keep"])


def best_condition(x: dict[str, np.ndarray], low: np.ndarray, cuts: int) -> tuple[Condition | None, float]:
    """The condition of the most information gain for the low rows, over ``cuts`` quantiles of each feature."""
    p0, n0 = int(low.sum()), int((~low).sum())
    best, most = None, 1e-9
    if not p0:
        return None, 0.0
    base = np.log2(p0 / (p0 + n0))
    for name, v in x.items():
        grid = np.unique(np.quantile(v[low], np.linspace(0, 1, cuts)).tolist() + np.quantile(v, np.linspace(0, 1, cuts)).tolist())
        grid = np.unique(np.concatenate([grid, (grid[1:] + grid[:-1]) / 2]))
        order = np.sort(v[low]), np.sort(v[~low])
        under_p, under_n = np.searchsorted(order[0], grid), np.searchsorted(order[1], grid)
        for above, p, n in ((False, under_p, under_n), (True, p0 - under_p, n0 - under_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1)
            k = int(gain.argmax())
            if gain[k] > most:
                best, most = Condition(name, above, float(grid[k])), float(gain[k])
    return best, most


def learn(x: dict[str, np.ndarray], low: np.ndarray, seed: int = 7, cuts: int = 64, most_conditions: int = 4, precision: float = 0.9, most_rules: int = 16) -> DecisionList:
    """Grow a rule on two thirds of the rows, prune it on the rest, drop what it covers, again.

    Growing adds the condition of most gain until no kept row is covered.  Pruning takes out the condition that is missed least,
    the last of equals, while (p - n) / (p + n) on the pruning rows does not get worse.  Learning stops at a rule whose precision on the pruning rows is
    under ``precision``.  Without low rows, or without kept ones, the list is empty.
    """
    rng, rules = np.random.default_rng(seed), []
    left = np.ones(len(low), bool)
    while len(rules) < most_rules and low[left].any() and (~low[left]).any():
        part = rng.random(len(low)) < 2 / 3
        grow, prune = left & part, left & ~part
        xs = {k: v[grow] for k, v in x.items()}
        ys, conditions = low[grow], []
        while len(conditions) < most_conditions and ys.any() and (~ys).any():
            c, _ = best_condition(xs, ys, cuts)
            if c is None:
                break
            conditions.append(c)
            hit = c.mask(xs)
            xs, ys = {k: v[hit] for k, v in xs.items()}, ys[hit]
        if not conditions:
            break
        px, py = {k: v[prune] for k, v in x.items()}, low[prune]

        def worth(cs: list[Condition]) -> tuple[float, int, int]:
            hit = Rule(tuple(cs)).mask(px)
            p, n = int((hit & py).sum()), int((hit & ~py).sum())
            return ((p - n) / (p + n) if p + n else -1.0), p, n

        while len(conditions) > 1:
            shorter = max((conditions[:k] + conditions[k + 1 :] for k in range(len(conditions) - 1, -1, -1)), key=lambda cs: worth(cs)[0])
            if worth(shorter)[0] < worth(conditions)[0]:
                break
            conditions = shorter
        _, p, n = worth(conditions)
        if p < 2 or p < precision * (p + n):
            break
        rules.append(Rule(tuple(conditions)))
        left &= ~rules[-1].mask(x)
    return DecisionList(tuple(rules))


#: Labelled rows that the list is learned from, at most.
SAMPLE = 20_000


def learn_from(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", sample: int = SAMPLE) -> DecisionList:
    """Learn from the statistics of labelled documents: ``sample`` of them at most, the first by a hash of the id.

    Labels that are null, and ids without a document, teach nothing.
    """
    named = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{quality_col}`").alias("quality")).where("id IS NOT NULL AND quality IS NOT NULL")
    n = named.count()
    share = min(1.0, 1.3 * sample / max(n, 1))
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    some = named.where(h < int(share * (1 << 30))).withColumn("h", h)
    f = features()
    rows = stats.join(some, stats.doc_id == some.id).select("h", "id", "quality", *[v.alias(k) for k, v in f.items()]).orderBy("h", "id", "quality", *f).limit(sample).toPandas()
    return learn({k: rows[k].to_numpy(float) for k in f}, rows["quality"].to_numpy() == 0) if len(rows) else DecisionList(())


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DecisionList]:
    """(one row a document: its statistics, base_failed, kept; the list that decided).

    base_failed: under 50 words, or over half of the words repeated.  kept: false where base_failed, else what the
    decision list says.  Null and empty texts fail.  Rows that repeat an id each get a row.  Without labels every document that
    passes the base rule is kept.
    """
    stats = staged(statistics(df, id_col, text_col), "quality-statistics")
    rules = learn_from(stats, labels)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & rules.column()), rules
