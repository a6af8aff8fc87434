"""A quality score from a sparse rule ensemble over text statistics.

Statistics of a text (shares of character classes, repeated words, lengths) are computed per batch with numpy. Small
regression trees are boosted on them; every path from a root to a node is a conjunctive rule, and a logistic model with
an L1 penalty weights the rules, most of them at zero. What is left is compiled into one Spark Column expression over
the statistics, so scoring is a projection. Labels, language, source and id are never inputs.

The model is fitted on a bounded sample of labelled rows: about SAMPLE, picked by a hash of the id; only their
statistics (some numbers a row) travel to the driver. Fitting is deterministic.

Cases: a null text counts as empty, and empty texts get a score as any other; rows without a label are not learned
from, and a row with several labels is learned once for each; with no label at all every score is 0.5; repeated rows
get the same score; a null id is kept; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches
from tidemark.llm.shingles import batches, word_hashes

SAMPLE = 12_000
TREES, DEPTH, LEARNING_RATE, CUTS = 24, 3, 0.3, 48
PENALTY, STEPS = 2e-3, 600

STATS = [
    "log_bytes", "upper", "digit", "mark", "symbol", "bar", "white", "line", "high", "word_length", "distinct", "common_word", "repeats", "symbol_words",
]


def statistics(texts) -> np.ndarray:
    """A row of STATS for each text of an Arrow string column or a list."""
    import pyarrow as pa

    texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    out = [np.zeros((0, len(STATS)))]
    for (some,) in batches(texts):
        words, first = word_hashes(some)
        out.append(np.array([_of_text((t or "").encode("utf-8", "surrogatepass"), words[a:b]) for t, a, b in zip(some, first[:-1], first[1:], strict=True)]))
    return np.concatenate(out)


def _classes() -> np.ndarray:
    kind = np.zeros(256, dtype=np.intp)
    for k, chars in enumerate((range(65, 91), range(48, 58), b".,;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{}~", b"|", b" \t\r\v\f", b"\n", range(128, 256)), 1):
        kind[list(chars)] = k
    return kind


_CLASS = _classes()


def _of_text(raw: bytes, words: np.ndarray) -> list[float]:
    n, m = max(len(raw), 1), max(len(words), 1)
    by_byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    shares = np.bincount(_CLASS, weights=by_byte, minlength=9)[1:] / n
    ordered = np.sort(words)
    edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True]))) if len(words) else np.array([0])
    runs = np.diff(edges)
    repeats = np.count_nonzero(words[1:] == words[:-1]) / m
    return [np.log1p(len(raw)), *shares, n / m, len(runs) / m, runs.max(initial=0) / m, repeats, by_byte[[33, 35, 36, 37, 38, 42, 124]].sum() / m]


def add_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of id and a column for each of STATS."""

    def run(parts):
        import pyarrow as pa

        for part in parts:
            found = statistics(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(x) for x in found.T)], names=["id", *STATS])

    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, " + ", ".join(f"{x} double" for x in STATS)).withColumnRenamed("id", id_col)


@dataclass
class Rules:
    rules: list[tuple[tuple[int, float, bool], ...]]  # (statistic, cut, whether above it), all of which must hold
    weights: list[float]
    bias: float

    def column(self) -> Column:
        """The score as an expression over the columns STATS."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for k, cut, above in rule:
                holds = holds & ((F.col(STATS[k]) > cut) if above else (F.col(STATS[k]) <= cut))
            total = total + F.when(holds, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def of(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            total += w * _holds(rule, x)
        return 1 / (1 + np.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        learn: Column | None = None, sample: int = SAMPLE) -> Rules:
    """Learns from the labels (0 or 1) for which `learn`, over the column id, holds."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    marked = marked.where(learn) if learn is not None else marked
    n = marked.count()
    share = min(1.0, sample / max(n, 1))
    marked = marked.where(F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marked.select("id").distinct()), "id", "left_semi")
    found = add_statistics(rows, "id").join(marked, "id").select("id", "y", *STATS).toPandas().sort_values(["id", "y", *STATS])
    return fit_rules(found[STATS].to_numpy(), found["y"].to_numpy())


def score(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and score."""
    return add_statistics(docs, id_col, text_col).select(id_col, rules.column().alias("score"))


def fit_rules(x: np.ndarray, y: np.ndarray) -> Rules:
    if not len(y) or y.min() == y.max():
        return Rules([], [], 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    bias = float(np.log(y.mean() / (1 - y.mean())))
    margin, rules = np.full(len(y), bias), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        for rule, rows, leaf in _tree(x, y - p, p * (1 - p), np.arange(len(y)), (), DEPTH):
            if rule:
                rules.setdefault(tuple(sorted(rule)), None)
            if leaf is not None:
                step[rows] = leaf
        margin = margin + LEARNING_RATE * step
    chosen = sorted(rules)
    z = np.stack([_holds(r, x) for r in chosen], axis=1).astype(np.float64) if chosen else np.zeros((len(y), 0))
    weights, bias = _lasso(z, y, bias)
    kept = [k for k in range(len(chosen)) if weights[k]]
    return Rules([chosen[k] for k in kept], [float(weights[k]) for k in kept], float(bias))


def _holds(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for k, cut, above in rule:
        out &= (x[:, k] > cut) if above else (x[:, k] <= cut)
    return out


def _tree(x, gradient, hessian, rows, rule, depth):
    """Yields (rule, rows, value) of each node below; the value is None for inner nodes."""
    total, weight = gradient[rows].sum(), hessian[rows].sum() + 1.0
    best = (1e-3, None, None)
    if depth and len(rows) >= 20:
        for k in range(x.shape[1]):
            v = x[rows, k]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1], method="lower"))
            at = np.searchsorted(cuts, v, side="left")  # v <= cuts[j] where at <= j
            left = np.cumsum(np.bincount(at, gradient[rows], len(cuts) + 1))[:-1]
            mass = np.cumsum(np.bincount(at, hessian[rows], len(cuts) + 1))[:-1] + 1.0
            gain = left**2 / mass + (total - left) ** 2 / (weight + 1.0 - mass) - total**2 / weight
            j = int(gain.argmax()) if len(gain) else -1
            if j >= 0 and gain[j] > best[0]:
                best = (gain[j], k, float(cuts[j]))
    _, k, cut = best
    if k is None:
        yield rule, rows, float(np.clip(total / weight, -4, 4))
        return
    yield rule, rows, None
    above = x[rows, k] > cut
    yield from _tree(x, gradient, hessian, rows[~above], (*rule, (k, cut, False)), depth - 1)
    yield from _tree(x, gradient, hessian, rows[above], (*rule, (k, cut, True)), depth - 1)


def _lasso(z: np.ndarray, y: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient steps; the bias is not penalised."""
    a = np.column_stack((np.ones(len(y)), z))
    rate = 4 * len(y) / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = np.zeros(a.shape[1])
    w[0] = bias
    v, t = w, 1.0
    for _ in range(STEPS):
        g = a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -30, 30))) - y) / len(y)
        new = v - rate * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * PENALTY, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (old - 1) / t * (new - w), new
    return w[1:], w[0]
