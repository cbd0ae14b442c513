"""Quality of texts by a sparse ensemble of rules over their statistics."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import fold

#: Labelled rows per class that the rules are fitted on, those with the smallest hash of their id.
SAMPLE_PER_CLASS = 2000
TREES, DEPTH, CUTS, FEATURES_PER_SPLIT, LEAST_ROWS = 20, 3, 16, 6, 10
PENALTIES = (0.03, 0.01, 0.003, 0.001)
STEPS = 300
THRESHOLD = 0.3


def text_statistics(text: Column) -> dict[str, Column]:
    """Statistics of whole texts as native expressions over `text`; null text is empty. Never null."""
    text = F.coalesce(text, F.lit(""))
    words, lines = F.col("_words"), F.col("_lines")
    chars = F.greatest(F.length(text), F.lit(1))
    count = F.greatest(F.size(words), F.lit(1))
    next_word = F.slice(words, 2, count)
    same = F.filter(F.zip_with(words, next_word, lambda a, b: a == b), lambda s: F.coalesce(s, F.lit(False)))
    return {
        "chars": F.log1p(F.length(text)),
        "words": F.log1p(F.size(words)),
        "lines": F.log1p(F.size(lines)),
        "word_chars": F.length(text) / count,
        "line_chars": F.log1p(F.length(text) / F.greatest(F.size(lines), F.lit(1))),
        "upper": F.regexp_count(text, F.lit(r"\p{Lu}")) / chars,
        "digits": F.regexp_count(text, F.lit(r"\p{N}")) / chars,
        "symbols": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]")) / chars,
        "symbol_runs": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]{2,}")) / count,
        "lone_symbols": F.regexp_count(text, F.lit(r"(?<=\s)[^\p{L}\p{N}\s]+(?=\s)")) / count,
        "distinct_words": F.size(F.array_distinct(words)) / count,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "repeated_words": F.size(same) / count,
    }


def with_statistics(frame: DataFrame, text_column: str) -> tuple[DataFrame, list[str]]:
    """The frame with one column per statistic, named _s_*."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    frame = frame.withColumns({"_words": F.split(F.trim(text), r"\s+"), "_lines": F.split(text, "\n")})
    found = {f"_s_{name}": c.cast("double") for name, c in text_statistics(F.col(text_column)).items()}
    return frame.withColumns(found).drop("_words", "_lines"), list(found)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above, cut)."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, values: np.ndarray, names: list[str]) -> np.ndarray:
        return reduce(and_, [(values[:, names.index(n)] > c) == up for n, up, c in self.terms])

    @property
    def column(self) -> Column:
        return reduce(and_, [F.col(n) > c if up else F.col(n) <= c for n, up, c in self.terms])


@dataclass
class RuleModel:
    """Score: logistic function of the intercept and the weights of the rules that hold."""

    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    @property
    def score(self) -> Column:
        total = reduce(add, [F.when(r.column, w).otherwise(0.0) for r, w in self.rules], F.lit(float(self.intercept)))
        return 1 / (1 + F.exp(-total))


def _tree_rules(values, target, names, rng) -> set[Rule]:
    """Paths to all nodes below the root of a regression tree grown on a bootstrap sample."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 2)[1:-1])) for column in values.T]
    rules = set()

    def grow(rows, terms, depth):
        best = None
        for f in rng.choice(values.shape[1], min(FEATURES_PER_SPLIT, values.shape[1]), replace=False):
            column, y = values[rows, f], target[rows]
            for cut in cuts[f]:
                up = column > cut
                n = up.sum()
                if min(n, len(rows) - n) < LEAST_ROWS:
                    continue
                gain = y[up].sum() ** 2 / n + y[~up].sum() ** 2 / (len(rows) - n)
                if best is None or gain > best[0]:
                    best = gain, f, cut, up
        if best is None or best[0] - target[rows].sum() ** 2 / len(rows) < 1e-9:
            return
        _, f, cut, up = best
        for above in (True, False):
            path = (*terms, (names[f], above, float(cut)))
            rules.add(Rule(path))
            if depth > 1:
                grow(rows[up == above], path, depth - 1)

    grow(rng.integers(0, len(values), len(values)), (), DEPTH)
    return rules


def _lasso(x, y, weight, penalty) -> tuple[float, np.ndarray]:
    """Weighted logistic regression with an L1 penalty, by accelerated proximal steps."""
    step = 4 / max(np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2 + weight.sum(), 1e-9)
    b = b_old = 0.0
    w = w_old = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(STEPS):
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pull = (t - 1) / t_next
        wm, bm = w + pull * (w - w_old), b + pull * (b - b_old)
        slip = weight * (1 / (1 + np.exp(-np.clip(x @ wm + bm, -40, 40))) - y)
        w_old, b_old, t = w, b, t_next
        w = wm - step * (x.T @ slip)
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        b = bm - step * slip.sum()
    return float(b), w


def fit_rules(values: np.ndarray, labels: np.ndarray, names: list[str], share: float, seed: int = 7) -> RuleModel:
    """Rules from TREES trees, weighted by lasso logistic regression; the penalty that loses least
    on a fifth of the rows is taken. `share` is the share of label 1 in the whole population, to
    which both classes are weighted. One class alone gives a constant."""
    base = min(max(share, 1e-3), 1 - 1e-3)
    constant = RuleModel(float(np.log(base / (1 - base))))
    if len(labels) < 2 * LEAST_ROWS or labels.min() == labels.max():
        return constant
    rng = np.random.default_rng(seed)
    weight = np.where(labels == 1, base / labels.mean(), (1 - base) / (1 - labels.mean())) / len(labels)
    found: set[Rule] = set()
    centred = labels - labels.mean()
    for _ in range(TREES):
        found |= _tree_rules(values, centred, names, rng)
    rules, seen = [], set()
    for rule in sorted(found, key=lambda r: (len(r.terms), r.terms)):
        held = rule.holds(values, names)
        key = held.tobytes()
        if key not in seen and (~held).tobytes() not in seen:
            seen.add(key)
            rules.append(rule)
    x = np.stack([r.holds(values, names) for r in rules], axis=1).astype(float)
    test = rng.random(len(labels)) < 0.2
    best = None
    for penalty in PENALTIES:
        b, w = _lasso(x[~test], labels[~test], weight[~test], penalty)
        z = np.clip(x[test] @ w + b, -40, 40)
        loss = (weight[test] * np.logaddexp(0, np.where(labels[test] == 1, -z, z))).sum()
        if best is None or loss < best[0]:
            best = loss, penalty
    b, w = _lasso(x, labels, weight, best[1])
    return RuleModel(b, [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6])


def train_quality(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", held_out_folds: int = 5) -> RuleModel:
    """Fits on labelled rows whose crc32(id as text) modulo `held_out_folds` is not 0.

    At most SAMPLE_PER_CLASS rows per label reach the driver, as statistics; the share of each
    label is counted over all labelled rows of those folds. Rows without id or label take no part;
    of documents with one id, one counts.
    """
    known = labels.select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("_y"))
    known = known.where((fold("_id", held_out_folds) != 0) & F.col("_y").isin(0, 1)).distinct()
    counts = {row["_y"]: row["n"] for row in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    picked = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_PER_CLASS) for y in (0, 1)]
    texts = documents.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    chosen, names = with_statistics(texts.join(F.broadcast(picked[0].unionAll(picked[1])), "_id"), "_text")
    # Documents that repeat an id are one row, so no more reach the driver than labels were picked.
    chosen = chosen.groupBy("_id", "_y").agg(F.min(F.struct(*names)).alias("_values")).select("_id", "_y", "_values.*")
    rows = sorted(tuple(r) for r in chosen.select("_id", "_y", *names).collect())
    values = np.array([r[2:] for r in rows], float).reshape(-1, len(names))
    share = counts.get(1, 0) / max(sum(counts.values()), 1) if counts else 0.5
    return fit_rules(values, np.array([r[1] for r in rows], float), names, share)


def score_quality(documents: DataFrame, model: RuleModel, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`documents` with score (0 to 1) and predicted (1 if score >= threshold, else 0), which take
    the place of columns so named. Native expressions, no shuffle; null and empty texts are scored
    by their statistics (all about 0), repeated rows alike."""
    kept = [c for c in documents.columns if c not in ("score", "predicted")]
    frame, _ = with_statistics(documents.select(F.struct(*kept).alias("_kept"), F.col(text_column).alias("_text")), "_text")
    frame = frame.select("_kept", model.score.alias("_score"))
    return frame.select("_kept.*", F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
