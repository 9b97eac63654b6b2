"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the hashed character n-grams that occur in it. From labelled documents come, for each n-gram, the
log ratio r of its smoothed shares among toxic and other documents; a logistic regression over the features r * [present]
is then trained. n-grams whose ratio is within chance (a z-score below ``z_least``) get no weight, so a document is scored
by what tells its class however long it is.

The classifier is fitted on a bounded sample of labelled documents: at most ``per_class`` of each class, those with the
smallest hash of their id; the bias is then corrected for the classes' true shares among all labels that may be learnt
from. Scoring covers every document and the whole of each text.

Defined cases: an empty or null text has no features, so its score is that of the bias; labels that are null or of
documents that do not exist teach nothing; a document labelled more than once counts once, toxic if any label says so;
with only one class to learn from every score is that class's share; a null doc_id stays null and is never learnt from;
repeated rows give repeated result rows; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Orders of the n-grams, in characters (code points) of the lower-cased text; so many bits of a hash name a feature.
ORDERS, BITS = (3, 4, 5, 6), 20
#: Characters of a text that are hashed at a time.
WINDOW = 1 << 20
STEP, MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


@dataclass
class Model:
    weights: np.ndarray  # by feature, float32
    bias: float


def text_windows(text: str | None) -> Iterator[np.ndarray]:
    """The code points of a text in windows that overlap by the longest n-gram less one."""
    if not text:
        return
    data = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for a in range(0, max(1, len(data) - ORDERS[-1] + 1), WINDOW):
        yield data[a : a + WINDOW + ORDERS[-1] - 1]


def hashed(data: np.ndarray) -> Iterator[np.ndarray]:
    """Feature numbers of the n-grams of each order."""
    h = codes = data
    for n in range(2, ORDERS[-1] + 1):
        if len(codes) < n:
            return
        h = h[:-1] * STEP + codes[n - 1 :]
        if n in ORDERS:
            x = (h ^ np.uint32(n)) * MIX
            x ^= x >> np.uint32(15)
            yield (x * MIX) >> np.uint32(32 - BITS)


def features(text: str | None) -> np.ndarray:
    found = [f for data in text_windows(text) for f in hashed(data)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)


def log_odds(text: str | None, model: Model) -> float:
    """Sum of the weights of the features that occur: most have none, and are gone before the distinct are taken."""
    met = []
    for data in text_windows(text):
        for f in hashed(data):
            hit = f[model.weights[f] != 0]
            if len(hit):
                met.append(hit)
    at = np.unique(np.concatenate(met)) if met else np.empty(0, np.int64)
    return model.bias + float(model.weights[at].sum(dtype=np.float64))


class Sums:
    """Sums, group by group, of what a vector has at the places of each group; a block of places at a time."""

    def __init__(self, places: np.ndarray, sizes: np.ndarray, block: int = 1 << 20):
        self.places, self.n, self.some = places, len(sizes), np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[self.some]
        cuts = np.unique(np.searchsorted(starts, np.arange(0, len(places), block)))
        self.blocks = [(a, b, starts[a:b] - starts[a], starts[a], starts[b] if b < len(starts) else len(places)) for a, b in zip(cuts, [*cuts[1:], len(starts)]) if a < b]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for a, b, starts, first, end in self.blocks:
            out[self.some[a:b]] = np.add.reduceat(x[self.places[first:end]], starts)
        return out


def fit(texts: list[str], y: np.ndarray, prior: tuple[int, int], z_least: float, l2: float, steps: int) -> Model:
    """prior: documents of class 0 and 1 among all labels that may be learnt from. Features are taken twice, so that only those
    that keep a weight are ever held."""
    weights = np.zeros(1 << BITS, np.float32)
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    if n.min() == 0:
        share = (prior[1] + 0.5) / (sum(prior) + 1.0)
        return Model(weights, float(np.log(share / (1 - share))))
    df = np.zeros((2, 1 << BITS))
    for text, label in zip(texts, y):
        df[label, features(text)] += 1
    a = df + 0.5
    ratio = np.log(a[1] / (n[1] + 1)) - np.log(a[0] / (n[0] + 1))
    keep = (np.abs(ratio) / np.sqrt(1 / a[0] + 1 / a[1]) >= z_least) & (df.sum(axis=0) >= 4)
    number = (np.cumsum(keep) - 1).astype(np.int32)
    rows = [number[f[keep[f]]] for f in map(features, texts)]
    sizes = np.array([len(f) for f in rows])
    col = np.concatenate(rows)
    by_doc = Sums(col, sizes)
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    order = np.argsort(col, kind="stable")
    r = ratio[keep]
    by_feature = Sums(doc[order], np.bincount(col, minlength=len(r)))
    del order, doc, col, rows
    w, b = np.zeros(len(r)), 0.0
    m, v = np.zeros(len(r) + 1), np.zeros(len(r) + 1)
    share = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])  # both classes weigh alike in training
    for t in range(1, steps + 1):
        z = b + by_doc(w * r)
        g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(r * by_feature(g) + l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    weights[keep] = w * r
    return Model(weights, b + float(np.log((prior[1] + 0.5) / (prior[0] + 0.5))))


def train(docs: DataFrame, labels: DataFrame, learn, label_col: str, id_col: str, text_col: str, per_class: int, z_least: float, l2: float, steps: int) -> Model:
    """Fit in one task, on at most 2 * per_class documents; the weights that are not zero come back."""
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(learn(id_col))
    own = own.groupBy(F.col(id_col).cast("long").alias("label_id")).agg(F.max(F.col(label_col).cast("int")).alias("label_y"))
    row = own.agg(F.count_if(F.col("label_y") == 0).alias("a"), F.count_if(F.col("label_y") == 1).alias("b")).first()
    pick = None
    for y in (0, 1):
        part = own.where(F.col("label_y") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(per_class)
        pick = part if pick is None else pick.unionAll(part)
    rows = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(pick), "label_id").select("label_id", "label_y", "text")

    def run(batches):
        got: dict[int, tuple[str, int]] = {}
        for batch in batches:
            for i, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if i not in got or (text or "") < got[i][0]:  # of rows that share an id, the smallest text
                    got[i] = text or "", y
        ids = sorted(got)  # so that the order of arrival does not matter
        model = fit([got[i][0] for i in ids], np.array([got[i][1] for i in ids], int), (row.a, row.b), z_least, l2, steps)
        at = np.flatnonzero(model.weights)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(model.weights[at].astype(float), model.bias))], ["feature", "weight"])

    table = rows.repartition(1).mapInArrow(run, "feature long, weight double").toArrow()
    at, w = table.column(0).to_numpy(), table.column(1).to_numpy()
    weights = np.zeros(1 << BITS, np.float32)
    weights[at[at >= 0]] = w[at >= 0]
    bias = w[at < 0]
    return Model(weights, float(bias[0]) if len(bias) else float(np.log((row.b + 0.5) / (row.a + 0.5))))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    per_class: int = 4000,
    z_least: float = 4.0,
    l2: float = 1e-5,
    steps: int = 300,
    keep_clean: bool = False,
) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) of every document; with keep_clean, the documents' own
    columns instead, and only those rows that are not predicted toxic.

    learn: given the name of the id column, a condition for the labels that may be learnt from.
    """
    model = train(docs, labels, learn, label_col, id_col, text_col, per_class, z_least, l2, steps)

    def run(batches):
        for batch in batches:
            z = np.array([log_odds(t.as_py(), model) for t in batch.column(1)], float)
            s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.record_batch([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    at = docs.columns.index(text_col)

    def clean(batches):
        for batch in batches:
            yield batch.filter(pa.array([log_odds(t.as_py(), model) < 0 for t in batch.column(at)], pa.bool_()))

    if keep_clean:
        return docs.mapInArrow(clean, docs.schema)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
