"""A quality classifier by co-training of a text view and a metadata view."""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, forget, lots, map_batches, written

TRIGRAMS, FIGURES = 512, 7  # of the content view: hashed byte trigrams, figures of words and marks
SCALE = 510  # of content figures, which are kept as bytes
BUCKETS = 48  # hashed language, source, and both
SIZES = 11
PATH, ENDS = re.compile(r"[^0-9A-Za-z]+|(?<=[A-Za-z])(?=[0-9])"), (".", "!", "?", "…", ":", '"')
WIDTHS = (TRIGRAMS + FIGURES, BUCKETS + SIZES)


def content_view(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams of the whole text, and figures of its words and marks, as bytes."""
    out = np.zeros(TRIGRAMS + FIGURES)
    b = np.frombuffer(text.encode("utf-8"), np.uint8).astype(np.uint32)
    if len(b) >= 3:
        b[(b >= 48) & (b <= 57)] = 48
        h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1) >> np.uint32(23)
        out[:TRIGRAMS] = SCALE * np.sqrt(np.bincount(h, minlength=TRIGRAMS) / len(h))
    words, n = text.split(), max(1, len(text))
    m = max(1, len(words))
    shares = (
        len(set(words)) / m,
        len(set(zip(words, words[1:], strict=False))) / m,
        sum(map(len, words)) / m / 10,
        10 * sum(map(text.count, "*&%$#|!")) / n,
        10 * sum(map(text.count, "0123456789")) / n,
        sum(map(str.isupper, words)) / m,
        10 * (text.count(".") + text.count(",")) / n,
    )
    out[TRIGRAMS:] = 255 * np.minimum(1, shares)
    return np.minimum(255, np.rint(out)).astype(np.uint8)


def metadata_view(text: str, lang: str | None, source: str | None) -> np.ndarray:
    """What a crawl's record says of a page beside its words: hashed language, source and parts of its path, and the page's shape.

    The shape is its size in characters and bytes, the number and lengths of its lines, how many of them repeat, how many end as
    sentences do, and how much of it is space.
    """
    out = np.zeros(BUCKETS + SIZES, np.float32)
    parts = [f"part={x}" for x in PATH.split(source)] if source else []
    for value in (f"lang={lang}", f"source={source}", f"both={lang}/{source}", *parts):
        out[zlib.crc32(value.encode("utf-8")) % BUCKETS] += 1
    n = len(text)
    lines = [x for x in map(str.rstrip, text.split("\n")) if x]
    long, m = np.array([len(x) for x in lines] or [0]), max(1, len(lines))
    out[BUCKETS:] = (
        math.log1p(n),
        math.log1p(m),
        math.log1p(long.mean()),
        math.log1p(long.max()),
        math.log1p(long.std()),
        math.log1p(n / (m + 1)),
        1 - len(set(lines)) / m,
        sum(x.endswith(ENDS) for x in lines) / m,
        len(text.encode("utf-8")) / max(1, n),
        text.count(" ") / max(1, n),
        float(n == 0),
    )
    return out


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 8) -> np.ndarray:
    """Weights and bias of a ridge logistic regression, by Newton steps."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        slope = x1.T @ (weight * (p - y)) + ridge * w
        curve = (x1 * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x1 + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass
class CoTrained:
    """Two views' weights, their calibration, and how both are joined. ``joint`` None: all labels were alike."""

    content: np.ndarray | None
    metadata: np.ndarray | None
    mean: np.ndarray | None
    scale: np.ndarray | None
    calibration: list[tuple[float, float]]
    joint: np.ndarray | None
    prior: float
    history: list[dict] = field(default_factory=list)

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.joint is None:
            same = np.full(len(content), self.prior)
            return same, same, same
        z = np.column_stack([logit(content, self.content), logit((metadata - self.mean) / self.scale, self.metadata)])
        z = np.column_stack([a * z[:, k] + b for k, (a, b) in enumerate(self.calibration)])
        return chance(z[:, 0]), chance(z[:, 1]), chance(logit(z, self.joint))


class Learner:
    """Both views' models, on labelled rows and on what each view was taught by the other."""

    RIDGE = (0.02, 1.0)

    def __init__(self, views: list[np.ndarray], label: np.ndarray):
        spread = views[1].std(axis=0)  # a column that doesn't vary among the labelled rows, as of a source that none has, stays as it is
        self.mean, self.scale = views[1].mean(axis=0), np.where(spread > 1e-3, spread, 1.0)
        self.views, self.label = [self.plain(k, v) for k, v in enumerate(views)], label
        self.held = np.arange(len(label)) % 4 == 3
        if label[self.held].min() == label[self.held].max() or label[~self.held].min() == label[~self.held].max():
            self.held[:] = False
        train = ~self.held
        self.models = [fitted(v[train], label[train], np.ones(train.sum()), ridge) for v, ridge in zip(self.views, self.RIDGE, strict=True)]
        #: Of each exchange: pseudo-labels by (teacher, class), and each view's accuracy on the rows held back, before and after it.
        self.history: list[dict] = []

    def plain(self, k: int, view: np.ndarray) -> np.ndarray:
        return (view - self.mean) / self.scale if k else view

    def trusted(self, k: int, said: int, confident: float) -> bool:
        """Whether a view's confident verdicts of a class are right as often as that on labelled rows that it wasn't fitted on."""
        p = chance(logit(self.views[k], self.models[k]))[self.held]
        sure = p >= confident if said else p <= 1 - confident
        return bool(sure.any()) and float((self.label[self.held][sure] == said).mean()) >= confident

    def accuracy(self) -> list[float]:
        rows = self.held if self.held.any() else ~self.held
        return [float(((logit(v, m) >= 0) == self.label)[rows].mean()) for v, m in zip(self.views, self.models, strict=True)]

    def slope(self, k: int, w: np.ndarray) -> tuple[np.ndarray, float]:
        """The gradient of view ``k`` over the labelled rows, with the ridge, and its loss."""
        train = ~self.held
        x, y = np.column_stack([self.views[k][train], np.ones(train.sum())]), self.label[train]
        z = np.clip(x @ w, -30, 30)
        return x.T @ (chance(z) - y) + self.RIDGE[k] * w, float((np.logaddexp(0, z) - y * z).sum() + self.RIDGE[k] / 2 * w @ w)

    def curve(self, k: int, w: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """A stand-in for the curvature: that of the labelled rows twice, since taught rows weigh as much at most, with some of the taught rows'
        own (``squares``: their weighted sums of squares), all of it for columns that they alone have."""
        train = ~self.held
        x = np.column_stack([self.views[k][train], np.ones(train.sum())])
        p = chance(np.clip(x @ w, -30, 30))
        new = squares * np.where(squares > 10 * (x * x).sum(0), 0.25, 0.05)
        return 2 * (x * np.maximum(p * (1 - p), 0.02)[:, None]).T @ x + np.diag(new + self.RIDGE[k])

    def joined(self) -> CoTrained:
        fit_on = self.held if self.held.any() else ~self.held
        z = [logit(v, m) for v, m in zip(self.views, self.models, strict=True)]
        one = np.ones(fit_on.sum())
        calibration = [tuple(fitted(v[fit_on][:, None], self.label[fit_on], one, 1e-2)) for v in z]
        both = np.column_stack([a * v + b for v, (a, b) in zip(z, calibration, strict=True)])
        joint = fitted(both[fit_on], self.label[fit_on], one, 1.0)
        return CoTrained(self.models[0], self.models[1], self.mean, self.scale, calibration, joint, float(self.label.mean()), self.history)


def views_of(batch) -> tuple[np.ndarray, np.ndarray]:
    texts = [t or "" for t in batch["text"]]
    content = np.array([content_view(t) for t in texts])
    return content, np.array([metadata_view(t, a, b) for t, a, b in zip(texts, batch["lang"], batch["source"], strict=True)])


def viewed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, content, metadata, h)`` of each row, written once; ``h`` is a uniform number made of id and content."""
    known = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]

    def run(batch):
        content, metadata = views_of(batch)
        return {"id": batch["id"], "content": [x.tobytes() for x in content], "metadata": [x.astype("<f4").tobytes() for x in metadata]}

    rows = map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *known), run, f"id {docs.schema[id_col].dataType.simpleString()}, content binary, metadata binary")
    return written(rows.withColumn("h", F.pmod(F.xxhash64("id", "content", "metadata"), F.lit(1 << 52)) / float(1 << 52)))


def arrays(table) -> list[np.ndarray]:
    """Both views of rows as numbers."""
    content, metadata = (b"".join(table[c].to_pylist()) for c in ("content", "metadata"))
    return [np.frombuffer(content, np.uint8).reshape(-1, WIDTHS[0]) / SCALE, np.frombuffer(metadata, "<f4").reshape(-1, WIDTHS[1]).astype(float)]


def exchange(pool: DataFrame, learner: Learner, confident: float, steps: int) -> None:
    """One exchange: each view learns from all rows of the pool that the other one, as it is now, is sure of.

    Pseudo-labels are those of the other view's confident verdicts, if labelled rows held back bear it out in both classes (``trusted``); a
    view that is sure of one class alone would teach that everything is of that class.
    A view's new weights minimise the loss over labelled rows and all of its pseudo-labels, which together weigh as much as the labelled ones at
    most. Each step is one pass over the pool in Spark: tasks sum gradients, Spark adds the sums up, and the driver sees as many
    numbers as the views have columns, whatever the pool's size. A step that made the loss larger is cut to a quarter.
    """
    teachers, before = [m.copy() for m in learner.models], learner.accuracy()
    mean, scale = learner.mean, learner.scale
    plain = lambda k, view: (view - mean) / scale if k else view
    trusted = [learner.trusted(k, 0, confident) and learner.trusted(k, 1, confident) for k in (0, 1)]
    counts: dict = {}
    last: list[tuple] = [(None, math.inf)] * 2
    for _ in range(steps + 1):
        students = [m.copy() for m in learner.models]

        def sums(batches, students=students):
            total, squares = ([np.zeros(w + 1) for w in WIDTHS] for _ in range(2))
            n, loss = np.zeros((2, 2)), np.zeros(2)
            for batch in batches:
                views = [plain(k, view) for k, view in enumerate(arrays(batch))]
                for k in (0, 1):
                    if not trusted[1 - k]:
                        continue
                    p = chance(logit(views[1 - k], teachers[1 - k]))
                    good, bad = p >= confident, p <= 1 - confident
                    rows = np.flatnonzero(good | bad)
                    if len(rows):
                        z = logit(views[k][rows], students[k])
                        off = chance(z) - good[rows]
                        loss[k] += (np.logaddexp(0, z) - good[rows] * z).sum()
                        total[k] += np.append(off @ views[k][rows], off.sum())
                        squares[k] += np.append((views[k][rows] ** 2).sum(0), len(rows))
                        n[1 - k] += bad.sum(), good.sum()
            for k in (0, 1):
                values = np.concatenate([total[k], squares[k], n[1 - k], loss[[k]]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k)), pa.array(np.arange(len(values))), pa.array(values)], names=["view", "at", "value"])

        got = {(r.view, r["at"]): r.value for r in pool.mapInArrow(sums, "view long, at long, value double").groupBy("view", "at").agg(F.sum("value").alias("value")).collect()}
        for k in (0, 1):
            wide = WIDTHS[k] + 1
            counts |= {(1 - k, said): int(got.get((k, 2 * wide + said), 0)) for said in (0, 1)}
            weight = min(0.5, (~learner.held).sum() / max(1, counts[1 - k, 0] + counts[1 - k, 1]))
            taught, squares = (weight * np.array([got.get((k, at), 0.0) for at in range(first, first + wide)]) for first in (0, wide))
            slope, loss = learner.slope(k, students[k])
            loss += weight * got.get((k, 2 * wide + 2), 0.0)
            if loss > last[k][1]:
                learner.models[k] = last[k][0] + (students[k] - last[k][0]) / 4
                continue
            last[k] = students[k], loss
            learner.models[k] = students[k] - np.linalg.solve(learner.curve(k, students[k], squares), slope + taught)
    learner.models = [w for w, _ in last]  # the last weights whose loss is known
    learner.history.append({"pseudo_labels": counts, "accuracy_before": before, "accuracy_after": learner.accuracy()})


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 6000, rounds: int = 4, confident: float = 0.98, steps: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> CoTrained:
    """Fit both views on labelled documents and let each teach the other from all other documents, over ``rounds`` rounds.

    At most ``most_labelled`` labelled documents, those with the smallest hashes
    of their ids, are fitted on; every other document is in the pool. In each
    exchange between two rounds each view judges the whole pool in Spark, and the other view learns from all rows that it is
    sure of at ``confident``, over ``steps`` passes (``exchange``). The bound on labelled rows is a parameter of the fit; all else covers
    all rows, and only labelled rows and sums come to the driver. ``history`` of the model tells what each exchange did.

    Ids with several labels count as good if one is; ids of several documents
    give one of them. Rows with a null label or id aren't labelled; columns
    ``lang`` and ``source`` may be absent. Fewer than eight labels, or labels
    that are all alike, give a model with one score for all.
    """
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("double")).alias("label"))
    views = viewed(docs, id_col, text_col)
    chosen = F.broadcast(named.orderBy(F.xxhash64("id"), "id").limit(most_labelled))
    first = F.min_by(F.struct("content", "metadata"), F.struct("h", "content"))
    known = views.join(chosen, "id").groupBy("id").agg(F.first("label").alias("label"), first.alias("view")).select("id", "label", "view.*").toArrow().sort_by("id")
    label = known["label"].to_numpy().astype(float)
    if len(label) < 8 or label.min() == label.max():
        return CoTrained(None, None, None, None, [], None, float(label.mean()) if len(label) else 1.0)
    learner = Learner(arrays(known), label)
    pool = views.join(chosen.select("id"), "id", "left_anti").select("content", "metadata")
    for _ in range(rounds - 1):
        exchange(pool, learner, confident, steps)
    forget(views)
    return learner.joined()


ADDED = ("p_content", "p_metadata", "score", "keep")


def scored(docs: DataFrame, model: CoTrained, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with ``p_content``, ``p_metadata``, ``score`` and ``keep``, without a shuffle.

    Columns of the docs that have those names (``ADDED``) are replaced; a caller who needs them renames them first. A null text counts as empty; it, and
    every row of a model whose labels were all alike, gets a score as any other.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL("{} double, {} double, {} double, {} boolean".format(*ADDED))
    plain = docs.drop(*added.names)
    schema = StructType([*plain.schema.fields, *added.fields])
    arrow, names = to_arrow_schema(schema), plain.columns
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for lot in lots(batch):
                cells = {"text": lot.column(text_col).to_pylist()} | {c: lot.column(c).cast(pa.string()).to_pylist() if c in names else [None] * lot.num_rows for c in ("lang", "source")}
                content, metadata = views_of(cells)
                p, q, score = model.scores(content / SCALE, metadata)
                new = [pa.array(np.round(x, 9)) for x in (p, q, score)] + [pa.array(score >= threshold)]
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(lot.columns, arrow, strict=False)), *new], schema=arrow)

    return plain.mapInArrow(run, schema)
