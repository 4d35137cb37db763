"""Toxic passages by maximum-scoring segments of token log-odds, and a document score from their extreme-value statistics.

Learning, on a bounded sample of labelled rows (``max_train``, those with the smallest hash of their id):

- Two thirds of the sample, each text once, give the tokens' log-odds. Tokens are words (ASCII letters, digits, characters
  beyond ASCII; lower case), counted once per text. The share of a token's texts that are toxic has a Dirichlet prior of weight
  ``prior`` around the share of its longest proper prefix (without its own texts), whose own prior is the next shorter prefix,
  down to all tokens. So words never seen, or seldom, fall back on their beginnings. The score of a token is
  ln(odds / odds of all tokens).
- The other third calibrates. ``drift`` is taken from every score, so that neutral text lowers a segment; a word that was among
  the last ``recent`` words brings nothing new and scores -drift at most. For clean text the largest segment of n tokens exceeds
  x with probability 1 - exp(-K n e^(-lambda x)), with the lambda and K of greatest likelihood for its clean texts. A logistic
  curve turns a document's evidence into a probability.

Scoring: a linear scan finds all maximal scoring segments of a text (Ruzzo and Tompa's rule). A segment is a toxic passage
if fewer than ``expected`` such segments are expected in clean text of that length. The evidence of a document is
ln(1 + sum over segments of e^(lambda score) / (K n)); nothing but the text is looked at.

Defined results: null and empty texts have no evidence and the score of such; labels null or neither 0 nor 1 are not learned
from, an id with several labels counts as toxic; repeated rows are scored alike; without labels of both kinds the score is
the share of toxic labels (0.5 without any). An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceloom.llm.common import Words, buffers, byte_table, saved, ship, steps, text_or_empty


@dataclass(frozen=True)
class Settings:
    max_train: int = 20_000
    prior: float = 6.0
    least_count: int = 3
    least_change: float = 0.05
    prefix: int = 10
    drift: float = 0.25
    recent: int = 32
    expected: float = 0.05


@dataclass
class Model:
    """Scores of prefixes (whole words end with a line feed) and the calibration; bounded by the sample it was fitted on."""

    scores: dict[str, float] = field(default_factory=dict)
    prefix: int = 10
    drift: float = 0.25
    recent: int = 32
    lam: float = 1.0
    k: float = 1.0
    expected: float = 0.05
    intercept: float = 0.0
    slope: float = 0.0

    def of_word(self, word: str) -> float:
        found = self.scores.get(word + "\n")
        for n in range(min(len(word), self.prefix), 0, -1):
            if found is not None:
                break
            found = self.scores.get(word[:n])
        return (found or 0.0) - self.drift

    def evidence(self, segments: list[tuple[float, int, int]], n_words: int) -> float:
        if not segments:
            return 0.0
        logs = [self.lam * s - math.log(self.k * n_words) for s, _, _ in segments]
        top = max(0.0, *logs)
        return top + math.log(math.exp(-top) + sum(math.exp(x - top) for x in logs))

    def significant(self, score: float, n_words: int) -> bool:
        return math.log(self.k * n_words) - self.lam * score < math.log(self.expected)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(500.0, max(-500.0, self.intercept + self.slope * evidence))))


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, end), in linear time.

    Runs of scores of one sign are summed first. A candidate remembers the sums to the left and to the right of it; a new
    one joins the candidates back to the nearest that began at a smaller sum, if its own right sum is the larger.
    """
    positive = scores > 0
    if not positive.any():
        return []
    cuts = np.flatnonzero(np.diff(positive)) + 1
    starts = np.concatenate([[0], cuts])
    sums = np.add.reduceat(scores, starts)
    ends = np.append(cuts, len(scores))
    total, found = 0.0, []  # (left sum, right sum, first, end, candidate to look at next)
    for value, first, end in zip(sums.tolist(), starts.tolist(), ends.tolist(), strict=True):
        if value <= 0:
            total += value
            continue
        left, right = total, total + value
        total = right
        at = len(found) - 1
        while True:
            while at >= 0 and found[at][0] >= left:
                at = found[at][4]
            if at < 0 or found[at][1] >= right:
                found.append((left, right, first, end, at))
                break
            left, first = found[at][0], found[at][2]
            before = found[at][4]
            del found[at:]
            at = before if before < len(found) else len(found) - 1
    return [(right - left, first, end) for left, right, first, end, _ in found]


# ----- words of texts ---------------------------------------------------------------------------------------------


def _word_batches(texts: pa.Array) -> Iterator[tuple[int, Words, np.ndarray, list[bytes]]]:
    """(first row, words, code of each word, word of each code) of some rows at a time."""
    table = byte_table(None)
    data, offsets = buffers(texts)
    for start, stop in steps(offsets):
        part = offsets[start : stop + 1]
        words = Words(data[part[0] : part[-1]], part - part[0], table)
        codes, distinct = pd.factorize(words.hashes)
        place = np.zeros(len(distinct), np.int64)
        place[codes[::-1]] = np.arange(len(codes))[::-1]
        raw = words.data.tobytes()
        yield start, words, codes, [raw[a:b] for a, b in zip(words.starts[place].tolist(), words.ends[place].tolist(), strict=True)]


def _lower(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower()


class Scorer:
    """Scores the words of batches; remembers up to ``limit`` distinct words, then begins anew."""

    def __init__(self, model: Model, limit: int = 200_000):
        self.model, self.limit, self.known = model, limit, {}

    def rows(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, scores of its words, bytes at which they begin)."""
        for start, words, codes, distinct in _word_batches(texts):
            if len(self.known) + len(distinct) > self.limit:
                self.known.clear()
            for word in distinct:
                if word not in self.known:
                    self.known[word] = self.model.of_word(_lower(word))
            scores = np.fromiter((self.known[w] for w in distinct), np.float64, len(distinct))[codes]
            order = np.argsort(codes, kind="stable")
            again = (np.diff(codes[order]) == 0) & (np.diff(order) <= self.model.recent)
            row = words.row_of_word()[order]
            again = order[1:][again & (np.diff(row) == 0)]
            scores[again] = np.minimum(scores[again], -self.model.drift)
            for k in range(len(words.rows) - 1):
                a, b = words.rows[k], words.rows[k + 1]
                yield start + k, scores[a:b], words.starts[a:b]


# ----- learning ---------------------------------------------------------------------------------------------------


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, settings: Settings) -> DataFrame:
    """(text, label, part) of at most max_train labelled ids; part 2 calibrates."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    known = known.where("id is not null").orderBy(F.xxhash64("id"), "id").limit(settings.max_train)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    sample = texts.join(F.broadcast(known), "id")  # at most max_train rows
    return sample.select("text", "label", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)).cast("int").alias("part"))


def _prefix_counts(sample: DataFrame, settings: Settings) -> pa.Table:
    """(node, clean, toxic): in how many texts of the first two parts prefixes and words occur (a prefix once per word)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list[int]] = {}
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for start, words, codes, distinct in _word_batches(batch.column(0)):
                once = np.unique(words.row_of_word() * len(distinct) + codes)
                row, code = np.divmod(once, max(1, len(distinct)))
                both = np.bincount(code, minlength=len(distinct)), np.bincount(code, toxic[start + row], len(distinct))
                for word, n, bad in zip(distinct, *map(np.ndarray.tolist, both), strict=True):
                    entry = totals.setdefault(_lower(word), [0, 0])
                    entry[0] += n - int(bad)
                    entry[1] += int(bad)
        names = list(totals)
        columns = [pa.array(names, pa.string()), *(pa.array([totals[w][k] for w in names], pa.int64()) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, ["word", "clean", "toxic"])

    learned = sample.where("part < 2").select("text", F.col("label").cast("int")).dropDuplicates(["text"])
    words = learned.mapInArrow(count, "word string, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    whole = F.concat("word", F.lit("\n"))
    nodes = F.transform(F.sequence(F.lit(0), F.least(F.length("word"), F.lit(settings.prefix))), lambda n: F.when(n == 0, whole).otherwise(F.col("word").substr(F.lit(1), n.cast("int"))))
    nodes = words.select(F.explode(nodes).alias("node"), "clean", "toxic").groupBy("node").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    return nodes.where(F.col("clean") + F.col("toxic") >= settings.least_count).toArrow()  # bounded by the sample


def _log_odds(counts: pa.Table, settings: Settings) -> dict[str, float]:
    """Scores by node. A node's prior mean comes from its prefix without the node's own texts, so none counts twice.

    Nodes that score as their prefix does are left out.
    """
    nodes = counts.column("node").to_pylist()
    numbers = np.stack([counts.column(c).to_numpy().astype(np.int64) for c in ("clean", "toxic")], 1).tolist()
    first = [n for node, n in zip(nodes, numbers, strict=True) if len(node) == 1]
    clean, toxic = (sum(n[k] for n in first) for k in (0, 1))
    share = (toxic + 0.5) / (clean + toxic + 1.0)
    known = {"": (clean, toxic, share)}  # texts, prior mean
    base = math.log(share / (1 - share))
    scores: dict[str, float] = {"": 0.0}
    for k in sorted(range(len(nodes)), key=lambda k: (nodes[k].endswith("\n"), len(nodes[k]))):
        node, (clean, toxic) = nodes[k], numbers[k]
        parent = node[:-1][: settings.prefix]
        while parent not in known:
            parent = parent[:-1]
        up_clean, up_toxic, up_mean = known[parent]
        others = up_clean + up_toxic - clean - toxic
        mean = (up_toxic - toxic + settings.prior * up_mean) / (others + settings.prior)
        p = (toxic + settings.prior * mean) / (clean + toxic + settings.prior)
        if not node.endswith("\n"):
            known[node] = (clean, toxic, mean)
        score = math.log(p / (1 - p)) - base
        while parent not in scores:
            parent = parent[:-1]
        if abs(score - scores[parent]) > settings.least_change:
            scores[node] = score
    return scores


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method; the slope has a prior around 1, so that few rows cannot turn it round."""
    design = np.stack([np.ones_like(x), x], 1)
    centre, weight = np.array([0.0, 1.0]), np.array([0.01, 1.0])

    def loss(beta: np.ndarray) -> float:
        z = design @ beta
        return float(np.logaddexp(0, z).sum() - y @ z + (weight * (beta - centre) ** 2).sum() / 2)

    beta = centre
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        gradient = design.T @ (y - p) - weight * (beta - centre)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(weight)
        step = np.linalg.solve(hessian, gradient)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()) -> Model:
    ship(docs.sparkSession)
    sample = saved(training_sample(docs, labels, id_col, text_col, label_col, settings))
    shown = {row.label: row.n for row in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_bad, n = shown.get(1, 0), sum(shown.values())
    share = (n_bad + 0.5) / (n + 1)
    model = Model(prefix=settings.prefix, drift=settings.drift, recent=settings.recent, expected=settings.expected, intercept=math.log(share / (1 - share)))
    if not n_bad or n_bad == n:
        return model
    model.scores = _log_odds(_prefix_counts(sample, settings), settings)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(label, words, scores of the segments) of each text."""
        scorer = Scorer(model)
        for batch in batches:
            out = [(row, len(s), [x for x, _, _ in segments(s)]) for row, s, _ in scorer.rows(batch.column(0))]
            rows, sizes, found = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["label", "words", "found"])

    held = sample.where("part = 2").select("text", F.col("label").cast("int"))
    rows = held.mapInArrow(measure, "label int, words bigint, found array<double>").toArrow()  # at most max_train rows
    label, sizes = (rows.column(c).to_numpy() for c in ("label", "words"))
    found = rows.column("found").to_pylist()
    tops = np.array([max(x, default=0.0) for x in found])
    clean = label == 0
    if clean.any():
        model.lam, model.k = _gumbel(tops[clean], np.maximum(1, sizes[clean]).astype(float))
    x = np.array([model.evidence([(s, 0, 0) for s in texts], max(1, int(n))) for texts, n in zip(found, sizes, strict=True)])
    if 0 < label.sum() < len(label):
        model.intercept, model.slope = _logistic(x, label.astype(float))
        model.slope = max(0.0, model.slope)
    return model


def _gumbel(tops: np.ndarray, sizes: np.ndarray) -> tuple[float, float]:
    """lambda and K of greatest likelihood for largest segments; a top of 0 only says that none is larger."""
    seen = tops[tops > 0]
    if not len(seen):
        return 1.0, 1.0 / float(sizes.sum())
    best = (-math.inf, 1.0, 1.0)
    for lam in np.geomspace(0.05, 10, 200):
        k = len(seen) / float((sizes * np.exp(-lam * tops)).sum())
        likelihood = len(seen) * (math.log(lam) + math.log(k)) - lam * float(seen.sum())
        best = max(best, (likelihood, float(lam), k))
    return best[1], best[2]


# ----- scoring ----------------------------------------------------------------------------------------------------


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with toxicity (probability) and toxic_passages (score, first byte, words) after the other columns."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    place = names.index(text_col)
    passage = pa.list_(pa.struct([("score", pa.float64()), ("first_byte", pa.int64()), ("words", pa.int64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model)
        for batch in batches:
            offsets = buffers(batch.column(place))[1]
            base = np.zeros(batch.num_rows, np.int64)
            for start, stop in steps(offsets):
                base[start:stop] = offsets[start:stop] - offsets[start]
            values, passages = [], []
            for row, scores, begins in scorer.rows(batch.column(place)):
                found = segments(scores)
                values.append(model.probability(model.evidence(found, max(1, len(scores)))))
                passages.append([{"score": s, "first_byte": int(begins[a] - base[row]), "words": b - a} for s, a, b in found if model.significant(s, len(scores))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64()), pa.array(passages, passage)], [*names, "toxicity", "toxic_passages"])

    fields = [T.StructField(f.name, f.dataType) for f in docs.schema]
    kind = T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("first_byte", T.LongType()), T.StructField("words", T.LongType())]))
    return docs.mapInArrow(score, T.StructType([*fields, T.StructField("toxicity", T.DoubleType()), T.StructField("toxic_passages", kind)]))
