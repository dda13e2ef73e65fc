"""Quality scores from a regularised quadratic discriminant.

Document statistics (length, word, case, symbol, repetition and line shape; whole
texts) are transformed to near-normal scales, ratios with a small prior so that short
texts stay in the middle. Each class gets its mean and a covariance that is shrunk
towards its own diagonal and the pooled one; the Cholesky factors are computed once and
cached in the model. The score is the logistic of the log-density difference plus the
log prior odds.

Sums of x and x x' are formed inside the tasks that read the statistics, so only one
small row per task and class is gathered; all labelled training rows count.

Null and empty texts are a text without words and get a score. Labels other than 0 and
1, null labels and doc_ids labelled both ways are not learned from. With no row of a
class the score is the prior. Repeated rows are scored alike; other columns are ignored.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from rollspan.llm import worker
from rollspan.llm.tokens import slices
from rollspan.session import cut

SHRINK_DIAGONAL = 0.1
SHRINK_POOLED = 0.1
FLOOR = 1e-4
NAMES = (
    "log_chars", "log_words", "word_length", "length_spread", "upper", "symbols", "marks",
    "digits", "pipes", "distinct", "repeats", "top_word", "line_words", "no_stop", "capital",
)
_SYMBOLS = b"#$%&*=<>^~_@\\+{}[]"
_LOWER = bytes(range(97, 123))
_UPPER = bytes(range(65, 91))


def _logit(count, total, prior, weight):
    p = (count + prior * weight) / (total + weight)
    return math.log(p / (1 - p)) if p < 1 else 12.0


def statistics(text):
    """The transformed statistics of one text, in the order of NAMES."""
    raw = text.encode() if text else b""
    words = raw.split()
    n, chars = len(words), len(raw)
    sizes = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    upper = chars - len(raw.translate(None, _UPPER))
    lower = chars - len(raw.translate(None, _LOWER))
    symbols = chars - len(raw.translate(None, _SYMBOLS))
    digits = chars - len(raw.translate(None, b"0123456789"))
    marks = raw.count(b"!")
    pipes = raw.count(b"|")
    counts = Counter(words)
    pairs = sum(map(bytes.__eq__, words[1:], words[:-1])) if n > 1 else 0
    top = max(counts.values(), default=0)
    lines = raw.count(b"\n") + 1
    stops = raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")
    capital = sum(w[:1].isupper() for w in words)
    return (
        math.log1p(chars),
        math.log1p(n),
        math.log((sizes.sum() + 5.0 * 8) / (n + 8)),
        0.5 * math.log((n * float(sizes.var()) + 12 * 8.0) / (n + 12)),
        _logit(upper, upper + lower, 0.04, 20),
        _logit(symbols, chars, 0.005, 40),
        _logit(marks, chars, 0.002, 40),
        _logit(digits, chars, 0.005, 40),
        _logit(pipes, n, 0.01, 10),
        _logit(len(counts), max(n, 1) ** 0.9, 0.7, 10) if n else 0.0,
        _logit(pairs, n, 0.01, 10),
        _logit(top, n, 0.1, 10),
        math.log1p(n / lines),
        _logit(stops, n, 0.1, 10),
        _logit(capital, n, 0.12, 10),
    )


def _measure(batches):
    worker.enter("quality")
    for batch in batches:
        for lo, hi in slices(batch):
            part = batch.slice(lo, hi - lo)
            x = [np.array(statistics(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"]
            )


def document_statistics(docs):
    """Written table: doc_id and the vector of statistics of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cut(rows.mapInArrow(_measure, "doc_id long, x array<double>"))


def _partial_sums(batches):
    d = len(NAMES)
    sums = {c: [0, np.zeros(d), np.zeros((d, d))] for c in (0, 1)}
    for batch in batches:
        if batch.num_rows == 0:
            continue
        x = np.asarray(batch.column("x").flatten()).reshape(-1, d)
        y = np.asarray(batch.column("label"))
        for c, held in sums.items():
            own = x[y == c]
            held[0] += len(own)
            held[1] += own.sum(axis=0)
            held[2] += own.T @ own
    yield pa.RecordBatch.from_pydict(
        {
            "label": pa.array([0, 1], pa.int32()),
            "k": pa.array([sums[c][0] for c in (0, 1)], pa.int64()),
            "v": [np.concatenate([sums[c][1], sums[c][2].ravel()]) for c in (0, 1)],
        }
    )


def fit(measured, labels, train):
    """Class sums over all training rows -> the discriminant's parameters."""
    clean = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label"))
        .filter("label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .filter("label = other")
        .select("doc_id", "label")
    )
    rows = measured.filter(train).join(clean, "doc_id").select("label", "x")
    partial = rows.mapInArrow(_partial_sums, "label int, k long, v array<double>")
    sums = (
        partial.filter("k > 0").select("label", "k", F.posexplode("v").alias("i", "s"))
        .groupBy("label", "i")
        .agg(F.sum("k").alias("k"), F.sum("s").alias("s"))
        .collect()
    )
    return discriminant(sums)


def discriminant(sums):
    """Means, shrunk covariances' Cholesky factors, log determinants and log priors."""
    d, model = len(NAMES), {}
    counts = {r["label"]: r["k"] for r in sums}
    total = sum(counts.values())
    moments = {}
    for c, n in counts.items():
        v = np.zeros(d + d * d)
        for r in sums:
            if r["label"] == c:
                v[r["i"]] = r["s"]
        mean = v[:d] / n
        moments[c] = mean, v[d:].reshape(d, d) / n - np.outer(mean, mean)
    if not total:
        return {"prior": 0.0, "classes": {}}
    pooled = sum(counts[c] * cov for c, (_, cov) in moments.items()) / total
    for c, (mean, cov) in moments.items():
        few = (d + 1) / (counts[c] + d + 1)
        towards = min(1.0, SHRINK_POOLED + few)
        cov = (1 - towards) * cov + towards * pooled
        cov = (1 - SHRINK_DIAGONAL) * cov + SHRINK_DIAGONAL * np.diag(np.diag(cov))
        cov = cov + FLOOR * np.eye(d)
        factor = np.linalg.cholesky(cov)
        model[c] = mean, factor, 2 * float(np.log(np.diag(factor)).sum())
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    return {"prior": math.log((n1 + 1) / (n0 + 1)), "classes": model}


def log_odds(model, x):
    """Log-density difference of class 1 and 0 plus log prior odds, row by row."""
    if len(model["classes"]) < 2:
        return np.full(len(x), model["prior"])
    density = {}
    for c, (mean, factor, logdet) in model["classes"].items():
        z = np.linalg.solve(factor, (x - mean).T)
        density[c] = -0.5 * ((z * z).sum(axis=0) + logdet)
    return density[1] - density[0] + model["prior"]


def score(measured, model):
    """doc_id and score in [0, 1] of every measured row."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)
            odds = np.clip(log_odds(model, x), -700, 700)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-odds)))], names=["doc_id", "score"]
            )

    return measured.mapInArrow(run, "doc_id long, score double")


def keep(docs, model, least):
    """The rows whose own text scores `least` or more, all columns as they were."""
    names, place = docs.columns, docs.columns.index("text")

    def run(batches):
        worker.enter("quality")
        for batch in batches:
            for lo, hi in slices(batch):
                part = batch.slice(lo, hi - lo)
                x = np.array([statistics(t) for t in part.column(place).to_pylist()])
                odds = np.clip(log_odds(model, x), -700, 700)
                yield part.filter(pa.array(1 / (1 + np.exp(-odds)) >= least))
        worker.release()

    rows = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in names])
    return rows.mapInArrow(run, rows.schema)


def held_out():
    """Rows kept from training: crc32 of the doc_id's text divisible by 5 (null is '')."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 0


def classify(docs, labels):
    """doc_id, held_out, score and predicted (score of 0.3 or more) per row."""
    measured = document_statistics(docs)
    model = fit(measured, labels, ~held_out())
    return score(measured, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )
