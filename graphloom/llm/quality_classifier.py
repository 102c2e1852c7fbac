"""Quality classification by hierarchical empirical Bayes.

Three sources of evidence meet in one log odds.  A logistic regression over hashed words and
character rates, fitted on a bounded sample of labelled documents, gives the evidence of the text.
The mean of its probabilities over a host, shrunk toward the mean of all documents, and over a
path of the host, shrunk toward the host, give the site's evidence; a document's own probability is
left out of its site's.  How far sites shrink comes from the data: prior strengths by the method of
moments.  The site then moves the prior odds of the text, at most by ``max_shift``.  There are two
heads: quality (label 1 is good) and toxicity (label 1 is toxic).

The classifier has 2^18 weights per head whatever the corpus; site sums are grouped aggregates with
partial sums, so a hot host needs no more than a row per task.

Defined results: a null text is an empty one.  Null hosts and paths are sites like others.  Labels
of one id are merged to the least quality and the largest toxicity; null labels teach nothing.
Without labels of both classes a head gives the prior 0.5 and rejects nothing.  Repeated rows count
each time.  An empty table gives an empty result.  Existing columns of the same name are replaced.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import append_columns, apart, release_memory, texts
from graphloom.storage import discard, materialize, slices

BITS = 18
#: Bytes of features that come to the driver at once.
COLLECTED = 1 << 23
HEADS = ("quality", "toxic")
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Byte classes of the character rates: upper case, lower case, digits, other bytes above 127, and each other byte by itself.
_CLASS = np.array([1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 else 3 if 48 <= c <= 57 else 4 if c >= 128 else c for c in range(256)])


def features(text: bytes) -> np.ndarray:
    """Hashed features: distinct words and their beginnings, rates of byte classes by powers of two, share of distinct
    words and length."""
    words = text.translate(_WORDS).split()
    distinct = set(words)
    out = list(map(zlib.crc32, distinct))
    out += map(zlib.crc32, {b"^" + w[:5] for w in distinct if len(w) > 5})
    if text:
        rates = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=128) / len(text)
        for c in np.flatnonzero(rates):
            out.append(zlib.crc32(b"rate %d %d" % (c, int(2 * np.log2(rates[c])))))
    if words:
        out.append(zlib.crc32(b"distinct %d" % (10 * len(distinct) // len(words))))
    out.append(zlib.crc32(b"length %d" % len(words).bit_length()))
    return np.unique(np.array(out, np.uint32) & ((1 << BITS) - 1))


@dataclass
class Classifier:
    #: by head: weights and bias, or None if the labels can't tell
    weights: dict[str, tuple[np.ndarray, float] | None]

    def log_odds(self, found: np.ndarray) -> list[float]:
        return [0.0 if (w := self.weights[h]) is None else float(w[0][found].sum(dtype=np.float64) + w[1]) for h in HEADS]


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 8, batch: int = 256, rate: float = 0.3, decay: float = 1e-6) -> tuple[np.ndarray, float] | None:
    """Logistic regression by AdaGrad, the rarer class weighted up by the root of its rarity; the
    order of rows comes from a fixed seed."""
    if len(rows) == 0 or labels.min() == labels.max():
        return None
    share = labels.mean()
    weight = np.where(labels > 0, max(1.0, (1 - share) / share) ** 0.5, max(1.0, share / (1 - share)) ** 0.5)
    w, b = np.zeros(1 << BITS), 0.0
    sw, sb = np.full(1 << BITS, 1e-2), 1e-2
    order = np.random.default_rng(7)
    for _ in range(epochs):
        shuffled = order.permutation(len(rows))
        for i in range(0, len(rows), batch):
            at = shuffled[i : i + batch]
            ids = np.concatenate([rows[j] for j in at])
            doc = np.repeat(np.arange(len(at)), [len(rows[j]) for j in at])
            z = np.bincount(doc, weights=w[ids], minlength=len(at)) + b
            err = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - labels[at]) * weight[at]
            g = np.bincount(ids, weights=err[doc], minlength=1 << BITS) / len(at)
            hit = np.unique(ids)
            g = g[hit] + decay * w[hit]
            sw[hit] += g * g
            w[hit] -= rate * g / np.sqrt(sw[hit])
            gb = err.mean()
            sb += gb * gb
            b -= rate * gb / np.sqrt(sb)
    return w.astype(np.float32), float(b)


def cutoff(z: np.ndarray, labels: np.ndarray) -> float:
    """Middle of the cutoffs that make the fewest errors."""
    order = np.argsort(z)
    z, y = z[order], labels[order] > 0
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum(~y[::-1])[::-1], [0]])
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    best = edges[errors == errors.min()]
    return float((best.min() + best.max()) / 2)


def fit_and_cut(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Fit on four fifths and set the bias so that log odds of 0 part the last fifth best."""
    held = np.arange(len(rows)) % 5 == 4
    got = fit([r for r, h in zip(rows, held) if not h], labels[~held]) if len(rows) else None
    if got is None or not held.any():
        return got
    w, b = got
    z = np.array([w[r].sum(dtype=np.float64) + b for r, h in zip(rows, held) if h])
    return w, b - float(np.clip(cutoff(z, labels[held]), -2.0, 2.0))


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_labelled: int = 20_000) -> Classifier:
    """Fit both heads on about ``max_labelled`` labelled documents at most, chosen by a hash."""
    merged = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = merged.where(draw < F.lit(min(1.0, max_labelled / max(1, merged.count()))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")  # about max_labelled rows
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    many = rows.select("doc_id").count()
    if many > 2 * max_labelled:  # rows that share an id are all labelled; the bound on labelled rows holds for them too
        rows = rows.where(draw < F.lit(max_labelled / many))

    def make():
        def compute(column: pa.Array):
            return [[features(t).tobytes() for t in texts(column)]]

        return compute

    made = materialize(append_columns(rows, ["text"], "features binary", make).select("quality", "toxic", "doc_id", "features"), "features")
    label, names, found = collected(made)
    discard(made)
    order = ordered(names, found)
    out = {}
    for head in HEADS:
        known = [i for i in order if label[head][i] is not None]
        out[head] = fit_and_cut([found[i] for i in known], np.array([float(label[head][i] > 0) for i in known]))
    del found
    release_memory()  # the driver lives on; what it learnt from is not needed again
    return Classifier(out)


def collected(made: DataFrame) -> tuple[dict[str, list], list[int], list[np.ndarray]]:
    """Labels by head, a number of the id, and features of each row.  They come in parts of a few MB: a driver that takes
    all at once holds them several times, as results of tasks, in the socket and in Python."""
    label, names, found = {h: [] for h in HEADS}, [], []
    n = slices(made.agg(F.sum(F.length("features"))).first()[0] or 0, COLLECTED)
    for i in range(n):
        got = (made.where(F.pmod(F.xxhash64("doc_id", "features"), F.lit(n)) == i) if n > 1 else made).toArrow()  # columns, not a row object each
        for h in HEADS:
            label[h] += got[h].to_pylist()
        names += [zlib.crc32(str(x).encode()) for x in got["doc_id"].to_pylist()]
        found += [np.frombuffer(x.as_buffer(), np.uint32) for x in got["features"]]
    return label, names, found


def ordered(names: list[int], found: list[np.ndarray]) -> list[int]:
    """Positions by name, then by features; only rows of equal names need their bytes."""
    out = []
    for _, same in itertools.groupby(sorted(range(len(names)), key=names.__getitem__), names.__getitem__):
        own = list(same)
        out += own if len(own) == 1 else sorted(own, key=lambda i: found[i].tobytes())
    return out


def evidence(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """Add the log odds of the text for both heads."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def compute(column: pa.Array):
            return list(zip(*[shared.value.log_odds(features(t)) for t in texts(column)]))

        return compute

    return append_columns(docs, [text_col], ", ".join(f"text_{h} double" for h in HEADS), make)


def _p(log_odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (F.lit(1.0) - p))


def strength(groups: DataFrame, total: str, n: str, mean: float) -> float:
    """Prior strength of a level by the method of moments, from its groups' sums and sizes."""
    got = groups.agg(
        F.sum(F.col(n) * F.pow(F.col(total) / F.col(n) - mean, 2)).alias("spread"),
        F.sum(n).alias("n"),
        F.count("*").alias("groups"),
    ).first()
    if not got.n or got.groups < 2:
        return 1e4
    within = mean * (1 - mean)
    between = max(got.spread / got.n - within * got.groups / got.n, 1e-9)
    return float(min(max(within / between - 1, 2.0), 1e4))


def combine(scored: DataFrame, max_shift: float) -> DataFrame:
    """Add ``host_<head>``, ``path_<head>`` (posterior means) and ``p_<head>`` to rows with ``_host``,
    ``_path`` and the log odds of the text."""
    probs = {h: _p(F.col(f"text_{h}")) for h in HEADS}
    sums = scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), *[F.sum(probs[h]).alias(f"sum_{h}") for h in HEADS])
    paths = materialize(sums, "paths")
    hosts = materialize(paths.groupBy("_host").agg(F.sum("n").alias("n"), *[F.sum(f"sum_{h}").alias(f"sum_{h}") for h in HEADS]), "hosts")
    overall = hosts.agg(F.sum("n").alias("n"), *[F.sum(f"sum_{h}").alias(h) for h in HEADS]).first()
    prior = {h: overall[h] / overall["n"] if overall["n"] else 0.5 for h in HEADS}
    k_host = {h: strength(hosts, f"sum_{h}", "n", prior[h]) for h in HEADS}
    k_path = {h: strength(paths, f"sum_{h}", "n", prior[h]) for h in HEADS}
    own = paths.withColumnsRenamed({"_host": "_h", "_path": "_p", "n": "_path_n"} | {f"sum_{h}": f"_path_{h}" for h in HEADS})
    sites = own.join(hosts.withColumnsRenamed({"n": "_host_n"} | {f"sum_{h}": f"_host_{h}" for h in HEADS}), F.col("_h").eqNullSafe(F.col("_host"))).drop("_host")
    # a written row per path: the optimizer knows its size, broadcasts it below its own limit and splits a hot path otherwise
    sites = materialize(sites, "sites")
    out = scored.join(sites, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p")))
    for h in HEADS:
        host = (F.lit(k_host[h] * prior[h]) + F.col(f"_host_{h}") - probs[h]) / (F.lit(k_host[h] - 1) + F.col("_host_n"))
        out = out.withColumn(f"host_{h}", host)
        path = (F.lit(k_path[h]) * F.col(f"host_{h}") + F.col(f"_path_{h}") - probs[h]) / (F.lit(k_path[h] - 1) + F.col("_path_n"))
        out = out.withColumn(f"path_{h}", path)
        shift = _logit(F.col(f"path_{h}")) - _logit(F.lit(prior[h]))
        shift = F.least(F.greatest(shift, F.lit(-max_shift)), F.lit(max_shift))
        out = out.withColumn(f"p_{h}", _p(F.col(f"text_{h}") + shift))
    return out


OUTPUTS = (*(f"text_{h}" for h in HEADS), *(f"{x}_{h}" for h in HEADS for x in ("host", "path", "p")), "kept")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    id_col: str = "doc_id",
    max_labelled: int = 20_000,
    max_shift: float = 1.0,
    model: Classifier | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add evidence, site posteriors, probabilities and ``kept`` (good and not toxic) to each row.

    A host and a path of it may be any columns; ``documents`` has no addresses, so there the source stands
    for the host and the language for the path.  ``keep`` names the columns that pass through (default: all)."""
    if model is None:
        model = train(docs, labels, text_col, id_col, max_labelled)
    columns = [c for c in keep or docs.columns if c.lower() not in OUTPUTS]
    name = apart(list(dict.fromkeys([*columns, text_col])))
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in name.items()], F.col(f"`{host_col}`").alias("_host"), F.col(f"`{path_col}`").alias("_path"))
    scored = evidence(rows, model, name[text_col]).select(*[name[c] for c in columns], "_host", "_path", *[f"text_{h}" for h in HEADS])
    out = combine(materialize(scored, "evidence"), max_shift)
    bad = F.lit(False)
    if model.weights["quality"] is not None:
        bad = bad | (F.col("p_quality") < 0.5)
    if model.weights["toxic"] is not None:
        bad = bad | (F.col("p_toxic") >= 0.5)
    return out.select(*[F.col(name[c]).alias(c) for c in columns], *OUTPUTS[:-1], (~bad).alias("kept"))
