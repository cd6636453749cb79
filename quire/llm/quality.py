"""Quality classification by hierarchical empirical Bayes.

Evidence of a document: two logistic regressions (toxic, low quality) over the words, and beginnings
of words, that tell the labels apart best and over shares of kinds of characters, fitted on a bounded sample of the labelled documents (SAMPLE). Evidence of its site: the
rates at which documents of its host and of its path are bad. A host's rate is its documents' evidence shrunk toward the
global rate, a path's toward its host's; the strength of either prior comes from the rates' variance beyond chance (method
of moments), so sparse sites lean on their prior and rich ones on themselves. A document's own evidence is left out of its
site's. Both meet in log odds: posterior = evidence + path rate - global rate.

Rates are grouped aggregates with partial sums, so a hot host is no hot task; sites are sent to every task while they are
few (BROADCAST_SITES), else joined with salted keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import _text as tx
from quire.llm.components import folder

#: Labelled documents that the regressions are fitted on, at most: those with the lowest hash of doc_id.
SAMPLE = 12_000
#: Words and beginnings of words (of so many bytes) that a regression takes in, at most.
SIGNS = 256
BEGINNINGS = (4, 5, 6)
RIDGE = 0.1
FITTED = 1_000
#: Documents are rejected from this probability of being bad.
REJECT = 0.5
BROADCAST_SITES = 1 << 18
SALTS = 16
_MARKS = b"!?|%$&*#@^~=+<>{}[]\\/_;:"
_N_SHARES = len(_MARKS) + 7


def _shares(raw: np.ndarray, off: np.ndarray, w: tx.Words, h: np.ndarray) -> np.ndarray:
    """Shares of kinds of characters and words, by document."""
    kinds = [(raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57), raw == 10, *((raw == m) for m in _MARKS)]
    at = lambda x: np.diff(np.r_[0, np.cumsum(x)][off])
    n, words = np.maximum(np.diff(off), 1), np.maximum(w.counts, 1)
    doc = np.repeat(np.arange(len(off) - 1), w.counts)
    distinct = np.bincount((np.unique((doc.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12))) >> np.uint64(52)).astype(np.int64), minlength=len(off) - 1)
    length = np.bincount(doc, w.end - w.start, len(off) - 1)
    return np.column_stack([*(np.sqrt(at(k) / n) for k in kinds), distinct / words, length / words / 10, np.log1p(words) / 10, w.counts == 0])


def _signs(w: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, documents) of each document's words and of what longer words begin with."""
    hashes, owners = [w.hashes()], [np.repeat(np.arange(len(w.first) - 1), w.counts)]
    for n in BEGINNINGS:
        long = w.end - w.start > n
        hashes.append(tx.hash_spans(w.buf, w.start[long], w.start[long] + n) + np.uint64(n))
        owners.append(owners[0][long])
    return np.concatenate(hashes), np.concatenate(owners)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, raw, off in tx.slices(b.column(2)):
            w = tx.Words(raw, off, tx.ALPHANUMERIC)
            h, doc = _signs(w)
            order = np.argsort(doc, kind="stable")
            h, edge = h[order], np.searchsorted(doc[order], np.arange(hi - lo + 1))
            signs = [np.unique(h[edge[i] : edge[i + 1]]).view(np.int64) for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(signs, pa.list_(pa.int64())), pa.array(list(_shares(raw, off, w, w.hashes())), pa.list_(pa.float64()))], ["toxic", "low", "signs", "shares"])


class Regression:
    """Ridge logistic regression by Newton's method over presence of signs and standardised shares."""

    def __init__(self, keys: np.ndarray, present: np.ndarray, shares: np.ndarray, y: np.ndarray):
        self.keys = keys
        self.mean, self.scale = (shares.mean(0), np.maximum(shares.std(0), 1e-3)) if len(y) else (np.zeros(shares.shape[1]), np.ones(shares.shape[1]))
        m = shares.shape[1]
        self.weights = np.zeros(1 + m + len(keys))
        if not len(y) or y.min() == y.max():  # one kind of label only: nothing to tell apart
            rate = min(max(y.mean() if len(y) else 0.0, 1e-3), 1 - 1e-3)
            self.weights[0] = np.log(rate / (1 - rate))
            return
        ridge = np.full(len(self.weights), RIDGE)
        ridge[0] = 1e-6
        for _ in range(25):
            slope, bend = -ridge * self.weights, np.diag(ridge)
            for a in range(0, len(y), FITTED):  # the driver holds the design of so many rows at once
                x = np.column_stack([np.ones(len(y[a : a + FITTED])), (shares[a : a + FITTED] - self.mean) / self.scale, present[a : a + FITTED]])
                p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
                slope += x.T @ (y[a : a + FITTED] - p)
                bend += (x.T * (p * (1 - p) + 1e-6)) @ x
            step = np.linalg.solve(bend, slope)
            self.weights += step
            if np.abs(step).max() < 1e-6:
                break

    def probability(self, h: np.ndarray, doc: np.ndarray, shares: np.ndarray) -> np.ndarray:
        m, k = shares.shape[1], max(len(self.keys), 1)
        z = self.weights[0] + ((shares - self.mean) / self.scale) @ self.weights[1 : m + 1]
        at, key = tx.Lookup(self.keys).find(h)
        pair = np.unique(doc[at] * k + key)
        if len(pair):
            z += np.bincount(pair // k, self.weights[m + 1 :][pair % k], len(shares))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(documents: DataFrame, labels: DataFrame) -> tuple[Regression, Regression]:
    """The regressions (toxic, low quality) on the sample. Several labels of one doc_id count as the worst of them; a null label is none."""
    labels = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("double").alias("toxic"), (1 - labels["quality"].cast("double")).alias("low"))
    labels = labels.where("doc_id is not null and (toxic is not null or low is not null)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("low").alias("low"))
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), tx.text_or_empty(documents).alias("text")).join(F.broadcast(sample), "doc_id").select("toxic", "low", "text")  # SAMPLE labels
    rows = rows.mapInArrow(tx.released(_features), "toxic double, low double, signs array<long>, shares array<double>").checkpoint()
    # how far a sign's share of bad documents is from all documents' (chi-square), for signs of five documents at least
    counted = rows.select("toxic", "low", F.explode("signs").alias("sign")).groupBy("sign").agg(*(f(c).cast("double").alias(f"{n}_{c}") for c in ("toxic", "low") for n, f in (("n", F.count), ("bad", F.sum)))).where("n_toxic >= 5 or n_low >= 5").checkpoint()
    out = []
    for c in ("toxic", "low"):
        rate = rows.agg(F.avg(c)).first()[0] or 0.0
        keys = np.zeros(0, np.uint64)
        if 0 < rate < 1:
            off = (F.col(f"bad_{c}") - F.col(f"n_{c}") * rate) ** 2 / F.col(f"n_{c}")
            keys = np.sort(np.array([r["sign"] for r in counted.where(f"n_{c} >= 5").orderBy(F.desc(off), "sign").limit(SIGNS).collect()], np.int64).view(np.uint64))
        own = rows.where(F.col(c).isNotNull()).select(c, "shares", F.array_intersect("signs", F.array(*(F.lit(int(k)) for k in keys.view(np.int64))).cast("array<long>")).alias("signs")).toArrow()  # SAMPLE rows of SIGNS signs at most
        signs = own.column("signs").combine_chunks()
        present = np.zeros((len(own), len(keys)), bool)
        present[np.repeat(np.arange(len(own)), np.diff(signs.offsets.to_numpy())), np.searchsorted(keys, signs.flatten().to_numpy().view(np.uint64))] = True
        shares = own.column("shares").combine_chunks().flatten().to_numpy().reshape(len(own), _N_SHARES)
        out.append(Regression(keys, present, shares, (own.column(c).to_numpy() > 0).astype(float)))
    return out[0], out[1]


def evidence(documents: DataFrame, models: tuple[Regression, Regression], host: Column, path: Column, row: Column) -> DataFrame:
    """doc_id (row), host, path, toxic and low (probabilities) of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, off in tx.slices(b.column(3)):
                w = tx.Words(raw, off, tx.ALPHANUMERIC)
                h, doc = _signs(w)
                shares = _shares(raw, off, w, h[: len(w.start)])
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in range(3)), *(pa.array(m.probability(h, doc, shares)) for m in models)], ["doc_id", "host", "path", "toxic", "low"])

    rows = documents.select(row.cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), tx.text_or_empty(documents).alias("text"))
    return rows.mapInArrow(tx.released(score), "doc_id long, host string, path string, toxic double, low double")


def _strength(groups: DataFrame, prior: Column) -> float:
    """How many documents a prior is worth: from the variance of groups' rates around it beyond what chance gives; groups have n and s."""
    rate = F.col("s") / F.col("n")
    r = groups.agg(F.sum(F.col("n") * (rate - prior) ** 2), F.sum(prior * (1 - prior)), F.sum("n"), F.sum(F.col("n") * prior * (1 - prior))).first()
    if not r[2]:
        return 2.0
    between, within = max((r[0] - r[1]) / r[2], 1e-9), r[3] / r[2]
    return float(min(max(within / between - 1, 2.0), 1e5))


def _log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def classify(documents: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", reject: float = REJECT, row: str = "doc_id") -> DataFrame:
    """One row per row of documents: doc_id, host, path, toxic, low, evidence, host_rate, path_rate, posterior, keep.

    host and path name columns; a path is one of its host. row names the column of longs that doc_id of the result takes
    its values from; labels always go by doc_id. Nulls in them, in doc_id and in texts count as empty; a text
    without words is judged by its shares alone. Rows that repeat are judged alike. Without labels, or with labels of one
    kind, every document has the same evidence; an empty table gives none. Other columns are ignored.
    """
    spark = documents.sparkSession
    tx.importable(spark)
    folder(spark)
    rows = evidence(documents, fit(documents, labels), documents[host], documents[path], documents[row]).withColumn("evidence", 1 - (1 - F.col("toxic")) * (1 - F.col("low"))).checkpoint()
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s")).checkpoint()
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    n, s = paths.agg(F.sum("n"), F.sum("s")).first()
    overall = min(max((s or 0.0) / (n or 1), 1e-6), 1 - 1e-6)
    weight = _strength(hosts, F.lit(overall))
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((F.col("s") + weight * overall) / (F.col("n") + weight)).alias("host_rate"))
    sites = paths.join(hosts, "host")
    path_weight = _strength(sites, F.col("host_rate"))
    if paths.count() <= BROADCAST_SITES:
        both = rows.join(F.broadcast(sites), ["host", "path"])
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        both = salted.join(sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "path", "salt"])
    host_rate = (F.col("host_s") - F.col("evidence") + weight * overall) / (F.col("host_n") - 1 + weight)
    both = both.withColumn("host_rate", host_rate)
    both = both.withColumn("path_rate", (F.col("s") - F.col("evidence") + path_weight * F.col("host_rate")) / (F.col("n") - 1 + path_weight))
    odds = _log_odds(F.col("evidence")) + _log_odds(F.col("path_rate")) - _log_odds(F.lit(overall))
    both = both.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return both.select("doc_id", "host", "path", "toxic", "low", "evidence", "host_rate", "path_rate", "posterior", (F.col("posterior") < reject).alias("keep"))
