"""Models on pyspark.ml and small dense steps: naive Bayes on character n-grams, a perceptron on vectors, clustering of sites."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizer, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import letter_frequencies
from .vectors import padded_ngrams


def naive_bayes(df: DataFrame, text: str, label: str, features: int = 3000, smoothing: float = 0.1, least_documents: float = 2.0) -> PipelineModel:
    """Fitted on tf-idf of padded character n-grams; score with :func:`with_grams` and ``transform``."""
    stages = [
        StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"),
        CountVectorizer(inputCol="_grams", outputCol="_tf", vocabSize=features, minDF=least_documents),
        IDF(inputCol="_tf", outputCol="_x"),
        NaiveBayes(featuresCol="_x", labelCol="_y", smoothing=smoothing),
    ]
    return Pipeline(stages=stages).fit(with_grams(df, text))


def with_grams(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_grams", padded_ngrams(F.col(text), (2, 4)))


def perceptron(df: DataFrame, vector: str, label: str, dim: int, classes: int, hidden: tuple[int, ...] = (128, 64), seed: int = 42):
    """On vectors; labels are 0 to classes - 1."""
    rows = df.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"), F.col(label).cast("double").alias("label"))
    return MultilayerPerceptronClassifier(layers=[dim, *hidden, classes], seed=seed, maxIter=50).fit(rows)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): n / (k * count), for ``weightCol``."""
    c = df.groupBy(label).agg(F.count("*").alias("c"))
    t = c.agg(F.sum("c").alias("n"), F.count("*").alias("k"))
    return c.crossJoin(F.broadcast(t)).select(label, (F.col("n") / (F.col("k") * F.col("c"))).alias("weight"))


def ward(x: np.ndarray, k: int) -> list[int]:
    """Cluster numbers of rows by Ward's merging on cosine distances, by the Lance-Williams update."""
    n = len(x)
    length = np.linalg.norm(x, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        d = np.nan_to_num(1 - (x @ x.T) / np.outer(length, length), nan=1.0)
    d = np.maximum(d, 0) ** 2
    np.fill_diagonal(d, np.inf)
    size, member = np.ones(n), {i: [i] for i in range(n)}
    while len(member) > k:
        live = sorted(member)
        sub = d[np.ix_(live, live)]
        i, j = sorted(live[t] for t in np.unravel_index(sub.argmin(), sub.shape))
        for m in live:
            if m not in (i, j):
                t = size[i] + size[j] + size[m]
                d[i, m] = d[m, i] = ((size[i] + size[m]) * d[i, m] + (size[j] + size[m]) * d[j, m] - size[m] * d[i, j]) / t
        size[i] += size[j]
        member[i] += member.pop(j)
        d[j, :] = d[:, j] = np.inf
    out = [0] * n
    for c, i in enumerate(sorted(member, key=lambda i: min(member[i]))):
        for m in member[i]:
            out[m] = c
    return out


def silhouette(x: np.ndarray, labels: list[int]) -> float:
    y = np.array(labels)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
    s = []
    for i in range(len(x)):
        own = (y == y[i]) & (np.arange(len(x)) != i)
        if not own.any():
            s.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, y == c].mean() for c in set(labels) if c != y[i])
        s.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(s))


def site_clusters(df: DataFrame, site: str, text: str, alphabet: str, least_texts: int = 5, most: int = 8, most_sites: int = 2000) -> DataFrame:
    """(site, cluster, pc1, pc2): sites of ``least_texts`` or more by letter shares; the number of clusters has the best silhouette.

    Shares are an aggregation over all texts. Sites are few (an error beyond ``most_sites``, before any is gathered), and their matrix is one group's.
    """
    big = df.groupBy(site).agg(F.count("*").alias("_n")).where(F.col("_n") >= least_texts).select(site)
    if big.limit(most_sites + 1).count() > most_sites:
        raise ValueError(f"more than {most_sites} sites")
    shares = letter_frequencies(df.join(big, site, "left_semi"), site, text, alphabet)
    rows = shares.groupBy(site).agg(F.transform(F.array_sort(F.collect_list(F.struct("letter", "share"))), lambda s: s["share"]).alias("v")).withColumn("_one", F.lit(1))

    def cluster(frame):
        frame = frame.sort_values(site).reset_index(drop=True)
        x = np.array(frame["v"].tolist())
        n = len(x)
        best = max(((silhouette(x, lab), -k, lab) for k in range(2, min(most, n - 1) + 1) for lab in [ward(x.copy(), k)]), default=(0, 0, [0] * n))
        c = x - x.mean(axis=0)
        u, s, _ = np.linalg.svd(c, full_matrices=False)
        pc = (u * s)[:, :2] if n > 1 else np.zeros((n, 2))
        out = frame[[site]].copy()
        out["cluster"], out["pc1"], out["pc2"] = best[2], pc[:, 0], pc[:, 1] if pc.shape[1] > 1 else 0.0
        return out

    kind = df.schema[site].dataType.simpleString()
    return rows.groupBy("_one").applyInPandas(lambda f: cluster(f), f"{site} {kind}, cluster int, pc1 double, pc2 double")


def mock_embedding(words: DataFrame, word: str, dim: int = 32) -> DataFrame:
    """Vectors from SHA-256 bytes, of length 1: the same word has the same vector anywhere."""
    from .vectors import unit

    hexes = F.concat(*[F.sha2(F.concat(F.col(word), F.lit(f"|{k}")), 256) for k in range(-(-dim // 32))])
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1)
    return words.withColumn("vector", unit(raw))
