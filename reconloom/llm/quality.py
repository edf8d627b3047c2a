"""Quality by hierarchical empirical Bayes.

A logistic classifier on figures of the text gives each document a probability of being good. Its mean
over a path shrinks towards that of the host, the host's towards the whole corpus, the more the fewer
documents there are; how strongly is estimated from the spread of the means (empirical Bayes). A document's
score combines its own evidence with its path's posterior in place of the corpus-wide rate. That posterior is of
the other documents of the site: a document's own evidence counts once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconloom.llm.common import held_out, labelled_sample, slices, small, small_batches, table

#: Labelled rows at most that the classifier is fitted on.
SAMPLE = 20_000
KEEP = 0.5
FIGURES = ("words", "word_length", "upper", "repeated", "distinct", "bang", "pipe", "symbols", "digits", "lines", "line_copies", "sentences", "pairs")
_END = re.compile(r"[.!?](?:\s|$)")


def figures(text: str | None) -> list[float]:
    """Figures of a whole text, each bounded or a logarithm; all 0 without words."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FIGURES)
    lines = [x for x in text.split("\n") if x.strip()]
    size = len(text)
    share = lambda chars: sum(map(text.count, chars)) / n
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)
    return [
        float(np.log1p(n)),
        min(size / n, 40) / 10,
        sum(map(str.isupper, words)) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(set(words)) / n,
        min(share("!"), 3),
        min(share("|"), 3),
        min(share("#$%&*@^~<>{}[]=_\\"), 5),
        min(share("0123456789"), 10) / 10,
        min(len(lines) / n, 1),
        1 - len(set(lines)) / max(1, len(lines)),
        min(len(_END.findall(text)) / n, 1),
        pairs,
    ]


@dataclass
class Classifier:
    """Logistic regression on scaled figures; pairs of figures come in as squares."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, z * z])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.w, -12, 12)))


def fit_classifier(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> Classifier:
    """By Newton steps with a square penalty; without rows of both classes it knows only the rate."""
    scale = x.std(0) if len(x) else np.ones(x.shape[1])
    c = Classifier(x.mean(0) if len(x) else np.zeros(x.shape[1]), np.where(scale > 1e-9, scale, 1.0), np.zeros(1 + 2 * x.shape[1]))
    c.w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if not 0 < y.sum() < len(y):
        return c
    a = c.design(x)
    ridge = np.full(a.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ c.w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * c.w)
        c.w = c.w + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return c


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = SAMPLE) -> Classifier:
    """Fit on the labelled rows that are not held out, `bound` or so at most."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
    own = labelled_sample(own.groupBy("id").agg(F.max("y").alias("y")), "id", bound)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"].astype(str), "x": [figures(t) for t in pdf["text"]], "y": pdf["y"]})

    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    got = text.join(F.broadcast(own), "id").mapInPandas(rows, "id string, x array<double>, y int").toPandas().sort_values("id")
    x = np.array([np.asarray(v) for v in got["x"]]) if len(got) else np.zeros((0, len(FIGURES)))
    return fit_classifier(x, got["y"].to_numpy(float))


def _strength(rows: DataFrame, n: str, total: str, squares: str, prior) -> float:
    """How many documents a prior is worth: from the spread of the means of sites around their priors, less what chance gives.

    By moments over all sites; a spread no larger than chance gives a prior worth 10**6 documents.
    """
    m = F.col(total) / F.col(n)
    noise = F.greatest(F.lit(0.0), F.col(squares) / F.col(n) - m * m) / F.col(n)
    r = rows.filter(F.col(n) > 1).agg(F.sum(F.col(n) * (m - prior) ** 2).alias("spread"), F.sum(F.col(n) * noise).alias("noise"), F.sum(F.col(n) * prior * (1 - prior)).alias("whole"), F.sum(n).alias("n")).collect()[0]
    if not r["n"]:
        return 1.0
    between = (r["spread"] - r["noise"]) / r["n"]
    return float(np.clip(r["whole"] / r["n"] / max(between, 1e-9) - 1, 1, 1e6))


def quality(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """One row for each row of docs: id, held_out, evidence, host_posterior, path_posterior, score, keep.

    The posteriors are the shrunken means of the other documents of the host and path. Host and path are columns (a path is
    within its host); a null is a site of its own. Null and empty texts have
    no figures and get what the classifier says of that. An empty table gives no rows. Sites are summed up
    by partial sums before any shuffle, so a host with a third of the rows sends a row for each task.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([figures(t) for t in b.column(1).to_pylist()]).reshape(-1, len(FIGURES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(classifier.probability(x))], names=["id", "host", "path", "p"])

    site = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), site(host_col).alias("host"), site(path_col).alias("path"))
    scored = table(src.mapInArrow(run, f"id {id_type}, host string, path string, p double"), "quality-scored")
    sums = (F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss"))
    paths = table(scored.groupBy("host", "path").agg(*sums), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("ss").alias("hss"))
    whole = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).collect()[0]
    m = float(np.clip(whole["s"] / whole["n"], 1e-4, 1 - 1e-4)) if whole["n"] else 0.5
    k1 = _strength(hosts, "hn", "hs", "hss", F.lit(m))
    shrunk = lambda total, n, k, prior: (total + k * prior) / (n + k)
    paths = paths.join(hosts, "host")
    k2 = _strength(paths, "n", "s", "ss", shrunk(F.col("hs"), F.col("hn"), k1, F.lit(m)))
    sites = table(paths.select("host", "path", "n", "s", "hn", "hs"), "quality-sites")
    joined = scored.join(small(sites), ["host", "path"])
    # Sums of the document's site without the document.
    host_posterior = shrunk(F.col("hs") - F.col("p"), F.col("hn") - 1, k1, F.lit(m))
    joined = joined.withColumn("host_posterior", host_posterior).withColumn("path_posterior", shrunk(F.col("s") - F.col("p"), F.col("n") - 1, k2, F.col("host_posterior")))
    logit = lambda c: F.log(c / (1 - c))
    z = logit(F.col("p")) + logit(F.least(F.greatest(F.col("path_posterior"), F.lit(1e-4)), F.lit(1 - 1e-4))) - float(np.log(m / (1 - m)))
    score = 1 / (1 + F.exp(-z))
    return joined.select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), F.col("p").alias("evidence"), "host_posterior", "path_posterior", score.alias("score"), (score >= KEEP).alias("keep")
    )
