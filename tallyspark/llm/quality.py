"""Quality by hierarchical empirical Bayes: a document's own evidence, with what its host and path have shown.

A logistic classifier on style features and a lexicon gives each document a probability. Grouped sums of these
(a label, where there is one, in place of the estimate) give each host a posterior that shrinks to the global
mean, and each path one that shrinks to its host's, by strengths that the variance between groups sets (method of
moments); sparse sites thus stay near the prior. A document's log odds are then its own, plus how far its path's
posterior, the document itself left out, lies from the global mean. Quality and toxicity are judged alike.

The classifier is fitted on a bounded sample: the `sample` labelled rows of least hash. The lexicon, up to
4 * `lexicon` words, is chosen by grouped counts over them. Posteriors come from all rows.

A null text is empty; null host or path are groups of their own; unlabelled tables give every document the same
probability. Rows repeated in documents are judged each; for an id labelled more than once the mean counts, above
a half being 1. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, save, slices, thrifty, utf8

STYLE = 14


def style(text: bytes, n_words: int) -> list[float]:
    """Shares of kinds of bytes, and sizes."""
    h = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    upper, lower = h[65:91].sum(), h[97:123].sum()
    lines = text.split(b"\n")
    signs = h[[35, 36, 37, 38, 42]].sum()  # # $ % & *
    words = max(1, n_words)
    return [np.log1p(n_words), len(text) / words, upper / max(1, upper + lower), h[48:58].sum() / n, h[33] / words, h[124] / words, signs / words, (h[44] + h[46]) / words, h[128:].sum() / n, len(lines) / words, 1 - len(set(lines)) / len(lines), (h[60] + h[62] + h[123] + h[125]) / words, h[47] / words, float(n_words < 5)]


def document_features(texts: list[bytes], lexicon: np.ndarray) -> np.ndarray:
    """Style features, then how often each word of the (sorted) lexicon occurs, as log(1 + n)."""
    words = Words(texts, "alnum", lower=True)
    n = np.diff(words.bounds)
    out = np.zeros((len(texts), STYLE + len(lexicon)), np.float32)
    for i, t in enumerate(texts):
        out[i, :STYLE] = style(t, int(n[i]))
    if len(lexicon) and len(words):
        at = np.minimum(np.searchsorted(lexicon, words.hash), len(lexicon) - 1)
        hit = lexicon[at] == words.hash
        np.add.at(out, (words.docs()[hit], STYLE + at[hit]), 1)
        out[:, STYLE:] = np.log1p(out[:, STYLE:])
    return out


class Classifier:
    """Ridge logistic regression by Newton steps, over standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 20.0, steps: int = 12):
        self.mean = x.mean(axis=0)
        self.scale = np.maximum(x.std(axis=0), 1e-3)
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        w = np.zeros(z.shape[1])
        share = (y.sum() + 1) / (len(y) + 2)
        w[0] = np.log(share / (1 - share))
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-3
        for _ in range(steps if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            v = np.maximum(p * (1 - p), 1e-6)
            move = np.linalg.solve((z * v[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += move
            if np.abs(move).max() < 1e-6:
                break
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        score = self.w[0] + np.clip((x - self.mean) / self.scale, -20, 20) @ self.w[1:]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def choose_lexicon(labelled: DataFrame, targets: list[str], lexicon: int) -> np.ndarray:
    """Hashes of the words whose presence tells most about a target, either way, by a two-proportion z score."""

    @thrifty
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 0):
            words = Words(utf8(batch.column(0)), "alnum", lower=True)
            doc = words.docs()
            pair = np.unique(np.stack([doc.astype(np.uint64), words.hash], axis=1), axis=0) if len(words) else np.zeros((0, 2), np.uint64)
            at = pa.array(pair[:, 0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 1]).view(np.int64)), *(batch.column(1 + i).take(at) for i in range(len(targets)))], ["word", *targets])

    rows = labelled.select("text", *targets)
    whole = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(t).alias(t) for t in targets)).first()
    if not whole["n"]:
        return np.zeros(0, np.uint64)
    words = rows.mapInArrow(run, ", ".join(["word bigint", *(f"{t} int" for t in targets)]))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *(F.sum(t).alias(t) for t in targets)).where("n >= 5")
    found: set[int] = set()
    for t in targets:
        share = whole[t] / whole["n"]
        z = (F.col(t) - F.col("n") * share) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-9))
        for order in (F.desc("z"), F.asc("z")):
            found |= {r["word"] for r in counts.select("word", z.alias("z")).where(F.abs("z") > 3).orderBy(order, "word").limit(lexicon).collect()}
    return np.sort(np.array(sorted(found), np.int64).view(np.uint64))


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, mean: Column, ceiling: float = 1e4) -> float:
    """Prior strength (in documents) from groups (n, s) whose rates scatter about `mean`: by the method of moments."""
    got = groups.where("n > 1").select("n", (F.col("s") / F.col("n")).alias("r"), mean.alias("m")).agg(F.sum(F.col("n") * (F.col("r") - F.col("m")) ** 2).alias("scatter"), F.sum(F.col("m") * (1 - F.col("m"))).alias("noise"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("spread")).first()
    if not got["n"]:
        return ceiling
    between = max(0.0, (got["scatter"] - got["noise"]) / got["n"])  # variance of the groups' true rates
    binomial = got["spread"] / got["n"]
    return float(min(ceiling, max(1.0, binomial / between - 1))) if between > 0 else ceiling


def posteriors(scored: DataFrame, target: str) -> DataFrame:
    """(_host, _path, {target}_n, {target}_s: documents and evidence of the path, {target}_prior, {target}_k, {target}_mean)."""
    evidence = F.coalesce(F.col(f"{target}_label").cast("double"), F.col(f"{target}_p"))
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(evidence).alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = (whole["s"] + 0.5) / (whole["n"] + 1) if whole["n"] else 0.5
    k_host = strength(hosts, F.lit(mean))
    hosts = hosts.select("host", ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("host_mean"))
    hosts = hosts.withColumnRenamed("host", "_host")
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host")))
    k_path = strength(joined, F.col("host_mean"))
    return joined.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("n").alias(f"{target}_n"), F.col("s").alias(f"{target}_s"), F.col("host_mean").alias(f"{target}_prior"), F.lit(k_path).alias(f"{target}_k"), F.lit(mean).alias(f"{target}_mean"))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample: int = 10_000, lexicon: int = 150, id_col: str = "doc_id", text_col: str = "text", targets: tuple[str, ...] = ("quality", "toxic")) -> DataFrame:
    """(doc_id, host, path, and for each target {target}_p: the document's own probability, {target}_site: its path's
    posterior without it, {target}_score: both combined)."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    known = labels.groupBy(F.col(id_col).alias("doc_id")).agg(*(F.avg(F.col(t).cast("double")).alias(t) for t in targets)).where("doc_id is not null")
    known = known.select("doc_id", *((F.col(t) > 0.5).cast("int").alias(t) for t in targets))
    drawn = known.dropna().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = save(rows.select("doc_id", "text").join(drawn, "doc_id").select("text", *targets), "labelled")
    words = choose_lexicon(labelled, list(targets), lexicon)

    @thrifty
    def features(batches):
        import pyarrow as pa

        for batch in slices(batches, 0):
            x = document_features(utf8(batch.column(0)), words)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), *(batch.column(1 + i) for i in range(len(targets)))], ["x", *targets])

    got = labelled.mapInArrow(features, ", ".join(["x binary", *(f"{t} int" for t in targets)])).toPandas()
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), STYLE + len(words)).astype(np.float64)
    order = np.lexsort(x.T) if len(x) else []
    models = [Classifier(x[order], got[t].to_numpy(np.float64)[order]) if len(x) else None for t in targets]
    held = docs.sparkSession.sparkContext.broadcast((words, models))

    @thrifty
    def score(batches):
        import pyarrow as pa

        words, models = held.value
        for batch in slices(batches, 1):
            x = document_features(utf8(batch.column(1)), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *(pa.array(m(x) if m else np.full(len(x), 0.5)) for m in models)], ["doc_id", "host", "path", *(f"{t}_p" for t in targets)])

    scored = rows.mapInArrow(score, ", ".join([f"doc_id {kind}, host string, path string", *(f"{t}_p double" for t in targets)]))
    scored = save(scored.join(known.select("doc_id", *(F.col(t).alias(f"{t}_label") for t in targets)), "doc_id", "left"), "scored")
    out = scored
    for t in targets:
        site = posteriors(scored, t)
        out = out.join(site, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")), "left").drop("_host", "_path")
        own = F.coalesce(F.col(f"{t}_label").cast("double"), F.col(f"{t}_p"))
        rest = (F.col(f"{t}_s") - own + F.col(f"{t}_k") * F.col(f"{t}_prior")) / (F.col(f"{t}_n") - 1 + F.col(f"{t}_k"))
        odds = logit(F.col(f"{t}_p")) + logit(rest) - logit(F.col(f"{t}_mean"))
        out = out.withColumn(f"{t}_site", rest).withColumn(f"{t}_score", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", "host", "path", *(f"{t}{x}" for t in targets for x in ("_p", "_site", "_score")))
