"""Language identification: a linear-chain conditional random field over the words of a text.

A word's features are its bytes' prefixes and suffixes, the byte bigrams and trigrams within it, and the word itself
(the lexicon), hashed into one table of weights; transitions between the labels of neighbouring words are learned
with them. Forward-backward over the whole text gives each word's posterior, so words of code-switched text keep
labels of their own; a text's language is the label with the largest share of posterior mass, its score that share.

The model is fitted on a bounded sample: `per_label` labelled documents a label (those of least hash), `spans`
spans of `span_words` words from evenly spaced places of each. Spans of different labels are strung together, so
that switches are seen and their weights learned. Only text and label are read.

A text that is null or has no letter is "und" with score 0, and so is every text if there are no labelled rows.
Null labels are never learned, rows that repeat id, text and label teach once. Repeated rows are judged alike. Of the
other columns, those to keep pass through.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, CHUNK_BYTES, Words, chunks, mix, powers, prefix_sums, slices, thrifty, utf8

TABLE_BITS = 17
UNDETERMINED = "und"
_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


class Features:
    """Hashed features of distinct words: for each word a run of table rows."""

    def __init__(self, words: Words, at: np.ndarray):
        s, e = words.starts[at], words.ends[at]
        n = e - s
        sums = prefix_sums(words.buf.astype(np.uint64) + np.uint64(1), BASE)
        down = powers(BASE, len(sums))[1]
        span = lambda a, b: (sums[b] - sums[a]) * down[a]
        who, feature = [np.arange(len(at))], [self._rows(words.hash[at], 1)]
        for k in (1, 2, 3):
            i = np.flatnonzero(n >= k)
            who.append(i)
            feature.append(self._rows(span(s[i], s[i] + k), 1 + k))
        for k in (1, 2, 3, 4):
            i = np.flatnonzero(n >= k)
            who.append(i)
            feature.append(self._rows(span(e[i] - k, e[i]), 4 + k))
        for k in (2, 3):
            count = np.maximum(n - k + 1, 0)
            i = np.repeat(np.arange(len(at)), count)
            a = s[i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            who.append(i)
            feature.append(self._rows(span(a, a + k), 8 + k))
        who, feature = np.concatenate(who), np.concatenate(feature)
        order = np.argsort(who, kind="stable")
        self.rows, self.first = feature[order], np.searchsorted(who[order], np.arange(len(at)))
        self.count = np.diff(np.append(self.first, len(who)))

    @staticmethod
    def _rows(h: np.ndarray, kind: int) -> np.ndarray:
        return (mix(h + np.uint64(kind * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """The summed weights of each word, a column a label."""
        return np.add.reduceat(weights[self.rows], self.first, axis=0) if len(self.first) else np.zeros((0, weights.shape[1]), weights.dtype)


def forward_backward(emit: np.ndarray, bounds: np.ndarray, trans: np.ndarray, span: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posteriors, forward, backward messages) of all words, each row summing to 1; emit: exp of the scores (largest 1 a
    word); documents lie between bounds.

    Documents are cut into spans of words that advance together: first each span's transfer matrix (from the label before
    it to the label at its end), then the messages between spans of one document, then those within the spans. So the
    number of steps follows the span and the number of spans of the longest document, not its words.
    """
    n, k = emit.shape
    words = np.diff(bounds)
    spans = -(-words // span)
    doc = np.repeat(np.arange(len(words)), spans)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(spans) - spans, spans)
    order = np.argsort(-np.minimum(words[doc] - nth * span, span), kind="stable")  # longest first
    doc, nth = doc[order], nth[order]
    first, length = bounds[doc] + nth * span, np.minimum(words[doc] - nth * span, span)
    going = np.searchsorted(-length, -np.arange(1, span + 1), side="right")  # spans of at least t + 1 words
    one = lambda x, axes: x / x.sum(axis=axes, keepdims=True)

    # transfer matrices: a document's first word has no transition before it
    across = np.broadcast_to(np.eye(k), (len(doc), k, k)).copy()
    for t in range(span if len(doc) else 0):
        m = going[t]
        if not m:
            break
        moved = across[:m] @ trans if t else np.where((nth[:m] > 0)[:, None, None], trans, np.eye(k))
        across[:m] = one(moved * emit[first[:m] + t][:, None, :], (1, 2))
    # messages at the spans' edges
    before, after = np.full((len(doc), k), 1 / k), np.full((len(doc), k), 1 / k)
    by_nth = np.argsort(nth, kind="stable")
    cut = np.searchsorted(nth[by_nth], np.arange(int(nth.max()) + 2)) if len(doc) else np.zeros(1, np.int64)
    at_doc = np.zeros((len(words), k))
    for i in range(1, len(cut) - 1):
        own = by_nth[cut[i - 1] : cut[i]]
        at_doc[doc[own]] = one((before[own][:, None, :] @ across[own])[:, 0], 1)
        own = by_nth[cut[i] : cut[i + 1]]
        before[own] = at_doc[doc[own]]
    at_doc[:] = 1 / k
    for i in range(len(cut) - 2, 0, -1):
        own = by_nth[cut[i] : cut[i + 1]]
        after[own] = at_doc[doc[own]]
        at_doc[doc[own]] = one((across[own] @ after[own][:, :, None])[:, :, 0], 1)
    own = by_nth[: cut[1]] if len(doc) else by_nth
    after[own] = at_doc[doc[own]]
    # within the spans
    alpha, beta = np.zeros((n, k)), np.zeros((n, k))
    now = before
    for t in range(span):
        m = going[t]
        if not m:
            break
        moved = now[:m] @ trans
        if not t:
            moved[nth[:m] == 0] = 1
        now = one(moved * emit[first[:m] + t], 1)
        alpha[first[:m] + t] = now
    now, back = after.copy(), trans.T
    for t in range(span - 1, -1, -1):
        m = going[t]
        if not m:
            continue
        at = first[:m] + t
        beta[at] = now[:m]
        now[:m] = one((now[:m] * emit[at]) @ back, 1)
    return one(alpha * beta, 1), alpha, beta


def pair_posteriors(emit: np.ndarray, trans: np.ndarray, alpha: np.ndarray, beta: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each word of `right`, the posterior of (label of the word before, its own label)."""
    pair = alpha[right - 1][:, :, None] * trans[None] * (emit[right] * beta[right])[:, None, :]
    return pair / pair.sum(axis=(1, 2), keepdims=True)


class Model:
    """Labels, weights and transitions; a worker's copy remembers the scores of words it has met, one a slot."""

    SLOTS = 18

    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray):
        self.labels, self.weights, self.trans, self._met = labels, weights, trans, None

    def __getstate__(self):
        return self.__dict__ | {"_met": None}

    def scores(self, words: Words, at: np.ndarray) -> np.ndarray:
        """The scores of the distinct words at some places."""
        if self._met is None:
            # a slot is empty as long as it holds a hash of the next slot
            empty = np.arange(1, (1 << self.SLOTS) + 1, dtype=np.uint64) << np.uint64(64 - self.SLOTS)
            self._met = empty, np.zeros((1 << self.SLOTS, len(self.labels)), np.float32)
        keys, held = self._met
        h = words.hash[at]
        slot = (h >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        score, new = held[slot], np.flatnonzero(keys[slot] != h)
        if len(new):
            score[new] = Features(words, at[new]).scores(self.weights)
            keys[slot[new]], held[slot[new]] = h[new], score[new]
        return score

    def posteriors(self, texts: list[bytes]) -> tuple[Words, np.ndarray]:
        words = Words(texts, "alnum", lower=True)
        if not len(words):
            return words, np.zeros((0, len(self.labels)), np.float32)
        _, at, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        score = self.scores(words, at)
        emit = np.exp(score - score.max(axis=1, keepdims=True)) + np.float32(1e-6)
        return words, forward_backward(emit[inverse], words.bounds, np.exp(self.trans))[0]


def sequences(spans: list[tuple[int, bytes]], n: int, seed: int = 11) -> list[list[int]]:
    """n strings of one to six spans; neighbours change label as chance has it."""
    rng = np.random.default_rng(seed)
    by_label: dict[int, list[int]] = {}
    for i, (label, _) in enumerate(spans):
        by_label.setdefault(label, []).append(i)
    labels = sorted(by_label)
    return [[by_label[k][rng.integers(len(by_label[k]))] for k in rng.choice(labels, rng.integers(1, 7))] for _ in range(n)]


def fit(labels: list[str], spans: list[tuple[int, bytes]], n: int = 2400, epochs: int = 3, batch: int = 48, rate: float = 0.3, penalty: float = 1e-5) -> Model:
    """Maximise the conditional likelihood of the strung-together spans by adaptive gradient steps."""
    k, size = len(labels), 1 << TABLE_BITS
    weights, trans = np.zeros((size, k), np.float32), np.zeros((k, k))
    seen_w, seen_t = np.full((size, k), 1e-3, np.float32), np.full((k, k), 1e-3)
    strings = sequences(spans, n)
    for epoch in range(epochs):
        for begin in range(0, n, batch):
            chosen = strings[begin : begin + batch]
            words = Words([b" ".join(spans[i][1] for i in s) for s in chosen], "alnum", lower=True)
            gold = []
            for s in chosen:
                for i in s:
                    gold.append(np.full(len(Words([spans[i][1]], "alnum", lower=True, hashed=False)), spans[i][0]))
            gold = np.concatenate(gold)
            _, at, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
            features = Features(words, at)
            score = features.scores(weights)
            emit = np.exp(score - score.max(axis=1, keepdims=True)) + 1e-6
            emit = emit[inverse].astype(np.float64)
            moves = np.exp(trans)
            post, alpha, beta = forward_backward(emit, words.bounds, moves)
            gap = -post
            gap[np.arange(len(gold)), gold] += 1
            # of the words, then of their features
            by_word = np.stack([np.bincount(inverse, gap[:, j], len(at)) for j in range(k)], axis=1)
            spread = np.repeat(by_word, features.count, axis=0)
            grad = np.stack([np.bincount(features.rows, spread[:, j], size) for j in range(k)], axis=1).astype(np.float32) / len(chosen) - np.float32(penalty) * weights
            seen_w += grad * grad
            weights += np.float32(rate) * grad / np.sqrt(seen_w)
            # of the transitions: gold pairs less expected ones, by the posteriors of neighbouring pairs
            inner = np.ones(len(gold), bool)
            inner[words.bounds[:-1][np.diff(words.bounds) > 0]] = False
            right = np.flatnonzero(inner)
            counted = np.zeros((k, k))
            np.add.at(counted, (gold[right - 1], gold[right]), 1)
            grad_t = (counted - pair_posteriors(emit, moves, alpha, beta, right).sum(axis=0)) / len(chosen)
            seen_t += grad_t * grad_t
            trans += rate * grad_t / np.sqrt(seen_t)
    return Model(labels, weights, trans)


def draw_spans(rows: DataFrame, per_label: int, spans: int, span_words: int, most_labels: int = 1000) -> list[tuple[str, bytes]]:
    """Spans of the labelled rows (id, text, label) of least hash, `per_label` documents a label.

    Labels are counted first; a hash below a label's cut then leaves little more than `per_label` of its rows, which are
    cut into spans where they are read. Texts are not shuffled, and no group is ranked in a task.
    """
    hashed = rows.where("text is not null and label is not null").withColumn("h", F.xxhash64("id", "text", "label"))
    counts = rows.where("text is not null and label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(most_labels + 1).collect()
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} labels: a model has a column of weights for each")
    # six standard deviations more than asked for, so that rows of evenly spread hashes are never too few
    wanted = per_label + 6 * per_label**0.5
    cuts = [(r["label"], int(min(2**63 - 1, -(2**63) + 2**64 * wanted / r["n"]))) for r in counts]
    limits = rows.sparkSession.createDataFrame(cuts, "label string, cut bigint")
    chosen = hashed.join(F.broadcast(limits), "label").where(F.col("h") <= F.col("cut")).select("label", "h", "text")

    @thrifty
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            label, h, part, span = [], [], [], []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                words = text.split()
                for i in range(min(spans, -(-len(words) // span_words))):
                    at = i * max(0, len(words) - span_words) // max(1, spans - 1)
                    cut = b" ".join(words[at : at + span_words])
                    if has_letter(cut):
                        label.append(a)
                        h.append(b)
                        part.append(i)
                        span.append(cut)
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.string()), pa.array(h, pa.int64()), pa.array(part, pa.int32()), pa.array(span, pa.binary())], ["label", "h", "part", "span"])

    # rows that repeat id, text and label have one hash and teach once
    found = sorted((r["label"], r["h"], r["part"], bytes(r["span"])) for r in chosen.mapInArrow(run, "label string, h bigint, part int, span binary").distinct().collect())
    last: dict[str, list[int]] = {}
    for label, h, _, _ in found:
        own = last.setdefault(label, [])
        if len(own) < per_label and (not own or own[-1] != h):
            own.append(h)
    return [(label, span) for label, h, _, span in found if h <= last[label][-1]]


def train(docs: DataFrame, per_label: int = 300, spans: int = 8, span_words: int = 16, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model | None:
    """A model of the labelled rows; None if there are none."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    drawn = draw_spans(rows, per_label, spans, span_words)
    labels = sorted({label for label, _ in drawn})
    return fit(labels, [(labels.index(label), span) for label, span in drawn]) if labels else None


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None, text_col: str = "text", segments: bool = False, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The columns `keep` of docs with lang_pred and score, and with segments, if asked for: runs of words of one label.
    A kept column of such a name gives way."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {"lang_pred", "score", "segments", "_text"}]
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    kind = "array<struct<lang:string,start:int,words:int>>"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["lang_pred string", "score double"] + [f"segments {kind}"] * segments)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @thrifty
    def run(batches):
        import pyarrow as pa

        model = held.value
        for batch in slices(batches, len(keep), chunk):
            texts = utf8(batch.column(len(keep)))
            label, score, runs = [UNDETERMINED] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
            for a, b in chunks(texts, chunk) if model else ():
                words, post = model.posteriors(texts[a:b])
                some = np.flatnonzero(np.diff(words.bounds) > 0)
                if not len(some):
                    continue
                mass = np.add.reduceat(post.astype(np.float64), words.bounds[:-1][some], axis=0)
                mass /= mass.sum(axis=1, keepdims=True)
                best = post.argmax(axis=1)
                for i, m in zip(some.tolist(), mass):
                    if has_letter(texts[a + i]):
                        j = int(m.argmax())
                        label[a + i], score[a + i] = model.labels[j], min(1.0, float(m[j]))
                        if segments:
                            own = best[words.bounds[i] : words.bounds[i + 1]]
                            cut = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]]).tolist()
                            runs[a + i] = [{"lang": model.labels[own[s]], "start": s, "words": e - s} for s, e in zip(cut, cut[1:])]
            out = [*(batch.column(i) for i in range(len(keep))), pa.array(label, pa.string()), pa.array(score)]
            if segments:
                out.append(pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("words", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(out, [*keep, "lang_pred", "score", *["segments"] * segments])

    return rows.mapInArrow(run, schema)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts
