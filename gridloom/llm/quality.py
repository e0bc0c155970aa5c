"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of PASSAGE bytes.  A passage is encoded by the
square roots of the shares of its pairs of neighbouring byte classes, the share
of distinct byte trigrams, and its length, each in 255 steps; a learned layer maps
it to h.  Gated attention a_k = softmax_k(w . (tanh(V h_k) * sigmoid(U h_k))) weighs
the passages, and the document's score is the logistic of c . sum_k a_k h_k.  All
weights are learned from document labels, on the driver, from a bounded sample: at
most SAMPLE labelled documents of at most SAMPLE_PASSAGES passages together, each
with all its passages.  Scoring reads every passage of every document, BLOCK
passages at a time: of a document only the softmax's running maximum and sums are
kept, so a text of any length takes the same memory beside its own bytes.

Edge cases: null and empty texts are one empty passage; without labels the score
is 0.5, with labels of one kind their mean; null labels are skipped; of several
labels of one id the greatest counts; repeated rows are scored alike; an empty table
gives none; a null doc_id counts as "".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import id_text, mapped, sampled, stored, table

PASSAGE = 400
SAMPLE = 4000
SAMPLE_PASSAGES = 40_000
BLOCK = 512
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 12, 24, 32, 0.004, 1e-4, 7

#: Byte classes: space, line end, lower, upper, digit, other letters' bytes, and each ASCII sign.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = np.zeros(256, np.int64)
_CLASS[[10, 13]] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[128:] = 5
for _i, _c in enumerate(_SIGNS):
    _CLASS[ord(_c)] = 6 + _i
CLASSES = 6 + len(_SIGNS)
WIDTH = CLASSES * CLASSES + 2


def encode(text: str | None) -> Iterator[np.ndarray]:
    """Passages by features in steps of 1 / 255, BLOCK passages at a time.  A passage's last pair and
    trigrams reach into the next passage."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    for i in range(0, max(1, len(raw)), BLOCK * PASSAGE):
        piece = raw[i : i + BLOCK * PASSAGE + 2]
        count = max(1, -(-min(BLOCK * PASSAGE, len(raw) - i) // PASSAGE))
        out = np.zeros((count, WIDTH), np.float32)
        c, n = _CLASS[piece], count * PASSAGE
        first = np.arange(min(n, max(0, len(piece) - 1)))
        pairs = np.bincount((first // PASSAGE * CLASSES + c[first]) * CLASSES + c[first + 1], minlength=count * CLASSES * CLASSES) if len(first) else np.zeros(count * CLASSES * CLASSES)
        pairs = pairs.reshape(count, -1).astype(np.float32)
        size = np.maximum(pairs.sum(axis=1), 1)
        out[:, :-2] = np.sqrt(pairs / size[:, None])
        first = np.arange(min(n, max(0, len(piece) - 2)))
        if len(first):
            x = piece.astype(np.int64)
            keys = np.unique((first // PASSAGE << 24) | (x[first] << 16) | (x[first + 1] << 8) | x[first + 2])
            out[:, -2] = np.bincount(keys >> 24, minlength=count) / size
        out[:, -1] = size / PASSAGE
        yield np.round(out * 255).astype(np.uint8)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionMIL:
    """One hidden layer, gated attention and a logistic output, trained by Adam."""

    def __init__(self, prior: float = 0.5):
        rng = np.random.default_rng(SEED)
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": g(WIDTH, HIDDEN) * 3, "b": np.zeros(HIDDEN, np.float32), "V": g(HIDDEN, GATE), "U": g(HIDDEN, GATE), "w": g(GATE), "c": g(HIDDEN), "d": np.zeros(1, np.float32)}
        self.prior, self.trained = prior, False

    def hidden(self, x: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        tv, su = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return h, tv, su, (tv * su) @ p["w"]

    def forward(self, x: np.ndarray, start: np.ndarray):
        """x: passages of several documents one after another, start: where each begins."""
        p = self.p
        h, tv, su, e = self.hidden(x)
        size = np.diff(np.append(start, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), size))
        a = e / np.repeat(np.add.reduceat(e, start), size)
        z = np.add.reduceat(h * a[:, None], start)
        return h, tv, su, a, size, z, _sigmoid(z @ p["c"] + p["d"])

    def scores(self, texts) -> np.ndarray:
        """Scores of texts, by blocks of passages; a block may hold several texts, a text several blocks."""
        n = len(texts)
        if not self.trained:
            return np.full(n, self.prior)
        most, total, z = np.full(n, -np.inf), np.zeros(n), np.zeros((n, HIDDEN))
        held, of, size = [], [], 0

        def settle():
            h, _, _, e = self.hidden(np.concatenate(held).astype(np.float32) / 255)
            doc = np.concatenate(of)
            start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            d = doc[start]
            now = np.maximum(most[d], np.maximum.reduceat(e, start))
            w = np.exp(e - np.repeat(now, np.diff(np.append(start, len(doc)))))
            old = np.exp(most[d] - now)
            total[d] = total[d] * old + np.add.reduceat(w, start)
            z[d] = z[d] * old[:, None] + np.add.reduceat(h * w[:, None], start)
            most[d] = now

        for i, t in enumerate(texts):
            for x in encode(t):
                held.append(x)
                of.append(np.full(len(x), i))
                size += len(x)
                if size >= BLOCK:
                    settle()
                    held, of, size = [], [], 0
        if held:
            settle()
        return _sigmoid(z / total[:, None] @ self.p["c"].astype(np.float64) + float(self.p["d"][0]))

    def fit(self, bags: list[np.ndarray], y: np.ndarray) -> AttentionMIL:
        """bags: what encode yields for a text, in one piece."""
        self.prior = float(y.mean()) if len(y) else 0.5
        if len(set(y.tolist())) < 2:
            return self
        rng, p = np.random.default_rng(SEED), self.p
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # classes count alike
        weight = np.sqrt(weight)  # but not quite: scores stay near frequencies
        m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), BATCH):
                pick = order[i : i + BATCH]
                x = np.concatenate([bags[j] for j in pick]).astype(np.float32) / 255
                start = np.cumsum([0, *[len(bags[j]) for j in pick[:-1]]])
                h, tv, su, a, size, z, s = self.forward(x, start)
                dz_out = ((s - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
                g = {"c": z.T @ dz_out, "d": dz_out.sum(keepdims=True)}
                dz = np.repeat(dz_out[:, None] * p["c"], size, axis=0)
                dh = dz * a[:, None]
                da = (dz * h).sum(axis=1)
                de = a * (da - np.repeat(np.add.reduceat(a * da, start), size))
                dg = de[:, None] * p["w"]
                g["w"] = (tv * su).T @ de
                dv, du = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
                g["V"], g["U"] = h.T @ dv, h.T @ du
                dh += dv @ p["V"].T + du @ p["U"].T
                dpre = dh * (1 - h**2)
                g["W"], g["b"] = x.T @ dpre, dpre.sum(axis=0)
                step += 1
                for k in p:
                    d = g[k] + DECAY * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    p[k] = (p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.trained = True
        return self


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, sample: int = SAMPLE, most: int = SAMPLE_PASSAGES) -> AttentionMIL:
    """Learns from labelled documents that are not held out, chosen by a hash of their ids: at most
    sample of them, and as many as have most passages together."""
    known = labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col(label).cast("int").alias("y")).where("y is not null")
    known = known.where(remainder(F.col("labelled"), folds) != held).groupBy("labelled").agg(F.max("y").alias("y"))
    known = known.where(sampled(1.2 * sample / max(1, known.count()), "labelled")).orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    rows = id_text(docs).join(F.broadcast(known), F.col("doc_id") == F.col("labelled"))  # sample rows at most
    rows = stored(rows.select("doc_id", "text", "y", F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE)).alias("passages")))
    sizes = rows.select("doc_id", "passages").groupBy("doc_id").agg(F.sum("passages").alias("passages")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # sample rows at most
    chosen, left = [], most
    for r in sizes:
        if r["passages"] <= left:
            chosen.append(r["doc_id"])
            left -= r["passages"]

    def work(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [b"".join(x.tobytes() for x in encode(t)) for t in b["text"]]})

    got = mapped(rows.where(F.col("doc_id").isin(chosen)).select("doc_id", "text", "y"), work, "doc_id long, y int, x binary").toPandas()
    got = got.sort_values(["doc_id", "x"], kind="stable")
    bags = [np.frombuffer(x, np.uint8).reshape(-1, WIDTH) for x in got["x"]]
    return AttentionMIL().fit(bags, (got["y"].to_numpy() > 0).astype(np.float32))


def quality_scores(docs: DataFrame, model: AttentionMIL, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""

    def work(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.scores(b["text"])})

    scored = mapped(id_text(docs), work, "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))
