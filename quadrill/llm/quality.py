"""Attention-based multiple-instance learning of document quality."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrill.llm.langid import held_out
from quadrill.llm.store import bounded_sample, spare_name
from quadrill.llm.words import batches, hashed_words, sliced

#: Labelled documents that are learned from, and MB of their features, at most half of each class.
SAMPLE, SAMPLE_MB = 3000, 32
#: Bytes of a passage.
PASSAGE = 600
#: Widths: byte classes, hashed byte pairs, word statistics; encoding; attention.
CLASSES, PAIRS, STATS = 160, 96, 4
ENCODED, ATTENTION = 24, 16

_CLASS = np.minimum(np.arange(256), 128 + np.arange(256) % 32).astype(np.int64)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Raw features of every passage of every text, and where each text's passages start.

    A passage is ``PASSAGE`` bytes of the UTF-8 text, the last one shorter; an
    empty text has one empty passage. Features: relative counts of byte classes
    and hashed byte pairs; shares of words that repeat the one before, that the
    passage has had before, words a byte and the passage's fill.
    """
    words = hashed_words(texts, lower=False)
    sizes = np.diff(words.text_starts)
    counts = np.maximum(1, -(-(sizes - 1) // PASSAGE))  # a zero byte ends each text
    first = np.cumsum(counts) - counts
    n = int(counts.sum())
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(words.raw)) - words.text_starts[text_of]
    passage = first[text_of] + np.minimum(at // PASSAGE, counts[text_of] - 1)
    real = at < sizes[text_of] - 1
    raw, of = words.raw[real].astype(np.int64), passage[real]
    size = np.maximum(1, np.bincount(of, minlength=n)).astype(np.float32)
    out = np.zeros((n, CLASSES + PAIRS + STATS), dtype=np.float32)
    out[:, :CLASSES] = np.bincount(of * CLASSES + _CLASS[raw], minlength=n * CLASSES).reshape(n, CLASSES) / size[:, None]
    same = of[1:] == of[:-1]
    pair = (raw[:-1] * 37 + raw[1:] * 101) % PAIRS
    out[:, CLASSES : CLASSES + PAIRS] = np.bincount(of[1:][same] * PAIRS + pair[same], minlength=n * PAIRS).reshape(n, PAIRS) / size[:, None]
    if len(words.hashes):
        of_word = passage[words.starts]
        counted = np.bincount(of_word, minlength=n)  # none in a passage without words, whatever is beside it
        n_words = np.maximum(1, counted)
        again = np.zeros(len(of_word), dtype=bool)
        again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (of_word[1:] == of_word[:-1])
        order = np.lexsort((words.hashes, of_word))
        had = np.zeros(len(of_word), dtype=bool)
        had[1:] = (words.hashes[order][1:] == words.hashes[order][:-1]) & (of_word[order][1:] == of_word[order][:-1])
        out[:, -4] = np.bincount(of_word[again], minlength=n) / n_words
        out[:, -3] = np.bincount(of_word[order][had], minlength=n) / n_words
        out[:, -2] = counted / size
    out[:, -1] = size / PASSAGE
    return np.sqrt(out), first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Passage encoder, gated attention and the score of the weighted passages."""

    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    encode_b: np.ndarray
    tanh: np.ndarray
    gate: np.ndarray
    attend: np.ndarray
    out: np.ndarray
    out_b: np.ndarray

    LEARNED = ("encode", "encode_b", "tanh", "gate", "attend", "out", "out_b")

    @classmethod
    def start(cls, x: np.ndarray) -> Model:
        rng, d = np.random.default_rng(7), x.shape[1]
        f = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        return cls(x.mean(0), x.std(0) + 1e-2, f(d, ENCODED), np.zeros(ENCODED, np.float32), f(ENCODED, ATTENTION), f(ENCODED, ATTENTION), f(ATTENTION), f(ENCODED), np.zeros(1, np.float32))

    def wide(self) -> Model:
        """The same model in doubles: neither threads nor batches of passages show in the digits that are kept."""
        return Model(*(getattr(self, f.name).astype(np.float64) for f in fields(self)))

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        s = {"x": (x - self.mean) / self.scale}
        s["h"] = np.maximum(0, s["x"] @ self.encode + self.encode_b)
        s["t"], s["g"] = np.tanh(s["h"] @ self.tanh), _sigmoid(s["h"] @ self.gate)
        a = (s["t"] * s["g"]) @ self.attend
        of = np.repeat(np.arange(len(first)), np.diff([*first, len(x)]))
        e = np.exp(a - np.maximum.reduceat(a, first)[of])
        s["a"] = e / np.add.reduceat(e, first)[of]
        s["z"] = np.add.reduceat(s["a"][:, None] * s["h"], first)
        s["of"], s["p"] = of, _sigmoid(s["z"] @ self.out + self.out_b)
        return s

    def gradients(self, s: dict[str, np.ndarray], y: np.ndarray, weight: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        d = (s["p"] - y) * weight / weight.sum()
        of, h, a = s["of"], s["h"], s["a"]
        dz = d[:, None] * self.out
        da = (dz[of] * h).sum(1)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        ds = a * (da - np.add.reduceat(a * da, first)[of])  # through the softmax
        dt = ds[:, None] * self.attend * s["g"] * (1 - s["t"] ** 2)
        dg = ds[:, None] * self.attend * s["t"] * s["g"] * (1 - s["g"])
        dh = (a[:, None] * dz[of] + dt @ self.tanh.T + dg @ self.gate.T) * (h > 0)
        out = {"encode": s["x"].T @ dh, "encode_b": dh.sum(0), "tanh": h.T @ dt, "gate": h.T @ dg, "attend": (s["t"] * s["g"]).T @ ds, "out": s["z"].T @ d, "out_b": np.array([d.sum()])}
        return {k: v + decay * getattr(self, k) for k, v in out.items()}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 160, rate: float = 0.02, decay: float = 1e-4) -> Model:
        """Adam over the whole sample, in doubles: in floats, sums by several threads would show in the model."""
        m = {k: np.zeros_like(getattr(self, k)) for k in self.LEARNED}
        v = {k: np.zeros_like(getattr(self, k)) for k in self.LEARNED}
        for step in range(1, steps + 1):
            for k, g in self.gradients(self.forward(x, first), y, weight, decay).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                move = (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
                setattr(self, k, (getattr(self, k) - rate * (1 - 0.9 * step / steps) * move))
        return self


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, sample_mb: float = SAMPLE_MB) -> Model | None:
    """A model of at most ``sample`` labelled documents that are not held out, learned in one executor task.

    Labels that repeat an id count once, by their mean. Ids of least hash are
    taken, half of each class, and weighted back to the classes' shares; the
    task reads their passages in that order until a class has ``sample_mb`` / 2
    of features or half of ``sample`` documents (rows that repeat an id are
    documents each, in order of their features). None if a class has no document
    to learn from.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).cast("long").alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if set(shares) != {0, 1}:
        return None
    some = None
    for y in (0, 1):
        half = bounded_sample(known.where(F.col("y") == y), F.xxhash64("id"), sample // 2, shares[y])
        some = half if some is None else some.unionByName(half)
    # At most ``sample`` rows of two numbers.
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(some), "id").select(F.xxhash64("id").alias("h"), "text", "y")

    def encoded(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(chunks):
            all_texts = batch.column("text").to_pylist()
            for part in batches(all_texts):
                x, first = features(all_texts[part])
                bags = [b.astype(np.float16).tobytes() for b in np.split(x, first[1:])]
                yield pa.record_batch([batch.column("h")[part], pa.array(bags, pa.binary()), batch.column("y")[part]], names=["h", "x", "y"])

    def fit(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags: list[np.ndarray] = []
        ys: list[int] = []
        room, places = {0: sample_mb * 5e5, 1: sample_mb * 5e5}, {0: sample // 2, 1: sample // 2}
        for batch in chunks:
            for x, y in zip(batch.column("x"), batch.column("y").to_pylist(), strict=True):
                if room[y] > 0 and places[y] > 0:
                    data = x.as_py()
                    room[y] -= len(data)
                    places[y] -= 1
                    bags.append(np.frombuffer(data, np.float16).reshape(-1, CLASSES + PAIRS + STATS).astype(np.float32))
                    ys.append(y)
        if len(set(ys)) == 2:
            y = np.array(ys)
            first = np.cumsum([0, *(len(b) for b in bags[:-1])])
            weight = np.where(y == 1, shares[1] / (y == 1).mean(), shares[0] / (y == 0).mean()) / sum(shares.values())
            x = np.concatenate(bags)
            yield pa.record_batch({"model": pa.array([pickle.dumps(Model.start(x).wide().fit(x, first, y, weight))], pa.binary())})

    ordered = texts.mapInArrow(encoded, "h long, x binary, y int").repartition(1).sortWithinPartitions("h", "x")
    found = ordered.mapInArrow(fit, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def score(docs: DataFrame, model: Model | None, *, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, score; with ``keep`` all columns of ``docs`` and the score. Without a model each score is one half."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # of fixed size
    at = docs.columns.index(text) if keep else 1

    def of(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pickle.loads(sent.value)
        for batch in sliced(chunks):
            texts, found = batch.column(at).to_pylist(), []
            for part in batches(texts):
                found += held.forward(*features(texts[part]))["p"].round(6).tolist() if held else [0.5] * len(texts[part])
            score = pa.array(found, pa.float64())
            if keep:
                yield pa.record_batch([*batch.columns, score], schema=batch.schema.append(pa.field("score", pa.float64())))
            else:
                yield pa.record_batch([batch.column(0), score], names=["doc_id", "score"])

    if not keep:
        return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(of, "doc_id long, score double")
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names with dots have no place in a schema of batches
    scored = plain.mapInArrow(of, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.toDF(*docs.columns, spare_name(docs, "score"))


def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from a score of one half on): one row a row of ``docs``.

    Scores depend on the whole text alone and have six digits, so equal texts
    have equal scores, and a score of just one half is predicted 1. A null text is scored like an empty
    one. Rows that repeat an id each get their row; an empty table gives none;
    without labels of both classes every score is one half.
    """
    model = learn(docs, labels, doc_id=doc_id, text=text, label=label, sample=sample)
    found = score(docs, model, doc_id=doc_id, text=text)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
