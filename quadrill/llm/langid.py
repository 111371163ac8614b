"""Language identification: known words first, then shorter and shorter n-grams."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of labelled text that are learned from, about, for each language.
SAMPLE_MB = 1.0
LONGEST = 5
#: Words of which a text's score takes account at most; more make it no surer.
SURE = 25
#: The lower-case letters of Latin-1, and letters with marks of any script.
_latin = re.compile("[a-zªµºß-öø-ÿ]+").findall
_any = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall

UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """The lower-cased words: runs of letters, and of marks after the first letter."""
    text = text.lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _any(text)
    return _latin(text)


def grams(word: str, n: int) -> list[str]:
    padded = f"\x02{word}\x03"
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


class Model:
    """Per-language log frequencies of words and of character n-grams."""

    def __init__(self, langs: list[str], tables: list[dict[str, int]], logs: list[np.ndarray]):
        self.langs, self.tables, self.logs = langs, tables, logs
        self.kept: dict[str, np.ndarray] = {}

    @classmethod
    def learn(cls, counts: dict[str, dict[str, int]]) -> Model:
        """From how often each language has each word; nothing is left out of the tables."""
        langs = sorted(counts)
        tables, logs = [], []
        for n in range(LONGEST + 1):  # 0: whole words
            of = []
            for lang in langs:
                if n == 0:
                    of.append(Counter(counts[lang]))
                    continue
                c: Counter = Counter()
                for word, times in counts[lang].items():
                    for g in grams(word, n):
                        c[g] += times
                of.append(c)
            total: Counter = Counter()
            for c in of:
                total.update(c)
            chosen = sorted(total)
            tables.append({w: k for k, w in enumerate(chosen)})
            # A count of half keeps what a language has not shown possible.
            seen = np.array([[c[w] for c in of] for w in chosen], dtype=np.float64).reshape(len(chosen), len(langs))
            logs.append(np.log(seen + 0.5) - np.log([sum(c.values()) + 0.5 * len(total) for c in of]))
        return cls(langs, tables, logs)

    def unseen(self, word: str) -> np.ndarray:
        """By the longest n-grams of which the word has any known one; zeros if it has none."""
        found = self.kept.get(word)
        if found is None:
            found = np.zeros(len(self.langs))
            for n in range(LONGEST, 0, -1):
                table = self.tables[n]
                rows = [table[g] for g in grams(word, n) if g in table]
                if rows:
                    found = self.logs[n][rows].mean(axis=0)
                    break
            if len(self.kept) > 200_000:
                self.kept.clear()
            self.kept[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        words = Counter(words_of(text)) if text else None
        if not words or not self.langs:
            return UNKNOWN, 0.0
        rows, times, total = [], [], np.zeros(len(self.langs))
        table = self.tables[0]
        for word, n in words.items():
            row = table.get(word)
            if row is None:
                total += n * self.unseen(word)
            else:
                rows.append(row)
                times.append(n)
        if rows:
            total += np.array(times, dtype=np.float64) @ self.logs[0][rows]
        n = sum(words.values())
        p = np.exp((total - total.max()) * (min(n, SURE) / n))
        best = int(np.argmax(p))
        return self.langs[best], float(p[best] / p.sum())


def learn(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_mb: float = SAMPLE_MB) -> bytes:
    """A model of about ``sample_mb`` of labelled text a language: the rows of least hash.

    Every language has a share of its own, so rare ones are learned too. Tasks
    count words and one more learns from the counts: texts stay where they are.
    """
    known = docs.where(F.col(lang).isNotNull() & (F.col(lang) != "") & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(doc_id, text).alias("h"))
    sizes = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size"))
    share = F.least(F.lit(1.0), F.lit(sample_mb * 1e6) / F.greatest(F.col("size"), F.lit(1)))
    some = known.join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang").where(F.pmod("h", F.lit(1 << 40)) < F.col("share") * (1 << 40))  # one row a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for b in batches:
            for one, words in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                counts.setdefault(one, Counter()).update(words_of(words.as_py()))
        for one, c in counts.items():
            yield pa.record_batch({"lang": pa.array([one] * (len(c) + 1)), "word": pa.array(["", *c]), "n": pa.array([0, *c.values()], pa.int64())})

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[str, int]] = {}
        for b in batches:
            for one, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                of = counts.setdefault(one, {})
                if word:
                    of[word] = n
        model = Model.learn(counts)
        yield pa.record_batch({"model": pa.array([pickle.dumps((model.langs, model.tables, model.logs))], pa.binary())})

    counted = some.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = counted.coalesce(1).mapInArrow(fit, "model binary").collect()
    return bytes(found[0]["model"]) if found else pickle.dumps(([], [], []))


def predict(docs: DataFrame, model: bytes, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample, and so by the languages

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*pickle.loads(sent.value))
        for batch in batches:
            found = [held.predict(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(of, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """True for the third of ids that no model learns from; a null id counts as its text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(3)) == 1


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_mb: float = SAMPLE_MB) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row a row of ``docs``.

    Learns from text and non-null lang of rows that are not held out, about
    ``sample_mb`` for each language, and from every word of those. A known word
    scores its log frequency in each language; any other falls back to its
    5-grams, then 4-grams and so on to single characters. Of equal scores the
    language that sorts first wins. A null text, or one without a letter, is
    ``und`` with score 0, and so is every text if there is nothing to learn
    from. Whole texts count, rows that repeat an id each get their row (and are
    each learned from), an empty table gives none.
    """
    model = learn(docs.where(~held_out(doc_id)), doc_id=doc_id, text=text, lang=lang, sample_mb=sample_mb)
    return predict(docs, model, doc_id=doc_id, text=text).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
