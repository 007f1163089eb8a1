"""Language identification with error-correcting output codes.

Every language gets a codeword of bits. For each bit a binary classifier over
letter n-grams (logistic regression on hashed 1- to 3-gram frequencies) predicts
whether the text's language has a one there. Decoding adds, for each codeword,
the logistic losses of all bits, weighted by how often that bit's classifier was
right on training rows of that language; the codeword with the least loss wins.
When the runner-up is nearly as close, the answer is flagged as ambiguous.

The model is fitted on a sample of labelled rows, ``per_language`` ids of each
language at most (in a fixed pseudo-random order) and ``MOST_ROWS`` in all, each as its ``BUCKETS``
counts, so what reaches the driver is bounded. An id counts once in each language, whatever the number of its rows. Prediction reads every whole text
in the scan, with no shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closetlake.llm.common import held_out, hidden, in_training, prepare, sample_order, table
from closetlake.llm.hashing import mix, slices
from closetlake.llm.labelled import per_class

UNKNOWN = "und"
BUCKETS = 1 << 13
#: Rows the model is fitted on: of each language, and in all. The most frequent languages are learned.
PER_LANGUAGE, MOST_ROWS = 300, 12_000
MOST_LANGUAGES = 256
#: Characters that are held as numbers at a time.
BLOCK = 200_000
#: Share of the winner's probability the runner-up must reach to be called ambiguous.
AMBIGUOUS = 0.8


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def ngram_buckets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, three for each letter, and how many letters each text has.

    Around each letter: the letter, it with its left neighbour, and it with both;
    neighbours that are no letters count as a word border.
    """
    lengths = np.array([len(t) + 2 if t else 2 for t in texts])
    joined = "".join(f" {t} " if t else "  " for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = _letters()[points].astype(np.uint64)
    at = np.flatnonzero(letters)
    here, left, right = letters[at], letters[at - 1], letters[at + 1]
    with np.errstate(over="ignore"):
        two = (left << np.uint64(21)) | here
        grams = np.stack([here, two | np.uint64(1 << 62), ((right << np.uint64(42)) ^ two) | np.uint64(1 << 63)])
        buckets = (mix(grams) % np.uint64(BUCKETS)).astype(np.int32)
    owner = np.repeat(np.arange(len(texts)), lengths)[at]
    return buckets, np.bincount(owner, minlength=len(texts))


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits, rows add up to 1

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Loss of each codeword (rows x languages)."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.codes[None])
        return (loss * self.trust[None]).sum(axis=2) * self.codes.shape[1]


def codewords(n: int) -> np.ndarray:
    """A code for ``n`` languages: all splits in two for up to 5, else random bits, rows and columns distinct."""
    if n <= 5:
        columns = [[1 if (mask >> i) & 1 else -1 for i in range(n)] for mask in range(1, 1 << (n - 1))]
        return np.array(columns, dtype=np.float64).reshape(-1, n).T if n > 1 else np.ones((n, 1))
    rng, bits = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    best, distance = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        code[:, np.abs(code.sum(axis=0)) == n] = 1 - 2 * (np.arange(n) % 2)[:, None]
        apart = (bits - code @ code.T) / 2
        np.fill_diagonal(apart, bits)
        if apart.min() > distance:
            best, distance = code, apart.min()
    return best


def gram_blocks(text: str) -> Iterator[np.ndarray]:
    """The n-gram buckets of a long text (3 x letters), in blocks that overlap by their border characters."""
    for a in range(0, len(text), BLOCK):
        b = min(len(text), a + BLOCK)
        buckets, _ = ngram_buckets([text[max(0, a - 1): b + 1]])
        before = int(a > 0 and _letters()[ord(text[a - 1])] > 0)
        after = int(b < len(text) and _letters()[ord(text[b])] > 0)
        yield buckets[:, before: buckets.shape[1] - after]


def gram_counts(text: str) -> np.ndarray:
    return sum((np.bincount(g.ravel(), minlength=BUCKETS) for g in gram_blocks(text)), np.zeros(BUCKETS, dtype=np.int64))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from the text and non-null lang of the given rows; None if there are no labelled letters."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang").distinct()
    ids = per_class(labelled, "lang", per_language, MOST_LANGUAGES)

    def count(batches):
        for batch in batches:
            rows = [gram_counts(t) for t in batch["text"]]
            found = [np.flatnonzero(r) for r in rows]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "lang": batch["lang"],
                "at": [f.astype(np.int16) for f in found], "n": [r[f].astype(np.int32) for f, r in zip(found, rows, strict=True)],
            })

    # At most MOST_LANGUAGES * per_language ids of 8 bytes with their labels: a bounded side.
    texts = docs.filter(F.col("text").isNotNull()).join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", "text")
    once = texts.groupBy("doc_id", "lang").agg(F.min_by("text", F.md5("text")).alias("text"))
    rows = once.mapInPandas(count, "doc_id long, lang string, at array<short>, n array<int>").filter(F.size("at") > 0)
    # Each language in turn, so that the bound in all leaves none out.
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(*sample_order("doc_id")))
    rows = rows.withColumn("turn", turn).orderBy("turn", "lang").limit(MOST_ROWS).collect()
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["n"]
        x[i] /= x[i].sum()
    y = np.array([languages.index(r["lang"]) for r in rows])
    codes = codewords(len(languages))
    scale = np.float32(100)
    x *= scale
    target = codes[y]
    balance = (1 / np.bincount(y)[y])[:, None]
    balance = (balance / balance.sum()).astype(np.float32)
    w, b = np.zeros((BUCKETS, codes.shape[1]), dtype=np.float32), np.zeros(codes.shape[1], dtype=np.float32)
    gw, gb = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    for _ in range(120):  # full-batch steps with per-weight rates
        pull = (-target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))).astype(np.float32) * balance
        dw, db = x.T @ pull + 1e-5 * w, pull.sum(axis=0)
        gw += dw * dw
        gb += db * db
        w -= 0.2 * dw / np.sqrt(gw)
        b -= 0.2 * db / np.sqrt(gb)
    right = ((x @ w + b) * target) > 0
    trust = np.array([right[y == k].mean(axis=0) for k in range(len(languages))]) + 1e-3
    return Model(languages, codes, w * scale, b, trust / trust.sum(axis=1, keepdims=True))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add ``lang_pred``, ``score`` (its probability) and ``ambiguous`` to every row of ``docs``.

    A text that is null or has no letter gives ``und``, score 0; so does every
    text when nothing could be learned. Other columns stay, but for those three
    names, which are replaced.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    [judged] = hidden(docs, "judged")
    rows = docs.withColumn(judged, judgement(docs, model))
    return rows.select(*[f"`{c}`" for c in docs.columns], f"{judged}.*")


def judgement(docs: DataFrame, model: Model | None) -> Column:
    """``lang_pred``, ``score`` and ``ambiguous`` of ``text`` as one column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for series in texts:
            texts_, label, score, close = list(series), np.full(len(series), UNKNOWN, dtype=object), np.zeros(len(series)), np.zeros(len(series), dtype=bool)
            for part in slices(texts_, BLOCK) if model else ():
                margins, letters = _margins(texts_[part.start: part.stop], model)
                known = np.flatnonzero(letters)
                if not len(known):
                    continue
                near = np.exp(-model.decode(margins[known]))
                near /= near.sum(axis=1, keepdims=True)
                ranked = np.sort(near, axis=1)
                at = part.start + known
                label[at] = np.array(model.languages, dtype=object)[near.argmax(axis=1)]
                score[at] = ranked[:, -1]
                close[at] = ranked[:, -2] > AMBIGUOUS * ranked[:, -1] if near.shape[1] > 1 else False
            yield pd.DataFrame({"lang_pred": label, "score": score, "ambiguous": close})

    return F.pandas_udf(judge, "lang_pred string, score double, ambiguous boolean")("text")


def _margins(texts: list, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Classifier outputs and letter counts of each text of a slice (a very long text is a slice of its own)."""
    if len(texts) == 1 and texts[0]:
        total, n = np.zeros(model.weights.shape[1]), 0
        for grams in gram_blocks(texts[0]):
            total += model.weights[grams].sum(axis=(0, 1), dtype=np.float64)
            n += grams.shape[1]
        return (total / max(1, 3 * n) + model.bias)[None], np.array([n])
    buckets, letters = ngram_buckets(texts)
    sums = np.zeros((len(texts), model.weights.shape[1]))
    full = np.flatnonzero(letters)
    if len(full):
        per_letter = model.weights[buckets[0]] + model.weights[buckets[1]] + model.weights[buckets[2]]
        sums[full] = np.add.reduceat(per_letter, (np.cumsum(letters) - letters)[full], axis=0, dtype=np.float64)
    return sums / np.maximum(1, 3 * letters)[:, None] + model.bias, letters


def identify(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """Fit on ``train`` (``docs`` where not given) and predict for ``docs``."""
    return predict(docs, fit(docs if train is None else train))


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has letters and is not torn between two languages, with all their columns as they are.

    Null, empty and letterless texts go. Repeated rows are judged alike. Where no row has a language, nothing can be torn.
    """
    [judged] = hidden(docs, "judged")
    rows = docs.withColumn(judged, judgement(docs, fit(docs)))
    has_letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return rows.filter(has_letters & ~F.col(f"{judged}.ambiguous")).select(*docs.columns)


def op2_language_id(spark, sf_dir):
    """Language of every whole text, learned from rows outside the held-out fold."""
    docs = table(prepare(spark), sf_dir, "documents")
    model = fit(docs.filter(in_training("doc_id", 4, 2)))
    judged = predict(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")
