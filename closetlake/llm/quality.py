"""Document quality by a linear-chain conditional random field over lines.

Every line is described by its length, words, repeated words, capitals, symbols,
digits and whether it was there before, each as one of a few steps, and by the same of
the lines before and after it. The field labels every line good or bad; the
marginals of forward-backward, weighted by line length, are a document's share
of good text, which a logistic curve turns into a probability.

Lines learn the label of their document, from ``PER_CLASS`` documents of each label at
most and ``MOST_LINES`` neighbouring lines of each (a bounded sample). Half of the documents fit
the field, the other half the curve. Scoring reads every line of every text in the scan, with no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closetlake.llm import crf
from closetlake.llm.common import held_out, hidden, in_training, prepare, table
from closetlake.llm.hashing import BLANKS, slices, word_hashes
from closetlake.llm.labelled import sample

PER_CLASS = 1000
MOST_LINES = 200
CUT = 0.7

_SHARES = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])
_RATIOS = np.array([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
STEPS = 12  # steps of a description, one more for "no such line"
_KINDS = np.zeros((4, 256), dtype=np.int32)  # capitals, symbols, exclamation marks, digits
_KINDS[0, 65:91] = 1
_KINDS[1, list(b"#$%&*@|<>{}[]=~^_\\/+")] = 1
_KINDS[2, 33] = 1
_KINDS[3, 48:58] = 1


def describe(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps of all descriptions of all lines (descriptions x lines), bytes per line, and lines per text."""
    split = [t.split("\n") if t else [] for t in texts]
    counts = np.array([len(s) for s in split])
    lines = [x for s in split for x in s]
    n = len(lines)
    if not n:
        return np.zeros((10, 0), dtype=np.int64), np.zeros(0), counts
    encoded = [x.encode("utf-8", "surrogatepass") for x in lines]
    size = np.array([len(e) for e in encoded])
    raw = np.frombuffer(b"\n".join(encoded) + b"\n", dtype=np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    shares = [np.add.reduceat(kind[raw], begin) / np.maximum(1, size) for kind in _KINDS]
    words, bounds = word_hashes(lines, BLANKS)
    n_words = np.diff(bounds)
    owner = np.repeat(np.arange(n), n_words)
    by_line = np.lexsort((words, owner))
    new = np.ones(len(words), dtype=bool)
    new[1:] = (owner[by_line][1:] != owner[by_line][:-1]) | (words[by_line][1:] != words[by_line][:-1])
    different = np.bincount(owner[by_line][new], minlength=n) / np.maximum(1, n_words)
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner, weights=again, minlength=n) / np.maximum(1, n_words)
    seen_before, doc = np.zeros(n, dtype=np.int64), 0
    for s in split:
        held: set[str] = set()
        for k, x in enumerate(s):
            seen_before[doc + k] = 2 if k and x == s[k - 1] else int(x in held)
            held.add(x)
        doc += len(s)
    # Few words differ less easily: the ratio is read together with the length.
    long = np.minimum(2, np.log10(np.maximum(1, n_words)).astype(np.int64))
    rows = [
        np.minimum(STEPS - 2, np.log2(np.maximum(1, size)).astype(np.int64)),
        np.minimum(STEPS - 2, np.log2(np.maximum(1, n_words)).astype(np.int64)),
        np.where(long > 0, np.searchsorted(_RATIOS, different), STEPS - 2),
        np.searchsorted(_SHARES, repeats),
        *[np.searchsorted(_SHARES, s) for s in shares],
        np.minimum(STEPS - 2, (size / np.maximum(1, n_words) / 3).astype(np.int64)),
        seen_before,
    ]
    return np.stack(rows).astype(np.int64), size.astype(np.float64), counts


def with_neighbours(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The descriptions of each line, the one before and the one after (``STEPS - 1`` beyond the text)."""
    starts = np.cumsum(counts) - counts
    full = counts > 0
    before, after = np.roll(rows, 1, axis=1), np.roll(rows, -1, axis=1)
    before[:, starts[full]] = STEPS - 1
    after[:, (starts + counts - 1)[full]] = STEPS - 1
    return np.concatenate([rows, before, after])


@dataclass
class Model:
    field: crf.Chain | None
    curve: np.ndarray | None
    share: float  # of label 1


def _good_text(field: crf.Chain, rows: np.ndarray, size: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the length-weighted share of good text and of its worst line, and its bad lines."""
    good = field.tag(with_neighbours(rows, counts), counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    weight = size + 1
    share = np.bincount(owner, weights=good * weight, minlength=len(counts)) / np.maximum(1, np.bincount(owner, weights=weight, minlength=len(counts)))
    worst = np.ones(len(counts))
    np.minimum.at(worst, owner, good)
    return share, worst, np.bincount(owner, weights=good < 0.5, minlength=len(counts)).astype(np.int64)


def _curve_inputs(share: np.ndarray, worst: np.ndarray) -> np.ndarray:
    share, worst = (np.clip(x, 1e-4, 1 - 1e-4) for x in (share, worst))
    return np.column_stack([np.log(share / (1 - share)), np.log(worst / (1 - worst))]) / 4


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    rows, share = sample(docs, labels, "quality", per_class)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, label in zip(batch["doc_id"], batch["text"], batch["label"], strict=True):
                steps, size, _ = describe([text])
                # A run of lines at a place that the id decides.
                a = zlib.crc32(str(doc_id).encode()) % max(1, steps.shape[1] - MOST_LINES + 1)
                cut = slice(a, a + MOST_LINES)
                out.append((doc_id, int(label), steps[:, cut].T.ravel().astype(np.int8), size[cut].astype(np.int32)))
            yield pd.DataFrame(out, columns=["doc_id", "label", "steps", "size"])

    got = rows.mapInPandas(send, "doc_id long, label int, steps array<tinyint>, size array<int>").limit(2 * per_class).collect()
    got = sorted((r for r in got if r["size"]), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    if len({r["label"] for r in got}) < 2:
        return Model(None, None, share)

    def flat(part):
        counts = np.array([len(r["size"]) for r in part])
        steps = np.concatenate([np.array(r["steps"], dtype=np.int64).reshape(len(r["size"]), -1) for r in part]).T
        return steps, np.concatenate([np.array(r["size"], dtype=np.float64) for r in part]), counts, np.array([r["label"] for r in part])

    half = got[::2]
    steps, _, counts, label = flat(half)
    field = crf.fit(with_neighbours(steps, counts), np.repeat(label, counts), counts, STEPS)
    rest = got[1::2] if len({r["label"] for r in got[1::2]}) == 2 else got
    steps, size, counts, label = flat(rest)
    good, worst, _ = _good_text(field, steps, size, counts)
    # The sample holds the labels in other shares than the table: weigh them back.
    weight = np.where(label == 1, share / label.mean(), (1 - share) / (1 - label.mean()))
    return Model(field, crf.logistic(_curve_inputs(good, worst), label, weight), share)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1, higher is better), ``n_lines`` and ``bad_lines``.

    Null and empty texts, and all texts when there was nothing to learn, score the
    share of good labels. Columns of these names in ``docs`` are replaced.
    """
    docs = docs.drop("score", "n_lines", "bad_lines")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for series in batches:
            texts, parts = list(series), []
            for part in slices(texts, 1_000_000):
                steps, size, counts = describe(texts[part.start: part.stop])
                score, bad = np.full(len(counts), model.share), np.zeros(len(counts), dtype=np.int64)
                if model.field is not None:
                    good, worst, bad = _good_text(model.field, steps, size, counts)
                    score = np.where(counts > 0, crf.probability(_curve_inputs(good, worst), model.curve), score)
                parts.append(pd.DataFrame({"score": score, "n_lines": counts.astype(np.int64), "bad_lines": bad}))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"score": [], "n_lines": [], "bad_lines": []}).astype({"n_lines": "int64", "bad_lines": "int64"})

    [judged] = hidden(docs, "judged")
    rows = docs.withColumn(judged, F.pandas_udf(judge, "score double, n_lines long, bad_lines long")("text"))
    return rows.select(*docs.columns, f"{judged}.*")


def op5_quality(spark, sf_dir):
    """Quality of every whole text, learned from labels outside the held-out fold."""
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(in_training("doc_id", 4, 2))
    rows = scored(docs, fit(docs, labels))
    return rows.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "n_lines", "bad_lines")
