"""Toxic spans by a linear-chain conditional random field over tokens.

Tokens are words of lower-case letters and digits. A token is described by hashes
of itself, of its first 4 and 6 bytes, and of the tokens beside it. Forward-backward marginals
tag toxic tokens; their expected number, their largest and their density give a
document's score by a logistic curve; neighbouring tagged tokens are reported as spans.

Labels are given per document, so tokens are labelled first: in a toxic document
those whose word or beginning occurs, in the sample, in toxic documents ``PRECISION``
of the time and ``SUPPORT`` times at least; all others are not toxic. The sample has ``PER_CLASS`` documents of each label
and ``MOST_TOKENS`` tokens of each at most. Two thirds of it label and fit the field, the rest the curve.
Sequences are lines, cut after ``SEQUENCE`` tokens. Scoring reads all of every text in the scan, with no shuffle.
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
from closetlake.llm.hashing import slices, word_hashes
from closetlake.llm.labelled import sample

PER_CLASS = 800
MOST_TOKENS = 1000
PRECISION, SUPPORT = 0.75, 4
SEQUENCE = 256
BUCKETS = 1 << 15
PREFIXES = (4, 6)
CUT = 0.5

#: A-Z to lower case, ASCII characters that are no letter or digit to a space, a line's end stays.
_TOKENS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass
class Tokens:
    """Hashes of the tokens of some texts (a row for whole tokens and one for each prefix), sequences, and places."""

    hashes: np.ndarray
    lengths: np.ndarray
    counts: np.ndarray  # tokens per text
    first: np.ndarray  # code point offsets in the text
    last: np.ndarray


def read(texts: list, places: bool = True) -> Tokens:
    split = [t.split("\n") if t else [] for t in texts]
    lines = [x for s in split for x in s]
    hashes, bounds, starts, ends, begin, raw = word_hashes(lines, _TOKENS, PREFIXES)
    per_line = np.diff(bounds)
    cuts = np.concatenate([np.full(n // SEQUENCE + (n % SEQUENCE > 0), SEQUENCE) for n in per_line]) if len(per_line) else np.zeros(0, dtype=np.int64)
    if len(cuts):
        pieces = -(-per_line // SEQUENCE)
        tails = np.cumsum(pieces)[pieces > 0] - 1
        cuts[tails] = (per_line - (pieces - 1) * SEQUENCE)[pieces > 0]
    line_counts = np.array([len(s) for s in split])
    owner = np.repeat(np.arange(len(texts)), line_counts)
    counts = np.bincount(owner, weights=per_line, minlength=len(texts)).astype(np.int64)
    first = last = np.zeros(0, dtype=np.int64)
    if places:
        # Lines are joined by one blank as they are by one line end in the text: offsets count code points from the text's start.
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        text_begin = np.zeros(len(texts), dtype=np.int64)
        line_at = np.cumsum(line_counts) - line_counts
        full = line_counts > 0
        text_begin[full] = points[begin[line_at[full]]]
        base = np.repeat(text_begin, counts)
        first, last = points[starts] - base, points[ends] - base
    return Tokens(hashes.astype(np.uint32), cuts.astype(np.int64), counts, first, last)


def features(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Feature numbers: the token, its prefixes, the token before and after (within the sequence)."""
    own = (hashes % np.uint32(BUCKETS - 1)).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    full = lengths > 0
    before, after = np.roll(own[0], 1), np.roll(own[0], -1)
    before[starts[full]] = BUCKETS - 1
    after[(starts + lengths - 1)[full]] = BUCKETS - 1
    return np.concatenate([own, before[None], after[None]])


@dataclass
class Model:
    field: crf.Chain | None
    curve: np.ndarray | None
    share: float


def _inputs(toxic: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected toxic tokens, the largest marginal and the density of each text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    expected = np.bincount(owner, weights=toxic, minlength=len(counts))
    largest = np.zeros(len(counts))
    np.maximum.at(largest, owner, toxic)
    return np.column_stack([np.log1p(expected), largest, np.log1p(100 * expected / np.maximum(1, counts))])


def _marked(hashes: np.ndarray, owner: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Tokens of toxic documents whose hash is found mostly in such documents."""
    out = np.zeros(hashes.shape[1], dtype=bool)
    for row in hashes:
        values, number = np.unique(row, return_inverse=True)
        pairs = np.unique(number.astype(np.int64) * len(label) + owner)
        toxic = label[pairs % len(label)]
        both = np.bincount(pairs // len(label), minlength=len(values))
        bad = np.bincount(pairs // len(label), weights=toxic, minlength=len(values))
        out |= ((bad >= SUPPORT) & (bad >= PRECISION * both))[number]
    return out & (label[owner] == 1)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    rows, share = sample(docs, labels, "toxic", per_class)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, label in zip(batch["doc_id"], batch["text"], batch["label"], strict=True):
                found = read([text], places=False)
                ends = np.cumsum(found.lengths)
                # Whole sequences from a place that the id decides, going round, up to the bound.
                a = zlib.crc32(str(doc_id).encode()) % max(1, len(ends)) if len(ends) and ends[-1] > MOST_TOKENS else 0
                turn = np.roll(np.arange(len(ends)), -a)
                turn = turn[np.cumsum(found.lengths[turn]) <= MOST_TOKENS]
                at = np.concatenate([np.arange(ends[k] - found.lengths[k], ends[k]) for k in turn]) if len(turn) else np.zeros(0, dtype=np.int64)
                out.append((doc_id, int(label), found.hashes[:, at].tobytes(), found.lengths[turn].astype(np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "label", "hashes", "lengths"])

    got = rows.mapInPandas(send, "doc_id long, label int, hashes binary, lengths binary").limit(2 * per_class).collect()
    got = sorted((r for r in got if r["hashes"]), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))

    def flat(part):
        hashes = np.concatenate([np.frombuffer(r["hashes"], dtype=np.uint32).reshape(1 + len(PREFIXES), -1) for r in part], axis=1)
        each = [np.frombuffer(r["lengths"], dtype=np.int32).astype(np.int64) for r in part]
        lengths, counts = np.concatenate(each), np.array([x.sum() for x in each])
        return hashes, lengths, counts, np.array([r["label"] for r in part])

    rest = got[2::3]
    main = [r for k, r in enumerate(got) if k % 3 < 2]
    if len({r["label"] for r in main}) < 2:
        return Model(None, None, share)
    rest = rest if len({r["label"] for r in rest}) == 2 else got
    hashes, lengths, counts, label = flat(main)
    marked = _marked(hashes, np.repeat(np.arange(len(label)), counts), label)
    field = crf.fit(features(hashes, lengths), marked.astype(np.int64), lengths, BUCKETS, steps=30)
    hashes, lengths, counts, label = flat(rest)
    x = _inputs(field.tag(features(hashes, lengths), lengths), counts)
    weight = np.where(label == 1, share / label.mean(), (1 - share) / (1 - label.mean()))
    return Model(field, crf.logistic(x, label, weight), share)


def _spans(toxic: np.ndarray, found: Tokens) -> list[list[dict]]:
    """For each text the stretches of neighbouring tokens tagged toxic, as code point offsets (the end excluded)."""
    out: list[list[dict]] = [[] for _ in found.counts]
    owner = np.repeat(np.arange(len(found.counts)), found.counts)
    at = np.flatnonzero(toxic >= 0.5)
    for k, i in enumerate(at):
        row = out[owner[i]]
        if row and k and at[k - 1] == i - 1 and owner[i - 1] == owner[i]:
            row[-1]["end"] = int(found.last[i])
        else:
            row.append({"start": int(found.first[i]), "end": int(found.last[i])})
    return out


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1, higher is more toxic) and ``spans`` (start, end in code points).

    Null and empty texts score as texts without toxic tokens; all texts score the share of
    toxic labels when there was nothing to learn. Columns of these names in ``docs`` are replaced.
    """
    docs = docs.drop("score", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for series in batches:
            texts, scores, spans = list(series), [], []
            for part in slices(texts, 300_000):
                found = read(texts[part.start: part.stop])
                if model.field is None:
                    scores.append(np.full(len(found.counts), model.share))
                    spans.extend([] for _ in found.counts)
                    continue
                toxic = model.field.tag(features(found.hashes, found.lengths), found.lengths)
                scores.append(crf.probability(_inputs(toxic, found.counts), model.curve))
                spans.extend(_spans(toxic, found))
            yield pd.DataFrame({"score": np.concatenate(scores) if scores else np.zeros(0), "spans": pd.Series(spans, dtype=object)})

    [judged] = hidden(docs, "judged")
    rows = docs.withColumn(judged, F.pandas_udf(judge, "score double, spans array<struct<start:long,end:long>>")("text"))
    return rows.select(*docs.columns, f"{judged}.*")


def op6_toxicity(spark, sf_dir):
    """Toxicity of every whole text, learned from labels outside the held-out fold."""
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(in_training("doc_id", 5, 0))
    rows = scored(docs, fit(docs, labels))
    return rows.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "spans")
