"""Toxicity scores from averaged subword embeddings under a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom.llm.common import chosen_ids, in_small_batches, mix, text_of

_WORD = re.compile(r"\w+")


def subwords(words: list[str], size: int, low: int = 3, high: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word index) of every word's bag: the word itself and its byte n-grams, with edge marks.

    All words are hashed at once as one buffer, by rolling over it once per n.
    """
    marked = [b"<" + w.encode() + b">" for w in words]
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    buf = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64) + np.uint64(1)
    of = np.repeat(np.arange(len(marked)), lens)
    first = np.cumsum(lens) - lens
    out, owner = [], []
    h = np.zeros(len(buf), np.uint64)
    for n in range(1, high + 1):
        h = h[:len(buf) - n + 1] * np.uint64(0x100000001B3) + buf[n - 1:]
        if n >= low and len(h):
            ok = of[:len(h)] == of[n - 1:]
            out.append(h[ok])
            owner.append(of[:len(h)][ok])
    place = np.arange(len(buf)) - np.repeat(first, lens)
    powers = np.multiply.accumulate(np.full(int(lens.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64))
    out.append(np.add.reduceat(buf * powers[place], first) if len(marked) else np.zeros(0, np.uint64))
    owner.append(np.arange(len(marked)))
    return (mix(np.concatenate(out)) % np.uint64(size)).astype(np.int64), np.concatenate(owner)


@dataclass(frozen=True)
class Model:
    """What scoring needs of the trained model: the class-1 logit of each bucket's embedding, bias and calibration."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    attention: float

    def word_logits(self, words: list[str]) -> np.ndarray:
        bucket, owner = subwords(words, len(self.weights))
        return np.bincount(owner, self.weights[bucket], len(words)) / np.bincount(owner, minlength=len(words))

    def bag_logit(self, z: np.ndarray, counts: np.ndarray) -> float:
        """Logit of the text's averaged bag, given its distinct words' logits and how often each occurs.

        The average runs over every occurrence, weighted by exp(``attention`` * logit): a
        softmax attention. The class layer is linear, so the average may be
        taken of logits instead of embeddings. A text without words has the bias alone.
        """
        if not len(z):
            return self.bias
        w = counts * np.exp(self.attention * (z - z.max()))
        return float((w * z).sum() / w.sum()) + self.bias

    def score(self, logit: float | np.ndarray):
        return _sigmoid(self.slope * logit + self.shift)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(texts: list[str], toxic: np.ndarray, size: int = 1 << 18, dim: int = 4, attention: float = 0.3, rounds: int = 60, rate: float = 0.3, least_docs: int = 2, clean_weight: float = 10.0,
          seed: int = 7) -> Model:
    """Embeddings and softmax trained jointly by full-batch Adam on the subword bags of words.

    Labels are of documents, so the words' targets are learned along: at first every word of a toxic
    document carries its label, which leaves ordinary words undecided and marks those that clean
    documents lack; then only the most toxic words of each toxic document keep it,
    renewed every round, and all others count as clean. A quarter of the documents is kept aside to calibrate the
    logit of a document's bag, averaged with ``attention``, into a probability.
    """
    rng = np.random.default_rng(seed)
    held = np.arange(len(texts)) % 4 == 3
    vocab: dict[str, int] = {}
    bags = [_bag(t, vocab) for t in texts]
    tokens = [np.sort(w) for w, _ in bags]
    fitted = [i for i in range(len(texts)) if not held[i] and len(tokens[i])]
    if not fitted:
        return Model(np.zeros(size, np.float32), 0.0, 0.0, -40.0, attention)
    seen = np.bincount(np.concatenate([tokens[i] for i in fitted]), minlength=len(vocab))
    common = np.flatnonzero(seen >= least_docs)  # a word of one document says nothing about another
    if not len(common):
        common = np.flatnonzero(seen)
    place = np.full(len(vocab), -1)
    place[common] = np.arange(len(common))
    names = list(vocab)
    flat, of_word = subwords([names[i] for i in common], size)
    n = len(common)
    lens = np.bincount(of_word, minlength=n)
    owner = np.concatenate([np.full(len(tokens[i]), i) for i in fitted])
    token = place[np.concatenate([tokens[i] for i in fitted])]
    owner, token = owner[token >= 0], token[token >= 0]
    bad = toxic[owner] == 1
    clean = np.bincount(token[~bad], minlength=n).astype(float)
    dirty = np.bincount(token[bad], minlength=n).astype(float)
    ratio = max(1, toxic[fitted].sum()) / max(1, (toxic[fitted] == 0).sum())
    bad_owner, bad_token = owner[bad], token[bad]

    emb = rng.normal(0, 1e-3, (size, dim))
    out = rng.normal(0, 0.5, (dim, 2))
    b = np.zeros(2)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, out, b)]
    for step in range(1, rounds + 1):
        word = np.stack([np.bincount(of_word, emb[flat, k], n) for k in range(dim)], 1) / lens[:, None]
        logits = word @ out + b
        p = _sigmoid(logits[:, 1] - logits[:, 0])
        if step <= rounds // 3:
            up, down = dirty, clean * ratio
        else:
            best = np.full(len(texts), 0.0)
            np.maximum.at(best, bad_owner, p[bad_token])
            chosen = p[bad_token] >= 0.8 * best[bad_owner]
            up = np.bincount(bad_token[chosen], minlength=n).astype(float)
            down = clean + np.where(up > 0, 0.0, dirty)
        scale = np.sqrt(up + down + 1e-12)  # a word weighs by the root of its documents
        up, down = up / scale, down / scale
        d = -(1 - p) * up / max(up.sum(), 1e-9) + clean_weight * p * down / max(down.sum(), 1e-9)
        d_logits = np.stack([-d, d], 1)
        d_out, d_b = word.T @ d_logits, d_logits.sum(0)
        d_word = d_logits @ out.T / lens[:, None]
        d_emb = np.stack([np.bincount(flat, d_word[of_word, k], size) for k in range(dim)], 1)
        for param, grad, (m, v) in zip((emb, out, b), (d_emb, d_out, d_b), state):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad ** 2 - v)
            root = np.sqrt(v / (1 - 0.99 ** step))
            # the mean root keeps buckets with little evidence close to where they were
            param -= rate * (m / (1 - 0.9 ** step)) / (root + root.mean())
    weights = (emb @ (out[:, 1] - out[:, 0])).astype(np.float32)
    model = Model(weights, float(b[1] - b[0]), 1.0, 0.0, attention)
    word = model.word_logits(names)
    bag = np.array([model.bag_logit(word[w], n) for w, n in bags])
    aside = held if len(set(toxic[held])) == 2 else np.ones(len(texts), bool)  # too few texts: calibrate on all
    return _calibrated(model, bag[aside], toxic[aside])


def _bag(text: str, vocab: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the text's distinct words in ``vocab``, which grows by new ones, and how often each occurs."""
    bag = Counter(_WORD.findall(text.lower()))
    return np.fromiter((vocab.setdefault(w, len(vocab)) for w in bag), np.int64, len(bag)), np.fromiter(bag.values(), np.float64, len(bag))


def _calibrated(model: Model, bag: np.ndarray, y: np.ndarray, rounds: int = 2000) -> Model:
    """Slope and shift of a logistic fit of the label on the document's bag logit."""
    mean, scale = bag.mean(), bag.std() + 1e-9
    x = (bag - mean) / scale
    a, c = 1.0, 0.0
    pos = max(1, int((y > 0).sum()))
    neg = max(1, int((y == 0).sum()))
    w = np.where(y > 0, 0.5 / pos, 0.5 / neg)
    for _ in range(rounds):
        g = w * (_sigmoid(a * x + c) - y)
        a -= 2.0 * float((g * x).sum() + 1e-4 * a)
        c -= 2.0 * float(g.sum())
    return Model(model.weights, model.bias, a / scale, c - a * mean / scale, model.attention)


def training_sample(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int], max_bytes: int, id_col: str, text_col: str) -> tuple[list[str], np.ndarray]:
    """Labelled texts outside the held-out third, in hash order, at most ``per_class`` of (clean, toxic) and ``max_bytes`` each.

    Ids are chosen before any text moves; then one scan brings the chosen texts, of a repeated id the smallest.
    """
    mark = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("cls"))
            .where(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1))
    short = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).where(F.octet_length("text") <= max_bytes)
    ids = chosen_ids(short.select("id").join(mark, "id").select("id", "cls"), dict(enumerate(per_class)))
    got = short.join(F.broadcast(ids), "id").groupBy("id", "cls").agg(F.min("text").alias("text")).orderBy("cls", F.xxhash64("id"), "id").collect()
    order = np.random.default_rng(0).permutation(len(got))
    return [got[i]["text"] for i in order], np.array([r["cls"] for r in got], np.int64)[order]


def fit(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (2000, 1000), max_bytes: int = 20_000, id_col: str = "doc_id",
        text_col: str = "text") -> Model:
    """Train on the bounded sample; without both classes every score is 0."""
    texts, y = training_sample(docs, labels, per_class, max_bytes, id_col, text_col)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << 18, np.float32), 0.0, 0.0, -40.0, 0.3)
    return train(texts, y)


def _logits(model: Model, texts: pa.Array, part_chars: int = 1 << 22) -> np.ndarray:
    """Bag logit of each text; the distinct words of about ``part_chars`` characters are scored at once."""
    out, at = np.zeros(len(texts)), 0
    while at < len(texts):
        vocab: dict[str, int] = {}
        bags, size, end = [], 0, at
        while end < len(texts) and size < part_chars:
            text = texts[end].as_py() or ""
            size += len(text) + 1
            bags.append(_bag(text, vocab))
            end += 1
        word = model.word_logits(list(vocab))
        out[at:end] = [model.bag_logit(word[w], n) for w, n in bags]
        at = end
    return out


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Every occurrence of every word counts: repeats of a toxic word raise a text's score, words less toxic
    than the text lower it. A null or empty text is scored by the bias alone; a null id is not held out; repeated
    rows are all scored; other columns are ignored; no rows give no rows.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for b in batches:
            out = model.score(_logits(model, b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["doc_id", "score"])

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    return (in_small_batches(docs).select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
            .select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def keep_civil(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents scored below ``threshold``, with all their columns; null and empty texts stay."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            keep = model.score(_logits(model, b.column(at))) < threshold
            yield b.filter(pa.array(keep))

    return in_small_batches(docs).mapInArrow(run, docs.schema)
