"""Language of a text: known words by their frequency in each language, unseen words by ever shorter character n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadloom.llm.common import chosen_ids, text_of

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_LONGEST = 5


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters (with their combining marks)."""
    return _WORD.findall(text.lower())


def ngrams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between edge marks; single characters without the marks."""
    marked = word if n == 1 else f"<{word}>"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


@dataclass(frozen=True)
class Model:
    """Log frequencies per language of known words and n-grams (``grams[n]`` for length n), one row each."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[int, dict[str, int]]
    table: np.ndarray
    prior: np.ndarray

    def word_rows(self, word: str) -> list[int]:
        """A known word's row; else the rows of its longest n-grams of which any is known; none if no character is known."""
        at = self.words.get(word)
        if at is not None:
            return [at]
        for n in range(_LONGEST, 0, -1):
            known = self.grams.get(n, {})
            rows = [known[g] for g in ngrams(word, n) if g in known]
            if rows:
                return rows
        return []


def _counts(texts: Iterator[tuple[str, str]]) -> Counter:
    """Occurrences of (language, kind, string); kind 0 holds words, kind n the n-grams."""
    words: Counter = Counter()
    for lang, text in texts:
        words.update((lang, w) for w in words_of(text))
    out: Counter = Counter()
    for (lang, w), c in words.items():
        out[lang, 0, w] += c
        for n in range(1, _LONGEST + 1):
            for g in ngrams(w, n):
                out[lang, n, g] += c
    return out


def model_of(langs: list[str], counts: list[tuple[str, int, str, int]], documents: dict[str, int]) -> Model:
    """The model of (language, kind, string, occurrences); half an occurrence is added everywhere.

    A string is known if it occurs at least twice, so that a slip of one document does not become a word.
    """
    column = {lang: i for i, lang in enumerate(langs)}
    total: Counter = Counter()
    for _, kind, s, c in counts:
        total[kind, s] += c
    place = {key: i for i, key in enumerate(sorted(k for k, c in total.items() if c >= 2))}
    table = np.zeros((len(place), len(langs)))
    for lang, kind, s, c in counts:
        if (kind, s) in place:
            table[place[kind, s], column[lang]] += c
    kinds = np.array([k for k, _ in place], np.int64)
    for kind in np.unique(kinds):
        rows = kinds == kind
        table[rows] = np.log((table[rows] + 0.5) / (table[rows].sum(0) + 0.5 * rows.sum()))
    found: dict[int, dict[str, int]] = {}
    for (kind, s), i in place.items():
        found.setdefault(kind, {})[s] = i
    prior = np.array([documents[lang] for lang in langs], float)
    return Model(langs, found.get(0, {}), {n: g for n, g in found.items() if n}, table.astype(np.float32), prior / max(1.0, prior.sum()))


def fit(docs: DataFrame, learnt: Column, per_lang: int = 1000, total: int = 16_000, max_bytes: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model:
    """The model of a bounded sample of the rows that ``learnt`` marks and whose language is not null.

    A language gives at most ``per_lang`` documents of at most ``max_bytes``, all languages together ``total``
    (with more languages than ``total``, the most frequent ones). Documents are taken in hash order; of
    a repeated id the smallest text. The strings of the sample are counted in Spark; the driver gets
    their counts, which the parameters bound.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.col(lang_col).alias("lang"), learnt.alias("learnt")).where(
        F.col("learnt") & F.col("id").isNotNull() & F.col("lang").isNotNull())
    seen = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(total).collect()
    documents = {r["lang"]: r["n"] for r in seen}
    if not documents:
        return Model([], {}, {}, np.zeros((0, 0), np.float32), np.zeros(0))
    room = max(1, min(per_lang, total // len(documents)))
    short = rows.where(F.octet_length("text") <= max_bytes).select("id", F.col("lang").alias("cls"))
    ids = chosen_ids(short, dict.fromkeys(documents, room))
    sample = (rows.join(F.broadcast(ids.withColumnRenamed("cls", "lang")), ["id", "lang"]).where(F.octet_length("text") <= max_bytes)
              .groupBy("id", "lang").agg(F.min("text").alias("text")).select("lang", "text"))

    def run(batches):
        for b in batches:
            got = _counts(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            if got:
                lang, kind, string = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(kind, pa.int32()), pa.array(string, pa.string()), pa.array(got.values(), pa.int64())],
                                                 ["lang", "kind", "string", "n"])

    counts = sample.mapInArrow(run, "lang string, kind int, string string, n long").groupBy("lang", "kind", "string").agg(F.sum("n").alias("n")).collect()
    return model_of(sorted(documents), [tuple(r) for r in counts], documents)


def judged(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, confidence) of each text.

    A word's rows are worked out once for all texts given; a text's rows are summed over its
    occurrences. The confidence is the share of the best language in a softmax of that sum, damped by the root of
    the number of words, whose evidence is not independent.
    """
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    if not model.langs:
        return out
    place: dict[str, int] = {}
    word, times, sizes, at = [], [], [], []
    for i, text in enumerate(texts):
        found = Counter(words_of(text or ""))
        if found:
            at.append(i)
            sizes.append(len(found))
            word += [place.setdefault(w, len(place)) for w in found]
            times += found.values()
    if not at:
        return out
    rows, lens = [], []
    for w in place:
        got = model.word_rows(w)
        rows += got
        lens.append(len(got))
    lens = np.array(lens)
    of_word = np.repeat(np.arange(len(lens)), lens)
    of_text = np.repeat(np.arange(len(at)), sizes)
    word, times = np.array(word), np.array(times, float)
    share = 1.0 / lens[of_word]
    z = np.empty((len(at), len(model.langs)))
    for k in range(len(model.langs)):
        mean = np.bincount(of_word, model.table[rows, k] * share, len(lens))
        z[:, k] = np.bincount(of_text, mean[word] * times)
    z = z / np.sqrt(np.bincount(of_text, times))[:, None] + np.log(model.prior + 1e-9)
    p = np.exp(z - z.max(1, keepdims=True))
    best = p.argmax(1)
    for i, b, share in zip(at, best.tolist(), (p.max(1) / p.sum(1)).tolist()):
        out[i] = (model.langs[b], share)
    return out


def identify(docs: DataFrame, model: Model, part_chars: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text.

    A null text, one without a letter, and every text where nothing was learnt, is ``und`` with score 0;
    a text of which no character is known gets the most frequent language, by the prior alone. Ties go to the first
    language in order. Null ids and repeated rows are all judged; other columns are ignored; no rows give no rows.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for b in batches:
            texts = b.column(1)
            at, part, size, got = 0, [], 0, []
            for i in range(len(texts)):
                part.append(texts[i].as_py())
                size += len(part[-1] or "")
                if size >= part_chars or i + 1 == len(texts):
                    got += judged(model, part)
                    at, part, size = i + 1, [], 0
            lang, score = zip(*got) if got else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
