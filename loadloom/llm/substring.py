"""Removal of word sequences that occur more than once, with an FM-index per shard of the corpus."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadloom.llm import common as c
from loadloom.llm.fm_index import FMIndex
from loadloom.sources.stage import stage


def anchor_runs(h: np.ndarray, doc_of: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows) of every run of windows that have the same anchor, and lie in one text.

    A window's anchor is its leftmost ``gram``-word sequence of least hash, which its words alone
    decide, so equal windows have equal anchors at the same place.
    """
    g = c.grams(h, gram)
    at = c.window_argmin(g, window - gram + 1)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = doc_of[:len(at)] == doc_of[window - 1:window - 1 + len(at)]
    head = ok.copy()
    head[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
    first = np.flatnonzero(head)
    tail = ok.copy()
    tail[:-1] &= (at[1:] != at[:-1]) | ~ok[1:]
    return g[at[first]], first, np.flatnonzero(tail) - first + 1


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _anchors(window: int, gram: int):
    def run(batches):
        for b in batches:
            for at, part in c.text_parts(b.column(1)):
                buf, offsets = c.joined(part)
                starts, ends = c.word_bounds(buf, c.SPACES)
                first = np.searchsorted(starts, offsets)
                doc_of = np.repeat(np.arange(len(part)), np.diff(first))
                a, s, n = anchor_runs(c.word_hashes(buf, starts, ends), doc_of, window, gram)
                d = doc_of[s] if len(s) else np.zeros(0, np.int64)
                cuts = np.searchsorted(d, np.arange(len(part) + 1))
                sha = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in part]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(part)), pa.array(np.diff(first)), pa.array(sha), _lists(cuts, c.as_long(a), pa.int64()),
                     _lists(cuts, s - first[d], pa.int32()), _lists(cuts, n, pa.int16())],
                    ["key", "n_words", "sha", "anchors", "starts", "spans"])
    return run


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _bodies(window: int, crowded: int, remembered: int = 200_000):
    """Cut the candidate stretches out of the texts; each distinct stretch's words are sent once per task."""

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            keys, texts, weights, runs = (b.column(i) for i in range(4))
            rows: list[tuple] = []
            for k in range(b.num_rows):
                words = texts[k].as_py().encode().split()
                for r in runs[k].as_py():
                    s, n = r["start"], r["span"]
                    pieces = [(s + j, 1) for j in range(n)] if r["n"] > crowded else [(s, n)]
                    for at, m in pieces:
                        body = b" ".join(words[at:at + m + window - 1])
                        d = _digest(body)
                        # a crowded anchor's windows are dealt by their own words instead of by the anchor
                        route = int.from_bytes(d[:8], "little", signed=True) if r["n"] > crowded else r["anchor"]
                        known = d in seen
                        if not known:
                            if len(seen) >= remembered:
                                seen.clear()
                            seen.add(d)
                        rows.append((d, route, keys[k].as_py(), at, weights[k].as_py(), None if known else body))
                    if len(rows) >= 20_000:
                        yield _body_batch(rows)
                        rows = []
            if rows:
                yield _body_batch(rows)
    return run


def _body_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds)], ["body_key", "route", "key", "start", "m", "body"])


def _search(window: int, shard_words: int):
    """Index consecutive routes of a partition, about ``shard_words`` words at a time, and stream the same stretches through."""

    def flush(held):
        ids: dict[bytes, int] = {}
        seqs, out = [], []
        for _, _, body in held:
            seqs.append(np.array([ids.setdefault(w, len(ids) + 1) for w in body.split()], np.int64))
        index = FMIndex(seqs, np.array([m for _, m, _ in held], np.int64))
        lens = np.fromiter(map(len, seqs), np.int64, len(seqs))
        base = np.cumsum(lens) - lens
        wins = lens - window + 1
        owner = np.repeat(np.arange(len(seqs)), wins)
        offset = np.arange(int(wins.sum())) - np.repeat(np.cumsum(wins) - wins, wins)
        length = index.matching(np.concatenate(seqs), base[owner] + offset + window - 1, window)
        hit = length == window
        owner, offset = owner[hit], offset[hit]
        cuts = np.searchsorted(owner, np.arange(len(seqs) + 1))
        for i, (key, _, _) in enumerate(held):
            o = offset[cuts[i]:cuts[i + 1]]
            if len(o):
                gap = np.flatnonzero(np.diff(o) > 1)
                out.append((key, [{"lo": int(x), "hi": int(y) + window} for x, y in zip(o[np.r_[0, gap + 1]], o[np.r_[gap, len(o) - 1]])]))
        return out

    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches):
        held, words, last = [], 0, None
        for b in batches:
            for key, route, m, body in zip(*(b.column(i).to_pylist() for i in range(4))):
                if words >= shard_words and route != last:
                    out = flush(held)
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([v for _, v in out], kind)], ["body_key", "spans"])
                    held, words = [], 0
                held.append((key, m, body))
                words += body.count(b" ") + 1
                last = route
        if held:
            out = flush(held)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([v for _, v in out], kind)], ["body_key", "spans"])
    return run


def _strip(batches):
    """Take the spans out of each text."""
    for b in batches:
        for at, part in c.text_parts(b.column(1)):
            gone, sha, kept_text = [], [], []
            for text, spans in zip(part, b.column(2).slice(at, len(part))):
                words = text.split()
                keep = np.ones(len(words), bool)
                for s in spans.as_py():
                    keep[s["lo"]:s["hi"]] = False
                kept = b" ".join([words[i] for i in np.flatnonzero(keep)])
                gone.append(len(words) - int(keep.sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(gone, pa.int64()), pa.array(sha), pa.array(kept_text)],
                                             ["key", "n_removed", "sha", "kept"])


def repeated_spans(docs: DataFrame, text_col: str = "text", window: int = 35, gram: int = 8, crowded: int = 2000,
                   shard_words: int = 300_000) -> tuple[DataFrame, DataFrame]:
    """Per distinct text (key, n_words, sha), and (key, spans of word positions) of those with a repeated window.

    Every ``window``-word window has an anchor that its words decide, so equal windows meet at
    the same anchor. Anchors that occur once in the corpus are dropped (their windows
    cannot repeat); the stretches around the others are dealt to shards by
    anchor, and each shard is an FM-index of its distinct stretches, weighted by how often they
    occur. The stretches are streamed through it backwards: a window whose match reaches
    ``window`` words with two or more occurrences is repeated. An anchor with more than
    ``crowded`` occurrences is dealt window by window instead, so that a passage that a
    third of all documents share is one weighted entry and the different texts around
    it spread over all shards. Copies of a text are one text with a weight.
    """
    key = c.text_key(text_col)
    base = c.in_small_batches(docs).select(key.alias("key"), c.text_of(text_col).alias("text"))
    made = base.mapInArrow(_anchors(window, gram), "key binary, n_words long, sha string, anchors array<long>, starts array<int>, spans array<short>")
    first = [F.first(x).alias(x) for x in ("n_words", "sha", "anchors", "starts", "spans")]
    texts = stage(made.groupBy("key").agg(F.count("*").alias("m"), *first))

    runs = texts.select("key", "m", F.explode(F.arrays_zip(F.col("anchors").alias("anchor"), F.col("starts").alias("start"), F.col("spans").alias("span"))).alias("r"))
    runs = runs.select("key", "m", "r.*")
    # written, so that the join has two shuffled sides and a frequent anchor can be split
    often = stage(runs.groupBy("anchor").agg(F.sum("m").alias("n")).where("n > 1"))
    hits = runs.join(often, "anchor")
    per_text = hits.groupBy("key").agg(F.first("m").alias("m"), F.collect_list(F.struct("start", "span", "anchor", "n")).alias("runs"))
    bodies = stage(base.groupBy("key").agg(F.first("text").alias("text")).join(per_text, "key").select("key", "text", "m", "runs")
                   .mapInArrow(_bodies(window, crowded), "body_key binary, route long, key binary, start int, m long, body binary"))

    distinct = bodies.groupBy("body_key").agg(F.first("route").alias("route"), F.sum("m").alias("m"), F.max("body").alias("body"))
    words = int(distinct.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // 6
    found = (distinct.select("body_key", "route", "m", "body").repartition(c.partitions(docs, words, shard_words), "route").sortWithinPartitions("route")
             .mapInArrow(_search(window, shard_words), "body_key binary, spans array<struct<lo:int,hi:int>>"))
    spans = (bodies.select("body_key", "key", "start").join(found, "body_key")
             .select("key", F.expr("transform(spans, s -> named_struct('lo', s.lo + start, 'hi', s.hi + start))").alias("spans"))
             .groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    return texts.select("key", "n_words", "sha"), stage(spans)


def _kept(docs: DataFrame, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    texts, spans = repeated_spans(docs, text_col, window)
    base = docs.select(c.text_key(text_col).alias("key"), c.text_of(text_col).alias("text"))
    stripped = (base.groupBy("key").agg(F.first("text").alias("text")).join(spans, "key").select("key", "text", "spans")
                .mapInArrow(_strip, "key binary, n_removed long, sha string, kept string"))
    return texts, stripped


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """One row per document: words, removed words, and the SHA-256 of what is kept.

    Every word covered by a window whose words also start anywhere else is removed, in all
    its places; windows are judged on the input. A null text has no words; texts
    shorter than a window lose nothing; repeated rows count as repeats of each other; other
    columns are ignored; no rows give no rows.
    """
    texts, stripped = _kept(docs, text_col, window)
    verdict = stage(texts.join(stripped.drop("kept").withColumnRenamed("sha", "kept_sha"), "key", "left")
                    .select("key", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256")))
    return (docs.select(F.col(id_col).alias("doc_id"), c.text_key(text_col).alias("key")).join(verdict, "key")
            .select("doc_id", "n_words", "n_removed", "kept_sha256"))


def without_repeats(docs: DataFrame, text_col: str = "text", window: int = 35) -> DataFrame:
    """The documents with repeated words cut out of their texts; a text of which nothing is left becomes empty.

    Untouched texts stay as they are, byte for byte; all rows and columns stay.
    """
    _, stripped = _kept(docs, text_col, window)
    key, kept = c.free_name(docs, "_key"), c.free_name(docs, "_kept")
    changed = stripped.select(F.col("key").alias(key), F.col("kept").alias(kept))
    others: list[Column] = [F.coalesce(kept, text_col).alias(text_col) if x == text_col else F.col(x) for x in docs.columns]
    return docs.withColumn(key, c.text_key(text_col)).join(changed, key, "left").select(*others)
