"""Benchmark passages in documents by winnowing: joined fingerprints, then extended hits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom.llm import common as c
from loadloom.sources.stage import stage

# Bytes that end a word: everything in ASCII but digits and letters.
GAPS = np.zeros(256, bool)
GAPS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_CUT = bytes(0x20 if GAPS[b] else b for b in _FOLD)


def words_of(text: str) -> list[bytes]:
    """A-Z lowered, cut at every ASCII character that is no digit or letter."""
    return text.encode().translate(_CUT).split()


def winnow(h: np.ndarray, doc_of: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the fingerprints: the leftmost least ``gram``-word hash of every window of ``span`` words.

    Two texts that share ``span`` words in a row select the same hash inside them.
    """
    g = c.grams(h, gram)
    at = c.window_argmin(g, span - gram + 1)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ok = doc_of[:len(at)] == doc_of[span - 1:span - 1 + len(at)]
    pos = np.unique(at[ok])
    return g[pos], pos


def whole(h: np.ndarray, doc_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every ``n``-word sequence; the hash also depends on ``n``."""
    g = c.grams(h, n)
    ok = np.flatnonzero(doc_of[:len(g)] == doc_of[n - 1:n - 1 + len(g)]) if len(g) else np.zeros(0, np.int64)
    return c.mix(g[ok] + np.uint64(n)), ok


def _prints(window: int, gram: int, lengths: list[int], wanted: np.ndarray | None, items: bool):
    """Fingerprints of texts. Sequences shorter than a window are published for the given lengths, by items only at their own."""

    def run(batches):
        for b in batches:
            for at, texts in c.text_parts(b.column(1)):
                part = [t.translate(_CUT) for t in texts]
                buf, offsets = c.joined(part)
                starts, ends = c.word_bounds(buf, c.SPACES)
                first = np.searchsorted(starts, offsets)
                n = np.diff(first)
                doc_of = np.repeat(np.arange(len(part)), n)
                h = c.word_hashes(buf, starts, ends)
                found = [winnow(h, doc_of, window, gram)]
                for m in lengths:
                    v, p = whole(h, doc_of, m)
                    own = n[doc_of[p]] == m if items and len(p) else np.ones(len(p), bool)
                    found.append((v[own], p[own]))
                v, p = (np.concatenate(x) for x in zip(*found))
                if wanted is not None and len(v):
                    i = np.minimum(np.searchsorted(wanted, c.as_long(v)), max(0, len(wanted) - 1))
                    ok = wanted[i] == c.as_long(v) if len(wanted) else np.zeros(len(v), bool)
                    v, p = v[ok], p[ok]
                order = np.argsort(p, kind="stable")
                v, p = v[order], p[order]
                d = doc_of[p] if len(p) else np.zeros(0, np.int64)
                cuts = np.searchsorted(d, np.arange(len(part) + 1))
                lists = (pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x)) for x in (c.as_long(v), (p - first[d]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), b.column(2).slice(at, len(part)), pa.array(n), *lists],
                                                 ["id", "key", "n_words", "hashes", "places"])
    return run


def _occurring(ids: np.ndarray, own: np.ndarray, need: int, starts: np.ndarray) -> np.ndarray:
    """The ``starts`` at which ``need`` words of ``ids`` also stand somewhere in ``own``: met by hash, compared word by word."""
    if not len(starts):
        return starts
    g = c.grams(c.mix(own.astype(np.uint64)), need)
    order = np.argsort(g, kind="stable")
    mine, theirs = (np.lib.stride_tricks.sliding_window_view(x, need) for x in (ids, own))
    wanted = c.grams(c.mix(ids.astype(np.uint64)), need)[starts]
    at, end = (np.searchsorted(g[order], wanted, side) for side in ("left", "right"))
    found, left = [], np.arange(len(starts))
    # A second turn only compares windows whose hash met that of a different window.
    while len(left := left[at[left] < end[left]]):
        same = (mine[starts[left]] == theirs[order[at[left]]]).all(1)
        found.append(starts[left[same]])
        left = left[~same]
        at[left] += 1
    return np.concatenate([starts[:0], *found])


def _extend(window: int, gram: int):
    """Extend every hit to the windows around it and keep those that occur in the item; linear in both texts, however repetitive."""

    def run(batches):
        for b in batches:
            hit_n, found = [], []
            for text, hits in zip(b.column(1), b.column(2)):
                number: dict[bytes, int] = {}
                ids = np.array([number.setdefault(w, len(number)) for w in words_of(text.as_py())], np.int64)
                edges, items = np.zeros(len(ids) + 1, np.int64), []
                for item in hits:
                    own = np.array([number.get(w, -1) for w in words_of(item["item_text"].as_py())], np.int64)
                    need = min(window, len(own))
                    places = item["at"].values.to_numpy(zero_copy_only=False).astype(np.int64)
                    starts = np.unique(places[:, None] - np.arange(window - gram + 1))
                    starts = _occurring(ids, own, need, starts[(starts >= 0) & (starts <= len(ids) - need)])
                    if len(starts):
                        np.add.at(edges, starts, 1)
                        np.add.at(edges, starts + need, -1)
                        items.append(item["item_key"].as_py())
                hit_n.append(int((edges.cumsum() > 0).sum()))
                found.append(items)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hit_n, pa.int64()), pa.array(found, pa.list_(pa.binary()))], ["key", "n_hit", "items"])
    return run


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = 13, gram: int = 5, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text: str = "text", share: int = 20, filter_rows: int = 1 << 20) -> DataFrame:
    """One row per document: words, words inside an occurring benchmark window, the items, the verdict.

    Both tables publish the least 5-word hash of every window of 13 words, so every shared window
    shares a fingerprint at the same place in it. An item shorter than a window publishes itself,
    and documents publish all their sequences of those lengths. Fingerprints are joined; each hit is extended to the
    windows that hold it, which are compared with the item word by word, so the result is exact: only real equal words count. If the
    benchmark has at most ``filter_rows`` fingerprints (8 bytes each), they are also sent to
    the tasks to drop other fingerprints before the join; above that all of them are shuffled.

    Null texts and texts without words have no windows, for documents and items alike. Repeated
    items are told apart by id; repeated rows are all returned; other columns of either table are
    ignored; an empty benchmark hits nothing, no documents give no rows.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), c.text_of(item_text).alias("text"), c.text_key(item_text).alias("key"))
    texts = stage(items.groupBy("key").agg(F.first("text").alias("text")))
    names = stage(items.select(F.col("key").alias("item_key"), "item_id").distinct())
    kinds = "id {}, key binary, n_words long, hashes array<long>, places array<int>"
    own = stage(texts.select(F.lit(None).cast("string").alias("id"), "text", "key")
                .mapInArrow(_prints(window, gram, list(range(1, window)), None, True), kinds.format("string")))
    short = [r[0] for r in own.where(f"n_words BETWEEN 1 AND {window - 1}").select(F.col("n_words").cast("int")).distinct().collect()]
    marks = own.select(F.col("key").alias("item_key"), F.explode(F.arrays_zip(F.col("hashes").alias("h"))).alias("f")).select("item_key", "f.*")
    wanted = None
    if marks.count() <= filter_rows:
        wanted = np.unique(np.array([r[0] for r in marks.select("h").distinct().collect()], np.int64))

    kind = dict(docs.dtypes)[id_col]
    made = stage(c.in_small_batches(docs).select(F.col(id_col).alias("id"), c.text_of(text_col).alias("text"), c.text_key(text_col).alias("key"))
                 .mapInArrow(_prints(window, gram, sorted(short), wanted, False), kinds.format(kind)))
    prints = (made.where("size(hashes) > 0").select("key", F.explode(F.arrays_zip(F.col("hashes").alias("h"), F.col("places").alias("p"))).alias("f"))
              .select("key", "f.*").distinct())
    # Only the places in the document are kept, so repetitive texts meet in |p| rows and not in |p| x |q|.
    hits = (prints.join(marks.select("item_key", "h").distinct(), "h").groupBy("key", "item_key").agg(F.collect_set("p").alias("at"))
            .join(texts.select(F.col("key").alias("item_key"), F.col("text").alias("item_text")), "item_key")
            .groupBy("key").agg(F.collect_list(F.struct("item_key", "item_text", "at")).alias("hits")))
    hits = stage(hits)
    base = docs.select(c.text_key(text_col).alias("key"), c.text_of(text_col).alias("text"))
    grown = (base.join(hits.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")).join(hits, "key").select("key", "text", "hits")
             .mapInArrow(_extend(window, gram), "key binary, n_hit long, items array<binary>"))
    grown = stage(grown.where("n_hit > 0"))
    listed = (grown.select("key", F.explode("items").alias("item_key")).join(names, "item_key")
              .groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")))
    verdict = stage(grown.select("key", "n_hit").join(listed, "key", "left"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return (made.select(F.col("id").alias("doc_id"), "key", "n_words").join(verdict, "key", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The documents that are not contaminated; all their columns."""
    key = c.free_name(docs, "_key")
    bad = contaminated_words(docs.select(c.text_key(text_col).alias("_key"), F.col(text_col).alias("_text")), benchmark, id_col="_key", text_col="_text", **settings)
    hit = bad.where("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, c.text_key(text_col)).join(hit, key, "left_anti").select(docs.columns)
