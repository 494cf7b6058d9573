"""Log probabilities of whole texts: counts of words and of the sequences they run in, a context-mixing model of new words, and the text's own history."""

from __future__ import annotations

import math

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom.llm.common import mix, text_of
from loadloom.llm.context_mixing import OFFSETS, Mixer, count_bits
from loadloom.sources.stage import stage

#: Shares of the text's own history in the experts that a text's probability averages over.
HISTORY = (0.0, 0.05, 0.2, 0.5)
#: How often a context must have occurred to weigh as much as what stands below it, for the last word and the last two words.
TRUST = ((math.inf, math.inf), (1000.0, 10.0), (50.0, 0.5), (50.0, 0.02))
#: Tokens after which the experts' weights are drawn anew from how they did, and the share dealt out evenly then.
EVERY, SWITCH = 32, 1 / 16
#: Tokens that are priced at once.
_TOKENS = 1 << 17
#: Bytes of text that are cut into words at once, a longer text alone.
_AT_ONCE = 4 << 20


def _numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z lowered and cut at ASCII white space, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    real = pc.binary_length(flat).to_numpy() > 0
    upto = np.concatenate([[0], np.cumsum(real)])
    return (flat if real.all() else flat.filter(pa.array(real))), np.diff(upto[ends])


def _chunks(chunk_bytes: int, id_type: pa.DataType):
    """Documents as word numbers of their chunk, and each chunk's words with their training counts."""

    def flush(chunk: int, rows: list[pa.RecordBatch], words: list[pa.Array], sizes: list[np.ndarray]):
        none = lambda k, t: pa.nulls(k, t)
        doc, held, n_bytes = pa.concat_batches(rows).columns
        size, n = np.concatenate(sizes), len(doc)
        coded = pa.chunked_array(words, pa.string()).dictionary_encode().chunks  # all with the same dictionary; none without words
        ids = np.concatenate([np.zeros(0, "<u4"), *(c.indices.to_numpy() for c in coded)], dtype="<u4", casting="unsafe")
        vocab = coded[0].dictionary.cast(pa.binary()) if coded else pa.array([], pa.binary())
        starts = np.concatenate([[0], np.cumsum(4 * size)]).astype(np.int32)
        blobs = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(starts), pa.py_buffer(ids)])
        yield pa.RecordBatch.from_arrays(
            [pa.array([True] * n), pa.array([chunk] * n, pa.int64()), doc, held,
             pa.array(size + 1, pa.int64()), n_bytes, blobs, none(n, pa.binary()), none(n, pa.int32()), none(n, pa.int64())], names)
        v = len(vocab)
        counts = np.bincount(ids[np.repeat(~held.to_numpy(zero_copy_only=False), size)], minlength=v)
        for a in range(0, v, 50_000):
            part = vocab.slice(a, 50_000)
            k = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([False] * k), pa.array([chunk] * k, pa.int64()), none(k, id_type), none(k, pa.bool_()), none(k, pa.int64()), none(k, pa.int64()),
                 none(k, pa.binary()), part, pa.array(np.arange(a, a + k, dtype=np.int32)), pa.array(counts[a:a + k], pa.int64())], names)

    names = ["is_doc", "chunk", "doc_id", "held_out", "n_tokens", "n_bytes", "ids", "word", "place", "n_train"]

    def run(batches):
        task = TaskContext.get()
        chunk = (task.partitionId() if task else 0) << 24
        rows, words, sizes, size = [], [], [], 0
        for b in batches:
            n_bytes = pc.binary_length(b.column(1)).cast(pa.int64())
            known = np.cumsum(n_bytes.to_numpy() + 64)
            plain = pa.RecordBatch.from_arrays([b.column(0), b.column(2), n_bytes], ["doc_id", "held_out", "n_bytes"])
            at = 0
            while at < b.num_rows:
                before = known[at - 1] if at else 0
                to = min(b.num_rows, int(np.searchsorted(known, before + min(chunk_bytes - size, _AT_ONCE))) + 1)
                flat, n = _numbered(b.column(1).slice(at, to - at))
                rows.append(plain.take(pa.array(np.arange(at, to))))  # a copy: a slice would keep the batch's texts
                words.append(flat)
                sizes.append(n)
                size += int(known[to - 1] - before)
                at = to
                if size >= chunk_bytes:
                    yield from flush(chunk, rows, words, sizes)
                    chunk += 1
                    rows, words, sizes, size = [], [], [], 0
        if rows:
            yield from flush(chunk, rows, words, sizes)
    return run


def _tables(words: DataFrame, types: int, words_per_task: int = 500_000, block: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
    """Bit counts of all training words, summed over tasks by blocks of slots; the blocks that come back hold no more than the tables."""

    def run(batches):
        held: list[bytes] = []
        for b in batches:
            held += b.column(0).to_pylist()
        if held:
            slot, n0, n1 = count_bits(held)
            edges = np.flatnonzero(np.concatenate([[True], np.diff(slot // block) > 0]))
            for a, b in zip(edges, [*edges[1:], len(slot)]):
                n = np.zeros((block, 2), "<i4")
                n[slot[a:b] % block, 0], n[slot[a:b] % block, 1] = n0[a:b], n1[a:b]
                yield pa.RecordBatch.from_arrays([pa.array([slot[a] // block], pa.int32()), pa.array([n.tobytes()], pa.binary())], ["block", "counts"])

    def add(parts: pa.Table) -> pa.Table:
        n = np.zeros(2 * block, np.int64)
        for raw in parts["counts"]:
            n += np.frombuffer(raw.as_buffer(), "<i4")
        return pa.table({"block": parts["block"][:1], "counts": pa.array([n.astype("<f4").tobytes()], pa.binary())})

    tasks = max(1, -(-types // words_per_task))
    rows = words.select("word").repartition(tasks).mapInArrow(run, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").toArrow()
    counts = np.zeros((-(-int(OFFSETS[-1]) // block), block, 2), np.float32)
    for at, raw in zip(rows["block"].to_pylist(), rows["counts"]):
        counts[at] = np.frombuffer(raw.as_buffer(), "<f4").reshape(-1, 2)
    counts = counts.reshape(-1, 2)[:OFFSETS[-1]]
    return counts[:, 0].copy(), counts[:, 1].copy()


def _mixer(words: DataFrame, types: int, at_once: int, words_per_task: int = 250_000) -> Mixer:
    """The mixer learned from all training words: tasks learn online from words of their own, ``at_once`` at a time and in hash order.

    Weights and refinement are the averages over the tasks, by how many bits each gate and cell learned from; those
    that met none keep their start. At most as many rows as there are gates and cells come back.
    """
    zeros, ones = _tables(words, types)

    def run(batches):
        mixer, held = Mixer.start(zeros, ones), []
        gates, cells = np.zeros(len(mixer.weights)), np.zeros(mixer.refine.size)

        def learn(some):
            for mass, new in zip((gates, cells), mixer.learn(some)):
                mass += new

        for b in batches:
            held += b.column(0).to_pylist()
            while len(held) >= at_once:
                learn(held[:at_once])
                held = held[at_once:]
        learn(held)
        value, mass = np.concatenate([mixer.weights.ravel(), mixer.refine.ravel()]), np.concatenate([np.repeat(gates, mixer.weights.shape[1]), cells])
        met = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(mass[met]), pa.array((value * mass)[met])], ["place", "mass", "value"])

    tasks = max(1, -(-types // words_per_task))
    learned = (words.select("word").repartition(tasks, "word").sortWithinPartitions(F.xxhash64("word", F.lit(1)), "word")
               .mapInArrow(run, "place int, mass double, value double").groupBy("place").agg((F.sum("value") / F.sum("mass")).alias("value")).toArrow())
    mixer = Mixer.start(zeros, ones)
    flat = np.concatenate([mixer.weights.ravel(), mixer.refine.ravel()])
    flat[learned["place"].to_numpy()] = learned["value"].to_numpy()
    mixer.weights, mixer.refine = flat[:mixer.weights.size].reshape(mixer.weights.shape), flat[mixer.weights.size:].reshape(mixer.refine.shape)
    return mixer


def _pack(a: np.ndarray) -> bytes:
    """Non-negative integers by byte planes, which leaves small numbers small."""
    a = np.ascontiguousarray(a)
    wide = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize)[:, :wide].T)
    return len(a).to_bytes(7, "little") + bytes([wide]) + pa.compress(planes, "zstd", asbytes=True)


def _unpack(raw: bytes, kind: type = np.uint64) -> np.ndarray:
    n, wide = int.from_bytes(raw[:7], "little"), raw[7]
    planes = np.frombuffer(pa.decompress(raw[8:], n * wide, "zstd"), np.uint8).reshape(wide, n)
    out = np.zeros(n, kind)
    out.view(np.uint8).reshape(n, out.itemsize)[:, :wide] = planes.T
    return out


def _join(words: Sequence[bytes]) -> bytes:
    """Words hold no blank, so blanks part them."""
    raw = b" ".join(words)
    return len(words).to_bytes(7, "little") + len(raw).to_bytes(7, "little") + pa.compress(raw, "zstd", asbytes=True)


def _split(raw: bytes) -> list[bytes]:
    n, size = (int.from_bytes(raw[a:a + 7], "little") for a in (0, 7))
    return pa.decompress(raw[14:], size, "zstd", asbytes=True).split(b" ") if n else []


def _whole_chunks(chunk_bytes: int, id_type: pa.DataType):
    """One row per chunk: its documents, their words as numbers, and the distinct words with their training counts."""
    names = ["chunk", "doc_id", "held_out", "n_bytes", "sizes", "ids", "words", "n_train"]

    def one(docs: pa.RecordBatch, vocab: list[pa.RecordBatch]) -> pa.RecordBatch:
        c = {n: docs.column(i) for i, n in enumerate(docs.schema.names)}
        words = [w for b in vocab for w in b.column(7).to_pylist()]
        train = np.concatenate([np.zeros(0, np.int64), *(b.column(9).to_numpy() for b in vocab)])
        ids = np.frombuffer(b"".join(c["ids"].to_pylist()), "<u4")
        whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays([c["chunk"][:1], whole(c["doc_id"]), whole(c["held_out"]), whole(c["n_bytes"]), *(pa.array([x], pa.binary()) for x in (
            _pack(c["n_tokens"].to_numpy() - 1), _pack(ids), _join(words), _pack(train)))], names)

    def run(batches):
        docs, vocab = None, []
        for b in _chunks(chunk_bytes, id_type)(batches):
            if not b.column(0)[0].as_py():
                vocab.append(b)
                continue
            if docs is not None:
                yield one(docs, vocab)
            docs, vocab = b, []
        if docs is not None:
            yield one(docs, vocab)
    return run


def _hashes(words: Sequence[bytes], together: int = 50_000) -> np.ndarray:
    """A 64-bit hash of every word."""
    out = np.empty(len(words), np.uint64)
    for a in range(0, len(words), together):
        some = words[a:a + together]
        lens = np.fromiter(map(len, some), np.int64, len(some))
        upto = np.concatenate([[0], np.cumsum(lens)])
        place = np.arange(upto[-1]) - np.repeat(upto[:-1], lens)
        power = np.multiply.accumulate(np.full(int(lens.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        buf = mix(np.frombuffer(b"".join(some), np.uint8).astype(np.uint64) + np.uint64(7)) * power[place]
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(buf, dtype=np.uint64)])
        out[a:a + together] = mix(run[upto[1:]] - run[upto[:-1]] + lens.astype(np.uint64))
    return out


def _stream(ids: np.ndarray, sizes: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, document, place in it) of all tokens; a text's end is token ``n_words``."""
    n = sizes + 1
    ends = np.cumsum(n)
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
    place = np.arange(len(doc), dtype=np.int32) - np.repeat((ends - n).astype(np.int32), n)
    token, word = np.full(len(doc), n_words, np.int32), np.ones(len(doc), bool)
    word[ends - 1] = False
    token[word] = ids
    return token, doc, place


def _sequences(token: np.ndarray, place: np.ndarray, hashes: np.ndarray, bits: int, before: int) -> np.ndarray:
    """Hashes of ``bits`` bits of every token with the ``before`` (one or two) tokens before it; a text's start counts as one."""
    hashes, out = np.append(hashes, np.uint64(0xE0D)), np.empty(len(token), np.uint64)
    for lo in range(0, len(token), _TOKENS):
        start = max(0, lo - 2)
        first, own = place[start:lo + _TOKENS] == 0, hashes[token[start:lo + _TOKENS]]
        key = own
        for k in range(before):
            key = mix(np.roll(key, 1))
            key[first] = 0x57A7 + k
            key = mix(key * np.uint64(3) + own)
        out[lo:lo + _TOKENS] = key[lo - start:] >> np.uint64(64 - bits)
    return out


def _ordered(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys in order, where they stood, which differ from the one before); equal keys stay in their order. ``key`` is used up."""
    at = max(1, (len(key) - 1).bit_length())
    if bits + at <= 64:
        key <<= np.uint64(at)
        key |= np.arange(len(key), dtype=np.uint64)
        key.sort()
        pos = (key & np.uint64((1 << at) - 1)).astype(np.int32 if at < 32 else np.int64)
        key >>= np.uint64(at)
    else:
        pos = np.argsort(key, kind="stable")
        key = key[pos]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return key, pos, new


def _by_key(key: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same in sixteen parts of the keys, which takes less memory at once."""
    low = np.uint64(bits - 4)
    part = (key >> low).astype(np.uint8)
    for q in range(16):
        at = np.flatnonzero(part == q).astype(np.int32 if len(key) < 1 << 31 else np.int64)
        if len(at):
            s, pos, new = _ordered(key[at] & np.uint64((1 << int(low)) - 1), int(low))
            yield s | np.uint64(q) << low, at[pos], new


def _edges(ranges: int, bits: int) -> np.ndarray:
    return np.array([-(-(r << bits) // ranges) for r in range(ranges + 1)], np.uint64)


def _deal(ranges: int, bits: int):
    """A chunk's words and word sequences with their training counts, by ranges of hashes; within a range in the order of their hashes."""
    edges = _edges(ranges, bits)

    def cut(keys: np.ndarray, counts: np.ndarray):
        at = np.append(np.searchsorted(keys, edges[:-1]), len(keys))
        for r, (a, b) in enumerate(zip(at, at[1:])):
            yield (_pack(np.diff(keys[a:b], prepend=edges[r])), _pack(counts[a:b]))

    def run(batches):
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                words, train = _split(row["words"]), _unpack(row["n_train"], np.int64)
                hashes = _hashes(words)
                token, doc, place = _stream(_unpack(row["ids"], np.int32), _unpack(row["sizes"], np.int64), len(words))
                learnt = ~np.array(row["held_out"], bool)[doc]
                del doc
                parts = []
                for before in (1, 2):
                    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                    for s, pos, new in _by_key(_sequences(token, place, hashes, bits, before), bits):
                        first = np.flatnonzero(new)
                        keys.append(s[first])
                        counts.append(np.add.reduceat(learnt[pos], first, dtype=np.int64))
                    parts.append(list(cut(np.concatenate(keys), np.concatenate(counts))))
                order = np.argsort(hashes, kind="stable")
                at = np.append(np.searchsorted((hashes >> np.uint64(64 - bits))[order], edges[:-1]), len(order))
                for r in range(ranges):
                    mine = order[at[r]:at[r + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([row["chunk"]], pa.int64()), *(pa.array([x], pa.binary()) for x in (
                        _join([words[i] for i in mine]), _pack(train[mine]), *parts[0][r], *parts[1][r]))], [f.split()[0] for f in _DEALT.split(", ")])
    return run


_DEALT = "range int, chunk long, words binary, n_train binary, keys2 binary, n2 binary, keys3 binary, n3 binary"
_MET = "range int, words binary, c binary, chunks array<long>, places array<binary>, c2 array<binary>, c3 array<binary>"


def _meet(ranges: int, bits: int):
    """One row per range: its distinct words with their counts, and for every chunk which of them it holds and the counts of its sequences."""

    def run(parts: pa.Table) -> pa.Table:
        rows = parts.sort_by("chunk").to_pydict()
        flat, n = [], []
        for raw in rows["words"]:
            some = _split(raw)
            flat += some
            n.append(len(some))
        coded = pa.array(flat, pa.binary()).dictionary_encode()
        ids, vocab = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        del flat
        total = np.zeros(len(vocab), np.int64)
        np.add.at(total, ids, np.concatenate([_unpack(x, np.int64) for x in rows["n_train"]]))
        out = [[_pack(x) for x in np.split(ids, np.cumsum(n)[:-1])]]
        for keys, counts in (("keys2", "n2"), ("keys3", "n3")):
            held = [np.cumsum(_unpack(x)) for x in rows[keys]]
            ends = np.cumsum([len(x) for x in held])[:-1]
            held, c = np.concatenate(held), np.concatenate([_unpack(x) for x in rows[counts]])
            for _, pos, new in _by_key(held, bits - ranges.bit_length() + 1):
                first = np.flatnonzero(new)
                c[pos] = np.repeat(np.add.reduceat(c[pos], first), np.diff(np.append(first, len(pos))))
            out.append([_pack(x) for x in np.split(c, ends)])
        lists = [pa.array([x], pa.list_(pa.binary())) for x in out]
        return pa.table([parts["range"].combine_chunks()[:1], pa.array([_join(vocab)], pa.binary()), pa.array([_pack(total)], pa.binary()), pa.array([rows["chunk"]], pa.list_(pa.int64())), *lists],
                        [f.split()[0] for f in _MET.split(", ")])
    return run


def _token_log2(base: np.ndarray, c2: np.ndarray, n1: np.ndarray, c3: np.ndarray, n2: np.ndarray, trust: tuple[float, float]) -> np.ndarray:
    """log2 probability of tokens of base probability 2**``base`` that followed the last word c2 of n1 times and the last two words c3 of n2 times."""
    if trust == (math.inf, math.inf):
        return base
    one, two = n1 / (n1 + trust[0]), n2 / (n2 + trust[1])
    stay = (1 - one) * (1 - two)
    more = (1 - two) * one * c2 / np.maximum(n1, 1) + two * c3 / np.maximum(n2, 1)
    return np.where(more > 0, np.log2(np.maximum(stay * np.exp2(np.maximum(base, -1000)) + more, 1e-300)), base + np.log2(stay))


def _mixed(log2: Sequence[np.ndarray], before: np.ndarray, place: np.ndarray, doc: np.ndarray, n_docs: int, every: int | None = None) -> np.ndarray:
    """log2 probability of every text from its tokens' ones under several contexts: the experts add a share of the text's own words so far.

    After ``every`` tokens the experts weigh by what they gave so far, but for a share that is dealt out evenly; None: they are averaged over the whole text.
    """
    start = np.flatnonzero(place % every == 0 if every else place == 0)
    again = np.flatnonzero(before)
    past, paid = before[again] / place[again], np.add.reduceat(place > 0, start, dtype=np.int64)
    again_at = np.searchsorted(start, again, "right") - 1
    sums = []
    for one in log2:
        plain, p = np.add.reduceat(one, start), np.exp2(np.maximum(one[again], -1000))
        for share in HISTORY:
            if share:
                gain = np.log2(np.maximum((1 - share) * p + share * past, 1e-300)) - one[again] - math.log2(1 - share)
                sums.append(plain + paid * math.log2(1 - share) + np.bincount(again_at, gain, len(start)))
            else:
                sums.append(plain)
    sums = np.stack(sums, 1)
    out, weight = np.zeros(n_docs), np.full((n_docs, sums.shape[1]), 1 / sums.shape[1])
    of = doc[start]
    nth = np.arange(len(of)) - np.searchsorted(of, of)
    order = np.argsort(nth, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(nth[order])) + 1):
        d, top = of[rows], sums[rows].max(1)
        w = weight[d] * np.exp2(np.maximum(sums[rows] - top[:, None], -1000))
        whole = w.sum(1)
        out[d] += top + np.log2(whole)
        weight[d] = (1 - SWITCH) * w / whole[:, None] + SWITCH / sums.shape[1]
    return out


def _in_document(new: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each of the ordered keys stood in its document before, and in all of it."""
    first = new.copy()
    first[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(first)
    times = np.diff(np.append(first, len(new)))
    return np.arange(len(new)) - np.repeat(first, times), np.repeat(times, times)


def _history(token: np.ndarray, doc: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """How often every token stood in its document before it, and in all of it."""
    _, pos, new = _ordered(token.astype(np.uint64), max(1, int(n_words).bit_length()))
    out = np.empty((2, len(pos)), np.int64)
    out[:, pos] = _in_document(new, doc[pos])
    return out[0], out[1]


def score_texts(docs: DataFrame, fold: int = 10, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 32 << 20,
                mixer_words: int = 6_000) -> DataFrame:
    """One row per document: tokens, known tokens, unigram score and the model's log10 probability.

    Training texts are those with crc32(id) mod ``fold`` not 0. A token is a word (A-Z lowered, cut at
    ASCII white space) or the end of the text. The model mixes contexts over the running text. Without a context, a
    token's probability is a known word's share of the training tokens, or, with the chance of a new word (the share of
    words seen once), its bytes under the context-mixing model of words: bit
    predictors of five hashed contexts whose counts come from all distinct training words, mixed with gated weights
    and refined by a table, both learned online from all of them by tasks that take ``mixer_words`` words
    at a time, and averaged. The last word and the last two words add what followed them in all training texts,
    by how often they occurred; a training text's own sequences are taken out of these counts, so they tell what the other texts say.
    Experts differ in how far they trust contexts (``TRUST``) and the text's own words so far (``HISTORY``). Every ``EVERY`` tokens their
    weights move to those that did best on the text; texts of few tokens average them.

    Documents are turned into word numbers per chunk of a task. A chunk's distinct words and sequences
    travel by ranges of their hashes, meet there once, and their counts and prices go back in the chunk's order. Sequences are told
    apart by hashes of 16 bits more than the corpus' bytes take to number (48 at most). A null text is
    empty: one token, its end. A null id counts as empty text for the fold. Repeated
    rows all count; other columns are ignored; no rows give no rows; without training
    tokens every word is new.
    """
    spark = docs.sparkSession
    id_type = pa.int64() if dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint") else pa.string()
    kind = "long" if id_type == pa.int64() else "string"
    ident = F.col(id_col).cast(kind)
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % fold == 0
    chunks = stage(docs.select(ident.alias("doc_id"), text_of(text_col).alias("text"), held.alias("held_out")).mapInArrow(
        _whole_chunks(chunk_bytes, id_type), f"chunk long, doc_id array<{kind}>, held_out array<boolean>, n_bytes array<long>, sizes binary, ids binary, words binary, n_train binary"))

    n_bytes, ends = chunks.agg(F.coalesce(F.sum(F.aggregate("n_bytes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)),
                               F.coalesce(F.sum(F.size(F.filter("held_out", lambda x: ~x))), F.lit(0))).first()
    # A range holds about as much as a chunk.
    ranges = max(2 * spark.sparkContext.defaultParallelism, n_bytes // max(1 << 20, chunk_bytes) + 1)
    bits = min(48, max(24, int(n_bytes + ends).bit_length() + 16))
    met = stage(chunks.mapInArrow(_deal(ranges, bits), _DEALT).repartition(ranges, "range").groupBy("range").applyInArrow(_meet(ranges, bits), _MET))

    def spell(batches):
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                yield pa.RecordBatch.from_arrays([pa.array(_split(row["words"]), pa.binary()), pa.array(_unpack(row["c"], np.int64))], ["word", "c"])

    words = met.select("words", "c").mapInArrow(spell, "word binary, c long")
    known, types, once = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1)).first()
    total, distinct = known + ends, types + (ends > 0)
    fresh = min(0.5, max(1e-4, (once + 1) / (total + 2)))
    mixer = _mixer(words.where("c > 0"), types, mixer_words)

    def answer(batches):
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                cost = np.asarray(mixer.log2_words(_split(row["words"])), "<f4")
                c = _unpack(row["c"], np.int64)
                for chunk, raw, c2, c3 in zip(row["chunks"], row["places"], row["c2"], row["c3"]):
                    at = _unpack(raw, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([row["range"]], pa.int32()), *(pa.array([x], pa.binary()) for x in (
                        _pack(c[at]), cost[at].tobytes(), c2, c3))], ["part", "range", "c", "cost", "c2", "c3"])

    base_of = lambda c: np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    end_base, end_log2 = float(base_of(float(ends))), math.log2(max((1 - fresh) * ends / max(1, total), fresh * 2.0 ** -8))

    def read_chunk(texts: pa.Table, answers: pa.Table) -> pa.Table:
        (row,), got = texts.to_pylist(), answers.sort_by("range").to_pydict()
        hashes = _hashes(_split(row["words"]))
        order = np.argsort(hashes, kind="stable")
        c, cost = np.zeros(len(hashes), np.int64), np.zeros(len(hashes))
        c[order], cost[order] = np.concatenate([_unpack(x, np.int64) for x in got["c"]]), np.concatenate([np.frombuffer(x, "<f4") for x in got["cost"]])
        p = (1 - fresh) * c / max(1, total) + fresh * np.exp2(np.maximum(cost, -1000))
        log2 = np.append(np.where(p > 0, np.log2(np.maximum(p, 1e-300)), math.log2(fresh) + cost), end_log2)
        base, c = np.append(base_of(c), end_base), np.append(c, ends)
        sizes, held = _unpack(row["sizes"], np.int64), np.array(row["held_out"], bool)
        token, doc, place = _stream(_unpack(row["ids"], np.int32), sizes, len(hashes))
        times = []  # of every token with the one before and with the two before, in other texts
        for k, name in ((1, "c2"), (2, "c3")):
            counts, n = np.concatenate([_unpack(x, np.int64) for x in got[name]]), np.empty(len(token), np.float32)
            for _, pos, new in _by_key(_sequences(token, place, hashes, bits, k), bits):
                d, first = doc[pos], np.flatnonzero(new)
                here, counts = counts[:len(first)], counts[len(first):]
                n[pos] = np.maximum(0, np.repeat(here, np.diff(np.append(first, len(new)))) - ~held[d] * _in_document(new, d)[1])
            times.append(n)
        out, upto = [], np.cumsum(sizes + 1)
        cuts = np.flatnonzero(np.diff(np.concatenate([[-1], (upto - sizes - 1) // _TOKENS])))
        for a, b in zip(cuts, np.append(cuts[1:], len(sizes))):
            now = slice(int(upto[a] - sizes[a]) - 1, int(upto[b - 1]))
            first = upto[a:b] - sizes[a:b] - 1 - now.start
            at, t, d = place[now], token[now], doc[now] - a
            before, own = _history(t, d, len(hashes))
            n1, (c2, c3) = c[t] - ~held[a:b][d] * own, (x[now].astype(float) for x in times)
            n1, n2 = np.roll(n1, 1), np.roll(c2, 1)
            n1[first], n2[first] = ends - ~held[a:b], 0
            c2, c3 = np.minimum(c2, n1), np.minimum(c3, n2)
            score = _mixed([_token_log2(log2[t], c2, n1, c3, n2, x) for x in TRUST], before, at, d, b - a, EVERY)
            out.append((np.add.reduceat(c[t] > 0, first, dtype=np.int64), np.add.reduceat(base[t], first), score))
        n_known, base_score, score = map(np.concatenate, zip(*out))
        return pa.table({"doc_id": pa.array(row["doc_id"], id_type), "held_out": pa.array(held), "n_tokens": pa.array(sizes + 1), "n_known": pa.array(n_known),
                         "train_tokens": pa.array([total] * len(sizes), pa.int64()), "base_score": pa.array(base_score),
                         "score": pa.array(score * math.log10(2)), "bits_per_byte": pa.array(-score / np.maximum(1, np.array(row["n_bytes"], np.int64)))})

    spread = max(ranges, int(spark.conf.get("spark.sql.shuffle.partitions")))
    answers = met.mapInArrow(answer, "part long, range int, c binary, cost binary, c2 binary, c3 binary").repartition(spread, "part")
    return (chunks.drop("n_train").repartition(spread, "chunk").groupBy("chunk").cogroup(answers.groupBy("part"))
            .applyInArrow(read_chunk, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"))


def with_history(ids: np.ndarray, log2: np.ndarray, end: float) -> float:
    """log2 probability of the words and the end after them: the average over experts that give a fixed share to the words' frequency so far."""
    n = len(ids)
    token, doc, place = _stream(np.asarray(ids, np.int64), np.array([n]), int(max(ids, default=-1)) + 1)
    before, _ = _history(token, doc, int(token[-1]))
    return float(_mixed([np.append(log2, end)], before, place, doc, 1)[0])
