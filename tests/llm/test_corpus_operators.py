"""Every corpus operator against a brute-force version on small tables, with the odd cases each must survive."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loadloom.llm import decontaminate, embedding_dedup, licenses, lm_score, packing, sharding, simhash, substring, tokens, toxicity
from loadloom.llm.components import components
from loadloom.llm.fm_index import FMIndex

RNG = np.random.default_rng(5)
VOCAB = ["".join(RNG.choice(list("abcdefghij"), RNG.integers(1, 7))) for _ in range(60)] + ["Été", "naïve", "Don't", "x-y", "数据"]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(VOCAB, n))


PASSAGE = prose(50, 999)


def corpus():
    """(doc_id, text): prose, copies, near copies, shared passages, periodic, long, blank, empty and null texts, a repeated row, a null id."""
    out = [(i, prose(20 + 7 * i, i)) for i in range(20)]
    out += [(20 + i, out[5][1]) for i in range(5)]
    out += [(30 + i, out[6][1] + f" tail{i}") for i in range(4)]
    out += [(40 + i, f"{prose(30, 100 + i)}\n{PASSAGE}\t{prose(10, 200 + i)}") for i in range(5)]
    out += [(50, "the " * 120), (51, prose(6000, 7)), (52, " \t\n"), (53, ""), (54, None), (55, "Word"), (55, "Word"), (None, prose(40, 8)),
            (56, "x" * 70_000), (57, "<|endoftext|> " + prose(60, 9)), (58, PASSAGE + " " + PASSAGE)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None, "k", "b") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, block string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def words(t):
    return (t or "").encode().split()


# ---- sharding

def test_shards_are_gapless_and_grow_into_the_new_one_only(docs, empty):
    got = sharding.shard(docs, sharding.balanced_tree(24), sharding.balanced_tree(25), rows_per_bucket=2).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in corpus())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty, sharding.balanced_tree(24)).count() == 0


def test_tree_moves_stay_in_the_changed_subtree(spark):
    ids = spark.range(4000).withColumn("text", F.lit("a"))
    tree = sharding.balanced_tree(24)
    wide = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 1 else 1.0) for x in tree]
    r = sharding.shard(ids, tree, wide, id_col="id").collect()
    region, rack = {x.shard: x.region for x in tree}, {x.shard: (x.region, x.rack) for x in tree}
    for x in r:
        if region[x.shard] != region[x.grown_shard]:
            assert region[x.grown_shard] == 0
        elif rack[x.shard] != rack[x.grown_shard]:
            assert rack[x.grown_shard] == (0, 0)
        elif x.shard != x.grown_shard:
            assert x.grown_shard == 1
    share = sum(x.grown_shard == 1 for x in r) / len(r)
    assert 0.08 < share < 0.15 and max(Counter(x.shard for x in r).values()) < 230


# ---- substring

def brute_repeats(texts, w):
    count = Counter(tuple(t[i:i + w]) for t in texts for i in range(len(t) - w + 1))
    out = []
    for t in texts:
        keep = [True] * len(t)
        for i in range(len(t) - w + 1):
            if count[tuple(t[i:i + w])] > 1:
                keep[i:i + w] = [False] * w
        kept = [x for x, k in zip(t, keep) if k]
        out.append((len(t), len(t) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("crowded", [2000, 3])
def test_repeated_passages(docs, empty, crowded):
    want = [(i, *x) for (i, _), x in zip(corpus(), brute_repeats([words(t) for _, t in corpus()], 35))]
    if crowded == 2000:
        got = substring.remove_repeats(docs)
        assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
        assert substring.remove_repeats(empty).count() == 0
        cut = substring.without_repeats(docs)
        assert cut.columns == docs.columns and cut.count() == docs.count()
        texts = {r.doc_id: r.text for r in cut.where("doc_id in (0, 20, 54, 58)").collect()}
        assert texts == {0: corpus()[0][1], 20: "", 54: None, 58: ""}
    else:
        texts, spans = substring.repeated_spans(docs, crowded=crowded, shard_words=200)
        key = {hashlib.md5((t or "").encode()).digest(): x for (_, t), x in zip(corpus(), want)}
        got = {bytes(r.key): len({p for s in r.spans for p in range(s.lo, s.hi)}) for r in spans.collect()}
        assert got == {k: x[2] for k, x in key.items() if x[2]}


def test_fm_index_counts_and_matching_statistics():
    r = np.random.default_rng(1)
    seqs = [r.integers(1, 4, n) for n in (30, 1, 17, 30, 8)]
    seqs[3] = seqs[0].copy()
    weights = np.array([1, 5, 1, 2, 1])
    index = FMIndex(seqs, weights)
    ids, base = np.concatenate(seqs), np.cumsum([0] + [len(s) for s in seqs])
    ends = np.concatenate([np.arange(base[i] + len(s) // 2, base[i + 1]) for i, s in enumerate(seqs)])
    owner = np.searchsorted(base, ends, side="right") - 1
    for depth, e, got in ((6, ends, None),):
        ok = e - base[owner] + 1 >= depth
        e = e[ok]
        got = index.matching(ids, e, depth)
        for p, g in zip(e, got):
            best = 0
            for n in range(1, depth + 1):
                pat = tuple(ids[p - n + 1:p + 1])
                if sum(w for s, w in zip(seqs, weights) for i in range(len(s) - n + 1) if tuple(s[i:i + n]) == pat) >= 2:
                    best = n
                else:
                    break
            assert g == best


# ---- decontamination

def brute_contamination(texts, bench, window=13):
    win = defaultdict(set)
    for i, t in bench:
        w = decontaminate.words_of(t or "")
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            win[tuple(w[k:k + n])].add(i)
    for t in texts:
        w, items = decontaminate.words_of(t or ""), set()
        hit = [False] * len(w)
        for n in {len(k) for k in win}:
            for k in range(len(w) - n + 1):
                x = win.get(tuple(w[k:k + n]))
                if x:
                    hit[k:k + n] = [True] * n
                    items |= x
        n = sum(hit)
        yield len(w), n, len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), n > 0 and 20 * n >= len(w)


@pytest.mark.parametrize("filter_rows", [1 << 20, 0])
def test_contamination(spark, docs, empty, filter_rows):
    p = PASSAGE.split()
    bench = [(1, " ".join(p[3:40])), (10, " ".join(p[10:22])), (11, "word"), (2, None), (3, ""), (4, prose(30, 5555)), (5, " ".join(p[30:50]) + " zz"),
             (6, corpus()[2][1].upper()), (7, corpus()[2][1]), (8, "numbers 1, 2; 3"), (9, " ".join(p[:3] + ["gap"] + p[4:17]))]
    table = spark.createDataFrame([(i, t, "x") for i, t in bench], "item_id long, text string, key string")
    got = decontaminate.contaminated_words(docs, table, filter_rows=filter_rows)
    want = [(i, *x) for (i, _), x in zip(corpus(), brute_contamination([t for _, t in corpus()], bench))]
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
    assert sum(x[-1] for x in want) > 5
    if filter_rows:
        clean = decontaminate.clean_documents(docs, table)
        assert clean.columns == docs.columns and clean.count() == sum(not x[-1] for x in want)
        assert decontaminate.contaminated_words(empty, table).count() == 0
        assert decontaminate.contaminated_words(docs, table.limit(0)).where("n_hit > 0").count() == 0


# ---- embeddings

def test_embedding_links(spark):
    r = np.random.default_rng(3)
    centre = r.normal(size=(6, 12))
    vec = [(i, (centre[i % 6] + 0.12 * r.normal(size=12)).tolist(), i % 2) for i in range(120)]
    vec += [(200 + i, vec[0][1], 0) for i in range(9)]
    vec += [(300, None, 0), (301, [], 0), (302, [0.0] * 12, 0), (303, [1.0] * 11 + [float("nan")], 0), (304, [None] + [1.0] * 11, 0), (305, vec[0][1], None),
            (306, [1e-200] * 12, 1), (307, [1e200] * 12, 1), (308, [1.0, 2.0], 1), (309, [1.0, 2.0], 1), (310, [float("inf")] * 12, 1)]
    df = spark.createDataFrame([(i, v, y, "k") for i, v, y in vec], "vec_id long, embedding array<double>, label int, node string")
    ok = {}
    for i, v, y in vec:
        if y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v) / np.abs(v).max()
            ok[i] = (y, len(v), u / np.linalg.norm(u))
    link = {i: {j for j in ok if j != i and ok[j][:2] == ok[i][:2] and ok[i][2] @ ok[j][2] >= 0.93} for i in ok}
    label = {i: i for i, _, _ in vec}
    for _ in range(len(vec)):
        label = {i: min([label[i], *(label[j] for j in link.get(i, ()))]) for i in label}
    want = sorted(((i, len(link.get(i, ())), label[i], label[i] == i) for i in label), key=repr)
    assert max(x[1] for x in want) > 10
    for block in (2048, 16):
        assert rows(embedding_dedup.linked(df, block_rows=block, axes=3), "vec_id", "n_links", "component_id", "kept") == want
    assert embedding_dedup.linked(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (None, 3), (500, 501)]
    got = dict(tuple(x) for x in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(30)}, 500: 500, 501: 500}


# ---- toxicity

def test_toxicity_held_out(spark):
    r = np.random.default_rng(0)
    base = [f"{a}{b}" for a in ("tion", "ander", "ing", "lo", "sta") for b in ("re", "men", "low", "der", "s", "ting")]
    bad = ["vilefool", "vilefoolish", "scumbag", "scumbags"]

    def text(toxic):
        w = list(r.choice(base, 40))
        for k in range(3 if toxic else 0):
            w[int(r.integers(40))] = str(r.choice(bad))
        return " ".join(w)

    data = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "z") for i, t, _ in data] + [(1000, None, "z"), (1001, "", "z"), (None, "a b", "z"), (5, "x" * 50_000, "z"),
                                                                      (1002, "you vilefools and scumbagz", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in data] + [(None, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 404
    held = [(got[i], y) for i, _, y in data if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(g.held_out for g, _ in held)
    assert sum(g.predicted == y for g, y in held) / len(held) > 0.97
    assert got[1000].score == got[1001].score < 0.5 and got[1002].predicted == 1
    kept = toxicity.keep_civil(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, none).agg(F.max("score")).first()[0] < 1e-6


def test_toxicity_bag_is_an_average_over_occurrences():
    r = np.random.default_rng(1)
    base = [f"{a}{b}" for a in ("tion", "ander", "ing", "lo", "sta") for b in ("re", "men", "low", "der", "s", "ting")]
    texts = [" ".join([*r.choice(base, 40), *(r.choice(["vilefool", "scumbag"], 1) if i % 3 == 0 else [])]) for i in range(300)]
    model = toxicity.train(texts, np.array([int(i % 3 == 0) for i in range(300)]))

    def logit(text, model=model):
        return toxicity._logits(model, pa.array([text]))[0]

    def brute(text):
        z = [float(model.word_logits([w])[0]) for w in text.lower().split()]
        weight = [math.exp(model.attention * (x - max(z))) for x in z]
        return sum(a * b for a, b in zip(weight, z)) / sum(weight) + model.bias

    clean = " ".join(r.choice(base, 2_000))
    for text in ("vilefool", "vilefool ander", clean, clean + " vilefool", clean + " Vilefool" * 300, "staof"):
        assert abs(logit(text) - brute(text)) < 1e-6
    high = lambda text: model.score(logit(text)) >= 0.7
    assert high("vilefool") and high("vilefool " * 200) and high("vilefool scumbag")  # one word, repeated or not
    assert high(clean + " vilefool" * 300) and high("vilefool " + clean) and not high(clean)
    # repeats never lower the score, clean words never raise it
    up = [logit(clean + " vilefool" * n) for n in (0, 1, 3, 30, 300)]
    assert all(a <= b for a, b in zip(up, up[1:])) and up[0] < up[1] < up[-1]
    flat = replace(model, attention=0.05)  # so that a few clean words show
    down = [logit("vilefool " + " ".join(base[:n]), flat) for n in range(len(base))]
    assert all(a > b for a, b in zip(down, down[1:]))
    assert logit("") == logit("...") == model.bias and not high("")


# ---- simhash

def test_simhash(docs, empty):
    import xxhash

    def fp(t):
        w = (t or "").encode().lower().split()
        k = min(3, len(w))
        h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(len(w) - k + 1)] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    data = [(i, fp(t)) for i, t in corpus()]
    got = simhash.near_duplicates(docs)
    assert rows(got, "doc_id", "fingerprint") == sorted(((i, f"{f:016x}") for i, f in data), key=repr)
    label = {f: f for _, f in data}
    near = {f: [g for g in label if (f ^ g).bit_count() <= 2] for f in label}
    for _ in range(len(label)):
        label = {f: min(label[g] for g in near[f]) for f in label}
    least = {}
    for i, f in data:
        if i is not None:
            least[label[f]] = min(least.get(label[f], i), i)
    assert rows(got, "doc_id", "component_id") == sorted(((i, least.get(label[f])) for i, f in data), key=repr)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id") == sorted([(i,) for i in least.values()] + [(None,)], key=repr)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("pair_limit", [1 << 24, 500])
def test_every_close_pair_is_linked(spark, pair_limit):
    r = np.random.default_rng(2)
    seeds = r.integers(0, 2**63, 60, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds:
        for k in range(4):
            bits = r.choice(64, 2, replace=False)
            fps.add(int(s) ^ (1 << int(bits[0])) ^ (1 << int(bits[1])))
    hub = int(seeds[0])
    fps |= {hub ^ (1 << i) for i in range(64)}
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    comp = dict(tuple(x) for x in components(simhash.near_links(df, pair_limit=pair_limit)).collect())
    signed = fps.view(np.int64).tolist()
    near = [np.flatnonzero(np.bitwise_count(f ^ fps) <= 2) for f in fps]
    label = list(signed)
    while True:
        new = [min(label[j] for j in n) for n in near]
        if new == label:
            break
        label = new
    assert {f: comp.get(f, f) for f in signed} == dict(zip(signed, label))


# ---- tokens and packing

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))


def test_token_counts_equal_the_library(spark, docs, empty, tokenizer):
    want = [(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in corpus()]
    for part in (1 << 16, 50):
        got = tokens.count_tokens(docs, part_chars=part, batch_bytes=1000)
        assert rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert tokens.count_tokens(empty).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r[0] for r in real.orderBy("doc_id").select("text").collect()]
    own = [r[0] for r in tokens.count_tokens(real, part_chars=200).orderBy("doc_id").select("n_tokens").collect()]
    assert own == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_other_vocabularies(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary_path("piece_bpe_32k.model"))
    t = Tokenizer.from_file(tokens.vocabulary_path("word_bpe_49k.json"))
    few = docs.where("doc_id < 5")
    text = dict(corpus())
    for name, count in (("piece_bpe_32k.model", lambda x: len(sp.encode(x))), ("word_bpe_49k.json", lambda x: len(t.encode(x, add_special_tokens=False).ids))):
        assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(few, name).collect()} == {i: count(text[i]) for i in range(5)}


def test_packing(docs, empty, tokenizer):
    got = packing.pack(docs).collect()
    want = Counter()
    for i, t in corpus():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cut = len(ids) % 2048 or 2048 if len(ids) > 2048 else len(ids)
        for j, s in enumerate([0, *range(cut, len(ids), 2048)]):
            piece = ids[s:cut if not j else s + 2048]
            want[(i, j, s, len(piece), zlib.crc32(piece.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) <= sum(r.length for r in got) // 2048 + 2
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_holds_every_capacity(rule):
    lengths = np.random.default_rng(4).integers(1, 400, 500)
    bins, offsets = packing.best_fit(lengths, (1000, 5, 200_000.0), rule)
    for b in range(bins.max() + 1):
        n = lengths[bins == b]
        assert 0 < n.sum() <= 1000 and len(n) <= 5 and (n.astype(float) ** 2).sum() <= 200_000 * (1 + 1e-9)
        o = np.argsort(offsets[bins == b])
        assert offsets[bins == b][o].tolist() == [0, *np.cumsum(n[o])[:-1]]
    assert bins.max() + 1 <= 1.15 * max(lengths.sum() / 1000, (lengths.astype(float) ** 2).sum() / 200_000, len(lengths) / 5) + 1


# ---- licences

def test_licences(spark):
    mit = "Released under the MIT License."
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may\nnot use this file except in compliance with the License.'
    data = [(1, "a/LICENSE", mit), (2, "a/b/c/x.py", prose(30, 1)), (3, "a/b/COPYING.txt", apache), (4, "a/y.py", apache + "\n\n" + prose(50, 2)), (5, "z/q.py", prose(20, 3)),
            (6, "a/n", None), (7, None, prose(5, 4)), (8, "top.py", "x = 1"), (9, "a/b/c/long.txt", prose(5000, 5) + "\nThis work is licensed under the GNU General Public License, version 3.\n"),
            (2, "a/b/c/x.py", prose(30, 1)), (10, "ab/c", "y")]
    df = spark.createDataFrame([(*r, "f") for r in data], "doc_id long, path string, text string, folder string")
    got = {r.doc_id: (r.license, r.origin, r.inherited_from) for r in licenses.scan(df).collect()}
    assert got == {1: ("MIT", "file", None), 2: ("Apache-2.0", "inherited", "a/b"), 3: ("Apache-2.0", "file", None), 4: ("Apache-2.0", "header", None), 5: (None, "none", None),
                   6: ("MIT", "inherited", "a"), 7: (None, "none", None), 8: (None, "none", None), 9: ("GPL-3.0", "header", None), 10: (None, "none", None)}
    assert licenses.scan(df).count() == len(data) and licenses.scan(df.limit(0)).count() == 0


# ---- language model scores

def test_scores(docs, empty):
    got = lm_score.score_texts(docs, chunk_bytes=3000, mixer_words=50).collect()
    train = [(i, t) for i, t in corpus() if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    c = Counter(w for _, t in train for w in (t or "").encode().lower().split())
    total, kinds = sum(c.values()) + len(train), len(c) + 1
    want = []
    for i, t in corpus():
        w = [c[x] for x in (t or "").encode().lower().split()] + [len(train)]
        base = sum(np.log10((k + 0.1) / (total + 0.1 * (kinds + 1))) for k in w)
        want.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, len(w), sum(k > 0 for k in w), total, round(float(base), 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert {r.doc_id: r.score for r in got}[50] > {r.doc_id: r.base_score for r in got}[50]
    assert lm_score.score_texts(empty).count() == 0


def test_word_model_is_a_distribution():
    from loadloom.llm.context_mixing import OFFSETS, Mixer, count_bits

    train = [w.encode() for w in VOCAB]
    slot, n0, n1 = count_bits(train)
    z, o = np.zeros(OFFSETS[-1], np.float32), np.zeros(OFFSETS[-1], np.float32)
    z[slot], o[slot] = n0, n1
    m = Mixer.fit(z, o, train)
    # all one-byte words and the blank that would end an empty one: their first bytes cover every case
    first = m.log2_words([bytes([b]) for b in range(256) if b != 0x20])
    assert 0 < np.exp2(first).sum() <= 1.001
    assert m.log2_words([b"abc"])[0] > m.log2_words([b"\xf0\x01\x02"])[0]


def test_probabilities_of_all_texts_sum_to_one():
    """The history's share is taken from the end of the text as well as from its words."""
    from itertools import product

    log2 = np.log2(np.array([0.06, 0.04]))
    total = 0.0
    for n in range(13):
        for text in product((0, 1), repeat=n):
            ids = np.array(text, np.int64)
            total += 2.0 ** lm_score.with_history(ids, log2[ids], np.log2(0.9))
    assert 0.998 < total <= 1 + 1e-9
    assert lm_score.with_history(np.zeros(0, np.int64), np.zeros(0), -1.5) == -1.5


def test_text_parts_and_batch_bound(spark):
    from loadloom.llm import common

    texts = ["a" * 10, "", "b" * 500, "c", "d" * 95, "e" * 4]
    got = list(common.text_parts(pa.array(texts), 100))
    assert [t.decode() for _, part in got for t in part] == texts
    assert [at for at, _ in got] == [0, 2, 3] and all(sum(map(len, p)) <= 100 or len(p) == 1 for _, p in got)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "3m")
        common.in_small_batches(spark.range(1))
        assert spark.conf.get(name) == "3m"
        spark.conf.unset(name)
        common.in_small_batches(spark.range(1))
        assert spark.conf.get(name) == "8m"
    finally:
        spark.conf.set(name, before)
