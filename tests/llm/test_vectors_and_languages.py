"""Vector codes, hard negatives and languages against brute force, with the odd rows each must survive."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadloom.llm import hard_negatives, language_id, vector_codes
from loadloom.llm.common import chosen_ids
from loadloom.llm.hard_negatives import Best, Block
from loadloom.llm.vector_codes import Tree

SHAPE = "vec_id long, embedding array<double>, label int, block string, id string, vector int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, y, "x", "clash", 7) for i, v, y in rows], SHAPE).repartition(parts)


def odd_rows(n=260, dim=8, seed=3):
    """(id, vector, label) with clusters, a hot vector, ties, repeated rows, nulls, non-finite, short and huge ones."""
    r = np.random.default_rng(seed)
    heart = r.normal(0, 1, (6, dim))
    out = [(i, (heart[i % 6] + r.normal(0, 0.2, dim)).tolist(), int(i % 6)) for i in range(n)]
    out += [(n + i, out[5][1], 5) for i in range(n // 3)]
    out += [(900, None, 1), (901, [None] + [0.0] * (dim - 1), 1), (902, [float("nan")] * dim, 1), (903, [float("inf")] * dim, 1), (904, [0.0] * dim, None),
            (905, [1.0, 2.0], 2), (906, [], 2), (None, [0.5] * dim, 3), (50, [0.1] * dim, 2), (7, out[7][1], 1), (907, [0.0] * dim, 4)]
    return out


def usable(rows):
    return [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]


def padded(v, scale, length):
    return [int(np.floor(scale * x)) for x in v] + [0] * (length - len(v))


# ---- vector codes

def brute_codes(rows, parts, entries, rounds, scale=1024):
    rows = usable(rows)
    width = -(-max(len(v) for _, v, _ in rows) // parts)
    x = [padded(v, scale, parts * width) for _, v, _ in rows]
    pieces = [[tuple(v[p * width:(p + 1) * width]) for v in x] for p in range(parts)]
    ids = sorted({i for i, _, _ in rows if i is not None})[:entries]
    first = [min(v for i, v, _ in rows if i == j) for j in ids]
    books = [[tuple(padded(v, scale, parts * width)[p * width:(p + 1) * width]) for v in first] for p in range(parts)]

    def nearest(q, book):
        return min((sum((a - b) ** 2 for a, b in zip(q, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = [[] for _ in books[p]]
            for q in pieces[p]:
                got[nearest(q, books[p])[1]].append(q)
            books[p] = [tuple(sum(c) // len(g) for c in zip(*g)) if g else e for g, e in zip(got, books[p])]
    best = [[nearest(pieces[p][n], books[p]) for p in range(parts)] for n in range(len(rows))]
    errors = [sum(d for d, _ in b) for b in best]
    label = Counter()
    for (_, _, y), e in zip(rows, errors):
        label[y] += e
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in b), e, label[y], digest) for (i, _, y), b, e in zip(rows, best, errors)), key=repr)


@pytest.mark.parametrize("entries,block", [(256, 2048), (16, 50)])
def test_codes_equal_brute_force(spark, entries, block):
    rows = odd_rows()
    got = vector_codes.encode(table(spark, rows), entries=entries, block_rows=block)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_codes(rows, 4, entries, 4)


def test_codes_of_lengths_that_parts_do_not_divide(spark):
    rows = odd_rows(40, 6)
    got = vector_codes.encode(table(spark, rows), entries=8, rounds=2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_codes(rows, 4, 8, 2)


def test_codes_of_nothing_and_of_huge_components(spark):
    assert vector_codes.encode(table(spark, [(1, None, 1)], 1)).count() == 0
    assert vector_codes.encode(table(spark, odd_rows()).limit(0)).count() == 0
    only = vector_codes.encode(table(spark, [(None, [1.0] * 4, None)], 1)).collect()
    assert [(r.vec_id, r.code, r.error) for r in only] == [(None, "00000000", 0)]
    far = vector_codes.encode(table(spark, [(1, [1e300, 0.0, 0.0, 0.0], 1), (2, [-1e300, 5e8, 0.0, 0.0], 1), (3, [1.0] * 4, 1)], 1)).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in far) == [(1, "00000000", 0), (2, "01010000", 0), (3, "02020202", 0)]


def test_tree_parts_its_points_and_owns_balls():
    r = np.random.default_rng(1)
    rows = np.round(np.concatenate([r.normal(c, 3, (150, 5)) for c in (0, 400, 900)])).astype(np.int64)
    tree = Tree.build(np.concatenate([rows, rows[:40]]))
    assert tree.counts[0] == 490 and (tree.sums[0] == rows.sum(0) + rows[:40].sum(0)).all()
    book = np.array([[0] * 5, [400] * 5, [900] * 5, [900] * 5])
    settled = list(tree.settle(book))
    spans = sorted((tree.lo[n], tree.hi[n]) for n, _ in settled)
    assert spans[0][0] == 0 and spans[-1][1] == len(tree.points) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    owned = [n for n, among in settled if len(among) == 1]
    assert len(settled) < 60 and sum(tree.counts[n] for n in owned) >= 300
    own, error = tree.assign(book)
    d = ((np.concatenate([rows, rows[:40]])[:, None] - book) ** 2).sum(2)
    assert (own == d.argmin(1)).all() and (error == d.min(1)).all()
    same = Tree.build(np.zeros((70, 3), np.int64))
    assert len(same.points) == 1 and same.counts[0] == 70 and (same.assign(book[:, :3])[0] == 0).all()


# ---- hard negatives

def brute_negatives(rows, every=10, scale=256):
    rows = [(i, v, y) for i, v, y in usable(rows) if i is not None and y is not None]
    one = {}
    for i, v, y in rows:
        one[i] = min(one.get(i, (y, v)), (y, v))
    length = max([len(v) for _, v in one.values()], default=0)
    x = {i: (y, padded(v, scale, length)) for i, (y, v) in one.items()}
    out = []
    for a in x:
        if a % every:
            continue
        score = {b: sum(p * q for p, q in zip(x[a][1], x[b][1])) for b in x if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if x[b][0] == x[a][0]][:5]:
            fit = [b for b in order if x[b][0] != x[a][0] and 80 * score[p] <= 100 * score[b] <= 100 * score[p]][:5]
            out += [(a, p, k + 1, b, score[p], score[b]) for k, b in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block,tile", [(4096, 4096), (16, 7)])
def test_negatives_equal_brute_force(spark, block, tile):
    rows = odd_rows()
    mixed = [(i, v, None if y is None else (y if (i or 0) % 3 else (y + 1) % 6)) for i, v, y in rows]
    got = hard_negatives.mine(table(spark, mixed), F.col("id") % 10 == 0, block_rows=block, tile_rows=tile)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(mixed)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_negatives_of_nothing(spark):
    df = table(spark, odd_rows(30))
    assert hard_negatives.mine(df.limit(0), F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.mine(df, F.col("id") < 0).count() == 0
    assert hard_negatives.mine(table(spark, [(10, None, 1), (20, [], 1), (30, [], 2), (40, [], 1)], 1), F.col("id") % 10 == 0).count() == 2


def test_search_stops_before_all_rows_are_scored():
    r = np.random.default_rng(0)
    values = r.integers(-50, 50, (4000, 3)).astype(float)
    values[:20] += 400
    block = Block(np.arange(4000), values, np.argsort(values, 0).T.astype(np.int32))
    best = Best(5)
    scored = block.search(np.array([1.0, 2.0, 1.0]), -1, [best])
    score = values @ [1, 2, 1]
    assert scored < 400 and list(best.ids) == sorted(range(4000), key=lambda i: (-score[i], i))[:5]
    narrow = Best(5, 100, 120)
    block.search(np.array([1.0, 2.0, 1.0]), -1, [narrow])
    assert list(narrow.ids) == sorted((i for i in range(4000) if 100 <= score[i] <= 120), key=lambda i: (-score[i], i))[:5]


# ---- languages

LANGS = {"en": "the of and house water green mother letter", "de": "der und haus wasser grün mutter brief straße", "fr": "le et maison eau verte mère lettre était"}


def speech(lang, n, seed):
    return " ".join(np.random.default_rng(seed).choice(LANGS[lang].split(), n))


def brute_judged(docs, text):
    """Scores straight from the definition: word frequencies, else mean of the longest known n-grams."""
    langs = sorted({lang for _, lang in docs})
    words = {lang: Counter(w for t, lg in docs if lg == lang for w in language_id.words_of(t)) for lang in langs}
    grams = {n: {lang: Counter() for lang in langs} for n in range(1, 6)}
    for lang in langs:
        for w, c in words[lang].items():
            for n in grams:
                for g in language_id.ngrams(w, n):
                    grams[n][lang][g] += c

    def logs(counts):
        known = {s for lang in langs for s in counts[lang] if sum(counts[x][s] for x in langs) >= 2}
        total = {lang: sum(counts[lang][s] for s in known) for lang in langs}
        return {s: [np.log((counts[lang][s] + 0.5) / (total[lang] + 0.5 * len(known))) for lang in langs] for s in known}

    by_word, by_gram = logs(words), {n: logs(grams[n]) for n in grams}
    z, m = np.zeros(len(langs)), 0
    for w in language_id.words_of(text):
        m += 1
        if w in by_word:
            z += by_word[w]
            continue
        for n in range(5, 0, -1):
            rows = [by_gram[n][g] for g in language_id.ngrams(w, n) if g in by_gram[n]]
            if rows:
                z += np.mean(rows, 0)
                break
    z = z / np.sqrt(m) + np.log([sum(lg == lang for _, lg in docs) / len(docs) + 1e-9 for lang in langs])
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return langs[int(p.argmax())], float(p.max())


def test_languages_equal_brute_force(spark):
    train = [(f"{speech(lang, 12, 7 * k + len(lang))}", lang) for k, lang in enumerate(["en", "de", "fr"] * 8)]
    asked = ["the waters", "wasserhaus", "maisonnette xyz", "qqq", "THE  Mother!", "straße-ß", "der der der the", "été"]
    rows = [(i, t, lang, "k") for i, (t, lang) in enumerate(train)] + [(1000 + i, t, None, "k") for i, t in enumerate(asked)]
    rows += [(2000, None, "en", "k"), (2001, "", "fr", "k"), (2002, "12 ½ ² ... _", None, "k"), (None, "the house", "en", "k"), (1000, asked[0], None, "k"), (2003, "house " * 30_000, None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, cls string").repartition(3)
    model = language_id.fit(df, F.coalesce(F.col("doc_id") < 1000, F.lit(False)))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df, model).collect()}
    assert language_id.identify(df, model).count() == len(rows)
    want = {1000 + i: brute_judged(train, t) for i, t in enumerate(asked)}
    want[2003] = brute_judged(train, "house " * 30_000)
    for i, (lang, score) in want.items():
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=2e-3), asked[i - 1000] if i < 2000 else i
    assert [got[i] for i in (2000, 2001, 2002)] == [("und", 0.0)] * 3
    assert got[None][0] == "en"
    assert language_id.identify(df.limit(0), model).count() == 0
    nothing = language_id.fit(df, F.lit(False))
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}


def test_languages_of_held_out_documents(spark):
    from loadloom.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    right, n = QUERIES["op12_language_id"](spark, sf).where("held_out").join(docs, "doc_id").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("lang")).first()
    assert n > 200 and right / n >= 0.97


def test_chosen_ids_are_the_first_hashes(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 7 == 0).cast("int").alias("cls"))
    got = chosen_ids(rows.union(rows), {0: 500, 1: 40}).collect()
    h = {r.id: (r.h, r.cls) for r in rows.withColumn("h", F.xxhash64("id")).collect()}
    for cls, n in ((0, 500), (1, 40)):
        assert {r.id for r in got if r.cls == cls} == set(sorted((i for i in h if h[i][1] == cls), key=lambda i: h[i])[:n])
    assert chosen_ids(rows, {5: 3}).count() == 0
