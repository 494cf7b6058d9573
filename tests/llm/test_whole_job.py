"""Cases that a narrower version of an operator would miss."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loadloom.llm import decontaminate, licenses, near_copies, packing, substring, tokens

SF = "/root/testdata/sf0.01"


def grams(t, k=5):
    w = (t or "").encode().lower().split()
    k = min(k, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(n, seed):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n)]


# ---- near copies of the pipeline

@pytest.mark.parametrize("group", [1000, 7])
def test_near_copies_equal_brute_force(spark, group):
    data = []
    for s in range(6):
        base = prose(200 + 40 * s, s)
        for k in range(6):  # k edited words, up to 5k of the shingles differ
            w = list(base)
            for i in range(k):
                w[20 + 30 * i] = f"edit{k}"
            data.append((10 * s + k, " ".join(w)))
    data += [(100, "a b"), (101, "A  B"), (102, "a c"), (103, ""), (104, None), (105, " ".join(prose(200, 0)).upper())]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    sets = {i: grams(t) for i, t in data}
    label = {i: i for i in sets}
    while True:
        new = {i: min(label[j] for j in sets if jaccard(sets[i], sets[j]) >= 0.8) for i in sets}
        if new == label:
            break
        label = new
    got = near_copies.labelled(df, group=group).collect()
    least = {}
    for r in got:
        least[r.component] = min(least.get(r.component, r.doc_id), r.doc_id)
    assert {r.doc_id: least[r.component] for r in got} == label
    assert len(set(label.values())) < len(data) - 20
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, df, "").collect()}
    assert kept == set(label.values())


def test_planted_near_copies_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: grams(r.text) for r in docs.collect()}
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).select("doc_id").collect()}
    ids, seen = sorted(kept), {}
    for i in ids:
        for g in sets[i]:
            for j in seen.get(g, ()):
                assert jaccard(sets[i], sets[j]) < 0.8
            seen.setdefault(g, []).append(i)


def test_winners_are_rows(spark):
    a, b = " ".join(prose(80, 1)), " ".join(prose(80, 2))
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (None, b), (None, "x y z"), (None, "x y z"), (3, a), (1, b)], "doc_id long, text string")
    got = sorted(near_copies.keep_one(df).collect(), key=repr)
    assert got == sorted([(1, a), (1, b), (None, "x y z")], key=repr)
    assert near_copies.keep_one(df.limit(0)).count() == 0


CLASHING = ["_key", "_kept", "_text_key", "__key", "_KEPT2", "_id", "_n", "node", "n_words", "held_out"]


def test_stages_keep_columns_with_their_own_names(spark):
    """Columns named like the operators' own keep their values through every filtering stage."""
    passage = " ".join(prose(60, 77))
    texts = [" ".join(prose(90, i)) for i in range(12)] + [" ".join(prose(20, 40 + i)) + " " + passage for i in range(3)] + [" ".join(prose(90, 0)), None, ""]
    df = spark.createDataFrame([(i, t, *[f"{c}-{i}" for c in CLASHING]) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING))
    bench = spark.createDataFrame([("q1", " ".join(prose(90, 3)[:40]))], "item_id string, text string")
    kept = near_copies.keep_one(df)
    cut = substring.without_repeats(df)
    clean = decontaminate.clean_documents(df, bench)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {15, 17}
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {3}
    shorter = {r.doc_id for r in cut.collect() if len(r.text or "") < len(texts[r.doc_id] or "")}
    assert cut.count() == len(texts) and shorter == {0, 12, 13, 14, 15}
    for out in (kept, cut, clean):
        assert out.columns == df.columns
        assert all(r[c] == f"{c}-{r.doc_id}" for r in out.collect() for c in CLASHING)


# ---- tokens

def test_long_white_space_runs_are_encoded(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    texts = ["a b" + gap * 1_100_000 + "c <|endoftext|> d" for gap in (" ", "\n", "\t")] + ["plain words"]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [tokens.encoder()(t) for t in texts] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()} == {i: len(w) for i, w in enumerate(want)}
    assert packing.pack(df).agg(F.sum("length")).first()[0] >= sum(map(len, want))


# ---- licences

def brute_cosine(m, text):
    lines = [w for x in text.lower().split("\n") if (w := licenses._TERM.findall(x))]
    out = 0.0
    for a in range(len(lines)):
        for b in range(a + 1, len(lines) + 1):
            part = sum(lines[a:b], [])
            if b > a + 1 and len(part) > m.longest:
                break
            x = {t: n * m.idf.get(t, m.top) for t, n in licenses.terms(" ".join(part)).items()}
            norm = sum(v * v for v in x.values()) ** 0.5
            out = max([out] + [sum(v * row.get(t, 0.0) for t, v in x.items()) / norm for _, row in m.rows])
    return out


def test_notices_wrapped_in_long_blocks_are_found(spark):
    mit = licenses.TEMPLATES["MIT"][0].split()
    wrapped = [" ".join(mit[i:i + 6]) for i in range(0, len(mit), 6)]
    code = [f"value_{i} = call_{i}(argument_{i})" for i in range(20)]
    data = [(1, "a/x.py", "\n".join(["# " + x for x in wrapped] + code)), (2, "b/x.c", "\n".join(code[:8] + [" * " + x for x in wrapped] + code[8:])),
            (3, "c/LICENSE", "\n".join([*code[:5], *wrapped, *code])), (4, "c/d/y", "x = 1"), (5, "e/y", "\n".join(code))]
    df = spark.createDataFrame(data, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(df).collect()}
    assert got == {1: ("MIT", "header"), 2: ("MIT", "header"), 3: ("MIT", "file"), 4: ("MIT", "inherited"), 5: (None, "none")}
    m = licenses.Matcher({"the": 40, "license": 5, "of": 30}, 50)
    for _, _, text in data[:3]:
        assert m.best(text)[0] == pytest.approx(brute_cosine(m, text), abs=1e-9)


def test_notices_that_only_name_the_licence_are_found(spark):
    data = [(1, "a.txt", "some words\nText under CC BY 4.0\nmore words"), (2, "b.txt", "Shared under CC BY-SA 4.0."), (3, "c.txt", "plain prose about nothing")] + [(k, "d.txt", "x y") for k in range(4, 24)]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(data, "doc_id long, path string, text string")).collect()}
    assert {i: x for i, x in got.items() if x} == {1: "CC-BY-4.0", 2: "CC-BY-SA-4.0"}
    m = licenses.Matcher({"the": 40, "of": 30}, 50)
    for _, _, text in data[:4]:
        assert m.best(text)[0] == pytest.approx(brute_cosine(m, text), abs=1e-9)


def test_mixer_learns_from_every_training_word(spark):
    from loadloom.llm import lm_score
    df = spark.createDataFrame([(f"w{i:05d}".encode(),) for i in range(700)], "word binary").repartition(3)
    words = [bytes(r.word) for r in df.orderBy(F.xxhash64("word", F.lit(1)), "word").collect()]
    one = lm_score.Mixer.start(*lm_score._tables(df, 700))
    gates, cells = one.learn(words)
    bits = 8 * sum(len(w) + 1 for w in words)
    assert gates.sum() == bits and cells.sum() == pytest.approx(bits)
    learned = lm_score._mixer(df, 700, 200)  # 200 words at a time, all of them
    assert np.allclose(learned.weights, one.weights) and np.allclose(learned.refine, one.refine)
    several = lm_score._mixer(df, 700, 200, 250)  # averaged over three tasks
    assert np.isfinite(several.weights).all() and not np.allclose(several.weights, 0.3)
