"""op10 mixes contexts over the running text of the whole corpus: counts against plain Python, distributions, twins."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest


def held_out(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def texts_of(rng, n, kinds=30):
    words = [f"w{k}" for k in range(kinds)]
    return [" ".join(rng.choice(words, int(k))) for k in rng.integers(0, 60, n)]


def test_sequences_are_counted_over_all_training_texts():
    """The counts that come back to a chunk are those of the whole corpus, whatever the chunks and ranges."""
    from loadloom.llm import lm_score as m

    rng = np.random.default_rng(1)
    texts = [*texts_of(rng, 40), "", "a a a a a", "\tOne  one\n"]
    held = [i % 5 == 0 for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array(held)], ["doc_id", "text", "held_out"])
    tokens = [[b"<s>", b"<s>", *t.encode().lower().split(), b"</s>"] for t in texts]
    want = [Counter(tuple(d[i - k:i + 1]) for d, h in zip(tokens, held) if not h for i in range(2, len(d))) for k in (1, 2)]
    for size, ranges in ((200, 5), (1 << 20, 1)):
        bits = 40
        chunks = [r for b in m._whole_chunks(size, pa.int64())(iter([batch])) for r in b.to_pylist()]
        dealt = pa.Table.from_batches([b for r in chunks for b in m._deal(ranges, bits)(iter([pa.RecordBatch.from_pylist([r])]))])
        met = [m._meet(ranges, bits)(dealt.filter(pa.compute.equal(dealt["range"], r))).to_pylist()[0] for r in range(ranges)]
        words = Counter({w: int(c) for row in met for w, c in zip(m._split(row["words"]), m._unpack(row["c"]))})
        assert +words == +Counter(w for d, h in zip(tokens, held) if not h for w in d[2:-1])
        for r in chunks:
            vocab = m._split(r["words"])
            token, doc, place = m._stream(m._unpack(r["ids"], np.int32), m._unpack(r["sizes"], np.int64), len(vocab))
            for k, name in ((1, "c2"), (2, "c3")):
                counts = np.concatenate([m._unpack(row[name][row["chunks"].index(r["chunk"])], np.int64) for row in met])
                got, used = np.empty(len(token), int), 0
                for _, pos, new in m._by_key(m._sequences(token, place, m._hashes(vocab), bits, k), bits):
                    got[pos] = counts[used:][np.cumsum(new) - 1]
                    used += new.sum()
                mine = [tokens[i] for i in r["doc_id"]]
                assert got.tolist() == [want[k - 1][tuple(d[i - k:i + 1])] for d in mine for i in range(2, len(d))]


def test_a_token_with_contexts_is_a_distribution():
    from loadloom.llm import lm_score as m

    base = np.log2([0.5, 0.3, 0.15, 0.05])
    for trust in m.TRUST:
        for c2, c3 in (([0, 0, 0, 0], [0, 0, 0, 0]), ([3, 1, 0, 0], [0, 0, 0, 0]), ([3, 1, 0, 2], [1, 0, 0, 2])):
            c2, c3 = np.array(c2, float), np.array(c3, float)
            p = np.exp2(m._token_log2(base, c2, np.full(4, c2.sum()), c3, np.full(4, c3.sum()), trust))
            assert p.sum() == pytest.approx(1, abs=1e-12)
    assert m._token_log2(np.array([-5000.0]), np.zeros(1), np.ones(1), np.zeros(1), np.ones(1), (1.0, 1.0))[0] == pytest.approx(-5002)


def test_weights_move_to_the_better_expert():
    """The text's probability is the chain of its parts', each under weights that the parts before it left."""
    from loadloom.llm import lm_score as m

    rng = np.random.default_rng(2)
    sizes = np.array([70, 0, 33])
    token, doc, place = m._stream(rng.integers(0, 9, 103).astype(np.int32), sizes, 9)
    before, own = m._history(token, doc, 9)
    log2 = [-9 * rng.random(len(token)) for _ in range(2)]
    got = m._mixed(log2, before, place, doc, 3, 32)
    for i in range(3):
        mine = np.flatnonzero(doc == i)
        weight, total = np.full(8, 1 / 8), 0.0
        seen = Counter()
        parts = [np.zeros(8) for _ in range(-(-len(mine) // 32))]
        for j, at in enumerate(mine):
            assert before[at] == seen[token[at]] and own[at] == (token[mine] == token[at]).sum()
            for e, (one, share) in enumerate((x, s) for x in log2 for s in m.HISTORY):
                parts[j // 32][e] += math.log2((1 - share if j else 1) * 2 ** one[at] + (share * seen[token[at]] / j if j else 0))
            seen[token[at]] += 1
        for p in parts:
            whole = (weight * 2.0 ** p).sum()
            total += math.log2(whole)
            weight = (1 - m.SWITCH) * weight * 2.0 ** p / whole + m.SWITCH / 8
        assert got[i] == pytest.approx(total, rel=1e-10)


def test_a_text_that_others_repeat_is_likelier(spark):
    """Word order counts: a text that another training text repeats stands apart from its shuffled words, and its own copy alone does not help it."""
    from loadloom.llm import lm_score

    rng = np.random.default_rng(7)
    train, held = [i for i in range(400) if not held_out(i)], [i for i in range(400) if held_out(i)]
    filler = dict(zip(train[10:], texts_of(rng, len(train) - 10, 400)))
    once = " ".join(rng.choice([f"w{k}" for k in range(400)], 120))
    mixed = " ".join(rng.permutation(once.split()))
    rows = {**filler, train[0]: once, train[1]: once, train[2]: mixed, held[0]: once, held[1]: mixed, held[2]: " ".join(rng.permutation(once.split()))}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = [{r.doc_id: r for r in lm_score.score_texts(df, chunk_bytes=size, mixer_words=50).collect()} for size in (3_000, 1 << 20)]
    score = {i: r.score for i, r in got[0].items()}
    assert score[train[0]] == pytest.approx(score[train[1]]) and score[train[0]] > 0.6 * score[held[2]] > score[held[2]]
    assert score[held[0]] > 0.6 * score[held[2]] and score[held[1]] > 0.6 * score[held[2]]  # learned from the other texts
    assert score[train[2]] < 0.8 * score[held[2]]  # only held-out texts repeat it
    assert all(got[1][i].score == pytest.approx(s, rel=1e-6) for i, s in score.items())
