"""The word model of op10 against plain Python: shared prefixes, large counts, chunks and a text's history."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest


def test_word_model_hashes_shared_prefixes_once(monkeypatch):
    """op10: counting and pricing cost as much as the words' distinct prefixes, and give what a plain count gives."""
    from loadloom.llm import context_mixing as cm

    words = [b"unquestionabl" + bytes([97 + i, 97 + j]) for i in range(20) for j in range(20)]
    done, slots = [], cm.slots
    monkeypatch.setattr(cm, "slots", lambda h, node: done.append(h.shape[1]) or slots(h, node))
    slot, n0, n1 = cm.count_bits(words)
    prefixes = {w[:k] for w in (x + b" " for x in words) for k in range(1, len(w) + 1)}
    assert sum(done) == 8 * len(prefixes) < 8 * sum(len(w) + 1 for w in words) / 7
    want = Counter()
    buf, _, h = cm.contexts(words)
    for j in range(7, -1, -1):
        bit = (buf >> np.uint64(j) & np.uint64(1)).astype(int)
        for row in slots(h, (buf | np.uint64(256)) >> np.uint64(j + 1)):
            want.update(zip(row.tolist(), bit.tolist()))
    got = {(s, b): k for s, z, o in zip(slot.tolist(), n0.tolist(), n1.tolist()) for b, k in ((0, z), (1, o)) if k}
    assert got == dict(want)
    zeros, ones = np.zeros(cm.OFFSETS[-1], np.float32), np.zeros(cm.OFFSETS[-1], np.float32)
    zeros[slot], ones[slot] = n0, n1
    m = cm.Mixer.fit(zeros, ones, words)
    done.clear()
    together = m.log2_words(words[::-1])[::-1]
    assert sum(done) == 8 * len(prefixes)
    assert np.allclose(together, [m.log2_words([w])[0] for w in words], rtol=1e-12)


def test_word_model_stands_one_sided_counts_of_large_corpora():
    """op10: a slot that met a hundred million ones and no zero has a finite prediction."""
    from loadloom.llm import context_mixing as cm

    m = cm.Mixer.fit(np.zeros(cm.OFFSETS[-1], np.float32), np.full(cm.OFFSETS[-1], 1e8, np.float32), [b"ab", b"cd"])
    assert np.isfinite(m.weights).all() and np.isfinite(m.log2_words([b"ab", b"\x01"])).all()


def test_chunks_number_words_as_python_cuts_them():
    """op10: Arrow cuts and numbers words like ``bytes.lower().split()``, whatever the white space, batches and chunks."""
    from loadloom.llm import lm_score

    texts = ["", " \t\n\x0b\x0c\r ", "Ab\x1cc\x85D e F\x00 \x1f İ Ä", " one  ONE\ttwo\r\n", "x" * 400, "", "two one three " * 30, "\n"]
    ids, held = [*range(7), None], [False, True] * 4
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(texts[a:b], pa.string()), pa.array(held[a:b])], ["doc_id", "text", "held_out"])
               for a, b in ((0, 3), (3, 3), (3, 8))]
    for size in (1, 300, 1 << 20):
        out = [r for b in lm_score._chunks(size, pa.int64())(iter(batches)) for r in b.to_pylist()]
        got, at, chunk = [], 0, 0
        while at < len(texts):
            vocab, train, rows, n = {}, Counter(), [], 0
            while at < len(texts) and n < size:
                raw = texts[at].encode()
                nums = [vocab.setdefault(w, len(vocab)) for w in raw.lower().split()]
                train.update([] if held[at] else nums)
                rows.append((True, chunk, ids[at], held[at], len(nums) + 1, len(raw), np.array(nums, "<u4").tobytes(), None, None, None))
                n += len(raw) + 64
                at += 1
            got += rows + [(False, chunk, None, None, None, None, None, w, k, train[k]) for w, k in vocab.items()]
            chunk += 1
        assert [tuple(r.values()) for r in out] == got


def test_history_of_a_text_equals_the_plain_sum():
    from math import log2 as lg

    from loadloom.llm import lm_score

    rng = np.random.default_rng(8)
    for n in (1, 2, 300):
        ids, log2 = rng.integers(0, 40, n).astype("<u4"), -20 * rng.random(n)
        log2 = log2[ids % n]
        totals = []
        for share in lm_score.HISTORY:
            seen, total = Counter(), -3.0 + lg(1 - share)
            for i, (w, v) in enumerate(zip(ids.tolist(), log2)):
                total += lg((1 - share if i else 1) * 2.0 ** v + (share * seen[w] / i if i else 0))
                seen[w] += 1
            totals.append(total)
        want = max(totals) + lg(sum(2.0 ** (t - max(totals)) for t in totals) / len(totals))
        assert lm_score.with_history(ids, log2, -3.0) == pytest.approx(want, rel=1e-12)


def test_learning_steps_do_not_depend_on_the_parts(monkeypatch):
    """op10: 200 words are learned from together, however many bytes are prepared at once and however long the words are."""
    from loadloom.llm import context_mixing as cm

    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, k).astype(np.uint8)) for k in [*rng.integers(0, 30, 900), 5000, *rng.integers(0, 9, 150)]]
    slot, n0, n1 = cm.count_bits(words, 1000)
    assert all(np.array_equal(x, y) for x, y in zip((slot, n0, n1), cm.count_bits(words)))
    zeros, ones = np.zeros(cm.OFFSETS[-1], np.float32), np.zeros(cm.OFFSETS[-1], np.float32)
    zeros[slot], ones[slot] = n0, n1
    parts, fits = cm._parts, []
    for size in (1, 1 << 14, 1 << 20):
        monkeypatch.setattr(cm, "_parts", lambda w, n, together=1, size=size: parts(w, size if together > 1 else n, together))
        fits.append(cm.Mixer.fit(zeros, ones, words))
    for m in fits[1:]:
        assert np.allclose(m.weights, fits[0].weights, rtol=1e-12) and np.allclose(m.refine, fits[0].refine, rtol=1e-12)
    assert np.allclose(fits[0].log2_words(words, 500), fits[0].log2_words(words), rtol=1e-12)
    assert list(parts([], 5)) == [] and list(parts([b"abc"] * 5, 8, 2)) == [(0, 2), (2, 4), (4, 5)]
