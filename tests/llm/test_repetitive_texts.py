"""Decontamination of repetitive texts: exact, and linear in both texts."""

import random
import time

from loadloom.llm import decontaminate
from test_corpus_operators import brute_contamination


def contaminated(spark, texts, bench):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(bench, "item_id string, text string")
    return decontaminate.contaminated_words(docs, table).orderBy("doc_id").collect()


def test_small_alphabets_equal_brute_force(spark):
    g = random.Random(4)
    texts = [" ".join(g.choice("aab") for _ in range(g.randint(0, 60))) for _ in range(60)]
    texts += [" ".join(["a"] * n) for n in (12, 13, 14, 40)] + [" ".join(["a", "b"] * 20), " ".join(["x", *["a"] * 15, "y"])]
    bench = [(f"i{k}", " ".join(g.choice("aab") for _ in range(g.randint(1, 30)))) for k in range(12)]
    bench += [("eq", " ".join(["a"] * 20)), ("edge", " ".join(["x", *["a"] * 13])), ("none", "...")]
    got = contaminated(spark, texts, bench)
    for row, want in zip(got, brute_contamination(texts, bench)):
        assert tuple(row)[1:1 + len(want)] == tuple(want)


def test_long_repetitions_take_linear_time(spark):
    texts = [" ".join(["spam"] * 60_000), " ".join(["buy", "now"] * 30_000), "clean words only here"]
    bench = [("one", " ".join(["spam"] * 20_000)), ("two", " ".join(["buy", "now"] * 10_000))]
    at = time.time()
    got = contaminated(spark, texts, bench)
    assert time.time() - at < 60
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got] == [(60_000, 60_000, 1, True), (60_000, 60_000, 1, True), (4, 0, 0, False)]
