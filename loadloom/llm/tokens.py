"""Token counts and token ids of whole texts under a byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom.llm.common import text_of

# A blank between two letters always starts a new pre-token of the vocabulary's pattern.
_SAFE = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")
_ENCODERS: dict[str, Callable[[str], list[int]]] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _json_encoder(name: str) -> Callable[[str], list[int]]:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path(name))
    return lambda text: tok.encode(text, add_special_tokens=False).ids


def encoder(name: str = "byte_bpe_50k.json") -> Callable[[str], list[int]]:
    """Text to ids, once per Python worker.

    A ``.json`` vocabulary that has a rank file beside it (same ids, same special
    strings) is run by the rank-file library, which gives the same ids about five times
    faster; the tests compare both on whole tables. It refuses runs of more than a million
    white-space characters; the ``.json`` library encodes what it refuses. Special strings inside a
    text become their own ids, as the ``.json`` library does by default.
    """
    if name not in _ENCODERS:
        if name == "byte_bpe_50k.json":
            import public_tokenizers
            import tiktoken

            with open(vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            enc = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                    special_tokens={"<|endoftext|>": 50256})

            def fast(text: str) -> list[int]:
                try:
                    return enc.encode(text, allowed_special="all")
                except ValueError:
                    if "whole" not in _ENCODERS:
                        _ENCODERS["whole"] = _json_encoder(name)
                    return _ENCODERS["whole"](text)

            _ENCODERS[name] = fast
        elif name.endswith(".json"):
            _ENCODERS[name] = _json_encoder(name)
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))
            _ENCODERS[name] = lambda text: sp.encode(text, num_threads=1)
    return _ENCODERS[name]


def parts(text: str, size: int) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut only where no token can span the cut."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def byte_batches(column: pa.ChunkedArray | pa.Array, limit: int) -> Iterator[list[str]]:
    """Consecutive texts in lists of about ``limit`` bytes each."""
    out, size = [], 0
    for x in column:
        s = x.as_py() or ""
        out.append(s)
        size += len(s)
        if size >= limit:
            yield out
            out, size = [], 0
    if out:
        yield out


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text",
                 batch_bytes: int = 1 << 20, part_chars: int = 1 << 16) -> DataFrame:
    """Bytes and tokens of every document; only lengths leave the Arrow function.

    Batches are balanced by bytes and texts above ``part_chars`` are encoded in parts
    whose cuts (a blank between letters) leave the token count unchanged; a text without such
    a place is encoded whole. Cuts are made only for the byte-level vocabulary.
    Null counts as empty (0 bytes, 0 tokens); repeated rows are all returned; other
    columns are ignored; no rows give no rows.
    """
    split = vocabulary == "byte_bpe_50k.json"
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        encode = encoder(vocabulary)
        for b in batches:
            n = []
            for texts in byte_batches(b.column(1), batch_bytes):
                n += [sum(len(encode(p)) for p in (parts(t, part_chars) if split else (t,))) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    t = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), t.alias("text"), F.octet_length(t).cast("long").alias("n_bytes"))
    return (rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
