"""Token counts by batch encoding: Arrow functions that return lengths only.

A batch of texts is cut at safe boundaries into chunks, the distinct chunks that the worker does not
remember are dealt into batches of about equal bytes, and the tokenizer encodes those; a text's count is
the sum over its chunks. A boundary is safe at ASCII white space when the tokenizer's file says so: its
pre-tokeniser splits at white space and drops it, its normaliser works character by character, and no added
token holds or swallows white space. Then no token spans it; this also cuts very long texts.

Where a text can't be cut so (any other file, a sentencepiece model) whole texts are encoded.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows count alike; an empty table
gives an empty table; ``keep`` names the columns that pass through, clashing ones are replaced by the counts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_column, byte_view, slices, small_batches, worker_state

MEMO_ENTRIES = 250_000
MEMO_CHARS = 64
BATCH_BYTES = 256 << 10
#: Python's split() also cuts here, the tokenizers' \s does not.
OTHER_BREAKS = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SAFE = re.compile("[ \t\r\n]+")


def balanced(chunks: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Runs of chunks of about ``limit`` bytes each."""
    start, size = 0, 0
    for k, c in enumerate(chunks):
        size += (len(c) if c.isascii() else len(c.encode())) + 16
        if size >= limit:
            yield chunks[start:k + 1]
            start, size = k + 1, 0
    if start < len(chunks):
        yield chunks[start:]


#: Pre-tokenisers that split at white space and drop it, and normalisers that change characters without regard to white space.
DROPPING = {"Whitespace", "WhitespaceSplit", "BertPreTokenizer"}
CHARACTERWISE = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"}
#: Fixed value: a pattern whose matches hold no white space and don't depend on what is around them; a Split that keeps its matches alone drops white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_space(form: dict) -> bool:
    """Whether the counts of a text's pieces between ASCII white space add up to the text's, by the tokenizer's file."""
    parts = lambda x, inner: [] if not x else [p for y in x[inner] for p in parts(y, inner)] if x["type"] == "Sequence" else [x]
    normal, pre = parts(form.get("normalizer"), "normalizers"), parts(form.get("pre_tokenizer"), "pretokenizers")
    calm = all(t["type"] in CHARACTERWISE or t["type"] == "Replace" and t["pattern"] == {"Regex": r"\s+"} and t["content"] == " " for t in normal)
    added = all(not t.get("lstrip") and not t.get("rstrip") and not re.search(r"\s", t["content"]) for t in form.get("added_tokens") or [])
    words = bool(pre) and pre[0]["type"] == "Split" and pre[0]["pattern"] == {"Regex": WORD_PATTERN} and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
    return calm and added and (words or bool(pre) and pre[0]["type"] in DROPPING) and not form["model"].get("dropout")


class Counter:
    """Token counts of chunks under one tokenizer, with a bounded memory of short chunks in two generations."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda chunks: [len(x) for x in model.encode(chunks, num_threads=1)]
            self.split = False
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.lengths = lambda chunks: [len(x) for x in model.encode_batch_fast(chunks, add_special_tokens=False)]
            self.split = splits_at_space(json.loads(model.to_str()))
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        """Chunks whose counts add up to the text's."""
        if not self.split:
            return [text] if text else []
        return [c for c in SAFE.split(text) if c] if OTHER_BREAKS.search(text) else text.split()

    def count(self, texts: list[str]) -> list[int]:
        cuts = [self.cut(t) for t in texts]
        need = set().union(*cuts)
        if len(self.new) > MEMO_ENTRIES:
            self.old, self.new = self.new, {}
        known = {c: n for c in need if (n := self.new.get(c)) is not None}
        for c in need - known.keys():
            if (n := self.old.get(c)) is not None:
                known[c] = self.new[c] = n
        missing = sorted(need - known.keys(), key=len)
        for part in balanced(missing):
            for c, n in zip(part, self.lengths(part)):
                known[c] = n
                if len(c) <= MEMO_CHARS:
                    self.new[c] = n
        get = known.__getitem__
        return [sum(map(get, chunks)) for chunks in cuts]


def token_counts(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, n_bytes: str = "n_bytes", n_tokens: str = "n_tokens") -> DataFrame:
    """Adds ``n_bytes`` (UTF-8 length) and ``n_tokens`` of each whole text; drops the text."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in (text, n_bytes, n_tokens)]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.LongType(), False) for c in (n_bytes, n_tokens)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = worker_state(("token counts", path), lambda: Counter(path))
        for batch, texts in slices(batches, text):
            _, offsets = byte_view(texts)
            out = add_column(batch.select(keep), n_bytes, pa.array(np.diff(offsets)))
            yield add_column(out, n_tokens, pa.array(c.count(texts.to_pylist()), pa.int64()))

    return small_batches(df.select(*dict.fromkeys([*keep, text]))).mapInArrow(run, schema)
