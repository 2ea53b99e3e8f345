"""Exact token counts by a map-side two-tier lookup, without any shuffle of pre-tokens.

Tier one is a compact table of the pre-tokens that byte-pair vocabularies are built from: every vocabulary entry that is a
whole pre-token, with the length the library itself gives it. It is made once on the driver, bounded by the vocabulary,
and broadcast. Tier two is a cache in each Python worker: a miss is encoded alone by the library and remembered (bounded;
emptied when full; very long pre-tokens are not kept). Pre-tokens are independent of each other, so sums are exact.

Defined cases: a null text counts as empty (0 bytes, 0 tokens, not over the limit); special strings inside a text count as
the library's default treats them, one token each; repeated rows are each counted; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.textvec import slices

#: Fixed value: the split of byte-level vocabularies into pre-tokens.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 500_000
CACHE_CHARS = 64


def _byte_chars() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest is moved past 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


def load(path: str):
    """The tokenizer, after checking that pre-tokens are cut by SPLIT and nothing rewrites the text before."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    spec = json.loads(Path(path).read_text())
    cut = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError("only byte-level vocabularies without a normalizer are counted by pre-token")
    special = [t for t in spec["added_tokens"] if t.get("special")]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]) or len(special) != len(spec["added_tokens"]):
        raise ValueError("added tokens that look at their surroundings are not supported")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, [t["content"] for t in special]


def frequent(path: str) -> dict[str, int]:
    """Tier one: vocabulary entries that are one whole pre-token, with their lengths."""
    tokenizer, special = load(path)
    chars, cut, words = _byte_chars(), regex.compile(SPLIT), []
    for entry in tokenizer.get_vocab():
        try:
            word = bytes(chars[c] for c in entry).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if word not in special and cut.findall(word) == [word]:
            words.append(word)
    return {w: len(e.ids) for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True)}


class Counter:
    """Counts the tokens of texts in one worker."""

    def __init__(self, path: str, table: dict[str, int]):
        self.tokenizer, special = load(path)
        self.table, self.cache = table, {}
        self.cut = regex.compile(SPLIT)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def _miss(self, word: str) -> int:
        n = self.cache.get(word)
        if n is None:
            n = len(self.tokenizer.encode(word, add_special_tokens=False).ids)
            if len(word) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[word] = n
        return n

    def count(self, text: str) -> int:
        known, miss, total = self.table.get, self._miss, 0
        parts = self.special.split(text) if self.special else [text]
        for part in parts:
            for word in self.cut.findall(part):
                total += known(word) or miss(word)
        return total + len(parts) - 1


_workers: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row. `path` is the vocabulary file, present on every worker."""
    table = docs.sparkSession.sparkContext.broadcast(frequent(path))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _workers:
            _workers[path] = Counter(path, table.value)
        count = _workers[path].count
        for batch in batches:
            for part in slices(batch, "t"):
                n = [count(t) if t else 0 for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_pydict({"i": part.column("i"), "b": part.column("b"), "n": pa.array(n, pa.int64())})

    part = docs.select(F.col(id_col).alias("i"), F.coalesce(F.octet_length(F.col(text_col)).cast("long"), F.lit(0)).alias("b"),
                       F.col(text_col).cast("string").alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = part.mapInArrow(rows, f"i {kind}, b long, n long")
    return out.select(F.col("i").alias(id_col), F.col("b").alias("n_bytes"), F.col("n").alias("n_tokens"),
                      (F.col("n") > limit).alias("over_limit"))
