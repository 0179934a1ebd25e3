"""Encoding of the whole corpus with a public byte-level BPE vocabulary (problem 6): prefix dynamic programming.

For every prefix of a piece of text there is exactly one token that the prefix's encoding ends in: the token
whose removal leaves a prefix whose own last token may stand before it. A token may stand before another if
merging the bytes of both, in the order of the merges, never joins across their border. So the table of last
tokens, one a byte, is filled from left to right and read back from right to left. Appending goes on where
the table ends; after an edit everything before the edit is kept.

Defined cases: a null and an empty text have no ids (an empty list); blank texts are encoded as they are;
strings that look like special tokens are ordinary text; texts and pieces may have any length.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: how this vocabulary parts a text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary:
    """A vocabulary's tokens in the order of their merges, and which of them may stand side by side."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.parts = regex.compile(PIECES)
        # every beginning of a token, with the token's id or -1
        self.starts: dict[bytes, int] = {}
        for t, i in self.ids.items():
            for n in range(1, len(t)):
                self.starts.setdefault(t[:n], -1)
            self.starts[t] = i
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._known: dict[str, list[int]] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that a token was merged from, None for a single byte."""
        if token not in self._halves:
            parts = [bytes([b]) for b in self.bytes[token]]
            while len(parts) > 2:
                ranks = [self.ids.get(parts[k] + parts[k + 1], 1 << 30) for k in range(len(parts) - 1)]
                k = ranks.index(min(ranks))
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            self._halves[token] = (self.ids[parts[0]], self.ids[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together are encoded as just these two tokens.

        The merges that made the two are taken back, last one first. Were the two pieces that touch the
        border at that time a token made by an earlier merge, they would have been joined.
        """
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            known = self._fits[key] = self._stand(left, right)
            if len(self._fits) > 2_000_000:
                self._fits.clear()
        return known

    def _stand(self, a: int, b: int) -> bool:
        before = 1 << 30
        while True:
            joined = self.ids.get(self.bytes[a] + self.bytes[b])
            if joined is not None and joined < before:
                return False
            ha, hb = self.halves(a), self.halves(b)
            if ha is None and hb is None:
                return True
            # the token that was made last comes apart first; of one and the same token the left one was made first
            if hb is None or (ha is not None and a > b):
                before, a = a, ha[1]  # what touches the border now was made before a
            else:
                before, b = b + 1, hb[0]

    def piece(self, text: str) -> list[int]:
        ids = self._known.get(text)
        if ids is None:
            raw = text.encode("utf-8", "surrogatepass")
            one = self.ids.get(raw)
            ids = [one] if one is not None else Prefixes(self).extend(raw).tokens()
            if len(raw) <= 64:
                if len(self._known) >= 200_000:
                    self._known.clear()
                self._known[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return [i for m in self.parts.finditer(text or "") for i in self.piece(m.group())]


class Prefixes:
    """The last token of every prefix of a growing string of bytes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.raw, self.last = vocabulary, bytearray(), [-1]

    def extend(self, more: bytes) -> Prefixes:
        """Append bytes; the prefixes known so far stay as they are."""
        v, old = self.vocabulary, len(self.raw)
        self.raw += more
        raw, last, n = bytes(self.raw), self.last, len(self.raw)
        last += [-1] * len(more)
        for i in range(max(0, old - v.longest), n):
            j, before = i + 1, last[i]
            while j <= n:
                token = v.starts.get(raw[i:j])
                if token is None:
                    break
                if j > old and token >= 0 and last[j] < 0 and (i == 0 or v.fits(before, token)):
                    last[j] = token
                j += 1
        return self

    def cut(self, n: int) -> Prefixes:
        """Forget all after the first n bytes, as before re-encoding from an edit on."""
        del self.raw[n:], self.last[n + 1:]
        return self

    def tokens(self) -> list[int]:
        out, at = [], len(self.raw)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _sent(path: str) -> str:
    """In a task: where Spark put the file."""
    sent = SparkFiles.get(os.path.basename(path))
    return sent if os.path.exists(sent) else path


def _send(path: str) -> str:
    """Have Spark hand the file to every executor, once a context: only the driver needs to see the path."""
    SparkSession.active().sparkContext.addFile(path)
    return path


def token_ids(text: str | Column, path: str = VOCABULARY) -> Column:
    """A text's ids; map-only, so the corpus is never shuffled. Each Python worker reads the vocabulary once."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        v = vocabulary(_sent(path))
        return pd.Series([v.encode(t) for t in texts])

    _send(path)
    return ids(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def token_count(text: str | Column, path: str = VOCABULARY) -> Column:
    """The number of a text's ids."""

    @F.pandas_udf("bigint")
    def size(texts: pd.Series) -> pd.Series:
        v = vocabulary(_sent(path))
        return pd.Series([len(v.encode(t)) for t in texts], dtype="int64")

    _send(path)
    return size(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def p6_ids(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_ids("text").alias("ids"))


def p6_fertility(spark, sf_dir: str) -> DataFrame:
    """(lang, n_docs, n_tokens, n_chars, tokens_per_char): what each language costs in tokens."""
    sized = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("chars"), token_count("text").alias("tokens"))
    return sized.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("n_tokens"), F.sum(F.coalesce("chars", F.lit(0))).alias("n_chars")).withColumn(
        "tokens_per_char", F.round(F.try_divide(F.col("n_tokens").cast("double"), "n_chars"), 6))
