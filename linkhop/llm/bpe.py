"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The pieces of many texts are looked up in a bounded store; new ones are laid out as
symbols in one flat array.  A round finds the rank of every adjacent pair by binary
search over the sorted pair keys, takes each word's lowest rank, merges its pairs of
that rank from the left, and drops the words that have none.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from linkhop.llm.common import documents, groups_of, prepare, ragged, tidy
from linkhop.llm.token_counts import byte_letters

#: Fixed value: the pattern that splits a text into pieces before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words and ids that the store of encoded words holds before it is started anew.
MOST_WORDS, MOST_IDS = 150_000, 1_500_000
NEVER = np.int64(1) << 40

ENCODED = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])


class Store(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_at = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.pieces = regex.compile(PIECES).findall
        self.first = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.first[b] = vocab[c]
        merges = [(vocab[a] << 20 | vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(spec["model"]["merges"])]
        table = np.array(sorted(merges), np.int64)
        self.keys, self.ranks, self.made = table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()
        parts = [b""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for t, n in vocab.items():
            parts[n] = bytes(letters[c] for c in t)
        for t, n in self.specials.items():
            parts[n] = t.encode()
        self.token_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.token_lens = np.array([len(p) for p in parts], np.int64)
        self.token_starts = np.cumsum(self.token_lens) - self.token_lens
        self.start()

    def start(self) -> None:
        self.store, self.ids = Store(), np.zeros(0, np.int64)
        self.starts, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has."""
        data = [w.encode() for w in words]
        lens = np.array([len(d) for d in data], np.int64)
        symbols = self.first[np.frombuffer(b"".join(data), np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        done_symbols, done_words = [], []
        while len(symbols):
            key = symbols[:-1] << 20 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(hit, self.ranks[at], NEVER), NEVER)
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(begins, len(word)))
            least = np.minimum.reduceat(rank, begins)
            over = np.repeat(least == NEVER, sizes)
            chosen = (rank == np.repeat(least, sizes)) & ~over
            # of pairs that overlap, every second from the left
            i = np.arange(len(chosen))
            run = np.maximum.accumulate(np.where(chosen, -1, i))
            chosen &= (i - run) % 2 == 1
            symbols = symbols.copy()
            symbols[chosen] = self.made[at[chosen[:-1]]]
            keep = np.append(True, ~chosen[:-1])
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                keep &= ~over
            symbols, word = symbols[keep], word[keep]
        if not done_symbols:
            return symbols, lens
        word = np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return np.concatenate(done_symbols)[order], np.bincount(word, minlength=len(words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.store) > MOST_WORDS or len(self.ids) > MOST_IDS:
            self.start()
        get, pieces, before = self.store.__getitem__, self.pieces, len(self.store)
        plans = []
        for text in texts:
            parts = self.split_at.split(text) if self.split_at and any(s in text for s in self.specials) else [text]
            plans.append([self.specials[p] if i % 2 else np.fromiter(map(get, pieces(p)), np.int64) for i, p in enumerate(parts)])
        new = list(self.store)[before:] if len(self.store) > before else []
        if new:
            ids, lens = self.merge(new)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lens) - lens])
            self.lens = np.concatenate([self.lens, lens])
            self.ids = np.concatenate([self.ids, ids])
        out = []
        for plan in plans:
            got = [np.array([p]) if isinstance(p, int) else ragged(self.ids, self.starts[p], self.lens[p]) for p in plan]
            out.append(got[0] if len(got) == 1 else np.concatenate(got))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return ragged(self.token_bytes, self.token_starts[ids], self.token_lens[ids]).tobytes().decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    return _codecs.get(path) or _codecs.setdefault(path, Codec(path))


def encode_column(text: Column, tokenizer: str) -> Column:
    """Token ids of each text (null: an empty text) as array<int>."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([x.astype(np.int32) for x in codec(tokenizer).encode([t or "" for t in texts])], dtype=object)

    return encode(text)


def decode_column(ids: Column, tokenizer: str) -> Column:
    """The text of each list of token ids, special tokens included (null: an empty list)."""

    @F.pandas_udf(T.StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([codec(tokenizer).decode(np.array([] if x is None else x, np.int64)) for x in rows], dtype=object)

    return decode(ids)


def digest_column(text: Column, tokenizer: str) -> Column:
    """Encodes and decodes each text: n_tokens and the digests of ids and decoded text.  Ids don't leave the task."""

    @F.pandas_udf(ENCODED)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(tokenizer)
        for rows in batches:
            texts, out = [t or "" for t in rows], []
            for a, b in groups_of(texts):
                for ids in own.encode(texts[a:b]):
                    decoded = own.decode(ids)
                    out.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            yield pd.DataFrame(out, columns=ENCODED.names)

    return digest(text)


def bpe_encode(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the token ids of each text as column ids_col, which replaces one of that name."""
    prepare(docs.sparkSession)
    docs = tidy(docs, text_col)
    return docs.withColumn(ids_col, encode_column(docs[text_col], tokenizer))


def bpe_decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows with the text of each list of ids as column text_col, which replaces one of that name."""
    prepare(rows.sparkSession)
    rows = tidy(rows, ids_col)
    return rows.withColumn(text_col, decode_column(rows[ids_col], tokenizer))


def bpe_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty; null and repeated ids are kept; further columns are left
    out; an empty table gives an empty result.  One narrow pass without a shuffle, so no
    key can be hot; a long text is one row of one batch.
    """
    prepare(docs.sparkSession)
    kept = documents(docs, id_col, text_col)
    return kept.select(F.col(id_col).alias("doc_id"), digest_column(F.col(text_col), tokenizer).alias("d")).select("doc_id", "d.*")
