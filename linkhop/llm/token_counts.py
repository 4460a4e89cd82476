"""Token counts by a compiled finite-state tokenizer.

The BPE of a word is the one sequence of tokens whose neighbours are compatible, so
the last token of each prefix is fixed and the encoder can run as a deterministic
transducer over bytes.  A state is the set of suffixes that may still grow into a
token, each with the token that ends before it and the tokens emitted since; a
transition is annotated with the number of tokens that it adds.  States are compiled
when first met and the table is started anew beyond a bound, so memory is bounded.

Texts are cut into chunks.  The map of a chunk from entry state to (exit state,
tokens) is constant after its first word end: the chunk is held as its head and the
constant, all constants are run in lockstep, and a prefix scan over the chunks of a
text composes the maps by running each head from the state before it.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from linkhop.llm.common import documents, groups_of, prepare

#: Symbols of a chunk.
CHUNK = 256
#: Compiled states beyond which the table is started anew.
MOST_STATES = 200_000
NEVER = 1 << 30
#: Code points that the tokenizer's white space class holds.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe in a piece of its own.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
SPACE, LETTER, NUMBER, OTHER = range(4)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Symbols are bytes, plus 256 for the last byte of a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        end = model["end_of_word_suffix"]
        self.specials = [t["content"] for t in spec["added_tokens"]]

        def symbols(token: str) -> tuple[int, ...]:
            last = token.endswith(end)
            body = [letters[c] for c in (token[: -len(end)] if last else token)]
            return (*body[:-1], body[-1] + 256) if last else tuple(body)

        #: Tokens are numbered from 1; 0 stands for the start of a word.
        number: dict[tuple, int] = {}
        self.tokens: list[tuple] = [()]
        for t in model["vocab"]:
            if t not in self.specials and number.setdefault(symbols(t), len(self.tokens)) == len(self.tokens):
                self.tokens.append(symbols(t))
        self.single = {t[0]: n for t, n in number.items() if len(t) == 1}
        self.rank: dict[tuple[int, int], int] = {}
        self.pair: dict[tuple[int, int], int] = {}
        text = {t: number[symbols(t)] for t in model["vocab"] if t not in self.specials}
        for r, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault((text[a], text[b]), r)
            self.pair[text[a], text[b]] = number[self.tokens[text[a]] + self.tokens[text[b]]]
        #: The trie of tokens: node * 512 + symbol to node; ends: node to token; inner: nodes with children.
        self.edge: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        self.inner: set[int] = set()
        made = set(self.pair.values()) | set(self.single.values())
        for n, token in enumerate(self.tokens):
            if n in made:
                node = 0
                for x in token:
                    self.inner.add(node)
                    node = self.edge.setdefault(node * 512 + x, len(self.edge) + 1)
                self.ends[node] = n
        self.fits: dict[int, bool] = {}
        self.spines: dict[int, tuple] = {0: ((), [], [0], [], [0])}
        self.start()

    def start(self) -> None:
        """An empty table.  A state's entries are packed: trie node << 27 | token before << 10 | tokens since + 512; a cell holds the next state * 2048 + the tokens added + 1024, or -1."""
        self.column = np.full(512, -1, np.int32)
        self.columns: list[int] = []
        self.table = np.full((16384, 64), -1, np.int32)
        self.states: list[tuple] = [(512,)]
        self.index = {self.states[0]: 0}

    def spine(self, token: int) -> tuple:
        """How merging forms the token alone: the result, and for its right and its left end the
        ranks of the merges in their order and the part at that end before and after each."""
        known = self.spines.get(token)
        if known is None:
            parts = [self.single[s] for s in self.tokens[token]]
            ranks, right, left = [], [parts[-1]], [parts[0]]
            while len(parts) > 1:
                r, i = min((self.rank.get((parts[i], parts[i + 1]), NEVER), i) for i in range(len(parts) - 1))
                if r == NEVER:
                    break
                parts[i : i + 2] = [self.pair[parts[i], parts[i + 1]]]
                ranks.append(r)
                right.append(parts[-1])
                left.append(parts[0])
            known = self.spines[token] = (tuple(parts), ranks, right, ranks, left)
        return known

    def compatible(self, before: int, token: int) -> bool:
        """Whether merging the two tokens' symbols gives just these two tokens."""
        key = before << 17 | token
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self._compatible(before, token)
        return known

    def _compatible(self, before: int, token: int) -> bool:
        parts, ranks, _, _, left = self.spine(token)
        if parts != (token,):
            return False
        if not before:
            return True
        _, ranks_before, right, _, _ = self.spine(before)
        i = j = 0
        while True:
            a = ranks_before[i] if i < len(ranks_before) else NEVER
            b = ranks[j] if j < len(ranks) else NEVER
            across = self.rank.get((right[i], left[j]), NEVER)
            if across < a and across <= b:
                return across == NEVER
            if a == b == NEVER:
                return across == NEVER
            if a <= b:
                i += 1
            else:
                j += 1

    def step(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        """The state after the symbol and the tokens that this adds."""
        grown, last, count, edge = [], None, None, self.edge
        for entry in state:
            child = edge.get((entry >> 27) * 512 + symbol)
            if child is not None:
                if child in self.inner:
                    grown.append((entry & 0x7FFFFFF) + (child << 27))
                if count is None:
                    token = self.ends.get(child)
                    if token is not None and self.compatible(entry >> 10 & 0x1FFFF, token):
                        last, count = token, (entry & 1023) - 511
        if count is None:
            raise ValueError(f"no token of the vocabulary ends with symbol {symbol}")
        if symbol >= 256:
            return self.states[0], count
        return (*(e - count for e in grown), last << 10 | 512), count

    def compile(self, cells: np.ndarray) -> None:
        wide = self.table.shape[1]
        for cell in set(cells.tolist()):
            s, c = divmod(cell, wide)
            after, count = self.step(self.states[s], self.columns[c])
            to = self.index.get(after)
            if to is None:
                to = self.index[after] = len(self.states)
                self.states.append(after)
                if to >= len(self.table):
                    self.table = np.vstack([self.table, np.full((32768, wide), -1, np.int32)])
            self.table[s, c] = to << 11 | count + 1024
        if len(self.fits) > 1_000_000:
            self.fits = {}

    def know(self, symbols: np.ndarray) -> None:
        """Gives each symbol of the batch a column."""
        for x in np.flatnonzero(np.bincount(symbols, minlength=512)).tolist():
            if self.column[x] < 0:
                self.column[x] = len(self.columns)
                self.columns.append(x)
                if len(self.columns) > self.table.shape[1]:
                    self.table = np.hstack([self.table, np.full((len(self.table), 16), -1, np.int32)])

    def run(self, columns: np.ndarray, starts: np.ndarray, lens: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs columns[s:s + n] of all (s, n) in lockstep; states after them and tokens added."""
        order = np.argsort(-lens, kind="stable")
        at, state, total = starts[order], states[order].astype(np.int64), np.zeros(len(order), np.int64)
        left = np.searchsorted(-lens[order], -np.arange(1, (int(lens.max()) if len(lens) else 0) + 1), side="right")
        wide = self.table.shape[1]
        for i, n in enumerate(left.tolist()):
            cell = state[:n] * wide + columns.take(at[:n] + i)
            got = self.table.ravel().take(cell)
            if got.min() < 0:
                self.compile(cell[got < 0])
                got = self.table.ravel().take(cell)
            total[:n] += (got & 2047) - 1024
            state[:n] = got >> 11
        back_state, back_total = np.empty_like(state), np.empty_like(total)
        back_state[order], back_total[order] = state, total
        return back_state, back_total

    def counts(self, symbols: np.ndarray, text_lens: np.ndarray) -> np.ndarray:
        """Tokens of each text; symbols holds the texts' symbols one after another."""
        if len(self.states) > MOST_STATES:
            self.start()
        self.know(symbols)
        columns = self.column[symbols]
        chunks = -(-text_lens // CHUNK)
        text = np.repeat(np.arange(len(text_lens)), chunks)
        first = np.concatenate([[0], np.cumsum(chunks)[:-1]]) if len(chunks) else chunks
        within = np.arange(len(text)) - first[text]
        text_starts = np.cumsum(text_lens) - text_lens
        starts = text_starts[text] + within * CHUNK
        lens = np.minimum(CHUNK, text_lens[text] - within * CHUNK)
        # a chunk that isn't a text's first has a head up to its first word end
        stops = np.flatnonzero(symbols >= 256)
        after = np.searchsorted(stops, starts)
        head = np.where(after < len(stops), stops[np.minimum(after, max(len(stops) - 1, 0))] + 1 - starts if len(stops) else lens, lens)
        head = np.where(within == 0, 0, np.minimum(head, lens))
        state, total = self.run(columns, starts + head, lens - head, np.zeros(len(text), np.int64))
        # the scan: a chunk's head is run once the state before it is known
        known, waiting = head < lens, head > 0
        known |= within == 0
        while waiting.any():
            ready = np.flatnonzero(waiting & known[np.arange(len(text)) - 1])
            end, more = self.run(columns, starts[ready], head[ready], state[ready - 1])
            total[ready] += more
            through = head[ready] == lens[ready]
            state[ready[through]] = end[through]
            known[ready] = True
            waiting[ready] = False
        return np.bincount(text, weights=total, minlength=len(text_lens)).astype(np.int64)


def classes() -> np.ndarray:
    """The class of each code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


class Counter:
    def __init__(self, path: str):
        self.transducer, self.classes = Transducer(path), classes()

    def normal(self, text: str) -> tuple[str, int]:
        """The text as the tokenizer normalises it, and the special tokens in it."""
        parts, n = [text], 0
        for special in self.transducer.specials:
            if special in text:
                parts = [q for p in parts for q in p.split(special)]
                n = len(parts) - 1
        text = " ".join(p if p.isascii() else unicodedata.normalize("NFC", p) for p in parts)
        return text.replace("Σ", "σ").lower(), n

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts, and how many each has."""
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        cls = self.classes[points]
        start = np.ones(len(points), bool)
        start[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == NUMBER)
        quote = np.flatnonzero(points == ord("'"))
        quote = quote[(quote == 0) | (cls[quote - 1] != OTHER)]
        for end in CONTRACTIONS:
            hit = quote[quote + len(end) < len(points)]
            for k, c in enumerate(end, 1):
                hit = hit[points[hit + k] == ord(c)]
            start[hit + 1] = False
            hit = hit[hit + len(end) + 1 < len(points)]
            start[hit + len(end) + 1] = True
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        symbol = data.astype(np.int16)
        last = np.append(lead[1:], len(data)) - 1
        ends = np.append(start[1:], True)
        symbol[last[ends]] += 256
        widths = np.diff(np.append(lead, len(data)))
        keep = np.repeat(cls != SPACE, widths)
        lens = np.array([len(t) for t in texts], np.int64) + 1
        edges = np.cumsum(lens)
        at = np.append(lead, len(data))[edges]
        kept = np.concatenate([[0], np.cumsum(keep)])
        return symbol[keep], np.diff(np.concatenate([[0], kept[at]]))

    def __call__(self, texts: list[str]) -> np.ndarray:
        normal, special = zip(*map(self.normal, texts), strict=True) if texts else ((), ())
        out = np.array(special, np.int64)
        for a, b in groups_of(normal):
            out[a:b] += self.transducer.counts(*self.symbols(list(normal[a:b])))
        return out


_counters: dict[str, Counter] = {}


def token_count(text: Column | str, tokenizer: str) -> Column:
    """Tokens of each text (null: an empty text), for a lower-casing BPE with word ends in the file at that path."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counters.get(tokenizer) or _counters.setdefault(tokenizer, Counter(tokenizer))
        for texts in batches:
            yield pd.Series(counter([t or "" for t in texts]), dtype="int64")

    return count(text)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit.

    A null text counts as empty (0 bytes, 0 tokens); null and repeated ids are kept as
    they are; a text is never cut.  An empty table gives an empty result, and further
    columns of docs are left out.  One narrow pass: no shuffle, whatever the skew.
    """
    prepare(docs.sparkSession)
    kept = documents(docs, id_col, text_col)
    return kept.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(F.col(text_col), tokenizer).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
