"""Token counts of a BPE tokenizer by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch lie one after another in one array of symbols with an array of starts. In every round each pre-token finds the lowest
rank among its neighbouring pairs, and all pairs of that rank are joined at once, leftmost first where they overlap; pre-tokens without a pair
that the vocabulary joins leave the arrays. What is left of a pre-token is its number of tokens: ids are never made. Joining all places of a
rank at once equals joining them one by one, because a merge always comes after the merges that make its parts; a tokenizer for which
this doesn't hold is refused. A pre-token of over ``LONG`` symbols would need a round over the whole array for each of its many ranks; it takes the
same merges from a heap of (rank, place) instead.

Pre-tokens recur, so each worker keeps a table of their counts, bounded in bytes (``TABLE_BYTES``) whatever the input, and only new ones reach the arrays. Where the
pre-tokenizer is the known one that drops white space (``PATTERN``), printable ASCII is cut by that pattern here, and other words, which the table holds whole, by the library; for any other
pre-tokenizer the library cuts whole texts. Texts are taken in windows of about ``WINDOW`` characters, so that a long one is not held in pieces at once.
Special tokens standing in a text count as one token each, as the tokenizers library does by default.

Defined results: null text counts as empty (no bytes, no tokens); empty tables, null ids, repeated rows and further columns pass
unchanged, a column of a made name is replaced. A narrow transformation without shuffle.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusemill.llm.bpe import byte_alphabet
from fusemill.llm.common import named

#: Bytes of a worker's table of words, both generations together; a full generation becomes the older one.
TABLE_BYTES = 24_000_000
#: What an entry takes besides its letters.
_ENTRY = 150
#: Characters of texts that are cut into words at once.
WINDOW = 1 << 20
#: Symbols beyond which a pre-token is merged from a heap.
LONG = 4096
_NONE = np.iinfo(np.int32).max

#: The pre-tokenizer's pattern of words, digits and marks without white space (a fixed value), and what it is on lower-case ASCII.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII = re.compile(PATTERN.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.A)
_SPACE = re.compile(r"[\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: White space for str.split, but not for the pre-tokenizer.
_SEPARATOR = re.compile("[\x1c-\x1f]")


def _plain(text: str) -> bool:
    """Printable ASCII: normal as it is but for capitals, and its letters are its bytes'."""
    return text.isascii() and text.isprintable()


class Merges:
    """Symbols and ranked merges of a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("a plain BPE is asked for")
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.suffix = model.get("end_of_word_suffix") or ""
        odd = [x for x in spec["added_tokens"] if x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"]]
        if odd:
            raise ValueError(f"added tokens with a condition: {odd[0]['content']}")
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.around_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        steps = [x.get("pattern", {}).get("Regex") for x in spec["pre_tokenizer"].get("pretokenizers", [])]
        small = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.known_pattern = steps == [PATTERN, None] and small == ["NFC", "Replace", "Lowercase"]
        vocab = model["vocab"]
        letters = list(byte_alphabet())
        if not all(c in vocab and c + self.suffix in vocab for c in letters):
            raise ValueError("a byte-level BPE is asked for")
        # symbols of a byte's letter inside a pre-token and at its end
        self.inner, self.last = np.zeros((2, 512), dtype=np.int64)
        for c in letters:
            self.inner[ord(c)], self.last[ord(c)] = vocab[c], vocab[c + self.suffix]
        n = max(vocab.values()) + 1
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        born = np.full(n, -1, dtype=np.int64)
        born[self.made] = np.arange(len(pairs))
        rank = np.arange(len(pairs))
        if len(np.unique(self.made)) < len(pairs) or (born[left] >= rank).any() or (born[right] >= rank).any():
            raise ValueError("a merge comes before those that make its parts")
        self.n = n
        key = left * n + right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank_of = key[order], rank[order].astype(np.int32)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; _NONE where the vocabulary doesn't join them."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], _NONE)

    def counts(self, pre_tokens: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token (not empty, bytes as their letters)."""
        size = np.fromiter(map(len, pre_tokens), dtype=np.int64, count=len(pre_tokens))
        letters = np.frombuffer("".join(pre_tokens).encode("utf-32-le"), dtype=np.uint32)
        end = np.cumsum(size)
        flat = self.inner[letters]
        flat[end - 1] = self.last[letters[end - 1]]
        out = size.copy()
        for k in np.flatnonzero(size > LONG):
            out[k] = self.from_heap(flat[end[k] - size[k] : end[k]])
        short = (size > 1) & (size <= LONG)
        which = np.flatnonzero(short)
        flat, size = flat[np.repeat(short, size)], size[which]
        while len(which):
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            rank = np.full(len(flat), _NONE, dtype=np.int32)
            rank[:-1] = self.ranks(flat[:-1], flat[1:])
            rank[start + size - 1] = _NONE  # the last symbol has no right neighbour of its own
            lowest = np.minimum.reduceat(rank, start)
            owner = np.repeat(np.arange(len(which)), size)
            join = (rank != _NONE) & (rank == lowest[owner])
            # of overlapping places of one pair (aaa) the first, third, ... are joined
            at = np.arange(len(flat))
            fresh = join & ~np.concatenate([[False], join[:-1]])
            join &= (at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0
            flat = np.where(join, self.made[np.where(join, rank, 0)], flat)
            gone = np.concatenate([[False], join[:-1]])
            size = size - np.bincount(owner[gone], minlength=len(which))
            out[which] = size
            goes_on = (lowest != _NONE) & (size > 1)
            flat = flat[~gone & goes_on[owner]]
            which, size = which[goes_on], size[goes_on]
        return out

    def from_heap(self, s: np.ndarray) -> int:
        """The number of tokens of one long sequence: the same merges, lowest rank first and leftmost first, from a heap."""
        first = self.ranks(s[:-1], s[1:])
        here = np.flatnonzero(first != _NONE)
        heap = list(zip(first[here].tolist(), here.tolist(), strict=True))
        heapq.heapify(heap)
        n = len(s)
        sym, after, before = s.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of = dict(zip(self.keys.tolist(), self.rank_of.tolist(), strict=True))
        left = n

        def push(a: int, b: int) -> None:
            if a >= 0 and b < n and (r := rank_of.get(sym[a] * self.n + sym[b])) is not None:
                heapq.heappush(heap, (r, a))

        while heap:
            r, a = heapq.heappop(heap)
            b = after[a] if sym[a] >= 0 else n
            if b >= n or rank_of.get(sym[a] * self.n + sym[b]) != r:
                continue  # one of the two has been joined otherwise since
            sym[a], sym[b], after[a] = int(self.made[r]), -1, after[b]
            if after[b] < n:
                before[after[b]] = a
            left -= 1
            push(before[a], a)
            push(a, after[a])
        return left


class Counter:
    """Counts tokens of texts with a bounded table of words."""

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.taken = 0

    def pre_tokens(self, piece: str) -> list[str]:
        normal = self.merges.normalizer.normalize_str(piece) if self.merges.normalizer else piece
        return [p for p, _ in self.merges.pre_tokenizer.pre_tokenize_str(normal) if p]

    def learn(self, keys: list[str]) -> None:
        """Counts of new keys; their pre-tokens go through the arrays together."""
        row: list[str] = []
        owner: list[int] = []
        fixed = np.zeros(len(keys), dtype=np.int64)
        for k, key in enumerate(keys):
            if self.merges.known_pattern and _plain(key) and not any(x in key for x in self.merges.special):
                row.append(key)
                owner.append(k)
                continue
            for j, piece in enumerate(self.merges.around_special.split(key) if self.merges.around_special else [key]):
                if j % 2:
                    fixed[k] += 1
                elif piece:
                    own = self.pre_tokens(piece)
                    row += own
                    owner += [k] * len(own)
        if row:
            fixed += np.bincount(owner, weights=self.merges.counts(row), minlength=len(keys)).astype(np.int64)
        for key, n in zip(keys, fixed.tolist(), strict=True):
            self._enter(key, n)

    def _enter(self, key: str, n: int) -> None:
        self.known[key] = n
        self.taken += len(key) + _ENTRY

    def keys(self, text: str) -> Iterator[list[str]]:
        """What the table holds of a text, window by window: pre-tokens of printable ASCII, other words, words with a special token."""
        if not self.merges.known_pattern:
            yield [text]
            return
        a = 0
        while a < len(text):
            end = a + WINDOW
            if end < len(text):
                space = _SPACE.search(text, end)
                end = space.start() if space else len(text)
            part = text[a:end]
            a = end
            special = any(x in part for x in self.merges.special)
            if not special and _plain(part.replace("\n", " ")):
                yield _ASCII.findall(part.lower())
                continue
            words = [w for w in _SPACE.split(part) if w] if _SEPARATOR.search(part) else part.split()
            other = [w for w in words if not _plain(w) or (special and any(x in w for x in self.merges.special))]
            if len(other) < len(words):
                apart = set(other)
                other += _ASCII.findall(" ".join([w for w in words if w not in apart]).lower())
            yield other

    def add_up(self, words: list[list[str]]) -> list[int]:
        """Tokens of each list of words."""
        new = set().union(*words) - self.known.keys()
        unseen = []
        for w in new:
            n = self.older.get(w)
            if n is None:
                unseen.append(w)
            else:
                self._enter(w, n)
        self.learn(unseen)
        out = [sum(map(self.known.__getitem__, ws)) for ws in words]
        if self.taken > TABLE_BYTES // 2:
            self.older, self.known, self.taken = (self.known if self.taken <= TABLE_BYTES else {}), {}, 0
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        out = [0] * len(texts)
        rows: list[int] = []
        held: list[list[str]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            for k, n in zip(rows, self.add_up(held), strict=True):
                out[k] += n
            rows.clear()
            held.clear()
            size = 0

        for k, text in enumerate(texts):
            text = text or ""
            for words in self.keys(text):
                rows.append(k)
                held.append(words)
                size += min(len(text), WINDOW)
                if size >= WINDOW:
                    flush()
        if rows:
            flush()
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of a tokenizer file, made once in a worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, text_col: str = "text") -> DataFrame:
    """Input columns and n_bytes (of UTF-8), n_tokens, over_limit (more than ``limit`` tokens)."""

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for texts in batches:
            yield pd.Series(c.count(texts.tolist()), dtype="int64")

    text = named(text_col)
    made = {"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": tokens(text)}
    own = [named(c) for c in docs.columns if c.lower() not in (*made, "over_limit")]
    out = docs.select(*own, *[c.alias(k) for k, c in made.items()])
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
