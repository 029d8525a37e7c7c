"""Byte-level BPE by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can't be joined by any merge, so the place between
them is a certain cut: the text splits there into fragments that are encoded on their own, and the ids are put
together again. Cuts are found for many texts at once, and their new fragments are encoded together. Three places are left uncut although their pair never occurs,
since the pre-tokenizer looks across them: inside a character, after white space, and before an apostrophe. A single line feed between two
printable ASCII characters is a pre-token of its own, so the place after it is a cut, too.
Fragments recur, so each worker keeps a table of their ids, bounded in bytes (``TABLE_BYTES``, and what one window adds) whatever the input.

Special tokens standing in a text become their id, as the tokenizers library does by default.

Defined results: null text counts as empty (no ids, empty text back); empty tables, null ids, repeated rows and further columns
pass unchanged. Texts are encoded whole; a narrow transformation without shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a worker's table of fragments, both generations together; a full generation becomes the older one.
TABLE_BYTES = 24_000_000
#: Characters of texts that are cut together (a longer text alone), and fragments that go to the library in one call.
WINDOW, CALL = 1 << 19, 1000
#: What an entry takes besides its letters: two bytes objects, and its place in a dict that is half full.
_ENTRY = 190
RESULT = "struct<n_tokens:bigint,ids:array<int>,decoded:string>"
DIGEST = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"

#: White space past the first byte, other white space or an apostrophe at the start, or any byte of non-ASCII white space.
_UNSAFE = re.compile(rb"^['\x00-\x1f]|.[\x00-\x20]|^ ?$|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80|\xe2\x81\x9f|\xe3\x80\x80", re.S)
#: A word of letters up to U+017F with one leading space or none: one pre-token whatever stands around it.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf])+")

_space_ends: dict[int, tuple[bytes, ...]] = {
    2: (b"\xc2\x85", b"\xc2\xa0"),
    3: (b"\xe1\x9a\x80", b"\xe2\x80\xa8", b"\xe2\x80\xa9", b"\xe2\x80\xaf", b"\xe2\x81\x9f", b"\xe3\x80\x80"),
}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 stays, the rest follows from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in own}
    for k, b in enumerate(b for b in range(256) if b not in set(own)):
        out[chr(256 + k)] = b
    return out


class Codec:
    """Encoder and decoder over a tokenizers JSON file of a byte-level BPE without normalizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError("forced boundaries need a byte-level BPE that cuts words, without normalizer or prefix space")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        alphabet = byte_alphabet()
        self.letters = {b: c for c, b in alphabet.items() if b != 0x0A}  # the line feed parts words
        self.bytes_of = {i: bytes(alphabet[c] for c in token) for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.cuttable = np.ones((256, 256), dtype=bool)
        for token in self.bytes_of.values():
            for a, b in zip(token, token[1:], strict=False):
                self.cuttable[a, b] = False
        self.cuttable[:, 0x27] = False  # an apostrophe may open a contraction at the start of a fragment only
        self.cuttable[:, 0x80:0xC0] = False  # inside a character
        self.cuttable[:0x21, :] = False  # after white space (and other control characters)
        self.cuttable = self.cuttable.reshape(-1)
        self.spelled = {i: b"%d" % i for i in self.bytes_of}
        self.line_feed = self.library.encode("\n", add_special_tokens=False).ids[0]
        # fragment (a special token is a str) -> its ids in decimal; what a fragment decodes to is kept only where it isn't the fragment
        self.fixed: dict[bytes | str, bytes] = {x: self.spelled[i] for x, i in self.special.items()}
        self.known, self.older = dict(self.fixed), {}
        self.decoded: dict[bytes | str, bytes] = {x: x.encode() for x in self.special}
        self.taken = 0

    def cuts(self, data: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Places k such that data[:k] and data[k:] may be encoded apart; ``stops``, the ends of texts, the last one included, are among them."""
        stops = stops[stops > 0]
        if len(data) < 2:
            return stops[:1]
        at = self.cuttable[(data[:-1].astype(np.int32) << 8) | data[1:]]
        for n, ends in _space_ends.items():
            if len(data) <= n:
                continue
            for end in ends:
                hit = data[n - 1 : -1] == end[-1]
                for k in range(n - 1):
                    hit &= data[k : len(data) - n + k] == end[k]
                at[n - 1 :][hit] = False
        if len(data) > 3:  # the eleven spaces from U+2000 on
            hit = (data[:-3] == 0xE2) & (data[1:-2] == 0x80) & (data[2:-1] >= 0x80) & (data[2:-1] <= 0x8A)
            at[2:][hit] = False
        if len(data) > 2:  # a line feed alone between two printable characters is a pre-token
            printable = (data > 0x20) & (data < 0x7F)
            at[1:][printable[:-2] & (data[1:-1] == 0x0A) & printable[2:] & (data[2:] != 0x27)] = True
        at[stops[stops < len(data)] - 1] = True
        return np.append(np.flatnonzero(at) + 1, len(data))

    def fragments(self, texts: list[str]) -> list[list[bytes | str]]:
        """Pieces of each text in order, cut together; a special token is a str, anything else UTF-8."""
        pieces = [self._around_special(t) for t in texts]
        raws = [p.encode() for own in pieces for p in own if p not in self.special]
        flat = b"".join(raws)
        ends = np.cumsum([len(r) for r in raws], dtype=np.int64)
        edges = self.cuts(np.frombuffer(flat, dtype=np.uint8), ends)
        upto = iter((np.searchsorted(edges, ends) + (ends > 0)).tolist())
        edges = edges.tolist()
        cut = [flat[a:b] for a, b in zip([0, *edges], edges, strict=False)]
        out: list[list[bytes | str]] = []
        a = 0
        for own in pieces:
            parts: list[bytes | str] = []
            for p in own:
                if p in self.special:
                    parts.append(p)
                    continue
                b = next(upto)
                parts += cut[a:b]
                a = b
            out.append(parts)
        return out

    def _around_special(self, text: str) -> list[str]:
        pieces = [text] if text else []
        for content in self.special:
            if content in text:
                split: list[str] = []
                for p in pieces:
                    for k, part in enumerate(p.split(content)) if p not in self.special else [(0, p)]:
                        split += [content] * (k > 0) + [part] * bool(part)
                pieces = split
        return pieces

    def _learn(self, fragments: list[bytes]) -> None:
        """Encode fragments that aren't known yet, each on its own.

        A word is one pre-token and goes to the library's merges at once. Another fragment without white space but for one leading space is
        closed off by a line feed on either side, so that many of them can go to the library in one call; the others go one by one.
        """
        words: list[bytes] = []
        plain: list[bytes] = []
        rest: list[bytes] = []
        for x in fragments:
            (words if _WORD.fullmatch(x) else rest if _UNSAFE.search(x) else plain).append(x)
        if words:
            tokenize = self.library.model.tokenize
            ids = [[t.id for t in tokenize(w)] for w in b"\n".join(words).decode("latin-1").translate(self.letters).split("\n")]
            self._keep(words, [b",".join([self.spelled[i] for i in own]) for own in ids], [b"".join([self.bytes_of[i] for i in own]) for own in ids])
        for at in range(0, len(plain), CALL):
            self._learn_plain(plain[at : at + CALL])
        for raw, e in zip(rest, self.library.encode_batch_fast([x.decode() for x in rest], add_special_tokens=False), strict=True):
            self._keep([raw], [b",".join([self.spelled[i] for i in e.ids])], [b"".join([self.bytes_of[i] for i in e.ids])])

    def _learn_plain(self, plain: list[bytes]) -> None:
        closed = b"\n" + b"\n".join(plain) + b"\n"
        (e,) = self.library.encode_batch_fast([closed.decode()], add_special_tokens=False)
        ids = e.ids
        feed = self.spelled[self.line_feed]
        spelled = b",".join([self.spelled[i] for i in ids])[len(feed) + 1 : -len(feed) - 1].split(b"," + feed + b",")
        back = b"".join([self.bytes_of[i] for i in ids])[1:-1].split(b"\n")
        if not len(spelled) == len(back) == len(plain):
            raise AssertionError("a fragment was not closed off by its line feeds")
        self._keep(plain, spelled, back)

    def _keep(self, raws: list[bytes], spelled: list[bytes], back: list[bytes]) -> None:
        self._enter(raws, spelled)
        if back != raws:
            self.decoded.update((raw, x) for raw, x in zip(raws, back, strict=True) if x != raw)

    def _enter(self, raws: list[bytes], spelled: list[bytes]) -> None:
        self.known.update(zip(raws, spelled, strict=True))
        self.taken += sum(map(len, raws)) + sum(map(len, spelled)) + _ENTRY * len(raws)

    def lookup(self, parts: set[bytes | str]) -> dict[bytes | str, bytes]:
        """Table that holds all ``parts``: decimal ids, joined by commas."""
        known, older = self.known, self.older
        new = parts - known.keys()
        if new:
            again = list(new & older.keys())
            self._enter(again, [older[p] for p in again])
            self._learn(list(new - older.keys()))
        return known

    def _rest(self) -> None:
        """When a generation is full it becomes the older one; what recurs comes back from there."""
        if self.taken > TABLE_BYTES // 2:
            self.older, self.known, self.taken = self.known, dict(self.fixed), 0
            self.decoded = {p: x for p, x in self.decoded.items() if p in self.older or p in self.fixed}

    def _spelled(self, texts: list[str | None]) -> Iterator[tuple[list[bytes | str], bytes]]:
        """Fragments and decimal ids of each text, window by window."""
        a = 0
        while a < len(texts):
            size, b = 0, a
            while b < len(texts) and (b == a or size + len(texts[b] or "") <= WINDOW):
                size += len(texts[b] or "")
                b += 1
            held = self.fragments([t or "" for t in texts[a:b]])
            known = self.lookup(set().union(*held))
            for parts in held:
                yield parts, b",".join(map(known.__getitem__, parts))
            self._rest()
            a = b

    def encode(self, text: str | None) -> list[int]:
        ((_, ids),) = self._spelled([text])
        return [int(i) for i in ids.split(b",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of ids, hash of the ids and hash of the decoded text of each text, fragment by fragment: no list of ids is made."""
        out = []
        for parts, ids in self._spelled(texts):
            other = self.decoded  # special tokens, and fragments that decode to something else
            back = parts if other.keys().isdisjoint(parts) else [other.get(p, p) for p in parts]
            decoded = b"".join(back).decode("utf-8", "replace").encode()
            out.append((ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return out

    def digest(self, text: str | None) -> tuple[int, str, str]:
        return self.digests([text])[0]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, made once in a worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_decode(text: Column, path: str) -> Column:
    """struct(n_tokens, ids, decoded) of each text."""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for texts in batches:
            ids = [c.encode(t) for t in texts]
            yield pd.DataFrame({"n_tokens": [len(x) for x in ids], "ids": ids, "decoded": [c.decode(x) for x in ids]})

    return run(text)


def encode_digest(text: Column, path: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256) of each text: ids and decoded text stay in the worker."""

    @F.pandas_udf(DIGEST)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for texts in batches:
            yield pd.DataFrame(c.digests(texts.tolist()), columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)
