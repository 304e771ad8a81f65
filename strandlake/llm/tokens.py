"""Token ids of whole documents under a word-level BPE tokenizer file, at the speed of a look-up per distinct word.

The tokenizer lower-cases, splits text into words, and encodes each on its own,
so equal words have equal ids.  Words are found and hashed in numpy over whole
columns; only words not met before are encoded.  Documents with anything that
this plain path does not cover (other alphabets, controls, apostrophes, special
tokens) go through the tokenizers library itself.
"""

from __future__ import annotations

import json
import os

import numpy as np

from strandlake.llm._text import LOWER, span_hashes, spans

#: Distinct words that a worker remembers; beyond, it starts anew, which costs time only.
REMEMBERED = 500_000

# bytes of the plain path: space, tab, newline, carriage return; letters; digits; other printable ASCII but the apostrophe
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[[9, 10, 13, 32]] = _SPACE
_KIND[33:127] = _MARK
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = _LETTER
_KIND[39] = _ODD


def _latin_table() -> np.ndarray:
    """By the two UTF-8 bytes of a letter of U+00C0 to U+024F, those of its lower case; 0 for what is no letter or changes its width."""
    table = np.zeros(1 << 16, np.uint16)
    for point in range(0xC0, 0x250):
        low = chr(point).lower()
        if chr(point).isalpha() and len(low) == 1 and 0xC0 <= ord(low) < 0x250:
            table[int.from_bytes(chr(point).encode(), "big")] = int.from_bytes(low.encode(), "big")
    return table


_LATIN = _latin_table()


def byte_names() -> dict[str, int]:
    """The printable stand-ins of bytes that byte-level BPE files use, by rule: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    """Encodes documents with a tokenizers file whose model is byte-level BPE over words with an end-of-word suffix."""

    _loaded: dict[str, "WordTokenizer"] = {}

    @classmethod
    def load(cls, path: str) -> "WordTokenizer":
        """One tokenizer a process and path."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names, special = byte_names(), {x["id"] for x in spec["added_tokens"]}
        # byte 255 is in no UTF-8 text, so it can stand for the end of a word
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if i not in special:
                ends = token.endswith("</w>")
                ranks[bytes(names[c] for c in (token[:-4] if ends else token)) + b"\xff" * ends] = i
        self.core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, spellings: list[bytes]) -> None:
        encode = self.core.encode_single_piece
        lists = [encode(w + b"\xff") for w in spellings]
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in lists for i in x), np.uint32, int(count.sum()))])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.first, self.count = known[order], np.concatenate([self.first, first])[order], np.concatenate([self.count, count])[order]

    def _look_up(self, uniq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.known):
            return np.zeros(len(uniq), np.int64), np.zeros(len(uniq), bool)
        at = np.searchsorted(self.known, uniq)
        at[at == len(self.known)] = 0
        return at, self.known[at] == uniq

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each UTF-8 document data[offsets[i]:offsets[i+1]], as the library gives them without special tokens added."""
        n = len(offsets) - 1
        kind = _KIND[data]
        odd = kind == _ODD
        after = np.r_[data[1:], np.uint8(0)]
        odd |= (data == 0x3C) & (after == 0x7C)  # a special token may start here
        low = LOWER[data]
        high = data >= 0x80
        if high.any():
            lead = data >= 0xC0
            pairs = np.flatnonzero(lead)
            lower = _LATIN[data[pairs].astype(np.int64) << 8 | after[pairs]]
            odd[pairs] = lower == 0
            odd |= high & ~lead & ~np.r_[False, lead[:-1]]
            fine = pairs[lower != 0]
            lower = lower[lower != 0]
            low[fine], low[fine + 1] = lower >> 8, lower & 255
        bad = np.r_[0, np.cumsum(odd)]
        plain = bad[offsets[1:]] == bad[offsets[:-1]]
        inside = kind != _SPACE
        starts, ends = spans(inside, offsets)
        # a word is a run of letters, a single digit or a run of marks
        edge = np.zeros(len(low) + 1, bool)
        edge[starts], edge[ends] = True, True
        edge[1:-1] |= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        edges = np.flatnonzero(edge)
        starts, ends = edges[:-1], edges[1:]
        keep = inside[starts]
        starts, ends = starts[keep], ends[keep]
        doc = np.searchsorted(offsets, starts, "right") - 1
        keep = plain[doc]
        starts, ends, doc = starts[keep], ends[keep], doc[keep]
        ids, sizes = np.zeros(0, np.uint32), np.zeros(n, np.int64)
        if len(starts):
            uniq, some, back = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
            at, have = self._look_up(uniq)
            if not have.all():
                raw = low.tobytes()
                if len(self.known) + int((~have).sum()) > REMEMBERED:
                    self._forget()
                    have[:] = False
                new = some[~have]
                self._learn(uniq[~have], [raw[a:b] for a, b in zip(starts[new], ends[new])])
                at, _ = self._look_up(uniq)
            first, count = self.first[at][back], self.count[at][back]
            total = int(count.sum())
            ids = self.ids[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)]
            sizes = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
        out = np.split(ids, np.cumsum(sizes)[:-1])
        for i in np.flatnonzero(~plain):
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
            out[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return out
