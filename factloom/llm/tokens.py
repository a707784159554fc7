"""Ids of the public byte-level BPE vocabulary, many texts at once.

The vocabulary's pre-tokens are found in numpy over code points; each distinct
one of a batch is encoded once and its ids copied to where it occurs.  Texts
with an apostrophe (contractions), a special token of the vocabulary or code
points from U+0250 on are encoded by the library as they stand.  A special token
in a text is its id, as `tokenizers` reads it by default; with an empty
`specials` it is ordinary text.  Tests hold the ids against `tokenizers`.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

from .memory import dropped_when_done

_SIMPLE = 0x250


SPECIALS = (("<|endoftext|>", 50256),)


@lru_cache(maxsize=2)
def _encoding(path: str, specials: tuple[tuple[str, int], ...]):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(specials))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """0 letter, 1 number, 2 white space, 3 other."""
    out = np.full(_SIMPLE, 3, np.uint8)
    for c in range(_SIMPLE):
        kind = unicodedata.category(chr(c))[0]
        out[c] = 0 if kind == "L" else 1 if kind == "N" else 2 if chr(c).isspace() and not 0x1C <= c <= 0x1F else 3
    return out


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(texts: list[str], path: str | None = None, close: int | None = None, specials: tuple[tuple[str, int], ...] = SPECIALS) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and their offsets; `close` ends each text."""
    enc = _encoding(path or ranks_path(), specials)
    tail = [] if close is None else [close]
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    plain = [i for i, c in enumerate(codes) if len(c) and int(c.max()) < _SIMPLE and not (c == 39).any() and not any(s in texts[i] for s, _ in specials)]
    parts: list = [None] * len(texts)
    chosen = set(plain)
    for i, t in enumerate(texts):
        if i not in chosen:
            parts[i] = np.array(enc.encode(t, allowed_special="all") + tail, np.uint32)
    if plain:
        ids, offsets = _encode_plain([texts[i] for i in plain], [codes[i] for i in plain], enc, tail)
        for k, i in enumerate(plain):
            parts[i] = ids[offsets[k] : offsets[k + 1]]
    counts = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.concatenate(([0], np.cumsum(counts)))


class _Known:
    """Ids of pre-tokens met before in this process, by hash; starts anew beyond `most` of them."""

    def __init__(self, most: int = 1 << 20):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def look_up(self, keys, starts, ends, texts, enc):
        """Place in `flat` and number of the ids of each of these distinct pre-tokens."""
        if len(self.keys) + len(keys) > self.most:
            self.clear()
        spot = np.searchsorted(self.keys, keys)
        fresh = np.ones(len(keys), bool)
        inside = spot < len(self.keys)
        fresh[inside] = self.keys[spot[inside]] != keys[inside]
        if fresh.any():
            whole, encode_ = "".join(texts), enc._core_bpe.encode_ordinary
            found = [encode_(whole[a:b]) for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)]
            size = np.fromiter(map(len, found), np.int64, len(found))
            at = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))))
            where = spot[fresh]
            self.keys, self.at, self.size = np.insert(self.keys, where, keys[fresh]), np.insert(self.at, where, at), np.insert(self.size, where, size)
            spot = np.searchsorted(self.keys, keys)
        return self.at[spot], self.size[spot], self.flat


_known = _Known()
dropped_when_done(_known.clear)


def _encode_plain(texts: list[str], codes: list[np.ndarray], enc, tail: list[int]) -> tuple[np.ndarray, np.ndarray]:
    from .rolling import Prefix, byte_values, mix

    c = np.concatenate(codes)
    n = len(c)
    begin = np.concatenate(([0], np.cumsum([len(x) for x in codes])))
    kind = _classes()[c]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new[begin[:-1]] = True
    # of a run of white space before something else the last one stands apart; a blank joins what follows
    space = kind == 2
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:]
    last[begin[1:] - 1] = False
    new[last] = True
    after = np.flatnonzero(last & (c == 32)) + 1
    new[after] = False
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    symbols = byte_values(1)[c & 0xFF] + byte_values(3)[c >> 8]
    keys = mix(Prefix(symbols).span(starts, ends))
    distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
    at, size, flat = _known.look_up(distinct, starts[first], ends[first], texts, enc)
    piece_size = size[which]
    out_at = np.concatenate(([0], np.cumsum(piece_size)))
    ids = flat[np.repeat(at[which] - out_at[:-1], piece_size) + np.arange(out_at[-1])]
    doc_at = out_at[np.searchsorted(starts, begin)]
    if tail:
        ids = np.insert(ids, np.repeat(doc_at[1:], len(tail)), tail * (len(begin) - 1))
        doc_at = doc_at + len(tail) * np.arange(len(begin))
    return ids, doc_at
