"""Encoding of whole texts by a public tokenizer, piece by piece.

A pre-tokenizer cuts a text before its merges run, so equal pieces always give equal ids. Texts
are cut at single blanks and line feeds; every distinct piece passes through the tokenizers
library once while it is remembered, and texts are put together from the pieces' ids. Pieces
are found again by 64-bit hashes of their bytes, computed on all texts of a slice at once, so a
remembered piece costs a few numbers and no Python object.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Byte-level pre-tokenizers keep one blank before a word. Where a text has other white space
#: than single blanks and line feeds between words, it is encoded in one go.
ODD = "[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|^[ \\n]|[ \\n]$|[ \\n][ \\n]"
#: Longer pieces (bytes) aren't remembered; the texts that hold them are encoded in one go.
LONGEST = 400
#: Bytes of text that are hashed at once; a longer text is a slice of its own.
SLICE = 1_000_000
#: A word of Latin letters, whose pre-token is the word itself, and full stops and commas after it.
PLAIN = re.compile("([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([,.]*)")

_RNG = np.random.Generator(np.random.PCG64(0x70C5))
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64, False)
_BASE = int(_RNG.integers(0, 1 << 64, dtype=np.uint64)) | 1
_BACK = pow(_BASE, -1, 1 << 64)


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level pre-tokenizers write for bytes: printable ones stay, the
    others follow each other from 256 on."""
    stay = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in stay)
    return {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BACK, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


#: Kept for slices of the usual size; a longer text makes its own.
_POWERS = _steps(SLICE + 1)


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece ``raw[start:end]``."""
    up, down = _POWERS if len(raw) < len(_POWERS[0]) else _steps(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    x = (sums[ends] - sums[starts]) * down[starts]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PieceEncoder:
    """Encodes batches of texts; ``max_pieces`` bounds what a worker remembers (about 60 bytes a
    piece)."""

    def __init__(self, path: str, max_pieces: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pre = self.tokenizer.pre_tokenizer
        self.drops_space = self._ids_of("a b") == self._ids_of("a\n\n b") and self._ids_of("a b") == self._ids_of("a") + self._ids_of("b")
        self.keeps_blank = not self.drops_space and "ByteLevel" in type(pre).__name__
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: What Latin words pass through before the model: nothing but lower case.
        self.lowers = self._normal("Éa") == "éa"
        self.plain = type(self.tokenizer.model).__name__ == "BPE" and (self.drops_space or self.keeps_blank) and self._plain_fits()
        self.max_pieces = max_pieces
        self.tails: dict[str, list[int]] = {}
        self._forget()

    def _normal(self, text: str) -> str:
        normalizer = self.tokenizer.normalizer
        return normalizer.normalize_str(text) if normalizer is not None else text

    def _plain_fits(self) -> bool:
        """Whether the short way of ``_plain_ids`` gives the library's ids on a few words."""
        blank = " " if self.keeps_blank else ""
        return all(self._plain_ids(blank, word, "") == self._ids_of(blank + word) for word in ("and", "The", "öffnen", "Àé", "ÿ", "zürich", "ßÐ"))

    def _ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.index = pd.Index(np.zeros(0, np.uint64))
        self.ends = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _plain_ids(self, before: str, word: str, tail: str) -> list[int]:
        """Ids of a word of Latin letters: the model's for the one pre-token that it is."""
        if self.lowers:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_LETTERS)
        if before == " ":
            word = _LETTERS[32] + word
        ids = [t.id for t in self.tokenizer.model.tokenize(word)]
        if before == "\n":
            ids = self._tail(before) + ids
        return ids + self._tail(tail) if tail else ids

    def _tail(self, text: str) -> list[int]:
        if text not in self.tails:
            if len(self.tails) > 1000:
                self.tails = {}
            self.tails[text] = self._ids_of(text)
        return self.tails[text]

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        found: list[list[int]] = []
        hard: list[int] = []
        match, plain = PLAIN.fullmatch, self._plain_ids
        texts = [p.decode() for p in pieces]
        for i, text in enumerate(texts):
            m = match(text) if self.plain else None
            if m is None:
                hard.append(i)
                found.append([])
            else:
                found.append(plain(*m.groups()))
        for k in range(0, len(hard), 2000):
            some = hard[k : k + 2000]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([texts[i] for i in some], add_special_tokens=False), strict=True):
                found[i] = e.ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((x for ids in found for x in ids), np.uint32, int(sizes.sum()))
        self.index = self.index.append(pd.Index(hashes))
        self.ends = np.concatenate([self.ends, len(self.flat) + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, flat])

    def _pieces(self, raw: np.ndarray, bounds: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of all texts but those in ``skip`` start and end, in order. With a
        byte-level pre-tokenizer the blank or line feed before a word is part of its piece."""
        apart = (raw == 32) | (raw == 10)
        first = np.zeros(len(raw) + 1, bool)
        first[bounds[:-1]] = np.diff(bounds) > 0
        first = first[:-1]
        if self.keeps_blank:
            starts = np.flatnonzero(apart | first)
            ends = np.append(starts[1:], len(raw))
        else:
            inside = ~apart
            before = np.concatenate([[False], inside[:-1]])
            starts = np.flatnonzero(inside & (~before | first))
            after = np.concatenate([inside[1:], [False]])
            last = np.concatenate([first[1:], [True]])
            ends = np.flatnonzero(inside & (~after | last)) + 1
        if skip.any():
            keep = ~skip[np.searchsorted(bounds, starts, "right") - 1]
            starts, ends = starts[keep], ends[keep]
        return starts, ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text ends. Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        ids, ends, at, done = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0, 0
        while at < len(texts):
            stop = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at : at + 100_000]), SLICE, "right")))
            some, where = self._encode(texts.slice(at, stop - at))
            ids.append(some)
            ends.append(where + done)
            at, done = stop, done + len(some)
        return np.concatenate(ids), np.concatenate(ends)

    def _whole(self, texts: pa.Array) -> np.ndarray:
        if self.drops_space:
            whole = np.zeros(len(texts), bool)
        elif self.keeps_blank:
            whole = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        else:
            whole = np.ones(len(texts), bool)
        for s in self.specials:
            if self.keeps_blank or " " in s or "\n" in s:
                whole = whole | pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return whole

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        bounds = offsets - offsets[0]
        whole = self._whole(texts)
        starts, ends = self._pieces(raw, bounds, whole)
        long = ends - starts > LONGEST
        if long.any():
            whole[np.searchsorted(bounds, starts[long], "right") - 1] = True
            keep = ~whole[np.searchsorted(bounds, starts, "right") - 1]
            starts, ends = starts[keep], ends[keep]
        where = self._places(raw, starts, ends)
        sizes = np.diff(self.ends, prepend=0)[where]
        piece_ends = np.cumsum(sizes)
        total = int(piece_ends[-1]) if len(sizes) else 0
        kind = np.int32 if max(total, len(self.flat)) < 1 << 31 else np.int64
        take = np.arange(total, dtype=kind) + np.repeat((self.ends[where] - piece_ends).astype(kind), sizes)
        ids = self.flat[take]
        # Pieces lie within one text, in order.
        text_ends = np.concatenate([[0], piece_ends])[np.searchsorted(starts, bounds[1:])]
        return self._merge(texts, whole, ids, text_ends) if whole.any() else (ids, text_ends)

    def _places(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The places of all pieces in what is remembered; unknown ones are learned."""
        codes, distinct = pd.factorize(_hashes(raw, starts, ends))
        at = self.index.get_indexer(distinct)
        if len(new := np.flatnonzero(at < 0)):
            if len(self.index) + len(new) > self.max_pieces:  # a slice has fewer pieces than bytes
                self._forget()
                new = np.arange(len(distinct))
            example = np.zeros(len(distinct), np.int64)
            example[codes[::-1]] = np.arange(len(codes))[::-1]
            text = raw.tobytes()
            spans = zip(starts[example[new]].tolist(), ends[example[new]].tolist(), strict=True)
            self._learn(distinct[new], [text[a:b] for a, b in spans])
            at = self.index.get_indexer(distinct)
        return at[codes]

    def _merge(self, texts: pa.Array, whole: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, lengths, before = [], [], 0
        for i, end in enumerate(ends.tolist()):
            part = np.array(self._ids_of(texts[i].as_py()), np.uint32) if whole[i] else ids[before:end]
            parts.append(part)
            lengths.append(len(part))
            before = end
        return np.concatenate(parts).astype(np.uint32), np.cumsum(np.array(lengths, np.int64))


_KEPT: dict[str, PieceEncoder] = {}


def encoder(path: str, max_pieces: int = 800_000, keep: bool = False) -> PieceEncoder:
    """An encoder for one task: what it remembers goes with it, since workers outlive their tasks.
    With ``keep`` the worker holds it for the tasks that follow, that of the vocabulary file used
    last only; ``max_pieces`` bounds it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if not keep:
        return PieceEncoder(path, max_pieces)
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = PieceEncoder(path, max_pieces)
    return _KEPT[path]


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to every document."""
    n = len(ends)
    out = np.full(len(ids) + n, end_id, np.uint32)
    new_ends = ends + np.arange(1, n + 1)
    mask = np.ones(len(out), bool)
    mask[new_ends - 1] = False
    out[mask] = ids
    return out, new_ends
