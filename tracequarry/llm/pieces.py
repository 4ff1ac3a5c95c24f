"""SentencePiece encoding and decoding of whole texts with a BPE model, in vectorised merge rounds.

The library merges the pair of neighbouring symbols with the best score, the leftmost of equals,
until no pair is a piece. Here all distinct words of a batch lie in one array of symbols. A round
finds every word's least pair rank, merges the leftmost occurrences of it in all words at once and
compacts the array; words without a pair are done. An occurrence whose merge makes a pair that is
at least as good ends its word's round, since that pair comes first in the library's order too. So
the ids are the library's, whatever the scores.

Words begin at blanks, which no piece holds behind other letters, and at line ends; a word is cut
once more between letters that stand together in no piece. A worker remembers the ids of words.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.common import bounded_batches, released, text_slices

BLANK = "▁"
#: A word with the blanks before it, blanks before a line end, a line end.
WORDS = " *[^ \n]+| +|\n"
WHOLE = "(?s).+"
#: Rank of neighbours that make no piece.
APART = np.iinfo(np.int32).max
#: What decoding writes for a byte that belongs to no letter, and for the unknown piece.
REPLACED, UNKNOWN_SURFACE = "�", " ⁇ "

codecs.register_error("tracequarry.bytewise", lambda e: (REPLACED, e.start + 1))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of every range, in a row."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class PieceModel:
    """The tables of a model file. Models that normalise texts, treat blanks otherwise, lack byte
    pieces or hold user-defined pieces aren't covered and are refused."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kind = model.normalizer_spec, proto.ModelProto.SentencePiece
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or norm.precompiled_charsmap or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only BPE models without a normalisation table are covered")
        if norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep all blanks and put one before the text are covered")
        if not model.trainer_spec.byte_fallback or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("only models with byte pieces and without user-defined or unused ones are covered")
        self.begin, self.end = (next(i for i, p in enumerate(model.pieces) if p.piece == s) for s in (model.trainer_spec.bos_piece, model.trainer_spec.eos_piece))
        self.n = len(model.pieces)
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.byte_ids = np.zeros(256, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i

        # Symbols are piece ids; letters that are part of pieces only follow them, then comes the rest.
        letters = sorted({c for s in normal for c in s})
        more = {c: self.n + k for k, c in enumerate(c for c in letters if c not in normal)}
        self.other = self.n + len(more)
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        self.letter_symbols = np.array([normal.get(c, more.get(c)) for c in letters], np.int64)
        self.base = self.other + 1
        symbol = normal | more
        scores = np.array([p.score for p in model.pieces], np.float32)
        _, rank = np.unique(-scores, return_inverse=True)
        pairs = [(symbol[s[:k]] * self.base + symbol[s[k:]], i) for s, i in normal.items() for k in range(1, len(s)) if s[:k] in symbol and s[k:] in symbol]
        pairs.sort()
        self.pairs = np.array([k for k, _ in pairs], np.int64)
        self.merged = np.array([i for _, i in pairs], np.int64)
        self.ranks = rank[self.merged].astype(np.int32)
        beside = {symbol[s[k]] * self.base + symbol[s[k + 1]] for s in normal for k in range(len(s) - 1)}
        self.beside = np.array(sorted(beside), np.int64)
        fits = not any("\n" in s or " " in s or BLANK in s.lstrip(BLANK) for s in normal)
        self.words = re.compile(self._blocks(normal) + WORDS if fits else WHOLE)

        # Decoding: the bytes of every piece, and which pieces give up a blank at the start.
        surface = {kind.CONTROL: lambda p: b"", kind.UNKNOWN: lambda p: UNKNOWN_SURFACE.encode(), kind.BYTE: lambda p: bytes([int(p.piece[3:5], 16)])}
        parts = [surface.get(p.type, lambda p: p.piece.replace(BLANK, " ").encode())(p) for p in model.pieces]
        self.part_sizes = np.array([len(x) for x in parts], np.int64)
        self.part_starts = np.cumsum(self.part_sizes) - self.part_sizes
        self.parts = np.frombuffer(b"".join(parts), np.uint8)
        self.is_control = np.array([p.type == kind.CONTROL for p in model.pieces])
        self.is_byte = np.array([p.type == kind.BYTE for p in model.pieces])
        self.blank_first = np.array([p.type == kind.NORMAL and p.piece.startswith(BLANK) for p in model.pieces])

    def _blocks(self, normal: dict[str, int]) -> str:
        """A pattern that cuts the longest piece of blanks off long stretches of them. Where blanks
        merge from the left, what follows such a piece is as if nothing stood before it; whether
        that holds is tried out."""
        most = max((len(s) for s in normal if not s.strip(BLANK)), default=0)
        if most < 2:
            return ""
        ids = [self.ids_of_words([" " * n])[0].tolist() for n in range(3 * most + 1)]
        holds = ids[most] == [normal[BLANK * most]] and all(ids[n + most] == ids[most] + ids[n] for n in range(2 * most + 1))
        return f" {{{most}}}(?= {{{most}}})|" if holds else ""

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs of symbols and what they merge to."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        known = self.pairs[at] == key
        return np.where(known, self.ranks[at], APART), self.merged[at]

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over the symbols of all words (``word`` numbers them in rising order).
        Returns the last symbols and the place where each one begins, in order."""
        place = np.arange(len(symbols))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        same = np.append(word[1:] == word[:-1], False)
        rank, into = self._pair(symbols, np.append(symbols[1:], 0))
        rank[~same] = APART
        while len(symbols):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            least = np.repeat(least, sizes)
            over = least == APART
            if over.any():
                done.append((symbols[over], place[over]))
                keep = ~over
                symbols, word, place, rank, into, least = (x[keep] for x in (symbols, word, place, rank, into, least))
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == least)
            # Of overlapping pairs every other one, from the left.
            joined = np.append(False, np.diff(at) == 1)
            first = np.flatnonzero(~joined)
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
            at = self._before_better(symbols, word, least, into, at)
            symbols[at] = into[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word, place, rank, into = (x[keep] for x in (symbols, word, place, rank, into))
            now = at - np.arange(len(at))  # where the merged symbols are after compaction
            for some in (now, now[now > 0] - 1):
                right = np.minimum(some + 1, len(symbols) - 1)
                new, to = self._pair(symbols[some], symbols[right])
                new[(right == some) | (word[right] != word[some])] = APART
                rank[some], into[some] = new, to
        if not done:
            return symbols, place
        symbols, place = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place, kind="stable")
        return symbols[order], place[order]

    def _before_better(self, symbols: np.ndarray, word: np.ndarray, least: np.ndarray, into: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Those merges that the library makes before any other: in each word up to the first that
        makes a pair with a rank no greater than its own."""
        own, made, n = word[at], into[at], len(symbols)
        left_at, right_at = np.maximum(at - 1, 0), np.minimum(at + 2, n - 1)
        left = symbols[left_at]
        after_merge = np.append(False, at[1:] - at[:-1] == 2)  # the left neighbour was merged just now
        left = np.where(after_merge, np.append(made[:1], made[:-1]), left)
        to_left, _ = self._pair(left, made)
        to_right, _ = self._pair(made, symbols[right_at])
        to_left[(at == 0) | (word[left_at] != own)] = APART
        to_right[(at + 2 > n - 1) | (word[right_at] != own)] = APART
        better = np.minimum(to_left, to_right) <= least[at]
        if not better.any():
            return at
        # How many such merges lie before in the same word.
        before = np.cumsum(better) - better
        first = np.append(True, own[1:] != own[:-1])
        return at[before == np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(at))))]

    def ids_of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has. Blanks count as their sign."""
        if not any(words):
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        points = np.frombuffer("".join(words).replace(" ", BLANK).encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        symbols = np.where(self.letters[at] == points, self.letter_symbols[at], self.other)
        # Letters that no piece holds side by side never come together.
        key = symbols[:-1] * self.base + symbols[1:]
        near = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        cut = (word[1:] != word[:-1]) | (self.beside[near] != key)
        part = np.cumsum(np.append(0, cut))
        symbols, place = self.merge(symbols, part)
        plain = symbols < self.n
        if not plain.all():
            symbols, place = self._with_bytes(symbols, place, points, plain)
        return symbols.astype(np.uint32), np.bincount(word[place], minlength=len(words))

    def _with_bytes(self, symbols: np.ndarray, place: np.ndarray, points: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters that are no pieces become their bytes in UTF-8."""
        own = points[place[~plain]].astype(np.int64)
        sizes = np.ones(len(symbols), np.int64)
        sizes[~plain] = 1 + (own > 0x7F) + (own > 0x7FF) + (own > 0xFFFF)
        out = np.repeat(symbols, sizes)
        raw = np.frombuffer(own.astype(np.uint32).tobytes().decode("utf-32-le").encode(), np.uint8)
        out[np.repeat(~plain, sizes)] = self.byte_ids[raw]
        return out, np.repeat(place, sizes)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of documents whose ids lie in a row, as the library decodes lists of ids."""
        sizes = self.part_sizes[ids]
        raw = self.parts[_ranges(self.part_starts[ids], sizes)]
        # The first piece that isn't a control piece gives up its first blank.
        at = np.concatenate([[0], np.cumsum(sizes)])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        shown = np.append(np.flatnonzero(~self.is_control[ids]), len(ids))
        first = shown[np.searchsorted(shown, starts)]
        strip = np.zeros(len(ends), np.int64)
        inside = first < ends
        strip[inside] = self.blank_first[ids[first[inside]]]
        # A control piece shows nothing, but bytes on both sides of it make no letter together.
        between = np.flatnonzero(self.is_control[ids[1:]] & self.is_byte[ids[:-1]]) + 1
        apart = set(np.searchsorted(ends, between[~np.isin(between, ends - 1)], "right").tolist())
        data, out = raw.tobytes(), []
        for i, (a, b, skip) in enumerate(zip(at[starts].tolist(), at[ends].tolist(), strip.tolist(), strict=True)):
            try:
                text = None if i in apart else data[a + skip : b].decode()
            except UnicodeDecodeError:
                text = None
            out.append(self._broken(ids[starts[i] : ends[i]], skip) if text is None else text)
        return out

    def _broken(self, ids: np.ndarray, skip: int) -> str:
        """A text whose byte pieces don't all make letters: every other byte is replaced by itself."""
        change = np.flatnonzero(np.diff(self.is_byte[ids])) + 1
        runs = np.split(ids, change)
        raw = [b"".join(self.parts[self.part_starts[i] : self.part_starts[i] + self.part_sizes[i]].tobytes() for i in run) for run in runs]
        return "".join(x.decode(errors="tracequarry.bytewise") for x in raw)[skip:]


class WordIds:
    """Ids of words that a worker remembers: between batches at most ``most`` words with
    ``most_letters`` letters in all."""

    def __init__(self, model: PieceModel, most: int = 300_000, most_letters: int = 4_000_000):
        self.model, self.most, self.most_letters = model, most, most_letters
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.letters = 0
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row with begin and end ids, and where each text ends."""
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                own = self.model.words.findall(" " + text.replace(BLANK, " "))
                counts[i] = len(own)
                words += own
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(new) > self.most or self.letters > self.most_letters:
            self._forget()
            new = list(dict.fromkeys(words))
        if new:
            flat, sizes = self.model.ids_of_words(new)
            self.letters += sum(map(len, new))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
            self.sizes, self.flat = np.append(self.sizes, sizes), np.append(self.flat, flat)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[at]
        inner = self.flat[_ranges(self.starts[at], sizes)]
        ends = np.append(0, np.cumsum(sizes))[np.cumsum(counts)]
        n = len(texts)
        out = np.empty(len(inner) + 2 * n, np.uint32)
        stops = ends + 2 * np.arange(1, n + 1)
        begins = np.concatenate([[0], stops[:-1]]).astype(np.int64)
        mask = np.ones(len(out), bool)
        mask[stops - 1] = mask[begins] = False
        out[mask] = inner
        out[begins], out[stops - 1] = self.model.begin, self.model.end
        return out, stops


@lru_cache(maxsize=1)
def piece_model(path: str) -> PieceModel:
    """The tables of a model, kept by a worker for the tasks that follow (about 10 MB)."""
    return PieceModel(path)


def _binaries(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    where = 4 * np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(where.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())]).cast(pa.binary())


def _encode_task(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(piece_model(path))
        for whole in batches:
            for batch in text_slices(whole, "text"):
                ids, ends = encoder.encode(batch.column("text").to_pylist())
                counts = np.diff(np.concatenate([[0], ends])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), _binaries(ids, ends)], ["doc_id", "n_tokens", "ids"])

    return run


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """Encode every whole text with the begin and end ids: ``doc_id``, ``n_tokens`` (all ids) and
    ``ids``, little-endian unsigned 32-bit integers.

    Null counts as empty: the begin and end ids only. Every row gives a row, so ids may be null or
    repeat; columns other than ``doc_id`` and ``text`` aren't read; no rows give no rows. Nothing
    is shuffled. A task holds a slice of texts of about 1 MB, or one longer text, and the words
    that it remembers.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(released(_encode_task(model)), "doc_id long, n_tokens long, ids binary")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """Add ``decoded``, the text of every row's ``ids``, to a table; a column of that name is
    replaced. Null ids are null texts; ids beyond the model's raise an error."""
    keep = [f for f in encoded.schema.fields if f.name != "decoded"]
    names = [f.name for f in keep]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = piece_model(model)
        for whole in batches:
            for batch in text_slices(whole, "ids"):
                raw = batch.column("ids").to_pylist()
                ids = np.frombuffer(b"".join(x or b"" for x in raw), "<u4").astype(np.int64)
                ends = np.cumsum([len(x or b"") // 4 for x in raw])
                texts = tables.decode(ids, ends)
                texts = [None if x is None else t for x, t in zip(raw, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, "decoded"])

    return encoded.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(released(run), f"{ddl}, decoded string")
