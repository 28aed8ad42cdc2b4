"""Byte-level BPE ids of whole texts, by the tokenizers library, with each distinct piece encoded once.

The tokenizer cuts a text by a pattern before it merges bytes, so a text may be cut wherever that pattern
always cuts, and the ids of the pieces joined are the ids of the text. `PieceEncoder` cuts before a space,
comma, full stop or line break where this holds, encodes pieces that it hasn't met, and looks up the rest.
Documents in which a cut would not be safe (runs of white space, punctuation after punctuation, NUL) are
encoded whole. The cache only saves time: when it holds `limit` pieces, those met only once are let go.
"""

from __future__ import annotations

import array
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from mediasift.llm.common import worker_cache

CUT, DOCUMENT = "\x00", "\x01document\x01"
CUT_BEFORE = (" ", ",", ".", "\n")
BLANKS = (" ", "\n")
BATCH_BYTES = 1_000_000
#: What a piece asks of the piece before it, and offers to the one after it.
BAD, WANTS_ALNUM, WANTS_INK, ENDS_ALNUM, ENDS_INK = 1, 2, 4, 8, 16


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 bytes stand for themselves, others for code points from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


LETTERS = _byte_letters()


class _Slots(dict):
    """Piece to slot number; a new piece gets the next slot and is noted in `new`."""

    def __init__(self, pieces: list[str]):
        super().__init__(zip(pieces, range(len(pieces)), strict=True))
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = slot = len(self)
        self.new.append(piece)
        return slot


class PieceEncoder:
    """Encodes batches of texts; one lives in each Python worker and tokenizer file."""

    @classmethod
    def of(cls, path: str, limit: int = 300_000) -> PieceEncoder:
        return worker_cache(("pieces", path, limit), lambda: cls(path, limit))

    def __init__(self, path: str, limit: int):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.limit = limit
        self.break_ids = self.direct(["\n"])[0]
        self.clear()

    def clear(self) -> None:
        self._hold([DOCUMENT], np.zeros(0, np.uint32), np.zeros(1, np.int64), np.full(1, ENDS_ALNUM | ENDS_INK, np.int8))

    def _hold(self, pieces: list[str], flat: np.ndarray, lengths: np.ndarray, flags: np.ndarray) -> None:
        self.slots = _Slots(pieces)
        self.flat, self.start, self.length, self.flags = array.array("I"), array.array("q"), array.array("q"), array.array("b")
        self.uses = np.zeros(len(pieces), np.int64)
        self._add(flat, lengths, flags)

    def _shrink(self) -> None:
        """Keep the pieces that were met again, the most frequent half of `limit` of them."""
        keep = self.uses >= 2
        if keep.sum() > self.limit // 2:
            keep[np.argsort(-self.uses, kind="stable")[self.limit // 2 :]] = False
        keep[0] = True
        lengths, flags, flat = np.array(self.length), np.array(self.flags), np.array(self.flat)
        self._hold(list(compress(self.slots, keep.tolist())), flat[np.repeat(keep, lengths)], lengths[keep], flags[keep])

    def direct(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def flag(piece: str) -> int:
        if not piece:
            return ENDS_ALNUM | ENDS_INK  # only at the start of a text
        last, head = piece[-1], piece[0]
        f = ENDS_ALNUM | ENDS_INK if last.isalnum() else 0 if last.isspace() else ENDS_INK
        if head == " ":
            return f | (BAD if len(piece) < 2 or piece[1].isspace() else 0)
        return f | (WANTS_INK if head == "\n" else WANTS_ALNUM if head in ",." else 0)

    def _learn(self) -> None:
        """Encode the pieces met for the first time, in the order of their slots."""
        tokenize, new = self.tokenizer.model.tokenize, self.slots.new
        ids: list[list[int]] = [[]] * len(new)
        words, bodies, other, flags = [], [], [], np.full(len(new), ENDS_ALNUM | ENDS_INK, np.int8)
        for i, p in enumerate(new):
            if (p[1:] if p[:1] in BLANKS else p).isalpha():  # one piece of the tokenizer's pattern: only the merges are needed
                words.append(i)
                bodies.append(p[1:] if p[0] == "\n" else p)
            else:
                other.append(i)
                flags[i] = self.flag(p)
        letters = "\n".join(bodies).encode().decode("latin-1").translate(LETTERS).split(LETTERS[ord("\n")])
        for i, body in zip(words, letters, strict=False):  # no words: one empty body
            ids[i] = [t.id for t in tokenize(body)]
            if new[i][0] == "\n":
                ids[i][:0] = self.break_ids
                flags[i] |= WANTS_INK
        for k in range(0, len(other), 4096):
            for i, got in zip(other[k : k + 4096], self.direct([new[i] for i in other[k : k + 4096]]), strict=True):
                ids[i] = got
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self._add(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths, flags)
        self.uses = np.append(self.uses, np.zeros(len(new), np.int64))
        new.clear()

    def _add(self, flat: np.ndarray, lengths: np.ndarray, flags: np.ndarray) -> None:
        self.start.frombytes((len(self.flat) + np.cumsum(lengths) - lengths).tobytes())
        self.length.frombytes(lengths.tobytes())
        self.flags.frombytes(flags.tobytes())
        self.flat.frombytes(flat.tobytes())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end as uint32, offsets of n + 1 texts); null is empty."""
        parts, sizes = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        i = 0
        while i < len(texts):
            k = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BATCH_BYTES)) + 1
            self._encode(texts.slice(i, k - i), parts, sizes)
            i = k
        return np.concatenate(parts), np.cumsum(np.concatenate(sizes))

    def _encode(self, texts: pa.Array, parts: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        if len(self.slots) > self.limit:
            self._shrink()
        marked = pc.or_(pc.match_substring(texts, CUT), pc.match_substring(texts, DOCUMENT))
        whole = marked.to_numpy(zero_copy_only=False).copy()
        cut = pc.if_else(marked, "", texts) if whole.any() else texts
        for c in CUT_BEFORE:
            cut = pc.replace_substring(cut, c, CUT + c)
        lists = pc.split_pattern(cut, CUT)
        coded = lists.values.dictionary_encode()
        at = lists.offsets.to_numpy()[:-1] + np.arange(len(texts))  # a mark stands before each document
        inner = np.ones(len(coded) + len(texts), bool)
        inner[at] = False
        distinct = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), CUT)[0].as_py().split(CUT)
        slot = np.fromiter(map(self.slots.__getitem__, distinct), np.int32, len(distinct))
        piece = np.zeros(len(inner), np.int32)
        piece[inner] = slot[coded.indices.to_numpy()]
        del cut, lists, coded, inner, distinct
        self._learn()
        self.uses += np.bincount(piece, minlength=len(self.uses))
        flags = np.frombuffer(self.flags, np.int8)[piece]
        wants, gives = flags[1:], flags[:-1]
        unsafe = (flags & BAD) > 0
        unsafe[1:] |= ((wants & WANTS_ALNUM) > 0) & ((gives & ENDS_ALNUM) == 0) | ((wants & WANTS_INK) > 0) & ((gives & ENDS_INK) == 0)
        whole[np.searchsorted(at, np.flatnonzero(unsafe), "right") - 1] = True
        lengths = np.frombuffer(self.length, np.int64)[piece].astype(np.int32)
        if whole.any():
            lengths[np.repeat(whole, np.diff(np.append(at, len(piece))))] = 0
        ends = np.cumsum(lengths, dtype=np.int64)
        take = np.repeat(np.frombuffer(self.start, np.int64)[piece] - (ends - lengths), lengths)
        take += np.arange(len(take))
        ids = np.frombuffer(self.flat, np.uint32)[take]
        size = np.add.reduceat(lengths, at, dtype=np.int64)
        if whole.any():
            offsets, last = np.concatenate([[0], np.cumsum(size)]), 0
            places = np.flatnonzero(whole)
            for i, got in zip(places, self.direct(texts.take(pa.array(places)).to_pylist()), strict=True):
                parts += [ids[offsets[last] : offsets[i]], np.array(got, np.uint32)]
                size[i], last = len(got), i + 1
            ids = ids[offsets[last] :]
        parts.append(ids)
        sizes.append(size)


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same documents, each with the id `end` appended."""
    n = len(offsets) - 1
    out = np.empty(len(ids) + n, np.uint32)
    ends = offsets[1:] + np.arange(n)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask] = ids
    out[ends] = end
    return out, offsets + np.arange(n + 1)
