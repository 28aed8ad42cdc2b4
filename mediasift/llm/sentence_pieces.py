"""SentencePiece ids of whole texts by a table of prefixes, and texts from ids.

In a BPE vocabulary every prefix of a word has one encoding, and so one last token. `PrefixTable` finds all tokens that
end at each place by an automaton, and of these the one that is compatible with the last token of the prefix before
it; the ids are then read backwards from the word's end. Two tokens are compatible if encoding their joined
text gives the two again: their merges are undone from the last one back, and no token across the border may come
before the merge undone last.

Words are cut where no token of the vocabulary reaches across: before white space (U+2581 in the vocabulary), around
letters that the vocabulary lacks, and between a letter and punctuation where the vocabulary allows it. Those of a
batch are tabled together, all prefixes of one length at a time, and kept for later batches; only time depends on what
is kept. Runs of white space, whose tokens all have one score, are merged from the left by a stack; letters that are
not in the vocabulary become bytes.

Models: BPE with byte fallback, no normalisation, white space first in a word, scores that order all tokens but
runs of white space; any other model raises an error. Null texts are empty; an empty text has no ids but the end. Very long texts
and words are encoded whole, words beyond `TABLE_CHARS` one place at a time. Repeated rows are encoded each. Other columns
pass through; one that has the new column's name is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import array
import re
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mediasift.llm.common import give_back, worker_cache

SPACE, LETTERS, PUNCTUATION = "▁", "A-Za-zÀ-ɏ", ",.;:!?\"')(-"
#: Characters of text encoded together, of the longest word that is tabled, segments that a worker keeps.
BATCH_CHARS, TABLE_CHARS, KEEP = 1_000_000, 64, 300_000
NONE = 1 << 30


def _merged(word: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """The last two tokens that merge to the whole of word, if it is its own encoding."""
    parts, last = list(word), None
    while len(parts) > 1:
        best, k = min((rank.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best == NONE:
            return None
        last = (parts[k], parts[k + 1])
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return last


class Pairs:
    """Numbers by key (0 or more), in an open hash table that looks up arrays of keys."""

    def __init__(self, keys: list[int], values: list[int]):
        self.bits = max(10, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        left, number = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(left)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = left[free]
            placed = self.keys[slot] == left  # of several keys at a slot the last one stays
            self.values[slot[placed]] = number[placed]
            left, number, slot = left[~placed], number[~placed], (slot[~placed] + 1) % len(self.keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF) >> (63 - self.bits)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, NONE where there is none."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], NONE)
        rest = np.flatnonzero((held != keys) & (held >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) % len(self.keys)
            held = self.keys[slot[rest]]
            out[rest] = np.where(held == keys[rest], self.values[slot[rest]], NONE)
            rest = rest[(held != keys[rest]) & (held >= 0)]
        return out


class _Slots(dict):
    """Segment to slot number; a new segment gets the next slot and is noted in `new`."""

    def __init__(self, segments: list[str]):
        super().__init__(zip(segments, range(len(segments)), strict=True))
        self.new: list[str] = []

    def __missing__(self, segment: str) -> int:
        self[segment] = slot = len(self)
        self.new.append(segment)
        return slot


class PrefixTable:
    """A model's vocabulary, its merges and its automaton. Tokens are numbered by rank: letters first, then merges in their order.

    The automaton is the trie of the tokens read backwards; walked from every place of the text at once, it names all
    tokens that end there.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        usable = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in usable}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end_id, self.runs = sp.eos_id(), {len(p): i for p, i in pieces.items() if not p.strip(SPACE)}
        letters = [p for p in pieces if len(p) == 1]
        merges = sorted((p for p in pieces if len(p) > 1 and p.strip(SPACE)), key=lambda p: -sp.get_score(pieces[p]))
        self._check(sp, pieces, merges)
        self.letters, rank = len(letters), {p: n for n, p in enumerate(letters + merges)}
        self.n, self.space, self.ids = len(rank), rank[SPACE], np.array([pieces[p] for p in rank], np.int32)
        self.lengths = np.array([len(p) for p in rank], np.int64)
        self.left, self.right = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        tokens, pairs = {p: t for p, t in rank.items() if len(p) == 1}, {}
        for p in merges:
            split, t = _merged(p, rank), rank[p]
            if split is None:
                continue  # never an encoding's token
            tokens[p] = t
            self.left[t], self.right[t] = rank[split[0]], rank[split[1]]
            if max(self.left[t], self.right[t]) >= max(t, self.letters):
                raise ValueError(f"token {p!r} comes before its parts")
            pairs |= {rank[p[:k]] * self.n + rank[p[k:]]: t for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank}
        self.pairs = Pairs(list(pairs), list(pairs.values()))
        self._automaton(tokens, rank)
        known = "".join(map(re.escape, sorted(set(letters) - {SPACE})))
        self.parts = re.compile(f"{SPACE}+[{known}]*|[{known}]+|[^{SPACE}{known}]+")
        self.plain = re.compile(f"{SPACE}?[{known}]+")
        self.segments = self._segments(pieces)
        self.clear()

    def _automaton(self, tokens: dict[str, int], rank: dict[str, int]) -> None:
        states, edges = {"": 0}, {}
        for p in tokens:
            for k in range(len(p) - 1, -1, -1):
                states.setdefault(p[k:], len(states))
                edges[states[p[k + 1 :]] * self.letters + rank[p[k]]] = states[p[k:]]
        self.edges = Pairs(list(edges), list(edges.values()))
        self.token = np.array([tokens.get(p, -1) for p in states], np.int32)  # of the state, if it is a whole token
        self.letter = np.full(0x110000, -1, np.int32)
        for p, t in rank.items():
            if len(p) == 1:
                self.letter[ord(p)] = t

    def matches(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(last place, token) of every token in the text, in no order."""
        codes = self.letter[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int64)
        at, found = np.flatnonzero(codes >= 0), []
        end, state = at, codes[at]
        state = self.edges[state].astype(np.int64)
        while len(end):
            token = self.token[state]
            whole = token >= 0
            found.append((end[whole], token[whole]))
            on = np.flatnonzero(at > 0)
            on = on[codes[at[on] - 1] >= 0]
            at, end, state = at[on] - 1, end[on], self.edges[state[on] * self.letters + codes[at[on] - 1]].astype(np.int64)
            on = state != NONE
            at, end, state = at[on], end[on], state[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int64)

    @staticmethod
    def _check(sp, pieces: dict[str, int], merges: list[str]) -> None:
        """Raise unless words can be cut before white space and tokens are told apart by score."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        plain = spec.add_dummy_prefix and spec.escape_whitespaces and not (spec.precompiled_charsmap or spec.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix)
        scores = [sp.get_score(pieces[p]) for p in merges]
        run_scores = {sp.get_score(i) for p, i in pieces.items() if not p.strip(SPACE) and len(p) > 1}
        user = any(p.type == 4 for p in model.pieces)
        ordered = len(set(scores)) == len(scores) and len(run_scores) <= 1 and (not run_scores or not scores or max(run_scores) < min(scores))
        if not (trainer.model_type == 2 and trainer.byte_fallback and plain and ordered) or user or any(SPACE in p[1:] for p in merges) or SPACE not in pieces or "\0" in pieces:
            raise ValueError("only BPE models with byte fallback, without normalisation and with ordered scores can be tabled")

    def _segments(self, pieces: dict[str, int]) -> re.Pattern:
        """Cuts a text where no token reaches across."""
        letter = re.compile(f"[{LETTERS}]")
        held = {b for p in pieces for a, b in zip(p, p[1:], strict=False) if letter.match(a)}
        ends = "".join(re.escape(c) for c in PUNCTUATION if c not in held)
        breaks = "".join(re.escape(c) for c in "\n\t" if c not in pieces)
        return re.compile(f"{SPACE}*+[{LETTERS}]++(?=[{ends}{SPACE}{breaks}]|$)|[{breaks}]+|{SPACE}*+[^{SPACE}{breaks}]++|{SPACE}++" if breaks else f"{SPACE}*+[{LETTERS}]++(?=[{ends}{SPACE}]|$)|{SPACE}*+[^{SPACE}]++|{SPACE}++")

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a stays a and b stays b where a's text is followed by b's."""
        ok, rows, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), NONE)
        while len(rows):
            clash = self.pairs[a * self.n + b] < limit
            ok[rows[clash]] = False
            go_on = ~clash & (np.maximum(a, b) >= self.letters)
            a, b, rows = a[go_on], b[go_on], rows[go_on]
            left = a > b  # equal tokens merge from the left, so the right one's merge is undone first
            limit = np.where(left, a, b + 1)
            a, b = np.where(left, self.right[a], a), np.where(left, b, self.left[b])
        return ok

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words end to end, tokens of each word); words hold letters of the vocabulary, white space at most first."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero(sizes <= TABLE_CHARS)
        tokens, owner = self._tabled([words[i] for i in short.tolist()] if len(short) < len(words) else words, sizes[short])
        owner = short[owner]
        if len(short) < len(words):
            found = [(i, self._walked(words[i])) for i in np.flatnonzero(sizes > TABLE_CHARS).tolist()]
            owner = np.concatenate([owner, *[np.full(len(t), i) for i, t in found]])
            tokens = np.concatenate([tokens, *[t for _, t in found]])
            order = np.argsort(owner, kind="stable")
            tokens, owner = tokens[order], owner[order]
        return tokens, np.bincount(owner, minlength=len(words))

    def _tabled(self, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, number of the word each is of), all prefixes of one length at a time."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1  # one place between words
        end, token = self.matches("\0".join(words))
        begin = end - self.lengths[token]  # the place before the token; a word's first token has its border there
        word = np.searchsorted(starts, end, "right") - 1
        place = end - starts[word]
        order = np.argsort(place.astype(np.int8), kind="stable")
        cuts = np.searchsorted(place[order], np.arange(int(sizes.max()) + 1))
        first = begin < starts[word]
        last = np.full(int(starts[-1] + sizes[-1]), -1)
        for p in range(int(sizes.max())):
            at = order[cuts[p] : cuts[p + 1]]
            whole = at[first[at]]
            last[end[whole]] = token[whole]
            at = at[~first[at]]
            fits = at[self.compatible(last[begin[at]], token[at])]
            last[end[fits]] = token[fits]
        at, rows = starts + sizes - 1, np.arange(len(words))
        found, owner = [], []
        while len(at):
            t = last[at]
            found.append(t)
            owner.append(rows)
            at = at - self.lengths[t]
            on = at >= starts[rows]
            at, rows = at[on], rows[on]
        tokens, owner = np.concatenate(found[::-1]), np.concatenate(owner[::-1])
        order = np.argsort(owner, kind="stable")
        return tokens[order], owner[order]

    def _walked(self, word: str) -> np.ndarray:
        """The tokens of one long word, one place at a time."""
        last, lengths, apart = array.array("i", bytes(4 * len(word))), self.lengths.tolist(), {}
        ends, tokens = self.matches(word)
        order = np.argsort(ends, kind="stable")
        for end, t in zip(ends[order].tolist(), tokens[order].tolist(), strict=True):
            begin = end - lengths[t]
            if begin >= 0:
                key = (last[begin], t)
                fits = apart.get(key)
                if fits is None:
                    fits = apart[key] = bool(self.compatible(np.array([key[0]]), np.array([t]))[0])
                if not fits:
                    continue
            last[end] = t
        out, at = [], len(word) - 1
        while at >= 0:
            out.append(last[at])
            at -= lengths[out[-1]]
        return np.array(out[::-1], np.int64)

    def run(self, n: int) -> list[int]:
        """Ids of n white spaces side by side: whatever two neighbours make a token merge, the leftmost first."""
        stack: list[int] = []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-2] + stack[-1] in self.runs:
                stack[-2:] = [stack[-2] + stack[-1]]
        return [self.runs[k] for k in stack]

    # ids of segments, kept from batch to batch

    def clear(self) -> None:
        self._hold([], np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _hold(self, segments: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.slots = _Slots(segments)
        self.flat, self.start, self.count = array.array("i"), array.array("q"), array.array("q")
        self.uses = np.zeros(len(segments), np.int64)
        self._add(ids, counts)

    def _shrink(self) -> None:
        """Keep the segments that were met again, the most frequent half of KEEP of them."""
        keep = self.uses >= 2
        if keep.sum() > KEEP // 2:
            keep[np.argsort(-self.uses, kind="stable")[KEEP // 2 :]] = False
        counts = np.array(self.count)
        self._hold(list(compress(self.slots, keep.tolist())), np.array(self.flat)[np.repeat(keep, counts)], counts[keep])

    def _learn(self, new: list[str]) -> None:
        """Ids of segments met for the first time, in the order of their slots."""
        words, recipes = [], {}
        for i, s in enumerate(new):
            if self.plain.fullmatch(s):
                words.append(s)
                continue
            recipe = recipes[i] = []
            for p in self.parts.findall(s):
                rest = p.lstrip(SPACE)
                if p[0] == SPACE and rest:
                    recipe.append((len(p) - len(rest), len(words)))
                    words.append(SPACE + rest)
                elif p[0] == SPACE:
                    recipe.append((len(p), -1))
                elif self.plain.fullmatch(p):
                    recipe.append((0, len(words)))
                    words.append(p)
                else:
                    recipe.append((0, -1, p))
        tokens, counts = self.words(words)
        ends = np.cumsum(counts)
        ids = self.ids[tokens]
        if not recipes:
            self._add(ids, counts)
            return
        parts, sizes, w = [], np.zeros(len(new), np.int64), 0
        for i in range(len(new)):
            if i not in recipes:
                parts.append(ids[ends[w] - counts[w] : ends[w]])
                sizes[i] = counts[w]
                w += 1
                continue
            out: list[int] = []
            for spaces, k, *unknown in recipes[i]:
                if unknown:
                    out += [self.byte_ids[b] for b in unknown[0].encode()]
                elif k < 0:
                    out += self.run(spaces)
                else:
                    own = tokens[ends[k] - counts[k] : ends[k]]
                    alone = bool(spaces) and own[0] == self.space  # the last white space joined no letter: it belongs to the run
                    out += self.run(spaces - 1 + alone if spaces else 0) + self.ids[own[int(alone) :]].tolist()
                    w += 1
            parts.append(np.array(out, np.int32))
            sizes[i] = len(out)
        self._add(np.concatenate(parts), sizes)

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.start.frombytes((len(self.flat) + np.cumsum(counts) - counts).astype(np.int64).tobytes())
        self.count.frombytes(counts.astype(np.int64).tobytes())
        self.flat.frombytes(ids.astype(np.int32).tobytes())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each), without end ids."""
        if len(self.slots) > KEEP:
            self._shrink()
        found = [self.segments.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        slots = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        if self.slots.new:
            self._learn(self.slots.new)
            self.uses = np.append(self.uses, np.zeros(len(self.slots.new), np.int64))
            self.slots.new.clear()
        self.uses += np.bincount(slots, minlength=len(self.uses))
        counts = np.frombuffer(self.count, np.int64)[slots]
        ends = np.cumsum(counts)
        take = np.repeat(np.frombuffer(self.start, np.int64)[slots] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)
        whole = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return np.frombuffer(self.flat, np.int32)[take], np.diff(whole)


def _by_chars(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, end) of slices of at most BATCH_CHARS bytes or one text."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1])
    begin, n = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if n and n + size > BATCH_CHARS:
            yield begin, i
            begin, n = i, 0
        n += size
    if begin < len(texts):
        yield begin, len(texts)


def _columns(df: DataFrame, out: str, kind: str) -> tuple[list[str], str]:
    kept = [f for f in df.schema.fields if f.name != out]
    return [f.name for f in kept], ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` {kind}"])


def encode_pieces(docs: DataFrame, model: str, text: str = "text", out: str = "ids", end: bool = True) -> DataFrame:
    """docs with the ids of each text (array<int>), followed by the model's end id unless `end` is false."""
    names, schema = _columns(docs, out, "array<int>")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_cache(("sentence pieces", model), lambda: PrefixTable(model))
        for b in batches:
            column = b.column(b.schema.get_field_index(text))
            for i, j in _by_chars(column):
                ids, counts = table.encode([t or "" for t in column.slice(i, j - i).to_pylist()])
                if end:
                    ids = np.insert(ids, np.cumsum(counts), table.end_id)
                    counts = counts + 1
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)).slice(i, j - i) for n in names), lists], [*names, out])
        give_back()

    return docs.mapInArrow(encode, schema)


def decode_pieces(rows: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text that the model's library decodes the ids to."""
    names, schema = _columns(rows, out, "string")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                lists = part.column(part.schema.get_field_index(ids))
                values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                known = lists.is_valid().to_numpy(zero_copy_only=False)
                texts = [sp.decode(values[j:k].tolist()) if ok else "" for j, k, ok in zip(at[:-1], at[1:], known, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), pa.array(texts, pa.string())], [*names, out])
        give_back()

    return rows.mapInArrow(decode, schema)
