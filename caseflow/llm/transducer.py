"""Token counts from compiled finite-state transducers: byte-level merge vocabularies (tokenizer .json files).

Two deterministic machines stand for the tokenizer. The first one cuts a text into the pieces within which merges
happen; its transitions, over classes of characters, are annotated with the cuts that they emit. Where a piece begins is
sometimes known one character late, so a transition may emit a cut before its character, before the one before, or both.

The second one reads the bytes of a piece; its transitions are annotated with how many tokens each byte adds. Its
state holds, for each end of the prefix read so far that may yet become the head of a token, the place in the
vocabulary's trie, the last token before that end, and the count there relative to the count now. A byte settles the
last token of the longer prefix: the one token that ends there and may follow the token before it, that is, no merge across
their border comes before the merges inside them. A later byte can undo a border, so the number added may be negative. The
machine is compiled as its transitions are first met, once per worker, and starts anew past STATES of them.

Both run over chunks of a fixed length at once: a chunk maps each entry state to an exit state and what it emits; the maps
compose by a parallel prefix scan, which gives every chunk the state it is entered in. The first machine has so few
states that its maps are complete. The second one has very many, so its maps hold the states in which chunks are entered:
chunks are run from the state that the chunk before leaves, until no entry changes.

Defined results: null is the empty text of no bytes and no tokens; repeated rows give equal counts; an empty table gives an
empty result; texts of any length are counted whole. Strings of special tokens inside texts count as one token each, which
is the library's default; vocabularies with added tokens that strip, are normalised or match words only, with a normaliser, with another
cut than the byte-level one, or with merges out of order, raise ValueError. The file's path must be readable on the executors.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import columnar as C

#: Positions that one chunk of the cutting machine, and bytes that one chunk of the merging machine, is long.
CUT_CHUNK, MERGE_CHUNK = 256, 64
#: States of the merging machine that a worker keeps, some 400 bytes each.
STATES = 400_000
#: Bytes of text that are looked at in one go: new states of one go come on top of STATES.
GO_BYTES = 512 << 10

# --- cutting machine ------------------------------------------------------------------------------------------------

#: Classes of characters: letters (five kinds that contractions are made of), digits, blank, other white space, apostrophe, anything else; END stands after a text.
LETTER, E_, RV, STMD, LL, DIGIT, BLANK, SPACE, APOSTROPHE, OTHER, END = range(11)
_LETTERS = (LETTER, E_, RV, STMD, LL)
_STATES = ("start", "letters", "digits", "others", "apostrophe", "apostrophe_rv", "apostrophe_l", "contraction", "blank", "blanks", "space", "spaces")
HERE, BEFORE = 1, 2  # emitted cuts


def cutting_machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, cuts), each by class * states + state."""
    at = {s: i for i, s in enumerate(_STATES)}
    fresh = dict.fromkeys(_LETTERS, "letters") | {DIGIT: "digits", BLANK: "blank", SPACE: "space", APOSTROPHE: "apostrophe", OTHER: "others", END: "start"}
    goes: dict[tuple[str, int], tuple[str, int]] = {}
    for s in _STATES:
        # without anything to go on with, a piece begins here
        for c, to in fresh.items():
            goes[s, c] = (to, 0 if c == END else HERE)
    on = lambda s, classes, to, cuts=0: goes.update({(s, c): (to, cuts) for c in classes})
    on("letters", _LETTERS, "letters")
    on("digits", [DIGIT], "digits")
    for s in ("others", "apostrophe"):
        on(s, [OTHER, APOSTROPHE], "others")
    on("apostrophe", [STMD], "contraction")
    on("apostrophe", [RV], "apostrophe_rv")
    on("apostrophe", [LL], "apostrophe_l")
    for s, ends in (("apostrophe_rv", E_), ("apostrophe_l", LL)):
        # not the second letter of a contraction after all: the first one began a piece
        for c, to in fresh.items():
            goes[s, c] = (to, BEFORE if c in _LETTERS or c == END else BEFORE | HERE)
        goes[s, ends] = ("contraction", 0)
    for s in ("blank", "blanks"):
        # a last blank goes with what follows, and the rest of the run stands alone
        cut = BEFORE if s == "blanks" else 0
        on(s, _LETTERS, "letters", cut)
        on(s, [DIGIT], "digits", cut)
        on(s, [OTHER, APOSTROPHE], "others", cut)
    for c, to in fresh.items():
        if c not in (BLANK, SPACE, END):
            # other white space at the end of a run stands alone
            goes["spaces", c] = (to, BEFORE | HERE)
    for s in ("blank", "blanks", "space", "spaces"):
        on(s, [BLANK], "blanks")
        on(s, [SPACE], "spaces")
    n = len(_STATES)
    to, out = np.zeros(11 * n, np.uint8), np.zeros(11 * n, np.uint8)
    for (s, c), (t, cuts) in goes.items():
        to[c * n + at[s]], out[c * n + at[s]] = at[t], cuts
    return to, out


_TO, _CUTS = cutting_machine()


def run_chunks(classes: np.ndarray, chunk: int = CUT_CHUNK) -> np.ndarray:
    """The cuts that the machine emits at each position, from its start state: chunk maps, their prefix scan, and a run from the entries found."""
    n, q = len(classes), len(_STATES)
    m = max(1, -(-n // chunk))
    grid = np.full(m * chunk, END, np.uint8)
    grid[:n] = classes
    # by position within the chunk, then chunk
    base = np.ascontiguousarray((grid * np.uint8(q)).reshape(m, chunk).T)
    maps = np.tile(np.arange(q, dtype=np.uint8), (m, 1))
    at = np.empty_like(maps)
    for row in base:
        np.add(maps, row[:, None], out=at)
        np.take(_TO, at, out=maps, mode="clip")
    # scan: after a round of width w, maps[i] leads through the chunks i - 2 * w + 1 to i
    width = 1
    while width < m:
        maps[width:] = np.take_along_axis(maps[width:], maps[:-width], 1)
        width *= 2
    state = np.zeros(m, np.uint8)
    state[1:] = maps[:-1, 0]
    cuts = np.empty_like(base)
    for i, row in enumerate(base):
        entry = row + state
        cuts[i], state = _CUTS[entry], _TO[entry]
    return cuts.T.reshape(-1)[:n]


def class_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(first code point of each run of one class, class), as the library's own tables of letters and digits have it.

    The library cuts a text of all characters in order exactly where their class changes; one character of each
    run then tells which class it is. White space and the apostrophe are put in by hand.
    """
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    white = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    odd = {*white, 0x27}
    table = np.full(0x110000, OTHER, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c not in odd]
    for i in range(0, len(points), 1 << 16):
        part = points[i : i + (1 << 16)]
        for _, (a, b) in cut("".join(map(chr, part))):
            c = chr(part[a])
            kind = LETTER if len(cut(f"a{c}")) == 1 else DIGIT if len(cut(f"1{c}")) == 1 else OTHER
            table[part[a:b]] = kind
    table[white] = SPACE
    for kind, chars in ((E_, "e"), (RV, "rv"), (STMD, "stmd"), (LL, "l"), (BLANK, " "), (APOSTROPHE, "'")):
        table[[ord(c) for c in chars]] = kind
    first = np.flatnonzero(np.diff(table, prepend=255))
    return first.astype(np.int32), table[first]


def spread(runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The class of every code point, from class_table()."""
    return np.repeat(runs[1], np.diff([*runs[0], 0x110000]))


class Pieces:
    """The pieces of a slice of texts: byte spans and the text of each; and how many special tokens each text has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, special: re.Pattern | None):
        raw, texts = data.tobytes(), len(offsets) - 1
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.flatnonzero((data & 0xC0) != 0x80)
        text = np.repeat(np.arange(texts), np.diff(np.searchsorted(first, offsets)))
        # a terminator after each text: a character of text t moves t places on
        n = len(points) + texts
        at = np.arange(len(points)) + text
        kinds = np.full(n, END, np.uint8)
        kinds[at] = classes[points]
        place = np.empty(n, np.int64)
        place[at] = first
        place[np.searchsorted(text, np.arange(texts), "right") + np.arange(texts)] = offsets[1:]
        self.specials = np.zeros(texts, np.int64)
        if special:
            for m in special.finditer(raw):
                t = int(np.searchsorted(offsets, m.start(), "right")) - 1
                if m.end() <= offsets[t + 1]:
                    self.specials[t] += 1
                    kinds[at[np.searchsorted(first, m.start()) : np.searchsorted(first, m.end())]] = END
        cuts = run_chunks(kinds)
        begins = (cuts & HERE).astype(bool)
        begins[:-1] |= (cuts[1:] & BEFORE).astype(bool)
        edges = np.flatnonzero(begins | (kinds == END))
        heads = np.flatnonzero(begins[edges])
        self.starts, self.ends = place[edges[heads]], place[edges[heads + 1]] if len(heads) else place[:0]
        self.text = np.searchsorted(offsets, self.starts, "right") - 1


# --- merging machine ------------------------------------------------------------------------------------------------

_FAR = 1 << 60


class Vocabulary:
    """Tokens as bytes, their merges and special strings, of a tokenizer's .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, pre = whole["model"], whole["pre_tokenizer"] or {}
        if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("not a plain byte-level merge vocabulary")
        if whole["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only the byte-level cut without normaliser and prefix is supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in whole["added_tokens"]):
            raise ValueError("added tokens that strip, are normalised or match words only are not supported")
        self.special = [t["content"].encode() for t in whole["added_tokens"]]
        shown = byte_signs()
        self.bytes = {i: bytes(shown[c] for c in s) for s, i in model["vocab"].items()}
        #: rank of a merge by its pair; by token, its rank and its pair
        self.merge: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            pair, token = (model["vocab"][left], model["vocab"][right]), model["vocab"][left + right]
            if token in self.rank or any(self.rank.get(p, -1) > rank for p in pair):
                raise ValueError("merges out of order")
            self.merge[pair], self.rank[token], self.parts[token] = rank, rank, pair
        if {len(b) for i, b in self.bytes.items() if i not in self.rank} - {1} or len({b for b in self.bytes.values() if len(b) == 1}) != 256:
            raise ValueError("tokens that no merge makes")


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 signs are themselves, the rest count up from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class MergingMachine:
    """Transitions (state, byte) -> (state, tokens added), compiled as they are met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [False]
        for i, b in vocabulary.bytes.items():
            node = 0
            for c in b:
                after = self.child.get(node << 8 | c)
                if after is None:
                    after = self.child[node << 8 | c] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = after
            self.token[node] = i
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        if not all(self._whole(t) for t in vocabulary.parts):
            raise ValueError("a token that its own bytes do not give")
        self._reset()

    def _reset(self) -> None:
        #: each state: (trie node, last token, count relative to now) of the ends that may yet head a token, the longest such head first
        self.states: list[tuple[tuple[int, int, int], ...]] = []
        self.number: dict[tuple[tuple[int, int, int], ...], int] = {}
        self.table = Table()
        self.follows.clear()
        #: the last token of each state's prefix
        self.last = np.full(1 << 10, -1, np.int32)
        assert self._state(((0, -1, 0),)) == 0

    def _state(self, key: tuple[tuple[int, int, int], ...]) -> int:
        n = self.number.setdefault(key, len(self.states))
        if n == len(self.states):
            self.states.append(key)
            if n == len(self.last):
                self.last = np.concatenate([self.last, self.last])
            self.last[n] = key[-1][1]
        return n

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank of the merge that uses it up) of the last (side 1) or first (side 0) symbols on the way to a token."""
        kept = (self.left, self.right)[side]
        out = kept.get(token)
        if out is None:
            out, used, parts, rank = [], _FAR, self.vocabulary.parts, self.vocabulary.rank
            t: int | None = token
            while t is not None:
                out.append((t, used))
                used = rank.get(t, _FAR)
                t = parts[t][side] if t in parts else None
            kept[token] = out
        return out

    def _crosses(self, a: int, b: int, before: int = _FAR) -> bool:
        """Whether a merge across the border of tokens a and b comes before those inside them, and before this rank. Of equal ranks the leftmost comes first."""
        merge = self.vocabulary.merge
        for x, x_used in self._spine(a, 1):
            for y, y_used in self._spine(b, 0):
                m = merge.get((x, y))
                if m is not None and m < x_used and m <= y_used and m < before:
                    return True
        return False

    def _whole(self, token: int) -> bool:
        return not self._crosses(*self.vocabulary.parts[token], before=self.vocabulary.rank[token])

    def _may_follow(self, a: int, b: int) -> bool:
        known = self.follows.get((a, b))
        if known is None:
            known = self.follows[a, b] = not self._crosses(a, b)
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state and byte."""
        child, token, inner = self.child, self.token, self.inner
        heads, last, added = [], None, 0
        for node, before, count in self.states[state]:
            c = child.get(node << 8 | byte)
            if c is None:
                continue
            if last is None and token[c] >= 0 and (before < 0 or self._may_follow(before, token[c])):
                last, added = token[c], count + 1
            if inner[c]:
                heads.append((c, before, count))
        return self._state((*((c, b, n - added) for c, b, n in heads), (0, last, 0))), added

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Transitions of many states at once."""
        key = state << 8 | byte
        value, missing = self.table.get(key)
        if len(missing):
            new = np.unique(key[missing])
            made = [self.compile(int(k) >> 8, int(k) & 255) for k in new]
            self.table.put(new, np.array([s << 16 | n + (1 << 15) for s, n in made], np.int64))
            value, _ = self.table.get(key)
        return value >> 16, (value & 0xFFFF) - (1 << 15)

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = MERGE_CHUNK, last: np.ndarray | None = None) -> np.ndarray:
        """Tokens of each piece; last: gets the last token of each piece's prefix that ends with a byte, at that byte."""
        if len(self.states) > STATES:
            self._reset()
        per = np.maximum(1, -(-(ends - starts) // chunk))
        piece = np.repeat(np.arange(len(starts)), per)
        inside = np.arange(len(piece)) - np.repeat(np.cumsum(per) - per, per)
        at = starts[piece] + inside * chunk
        length = np.minimum(ends[piece] - at, chunk)
        follows = inside > 0
        entry, left = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        total = np.zeros(len(at), np.int64)
        todo = np.arange(len(at))
        while len(todo):
            todo = todo[np.argsort(-length[todo], kind="stable")]
            state, added, place = entry[todo], np.zeros(len(todo), np.int64), at[todo]
            # of lanes by falling length, those that reach step i stand in front
            reach = np.searchsorted(-length[todo], -np.arange(int(length[todo[0]])), "left")
            for i, m in enumerate(reach):
                at_byte = place[:m] + i
                state[:m], more = self.step(state[:m], data[at_byte].astype(np.int64))
                added[:m] += more
                if last is not None:
                    last[at_byte] = self.last[state[:m]]
            left[todo], total[todo] = state, added
            behind = todo[todo + 1 < len(at)] + 1
            behind = behind[follows[behind]]
            todo = behind[entry[behind] != left[behind - 1]]
            entry[todo] = left[todo - 1]
        return np.bincount(piece, total, len(starts)).astype(np.int64)

    def tokens(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, how many each piece has): from each piece's end back over its last tokens."""
        last = np.full(len(data), -1, np.int32)
        n = self.counts(data, starts, ends, last=last)
        size = np.zeros(max(self.vocabulary.bytes) + 1, np.int64)
        for i, b in self.vocabulary.bytes.items():
            size[i] = len(b)
        ids, place, at = np.empty(int(n.sum()), np.int32), np.cumsum(n) - 1, ends - 1
        back = np.flatnonzero(n)
        for step in range(int(n.max(initial=0))):
            back = back[n[back] > step]
            ids[place[back] - step] = t = last[at[back]]
            at[back] -= size[t]
        return ids, n


class Table:
    """An open-addressing table from 64-bit keys (not negative) to values, looked up by arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, indices of keys that are not there)."""
        at = self._place(key)
        found = self.keys[at]
        off = np.flatnonzero(found != key)
        missing = []
        while len(off):
            empty = found[off] < 0
            missing.append(off[empty])
            off = off[~empty]
            at[off] = (at[off] + 1) & ((1 << self.bits) - 1)
            found[off] = self.keys[at[off]]
            off = off[found[off] != key[off]]
        return self.values[at], np.concatenate(missing) if missing else np.zeros(0, np.int64)

    def put(self, key: np.ndarray, value: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        while 2 * (self.used + len(key)) > 1 << self.bits:
            old = self.keys >= 0
            more, kept = self.keys[old], self.values[old]
            self.bits, self.used = self.bits + 1, 0
            self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
            self._insert(more, kept)
        self._insert(key, value)

    def _insert(self, key: np.ndarray, value: np.ndarray) -> None:
        self.used += len(key)
        at = self._place(key)
        while len(key):
            free = np.flatnonzero(self.keys[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            win = free[one]
            self.keys[at[win]], self.values[at[win]] = key[win], value[win]
            stay = np.ones(len(key), bool)
            stay[win] = False
            key, value, at = key[stay], value[stay], (at[stay] + 1) & ((1 << self.bits) - 1)


# --- operator -------------------------------------------------------------------------------------------------------


@lru_cache(1)
def machine(path: str) -> MergingMachine:
    """The worker's machine: tasks that follow each other in one worker share its transitions."""
    return MergingMachine(Vocabulary(path))


def token_counts(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, merging: MergingMachine) -> np.ndarray:
    """Tokens of each text of a slice."""
    special = merging.vocabulary.special
    pattern = re.compile(b"|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
    pieces = Pieces(data, offsets, classes, pattern)
    starts, ends = pieces.starts, pieces.ends
    n = merging.counts(data, starts, ends) if len(starts) else np.zeros(0, np.int64)
    return pieces.specials + np.bincount(pieces.text, n, len(offsets) - 1).astype(np.int64)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit): one pass over the texts, nothing is shuffled."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    schema = C.extend(rows.schema.fields[:1], "n_bytes long, n_tokens long, over_limit boolean")
    runs = class_table(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, merging = spread(runs), machine(path)
        for batch in batches:
            for part, data, offsets in C.chunks(batch.rename_columns(["id", "text"]), "text", GO_BYTES):
                n = token_counts(data, offsets, classes, merging)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=schema.names)

    return rows.mapInArrow(run, schema)
