"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs, best score first and of equal scores the leftmost; popping a
pair merges it and offers its new neighbours. As long as no piece of the vocabulary has a word-start mark after
another character (checked when it is loaded), no merge crosses from a character to a following mark, so a text is
cut there and each distinct segment goes through the agenda once per worker, or again where CACHE_BYTES do not hold all. Every segment
that the agenda solves is checked against the sentencepiece library in the same Arrow batch; a difference raises.

Only vocabularies with the identity normaliser, a dummy prefix and no removal of white space are taken: others
raise ValueError. The model file's path is a parameter and must be readable on the executors.

Defined results: null is the empty text, which has no ids and decodes to the empty text; repeated rows give equal
values; an empty table gives an empty result; very long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import columnar as C

MARK = "▁"
#: Bytes of segments and their ids that a worker keeps at most, by the estimate of segment_bytes(), and the longest segment that is kept.
CACHE_BYTES, CACHE_CHARS = 320 << 20, 48
#: What encode_and_decode() keeps of it: its workers hold the columns of both results as well, and go on to other stages.
SMALL_CACHE_BYTES = 48 << 20
#: Longest segment whose agenda is a plain list: finding the best of a few pairs there is quicker than keeping a heap.
SHORT = 48
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            c = raw[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, raw[i : i + n]
            i += n
        else:
            n = 8 if key & 7 == 1 else 4
            yield key >> 3, struct.unpack("<d" if n == 8 else "<f", raw[i : i + n])[0]
            i += n


class PieceModel:
    """A vocabulary with agenda encoder and decoder."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.unknown = 0
        pieces, trainer, normalizer = [], {}, {}
        for field, value in _fields(raw):
            if field == 1:
                pieces.append(dict(_fields(value)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a merge-type vocabulary")
        if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24):
            raise ValueError("only the identity normaliser with a dummy prefix and all white space kept is supported")
        for i, p in enumerate(pieces):
            text, kind = p[1].decode("utf-8"), p.get(3, NORMAL)
            if kind == NORMAL:
                self.id[text], self.score[text] = i, p.get(2, 0.0)
                if re.search(f"[^{MARK}]{MARK}", text):
                    raise ValueError(f"a piece crosses a word start: {text!r}")
            elif kind == BYTE:
                self.byte_id[int(text[3:5], 16)] = i
            elif kind == UNKNOWN:
                self.unknown = i
            elif kind in (USER_DEFINED, UNUSED):
                raise ValueError("user-defined and unused pieces are not supported")
        # (-score) of each merge result: the agenda is a heap
        self.cost = {text: -score for text, score in self.score.items() if len(text) > 1}
        self.byte_fallback = bool(trainer.get(35)) and len(self.byte_id) == 256

    def agenda(self, segment: str) -> list[int]:
        """Ids of one segment."""
        if len(segment) <= SHORT:
            return self._ids(self._merged_by_list(segment))
        return self._ids(self._merged_by_heap(segment))

    def _merged_by_list(self, segment: str) -> list[str]:
        """The agenda is the list of the costs of all adjacent pairs, in their order."""
        symbols, get, none = list(segment), self.cost.get, math.inf
        costs = [get(both, none) for both in map(add, segment, segment[1:])]
        while costs:
            best = min(costs)
            if best == none:
                break
            i = costs.index(best)
            both = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del costs[i]
            if i < len(costs):
                costs[i] = get(both + symbols[i + 1], none)
            if i:
                costs[i - 1] = get(symbols[i - 1] + both, none)
        return symbols

    def _merged_by_heap(self, segment: str) -> list[str]:
        symbols = list(segment)
        n = len(symbols)
        cost = self.cost
        if n > 1:
            left, right = list(range(-1, n - 1)), list(range(1, n + 1))
            pairs = []
            for i in range(n - 1):
                both = symbols[i] + symbols[i + 1]
                c = cost.get(both)
                if c is not None:
                    pairs.append((c, i, both))
            heapify(pairs)
            while pairs:
                _, i, both = heappop(pairs)
                s = symbols[i]
                j = right[i]
                # stale: one of the two has been merged since
                if not s or j >= n or len(s) + len(symbols[j]) != len(both) or s + symbols[j] != both:
                    continue
                symbols[i], symbols[j] = both, ""
                k = right[i] = right[j]
                if k < n:
                    left[k] = i
                    joined = both + symbols[k]
                    c = cost.get(joined)
                    if c is not None:
                        heappush(pairs, (c, i, joined))
                h = left[i]
                if h >= 0:
                    joined = symbols[h] + both
                    c = cost.get(joined)
                    if c is not None:
                        heappush(pairs, (c, h, joined))
        return [s for s in symbols if s]

    def _ids(self, symbols: list[str]) -> list[int]:
        known = list(map(self.id.get, symbols))
        if None not in known:
            return known
        ids: list[int] = []
        for s, i in zip(symbols, known, strict=True):
            if i is not None:
                ids.append(i)
            elif self.byte_fallback:
                ids.extend(self.byte_id[b] for b in s.encode("utf-8"))
            else:
                ids.append(self.unknown)
        return ids

    @staticmethod
    def segments(text: str) -> list[str]:
        """Cuts the marked text before every run of marks."""
        return _SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for s in self.segments(text) for i in self.agenda(s)]

    @property
    def pieces(self) -> dict[int, str]:
        if not hasattr(self, "_pieces"):
            self._pieces = {i: s for s, i in self.id.items()}
            self._bytes = {i: b for b, i in self.byte_id.items()}
        return self._pieces

    def decode(self, ids: list[int]) -> str:
        """Text of ids: runs of byte pieces are read as UTF-8, each bad byte as U+FFFD; the dummy prefix goes."""
        pieces, out, run = self.pieces, [], bytearray()
        for i in [*ids, None]:
            if i in self._bytes:
                run.append(self._bytes[i])
                continue
            if run:
                out.append(_lenient(bytes(run)))
                run.clear()
            if i is not None:
                out.append(pieces.get(i, f" {chr(0x2047)} " if i == self.unknown else ""))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if ids and pieces.get(ids[0], "").startswith(MARK) else text


_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _lenient(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for n in range(1, 5):
            try:
                out.append(raw[i : i + n].decode("utf-8"))
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


@lru_cache(2)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(1)
def batch_encoder(path: str, limit: int | None = None) -> BatchEncoder:
    """The worker's encoder: tasks that follow each other in one worker share its segments."""
    return BatchEncoder(path, limit)


def segment_bytes(segment: str, ids: tuple[int, ...]) -> int:
    """What a kept segment takes at most: its text, the tuple, and its place in the table (ids of the vocabulary are shared)."""
    return 200 + 4 * len(segment) + 8 * len(ids)


class BatchEncoder:
    """Encodes the texts of Arrow batches; what the agenda solves is checked against the library at once."""

    def __init__(self, path: str, limit: int | None = None):
        self.model, self.library, self.limit = load(path), _library(path), limit
        # two generations: what is not asked for while one fills goes with the next change
        self.kept: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.bytes = 0

    def _solve(self, new: list[str]) -> dict[str, tuple[int, ...]]:
        agenda = self.model.agenda
        solved = {s: tuple(agenda(s)) for s in new}
        # the library puts a mark of its own before the text
        marked = [s for s in new if s[0] == MARK]
        for s, ids in zip(marked, self.library.encode([s[1:] for s in marked], num_threads=1), strict=True):
            # a lone mark is the dummy prefix of nothing, which the library leaves out
            if tuple(ids) != solved[s] and s != MARK:
                raise AssertionError(f"agenda and library differ on {s!r}: {solved[s]} and {ids}")
        return solved

    def _learned(self, texts: list[str]) -> tuple[list[list[str]], set[str]]:
        """Segments of the texts, all of them in `kept`; and those that were new."""
        segments = [self.model.segments(t) for t in texts]
        wanted = {s for own in segments for s in own}
        if self.bytes > (self.limit or CACHE_BYTES) // 2:
            self.old, self.kept, self.bytes = self.kept, {}, 0
        missing = wanted.difference(self.kept)
        again = {s: self.old[s] for s in missing if s in self.old}
        new = missing.difference(again)
        solved = self._solve(list(new)) if new else {}
        for more in (again, solved):
            self.kept.update(more)
            self.bytes += sum(segment_bytes(s, ids) for s, ids in more.items())
        return segments, new

    def encode(self, texts: list[str]) -> list[list[int]]:
        segments, new = self._learned(texts)
        ids_of = self.kept.__getitem__
        out = [list(chain.from_iterable(map(ids_of, own))) for own in segments]
        self._forget(new)
        return out

    def encode_with_digest(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """Ids of each text, and the sha256 of the decimal ids joined by commas: each segment is printed once a call."""
        segments, new = self._learned(texts)
        kept, out, printed = self.kept, [], {}
        for own in segments:
            for s in set(own).difference(printed):
                printed[s] = ",".join(map(str, kept[s]))
            ids = list(chain.from_iterable(map(kept.__getitem__, own)))
            out.append((ids, hashlib.sha256(",".join(map(printed.__getitem__, own)).encode()).hexdigest()))
        self._forget(new)
        return out

    def _forget(self, new: set[str]) -> None:
        for s in new:
            if len(s) > CACHE_CHARS:
                self.bytes -= segment_bytes(s, self.kept.pop(s))


def _rows(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Slices of at most `limit` characters, or one text."""
    i = 0
    while i < len(texts):
        j, n = i + 1, len(texts[i])
        while j < len(texts) and n + len(texts[j]) <= limit:
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with an array<int> column of ids, without begin or end ids. An existing column of that name is replaced."""
    schema = C.extend([f for f in docs.schema.fields if f.name != ids_col], f"`{ids_col}` array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = batch_encoder(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            for i, j in _rows(texts):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in schema.names[:-1]), pa.array(encoder.encode(texts[i:j]), pa.list_(pa.int32()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with the text that the library's decode(ids) gives; null ids give the empty text."""
    schema = C.extend([f for f in docs.schema.fields if f.name != text_col], f"`{text_col}` string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(model_path)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                ids = [x or [] for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in schema.names[:-1]), pa.array(library.decode(ids, num_threads=1), pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """docs with both columns of encode() and decode(), in one pass of one worker. Existing columns of these names are replaced."""
    schema = C.extend([f for f in docs.schema.fields if f.name not in (ids_col, decoded_col)], f"`{ids_col}` array<int>, `{decoded_col}` string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = batch_encoder(model_path, SMALL_CACHE_BYTES)
        for batch in batches:
            for part, _, _ in C.chunks(batch, text_col, 1 << 20):
                ids = encoder.encode([t or "" for t in part.column(text_col).to_pylist()])
                decoded = encoder.library.decode(ids, num_threads=1)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in schema.names[:-2]), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoder and decoder in one pass, ids never leave the worker."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    schema = C.extend(rows.schema.fields[:1], "n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = batch_encoder(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, ids_sha, text_sha = [], [], []
            for i, j in _rows(texts):
                both = encoder.encode_with_digest(texts[i:j])
                ids = [x for x, _ in both]
                n += [len(x) for x in ids]
                ids_sha += [x for _, x in both]
                text_sha += [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in encoder.library.decode(ids, num_threads=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
