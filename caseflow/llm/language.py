"""Language ID by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum over
all ways to cut it into pieces (forward algorithm), a text's is the product over its words, and languages compete
with equal priors. Piece probabilities are learned by expectation-maximisation with the same sums (forward-backward).

Pieces are byte strings: all of the vocabulary's normal pieces, plus all 256 single bytes, so
that every word has a cut. A word is a run of non-white-space bytes, A-Z lower-cased, with one space before it that
stands for the vocabulary's word-start mark. Words of any length are summed over whole: those over SHORT bytes one by
one, rescaled on the way. Whole texts are scored: every word of every text counts.

Learning takes a bounded sample: about `sample` labelled texts of each language (a hash of the text decides), and
nothing but their texts and languages; of their words it takes those of at most LEARN_WORD bytes. What is gathered on the driver is the sample's distinct words with counts.

Defined results: a null text, or one without any letter, is "und" with score 0; so is everything where nothing can
be learned. Rows that repeat get equal values. Only the named columns are read. Ties go to the alphabetically first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm import columnar as C
from caseflow.llm.pieces import MARK, load

#: Words that are scored with whole lattices, and the longest that learning takes.
SHORT, LEARN_WORD = 32, 64
#: Expected number of texts a language that learning uses at most, rounds, and pseudo-counts for each piece.
SAMPLE, ROUNDS, SMOOTH = 500, 4, 0.01
CHUNK = 4 << 20
_SLOTS, _REST = 20, 17


class Vocabulary:
    """Byte pieces, looked up by span hash in two tables without collisions."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.longest = pieces, max(map(len, pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        keys = C.span_hash(raw, np.concatenate([[0], ends[:-1]]), ends)
        self.n = len(pieces)
        self.keys = np.concatenate([keys, np.zeros(1, np.uint64)])
        self.main = np.full(1 << _SLOTS, self.n, np.int32)
        slot = keys >> np.uint64(64 - _SLOTS)
        _, chosen = np.unique(slot, return_index=True)
        self.main[slot[chosen]] = chosen
        rest = np.setdiff1d(np.arange(self.n), chosen)
        self.multiplier, self.rest = np.uint64(1), np.full(1 << _REST, self.n, np.int32)
        while len(rest):
            place = (keys[rest] * self.multiplier) >> np.uint64(64 - _REST)
            if len(np.unique(place)) == len(rest) and self.multiplier > 1:
                self.rest[place] = rest
                break
            self.multiplier = np.uint64((int(self.multiplier) * 6364136223846793005 + 1442695040888963407) % (1 << 64) | 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash's piece, n where there is none."""
        i = self.main[h >> np.uint64(64 - _SLOTS)]
        wrong = np.flatnonzero(self.keys[i] != h)
        i[wrong] = self.n
        j = self.rest[(h[wrong] * self.multiplier) >> np.uint64(64 - _REST)]
        good = (j < self.n) & (self.keys[j] == h[wrong])
        i[wrong[good]] = j[good]
        return i


def vocabulary(model_path: str) -> Vocabulary:
    single = [bytes([b]) for b in range(256)]
    known = {s.replace(MARK, " ").lower().encode("utf-8") for s in load(model_path).id}
    return Vocabulary([*single, *sorted(p for p in known if len(p) > 1)])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, text) of all words with a space in front."""
    starts, ends, first = C.words(data, offsets, C.NON_SPACE)
    size = ends - starts + 1
    at = np.cumsum(size) - size
    buf = np.full(int(size.sum()), 0x20, np.uint8)
    if len(buf):
        letter = np.ones(len(buf), bool)
        letter[at] = False
        buf[letter] = C.LOWER[data[C.NON_SPACE[data]]]
    return buf, at, at + size, C.owner(first)


def lattice(buf: np.ndarray, starts: np.ndarray, size: int, vocab: Vocabulary, total: np.ndarray) -> np.ndarray:
    """Piece index by (position, length - 1, word) of words of one size; vocab.n where there is no piece."""
    out = np.full((size, min(size, vocab.longest), len(starts)), vocab.n, np.int32)
    for i in range(size):
        back = C._power(1, len(total))[starts + i]
        for n in range(1, min(vocab.longest, size - i) + 1):
            out[i, n - 1] = vocab.find(C.mix((total[starts + i + n] - total[starts + i]) * back))
    return out


def _total(buf: np.ndarray) -> np.ndarray:
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(C._VALUES[0][buf] * C._power(0, len(buf)), out=total[1:])
    return total


def forward(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha[position, word, language] of the words of a lattice; p has a last row of zeros."""
    size, longest, m = ids.shape
    alpha = np.zeros((size + 1, m, p.shape[1]))
    alpha[0] = 1.0
    for j in range(1, size + 1):
        for n in range(1, min(longest, j) + 1):
            own = ids[j - n, n - 1]
            use = np.flatnonzero(own < len(p) - 1)
            if len(use):
                alpha[j][use] += alpha[j - n][use] * p[own[use]]
    return alpha


def long_words(starts: np.ndarray, ends: np.ndarray, vocab: Vocabulary, total: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log probability (word, language) of words however long: forward() word by word, rescaled on its way."""
    size = ends - starts
    word = np.repeat(np.arange(len(starts)), size)
    at = np.repeat(starts - np.cumsum(size) + size, size) + np.arange(len(word))
    found = []
    for n in range(1, vocab.longest + 1):  # all pieces of n bytes at once
        fits = np.flatnonzero(at + n <= ends[word])
        a = at[fits]
        own = vocab.find(C.mix((total[a + n] - total[a]) * C._power(1, len(total))[a]))
        good = np.flatnonzero(own < vocab.n)
        found.append((fits[good] + n - 1, np.full(len(good), n), own[good]))
    last, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(last, kind="stable")
    length, piece = length[order], piece[order]
    bounds = np.searchsorted(last[order], np.arange(len(word) + 1))
    out, first = np.zeros((len(starts), p.shape[1])), np.cumsum(size) - size
    for w in range(len(starts)):
        alpha, scale = np.zeros((size[w] + 1, p.shape[1])), np.zeros(p.shape[1])
        alpha[0] = 1.0
        for j in range(1, size[w] + 1):
            own = slice(bounds[first[w] + j - 1], bounds[first[w] + j])
            alpha[j] = (alpha[j - length[own]] * p[piece[own]]).sum(0)
            if j % 16 == 0:  # so that 16 steps of 1e-12 each stay far from underflow
                near = alpha[max(0, j - vocab.longest) : j + 1]
                top = np.maximum(near.max(0), 1e-300)
                near /= top
                scale += np.log(top)
        out[w] = np.log(np.maximum(alpha[size[w]], 1e-300)) + scale
    return out


def expected(ids: np.ndarray, p: np.ndarray, alpha: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts (piece, language); weight: (word, language) occurrences."""
    size, longest, m = ids.shape
    beta = np.zeros_like(alpha)
    beta[size] = 1.0
    counts = np.zeros_like(p)
    share = weight / np.maximum(alpha[size], 1e-300)
    for i in range(size - 1, -1, -1):
        for n in range(1, min(longest, size - i) + 1):
            own = ids[i, n - 1]
            use = np.flatnonzero(own < len(p) - 1)
            if len(use):
                step = p[own[use]] * beta[i + n][use]
                beta[i][use] += step
                got = alpha[i][use] * step * share[use]
                for k in range(p.shape[1]):
                    counts[:, k] += np.bincount(own[use], got[:, k], len(p))
    return counts


@dataclass
class Model:
    """Languages and their piece probabilities; the last row is the missing piece."""

    languages: list[str]
    vocab: Vocabulary
    p: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log probability by (text, language)."""
        buf, starts, ends, text = word_spans(data, offsets)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(starts):
            return out
        h = C.span_hash(buf, starts, ends)
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        ll = self.word_scores(buf, starts[first], ends[first])
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(text, ll[back, k], len(out))
        return out

    def word_scores(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total, size = _total(buf), ends - starts
        out = np.zeros((len(starts), self.p.shape[1]))
        rest = np.flatnonzero(size > SHORT)
        if len(rest):
            out[rest] = long_words(starts[rest], ends[rest], self.vocab, total, self.p)
        for n in np.unique(size[size <= SHORT]):
            own = np.flatnonzero(size == n)
            for i in range(0, len(own), 8192):
                part = own[i : i + 8192]
                out[part] = np.log(np.maximum(forward(lattice(buf, starts[part], int(n), self.vocab, total), self.p)[n], 1e-300))
        return out


def learn(words: list[bytes], weight: np.ndarray, languages: list[str], vocab: Vocabulary, rounds: int = ROUNDS, smooth: float = SMOOTH) -> Model:
    """EM from distinct words (space in front, at most LEARN_WORD bytes) and their (word, language) counts."""
    buf = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(size)
    starts, total = ends - size, _total(buf)
    p = np.full((vocab.n + 1, len(languages)), 1.0 / vocab.n)
    p[-1] = 0.0
    for _ in range(rounds):
        counts = np.zeros_like(p)
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            for i in range(0, len(own), 8192):
                part = own[i : i + 8192]
                ids = lattice(buf, starts[part], int(n), vocab, total)
                counts += expected(ids, p, forward(ids, p), weight[part])
        p = counts + smooth
        p[-1] = 0.0
        p /= p.sum(0)
    return Model(languages, vocab, p)


def fit(labelled: DataFrame, model_path: str, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Model from rows with a language; None if there are none."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, sample / sizes[k])))])
    draw = F.pmod(F.xxhash64("text", F.lit("language sample")), F.lit(1_000_000)) / 1_000_000
    chosen = rows.where(draw < F.element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in C.chunks(batch, "text", CHUNK):
                lang = np.array([languages.index(x) for x in part.column("lang").to_pylist()], np.int64)
                buf, starts, ends, text = word_spans(data, offsets)
                short = ends - starts <= LEARN_WORD
                starts, ends, text = starts[short], ends[short], text[short]
                if not len(starts):
                    continue
                h = C.span_hash(buf, starts, ends)
                _, first, back = np.unique(h, return_index=True, return_inverse=True)
                n = np.bincount(back * len(languages) + lang[text], minlength=len(first) * len(languages))
                at = np.flatnonzero(n)
                raw = buf.tobytes()
                word = [raw[starts[i] : ends[i]] for i in first[at // len(languages)]]
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(at % len(languages), pa.int32()), pa.array(n[at], pa.int64())], names=["word", "k", "n"])

    counts = chosen.mapInArrow(count, "word binary, k int, n long").groupBy("word", "k").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):
        return None
    counts = counts.sort_values(["word", "k"], kind="stable")
    words = sorted(set(map(bytes, counts["word"])))
    index = {w: i for i, w in enumerate(words)}
    weight = np.zeros((len(words), len(languages)))
    weight[[index[bytes(w)] for w in counts["word"]], counts["k"].to_numpy()] = counts["n"].to_numpy()
    return learn(words, weight, languages, vocabulary(model_path))


def predict(docs: DataFrame, model: Model | None, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """(the kept columns, lang_pred, score): score is the posterior probability of the predicted language."""
    own_text, own_letter = C.free(list(keep), "text", "letter")
    rows = docs.select(*[c.alias(k) for k, c in keep.items()], F.col(text_col).alias(own_text), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias(own_letter))
    if model is None:
        return rows.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = C.extend(rows.schema.fields[: len(keep)], "lang_pred string, score double")
    kept = list(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 bytes a piece and language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            for part, data, offsets in C.chunks(batch, own_text, CHUNK):
                ll = m.score(data, offsets)
                best = np.argmax(ll, 1)
                score = 1.0 / np.exp(ll - ll[np.arange(len(ll)), best][:, None]).sum(1)
                letter = np.array(part.column(own_letter).to_pylist(), bool)
                best = np.where(letter, best, len(m.languages))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), pa.array(names[best], pa.string()), pa.array(np.where(letter, score, 0.0), pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)
