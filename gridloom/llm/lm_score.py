"""LM scoring with Elias-Fano n-gram tries of three levels over an open vocabulary.

Model.  Base: p1(w) = (c(w) + 1) / (N + V + 1), exact.  Above it, interpolated
absolute discounting with D = DISCOUNT:
    p2(w | v)    = max(c(v w) - D, 0) / c(v) + g(v) p1(w),           g(v) = D types(v) / c(v),
    p3(w | u, v) = max(c(u v w) - D, 0) / c(u v) + g(u v) p2(w | v),  g(u v) = D types(u v) / c(u v);
a context that was not seen hands on to the next one.  Every word of the training
rows is counted, none is put in a class; these sum to 1 over all words and one unseen
word.  The model follows from the training rows alone: not from the number of shards,
nor from which words the sample below calls hot.

A trie holds the counts of a shard of contexts v: the contexts; for each the words
after it, with codes of the discounted share; the words u before it, with codes of
g(u v); and for each (u, v) the words after, as places among the successors of v, with
codes.  All sequences are Elias-Fano coded: contexts and runs' pointers are monotone,
runs are once each is shifted past the one before.  Codes are logarithms in steps of
FINE, so that a value has one code in any shard.  A query finds its context, reads two
pointers, and searches among that context's successors alone: the upper bits lead to the
few candidates, the lower bits decide.  Tries are written to a file, unlinked at once and
read through a memory map.

Distribution.  Texts are packed in batches of some BATCH bytes, kept in the shared
folder; texts above that are cut between words into several.
1  A batch sends each shard of words its distinct words with their counts, and each
   shard of contexts its distinct trigrams with theirs; a string that fills the corpus
   costs a row a batch.
2  A shard sums words by their bytes and answers with counts; it builds its trie
   from the trigrams' counts and answers each distinct trigram from the trie with two
   numbers a and b, log-coded in steps of STEP: p3 = a + b p1(w).
3  The batch adds up log10(a + b p1(w)) over the tokens of each text.
A shard holds what some SHARD_BYTES of text give at any size of the corpus, and shards
are dealt by their number.  A word v that makes up a large share of the corpus would not
fit: its trigrams are dealt by u, and those of a hot pair (u, v) by w.  A part (u, v)
then answers with its own two codes, a part of a hot pair with counts; the batch sends
the bigrams (v, w) of hot words as well, dealt by w, and is told their counts; c(v),
types(v), c(u v) and types(u v) are summed over the parts, a row for each hot word and
pair.  From these the batch reckons the same a and b, in the same codes.

Words outside the FREQUENT words of a bounded sample, which have short codes, are known
by 48 bits of hash in n-grams (never in p1).  Which words and pairs that sample calls
frequent or hot steers cost alone.

Edge cases: null and empty texts have the end token only; texts of any length are
taken whole; repeated rows are scored alike and counted as often as they occur; a null
doc_id hashes as ""; an empty table gives no rows; without training rows every word is
unseen; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import tempfile
import zlib
from collections import Counter, defaultdict
from itertools import count, islice

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import TEXT_ROWS, byte_words, id_text, release, sampled, stored, table
from gridloom.sources.storage import drop_shuffles

DISCOUNT = 0.75
BATCH = 3_000_000
SHARD_BYTES = 8_000_000  # of text to a shard
PACK_ROWS = 8  # packs in an Arrow batch
SAMPLE = 4000
FREQUENT = 65_000
FREQUENT_BYTES = 64
PAIR_LEAST = 50  # occurrences of a pair in the sample
SPREAD = 4  # a part of a hot word or pair holds at most about a SPREADth of a shard
START, END = 0, 1
RARE = 1 << 16  # ids from here on are 48 bits of hash
ESCAPE = RARE - 1
BY_U, BY_W = 1 << 50, 1 << 51  # marks of the parts of hot words and of hot pairs; the word is in their low 16 bits
STEP, FINE = 0.04, 0.0002
NONE = -(1 << 63)
_END_WORD = b" "  # no word holds a space
_GAP = re.compile(rb"[\x09-\x0d ]")
_M = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


# --- Elias-Fano ---------------------------------------------------------------


class EliasFano:
    """A non-decreasing sequence: low bits packed, high parts in unary, with a rank for each word of 64 bits."""

    def __init__(self, n: int, low: int, lower: np.ndarray, upper: np.ndarray, ranks: np.ndarray):
        self.n, self.low, self.lower, self.upper, self.ranks = n, low, lower, upper, ranks
        self.zeros = np.arange(len(ranks), dtype=np.int64) * 64 - ranks  # before each word

    @classmethod
    def build(cls, x: np.ndarray) -> EliasFano:
        x = x.astype(np.uint64)
        n = len(x)
        low = max(0, int(x[-1] // np.uint64(n)).bit_length() - 1) if n else 0
        lower = np.zeros(n * low // 64 + 2, np.uint64)
        if low:
            bit = np.arange(n, dtype=np.int64) * low
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            part = x & np.uint64((1 << low) - 1)
            first = np.flatnonzero(np.diff(word, prepend=-1))  # of the elements that begin in a word
            lower[word[first]] = np.add.reduceat(part << shift, first)
            over = np.flatnonzero(shift > 64 - low)
            lower[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
        at = (x >> np.uint64(low)).astype(np.int64) + np.arange(n)
        unary = np.zeros(((int(at[-1]) + 2 if n else 1) + 63) // 64 * 64, np.uint8)
        unary[at] = 1
        upper = np.packbits(unary, bitorder="little").view(np.uint64)
        ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(upper), dtype=np.int64)))
        return cls(n, low, lower.view(np.uint8), upper, ranks)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low], np.int64), self.lower, self.upper, self.ranks]

    @classmethod
    def of(cls, a: list[np.ndarray]) -> EliasFano:
        return cls(int(a[0][0]), int(a[0][1]), *a[1:4])

    @staticmethod
    def _nth(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one of each word: the byte by running sums of the bytes' ones, the bit by a table."""
        k = k.astype(np.uint64)
        s = word - ((word >> _B[1]) & _B[0x55])
        s = (s & _B[0x33]) + ((s >> _B[2]) & _B[0x33])
        s = ((s + (s >> _B[4])) & _B[0x0F]) * _ONES
        byte = (((((k * _ONES) | _B[0x80]) - s) & _B[0x80]) >> _B[7]) * _ONES >> _B[56] << _B[3]
        left = k - (((s << _B[8]) >> byte) & _B[0xFF])
        return (byte + _SELECT[((word >> byte) & _B[0xFF]) << _B[3] | left]).astype(np.int64)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.int64)
        bit = i * self.low
        words = np.ndarray((len(self.lower) - 7,), "<u8", np.ascontiguousarray(self.lower), 0, (1,))
        return ((words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)).astype(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.int64)
        word = np.searchsorted(self.ranks, i, side="right") - 1
        high = word * 64 + self._nth(self.upper[word], i - self.ranks[word]) - i
        return (high << self.low) | self._lows(i)

    def _below(self, h: np.ndarray) -> np.ndarray:
        """How many elements have a high part of at most h."""
        out = np.full(len(h), self.n)
        some = np.flatnonzero(h < self.zeros[-1])
        k = h[some]
        word = np.searchsorted(self.zeros, k, side="right") - 1
        out[some] = word * 64 + self._nth(~self.upper[word], k - self.zeros[word]) - k
        return out

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Position of x in [lo, hi), -1 if it is not there: the successor search of a run."""
        out = np.full(len(x), -1)
        ask = np.flatnonzero(lo < hi)
        x, lo, hi = x[ask], lo[ask], hi[ask]
        h, low = x >> self.low, x & ((1 << self.low) - 1)
        a = np.where(h > 0, self._below(np.maximum(h - 1, 0)), 0)
        # the candidates are the run of ones from there; a run that leaves its word is counted the long way
        at = np.minimum(a + h, 64 * len(self.upper) - 1)
        word = ~(self.upper[at >> 6] >> (at & 63).astype(np.uint64))
        run = np.bitwise_count((word & (~word + _B[1])) - _B[1]).astype(np.int64)
        b = a + run
        far = np.flatnonzero(run + (at & 63) >= 64)
        b[far] = self._below(h[far])
        a, b = np.maximum(a, lo), np.minimum(b, hi)
        end = b.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):  # among elements of one high part
            mid = (a[open_] + b[open_]) >> 1
            less = self._lows(mid) < low[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
            open_ = open_[a[open_] < b[open_]]
        hit = np.flatnonzero(a < end)
        hit = hit[self._lows(a[hit]) == low[hit]]
        out[ask[hit]] = a[hit]
        return out


#: Shifts and masks as words; masks repeat a byte.
_B = {k: np.uint64(k) for k in (1, 2, 3, 4, 7, 8, 56, 63, 0xFF)} | {k: np.uint64(int.from_bytes(bytes([k]) * 8)) for k in (0x55, 0x33, 0x0F, 0x80)}
_ONES = np.uint64(int.from_bytes(b"\1" * 8))
_SELECT = np.zeros(256 * 8, np.uint64)
for _b in range(256):
    for _k, _p in enumerate([p for p in range(8) if _b >> p & 1]):
        _SELECT[_b * 8 + _k] = _p


def _codes(p: np.ndarray, step: float, top: int) -> np.ndarray:
    """Steps of -log10 p; top is zero."""
    code = np.full(len(p), top, np.int64)
    some = p > 0
    code[some] = np.clip(np.round(-np.log10(p[some]) / step), 0, top - 1)
    return code


def _fine(p: np.ndarray) -> np.ndarray:
    return _codes(p, FINE, 65535).astype(np.uint16)


def _log_code(p: np.ndarray) -> np.ndarray:
    return _codes(p, STEP, 255).astype(np.uint8)


#: The values of the codes.
_P = np.append(10.0 ** (-STEP * np.arange(255)), 0.0)
_FINE = np.append(10.0 ** (-FINE * np.arange(65535)), 0.0)


class Trie:
    """Contexts v; their successors; the words u before them; and successors of (u, v).

    Words are numbers below 2 ** bits.  Levels: contexts, word pointers, words, before
    pointers, before, pointers, places; codes: of contexts, words, before, places.
    Contexts from BY_U on are parts of a word: they know (u, v) alone, and hand on p2 whole.
    """

    KINDS = ("uint8", "int64", "uint16", "uint64")

    def __init__(self, levels: list[EliasFano], codes: list[np.ndarray], shape: np.ndarray):
        self.contexts, self.word_at, self.words, self.before_at, self.before, self.place_at, self.places = self.levels = levels
        self.back, self.share, self.back_pair, self.share_pair = self.codes = codes
        self.shape, self.bits, self.most = shape, int(shape[0]), int(shape[1])

    @classmethod
    def build(cls, bits: int, v: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray) -> Trie:
        """Distinct trigrams in the order of v, u, w, and how often they occur."""
        contexts, first = np.unique(v, return_index=True)
        of = np.repeat(np.arange(len(contexts)), np.diff(np.append(first, len(v))))
        pair, back = np.unique((of << bits) | w, return_inverse=True)
        count = np.bincount(back, n, len(pair))
        run = pair >> bits
        total, types = np.bincount(of, n, len(contexts)), np.bincount(run, minlength=len(contexts))
        word_at = np.concatenate(([0], np.cumsum(types)))
        new = np.ones(len(v), bool)
        new[1:] = (of[1:] != of[:-1]) | (u[1:] != u[:-1])
        begin = np.flatnonzero(new)
        pair_of = np.cumsum(new) - 1
        pair_total, pair_types = np.bincount(pair_of, n, len(begin)), np.diff(np.append(begin, len(v)))
        before_at = np.concatenate(([0], np.cumsum(np.bincount(of[begin], minlength=len(contexts)))))
        most = int(types.max()) if len(types) else 1
        levels = [contexts, word_at, pair, before_at, (of[begin] << bits) | u[begin], np.append(begin, len(v)), pair_of * most + back - word_at[of]]
        part = contexts >= BY_U
        values = [np.where(part, 1, DISCOUNT * types / total), np.where(part[run], 0, (count - DISCOUNT) / total[run]), DISCOUNT * pair_types / pair_total, (n - DISCOUNT) / pair_total[pair_of]]
        return cls([EliasFano.build(x) for x in levels], [_fine(x) for x in values], np.array([bits, most], np.int64))

    def arrays(self) -> list[np.ndarray]:
        return [self.shape, *[a for e in self.levels for a in e.arrays()], *self.codes]

    def save(self, path: str) -> None:
        parts = self.arrays()
        with open(path, "wb") as f:
            at, table_ = 8 * 3 * len(parts), []
            for a in parts:
                at = -(-at // 8) * 8
                table_.append([at, len(a), self.KINDS.index(a.dtype.name)])
                at += a.nbytes
            f.write(np.array(table_, np.int64).tobytes())
            for a, (start, _, _) in zip(parts, table_, strict=True):
                f.write(b"\0" * (start - f.tell()))
                f.write(a.tobytes())

    @classmethod
    def mapped(cls, path: str) -> Trie:
        raw = np.memmap(path, np.uint8, "r")
        parts, count = [], 1 + 7 * 4 + 4
        for start, n, kind in raw[: 8 * 3 * count].view(np.int64).reshape(count, 3).tolist():
            dtype = np.dtype(cls.KINDS[kind])
            parts.append(raw[start : start + n * dtype.itemsize].view(dtype).view(np.ndarray))
        return cls([EliasFano.of(parts[1 + 4 * i : 5 + 4 * i]) for i in range(7)], parts[29:], parts[0])

    def lookup(self, v: np.ndarray, pair_v: np.ndarray, pair_w: np.ndarray, ctx_v: np.ndarray, ctx_u: np.ndarray, tri_ctx: np.ndarray, tri_pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """a of trigrams and b of contexts (u, v), p3 = a + b p1.  Distinct contexts v; pairs (v, w) and
        contexts (v, u) by places in v; trigrams by places in the contexts and in the pairs."""
        at = self.contexts.find(v, np.zeros(len(v), np.int64), np.full(len(v), self.contexts.n))
        seen = np.flatnonzero(at >= 0)
        word_lo, word_hi, before_lo, before_hi = (np.zeros(len(v), np.int64) for _ in range(4))
        for out, level, k in ((word_lo, self.word_at, 0), (word_hi, self.word_at, 1), (before_lo, self.before_at, 0), (before_hi, self.before_at, 1)):
            out[seen] = level[at[seen] + k]
        back = np.ones(len(v))
        back[seen] = _FINE[self.back[at[seen]]]
        pair_at = self.words.find((at[pair_v] << self.bits) | pair_w, word_lo[pair_v], word_hi[pair_v])
        share = np.zeros(len(pair_v))
        share[pair_at >= 0] = _FINE[self.share[pair_at[pair_at >= 0]]]
        place = np.where(pair_at >= 0, pair_at - word_lo[pair_v], -1)
        ctx_at = self.before.find((at[ctx_v] << self.bits) | ctx_u, before_lo[ctx_v], before_hi[ctx_v])
        known = np.flatnonzero(ctx_at >= 0)
        back_pair, lo, hi = np.ones(len(ctx_v)), np.zeros(len(ctx_v), np.int64), np.zeros(len(ctx_v), np.int64)
        back_pair[known], lo[known], hi[known] = _FINE[self.back_pair[ctx_at[known]]], self.place_at[ctx_at[known]], self.place_at[ctx_at[known] + 1]
        ask = np.flatnonzero((ctx_at[tri_ctx] >= 0) & (place[tri_pair] >= 0))
        c, p = tri_ctx[ask], place[tri_pair[ask]]
        found = self.places.find(ctx_at[c] * self.most + p, lo[c], hi[c])
        a = back_pair[tri_ctx] * share[tri_pair]
        a[ask[found >= 0]] += _FINE[self.share_pair[found[found >= 0]]]
        return a, back_pair * back[ctx_v]


# --- words, parts and batches ---------------------------------------------------


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a.astype(np.uint64) * _M[0] + b.astype(np.uint64) * _M[1]
    h ^= h >> np.uint64(29)
    h *= _M[2]
    return h ^ (h >> np.uint64(32))


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Vocabulary:
    """Frequent words of a bounded sample with short codes, and in how many parts hot words and pairs are dealt."""

    def __init__(self, words: list[str], classes: np.ndarray, pairs: dict[tuple[int, int], int]):
        self.state = words, classes, pairs  # plain values for a broadcast
        self.ids = {w.encode(): i + 2 for i, w in enumerate(words)}
        self.words = [b"", _END_WORD, *self.ids]
        self.hashes = _hashed(self.words)
        self.classes = np.ones(RARE, np.int64)
        self.classes[: len(classes)] = classes
        self.pair_keys = np.array(sorted(u * RARE + v for u, v in pairs), np.int64)
        self.pair_classes = np.array([pairs[divmod(k, RARE)] for k in self.pair_keys.tolist()], np.int64)

    @staticmethod
    def context(x: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The context of the model after x, u and v: the word v, in however many parts it is dealt."""
        return v

    def part(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Where trigrams of hot words v are counted: in a part by u, or of a hot pair (u, v) by w."""
        out = BY_U | (_mix(u, np.ones(1)) % self.classes[v].astype(np.uint64)).astype(np.int64) << 16 | v
        if len(self.pair_keys):
            key = np.where(u < RARE, u * RARE + v, -1)
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            hot = np.flatnonzero(self.pair_keys[at] == key)
            # pairs of one v begin at different parts, so that they spread
            place = (_mix(u[hot], np.full(1, 7)) >> np.uint64(34)) + _mix(w[hot], np.ones(1)) % self.pair_classes[at[hot]].astype(np.uint64)
            out[hot] = BY_W | (place & np.uint64((1 << 30) - 1)).astype(np.int64) << 16 | v[hot]
        return out

    def contexts(self, numbers: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where trigrams of words given by places in numbers are counted, by v or a part of it: the
        distinct contexts, and each one's place in them.  Only hot words are looked at one by one."""
        parted = (self.classes[np.minimum(numbers, ESCAPE)] > 1) & (numbers < RARE)
        some = np.flatnonzero(parted[v])
        own, rank = np.unique(self.part(numbers[u[some]], numbers[v[some]], numbers[w[some]]), return_inverse=True)
        at = v.copy()
        at[some] = len(numbers) + rank
        used = np.zeros(len(numbers) + len(own), bool)
        used[at] = True
        place = np.cumsum(used) - 1
        # a word may be in numbers twice: one place for both
        distinct, first = np.unique(np.append(numbers, own)[used], return_inverse=True)
        return distinct, first[place[at]]


def vocabulary(rows: DataFrame, shards: int) -> Vocabulary:
    some = stored(rows.where(sampled(SAMPLE / max(1, rows.count()), "doc_id", "text")).select("text"))

    def count(batches):
        words, pairs = Counter(), Counter()
        for b in batches:
            for t in b["text"]:
                w = byte_words(t)
                words.update(w)
                words[b""] += 1
                pairs.update(zip([b"", *w], w, strict=False))
        yield pd.DataFrame({"u": b"\n", "v": list(words), "n": list(words.values())})
        often = [(u, v, n) for (u, v), n in pairs.items() if n >= 4]
        if often:
            yield pd.DataFrame(often, columns=["u", "v", "n"])

    got = stored(some.mapInPandas(count, "u binary, v binary, n long"), TEXT_ROWS).groupBy("u", "v").agg(F.sum("n").alias("n"))
    got = got.where(F.octet_length("v") <= FREQUENT_BYTES)
    is_word = F.col("u") == F.lit(b"\n")
    top = got.where(is_word & (F.octet_length("v") > 0)).orderBy(F.desc("n"), "v").limit(FREQUENT).collect()
    total = max(1, got.where(is_word).agg(F.sum("n")).first()[0] or 1)
    starts = (got.where(is_word & (F.octet_length("v") == 0)).agg(F.sum("n")).first()[0] or 0) / total
    parts = lambda n: max(1, int(np.ceil(n / total * shards * SPREAD)))
    ids = {bytes(r["v"]): i + 2 for i, r in enumerate(top)} | {b"": START}
    least = max(PAIR_LEAST, total // (shards * SPREAD))
    pairs = {}
    for r in got.where(~is_word & (F.col("n") >= least)).collect():  # fewer than the sample's words / PAIR_LEAST
        u, v = ids.get(bytes(r["u"])), ids.get(bytes(r["v"]))
        if u is not None and v is not None and parts(r["n"]) > 1:
            pairs[u, v] = parts(r["n"])
    classes = np.array([parts(starts * total), 1, *[parts(r["n"]) for r in top]], np.int64)
    if classes[START] > 1:  # the first words of texts
        pairs[START, START] = int(classes[START])
    pairs = {(u, v): n for (u, v), n in pairs.items() if classes[v] > 1}
    return Vocabulary([bytes(r["v"]).decode() for r in top], classes, pairs)


def packed(rows: DataFrame) -> DataFrame:
    """batch, and of each text or piece: id, batch and place of its first piece, whether it is the last one,
    how many leading words are only context, bytes, whether it is whole; body."""

    def pieces(raw: bytes):
        at = 0
        while True:
            gap = _GAP.search(raw, at + BATCH) if len(raw) - at > BATCH else None
            end = gap.start() if gap else len(raw)
            width, before = 256, []
            while at:
                before = raw[max(0, at - width) : at].split()
                if len(before) > 3 or width >= at:
                    break
                width *= 4
            before = before[-3:]
            yield b" ".join([*before, raw[at:end]]), len(before), end == len(raw)
            if end == len(raw):
                return
            at = end

    def work(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held, bodies, size = [], [], 0

        def row():
            return pd.DataFrame({"batch": [(part << 32) | seq], "docs": [np.array(held, np.int64).tobytes()], "body": [zstandard.ZstdCompressor(level=3).compress(b"".join(bodies))]})

        for b in batches:
            for i, t in zip(b["doc_id"].tolist(), b["text"], strict=True):
                first = None
                for body, lead, last in pieces(t.encode("utf-8", "replace")):
                    if size and size + len(body) > BATCH or len(held) >= 50_000:
                        yield row()
                        held, bodies, size, seq = [], [], 0, seq + 1
                    first = first or ((part << 32) | seq, len(held))
                    held.append((i, *first, last, lead, len(body), last and first == ((part << 32) | seq, len(held))))
                    bodies.append(body)
                    size += len(body)
        if held:
            yield row()

    rows = rows.select(F.coalesce("doc_id", F.lit(NONE)).alias("doc_id"), "text")
    return stored(rows.mapInPandas(work, "batch long, docs binary, body binary"), TEXT_ROWS, compression="none", **{"parquet.block.size": str(16 << 20)})


class Batch:
    """A pack's texts as words and trigrams, in an order that follows from the pack alone."""

    def __init__(self, docs: bytes, body: bytes, voc: Vocabulary, shards: int, folds: int, held: int):
        self.docs = np.frombuffer(docs, np.int64).reshape(-1, 7)
        raw = memoryview(zstandard.ZstdDecompressor().decompress(body, max_output_size=int(self.docs[:, 5].sum()) + 1))
        words: list[bytes] = []
        size = np.zeros(len(self.docs), np.int64)
        at = 0
        for k, n in enumerate(self.docs[:, 5].tolist()):
            w = bytes(raw[at : at + n]).lower().split()
            words += w
            size[k] = len(w)
            at += n
        # a word's place: frequent ones by id, then rare ones by first occurrence
        places = defaultdict(count(RARE).__next__, voc.ids)
        known = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
        del words
        rare = np.flatnonzero(known >= RARE)
        rare_words = list(islice(places, len(voc.ids), None))
        rare_hash = _hashed(rare_words)
        # each text: START three times, its words, END if it is the last piece
        lead, last, first = self.docs[:, 4], self.docs[:, 3], (self.docs[:, 4] == 0).astype(np.int64) * 3
        length = first + size + last
        begin = np.cumsum(length) - length
        ids, place = np.full(int(length.sum()), START), np.full(int(length.sum()), -1)
        to = np.arange(len(known)) + np.repeat(begin + first - (np.cumsum(size) - size), size)
        number = known.copy()
        number[rare] = RARE + (rare_hash[known[rare] - RARE] >> np.uint64(16)).astype(np.int64)
        ids[to] = number
        place[to] = known
        ends = (begin + length - 1)[last == 1]
        ids[ends] = place[ends] = END
        doc = np.repeat(np.arange(len(length)), length)
        token = np.arange(len(ids)) - begin[doc] >= np.where(lead > 0, lead, 3)[doc]
        # a later piece may have fewer than three words before it; START stands for the others
        i = np.flatnonzero(token)
        self.doc, word = doc[i], place[i]
        far = begin[self.doc]
        before = [np.where(i - k >= far, i - k, -1) for k in (1, 2)]
        train = np.array([zlib.crc32(b"" if d == NONE else str(d).encode()) % folds != held for d in self.docs[:, 0].tolist()], bool)
        weight = train[self.doc].astype(np.int64)
        # words
        frequent = np.zeros(RARE, bool)
        frequent[word[word < RARE]] = True
        some = np.flatnonzero(frequent)
        self.words = [*[voc.words[k] for k in some.tolist()], *rare_words]
        index = np.zeros(RARE, np.int64)
        index[some] = np.arange(len(some))
        rare_token = word >= RARE
        self.word = np.where(rare_token, word - RARE + len(some), index[np.minimum(word, ESCAPE)])
        self.word_count = np.bincount(self.word, weight, len(self.words)).astype(np.int64)
        shard = _shard(np.concatenate((voc.hashes[some], rare_hash)), shards)
        self.word_order = np.argsort(shard, kind="stable")
        self.word_shards, cut = np.unique(shard[self.word_order], return_index=True)
        self.word_cut = np.append(cut, len(self.words))
        # trigrams, by the places of their words here; the last place is that of START
        numbers = np.append(np.where(some < RARE, some, 0), np.concatenate((RARE + (rare_hash >> np.uint64(16)).astype(np.int64), [START])))
        at = np.full(len(ids) + 1, len(numbers) - 1)
        at[i] = self.word
        # words that are only context here
        lone = np.flatnonzero(~token & (place >= 0))
        if len(lone):
            more, rank = np.unique(ids[lone], return_inverse=True)
            at[lone] = len(numbers) + rank
            numbers = np.append(numbers, more)
        v, u = (at[k] for k in before)  # -1: START
        contexts, v = voc.contexts(numbers, u, v, self.word)
        shard = _shard(_mix(contexts, np.full(1, 3)), shards)
        by = np.lexsort((contexts, shard))
        rank = np.zeros(len(by), np.int64)
        rank[by] = np.arange(len(by))
        bits = max(1, int(len(numbers)).bit_length())
        key = ((rank[v] << bits | u) << bits) | self.word
        key, self.tri = np.unique(key, return_inverse=True)
        self.count = np.bincount(self.tri, weight, len(key)).astype(np.int64)
        mask = (1 << bits) - 1
        w, pair = key & mask, key >> bits
        self.w = numbers[w]
        new = np.ones(len(key), bool)
        new[1:] = pair[1:] != pair[:-1]
        self.pair_begin = np.flatnonzero(new)
        self.pair_of = np.cumsum(new) - 1
        pair = pair[self.pair_begin]
        self.u, ctx = numbers[pair & mask], pair >> bits
        new = np.ones(len(ctx), bool)
        new[1:] = ctx[1:] != ctx[:-1]
        self.ctx_begin = np.flatnonzero(new)
        ctx_of = np.cumsum(new) - 1
        ctx = by[ctx[self.ctx_begin]]
        self.v, shard = contexts[ctx], shard[ctx]
        self.shards, cut = np.unique(shard, return_index=True)
        self.cut = np.append(cut, len(shard))
        # bigrams of hot words, each word's dealt by the second word
        self.kind = (self.v >> 50)[ctx_of]  # of pairs; 1 in BY_U, 2 in BY_W
        self.hot = np.flatnonzero(self.kind[self.pair_of])
        hot_v = (self.v & ESCAPE)[ctx_of]
        key, bigram = np.unique(hot_v[self.pair_of[self.hot]] << bits | w[self.hot], return_inverse=True)
        big_v, big_w = key >> bits, numbers[key & mask]
        shard = _shard(_mix(big_v, _mix(big_w, np.full(1, 5)) % voc.classes[big_v].astype(np.uint64)), shards)
        by = np.argsort(shard, kind="stable")
        rank = np.zeros(len(by), np.int64)
        rank[by] = np.arange(len(by))
        self.bigram, self.big_v, self.big_w = rank[bigram], big_v[by], big_w[by]
        self.big_count = np.bincount(bigram, self.count[self.hot], len(key)).astype(np.int64)[by]
        self.big_shards, cut = np.unique(shard[by], return_index=True)
        self.big_cut = np.append(cut, len(by))
        self.hot_pair = self.u * RARE + hot_v  # of pairs in BY_W

    def messages(self, batch: int):
        """(shard, kind, batch, blob)."""
        press = zstandard.ZstdCompressor(level=1)
        for s, a, z in zip(self.word_shards.tolist(), self.word_cut, self.word_cut[1:], strict=False):
            mine = self.word_order[a:z]
            yield s, 0, batch, press.compress(_planes(*_small(self.word_count[mine]), np.frombuffer(b"\n".join([self.words[i] for i in mine.tolist()]), np.uint8)))
        ctx, pair = np.append(self.ctx_begin, len(self.u)), np.append(self.pair_begin, len(self.w))
        for s, a, z in zip(self.shards.tolist(), self.cut, self.cut[1:], strict=False):
            c0, c1 = ctx[a], ctx[z]
            e0, e1 = pair[c0], pair[c1]
            planes = [self.v[a:z], *_small(np.diff(ctx[a : z + 1])), *_small(np.diff(pair[c0 : c1 + 1])), *_small(self.count[e0:e1])]
            planes += [*_short(self.u[c0:c1]), *_short(self.w[e0:e1])]
            yield s, 1, batch, press.compress(_planes(*planes))
        for s, a, z in zip(self.big_shards.tolist(), self.big_cut, self.big_cut[1:], strict=False):
            v, first = np.unique(self.big_v[a:z], return_index=True)
            yield s, 3, batch, press.compress(_planes(v.astype(np.uint16), np.diff(np.append(first, z - a)).astype(np.uint32), *_small(self.big_count[a:z]), *_short(self.big_w[a:z])))

    def probabilities(self, p1: np.ndarray, coded: list[list[np.ndarray]], bigrams: np.ndarray, words: Totals, pairs: Totals) -> np.ndarray:
        """p3 of each token from p1, the shards' answers in their order and the totals of hot words and pairs."""
        if not coded:
            return p1
        a, back, own, own_back, counts = (np.concatenate([g[k] for g in coded]) for k in range(5))
        tri_kind = self.kind[self.pair_of]
        share3, rest, rest3 = np.zeros(len(self.hot)), np.ones(len(self.kind)), np.ones(len(self.kind))
        value, value_back = np.zeros(len(tri_kind)), np.zeros(len(self.kind))
        value[tri_kind == 0], value_back[self.kind == 0] = _P[a], _P[back]
        if len(self.hot):
            # the word before
            total, types = words.of(self.big_v)
            share = _FINE[_fine(np.where(bigrams > 0, bigrams - DISCOUNT, 0) / np.maximum(total, 1))][self.bigram]
            some = np.flatnonzero(self.kind)
            total, types = words.of(self.hot_pair[some] % RARE)
            rest[some] = np.where(total > 0, _FINE[_fine(DISCOUNT * types / np.maximum(total, 1))], 1)
            # the two words before
            of = self.pair_of[self.hot]
            kind = self.kind[of]
            share3[kind == 1], rest3[self.kind == 1] = _FINE[own], _FINE[own_back]
            some = np.flatnonzero(self.kind == 2)
            total, types = (np.zeros(len(self.kind), np.int64) for _ in range(2))
            total[some], types[some] = pairs.of(self.hot_pair[some])
            rest3[some] = np.where(total[some] > 0, _FINE[_fine(DISCOUNT * types[some] / np.maximum(total[some], 1))], 1)
            share3[kind == 2] = _FINE[_fine(np.where(counts > 0, counts - DISCOUNT, 0) / np.maximum(total[of[kind == 2]], 1))]
            value[self.hot] = _P[_log_code(rest3[of] * share + share3)]
            some = np.flatnonzero(self.kind)
            value_back[some] = _P[_log_code(rest3[some] * rest[some])]
        return value[self.tri] + value_back[self.pair_of[self.tri]] * p1


class Totals:
    """Occurrences and distinct successors of hot words or pairs, by number."""

    def __init__(self, keys: np.ndarray, total: np.ndarray, types: np.ndarray):
        by = np.argsort(keys)
        self.keys, self.total, self.types = keys[by], total[by], types[by]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.total[at], 0), np.where(hit, self.types[at], 0)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _planes(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64).tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])


def _opened(blob: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, n, 8).tolist(), 8 + 8 * n, []
    for size, t in zip(sizes, types, strict=True):
        out.append(np.frombuffer(raw, t, size // np.dtype(t).itemsize, at))
        at += size
    return out


def _short(ids: np.ndarray) -> list[np.ndarray]:
    """Numbers of words as planes: two of the short ones, one of the others' hashes."""
    far = ids >= ESCAPE
    short = np.where(far, ESCAPE, ids).astype(np.uint16)
    return [(short & 255).astype(np.uint8), (short >> 8).astype(np.uint8), np.ascontiguousarray((ids[far] - RARE).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).ravel()]


def _small(n: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes, and those from 255 on."""
    return [np.minimum(n, 255).astype(np.uint8), n[n >= 255].astype(np.uint32)]


def _counts(n: np.ndarray, more: np.ndarray) -> np.ndarray:
    out = n.astype(np.int64)
    out[n == 255] = more
    return out


def _bytes(n: np.ndarray, width: int = 8) -> np.ndarray:
    """Numbers as planes of their bytes, one after the other."""
    return np.ascontiguousarray(n.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).ravel()


def _numbers(planes: np.ndarray, width: int = 8) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def _ids(low: np.ndarray, high: np.ndarray, far: np.ndarray) -> np.ndarray:
    out = low.astype(np.int64) | high.astype(np.int64) << 8
    wide = np.zeros((len(far) // 6, 8), np.uint8)
    wide[:, :6] = far.reshape(-1, 6)
    out[out == ESCAPE] = RARE + wide.view("<u8").ravel().astype(np.int64)
    return out


def _by_shard(batches, columns: list[str]):
    """(shard, rows) of a partition sorted by shard, one shard at a time."""
    held: list = []
    for b in batches:
        for row in zip(*[b[c] for c in columns], strict=True):
            if held and held[-1][0] != row[0]:
                yield held[-1][0], held
                held = []
            held.append(row)
    if held:
        yield held[-1][0], held


def count_words(blobs: list[bytes]) -> tuple[list[np.ndarray], int, int]:
    """Each message's words' counts over all messages, and the sum and number of words that occur."""
    places: dict[bytes, int] = {}
    counts, parts = [], []
    for blob in blobs:
        *n, raw = _opened(blob, np.uint8, np.uint32, np.uint8)
        words = raw.tobytes().split(b"\n")
        parts.append(np.fromiter((places.setdefault(w, len(places)) for w in words), np.int64, len(words)))
        counts.append(_counts(*n))
    total = np.bincount(np.concatenate(parts), np.concatenate(counts), len(places)).astype(np.int64)
    return [total[p] for p in parts], int(total.sum()), int((total > 0).sum())


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of n and the number of those above zero."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, n, len(distinct)).astype(np.int64), np.bincount(at, n > 0, len(distinct)).astype(np.int64)


def count_bigrams(blobs: list[bytes]) -> tuple[list[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each message's bigrams' counts over all messages; of each first word, its occurrences and successors here."""
    vs, per, ws, counts = [], [], [], []
    for blob in blobs:
        v, per_v, n, more, *planes = _opened(blob, np.uint16, np.uint32, np.uint8, np.uint32, *[np.uint8] * 3)
        vs.append(v)
        per.append(per_v)
        ws.append(_ids(*planes))
        counts.append(_counts(n, more))
    v, vi = np.unique(np.concatenate(vs), return_inverse=True)  # numbers of words have 49 bits
    key, at = np.unique(np.repeat(vi.astype(np.uint64), np.concatenate(per)) << np.uint64(49) | np.concatenate(ws).astype(np.uint64), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)
    cut = np.cumsum([len(n) for n in counts])[:-1]
    return [zstandard.compress(_bytes(n).tobytes(), 1) for n in np.split(total[at], cut)], _sums(v.astype(np.int64)[(key >> np.uint64(49)).astype(np.int64)], total)


def answer_trigrams(blobs: list[bytes]) -> tuple[list[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Builds the trie of the messages' trigrams and answers each message from it: of whole contexts a and b
    of trigrams and pairs, of parts by u the codes of (u, v), of parts by w counts.  Of each hot pair, its
    occurrences and successors here."""
    shape, vs, us, ws, ns = [], [], [], [], []
    for blob in blobs:
        v, *planes = _opened(blob, np.int64, *[np.uint8, np.uint32] * 3, *[np.uint8] * 6)
        per_v, per_u, n = (_counts(*planes[k : k + 2]) for k in (0, 2, 4))
        u, w = _ids(*planes[6:9]), _ids(*planes[9:])
        shape.append((len(u), len(w)))
        vs.append(np.repeat(v, per_v))
        us.append(u)
        ws.append(w)
        ns.append((n, per_u))
    u, w = np.concatenate(us), np.concatenate(ws)
    us = ws = None
    rare = np.unique(np.concatenate((u[u >= RARE], w[w >= RARE])))
    for ids in (u, w):
        far = ids >= RARE
        ids[far] = RARE + np.searchsorted(rare, ids[far])
    bits = int(RARE + len(rare)).bit_length()
    del rare
    v, vi = np.unique(np.concatenate(vs), return_inverse=True)
    ctx, ci = np.unique((vi << bits) | u, return_inverse=True)
    del vs, vi, u
    per_u = np.concatenate([p for _, p in ns])
    tri, back = np.unique((np.repeat(ci, per_u) << bits) | w, return_inverse=True)
    n = np.bincount(back, np.concatenate([n for n, _ in ns]), len(tri)).astype(np.int64)
    del w, ns, per_u
    mask = (1 << bits) - 1
    ctx_v, ctx_u, tri_ctx, tri_w = ctx >> bits, ctx & mask, tri >> bits, tri & mask
    del ctx, tri
    some = np.flatnonzero(n > 0)
    if len(some):
        fd, path = tempfile.mkstemp(suffix=".trie")
        os.close(fd)
        try:
            c = tri_ctx[some]
            Trie.build(bits, v[ctx_v[c]], ctx_u[c], tri_w[some], n[some]).save(path)
            trie = Trie.mapped(path)
        finally:
            os.unlink(path)
        del c, some
        pair, tri_pair = np.unique((ctx_v[tri_ctx] << bits) | tri_w, return_inverse=True)
        a, b = trie.lookup(v, pair >> bits, pair & mask, ctx_v, ctx_u, tri_ctx, tri_pair)
    else:
        a, b = np.zeros(len(tri_ctx)), np.ones(len(ctx_v))
    kind = (v >> 50)[ctx_v]
    tri_kind = kind[tri_ctx]
    whole, of = kind == 0, tri_kind == 0
    a, b = np.where(of, _log_code(a), _fine(a)), np.where(whole, _log_code(b), _fine(b))
    press, out, at_c, at_t = zstandard.ZstdCompressor(level=1), [], 0, 0
    for contexts, trigrams in shape:
        t, c = back[at_t : at_t + trigrams], ci[at_c : at_c + contexts]
        k, kc = tri_kind[t], kind[c]
        out.append(press.compress(_planes(a[t[k == 0]].astype(np.uint8), b[c[kc == 0]].astype(np.uint8), _bytes(a[t[k == 1]], 2), _bytes(b[c[kc == 1]], 2), _bytes(n[t[k == 2]]))))
        at_c, at_t = at_c + contexts, at_t + trigrams
    by_w = np.flatnonzero(tri_kind == 2)
    return out, _sums(ctx_u[tri_ctx[by_w]] * RARE + (v[ctx_v[tri_ctx[by_w]]] & ESCAPE), n[by_w])


def lm_scores(docs: DataFrame, folds: int = 7, held: int = 2, text: str = "text", doc_id: str = "doc_id", voc: Vocabulary | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = id_text(docs, text=text, doc_id=doc_id)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    shards = max(12, int(size // SHARD_BYTES))
    shared = spark.sparkContext.broadcast((voc or vocabulary(rows, shards)).state)  # FREQUENT words of FREQUENT_BYTES, and pairs of the sample
    packs = packed(rows)

    def ask(batches):
        voc = Vocabulary(*shared.value)
        for b in batches:
            for batch, d, body in zip(b["batch"], b["docs"], b["body"], strict=True):
                yield pd.DataFrame(list(Batch(d, body, voc, shards, folds, held).messages(batch)), columns=["shard", "kind", "batch", "blob"])
                release()

    def answer(batches):
        def answers(sent, kind, blobs):
            return pd.DataFrame({"batch": [r[2] for r in sent], "shard": sent[0][0], "kind": kind, "blob": blobs, "total": 0, "kinds": 0})

        def totals(shard, kind, keys, total, kinds):
            return pd.DataFrame({"batch": keys, "shard": shard, "kind": kind, "blob": b"", "total": total, "kinds": kinds})

        for shard, sent in _by_shard(batches, ["shard", "kind", "batch", "blob"]):
            words, trigrams, bigrams = ([r for r in sent if r[1] == kind] for kind in (0, 1, 3))
            sent.clear()
            total = kinds = 0
            if words:
                counts, total, kinds = count_words([r[3] for r in words])
                yield answers(words, 0, [zstandard.compress(_bytes(c).tobytes(), 1) for c in counts])
                del counts
            yield totals(shard, 2, [-1], total, kinds)
            for sent, kind, work in ((trigrams, 1, answer_trigrams), (bigrams, 3, count_bigrams)):  # noqa: B020
                if sent:
                    blobs, sums = work([r[3] for r in sent])
                    yield answers(sent, kind, blobs)
                    if len(sums[0]):
                        yield totals(shard, kind + 3, *sums)
            release()

    dealt = packs.mapInPandas(ask, "shard int, kind int, batch long, blob binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    told = stored(dealt.mapInPandas(answer, "batch long, shard int, kind int, blob binary, total long, kinds long"), PACK_ROWS, compression="none")
    drop_shuffles(spark)
    def summed(kind: int) -> tuple[np.ndarray, ...]:  # a row for each hot word or pair of the sample
        got = told.where(F.col("kind") == kind).groupBy("batch").agg(F.sum("total").alias("n"), F.sum("kinds").alias("k")).toPandas()
        return tuple(got[c].to_numpy(np.int64) for c in ("batch", "n", "k"))

    hot = spark.sparkContext.broadcast((summed(6), summed(4)))
    sums = told.where("kind = 2").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("v")).first()
    total, whole = int(sums["n"]), float(sums["n"] + sums["v"] + 1)

    def finish(batches):
        voc = Vocabulary(*shared.value)
        hot_words, hot_pairs = (Totals(*t) for t in hot.value)
        for b in batches:
            for d, body, answers in zip(b["docs"], b["body"], b["answers"], strict=True):
                pack = Batch(d, body, voc, shards, folds, held)
                n, texts = np.zeros(len(pack.words), np.int64), len(pack.docs)
                answers = sorted(answers if answers is not None else [], key=lambda r: (r["kind"], r["shard"]))
                n[pack.word_order] = np.concatenate([_numbers(np.frombuffer(zstandard.decompress(r["blob"]), np.uint8)) for r in answers if r["kind"] == 0] or [n])
                coded = [[x if k < 2 else _numbers(x, (2, 2, 8)[k - 2]) for k, x in enumerate(_opened(r["blob"], *[np.uint8] * 5))] for r in answers if r["kind"] == 1]
                bigrams = [_numbers(np.frombuffer(zstandard.decompress(r["blob"]), np.uint8)) for r in answers if r["kind"] == 3]
                p1 = ((n + 1) / whole)[pack.word]
                p = pack.probabilities(p1, coded, np.concatenate(bigrams or [np.zeros(0, np.int64)]), hot_words, hot_pairs)
                add = lambda x: np.bincount(pack.doc, x, texts)
                yield pd.DataFrame({
                    "doc_id": pack.docs[:, 0], "first": pack.docs[:, 1], "at": pack.docs[:, 2], "whole": pack.docs[:, 6] == 1, "n_tokens": add(None).astype(np.int64),
                    "n_known": add((n > 0)[pack.word]).astype(np.int64), "base_score": add(np.log10(p1)), "score": add(np.log10(p)),
                })
                release()

    answers = told.where("kind IN (0, 1, 3)").groupBy("batch").agg(F.collect_list(F.struct("kind", "shard", "blob")).alias("answers"))
    full = packs.join(answers.hint("merge"), "batch", "left").select("docs", "body", "answers")
    numbers = ("n_tokens", "n_known", "base_score", "score")
    scored = stored(full.mapInPandas(finish, "doc_id long, first long, at long, whole boolean, n_tokens long, n_known long, base_score double, score double"), PACK_ROWS)
    cut = scored.where("NOT whole").groupBy("first", "at").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in numbers])
    out = scored.where("whole").select("doc_id", *numbers).unionByName(cut.select("doc_id", *numbers))
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held
    out = out.withColumn("doc_id", F.when(F.col("doc_id") != NONE, F.col("doc_id")))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
