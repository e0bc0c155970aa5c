"""Suffix-array dedup: repeated strings of WINDOW bytes, by deep-shallow suffix sorting.

Every window of 50 bytes has an anchor: the leftmost of its 24-byte grams with
the least hash.  The anchor and its place in the window follow from the window's
bytes alone, so equal windows, wherever they start, have equal grams at their
anchors.  Consecutive windows share anchors; there are about 1 / 14 as many
anchors as bytes.

1  Texts are packed in batches of some BATCH bytes, kept in the shared folder.
2  A batch sends the distinct hashes of its anchors to shards, which answer with
   a bit each: does the gram occur in more than one document?
3  A batch sends the contexts of those anchors (the bytes of the windows they
   stand for) to shards, distinct ones once, with the smallest doc_id.
4  A shard sorts the contexts' suffixes from the anchor on: multikey quicksort
   (three-way, eight bytes to a character) to SHALLOW bytes; then blind tries for
   the groups that are still together.  From the order and its common prefixes,
   windows at each offset fall into classes of equal strings; the answer is each
   class's smallest doc_id.
5  A batch removes the bytes of windows whose class has a smaller doc_id.

A string that fills the corpus costs one row per batch and shard, whatever the
number of documents that have it; hashes only choose what is compared, equality
is decided on bytes.

Edge cases: null and empty texts, and texts under 50 bytes, lose nothing; texts
of any length are taken whole; a null doc_id counts as the largest; of rows with
one doc_id none is smaller; an empty table gives no rows; bytes of any value are
allowed; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import TEXT_ROWS, id_text, release, stored, table

WINDOW = 50
GRAM = 24
SHALLOW = GRAM
SPAN = WINDOW - GRAM + 1  # grams of a window, and offsets of an anchor
BATCH = 1_000_000
PACK_ROWS = 4  # packs of texts in an Arrow batch
SHARD_BYTES = 16_000_000  # of text to a shard
HASH_BYTES = 5
LAST = (1 << 63) - 1
_CHUNK = 1 << 17
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


# --- anchors ------------------------------------------------------------------


def _mix(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = a * _K[0]
    h ^= h >> np.uint64(29)
    h += b * _K[1]
    h ^= h >> np.uint64(31)
    h += c * _K[2]
    h ^= h >> np.uint64(30)
    h *= _K[3]
    h ^= h >> np.uint64(32)
    return h


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as numbers."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))


def window_anchors(buf: np.ndarray) -> np.ndarray:
    """For every window start the position of its anchor."""
    n = len(buf) - WINDOW + 1
    out = np.zeros(max(0, n), np.int32 if len(buf) < 1 << 31 else np.int64)
    for s in range(0, n, _CHUNK):
        m = min(_CHUNK, n - s)
        w = _words(np.ascontiguousarray(buf[s : s + m + WINDOW - 1])).astype(np.uint64)
        grams = m + SPAN - 1
        key = (_mix(w[:grams], w[8 : 8 + grams], w[16 : 16 + grams]) & ~np.uint64(0xFFFFFF)) | np.arange(grams, dtype=np.uint64)
        width = 1
        while width * 2 <= SPAN:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        least = np.minimum(key[:m], key[SPAN - width : SPAN - width + m])
        out[s : s + m] = (least & np.uint64(0xFFFFFF)).astype(out.dtype) + s
    return out


class Runs:
    """Runs of windows of a batch with one anchor: anchor, first and last window start, document, gram hash."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        long_ = sizes >= WINDOW
        if not long_.any():
            z = np.zeros(0, np.int64)
            self.anchor, self.first, self.last, self.doc, self.hash = z, z, z, z, z.astype(np.uint64)
            return
        edge = np.zeros(len(buf) + 1, np.int32)
        edge[starts[long_]] += 1
        edge[(starts + sizes)[long_] - WINDOW + 1] -= 1
        at = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int32))  # windows inside a document
        del edge
        anchor = window_anchors(buf)[at]
        cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)) + 1
        lo = np.concatenate(([0], cut))
        hi = np.concatenate((cut, [len(at)])) - 1
        self.anchor, self.first, self.last = anchor[lo].astype(np.int64), at[lo], at[hi]
        self.doc = np.searchsorted(starts, self.first, side="right") - 1
        # an empty document shares its start with the next one, which side="right" passes over
        w = _words(buf)
        h = _mix(w[self.anchor].astype(np.uint64), w[self.anchor + 8].astype(np.uint64), w[self.anchor + 16].astype(np.uint64))
        self.hash = _mix(h, h >> np.uint64(32), np.array([1], np.uint64))  # anchors have small hashes; shards need even ones


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Batch:
    """A row of packed texts."""

    def __init__(self, ids: bytes, sizes: bytes, body: bytes):
        self.ids, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=int(self.sizes.sum()) + 1), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.runs = Runs(self.buf, self.starts, self.sizes)

    def hashes(self, shards: int):
        """Distinct anchor hashes, whether each is in several documents here, the shards they go to, where
        each shard's begin, and each run's place."""
        distinct, back = np.unique(self.runs.hash, return_inverse=True)
        n = len(distinct)
        low, high = np.full(n, len(self.ids)), np.full(n, -1)
        np.minimum.at(low, back, self.runs.doc)
        np.maximum.at(high, back, self.runs.doc)
        present, first = np.unique(_shard(distinct, shards), return_index=True)
        return distinct, low != high, present, np.append(first, n), back

    def entries(self, shards: int, bits: dict[int, bytes]) -> Entries:
        """Distinct contexts of the anchors that are in several documents, by shard."""
        distinct, _, present, cut, back = self.hashes(shards)
        several = np.zeros(len(distinct), bool)
        for k, s in enumerate(present.tolist()):
            several[cut[k] : cut[k + 1]] = np.unpackbits(np.frombuffer(bits[s], np.uint8), count=int(cut[k + 1] - cut[k])).astype(bool)
        return Entries(self, np.flatnonzero(several[back]), shards)


class Entries:
    """Contexts: the bytes from SPAN - 1 before the anchor to WINDOW after it, zero outside the run's windows."""

    WIDTH = SPAN - 1 + WINDOW

    def __init__(self, batch: Batch, pick: np.ndarray, shards: int):
        r = batch.runs
        self.run = pick
        anchor = r.anchor[pick]
        self.most, self.least = anchor - r.first[pick], anchor - r.last[pick]
        shard = _shard(r.hash[pick], shards)
        print_ = np.zeros(len(pick), np.uint64)
        for i in range(0, len(pick), 1 << 13):
            c = context(batch.buf, anchor[i : i + (1 << 13)], self.most[i : i + (1 << 13)], self.least[i : i + (1 << 13)])
            print_[i : i + len(c)] = _prints(c, self.most[i : i + (1 << 13)], self.least[i : i + (1 << 13)])
        # contexts of one print count as one; if bytes tell some apart after all, bytes decide for the batch
        order = np.lexsort((print_, shard))
        same = (print_[order][1:] == print_[order][:-1]) & (shard[order][1:] == shard[order][:-1])
        number = np.concatenate(([0], np.cumsum(~same))) if len(order) else np.zeros(0, np.int64)
        if self._differ(batch.buf, anchor, order, np.flatnonzero(same)):
            raw = np.concatenate([shard.astype(">u8").view(np.uint8).reshape(-1, 8), context(batch.buf, anchor, self.most, self.least), self.most[:, None].astype(np.uint8), self.least[:, None].astype(np.uint8)], axis=1)
            number = np.unique(raw, axis=0, return_inverse=True)[1].ravel()
            order = np.argsort(number, kind="stable")
            number = number[order]
        self.of = np.zeros(len(pick), np.int64)
        self.of[order] = number
        n = int(number[-1]) + 1 if len(number) else 0
        rep = np.zeros(n, np.int64)
        rep[number[::-1]] = order[::-1]
        self.doc = np.full(n, LAST)
        np.minimum.at(self.doc, self.of, batch.ids[r.doc[pick]])
        self.anchor, self.shard = anchor[rep], shard[rep]
        self.e_most, self.e_least = self.most[rep], self.least[rep]

    def _differ(self, buf: np.ndarray, anchor: np.ndarray, order: np.ndarray, at: np.ndarray) -> bool:
        """Whether some row of order and the next one, at the given places, have different contexts."""
        for i in range(0, len(at), 1 << 13):
            a, b = order[at[i : i + (1 << 13)]], order[at[i : i + (1 << 13)] + 1]
            if (self.most[a] != self.most[b]).any() or (self.least[a] != self.least[b]).any() or (context(buf, anchor[a], self.most[a], self.least[a]) != context(buf, anchor[b], self.most[b], self.least[b])).any():
                return True
        return False


def _prints(contexts: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """A hash of each context and its reach."""
    words = np.zeros((len(contexts), 80), np.uint8)
    words[:, : Entries.WIDTH] = contexts
    words[:, Entries.WIDTH], words[:, Entries.WIDTH + 1] = most, least
    w = words.view("<u8")
    h = w[:, 0].astype(np.uint64)
    for k in range(1, 10):
        h = _mix(h, w[:, k].astype(np.uint64), np.array([k], np.uint64))
    return h


def context(buf: np.ndarray, anchor: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """WIDTH bytes around each anchor, zero where no window of the run reaches."""
    k = np.arange(-(SPAN - 1), WINDOW)
    at = anchor[:, None] + k
    keep = (k >= -most[:, None]) & (k < (WINDOW - least)[:, None])
    return np.where(keep, buf[np.clip(at, 0, len(buf) - 1)], 0).astype(np.uint8)


# --- deep-shallow sorting -----------------------------------------------------


def multikey(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of eight-byte characters, and the group of rows that are equal in all of them.

    Multikey quicksort, all groups at once: each group is parted by a pivot among its
    next characters into less, equal and greater; equal rows go on with the character
    after, the others with the same one, until a group is one row or its depth is reached.
    """
    n, depth = words.shape
    order, heads = np.arange(n), np.zeros(n + 1, bool)
    heads[[0, n]] = True
    start, size, deep = np.array([0]), np.array([n]), np.array([0])
    rng = np.random.default_rng(n)
    while True:
        open_ = (size > 1) & (deep < depth)
        start, size, deep = start[open_], size[open_], deep[open_]
        if not len(start):
            break
        of = np.repeat(np.arange(len(start)), size)
        first = np.cumsum(size) - size
        place = np.arange(len(of)) - first[of] + start[of]
        rows = order[place]
        key = words[rows, deep[of]]
        three = np.sort(key[first[:, None] + (rng.random((len(start), 3)) * size[:, None]).astype(np.int64)], axis=1)
        pivot = three[:, 1][of]
        less, more = key < pivot, key > pivot
        n_less, n_more = np.add.reduceat(less, first, dtype=np.int64), np.add.reduceat(more, first, dtype=np.int64)
        n_equal = size - n_less - n_more
        goes = start[of] + np.where(more, (n_less + n_equal)[of], np.where(less, 0, n_less[of]))  # to its part's begin
        for part in (less, ~(less | more), more):  # and its rank in the part
            rank = np.cumsum(part) - part
            goes += np.where(part, rank - rank[first][of], 0)
        order[goes] = rows
        start, size, deep = np.concatenate((start, start + n_less, start + n_less + n_equal)), np.concatenate((n_less, n_equal, n_more)), np.concatenate((deep, deep + 1, deep))
        heads[start] = True
    return order, np.cumsum(heads[:-1]) - 1


class BlindTrie:
    """A binary trie of equally long strings that stores branching bits only.

    An insertion goes down by the stored bits alone, compares once with the string it
    ends at, and branches at the first bit in which the two differ.
    """

    def __init__(self, bits: int):
        self.bits, self.root = bits, None

    def insert(self, value: int, item: int) -> None:
        if self.root is None:
            self.root = (value, [item])
            return
        node = self.root
        while len(node) == 3:
            node = node[2] if value >> node[0] & 1 else node[1]
        differ = (value ^ node[0]).bit_length() - 1
        if differ < 0:
            node[1].append(item)
            return
        above, node = None, self.root
        while len(node) == 3 and node[0] > differ:
            above, side = node, 2 if value >> node[0] & 1 else 1
            node = node[side]
        leaf = (value, [item])
        branch = [differ, node, leaf] if value >> differ & 1 else [differ, leaf, node]
        if above is None:
            self.root = branch
        else:
            above[side] = branch

    def leaves(self):
        """(value, items) in order."""
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if len(node) == 3:
                todo += (node[2], node[1])
            else:
                yield node


def deep_shallow(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of rows of WINDOW bytes, and bytes in common with the row before."""
    n = len(suffixes)
    padded = np.zeros((n, 56), np.uint8)
    padded[:, :WINDOW] = suffixes
    words = padded.view(">u8").astype(np.uint64)
    shallow = SHALLOW // 8
    order, group = multikey(words[:, :shallow])
    # groups that differ below the shallow depth
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
    deep = words[order, shallow:]
    unlike = (deep != deep[first[group]]).any(axis=1) if n else np.zeros(0, bool)
    bounds = np.append(first, n)
    for g in np.unique(group[unlike]).tolist():
        a, b = int(bounds[g]), int(bounds[g + 1])
        trie = BlindTrie((WINDOW - SHALLOW) * 8)
        rows = order[a:b]
        for i, raw in zip(rows.tolist(), suffixes[rows, SHALLOW:], strict=True):
            trie.insert(int.from_bytes(raw.tobytes(), "big"), i)
        order[a:b] = [i for _, items in trie.leaves() for i in items]
    common = np.zeros(n, np.int64)
    for i in range(1, n, 1 << 13):
        j = min(n, i + (1 << 13))
        common[i:j] = np.cumprod(suffixes[order[i:j]] == suffixes[order[i - 1 : j - 1]], axis=1, dtype=np.uint8).sum(axis=1)
    return order, common


def window_minima(contexts: np.ndarray, most: np.ndarray, least: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each context and offset of the anchor the smallest doc of an equal window; LAST outside the run.

    Windows at offset o are equal if the suffixes agree in WINDOW - o bytes, which
    makes runs in sorted order, and the o bytes before the anchor agree.
    """
    n = len(contexts)
    out = np.full((n, SPAN), LAST)
    if not n:
        return out
    order, common = deep_shallow(contexts[:, SPAN - 1 :])
    before = contexts[order, : SPAN - 1]
    hi, lo, doc = most[order], least[order], doc[order]
    left = np.zeros(n, np.int64)
    for o in range(SPAN):
        if o:  # classes of the o bytes before the anchor
            left = np.unique(left * 256 + before[:, SPAN - 1 - o], return_inverse=True)[1]
        inside = np.flatnonzero((lo <= o) & (o <= hi))
        if not len(inside):
            continue
        right = np.cumsum(common < WINDOW - o)
        key = right[inside] * n + left[inside]
        by = np.lexsort((doc[inside], key))
        key = key[by]
        begins = np.concatenate(([True], key[1:] != key[:-1]))
        out[order[inside[by]], o] = doc[inside[by]][np.flatnonzero(begins)[np.cumsum(begins) - 1]]
    return out


# --- the job ------------------------------------------------------------------


def _packed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """batch, ids, sizes, body: the texts, some BATCH bytes to a row."""

    def work(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, raws, size = [], [], 0

        def row():
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(raws))
            return pd.DataFrame({"batch": [(part << 32) | seq], "ids": [np.array(ids, np.int64).tobytes()], "sizes": [np.array([len(r) for r in raws], np.int64).tobytes()], "body": [body]})

        for b in batches:
            for i, t in zip(b["doc_id"].tolist(), b["text"], strict=True):
                raw = t.encode()
                ids.append(i)
                raws.append(raw)
                size += len(raw)
                if size >= BATCH or len(ids) >= 50_000:
                    yield row()
                    ids, raws, size, seq = [], [], 0, seq + 1
        if ids:
            yield row()

    rows = id_text(docs, text=text, doc_id=doc_id).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text")
    return stored(rows.mapInPandas(work, "batch long, ids binary, sizes binary, body binary"), TEXT_ROWS, compression="none", **{"parquet.block.size": str(16 << 20)})


def _shards_of(batches, columns):
    """(shard, rows) of a partition sorted by shard."""
    held: list = []
    for b in batches:
        for row in zip(*[b[c] for c in columns], strict=True):
            if held and held[-1][0] != row[0]:
                yield held[-1][0], held
                held = []
            held.append(row)
    if held:
        yield held[-1][0], held


def _answers(df: DataFrame, *cols: str) -> DataFrame:
    """All shards' answers to a batch in one row."""
    return df.groupBy("batch").agg(F.collect_list(F.struct("shard", *cols)).alias(cols[0] + "_of"))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per document; with_text: kept (binary) and spans (begin, end) too."""
    spark = docs.sparkSession
    texts = _packed(docs, text, doc_id)
    total = id_text(docs, text=text, doc_id=doc_id).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    shards = max(12, int(total // SHARD_BYTES))

    def sketch(batches):
        for b in batches:
            for batch, ids, sizes, body in zip(b["batch"], b["ids"], b["sizes"], b["body"], strict=True):
                distinct, several, present, cut, _ = Batch(ids, sizes, body).hashes(shards)
                low = np.ascontiguousarray(distinct.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])
                yield pd.DataFrame({
                    "shard": present, "batch": batch, "hashes": [low[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)],
                    "flags": [np.packbits(several[a:b]).tobytes() for a, b in zip(cut, cut[1:], strict=False)],
                })
                release()

    def count(batches):
        for shard, rows in _shards_of(batches, ["shard", "batch", "hashes", "flags"]):
            raw = [np.frombuffer(r[2], np.uint8).reshape(-1, HASH_BYTES) for r in rows]
            wide = np.zeros((sum(map(len, raw)), 8), np.uint8)
            wide[:, :HASH_BYTES] = np.concatenate(raw)
            h, sizes_ = wide.view("<u8").ravel(), [len(x) for x in raw]
            flag = np.concatenate([np.unpackbits(np.frombuffer(r[3], np.uint8), count=len(x)) for r, x in zip(rows, raw, strict=True)])
            rows, raw = [r[1] for r in rows], None
            order = np.argsort(h, kind="stable")
            group = np.concatenate(([0], np.cumsum(h[order][1:] != h[order][:-1])))
            n = np.bincount(group, 1 + flag[order])
            several = np.zeros(len(h), bool)
            several[order] = n[group] > 1
            cuts = np.cumsum(sizes_)[:-1]
            yield pd.DataFrame({"batch": rows, "shard": shard, "bits": [np.packbits(x).tobytes() for x in np.split(several, cuts)]})
            release()

    dealt = texts.mapInPandas(sketch, "shard long, batch long, hashes binary, flags binary").repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard")
    bits = stored(dealt.mapInPandas(count, "batch long, shard long, bits binary"), PACK_ROWS)
    asked = texts.join(_answers(bits, "bits").hint("merge"), "batch", "left")

    def told(value) -> dict[int, bytes]:
        return {r["shard"]: r["bits"] for r in value} if value is not None else {}

    def contexts(batches):
        for b in batches:
            for batch, ids, sizes, body, bits_ in zip(b["batch"], b["ids"], b["sizes"], b["body"], b["bits_of"], strict=True):
                pack = Batch(ids, sizes, body)
                e = pack.entries(shards, told(bits_))
                present, cut = np.unique(e.shard, return_index=True)
                for s, a, z in zip(present.tolist(), cut, np.append(cut[1:], len(e.shard)), strict=True):
                    p = slice(a, z)
                    c = context(pack.buf, e.anchor[p], e.e_most[p], e.e_least[p])
                    k = np.arange(-(SPAN - 1), WINDOW)
                    keep = (k >= -e.e_most[p][:, None]) & (k < (WINDOW - e.e_least[p])[:, None])
                    yield pd.DataFrame({"shard": [s], "batch": [batch], "docs": [e.doc[p].tobytes()], "reach": [np.stack((e.e_most[p], e.e_least[p])).astype(np.uint8).tobytes()], "body": [c[keep].tobytes()]})
                release()

    def settle(batches):
        for shard, rows in _shards_of(batches, ["shard", "batch", "docs", "reach", "body"]):
            doc = np.concatenate([np.frombuffer(r[2], np.int64) for r in rows])
            reach = np.concatenate([np.frombuffer(r[3], np.uint8).reshape(2, -1) for r in rows], axis=1).astype(np.int64)
            k = np.arange(-(SPAN - 1), WINDOW)
            keep = (k >= -reach[0][:, None]) & (k < (WINDOW - reach[1])[:, None])
            c = np.zeros(keep.shape, np.uint8)
            c[keep] = np.concatenate([np.frombuffer(r[4], np.uint8) for r in rows])
            del keep
            m = window_minima(c, reach[0], reach[1], doc)
            del c
            # runs of offsets with one minimum
            new = np.ones(m.shape, bool)
            new[:, 1:] = m[:, 1:] != m[:, :-1]
            new &= m != LAST
            stop = m == LAST
            stop[:, 1:] &= m[:, :-1] != LAST
            stop[:, 0] = False
            mark = new | stop
            at = 0
            batch_, n_, o_, v_ = [], [], [], []
            for r in rows:
                size = len(r[2]) // 8
                part, values = mark[at : at + size], m[at : at + size]
                batch_.append(r[1])
                n_.append(part.sum(axis=1).astype(np.uint8).tobytes())
                o_.append(np.nonzero(part)[1].astype(np.uint8).tobytes())
                v_.append(values[part].tobytes())
                at += size
            yield pd.DataFrame({"batch": batch_, "shard": shard, "n": n_, "o": o_, "m": v_})
            release()

    dealt = asked.mapInPandas(contexts, "shard long, batch long, docs binary, reach binary, body binary").repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard")
    marks = stored(dealt.mapInPandas(settle, "batch long, shard long, n binary, o binary, m binary"), PACK_ROWS)

    def minima(value, n: int) -> np.ndarray:
        """The answers to a batch's entries, in their order."""
        out = np.full((n, SPAN), LAST)
        at = 0
        for r in sorted(value if value is not None else [], key=lambda r: r["shard"]):
            runs = np.frombuffer(r["n"], np.uint8).astype(np.int64)
            o, v = np.frombuffer(r["o"], np.uint8).astype(np.int64), np.frombuffer(r["m"], np.int64)
            row = at + np.repeat(np.arange(len(runs)), runs)
            last = np.ones(len(row), bool)
            last[:-1] = row[1:] != row[:-1]
            end = np.where(last, SPAN, np.append(o[1:], 0))
            for k in range(SPAN):
                here = (o <= k) & (k < end)
                out[row[here], k] = v[here]
            at += len(runs)
        return out

    def removed(pack: Batch, bits_, marks_) -> np.ndarray:
        e = pack.entries(shards, bits_)
        edge = np.zeros(len(pack.buf) + 1, np.int32)
        least = minima(marks_, len(e.doc))
        for i in range(0, len(e.run), 1 << 13):
            p = slice(i, i + (1 << 13))
            r = e.run[p]
            o = np.arange(SPAN)
            gone = (least[e.of[p]] < pack.ids[pack.runs.doc[r]][:, None]) & (o <= e.most[p][:, None]) & (o >= e.least[p][:, None])
            some = gone.any(axis=1)
            gone, anchor = gone[some], pack.runs.anchor[r[some]]
            # windows of one run all cover its anchor, so those that go make one stretch
            np.add.at(edge, anchor - (SPAN - 1 - np.argmax(gone[:, ::-1], axis=1)), 1)
            np.add.at(edge, anchor - np.argmax(gone, axis=1) + WINDOW, -1)
        return np.cumsum(edge[:-1]) > 0

    def finish(batches):
        for b in batches:
            for ids, sizes, body, bits_, marks_ in zip(b["ids"], b["sizes"], b["body"], b["bits_of"], b["n_of"], strict=True):
                pack = Batch(ids, sizes, body)
                gone = removed(pack, told(bits_), marks_)
                rows = []
                for i, s, n in zip(pack.ids.tolist(), pack.starts.tolist(), pack.sizes.tolist(), strict=True):
                    mine = gone[s : s + n]
                    count_ = int(mine.sum())
                    kept = pack.buf[s : s + n][~mine].tobytes() if count_ else pack.buf[s : s + n].tobytes()
                    step = np.diff(mine.astype(np.int8), prepend=0, append=0) if count_ else np.zeros(0, np.int8)
                    row = [i, n, count_, int((step == 1).sum()), hashlib.sha256(kept).hexdigest()]
                    if with_text:
                        row += [kept, [{"begin": x, "end": y} for x, y in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)]]
                    rows.append(row)
                yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "spans"] if with_text else [])])
                release()

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<begin:long,end:long>>" * with_text
    full = asked.join(_answers(marks, "n", "o", "m").hint("merge"), "batch", "left")
    out = stored(full.select("ids", "sizes", "body", "bits_of", "n_of").mapInPandas(finish, schema), PACK_ROWS)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
