"""Benchmark decontamination by pigeonhole edit matching.

Item and document are compared in lower case with every run of other characters
than letters and digits as one space.  An item of m characters, with a space before
and after it, may be found with up to k = m * RATE edits anywhere in a document, with
a space before and after that: matches begin and end with whole words.  The padded
item is cut into k + 1 pieces; an occurrence with k edits leaves one piece untouched,
so an Aho-Corasick automaton over all pieces finds every place where it can be, and
Myers' bit-parallel distance verifies it there.  An item of fewer than SHORT_WORDS
words is no evidence inside another text: it is found only where it is the whole
document, with the same budget.

Items are taken in blocks of bounded size (BLOCK_CHARS), each block is one pass over
the documents whose hits are stored before the next block is fetched; no pair of a
document and an item is formed before a piece is hit.  Documents are not shuffled.

Edge cases: null and empty texts match nothing, items without letters or digits
match nothing, repeated items are reported once each, item ids may be of any type,
texts of any length are scanned whole, empty tables give no rows, other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import id_text, mapped, table

RATE = 0.08
SHORT_WORDS = 5
BLOCK_CHARS = 2_000_000
_OTHER = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """The item cut into k + 1 pieces of about equal length, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of text, and where that ends first."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, at = score, j + 1
        ph = (ph << 1) & full
        xv = eq | mv
        pv = ((mh << 1) & full) | (full & ~(xv | ph))
        mv = ph & xv
    return best, at


class Matcher:
    """Finds a block of (item_id, text) in plain texts."""

    def __init__(self, items: list[tuple[str | None, str]], rate: float = RATE):
        self.items, places = [], {}
        for item_id, text in items:
            item = plain(text)
            if not item:
                continue
            k, n, short = int(len(item) * rate), len(self.items), item.count(" ") + 1 < SHORT_WORDS
            item = f" {item} "
            self.items.append((item_id, item, k, masks(item), short))
            for offset, piece in pieces(item, k):
                places.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, text: str) -> Iterator[tuple[str | None, int, int]]:
        """(item_id, distance, end in the plain text) of each item that occurs."""
        if self.empty or not text:
            return
        text = f" {text} "
        hits: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                hits.setdefault(n, []).append(end + 1 - size - offset)
        for n, starts in sorted(hits.items()):
            item_id, item, k, peq, short = self.items[n]
            if short and abs(len(text) - len(item)) > k:
                continue
            best = None
            lo = hi = None
            for s in [*sorted(starts), None]:
                if s is not None and hi is not None and s - k <= hi:
                    hi = s + len(item) + k
                    continue
                if hi is not None:
                    window = text[max(0, lo) : hi]
                    distance, at = (0, found + len(item)) if (found := window.find(item)) >= 0 else myers(peq, len(item), window)
                    if distance <= k and (best is None or distance < best[0]):
                        best = (distance, max(0, max(0, lo) + at - 2))
                if s is not None:
                    lo, hi = s - k, s + len(item) + k
            if best and short:  # the whole texts; the distance to a part is not more than that
                best = (d, len(text) - 2) if (d := edits(item, text)) <= k else None
            if best:
                yield item_id, *best


def edits(a: str, b: str) -> int:
    """Edit distance of two short texts."""
    row = list(range(len(a) + 1))
    for c in b:
        last, row[0] = row[0], row[0] + 1
        for i, x in enumerate(a, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != c))
    return row[-1]


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def benchmark_hits(docs: DataFrame, items: DataFrame, rate: float = RATE, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, distance, end_at: each item that occurs in a document with up to rate edits a character."""
    spark, kind = docs.sparkSession, items.schema[item_id].dataType
    rows = id_text(docs, text=text, doc_id=doc_id)
    out = None
    wanted = items.select(F.col(item_id).cast("string").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    for block in _blocks(wanted, BLOCK_CHARS):
        shared = spark.sparkContext.broadcast(block)  # BLOCK_CHARS and one item at most

        def work(batches, shared=shared):
            matcher = Matcher(shared.value, rate)
            for b in batches:
                found = [(d, *hit) for d, t in zip(b["doc_id"], b["text"], strict=True) for hit in matcher.find(plain(t))]
                if found:
                    yield pd.DataFrame(found, columns=["doc_id", "item_id", "distance", "end_at"])

        part = mapped(rows, work, "doc_id long, item_id string, distance long, end_at long")
        shared.unpersist()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "doc_id long, item_id string, distance long, end_at long")
    return out.withColumn("item_id", F.col("item_id").cast(kind))


def op4_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
