"""SimHash near-dedup by the generalised pigeonhole principle; similar_groups: near copies by SimHash links,
verified, and an exact join of shingle sets for those that SimHash does not link.

Fingerprints: 64-bit SimHash of the word shingles, a bit is 1 if it is set in
over half the shingles' XXH64.  Two fingerprints link at up to TAU differing
bits.  The 64 bits are grouped into m partitions, correlated bits together, and
partition i gets a threshold T_i (-1: not probed) with
    sum(T_i) = TAU - m + 1:
if two fingerprints differ by more than T_i in every partition, they differ by
TAU + 1 at least, so probing each partition within T_i loses no link.  A dynamic
programme shares the thresholds out so that the estimated number of probes and
candidates is least, for several m; the cheapest plan is taken.  The estimates
come from a bounded sample and steer cost only.  Every candidate is verified.

Equal fingerprints are one vertex.  A bucket returns a spanning forest of its
links instead of all its pairs, and a bucket of more than BLOCK fingerprints is
dealt out as pairs of blocks, so no task holds an unbounded bucket and no link
between components is lost.

Edge cases: null and empty texts and texts without words have fingerprint zero;
fewer words than a shingle: the whole word sequence is the shingle; long texts
are counted in slices; repeated rows share a vertex; an empty table gives none.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import TEXT_ROWS, byte_words, id_text, mapped, partitions, sampled, stored, table
from gridloom.llm.components import components, joined
from gridloom.sources.storage import drop_shuffles

TAU = 4
SEED = 42
BLOCK = 8192
SAMPLE = 20_000
NUMBER_ROWS, SET_ROWS = 20_000, 4096  # of an Arrow batch of numbers, of prefixes of sets
#: similar_groups: sets of a bucket whose pairs are listed; sets of a block; frequent shingles and texts sampled for them.
FEW = 64
BLOCK_SETS = 512
FREQUENT = 200_000
FREQUENT_SAMPLE = 8000
SLOTS = 1 << 20  # of a filter of ids, in bits
_SLICE = 1 << 16


def _shingle_hashes(text: str | None, shingle: int):
    """XXH64 of a text's shingles, repeats included, in slices."""
    words = byte_words(text)
    if not words:
        return
    n = max(1, len(words) - shingle + 1)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    for i in range(0, n, _SLICE):
        yield np.array([h(joined[a:b], SEED) for a, b in zip(starts[i : i + _SLICE], ends[i : i + _SLICE], strict=True)], np.uint64)


def _simhash(slices) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for x in slices:
        counts += np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(x)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of a text as an unsigned 64-bit number."""
    return _simhash(_shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def work(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    return mapped(id_text(docs, text=text, doc_id=doc_id), work, "doc_id long, fp long")


def bit_groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """64 bit numbers in m groups of about equal size; each group gathers the bits that go with its first one."""
    if len(sample) > 1:
        bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float64)
        c = bits - bits.mean(axis=0)
        sd = np.sqrt((c**2).mean(axis=0))
        corr = np.abs(c.T @ c) / len(c) / np.maximum(np.outer(sd, sd), 1e-9)
    else:
        corr = np.zeros((64, 64))
    left, groups = list(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            left.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def extract(x: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    for k, b in enumerate(bits):
        out |= ((x >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def flips(width: int, threshold: int) -> np.ndarray:
    """Masks of up to threshold bits."""
    masks = [0]
    if threshold >= 1:
        masks += [1 << i for i in range(width)]
    if threshold >= 2:
        masks += [(1 << i) | (1 << j) for i in range(width) for j in range(i)]
    if threshold >= 3:
        masks += [(1 << i) | (1 << j) | (1 << k) for i in range(width) for j in range(i) for k in range(j)]
    return np.array(masks, dtype=np.uint64)


def plan(sample: np.ndarray, total: int, tau: int = TAU) -> list[tuple[list[int], int]]:
    """(bits, threshold) for each partition that is probed: the least estimated probes and candidates."""
    sample = np.unique(sample)
    scale = (total / max(1, len(sample))) ** 2
    best = None
    for m in range(min(2, tau + 1), min(tau + 1, 8) + 1):
        groups, need = bit_groups(sample, m), tau - m + 1
        costs = []
        for bits in groups:
            keys, n = np.unique(extract(sample, bits), return_counts=True)
            by = {-1: 0.0}
            for t in range(0, max(0, need + m - 1) + 1):
                if t > 2:
                    break
                pairs = 0.0
                for mask in flips(len(bits), t):
                    at = np.searchsorted(keys, keys ^ mask)
                    hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == (keys ^ mask)) if len(keys) else np.zeros(0, bool)
                    same = n[hit] * (n[at[hit]] - (mask == 0))
                    pairs += float(same.sum()) / 2 * scale
                # pairs that the sample is too small to show
                pairs += total * total / 2 / 2.0 ** len(bits) * len(flips(len(bits), t))
                by[t] = total * len(flips(len(bits), t)) * 4.0 + pairs * 0.02
            costs.append(by)
        table_ = {0: (0.0, [])}  # sum of thresholds so far (each raised by one) -> cost, thresholds
        for by in costs:
            step = {}
            for s, (c, ts) in table_.items():
                for t, x in by.items():
                    k = s + t + 1
                    if k <= need + m and (k not in step or c + x < step[k][0]):
                        step[k] = (c + x, [*ts, t])
            table_ = step
        cost, ts = table_[need + m]
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0])
    return best[1]


def _forest(fp: np.ndarray, tau: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among distinct fingerprints (breadth first)."""
    left, us, vs = fp, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= tau
            if near.any():
                found = left[near]
                us.append(np.full(len(found), x))
                vs.append(found)
                queue.extend(found)
                left = left[~near]
    return list(zip(us, vs, strict=True))


def _dense(fp: np.ndarray, tau: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a bucket: all of them while they are few, else a spanning forest."""
    if len(fp) <= 1024:
        u, v = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp) <= tau, 1))
        if len(u) <= 4 * len(fp):
            return [(fp[u], fp[v])]
    return _forest(fp, tau)


def links(fps: DataFrame, tau: int = TAU) -> DataFrame:
    """u, v: edges whose components are those of all links between the distinct fingerprints in fp."""
    spark = fps.sparkSession
    if tau < 1:  # equal fingerprints are one vertex
        return spark.createDataFrame([], "u long, v long")
    total = fps.count()
    sample = fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    parts = [(bits, flips(len(bits), t)) for bits, t in plan(sample, total, tau)]

    def signatures(batches):
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            for i, (bits, masks) in enumerate(parts):
                keys = extract(fp.view(np.uint64), bits)
                for mask in masks:
                    # of two that differ in the mask, the one with its lowest bit set probes the other
                    take = (keys & np.uint64(int(mask) & -int(mask))) != 0 if mask else slice(None)
                    yield pd.DataFrame({"bucket": ((keys[take] ^ mask) | np.uint64(i << 32)).view(np.int64), "fp": fp[take]})

    sigs = stored(fps.select("fp").mapInPandas(signatures, "bucket long, fp long"), NUMBER_ROWS)
    sizes = sigs.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    blocks = F.ceil(F.col("n") / (BLOCK // 2)).cast("int")
    dealt = sigs.join(sizes, "bucket", "left")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), blocks).cast("int")
    pairs = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(mine, j) * 1_000_000 + F.greatest(mine, j))
    )
    dealt = dealt.select("bucket", F.explode(pairs).alias("block"), "fp")
    k = partitions(spark)
    dealt = dealt.repartition(k, "bucket", "block").sortWithinPartitions("bucket", "block", "fp")

    def bucket_edges(bucket, block, fp):
        """Edges of whole buckets, which are runs in the sorted arrays."""
        new = np.ones(len(fp), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(fp)))
        us, vs = [], []
        for s, n in zip(start[size > 32].tolist(), size[size > 32].tolist(), strict=True):
            for u, v in _dense(np.unique(fp[s : s + n]), tau):
                us.append(u)
                vs.append(v)
        run = np.repeat(np.arange(len(start)), size)
        few = np.flatnonzero((size <= 32)[run])
        f, r = fp[few], run[few]
        for d in range(1, 32):
            if d >= len(f):
                break
            hit = (r[d:] == r[:-d]) & (f[d:] != f[:-d])
            hit &= np.bitwise_count(f[d:] ^ f[:-d]) <= tau
            us.append(f[:-d][hit])
            vs.append(f[d:][hit])
        return np.concatenate(us) if us else np.zeros(0, np.uint64), np.concatenate(vs) if vs else np.zeros(0, np.uint64)

    def probe(batches):
        """Joins what a bucket has in one batch with its rest in the next, then finds its links."""
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            keys = held["bucket"].to_numpy(), held["block"].to_numpy()
            other = np.flatnonzero((keys[0] != keys[0][-1]) | (keys[1] != keys[1][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                u, v = bucket_edges(keys[0][:cut], keys[1][:cut], held["fp"].to_numpy(np.int64)[:cut].view(np.uint64))
                yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            u, v = bucket_edges(held["bucket"].to_numpy(), held["block"].to_numpy(), held["fp"].to_numpy(np.int64).view(np.uint64))
            yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return stored(dealt.mapInPandas(probe, "u long, v long"), NUMBER_ROWS).distinct()


def simhash_groups(docs: DataFrame, shingle: int = 4, tau: int = TAU, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links)."""
    fps = fingerprints(docs, shingle, text, doc_id)
    vertices = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comps = components(links(vertices, tau))
    rooted = vertices.join(comps, vertices["fp"] == comps["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def _distinct(slices: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(slices)) if slices else np.zeros(0, np.uint64)


def _shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return _distinct(list(_shingle_hashes(text, shingle)))


def _set_key(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def prefix(shingles: np.ndarray, similarity: float, frequent: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles in the common order (rare ones by hash, then frequent ones by frequency):
    so many that two sets of the similarity share one of them."""
    n = len(shingles)
    if not n:
        return shingles
    size = n - int(np.ceil(similarity * n - 1e-9)) + 1
    if not len(frequent):
        return shingles[:size]
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    rank = np.where(frequent[at] == shingles, often[at], 0)
    return shingles[np.lexsort((shingles, rank))[:size]]


def _possible(nx, ny, px, py, similarity: float) -> np.ndarray:
    """Whether sets of nx and ny shingles whose first common one is at px and py can have the similarity.
    No pair that has it fails in the bucket of its first common shingle."""
    swap = nx > ny
    nx, ny, px, py = np.where(swap, ny, nx), np.where(swap, nx, ny), np.where(swap, py, px), np.where(swap, px, py)
    share = similarity / (1 + similarity)
    ok = nx >= similarity * ny - 1e-9
    ok &= 1 + np.minimum(nx - px - 1, ny - py - 1) >= share * (nx + ny) - 1e-9
    return ok & (px < nx - np.ceil(2 * share * nx - 1e-9) + 1)


def similar_forest(sets: list[np.ndarray], root: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Edges between sets of different roots that have the similarity: a spanning forest of all of them."""
    size = np.array([len(x) for x in sets], np.int64)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, inverse, count = np.unique(tokens, return_inverse=True, return_counts=True)
    common = count[inverse] > 1
    column = (np.cumsum(count > 1) - 1)[inverse[common]]
    owner = owner[common]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for i in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, (i, i + 4096))
        some = np.zeros((len(sets), 4096), np.float32)
        some[owner[lo:hi], column[lo:hi] - i] = 1
        both += some @ some.T
    both = both.astype(np.int64)
    linked = both / np.maximum(size[:, None] + size - both, 1) >= similarity
    linked |= root[:, None] == root  # joined already; these edges are not returned
    left, edges = np.arange(len(sets)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = linked[x, left]
            edges += [(int(x), int(y)) for y in left[near] if root[y] != root[x]]
            queue.extend(left[near])
            left = left[~near]
    return edges


def _runs(batches, keys: list[str]):
    """Sorted batches dealt anew, so that rows of equal keys are never parted."""
    held = []
    for b in batches:
        if not len(b):
            continue
        last = np.logical_and.reduce([b[k].to_numpy() == b[k].iloc[-1] for k in keys])
        other = np.flatnonzero(~last)
        cut = int(other[-1]) + 1 if len(other) else 0
        if not cut and held and any(held[-1][k].iloc[-1] != b[k].iloc[0] for k in keys):
            yield pd.concat(held, ignore_index=True)
            held = []
        if cut:
            yield pd.concat([*held, b.iloc[:cut]], ignore_index=True)
            held = []
        held.append(b.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _frequent(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that many texts of a bounded sample have, and in how many."""
    share = FREQUENT_SAMPLE / max(1, rows.count())

    def work(batches):
        for b in batches:
            yield pd.DataFrame({"token": np.concatenate([_shingle_set(t, shingle) for t in b["text"]] or [np.zeros(0, np.uint64)]).view(np.int64)})

    some = rows.where(sampled(share, "doc_id", "text"))
    got = stored(some.mapInPandas(work, "token long"), TEXT_ROWS).groupBy("token").agg(F.count("*").alias("n")).where("n > 5").orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    token, n = got["token"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(token)
    return token[order], n[order]


def parity(shingles: np.ndarray) -> np.ndarray:
    """A bit for each residue of the shingles, as many residues as the next power of two: whether an odd
    number of shingles has it.  Two sets' parities differ in no more bits than the sets in shingles."""
    size = 64
    while size < len(shingles):
        size *= 2
    odd = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which rows of parities differ; the longer ones are folded to the shorter ones."""
    while a.shape[-1] > b.shape[-1]:
        a = a[..., : a.shape[-1] // 2] ^ a[..., a.shape[-1] // 2 :]
    while b.shape[-1] > a.shape[-1]:
        b = b[..., : b.shape[-1] // 2] ^ b[..., b.shape[-1] // 2 :]
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def may_differ(nx, ny, similarity: float):
    """The most shingles in which two sets of the similarity can differ."""
    return np.floor((nx + ny) * (1 - similarity) / (1 + similarity) + 1e-9)


def _slots(ids: DataFrame, name: str) -> np.ndarray:
    """Which of SLOTS hash values the ids have: a filter of fixed size that lets every id pass.  It spares
    cost where the ids are few beside SLOTS."""
    got = ids.select(F.pmod(F.xxhash64(name), F.lit(SLOTS)).cast("int").alias("slot")).distinct().toPandas()["slot"]  # SLOTS rows at most
    bits = np.zeros(SLOTS, np.uint8)
    bits[got.to_numpy(np.int64)] = 1
    return np.packbits(bits)


def simhash_pairs(told: DataFrame, tau: int = TAU) -> DataFrame:
    """u, v: sets (key) that fingerprints (fp) of theirs link, each with the first of its own or of a linked fingerprint."""
    first = stored(told.groupBy("fp").agg(F.min("key").alias("first")))
    own = told.join(first, "fp").select(F.col("first").alias("u"), F.col("key").alias("v"))
    at = lambda c, name: first.select(F.col("fp").alias(c), F.col("first").alias(name))
    near = links(first.select("fp"), tau).join(at("u", "a"), "u").join(at("v", "b"), "v").select("a", "b")
    pairs = own.union(near).where("u <> v")
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, component_id: groups of documents whose shingles' Jaccard similarity is similarity or more.

    First by SimHash: the documents' fingerprints are linked at up to TAU bits by the
    generalised pigeonhole principle, and linked documents whose sets have the similarity
    are joined.  A fingerprint's documents are compared with its first one, and the first
    ones of linked fingerprints with each other.

    SimHash is no bound on the similarity, so what it leaves apart is then found by an
    exact join of sets by prefixes.  All shingles are put in one order, rare ones
    first; two sets of the similarity share one of their first n - ceil(similarity n) + 1
    shingles, so every such pair meets in a bucket of one of these.  The order
    (a bounded sample tells the frequent shingles) steers cost only.  Equal sets are one
    vertex, named by 64 bits of hash as the shingles are.

    Of a bucket of up to FEW sets every pair whose sizes and positions allow the
    similarity is a candidate, of a larger one every set with its first.  Buckets of
    frequent shingles are counted before they are dealt out, so a hot one never meets in
    one task.  Candidates of both kinds are tested by parities, some bits for each shingle of the
    set, which rule out nearly all that are not alike and none that are; the rest is
    verified on the full sets, SimHash's first, then one pair for each set, then those that
    this has not joined.  Large buckets that are then still in several components are compared in
    blocks of BLOCK_SETS: parities tell the sets that may have a partner of another
    component in the block, and only these are compared in full; a spanning forest of the
    verified pairs is kept.  Only documents that pass a test by parities are moved.
    doc_id must tell the rows apart (see common.numbered); rows where it is null stand alone.
    """
    spark = docs.sparkSession
    rows = id_text(docs, text=text, doc_id=doc_id).where("doc_id IS NOT NULL")
    frequent, often = _frequent(rows, shingle)

    def prefixes(batches):
        for b in batches:
            hashes = [list(_shingle_hashes(t, shingle)) for t in b["text"]]
            fp = np.array([_simhash(x) for x in hashes], np.uint64).view(np.int64)
            sets = [_distinct(x) for x in hashes]
            key = np.array([_set_key(x) for x in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp, "key": key, "n": [len(x) for x in sets], "prefix": [prefix(x, similarity, frequent, often).tobytes() for x in sets], "bits": [parity(x).tobytes() for x in sets]})

    def signatures(batches):
        for b in batches:
            tokens = [np.frombuffer(x, np.uint64) for x in b["prefix"]]
            size = [len(x) for x in tokens]
            if sum(size):
                bucket = np.concatenate(tokens)
                hot = frequent[np.minimum(np.searchsorted(frequent, bucket), len(frequent) - 1)] == bucket if len(frequent) else np.zeros(len(bucket), bool)
                yield pd.DataFrame({"bucket": bucket.view(np.int64), "key": np.repeat(b["key"].to_numpy(), size), "n": np.repeat(b["n"].to_numpy(), size), "pos": np.concatenate([np.arange(k) for k in size]), "hot": hot})

    def probe(batches):
        """Pairs (u, v) of small buckets; members u of large ones with the bucket and its size."""
        for b in _runs(batches, ["bucket"]):
            bucket = b["bucket"].to_numpy()
            begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            size = np.repeat(sizes := np.diff(np.append(begin, len(bucket))), sizes)
            key, n, pos = (b[c].to_numpy() for c in ("key", "n", "pos"))
            large = size > FEW
            if large.any():
                yield pd.DataFrame({"u": key[large], "v": key[large], "bucket": bucket[large], "sets": size[large]})
            some = (size > 1) & ~large
            bucket, key, n, pos = bucket[some], key[some], n[some], pos[some]
            for d in range(1, min(FEW, len(bucket))):
                hit = np.flatnonzero(bucket[d:] == bucket[:-d])
                if not len(hit):
                    break
                hit = hit[_possible(n[hit], n[hit + d], pos[hit], pos[hit + d], similarity)]
                yield pd.DataFrame({"u": np.minimum(key[hit], key[hit + d]), "v": np.maximum(key[hit], key[hit + d]), "bucket": 0, "sets": 0}, dtype=np.int64)

    def prune(batches):
        for b in batches:
            nx, ny = b["nx"].to_numpy(), b["ny"].to_numpy()
            far = np.array([apart(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b["x"], b["y"], strict=True)], np.int64)
            ok = (far <= may_differ(nx, ny, similarity)) & (np.minimum(nx, ny) >= similarity * np.maximum(nx, ny) - 1e-9)
            yield b.loc[ok, ["u", "v"]]

    def verify(batches):
        for b in batches:
            ok = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity for x, y in zip(b["x"], b["y"], strict=True)]
            yield b.loc[np.array(ok, bool), ["u", "v"]]

    def active(batches):
        """Members of a block that may be alike to one of another component in it."""
        for b in _runs(batches, ["bucket", "block"]):
            for (bucket, block), g in b.groupby(["bucket", "block"], sort=False):
                n, root, key = (g[c].to_numpy() for c in ("n", "root", "key"))
                raw = [np.frombuffer(x, np.uint64) for x in g["bits"]]
                found = np.zeros(len(g), bool)
                width = np.array([len(x) for x in raw])
                for w in np.unique(width):  # by length of parity; those of other lengths cannot be alike beyond the next one
                    mine = np.flatnonzero(width == w)
                    for w2 in (w, 2 * w):
                        others = np.flatnonzero(width == w2)
                        if not len(others):
                            continue
                        stack = np.stack([raw[j] for j in others])
                        for i in mine.tolist():
                            near = (apart(stack, raw[i][None, :]) <= may_differ(n[i], n[others], similarity)) & (root[others] != root[i])
                            found[others[near]] = True
                            found[i] |= near.any()
                if found.any():
                    yield pd.DataFrame({"bucket": bucket, "block": block, "key": key[found], "root": root[found]})

    def compare(batches):
        for b in _runs(batches, ["bucket", "block"]):
            for _, g in b.groupby(["bucket", "block"], sort=False):
                key = g["key"].to_numpy()
                edges = similar_forest([np.frombuffer(x, np.uint64) for x in g["shingles"]], g["root"].to_numpy(), similarity)
                yield pd.DataFrame({"u": [key[i] for i, _ in edges], "v": [key[j] for _, j in edges]}, dtype=np.int64)

    def sets_of(keys: DataFrame) -> DataFrame:
        """key, shingles of the vertices in keys, from the texts."""
        wanted = stored(keys.distinct().join(vertices.select("key", "least"), "key").select(F.col("least").alias("wanted")))
        slots = _slots(wanted, "wanted")

        def sets(batches):
            for b in batches:
                b = b[(slots[b["slot"].to_numpy() >> 3] >> (7 - (b["slot"].to_numpy() & 7))) & 1 == 1]
                if len(b):
                    of = [_shingle_set(t, shingle) for t in b["text"]]
                    yield pd.DataFrame({"doc_id": b["doc_id"], "key": np.array([_set_key(x) for x in of], np.uint64).view(np.int64), "shingles": [x.tobytes() for x in of]})

        numbers = rows.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int"))
        found = numbers.mapInPandas(sets, "doc_id long, key long, shingles binary")  # no doc_id is null
        return stored(found.join(wanted, F.col("doc_id") == F.col("wanted"), "left_semi").select("key", "shingles"), TEXT_ROWS)

    def verified(pairs: DataFrame) -> DataFrame:
        has = sets_of(pairs.select(F.col("u").alias("key")).union(pairs.select("v")))
        of = lambda c, name: has.select(F.col("key").alias(c), F.col("shingles").alias(name))
        return stored(pairs.join(of("u", "x"), "u").join(of("v", "y"), "v").mapInPandas(verify, "u long, v long"), TEXT_ROWS)

    def tested(pairs: DataFrame) -> DataFrame:
        of = lambda c, n, name: vertices.select(F.col("key").alias(c), F.col("n").alias(n), F.col("bits").alias(name))
        return stored(pairs.join(of("u", "nx", "x"), "u").join(of("v", "ny", "y"), "v").mapInPandas(prune, "u long, v long"), SET_ROWS)

    def apart_by(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs that are not joined yet."""
        at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        return pairs.join(at("u"), "u", "left").join(at("v"), "v", "left").where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")

    k = partitions(spark)
    told = mapped(rows, prefixes, "doc_id long, fp long, key long, n long, prefix binary, bits binary")
    vertices = stored(told.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")))
    linked = tested(simhash_pairs(told.select("fp", "key").distinct()))
    roots = components(verified(linked))
    drop_shuffles(spark)  # and the plans so far, which the driver would keep beside those to come
    sigs = vertices.select("key", "n", "prefix").mapInPandas(signatures, "bucket long, key long, n int, pos int, hot boolean")
    hot = stored(sigs.where("hot").drop("hot"), SET_ROWS)
    large = stored(hot.groupBy("bucket").agg(F.count("*").alias("sets")).where(F.col("sets") > FEW))  # FREQUENT rows at most
    cold = sigs.where("NOT hot").drop("hot").unionByName(hot.join(F.broadcast(large), "bucket", "left_anti"))
    probed = stored(cold.repartition(k, "bucket").sortWithinPartitions("bucket", "key").mapInPandas(probe, "u long, v long, bucket long, sets long"), SET_ROWS)
    big = hot.join(F.broadcast(large), "bucket").select("bucket", "sets", "key").unionByName(probed.where("u = v").select("bucket", "sets", F.col("u").alias("key")))
    big = stored(big)
    star = big.join(big.groupBy("bucket").agg(F.min("key").alias("u")), "bucket").where("u <> key").select("u", F.col("key").alias("v"))
    pairs = probed.where("u <> v").select("u", "v").union(star).distinct()
    pairs = tested(apart_by(pairs, roots).join(linked, ["u", "v"], "left_anti"))
    for some in (lambda p: p.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), lambda p: p):
        more = verified(stored(some(apart_by(pairs, roots))))
        if not more.isEmpty():
            roots = joined(roots, more)
    if not big.isEmpty():
        rooted = stored(big.join(roots, F.col("key") == F.col("node"), "left").select("bucket", "sets", "key", F.coalesce("root", "key").alias("root")))
        several = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
        blocks = F.ceil(F.col("sets") / BLOCK_SETS).cast("int")
        mine = F.pmod(F.xxhash64("key"), blocks).cast("int")
        block = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(mine, j).cast("long") * (1 << 31) + F.greatest(mine, j)))
        dealt = rooted.join(several, "bucket").select("bucket", block.alias("block"), "key", "root").join(vertices.select("key", "n", "bits"), "key")
        maybe = stored(dealt.repartition(k, "bucket", "block").sortWithinPartitions("bucket", "block", "key").mapInPandas(active, "bucket long, block long, key long, root long"), SET_ROWS)
        if not maybe.isEmpty():
            dealt = maybe.join(sets_of(maybe.select("key")), "key")
            more = dealt.repartition(k, "bucket", "block").sortWithinPartitions("bucket", "block", "key").mapInPandas(compare, "u long, v long")
            more = stored(more.distinct(), TEXT_ROWS)
            if not more.isEmpty():
                roots = joined(roots, more)
    rooted = stored(vertices.select("key", "least").join(roots, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("root", "key").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = told.select("doc_id", "key").join(rooted.join(smallest, "root").select("key", "component_id"), "key").select("doc_id", "component_id")
    lone = id_text(docs, text=text, doc_id=doc_id).where("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("component_id"))
    return named.unionByName(lone)


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
