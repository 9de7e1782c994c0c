"""SimHash near-duplicates: byte-position inverted index with count filtering.

A fingerprint has eight bytes.  Two fingerprints that differ in at most four
bits agree in at least four byte positions.  The inverted index is keyed by
three positions and their bytes; its 20 position triples are chosen so that
every set of four positions contains one of them, so each such pair meets in at
least one posting list.  In a list the shared positional bytes of pairs are
tallied, pairs below the guaranteed four are dropped and the rest verified by
their bit distance.  Only links that join components leave a list.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from railyard.llm.common import binary_values, checkpointed, connected_components

POSITIONS = 8
MIN_SHARED = 4
# lists longer than this are dealt again under one more shared byte
LONG_LIST = 50_000


def position_triples() -> list[tuple[int, int, int]]:
    """Three classes of positions in a ring: triples inside a class, and two of a class with one of the next."""
    classes = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [t for c in classes for t in combinations(c, 3)]
    for i, c in enumerate(classes):
        out += [(*pair, x) for pair in combinations(c, 2) for x in classes[(i + 1) % 3]]
    return [tuple(sorted(t)) for t in out]


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority bit of the XXH64 (seed 42) of the word shingles; no words: 0."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        size = np.fromiter(map(len, words), np.int64, n) + 1
        ends = np.cumsum(size)
        starts, ends = (ends - size)[:n - shingle + 1].tolist(), (ends - 1)[shingle - 1:].tolist()
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[a:b], 42) for a, b in zip(starts, ends)]
    grid = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.unpackbits(grid, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle):
    def run(batches):
        for b in batches:
            known: dict[bytes, int] = {}
            out = []
            for t in binary_values(b.column(1)):
                if t not in known:
                    known[t] = fingerprint(t, shingle)
                out.append(known[t])
            fp = np.array(out, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])
    return run


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``id, fp`` (the 64 bits as a long) of every row; null text counts as empty."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(_fingerprints(shingle), f"id {kind}, fp bigint")


def _close(a, b, max_bits):
    """Pairs that share enough positional bytes and then differ in few enough bits."""
    x = a ^ b
    shared = (x[..., None].view(np.uint8) == 0).sum(axis=-1) if x.ndim else 0
    ok = shared >= MIN_SHARED
    ok[ok] = np.bitwise_count(x[ok]) <= max_bits
    return ok


def _links_in_list(fps, max_bits):
    """Links that span the components of one posting list, grown from one member after another;
    each step compares a member with those not reached yet."""
    left, links = fps, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            ok = _close(left, x, max_bits)
            if ok.any():
                near = left[ok]
                links.append(np.stack([np.full(len(near), x), near]))
                queue.extend(near)
                left = left[~ok]
    return links


def _list_links(max_bits, short=12):
    def of(key, fp):
        n = len(key)
        if n < 2:
            return []
        cut = np.flatnonzero(np.diff(key)) + 1
        starts = np.concatenate([[0], cut])
        sizes = np.diff(np.concatenate([starts, [n]]))
        small = np.repeat(sizes, sizes) <= short
        links = []
        for d in range(1, int(min(short, sizes.max()))):
            i = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
            if len(i):
                ok = _close(fp[i], fp[i + d], max_bits)
                links.append(np.stack([fp[i][ok], fp[i + d][ok]]))
        for s, m in zip(starts[sizes > short], sizes[sizes > short]):
            links += _links_in_list(fp[s:s + m], max_bits)
        return links

    def run(batches):
        # rows come sorted by key; the last list of a batch may go on in the next
        rest = None
        for b in batches:
            key, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            if rest is not None:
                key, fp = np.concatenate([rest[0], key]), np.concatenate([rest[1], fp])
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            rest = key[whole:], fp[whole:]
            yield from _batch(of(key[:whole], fp[:whole]))
        if rest is not None:
            yield from _batch(of(*rest))

    def _batch(links):
        if links:
            a, b = np.concatenate(links, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    return run


def _byte(position):
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Spanning links ``a, b`` between distinct fingerprints (column ``fp``) at ``max_bits`` or fewer bits."""
    if not 0 <= max_bits <= POSITIONS - MIN_SHARED:
        raise ValueError("the index guarantees four shared bytes only up to four differing bits")

    def key(i, positions):
        k = F.lit(i).cast("bigint")
        for p in positions:
            k = F.shiftleft(k, 8).bitwiseOR(_byte(p))
        return k

    triples = position_triples()
    posted = fps.select("fp", F.explode(F.array(*[key(i, t) for i, t in enumerate(triples)])).alias("key"))
    sized = posted.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    short = sized.filter(F.col("n") <= LONG_LIST).select("key", "fp").mapInArrow(_list_links(max_bits), "a bigint, b bigint")
    # a long list is split by one more of the four bytes that a pair must share
    fours = [F.when(F.shiftright("key", 24) == i, F.array(*[key(i * POSITIONS + p, (*t, p)) for p in range(POSITIONS) if p not in t]))
             for i, t in enumerate(triples)]
    long = (sized.filter(F.col("n") > LONG_LIST).select("fp", F.explode(F.coalesce(*fours)).alias("key"))
                 .repartition("key").sortWithinPartitions("key").select("key", "fp")
                 .mapInArrow(_list_links(max_bits), "a bigint, b bigint"))
    return short.unionByName(long)


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links.  Null and empty
    texts have fingerprint 0 and link like any other; a null id never is a
    component id unless no member has one; repeated rows come out as often as
    they come in; other columns are ignored.
    """
    rows = checkpointed(simhash(docs, id_col, text_col, shingle))
    known = rows.groupBy("fp").agg(F.min("id").alias("low"))
    comp = connected_components(links(known.select("fp"), max_bits).distinct())
    label = known.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = label.groupBy("component").agg(F.min("low").alias("component_id"))
    of_fp = label.join(lowest, "component").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def hex_fingerprint(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
