"""MinHash near-duplicates: signature-coordinate inverted join, links confirmed on whole sets.

1. Every text becomes its set of distinct word shingles (64-bit hashes), a key of
   the set and a signature of ``COORDINATES`` minima.  Equal sets are one class.
2. A class is posted under its coordinate-value pairs.  Values that only one
   class has cannot collide and go; two classes that agree in ``t`` of ``k``
   coordinates share one of their ``k - t + 1`` rarest values, so only that prefix
   is posted, and values that large parts of the corpus share hardly ever are.
3. In a posting list, members are merged into leaders: a member within ``NEAR``
   coordinates of a leader is linked to it and skipped from then on.  This runs on
   salted parts of each list first and then on the leaders of all parts, so a list
   holds no more than its leaders, however many near copies there are.  Between
   leaders the count of collisions is compared with the match threshold less what
   the skipped members may differ.  The result is a set of candidate groups that
   no pair above the threshold leaves.
4. Links are confirmed on the whole sets, group by group and without listing all
   pairs: members of a group outside its largest component are compared with the
   group's every member, a growing number per round; what they reach joins them.
   When no such member is left, every pair that could still join two components
   of a group has been compared.

The match threshold is the largest count that a pair at the similarity limit
misses with a probability below ``MISS``.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from railyard.llm.common import checkpointed, connected_components, rows_with, sized, tasks_for
from railyard.llm.words import slices, words

SEPARATORS = r"[\x20\x09-\x0D]+"
COORDINATES = 64
# bytes kept of a coordinate's value; the first alone is compared inside a list
PLANES = 5
# chance that a pair exactly at the similarity limit agrees in fewer coordinates than asked for
MISS = 1e-5
# coordinates in which a skipped member may differ from its leader
NEAR = 3
# parts of a posting list that are merged on their own first, and of a group whose members meet its pivots
PARTS = 8
# members of a group compared with all others in the first round; later rounds take eight times as many
PIVOTS = 16

_GOLDEN, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x):
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * _GOLDEN
    return x ^ (x >> np.uint64(32))


_FACTORS = _mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def least_matches(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """Largest ``t`` with P(fewer than ``t`` of ``coordinates`` agree) at most ``miss`` at ``percent`` similarity."""
    p, total = percent / 100, 0.0
    for t in range(coordinates + 1):
        total += math.comb(coordinates, t) * p ** t * (1 - p) ** (coordinates - t)
        if total > miss:
            return max(1, t)
    return coordinates


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct ``row, hash`` of the texts' word shingles, by row; a text with fewer words has the whole sequence."""
    w = words(texts, SEPARATORS)
    n = np.bincount(w.row, minlength=w.rows)
    base = np.array([xxhash.xxh64_intdigest(x, 42) for x in w.dictionary], np.uint64)
    begin = np.cumsum(n) - n
    starts = np.repeat(begin, n)
    place = np.arange(len(w.code)) - starts
    length = np.minimum(n, shingle)[w.row] if len(w.row) else np.empty(0, np.int64)
    first = np.flatnonzero(place <= n[w.row] - length) if len(w.row) else np.empty(0, np.int64)
    # the number of words goes into the hash, so that "a b" of a short text is not a prefix of a longer shingle
    h = _mix(length[first].astype(np.uint64))
    for i in range(shingle):
        on = length[first] > i
        at = np.minimum(first + i, len(w.code) - 1)
        h = np.where(on, _mix(h * _GOLDEN + base[w.code[at]]) if len(base) else h, h)
    row = w.row[first]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new], w.rows


def _fixed(values: np.ndarray) -> pa.Array:
    """A binary value per row of a matrix of bytes."""
    rows, width = values.shape
    ends = pa.py_buffer((np.arange(rows + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), rows, [None, ends, pa.py_buffer(np.ascontiguousarray(values))])


def _signed(shingle):
    def run(batches):
        for b in batches:
            for s in slices(b, 1):
                row, h, rows = shingle_sets(s.column(1), shingle)
                n = np.bincount(row, minlength=rows)
                full = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[full]
                key, minima = np.zeros((rows, 2), np.uint64), np.zeros((rows, COORDINATES), np.uint64)
                if len(h):
                    key[full, 0] = np.add.reduceat(h, starts)
                    key[full, 1] = np.add.reduceat(_mix(h + _GOLDEN), starts)
                    for c, factor in enumerate(_FACTORS):
                        minima[full, c] = np.minimum.reduceat(h * factor, starts)
                    minima = _mix(minima)
                planes = minima[..., None].view(np.uint8).swapaxes(1, 2)[:, :PLANES].reshape(rows, -1)
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(2), pa.array(n.astype(np.int64)), _fixed(key.view(np.uint8)), _fixed(planes)],
                                                 names=["id", "text_key", "n", "key", "signature"])
    return run


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2) -> DataFrame:
    """``id, text_key, n, key, signature``: size and key of each row's set, and ``PLANES`` bytes of its value in every
    coordinate, first bytes first."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    d = d.withColumn("k", F.unhex(F.md5(F.coalesce("t", F.lit("")))))
    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(_signed(shingle), f"id {kind}, text_key binary, n bigint, key binary, signature binary")


# --- candidate groups --------------------------------------------------------
def _lists(batches):
    """``keys, signatures, goes_on`` of the lists of rows that come sorted by list; long lists come in parts."""
    last = None
    for b in batches:
        head = b.column(0).to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, COORDINATES)
        cut = np.append(np.flatnonzero(np.diff(head)) + 1, len(head)) if len(head) else []
        start = 0
        for stop in cut:
            yield head[start], b.column(1).slice(start, stop - start).to_pylist(), sig[start:stop], last == head[start]
            last = head[start]
            start = stop


def _merged(near):
    """Links of skipped members to their leaders, and the leaders (``other`` null)."""
    def run(batches):
        def out(rows):
            if rows:
                t, a, s, o = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(a, pa.int64()), pa.array(s, pa.binary()), pa.array(o, pa.int64())],
                                                 names=["value", "node", "signature", "other"])
        rows, names, leaders = [], [], np.empty((0, COORDINATES), np.uint8)
        for value, keys, sigs, goes_on in _lists(batches):
            if not goes_on:
                names, leaders = [], np.empty((0, COORDINATES), np.uint8)
            left = np.arange(len(keys))
            known, fresh = len(names), []
            while len(left):
                if known:
                    # leaders found in earlier parts of the list come first
                    name, sig = names[-known], leaders[-known]
                    known -= 1
                else:
                    name, sig = keys[left[0]], sigs[left[0]]
                    fresh.append(left[0])
                    rows.append((value, name, sig.tobytes(), None))
                    left = left[1:]
                hit = (sigs[left] != sig).sum(axis=1) <= near
                rows += [(value, keys[i], None, name) for i in left[hit]]
                left = left[~hit]
            names = names + [keys[i] for i in fresh]
            leaders = np.concatenate([leaders, sigs[fresh]]) if fresh else leaders
            if len(rows) > 20_000:
                yield from out(rows)
                rows = []
        yield from out(rows)
    return run


def _grown(most):
    """Links that span the components of each list's leaders, at ``most`` differing coordinates."""
    def run(batches):
        def links(keys, sigs):
            left = np.arange(len(keys))
            while len(left):
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    x = queue.pop()
                    hit = (sigs[left] != sigs[x]).sum(axis=1) <= most
                    yield from ((keys[x], keys[i]) for i in left[hit])
                    queue.extend(left[hit])
                    left = left[~hit]

        def out(found):
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        keys, sigs, found = [], [], []
        for _, more, sig, goes_on in _lists(batches):
            if not goes_on:
                if len(keys) > 1:
                    found += links(keys, np.concatenate(sigs))
                keys, sigs = [], []
                if len(found) > 20_000:
                    yield from out(found)
                    found = []
            keys, sigs = keys + more, sigs + [sig]
        if len(keys) > 1:
            found += links(keys, np.concatenate(sigs))
        yield from out(found)
    return run


def _posted(batches):
    """``value, node`` of every coordinate-value pair of a class."""
    at = _mix(np.arange(1, COORDINATES + 1, dtype=np.uint64))
    for b in batches:
        for start in range(0, b.num_rows, 4096):
            s = b.slice(start, 4096)
            planes = np.frombuffer(b"".join(s.column(1).to_pylist()), np.uint8).reshape(s.num_rows, PLANES, COORDINATES).astype(np.uint64)
            value = at + sum(planes[:, i] << np.uint64(8 * i) for i in range(PLANES))
            node = np.repeat(s.column(0).to_numpy(), COORDINATES)
            yield pa.RecordBatch.from_arrays([pa.array(_mix(value).view(np.int64).ravel()), pa.array(node)], names=["value", "node"])


def candidate_links(classes: DataFrame, matches: int) -> DataFrame:
    """``a, b``: links whose components hold every pair of ``classes`` that agrees in ``matches`` coordinates."""
    posted = classes.select("node", "signature").mapInArrow(_posted, "value bigint, node bigint")
    # one exchange by value: lists of one class end here
    common = posted.withColumn("n", F.count("*").over(Window.partitionBy("value"))).filter("n > 1")
    held = common.groupBy("node").agg(F.collect_list(F.struct("n", "value")).alias("values")).filter(F.size("values") >= matches)
    # of the values that are left, all but the ``matches - 1`` most common
    prefix = F.slice(F.array_sort("values"), F.lit(1), F.size("values") - (matches - 1))
    held = held.select("node", F.transform(prefix, lambda x: x["value"]).alias("values"))
    short = classes.select("node", F.substring("signature", 1, COORDINATES).alias("signature"))
    postings = held.join(short, "node").select(F.explode("values").alias("value"), "node", "signature")
    part = F.pmod(F.xxhash64("node"), F.lit(PARTS))
    parts = postings.repartition("value", part).sortWithinPartitions("value").select("value", "node", "signature")
    merged = checkpointed(parts.mapInArrow(_merged(NEAR), "value bigint, node bigint, signature binary, other bigint"))
    skipped = merged.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    leaders = merged.filter("other IS NULL").repartition("value").sortWithinPartitions("value").select("value", "node", "signature")
    between = leaders.mapInArrow(_grown(COORDINATES - matches + 2 * NEAR), "a bigint, b bigint")
    return skipped.unionByName(between).distinct()


# --- confirmation ------------------------------------------------------------
def _sets(shingle):
    def run(batches):
        for b in batches:
            for s in slices(b, 2):
                row, h, rows = shingle_sets(s.column(2), shingle)
                ends = np.append(0, np.cumsum(np.bincount(row, minlength=rows))).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), values], names=["node", "grp", "members"])
    return run


def confirmed_components(groups: DataFrame, percent: int) -> DataFrame:
    """``node, component`` of the sets that links of ``percent`` similarity connect inside their group.

    ``groups`` has ``node, grp, members`` (the set); a node without a link is its own component.
    """
    closed, pivots = [], PIVOTS
    labels = groups.select("node", "grp", F.col("node").alias("component"), F.lit(False).alias("done"))
    while True:
        # labels are narrow rows: as many tasks as they are worth, whatever the number that the sets are dealt to
        tasks = tasks_for(labels.count())
        labels = labels.coalesce(tasks)
        # a group goes on while a node outside its largest component has not been compared with all others
        sizes = labels.groupBy("grp", "component").agg(F.count("*").alias("n"), F.count_if(~F.col("done")).alias("left")).coalesce(tasks)
        states = sizes.groupBy("grp").agg(F.max_by(F.struct("component", "left"), F.struct("n", "component")).alias("top"), F.sum("left").alias("left"))
        states = checkpointed(states.select("grp", F.col("top.component").alias("largest"), (F.col("left") > F.col("top.left")).alias("goes_on")).coalesce(tasks))
        going = states.filter("goes_on").select("grp", "largest")
        closed.append(labels.join(states.filter("NOT goes_on").select("grp"), "grp", "left_semi").select("node", "component"))
        if going.isEmpty():
            return reduce(DataFrame.unionByName, closed)
        labels = labels.join(going, "grp").coalesce(tasks)
        place = F.row_number().over(Window.partitionBy("grp").orderBy("node"))
        chosen = labels.filter("component != largest AND NOT done").withColumn("place", place).filter(F.col("place") <= pivots)
        chosen = checkpointed(chosen.select("node", F.lit(True).alias("now")).coalesce(tasks))
        # the sets of groups that are done stay where they are, and a node that the filter takes for a pivot is compared as
        # one, which does no harm; a group's members are dealt to parts, each of which meets all of its pivots
        opened = rows_with(groups, going, "grp").withColumn("n", F.size("members"))
        p = rows_with(opened, chosen, "node").select("grp", F.explode(F.array(*map(F.lit, range(PARTS)))).alias("part"),
                                                     F.col("node").alias("b"), F.col("members").alias("other"), F.col("n").alias("m"))
        part = F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int").alias("part")
        pairs = opened.select("grp", part, F.col("node").alias("a"), "members", "n").join(p, ["grp", "part"]).filter("a != b")
        pairs = pairs.filter(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
        shared = F.size(F.array_intersect("members", "other"))
        new = pairs.filter(100 * shared >= percent * (F.col("n") + F.col("m") - shared)).select("a", "b")
        # what was one component stays one
        known = labels.filter("component != node").select(F.col("node").alias("a"), F.col("component").alias("b"))
        comp = connected_components(new.unionByName(known))
        labels = (labels.select("node", "grp", "done").join(comp, "node", "left").join(chosen, "node", "left")
                        .select("node", "grp", F.coalesce("component", "node").alias("component"), (F.col("done") | F.col("now").isNotNull()).alias("done")))
        labels = checkpointed(labels.coalesce(tasks))
        pivots *= 8


def minhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Two rows are linked if the Jaccard similarity of their shingle sets is at least ``percent``; ``component_id`` is the
    smallest id reachable and ``kept`` marks the row whose id that is.  A null, empty or wordless text has no shingles and
    is linked with nothing: its own id is its component.  A null id is a component id only if no member has another.
    Repeated rows, and rows that share an id, come out as often as they come in.  Very long texts are worked on alone;
    an empty table gives an empty frame; other columns are ignored, whatever their names.
    """
    matches = least_matches(percent)
    rows = checkpointed(signatures(docs, id_col, text_col, shingle))
    one = F.min_by(F.struct("id", "text_key", "signature"), F.struct(F.col("id").isNull(), "id", "text_key"))
    classes = rows.filter("n > 0").groupBy("key").agg(one.alias("one"))
    # the numbers are read back from the checkpoint, so they are the same for every later step
    classes = checkpointed(classes.select("key", "one.*", F.monotonically_increasing_id().alias("node")))
    groups = connected_components(candidate_links(classes, matches)).select("node", F.col("component").alias("grp"))
    # the whole sets of one text of every class in a group; written, so that its size is known when texts are joined to it
    chosen = classes.select("node", F.col("id").alias("_id"), F.col("text_key").alias("_text")).join(groups, "node")
    chosen = sized(chosen, "minhash-classes")
    texts = docs.select(F.col(id_col).alias("_of"), F.col(text_col).cast("string").alias("t")).withColumn("k", F.unhex(F.md5(F.coalesce("t", F.lit("")))))
    # few texts have a candidate: the others are left where they are
    texts = rows_with(texts, chosen.select(F.col("_text").alias("k")), "k")
    texts = texts.join(chosen, (F.col("k") == F.col("_text")) & F.col("_of").eqNullSafe(F.col("_id"))).dropDuplicates(["node"])
    sets = checkpointed(texts.select("node", "grp", "t").mapInArrow(_sets(shingle), "node bigint, grp bigint, members array<bigint>"))
    comp = classes.select("key", "node", "id").join(confirmed_components(sets, percent), "node", "left")
    comp = comp.select("key", "id", F.coalesce("component", "node").alias("component"))
    lowest = comp.groupBy("component").agg(F.min("id").alias("component_id"))
    of_key = comp.join(lowest, "component").select("key", "component_id")
    some = rows.filter("n > 0").select("id", "n", "key").join(of_key, "key").select("id", "n", "component_id")
    whole = some.unionByName(rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return whole.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id",
                        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
