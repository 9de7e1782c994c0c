"""Suffix-array dedup: drop every byte of a long string that also starts earlier.

Suffixes are sampled where a repeat can be recognised: each window of
``length`` bytes picks the smallest hash of its ``GRAM``-byte strings, so equal
windows pick the same place.  The windows that share a place form one segment.

1. Every block of documents sends its sampled hashes to buckets; a bucket
   answers with those that occur more than once.
2. Blocks send the segments around repeated places; equal segments of a block
   travel once.
3. A bucket orders the segments of each place by deep-shallow sorting, once by
   what follows the place and once by what precedes it: multikey quicksort to a
   shallow depth, then blind tries for the groups with a longer common prefix.
   The common-prefix lengths of the two orders tell for every window which
   others equal it; all but the first are repeats.
4. Blocks remove the bytes that repeated windows cover.

Messages are packed arrays, one row per block and bucket.  The documents are
shuffled once; later steps reuse that exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from railyard.llm.common import binary_values, block_count, gram_hashes, window_minima

GRAM = 32
# bytes of a context that multikey quicksort orders before the tries take over
SHALLOW = 40
# a document is scanned in pieces of this many windows, several documents to a piece
PIECE = 1 << 20
_LOW = np.uint64((1 << 24) - 1)


# ---------------------------------------------------------------------------
# sampled places
# ---------------------------------------------------------------------------
def _pieces(texts, length):
    """Groups of ``(document, offset, bytes)``; neighbours within a document overlap by ``length - 1``."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - length + 1), PIECE):
            part = t[at:at + PIECE + length - 1]
            group.append((i, at, part))
            size += len(part)
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def places(texts: list[bytes], length: int):
    """Sampled places of the texts, piece by piece.

    Yields ``data, doc, base, lo, hi, pos, hash``: windows ``lo..hi`` of
    ``data`` picked the string at ``pos``; the document's own offset is
    ``base`` plus the offset in ``data``.
    """
    w = length - GRAM + 1
    for group in _pieces(texts, length):
        data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        ends = np.cumsum([len(p) for _, _, p in group])
        h = gram_hashes(data, GRAM)
        at = np.arange(len(h), dtype=np.uint64)
        best = window_minima((h & ~_LOW) | (_LOW - at), w)
        inside = np.ones(len(best) + length, bool)
        for e in ends:
            inside[e - length + 1:e] = False
        win = np.flatnonzero(inside[:len(best)])
        picked = best[win]
        new = np.ones(len(win), bool)
        new[1:] = (picked[1:] != picked[:-1]) | (win[1:] != win[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(win)) - 1
        lo, hi = win[first], win[last]
        pos = (_LOW - (picked[first] & _LOW)).astype(np.int64)
        piece = np.searchsorted(ends, lo, side="right")
        doc = np.array([i for i, _, _ in group], np.int64)
        off = np.array([o for _, o, _ in group], np.int64) - np.concatenate([[0], ends[:-1]])
        yield data, doc[piece], off[piece], lo, hi, pos, h[pos]


# ---------------------------------------------------------------------------
# deep-shallow sorting
# ---------------------------------------------------------------------------
def _common(a: bytes, b: bytes) -> int:
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (x.bit_length() + 7) // 8


class _Node:
    __slots__ = ("depth", "kids")

    def __init__(self, depth, kids):
        self.depth, self.kids = depth, kids


def blind_trie_order(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorted order of equally long strings and each one's common prefix with the one before (first: -1).

    A node keeps only the depth at which its strings differ; a string is sent
    down by its bytes at those depths alone, compared once with the leaf that
    it reaches, and branches off where the two differ.
    """
    size = len(strings[0])
    root = [0]                                     # a leaf: the indices of equal strings
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while type(node) is _Node:
            node = node.kids.get(s[node.depth]) or next(iter(node.kids.values()))
        lcp = _common(s, strings[node[0]])
        if lcp == size:
            node.append(i)
            continue
        other = strings[node[0]]
        above, node = None, root
        while type(node) is _Node and node.depth < lcp:
            above, node = node, node.kids[s[node.depth]]
        if type(node) is _Node and node.depth == lcp:
            node.kids[s[lcp]] = [i]
            continue
        fork = _Node(lcp, {other[lcp]: node, s[lcp]: [i]})
        if above is None:
            root = fork
        else:
            above.kids[s[above.depth]] = fork
    order, lcps, stack = [], [], [(root, -1)]
    while stack:
        node, before = stack.pop()
        if type(node) is _Node:
            kids = [node.kids[c] for c in sorted(node.kids)]
            stack += [(k, node.depth) for k in reversed(kids[1:])]
            stack.append((kids[0], before))
        else:
            order += node
            lcps += [before] + [size] * (len(node) - 1)
    return order, lcps


def deep_shallow_sort(strings: np.ndarray, group: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``strings`` (bytes) inside each ``group``, and common prefixes with the row before.

    The first row of a group gets -1.  Multikey quicksort takes eight bytes as
    one symbol and partitions all groups of a depth at once; equal parts go on
    to the next symbol, up to ``shallow`` bytes.
    """
    n, size = strings.shape
    wide = np.zeros((n, -(-size // 8) * 8), np.uint8)
    wide[:, :size] = strings
    symbols = wide.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    lcp = np.zeros(n, np.int64)
    g = group[order]
    fresh = np.ones(n, bool)
    fresh[1:] = g[1:] != g[:-1]
    lcp[fresh] = -1
    depth = 0
    while depth < shallow:
        open_ = ~fresh
        open_[:-1] |= ~fresh[1:]
        at = np.flatnonzero(open_)
        if not len(at):
            break
        part = np.cumsum(fresh)[at]
        sym = symbols[order[at], depth // 8]
        by = np.lexsort((sym, part))
        order[at] = order[at][by]
        sym = sym[by]
        split = np.zeros(len(at), bool)
        split[1:] = (part[1:] == part[:-1]) & (sym[1:] != sym[:-1])
        x = np.zeros(len(at), np.uint64)
        x[1:] = sym[1:] ^ sym[:-1]
        s = at[split]
        lead = 7 - (np.frexp(x[split].astype(np.float64))[1] - 1) // 8
        # rounding up to the next power of two would move the first differing byte
        lead += (x[split] >> ((np.uint64(7) - lead.astype(np.uint64)) * np.uint64(8))) == 0
        lcp[s] = np.minimum(depth + lead, size)
        fresh[s] = True
        depth += 8
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, n))
    flat = np.ascontiguousarray(strings[:, min(depth, size):])
    rest = flat.shape[1]
    for s, m in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        rows = order[s:s + m]
        if rest == 0:
            lcp[s + 1:s + m] = size
            continue
        by, inner = blind_trie_order([flat[r].tobytes() for r in rows])
        order[s:s + m] = rows[by]
        lcp[s + 1:s + m] = np.array(inner[1:]) + min(depth, size)
    return order, lcp


# ---------------------------------------------------------------------------
# messages
# ---------------------------------------------------------------------------
def _segment_type(length):
    return np.dtype([("hash", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("lo", "<i8"),
                     ("windows", "u1"), ("lead", "u1"), ("text", "u1", (2 * length - GRAM,))])


_MARK = np.dtype([("tie", "<i8"), ("start", "<i8"), ("end", "<i8")])


def _bucket_of(h, buckets):
    return (h >> np.uint64(32)) % np.uint64(buckets)


def _by_bucket(values, bucket):
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(bucket[part[0]]), values[part]


def _table(rows, names, types):
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types))})


def _texts(table, within):
    """The texts as bytes, null as empty; ``within`` names their field of ``carried``, if they are there."""
    return binary_values(pc.struct_field(table["carried"], [within]) if within else table["text"])


def _sampled(length, buckets, within):
    def run(table):
        if not table.num_rows:
            return _table([], ["bucket", "blk", "body"], [pa.int32(), pa.int32(), pa.binary()])
        found = [h for *_, h in places(_texts(table, within), length)]
        h, n = np.unique(np.concatenate(found or [np.empty(0, np.uint64)]), return_counts=True)
        # the lowest bit says that the block itself repeats the string
        h = (h & ~np.uint64(1)) | (n > 1).astype(np.uint64)
        blk = table["blk"][0].as_py()
        rows = [(k, blk, v.tobytes()) for k, v in _by_bucket(h, _bucket_of(h, buckets))]
        return _table(rows, ["bucket", "blk", "body"], [pa.int32(), pa.int32(), pa.binary()])
    return run


def _repeated(table):
    bodies = [np.frombuffer(b, np.uint64) for b in table["body"].to_pylist()]
    blks = np.repeat(np.array(table["blk"].to_pylist(), np.int32), [len(b) for b in bodies])
    h = np.concatenate(bodies or [np.empty(0, np.uint64)])
    inside = (h & np.uint64(1)).astype(bool)
    h = h & ~np.uint64(1)
    order = np.argsort(h, kind="stable")
    h, blks, inside = h[order], blks[order], inside[order]
    same = h[1:] == h[:-1]
    again = inside.copy()
    again[1:] |= same
    again[:-1] |= same
    rows = [(k, v.tobytes()) for k, v in _by_bucket(h[again], blks[again])]
    return _table(rows, ["blk", "body"], [pa.int32(), pa.binary()])


def _segments(length, buckets, within):
    kind = _segment_type(length)
    span = 2 * length - GRAM
    names, types = ["bucket", "blk", "marks", "body"], [pa.int32(), pa.int32(), pa.bool_(), pa.binary()]

    def run(docs, answers):
        if not docs.num_rows or not answers.num_rows:
            return _table([], names, types)
        blk = docs["blk"][0].as_py()
        again, firsts = [], set()
        for body, keys in zip(answers["body"].to_pylist(), answers["firsts"].to_pylist()):
            if keys is not None:
                firsts.update(keys)
            elif body:
                again.append(np.frombuffer(body, np.uint64))
        again = np.sort(np.concatenate(again or [np.empty(0, np.uint64)]))
        tie, doc = docs["tie"].to_numpy(), docs["doc"].to_numpy()
        texts = _texts(docs, within)
        seen = set()
        for i, t in enumerate(tie.tolist()):        # a later copy is removed whole, without comparing
            if t not in firsts or t in seen:
                texts[i] = b""
            seen.add(t)
        parts = []
        for data, d, base, lo, hi, pos, h in places(texts, length):
            h = h & ~np.uint64(1)
            at = np.searchsorted(again, h)
            hit = np.flatnonzero((at < len(again)) & (again[np.minimum(at, len(again) - 1)] == h)) if len(again) else []
            if not len(hit):
                continue
            s = np.zeros(len(hit), kind)
            s["hash"], s["doc"], s["tie"] = h[hit], doc[d[hit]], tie[d[hit]]
            s["lo"] = lo[hit] + base[hit]
            s["windows"], s["lead"] = hi[hit] - lo[hit] + 1, pos[hit] - lo[hit]
            view = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(span, np.uint8)]), span)
            s["text"] = view[lo[hit]] * (np.arange(span) < (s["windows"].astype(int) + length - 1)[:, None])
            parts.append(s)
        if not parts:
            return _table([], names, types)
        s = np.concatenate(parts)
        s = s[np.lexsort((s["lo"], s["tie"], s["doc"]))]
        first, rest = _collapse(s)
        rows = [(k, blk, False, v.tobytes()) for k, v in _by_bucket(s[first], _bucket_of(s["hash"][first], buckets))]
        if len(rest):
            rows.append((blk % buckets, blk, True, _whole(s[rest], length).tobytes()))
        return _table(rows, names, types)
    return run


def _collapse(s):
    """Indices of the first of equal segments, and of the others; ``s`` is in document order."""
    size = s.dtype.itemsize
    raw, known = s.tobytes(), {}
    text = s.dtype.fields["windows"][1]
    keep = np.zeros(len(s), bool)
    for i in range(len(s)):
        body = raw[i * size + text:(i + 1) * size]
        if body not in known:
            known[body] = i
            keep[i] = True
    return np.flatnonzero(keep), np.flatnonzero(~keep)


def _whole(s, length):
    m = np.zeros(len(s), _MARK)
    m["tie"], m["start"] = s["tie"], s["lo"]
    m["end"] = s["lo"] + s["windows"].astype(np.int64) - 1 + length
    return m


def repeats_among(s: np.ndarray, length: int) -> np.ndarray:
    """Which windows of the segments (rows, in document order; no two equal) equal a window of an earlier one."""
    reach = length - GRAM
    n, lead = len(s), s["lead"].astype(np.int64)
    spans = np.concatenate([np.zeros((n, reach), np.uint8), s["text"], np.zeros((n, reach), np.uint8)], axis=1)
    cols = lead[:, None] + reach
    after = np.take_along_axis(spans, cols + np.arange(length), axis=1)
    used = s["windows"].astype(np.int64) - 1 + length - lead
    after *= np.arange(length) < used[:, None]
    before = np.take_along_axis(spans, cols - 1 - np.arange(reach), axis=1)
    before *= np.arange(reach) < lead[:, None]
    ranks, lcps = [], []
    for strings, shallow in ((after, SHALLOW), (before, SHALLOW - GRAM)):
        order, lcp = deep_shallow_sort(strings, s["hash"], shallow)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        ranks.append(rank)
        lcps.append(lcp)
    repeat = np.zeros((n, reach + 1), bool)
    for j in range(reach + 1):                     # the window that starts j bytes before the place
        own = np.flatnonzero((j <= lead) & (j > lead - s["windows"]))
        if len(own) < 2:
            continue
        a = np.cumsum(lcps[0] < length - j)[ranks[0][own]]
        b = np.cumsum(lcps[1] < j)[ranks[1][own]]
        _, first = np.unique(a * (n + 1) + b, return_index=True)
        later = np.ones(len(own), bool)
        later[first] = False
        repeat[own[later], j] = True
    return repeat


def _marks(length):
    kind = _segment_type(length)
    names, types = ["blk", "body"], [pa.int32(), pa.binary()]

    def run(table):
        rows, parts, blks = [], [], []
        for blk, marks, body in zip(*(table[c].to_pylist() for c in ("blk", "marks", "body"))):
            if marks:
                rows.append((blk, body))
            else:
                parts.append(np.frombuffer(body, kind))
                blks.append(np.full(len(parts[-1]), blk, np.int32))
        if not parts:
            return _table(rows, names, types)
        s, blks = np.concatenate(parts), np.concatenate(blks)
        order = np.lexsort((s["lo"], s["tie"], s["doc"]))
        s, blks = s[order], blks[order]
        first, rest = _collapse(s)
        out, to = [_whole(s[rest], length)], [blks[rest]]
        s, blks = s[first], blks[first]
        # a place with a single segment repeats nothing else
        _, back, count = np.unique(s["hash"], return_inverse=True, return_counts=True)
        several = count[back] > 1
        s, blks = s[several], blks[several]
        if len(s):
            repeat = repeats_among(s, length)
            edge = np.diff(np.pad(repeat.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            i, j0 = np.nonzero(edge == 1)
            _, j1 = np.nonzero(edge == -1)
            pos = s["lo"][i] + s["lead"][i]
            m = np.zeros(len(i), _MARK)
            m["tie"], m["start"], m["end"] = s["tie"][i], pos - (j1 - 1), pos - j0 + length
            out.append(m)
            to.append(blks[i])
        out, to = np.concatenate(out), np.concatenate(to)
        rows += [(k, v.tobytes()) for k, v in _by_bucket(out, to)]
        return _table(rows, names, types)
    return run


def kept_parts(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    """Runs of bytes outside the union of ``spans``, and the number of maximal runs inside it."""
    kept, runs, at = [], 0, -1
    for a, b in sorted(spans):
        if a > at:
            kept.append(text[max(at, 0):a])
            runs += 1
        at = max(at, b)
    kept.append(text[max(at, 0):])
    return kept, runs


def _removed(length, id_type, carried, whole, within):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "document"]
    types = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if whole else pa.binary(), pa.int64()]

    def run(docs, answers):
        firsts, marks = set(), []
        for body, keys in zip(answers["body"].to_pylist(), answers["firsts"].to_pylist()):
            if keys is not None:
                firsts.update(keys)
            elif body:
                marks.append(np.frombuffer(body, _MARK))
        marks = np.concatenate(marks or [np.empty(0, _MARK)])
        marks = marks[np.argsort(marks["tie"], kind="stable")]
        rows = []
        ties = docs["tie"].to_numpy() if docs.num_rows else np.empty(0, np.int64)
        a, b = np.searchsorted(marks["tie"], ties), np.searchsorted(marks["tie"], ties, side="right")
        for k, (key, t, text) in enumerate(zip(docs["id"].to_pylist(), ties.tolist(), _texts(docs, within))):
            if t in firsts:
                m = marks[a[k]:b[k]]
                parts, runs = kept_parts(text, list(zip(m["start"].tolist(), m["end"].tolist())))
            elif len(text) >= length:
                parts, runs = [], 1
            else:
                parts, runs = [text], 0
            kept = b"".join(parts)
            # a cut can split a character only at the ends of a part
            shown = "".join(p.decode(errors="ignore") for p in parts) if whole else kept
            rows.append((key, len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest(), shown, t))
        out = _table(rows, names, types)
        return out.append_column("carried", docs["carried"]) if carried else out
    return run


def _order(id_col):
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit((1 << 63) - 1))


def document_key(id_col: str = "doc_id", text_col: str = "text"):
    """A hash that tells rows with different id or text apart."""
    return F.xxhash64(_order(id_col), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100,
                       carry: list[str] = (), whole_characters: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, document`` for every row of ``docs``.

    A byte goes if a string of ``length`` bytes that covers it also starts
    earlier, in a document with a smaller id or earlier in its own.  Strings
    are taken from the texts as they come in and never cross documents.  Null
    text is empty.  A null id counts as the largest; documents that share an id
    are ordered by their texts' digests; rows that repeat id and text are the
    same document and come out alike.  Ids are whole numbers or text of such.  ``kept`` are the remaining bytes (a cut
    may fall inside a character) or, with ``whole_characters``, the text without the characters that a cut has
    split; ``document`` is ``document_key`` of the row.
    Other columns are ignored; those named in ``carry`` come out in the struct
    ``carried``.
    """
    if not GRAM < length < 255:
        raise ValueError(f"length must lie between {GRAM} and 255")
    # a text that is carried is exchanged, and goes to the tasks, once
    within = text_col if text_col in carry and docs.schema[text_col].dataType.typeName() == "string" else None
    d = docs.select(F.col(id_col).alias("id"), _order(id_col).alias("doc"),
                    *([] if within else [F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]),
                    *([F.struct(*carry).alias("carried")] if carry else []))
    text = F.coalesce(F.col("carried")[within], F.lit("")) if within else F.col("text")
    blocks = block_count(d.select(text.alias("text")))
    buckets = -(-blocks // 4)
    blk = F.pmod(F.col("tie"), F.lit(blocks)).cast("int").alias("blk")
    sha = F.sha2(text, 256)
    tie = F.xxhash64("doc", sha).alias("tie")
    rows = d.withColumn("tie", tie).select("*", blk).repartition("blk")
    firsts = (d.select("doc", sha.alias("sha")).groupBy("sha").agg(F.min("doc").alias("doc"))
              .select(F.xxhash64("doc", "sha").alias("tie")).select("tie", blk)
              .groupBy("blk").agg(F.collect_list("tie").alias("firsts"))
              .select("blk", F.lit(None).cast("binary").alias("body"), "firsts"))

    def answered(body):
        return body.select("blk", "body", F.lit(None).cast("array<bigint>").alias("firsts")).unionByName(firsts).groupBy("blk")

    sampled = rows.groupBy("blk").applyInArrow(_sampled(length, buckets, within), "bucket int, blk int, body binary")
    again = sampled.groupBy("bucket").applyInArrow(_repeated, "blk int, body binary")
    segments = rows.groupBy("blk").cogroup(answered(again)).applyInArrow(
        _segments(length, buckets, within), "bucket int, blk int, marks boolean, body binary")
    marks = segments.groupBy("bucket").applyInArrow(_marks(length), "blk int, body binary")
    id_type = d.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    return rows.groupBy("blk").cogroup(answered(marks)).applyInArrow(
        _removed(length, to_arrow_type(id_type), bool(carry), whole_characters, within),
        f"doc_id {id_type.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept {'string' if whole_characters else 'binary'}, document bigint"
        + (f", carried {d.schema['carried'].dataType.simpleString()}" if carry else ""))
