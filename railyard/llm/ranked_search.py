"""Ranked lexical search: an inverted index in shards, searched by Block-Max MaxScore.

Every task that reads documents cuts its rows into shards of bounded text size
and writes each shard's posting lists as compressed blocks with their last
document, largest term frequency and shortest length; the text is not shuffled.
Query terms are joined to the lists of the index, which bring the weight and
the items that ask for the term, and each shard is searched on its own:

* a list's bound is its largest block maximum; lists whose bounds together stay
  below the heap's lowest score are non-essential and give no candidates;
* a candidate's partial score plus the block maxima of the non-essential lists
  rejects it before any block of theirs is decompressed;
* only blocks that still hold candidates are decompressed, list by list from the
  highest bound, and the rejection is repeated after each.

Documents are taken in ranges of a shard, so that later ranges meet a full
heap.  The heaps of the shards are merged by item.  Everything but the weights'
logarithm is whole numbers.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from railyard.llm.common import rows_with, sized
from railyard.llm.words import SLICE_BYTES, slices, words
from railyard.session import scratch_path

# a-z, A-Z, 0-9 and everything beyond ASCII are term characters
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_BYTES = 16 << 20
BLOCK = 128
# documents of a shard that are scored together: the first ranges are small, to fill the heap early
RANGE, FIRST_RANGE = 2048, 256
# items whose searches share one group of a shard
ITEMS_PER_GROUP = 1000

_HEAD = np.dtype([("last", "<u4"), ("max_tf", "<u4"), ("min_n", "<u4"), ("start", "<u4"), ("width", "u1"), ("tf_width", "u1")])


# --- index ------------------------------------------------------------------
def _packed(values, width):
    """Little-endian bytes of ``values``, each in ``width`` bytes; and where each begins."""
    ends = np.cumsum(width)
    begin = ends - width
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for byte in range(4):
        on = width > byte
        out[begin[on] + byte] = values[on] >> (8 * byte) & 255
    return out, begin


def _width(values):
    return np.where(values < 256, 1, np.where(values < 65536, 2, 4))


def _posting_lists(code, doc, n_docs, lengths):
    """``term code, df, heads, bodies`` of a shard: the lists' block heads and compressed blocks, each with offsets."""
    key, tf = np.unique(code * n_docs + doc, return_counts=True)
    term, doc = np.divmod(key, n_docs)
    first = np.flatnonzero(np.diff(term, prepend=-1))
    df = np.diff(np.append(first, len(term)))
    place = np.arange(len(term)) - np.repeat(first, df)
    starts = np.flatnonzero(place % BLOCK == 0)
    size = np.diff(np.append(starts, len(term)))
    # documents as gaps inside a block, the first one against zero
    gap = np.diff(doc, prepend=0)
    gap[starts] = doc[starts]
    max_tf = np.maximum.reduceat(tf, starts)
    wide, tf_wide = _width(np.maximum.reduceat(gap, starts)), _width(max_tf)
    # a block is its gaps, then its term frequencies
    widths = np.empty(2 * len(term), np.int64)
    values = np.empty(2 * len(term), np.int64)
    of_block = np.repeat(np.arange(len(starts)), size)
    in_block = np.arange(len(term)) - starts[of_block]
    at = 2 * starts[of_block] + in_block
    widths[at], values[at] = wide[of_block], gap
    at = at + size[of_block]
    widths[at], values[at] = tf_wide[of_block], tf
    body, begin = _packed(values, widths)
    block_begin = begin[2 * starts]
    list_of_block = np.searchsorted(first, starts, side="right") - 1
    body_ends = np.append(block_begin[np.searchsorted(list_of_block, np.arange(len(first)))], len(body))
    heads = np.empty(len(starts), _HEAD)
    heads["last"], heads["max_tf"], heads["min_n"] = doc[np.append(starts[1:], len(doc)) - 1], max_tf, np.minimum.reduceat(lengths[doc], starts)
    heads["start"], heads["width"], heads["tf_width"] = block_begin - body_ends[list_of_block], wide, tf_wide
    head_ends = np.append(np.searchsorted(list_of_block, np.arange(len(first))), len(heads)) * _HEAD.itemsize
    return term[first], df, (heads.tobytes(), head_ends), (body.tobytes(), body_ends)


def _binaries(data, ends):
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _shard_rows(name, ids, texts, schema):
    """Index rows of one shard: its documents (term null), then its posting lists."""
    # local numbers ascend with the id, so equal scores go to the smaller number
    order = pc.sort_indices(ids, null_placement="at_start")
    ids, texts = ids.take(order), texts.take(order)
    w = words(texts, SEPARATORS)
    lengths = np.bincount(w.row, minlength=len(ids)).astype(np.int64)
    listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)

    def rows(n, **columns):
        full = {"shard": pa.array([name] * n)} | columns
        return pa.RecordBatch.from_arrays([full.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in schema], schema=schema)

    yield rows(1, ids=listed, body=pa.array([lengths.astype("<u4").tobytes()]), df=pa.array([int((lengths > 0).sum())]), tokens=pa.array([int(lengths.sum())]))
    if len(w.code):
        term, df, heads, bodies = _posting_lists(w.code, w.row, len(ids), lengths)
        dictionary = pa.array(w.dictionary, pa.binary()).take(pa.array(term)).cast(pa.string())
        yield rows(len(term), term=dictionary, df=pa.array(df), heads=_binaries(*heads), body=_binaries(*bodies))


def _indexed(id_type, shard_bytes):
    schema = pa.schema([("shard", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("heads", pa.binary()),
                        ("body", pa.binary()), ("ids", pa.list_(id_type)), ("tokens", pa.int64())])

    def run(batches):
        task, count = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush():
            ids = pa.concat_arrays([h.column(0) for h in held])
            texts = pa.concat_arrays([pc.fill_null(h.column(1), "") for h in held])
            return _shard_rows(f"{task}-{count}", ids, texts, schema)
        for b in batches:
            for s in slices(b, 1, min(SLICE_BYTES, shard_bytes)):
                more = pc.sum(pc.binary_length(s.column(1))).as_py() or 0
                if held and size + more > shard_bytes:
                    yield from flush()
                    held, size, count = [], 0, count + 1
                held.append(s)
                size += more
        if held:
            yield from flush()
    return run


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the index of every row of ``docs`` to ``path`` and read it back.

    One row per shard with ``term`` null (its documents' ids and lengths, ``df`` the documents with a term, ``tokens``
    all terms) and one per posting list.  The rows of a shard depend only on the input's partition, so a task that is
    run again writes the same ones.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = d.schema["id"].dataType
    ddl = f"shard string, term string, df bigint, heads binary, body binary, ids array<{kind.simpleString()}>, tokens bigint"
    d.mapInArrow(_indexed(to_arrow_type(kind), shard_bytes), ddl).write.parquet(path)
    return docs.sparkSession.read.schema(ddl).parquet(path)


# --- search -----------------------------------------------------------------
def _impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class _List:
    """A posting list of a shard; blocks are decompressed when first asked for."""

    def __init__(self, heads, body, weight, norm):
        self.heads = np.frombuffer(heads, _HEAD)
        self.body, self.weight, self.norm = body, weight, norm
        self.last = self.heads["last"].astype(np.int64)
        # length norms grow with length, so a block's shortest document bounds it
        self.block_max = weight * _impact(self.heads["max_tf"].astype(np.int64), norm(self.heads["min_n"].astype(np.int64)))
        self.bound = int(self.block_max.max())
        self.count = np.full(len(self.heads), BLOCK, np.int64)
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _block(self, i):
        if i not in self._open:
            h = self.heads[i]
            end = int(self.heads["start"][i + 1]) if i + 1 < len(self.heads) else len(self.body)
            start, wide, tf_wide = int(h["start"]), int(h["width"]), int(h["tf_width"])
            n = (end - start) // (wide + tf_wide)
            doc = np.cumsum(np.frombuffer(self.body, f"<u{wide}", n, start), dtype=np.int64)
            tf = np.frombuffer(self.body, f"<u{tf_wide}", n, start + n * wide).astype(np.int64)
            self._open[i] = doc, self.weight * _impact(tf, self.norm.of(doc))
        return self._open[i]

    def blocks_of(self, docs):
        """Block that may hold each document, the number of blocks where none can."""
        return np.searchsorted(self.last, docs)

    def bounds(self, docs):
        b = self.blocks_of(docs)
        return np.where(b < len(self.last), self.block_max[np.minimum(b, len(self.last) - 1)], 0)

    def add_range(self, low, high, scores):
        """Add the scores of documents ``low`` to ``high - 1``."""
        first, stop = np.searchsorted(self.last, [low, high - 1])
        for i in range(first, min(stop + 1, len(self.last))):
            doc, score = self._block(i)
            a, b = np.searchsorted(doc, [low, high])
            scores[doc[a:b] - low] += score[a:b]

    def add_to(self, docs, scores):
        """Add the scores of ``docs`` (ascending); opens only their blocks."""
        block = self.blocks_of(docs)
        inside = block < len(self.last)
        for i in np.unique(block[inside]):
            doc, score = self._block(i)
            a, b = np.searchsorted(block, [i, i + 1])
            at = np.searchsorted(doc, docs[a:b])
            hit = doc[np.minimum(at, len(doc) - 1)] == docs[a:b]
            scores[a:b][hit] += score[at[hit]]


class _Norm:
    """Length norm of documents under the corpus' counts."""

    def __init__(self, lengths, n, total):
        self.n, self.total = n, total
        self._of = self(lengths)

    def __call__(self, lengths):
        return 50 + (50 * lengths * self.n) // self.total

    def of(self, docs):
        return self._of[docs]


def top_documents(lists: list[_List], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Local numbers and scores of the ``k`` best documents above zero, best first, ties to the smaller number."""
    lists = sorted(lists, key=lambda x: x.bound)
    below = np.cumsum([x.bound for x in lists])
    best, best_score = np.empty(0, np.int64), np.empty(0, np.int64)
    low, step = 0, FIRST_RANGE
    while low < n_docs:
        high = min(n_docs, low + step)
        least = int(best_score[-1]) if len(best) == k else 1
        # an equal score loses to a smaller number, which is in the heap already
        essential = int(np.searchsorted(below, least, side="right" if len(best) == k else "left"))
        if essential == len(lists):
            break
        scores = np.zeros(high - low, np.int64)
        for x in lists[essential:]:
            x.add_range(low, high, scores)
        docs = np.flatnonzero(scores)
        scores, docs = scores[docs], docs + low
        rest = lists[:essential][::-1]
        if rest and len(docs):
            bounds = [x.bounds(docs) for x in rest]
            left = np.sum(bounds, axis=0)
            for i, x in enumerate(rest):
                keep = scores + left > least if len(best) == k else scores + left >= least
                if not keep.all():
                    docs, scores, left, bounds = docs[keep], scores[keep], left[keep], [b[keep] for b in bounds]
                if not len(docs):
                    break
                left = left - bounds[i]
                x.add_to(docs, scores)
        if len(docs):
            docs, scores = np.concatenate([best, docs]), np.concatenate([best_score, scores])
            order = np.lexsort((docs, -scores))[:k]
            best, best_score = docs[order], scores[order]
        low, step = high, min(RANGE, step * 2)
    return best, best_score


def _searched(k, n, total, schema):
    def run(lists: pa.Table, shards: pa.Table) -> pa.Table:
        if not lists.num_rows or not shards.num_rows:
            return schema.empty_table()
        lengths = np.frombuffer(shards["lengths"][0].as_py(), "<u4").astype(np.int64)
        ids = shards["ids"].chunk(0).flatten()
        norm = _Norm(lengths, n, total)
        of_item: dict = {}
        for r in lists.select(["heads", "body", "weight", "items"]).to_pylist():
            one = _List(r["heads"], r["body"], r["weight"], norm)
            for item in r["items"]:
                of_item.setdefault(item["key"], (item, []))[1].append(one)
        items, docs, scores = [], [], []
        for item, its in of_item.values():
            d, s = top_documents(its, len(lengths), k)
            items += [item] * len(d)
            docs.append(d)
            scores.append(s)
        at = pa.array(np.concatenate(docs) if docs else np.empty(0, np.int64))
        found = pa.array(np.concatenate(scores) if scores else np.empty(0, np.int64))
        return pa.Table.from_arrays([pa.array(items, schema.field("item").type), ids.take(at), found], schema=schema)
    return run


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` best documents of every item, by ``build_index``'s index.

    Only documents with a score above 0 are returned, equal scores by ascending ``doc_id`` (null first).  A null or
    empty item, and one whose terms no document has, returns none; repeated rows of an item are one item, rows
    with the same id and different texts are searched each for itself.  Other columns are ignored.
    """
    stats = index.filter("term IS NULL").agg(F.sum("df"), F.sum("tokens")).first()
    n, total = stats[0] or 0, stats[1] or 0
    asked = items.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).distinct()
    lower = F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.array_distinct(F.filter(F.split(lower, SEPARATORS), lambda x: x != ""))
    item = F.struct("item_id", F.xxhash64("item_id", "t").alias("key"))
    asked = asked.select(item.alias("item"), F.explode(terms).alias("term"))
    lists = index.filter("term IS NOT NULL")
    df = lists.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * n + 2) / (F.col("df") * 2.0 + 1))).cast("long")
    groups = max(1, -(-items.count() // ITEMS_PER_GROUP))
    wanted = (asked.join(df.select("term", weight.alias("weight")), "term").filter("weight > 0")
                   .groupBy("term", "weight", F.pmod(F.xxhash64("item"), F.lit(groups)).alias("part"))
                   .agg(F.collect_list("item").alias("items")))
    # the lists of other terms are left where they are
    wanted = sized(wanted, "search-terms")
    wanted = rows_with(lists, wanted, "term").join(wanted, "term").select("shard", "part", "heads", "body", "weight", "items")
    parts = index.filter("term IS NULL").select(
        F.col("shard").alias("home"), F.col("body").alias("lengths"), "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("of"))
    out = T.StructType([T.StructField("item", asked.schema["item"].dataType), T.StructField("doc_id", index.schema["ids"].dataType.elementType),
                        T.StructField("score", T.LongType())])
    heaps = wanted.groupBy("shard", "part").cogroup(parts.groupBy("home", "of")).applyInArrow(
        _searched(k, n, max(1, total), to_arrow_schema(out)), out)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first()))
    return heaps.withColumn("rank", rank).filter(F.col("rank") <= k).select("item.item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``search`` over an index of all ``docs`` written to a folder of its own in the shared checkpoint folder.

    Null texts and texts without terms are indexed without postings and never found; repeated rows and repeated ids
    are documents of their own; empty tables give an empty frame; very long texts make a shard of their own.
    """
    index = build_index(docs, scratch_path(docs.sparkSession, f"search-index-{uuid.uuid4().hex}"), id_col, text_col)
    return search(index, items, item_col, item_text_col, k)
