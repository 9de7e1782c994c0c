"""Document fingerprints by winnowing.

Rolling hashes of ``gram``-byte strings; of every ``window`` neighbouring
hashes the smallest is kept, the rightmost of equal ones, with its place; at
the ends of a text the windows that reach over them count what is inside.  Two
texts that share ``gram + window - 1`` bytes keep a common hash there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from railyard.llm.common import binary_values, block_count, gram_hashes, window_minima

GRAM = 8
WINDOW = 16
# bytes hashed at a time
PIECE = 1 << 20
_LOW = np.uint64((1 << 24) - 1)
_NONE = np.uint64((1 << 64) - 1)


def _kept(texts: list[bytes], gram: int, window: int, open_start: bool = False, open_end: bool = False):
    """Places and hashes kept in ``texts``, as offsets into them joined, and where each text ends there.

    Windows reach over the ends of a text, where only the hashes inside it count; with ``open_start`` or ``open_end``
    (a part of a longer text) those at that end are left out.
    """
    # the gap between texts is so long that a window meets one text only
    gap, lengths = max(0, window - gram), np.array([len(t) for t in texts])
    lead, tail = (0 if open_start else window - 1), (0 if open_end else window - 1)
    data = np.frombuffer(b"\0" * lead + (b"\0" * gap).join(texts) + b"\0" * tail, np.uint8)
    starts = lead + np.cumsum(lengths + gap) - lengths - gap
    h = gram_hashes(data, gram)
    steps = np.zeros(len(h) + 1, np.int8)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + np.maximum(lengths - gram + 1, 0), -1)
    inside = np.cumsum(steps[:-1]) > 0
    keys = np.where(inside, (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64)), _NONE)
    best = window_minima(keys, window)
    best = best[best != _NONE]
    if len(best):
        best = best[np.concatenate([[True], best[1:] != best[:-1]])]
    at = (_LOW - (best & _LOW)).astype(np.int64)
    cut = np.searchsorted(at, starts)
    own = np.repeat(np.arange(len(texts)), np.diff(np.append(cut, len(at))))
    return own, at - starts[own], (h[at] >> np.uint64(32)).astype(np.uint32)


def winnowed(texts: list[bytes], gram: int = GRAM, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(places, hashes)`` of each text.

    One rule for every length: the smallest hash, the rightmost of equal ones, of every window that meets the text;
    at its ends windows are cut off, down to the first and the last hash alone.  A text shorter than a gram keeps the
    hash of all of it, an empty one nothing.
    """
    out: list = [None] * len(texts)
    least = gram + window - 1
    group, size = [], 0

    def flush():
        own, at, h = _kept([texts[i] for i in group], gram, window)
        cut = np.searchsorted(own, np.arange(len(group) + 1))
        for k, i in enumerate(group):
            out[i] = at[cut[k]:cut[k + 1]], h[cut[k]:cut[k + 1]]

    for i, t in enumerate(texts):
        if not t:
            out[i] = np.empty(0, np.int64), np.empty(0, np.uint32)
        elif len(t) < gram:
            out[i] = _kept([t], len(t), window)[1:]
        elif len(t) > PIECE:
            cuts = range(0, len(t) - least + 1, PIECE)
            parts = [(_kept([t[a:a + PIECE + least - 1]], gram, window, a > 0, a + PIECE + least - 1 < len(t))[1:], a) for a in cuts]
            at, h = np.concatenate([p[0] + a for p, a in parts]), np.concatenate([p[1] for p, _ in parts])
            at, first = np.unique(at, return_index=True)
            out[i] = at, h[first]
        else:
            group.append(i)
            size += len(t) + window
            if size >= PIECE:
                flush()
                group, size = [], 0
    if group:
        flush()
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of the two sets of kept hashes; two empty ones are alike."""
    x, y = set(a.tolist()), set(b.tolist())
    return len(x & y) / len(x | y) if x or y else 1.0


def _hex(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``doc_id, fingerprint`` (eight hex digits a kept hash, in text order) and ``positions`` (their byte offsets)
    of every row; null text counts as empty; other columns are ignored."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = d.schema["doc_id"].dataType

    def run(batches):
        for b in batches:
            kept = winnowed(binary_values(b.column(1)), gram, window)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([_hex(h) for _, h in kept], pa.string()),
                 pa.array([at for at, _ in kept], pa.list_(pa.int64()))], names=["doc_id", "fingerprint", "positions"])
    return d.mapInArrow(run, f"doc_id {kind.simpleString()}, fingerprint string, positions array<bigint>")


def edited(text: bytes, following: bytes) -> tuple[bytes, int]:
    """The text with its last quarter of code points replaced by as many first ones of the next; its length."""
    own = text.decode()
    n = len(own)
    # a code point has at most four bytes
    head = following[:4 * (n // 4) + 4].decode(errors="ignore")[:n // 4]
    return (own[:n - n // 4] + head).encode(), n


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compared(ids, texts, gram, window, id_type):
    """Result rows of ``texts[:-1]``, each followed by the next of the list."""
    made = [edited(a, b) for a, b in zip(texts, texts[1:])]
    own = [h for _, h in winnowed(texts, gram, window)]
    other = [h for _, h in winnowed([e for e, _ in made], gram, window)]
    return pa.RecordBatch.from_arrays([
        pa.array(ids, id_type), pa.array([n for _, n in made], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e, _ in made], pa.string()),
        pa.array([_hex(h) for h in own[:-1]], pa.string()), pa.array([_hex(h) for h in other], pa.string()),
        pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64())], names=_COLUMNS)


def neighbour_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to it and to the next document.

    Documents stand in ascending id order, null ids last, equal ids by their
    texts' digests; the first follows the last (a single one follows itself).
    Null text counts as empty.  Other columns are ignored.

    The documents are range-partitioned by id.  Within a partition a document
    finds the next one in the row behind it; the last of each partition is
    paired with the first of the next by a join of one row per partition on
    its number.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), block_count(d, block_bytes=32 << 20))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    d = d.withColumn("tie", F.sha2("text", 256)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    id_type = to_arrow_type(d.schema["doc_id"].dataType)
    schema = (f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_chars bigint, edited_sha256 string, "
              "fingerprint string, edited_fingerprint string, near_edited double, near_next double")

    def inner(batches):
        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), binary_values(b.column(1))):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size > 2 * PIECE and len(texts) > 1:
                    yield _compared(ids[:-1], texts, gram, window, id_type)
                    ids, texts, size = ids[-1:], texts[-1:], len(t)
        if len(texts) > 1:
            yield _compared(ids[:-1], texts, gram, window, id_type)

    def ends(batches):
        for b in batches:
            for i, t, n in zip(b.column(0).to_pylist(), binary_values(b.column(1)), binary_values(b.column(2))):
                yield _compared([i], [t, n], gram, window, id_type)

    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")
    edge = (d.withColumn("part", F.spark_partition_id()).groupBy("part")
             .agg(F.min_by("text", place).alias("first"), F.max_by(F.struct("doc_id", "text"), place).alias("end")))
    # passed through as it is, so that all its uses below have one plan and one exchange of texts
    edge = edge.mapInArrow(lambda batches: batches, f"part int, first string, end struct<doc_id:{d.schema['doc_id'].dataType.simpleString()},text:string>")
    # which partition follows which: their numbers alone, the texts are joined to them
    number = edge.select("part")
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), number.select(F.min("part")).scalar())
    number = number.select("part", following.alias("then"))
    firsts = edge.select(F.col("part").alias("then"), F.col("first").alias("next"))
    edge = edge.select("part", "end.doc_id", "end.text").join(number, "part").join(firsts, "then").select("doc_id", "text", "next")
    return d.select("doc_id", "text").mapInArrow(inner, schema).unionByName(edge.mapInArrow(ends, schema))
