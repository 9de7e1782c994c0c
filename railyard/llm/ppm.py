"""Prediction by partial matching: code length of documents under a byte-context trie.

The trie counts, for every context of up to ``ORDER`` bytes, the symbols that
follow it in the training documents; a symbol is a byte or the end of the text.
A symbol is coded at the longest context that has seen it.  Each longer context
first codes an escape, estimated by the number of distinct symbols it has seen
(method D: half a count for each), and the symbols it has seen are excluded below.  Under all
contexts lies the uniform distribution over the symbols still left.

Blocks of documents send their distinct (context, symbol) strings with
training counts to buckets chosen by the two latest context symbols, or by the
three latest where those two hold more than one part in ``HOT`` of the training
symbols: a bucket holds every trie node below those levels.  The levels above
are counted first and go along with the task: at most 257 * 257 counts of a
symbol after one, and 257 for each of at most ``HOT`` frequent pairs.  A bucket
answers with the code length of each string, and the blocks add up their
documents.  Word counts for the add-0.1 unigram model take the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from railyard.llm.common import binary_values, block_count, checkpointed, gram_hashes
from railyard.llm.words import slices

ORDER = 5
SYMBOLS = 257
BITS = 9
LOW = (1 << BITS) - 1
BLOCK = 8 << 20
# symbols taken at a time, and documents among them (their number shares a word with the string)
CHUNK, CHUNK_DOCS = 1 << 20, 1 << (64 - BITS * (ORDER + 1))
DOC_BITS = np.uint64(64 - BITS * (ORDER + 1))
WORDS, GRAMS = 0, 1
SMOOTH = 0.1
# pairs of symbols with more than one part in HOT of all are dealt by one symbol more
HOT = 512


# ---------------------------------------------------------------------------
# strings of a context and its symbol
# ---------------------------------------------------------------------------
def chunks(texts: list[bytes]):
    """``first document, strings``: sorted 64-bit words of latest context symbol first, the coded symbol, and
    the document's number from the first one on.  Symbol 0 stands before and after a text."""
    def made(first, parts, skips):
        sym = np.zeros(sum(map(len, parts)) + ORDER * len(parts) + len(parts), np.uint64)
        doc = np.zeros(len(sym), np.uint64)
        used = np.ones(len(sym), bool)
        at = 0
        for k, (p, (own, lead, final)) in enumerate(zip(parts, skips)):
            size = ORDER + len(p) - lead + final
            body = np.frombuffer(p, np.uint8).astype(np.uint64) + np.uint64(1)
            sym[at + ORDER - lead:at + ORDER - lead + len(p)] = body
            used[at:at + ORDER] = False
            doc[at:at + size] = own
            at += size
        sym, doc, used = sym[:at], doc[:at], used[:at]
        key = np.zeros(at, np.uint64)
        for j in range(1, ORDER + 1):
            key[j:] |= sym[:-j] << np.uint64(BITS * (ORDER + 1 - j))
        key |= sym
        return first, np.sort((key[used] << DOC_BITS) | doc[used])

    first, parts, skips, size = 0, [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t)), CHUNK):
            if size >= CHUNK or i - first >= CHUNK_DOCS:
                yield made(first, parts, skips)
                first, parts, skips, size = i, [], [], 0
            lead = min(a, ORDER)                    # context from the piece before
            piece = t[a - lead:a + CHUNK]
            parts.append(piece)
            skips.append((i - first, lead, a + CHUNK >= len(t)))
            size += len(piece) + ORDER
    if parts:
        yield made(first, parts, skips)


def strings_of(taken, train: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of the chunks, sorted, and their number in training texts."""
    keys, counts = [], []
    for first, s in taken:
        own = np.array(train[first:first + CHUNK_DOCS])
        key, doc = s >> DOC_BITS, (s & np.uint64(CHUNK_DOCS - 1)).astype(np.int64)
        start = _starts(key)
        keys.append(key[start])
        counts.append(np.add.reduceat(own[doc].astype(np.int64), start))
    return _merged(np.concatenate(keys or [np.empty(0, np.uint64)]), np.concatenate(counts or [np.empty(0, np.int64)]))


def _starts(values):
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def _merged(keys, counts):
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = _starts(keys)
    return keys[start], np.add.reduceat(counts[order], start)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = gram_hashes(np.arange(256, dtype=np.uint8), 1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
END = np.uint64(0)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and text number of every word, and of one end (0) for each text.

    A word's hash is the sum of its bytes' marks times powers of a step, taken
    from running sums over the joined texts, then mixed.
    """
    hashes, owners = [np.full(len(texts), END)], [np.arange(len(texts))]
    group, first, size = [], 0, 0
    for i, t in enumerate(texts):
        group.append(t)
        size += len(t)
        if size < CHUNK and i < len(texts) - 1:
            continue
        data = np.frombuffer(b" " + b" ".join(group) + b" ", np.uint8)
        blank = _SPACE[data]
        start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        stop = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTER[data] * _powers(_STEP, len(data)), out=sums[1:])
        h = (sums[stop] - sums[start]) * _powers(_BACK, len(data))[start]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        hashes.append(h | np.uint64(1 << 63))       # no word is the end
        owners.append(first + np.searchsorted(np.cumsum([len(g) + 1 for g in group]), start - 1, side="right"))
        group, first, size = [], i + 1, 0
    return np.concatenate(hashes), np.concatenate(owners)


def _powers(step, n, known={}):
    if len(known.get(step, ())) < n:
        p = np.full(max(n, 2 * CHUNK), step, np.uint64)
        p[0] = 1
        known[step] = np.cumprod(p, dtype=np.uint64)
    return known[step][:n]


# ---------------------------------------------------------------------------
# the trie's upper levels
# ---------------------------------------------------------------------------
@dataclass
class Upper:
    """Training counts above the buckets: of (latest context symbol, symbol); and of frequent pairs of the two
    latest context symbols with the symbol after them, sorted."""
    low: np.ndarray
    hot: np.ndarray             # whether a pair is frequent, by its code
    triples: np.ndarray
    counts: np.ndarray


def _triple_counts(batches):
    """Counts of (latest, second latest context symbol, symbol) of whole texts, as one code of three symbols."""
    known = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        for part in slices(b, 0, CHUNK):
            texts = [t.lower() for t in binary_values(part.column(0))]
            # two symbols before a text, one behind it
            sizes = np.array([len(t) + 3 for t in texts])
            data = np.frombuffer(b"\0\0" + b"\0\0\0".join(texts) + b"\0", np.uint8)
            sym = data.astype(np.int64) + 1
            first = np.cumsum(sizes) - sizes
            for at in (first, first + 1, first + sizes - 1):
                sym[at] = 0
            inside = np.ones(len(sym), bool)
            inside[first] = inside[first + 1] = False
            # symbols numbered by use, so that a table of all triples stays small
            used = np.flatnonzero(np.bincount(sym, minlength=SYMBOLS))
            k, at = len(used), np.flatnonzero(inside)
            number = np.zeros(SYMBOLS, np.int64)
            number[used] = np.arange(k)
            code = number[sym]
            n = np.bincount((code[at - 1] * k + code[at - 2]) * k + code[at], minlength=k ** 3)
            found = np.flatnonzero(n)
            c, s = np.divmod(found, k)
            latest, second = np.divmod(c, k)
            triple = (used[latest] << 2 * BITS) | (used[second] << BITS) | used[s]
            known = _merged(np.concatenate([known[0], triple]), np.concatenate([known[1], n[found]]))
    yield pa.RecordBatch.from_arrays([pa.array(known[0]), pa.array(known[1])], names=["triple", "n"])


def upper_levels(train: DataFrame) -> Upper:
    """Count the upper levels over ``text`` of ``train``; what the driver gets is bounded by the alphabet and ``HOT``."""
    n = train.select("text").mapInArrow(_triple_counts, "triple bigint, n bigint").groupBy("triple").agg(F.sum("n").alias("n"))
    n = checkpointed(n)
    latest, symbol = F.shiftright("triple", 2 * BITS), F.col("triple").bitwiseAND(F.lit(LOW))
    low = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    for r in n.groupBy(latest.alias("c"), symbol.alias("s")).agg(F.sum("n").alias("n")).collect():
        low[r.c, r.s] = r.n
    pair = F.shiftright("triple", BITS)
    hot = np.zeros(1 << 2 * BITS, bool)
    frequent = n.groupBy(pair.alias("pair")).agg(F.sum("n").alias("n")).filter(F.col("n") * HOT > int(low.sum()))
    pairs = [r.pair for r in frequent.collect()]
    hot[pairs] = True
    rows = sorted(map(tuple, n.filter(pair.isin(pairs)).collect())) if pairs else []
    return Upper(low, hot, np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64))


def bucket_of(keys: np.ndarray, buckets: int, hot: np.ndarray) -> np.ndarray:
    two, three = keys >> np.uint64(BITS * (ORDER - 1)), keys >> np.uint64(BITS * (ORDER - 2))
    top = np.where(hot[two], three + np.uint64(1 << 3 * BITS), two)
    return ((top * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes apart, which compress well."""
    d = keys.copy()
    d[1:] -= keys[:-1]
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(body: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(d, dtype=np.uint64)


# ---------------------------------------------------------------------------
# code lengths
# ---------------------------------------------------------------------------
def _find(keys, wanted):
    """Index of each wanted value in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def code_lengths(keys: np.ndarray, counts: np.ndarray, upper: Upper) -> np.ndarray:
    """log10 probability of the last symbol of each string after its context.

    ``keys`` are all strings below their two latest context symbols (three,
    where those are frequent), with training counts; ``upper`` has the counts
    of the levels above in the whole training corpus.
    """
    symbol = keys & np.uint64(LOW)
    nodes = []                                      # of each order: pairs, their counts; contexts, totals, distinct symbols
    for k in range(ORDER + 1):
        if k >= 2:
            seen = counts > 0
            pair = ((keys[seen] >> np.uint64(BITS * (ORDER + 1 - k))) << np.uint64(BITS)) | symbol[seen]
            pair, n = _merged(pair, counts[seen])
            if k == 2 and len(upper.triples):
                # a frequent pair's strings lie in several buckets
                here = ~upper.hot[pair >> np.uint64(BITS)]
                pair, n = _merged(np.concatenate([pair[here], upper.triples]), np.concatenate([n[here], upper.counts]))
        else:
            table = upper.low if k else upper.low.sum(axis=0, keepdims=True)
            flat = np.flatnonzero(table)
            c, s = np.divmod(flat, SYMBOLS)
            pair, n = (c.astype(np.uint64) << np.uint64(BITS)) | s.astype(np.uint64), table.ravel()[flat]
        context = pair >> np.uint64(BITS)
        start = _starts(context)
        total = np.add.reduceat(n, start) if len(start) else n
        nodes.append((pair, n, context[start], total, np.diff(np.append(start, len(pair)))))
    out = np.zeros(len(keys))
    left = np.arange(len(keys))                     # strings not coded yet
    gone_n, gone_d = np.zeros(len(keys)), np.zeros(len(keys))
    for k in range(ORDER, -1, -1):
        pair, n, context, total, distinct = nodes[k]
        own = keys[left] >> np.uint64(BITS * (ORDER + 1 - k))
        at, there = _find(context, own)
        rest = np.where(there, total[at] if len(total) else 0, 0) - gone_n[left]
        kinds = np.where(there, distinct[at] if len(distinct) else 0, 0) - gone_d[left]
        hit, found = _find(pair, (own << np.uint64(BITS)) | symbol[left])
        # a context whose symbols are all excluded codes nothing
        some = rest > 0
        p = np.where(found, (n[hit] if len(n) else 0) - 0.5, kinds / 2)
        out[left[some]] += np.log10(p[some] / rest[some])
        if k:
            # what this context has seen is excluded in the next shorter one
            shorter, m = nodes[k - 1][:2]
            cut = (pair >> np.uint64(2 * BITS) << np.uint64(BITS)) | (pair & np.uint64(LOW)) if k > 1 else pair & np.uint64(LOW)
            to, known = _find(shorter, cut)
            start = _starts(pair >> np.uint64(BITS))
            sums = np.add.reduceat(np.where(known, m[to] if len(m) else 0, 0), start) if len(start) else np.zeros(1)
            gone_n[left] = np.where(there, sums[at] if len(context) else 0, gone_n[left] * 0)
            gone_d[left] = np.where(there, distinct[at] if len(context) else 0, 0)
        else:
            unseen = ~found
            out[left[unseen]] -= np.log10(SYMBOLS - len(nodes[0][0]))
        left = left[~found]
    return out


# ---------------------------------------------------------------------------
# messages
# ---------------------------------------------------------------------------
_REQUEST = "bucket int, kind int, blk int, body binary, counts binary"
_REQUEST_TYPES = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blk", pa.int32()), ("body", pa.binary()), ("counts", pa.binary())])


def _rows(rows, schema):
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)


def _buckets(kind, keys, buckets, hot):
    b = bucket_of(keys, buckets, hot) if kind == GRAMS else (keys >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(b, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(b[order])) + 1):
        if len(part):
            yield int(b[part[0]]), part


def _block(table):
    texts = [t.lower() for t in binary_values(table["text"])]
    return texts, [not h for h in table["held_out"].to_pylist()]


def _requests(buckets, hot):
    def run(table):
        if not table.num_rows:
            return _rows([], _REQUEST_TYPES)
        texts, train = _block(table)
        blk, rows = table["blk"][0].as_py(), []
        words, owner = word_hashes(texts)
        for kind, (keys, counts) in ((GRAMS, strings_of(chunks(texts), train)), (WORDS, _merged(words, np.array(train)[owner].astype(np.int64)))):
            for b, part in _buckets(kind, keys, buckets, hot):
                rows.append((b, kind, blk, _packed(keys[part]), counts[part].astype(np.uint32).tobytes()))
        return _rows(rows, _REQUEST_TYPES)
    return run


def _asked(batch):
    return zip(*(batch.column(c).to_pylist() for c in ("kind", "body", "counts")))


_ANSWER = "blk int, bucket int, kind int, body binary"
_ANSWER_TYPES = pa.schema([("blk", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])


def _answers(upper):
    def run(requests):
        rows = []
        asked = list(zip(*(requests[c].to_pylist() for c in ("bucket", "kind", "blk", "body", "counts"))))
        for kind in (GRAMS, WORDS):
            own = [(b, blk, _unpacked(body), np.frombuffer(c, np.uint32)) for b, k, blk, body, c in asked if k == kind]
            if not own:
                continue
            keys, counts = _merged(np.concatenate([g[2] for g in own]), np.concatenate([g[3] for g in own]).astype(np.int64))
            answer = code_lengths(keys, counts, upper).astype(np.float32) if kind == GRAMS else counts
            for b, blk, wanted, _ in own:
                rows.append((blk, b, kind, _planes(answer[np.searchsorted(keys, wanted)])))
        return _rows(rows, _ANSWER_TYPES)
    return run


def _planes(values):
    """Bytes of an array, planes apart, which compress better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _from_planes(body, kind):
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _vocabulary(batches):
    """Training vocabulary and tokens of the word requests; a partition holds whole buckets."""
    keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for batch in batches:
        for kind, body, n in _asked(batch):
            if kind == WORDS:
                keys.append(_unpacked(body))
                counts.append(np.frombuffer(n, np.uint32).astype(np.int64))
        keys, counts = map(lambda x: [x], _merged(np.concatenate(keys), np.concatenate(counts)))
    yield pa.RecordBatch.from_arrays([pa.array([int((counts[0] > 0).sum()) if len(counts) == 1 else 0], pa.int64()),
                                      pa.array([int(sum(c.sum() for c in counts))], pa.int64())], names=["vocabulary", "tokens"])


def _scores(buckets, hot, id_type):
    schema = pa.schema([("doc_id", id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("known_part", pa.float64()), ("score", pa.float64())])

    def run(docs, answers):
        if not docs.num_rows:
            return _rows([], schema)
        texts, train = _block(docs)
        got = {(k, b): body for k, b, body in zip(*(answers[c].to_pylist() for c in ("kind", "bucket", "body")))}
        taken = list(chunks(texts))
        words, owner = word_hashes(texts)
        names, place = np.unique(words, return_inverse=True)
        answer = {}
        for kind, keys, form in ((GRAMS, strings_of(taken, train)[0], np.float32), (WORDS, names, np.int64)):
            answer[kind] = keys, (value := np.empty(len(keys), form))
            for b, part in _buckets(kind, keys, buckets, hot):
                value[part] = _from_planes(got[kind, b], form)
        score = np.zeros(len(texts))
        keys, code = answer[GRAMS]
        for first, s in taken:
            key, doc = s >> DOC_BITS, (s & np.uint64(CHUNK_DOCS - 1)).astype(np.int64)
            start = _starts(key)
            own = np.repeat(code[np.searchsorted(keys, key[start])].astype(np.float64), np.diff(np.append(start, len(key))))
            part = np.bincount(doc, own)
            score[first:first + len(part)] += part
        count = answer[WORDS][1][place]
        sums = [np.bincount(owner, x, len(texts)) for x in (np.ones(len(owner)), count > 0, np.log10(count + SMOOTH))]
        return pa.table([docs["id"].combine_chunks().cast(id_type), docs["held_out"].combine_chunks(), pa.array(sums[0].astype(np.int64)),
                         pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(score)], schema=schema)
    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Learns from the rows whose CRC-32 of the id's text is no multiple of
    ``folds``.  A-Z are lower-cased.  ``base_score`` is the add-0.1 unigram
    model over white-space words and an end token; ``score`` the trie's log10
    probability of the text and its end.  Null text is empty, a null id counts
    as empty text; repeated rows are counted and scored as often as they come;
    without training rows every symbol has probability 1/257.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                    (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0).alias("held_out"))
    blocks = block_count(d, block_bytes=BLOCK)
    buckets = -(-blocks // 2) + 1
    blk = F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")
    rows = d.withColumn("blk", blk).repartition("blk")
    upper = upper_levels(d.filter(~F.col("held_out")))
    # all columns, so that the exchange by bucket serves the answers and the vocabulary
    requests = rows.groupBy("blk").applyInArrow(_requests(buckets, upper.hot), _REQUEST).repartition("bucket")
    answers = requests.groupBy("bucket").applyInArrow(_answers(upper), _ANSWER)
    found = rows.groupBy("blk").cogroup(answers.select("blk", "bucket", "kind", "body").groupBy("blk"))
    id_type = d.schema["id"].dataType
    scored = found.applyInArrow(_scores(buckets, upper.hot, to_arrow_type(id_type)),
                                f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, known_part double, score double")
    stats = requests.mapInArrow(_vocabulary, "vocabulary bigint, tokens bigint").agg(
        F.struct(F.coalesce(F.sum("vocabulary"), F.lit(0)).alias("v"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).alias("s"))
    scored = scored.withColumn("s", stats.scalar())
    base = F.col("known_part") - F.col("n_tokens") * F.log10(F.col("s.n") + F.lit(SMOOTH) * (F.col("s.v") + 1))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.col("s.n").alias("train_tokens"), base.alias("base_score"), "score")
