"""Language identification: a linear-chain conditional random field over words.

A word's score for each language is the sum of learned weights of its byte
n-grams and affixes (n-grams that include the word's edge) and, if the lexicon
has it, of the word itself; learned transition scores tie neighbouring words
together.  Forward-backward gives each word's probability of each language, so
code-switched text gets labels word by word; a document's language is the one
with the largest mean probability over its words.

Training uses a bounded sample (``per_language`` pieces of at most
``piece_words`` words a language, ``most_pieces`` of all), from which pure and
code-switched sequences are spliced; its gradients are summed over parts of
the sample, so that memory holds the weights and ``CELLS`` scores at a time.  Prediction reads every word of every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from railyard.llm.common import gram_hashes

SIZES = (2, 3, 4)
TABLE = 1 << 16
# text labelled at a time, for up to four languages (less for more)
PIECE = 4 << 20
# distinct words whose features are held at a time
WORDS = 1 << 15
# scores (words times languages) of a part of the training sample
CELLS = 1 << 22


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray        # (TABLE + lexicon, languages)
    lexicon: dict[bytes, int]
    transition: np.ndarray     # (languages, languages), scores
    start: np.ndarray


def features(words: list[bytes]):
    """Word index and table slot of every n-gram of the words; a word's edges count as a blank."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    blanks = np.concatenate([[0], np.cumsum(data == 32)])
    for n in SIZES:
        h = gram_hashes(data, n)
        # a blank may stand at either end of a gram, not inside; two blanks meet only at an empty word
        ok = np.flatnonzero(blanks[n - 1:n - 1 + len(h)] == blanks[1:1 + len(h)])
        yield blanks[ok + 1] - 1, ((h[ok] + np.uint64(n)) % np.uint64(TABLE)).astype(np.int64)


def _sums(index, slots, columns, n):
    return np.stack([np.bincount(index, c[slots], n) for c in columns], axis=1)


def emissions(words: list[bytes], model: Model) -> np.ndarray:
    """Scores of distinct words; words without letters say nothing."""
    columns = [np.ascontiguousarray(c) for c in model.weights.T]
    out = np.zeros((len(words), len(columns)))
    for start in range(0, len(words), WORDS):
        some = words[start:start + WORDS]
        for word, slot in features(some):
            out[start:start + len(some)] += _sums(word, slot, columns, len(some))
    known = [(i, slot) for i, slot in enumerate(map(model.lexicon.get, words)) if slot is not None]
    if known:
        at, slot = np.array(known).T
        out[at] += model.weights[slot]
    out[[i for i, w in enumerate(words) if not _has_letter(w)]] = 0
    return out


_ASCII_LETTER = re.compile(rb"[a-z]")


def _has_letter(word: bytes) -> bool:
    return _ASCII_LETTER.search(word) is not None or not word.isascii() and any(map(str.isalpha, word.decode(errors="replace")))


def posteriors(scores: np.ndarray, lengths: np.ndarray, model: Model, pairs: np.ndarray | None = None,
               flat: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward over sequences laid out one after another, longest first, ``lengths`` words each.

    ``scores`` has a row for each word or, with ``flat`` (that row's number for each word), for each distinct one.  Probability of each
    language for each word (the one array of that size); adds the expected counts of neighbouring languages to ``pairs``.
    """
    flat = np.arange(len(scores)) if flat is None else flat
    scores = scores - scores.max(axis=1, keepdims=True)
    local, move = np.exp(scores), np.exp(model.transition - model.transition.max())
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    forward = np.empty((len(flat), local.shape[1]))
    live = len(lengths)
    a = local[flat[first]] * np.exp(model.start - model.start.max())
    a /= a.sum(axis=1, keepdims=True)
    forward[first] = a
    lives = [live]
    for t in range(1, int(lengths[0]) if live else 0):
        while lengths[live - 1] <= t:
            live -= 1
        lives.append(live)
        at = first[:live] + t
        a = (a[:live] @ move) * local[flat[at]]
        a /= a.sum(axis=1, keepdims=True)
        forward[at] = a
    b = np.empty((0, local.shape[1]))
    for t in range(len(lives) - 1, -1, -1):
        live = lives[t]
        if live > len(b):
            b = np.concatenate([b, np.ones((live - len(b), local.shape[1]))])
        at = first[:live] + t
        forward[at] *= b
        if t:
            b = b * local[flat[at]]
            if pairs is not None:
                # expected neighbours, each word's adding up to one, without a matrix per word
                before = forward[at - 1]
                before = before / ((before @ move) * b).sum(axis=1, keepdims=True)
                pairs += move * (before.T @ b)
            b = b @ move.T
            b /= b.sum(axis=1, keepdims=True)
    forward /= forward.sum(axis=1, keepdims=True)
    return forward


def train(pieces: list[tuple[str, str]], rounds: int = 40, lexicon_count: int = 3, seed: int = 7) -> Model:
    """Fit weights and transitions by gradient steps on the log-likelihood of spliced sequences."""
    languages = sorted({lang for lang, _ in pieces})
    rng = np.random.default_rng(seed)
    spans, label_of = [], {lang: k for k, lang in enumerate(languages)}
    for lang, text in sorted(pieces):
        words = text.lower().encode().split()
        spans += [(label_of[lang], words[i:i + 20]) for i in range(0, len(words), 20)]
    count: dict[bytes, int] = {}
    for _, words in spans:
        for w in words:
            count[w] = count.get(w, 0) + 1
    lexicon = {w: TABLE + i for i, w in enumerate(sorted(w for w, n in count.items() if n >= lexicon_count))}
    model = Model(languages, np.zeros((TABLE + len(lexicon), len(languages))), lexicon,
                  np.zeros((len(languages),) * 2), np.zeros(len(languages)))
    if not spans:
        return model
    # half of the sequences stay in one language, half switch at random
    by_label = [[s for s in spans if s[0] == k] for k in range(len(languages))]
    sequences = []
    for s in spans:
        own = by_label[s[0]] if rng.random() < 0.5 else spans
        sequences.append([s] + [own[rng.integers(len(own))] for _ in range(2)])
    sequences.sort(key=lambda q: -sum(len(w) for _, w in q))
    k_all = len(languages)
    batches = [_Batch(part, lexicon, k_all) for part in _parted(sequences, max(1, CELLS // k_all))]
    size = sum(len(b.flat) for b in batches)
    follow = sum(b.follow for b in batches)
    mean = [np.zeros_like(p) for p in (model.weights, model.transition, model.start)]
    spread = [np.zeros_like(p) for p in mean]
    for step in range(1, rounds + 1):
        # the gradient over all sequences, a bounded number of words at a time
        grads = [np.zeros_like(p) for p in mean]
        for b in batches:
            b.add_gradients(model, grads)
        grads[1] = follow - grads[1]
        for i, (param, g) in enumerate(zip((model.weights, model.transition, model.start), grads)):
            g /= size
            g -= 1e-6 * param
            mean[i] += 0.1 * (g - mean[i])
            spread[i] += 0.001 * (g * g - spread[i])
            np.sqrt(spread[i] / (1 - 0.999 ** step), out=g)
            g += 1e-12
            param += 0.1 * (mean[i] / (1 - 0.9 ** step)) / g
    return model


def _parted(sequences, most):
    """Runs of sequences with at most ``most`` words; a longer sequence makes a run of its own."""
    part, size = [], 0
    for q in sequences:
        n = sum(len(ws) for _, ws in q)
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append(q)
        size += n
    if part:
        yield part


class _Batch:
    """Training sequences, longest first, with the features of their distinct words."""

    def __init__(self, sequences, lexicon, k_all):
        distinct: dict[bytes, int] = {}
        for q in sequences:
            for _, ws in q:
                for w in ws:
                    distinct.setdefault(w, len(distinct))
        words = list(distinct)
        self.n_words = len(words)
        self.flat = np.array([distinct[w] for q in sequences for _, ws in q for w in ws])
        self.label = np.array([k for q in sequences for k, ws in q for _ in ws])
        self.lengths = np.array([sum(len(ws) for _, ws in q) for q in sequences])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        word_at, slot_at = map(np.concatenate, zip(*features(words)))
        known = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
        if known:
            word_at = np.concatenate([word_at, [i for i, _ in known]])
            slot_at = np.concatenate([slot_at, [s for _, s in known]])
        self.word_at, self.slot_at = word_at, slot_at
        inner = np.ones(len(self.flat), bool)
        inner[self.starts] = False
        after = np.flatnonzero(inner)
        self.follow = np.zeros((k_all, k_all))
        np.add.at(self.follow, (self.label[after - 1], self.label[after]), 1)

    def add_gradients(self, model, grads):
        """Add the true less the expected weights and starts, and the expected neighbours."""
        score = _sums(self.word_at, self.slot_at, (np.ascontiguousarray(c) for c in model.weights.T), self.n_words)
        miss = posteriors(score, self.lengths, model, grads[1], self.flat)
        np.negative(miss, out=miss)
        miss[np.arange(len(miss)), self.label] += 1
        grads[2] += miss[self.starts].sum(axis=0)
        for k in range(miss.shape[1]):
            by_word = np.bincount(self.flat, miss[:, k], self.n_words)
            grads[0][:, k] += np.bincount(self.slot_at, by_word[self.word_at], len(model.weights))


def label_texts(texts: Iterable[str | None], model: Model) -> list[tuple[str, float]]:
    """Language and mean word probability of each text; ``und`` for null or a text without a letter."""
    out, rows, ids = [], [], {}
    for t in texts:
        if t and model.languages and any(map(str.isalpha, t)):
            # words are objects for one text at a time; numbers of distinct words stay
            rows.append((len(out), np.array([ids.setdefault(w, len(ids)) for w in t.lower().encode().split()], np.int32)))
        out.append(("und", 0.0))
    if not rows:
        return out
    rows.sort(key=lambda r: -len(r[1]))
    at = [i for i, _ in rows]
    lengths = np.array([len(ws) for _, ws in rows])
    flat = np.concatenate([ws for _, ws in rows])
    del rows
    scores = emissions(list(ids), model)
    del ids
    p = posteriors(scores, lengths, model, flat=flat)
    p[~scores.any(axis=1)[flat]] = 0                # words without letters do not vote
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    total = np.add.reduceat(p, first, axis=0)
    best = total.argmax(axis=1)
    share = total[np.arange(len(at)), best] / np.maximum(total.sum(axis=1), 1e-12)
    for i, k, s in zip(at, best.tolist(), share.tolist()):
        out[i] = model.languages[k], min(1.0, s)
    return out


def training_pieces(docs: DataFrame, lang_col: str, text_col: str, id_col: str, per_language: int, piece_words: int,
                    most_pieces: int) -> DataFrame:
    """``lang, piece``: a seeded sample of about ``per_language`` (never more) labelled rows a language, fewer where
    all languages together would have more than ``most_pieces`` (at least one); from each row at most
    ``piece_words`` words at a seeded place."""
    mark = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("sample"))
    d = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), mark.alias("mark"))
    counts = d.groupBy("lang").agg(F.count("*").alias("n"))
    part = (F.col("mark") / F.lit(float(1 << 63)) + 1) / 2
    # a language's share of the sample: at least one piece, whatever the number of languages
    langs = counts.select(F.count("*")).scalar()
    most = F.greatest(F.least(F.lit(per_language).cast("long"), F.expr(f"{int(most_pieces)}L").cast("double") / F.greatest(langs, F.lit(1))), F.lit(1)).cast("int")
    near = d.join(counts.withColumn("most", most), "lang").filter(part < 1.2 * F.col("most") / F.col("n"))
    words = F.split("text", r"[\x20\x09-\x0D]+")
    at = F.pmod(F.xxhash64("mark"), F.greatest(F.size("words") - piece_words, F.lit(1)).cast("bigint")).cast("int")
    picked = near.withColumn("words", words).select("lang", "most", "mark", F.array_join(F.slice("words", at + 1, piece_words), " ").alias("piece"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("mark", "piece"))
    return picked.withColumn("turn", turn).filter(F.col("turn") <= F.col("most")).select("lang", "piece")


def held_out(id_col: str, folds: int = 5):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = 250, piece_words: int = 120, most_pieces: int = 4000) -> Model:
    """A model from the labelled rows that are not held out: a bounded sample of them, all their languages.

    Rows without text, label or letters teach nothing; a null id counts as the empty one; ties of the sample's marks
    are ordered by the text; an empty table gives a model without languages, which finds ``und``.
    """
    sample = training_pieces(docs.filter(~held_out(id_col)), lang_col, text_col, id_col, per_language, piece_words, most_pieces)
    return train([(r.lang, r.piece) for r in sample.collect()])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = ()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, and the columns named in ``carry`` in the struct ``carried``.

    A null text and one without letters are ``und`` with score 0; of languages with equal probability the first by
    name; a null id counts as the empty one in ``held_out``; very long texts are labelled alone; repeated rows stay;
    other columns are ignored.
    """
    # a text that is carried goes to the task once
    twice = text_col in carry and docs.schema[text_col].dataType.typeName() == "string"
    d = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"),
                    *([] if twice else [F.col(text_col).cast("string").alias("text")]), *([F.struct(*carry).alias("carried")] if carry else []))
    kind = d.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    piece = 4 * PIECE // max(4, len(model.languages))

    def run(batches):
        for b in batches:
            texts = b.column("carried").field(text_col) if twice else b.column("text")
            size, start = 0, 0
            for i, n in enumerate(pc.utf8_length(texts).to_pylist()):
                size += n or 0
                if size > piece or i == len(texts) - 1:
                    # a piece's rows leave before the next piece is read
                    rows = b.slice(start, i + 1 - start)
                    found = label_texts((t.as_py() for t in texts.slice(start, len(rows))), model)
                    columns = [rows.column(0).cast(id_type), rows.column(1), pa.array([f[0] for f in found], pa.string()),
                               pa.array([f[1] for f in found], pa.float64()), *([rows.column("carried")] if carry else [])]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", *(["carried"] if carry else [])])
                    start, size = i + 1, 0
    return d.mapInArrow(run, f"doc_id {kind.simpleString()}, held_out boolean, lang_pred string, score double"
                             + (f", carried {d.schema['carried'].dataType.simpleString()}" if carry else ""))
