"""Language ID: a linear-chain conditional random field over the words of a text.

Every word is labelled with a language. Its features are the character trigrams within it
(with its edges), its first and last three characters and, for words of a learned lexicon,
the word itself; all are hashed to slots with one weight per language. Learned transitions
between neighbouring words let code-switched texts change language, and forward-backward
gives each word's posterior. A text's language is the one with the largest mean posterior.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_binary, sample_texts, smaller
from .hashing import text_chunks

UNKNOWN = "und"
SLOT_BITS = 17
LEXICON_BITS = 16


@dataclass(frozen=True)
class LanguageModel:
    """Learned labels in order; row of each slot in the weights (row 0: none), transitions, start scores and lexicon (None without labels)."""

    labels: tuple[str, ...]
    rows: object = None
    weights: object = None
    moves: object = None
    start: object = None
    lexicon: object = None

    def arrays(self) -> tuple:
        """The model as plain values: what is sent along must not need this class on the executors."""
        return self.labels, self.rows, self.weights, self.moves, self.start, self.lexicon


def word_slots(texts: list[bytes]):
    """Features of all words of the texts.

    Gives (grams, first, prefix, suffix, word, owner): trigram slots of all word bytes in
    order, where each word's begin, one prefix and one suffix slot and a 64-bit hash per
    word, and the text that it is of. Words are runs of ASCII letters (A-Z lower-cased) and
    non-ASCII bytes.
    """
    import numpy as np

    fold = np.zeros(256, dtype=np.uint32)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        if 97 <= low <= 122 or low >= 128:
            fold[b] = low
    buf = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n\n\n", dtype=np.uint8)
    v = fold[buf]
    inside = v > 0
    at = np.flatnonzero(inside)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none
    mix, shift = np.uint32(0x9E3779B1), np.uint32(32 - SLOT_BITS)
    tri = v[:-2] << np.uint32(16)
    tri |= v[1:-1] << np.uint32(8)
    tri |= v[2:]
    grams = (tri[at - 1] * mix) >> shift
    start = at[~inside[at - 1]]
    end = at[~inside[at + 1]]
    size = end - start + 1
    first = np.searchsorted(at, start)

    def affix(a, b, c, salt):
        x = a << np.uint32(16) | np.where(size > 1, b, 0).astype(np.uint32) << np.uint32(8) | np.where(size > 2, c, 0).astype(np.uint32)
        return (((x ^ np.uint32(salt << 24)) * np.uint32(0x85EBCA6B)) ^ (x >> np.uint32(7))) * mix >> shift

    prefix = affix(v[start], v[start + 1], v[start + 2], 1)
    suffix = affix(v[end], v[end - 1], v[np.maximum(end - 2, 0)], 2)
    # Sums of position-weighted bytes tell words of a lexicon apart well enough: order counts by the trigram mixed in.
    salted = (grams.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    salted ^= salted >> np.uint64(31)
    word = np.add.reduceat(salted * np.uint64(0x94D049BB133111EB), first)
    word ^= size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(ends, start - 1, side="right")
    return grams.astype(np.int64), first, prefix.astype(np.int64), suffix.astype(np.int64), word, owner


def lexicon_slots(word, lexicon):
    """Slot of each word in the lexicon table, or -1."""
    import numpy as np

    at = (word >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)
    return np.where(lexicon[at] == word, at, -1)


def emissions(slots, rows, weights, lexicon):
    """Scores (words x labels) of all words."""
    import numpy as np

    grams, first, prefix, suffix, word, _ = slots
    lex = lexicon_slots(word, lexicon)
    grams, prefix, suffix = rows[grams], rows[prefix], rows[suffix]
    known = np.where(lex >= 0, rows[(1 << SLOT_BITS) + np.maximum(lex, 0)], 0)
    out = np.empty((len(first), weights.shape[1]))
    for k in range(weights.shape[1]):
        w = np.ascontiguousarray(weights[:, k])
        out[:, k] = np.add.reduceat(w[grams], first) if len(first) else 0
        out[:, k] += w[prefix] + w[suffix] + w[known]
    return out


def forward_backward(scores, fresh, moves, start, pairs: bool = False, block: int = 128):
    """Posteriors (words x labels) of a chain; fresh marks words that begin a text.

    The chain is cut into blocks that are worked on side by side: first the product of
    the steps of each block, then the messages at the blocks' edges, then forward and
    backward messages inside. A word that begins a text forgets what came before. With
    pairs, also the expected number of moves between labels, and of starts.
    """
    import numpy as np

    n, width = scores.shape
    block = max(block, -(-n * width * width >> 23))  # products of many labels' steps stay within bounded memory
    count = -(-n // block)
    e = np.ones((count * block, width))
    e[:n] = np.exp(np.clip(scores - scores.max(axis=1, keepdims=True), -60, 0))
    reset = np.zeros(count * block, dtype=bool)
    reset[:n] = fresh
    reset[n:] = True
    reset[:1] = True
    e, reset = e.reshape(count, block, width), reset.reshape(count, block)
    move, begin = np.exp(moves), np.exp(start)
    resets = [np.flatnonzero(reset[:, b]) for b in range(block)]
    product = np.broadcast_to(np.eye(width), (count, width, width)).copy()
    for b in range(block):
        nxt = (product.reshape(-1, width) @ move).reshape(count, width, width)
        r = resets[b]
        nxt[r] = product[r].sum(axis=2, keepdims=True) * begin
        nxt *= e[:, b, None, :]
        product = nxt / nxt.max(axis=(1, 2), keepdims=True)
    into, back = np.empty((count, width)), np.empty((count, width))
    a, z = np.full(width, 1 / width), np.ones(width)
    for k in range(count):
        into[k] = a
        a = a @ product[k]
        a = a / a.sum()
    for k in range(count - 1, -1, -1):
        back[k] = z
        z = product[k] @ z
        z = z / z.max()
    alpha, beta = np.empty((block, count, width)), np.empty((block, count, width))
    a = into
    for b in range(block):
        nxt = a @ move
        r = resets[b]
        nxt[r] = begin
        nxt *= e[:, b]
        a = alpha[b] = nxt / nxt.sum(axis=1, keepdims=True)
    z = back
    for b in range(block - 1, -1, -1):
        beta[b] = z
        nxt = (e[:, b] * z) @ move.T
        nxt[resets[b]] = 1
        z = nxt / nxt.max(axis=1, keepdims=True)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    post = post.transpose(1, 0, 2).reshape(-1, width)[:n]
    if not pairs:
        return post
    alpha, beta = alpha.transpose(1, 0, 2).reshape(-1, width)[:n], beta.transpose(1, 0, 2).reshape(-1, width)[:n]
    xi = alpha[:-1, :, None] * move * (e.reshape(-1, width)[1:n] * beta[1:])[:, None, :]
    xi = xi[~fresh[1:]]
    xi /= xi.sum(axis=(1, 2), keepdims=True)
    return post, xi.sum(axis=0), post[np.r_[True, fresh[1:]]].sum(axis=0)


def fit(texts: list[bytes], langs: list[str], labels: tuple[str, ...], epochs: int, min_count: int, chunk: int, rate: float, decay: float):
    """Weights of the field by full-batch Adam on the conditional likelihood; None if no text has a word.

    Training chains are made of runs of about `chunk` words from the labelled texts, dealt
    in a fixed random order, so that learned transitions know of changes between languages.
    """
    import numpy as np

    grams, first, prefix, suffix, word, owner = word_slots(texts)
    n, width, base = len(first), len(labels), 1 << SLOT_BITS
    if not n:
        return None
    number = {x: k for k, x in enumerate(labels)}
    y = np.array([number[x] for x in langs])[owner]
    known, times = np.unique(word, return_counts=True)
    order = np.argsort(times, kind="stable")
    frequent = known[order][times[order] >= min_count]
    lexicon = np.zeros(1 << LEXICON_BITS, dtype=np.uint64)
    lexicon[(frequent >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)] = frequent
    rng = np.random.default_rng(1)
    piece = np.cumsum(np.r_[False, (owner[1:] != owner[:-1]) | (rng.random(n - 1) < 1 / chunk)])
    place = rng.permutation(piece[-1] + 1)
    chain = np.argsort(place[piece], kind="stable")
    fresh = np.r_[True, (np.diff(place[piece][chain]) != 0) & (place[piece][chain][1:] % 8 == 0)]
    sizes = np.diff(np.r_[first, len(grams)])
    gram_word = np.repeat(np.arange(n), sizes)
    lex = lexicon_slots(word, lexicon)
    has = np.flatnonzero(lex >= 0)
    slot = np.concatenate([grams, prefix, suffix, base + lex[has]])
    of = np.concatenate([gram_word, np.arange(n), np.arange(n), has])
    used, slot = np.unique(slot, return_inverse=True)
    truth = np.eye(width)[y]
    seen_moves = np.zeros((width, width))
    yc = y[chain]
    np.add.at(seen_moves, (yc[:-1][~fresh[1:]], yc[1:][~fresh[1:]]), 1)
    seen_start = np.bincount(yc[fresh], minlength=width)
    theta = [np.zeros((len(used), width)), np.zeros((width, width)), np.zeros(width)]
    m1, m2 = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    back = np.empty(n, dtype=np.int64)
    back[chain] = np.arange(n)
    for step in range(1, epochs + 1):
        scores = np.stack([np.bincount(of, weights=theta[0][slot, k], minlength=n) for k in range(width)], axis=1)
        post, moved, started = forward_backward(scores[chain], fresh, theta[1], theta[2], pairs=True)
        miss = truth - post[back]
        grads = [
            np.stack([np.bincount(slot, weights=miss[of, k], minlength=len(used)) for k in range(width)], axis=1) / n - decay * theta[0],
            (seen_moves - moved) / n, (seen_start - started) / n,
        ]
        for t, g, a, b in zip(theta, grads, m1, m2):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            t += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    rows = np.zeros(base + (1 << LEXICON_BITS), dtype=np.int32)
    rows[used] = np.arange(1, len(used) + 1)
    weights = np.concatenate([np.zeros((1, width)), theta[0]]).astype(np.float32)
    return rows, weights, theta[1], theta[2], lexicon


def train_language_model(
    docs: DataFrame, max_rows: int = 120, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    epochs: int = 30, min_count: int = 5, chunk: int = 30, rate: float = 0.1, decay: float = 1e-7, long_text: int = 1 << 17,
) -> LanguageModel:
    """Fit on at most max_rows labelled texts per language, chosen by a hash of the id, one row per id.

    Labels are the non-null values of lang_col, however many; weights grow with their number.
    Texts of more than long_text characters are chosen only where a language has too few
    others. The sample's size depends on neither table nor skew; it is learned in one task.
    Without labels, or if no chosen text has a letter, nothing is learned.
    """
    import numpy as np

    known = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    sample = sample_texts(known, max_rows, long_text)
    def learn(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["l", "i", "t"])
        labels = tuple(sorted(set(pdf["l"])))
        got = fit([t.encode() for t in pdf["t"]], pdf["l"].tolist(), labels, epochs, min_count, chunk, rate, decay)
        parts = {"labels": json.dumps(labels if got else []).encode()} | {name: x.tobytes() for name, x in zip(["rows", "weights", "moves", "start", "lexicon"], got or ())}
        return pd.DataFrame({"name": list(parts), "body": list(parts.values())})

    got = {r["name"]: r["body"] for r in sample.groupBy(F.lit(1).alias("one")).applyInPandas(learn, "name string, body binary").collect()}
    labels = tuple(json.loads(got["labels"])) if got else ()
    if not labels:
        return LanguageModel(())
    k = len(labels)
    return LanguageModel(
        labels, np.frombuffer(got["rows"], np.int32), np.frombuffer(got["weights"], np.float32).reshape(-1, k), np.frombuffer(got["moves"]).reshape(k, k), np.frombuffer(got["start"]), np.frombuffer(got["lexicon"], np.uint64)
    )


def word_posteriors(bodies: list[bytes], model: tuple) -> Iterator[tuple]:
    """(from, to, owner, posteriors) of ranges of texts: the text each word is of, and its posterior by label."""
    import numpy as np

    labels, rows, weights, moves, start, lexicon = model
    for lo, hi in text_chunks(bodies, max(1 << 14, (1 << 25) // max(64, len(labels) ** 2))) if labels else ():
        slots = word_slots(bodies[lo:hi])
        owner = slots[-1]
        if len(owner):
            fresh_ = np.r_[True, owner[1:] != owner[:-1]]
            yield lo, hi, owner, forward_backward(emissions(slots, rows, weights, lexicon), fresh_, moves, start)


def label_texts(bodies: list[bytes], model: tuple):
    """(label index or -1, mean posterior) of each text."""
    import numpy as np

    pred, score = np.full(len(bodies), -1), np.zeros(len(bodies))
    for lo, hi, owner, post in word_posteriors(bodies, model):
        words = np.bincount(owner, minlength=hi - lo)
        mean = np.stack([np.bincount(owner, weights=p, minlength=hi - lo) for p in post.T], axis=1) / np.maximum(words, 1)[:, None]
        pred[lo:hi] = np.where(words > 0, mean.argmax(axis=1), -1)
        score[lo:hi] = np.where(words > 0, np.clip(mean.max(axis=1), 0, 1), 0)
    for i in np.flatnonzero(pred >= 0):
        # Non-ASCII bytes are word characters above; a text of symbols alone still has no letter.
        if not bodies[i].isascii() and not any(c.isalpha() for c in bodies[i].decode()):
            pred[i], score[i] = -1, 0.0
    return pred, score


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred and score (mean posterior of that language over the words).

    Null texts and texts without a letter are `und` with score 0, as is everything where no
    label could be learned. Ties go to the first label in order. Repeated rows are labelled
    each. An empty table gives no rows. Other columns are not read. Narrow: no shuffle; the
    model sent along has a bounded size per label.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.arrays())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = sent.value[0]
        for b in smaller(batches):
            pred, score = label_texts(b.column(1).to_pylist(), sent.value)
            names = [labels[k] if k >= 0 else UNKNOWN for k in pred]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return map_binary(docs, id_col, text_col, run, "doc_id long, lang_pred string, score double")


def language_segments(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Code-switched text: (doc_id, first_word, n_words, lang, score) of every run of words of one language.

    Words (runs of letters) are numbered from 0 in each text; a word's language is the one of
    its largest posterior, ties to the first label in order, and score is the run's mean
    posterior. Texts without a word, and all texts where nothing was learned, give no rows;
    repeated rows give theirs each. Other columns are not read. Narrow: no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.arrays())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names = np.array(sent.value[0], dtype=object)
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, _, owner, post in word_posteriors(b.column(1).to_pylist(), sent.value):
                best = post.argmax(axis=1)
                text = np.r_[True, owner[1:] != owner[:-1]]
                new = np.flatnonzero(text | np.r_[True, best[1:] != best[:-1]])
                size = np.diff(np.r_[new, len(best)])
                begin = np.maximum.accumulate(np.where(text, np.arange(len(best)), 0))[new]
                mean = np.add.reduceat(post.max(axis=1), new) / size
                cols = [pa.array([ids[lo + k] for k in owner[new]], pa.int64()), pa.array(new - begin), pa.array(size), pa.array(names[best[new]], pa.string()), pa.array(mean)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "first_word", "n_words", "lang", "score"])

    return map_binary(docs, id_col, text_col, run, "doc_id long, first_word long, n_words long, lang string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float, text_col: str = "text") -> DataFrame:
    """docs, all columns, whatever their names, without the rows that are `und` or below min_score.

    Null texts and texts without a letter are `und` and go, as does every row where nothing
    was learned. Repeated rows stay or go together. An empty table stays empty. Narrow: no
    shuffle.
    """
    from pyspark.sql.types import BooleanType, StructType

    sent = docs.sparkSession.sparkContext.broadcast(model.arrays())
    keep = fresh(docs, "keep")[0]
    schema = StructType([*docs.schema.fields]).add(keep, BooleanType())
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in smaller(batches):
            pred, score = label_texts([(t or "").encode() for t in b.column(at).to_pylist()], sent.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((pred >= 0) & (score >= min_score))], names=[*b.schema.names, keep])

    return docs.mapInArrow(run, schema).where(F.col(keep)).drop(keep)
