"""Word hashes of many texts at once, by NumPy over their bytes."""

from __future__ import annotations

from collections.abc import Iterator


def text_chunks(texts: list[bytes], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges (from, to) of texts of about limit bytes together; a longer text is a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]):
    """(hashes uint64, owner int64): words of all texts in order, and the text each is of.

    A word is a run of ASCII digits and letters (A-Z lower-cased) and non-ASCII bytes. Its
    hash is a polynomial in its bytes modulo 2**64: powers rise along the whole buffer and
    are divided out at each word's start, so one pass serves all words.
    """
    import numpy as np

    fold = np.zeros(256, dtype=np.uint64)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        if 48 <= low <= 57 or 97 <= low <= 122 or low >= 128:
            fold[b] = low
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    value = fold[buf]
    inside = value > 0
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    base = 0x9E3779B97F4A7C15
    power = np.full(len(buf), base, dtype=np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    value *= power
    inverse = np.full(len(buf), pow(base, -1, 1 << 64), dtype=np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    h = np.add.reduceat(value, starts) * inverse[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.searchsorted(ends, starts, side="right")


def gram_features(h, owner, bits: int):
    """(feature, owner) of unigrams, bigrams and skip-grams (one word left out) within a text, in `bits` bits."""
    import numpy as np

    shift = np.uint64(64 - bits)

    def mixed(a, b, salt):
        x = (a * np.uint64(0x9FB21C651E98DF25) + b) ^ np.uint64(salt)
        x ^= x >> np.uint64(28)
        return (x * np.uint64(0x94D049BB133111EB)) >> shift

    feats, owners = [h * np.uint64(0xD6E8FEB86659FD93) >> shift], [owner]
    for gap, salt in ((1, 0x1234567), (2, 0x89ABCDE)):
        if len(h) > gap:
            same = owner[gap:] == owner[:-gap]
            feats.append(mixed(h[:-gap], h[gap:], salt)[same])
            owners.append(owner[gap:][same])
    return np.concatenate(feats).astype(np.int64), np.concatenate(owners)
