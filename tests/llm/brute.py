"""Plain versions of the operators, for small tables."""

import hashlib
import re

from lorekeep.llm.chunk_dedup import GEAR, MASK, MAX_CHUNK, MIN_CHUNK


def in_order(rows):
    """Rows (doc_id, text) by doc_id, null last, then text, null first."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))


def repeats(rows, width=100):
    """(doc_id, bytes, mask of removed bytes) of rows in order."""
    seen, out = set(), []
    for doc, text in in_order(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            if w in seen:
                gone[k : k + width] = b"\1" * width
            seen.add(w)
        out.append((doc, b, bytes(gone)))
    return out


def op6(rows):
    out = []
    for doc, b, gone in repeats(rows):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def op10(rows):
    seen, out = set(), []
    for doc, text in in_order(rows):
        b, h, at, n, m, size, kept = (text or "").encode(), 0, 0, 0, 0, 0, b""
        for k, c in enumerate(b):
            h = ((h << 1) + int(GEAR[c])) & 0xFFFFFFFF
            length = k + 1 - at
            if (length >= MIN_CHUNK and not h & int(MASK)) or length == MAX_CHUNK or k + 1 == len(b):
                chunk, at, n = b[at : k + 1], k + 1, n + 1
                if len(chunk) >= MIN_CHUNK and chunk in seen:
                    m, size = m + 1, size + len(chunk)
                else:
                    kept += chunk
                    if len(chunk) >= MIN_CHUNK:
                        seen.add(chunk)
        out.append((doc, len(b), n, m, size, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def shingle_set(text, n=5):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def op8(rows):
    rows = in_order(rows)
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(((rows[i][0], len(sets[i]), rows[find(i)][0]) for i in range(len(rows))), key=repr)


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(text, items, width=10):
    w = bench_words(text)
    for item in items:
        x = bench_words(item)
        k = min(width, len(x))
        wins = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if k else set()
        if any(tuple(w[i : i + k]) in wins for i in range(len(w) - k + 1)):
            return True
    return False
