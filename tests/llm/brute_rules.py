"""Plain versions of the quality rules, of whitening and of spelling variants."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def grams(text, buckets=1 << 16):
    """Buckets of a text's words and pairs of words."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in WORD.findall(text or "")]
    pair = lambda a, b: xxhash.xxh64(b.to_bytes(8, "little"), seed=xxhash.xxh64(a.to_bytes(8, "little"), seed=42).intdigest()).intdigest()
    return [signed(x) % buckets for x in h] + [signed(pair(a, b)) % buckets for a, b in zip(h, h[1:])]


def op11(rows, trusted, prior=65_536, threshold=-0.2):
    """rows (doc_id, text), trusted a set of ids."""
    raw, target = Counter(), Counter()
    for doc, text in rows:
        raw.update(grams(text))
        if doc in trusted:
            target.update(grams(text))
    total, own = sum(raw.values()), sum(target.values())
    weight = {b: round(1e6 * math.log((target[b] * (total / n) + prior) / (own + prior))) for b, n in raw.items()}
    out = []
    for doc, text in rows:
        found, g = base(text), grams(text)
        s = sum(weight[b] for b in g)
        out.append((doc, *found, s / len(g) / 1e6 if g else 0.0, not found[5] and s >= threshold * 1e6 * len(g)))
    return out


def op12(rows, k=4):
    """{(vec_id, component): [(n, deviation, |whitened|, explained)]} of rows (vec_id, vector), all of one length."""
    fine = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in fine})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([s / n for s in sums])
    y = np.array(fit, float) - mean
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = defaultdict(list)
    for i, x in fine:
        w = (np.array(x) - mean) @ u / np.sqrt(e)
        for c in range(k):
            out[i, c + 1].append((n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), abs(w[c]), e[c] / np.trace(v)))
    return out


def vocabulary(rows):
    counts = Counter()
    for doc, text in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = re.sub("[A-Z]", lambda m: m[0].lower(), r)
            h = zlib.crc32(f"{'' if doc is None else doc}:{r}".encode())
            if h % 31 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            counts[r] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def op13(rows):
    words = vocabulary(rows)
    shorter, near = defaultdict(set), {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            shorter[w[:i] + w[i + 1 :]].add(w)
            shorter[w[:i], w[i + 1 :]].add(w)
    for key, group in shorter.items():
        for a in group:
            if isinstance(key, tuple):
                near[a] |= {b for b in group if b != a}
            elif key in words:
                near[a].add(key)
                near[key].add(a)
    form = {}
    for w, n in words.items():
        if near[w]:
            b = min(near[w], key=lambda x: (-words[x], x))
            if words[b] >= 10 * n:
                form[w] = b
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=repr)
