"""Brute-force versions of the corpus operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np

KINDS = ("email", "ip", "card", "phone")


def words(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def fold(doc_id, mod):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % mod


# ---- op 1 ------------------------------------------------------------------

def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = [("email", *m.span()) for m in
           re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p[-4300:]) <= 255 and not p[:-4300].strip("0") for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def span_text(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


# ---- op 2 ------------------------------------------------------------------

def kneser_ney(rows):
    """(doc_id, text) -> (doc_id, n_tokens, n_known, train_tokens, base, score)."""
    count, pairs = collections.Counter(), collections.Counter()
    for doc_id, text in rows:
        if doc_id is not None and fold(doc_id, 7) != 2:
            before = "begin"
            for w in [*words(text, True), None]:
                count[w] += 1
                pairs[before, w] += 1
                before = w
    n, v = sum(count.values()), len(count)

    def discounts(values):
        n1, n2, n3, n4 = (sum(1 for x in values if x == k) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [0, 1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0,
             3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
        return [0] + [min(max(x, 0.05), k) for k, x in ((1, d[1]), (2, d[2]), (3, d[3]))]

    types, total, after = collections.Counter(), collections.Counter(), collections.defaultdict(lambda: [0] * 4)
    for (a, w), k in pairs.items():
        types[w] += 1
        total[a] += k
        after[a][min(k, 3)] += 1
    high, low = discounts(pairs.values()), discounts(types.values())
    spare = sum(low[min(k, 3)] for k in types.values()) / len(pairs) if pairs else 1.0
    out = []
    for doc_id, text in rows:
        base = score = 0.0
        known, before = 0, "begin"
        tokens = [*words(text, True), None]
        for w in tokens:
            base += math.log10((count[w] + 1) / (n + v + 1))
            known += count[w] > 0
            p = max(types[w] - low[min(types[w], 3)], 0) / max(len(pairs), 1) + spare / (v + 1)
            if total[before]:
                k = pairs[before, w]
                p = (max(k - high[min(k, 3)], 0) + sum(high[j] * after[before][j] for j in (1, 2, 3)) * p) / total[before]
            score += math.log10(p)
            before = w
        out.append((doc_id, len(tokens), known, n, base, score))
    return out


# ---- op 4 ------------------------------------------------------------------

def remove_windows(texts, size=35):
    """(n_words, n_removed, kept) of each text."""
    cut = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[i:i + size]) for w in cut for i in range(len(w) - size + 1))
    out = []
    for w in cut:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone[i:i + size] = [True] * size
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), len(w) - len(kept), b" ".join(kept).decode()))
    return out


# ---- op 8, 9, 10 -----------------------------------------------------------

def groups(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def least_ids(ids, part):
    low = {}
    for i, p in zip(ids, part):
        if i is not None:
            low[p] = min(low.get(p, i), i)
    return [low.get(p) for p in part]


def vector_links(rows):
    """(id, vector or None, label) -> [(id, n_links, component, kept)]."""
    def usable(v, label):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    links = []
    for i, (_, v, a) in enumerate(rows):
        for j in range(i):
            _, w, b = rows[j]
            if a == b and usable(v, a) and usable(w, b) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if list(v) == list(w) or x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links.append((i, j))
    degree = collections.Counter(k for pair in links for k in pair)
    ids = [r[0] for r in rows]
    low = least_ids(ids, groups(len(rows), links))
    return [(i, degree[k], c, i is not None and i == c) for k, (i, c) in enumerate(zip(ids, low))]


def shingles(text):
    w = words(text, True)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def jaccard_components(rows):
    """(id, text) -> [(id, n_shingles, component)]."""
    sets = [shingles(t) for _, t in rows]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    links = []
    for i, s in enumerate(sets):
        common = collections.Counter(j for x in s for j in holders[x] if j > i)
        links += [(i, j) for j, c in common.items() if 100 * c >= 75 * (len(s) + len(sets[j]) - c)]
    ids = [r[0] for r in rows]
    low = least_ids(ids, groups(len(rows), links))
    return [(i, len(s), c) for i, s, c in zip(ids, sets, low)]


def contained(docs, items):
    """{(doc_id, item_id, n_item, n_shared)} of the contained items."""
    known = [(k, shingles(t)) for k, t in items]
    out = set()
    for doc_id, text in docs:
        own = shingles(text)
        for k, s in known:
            if s and 100 * len(s & own) >= 75 * len(s):
                out.add((doc_id, k, len(s), len(s & own)))
    return out


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
