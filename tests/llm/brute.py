"""Plain single-process versions of the operators' contracts, for tests."""

import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import xxhash

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shards(rows, n_shards, overhead=16):
    """rows: (id, text). Returns capacity and {text or None: shard}."""
    groups = {}
    for i, t in rows:
        first, size, n = groups.get(t, (i, 0, 0))
        groups[t] = (min(first, i), size + len((t or "").encode()) + overhead, n + 1)
    order = sorted(groups, key=lambda t: groups[t][0])

    def cut(capacity):
        out, at, shard = {}, 0, 0
        for t in order:
            size = groups[t][1]
            if size > capacity:
                return None
            if at + size > capacity:
                shard, at = shard + 1, 0
            at += size
            out[t] = shard
        return out if shard < n_shards else None

    low, high = 0, sum(g[1] for g in groups.values())
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if cut(mid) is not None else (mid, high)
    return high, cut(high) or {}


def simhash(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) else 0.0


def near_texts(rows, radius=2):
    """rows: (id, text). {id: (fingerprint, component)}."""
    prints = {i: simhash(t) for i, t in rows}
    by = defaultdict(list)
    for i, f in prints.items():
        by[f].append(i)
    keys = list(by)
    edges = [(by[f][0], i) for f in keys for i in by[f][1:]]
    edges += [(by[f][0], by[g][0]) for a, f in enumerate(keys) for g in keys[a + 1 :] if (f ^ g).bit_count() <= radius]
    of = components(prints, edges)
    return {i: (prints[i], of[i]) for i in prints}


def url_parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return (m[1].translate(UP), m[2]) if m else ("", "")


def url_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def url_ratios(urls, labels, order=5, strength=2.0):
    """Ratio of each URL without a label, by plain counts in dictionaries; labels: 1, 0 or None."""
    held = [a is not None and crc(u) % 5 == 0 for u, a in zip(urls, labels, strict=True)]

    def grams(u):
        line = [-1] * order + list((u or "").encode()) + [-2]
        for i in range(order, len(line)):
            yield [(tuple(line[i - k : i]), line[i]) for k in range(order + 1)]

    seen = [defaultdict(int), defaultdict(int)]
    for u, a, h in zip(urls, labels, held, strict=True):
        if a is not None and not h:
            for place in grams(u):
                for context, byte in place:
                    seen[a][context] += 1
                    seen[a][context, byte] += 1

    def mean(u, c):
        total, n = 0.0, 0
        for place in grams(u):
            p = 1 / 256
            for context, byte in place:
                p = (seen[c].get((context, byte), 0) + strength * p) / (seen[c].get(context, 0) + strength)
            total, n = total + np.log(p), n + 1
        return total / n

    ratios = [mean(u, 1) - mean(u, 0) for u in urls]
    rows = [(min(1000, max(-1000, int(np.floor(r * 100)))), a) for r, a, h in zip(ratios, labels, held, strict=True) if h]
    bad, good = [b for b, a in rows if not a], [b for b, a in rows if a]
    cut = 0.0
    if bad and good:
        right = {c: round(sum(b < c for b in bad) / len(bad) + sum(b >= c for b in good) / len(good), 10) for c in range(-1000, 1002)}
        cut = min((c for c in right if right[c] == max(right.values())), key=lambda c: (abs(c), c)) / 100
    return [None if a is not None else r - cut for r, a in zip(ratios, labels, strict=True)]


def pfair(shares, frame):
    """Slots of one frame by earliest deadline first over released blocks."""
    done, out = [0] * len(shares), []
    for t in range(frame):
        ready = [(-(-(d + 1) * frame // a), i) for i, (d, a) in enumerate(zip(done, shares, strict=True)) if d < a and d * frame // a <= t]
        _, i = min(ready)
        done[i] += 1
        out.append(i)
    return out


def deviation(picks, shares, frame):
    """Largest distance of any source from its ideal number at any slot."""
    done, worst = [0] * len(shares), Fraction(0)
    for t, i in enumerate(picks, 1):
        done[i] += 1
        worst = max([worst, *(abs(Fraction(a * t, frame) - d) for d, a in zip(done, shares, strict=True))])
    return worst


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def license_places(text, phrases):
    ws = license_words(text)
    out = []
    for label, phrase in phrases:
        p = phrase.split(" ")
        out += [(label, i) for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
    return sorted(out)


def license_matches(text, templates, threshold):
    """(label, template, word, containment) of every block of a template's length, from its definition; of overlapping ones those that none beats."""
    ws, out = license_words(text), []
    for k, (label, t, keys) in enumerate(templates):
        own, wide = set(license_words(t)), len(license_words(t))
        found = []
        for at in range(len(ws)):
            block = set(ws[at : at + wide])
            if ws[at] in own and set(license_words(keys)) <= block and len(own & block) / len(own) >= threshold - 1e-9:
                found.append((at, len(own & block) / len(own)))
        out += [(label, k, a, c) for a, c in found if not any(abs(a - b) < wide and (d > c or (d == c and b < a)) for b, d in found)]
    return sorted(out)


def near_vectors(rows, threshold):
    """rows: (id, vector). {id: (links, component)}."""
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    ids = [i for i, _ in ok]
    edges, links = [], defaultdict(int)
    for d in {len(v) for _, v in ok}:
        some = [(i, v / np.linalg.norm(v)) for i, v in ok if len(v) == d]
        x = np.stack([v for _, v in some])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1)), strict=True):
            edges.append((some[a][0], some[b][0]))
            links[some[a][0]] += 1
            links[some[b][0]] += 1
    of = components([i for i, _ in rows], edges)
    assert len(set(ids)) == len(ids)
    return {i: (links[i], of[i]) for i, _ in rows}


def nearest(rows, k, is_query):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    out = {}
    for q, v in ok:
        if is_query(q):
            scores = (x * v).sum(1)
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:k]
            out[q] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def crc(text):
    return zlib.crc32(text.encode())
