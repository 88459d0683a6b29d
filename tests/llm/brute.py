"""Plain-Python versions of the operators' definitions, for small fixtures."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return frozenset()
    return frozenset(" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def near_documents(docs):
    """docs: {id: text}; {id: (n_shingles, component, kept)}"""
    sets = {d: shingle_set(t) for d, t in docs.items()}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = components(ids, links)
    return {d: (len(sets[d]), comp[d], comp[d] == d) for d in ids}


def without_repeats(docs, length):
    """docs: list of (id, text); {id: (n_bytes, spans, kept bytes)} of the last such row"""
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i:i + length] for _, b in data for i in range(len(b) - length + 1))
    out = {}
    for d, b in data:
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                hit[i:i + length] = b"\1" * length
        spans, start = [], None
        for i in range(len(b) + 1):
            on = i < len(b) and hit[i]
            if on and start is None:
                start = i
            if not on and start is not None:
                spans.append((start, i))
                start = None
        out[d] = (len(b), spans, bytes(x for x, h in zip(b, hit) if not h))
    return out


def benchmark_hits(docs, items, window=13):
    """{id: (n_words, n_hit, sorted item ids)}"""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(lambda: defaultdict(set))
    for i, t in items:
        w = pattern.findall(lower(t))
        if w:
            m = min(window, len(w))
            for k in range(len(w) - m + 1):
                wins[m][tuple(w[k:k + m])].add(str(i))
    out = {}
    for d, t in docs:
        w = pattern.findall(lower(t))
        hit, found = set(), set()
        for m, known in wins.items():
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in known:
                    hit.update(range(k, k + m))
                    found |= known[tuple(w[k:k + m])]
        out[d] = (len(w), len(hit), sorted(found))
    return out


def line_words(line):
    return [w for w in re.split(r"[ \t\r]+", line.lower()) if w]


def simhash(words):
    words = set(words)
    count = [0] * 64
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=42)
        for b in range(64):
            count[b] += (h >> b) & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(words))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def deduped_lines(docs, similarity=0.9, min_words=5):
    """docs: {id: text}; {id: text left}"""
    where = defaultdict(list)
    for d, t in docs.items():
        for i, line in enumerate((t or "").split("\n")):
            w = line_words(line)
            if len(w) >= min_words:
                where[" ".join(w)].append((d, i))
    lines = sorted(where)
    sims = [simhash(x.split(" ")) for x in lines]
    links = []
    for i, x in enumerate(lines):
        for j in range(i + 1, len(lines)):
            if (sims[i] ^ sims[j]).bit_count() <= 3:
                y = lines[j]
                if edit_distance(x, y) <= math.floor(max(len(x), len(y)) * (1 - similarity) + 1e-9):
                    links.append((i, j))
    groups = defaultdict(list)
    for i, c in components(range(len(lines)), links).items():
        groups[c] += where[lines[i]]
    gone = {x for g in groups.values() for x in g if x != min(g)}
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)
            for d, t in docs.items()}


def near_vectors(rows, cosine=0.95):
    """rows: list of (id, vector); {id: (n_links, component, kept)}"""
    ok = {i: np.array(v, float) for i, v in rows
          if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    ids = sorted(unit)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:]
             if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    comp = components([i for i, _ in rows], links)
    count = Counter(x for p in links for x in p)
    return {i: (count[i], comp[i], comp[i] == i) for i, _ in rows}


def word_scores(docs):
    """docs: {id: text}; {id: (held_out, n_tokens, n_known, train_tokens, base)}"""
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None] for d, t in docs.items()}
    count = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(count.values()), len(count)
    return {d: (held[d], len(ws), sum(count[w] > 0 for w in ws), n,
                sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for d, ws in tokens.items()}


def tree_scores(docs, depth):
    """Context-tree weighting node by node; {id: log10 probability}"""
    def decisions(text):
        b = b"\xfe" * depth + lower(text).encode() + b"\xff"
        for i in range(depth, len(b)):
            for k in range(8):
                yield b[i - depth:i][::-1], (1 << k) | (b[i] >> (8 - k)), (b[i] >> (7 - k)) & 1

    def kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    counts = defaultdict(lambda: [0, 0])
    for d, t in docs.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            for ctx, node, bit in decisions(t):
                for k in range(depth + 1):
                    counts[ctx[:k], node][bit] += 1
    children = defaultdict(list)
    for ctx, node in counts:
        if ctx:
            children[ctx[:-1], node].append((ctx, node))
    log_pw, weight = {}, {}
    for key in sorted(counts, key=lambda x: -len(x[0])):
        own = kt(*counts[key])
        log_pw[key], weight[key] = own, 1.0
        if len(key[0]) < depth:
            below = sum(log_pw[c] for c in children[key])
            log_pw[key] = float(np.logaddexp(own, below)) - math.log(2)
            weight[key] = math.exp(own - math.log(2) - log_pw[key])
    out = {}
    for d, t in docs.items():
        total = 0.0
        for ctx, node, bit in decisions(t):
            mass, rest, p = 0.0, 1.0, 0.5
            for k in range(depth + 1):
                key = ctx[:k], node
                if key not in log_pw:
                    break
                a, b = counts[key]
                q = (b + .5) / (a + b + 1)
                p = mass + rest * q
                mass, rest = mass + rest * weight[key] * q, rest * (1 - weight[key])
            total += math.log10(p if bit else 1 - p)
        out[d] = total
    return out


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
