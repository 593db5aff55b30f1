"""Plain Python forms of the operators' contracts."""

from __future__ import annotations

import hashlib
import math
import re
import string
import zlib
from collections import Counter, defaultdict

import xxhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[(t or "").translate(LOWER)].append(i)
    return [(i, max(g := groups[n]), len(g), i == max(g), sha(n))
            for i, t in docs for n in [(t or "").translate(LOWER)]]


def sizes(docs):
    return {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs}


def shingles(text, k):
    words = BLANKS.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def near(docs, k=3, per_cent=85):
    sets = [shingles(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = defaultdict(int)
    for h in holders.values():
        for a in range(len(h)):
            for b in range(a):
                shared[h[b], h[a]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= per_cent * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = root(i)
        least[r] = d if r not in least else min((x for x in (least[r], d) if x is not None), default=None)
    return [(d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(docs)]


def decontaminate(docs, items, window=10):
    wanted = defaultdict(set)
    for i, t in items:
        words = ALNUM.findall((t or "").translate(LOWER))
        n = min(window, len(words))
        for a in range(len(words) - n + 1 if n else 0):
            wanted[tuple(words[a : a + n])].add("" if i is None else str(i))
    lengths = {len(w) for w in wanted}
    out = []
    for i, t in docs:
        words = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for a in range(len(words) - n + 1):
                who = wanted.get(tuple(words[a : a + n]))
                if who:
                    hit.update(range(a, a + n))
                    found |= who
        out.append((i, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def judge(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = raw.translate(LOWER), re.match(r"[^?#]*", rest[len(raw):])[0]
    best = None
    for rule_host, rule_path, action in rules:
        if rule_host and (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            best = max(best or (0,), (len(rule_host + rule_path), len(rule_host), rule_host + rule_path, action))
    return host, path, best and best[2], best[3] if best else default


def repeats(docs, window=20):
    first = {}
    cut = [BLANKS.findall(t or "") for _, t in docs]
    low = [(i is not None, i or 0) for i, _ in docs]
    for i, words in zip(low, cut, strict=True):
        for a in range(len(words) - window + 1):
            w, at = tuple(words[a : a + window]), (i, a)
            first[w] = min(first.get(w, at), at)
    out = []
    for (i, _), o, words in zip(docs, low, cut, strict=True):
        gone = set()
        for a in range(len(words) - window + 1):
            if first[tuple(words[a : a + window])] < (o, a):
                gone.update(range(a, a + window))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((i, len(words), len(gone), sha(" ".join(kept))))
    return out


PIECES = re.compile(r"[.,;:!?\x0A-\x0D]")
PIECE_WORDS = re.compile(r"[^\x20\x09]+")


def collocate(docs, top, least, longest=5):
    """(lang, text) rows -> ranked phrases of each language."""
    counts, totals = defaultdict(int), defaultdict(int)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in PIECES.split((text or "").translate(LOWER)):
            words = PIECE_WORDS.findall(piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    often = {p: f for p, f in counts.items() if f >= least and len(p[1]) > 1}
    gone = {(lang, part) for (lang, p), f in often.items()
            for size in range(2, len(p)) for i in range(len(p) - size + 1)
            for part in [p[i : i + size]] if f >= counts[lang, part]}
    out, by_lang = [], defaultdict(list)
    for (lang, p), a in often.items():
        if (lang, p) in gone:
            continue
        n, cuts = totals[lang], []
        for k in range(1, len(p)):
            left, right = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((1000 * a * n // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        by_lang[lang].append((-score, -a, " ".join(p).encode(), left, right, n))
    for lang, rows in by_lang.items():
        for rank, (score, a, p, left, right, n) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return out


def ranked(docs, items, k=50):
    """(item, rank, doc, score) for distinct ids; null document ids last."""
    cut = [(i, ALNUM.findall((t or "").translate(LOWER))) for i, t in docs]
    cut = [(i, w) for i, w in cut if w]
    total = sum(len(w) for _, w in cut)
    df = defaultdict(int)
    for _, w in cut:
        for term in set(w):
            df[term] += 1
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(ALNUM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        weights = {t: math.floor(1000 * math.log((2 * len(cut) + 2) / (2 * df[t] + 1))) for t in terms if df[t]}
        rows = []
        for i, words in cut:
            m = 50 + (50 * len(words) * len(cut)) // total
            tf = Counter(w for w in words if w in weights)
            score = sum(weights[t] * ((1_000_000_000 * n) // (1000 * n + 20 * m)) for t, n in tf.items())
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        rows.sort()
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(rows[:k], 1)]
    return out


def simhashes(docs, shingle=3, radius=2):
    """(id, fingerprint, component id) by comparing all pairs."""
    prints = []
    for _, t in docs:
        words = BLANKS.findall((t or "").translate(LOWER))
        k = min(shingle, len(words))
        parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if words else []
        digests = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(d >> b & 1 for d in digests) > len(digests)))
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(distinct)):
        for b in range(a):
            if (distinct[a] ^ distinct[b]).bit_count() <= radius:
                parent[root(distinct[a])] = root(distinct[b])
    least = defaultdict(list)
    for (i, _), p in zip(docs, prints, strict=True):
        if i is not None:
            least[root(p)].append(i)
    return [(i, f"{p:016x}", min(least[root(p)], default=None)) for (i, _), p in zip(docs, prints, strict=True)]


def posteriors(patterns, counts, belief, meant, labellers=9, low=0, good=2, rounds=100):
    """Expectation-maximisation over vote patterns, one number at a time."""
    votes = {p: [p // 3**j % 3 for j in range(labellers)] for p in patterns}
    total = sum(counts)
    chance = {p: 0.1 if low in votes[p] else 0.9 for p in patterns}
    for _ in range(rounds):
        table = [[[1.0 + belief * total * meant[c][v] for v in range(3)] for _ in range(labellers)] for c in (0, 1)]
        for p, n in zip(patterns, counts, strict=True):
            for j, v in enumerate(votes[p]):
                table[1][j][v] += n * chance[p]
                table[0][j][v] += n * (1 - chance[p])
        prior = min(0.99, max(0.01, sum(n * chance[p] for p, n in zip(patterns, counts, strict=True)) / total))
        new = {}
        for p in patterns:
            odds = math.log(prior / (1 - prior))
            for j, v in enumerate(votes[p]):
                odds += math.log(table[1][j][v] / sum(table[1][j])) - math.log(table[0][j][v] / sum(table[0][j]))
            new[p] = 1 / (1 + math.exp(-max(-50, min(50, odds))))
        moved = max(abs(new[p] - chance[p]) for p in patterns)
        chance = new
        if moved < 1e-9:
            break
    return chance


def shard(key, weights):
    """Weighted rendezvous over XXH64 of the key and each shard's number."""
    def hashed(data, seed):
        return xxhash.xxh64(data, seed=seed).intdigest()

    own = hashed(key.to_bytes(8, "little", signed=True), 42)
    scores = []
    for i, w in enumerate(weights):
        unit = (hashed(i.to_bytes(4, "little"), hashed(own.to_bytes(8, "little"), 42)) >> 11) + 0.5
        scores.append((-w / math.log(unit / 2**53), i))
    return max(scores)[1]
