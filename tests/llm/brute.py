"""Plain versions of the operators' contracts, in Python on one machine."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def runs(flags) -> list[tuple[int, int]]:
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            out.append((start, i))
            start = None
    return out


def op1(rows, length=400, first=False):
    """rows: (id, text). Bytes covered by a string of ``length`` that also starts elsewhere."""
    texts = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: r[0])
    count = Counter(t[p:p + length] for _, t in texts for p in range(len(t) - length + 1))
    seen, out = set(), []
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            s = t[p:p + length]
            if count[s] > 1 and (not first or s in seen):
                gone[p:p + length] = [True] * length
            seen.add(s)
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), len(runs(gone)), sha(kept)))
    return out


def op2(rows, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate(LOWER))
    index = defaultdict(set)
    sizes = set()
    for i, t in items:
        w = words(t)
        size = min(window, len(w))
        sizes.add(size)
        for s in range(len(w) - size + 1) if w else []:
            index[tuple(w[s:s + size])].add(str(i))
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for size in sizes - {0}:
            for s in range(len(w) - size + 1):
                if own := index.get(tuple(w[s:s + size])):
                    hit |= set(range(s, s + size))
                    found |= own
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def op3(rows, rules, default="allow"):
    out = []
    for page, url in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(h) + len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else (0, None, default)
        out.append((page, host, path, best[1], best[2]))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15),
]


def op4(rows):
    out = []
    for d, t in rows:
        spans = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if good(m[0])] for k, p, good in PII]
        out.append((d, *map(len, spans), sha(",".join(x for s in spans for x in s))))
    return out


def shingles(text, size=5):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def op5(rows, size=5, threshold=75):
    sets = {d: shingles(t, size) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            index[x].add(d)
    pairs = {(a, b) for ids in index.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return [(d, len(sets[d]), root(d)) for d, _ in rows]


def op7(rows):
    first, out = {}, []
    for page, _, html in sorted(rows):
        first.setdefault((html or "").encode(), page)
    for page, _, html in rows:
        payload = (html or "").encode()
        origin = first[payload]
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "response" if origin == page else "revisit", None if origin == page else origin))
    return out


def op10(rows):
    out = []
    for d, t in rows:
        t = t or ""
        w = SPACED.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if SPACED.search(line):
                dup += line in seen
                seen.add(line)
        count = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if count[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again), failed))
    return out


def op11(rows):
    """Groups by the normalised text itself."""
    white = re.compile(r"[\x20\x09-\x0D]+")
    norm = [white.sub(" ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, norm):
        groups[t].append(i)
    out, seen = [], set()
    for (i, _), t in zip(rows, norm):
        ids = [k for k in groups[t] if k is not None]
        keep = min(ids) if ids else None
        first = i == keep and (t, i) not in seen
        seen.add((t, i))
        out.append((i, keep, len(groups[t]), first, sha(t)))
    return out


def op12(rows):
    """rows: (doc_id, source, lang, n_chars, text); the whole tree in memory."""
    def digest(values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def levels(leaves):
        out = [leaves]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k:k + 2])) for k in range(0, len(out[-1]), 2)])
        return out

    def way(built, k):
        out = []
        for level in built[:-1]:
            out.append((level[k ^ 1] if k ^ 1 < len(level) else None, k & 1))
            k >>= 1
        return out

    trees = defaultdict(list)
    for r in rows:
        i, source, lang, n_chars, text = r
        odd = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n_chars is not None
        trees[lang].append((i, digest(r), digest((i, source, lang, n_chars + 1, text)) if odd else digest(r)))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {}
    for name in names:
        trees[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        built[name] = levels([x[1] for x in trees[name]])
    top = levels([built[name][-1][0] for name in names]) if names else [[None]]
    out = []
    for at, name in enumerate(names):
        for k, (i, leaf, other) in enumerate(trees[name]):
            path = way(built[name], k) + way(top, at)
            h = other
            for sibling, right in path:
                h = sha(h if sibling is None else sibling + h if right else h + sibling)
            proof = sha("".join(s for s, _ in path if s is not None))
            out.append((i, leaf, built[name][-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return out


def op13(rows):
    """Every period of every stretch, by comparing words q apart."""
    out = []
    for i, text in rows:
        w = SPACED.findall(text or "")
        n = len(w)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + k % p] for k in range(n - a)]
        found = {}
        for q in range(1, n // 4 + 1):
            at = 0
            while at + q < n:
                if w[at] != w[at + q]:
                    at += 1
                    continue
                end = at
                while end + q < n and w[end] == w[end + q]:
                    end += 1
                if end + q - at >= max(6, 4 * q):
                    found.setdefault((at, end + q - at), q)  # the smallest period comes first
                at = end + 1
        listed = sorted((s, m, q) for (s, m), q in found.items())
        listed.sort(key=lambda r: (r[0], r[2]))
        gone = set()
        for s, m, q in listed:
            gone.update(range(s + q, s + m))
        best = min(listed, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if listed else (None, None, None)
        milli = 1000 * best[1] // best[2] if listed else None
        out.append((i, len(listed), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in listed)),
                    sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out
