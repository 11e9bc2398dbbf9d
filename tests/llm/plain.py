"""Brute-force versions of the operators' results."""

import hashlib
import re

SPACE = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ALNUM_ALL = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


class Union:
    def __init__(self, names):
        self.up = {n: n for n in names}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def repeated_bytes(docs, window):
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if b[i:i + window] in seen:
                hit[i:i + window] = b"\1" * window
            seen.add(b[i:i + window])
        runs = sum(1 for i in range(len(b)) if hit[i] and (i == 0 or not hit[i - 1]))
        out.append((d, len(b), sum(hit), runs, sha(bytes(x for x, h in zip(b, hit) if not h))))
    return sorted(out)


def repeated_words(docs, window):
    words = [(d, SPACE.findall(t or "")) for d, t in sorted(docs, key=lambda x: x[0])]
    first, out = {}, []
    for d, w in words:
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), d)
    for d, w in words:
        hit = [0] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                hit[i:i + window] = [1] * window
        out.append((d, len(w), sum(hit), sha(" ".join(x for x, h in zip(w, hit) if not h))))
    return sorted(out)


def contaminated(docs, items, window=10):
    holders = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        n = min(window, len(w))
        if n and i is not None:
            for k in range(len(w) - n + 1):
                holders.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    sizes, out = {len(k) for k in holders}, []
    for d, t in docs:
        w, found = ALNUM.findall(lower(t)), set()
        hit = [0] * len(w)
        for n in sizes:
            for k in range(len(w) - n + 1):
                if x := holders.get(tuple(w[k:k + n])):
                    found |= x
                    hit[k:k + n] = [1] * n
        out.append((d, len(w), sum(hit), len(found), sha(",".join(sorted(found))), sum(hit) > 0))
    return sorted(out, key=str)


def shingles(text, size):
    w = SPACE.findall(lower(text))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def near_groups(docs, size, percent):
    sets = [(d, shingles(t, size)) for d, t in docs]
    union = Union(d for d, _ in docs)
    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= percent * (len(a) + len(b) - n):
                    union.join(d, e)
    return sorted((d, len(s), union.find(d)) for d, s in sets)


def luhn(digits):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def personal(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, least, most in ((2, r"[0-9]([\x20-]?[0-9])+", 13, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out
