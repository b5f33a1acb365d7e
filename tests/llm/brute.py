"""Plain versions of what the operators compute, over lists of rows. No Spark, no shared code with the operators."""

import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def fingerprint(text):
    import xxhash

    w = WORD.findall(low(text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius=3):
    """For each fingerprint the indices it reaches, by the smallest index."""
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        near = np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius) + i + 1
        for j in near:
            x, y = root(i), root(int(j))
            parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(fps))]


def decontaminated(text, items, n=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall(low(text or ""))
    hit, found = set(), set()
    for item, body in items:
        q = word.findall(low(body or ""))
        size = min(n, len(q))
        for i in range(len(q) - size + 1 if size else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == q[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add("" if item is None else str(item))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i : i + 3]), []).append(i)
    rep = {i + k for v in where.values() if len(v) > 1 for i in v for k in range(3)}
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep), failed


def base_secrets(text):
    t = text or ""
    found = []
    for m in re.finditer(r"""(?a:([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", t):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", t):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", t):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, m.end(), "hex"))
    found.sort()
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)


def targets(sizes, weights=(3, 1, 2)):
    """By source: target."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    goal, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = goal - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
