"""Plain single-process versions of the operators, written from their definitions."""

import hashlib
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def roots(count, pairs):
    parent = list(range(count))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        if p != q:
            parent[max(p, q)] = min(p, q)
    return [find(i) for i in range(count)]


def smallest(ids, root):
    out = {}
    for i, r in zip(ids, root):
        if i is not None:
            out[r] = i if r not in out else min(out[r], i)
    return [out.get(r) for r in root]


def fingerprint(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows):
    prints = np.array([fingerprint(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    root = roots(len(rows), zip(*np.nonzero(np.triu(near, 1))))
    return [(i, f"{int(p):016x}", c) for (i, _), p, c in zip(
        rows, prints, smallest([i for i, _ in rows], root))]


def vectors(rows):
    ids, pairs, degree = [r[0] for r in rows], [], [0] * len(rows)
    good = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(len(v), []).append(k)
    for some in good.values():
        u = np.array([rows[k][1] for k in some], float)
        u /= np.linalg.norm(u, axis=1)[:, None]
        linked = u @ u.T >= 0.95
        np.fill_diagonal(linked, False)
        for a, b in zip(*np.nonzero(linked)):
            degree[some[a]] += 1
            pairs.append((some[a], some[b]))
    root = roots(len(rows), pairs)
    return [(i, d, c) for i, d, c in zip(ids, degree, smallest(ids, root))]


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(number[::-1])) % 10 == 0


def pii(text):
    text = text or ""
    out = [("email", m) for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 8 <= len(digits(m.group())) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in (
    "password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text)
            if len(m.group()) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text)
            if len(m.group()) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def crc(data):
    return zlib.crc32(data)


def targets(sizes):
    """Water-filling by rounds: source -> target, with 150 % of all sizes and two epochs at most."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, clamped = 1.5 * sum(sizes.values()), set()
    while len(clamped) < len(order):
        level = (budget - sum(2 * sizes[s] for s in clamped)) / sum(
            weight[s] for s in order if s not in clamped)
        over = {s for s in order if s not in clamped and level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in clamped else level * weight[s] for s in order}
        clamped |= over
    return {s: 2 * sizes[s] for s in order}
