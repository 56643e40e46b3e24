"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def quality(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    hit = {i + j for i, x in enumerate(windows) if n[x] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed


def digest(spans, kinds):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted((a, kinds.index(k), k, b) for k, a, b in spans))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


SECRETS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(text):
    t = text or ""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return found


def entropy(text):
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


PRIVATE = ("email", "ip", "card", "phone")


def private(text):
    t = text or ""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, least, most in (("card", r"[0-9]([\x20-]?[0-9])+", 12, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                found.append((kind, *m.span()))
    return found


BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def decontaminate(docs, items, k=10):
    """docs, items: {id: text}; per document (n_words, n_hit, sorted item ids as strings)."""
    windows = {}
    for item, text in items.items():
        w = BENCH.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - k + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    sizes = {len(x) for x in windows}
    out = {}
    for d, text in docs.items():
        w = BENCH.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if x := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= x
        out[d] = (len(w), len(hit), sorted(found))
    return out


def simhash(text):
    import xxhash

    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fingerprints, radius=4):
    """fingerprints: {id: int}; {id: smallest reachable id}."""
    import numpy as np

    ids = sorted(fingerprints)
    f = np.array([fingerprints[i] for i in ids], dtype=np.uint64)
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= radius) + i + 1:
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    return {ids[i]: ids[root(i)] for i in range(len(ids))}


def remove_lines(docs):
    """docs: {id: text}; {id: text} after the windows of three lines."""
    seen, gone = set(), {}
    at = {d: [i for i, x in enumerate((t or "").split("\n")) if WORD.search(x)] for d, t in docs.items()}
    for d in sorted(docs):
        lines = (docs[d] or "").split("\n")
        for j in range(max(1, len(at[d]) - 2) if at[d] else 0):
            key = tuple(lines[i].strip(" \t\n\x0b\f\r") for i in at[d][j : j + 3])
            if key in seen:
                gone.setdefault(d, set()).update(at[d][j : j + 3])
            seen.add(key)
    return {d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone.get(d, ())) if d in gone else t for d, t in docs.items()}


def ppm_scores(train, tokens, order=5):
    """train: {token: count}; {token: log10 probability} by prediction by partial matching, one symbol at a time."""
    coded = lambda t: b" " + t.encode() + b" " if t else b" \n"
    trie = {}
    for t, n in train.items():
        s = coded(t)
        for i in range(1, len(s)):
            for k in range(min(order, i) + 1):
                trie.setdefault(s[i - k : i], Counter())[s[i]] += n
    out = {}
    for t in tokens:
        s, total = coded(t), 0.0
        for i in range(1, len(s)):
            excluded, p = set(), 1.0
            for k in range(min(order, i), -1, -1):
                seen = {x: n for x, n in trie.get(s[i - k : i], {}).items() if x not in excluded}
                if not seen:
                    continue
                n, q = sum(seen.values()), len(seen)
                if s[i] in seen:
                    p *= (seen[s[i]] - 0.5) / n
                    break
                p *= 0.5 * q / n
                excluded |= set(seen)
            else:
                p /= 256 - len(excluded)
            total += math.log10(p)
        out[t] = total
    return out
