"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile("[^ \t-\r]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def substring_dedup(rows, least=50):
    """rows: (doc_id, text); returns a list of (doc_id, n_bytes, n_removed, n_spans, sha256), sorted."""
    big = 1 << 62
    data = sorted(((big if i is None else i), (t or "").encode()) for i, t in rows)
    first = {}
    for i, b in data:
        for k in range(len(b) - least + 1):
            first.setdefault(b[k : k + least], i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - least + 1):
            if first[b[k : k + least]] < i:
                gone[k : k + least] = b"\1" * least
        spans = [x for x in bytes(gone).split(b"\0") if x]
        out.append((None if i == big else i, len(b), sum(gone), len(spans), sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out, key=str)


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_duplicates(rows):
    """rows: (doc_id, text) with distinct ids; returns {doc_id: (n_shingles, component)}."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in where.get(s, ()))
        for s in sets[i]:
            where.setdefault(s, []).append(i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


def grams(texts, order):
    """All (context bytes, byte) of the texts, each begun by zero bytes."""
    padded = [b"\0" * order + t for t in texts]
    return [p[i : i + order + 1] for p in padded for i in range(len(p) - order)]


def kneser_ney(by_class, order, shared, discount=0.75):
    """A function (class, gram) -> log probability of the gram's last byte; by_class: {class: texts}."""
    own = {c: grams(ts, order) for c, ts in by_class.items()}
    both = [g for gs in own.values() for g in gs]

    def counts(gs, k):
        return Counter(g[-k - 1 :] for g in gs) if k == order else Counter(g[-k - 1 :] for g in {g[-k - 2 :] for g in gs})

    tables = {(c, k): counts(both if k <= shared else gs, k) for c, gs in own.items() for k in range(order + 1)}

    def log_p(c, gram):
        p = 1 / 256
        for k in range(order + 1):
            after = {g: n for g, n in tables[c, k].items() if g[:-1] == gram[-k - 1 : -1]}
            if after:
                p = (max(after.get(gram[-k - 1 :], 0) - discount, 0) + discount * len(after) * p) / sum(after.values())
        return math.log(p)

    return log_p


def code_length(texts, order):
    """A function gram -> bits of its last byte by partial matching (method C, with exclusion)."""
    seen = grams(texts, order)
    tables = [Counter(g[-k - 1 :] for g in seen) for k in range(order + 1)]

    def bits(gram):
        out, ruled = 0.0, set()
        for k in range(order, -1, -1):
            after = {g[-1]: n for g, n in tables[k].items() if g[:-1] == gram[-k - 1 : -1]}
            left = {s: n for s, n in after.items() if s not in ruled}
            if gram[-1] in left:
                return out + math.log2((sum(left.values()) + len(left)) / left[gram[-1]])
            if left:
                out += math.log2((sum(left.values()) + len(left)) / len(left))
            ruled |= set(after)
        return out + math.log2(max(256 - len(ruled), 1))

    return bits


BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m.group(2)) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 16),
]


def secrets(text):
    """Counts of the three kinds and the base spans in order."""
    found = [(m.start(), k, m.end()) for k, (_, p, good) in enumerate(BASE) for m in p.finditer(text or "") if good(m)]
    return [sum(f[1] == k for f in found) for k in range(3)], ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in sorted(found))


def markov_spans(text, base, logs, least, shortest=16):
    """Added spans of a text: runs outside the base spans whose mean log ratio reaches the threshold."""
    chars = list(text or "")
    for s in base:
        _, a, b = s.split(":")
        chars[int(a) : int(b)] = " " * (int(b) - int(a))
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]+", "".join(chars)):
        t = m.group()
        if len(t) >= shortest and sum(logs[ord(a) * 128 + ord(b)] for a, b in zip(t, t[1:])) / (len(t) - 1) >= least:
            out.append(f"markov:{m.start()}:{m.end()}")
    return out


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    inside = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def targets(sizes, weights=(5, 2, 1), most=3):
    """sizes: {source: size}; targets by resharing until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        over = 0.0
        for s in list(open_):
            target[s] += left * weight[s] / total
            if target[s] >= most * sizes[s]:
                over += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
        left = over
    return target


def remainder(doc_id, by):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % by


def spelling(rows):
    """rows: (doc_id, text); returns sorted (word, form, root, n, n_near, form_n)."""
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, found = {}, {}
    for w in n:
        found[w] = sorted((-n[v], v) for v in n if near(w, v))
        form[w] = found[w][0][1] if found[w] and -found[w][0][0] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(found[w]), n.get(form[w])))
    return sorted(out)


def clusters(rows, k=16, rounds=3, scale=64, dims=64):
    """rows: (vec_id, vector); returns sorted (vec_id, cluster, distance, cluster_inertia, inertia, sha256)."""
    kept = [(i, [int(x) * scale if abs(x) > 1e300 else math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, v in sorted(kept, key=lambda r: sha(f"1:{'' if r[0] is None else r[0]}"))[:k]]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [place(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *place(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in last:
        inertia[j] += d
    fits = lambda x: x if x < 1 << 63 else None
    wide = {j for _, d, j in last if d >= 1 << 63}
    return sorted(((i, j, fits(d), None if j in wide else fits(inertia[j]), None if wide else fits(sum(inertia.values())), sha(",".join(map(str, centres[j])))) for i, d, j in last), key=str)
