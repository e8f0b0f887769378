"""Plain-Python versions of the operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WIDE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def substring_dedup(docs, window=20):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if x in seen:
                gone[k : k + window] = [True] * window
            seen.add(x)
        out[i] = (len(w), sum(gone), sha(" ".join(a for a, g in zip(w, gone) if not g)))
    return out


def contamination(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = WIDE.findall(fold(t or ""))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = WIDE.findall(fold(t or "")), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    found |= x
                    hit.update(range(k, k + n))
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digest(spans, kinds):
    spans = sorted((s, kinds.index(k), e) for k, s, e in spans)
    counts = Counter(k for _, k, _ in spans)
    return (*(counts[k] for k in range(len(kinds))), sha(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)))


def pii(text):
    t, s = text or "", []
    s += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    s += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            s.append(("card", *m.span()))
    s += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return digest(s, ["email", "ip", "card", "phone"])


def secrets(text):
    t, s = text or "", []
    words = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey"))
    s += [("assign", *m.span()) for m in re.finditer(rf"({words})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 12]
    s += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    s += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return digest(s, ["assign", "access", "hex"])


def shingles(text, n):
    w = WORD.findall(fold(text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near_duplicates(docs, n=4, percent=80):
    sets = {i: shingles(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    places = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            places[g].append(i)
    for i, s in sets.items():
        for j, k in Counter(j for g in s for j in places[g] if j > i).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def repetition(text):
    t = text or ""
    w = WORD.findall(t)
    n, seen, same = len(w), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            same += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    inside = {i + k for i in range(n - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), same, len(inside), n < 10 or 100 * len(inside) > 20 * n)


def toxicity(texts, sample, toxic, k=15):
    """Votes for all texts, none by itself: TF-IDF over all words of the sample, weighted by how surely they tell its labels apart."""
    counts = {i: Counter(re.findall(r"[a-z0-9\x80-\U0010ffff]+", fold(t or ""))) for i, t in texts.items()}
    known = set().union(*(counts[i] for i in sample))
    seen = Counter(x for c in counts.values() for x in c)
    within = Counter(x for i in sample for x in counts[i])
    within_toxic = Counter(x for i in sample if i in toxic for x in counts[i])
    bad = sum(i in toxic for i in sample)
    share = (bad + 1) / (len(sample) + 2)

    def weight(x):
        a, b = within_toxic[x] + 4 * share, within[x] - within_toxic[x] + 4 * (1 - share)
        z2 = (math.log(a / (bad + 4)) - math.log(b / (len(sample) - bad + 4))) ** 2 / (1 / a + 1 / b)
        return (math.log((1 + len(texts)) / (1 + seen[x])) + 0.1) * max(z2 / (z2 + 20), 1e-6)

    weights = {x: weight(x) for x in known}

    def unit(c):
        w = {x: (1 + math.log(n)) * weights[x] for x, n in c.items() if x in known}
        size = math.sqrt(sum(v * v for v in w.values()))
        return {x: v / size for x, v in w.items()}

    vectors = {i: unit(c) for i, c in counts.items()}
    bare = [i for i in sample if not vectors[i]]
    out = {}
    for i, q in vectors.items():
        out[i] = (sum(j in toxic for j in bare) + share) / (len(bare) + 1)
        if q:
            near = sorted(((round(sum(v * vectors[j].get(x, 0) for x, v in q.items()), 6), j in toxic) for j in sample if j != i), reverse=True)
            last = near[min(k, len(near)) - 1][0]
            above, level = [x for x in near if x[0] > last], [x for x in near if x[0] == last]
            part = (min(k, len(near)) - len(above)) / len(level)
            votes = [(1 / (0.02 + max(1 - c, 0)), t) for c, t in above] + [(part / (0.02 + max(1 - c, 0)), t) for c, t in level]
            out[i] = sum(v for v, t in votes if t) / sum(v for v, _ in votes)
    return out


def periodic_runs(words: list) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of all runs, trying every period from every word."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
            i += i == start
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def merkle(rows: list[tuple[object, object, list]], arity: int) -> dict:
    """Per (key, group): a list of (leaf, subroot, root, path), a path being pairs of digests before and after in each run."""
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            x = levels[-1]
            levels.append([digest("".join(x[i : i + arity])) for i in range(0, len(x), arity)])
        return levels

    def path(levels, i):
        out = []
        for x in levels[:-1]:
            b = i - i % arity
            out.append(("".join(x[b:i]), "".join(x[i + 1 : b + arity])))
            i //= arity
        return out

    groups, out = {}, {}
    for key, group, values in rows:
        groups.setdefault(group, []).append((key is not None, key, digest("".join(map(text, values)))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g]), tree([h for *_, h in sorted(groups[g])])) for g in order}
    top = tree([trees[g][1][-1][0] for g in order])
    for j, g in enumerate(order):
        for i, (_, key, h) in enumerate(trees[g][0]):
            out.setdefault((key, g), []).append((h, trees[g][1][-1][0], top[-1][0], path(trees[g][1], i) + path(top, j)))
    return out
