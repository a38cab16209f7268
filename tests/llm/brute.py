"""Plain versions of the contracts, for small tables."""

import hashlib
import re


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def near(rows, words=3, percent=85):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def contaminated(docs, items, size=13):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    wins = {}
    for i, t in items:
        w = word(t)
        for s in range(max(1, len(w) - size + 1)) if w else ():
            wins.setdefault(tuple(w[s : s + size]), set()).add(i)
    lengths = sorted({len(w) for w in wins})
    out = {}
    for d, t in docs:
        w, hit, its = word(t), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    its |= wins[x]
        out[d] = (len(w), len(hit), len(its), sha(",".join(sorted(map(str, its)))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def repeats(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            x = raw[s : s + length]
            if x in seen:
                gone[s : s + length] = [True] * length
            seen.add(x)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(raw), sum(gone), runs, sha(bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def lines(rows, least=10):
    key = lambda x: fold(x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(d)
    out = {}
    for d, t in rows:
        parts = (t or "").split("\n")
        keep = [x for x in parts if len(key(x)) < least or len(held[key(x)]) < 2 or min(held[key(x)]) == d]
        out[d] = (len(parts), len(parts) - len(keep), sha("\n".join(keep)))
    return out


def lm(rows, backoff=0.4, unseen=0.5):
    """Bigram scores of each document against all others, equal rows being one document."""
    import math
    from collections import Counter

    word, texts = Counter(), {}
    copies = Counter(rows)
    grams = lambda w: list(zip([None, *w], w))
    pair, first, total = Counter(), Counter(), 0
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        texts[d, t] = w
        pair.update(grams(w))
        word.update(w)
        total += len(w)
        first[None] += bool(w)
    out = {}
    for (d, t), w in texts.items():
        m = copies[d, t]
        mine, own = Counter(grams(w)), Counter(w)
        s = seen = 0
        for (a, b), n in mine.items():
            others = pair[a, b] - n * m
            if others > 0:
                rest = (first[None] - m) if a is None else word[a] - own[a] * m
                s += n * math.log(others / max(rest, others))
                seen += n
            else:
                s += n * math.log(backoff * max(word[b] - own[b] * m, unseen) / max(total, 1))
        out[d] = (len(w), seen, s / len(w) if w else None)
    return out
