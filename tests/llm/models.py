"""Plain Python models of what the operators return."""

import collections
import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = r"[^\x20\x09-\x0D]+"


def blank_words(text):
    return re.findall(BLANK, text or "")


def kept_after_repeats(texts, window):
    count, words = collections.Counter(), [blank_words(t) for t in texts]
    for w in words:
        count.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def shingles(text, width=5):
    w = blank_words((text or "").translate(LOWER))
    if len(w) < width:
        return frozenset([("short", *w)] if w else [])
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))


def classes(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[find(k)].append(i)
    return {i: (len(s), min(least[find(k)])) for k, (i, s) in enumerate(sets)}


def line_statistics(text):
    text = text or ""
    w = blank_words(text)
    lines = [x for x in text.split("\n") if re.search(BLANK, x)]
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    count, twice = collections.Counter(grams), [False] * len(w)
    for k, g in enumerate(grams):
        if count[g] > 1:
            twice[k : k + 5] = [True] * 5
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(twice)


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contaminated(rows, items, window=10):
    where, lengths = collections.defaultdict(set), set()
    for i, t in items:
        if w := item_words(t):
            n = min(window, len(w))
            lengths.add(n)
            for k in range(len(w) - n + 1):
                where[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, found = item_words(t), set()
        hit = [False] * len(w)
        for n in lengths:
            for k in range(len(w) - n + 1):
                if ids := where.get(tuple(w[k : k + n])):
                    found |= ids
                    hit[k : k + n] = [True] * n
        out.append((i, len(w), sum(hit), sorted(found)))
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def identifiers(text):
    def valid(kind, v):
        digits = re.sub("[^0-9]", "", v)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in v.split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()

    found = [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for rank, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(kind, m.group())]
    return ",".join(x for _, _, x in sorted(found))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
