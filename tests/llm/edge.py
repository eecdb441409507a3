"""Small documents with every awkward case, and plain re-computations to hold results against."""

import random
import re

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(n=60, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["Ä", "é", "Über", "x.y", "O'K"]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared, out = say(60), []
    for i in range(n):
        kind = i % 6
        text = say(rng.randint(1, 120))
        if kind == 1:
            text = f"{say(5)} {shared} {say(9)}"
        elif kind == 2 and i > 12:
            text = out[i - 6][1].upper() if out[i - 6][1] else text
        elif kind == 3 and i > 12:
            w = (out[i - 6][1] or text).split(" ")
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        out.append((i * 3, text))
    out += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one two three"), (1004, "ONE two three"), (1005, "a b c\x1cd"), (1006, ("ab " * 3000).strip()), (1007, "12 !!")]
    return out


def frame(spark, rows=None):
    """With columns whose names clash with the operators' own."""
    rows = documents() if rows is None else rows
    data = [(i, t, "k", i, (i or 0) % 3, "x") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, id string, n long, v0 int, kept string")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(rows, units, length):
    """Which units of each text lie in a window that starts earlier."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        u = units(t)
        gone = [False] * len(u)
        for k in range(len(u) - length + 1):
            key = tuple(u[k : k + length])
            if key in seen:
                gone[k : k + length] = [True] * length
            seen.add(key)
        out[i] = (u, gone)
    return out


def benchmark_hits(rows, items, size=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = {}
    for i, t in rows:
        w, found = words(t), set()
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = [True] * n
                    found |= windows[tuple(w[k : k + n])]
        out[i] = (len(w), sum(hit), len(found), sum(hit) > 0 and 20 * sum(hit) >= len(w))
    return out


def unruly():
    """Rows without ids, with repeated ids, and repeated rows: each is a document of its own."""
    words = [f"w{k}" for k in range(40)]
    long, other = " ".join(words), " ".join(words[20:] + words[:5])
    return [(None, long), (None, long), (None, None), (1, long), (1, long), (1, other), (1, ""), (2, other.upper()), (2, other.upper()), (3, "lonely text of its own"), (None, "12 !!"), (4, None), (4, None)]
