"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeat_words(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)})


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    r = repeat_words(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), r, len(words) < 50 or 100 * r > 50 * len(words))


def normal(line):
    return re.sub(r"[ \t-\r]+", " ", line.lower()).strip(" ")


def judged(rows, line_min_docs=20, share=0.05, left=30, line_max_texts=100):
    """rows: (id, text, host). Verdicts in order."""
    docs, held, texts = defaultdict(set), defaultdict(set), defaultdict(set)
    for d, t, h in rows:
        t = t or ""
        who = t if d is None else d
        docs[h].add(who)
        for x in t.split("\n"):
            held[h, normal(x)].add(who)
            texts[h, normal(x)].add(t)

    def goes(h, x):
        n = len(held[h, x])
        return x and (n > line_min_docs and n > share * len(docs[h]) or len(texts[h, x]) > line_max_texts)

    out = []
    for _, t, h in rows:
        m = base(t)
        bad = [(i, len(normal(x).split(" "))) for i, x in enumerate((t or "").split("\n")) if goes(h, normal(x))]
        gone = sum(n for _, n in bad)
        out.append((*m, [i for i, _ in bad], not m[-1] and not (m[0] - gone) * 100 < m[0] * left))
    return out


def one_word(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == (b if len(a) > len(b) else b[:i] + b[i + 1 :]) for i in range(len(a)))


def line_dups(rows, min_edit=5):
    """rows: (id, text) with distinct ids. {id: (exact, near)}."""
    first, every = {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        for i, x in enumerate((t or "").split("\n")):
            n = normal(re.sub(r"([\u0e00-\u0eff\u3041-\u30fa\u4e00-\u9fff])", r" \1 ", x))
            if n:
                every.append((d, i, n))
                first.setdefault(n, len(every))
    order = sorted(first, key=first.get)
    near = {b for j, b in enumerate(order) if len(b.split(" ")) >= min_edit for a in order[:j] if len(a.split(" ")) >= min_edit and one_word(a.split(" "), b.split(" "))}
    out = defaultdict(lambda: ([], []))
    for k, (d, i, n) in enumerate(every, 1):
        if first[n] != k:
            out[d][0].append(i)
        elif n in near:
            out[d][1].append(i)
    return dict(out)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def components(rows, percent=85):
    """rows: (id, text). {id: (n, component)}."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    postings = defaultdict(list)
    for d in sorted(sets):
        seen = Counter(o for s in sets[d] for o in postings[s])
        for o, k in seen.items():
            if 100 * k >= percent * (len(sets[d]) + len(sets[o]) - k):
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
        for s in sets[d]:
            postings[s].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}
