"""Plain Python versions of the operators, for small tables."""

import re

WORD = re.compile("[0-9a-z\u0080-\U0010ffff]+")
SPACE = " \t\n\x0b\f\r"


def shingles(text, width=5):
    words = WORD.findall((text or "").lower())
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def similar(a, b, threshold=0.8):
    return bool(a and b) and len(a & b) >= threshold * len(a | b) - 1e-9


def classes(docs, threshold=0.8):
    """``{(id, text): (class, links)}`` of (id, text) pairs."""
    keys = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    sets = [shingles(t) for _, t in keys]
    links = {k: [j for j in range(len(keys)) if j != k and similar(sets[k], sets[j], threshold)] for k in range(len(keys))}
    out = {}
    for k in range(len(keys)):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[keys[k]] = (keys[min(seen)][0], len(links[k]))
    return out


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def dedup_lines(docs, min_chars=40, min_docs=5):
    """``[(id, lines, dropped, kept text)]`` of (id, text) pairs; ids None count as the smallest."""
    order = lambda i: (i is not None, i or 0)
    holders = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            holders.setdefault(line_key(line), set()).add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [
            x for x in lines
            if len(line_key(x)) < min_chars or len(holders[line_key(x)]) < min_docs or i == max(holders[line_key(x)], key=order)
        ]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def contained(docs, items, threshold=0.8):
    found = []
    for d, text in docs:
        own = shingles(text)
        for i, item in items:
            wanted = shingles(item)
            if wanted and len(wanted & own) >= threshold * len(wanted) - 1e-9:
                found.append((d, i, len(wanted), len(wanted & own)))
    return found


def chunks_of(text, gear, reach, window, most):
    """Start and end of the content-defined chunks of an ASCII text, one position after the other."""
    data = text.encode()
    h = [sum(int(gear[data[i - j]]) << j for j in range(min(window, i + 1))) % 2**32 for i in range(len(data))]
    cuts = {0, len(data)}
    for i in range(window - 1 + reach, len(data) - reach):
        if h[i] > max(h[i - reach : i]) and h[i] >= max(h[i + 1 : i + 1 + reach]):
            cuts.add(i + 1)
    for a, b in list(zip(sorted(cuts), sorted(cuts)[1:], strict=False)):
        cuts |= set(range(a + most, b, most))
    cuts = sorted(cuts)
    return list(zip(cuts, cuts[1:], strict=False)) if data else []


def spans(docs, gear, reach, window, most, min_words):
    """``(id, start, end, words, first id, is first)`` of the shared spans of (id, ASCII text) pairs."""
    key = lambda i: (i is not None, i or 0)
    texts = sorted(set(docs), key=str)
    holders = {}
    for i, t in texts:
        for a, b in chunks_of(t or "", gear, reach, window, most):
            holders.setdefault(t[a:b], set()).add(key(i))
    out = []
    for i, t in texts:
        run = []
        for a, b in [*chunks_of(t or "", gear, reach, window, most), (-1, -1)]:
            if a >= 0 and len(holders[t[a:b]]) > 1:
                run.append((a, b))
                continue
            if run:
                start, end = run[0][0], run[-1][1]
                words = sum(t[k] not in SPACE and (k == 0 or t[k - 1] in SPACE) for k in range(start, end))
                if words >= min_words:
                    first = min(((-(b - a), min(holders[t[a:b]])) for a, b in run))[1]
                    earlier = any(min(holders[t[a:b]]) < key(i) for a, b in run)
                    out.append((i, start, end, words, first[1] if first[0] else None, not earlier))
            run = []
    return out
