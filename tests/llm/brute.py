"""Plain restatements of the operators, for tables small enough to compare everything with everything."""

from __future__ import annotations

import re


def components(n: int, linked) -> list[int]:
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in linked:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return [top(i) for i in range(n)]


def shingle_set(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1)))


def near_groups(rows, words=5, percent=80):
    """{doc_id: (n_shingles, component_id)} for rows (doc_id, text) with distinct ids."""
    rows = sorted(rows)
    sets = [shingle_set(t, words) for _, t in rows]
    posted: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            posted.setdefault(x, []).append(i)
    counts: dict = {}
    for ids in posted.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1:]:
                counts[a, b] = counts.get((a, b), 0) + 1
    linked = [(a, b) for (a, b), c in counts.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    top = components(len(rows), linked)
    return {rows[i][0]: (len(sets[i]), rows[top[i]][0]) for i in range(len(rows))}


def kept_lines(rows, num=4, den=5):
    """{doc_id: [line numbers that stay]} for rows (doc_id, text) with distinct ids."""
    earlier, seen, out = [], set(), {}
    posted: dict = {}
    for doc, text in sorted(rows):
        out[doc] = []
        for i, line in enumerate((text or "").split("\n")):
            tokens = next(iter(shingle_words(line)), None)
            if tokens is None:
                continue
            counts: dict = {}
            for w in tokens:
                for k in posted.get(w, ()):
                    counts[k] = counts.get(k, 0) + 1
            if not any(c * den >= num * (len(tokens) + len(earlier[k]) - c) for k, c in counts.items()):
                out[doc].append(i)
            if tokens not in seen:
                seen.add(tokens)
                for w in tokens:
                    posted.setdefault(w, []).append(len(earlier))
                earlier.append(tokens)
    return out


def shingle_words(line):
    found = shingle_set(line, 1)
    if found:
        yield frozenset(w[0] for w in found)
