"""The operators' contracts in plain Python, for small tables."""

import re


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def repeated_mask(texts, window):
    starts = {}
    words = [words_of(t) for t in texts]
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            starts.setdefault(tuple(w[i : i + window]), []).append((d, i))
    masks = [[False] * len(w) for w in words]
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                masks[d][i : i + window] = [True] * window
    return words, masks


def in_order(rows):
    return sorted(rows, key=repr)


def brute_components(rows, size, percent):
    sets = []
    for row in rows:
        w = words_of(lowered(row[1]))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, row in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        comp = min(ids) if ids else None
        out.append((row[0], len(sets[i]), comp, row[0] == comp))
    return out


def edits(a, b):
    """Word edit distance, as far as 2."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute_contamination(rows, items):
    out = []
    for row in rows:
        w, hit, named = item_words(row[1]), set(), set()
        for item, text in items:
            phrase = item_words(text)
            k = min(13, len(phrase))
            for i in range(len(phrase) - k + 1) if k else ():
                for j in range(len(w) - k + 1):
                    if w[j : j + k] == phrase[i : i + k]:
                        hit |= set(range(j, j + k))
                        named.add(item)
        out.append((row[0], len(w), len(hit), tuple(sorted(str(n) for n in named if n is not None)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def brute_lines(rows):
    """(doc_id, lines, dropped, text) of every row, and the lines that an earlier one within a word edit drops."""
    lines = {}
    for row in rows:
        for i, line in enumerate((row[1] or "").split("\n")):
            if w := words_of(line):
                lines.setdefault(tuple(w), []).append((row[0] is None, row[0] or 0, i))
    first = {w: min(at) for w, at in lines.items()}
    near = {w for w in lines if len(w) >= 8 and any(first[o] < first[w] and len(o) >= 8 and abs(len(o) - len(w)) < 2 and o != w and edits(o, w) <= 1 for o in lines)}
    expected = []
    for row in rows:
        total, left = 0, []
        for i, line in enumerate((row[1] or "").split("\n")):
            w = tuple(words_of(line))
            total += bool(w)
            if not w or (w not in near and first[w] == (row[0] is None, row[0] or 0, i)):
                left.append(line)
        lost = len((row[1] or "").split("\n")) - len(left)
        expected.append((row[0], total, lost, None if row[1] is None else "\n".join(left)))
    return expected, near
