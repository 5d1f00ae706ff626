"""Small tables with every awkward case, and plain restatements to compare with."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    draw = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzäé"
    known = ["".join(draw.choice(letters) for _ in range(draw.randint(2, 7))) for _ in range(vocabulary)]
    return [draw.choice(known) for _ in range(n)]


def changed(words: list[str], seed: int, n: int) -> list[str]:
    draw, out = random.Random(seed), list(words)
    for _ in range(n):
        out[draw.randrange(len(out))] = f"edit{draw.randrange(10**6)}"
    return out


def awkward() -> list[tuple[int | None, str | None]]:
    """(doc_id, text): nulls, empty and white texts, repeats, ties, a very long text, near copies."""
    base = prose(1, 300)
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "One TWO"), (6, "one two"), (None, "one two"),
        (None, None), (7, " ".join(prose(7, 20_000))), (8, "\x0b".join(prose(8, 60))), (8, "\x0b".join(prose(8, 60))),
        (9, "ein Wort mit breiten Blanks und ſ K ẞ İ"), (10, "a\nb\na\n\nb\n \n \nc"),
    ]
    rows += [(20 + i, " ".join(changed(base, i, i // 2))) for i in range(24)]
    rows += [(60 + i, " ".join(prose(100 + i, 80))) for i in range(12)]
    rows += [(90 + i, " ".join(base)) for i in range(4)]
    return rows


def docs(spark, rows=None):
    """With extra columns whose names clash with working columns of the operators."""
    rows = awkward() if rows is None else rows
    return spark.createDataFrame(
        [(a, b, "en", "s", None, 1, "x", 0.5) for a, b in rows],
        "doc_id long, text string, lang string, source string, n_chars long, id int, key string, stats double",
    ).repartition(3)


def empty(spark):
    return docs(spark, [])


def shingle_set(text: str | None) -> frozenset:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_components(rows, similarity: int = 85) -> dict:
    """doc_id -> smallest id reachable over links of ``similarity`` per cent."""
    known = [(k, shingle_set(t)) for k, t in rows if k is not None]
    label = {k: k for k, _ in known}

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            if x and y and 100 * len(x & y) >= similarity * len(x | y):
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return {k: find(k) for k in label}


def near_rows(rows, similarity: int = 85) -> dict:
    """(doc_id, text) -> (smallest id reachable, all (doc_id, text) reachable), every text compared on its own."""
    known = {r: shingle_set(r[1]) for r in rows if r[0] is not None and shingle_set(r[1])}
    group = {r: {r} for r in known}
    nodes = list(known)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            x, y = known[a], known[b]
            if group[a] is not group[b] and 100 * len(x & y) >= similarity * len(x | y):
                both = group[a] | group[b]
                for r in both:
                    group[r] = both
    return {r: (min(k for k, _ in g), g) for r, g in group.items()}


def one_of_each(rows, similarity: int = 80) -> list:
    """The rows that stay when each group of near duplicates keeps one text."""
    found, seen, out = near_rows(rows, similarity), set(), []
    for r in rows:
        if r not in found:
            out.append(r)
            continue
        least, group = found[r]
        first = min((t for t in group if t[0] == least), key=lambda t: hashlib.sha256((t[1] or "").encode()).digest())
        if r == first and r not in seen:
            seen.add(r)
            out.append(r)
    return out


#: Extra columns with the names that operators use for columns of their own.
CLASHES = ("id", "key", "row", "stats", "kept", "rule", "base_failed", "spans", "is_toxic", "p_toxic", "text_digest", "group",
           "component", "n", "same", "_w", "_t", "_text", "_key", "_lines", "__id", "__text", "kinds", "word count")


def clashing(spark, rows):
    """``rows`` as documents with every name of ``CLASHES`` as an extra column that tells the row."""
    table = [(k, t, "en", "s", None, *(f"{c}{i}" for c in CLASHES)) for i, (k, t) in enumerate(rows)]
    return spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(3)
