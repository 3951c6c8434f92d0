"""Small tables with every odd case, and plain re-statements of the contracts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ["row", "score", "size", "key", "found", "node", "group", "n_tokens", "keep_id", "copies", "root", "part", "left", "run"]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(rng: random.Random, n: int, syllables: str = "an er on the in re ti es") -> str:
    parts = syllables.split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls everywhere, empty, blank and very long texts, ties, repeated rows, near copies, other scripts."""
    rng = random.Random(5)
    base = prose(rng, 80)
    near = " ".join([*base.split()[:-2], "other", "end"])
    long = prose(rng, 30_000)
    return [
        (1, base, "en", "a", 1),
        (2, near, "en", "a", None),
        (2, near, "en", "a", None),
        (3, base, None, None, 3),
        (None, base, "en", "b", 4),
        (None, None, None, None, None),
        (4, None, "en", "b", 0),
        (5, "", "en", "c", 0),
        (6, " \t\n", None, "c", 0),
        (7, long, "en", "a", 7),
        (8, long + " x", "en", "b", 8),
        (9, "one two", "en", "z", 9),
        (10, "ONE  two!", "en", None, 9),
        (11, "12 345 !!", "en", "z", 9),
        (12, "日本語 の テキスト 🤔 <|endoftext|> 'tis it's", None, "z", 9),
        (13, base.upper(), "de", "a", 13),
    ]


def odd_docs(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


def empty_docs(spark):
    return odd_docs(spark).limit(0)


def shingle_bag(text: str | None) -> Counter:
    w = words(text)
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else Counter()


def near_classes(rows: list[tuple], threshold: float = 0.8) -> list[list[int]]:
    """Row numbers of each class, by comparing all pairs."""
    bags = [shingle_bag(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = sum((bags[i] & bags[j]).values())
            total = sum(bags[i].values()) + sum(bags[j].values()) - shared
            if total and shared >= threshold * total:
                parent[find(i)] = find(j)
    out = defaultdict(list)
    for i in range(len(rows)):
        out[find(i)].append(i)
    return list(out.values())


def passages(rows: list[tuple], items: list[tuple]) -> list[tuple]:
    """What decontamination must find, by looking for every window of every item."""
    windows = defaultdict(set)
    for i, text in items:
        w = words(text)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[a : a + k])].add(str(i))
    out = []
    for i, text, *_ in rows:
        w = words(text)
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if s := windows.get(tuple(w[a : a + k])):
                    found |= s - {"None"}
                    hit.update(range(a, a + k))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
