"""Plain versions of the operators, for small inputs: no block, batch or sketch."""

from __future__ import annotations

import hashlib
import html.parser
import re

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def phrases(text: str) -> set[str]:
    seen, phrase = set(), ""
    for character in text:
        phrase += character
        if phrase not in seen:
            seen.add(phrase)
            phrase = ""
    return seen


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(texts: list[str]) -> list[str]:
    found = []
    for i, text in enumerate(texts):
        cut = len(text) // 4
        following = texts[(i + 1) % len(texts)]
        found.append(text[: len(text) - cut] + following[:cut])
    return found


def simhash(text: str | None, size: int) -> int:
    own = [w.lower() for w in words(text)]
    count = max(1, len(own) - size + 1) if own else 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(own[i : i + size]), 42) for i in range(count)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > count)


def components(ids: list[int], marks: list[int], radius: int) -> list[int]:
    labels = list(ids)
    near = [
        [j for j in range(len(ids)) if (marks[i] ^ marks[j]).bit_count() <= radius]
        for i in range(len(ids))
    ]
    changed = True
    while changed:
        changed = False
        for i, own in enumerate(near):
            least = min(labels[j] for j in own)
            if least < labels[i]:
                labels[i] = least
                changed = True
    return labels


def without_repeats(rows: list[tuple[int, str | None]], size: int) -> dict[int, tuple]:
    """id: (words, removed, kept) of rows in order."""
    seen: set[tuple] = set()
    found = {}
    for key, text in rows:
        own = words(text)
        gone = [False] * len(own)
        for i in range(len(own) - size + 1):
            window = tuple(own[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        kept = [w for w, g in zip(own, gone, strict=True) if not g]
        found[key] = (len(own), sum(gone), b" ".join(kept))
    return found


def nearest(ids: list[int], vectors: np.ndarray, query: int, count: int) -> list[tuple[int, float]]:
    own = vectors[ids.index(query)]
    scores = np.zeros(len(ids))
    for i in range(vectors.shape[1]):
        scores += own[i] * vectors[:, i]
    order = sorted((-s, i) for s, i in zip(scores.tolist(), ids, strict=True) if i != query)
    return [(i, -s) for s, i in order[:count]]


def targets_of(sizes: list[int], weights: list[float], most: int = 3) -> list[float]:
    """The total by weight; what is above ``most`` times a size is shared anew, again and again."""
    capped: set[int] = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = sum(sizes) - sum(most * sizes[i] for i in capped)
        shares = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        above = {i for i in free if shares[i] > most * sizes[i]}
        if not above:
            return [shares.get(i, float(most * sizes[i])) for i in range(len(sizes))]
        capped |= above


def best_sum(lengths: list[int], counts: list[int], budget: int) -> int:
    """The largest sum of so many documents that is not above the budget."""
    sums = {0}
    for length, count in zip(lengths, counts, strict=True):
        sums = {s + length * k for s in sums for k in range(count + 1) if s + length * k <= budget}
    return max(sums)


class ArticleParser(html.parser.HTMLParser):
    """The blocks inside the article of a page that marks its parts, by the library's parser."""

    BLOCKS = frozenset("p li ul div h1 article".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks, self.open, self.skipped = [""], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.open += 1
        if tag in ("script", "style", "aside", "form", "nav"):
            self.skipped += 1
        if tag in self.BLOCKS:
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.blocks.append("")
        if tag == "article":
            self.open -= 1
        if tag in ("script", "style", "aside", "form", "nav"):
            self.skipped -= 1

    def handle_data(self, data):
        if self.open and not self.skipped:
            self.blocks[-1] += data


def article_text(page: str | None) -> str:
    parser = ArticleParser()
    parser.feed(page or "")
    parser.close()
    return "\n".join(t for t in (" ".join(b.split()) for b in parser.blocks) if t)
