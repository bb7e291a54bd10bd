"""Plain versions of the operators, on small fixtures: no Spark, no shared code."""

from __future__ import annotations

import hashlib
import re

LOWER = {c: c + 32 for c in range(65, 91)}


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def dedup(docs: list[tuple[int, bytes]], window: int = 100) -> dict:
    seen, out = set(), {}
    for doc_id, text in docs:
        gone = [False] * len(text)
        for i in range(len(text) - window + 1):
            part = text[i : i + window]
            if part in seen:
                gone[i : i + window] = [True] * window
            seen.add(part)
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def contamination(text: str | None, items: list[tuple[str, str | None]], window: int = 13) -> tuple:
    words_of = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    words = words_of((text or "").translate(LOWER))
    hit, found = [False] * len(words), set()
    for item, item_text in items:
        other = words_of((item_text or "").translate(LOWER))
        for k in range(max(len(other) - window, 0) + 1 if other else 0):
            phrase = other[k : k + window]
            for i in range(len(words) - len(phrase) + 1):
                if words[i : i + len(phrase)] == phrase:
                    found.add(item)
                    hit[i : i + len(phrase)] = [True] * len(phrase)
    ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), sum(hit), len(found), ids, sum(hit) > 0 and 20 * sum(hit) >= len(words)


ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text: str | None) -> tuple:
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    spans = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
    counts = tuple(sum(k == n for _, k, _ in found) for n in range(3))
    return *counts, hashlib.sha256(spans.encode()).hexdigest()


def shingles(text: str | None) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(docs: list[tuple[int, str | None]]) -> dict:
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return {doc_id: (len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(docs)}
