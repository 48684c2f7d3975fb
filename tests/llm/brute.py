"""Plain versions of the training-data operators, for small fixtures."""

from __future__ import annotations

import base64
import hashlib
import re

import xxhash

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def fingerprint(text: str | None, words: int = 4) -> int:
    parts = WORD.findall(ascii_lower(text or ""))
    shingles = [" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or ([" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes: list, linked) -> dict:
    """Smallest node reachable for each, by repeated passes over all pairs."""
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def simhash(docs: list[tuple[int, str | None]], radius: int = 4) -> dict[int, tuple[int, int]]:
    prints = {i: fingerprint(t) for i, t in docs}
    roots = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= radius)
    return {i: (prints[i], roots[i]) for i in prints}


def within_one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def line_dedup(docs: list[tuple[int, str | None]], least: int = 16) -> dict[int, str | None]:
    seen: dict[str, tuple[int, int]] = {}
    rows = {i: (t or "").split("\n") for i, t in docs}
    for i in sorted(rows):
        for pos, line in enumerate(rows[i]):
            if line.strip(SPACE):
                seen.setdefault(line, (i, pos))

    def stays(i: int, pos: int, line: str) -> bool:
        if not line.strip(SPACE):
            return True
        if seen[line] != (i, pos):
            return False
        return not any(at < (i, pos) and max(len(line), len(other)) >= least and len(line) >= least and len(other) >= least and within_one_edit(line, other) for other, at in seen.items())

    return {i: None if t is None else "\n".join(x for pos, x in enumerate(rows[i]) if stays(i, pos, x)) for i, t in docs}


def plain(text: str) -> str:
    return "".join(" " if ord(c) <= 32 else (c.lower() if len(c.lower()) == 1 else c) for c in text)


def best_edits(text: str, passage: str) -> int:
    """Least edits of the passage against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(passage, 1):
        last, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != p))
    return min(row)


def contaminated(text: str | None, passage: str | None, rate: float = 0.1) -> bool:
    """Whether the text holds the passage with edits of up to a tenth of its length."""
    passage = plain((passage or "").strip())
    if not passage or not text:
        return False
    return best_edits(plain(text), passage) <= int(rate * len(passage) + 1e-9)


def targets(sizes: dict, weights=(1, 2, 3), most: int = 3) -> dict:
    """Water filling: capped sources leave, the rest share what is left by weight."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    result, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > most * sizes[s]]
        if not over:
            return result | {s: share * weight[s] for s in free}
        for s in over:
            result[s] = float(most * sizes[s])
            left -= result[s]
            free.discard(s)
    return result


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda d, v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda d, v: all(int(x) <= 255 for x in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda d, v: 12 <= len(d) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda d, v: 9 <= len(d) <= 15),
    }
    found = []
    for number, (kind, (pattern, valid)) in enumerate(kinds.items()):
        found += [(m.start(), number, m.end(), kind) for m in re.finditer(pattern, text or "") if valid(re.sub("[^0-9]", "", m[0]), m[0])]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def repeated_passages(docs: list[tuple[int, str | None]], least: int = 51, within: bool = False) -> set[tuple[int, int, int]]:
    """(doc_id, start, end) of the united runs of `least` words that occur at another place."""
    words = {i: [w for w in WORD.findall(ascii_lower(t or ""))] for i, t in docs}
    places: dict[tuple, list] = {}
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            places.setdefault(tuple(w[k : k + least]), []).append((i, k))
    starts: dict[int, list[int]] = {}
    for at in places.values():
        if len(at) > 1 and (within or len({i for i, _ in at}) > 1):
            for i, k in at:
                starts.setdefault(i, []).append(k)
    found = set()
    for i, ks in starts.items():
        ks.sort()
        low = high = ks[0]
        for k in ks[1:]:
            if k > high + least:
                found.add((i, low, high + least))
                low = k
            high = k
        found.add((i, low, high + least))
    return found
