"""Plain answers that the operators must give: written for clarity, for small inputs only."""

from __future__ import annotations

import hashlib
import math
import re

import xxhash

SPACE = r"[^\x20\x09-\x0D]+"


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def simhash(text: str | None) -> int:
    words = re.findall(SPACE, lower_ascii(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(docs: list[tuple]) -> list[tuple]:
    """(doc_id, hex, component) by comparing all pairs."""
    prints = [simhash(t) for _, t in docs]
    comp = [d for d, _ in docs]
    changed = True
    while changed:
        changed = False
        for i in range(len(docs)):
            for j in range(len(docs)):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return [(d, f"{p:016x}", c) for (d, _), p, c in zip(docs, prints, comp, strict=True)]


def contamination(docs: list[tuple], items: list[tuple], width: int = 13) -> list[tuple]:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    split = lambda t: re.findall(word, lower_ascii(t or ""))
    windows: dict[tuple, set[str]] = {}
    for item_id, text in items:
        w = split(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item_id))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w = split(text)
        hit, ids = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    ids |= own
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def repeated_lines(docs: list[tuple], min_words: int = 50) -> dict:
    """Per doc_id the numbers of the lines with words in runs that occur at an earlier place, by all pairs of equal lines."""
    docs = sorted(docs, key=lambda d: d[0])
    seqs = [[(line.strip(" \t\n\r\x0b\x0c"), len(re.findall(SPACE, line)), at) for at, line in enumerate((t or "").split("\n")) if re.findall(SPACE, line)] for _, t in docs]
    places: dict[str, list[tuple[int, int]]] = {}
    for d, seq in enumerate(seqs):
        for i, (line, _, _) in enumerate(seq):
            places.setdefault(line, []).append((d, i))
    gone: dict = {d: set() for d, _ in docs}
    for d, seq in enumerate(seqs):
        done = set()
        for i, (line, _, _) in enumerate(seq):
            for e, j in places[line]:
                if (e, j) >= (d, i):
                    break
                if (e, i - j, i) in done:
                    continue
                a = i
                while a < len(seq) and a - i + j < len(seqs[e]) and seq[a][0] == seqs[e][a - i + j][0]:
                    done.add((e, i - j, a))
                    a += 1
                if sum(x[1] for x in seq[i:a]) >= min_words:
                    gone[docs[d][0]] |= {x[2] for x in seq[i:a]}
    return gone


def five_word_sets(text: str | None) -> set[tuple]:
    words = re.findall(SPACE, lower_ascii(text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)} - {()}


def near_copy_components(docs: list[tuple]) -> tuple[list, list[tuple[int, int]]]:
    """Component of each (doc_id, text), named by its smallest id, by comparing all pairs; and the pairs of similarity 0.8 or more."""
    sets, comp = [five_word_sets(t) for _, t in docs], [d for d, _ in docs]
    alike = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and 5 * len(a & b) >= 4 * len(a | b)]
    while any(comp[j] < comp[i] for i, j in alike):
        for i, j in alike:
            comp[i] = min(comp[i], comp[j])
    return comp, alike


def ranked_documents(items: list[tuple], docs: list[tuple], k: int = 50) -> list[tuple]:
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    terms = lambda t: [lower_ascii(w) for w in re.findall(word, t or "")]
    held = [(d, terms(t)) for d, t in docs]
    n_docs, total = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    out = []
    for item_id, text in items:
        own = set(terms(text))
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in w for _, w in held) + 1))) for t in own}
        found = []
        for d, w in held:
            m = 50 + (50 * len(w) * n_docs // total if total else 0)
            score = sum(weights[t] * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in own & set(w))
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item_id, r + 1, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(found)[:k])]
    return out


def manifest(rows: list[tuple], arity: int = 3) -> dict:
    """Per doc_id (leaf, subroot, root, siblings as (left, right) from the leaf up) of rows (doc_id, source, lang, n_chars, text)."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def climb(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
            for p, i in enumerate(at):
                run, own = runs[i // arity], i % arity
                paths[p].append(("".join(run[:own]), "".join(run[own + 1 :])))
            at, nodes = [i // arity for i in at], [sha("".join(r)) for r in runs]
        return nodes[0], paths

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(((r[0] is not None, r[0] or 0, leaf(r)) for r in rows if r[1] == s)) for s in sources}
    done = {s: climb([x[2] for x in tree]) for s, tree in trees.items()}
    root, over = climb([done[s][0] for s in sources])
    out = {}
    for s, upper in zip(sources, over, strict=True):
        for x, path in zip(trees[s], done[s][1], strict=True):
            out[(x[1] if x[0] else None, x[2])] = (done[s][0], root, path + upper)
    return out
