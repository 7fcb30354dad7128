"""Plain versions of the operators, for comparison on small inputs."""

import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, k=3):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def simhash_components(rows, max_bits=2):
    """rows: (doc_id, text) -> {doc_id: (fingerprint, component)}."""
    fp = {i: fingerprint(t) for i, t in rows}
    first, u = {}, Union()
    for i, f in sorted(fp.items()):
        u.join(i, first.setdefault(f, i))
    distinct = sorted(first)
    for n, a in enumerate(distinct):
        for b in distinct[n + 1:]:
            if (a ^ b).bit_count() <= max_bits:
                u.join(first[a], first[b])
    return {i: (f, u.find(i)) for i, f in fp.items()}


def rule_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(hit))


def line_key(line):
    return " ".join(WORD.findall(line.lower()))


def removed_words(rows, min_documents, document=None):
    """rows: (doc_id, host, text) -> {doc_id: words in lines that more documents of the host hold}.

    ``document``: text -> what it counts as (the text itself, if not given).
    """
    held, document = {}, document or {}
    for _, host, text in rows:
        for k in {line_key(x) for x in (text or "").split("\n")} - {""}:
            held.setdefault((host, k), set()).add(document.get(text, text))
    over = {hk for hk, t in held.items() if len(t) > min_documents}
    return {i: sum(len(WORD.findall(x)) for x in (t or "").split("\n") if (h, line_key(x)) in over) for i, h, t in rows}
