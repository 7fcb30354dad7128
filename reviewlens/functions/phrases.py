"""Phrase replacement on raw text: leftmost, longest phrase first, matched in the JVM.

The phrases are put into a trie, and the trie is written as one regular expression whose
branches differ in their first character, so matching does not slow down with the number of
phrases, and a phrase that is the beginning of another one gives way to it wherever the longer
one is there.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases in one expression at most; the pattern and the table are literals of the plan.
MAX_PHRASES = 20_000
APOSTROPHES = "'’"

# --- fixed values: English contractions, by rule -------------------------------------------
SUBJECTS = ("i", "you", "he", "she", "it", "we", "they", "that", "there", "this", "who", "what", "where", "how")
ENDINGS = {"'ll": "will", "'ve": "have", "'d": "would", "'re": "are", "'s": "is", "'d've": "would have", "'ll've": "will have"}
NEGATED = ("is", "are", "was", "were", "do", "does", "did", "have", "has", "had", "could", "would", "should", "might", "must", "need")
IRREGULAR = {"i'm": "i am", "can't": "cannot", "can't've": "cannot have", "won't": "will not", "won't've": "will not have",
             "shan't": "shall not", "ain't": "is not", "let's": "let us", "y'all": "you all", "ma'am": "madam", "o'clock": "of the clock",
             "'tis": "it is", "'twas": "it was", "'cause": "because", "gonna": "going to", "wanna": "want to", "gotta": "got to"}
# ---------------------------------------------------------------------------------------------


def contractions() -> dict[str, str]:
    """Contraction → long form: subjects with endings, negated verbs, and the irregular ones."""
    out = {s + e: f"{s} {w}" for s in SUBJECTS for e, w in ENDINGS.items()}
    out |= {f"{v}n't": f"{v} not" for v in NEGATED} | {f"{v}n't've": f"{v} not have" for v in NEGATED}
    return out | IRREGULAR


_APOSTROPHE = str.maketrans({c: "'" for c in APOSTROPHES})


def _key(phrase: str) -> str:
    """How phrases are compared: without case, all apostrophes alike, runs of white space as one space."""
    return " ".join(phrase.translate(_APOSTROPHE).lower().split())


def _literal(c: str) -> str:
    if c == "'":
        return f"[{APOSTROPHES}]"
    if c == " ":
        return r"\s+"
    return "\\" + c if not c.isalnum() else c


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def trie_pattern(phrases: list[str]) -> str:
    """One pattern for ``phrases`` (as ``_key`` gives them): whole words, the longest phrase that fits."""
    root: dict = {}
    for p in phrases:
        node = root
        for c in p:
            node = node.setdefault(c, {})
        node[""] = p

    def end(p: str) -> str:
        return r"(?!\w)" if _is_word(p[-1]) else ""

    def write(node: dict) -> str:
        """Node to pattern; chains are followed without recursion, so depth is that of the branching."""
        out = []
        while True:
            ends = node.get("")
            children = [(c, n) for c, n in node.items() if c]
            if ends is None and len(children) == 1:
                c, node = children[0]
                out.append(_literal(c))
                continue
            if not children:
                return "".join(out) + end(ends)
            # longer phrases first; the phrase that ends here is the last resort
            branches = [_literal(c) + write(n) for c, n in children] + ([end(ends)] if ends is not None else [])
            return "".join(out) + "(?:" + "|".join(branches) + ")"

    words = {k: v for k, v in root.items() if _is_word(k)}
    marks = {k: v for k, v in root.items() if not _is_word(k)}
    parts = ([r"(?<!\w)" + write(words)] if words else []) + ([write(marks)] if marks else [])
    return "(?iuU)(?:" + "|".join(parts) + ")"


_BUCKET, _ENTRY, _VALUE = "\x1d", "\x1e", "\x1f"


def _lookup(key: Column, table: Mapping[str, str]) -> Column:
    """``table[key]`` from one string constant: its few entries with the key's hash are split off and searched."""
    n = max(1, len(table) // 4)
    spread: list[list[str]] = [[] for _ in range(n)]
    for k, v in table.items():
        if {*k, *v} & {_BUCKET, _ENTRY, _VALUE}:
            raise ValueError(f"separator character in the phrase {k!r}")
        spread[zlib.crc32(k.encode()) % n].append(k + _VALUE + v)
    buckets = F.split(F.lit(_BUCKET.join(_ENTRY.join(b) for b in spread)), _BUCKET, -1)  # folded when the plan is made
    bucket = F.element_at(buckets, (F.crc32(key.cast("binary")) % n + 1).cast("int"))
    return F.try_element_at(F.str_to_map(bucket, F.lit(_ENTRY), F.lit(_VALUE)), key)


def replace_phrases(c: Column | str, table: Mapping[str, str], keep_case: bool = True) -> Column:
    """``c`` with each phrase of ``table`` replaced by its value: leftmost first, of several the longest.

    Phrases are whole (no letter, digit or ``_`` next to either end that is one), compared
    without case; any white space stands for a space, ``'`` and ``’`` are one. With ``keep_case`` a
    replacement of a capitalised phrase is capitalised. Replacements are not looked at again.
    The same phrase twice in the table (as compared) must have one value. Null stays null.
    """
    c = F.col(c) if isinstance(c, str) else c
    keyed: dict[str, str] = {}
    for phrase, value in table.items():
        k = _key(phrase)
        if not k:
            continue
        if keyed.setdefault(k, value) != value:
            raise ValueError(f"conflicting replacements of the phrase {k!r}")
    if not keyed:
        return c
    if len(keyed) > MAX_PHRASES:
        raise ValueError(f"{len(keyed)} phrases; one expression takes {MAX_PHRASES}: use several tables, split by the first word")
    pattern = trie_pattern(sorted(keyed))

    def replaced(m: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.translate(F.lower(m), APOSTROPHES, "'" * len(APOSTROPHES)), r"(?U)\s+", " "))
        value = F.coalesce(_lookup(plain, keyed), m)
        if not keep_case:
            return value
        first = F.substring(m, 1, 1)
        return F.when((first != F.lower(first)), F.concat(F.upper(F.substring(value, 1, 1)), F.substring(value, 2, 1 << 30))).otherwise(value)

    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    # ``split`` compiles its pattern for each row, so the matches are marked first and the marks split at
    marked = F.split(F.regexp_replace(c, pattern, _BUCKET), _BUCKET, -1)
    between = F.when(F.contains(c, F.lit(_BUCKET)), F.split(c, pattern, -1)).otherwise(marked)
    joined = F.zip_with(between, found, lambda text, m: F.concat(text, F.coalesce(replaced(m), F.lit(""))))
    return F.when(c.rlike(pattern), F.array_join(joined, "")).otherwise(c)
