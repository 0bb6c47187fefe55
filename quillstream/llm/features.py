"""Per-document quality features, vectorised over an Arrow batch of texts."""

from __future__ import annotations

import numpy as np

from .textkit import per_text, shingle_hashes, word_hashes, words

NAMES = (
    "log_bytes", "log_words", "mean_word", "upper_share", "digit_share", "space_share", "punct_share", "bang_share", "pipe_share",
    "symbol_share", "non_ascii_share", "distinct_words", "top_word_share", "adjacent_repeats", "distinct_lines", "distinct_shingles",
    "log_line", "stops_per_word", "short_words", "longest_word",
)


def _kind(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGIT, _SPACE = _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _kind("0123456789"), _kind(" \t\n\r\x0b\x0c")
_LETTER = _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_PUNCT, _SYMBOL = _kind(".,;:!?'\"()-|"), _kind("#$%&*@^~<>{}[]\\/=+_`")
_HIGH = np.arange(256) >= 128
_LINE = ~_kind("\n")


def _distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in each range, and the count of the most common one."""
    n = np.zeros(len(at) - 1, np.int64)
    top = np.zeros(len(at) - 1, np.int64)
    for i in range(len(n)):
        part = np.sort(hashes[at[i] : at[i + 1]])
        if len(part):
            edge = np.flatnonzero(part[1:] != part[:-1])
            n[i] = len(edge) + 1
            top[i] = np.diff(np.concatenate([[-1], edge, [len(part) - 1]])).max()
    return n, top


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of len(NAMES) float32 for each text; an empty text gives zeros."""
    n_bytes = np.diff(offsets)
    some = np.maximum(n_bytes, 1)
    share = lambda kind: per_text(kind[buf], offsets) / some
    starts, ends, at = words(buf, offsets)
    hashes, _ = word_hashes(buf, offsets)
    n_words = np.diff(at)
    some_words = np.maximum(n_words, 1)
    length = ends - starts
    distinct, top = _distinct(hashes, at)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[at[:-1][at[:-1] < len(same)]] = False
    l_starts, l_ends, l_at = words(buf, offsets, _LINE)
    from .textkit import range_hashes

    n_lines = np.diff(l_at)
    lines, _ = _distinct(range_hashes(buf, l_starts, l_ends, fold=False), l_at)
    sh, sh_at = shingle_hashes(hashes, at, 3)
    n_sh = np.diff(sh_at)
    d_sh, _ = _distinct(sh, sh_at)
    letters = np.maximum(per_text(_LETTER[buf], offsets), 1)
    longest = np.zeros(len(n_bytes))
    full = n_words > 0
    if full.any():
        longest[full] = np.maximum.reduceat(length, at[:-1][full])
    out = np.stack([
        np.log1p(n_bytes), np.log1p(n_words), per_text(length, at) / some_words, per_text(_UPPER[buf], offsets) / letters, share(_DIGIT), share(_SPACE),
        share(_PUNCT), share(_kind("!")), share(_kind("|")), share(_SYMBOL), share(_HIGH), distinct / some_words, top / some_words,
        per_text(same, at) / some_words, lines / np.maximum(n_lines, 1), d_sh / np.maximum(n_sh, 1), np.log1p(n_bytes / np.maximum(n_lines, 1)),
        per_text(_kind(".?")[buf], offsets) / some_words, per_text(length <= 3, at) / some_words, np.log1p(longest),
    ], axis=1).astype(np.float32)
    out[n_bytes == 0] = 0
    return out
