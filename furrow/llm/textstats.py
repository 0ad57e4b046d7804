"""Rule statistics of texts, a batch at a time. Words are runs of anything but the six ASCII white spaces."""

from __future__ import annotations

import numpy as np
import pandas as pd

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_STOPS = b".,;:!?"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_distinct", "n_lines", "n_upper", "n_digits", "n_stops", "n_bangs", "n_bars", "n_wide"]


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside 3-word windows that occur at least twice, the first occurrence included; distinct words."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    n = len(known)
    if len(words) < 4:
        return 0, n
    key = ids[:-1] * n + ids[1:]
    if n >= 2_000_000:
        key = np.unique(key, return_inverse=True)[1].reshape(-1)
    key = key[:-1] * n + ids[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0, n
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(key)] |= twice
    return int(covered.sum()), n


def counts(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` and ``MORE`` of one whole text; a NULL text counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    less = lambda drop: len(raw) - len(raw.translate(None, drop))
    repeat, distinct = repeated_words(words)
    return (
        len(words), len(text) - less(_SPACE), less(_SYMBOLS), len(lines) - len(set(lines)), repeat,
        distinct, len(lines), less(_UPPER), less(_DIGITS), less(_STOPS), raw.count(b"!"), raw.count(b"|"), len(raw) - len(text),
    )


def frame(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([counts(t) for t in texts], columns=COUNTS + MORE, index=texts.index, dtype="int64")


def ratios(c: pd.DataFrame) -> np.ndarray:
    """Scale-free statistics, one row per text, all finite; an empty text gives zeros."""
    words, chars = c["n_words"].to_numpy(float), c["word_chars"].to_numpy(float)
    per = lambda a, b: a / np.maximum(b, 1.0)
    col = lambda n: c[n].to_numpy(float)
    return np.column_stack(
        [
            np.log1p(words),
            per(chars, words),
            np.log1p(10 * per(col("n_symbols"), words)),
            np.log1p(10 * per(col("n_bangs"), words)),
            np.log1p(10 * per(col("n_bars"), words)),
            np.log1p(10 * per(col("n_digits"), words)),
            per(col("n_stops"), words),
            per(col("n_upper"), chars),
            per(col("n_wide"), chars),
            per(col("n_dup_lines"), col("n_lines")),
            per(col("n_repeat_words"), words),
            per(col("n_distinct"), words),
            np.log1p(per(words, col("n_lines"))),
        ]
    )
