"""Document statistics, vectorised over the bytes of a batch of whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common
from quillstone.llm.common import _BYTE, _SPACE, SLICE_BYTES, batches, buffer_of, frugal, mix, run_hashes, shingle_hashes, slices, text_bytes, word_hashes, word_spans

WINDOW = 8
_CLASSES = ("other", "lower", "upper", "digit", "symbol", "stop", "bang", "continued", "wide", "space")
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 4
_CLASS[[ord(c) for c in ".,;:"]] = 5
_CLASS[[ord(c) for c in "!?"]] = 6
_CLASS[0x80:0xC0] = 7  # not the first byte of a code point
_CLASS[0xC0:] = 8
_CLASS[_SPACE] = 9

NAMES = (
    "n_chars_all", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ink_lines", "n_distinct_words",
    "n_same_next", "n_lower", "n_upper", "n_digits", "n_stops", "n_bangs", "n_wide", "n_bare_words", "n_caps_words",
)


def _owners(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _class_counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bytes of each class per document, worked out in steps of SLICE_BYTES."""
    m, k = len(off) - 1, len(_CLASSES)
    out = np.zeros(m * k, np.int64)
    for p in range(0, len(buf), SLICE_BYTES):
        q = min(p + SLICE_BYTES, len(buf))
        owner = np.repeat(np.arange(m), np.diff(np.clip(off, p, q)))
        out += np.bincount(owner * k + _CLASS[buf[p:q]], minlength=m * k)
    return out.reshape(m, k)


def _per_doc(flags: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
    return np.bincount(owner[flags], minlength=m)


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more, not the first of its kind) for each key, in place."""
    by = np.argsort(keys, kind="stable")
    same = keys[by][1:] == keys[by][:-1]
    late, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    late[by[1:]] = same
    twice[by[1:]] = same
    twice[by[:-1]] |= same
    return twice, late


def statistics(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """NAMES -> counts per document."""
    m = len(off) - 1
    classes = _class_counts(buf, off)
    kind = dict(zip(_CLASSES, classes.T, strict=True))
    starts, ends, first = word_spans(buf, off)
    owner = _owners(first)
    words = word_hashes(buf, starts, ends)
    salt = mix(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    # Words in windows that occur twice or more in their text.
    runs = shingle_hashes(words, WINDOW)
    inside = owner[: len(runs)] == owner[WINDOW - 1 :] if len(runs) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    twice, _ = _again(runs[at] ^ salt[owner[at]])
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    repeated = np.cumsum(cover[:-1]) > 0
    _, late = _again(words ^ salt[owner])
    same_next = np.zeros(len(words), bool)
    same_next[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    # Lines: each begins at a text's start or after \n.
    breaks = np.flatnonzero(buf == 10)
    line = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], breaks + 1]))
    line = line[line < len(buf)]
    line_owner = np.searchsorted(off, line, "right") - 1
    if len(line):
        value = _BYTE.copy()
        value[10] = 0
        size = np.diff(line, append=len(buf)) - (np.isin(np.append(line[1:], len(buf)) - 1, breaks))
        hashes = mix(run_hashes(buf, line, value) + size.astype(np.uint64))
        inked = np.searchsorted(starts, np.append(line[1:], len(buf))) > np.searchsorted(starts, line)
    else:
        hashes, inked = np.zeros(0, np.uint64), np.zeros(0, bool)
    _, late_line = _again(hashes[inked] ^ salt[line_owner[inked]])
    last = buf[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    head = buf[starts] if len(starts) else np.zeros(0, np.uint8)
    second = buf[np.minimum(starts + 1, len(buf) - 1)] if len(starts) else head
    return {
        "n_chars_all": classes.sum(1) - kind["continued"],
        "n_words": np.diff(first),
        "word_chars": classes.sum(1) - kind["continued"] - kind["space"],
        "n_symbols": kind["symbol"],
        "n_dup_lines": _per_doc(late_line, line_owner[inked], m),
        "n_repeat_words": _per_doc(repeated, owner, m),
        "n_lines": np.bincount(np.searchsorted(off, breaks, "right") - 1, minlength=m) + 1,
        "n_ink_lines": np.bincount(line_owner[inked], minlength=m),
        "n_distinct_words": np.diff(first) - _per_doc(late, owner, m),
        "n_same_next": _per_doc(same_next, owner, m),
        "n_lower": kind["lower"],
        "n_upper": kind["upper"],
        "n_digits": kind["digit"],
        "n_stops": kind["stop"],
        "n_bangs": kind["bang"],
        "n_wide": kind["wide"],
        "n_bare_words": _per_doc((_CLASS[last] == 4) if len(last) else np.zeros(0, bool), owner, m),
        "n_caps_words": _per_doc((_CLASS[head] == 2) & (_CLASS[second] == 2) & (ends - starts > 1), owner, m),
    }


def _run(parts):
    for part in parts:
        buf, off = buffer_of(part.column("text"))
        got = [statistics(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in slices(off)]
        cols = [pa.array(np.concatenate([g[name] for g in got]).astype(np.int64) if got else np.zeros(0, np.int64)) for name in NAMES]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], ["doc_id", *NAMES])


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and NAMES (long) per row of `docs`, over whole texts (null: empty); no shuffle."""
    batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(frugal(_run), "doc_id long, " + ", ".join(f"{n} long" for n in NAMES))


common.ship(__name__)
