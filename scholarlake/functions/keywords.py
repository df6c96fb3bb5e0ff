"""Keywords of many texts at once, over their bytes: the same ones as `text.keyword_tokens` finds by an expression."""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scholarlake.functions.text import CJK

_SIGNS = string.ascii_lowercase + string.digits
_BEGINS, _GOES_ON = (np.isin(np.arange(256), np.frombuffer(s.encode(), np.uint8)) for s in (_SIGNS, _SIGNS + "_-"))
#: Digits and marks only, or one sign five times in a row.
_NOISE = "^[0-9_-]+$|" + "|".join(c + "{5}" for c in _SIGNS + "_-")
_CJK_NOISE = re.compile(r"(.)\1{4}")


def _latin(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of words of two and more; the last byte belongs to none."""
    step = np.diff(_GOES_ON[data].view(np.int8), prepend=np.int8(0))
    begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    marked = np.flatnonzero(~_BEGINS[data[begins]])  # a word begins after the marks that stand before it
    if len(marked):
        can = np.append(np.flatnonzero(_BEGINS[data]), len(data))
        begins[marked] = np.minimum(can[np.searchsorted(can, begins[marked])], ends[marked])
    long = ends - begins >= 2
    return begins[long], ends[long]


def _cjk(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of runs of two and more signs of three bytes, U+4E00 to U+9FFF."""
    at = np.flatnonzero((data >= 0xE4) & (data <= 0xE9))
    at = at[at + 2 < len(data)]
    at = at[((data[at] > 0xE4) | (data[at + 1] >= 0xB8)) & (data[at + 1] & 0xC0 == 0x80) & (data[at + 2] & 0xC0 == 0x80)]
    first = np.diff(at, prepend=-9) != 3
    last = np.append(first[1:], True)[: len(at)]
    begins, ends = at[first], at[last] + 3
    long = ends - begins >= 6
    return begins[long], ends[long]


def keyword_places(texts: pa.StringArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, word, text): the different keywords of lower-cased texts, and for each place of one its word and its text.

    Each text ends with a byte that no keyword has, such as a line's end. Null texts have no keywords.
    """
    texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    begins, ends = _latin(data)
    cjk_begins, cjk_ends = _cjk(data)
    if len(cjk_begins):
        begins, ends = np.concatenate([begins, cjk_begins]), np.concatenate([ends, cjk_ends])
        order = np.argsort(begins, kind="stable")
        begins, ends = begins[order], ends[order]
    step = np.zeros(len(data) + 1, np.int8)
    step[begins] += 1
    step[ends] -= 1
    within = np.cumsum(step, dtype=np.int8)[:-1].astype(bool)
    cut = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int32)
    found = pa.StringArray.from_buffers(len(begins), pa.py_buffer(cut), pa.py_buffer(data[within])).dictionary_encode()
    noise = pc.match_substring_regex(found.dictionary, _NOISE).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(pc.match_substring_regex(found.dictionary, f"^[{CJK}]").to_numpy(zero_copy_only=False)):
        noise[i] = bool(_CJK_NOISE.search(found.dictionary[int(i)].as_py()))
    word = found.indices.to_numpy()
    kept = ~noise[word]
    text = np.searchsorted(offsets - offsets[0], begins[kept], side="right") - 1
    return found.dictionary, word[kept].astype(np.int64), text
