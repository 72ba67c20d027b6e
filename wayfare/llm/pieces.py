"""Splitting texts into the pieces of the usual byte-level BPE pattern, for a whole slice of documents at once.

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

The pattern's matches cover the text without gaps, so they are given by their starts, which follow from character
classes alone (asked of the library whose pieces are wanted, for every code point): numpy finds them for all texts of a slice together, several times faster than a regex engine does.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa

_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3
#: Code points that a library is asked for at once.
_ASKED = 4096


def _classes(matches: Callable[[str, str], str]) -> np.ndarray:
    """The class of every code point; matches(pattern, text) joins what a library's regex engine finds in the text."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, _OTHER, np.uint8)
    for a in range(0, len(every), _ASKED):
        for pattern, kind in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _SPACE)):
            out[np.frombuffer(matches(pattern, every[a : a + _ASKED]).encode("utf-32-le"), np.uint32)] = kind
    return out


@functools.cache
def tiktoken_classes() -> np.ndarray:
    """As the tiktoken library's patterns see them, whichever Unicode version it was built with."""
    import tiktoken

    @functools.cache
    def single_of(pattern: str) -> tiktoken.Encoding:
        return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})

    def matches(pattern: str, text: str) -> str:
        single = single_of(pattern)
        return single.decode_bytes(single.encode_ordinary(text)).decode()

    return _classes(matches)


@functools.cache
def tokenizers_classes() -> np.ndarray:
    """As the tokenizers library's patterns see them."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    def matches(pattern: str, text: str) -> str:
        left = Split(Regex(pattern + "+"), "removed").pre_tokenize_str(text)
        at = [0, *(x for _, span in left for x in span), len(text)]
        return "".join(text[a:b] for a, b in zip(at[::2], at[1::2]))

    return _classes(matches)


def starts_of(codes: np.ndarray, begins: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A mask of the pieces' starts in the concatenated code points of texts; begins: where each non-empty text begins."""
    n = len(codes)
    kind = classes[codes]
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    run = first[:-1].copy()  # a text's first character, and changes of class
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    ends_text = first[1:]
    out = run & ~space
    # white space: a run at a text's end is one piece; before anything else its last character stands apart
    out |= run & space
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:]
    last &= ~ends_text
    out |= last
    # a single blank goes with what follows it
    takes = np.flatnonzero(last & (codes == 32)) + 1
    out[takes] = False
    # contractions: an apostrophe that starts a piece, with letters after it
    q = np.flatnonzero((codes == 39) & out)
    q = q[q + 1 < n]
    q = q[(kind[q + 1] == _LETTER) & ~first[q + 1]]
    if len(q):
        a = codes[q + 1]
        has2 = (q + 2 < n) & ~first[np.minimum(q + 2, n)]
        b = np.where(has2, codes[np.minimum(q + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = np.zeros(len(q), bool)
        for pair in ("re", "ve", "ll"):
            two |= (a == ord(pair[0])) & (b == ord(pair[1]))
        size = np.where(one, 2, np.where(two, 3, 0))
        q, size = q[size > 0], size[size > 0]
        out[q + 1] = False  # the letters' run starts with the apostrophe
        after = q + size
        ok = after < n
        out[after[ok]] = True
    return out


def split(texts: list[str], classes: np.ndarray) -> list[list[str]]:
    """The pieces of each text, by the classes of a library."""
    whole = "".join(texts)
    if not whole:
        return [[] for _ in texts]
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    begins = (ends - sizes)[sizes > 0]
    mask = starts_of(codes, begins, classes)
    at = np.flatnonzero(mask)
    bounds = np.searchsorted(at, np.concatenate([ends - sizes, ends[-1:]])).tolist()
    at = at.tolist()
    at.append(len(whole))
    words = [whole[a:b] for a, b in zip(at, at[1:])]
    return [words[a:b] for a, b in zip(bounds, bounds[1:])]


def split_column(texts: pa.Array, classes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts (null: empty) in UTF-8, one after the other, and the number of pieces before each text and in all."""
    column = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    whole = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    codes = np.frombuffer(whole.tobytes().decode().encode("utf-32-le"), np.uint32)
    byte_of = np.flatnonzero((whole & 0xC0) != 0x80)  # where each code point begins
    begins = np.searchsorted(byte_of, offsets[:-1][offsets[1:] > offsets[:-1]])
    at = byte_of[starts_of(codes, begins, classes)]
    pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(whole))), pa.py_buffer(whole)])
    return pieces, np.searchsorted(at, offsets)
