"""Texts cut at blanks and line ends into pieces, a batch at a time in Arrow, so that equal pieces are encoded once.

A blank after a non-blank, and a line end between non-blanks, always begin a pre-token of byte-level BPE, so a
text's ids are those of its pieces one after another. A piece begins with a mark that tells what stands before
it: none for a blank, the line end itself, or ``HEAD`` for the start of the text. ``END`` closes each text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

HEAD, END = "\x03", "\x04"
#: White space by any of the readings of ``\\s`` in use.
_WS = "\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_WS_LESS_NL = "\\x09\\x0b-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: A word of letters up to U+02FF (letters in every Unicode version) and ASCII marks after it: two pre-tokens.
SIMPLE = re.compile(r"([A-Za-zªµºÀ-ÖØ-öø-ˁˆ-ˑˠ-ˤˬˮ]+)([!-/:-@\[-`{-~]*)").fullmatch
def blocks(batches, text: int, rows: int = 6_000, size_of_text: int = 8 << 20):
    """Record batches cut so that each has at most so many rows and, but for single rows, bytes of text."""
    for b in batches:
        at = 0
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < b.num_rows:
            upto = int(np.searchsorted(size, (size[at - 1] if at else 0) + size_of_text, side="right"))
            n = max(1, min(rows, upto - at))
            yield b.slice(at, n)
            at += n


class Cutter:
    """Cuts texts; those that can't be cut safely (blank runs, control marks, added tokens) are told apart."""

    def __init__(self, added):
        parts = [f" (?:[{_WS}]|\\z)", "\\n\\n(?:\\n|\\z)", f"\\n[{_WS_LESS_NL}]", f"[{_WS_LESS_NL}]\\n", f"[{HEAD}{END}]"]
        parts += ["".join(f"\\x{{{ord(c):x}}}" for c in s) for s in added]
        self.odd = "|".join(parts)

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
        """(whether odd, different pieces, each piece's place among these, where each text's pieces begin and end).

        Null is empty. An odd text has the pieces of an empty one.
        """
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd)
        plain = pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n")
        lists = pc.split_pattern(pc.binary_join_element_wise(HEAD, plain, " " + END, ""), " ")
        found = lists.flatten().dictionary_encode()
        return odd.to_numpy(zero_copy_only=False), found.dictionary, found.indices, lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()


def joined(values: list[bytes], indices: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """The pieces' values one after another, and where each text's begin and end in them."""
    taken = pa.array(values, pa.large_binary()).take(indices)
    at = np.frombuffer(taken.buffers()[1], np.int64)[: len(indices) + 1]
    data = taken.buffers()[2]
    return at[offsets], memoryview(data) if data is not None else memoryview(b"")
