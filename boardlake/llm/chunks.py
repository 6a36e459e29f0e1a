"""Cuts a text at places where byte-level BPE with the usual pre-token pattern always cuts.

A single space or newline between two characters that aren't white space starts a new
pre-token there, whatever stands around it. So a text is the concatenation of chunks that
can be encoded one by one, and equal chunks (mostly one word) are encoded once per task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_OTHER_SPACE = re.compile("[\x00\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_SAFE = re.compile(r"(?<=\S)(?= \S)")


def _odd(text: str) -> bool:
    """Whether text has white space that isn't a single space or newline between other characters."""
    return bool(
        text[:1].isspace()
        or text[-1:].isspace()
        or "  " in text
        or "\n\n" in text
        or " \n" in text
        or "\n " in text
        or _OTHER_SPACE.search(text)
    )


def _marked(text: str) -> str:
    """text, which isn't odd, with a null character between its chunks."""
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0")


def cut(text: str) -> list[str]:
    """Chunks of text; joined they are text again."""
    return _SAFE.split(text) if _odd(text) else _marked(text).split("\0")


def chunked(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different chunks of all texts, the number of each text's chunks in that list one after another, and where each text's end."""
    if any("\0" in t for t in texts):
        cuts = [cut(t) for t in texts]
        flat, ends = pa.array([c for cs in cuts for c in cs], pa.string()), np.cumsum([len(cs) for cs in cuts])
    else:
        parts = pc.split_pattern(pa.array(["\0".join(_SAFE.split(t)) if _odd(t) else _marked(t) for t in texts], pa.string()), "\0")
        flat, ends = parts.flatten(), parts.offsets.to_numpy()[1:]
    told = flat.dictionary_encode()
    return told.dictionary.to_numpy(zero_copy_only=False).tolist(), told.indices.to_numpy(), ends


def laid_out(values: list[bytes], which: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """values[w] for each w of which, one after another as one array of this kind, and where each ends."""
    flat = np.frombuffer(b"".join(values), kind)
    size = np.fromiter(map(len, values), np.int64, len(values)) // flat.itemsize
    return spread(flat, np.cumsum(size) - size, size, which)


def spread(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of flat that start and size tell, for each number of which, and where each ends."""
    n = size[which]
    end = np.cumsum(n)
    if not len(end):
        return flat[:0], end
    return flat[np.repeat(start[which] - (end - n), n) + np.arange(end[-1])], end


class Encoded:
    """Chunk -> value, bounded: two generations of at most so many chunks. A full one becomes the
    older one, from which chunks that come again move over; losing a chunk costs time only."""

    def __init__(self, encode: Callable[[list[str]], Iterable], most: int = 250_000):
        self.encode, self.most, self.known, self.older = encode, most, {}, {}

    def values(self, chunks: list[str]) -> list:
        """The value of each of these different chunks."""
        found = list(map(self.known.get, chunks))
        lack = [i for i, v in enumerate(found) if v is None]
        if lack and len(self.known) + len(lack) > self.most:
            self.older, self.known = self.known, {}
        new = []
        for i in lack:
            if (value := self.older.get(chunks[i])) is None:
                new.append(i)
            else:
                found[i] = self.known[chunks[i]] = value
        if new:
            for i, value in zip(new, self.encode([chunks[i] for i in new]), strict=True):
                found[i] = self.known[chunks[i]] = value
        return found

    def flat(self, texts: list[str], kind: str) -> tuple[np.ndarray, np.ndarray]:
        """The values (bytes) of all texts' chunks as one array of this kind, and where each text ends."""
        chunks, which, ends = chunked(texts)
        out, upto = laid_out(self.values(chunks), which, kind)
        return out, np.concatenate([[0], upto])[ends]


def groups(texts: list[str], chars: int = 4_000_000) -> Iterable[tuple[int, int]]:
    """Slices of texts of about so many characters, to bound what one step holds."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
