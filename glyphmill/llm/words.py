"""Words of whole Arrow batches: one pass in C per batch, so Python works on distinct words only.

Used inside Arrow functions; nothing here keeps more than one batch, besides the bounded cache."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a batch that are handled at once (a single longer text is handled alone).
PIECE = 4 << 20


def byte_table(is_word: Callable[[int], bool], lower: bool) -> bytes:
    """Byte translation: bytes that are no part of a word become a space; A-Z is lower-cased if asked."""
    return bytes((b + 32 if lower and 65 <= b <= 90 else b) if is_word(b) else 32 for b in range(256))


#: Words are runs of anything but white space, `[^\\x20\\x09-\\x0D]+`.
SPACED = byte_table(lambda b: b != 32 and not 9 <= b <= 13, lower=False)
SPACED_LOWER = byte_table(lambda b: b != 32 and not 9 <= b <= 13, lower=True)
#: Words are runs of ASCII letters, digits and anything beyond ASCII.
ALNUM_LOWER = byte_table(lambda b: b >= 128 or chr(b).isalnum(), lower=True)


def pieces(batch: pa.RecordBatch, text: int, piece: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `piece` bytes of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype="int64")
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + piece, "right")))
        yield batch.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()  # workers live on; what a batch needed goes back


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """The texts (null: empty) with every byte mapped by the table; an Arrow binary array."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return texts
    ends = np.frombuffer(texts.buffers()[1], "int64")[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes().translate(table) if ends[-1] > ends[0] else b""
    return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(data)])


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(code of every word, start of every text in the codes, distinct words by code) for words between single spaces.

    Empty words between two spaces are left out."""
    lists = pc.split_pattern(texts, " ")
    flat = pc.dictionary_encode(lists.flatten())
    codes, values = flat.indices.to_numpy(), flat.dictionary.to_pylist()
    starts = lists.offsets.to_numpy().astype("int64")
    starts -= starts[0]
    if b"" in values:
        keep = codes != values.index(b"")
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        codes = codes[keep]
    return codes, starts, values


def gather(codes: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Concatenation of the variable-length rows named by codes; row c is flat[sum(lens[:c]):][:lens[c]]."""
    first = np.concatenate([[0], np.cumsum(lens)])[:-1]
    n = lens[codes]
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[codes] - (ends - n), n)]


class Cache(dict):
    """A dict in two generations: when the young one holds `limit` entries it becomes the old one, and that is forgotten."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def fill(self, keys, compute: Callable[[list], list]) -> None:
        """Afterwards every key is present; those that neither generation holds are computed at once."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        new = []
        for k in keys:
            if k not in self:
                if k in self.old:
                    self[k] = self.old[k]
                else:
                    new.append(k)
        self.update(zip(new, compute(new)))


def kept_in_worker(key: str, make: Callable[[], object]) -> object:
    """An object made once per Python worker, which Spark reuses for many tasks."""
    store = sys.modules.setdefault("_glyphmill_worker", types.ModuleType("_glyphmill_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]
