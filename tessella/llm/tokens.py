"""Token ids of whole texts with a public byte-level BPE.

White space and the word after it form a unit; no pre-token of the tokenizer's pattern crosses the start of
a unit, so ids of units can be joined. Only texts with white space outside ASCII, which
the pattern may join across units, are encoded whole. Every text is followed by id 0.

The distinct units of a batch are encoded in a few calls, one after the other in one string: a unit that begins with
white space and ends with none has the same ids there as alone. Its tokens are found by their bytes.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textkit as K

#: Bytes of units that are encoded in one call.
CALL_BYTES = 1 << 20
ODD_SPACE = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Encoder:
    """Encodes batches; pickles as the vocabulary's name, so each worker loads it once."""

    def __init__(self, vocabulary: str = "byte_bpe_50k"):
        self.vocabulary = vocabulary
        self._load()

    def __getstate__(self) -> str:
        return self.vocabulary

    def __setstate__(self, vocabulary: str) -> None:
        self.__init__(vocabulary)

    def _load(self) -> None:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{self.vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding(self.vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))

    def _joined(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of units) of units that begin with white space and end with none."""
        data, offsets = K.bytes_view(units)
        cuts = np.unique(np.r_[np.searchsorted(offsets[:-1], np.arange(0, offsets[-1], CALL_BYTES)), len(units)])
        parts = [self.bpe.encode_ordinary(data[offsets[a] : offsets[z]].tobytes().decode()) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        ids = np.fromiter(chain.from_iterable(parts), np.uint32, sum(map(len, parts)))
        return ids, np.searchsorted(np.cumsum(self.sizes[ids]), offsets, "right")

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of rows), each row ending with id 0."""
        text = K.plain(text)
        whole = pc.match_substring_regex(text, ODD_SPACE).to_numpy(zero_copy_only=False)
        data, offsets = K.bytes_view(text)
        space = _SPACE[data]
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        at = np.flatnonzero(start)
        bounds = np.searchsorted(at, offsets)
        for r in np.flatnonzero(whole):
            start[offsets[r] + 1 : offsets[r + 1]] = False
        if whole.any():
            at = np.flatnonzero(start)
            bounds = np.searchsorted(at, offsets)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.r_[at, len(data)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = units.dictionary_encode()
        indices = coded.indices.to_numpy(zero_copy_only=False)
        chars, cut = K.bytes_view(coded.dictionary)
        alone = ~_SPACE[chars[cut[:-1]]] | _SPACE[chars[cut[1:] - 1]]
        alone[indices[bounds[:-1][whole]]] = True
        ids, parts = self._joined(coded.dictionary.filter(pa.array(~alone)))
        found = [self.bpe.encode_ordinary(u.decode()) for u in coded.dictionary.filter(pa.array(alone)).to_pylist()]
        found.append([0])
        alone = np.r_[alone, True]
        lengths = np.empty(len(alone), np.int64)
        lengths[~alone], lengths[alone] = np.diff(parts), np.fromiter(map(len, found), np.int64, len(found))
        first = np.empty(len(alone), np.int64)
        first[~alone], first[alone] = parts[:-1], len(ids) + np.cumsum(lengths[alone]) - lengths[alone]
        flat = np.r_[ids, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths[alone].sum()))]
        rows = len(bounds) - 1
        codes = np.empty(len(at) + rows, np.int64)
        ends = bounds[1:] + np.arange(rows)
        is_end = np.zeros(len(codes), bool)
        is_end[ends] = True
        codes[is_end] = len(alone) - 1
        codes[~is_end] = indices
        n = lengths[codes]
        ids = flat[np.repeat(first[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return ids, np.r_[0, np.cumsum(n)[ends]] if rows else np.zeros(1, np.int64)
