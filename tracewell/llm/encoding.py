"""Encoding texts with a public tokenizer's file, a batch at a time.

Pre-tokens never cross white space, so a text's ids are those of its
space-separated chunks one after another. Each distinct chunk of a batch is
looked up once, in a cache of two generations that is bounded in bytes: chunks
used again move to the younger one, and the older one goes when that is full.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: lower-case and upper-case letters of ASCII and Latin-1, then ASCII punctuation without the apostrophe
_PLAIN = re.compile(r"([a-zA-Zß-öø-ÿÀ-ÖØ-Þ]*)([!-&(-/:-@\[-`{-~]*)")
BATCH_CHARS = 3_000_000
CACHE_BYTES = 128 << 20
#: about what an entry of the cache takes besides its characters and ids
ENTRY_BYTES = 190


class Encoder:
    """ids of texts by ``tokenizers``, as ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.tokenize = self.whole.model.tokenize
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.limit = cache_bytes
        self.plain = _is_word_bpe(self.whole)
        # chunks and their ids as bytes of uint32
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _keep(self, chunk: str, ids: bytes) -> bytes:
        size = ENTRY_BYTES + len(chunk) + len(ids)
        if size > self.limit // 64:  # a very long chunk is not worth its place
            return ids
        if self.held + size > self.limit // 2:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[chunk] = ids
        self.held += size
        return ids

    def _part(self, part: str) -> bytes:
        """ids of a run of letters or of marks."""
        found = self.young.get(part)
        if found is None:
            found = self.old.get(part)
            if found is None:
                mapped = part if part.isascii() else self.bytes.pre_tokenize_str(part)[0][0]
                found = array("I", [t.id for t in self.tokenize(mapped)]).tobytes()
            self._keep(part, found)
        return found

    def _chunk(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is not None:
            return self._keep(chunk, found)
        if self.plain and chunk.isascii() and chunk.isalpha():
            return self._part(chunk.lower())
        m = _PLAIN.fullmatch(chunk) if self.plain else None
        if m is None:
            return self._keep(chunk, array("I", self.whole.encode(chunk, add_special_tokens=False).ids).tobytes())
        letters, marks = m.groups()
        if not marks:
            return self._part(letters.lower()) if letters else b""
        return self._keep(chunk, (self._part(letters.lower()) if letters else b"") + self._part(marks))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids (uint32) of all texts one after another, and the number of each text's ids; a null text has none."""
        texts = pc.fill_null(texts, "")
        # special tokens are told from text by their case, and their strings may hold anything
        odd = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        if not self.plain or odd.any():
            each = [self.whole.encode(t, add_special_tokens=False).ids if o or not self.plain else None for t, o in zip(texts.to_pylist(), odd, strict=True)]
            rest, counts = self._encode(texts.filter(pa.array(~odd))) if self.plain else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            cut = np.split(rest, np.cumsum(counts)[:-1]) if len(counts) else []
            other = iter(cut)
            arrays = [np.asarray(x, np.uint32) if x is not None else next(other) for x in each]
            return (np.concatenate(arrays) if arrays else rest), np.array([len(a) for a in arrays], np.int64)
        return self._encode(texts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lowered = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
        lists = pc.split_pattern(lowered, " ")
        chunks = lists.flatten()
        if not len(chunks):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = list(map(self.young.get, distinct))
        for k, ids in enumerate(found):
            if ids is None:
                found[k] = self._chunk(distinct[k])
        flat = np.frombuffer(b"".join(found), np.uint32)
        lens = np.fromiter(map(len, found), np.int64, len(found)) // 4
        index = coded.indices.to_numpy()
        first, lens = (np.cumsum(lens) - lens)[index], lens[index]
        ends = np.cumsum(lens)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - lens), lens)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return flat[at], np.diff(np.concatenate([[0], ends])[offsets])


def _is_word_bpe(tokenizer) -> bool:
    """Whether chunks may be encoded by themselves and plain words by the model alone: the pre-tokens are runs of letters, digits and the rest, lower-cased."""
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    alone = lambda t: [x.id for x in tokenizer.model.tokenize(t)]
    try:
        return ids("Lorem  ipsum\n dolor.") == alone("lorem") + alone("ipsum") + alone("dolor") + alone(".") and ids(" x") == ids("x")
    except Exception:  # a model that has no such pieces
        return False


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def batches(texts: pa.Array, most: int = BATCH_CHARS):
    """Slices (first, length) of texts with about ``most`` bytes each, at least one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for k, n in enumerate(sizes):
        if k > first and held + n > most:
            yield first, k - first
            first, held = k, 0
        held += int(n)
    if first < len(sizes):
        yield first, len(sizes) - first
