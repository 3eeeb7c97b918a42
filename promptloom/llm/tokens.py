"""Token ids of whole texts with a public tokenizer, by cached words.

The vocabulary's tokenizer lower-cases, cuts at white space and by a pattern,
and merges inside each cut part only, so a text's ids are its parts' ids one
after another. Arrow does the cutting for a block of texts at once and finds the
distinct parts; a cache of bounded size holds parts' ids, and new parts go to
the merge table in one call. Texts that this short cut doesn't cover (letters
beyond Latin, control characters, the strings of special tokens) go through the
tokenizer as it is.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Where the tokenizer cuts a lower-case Latin text besides white space, fixed by the
# vocabulary file: contractions, runs of neither letters nor numbers, single numbers.
CUT = r"('(?:s|t|re|ve|m|ll|d)|[^\x09-\x0D\x20\p{L}\p{N}]+|[0-9²³¹¼½¾])"
# What only the tokenizer itself can normalise: beyond Latin letters, İ, and marks of special tokens.
ODD = r"[^\x09-\x0D\x20-\x7E\x{A1}-\x{12F}\x{131}-\x{24F}]|<\|"
# Parts kept in each of the two generations of the cache.
PARTS = 150_000
# Bytes of text that are cut together.
BLOCK = 3_000_000


def _byte_table() -> dict[int, int]:
    """Code points that stand for bytes: printable ones for themselves, the rest from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}


class PartTokenizer:
    """Little-endian unsigned 32-bit ids of texts, as bytes."""

    def __init__(self, path: str, parts: int = PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        suffix, vocab = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        bare = spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.bytes_as = _byte_table()
        self.parts = parts
        self.now: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    @cached_property
    def whole(self):
        """The tokenizer as it is; loaded only where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def exact(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, parts: list[str]) -> None:
        shown = [p if p.isascii() else p.encode().decode("latin-1").translate(self.bytes_as) for p in parts]
        ids = np.array(self.bare.encode_batch_fast([shown], is_pretokenized=True)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(parts):
            raise ValueError("the vocabulary doesn't mark each word's end")
        flat, ends = ids.tobytes(), (cuts * 4).tolist()
        self.now.update(zip(parts, [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def _of(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts."""
        found = list(map(self.now.get, parts))
        missing = [p for p, f in zip(parts, found, strict=True) if f is None]
        if len(self.now) + len(missing) > self.parts:
            self.old, self.now, missing = self.now, {"": b""}, [p for p in parts if p]
        new = []
        for p in missing:
            if (known := self.old.get(p)) is None:
                new.append(p)
            else:
                self.now[p] = known
        if new:
            self._learn(new)
        return list(map(self.now.__getitem__, parts)) if missing else found

    def _block(self, texts: pa.Array) -> Iterator[bytes]:
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(plain), CUT, r" \1 "))
        bounds = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        ids = pa.array(self._of(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        if not len(ids):
            ends, data = np.zeros(1, dtype=np.int64), b""
        else:
            ends = np.frombuffer(ids.buffers()[1], dtype=np.int64, count=len(ids) + 1)
            data = memoryview(ids.buffers()[2]) if ids.buffers()[2] else b""
        cuts = ends[bounds - bounds[0]].tolist()
        for i, is_odd in enumerate(odd.tolist()):
            yield self.exact(texts[i].as_py()) if is_odd else bytes(data[cuts[i] : cuts[i + 1]])

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text; null is empty."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + BLOCK)))
            yield from self._block(pc.fill_null(texts.slice(at, end - at), "").cast(pa.large_string()))
            at = end
