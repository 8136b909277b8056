"""Whole texts to token ids with the tokenizers library, each distinct chunk of a worker's texts encoded once.

Texts are cut at single spaces and line ends. Both kinds of vocabulary used here start a new pre-token there, so the
ids of a text are those of its chunks, end to end; texts in which white space meets white space are encoded whole.
Many chunks go to the library as one string, with a separator between them that is always a pre-token of its own.
With ``added``, tokens that were added to the vocabulary (<|endoftext|>) are read as such where a text spells them out,
as by the library left as it is; such texts are encoded whole. Without it, they are ordinary text.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept by a worker, some 200 bytes each; beyond that it keeps those that came up again, which bounds its memory.
#: A job of several stages leaves them in its workers, so more are kept only where a query has the workers for itself.
MOST_CHUNKS = 350_000
#: White space as the vocabularies' patterns know it, without the space itself.
_WHITE = "\\t\\n\\x0b\\f\\r\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}"
_MEETS = f"[ {_WHITE}][ {_WHITE}]|^[ {_WHITE}]|[ {_WHITE}]$"
_OTHER_WHITE = re.compile("[\t\n\x0b\f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f]")
#: Chunks in a string for the library.
TOGETHER = 256
#: Chunks whose ids are looked up at a time, so that what lies between stays in the processor's cache.
STRIP = 1 << 15


def vocabulary(name: str) -> str:
    """Where a public vocabulary is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, end to end."""
    before = np.cumsum(size, dtype=np.int64) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


class Encoder:
    def __init__(self, path: str, added: bool = False, most: int = MOST_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.encode_special_tokens = not added
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.spaced = "use_regex" in (kind := self.tokenizer.pre_tokenizer.__repr__()) and "Split" not in kind
        self.mark = "\r" if self.spaced else " \x01 "
        self.mark_id = self.tokenizer.encode(self.mark, add_special_tokens=False).ids[0]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size, self.uses = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)

    def _shrink(self) -> None:
        """Keep the chunks that more than one batch had, or none if those are too many."""
        again = [c for c, i in self.known.items() if self.uses[i] > 1]
        known, ids, start, size = self.known, self.ids, self.start, self.size
        self._clear()
        if 0 < len(again) < self.most // 2:
            old = np.fromiter((known[c] for c in again), np.int64, len(again))
            self._store(again, ids[ranges(start[old], size[old])], size[old])

    def _store(self, chunks: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        n, m = len(self.known), len(chunks)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + m > len(self.start):
            self.start, self.size, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.uses))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[n : n + m] = self.used + np.cumsum(size) - size
        self.size[n : n + m] = size
        self.uses[n : n + m] = 0
        self.used += len(flat)
        self.known.update(zip(chunks, range(n, n + m), strict=True))

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int32, len(ids))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, end to end, and how many each has. Where a separator could be mistaken, texts go alone."""
        flat, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
        groups = [texts[at : at + TOGETHER] for at in range(0, len(texts), TOGETHER)]
        for at in range(0, len(groups), 64):
            some = groups[at : at + 64]
            joined = [self.mark.join(g) for g in some]
            for group, line, x in zip(some, joined, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                ids = np.array(x.ids, np.uint32)
                edges = np.flatnonzero(ids == self.mark_id)
                sound = line.count(self.mark.strip(" ")) == len(edges) == len(group) - 1 and not (self.spaced and _OTHER_WHITE.search(line))
                ids, sizes = (ids[ids != self.mark_id], np.diff(np.r_[-1, edges, len(ids)]) - 1) if sound else self._one_by_one(group)
                flat.append(ids)
                size.append(sizes)
        return np.concatenate(flat), np.concatenate(size)

    def _places(self, chunks: list[str]) -> np.ndarray:
        """Numbers of the chunks (all different) in the store; encodes those that aren't there yet."""
        out = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(out < 0)
        out[missing] = np.arange(len(missing)) + len(self.known)
        fresh = [chunks[i] for i in missing.tolist()]
        self._store(fresh, *self._encode(fresh))
        self.uses[out] += 1
        return out

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and the offset of each; ``end`` is appended to each text. Null counts as empty."""
        if len(self.known) > self.most:
            self._shrink()
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        n = len(texts)
        whole = np.zeros(n, bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if self.spaced:
            whole |= pc.match_substring_regex(texts, _MEETS).to_numpy(zero_copy_only=False)
        parted = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        split = pc.split_pattern(pc.replace_substring(parted, "\n", " \n " if self.spaced else " "), " ")
        at = split.offsets.to_numpy().astype(np.int64)
        at, values = at - at[0], split.flatten()
        coded = values.dictionary_encode()
        codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.spaced:
            first = np.zeros(len(codes) + 1, bool)  # chunks without a space before them
            first[at[:-1][np.diff(at) > 0]] = True
            if "\n" in words:
                lines = np.flatnonzero(codes == words.index("\n"))
                first[lines] = first[lines + 1] = True
            key = codes * 2 + first[:-1]
            there, of = np.zeros(2 * len(words), bool), np.empty(2 * len(words), np.int32)
            there[key] = True
            of[there] = self._places([words[c >> 1] if c & 1 else " " + words[c >> 1] for c in np.flatnonzero(there).tolist()])
            place = of[key]
        else:
            place = self._places(words)[codes]
        size, before = self.size[place], np.zeros(len(place) + 1, np.int64)
        np.cumsum(size, out=before[1:])
        ids, offsets = np.empty(before[-1], np.uint32), before[at]
        for lo in range(0, len(place), STRIP):
            some, sizes = place[lo : lo + STRIP], size[lo : lo + STRIP]
            ids[before[lo] : before[lo + len(some)]] = self.ids[ranges(self.start[some], sizes)]
        if whole.any() or end is not None:
            parts, lengths = [], np.diff(offsets)
            odd, odd_size = self._one_by_one([texts[int(i)].as_py() for i in np.flatnonzero(whole)])
            rest = iter(np.split(odd, np.cumsum(odd_size)[:-1]) if whole.any() else [])
            tail = np.array([] if end is None else [end], np.uint32)
            for i in range(n):
                own = next(rest) if whole[i] else ids[offsets[i] : offsets[i + 1]]
                lengths[i] = len(own) + len(tail)
                parts += [own, tail]
            ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
        return ids, offsets


@lru_cache(maxsize=2)
def encoder(name: str, added: bool = False, most: int = MOST_CHUNKS) -> Encoder:
    """One encoder of a vocabulary for each worker process."""
    return Encoder(vocabulary(name) if "/" not in name else name, added, most)


def forget() -> None:
    """Free the chunks that this worker process keeps, for stages that encode nothing."""
    encoder.cache_clear()


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


__all__ = ["MOST_CHUNKS", "Encoder", "crc", "encoder", "forget", "vocabulary"]
