"""Token ids of whole texts, and numbers of tokens through a chunk cache.

The byte-level pre-tokenizer always splits before a single space that stands
between two non-space characters, so a text may be cut there into chunks and
each chunk (with its space) encoded alone. Chunks repeat, so their lengths are
cached (``Counter``), but for long ones, which are encoded where they stand.
Where white space is adjacent to other white space the text is not cut, and the
encoder sees the whole run. Ids are made from whole texts (``Encoder``): looking
chunks up and joining their ids takes longer than merging them again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np

ADJACENT_SPACE = re.compile(r"\s\s")
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
CACHE_ENTRIES = 800_000
TEXTS_AT_ONCE = 128
PIECES_AT_ONCE = 2048
LONGEST_CHUNK = 64   # characters of a chunk that may be cached, counted or broadcast
DIVIDER = "<|endoftext|>"
UNSURE = re.compile("[\u0530-\U0010ffff]|<\\|")
#: Fixed value: how byte-level tokenizers split a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def chunks(text: str) -> list[str]:
    """Chunks of a text; every chunk but the first is preceded by one space."""
    return LONE_SPACE.split(text) if ADJACENT_SPACE.search(text) else text.split(" ")


class BoundedCache(dict):
    """Dict that computes missing values. When half of ``entries`` are new, the
    older half is dropped; what is asked for again in time is kept."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.half, self.older = make, max(1, entries // 2), {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Merger:
    """Ids of short pieces, as little-endian unsigned 32-bit integers.

    Pieces of the scripts up to Cyrillic are merged by tiktoken from the
    tokenizer's own vocabulary, which takes a third of the time: there both
    libraries agree on what is a letter, a digit or a space (tested for every
    character), and byte-pair merging has one result. All other pieces, and all
    if the file is no plain byte-level BPE in order of its merges, go to the
    tokenizer itself, many in one call: the closing token between them marks
    their ends, as it is cut out before anything else.
    """

    def __init__(self, path: str):
        self.tok, self.fast = load(path), _ranked(path)

    def __call__(self, pieces: list[str]) -> list[bytes]:
        if self.fast is None:
            return self._encoded(pieces)
        if not UNSURE.search("".join(pieces)):
            return self._merged(pieces)
        sure = [not UNSURE.search(p) for p in pieces]
        quick = iter(self._merged([p for p, x in zip(pieces, sure) if x]))
        other = iter(self._encoded([p for p, x in zip(pieces, sure) if not x]))
        return [next(quick) if x else next(other) for x in sure]

    def whole(self, text: str) -> bytes:
        """Ids of a text of any length: runs of chunks that both libraries read
        alike are merged in one call each, all other runs encoded in one."""
        if self.fast is None:
            return self._library(text)
        if not UNSURE.search(text):
            return self._quick(text)
        runs, space = [], ""
        for unsure, run in groupby(chunks(text), lambda c: UNSURE.search(c) is not None):
            runs.append((unsure, space + " ".join(run)))
            space = " "
        other = iter(self._encoded([r for unsure, r in runs if unsure]))
        return b"".join(next(other) if unsure else self._quick(r) for unsure, r in runs)

    def _library(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _quick(self, text: str) -> bytes:
        try:
            return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
        except ValueError:  # a run of a million blanks is beyond the stack of its pattern matcher
            return self._library(text)

    def _merged(self, pieces: list[str]) -> list[bytes]:
        try:
            ids = [self.fast.encode_ordinary(p) for p in pieces]
        except ValueError:
            return [self._quick(p) for p in pieces]
        ends = np.cumsum([4 * len(x) for x in ids]).tolist()
        data = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        return [data[a:z] for a, z in zip([0, *ends], ends)]

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(pieces), PIECES_AT_ONCE):
            part = pieces[i:i + PIECES_AT_ONCE]
            ids = np.asarray(self.tok.encode(DIVIDER.join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(ids == self.tok.token_to_id(DIVIDER))
            if len(ends) == len(part) - 1 and not any("<|" in p or "|>" in p for p in part):
                data, starts = ids.tobytes(), [0, *(4 * (ends + 1)).tolist()]
                out += [data[x:z] for x, z in zip(starts, [*(4 * ends).tolist(), len(data)])]
            else:  # a piece holds the token's own string
                out += map(self._library, part)
        return out


def _ranked(path: str):
    """The vocabulary as ranks for tiktoken, if its ids follow its merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    byte_level = (model["type"] == "BPE" and spec["normalizer"] is None and split.get("type") == "ByteLevel"
                  and split.get("use_regex") and not split.get("add_prefix_space")
                  and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")))
    merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
    vocab = model["vocab"]
    if not byte_level or any(vocab[m.replace(" ", "")] != 256 + i for i, m in enumerate(merges)):
        return None
    # byte-level files write each byte as one printable character
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(map(letters.__getitem__, t)): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class ChunkCache(dict):
    """Values of chunks. Unknown ones are learnt for many texts at once; when
    half of ``entries`` are new, the older half is dropped, but what is asked
    for again in time is kept. ``fixed`` is a first tier that never changes.
    Chunks over ``LONGEST_CHUNK`` characters stay until the next call only, so
    the cache is bounded in bytes too."""

    def __init__(self, learn, entries: int, fixed: dict | None = None):
        super().__init__()
        self.learn_all, self.half, self.older, self.fixed = learn, max(1, entries // 2), {}, fixed or {}
        self.long = {}

    def __missing__(self, chunk):
        return self.long[chunk] if len(chunk) > LONGEST_CHUNK else self.fixed[chunk]

    def learn(self, chunks: set[str]) -> None:
        new = chunks.difference(self.fixed).difference(self)
        long = [c for c in new if len(c) > LONGEST_CHUNK]
        self.long = dict(zip(long, self.learn_all(long)))
        new.difference_update(long)
        if len(self) + len(new) > self.half:
            self.older = dict(self)
            self.clear()
            new = {c for c in chunks.difference(self.fixed) if len(c) <= LONGEST_CHUNK}
        for c in [c for c in new if c in self.older]:
            self[c] = self.older[c]
            new.discard(c)
        todo = list(new)
        self.update(zip(todo, self.learn_all(todo)))


class _Texts:
    """Texts by their chunks: the first one, and those behind a space."""

    def __init__(self, learn, entries: int, fixed: dict | None = None):
        self.head = ChunkCache(learn, entries // 4)
        self.rest = ChunkCache(lambda chunks: learn([" " + c for c in chunks]), entries, fixed)

    def values(self, texts: list[str]) -> Iterator[tuple]:
        """(value of the first chunk, values of the rest) of every text."""
        for i in range(0, len(texts), TEXTS_AT_ONCE):
            cut = [chunks(t) for t in texts[i:i + TEXTS_AT_ONCE]]
            self.head.learn({parts[0] for parts in cut})
            self.rest.learn(set().union(*(parts[1:] for parts in cut)))
            for parts in cut:
                yield self.head[parts[0]], map(self.rest.__getitem__, parts[1:])


class Counter(_Texts):
    """Numbers of tokens; ``table`` holds lengths of frequent chunks."""

    def __init__(self, path: str, table: dict[str, int], entries: int = CACHE_ENTRIES):
        merge = Merger(path)
        super().__init__(lambda pieces: [len(x) // 4 for x in merge(pieces)], entries, table)

    def __call__(self, texts: list[str]) -> list[int]:
        return [first + sum(rest) for first, rest in self.values(texts)]


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.merge = Merger(path)

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        return map(self.merge.whole, texts)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder (a tokenizer and its vocabulary), kept while the worker lives."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
