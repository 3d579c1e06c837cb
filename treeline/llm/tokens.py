"""Token ids from a public tokenizer file, fast enough for whole corpora.

White space parts pre-tokens in the vocabularies used here, so a text's ids are those of its pieces between ASCII white
space. Some megabytes of text at a time are parted into pieces by Arrow, which also parts each distinct piece that is a
plain word with ASCII marks after it into word and marks. A distinct word in lower case is looked up once, and goes to
the library's BPE model directly if it is new, in the form that the file's normalizer and pre-tokenizer would give it;
every piece of another kind goes through the library's whole chain. The ids are laid out for all texts together.
"""

from __future__ import annotations

import gc
import json
import os
import re
import string
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words, and pieces of other kinds, that a worker remembers at most, the longest that it remembers, and the bytes of text that are parted at once (a longer text is parted alone): these bound memory, not results.
CACHE_PIECES, CACHE_CHARS, PART_BYTES = 900_000, 48, 3 << 20
#: Letters of Latin up to U+017F without those whose lower case or composition is not one letter.
_PLAIN = "[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž]"
_PLAIN_LETTERS = "".join(filter(re.compile(_PLAIN).fullmatch, map(chr, range(0x180))))
#: The chain of a file for which the short way holds.
_CHAIN = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte: itself if it is printable, else the next from U+0100 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    rest = sorted(set(range(256)) - own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_ID = attrgetter("id")


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if out.itemsize != 4:
        raise TypeError("a four-byte integer type is needed")
    return out.tobytes()


class PieceEncoder:
    """Encodes texts with the file at ``path``; special tokens' strings in a text are ordinary text."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [])
        steps_named = [x["type"] for x in norm.get("normalizers", [])], [x["type"] for x in steps], (steps or [{}])[0].get("pattern", {}).get("Regex")
        self.short = steps_named == _CHAIN and spec["model"]["type"] == "BPE"
        del spec  # before the library loads its own
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        # What plain words, marks after words and pieces of other kinds were found to be.
        self.words, self.marks, self.others = _Memory(), _Memory(), _Memory()

    def _long_way(self, pieces: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _of_words(self, words: list[str]) -> list[bytes]:
        tokenize = self.model.tokenize
        spelled = (w if w.isascii() else w.encode().decode("latin-1").translate(_LETTERS) for w in words)
        # Thousands of small lists and no cycles: the collector would only walk through all that is remembered.
        collecting = gc.isenabled()
        gc.disable()
        try:
            ids = [list(map(_ID, tokenize(w))) for w in spelled]
        finally:
            if collecting:
                gc.enable()
        flat, at, out = _packed(list(chain.from_iterable(ids))), 0, []
        for own in ids:
            upto = at + 4 * len(own)
            out.append(flat[at:upto])
            at = upto
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as unsigned 32-bit integers in the machine's order (little-endian here); nothing for null."""
        return [ids.tobytes() for flat, lengths in self.encode_column(pa.array(texts, pa.string())) for ids in np.split(flat, np.cumsum(lengths)[:-1])]

    def encode_column(self, texts: pa.Array, part_bytes: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of the next texts one after the other, number of ids of each) for runs of ``texts`` of about ``part_bytes``, PART_BYTES where it is not given."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (part_bytes or PART_BYTES), side="right")))
            yield self._encode(texts.slice(at, upto - at))
            at = upto

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        pieces = parts.flatten().dictionary_encode()
        store, sizes = self._distinct(pieces.dictionary)
        codes = pieces.indices.to_numpy()
        flat, ends = _gather(store, sizes, codes)
        # Ids before each text's first piece.
        bounds = np.concatenate([[0], ends])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        return flat, np.diff(bounds)

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``pieces`` one after the other, and how many each has."""
        words = pc.utf8_rtrim(pieces, characters=string.punctuation)
        plain = pc.match_substring_regex(words, f"^{_PLAIN}+$") if self.short else pa.array(np.zeros(len(pieces), bool))
        words = pc.utf8_lower(words.filter(plain)).dictionary_encode()
        marks = pc.utf8_ltrim(pieces.filter(plain), characters=_PLAIN_LETTERS).dictionary_encode()
        others = pieces.filter(pc.invert(plain))
        found = self.words.look_up(words.dictionary.to_pylist(), self._of_words)
        first_mark = len(found)
        found += self.marks.look_up(marks.dictionary.to_pylist(), self._long_way)
        first_other = len(found)
        found += self.others.look_up(others.to_pylist(), self._long_way)
        # Each piece is two runs of what was found: word and marks, or itself and nothing.
        found.append(b"")
        runs = np.full((len(pieces), 2), len(found) - 1, np.int64)
        is_plain = plain.to_numpy(zero_copy_only=False)
        runs[is_plain, 0], runs[is_plain, 1] = words.indices.to_numpy(), marks.indices.to_numpy() + first_mark
        runs[~is_plain, 0] = np.arange(first_other, first_other + len(others))
        store, ends = _gather(np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) >> 2, runs.ravel())
        return store, np.diff(ends[1::2], prepend=0)


class _Memory:
    """The ids of strings seen lately: what is in use passes from one generation of half CACHE_PIECES to the next."""

    def __init__(self) -> None:
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def look_up(self, strings: list[str], learn: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """What ``learn`` gives for each of the distinct ``strings``, from memory where they are there."""
        if len(self.now) > CACHE_PIECES // 2:
            self.before, self.now = self.now, {}
        now, before = self.now, self.before
        out = list(map(now.get, strings))
        lacking = [i for i, got in enumerate(out) if got is None]
        new = []
        for i in lacking:
            got = before.get(strings[i])
            if got is None:
                new.append(i)
            else:
                out[i] = now[strings[i]] = got
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for i, got in zip(some, learn([strings[i] for i in some]), strict=True):
                out[i] = got
                if len(strings[i]) <= CACHE_CHARS:
                    now[strings[i]] = got
        return out


def _gather(store: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``store`` that ``codes`` name, one after the other, and where each ends; run i has ``sizes[i]`` items and follows run i - 1."""
    firsts = (np.cumsum(sizes) - sizes)[codes]
    sizes = sizes[codes]
    ends = np.cumsum(sizes)
    where = np.repeat(firsts - (ends - sizes), sizes)
    where += np.arange(len(where))
    return store[where], ends


def with_end(flat: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and lengths with the id ``end`` after each text."""
    lengths = lengths + 1
    ends = np.cumsum(lengths) - 1
    out = np.empty(len(flat) + len(lengths), flat.dtype)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = flat, end
    return out, lengths


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One encoder a file and worker."""
    return PieceEncoder(path)


def vocabulary(name: str) -> str:
    """Where the public vocabulary file ``name`` lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
