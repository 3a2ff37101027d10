"""Tokenizing with the `tokenizers` library through a bounded cache of units.

A unit is a stretch of text that the tokenizer's own pre-tokenizer always encodes by itself, whatever stands around it.
Each distinct unit goes through the library once while it is cached; a text that cannot be cut into such units goes through
the library whole, and so does one that holds an added token's content (`<|endoftext|>`), which the library takes for that token.
Ids are therefore always the library's, with its defaults but for add_special_tokens=False.
"""

from __future__ import annotations

import re
from functools import lru_cache, partial
from unicodedata import is_normalized

import numpy as np

from tenet.llm.common import KEPT

#: Where white space differs between Python's str.split and the pre-tokenizers' \s, texts go through the library whole.
ODD_BLANKS = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿\x00]")
#: No text has this character between units: the units that hold it are encoded alone.
MARK = "\x02"
#: Before a text's first word. Texts that have this character go through the library whole.
FIRST = "\x00"
nfc = partial(is_normalized, "NFC")
#: Latin letters, each of which is one in lower case, too, and the ASCII punctuation after them, which the lower-casing tokenizer's
#: pattern takes apart from them: no letter follows, so it is no contraction.
STEM = re.compile("([A-Za-zÀ-ÖØ-öø-įıĲ-ɏ]+)([!-/:-@\\[-`{-~]*)")
#: A cache is emptied at so many units; each takes about 200 bytes.
CACHE_UNITS = 600_000


class Encoder:
    """encode(texts) -> for each text its ids as little-endian bytes of the given width."""

    def __init__(self, path: str, dtype: str = "<u4", cache_units: int = CACHE_UNITS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype, self.cache_units = np.dtype(dtype), cache_units
        self.cache: dict[str, bytes] = {}
        #: Ids of stems and of what follows them.
        self.known: dict[str, bytes] = {}
        lower = self.library.normalizer is not None
        self.split = self._split_words if lower else self._split_spaced
        #: In lower case, as a normalizer may make them.
        self.added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.angled = all(a.startswith("<") for a in self.added)  # then most texts need no search
        #: Between joined units stands a mark that the pre-tokenizer always takes alone; its ids are found again in the result.
        self.mark = f" {MARK} " if lower else f" {MARK}"
        self.mark_ids = self.library.encode("a" + self.mark, add_special_tokens=False).ids[1:]
        #: Bytes that each id stands for (a byte is a character of a byte-level vocabulary), and whether a word may end with it.
        known = self.library.get_vocab(with_added_tokens=False)
        self.sizes, self.closes = np.zeros(max(known.values()) + 1, np.int64), np.ones(max(known.values()) + 1, bool)
        for token, i in known.items():
            self.sizes[i] = len(token.removesuffix("</w>") if lower else token)
            self.closes[i] = not lower or token.endswith("</w>")
        self.lower = lower

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, units: list[str]) -> list[bytes]:
        """Each unit's ids, from one call: the library's cost a call is many times that of a word."""
        joined = (" " if self.lower else "").join(units)
        return self.cut(joined, [len((u.lower() if self.lower else u).encode()) for u in units]) or self.marked(units)

    def plain(self, unit: str) -> bool:
        """May a unit be joined with others of its like, with nothing between them?"""
        return nfc(unit) if self.lower else unit[0] in " \n" and unit[-1] != "\n"  # line feeds might run together

    def cut(self, joined: str, sizes: list[int]) -> list[bytes] | None:
        """The ids of joined units, cut where the units' bytes end; None if any end is not that of an id."""
        ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=self.dtype)
        if not len(ids) or int(ids.max()) >= len(self.sizes):
            return None
        reached, ends = np.cumsum(self.sizes[ids]), np.cumsum(sizes)
        last = np.searchsorted(reached, ends)
        if last[-1] != len(ids) - 1 or (reached[last] != ends).any() or not self.closes[ids[last]].all():
            return None
        raw, width = ids.tobytes(), self.dtype.itemsize
        stops = ((last + 1) * width).tolist()
        return [raw[s:e] for s, e in zip([0, *stops[:-1]], stops, strict=True)]

    def marked(self, units: list[str]) -> list[bytes]:
        """As `apart`, with a mark between the units."""
        odd = [u for u in units if MARK in u or u[0] not in " \n"] if self.mark[-1] == MARK else [u for u in units if MARK in u]
        if odd:
            alone = dict(zip(odd, self.whole(odd), strict=True))
            rest = [u for u in units if u not in alone]
            alone.update(zip(rest, self.marked(rest) if rest else [], strict=True))
            return [alone[u] for u in units]
        ids = np.array(self.library.encode_batch_fast([self.mark.join(units)], add_special_tokens=False)[0].ids, dtype=self.dtype)
        n = len(self.mark_ids)
        at = np.flatnonzero(ids == self.mark_ids[-1])
        starts, ends = [0, *(at + 1).tolist()], [*(at - n + 1).tolist(), len(ids)]
        if len(starts) != len(units):
            return self.whole(units)
        raw, width = ids.tobytes(), self.dtype.itemsize
        return [raw[s * width : e * width] for s, e in zip(starts, ends, strict=True)]

    def units(self, text: str) -> list[str] | None:
        low = text.lower() if "<" in text or not self.angled else ""
        return None if low and any(a in low for a in self.added) else self.split(text)

    @staticmethod
    def _split_words(text: str) -> list[str] | None:
        """For a pre-tokenizer that drops white space: its words. Odd blanks: None."""
        return None if ODD_BLANKS.search(text) else text.split()

    @staticmethod
    def _split_spaced(text: str) -> list[str] | None:
        """For a byte-level pre-tokenizer, which binds one blank to the word after it: words, for each of which `spaced_unit` tells the
        unit, and two line feeds before a blank, which its pattern takes together. Other runs of white space: None."""
        if not text:
            return []
        if "  " in text or " \n" in text or "\n\n\n" in text or text[0] in " \n\t\r" or text[-1] == " " or text.endswith("\n\n") or ODD_BLANKS.search(text) or "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text:
            return None
        if "\n\n " not in text:
            return (FIRST + text.replace("\n", " \n")).split(" ")
        parts = [p.replace("\n", " \n").split(" ") for p in (FIRST + text).split("\n\n ")]
        return [*parts[0], *[w for p in parts[1:] for w in ("\n\n", *p)]]

    @staticmethod
    def spaced_unit(word: str) -> str:
        """The unit of a word of `_split_spaced`: with a blank before it, but for a text's first and those after a line feed."""
        return word[1:] if word[0] == FIRST else word if word[0] == "\n" else " " + word

    def stems(self, units: list[str]) -> tuple[list[tuple[str, str, str]], list[str]]:
        """Units with the lower-case stem and what follows it, of whose ids theirs are made; and which of these the library has yet to
        encode. Words differ more by case and punctuation than by their stems."""
        made = []
        for unit in units:
            match = STEM.fullmatch(unit)
            made.append((unit, match[1].lower(), match[2]) if match else (unit, unit, ""))
        return made, list({stem for _, stem, _ in made}.union(tail for *_, tail in made if tail).difference(self.known))

    def encode(self, texts: list[str]) -> list[bytes]:
        cache = self.cache
        for held in (cache, self.known):
            if len(held) > self.cache_units:
                held.clear()
        cut = [self.units(t) for t in texts]
        missing = list(set().union(*filter(None, cut)).difference(cache))
        made, into = [], cache
        if self.lower:
            made, missing = self.stems(missing)
            into = self.known
        pairs = [(k, k if self.lower else self.spaced_unit(k)) for k in missing]
        for fits, way in ((True, self.apart), (False, self.marked)):
            group = [p for p in pairs if self.plain(p[1]) == fits]
            for i in range(0, len(group), 4096):
                keys, units = zip(*group[i : i + 4096], strict=True)
                into.update(zip(keys, way(list(units)), strict=True))
        part = self.known.__getitem__
        cache.update([(unit, part(stem) + part(tail) if tail else part(stem)) for unit, stem, tail in made])
        got = cache.__getitem__
        return [b"".join(map(got, units)) if units is not None else self.whole([t])[0] for units, t in zip(cut, texts, strict=True)]


@lru_cache(maxsize=4)
def encoder(path: str, dtype: str = "<u4") -> Encoder:
    """One encoder a Python worker, kept between tasks."""
    return Encoder(path, dtype)


KEPT.append(encoder.cache_clear)
