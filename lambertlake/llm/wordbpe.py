"""A byte-pair vocabulary with word ends, read from a tokenizers JSON file.

Holds what the counting and the encoding operator share: splitting a text into special
strings and words, spelling a word in byte symbols, and the merge ranks. Which characters are
letters, and what their lower case is, must be as in the library's Unicode tables: a text with
characters that Python's own tables don't know is normalised and split by the library.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import sys
import unicodedata

import regex
from tokenizers import Regex, normalizers, pre_tokenizers

from lambertlake.llm import runtime

#: Unicode white space, as the vocabulary's splitting pattern takes it.
SPACE = "\t-\r \x85\xa0  -     　"
#: Fixed value: the splitting pattern of the vocabulary file.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_symbols() -> list[str]:
    """The printable symbol that byte-level vocabularies use for each byte.

    Printable Latin-1 bytes stand for themselves; the others follow from U+0100 on.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


@functools.lru_cache(maxsize=1)
def unassigned() -> tuple[re.Pattern, re.Pattern]:
    """Two patterns: characters that Python's Unicode tables may not know, found fast, and those that they don't know."""
    kinds = itertools.groupby(range(sys.maxunicode + 1), lambda c: unicodedata.category(chr(c)) == "Cn")
    runs = [list(codes) for unknown, codes in kinds if unknown]
    ranges = [f"{re.escape(chr(r[0]))}-{re.escape(chr(r[-1]))}" for r in runs]
    low = "".join(x for x, r in zip(ranges, runs) if r[-1] < 0x10000)
    return re.compile(f"[{low}\U00010000-\U0010ffff]"), re.compile("[" + "".join(ranges) + "]")


class WordBpe:
    """Vocabulary, merge ranks and text splitting of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end: str = model["end_of_word_suffix"]
        self.ids: dict[str, int] = dict(model["vocab"])
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: (left, right) -> (rank, joined)
        self.merges: dict[tuple[str, str], tuple[int, str]] = {m: (rank, m[0] + m[1]) for rank, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids.update(self.special)
        self.strings = [""] * (1 + max(self.ids.values()))
        for token, i in self.ids.items():
            self.strings[i] = token
        self.byte = byte_symbols()
        self._words = regex.compile(WORDS)
        self._maybe_odd, self._odd = unassigned()
        self._library = None
        longest_first = sorted(self.special, key=len, reverse=True)
        self._split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None

    def words(self, text: str) -> list[str]:
        """Words of a text without special strings, normalised."""
        if not text.isascii() and (m := self._maybe_odd.search(text)) and self._odd.search(text, m.start()):
            return self._library_words(text)
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower-cased letter by letter, without the final form
            text = text.replace("Σ", "σ")
        return self._words.findall(text.lower())

    def _library_words(self, text: str) -> list[str]:
        if self._library is None:
            normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
            self._library = normal, pre_tokenizers.Split(Regex(WORDS), "removed", invert=True)
        normal, split = self._library
        return [word for word, _ in split.pre_tokenize_str(normal.normalize_str(text))]

    def pieces(self, text: str) -> list[str]:
        """Words and special strings in order; a special string is a piece of its own."""
        if self._split is None or "<|" not in text:
            return self.words(text)
        out: list[str] = []
        for k, part in enumerate(self._split.split(text)):
            if k % 2:
                out.append(part)
            elif part:
                out += self.words(part)
        return out

    def symbols(self, word: str) -> list[str]:
        """The word's bytes as symbols; the last one carries the word end."""
        out = list(map(self.byte.__getitem__, word.encode("utf-8", "surrogatepass")))
        out[-1] += self.end
        return out


@runtime.kept
def load(path: str) -> WordBpe:
    """One copy for each Python worker."""
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
