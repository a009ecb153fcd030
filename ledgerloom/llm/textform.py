"""One consistent form for equal-looking text, and the words and shingles cut from it.

The form is computed by a longest-match transducer over grapheme clusters.  Its keys are letters with the accents that
follow them, of one or more characters: each of Unicode's composed letters, its accents in any order, also behind a letter that looks
like the plain one.  Widths and invisible characters are rules for single characters that it reads its input through.  Every state has an output for
words with a Latin letter and one for others, as only the former take look-alike letters.  All is precomputed from four rule families (widths,
accents, spaces and invisible characters, look-alikes); building fails if two want different outputs for one key, or if an output is not itself stable.
A text is walked once, from one stretch of white space to the next; plain ASCII pieces pass as they are and
the outputs of others are kept, as most come again.  Accents that no composed letter has are put in Unicode's order behind their letter.

Null text has no form (null); an empty text has the empty form.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable
from itertools import chain, permutations

import numpy as np
import regex
import xxhash

# Letters of other alphabets that are drawn like a Latin letter.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "ᴦ": "r",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Լ": "L", "Տ": "S",
    # Latin letters drawn like a plainer one
    "ɡ": "g", "ɑ": "a", "ı": "i", "ɩ": "i", "ſ": "f", "ɪ": "i",
}
# Characters without a picture that Unicode does not class as format or control characters.
BLANK_EXTRA = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
# Punctuation drawn like an ASCII character.
PUNCTUATION = {"‐": "-", "‑": "-", "․": ".", ";": ";", "։": ":", "∕": "/", "∶": ":"}
# Ranges of compatibility characters drawn like the letters they decompose to.
WIDTH_RANGES = ((0xFF01, 0xFF5E), (0xFF61, 0xFF9F), (0xFFE0, 0xFFEE), (0xFB00, 0xFB06), (0x2160, 0x217F), (0x1D400, 0x1D7FF))


def _is_blank(c: str) -> bool:
    """Invisible: format and control characters and variation selectors that are no white space."""
    if c.isspace():
        return False
    return unicodedata.category(c) in ("Cf", "Cc") or c in BLANK_EXTRA or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF


def build_rules() -> tuple[dict[str, str], dict[str, str], str, str]:
    """(rules for any word, rules for words with a Latin letter, invisible characters, white space)."""
    rules: dict[str, str] = {}

    def add(source: str, target: str) -> None:
        if rules.setdefault(source, target) != target:
            raise ValueError(f"two outputs for U+{ord(source):04X}")

    blanks, spaces = [], []
    for code in (*range(0x20000), *range(0xE0000, 0xE0200)):  # the planes between hold ideographs and unassigned codes only
        c = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        if c.isspace():
            spaces.append(c)
        elif _is_blank(c):
            blanks.append(c)
            add(c, "")
    for low, high in WIDTH_RANGES:
        for code in range(low, high + 1):
            wide = unicodedata.normalize("NFKC", chr(code))
            if wide != chr(code) and not _is_blank(chr(code)):
                add(chr(code), wide)
    for c, plain in PUNCTUATION.items():
        add(c, plain)
    latin = dict(LOOKALIKES)
    for source in latin:
        if source in rules:
            raise ValueError(f"two families map {source!r}")
    for target in [*rules.values(), *latin.values()]:
        for c in target:
            if c in rules or (c in latin and target in latin.values()):
                raise ValueError(f"output {target!r} is mapped again")
    return rules, latin, "".join(blanks), "".join(spaces)


RULES, LATIN_RULES, BLANKS, SPACES = build_rules()
INVISIBLE = frozenset(BLANKS)


class Transducer:
    """A trie over characters; each state has the outputs (in any word, in a word with a Latin letter) of the key that leads to it."""

    def __init__(self, single: dict[str, str], latin: dict[str, str]) -> None:
        self.single, self.latin = single, latin
        self.next: list[dict[str, int]] = [{}]
        self.output: list[tuple[str, str]] = [("", "")]
        self.given: dict[str, tuple[str, str]] = {}

    def add(self, key: str) -> None:
        """A letter with accents, or one that looks like another; each of its beginnings is a key too."""
        state = 0
        for i, c in enumerate(key):
            if (after := self.next[state].get(c)) is None:
                after = self.next[state][c] = len(self.next)
                self.next.append({})
                self.output.append(("", ""))
            state = after
            start = key[: i + 1]
            outputs = unicodedata.normalize("NFC", start), unicodedata.normalize("NFC", self.latin.get(start[0], start[0]) + start[1:])
            if self.given.setdefault(start, outputs) != outputs or unicodedata.normalize("NFC", outputs[0]) != outputs[0]:
                raise ValueError(f"two outputs for {start!r}")
            self.output[state] = outputs

    def read(self, cluster: str) -> tuple[str, str]:
        """The outputs for a cluster, longest keys first; what is no key passes as it is."""
        made: list[tuple[str, str]] = []
        state, loose = 0, False
        for c in cluster:
            for x in self.single.get(c, c):
                after = self.next[state].get(x)
                if after is None:
                    if state:
                        made.append(self.output[state])
                    after = self.next[0].get(x, 0)
                    if not after:
                        made.append((x, x))
                        loose = loose or not x.isascii()
                state = after
        if state:
            made.append(self.output[state])
        plain, latin = ("".join(part) for part in zip(*made)) if made else ("", "")
        return (unicodedata.normalize("NFC", plain), unicodedata.normalize("NFC", latin)) if loose else (plain, latin)


def build_transducer(single: dict[str, str], latin: dict[str, str]) -> Transducer:
    """From Unicode's canonical compositions: the letters they are of, look-alikes of these, and all orders of their accents."""
    made = Transducer(single, latin)
    alike: dict[str, list[str]] = {}
    for source, target in latin.items():
        made.add(source)
        alike.setdefault(target, []).append(source)
    for code in range(0xC0, 0x1_0000):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 1 or unicodedata.normalize("NFC", parts) != c or 0xAC00 <= code <= 0xD7A3 or any(x in single for x in parts):
            continue  # Hangul syllables are computed, not listed
        for marks in {"".join(m) for m in permutations(parts[1:])}:
            if unicodedata.normalize("NFC", parts[0] + marks) == c:
                for base in (parts[0], *alike.get(parts[0], ())):
                    made.add(base + marks)
    return made


_CLUSTER = regex.compile(r"\X")
_SCRIPT_LATIN = regex.compile(r"\p{Latin}")
TRANSDUCER = build_transducer(RULES, LATIN_RULES)


class _Clusters(dict):
    """cluster -> (output in any word, output in a word with a Latin letter, part of a word?, holds a Latin letter?)"""

    def __missing__(self, cluster: str) -> tuple[str, str, bool, bool]:
        plain, latin = TRANSDUCER.read(cluster)
        # composed look-alikes are taken apart for their letter
        latin = latin if latin.isascii() else unicodedata.normalize("NFC", "".join(LATIN_RULES.get(c, c) for c in unicodedata.normalize("NFD", latin)))
        word = not plain or all(unicodedata.category(c)[0] in "LMN" for c in plain)
        is_latin = any(_SCRIPT_LATIN.match(c) for c in unicodedata.normalize("NFD", plain))
        if len(self) > 100_000:
            self.clear()
        self[cluster] = found = plain, latin, word, is_latin
        return found


_clusters = _Clusters()


def transduce(piece: str) -> str:
    """The form of a text without white space, taken cluster by cluster."""
    out: list[str] = []
    word: list[tuple[str, str, bool, bool]] = []

    def close() -> None:
        out.extend(w[1 if any(x[3] for x in word) else 0] for w in word)
        word.clear()

    # an invisible character can stand between a letter and its accent, which makes clusters of both
    for cluster in _CLUSTER.findall(piece if INVISIBLE.isdisjoint(piece) else "".join(c for c in piece if c not in INVISIBLE)):
        found = _clusters[cluster]
        if found[2]:
            word.append(found)
        else:
            close()
            out.append(found[0])
    close()
    made = "".join(out)
    return made if unicodedata.is_normalized("NFC", made) else unicodedata.normalize("NFC", made)


class _Pieces(dict):
    """piece -> its form; short pieces are kept, as most come again."""

    def __missing__(self, piece: str) -> str:
        made = piece if piece.isascii() and piece.isprintable() else transduce(piece)
        if len(self) > 300_000:
            self.clear()
        if len(piece) < 64:
            self[piece] = made
        return made


_pieces = _Pieces()


def form(text: str | None) -> str | None:
    """The one form of all texts that look like this one; null for null."""
    if text is None:
        return None
    made = " ".join(filter(None, map(_pieces.__getitem__, text.split())))
    # an expansion can bring in white space (as of a spacing accent), which then collapses as well
    return made if made.isascii() else " ".join(made.split())


_MARKUP = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """The text's form without markup, its character references decoded."""
    made = form(text)
    if "<" in made:
        made = _MARKUP.sub(" ", made)
    return html.unescape(made) if "&" in made else made


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits of the text's form, without markup; none for null."""
    return _WORD.findall(plain(text).lower()) if text else []


class _PieceHashes(dict):
    """piece -> hashes of the words in it"""

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        made = tuple(map(xxhash.xxh3_64_intdigest, _WORD.findall(_pieces[piece].lower())))
        if len(piece) < 64:
            self[piece] = made
        return made


_piece_hashes = _PieceHashes()


def word_hashes(text: str | None) -> Iterable[int]:
    """64-bit hashes of the words, in order."""
    if not text:
        return ()
    if "<" in text or "&" in text or not _without_wide_markup(text):
        return map(xxhash.xxh3_64_intdigest, words(text))
    return chain.from_iterable(map(_piece_hashes.__getitem__, text.split()))


def _without_wide_markup(text: str) -> bool:
    return text.isascii() or not ("＜" in text or "＆" in text)


def hash_batch(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, number of words of each)."""
    parts = [np.fromiter(word_hashes(t), np.uint64) for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), sizes


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_batch(texts: Iterable[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): of each text the ascending distinct signed hashes of its runs of `size` words."""
    h, n = hash_batch(texts)
    doc = np.repeat(np.arange(len(n)), n)
    m = max(0, len(h) - size + 1)
    s = np.zeros(m, np.uint64)
    for i in range(size):
        s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m])
    inside = doc[:m] == doc[size - 1 : size - 1 + m]
    s, d = s[inside].view(np.int64), doc[:m][inside]
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return s[new], np.bincount(d[new], minlength=len(n)).astype(np.int64)
