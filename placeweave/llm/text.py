"""Characters: look-alikes, invisible signs and the folding that other operators compare by."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex

# Signs that are not seen, blanks other than the plain one, hyphens other than the plain one.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u3164\ufe0e\ufe0f\ufeff\uffa0"
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\u2212\ufe63\uff0d"
ORDINALS = "ªº№"
# Letters of other alphabets and the Latin letters they look like: Cyrillic, Greek, Armenian, Coptic, Cherokee, Lisu.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ь": "b",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "ρ": "p", "υ": "u", "κ": "k", "γ": "y", "χ": "x", "ϲ": "c", "ϳ": "j",
    "в": "b", "к": "k", "м": "m", "н": "h", "т": "t",
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U",
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲭ": "X",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
#: Alphabets of LOOKALIKES.
SCRIPTS = ("Greek", "Cyrillic", "Armenian", "Coptic", "Cherokee", "Lisu")
# Signs that look alike within plain text, and phonetic letters like plain ones; they meet in the skeleton only.
ALIKE = {"0": "O", "1": "l", "I": "l", "|": "l", "m": "rn", "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʋ": "v", "ꞵ": "ß", "β": "ß", "’": "'", "‘": "'", "´": "'", "ʼ": "'"}
#: Letters that look like Latin ones in some types only: they stand for Latin beside Latin letters, and are no proof that a whole word is disguised.
WEAK = set("вкмнтЬαικργχνυ")

_ERASE = dict.fromkeys(map(ord, INVISIBLE))
_LINE_UP = _ERASE | dict.fromkeys(map(ord, BLANKS), " ") | dict.fromkeys(map(ord, HYPHENS), "-")
_TO_LATIN = {ord(k): v for k, v in LOOKALIKES.items()}
_SCRIPT = {name: regex.compile(rf"\p{{{name}}}") for name in SCRIPTS}
_FROM_LATIN = {name: {ord(v): k for k, v in reversed(LOOKALIKES.items()) if p.match(k) and k not in WEAK} for name, p in _SCRIPT.items()}
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_FOREIGN = regex.compile("[" + "".join(rf"\p{{{name}}}" for name in SCRIPTS) + "]")
_MARK = regex.compile(r"\p{M}")
_LATIN = regex.compile(r"\p{Latin}")


def prototype(ch: str) -> str:
    """The character's own prototype: its compatibility form for letters and digits, itself for punctuation and ordinal signs."""
    if ch in ORDINALS or unicodedata.category(ch)[0] not in "LN":
        return ch
    return unicodedata.normalize("NFKC", ch)


class _Prototypes(dict):
    """Table for str.translate, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        self[code] = got = prototype(chr(code))
        return got


_PLAIN = _Prototypes()


def prototypes() -> dict[int, str]:
    """The table of characters that a skeleton replaces, by rule and by list.

    By rule: letters and digits of compatibility (full-width, mathematical, circled,
    ligatures and the like) stand for what they decompose to. By list: letters of
    other alphabets, and signs alike within plain text. A prototype is replaced in
    its turn, so that a Greek I, a plain I and a 1 meet.
    """
    table = {code: p for code in range(0x80, 0x20000) if (p := prototype(chr(code))) != chr(code)}
    table |= {ord(k): v for k, v in LOOKALIKES.items()}
    table |= {ord(k): v for k, v in ALIKE.items()}

    def final(p: str) -> str:
        while (q := p.translate(table)) != p:
            p = q
        return p

    return {code: final(p) for code, p in table.items()} | _LINE_UP


@lru_cache(maxsize=1)
def _table() -> dict[int, str | None]:
    return prototypes()


def skeleton(text: str) -> str:
    """What the text looks like: decomposed, each character replaced by its prototype, decomposed again.

    Texts of equal skeleton look alike. Case and accents are kept, and full-width
    punctuation, which looks wider. `lookalikes.skeleton_of_ascii` says the same of
    ASCII inside the JVM.
    """
    decompose = unicodedata.normalize
    return decompose("NFD", decompose("NFD", text).translate(_table()))


def _genuine(word: str, script: str) -> bool:
    """Whether the word has a letter of the alphabet that looks like no Latin letter."""
    return any(ch not in LOOKALIKES for ch in _SCRIPT[script].findall(word))


def _one_alphabet(text: str) -> str:
    """Each word in one alphabet: disguised letters become what they stand for; words wholly of another alphabet stay."""
    if not _FOREIGN.search(text):
        return text
    words = [m.group() for m in _WORD.finditer(text)]
    real = {s for s in SCRIPTS for w in words if not _LATIN.search(w) and _genuine(w, s)}

    def settle(m: regex.Match) -> str:
        word = m.group()
        if not _FOREIGN.search(word):
            return word
        script = next(s for s in SCRIPTS if _SCRIPT[s].search(word))
        if _LATIN.search(word):
            if _genuine(word, script) and len(_SCRIPT[script].findall(word)) > len(_LATIN.findall(word)):
                return word.translate(_FROM_LATIN[script])
            return word.translate(_TO_LATIN)
        if script in real or _genuine(word, script) or any(ch in WEAK for ch in word):
            return word
        return word.translate(_TO_LATIN)

    return _WORD.sub(settle, text)


@lru_cache(maxsize=1 << 16)
def consistent_form(text: str) -> str:
    """The text in plain characters: composed accents, plain letters, digits, spaces and hyphens, nothing invisible.

    Full-width punctuation, ordinal signs, CJK characters and words wholly of one
    other alphabet stay. ASCII text is its own form.
    """
    if text.isascii():
        return text
    return _one_alphabet(unicodedata.normalize("NFC", text.translate(_LINE_UP).translate(_PLAIN)))


_SPECIAL = str.maketrans({"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ł": "l", "ı": "i"})


@lru_cache(maxsize=1 << 16)
def folded(text: str) -> str:
    """For comparison: consistent form, compatibility forms throughout, without case and accents, white space collapsed."""
    if not text.isascii():
        text = consistent_form(text)
        text = unicodedata.normalize("NFKD", text).casefold().translate(_SPECIAL)
        text = unicodedata.normalize("NFC", _LATIN_MARKS.sub(r"\1", text))
    else:
        text = text.lower()
    return " ".join(text.split())


_LATIN_MARKS = regex.compile(r"([\p{Latin}\p{Greek}\p{Cyrillic}])\p{M}+")
