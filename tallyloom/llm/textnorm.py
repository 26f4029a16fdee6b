"""Word normal forms with offsets into the text as stored."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters of other scripts that look like a Latin one.
HOMOGLYPHS = str.maketrans(
    {
        "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
        "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "æ": "ae", "œ": "oe", "ß": "ss",
    }
)
#: Invisible characters that may stand inside a word.
INVISIBLE = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤︎️﻿"
#: A UTF-8 letter read as Latin-1: two characters stand for one.
_BROKEN = re.compile("[ÂÃ][\u0080-¿]")
_MARK = "̀-ͯ"
#: A word: a Chinese character, or letters, digits, marks and broken letters, also across invisible characters and a hyphen at a line's end; or a tag, an entity or the speaker that begins
#: a line, which are layout and skipped.
WORD = re.compile(
    rf"(?m:^)[^\W\d_]{{2,12}}[:：](?=\s)|<[/!]?[A-Za-z][^<>\n]*>|&(?:#\d{{1,7}}|#x[0-9A-Fa-f]{{1,6}}|[A-Za-z]{{2,12}});"
    rf"|[㐀-鿿]|(?:[ÂÃ][\u0080-\u00bf]|[^\W_㐀-鿿]|[{_MARK}])(?:[ÂÃ][\u0080-\u00bf]|[^\W_㐀-鿿]|[{_MARK}{INVISIBLE}]|['’](?=[^\W\d_])|-[ \t]*\r?\n[ \t>*]*(?=[^\W\d_A-Z]))*"
)
_DROP = re.compile(rf"[{_MARK}{INVISIBLE}'’\s>*-]+")


def _unbreak(m: re.Match) -> str:
    return m[0].encode("latin-1").decode("utf-8", "ignore")


def plain_word(word: str) -> str:
    """Lower case without marks, width, invisible, look-alike and broken letters."""
    if word.isascii() and word.isalnum():
        return word.lower()
    w = _BROKEN.sub(_unbreak, word)
    w = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", w)).casefold()
    w = _DROP.sub("", w.translate(HOMOGLYPHS))
    return "".join(c for c in w if not unicodedata.combining(c))


#: Spellings of one sound that English, German and Spanish writers exchange; applied in this order to both sides.
SPELLINGS = (("ae", "a"), ("oe", "o"), ("ue", "u"), ("our", "or"), ("ph", "f"), ("ck", "k"), ("sc", "sk"), ("c", "k"), ("y", "i"), ("z", "s"))
_DOUBLE = re.compile(r"([a-z])\1+")


def spelling_key(plain: str) -> str:
    """One key for the spellings of a word. Numbers keep all their digits."""
    if plain.isdigit():
        return plain
    for a, b in SPELLINGS:
        plain = plain.replace(a, b)
    return _DOUBLE.sub(r"\1", plain)


class Words:
    """Splits texts, remembering the normal form of words seen before."""

    def __init__(self, most: int = 200_000) -> None:
        self.known: dict[str, str] = {}
        self.most = most

    def __call__(self, text: str) -> tuple[list[str], list[int], list[int]]:
        """Spelling keys of the words of a text with their first and past-the-end offsets."""
        keys: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        known = self.known
        for m in WORD.finditer(text):
            raw = m[0]
            key = known.get(raw)
            if key is None:
                if raw[0] == "<" or raw[-1] in ":：":
                    key = ""
                elif raw[0] == "&":
                    key = spelling_key(plain_word(c)) if (c := html.unescape(raw)).isalnum() else ""
                else:
                    key = spelling_key(plain_word(raw))
                if len(known) < self.most and len(raw) < 50:
                    known[raw] = key
            if key:
                keys.append(key)
                starts.append(m.start())
                ends.append(m.end())
        return keys, starts, ends


def near(a: str, b: str) -> bool:
    """Whether two different keys differ by one slip: a letter changed, missing, added, or two neighbours exchanged. Short words and numbers must be equal."""
    la, lb = len(a), len(b)
    if min(la, lb) < 3 or abs(la - lb) > 1 or a.isdigit() or b.isdigit():
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    if la == lb:
        return x[1:] == y[1:] or (len(x) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])
    return (x[1:] == y) if la > lb else (x == y[1:])
