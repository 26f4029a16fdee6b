"""Labelled training texts, put together at random from the words and sentence patterns of ``pii_words`` and invented values in English, German, Spanish and Chinese.

Patterns are a small grammar over parts of speech, so a sentence is drawn word by word; none is taken from a corpus. Some persons, and some things with capitalised
names, recur within a text, at places that tell what they are and at places that don't: that is what the skip potentials learn from.
"""

from __future__ import annotations

import base64
import random
import re
from functools import lru_cache
from pathlib import Path

from tallyloom.llm import pii_words as words
from tallyloom.llm.pii_crf import LABELS, SkipChain
from tallyloom.llm.pii_tokens import FAMILY_ZH, STREET_EN, tokens

_SLOT = re.compile(r"\{([A-Za-z]+\d*)(~C)?\}")
_SPLIT = re.compile(r"(?<! )\|(?! )|\n")
_PII = {"N": 5, "P": 2, "E": 1, "I": 3, "A": 4}
#: Shapes of phone numbers; # is a digit.
PHONES = {
    "en": "+1-###-###-####|+1 ### ### ####|1 (###) ###-####|1-###-###-####|(###) ###-####|###-###-####|###.###.####|##########|+44 1### ### ###|+44 (0)7### ######|+44 7### ######|+44 20 #### ####|+447#########|07### ######|07#########|01### ######|(01###) ######|(01###) ###-###|01### ### ###|0### ### ####|020 #### ####|+1-###-###-#### ext. ###|+1 (###) ###-####|1 (###) ### ####|+## ### ### ####",
    "de": "+49 ## #### ####|+49 ## ##### ###|+49 (0)## ######|(0##) #####-###|(0###) ######|0##/########|0049 ## ########|+49 (0)1## ##### ##|01## #######|01## ########|01##/#######|+49 1## #######|0049 1## #######|0## ######|0### #### ###|0### ######",
    "es": "+34 6## ### ###|+34 9## ### ###|(+34) 6## ### ###|0034 9## ### ###|0034 6########|6########|9## ### ###|9########|6##-###-###|6## ### ###|6## ## ## ##|+346########|7## ### ###",
    "zh": "1##########|1## #### ####|1##-####-####|+86 1## #### ####|00861##########|+861##########|0##-########|0###-#######|+86-1##########",
}
#: Shapes of identity numbers; # is a digit, @ a letter, $ either.
IDENTITIES = {
    "en": "###-##-####|###-##-####|### ## ####|###.##.####|#########|@@######@|@@ ## ## ## @|@@-##-##-##-@|@@###### @",
    "de": "@#$$$$$#$|@#$ $$$ $##|@##$$$@##|@#$$$$$#$|@########|###########|## ### ### ###|##/###/#####",
    "es": "########@|########-@|##.###.###-@|######## @|@#######@|@-#######-@|########|##.###.###",
    "zh": "######19##0#1####X|######19##0#1#####|######20##1#0#####|###### 19##0#1# ####",
}


#: Folder of public tokenizers, whose vocabularies give everyday words beside those of ``pii_words``. Needed on the driver only; without it such words are invented.
VOCABULARIES = "/opt/tokenizers"
#: Symbols of the grammar that now and then give way to such a word.
_OPEN = {"noun", "adj", "adje", "vi", "vt", "act", "see", "say", "adv", "with", "prep"}


@lru_cache(4)
def everyday_words(folder: str = VOCABULARIES) -> dict[str, tuple[list[str], list[str]]]:
    """Small and capitalised words of a language, from the vocabularies of public tokenizers."""
    out = {}
    for langs, file in ((("en",), "byte_bpe_50k.tiktoken"), (("de", "es"), "byte_bpe_multi_50k.tiktoken")):
        path = Path(folder) / file
        if not path.exists():
            continue
        found = [base64.b64decode(line.split()[0]).decode("utf-8", "ignore") for line in path.read_bytes().splitlines()]
        persons = set(words.GIVEN) | set(words.FAMILY)
        small = [w[1:] for w in found if re.fullmatch(r" [a-zäöüßñáéíóú]{3,}", w)]
        large = [w[1:] for w in found if re.fullmatch(r" [A-ZÄÖÜ][a-zäöüßñáéíóú]{3,}", w) and w[1:] not in persons]
        out |= {lang: (small, large) for lang in langs}
    return out


def _alternatives(text: str) -> list[str]:
    return [a.replace("\\n", "\n") for a in _SPLIT.split(text) if a]


GRAMMAR = {lang: {k: _alternatives(v) if isinstance(v, str) else v for k, v in g.items()} for lang, g in (("en", words.EN), ("de", words.DE), ("es", words.ES), ("zh", words.ZH))}


class Maker:
    """Random values, sentences and texts."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.everyday = everyday_words()

    # Values

    def digits(self, mask: str) -> str:
        r = self.r
        return "".join(r.choice("0123456789") if c == "#" else r.choice("ABCDEFGHJKLMNPRTVWXYZ") if c == "@" else r.choice("0123456789ABCDEFGHKLMNPRTWXYZ") if c == "$" else c for c in mask)

    def syllable(self) -> str:
        r = self.r
        return r.choice(words.ONSETS) + r.choice(words.VOWELS) + r.choice(words.CODAS)

    def coined(self, ends: list[str]) -> str:
        """A capitalised word that nobody has seen."""
        r = self.r
        x = r.random()
        if x < 0.35:
            s = r.choice(words.STARTS) + (r.choice(words.STARTS) if r.random() < 0.35 else "") + r.choice(ends)
        elif x < 0.7:
            s = self.syllable() + r.choice(ends)
        else:
            s = "".join(self.syllable() for _ in range(r.choice([1, 2, 2, 3])))
        return (s if len(s) > 1 else s + "na").capitalize()

    def capital(self) -> str:
        """Any capitalised word of a vocabulary."""
        r = self.r
        return r.choice(self.everyday[r.choice(["en", "de"])][1]) if "en" in self.everyday and "de" in self.everyday else self.coined(words.FAMILY_ENDS)

    def given(self) -> str:
        r = self.r
        x = r.random()
        return r.choice(words.GIVEN) if x < 0.3 else self.capital() if x < 0.5 else self.coined(words.GIVEN_ENDS)

    def family(self) -> str:
        r = self.r
        x = r.random()
        if x < 0.25:
            return r.choice(words.FAMILY)
        s = self.capital() if x < 0.45 else self.coined(words.FAMILY_ENDS)
        x = r.random()
        return "O'" + s if x < 0.03 else "Mc" + s if x < 0.05 else s

    def invented(self) -> str:
        r = self.r
        if r.random() < 0.5:
            return "".join(self.syllable() for _ in range(r.choice([1, 2, 2]))) + "n"
        return "".join(r.choice(words.STARTS) for _ in range(r.choice([1, 1, 2]))) + r.choice(words.WORD_ENDS)

    def everyday_word(self, lang: str) -> str:
        if lang not in self.everyday or self.r.random() < 0.25:
            return self.invented()
        # Words stand in order of how often they occur.
        return self.r.choice(self.everyday[lang][0][: self.r.choice([1000, 5000, 20_000])])

    def name(self, lang: str) -> str:
        r = self.r
        if lang == "zh":
            if r.random() < 0.08:
                return self.name("en")
            return (r.choice(words.FAMILY_ZH_MORE) if r.random() < 0.2 else r.choice(_FAMILY_ZH)) + "".join(r.choice(words.GIVEN_ZH) for _ in range(2 if r.random() < 0.85 else 1))
        g, s = self.given(), self.family()
        x = r.random()
        if lang == "es" and x < 0.4:
            s = f"{s} {self.family()}"
        elif x < 0.06:
            s = f"{r.choice(['van', 'von', 'de', 'di', 'van der', 'de la', 'zu', 'del'])} {s}"
        elif x < 0.1:
            s = f"{s}-{self.family()}"
        x = r.random()
        full = f"{s}, {g}" if x < 0.1 else f"{g} {r.choice('ABCDEFHJKLMNRST')}. {s}" if x < 0.2 else f"{g[0]}. {s}" if x < 0.29 else f"{s} {g}" if x < 0.32 else f"{g} {s}"
        x = r.random()
        cut = full.find(" ")
        if x < 0.04 and lang != "de":  # there it would look like an adjective before a noun
            return full[:cut] + full[cut:].lower() if x < 0.012 else full[:cut].lower() + full[cut:]
        return full.upper() if x < 0.1 else full.lower() if x < 0.22 else full

    def phone(self, lang: str) -> str:
        r = self.r
        s = self.digits(r.choice(_MASKS["phone", lang]))
        return s.translate(_WIDE) if r.random() < 0.06 else s

    def email(self, lang: str) -> str:
        r = self.r
        g, s = self.given().lower(), self.family().lower().replace("'", "")
        local = r.choice([f"{g}.{s}", f"{g}_{s}", f"{g[0]}{s}", f"{s}{r.randint(1, 99)}", f"{g}{r.randint(1950, 2010)}", f"{g}-{s[0]}", f"{g}.{s}+{self.invented()}", self.invented(), f"{g[0]}.{s}"])
        domain = f"{r.choice([self.invented(), r.choice(words.EN['noun']), r.choice(['mail', 'post', 'web', 'box', 'corp', 'example'])])}.{r.choice(['com', 'org', 'net', 'de', 'es', 'cn', 'example', 'test', 'invalid', 'co.uk', 'example.com', 'example.net'])}"
        x = r.random()
        dot = r.choice(["dot", "punkt", "punto"]) if lang in ("de", "es") else "dot"
        at = r.choice(["at", "ät", "arroba"]) if lang in ("de", "es") else "at"
        if x < 0.1:
            return f"{local} ({at}) {domain}"
        if x < 0.18:
            return f"{local} [{at}] {domain.replace('.', f' [{dot}] ')}"
        if x < 0.24:
            return f"{local.replace('.', f' {dot} ')} {at} {domain.replace('.', f' {dot} ')}"
        if x < 0.28:
            return f"{local} @ {domain}"
        if x < 0.31:
            return f"{local}%40{domain}"
        if x < 0.34:
            return f"{local}({at}){domain}"
        return f"{local}@{domain}".upper() if x < 0.39 else f"{local}@{domain}"

    def identity(self, lang: str) -> str:
        s = self.digits(self.r.choice(_MASKS["id", lang]))
        return s.lower() if self.r.random() < 0.1 else s

    def address(self, lang: str) -> str:
        r = self.r
        if lang == "zh":
            w = lambda n: "".join(r.choice(words.ROADS_ZH) for _ in range(n))
            city = f"{r.choice(words.ZH['city']) if r.random() < 0.5 else w(2)}市" if r.random() < 0.8 else ""
            area = f"{w(r.choice([1, 2, 2]))}{r.choice('区区县镇')}" if r.random() < 0.8 or not city else ""
            tail = r.choice(["", "", f"{r.randint(1, 30)}{r.choice('栋幢楼')}", f"{r.randint(1, 6)}单元{r.randint(101, 2502)}室", f"{r.randint(1, 20)}栋{r.randint(1, 6)}单元{r.randint(101, 2502)}室", f"{r.randint(1, 30)}楼"])
            return f"{city}{area}{w(r.choice([2, 2, 3]))}{r.choice(['路', '路', '路', '街', '大道', '巷', '弄'])}{r.randint(1, 300)}号{tail}"
        plain = {"en": words.EN["noun"], "de": words.DE["noun"], "es": words.ES["noun"]}[lang]
        word = lambda: self.family() if r.random() < 0.6 else r.choice(plain).capitalize()
        town = r.choice(words.PLACES) if r.random() < 0.3 else self.family() if r.random() < 0.8 else f"{r.choice(['New', 'Port', 'Bad', 'San', 'Saint', 'Upper'])} {self.family()}"
        n = str(r.randint(1, 1900) if r.random() < 0.4 else r.randint(1, 150)) + (r.choice("abcABC") if r.random() < 0.2 else "")
        if lang == "de":
            street = r.choice([f"{word()}{r.choice(['weg', 'straße', 'strasse', 'gasse', 'platz', 'ring', 'str.', 'allee', 'ufer', 'damm', 'stieg'])}", f"{word()}{r.choice(['weg', 'straße', 'gasse'])}", f"{r.choice(['Am', 'An der', 'Hinter dem', 'Im', 'Zum', 'Auf der', 'Unter den'])} {r.choice(['Alten', 'Neuen', 'Roten', '', ''])} {word()}".replace("  ", " "), f"{r.choice(['Alte', 'Lange', 'Neue', 'Große'])} {word()}{r.choice(['straße', 'gasse'])}", f"{word()}er {r.choice(['Straße', 'Weg', 'Platz', 'Allee'])}"])
            a = f"{street} {n}" + (f" {r.choice(['Haus', 'Whg.'])} {r.randint(1, 9)}" if r.random() < 0.06 else "")
            return a + (f", {self.digits('#####')} {town}" if r.random() < 0.7 else f", {town}" if r.random() < 0.2 else "")
        if lang == "es":
            street = f"{r.choice(['Calle', 'C/', 'Avda.', 'Paseo', 'Plaza', 'Avenida', 'Calle', 'Camino', 'Ronda', 'Carretera'])} {r.choice(['', '', 'de la ', 'del ', 'de las ', 'de '])}{word()}{r.choice(['', '', ' ' + word()])}"
            a = f"{street}{r.choice([', ', ', ', ' '])}{n}{r.choice(['', '', '', ', bajo', ', 3.º B', ', 2.º', ', piso 4'])}"
            return a + (f", {self.digits('#####')} {town}" if r.random() < 0.6 else f", {town}" if r.random() < 0.3 else "")
        a = f"{n} {word()}{r.choice(['', '', ' ' + word()])} {r.choice(_STREETS)}"
        a += r.choice(["", "", "", f", Unit {r.randint(1, 20)}", f", Apt {r.randint(1, 30)}{r.choice('ABC')}", f", Flat {r.randint(1, 30)}", f" #{r.randint(1, 90)}", f", Suite {r.randint(100, 900)}"])
        if r.random() < 0.75:
            a += f"{r.choice([', ', ', ', ', ', chr(10)])}{town}" + self.digits(r.choice(["", "", ", @@ #####", ", @@ #####", " @@## #@@", " @@# #@@", ", #####", ", @@"]))
        return a.lower() if r.random() < 0.04 else a.upper() if r.random() < 0.03 else a

    def leaf(self, k: str, lang: str) -> str:
        """A value that is no personal information."""
        r = self.r
        if k in _CODES:
            return self.digits(r.choice(_CODES[k]))
        if k == "n":
            return str(r.randint(1, 12) if r.random() < 0.3 else r.randint(2, 999))
        if k == "m":
            s = f"{r.uniform(1, 900):.2f}".replace(".", "," if lang in ("de", "es") and r.random() < 0.6 else ".")
            return r.choice([s, s, f"{s} euros" if lang == "es" else f"{s} Euro" if lang == "de" else f"${s}", s.split(".")[0].split(",")[0]])
        if k == "y":
            return str(r.randint(1900, 2030))
        if k == "ver":
            return r.choice(["v", ""]) + f"{r.randint(1, 15)}.{r.randint(0, 30)}.{r.randint(0, 30)}"
        if k == "ip":
            return ".".join(str(r.randint(1, 250)) for _ in range(4))
        if k == "date":
            return r.choice([f"{r.randint(1990, 2030)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}"])
        if k == "handle":
            return r.choice([f"{self.given()}_{self.invented()}", f"{self.family()}{r.randint(1, 99)}", f"{self.invented()}.{self.invented()}", self.given() + self.family()]).lower()
        if k == "url":
            return f"{r.choice(['www.', 'https://', ''])}{self.invented()}.{r.choice(['com', 'example', 'org'])}/{r.choice(['', self.invented(), 'a?id=' + self.digits('######')])}"
        if k == "invent":
            return self.everyday_word(lang)
        if k == "small":
            word = lambda: r.choice(GRAMMAR[lang]["noun"]).lower() if r.random() < 0.4 else self.everyday_word(lang)
            return r.choice([f"{word()} {word()}", f"{word()} {word()}", f"{word()} {word()} {word()}", f"{word()} {dict(en='and', de='und', es='y')[lang]} {word()}", word()])
        if k == "T":
            return self.family() if r.random() < 0.4 else self.given() if r.random() < 0.3 else self.capital()
        if k == "comp":
            a, b = r.choice(words.DE["noun"]), r.choice(words.DE["noun"])
            return a + b.lower()
        if k == "zhent":
            return "".join(r.choice(words.ROADS_ZH) for _ in range(2)) + r.choice("路街茶牌站店队厂湾区号堂屋园")
        if k == "zhmix":
            x = r.random()
            if x < 0.35:
                return "".join(r.choice(words.ZH["noun"])[-1 if i else 0] for i in range(2)) + r.choice(["", *"帽壶盒杯灯鞋包架垫机器"])
            if x < 0.5:
                return r.choice(_FAMILY_ZH) + r.choice(words.ZH["noun"])[-1] + r.choice(["", r.choice(words.COMMON_ZH)])
            return "".join(r.choice(words.COMMON_ZH) for _ in range(r.choice([1, 2, 2, 3, 4])))
        return {"given": self.given, "family": self.family, "place": lambda: r.choice(words.PLACES), "brand": lambda: r.choice(words.BRANDS)}[k]()

    # Sentences

    def expand(self, lang: str, text: str, known: dict, out: list, depth: int = 0) -> None:
        """Appends (piece, label number) of a pattern to out."""
        r = self.r
        at = 0
        for m in _SLOT.finditer(text):
            if m.start() > at:
                out.append((text[at : m.start()], 0))
            at = m.end()
            k, upper = m[1], m[2]
            start = len(out)
            if k in _PII:
                if k == "N":
                    v = r.choice(known["N"]) if known["N"] and r.random() < 0.45 else self.name(lang)
                    known["N"].append(v)
                else:
                    v = {"P": self.phone, "E": self.email, "I": self.identity, "A": self.address}[k](lang)
                out.append((v, _PII[k]))
            elif k in _OPEN and lang != "zh" and r.random() < 0.4:
                out.append((self.capital() if lang == "de" and k == "noun" else self.everyday_word(lang), 0))
            elif k in GRAMMAR[lang]:
                if k == "ent" and known["ent"] and r.random() < 0.4:
                    out.append((r.choice(known["ent"]), 0))
                else:
                    self.expand(lang, r.choice(GRAMMAR[lang][k]), known, out, depth + 1)
                    if k == "ent":
                        known["ent"].append("".join(p for p, _ in out[start:]))
            else:
                out.append((self.leaf(k, lang), 0))
            if upper and len(out) > start:
                p, label = out[start]
                out[start] = (p[:1].upper() + p[1:], label)
        if at < len(text):
            out.append((text[at:], 0))

    def sentence(self, lang: str, known: dict) -> tuple[str, list[tuple[int, int, int]]]:
        r = self.r
        kind = r.choices(["s", "code", "name", "phone", "email", "id", "addr"], [50, 18, 19, 4, 4, 4, 5])[0]
        out: list[tuple[str, int]] = []
        template = r.choice(GRAMMAR[lang][kind])
        # At an unclear place stands now a person, now a thing: only the rest of the text can tell.
        if lang != "zh" and r.random() < 0.06:
            template = r.choice(_UNCLEAR).replace("X", r.choice(["{N}", "{ent}", "{ent}", "{small}", "{small}"]))
        self.expand(lang, template, known, out)
        if kind == "s" and r.random() < 0.85 and out:  # a sentence begins with a capital as a rule
            out[0] = (out[0][0][:1].upper() + out[0][0][1:], 0)
        spans, at = [], 0
        for p, label in out:
            if label:
                spans.append((at, at + len(p), label))
            at += len(p)
        return "".join(p for p, _ in out).replace("{{", "{").replace("}}", "}") if "{{" not in template else _unbrace(out, spans), spans

    def document(self) -> tuple[str, list[tuple[int, int, int]]]:
        r = self.r
        lang = r.choices(["en", "de", "es", "zh"], [5, 3, 3, 3])[0]
        known: dict = {"N": [], "ent": []}
        text, spans = "", []
        for _ in range(r.randint(2, 9)):
            s, found = self.sentence(lang if r.random() < 0.95 else "en", known)
            x = r.random()
            if x < 0.04:
                s = s.upper() if len(s.upper()) == len(s) else s
            elif x < 0.07:
                s = s.lower() if len(s.lower()) == len(s) else s
            elif x < 0.1:
                tag = r.choice(["p", "b", "li", "td", "div"])
                k = len(tag) + 2
                s, found = f"<{tag}>{s}</{tag}>", [(a + k, b + k, label) for a, b, label in found]
            x = r.random()
            lead = ""
            if x < 0.12:
                lead = r.choice({"en": ["Q: ", "A: ", "Speaker: ", "Caller: ", "Support: "], "de": ["Anrufer: ", "Frage: ", "Antwort: "], "es": ["Pregunta: ", "Respuesta: ", "Soporte: "], "zh": ["问：", "答：", "来电："]}[lang])
            elif x < 0.18:
                lead = r.choice(["- ", "* ", "1. ", "📦 ", "> ", "# ", "| "])
            gap = "" if not text else "\n" if lead or r.random() < 0.2 else "\n\n" if r.random() < 0.1 else "" if lang == "zh" and r.random() < 0.8 else " "
            shift = len(text) + len(gap) + len(lead)
            spans += [(a + shift, b + shift, k) for a, b, k in found]
            text += gap + lead + s
        return text, spans


def _unbrace(out: list[tuple[str, int]], spans: list[tuple[int, int, int]]) -> str:
    """The text of pieces with doubled braces made single, the spans moved along."""
    text, at = "", 0
    spans.clear()
    for p, label in out:
        p = p if label else p.replace("{{", "{").replace("}}", "}")
        if label:
            spans.append((at, at + len(p), label))
        text += p
        at += len(p)
    return text


#: Places at which nothing tells a person from a thing.
_UNCLEAR = ["X", "X.", "(X)", "X, X", "- X", "X / X", "[X]", "X!", "X?", "X - X", "* X", "X;", "“X”", "| X |", "1. X", "re: X", "X etc."]
_WIDE = {ord(c): ord(c) + 0xFEE0 for c in "0123456789+-."}
_FAMILY_ZH = sorted(FAMILY_ZH)
_STREETS = sorted(s.capitalize() for s in STREET_EN) + ["Street", "Street", "Road", "Avenue", "Lane"]
_MASKS = {(kind, lang): masks.split("|") for kind, table in (("phone", PHONES), ("id", IDENTITIES)) for lang, masks in table.items()}
_CODES = {
    k: v.split("|")
    for k, v in {
        "c": "@@@-#######|@@@-#####|@@-######|@@@@-####|@#####|#######|@@@-##-####", "d5": "#####|####", "d6": "######|#####|#######", "d8": "########|#########", "d10": "##########|#######", "d12": "############|0034##############|00## #### ####|#### #### ####|################",
        "track": "1Z###@@@########|00340###############|@@#########@@|############", "item": "I######|I#####|#######", "art": "####-###-####|###.###.##|####-###-##|@@-####|###-####", "ean": "#############|000##########|########", "isbn": "978-#-##-######-#|978##########",
        "uid": "U####|U######|u_#####", "batch": "###-##-###@|###-###@|##-####|@-####-##", "stamp": "1#########|16########|1############", "model": "@@#-#@|@@-###|@@##|@##|@@@ ###|#@", "fl": "@@ ####|@@###|@@ ###",
    }.items()
}


def labelled(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[str], list[str], list[int]]:
    """Forms, classes and label numbers of a text's tokens."""
    forms, classes, starts, ends = tokens(text)
    labels = [0] * len(forms)
    for a, b, k in spans:
        for i in range(len(forms)):
            if starts[i] < b and ends[i] > a:
                labels[i] = k
    return forms, classes, labels


def training_data(m: Maker, documents: int) -> list[tuple[list[str], list[str], list[int]]]:
    data = []
    for _ in range(documents):
        forms, classes, labels = labelled(*m.document())
        # Now and then a word nobody has seen, so that its surroundings must tell.
        for i, c in enumerate(classes):
            if c in ("TITLE", "LOWER", "UPPER") and m.r.random() < 0.12:
                w = m.invented()
                forms[i] = w.capitalize() if c == "TITLE" else w.upper() if c == "UPPER" else w
        data.append((forms, classes, labels))
    return data


def train(documents: int = 16_000, seed: int = 11) -> SkipChain:
    """A field whose chain and skip potentials are trained together on ``documents`` made texts."""
    model = SkipChain()
    model.fit(training_data(Maker(seed), documents))
    return model


__all__ = ["LABELS", "Maker", "labelled", "train"]
