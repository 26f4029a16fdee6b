"""Tokens of a text with offsets, for the recognition of personal information."""

from __future__ import annotations

import re
from functools import lru_cache

from tallyloom.llm.textnorm import INVISIBLE

_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|punkt|punto)\s?[)\]}]\s?|\s(?:dot|punkt|punto)\s)"
_AT = r"(?:\s?@\s?|%40|\s?[(\[{]\s?(?:at|ät|arroba)\s?[)\]}]\s?|\s(?:at|ät|arroba)\s(?=[\w-]+(?:\s(?:dot|punkt|punto)\s|\s?[(\[{]\s?(?:dot|punkt|punto)))|#at#)"
_PART = r"[A-Za-z0-9_+\-À-ÖØ-öø-ɏ]+"
_D = r"\d"
#: Token kinds in order of precedence. Most tokens are plain words, so these are tried first, where nothing after them could make them part of something else.
_KINDS = [
    ("PLAIN", r"[a-z]{3,}(?=[,;!?)]|[ \n](?!@|[(\[{]|(?:dot|punkt|punto|at|ät|arroba)\b))"),
    ("TAG", r"</?(?:p|br|b|i|u|em|strong|span|div|li|ul|ol|td|tr|th|table|h[1-6]|a|font)\b[^<>@]*>|&(?:#\d{1,7}|[a-z]{2,8});"),
    ("EMAIL", rf"(?<![A-Za-z0-9_.+-]){_PART}(?:{_DOT}{_PART})*{_AT}(?:[A-Za-z0-9\-À-ÖØ-öø-ɏ]+{_DOT})+[A-Za-z][A-Za-z0-9\-]+"),
    ("URL", r"(?:https?://|www\.)\S+|\b[A-Za-z0-9\-]+(?:\.[A-Za-z\-]+)+/\S*"),
    ("HANDLE", r"(?<![A-Za-z0-9])@\w[\w.]*"),
    ("CODE", r"(?<![A-Za-z0-9_])[A-Z]{3,5}-\d[\dA-Z-]*|(?<![A-Za-z0-9_])v\d+(?:\.\d+)+|(?<![A-Za-z0-9_])I\d{2,}(?![A-Za-z0-9])"),
    ("NINO", r"(?<![A-Za-z0-9_-])[A-Za-z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-Da-d](?![A-Za-z0-9])"),
    ("CARD", r"(?<![A-Za-z0-9_-])[A-Za-z](?=[0-9A-Za-z ]{8,10})(?=(?:\S ?){0,4}\d)\d[0-9A-Za-z] ?[0-9A-Za-z]{3} ?[0-9A-Za-z]{3}(?![A-Za-z0-9])"),
    ("NIE", r"(?<![A-Za-z0-9_-])[XYZxyz][- ]?\d{7}[- ]?[A-Za-z](?![A-Za-z0-9])"),
    ("DNI", r"(?<![A-Za-z0-9_.-])(?:\d{8}|\d{2}\.\d{3}\.\d{3})[- ]?[A-Za-z](?![A-Za-z0-9])"),
    ("CNID", r"(?<![A-Za-z0-9_-])\d{6} ?\d{8} ?\d{3}[\dXx](?![\dA-Za-z])"),
    ("ISODATE", r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"),
    ("NUM", r"(?<![A-Za-z0-9])(?:\(?\+\d{1,3}\)?[ .-]?|\d[ .-])?(?:\(\d{1,5}\)[ .-]?)?\d+(?:(?:[ .\-/]|\(0\) ?|\)[ .-]?)\d+)*(?:[A-Za-z](?![A-Za-z0-9]))?"),
    ("PLUSNUM", r"\(?\+[ ]?\d[\d ().\-/]*\d"),
    ("CJK", r"[㐀-鿿]"),
    ("WORD", rf"(?:[^\W\d_㐀-鿿]|[ÂÃ][-¿])(?:[^\W\d_㐀-鿿]|[̀-ͯ]|[ÂÃ][-¿]|['’](?=[^\W\d_])|-(?=[^\W\d_]))*\.?(?=(?:\W|\d|_|[㐀-鿿]|$))"),
    ("NL", r"\r?\n[ \t>*]*"),
    ("PUNCT", r"[^\w\s]|_"),
    ("OTHER", r"\S"),
]
TOKEN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _KINDS), re.IGNORECASE)
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20}
_HIDDEN = re.compile(f"[{INVISIBLE}]")

#: Words that end or begin a street's name, in English, German and Spanish.
STREET_EN = set("street st st. avenue ave ave. lane ln ln. road rd rd. close terrace row drive dr dr. boulevard blvd blvd. way court ct place pl square crescent gardens hill walk parkway".split())
STREET_DE = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "stieg", "ufer", "ring", "damm", "pfad")
STREET_ES = set("calle c avenida avda avda. av av. paseo plaza camino carretera ronda travesía".split())
#: Everyday words that announce a kind of information, as they stand on forms and letters.
CUES = {
    "TEL": set("tel tel. phone telephone mobile cell whatsapp fax landline call dial ring telefon telefonnummer rufnummer handy handynummer mobil festnetz anrufen wählen teléfono móvil celular llamar llame marcar marque tfno. 电 话 拨 致".split()),
    "MAIL": set("email e-mail mail mailto mailbox inbox correo mailadresse 邮 箱".split()),
    "IDNO": set("id ssn ni nino passport identity social insurance taxpayer steuer-id steuernummer ausweis ausweisnummer personalausweis reisepass passnummer dni nie nif pasaporte identidad documento 证 身 护".split()),
    "ADDR": set("address residence located adresse anschrift wohnort wohnt dirección domicilio sede residencia 址 住 寄".split()),
    "WHO": set("name mr mr. mrs mrs. ms ms. dr dr. miss prof. sir dear regards signed sincerely attn recipient sender frau herr herrn hallo liebe lieber grüße empfänger absender nombre señor señora sr. sra. don doña hola saludos firmado destinatario remitente 姓 名 叫".split()),
}
_CUE = {w: k for k, ws in CUES.items() for w in ws}
#: Words that announce numbers of things.
_OF_THINGS = set("batch lot ean sku isbn tracking parcel order invoice serial item article charge sendung bestellung rechnung artikel lote pedido factura envío artículo 单 批 货 运".split())
#: Frequent Chinese family names.
FAMILY_ZH = set("王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗高郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤温岑祝柏裴蔺冉桑宫鄢简阮庄翟施洪常卞凌霍路梅盛童欧单娄柯葛左")


@lru_cache(200_000)
def digit_groups(s: str) -> str:
    return "-".join(str(len(g)) for g in re.findall(r"\d+", s))


@lru_cache(200_000)
def token_class(kind: str, s: str) -> str:
    """A small class of a token by its form."""
    if kind in ("NUM", "PLUSNUM"):
        digits = sum(c.isdigit() for c in s)
        g = digit_groups(s)
        tail = "X" if s[-1].isalpha() else ""
        if tail and digits <= 4 and "-" not in g:
            return "HOUSE"
        if "+" in s:
            return "PLUS" if digits >= 8 else "NUMX"
        if re.fullmatch(r"\d{1,7}[.,]\d{1,2}", s):
            return "PRICE"
        if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", s) and not re.fullmatch(r"\d{3}\.\d{2}\.\d{4}", s):
            return "DOTTED"
        if digits <= 4 and "-" not in g:
            return f"N{digits}"
        if "(" in s:
            return "BRACKET" if digits >= 8 else "NUMX"
        if tail:
            return "NUMTAIL"
        if "-" not in g:
            zero = "Z" if s.startswith("00") and digits > 9 else ("T" if s[0] == "0" else "")
            return f"L{min(digits, 18)}{zero}" + ("M" if digits == 11 and s[0] == "1" else "")
        return f"G{g}" if len(g) <= 9 else "GLONG"
    if kind == "WORD":
        low = s.lower()
        if low in _CUE:
            return "C_" + _CUE[low]
        if low in _OF_THINGS:
            return "THING"
        if low in STREET_EN:
            return "STREET"
        if low in STREET_ES:
            return "STREETES"
        if any(low.endswith(x) for x in STREET_DE) and len(low) > 5:
            return "STREETDE"
        if len(s.rstrip(".")) == 1:
            return "INITIAL" if s[0].isupper() else "LETTER"
        if s.isupper():
            return "UPPER"
        if s[0].isupper():
            return "TITLE"
        return "LOWER"
    if kind == "CJK":
        if s in _CUE:
            return "C_" + _CUE[s]
        if s in _OF_THINGS:
            return "ZHTHING"
        for k, chars in (("ZHCITY", "市省县"), ("ZHAREA", "区镇乡"), ("ZHROAD", "路街巷弄道"), ("ZHNO", "号"), ("ZHUNIT", "栋单元室楼幢"), ("ZHEND", "了到在是于")):
            if s in chars:
                return k
        return "ZHFAM" if s in FAMILY_ZH else "ZH"
    if kind == "PUNCT":
        return {"，": ",", "：": ":", "（": "(", "）": ")", "。": ".", "｜": "|"}.get(s, s) if s in ",:;.()<>|=\"'{}[]*#?!@/，：（）。｜-_+%" else "P"
    return kind


def tokens(text: str) -> tuple[list[str], list[str], list[int], list[int]]:
    """Forms, classes, first and past-the-end offsets. Wide letters are narrowed and invisible characters passed over; offsets are those of the text as stored."""
    flat = text.translate(_WIDE)
    back: list[int] | None = None
    if _HIDDEN.search(flat):
        back = [i for i, c in enumerate(flat) if c not in INVISIBLE]
        flat = "".join(flat[i] for i in back)
    forms, classes, starts, ends = [], [], [], []
    for m in TOKEN.finditer(flat):
        kind, s = m.lastgroup, m[0]
        a, b = m.span()
        if kind == "PLAIN":
            forms.append(s)
            classes.append(token_class("WORD", s))
            starts.append(a)
            ends.append(b)
            continue
        if kind == "NUM" and s[0] == "(" and s.count("(") > s.count(")"):
            a, s = a + 1, s[1:]
        elif kind == "PLUSNUM" and s[0] == "(" and ")" not in s:
            a, s = a + 1, s[1:]
        if kind == "WORD" and s[-1] == "." and len(s) > 2 and s.lower() not in _CUE and s.lower() not in STREET_EN and s.lower() not in STREET_ES:
            b, s = b - 1, s[:-1]
            forms.append(s)
            classes.append(token_class(kind, s))
            starts.append(a)
            ends.append(b)
            forms.append(".")
            classes.append(".")
            starts.append(b)
            ends.append(b + 1)
            continue
        forms.append(s)
        classes.append(token_class(kind, s))
        starts.append(a)
        ends.append(b)
    if back is not None:
        n = len(back)
        starts = [back[i] for i in starts]
        ends = [back[i - 1] + 1 if i <= n else len(text) for i in ends]
    return forms, classes, starts, ends
