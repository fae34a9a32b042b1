"""Text of glyph names: a short list, and rules for accented letters, Greek and Cyrillic."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Names of glyphs that no rule below covers.
NAMES = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[",
    "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|",
    "braceright": "}", "asciitilde": "~", "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥",
    "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©", "ordfeminine": "ª", "guillemotleft": "«", "logicalnot": "¬",
    "registered": "®", "macron": "¯", "degree": "°", "plusminus": "±", "acute": "´", "mu": "µ", "paragraph": "¶",
    "periodcentered": "·", "middot": "·", "cedilla": "¸", "onesuperior": "¹", "twosuperior": "²", "threesuperior": "³",
    "ordmasculine": "º", "guillemotright": "»", "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "questiondown": "¿",
    "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "germandbls": "ß", "multiply": "×",
    "divide": "÷", "Oslash": "Ø", "oslash": "ø", "dotlessi": "ı", "Lslash": "Ł", "lslash": "ł", "Dcroat": "Đ", "dcroat": "đ",
    "circumflex": "ˆ", "caron": "ˇ", "breve": "˘", "dotaccent": "˙", "ring": "˚", "ogonek": "˛", "tilde": "˜", "hungarumlaut": "˝",
    "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚", "quotedblleft": "“", "quotedblright": "”",
    "quotedblbase": "„", "dagger": "†", "daggerdbl": "‡", "bullet": "•", "ellipsis": "…", "perthousand": "‰", "guilsinglleft": "‹",
    "guilsinglright": "›", "fraction": "⁄", "Euro": "€", "trademark": "™", "minus": "−", "florin": "ƒ", "fi": "ﬁ", "fl": "ﬂ",
    "ff": "ﬀ", "ffi": "ﬃ", "ffl": "ﬄ", "infinity": "∞", "notequal": "≠", "lessequal": "≤", "greaterequal": "≥", "partialdiff": "∂",
    "summation": "∑", "product": "∏", "integral": "∫", "radical": "√", "approxequal": "≈", "lozenge": "◊", "Delta": "∆", "Omega": "Ω",
    "nbspace": " ", "softhyphen": "­", "sfthyphen": "­", "kgreenlandic": "ĸ", "longs": "ſ", "Eng": "Ŋ", "eng": "ŋ",
    "sigma1": "ς", "theta1": "ϑ", "phi1": "ϕ", "omega1": "ϖ",
}
#: Accents that a letter's name can end in, as combining characters.
ACCENTS = {
    "grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇",
    "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "commaaccent": "̧", "cedilla": "̧", "ogonek": "̨",
}
_ACCENTED = re.compile("([A-Za-z])(" + "|".join(ACCENTS) + ")")


def _part(name: str) -> str:
    if re.fullmatch(r"uni(?:[0-9A-F]{4})+", name):
        return "".join(chr(int(name[i : i + 4], 16)) for i in range(3, len(name), 4))
    if re.fullmatch(r"u[0-9A-F]{4,6}", name) and int(name[1:], 16) < 0x110000:
        return chr(int(name[1:], 16))
    if len(name) == 1:
        return name
    if name in NAMES:
        return NAMES[name]
    accented = _ACCENTED.fullmatch(name)
    if accented:
        letter, accent = accented[1], ACCENTS[accented[2]]
        if accented[2] == "commaaccent" and letter in "SsTt":  # the letter with a comma below where there is one
            accent = "̦" if letter in "Ss" else "̧"
        whole = unicodedata.normalize("NFC", letter + accent)
        if len(whole) == 1:
            return whole
    cyrillic = re.fullmatch(r"afii100(\d\d)", name)
    if cyrillic:  # capitals from 17 and small letters from 65 on; the letter io stands outside the alphabet's order
        n = int(cyrillic[1])
        for first, start, io in ((17, 0x410, "Ё"), (65, 0x430, "ё")):
            if first <= n <= first + 32:
                k = n - first
                return io if k == 6 else chr(start + k - (k > 6))
    try:
        tone = name.endswith("tonos")
        letter = name.removesuffix("tonos")
        case = "CAPITAL" if letter[0].isupper() else "SMALL"
        return unicodedata.lookup(f"GREEK {case} LETTER {letter.upper().replace('LAMBDA', 'LAMDA')}" + (" WITH TONOS" if tone else ""))
    except KeyError:
        return ""


@lru_cache(maxsize=4096)
def glyph_text(name: str) -> str:
    """Text of a glyph name: what follows a dot is dropped, parts joined by underscores are looked up one by one."""
    return "".join(map(_part, name.split(".")[0].split("_"))) if name.split(".")[0] else ""
