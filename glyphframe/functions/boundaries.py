"""Boundaries of words, sentences and lines by the Unicode rules (annexes 29 and 14).

A text becomes a string of break classes, one letter a character; marks that a rule ignores are folded into the
character before them; the rules are regular expressions over what remains.  There are no dictionaries: Han and Hiragana
characters are words of their own, Thai and its like break at spaces.
"""

from __future__ import annotations

import re
import unicodedata

import regex

Segment = tuple[int, int, str]
#: Unicode white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


class Classes(dict):
    """Code point to letter, found on first use; for ``str.translate``."""

    def __init__(self, rules: list[tuple[str, str]], other: str):
        super().__init__()
        self.rules = rules
        self.tests = [(regex.compile(f"[{p}]" if not p.startswith("[") else p, regex.V1), letter) for letter, p in rules]
        self.other = other

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = next((letter for test, letter in self.tests if test.match(c)), self.other)
        return self[point]


def _properties(name: str, letters: dict[str, str]) -> list[tuple[str, str]]:
    return [(letter, "".join(rf"\p{{{name}={v}}}" for v in values.split())) for letter, values in letters.items()]


def _folded(classes: str, unit: re.Pattern, marks: str, alone: str) -> tuple[str, list[int], list[str]]:
    """One class a unit, where units start (and the text ends), and their own classes in full."""
    units = [m.group() for m in unit.finditer(classes)]
    starts, at = [0], 0
    for u in units:
        at += len(u)
        starts.append(at)
    return "".join(alone if u[0] in marks else u[0] for u in units), starts, units


# Words.  A letter, B letter that is also a pictograph, h Hangul syllable (a word with its like), H Hebrew letter, 9 number, K Katakana, _ connector, q d l m u marks
# within words or numbers, R flag letter, P pictograph, i Han or Hiragana, x extending, z joiner, r n w line ends

_WORD = Classes(
    [("h", r"\p{lb=H2}\p{lb=H3}"), ("B", r"[\p{WB=ALetter}&&\p{Extended_Pictographic}]"), ("P", r"[\p{Extended_Pictographic}--\p{WB=RI}]")]
    + _properties("WB", {"r": "CR", "n": "LF", "w": "Newline", "x": "Extend Format", "z": "ZWJ", "R": "Regional_Indicator", "K": "Katakana", "H": "Hebrew_Letter",
                         "A": "ALetter", "q": "Single_Quote", "d": "Double_Quote", "m": "MidNumLet", "l": "MidLetter", "u": "MidNum", "9": "Numeric", "_": "ExtendNumLet", " ": "WSegSpace"})
    + [("i", r"\p{Script=Han}\p{Script=Hiragana}")],
    "o",
)
_WORD_UNIT = re.compile("[rnw]|[^rnw][xz]*")
#: Unit classes: S a space with marks, g a Hangul syllable with marks, p a pictograph joined to what is before it.
_WORD_SEGMENT = re.compile(
    "A++(?![BH9_lmqp])| (?![ Sp])|rn|[rnw]| *S|(?: +|RR?|h*g|h+|[ABH9K_](?:(?<=[ABH9_])[ABH9_]|(?<=[K_])[K_]|(?<=[ABH])[lmq][ABH]|(?<=9)[umq]9|(?<=H)dH|(?<=H)q)*|.)p*|p+"
)
_WORD_LABELS = dict.fromkeys("ABHh", "letter") | {"9": "number"} | dict.fromkeys("Ki", "ideo")


def words(text: str) -> list[Segment]:
    """(start, end, class) of all segments between word boundaries; they cover the text.

    The class is that of what the segment ends with: number, letter, ideo (Katakana included) or none.
    """
    base = text.translate(_WORD)
    starts, units = None, []
    if "x" in base or "z" in base:
        base, starts, units = _folded(base, _WORD_UNIT, "xz", "o")
        base = "".join(
            {" ": "S", "h": "g"}.get(c, c) if c in " h" and len(u) > 1 else "p" if c == "P" and k and units[k - 1][-1] == "z" else c for k, (c, u) in enumerate(zip(base, units))
        )
    out, labels = [], _WORD_LABELS
    for m in _WORD_SEGMENT.finditer(base):
        a, b = m.span()
        last = base[b - 1]
        if last in "_q" and b - a > 1:
            if last == "q":
                last = base[b - 2]  # a mark behind a Hebrew letter
            elif not (starts and len(units[b - 1]) > 1):
                last = "A" if base[b - 2] == "_" else base[b - 2]
        label = labels.get(last, "none")
        out.append((starts[a], starts[b], label) if starts else (a, b, label))
    return out


# Sentences.  . and ! ends, ) closing, , continuing, u l o letters, 9 numbers, p r n line ends

_SENTENCE = Classes(
    _properties("SB", {"r": "CR", "n": "LF", "p": "Sep", "x": "Extend Format", " ": "Sp", "l": "Lower", "u": "Upper", "o": "OLetter", "9": "Numeric", ".": "ATerm", "!": "STerm", ",": "SContinue", ")": "Close"}),
    "z",
)
_SENTENCE_UNIT = re.compile("[prn]|[^prn]x*")
_SENTENCE_END = regex.compile(
    r"(?:rn|[rnp])|(?:!\)*+ *+|(?:(?<![ul])\.|(?<=[ul])\.(?!u))(?!9)\)*+ *+(?![^oulrnp.!]*+l))(?![,.!])(?:rn|[rnp])?+"
)


_GREEK = Classes(_SENTENCE.rules, "z")
_GREEK[ord(";")] = _GREEK[0x37E] = "!"


def sentences(text: str, classes: Classes = _SENTENCE) -> list[Segment]:
    """(start, end, "term" or "sep") of sentences; they cover the text.  "sep": without a mark at its end."""
    base, starts = text.translate(classes), None
    if "x" in base:
        base, starts, _ = _folded(base, _SENTENCE_UNIT, "x", "z")
    out, at = [], 0
    for m in _SENTENCE_END.finditer(base):
        out.append((at, m.end(), "term" if base[m.start()] in ".!" else "sep"))
        at = m.end()
    if at < len(base):
        out.append((at, len(base), "sep"))
    return [(starts[a], starts[b], label) for a, b, label in out] if starts else out


def greek_sentences(text: str) -> list[Segment]:
    """Sentences where a semicolon asks."""
    return sentences(text, _GREEK)


# Lines.  Letters for the classes of the annex; o p d are East Asian forms of O P b, i f q quotes that open, close or do both

_LINE = Classes(
    [("X", r"[\p{lb=SA}&&[\p{Mn}\p{Mc}]]"), ("u", r"‐"), ("x", r"[\p{Extended_Pictographic}&&\p{Cn}]"),
     ("o", r"[\p{lb=OP}&&[\p{ea=F}\p{ea=W}\p{ea=H}]]"), ("p", r"[\p{lb=CP}&&[\p{ea=F}\p{ea=W}\p{ea=H}]]"), ("d", r"[\p{lb=BA}&&[\p{ea=F}\p{ea=W}\p{ea=H}]]"),
     ("i", r"[\p{lb=QU}&&\p{Pi}]"), ("f", r"[\p{lb=QU}&&\p{Pf}]")]
    + _properties("lb", {"H": "HL", "N": "NU", "S": "SP", "Z": "ZW", "B": "BK", "R": "CR", "F": "LF", "L": "NL", "W": "WJ", "G": "GL", "C": "CL", "P": "CP", "E": "EX", "Y": "SY", "O": "OP",
                         "q": "QU", "I": "IS", "n": "NS CJ", "2": "B2", "c": "CB", "b": "BA", "h": "HY", "M": "BB", ".": "IN", "$": "PR", "%": "PO", "D": "ID", "e": "EB", "m": "EM",
                         "j": "JL", "v": "JV", "t": "JT", "k": "H2", "l": "H3", "r": "RI", "X": "CM", "z": "ZWJ"}),
    "A",
)
_LINE_UNIT = re.compile("[SZBRFL]|[^SZBRFL][Xz]*")
#: Between two letters or digits, and before a space, no line breaks.
_LINE_PLACE = re.compile("(?<=[BRFL])(?=.)|(?<=.)(?=[^SZ])(?<!A(?=A))(?<!A(?=N))(?<!N(?=[AN]))", re.S)
_LINE_SPACE = re.compile("(?<=[Sbd])(?=[^SZ])", re.S)
#: Pairs that stay together wherever they stand, by the annex's rules in their order from 21 on.
_TOGETHER = re.compile(
    r".[bduhn]|M.|YH|.\.|[AH]N|N[AH]|\$[Demx]|[Demx]%|[$%][AH]|[AH][$%]|[$%]N|[hI]N|j[jvkl]|[vk][vt]|[tl]t|[jvtkl]%|\$[jvtkl]|[AH][AH]|I[AH]|[AHN]O|P[AHN]|em|xm", re.S
)
_LINE_ENDS = frozenset("BRFL")


def _east(c: str) -> bool:
    return bool(c) and unicodedata.east_asian_width(c) in "FWH"


def line_breaks(text: str) -> list[Segment]:
    """(start, end, "soft" or "hard") of pieces between possible line breaks."""
    raw = text.translate(_LINE)
    base, starts, units = _folded(raw, _LINE_UNIT, "Xz", "A")
    out, at = [], 0
    for m in _LINE_PLACE.finditer(base):
        i = m.start()
        hard = base[i - 1] in _LINE_ENDS and base[i - 1 : i + 1] != "RF"
        if hard or _may_break(base, i, units, text, starts):
            out.append((starts[at], starts[i], "hard" if hard else "soft"))
            at = i
    if at < len(base):
        out.append((starts[at], starts[-1], "hard" if base[-1] in _LINE_ENDS else "soft"))
    return out


def space_breaks(text: str) -> list[int]:
    """Where lines may break after white space, and the end."""
    base, starts, units = _folded(text.translate(_LINE), _LINE_UNIT, "Xz", "A")
    places = (m.start() for m in _LINE_SPACE.finditer(base))
    return [starts[i] for i in places if text[starts[i] - 1] in WHITE and _may_break(base, i, units, text, starts)] + [len(text)]


def _may_break(base: str, i: int, units: list[str], text: str, starts: list[int]) -> bool:
    """Whether a line may end before unit ``i``; the rules in the annex's order."""
    a, b = base[i - 1], base[i]
    after = base[i + 1] if i + 1 < len(base) else ""
    if b in _LINE_ENDS or a == "R":
        return False
    k = i - 1
    while k >= 0 and base[k] == "S":
        k -= 1
    left = base[k] if k >= 0 else ""  # before any spaces
    if left == "Z":
        return True
    if units[i - 1][-1] == "z" or a == "W" or b == "W" or a == "G":
        return False
    if b == "G" and a not in "Sbduh" or b in "CPpEY" or left in "Oo" and left:
        return False
    if left == "i" and (k == 0 or base[k - 1] in "BRFLOoiqfGSZ"):
        return False
    if b == "f" and (not after or after in "SGWCqifPpEIYBRFLZ"):
        return False
    if a == "S" and b == "I" and after == "N":
        return True
    if b == "I" or left and left in "CPp" and b == "n" or left == b == "2":
        return False
    if a == "S":
        return True
    if b in "fq" or a in "iq":
        return False
    if b in "iq" or a in "fq":
        before, beyond = text[starts[i - 1]], text[starts[i]]
        if b == "i" and (not _east(before) or not after or not _east(text[starts[i + 1]])):
            return False
        if a == "f" and (not _east(beyond) or i < 2 or not _east(text[starts[i - 2]])):
            return False
    if a == "c" or b == "c":
        return True
    start = i < 2 or base[i - 2] in "BRFLSZcG"
    if a in "hu" and start and b == "A":
        return False
    if a in "hbu" and i > 1 and base[i - 2] == "H" and b not in "bduhn" and b != "H":
        return False
    if _TOGETHER.match(a + b):
        return False
    if a in "$%" and b in "Oo" and (after == "N" or base[i + 1 : i + 3] == "IN"):
        return False
    if b in "$%N":  # what is before may be a number
        j = i - 1
        if a in "CPp" and b != "N":
            j -= 1
        while j >= 0 and base[j] in "YI":
            j -= 1
        if j >= 0 and base[j] == "N":
            return False
    if a == b == "r":
        j = i - 1
        while j >= 0 and base[j] == "r":
            j -= 1
        return (i - 1 - j) % 2 == 0
    return True
