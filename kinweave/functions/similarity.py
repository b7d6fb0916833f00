"""Arrow UDFs for what the JVM has no expression for: Jaro-Winkler similarity and Double Metaphone codes."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from kinweave.functions import text as T


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity; if it is over 0.7, with a bonus of a tenth of the rest for each of up to four equal first letters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    ours = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                ours.append(c)
                break
    m = len(ours)
    if not m:
        return 0.0
    theirs = [c for c, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(ours, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


@F.pandas_udf(DoubleType())
def _best(mention: pd.Series, names: pd.Series) -> pd.Series:
    cached = lru_cache(1 << 16)(jaro_winkler)
    return pd.Series([max((cached(m, n) for n in ns), default=0.0) if m is not None and ns is not None else None for m, ns in zip(mention, names, strict=True)])


def jaro_winkler_best(mention: Column, names: Column) -> Column:
    """The highest Jaro-Winkler similarity of a string to any of an array of strings; 0 for an empty array."""
    return _best(mention, names)


VOWELS = set("AEIOUY")


class _Coder:
    """Primary Double Metaphone code of one word of capital letters, at most four letters long."""

    def __init__(self, word: str):
        self.w, self.out, self.i = word, [], 0
        self.slavic = "W" in word or "K" in word or "CZ" in word or "WITZ" in word

    def at(self, start: int, length: int, *options: str) -> bool:
        return start >= 0 and self.w[start : start + length] in options

    def char(self, i: int) -> str:
        return self.w[i] if 0 <= i < len(self.w) else ""

    def add(self, code: str, step: int) -> None:
        self.out.append(code)
        self.i += step

    def code(self) -> str:
        w = self.w
        if self.at(0, 2, "GN", "KN", "PN", "WR", "PS"):
            self.i = 1
        while self.i < len(w) and sum(map(len, self.out)) < 4:
            c = w[self.i]
            if c in VOWELS:
                self.add("A" if self.i == 0 else "", 1)
            else:
                getattr(self, f"on_{c}", lambda: self.add("", 1))()
        return "".join(self.out)[:4]

    def double(self, code: str) -> None:
        self.add(code, 2 if self.char(self.i + 1) == self.w[self.i] else 1)

    def on_B(self) -> None:
        self.double("P")

    def on_C(self) -> None:
        i, w, at = self.i, self.w, self.at
        if self._hard_c(i):
            self.add("K", 2)
        elif i == 0 and at(i, 6, "CAESAR"):
            self.add("S", 2)
        elif at(i, 2, "CH"):
            self._ch(i)
        elif at(i, 2, "CZ") and not at(i - 2, 4, "WICZ"):
            self.add("S", 2)
        elif at(i + 1, 3, "CIA"):
            self.add("X", 3)
        elif at(i, 2, "CC") and not (i == 1 and w[0] == "M"):
            if at(i + 2, 1, "I", "E", "H") and not at(i + 2, 2, "HU"):
                self.add("KS" if (i == 1 and self.char(0) == "A") or at(i - 1, 5, "UCCEE", "UCCES") else "X", 3)
            else:
                self.add("K", 2)
        elif at(i, 2, "CK", "CG", "CQ"):
            self.add("K", 2)
        elif at(i, 2, "CI", "CE", "CY"):
            self.add("S", 2)
        else:
            self.add("K", 3 if at(i + 1, 2, " C", " Q", " G") else 2 if at(i + 1, 1, "C", "K", "Q") and not at(i + 1, 2, "CE", "CI") else 1)

    def _hard_c(self, i: int) -> bool:
        if self.at(i, 4, "CHIA"):
            return True
        if i <= 1 or self.char(i - 2) in VOWELS or not self.at(i - 1, 3, "ACH"):
            return False
        c = self.char(i + 2)
        return c not in ("I", "E") or self.at(i - 2, 6, "BACHER", "MACHER")

    def _ch(self, i: int) -> None:
        at = self.at
        if i > 0 and at(i, 4, "CHAE"):
            self.add("K", 2)
        elif i == 0 and (at(1, 5, "HARAC", "HARIS") or at(1, 3, "HOR", "HYM", "HIA", "HEM")) and not at(0, 5, "CHORE"):
            self.add("K", 2)
        elif at(0, 4, "VAN ", "VON ") or at(0, 3, "SCH") or at(i - 2, 6, "ORCHES", "ARCHIT", "ORCHID") or at(i + 2, 1, "T", "S") or ((at(i - 1, 1, "A", "O", "U", "E") or i == 0) and (at(i + 2, 1, "L", "R", "N", "M", "B", "H", "F", "V", "W", " ") or i + 1 == len(self.w) - 1)):
            self.add("K", 2)
        elif i > 0:
            self.add("K" if at(0, 2, "MC") else "X", 2)
        else:
            self.add("X", 2)

    def on_D(self) -> None:
        if self.at(self.i, 2, "DG"):
            if self.at(self.i + 2, 1, "I", "E", "Y"):
                self.add("J", 3)
            else:
                self.add("TK", 2)
        else:
            self.add("T", 2 if self.at(self.i, 2, "DT", "DD") else 1)

    def on_F(self) -> None:
        self.double("F")

    def on_G(self) -> None:
        i, at, char = self.i, self.at, self.char
        if char(i + 1) == "H":
            if i > 0 and char(i - 1) not in VOWELS:
                self.add("K", 2)
            elif i == 0:
                self.add("J" if char(2) == "I" else "K", 2)
            elif (i > 1 and at(i - 2, 1, "B", "H", "D")) or (i > 2 and at(i - 3, 1, "B", "H", "D")) or (i > 3 and at(i - 4, 1, "B", "H")):
                self.add("", 2)
            elif i > 2 and char(i - 1) == "U" and at(i - 3, 1, "C", "G", "L", "R", "T"):
                self.add("F", 2)
            else:
                self.add("K" if i > 0 and char(i - 1) != "I" else "", 2)
        elif char(i + 1) == "N":
            if i == 1 and char(0) in VOWELS and not self.slavic:
                self.add("KN", 2)
            elif not at(i + 2, 2, "EY") and char(i + 1) != "Y" and not self.slavic:
                self.add("N", 2)
            else:
                self.add("KN", 2)
        elif at(i + 1, 2, "LI") and not self.slavic:
            self.add("KL", 2)
        elif i == 0 and (char(1) == "Y" or at(1, 2, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
            self.add("K", 2)
        elif (at(i + 1, 2, "ER") or char(i + 1) == "Y") and not at(0, 6, "DANGER", "RANGER", "MANGER") and not at(i - 1, 1, "E", "I") and not at(i - 1, 3, "RGY", "OGY"):
            self.add("K", 2)
        elif at(i + 1, 1, "E", "I", "Y") or at(i - 1, 4, "AGGI", "OGGI"):
            self.add("K" if at(0, 4, "VAN ", "VON ") or at(0, 3, "SCH") or at(i + 1, 2, "ET") else "J", 2)
        else:
            self.add("K", 2 if char(i + 1) == "G" else 1)

    def on_H(self) -> None:
        if (self.i == 0 or self.char(self.i - 1) in VOWELS) and self.char(self.i + 1) in VOWELS and self.char(self.i + 1):
            self.add("H", 2)
        else:
            self.add("", 1)

    def on_J(self) -> None:
        i, char = self.i, self.char
        if self.at(i, 4, "JOSE") or self.at(0, 4, "SAN "):
            self.add("H" if (i == 0 and char(4) == " ") or len(self.w) == 4 or self.at(0, 4, "SAN ") else "J", 1)
            return
        if i == 0:
            code = "J"
        elif char(i - 1) in VOWELS and not self.slavic and char(i + 1) in ("A", "O") and char(i + 1):
            code = "J"
        elif i == len(self.w) - 1:
            code = "J"
        else:
            code = "J" if not self.at(i + 1, 1, "L", "T", "K", "S", "N", "M", "B", "Z") and not self.at(i - 1, 1, "S", "K", "L") else ""
        self.add(code, 2 if char(i + 1) == "J" else 1)

    def on_K(self) -> None:
        self.double("K")

    def on_L(self) -> None:
        self.double("L")

    def on_M(self) -> None:
        i = self.i
        pair = self.char(i + 1) == "M" or (self.at(i - 1, 3, "UMB") and (i + 1 == len(self.w) - 1 or self.at(i + 2, 2, "ER")))
        self.add("M", 2 if pair else 1)

    def on_N(self) -> None:
        self.double("N")

    def on_P(self) -> None:
        if self.char(self.i + 1) == "H":
            self.add("F", 2)
        else:
            self.add("P", 2 if self.at(self.i + 1, 1, "P", "B") else 1)

    def on_Q(self) -> None:
        self.double("K")

    def on_R(self) -> None:
        i = self.i
        silent = i == len(self.w) - 1 and not self.slavic and self.at(i - 2, 2, "IE") and not self.at(i - 4, 2, "ME", "MA")
        self.double("" if silent else "R")

    def on_S(self) -> None:
        i, at, char = self.i, self.at, self.char
        if at(i - 1, 3, "ISL", "YSL"):
            self.add("", 1)
        elif i == 0 and at(i, 5, "SUGAR"):
            self.add("X", 1)
        elif at(i, 2, "SH"):
            self.add("S" if at(i + 1, 4, "HEIM", "HOEK", "HOLM", "HOLZ") else "X", 2)
        elif at(i, 3, "SIO", "SIA") or at(i, 4, "SIAN"):
            self.add("S", 3)
        elif (i == 0 and at(i + 1, 1, "M", "N", "L", "W")) or at(i + 1, 1, "Z"):
            self.add("S", 2 if at(i + 1, 1, "Z") else 1)
        elif at(i, 2, "SC"):
            if char(i + 2) == "H":
                if at(i + 3, 2, "OO", "ER", "EN", "UY", "ED", "EM"):
                    self.add("X" if at(i + 3, 2, "ER", "EN") else "SK", 3)
                else:
                    self.add("X", 3)
            elif at(i + 2, 1, "I", "E", "Y"):
                self.add("S", 3)
            else:
                self.add("SK", 3)
        else:
            silent = i == len(self.w) - 1 and at(i - 2, 2, "AI", "OI")
            self.add("" if silent else "S", 2 if at(i + 1, 1, "S", "Z") else 1)

    def on_T(self) -> None:
        i, at = self.i, self.at
        if at(i, 4, "TION") or at(i, 3, "TIA", "TCH"):
            self.add("X", 3)
        elif at(i, 2, "TH") or at(i, 3, "TTH"):
            self.add("T" if at(i + 2, 2, "OM", "AM") or at(0, 4, "VAN ", "VON ") or at(0, 3, "SCH") else "0", 2)
        else:
            self.add("T", 2 if at(i + 1, 1, "T", "D") else 1)

    def on_V(self) -> None:
        self.double("F")

    def on_W(self) -> None:
        i, at, char = self.i, self.at, self.char
        if at(i, 2, "WR"):
            self.add("R", 2)
        elif i == 0 and (char(1) in VOWELS and char(1) or at(i, 2, "WH")):
            self.add("A", 1)
        elif (i == len(self.w) - 1 and char(i - 1) in VOWELS) or at(i - 1, 5, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or at(0, 3, "SCH"):
            self.add("", 1)
        elif at(i, 4, "WICZ", "WITZ"):
            self.add("TS", 4)
        else:
            self.add("", 1)

    def on_X(self) -> None:
        i = self.i
        if i == 0:
            self.add("S", 1)
            return
        silent = i == len(self.w) - 1 and (self.at(i - 3, 3, "IAU", "EAU") or self.at(i - 2, 2, "AU", "OU"))
        self.add("" if silent else "KS", 2 if self.at(i + 1, 1, "C", "X") else 1)

    def on_Z(self) -> None:
        i = self.i
        if self.char(i + 1) == "H":
            self.add("J", 2)
        else:
            self.add("S", 2 if self.char(i + 1) == "Z" else 1)


@lru_cache(1 << 16)
def double_metaphone(word: str) -> str:
    """The primary code of a word of ASCII letters; other characters stand for themselves as breaks."""
    return _Coder(word.strip().upper()).code()


@F.pandas_udf(ArrayType(StringType()))
def _codes(words: pd.Series) -> pd.Series:
    return pd.Series([None if ws is None else [double_metaphone(w) if w and any(c.isascii() and c.isalpha() for c in w) else "" for w in ws] for ws in words])


def phonetic_codes(words: Column) -> Column:
    """Codes of an array of words; '' for words without ASCII letters once folded."""
    return _codes(F.transform(words, T.ascii_fold))
