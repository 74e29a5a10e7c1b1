"""Double metaphone: a primary and a secondary code of how an English word, or a name of other origin, may sound.

After the published description, as one table: for each letter, rules in order of (what stands before, what stands here,
primary sound, secondary sound or None for the same, letters that are used up). The first rule that fits is taken.
"""

from __future__ import annotations

import re
from functools import lru_cache

V = "[AEIOUY]"
#: names of German or Dutch origin, and words of Slavic look
GERMANIC, SLAVIC = "GERMANIC", "SLAVIC"
LONGEST = 4

# -- fixed values: the rules of the published description ---------------------------------------------------------------------

_TABLE: dict[str, list[tuple]] = {
    "A": [("^$", "", "A", None, 1), ("", "", "", None, 1)],
    "B": [("", "BB?", "P", None, 0)],
    "Ç": [("", "", "S", None, 1)],
    "C": [
        ("[^AEIOUY]A$", "CH(?![IE])", "K", None, 2), ("[BM]A$", "CHER", "K", None, 2), ("^$", "CAESAR", "S", None, 2), ("", "CHIA", "K", None, 2),
        (".", "CHAE", "K", "X", 2), ("^$", "CH(?!ORE)(ARAC|ARIS|OR|YM|IA|EM)", "K", None, 2), (GERMANIC, "CH", "K", None, 2), ("OR$", "CHES|CHID", "K", None, 2), ("AR$", "CHIT", "K", None, 2),
        ("", "CH[TS]", "K", None, 2), ("(^|[AOUE])$", "CH([LRNMBHFVW]|$)", "K", None, 2), ("^M$", "CH", "K", None, 2), (".", "CH", "X", "K", 2), ("", "CH", "X", None, 2),
        ("WI$", "CZ", "X", None, 2), ("", "CZ", "S", "X", 2), ("", "CCIA", "X", None, 3), ("^A$", "CC[IEH](?!U)", "KS", None, 3), ("U$", "CCE[ES]", "KS", None, 3), ("(?<!^M)$", "CC[IE]|CCH(?!U)", "X", None, 3),
        ("(?<!^M)$", "CC", "K", None, 2), ("", "C[KGQ]", "K", None, 2), ("", "CI[OEA]", "S", "X", 2), ("", "C[IEY]", "S", None, 2), ("", "C[CKQ](?![EI])", "K", None, 2), ("", "", "K", None, 1),
    ],
    "D": [("", "DG[IEY]", "J", None, 3), ("", "DG", "TK", None, 2), ("", "D[TD]?", "T", None, 0)],
    "F": [("", "FF?", "F", None, 0)],
    "G": [
        (f"(?<!{V})(?<!^)$", "GH", "K", None, 2), ("^$", "GHI", "J", None, 2), ("^$", "GH", "K", None, 2), ("(B|H|D).$|(B|H|D)..$|(B|H)...$", "GH", "", None, 2), ("[CGLRT].U$", "GH", "F", None, 2), ("I$", "GH", "", None, 2), ("", "GH", "K", None, 2),
        (f"^{V}$", f"GN(?!{SLAVIC})", "KN", "N", 2), ("", f"GN(?!EY|Y|{SLAVIC})", "N", "KN", 2), ("", "GN", "KN", None, 2), ("", f"GLI(?!{SLAVIC})", "KL", "L", 2),
        ("^$", "G(Y|E[SPBLYIR]|I[BLNE])", "K", "J", 2), ("(?<![EIRO])(?<!^DAN)(?<!^RAN)(?<!^MAN)$", "GY", "K", "J", 2), ("(?<![EI])(?<!^DAN)(?<!^RAN)(?<!^MAN)$", "GER", "K", "J", 2),
        (GERMANIC, "G[EIY]", "K", None, 2), ("", "GET", "K", None, 2), ("", "GIER$", "J", None, 2), ("", "G[EIY]", "J", "K", 2), ("[AO]$", "GGI", "J", "K", 2), ("", "GG?", "K", None, 0),
    ],
    "H": [(f"(^|{V})$", f"H{V}", "H", None, 2), ("", "", "", None, 1)],
    "J": [("^$", "JOSE$", "H", None, 1), ("^$", "JOSE", "J", "H", 1), ("^SAN.*$", "J", "H", None, 1), ("^$", "JJ?", "J", "A", 0), (f"{V}$", f"J(?=[AO])(?!{SLAVIC})", "J", "H", 1), ("", "J$", "J", "", 1), ("[SKL]$", "J", "", None, 1), ("", "J[LTKSNMBZ]", "", None, 1), ("", "JJ?", "J", None, 0)],
    "K": [("", "KK?", "K", None, 0)],
    "L": [("I$", "LL[OA]$", "L", "", 2), ("A$", "LLE(S?$|.*[AO]S?$)", "L", "", 2), ("", "LL?", "L", None, 0)],
    "M": [("U$", "MB($|ER)", "M", None, 2), ("", "MM?", "M", None, 0)],
    "N": [("", "NN?", "N", None, 0)],
    "Ñ": [("", "", "N", None, 1)],
    "P": [("", "PH", "F", None, 2), ("", "P[PB]?", "P", None, 0)],
    "Q": [("", "QQ?", "K", None, 0)],
    "R": [("(?<!M[EA])IE$", f"R$(?!{SLAVIC})", "", "R", 1), ("", "RR?", "R", None, 0)],
    "S": [
        ("[IY]$", "SL", "", None, 1), ("^$", "SUGAR", "X", "S", 1), ("", "SH(EIM|OEK|OLM|OLZ)", "S", None, 2), ("", "SH", "X", None, 2), ("", f"SI[OA](?!{SLAVIC})", "S", "X", 3), ("", "SI[OA]", "S", None, 3),
        ("^$", "S[MNLW]", "S", "X", 1), ("", "SZ", "S", "X", 2), ("", "SCH(ER|EN)", "X", "SK", 3), ("", "SCH(OO|UY|ED|EM)", "SK", None, 3), ("^$", f"SCH(?!{V}|W)", "X", "S", 3), ("", "SCH", "X", None, 3),
        ("", "SC[IEY]", "S", None, 3), ("", "SC", "SK", None, 3), ("[AO]I$", "S$", "", "S", 1), ("", "S[SZ]?", "S", None, 0),
    ],
    "T": [("", "TION|TIA|TCH", "X", None, 3), (GERMANIC, "TH", "T", None, 2), ("", "TH[OA]M", "T", None, 2), ("", "TH", "0", "T", 2), ("", "TTH", "0", "T", 3), ("", "T[TD]?", "T", None, 0)],
    "V": [("", "VV?", "F", None, 0)],
    "W": [
        ("", "WR", "R", None, 2), ("^$", f"W{V}", "A", "F", 1), ("^$", "WH", "A", None, 1), (f"{V}$", "W$", "", "F", 1), ("[EO]$", "WSK[IY]", "", "F", 1), ("^SCH.*$", "W", "", "F", 1), ("", "WI[CT]Z", "TS", "FX", 4), ("", "", "", None, 1),
    ],
    "X": [("^$", "", "S", None, 1), ("([IE]AU|[AO]U)$", "X$", "", None, 1), ("", "X[CX]?", "KS", None, 0)],
    "Z": [("", "ZH", "J", None, 2), ("", "ZZ?[OIA]", "S", "TS", 1), ("(?<!^)(?<!T)$", f"ZZ?(?={SLAVIC})", "S", "TS", 0), ("", "ZZ?", "S", None, 0)],
}
_SILENT_STARTS = ("GN", "KN", "PN", "WR", "PS")


@lru_cache(maxsize=4)
def _rules(germanic: bool, slavic: bool) -> dict[str, list[tuple]]:
    """The table for words of an origin, compiled: a mark of the other origin fits nowhere."""
    nowhere, anywhere = r"(?!)", ""

    def pattern(text: str) -> str:
        return text.replace(SLAVIC, anywhere if slavic else nowhere)

    out = {}
    for letter, rules in _TABLE.items():
        mine = []
        for before, here, first, second, used in rules:
            before = (anywhere if germanic else nowhere) if before == GERMANIC else before
            mine.append((re.compile(f"(?:{before})" + ("" if before.endswith("$") or not before else "$")), re.compile(pattern(here)), first, first if second is None else second, used))
        out[letter] = mine
    return out


@lru_cache(maxsize=200_000)
def double_metaphone(word: str) -> tuple[str, str]:
    """Codes of four sounds at most; both are empty where a word has no letters."""
    w = re.sub(r"[^A-ZÇÑ]", "", word.upper())
    rules = _rules(w.startswith(("VAN", "VON", "SCH")), bool(re.search("W|K|CZ|WITZ", w)))
    one, two = "", ""
    i = 1 if w.startswith(_SILENT_STARTS) else 0
    while i < len(w) and (len(one) < LONGEST or len(two) < LONGEST):
        letter = "A" if w[i] in "AEIOUY" else w[i]
        for before, here, first, second, used in rules[letter]:
            found = here.match(w, i)
            if found and before.search(w[:i]):
                one, two, i = one + first, two + second, i + (used or len(found[0]) or 1)
                break
        else:
            i += 1
    return one[:LONGEST], two[:LONGEST]
