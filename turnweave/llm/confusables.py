"""The public table of visually confusable characters, read from the Unicode library that Spark brings along.

The table gives each character its prototype ("skeleton"): two characters look alike if their
prototypes are equal. It is read once, on the driver, from a file of the library's binary format
(``confusables.cfu``, on its own or inside the library's jar); kernels carry what is derived from it.
"""

from __future__ import annotations

import glob
import os
import string
import struct
import unicodedata
import zipfile

import numpy as np
import regex

MAGIC = 0x3845FDEF
#: Scripts whose letters take part; a letter of none of them is in a script of its own.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic", "Georgian", "Hebrew", "Arabic", "Lisu", "Deseret", "Osage", "Tifinagh", "Ethiopic", "Thai", "Devanagari", "Bengali", "Tamil", "Telugu", "Malayalam")
_IN = {s: regex.compile(rf"\p{{scx={s}}}") for s in SCRIPTS}
#: The letters a script is spelled with: those of its basic alphabet.
ALPHABETS = {
    "Latin": string.ascii_letters,
    "Cyrillic": "".join(map(chr, range(0x410, 0x450))) + "Ёё",
    "Greek": "".join(c for c in map(chr, range(0x391, 0x3CA)) if c.isalpha()),
}


def default_path() -> str:
    """The library's jar among the jars of the running Spark."""
    import pyspark

    homes = [os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)]
    for home in filter(None, homes):
        found = sorted(glob.glob(os.path.join(home, "jars", "icu4j-*.jar")))
        if found:
            return found[-1]
    raise FileNotFoundError("no icu4j jar found; name a confusables.cfu or such a jar")


def prototypes(path: str | None = None) -> dict[str, str]:
    """Character to prototype, from a ``confusables.cfu`` or a jar that holds one."""
    path = path or default_path()
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as jar:
            raw = jar.read(next(n for n in jar.namelist() if n.endswith("confusables.cfu")))
    else:
        with open(path, "rb") as file:
            raw = file.read()
    order = "<" if raw[8] == 0 else ">"
    body = raw[struct.unpack(order + "H", raw[:2])[0] :]
    magic, _, _, keys, n_keys, values, n_values, text, n_text = struct.unpack(order + "9I", body[:36])
    if magic != MAGIC:
        raise ValueError(f"{path} holds no table of confusables")
    key = np.frombuffer(body, order + "u4", n_keys, keys)
    value = np.frombuffer(body, order + "u2", n_values, values)
    units = np.frombuffer(body, order + "u2", n_text, text)
    out = {}
    for code, length, at in zip((key & 0x1FFFFF).tolist(), ((key >> 24) + 1).tolist(), value.tolist()):
        out[chr(code)] = chr(at) if length == 1 else units[at : at + length].astype("<u2").tobytes().decode("utf-16-le")
    return out


def _case(ch: str) -> str:
    return "upper" if ch.isupper() else "lower"


class Spelling:
    """How letters can be spelled in another script, and which scripts each letter belongs to."""

    def __init__(self, path: str | None = None):
        proto = prototypes(path)
        letters = [c for c in proto if unicodedata.category(c)[0] == "L"] + list(string.ascii_letters)
        #: For each script the strict twins (equal prototype, same case) and the loose ones (twins of the other case).
        self.strict: dict[str, dict[str, str]] = {}
        self.loose: dict[str, dict[str, str]] = {}
        for script, alphabet in ALPHABETS.items():
            at_home: dict[tuple[str, str], str] = {}
            for ch in alphabet:
                at_home.setdefault((proto.get(ch, ch), _case(ch)), ch)
            home = set(alphabet)
            strict = {c: at_home[proto.get(c, c), _case(c)] for c in letters if c not in home and (proto.get(c, c), _case(c)) in at_home}
            self.strict[script] = strict
            self.loose[script] = strict | {
                c.lower(): t.lower() for c, t in strict.items() if c.isupper() and len(c.lower()) == 1 and c.lower() not in home and c.lower() not in strict
            }
        kana = regex.compile(r"[\p{Script=Katakana}ー]")
        han = regex.compile(r"\p{Script=Han}")
        #: Kanji to the katakana (or length mark) that looks like it.
        self.katakana = {p: c for c, p in proto.items() if kana.fullmatch(c) and han.fullmatch(p) and unicodedata.normalize("NFKC", c) == c}
        self.katakana |= {c: p for c, p in proto.items() if han.fullmatch(c) and kana.fullmatch(p)}
        self._sets: dict[str, frozenset] = {}

    def scripts(self, ch: str) -> frozenset | None:
        """The script extensions of a letter; None for a character that goes with every script."""
        found = self._sets.get(ch, self)
        if found is self:
            if unicodedata.category(ch)[0] != "L":
                found = None
            else:
                found = frozenset(s for s, p in _IN.items() if p.match(ch)) or frozenset((unicodedata.name(ch, "none").split(" ")[0],))
            self._sets[ch] = found
        return found

    def spell(self, token: str, script: str, loose: bool = False) -> str | None:
        """The token in ``script``, or None where a letter has no such spelling."""
        twins = (self.loose if loose else self.strict).get(script, {})
        out = []
        for ch in unicodedata.normalize("NFD", token):
            sets = self.scripts(ch)
            if ch in twins:
                out.append(twins[ch])
            elif sets is None or script in sets:
                out.append(ch)
            else:
                return None
        return unicodedata.normalize("NFC", "".join(out))
