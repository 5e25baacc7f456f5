"""Alphabets as column expressions. The terminator ``*`` sorts before every letter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMINATOR = "*"
# Letters of the named alphabets, in sorting order.
NAMED = {
    "protein": "ACDEFGHIKLMNPQRSTVWYX",
    "dna": "ACGTN",
    "rna": "ACGUN",
    "iupac": "ACGTNRYSWKMBDHV",
}
# Complements of nucleotide letters.
COMPLEMENTS = dict(zip("ACGTUNRYSWKMBDHV|", "TGCAANYRSWMKVHDB|", strict=True))
# The standard genetic code, codons in the order TTT, TTC, TTA, TTG, TCT, ...
GENETIC_CODE = "FFLLSSSSYY$$CC$WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

#: Sorting codes in ASCII order, one for each letter of an alphabet of up to 128 symbols.
_CODES = "".join(chr(c) for c in range(0x30, 0x7F)) + "".join(chr(c) for c in range(0xA1, 0xC3))


@dataclass(frozen=True)
class Alphabet:
    """Letters in sorting order; the last one stands for foreign letters."""

    letters: str
    case_sensitive: bool = False

    @classmethod
    def of(cls, spec: str) -> Alphabet:
        """From a name with qualifiers (``DNA/wildcard/variants``, abbreviated at will) or literal letters."""
        name, *marks = spec.split("/")
        letters = NAMED.get(name.lower(), name)
        case = False
        for mark in marks:
            known = [m for m in ("wildcard", "casesens", "variants") if mark and m.startswith(mark.lower())]
            if len(known) != 1:
                raise ValueError(f"unknown qualifier {mark!r}")
            if known[0] == "casesens":
                case = True
            elif known[0] == "variants":
                wild = letters[-1] in "NX"
                letters = letters[:-1] + "|" + letters[-1] if wild else letters + "|"
        letters = "".join(dict.fromkeys(letters))
        if len(letters) > 127:
            raise ValueError("an alphabet has at most 127 letters and the terminator")
        return cls(letters, case)

    @property
    def codes(self) -> str:
        return _CODES[: len(self.letters)]

    @property
    def complement_letters(self) -> str:
        missing = [c for c in self.letters if COMPLEMENTS.get(c) is None]
        if missing:
            raise ValueError(f"no complement for {''.join(missing)}")
        swapped = [COMPLEMENTS[c] for c in self.letters]
        if "U" in self.letters:
            swapped = ["U" if c == "A" else x for c, x in zip(self.letters, swapped, strict=True)]
        return "".join(swapped)

    def clean(self, s: Column) -> Column:
        """Letters of the alphabet: non-letters go, foreign letters become the last letter."""
        s = F.regexp_replace(s, r"[^A-Za-z|]" if "|" in self.letters else r"[^A-Za-z]", "")
        s = s if self.case_sensitive else F.upper(s)
        foreign = "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ("abcdefghijklmnopqrstuvwxyz" if self.case_sensitive else "") if c not in self.letters)
        return F.translate(s, foreign, self.letters[-1] * len(foreign)) if foreign else s

    def encode(self, s: Column) -> Column:
        """Text whose ASCII order is the order of the alphabet."""
        return F.translate(s, self.letters, self.codes)

    def decode(self, s: Column) -> Column:
        return F.translate(s, self.codes, self.letters)

    def complement(self, s: Column) -> Column:
        return F.translate(s, self.letters, self.complement_letters)

    def revcomp(self, s: Column) -> Column:
        return F.reverse(self.complement(s))

    def default_prefix(self) -> int:
        """Letters that key a bucket of the index."""
        n = len(self.letters) + 1
        return 4 if n <= 8 else 3 if n <= 16 else 2


DNA = Alphabet.of("DNA/wildcard")
PROTEIN = Alphabet.of("protein")


def translate_dna(s: Column) -> Column:
    """Amino acids of all three frames in one text of the same length: the residue of a codon stands
    at the codon's last letter, the first two places are X, stops are ``$``, other codons X."""
    order = "TCAG"
    codons = [a + b + c for a in order for b in order for c in order]
    table = F.create_map(*[F.lit(x) for pair in zip(codons, GENETIC_CODE, strict=True) for x in pair])
    n = F.length(s)
    rest = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.coalesce(F.get(F.array(table[F.substring(s, i, F.lit(3))]), F.lit(0)), F.lit("X")))
    return F.when(n < 3, F.repeat(F.lit("X"), n)).otherwise(F.concat(F.lit("XX"), F.array_join(rest, "")))


def word_number(word: Column, letters: str, first: int = 0) -> Column:
    """The word as a number in base len(letters), most significant letter first; digits count from
    ``first``. Null where a letter is foreign."""
    base = len(letters) + first
    digits = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(letters), c).cast("bigint") - 1 + first)
    value = F.aggregate(digits, F.lit(0).cast("bigint"), lambda acc, d: acc * base + d)
    return F.when(F.exists(digits, lambda d: d < first), F.lit(None)).otherwise(value)


def number_word(number: Column, letters: str, length: int) -> Column:
    """Inverse of ``word_number`` for words of a known length."""
    base = len(letters)
    digits = F.transform(F.sequence(F.lit(length - 1), F.lit(0), F.lit(-1)), lambda k: F.substring(F.lit(letters), (F.floor(number / F.pow(F.lit(float(base)), k)) % base + 1).cast("int"), F.lit(1)))
    return F.array_join(digits, "")


def entropy(p: list[Column]) -> Column:
    """Relative entropy to four equal letters in bits: the sum of p * (2 + log2 p) over p > 0."""
    return sum((F.when(x > 0, x * (2 + F.log2(x))).otherwise(0.0) for x in p[1:]), F.when(p[0] > 0, p[0] * (2 + F.log2(p[0]))).otherwise(0.0))


def argmax_letter(p: list[Column], letters: str = "ACGT") -> Column:
    """The letter of the largest value, the earliest of equals."""
    top = F.greatest(*p)
    out = F.lit(letters[-1])
    for x, c in reversed(list(zip(p, letters, strict=True))):
        out = F.when(x >= top, F.lit(c)).otherwise(out)
    return out


def six_digits(x: Column) -> Column:
    """The number with six decimals as C prints it: the double itself is rounded, not its shortest decimal
    form, and only exact ties go to the even digit. From 16 on the decimal form is rounded."""
    a = F.abs(x)
    high = a * 134217729.0 - (a * 134217729.0 - a)  # the upper half of the bits: both products are exact
    up, rest = high * 1e6, (a - high) * 1e6
    whole = F.floor(up)
    over = up - whole - 0.5
    micro = whole + F.when((over > -rest) | ((over == -rest) & (whole % 2 == 1)), 1).otherwise(0)
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    exact = F.concat(sign, F.floor(micro / 1000000).cast("string"), F.lit("."), F.lpad((micro % 1000000).cast("string"), 6, "0"))
    return F.when(a < 16, exact).otherwise(F.format_string("%.6f", F.bround(x, 6)))
