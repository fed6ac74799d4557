"""Residue alphabets, packed into 64-bit words."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np

INVALID = 255

# Residue classes by alphabet, in class order; results depend on them.
CLASSES = {
    "protein": "A C D E F G H I K L M N P Q R S T V W Y",
    "murphy10": "LVIM C A G ST P FYW EDNQ KR H",
    "dayhoff": "AGPST C DENQ HKR ILMV FWY",
    "dna": "A C G TU",
    "murphy8": "LVIMC AG ST P FYW EDNQ KR H",
    "murphy12": "LVIM C A G ST P FY W EQ DN KR H",
    "murphy15": "LVIM C A G S T P FY W E Q D N KR H",
    "diamond11": "KREDQN C G H ILV M F Y W P STA",
    "seb6": "AST CP DEHKNQR FWY G ILMV",
    "seb8": "AST C DHN EKQR FWY G ILMV P",
    "seb10": "AST C DN EQ FY G HW ILMV KR P",
    "seb14": "A C D EQ FY G H IV KR LM N P ST W",
    "sev10": "AST C DEN FY G H ILMV KQR P W",
    "lia10": "AC DE FWY G HN IV KQR LM P ST",
    "lib10": "AST C DEQ FWY G HN IV KR LM P",
    "opt4": "CFILMVWY DEHKNQR PST AG",
    "opt6": "FHWY ILMV ACT DEQ GNS KPR",
    "opt8": "FHWY DEQ KNR AC GS IV LM PT",
    "opt10": "FHWY AC DN EQ IV KR LM PT G S",
    "opt12": "FWY AC EQ HN IV KR LM D G P S T",
    "opt14": "FWY AC EQ HN LM D G I K P R S T V",
}


@dataclass(frozen=True)
class Alphabet:
    """Classes of residues; letters of either case count, all other bytes break a word."""

    name: str
    classes: tuple[str, ...]

    @property
    def bits(self) -> int:
        return max(1, (len(self.classes) - 1).bit_length())

    @property
    def max_k(self) -> int:
        return 64 // self.bits

    @property
    def is_nucleotide(self) -> bool:
        return self.name == "dna"

    @cached_property
    def table(self) -> np.ndarray:
        """Class of each byte, ``INVALID`` for none."""
        table = np.full(256, INVALID, np.uint8)
        for i, letters in enumerate(self.classes):
            for c in letters:
                table[[ord(c), ord(c.lower())]] = i
        return table

    def letters(self) -> str:
        return "".join(self.classes)


@lru_cache
def alphabet(name: str) -> Alphabet:
    """The alphabet of that name, in any case."""
    try:
        return Alphabet(name.lower(), tuple(CLASSES[name.lower()].split()))
    except KeyError:
        raise ValueError(f"unknown alphabet {name!r}; there are {', '.join(CLASSES)}") from None
