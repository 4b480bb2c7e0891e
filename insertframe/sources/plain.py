"""Driver-side sequence helpers for single records (library import)."""

from __future__ import annotations

import re

from insertframe.functions.seq import CODONS, FAMILIES


def clean(raw: str) -> str:
    return re.sub("[^A-Za-z]", "", raw).upper()


def translate(raw: str) -> str:
    nt = clean(raw).replace("U", "T")
    return "".join(CODONS.get(c) or FAMILIES.get(c[:2]) or "X" for c in re.findall("...", nt))


def translate_to_stop(raw: str) -> str:
    return translate(raw).split("*", 1)[0]
