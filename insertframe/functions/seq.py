"""Sequence functions as native Column expressions (no Python on the executors but for windows of GC and reading frames).

All take any text and clean it first: ASCII letters alone, upper-cased.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from insertframe.functions import kernels

# The standard genetic code, codons in TCAG order, the third base fastest.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

CODONS = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
#: Pairs of bases that decide the amino acid whatever follows, even a letter that is no base.
FAMILIES = {p: CODONS[p + "T"] for p in (a + b for a in BASES for b in BASES) if len({CODONS[p + c] for c in BASES}) == 1}


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, even where lambdas close over it."""
    return F.transform(F.array(value), body)[0]


def clean(raw: Column) -> Column:
    """ASCII letters, upper-cased; filtered first, as other letters may upper-case into ASCII."""
    return F.upper(F.regexp_replace(raw, "[^A-Za-z]", ""))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.greatest(whole, F.lit(1)))


def letters(s: Column, wanted: str) -> Column:
    """How many letters of ``s`` are among the wanted ones."""
    return F.length(F.regexp_replace(s, f"[^{wanted}]", ""))


def detect_type(raw: Column) -> Column:
    """``nt`` if at least nine tenths of the letters are nucleotides, else ``aa``; empty is ``aa``."""
    s = clean(raw)
    return F.when(mostly_bases(s), "nt").otherwise("aa")


def mostly_bases(cleaned: Column) -> Column:
    return (F.length(cleaned) > 0) & (10 * letters(cleaned, "ACGTUN") >= 9 * F.length(cleaned))


def revcomp(raw: Column) -> Column:
    return revcomp_of(clean(raw))


def revcomp_of(cleaned: Column) -> Column:
    return F.reverse(F.translate(cleaned, "ATUGC", "TAACG"))


def translate(raw: Column, frame: int = 0) -> Column:
    """The protein of a reading frame; stops are ``*``, unknown codons ``X``, a rest is dropped.

    Four-fold families take any third letter.
    """
    return _translated(clean(raw), frame)


#: A codon as four hexadecimal digits of one letter's code: a 0 and its letters by their place here.
DIGITS = BASES + "U" + "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in BASES + "U")
_DIGIT = {c: "01230"[i] if i < 5 else "4" for i, c in enumerate(DIGITS)}
_AMINO = {chr(256 * i + 16 * j + k): CODONS.get(c, FAMILIES.get(c[:2], "X")) for i, a in enumerate(BASES + "N") for j, b in enumerate(BASES + "N") for k, d in enumerate(BASES + "N") for c in (a + b + d,)}


def _translated(cleaned: Column, frame: int) -> Column:
    """Every codon becomes one letter of UTF-16, and each of these its residue: whole strings at a time."""
    digits = F.translate(cleaned, DIGITS, "".join(_DIGIT[c] for c in DIGITS))
    if frame:
        digits = F.substring(digits, frame + 1, 1 << 30)
    whole = F.left(digits, F.length(digits) - F.length(digits) % 3)
    codons = F.decode(F.unhex(F.regexp_replace(whole, "(...)", "0$1")), "UTF-16BE")
    return F.translate(codons, "".join(_AMINO), "".join(_AMINO.values()))


def to_stop(protein: Column) -> Column:
    return F.substring_index(protein, "*", 1)


def translate_to_stop(raw: Column) -> Column:
    return to_stop(translate(raw))


def first_stop(protein: Column) -> Column:
    """The 0-based place of the first stop, null if none."""
    at = F.instr(protein, "*")
    return F.when(at > 0, at - 1)


def gc_fraction(raw: Column) -> Column:
    s = clean(raw)
    return share(letters(s, "GC"), F.length(s))


def max_windowed_gc(raw: Column, window: int) -> Column:
    """The largest GC share of any window; the share of the whole where it fits no window.

    Running sums over the letters, in numpy, so time is linear in the sequence whatever the window.
    """
    return kernels.max_window_gc(clean(raw), window) if window > 0 else gc_fraction(raw)


def sha256_hex(raw: Column) -> Column:
    return F.sha2(clean(raw), 256)


def mismatches(a: Column, b: Column) -> Column:
    """Differing letters of two strings, over the shorter one's length."""
    n = F.least(F.length(a), F.length(b))

    def chars(s: Column) -> Column:
        return F.split(F.left(s, n), "")

    differ = F.zip_with(chars(a), chars(b), lambda x, y: (x != y).cast("int"))
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(differ, F.lit(0), lambda t, v: t + F.coalesce(v, F.lit(0))))


def rotate(s: Column, n: Column) -> Column:
    """Circular rotation to the left."""
    k = F.when(F.length(s) > 0, F.pmod(n, F.length(s))).otherwise(F.lit(0))
    return F.concat(F.substring(s, k + 1, F.length(s)), F.left(s, k))


def assemble(vector: Column, core: Column, oh5_end: Column, oh3_start: Column) -> Column:
    """The vector with the core between its two insertion ends, which are clamped to it."""
    v = clean(vector)
    return F.concat(F.left(v, F.least(oh5_end, F.length(v))), core, F.substring(v, F.least(oh3_start, F.length(v)) + 1, F.length(v)))


def prefix_mismatches(s: Column, overhang: Column) -> Column:
    """Mismatches of an overhang at the start of ``s``; null where ``s`` is shorter."""
    return F.when(F.length(s) >= F.length(overhang), mismatches(F.left(s, F.length(overhang)), overhang))


def suffix_mismatches(s: Column, overhang: Column) -> Column:
    return F.when(F.length(s) >= F.length(overhang), mismatches(F.right(s, F.length(overhang)), overhang))


def strip_overhangs(raw: Column, oh5: Column, oh3: Column, most: int) -> Column:
    """A struct: the core between the overhangs that are present, and what was found at each end.

    An empty overhang is present with no mismatch. Overhangs that cross leave an empty core.
    """

    def of(s: Column) -> Column:
        # a lambda evaluates what it holds wherever it is named: the ends are looked at once
        ends = F.struct(prefix_mismatches(s, oh5).alias("m5"), suffix_mismatches(s, oh3).alias("m3"), F.length(s).alias("n"))
        return let(ends, lambda e: cut(s, e["m5"], e["m3"], e["n"]))

    def cut(s: Column, m5: Column, m3: Column, n: Column) -> Column:
        p5, p3 = F.coalesce(m5 <= most, F.lit(False)), F.coalesce(m3 <= most, F.lit(False))
        lo = F.when(p5, F.length(oh5)).otherwise(F.lit(0))
        hi = n - F.when(p3, F.length(oh3)).otherwise(F.lit(0))
        core = F.when(hi > lo, F.substring(s, lo + 1, hi - lo)).otherwise(F.lit(""))
        return F.struct(core.alias("core"), F.coalesce(m5, F.length(oh5)).alias("oh5_mismatches"), F.coalesce(m3, F.length(oh3)).alias("oh3_mismatches"), p5.alias("oh5_present"), p3.alias("oh3_present"))

    return let(clean(raw), of)


LOCI = ("IGH", "IGK", "IGL")
CLASS_OF = {"IGH": "heavy", "IGK": "kappa", "IGL": "lambda"}
LOCUS_OF = {v: k for k, v in CLASS_OF.items()}


def locus_from_overhangs(raw: Column, overhangs: dict[str, tuple[str | None, str | None]], most: int) -> Column:
    """The locus whose 3' overhang the fragment has, else whose 5' one; ties in the order of LOCI."""

    def of(s: Column) -> Column:
        def near(at, side: int) -> list[tuple[str, Column]]:
            return [(x, at(s, F.lit(overhangs[x][side])) <= most) for x in LOCI if x in overhangs and overhangs[x][side] is not None]

        out = None
        for locus, hit in near(suffix_mismatches, 1) + near(prefix_mismatches, 0):
            out = F.when(hit, locus) if out is None else out.when(hit, locus)
        return F.lit(None).cast("string") if out is None else out

    return let(clean(raw), of)


# Constant- and joining-region motifs of each locus.
MOTIFS = {"IGH": ("ASTKGP", "VTVSS"), "IGK": ("TKVEIK", "RTVAAP"), "IGL": ("GQPKAAP", "QPKAAPSV")}


def locus_from_protein(protein: Column) -> Column:
    out = None
    for locus, motifs in MOTIFS.items():
        hit = protein.contains(motifs[0]) | protein.contains(motifs[1])
        out = F.when(hit, locus) if out is None else out.when(hit, locus)
    return out


def _code() -> kernels.Code:
    letters = np.full(256, 4)
    letters[[ord(c) for c in BASES + "U"]] = [0, 1, 2, 3, 0]
    codons = [a + b + c for a in BASES + "N" for b in BASES + "N" for c in BASES + "N"]
    return kernels.Code(letters, np.frombuffer("".join(CODONS.get(c, FAMILIES.get(c[:2], "X")) for c in codons).encode(), np.uint8))


def protein_of(cleaned: Column) -> Column:
    """What ``translate`` gives of a cleaned sequence, in numpy: for whole columns, where it need not be an expression."""
    return kernels.protein(cleaned, _code())


def protein_to_stop(raw: Column) -> Column:
    """What ``translate_to_stop`` gives, in numpy: for whole columns of long sequences."""
    return kernels.protein_to_stop(raw, _code())


def best_frame_protein(raw: Column) -> Column:
    """Of three forward frames the longest protein before a stop, the lowest frame on ties."""
    return kernels.best_frame(clean(raw), _code())


def locate_orf(raw: Column, leader: Column) -> Column:
    """The translation from the earliest leader (its first 8 residues) in any forward frame, by
    residue and then by frame; frame 0 from the start where there is none."""
    return locate_orf_in(clean(raw), leader)


def locate_orf_in(cleaned: Column, leader: Column) -> Column:
    return kernels.orf_from(cleaned, F.left(leader, F.lit(8)), _code())


def extract_insert(raw: Column, vector: Column, oh5_end: Column, core_len: Column) -> Column:
    """The insert of a read: placed by the first 30 letters of the leader, null where it is not whole."""
    return extract_insert_from(clean(raw), vector, oh5_end, core_len)


def extract_insert_from(cleaned: Column, vector: Column, oh5_end: Column, core_len: Column) -> Column:

    def of(s: Column) -> Column:
        v = clean(vector)
        probe = F.left(v, F.least(oh5_end, F.lit(30)))
        at = F.when(F.length(probe) == 0, F.lit(1)).otherwise(F.call_function("instr", s, probe))
        start = at - 1 + oh5_end
        return F.when((at > 0) & (start + core_len <= F.length(s)), F.substring(s, start + 1, core_len))

    return let(cleaned, of)
