"""Personal data: candidate spans scored by boosted trees, in DataFrame expressions only.

Four kinds: email, ip, card, phone. For each kind

* a **base** pattern with a check (octets at most 255, Luhn digits, digit counts) finds
  leftmost non-overlapping spans, all of which are kept;
* high-recall **generators** propose further, overlapping spans: addresses with a spelled-out
  at sign, colon-separated addresses, shorter card numbers, numbers without a plus sign. In a
  run of digit groups every window of groups with the digits of a card or a phone number is
  proposed, and of a spelled-out address every end;
* **boosted trees** over format and context features score every proposal, and proposals at
  or above a threshold, chosen per kind on held-out examples for a wanted precision, are
  added where they overlap no base span and no better proposal, of any kind.

The trees are trained on the driver from examples that this module generates by rule (no
corpus rows). Training and scoring use the same feature expressions; the trees become
``CASE`` expressions, so scoring stays in the JVM.

Null text is empty; texts without candidates give empty lists. Offsets are code points, end
exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, written with possessive loops and run starts so that no input makes
#: them backtrack or recurse: each matches what its plain form matches.
#: email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#: ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card   [0-9]([\x20-]?[0-9])+
#: phone  \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators: matches hold the proposals that ``proposals`` takes from them.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{2,63})++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Fa-f:])",
    "card": r"[0-9](?:[\x20-]?+[0-9])*+",
    "phone": r"\(?+[0-9](?:[\x20()./-]{0,2}+[0-9])*+",
}
#: How many digits a proposed window of digit groups has.
DIGITS = {"card": (13, 19), "phone": (7, 15)}
#: The end of a spelled-out address.
PART = r"\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{2,63}"
#: What must be in a text for a pattern to match; saves the scan where it is not.
NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.contains("."),
    "card": lambda t: F.lit(True),
    "phone": lambda t: t.contains("+"),
}
WIDE_NEEDS = {
    "email": lambda t: t.rlike(r"(?:\(at\)|\[at\]|\x20at\x20)"),
    "ip": lambda t: t.rlike(":[0-9A-Fa-f]{0,4}:"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.rlike(r"[0-9](?:[\x20()./-]{0,2}[0-9]){6}"),
}
#: Words before a span that speak for or against a kind.
CUES_FOR = r"(?i)(?:mail|e-mail|contact|write|call|phone|tel|fax|mobile|cell|whatsapp|card|visa|mastercard|amex|credit|ip|host|server|address|reach|llame|appel|anruf|karte|carte|tarjeta)\W*$"
CUES_AGAINST = r"(?i)(?:version|isbn|issn|order|invoice|ref|id|no|number|page|pages|vol|chapter|date|price|total|sku|serial|ticket|time|ratio|score)\W*$"

CONTEXT = 24


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.filter(F.split(F.reverse(number), ""), lambda d: d != ""),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")),
        lambda a, d: F.struct(
            (a["i"] + 1).alias("i"),
            (a["s"] + F.when(a["i"] % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))).alias("s"),
        ),
        lambda a: a["s"],
    )
    return total % 10 == 0


def _octets(x: Column) -> Column:
    """Whether every dotted part is at most 255, leading zeros or not."""
    return F.forall(F.split(x, r"\."), lambda p: p.rlike(r"^0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


CHECKS = {
    "email": lambda x: F.lit(True),
    "ip": _octets,
    "card": lambda x: let(digits(x), lambda d: F.length(d).between(16, 19) & luhn(d)),
    "phone": lambda x: F.length(digits(x)).between(8, 15),
}


def find(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, value), in code points.

    Java splits and extracts at the same matches, so the pieces between them place them.
    """
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def place(found: Column) -> Column:
        def step(a: Column, p: Column) -> Column:
            begin = a["at"] + F.length(p["gap"])
            end = begin + F.length(p["hit"])
            span = F.struct(begin.alias("start"), end.alias("end"), p["hit"].alias("value"))
            return F.struct(end.alias("at"), F.concat(a["spans"], F.array(span)).alias("spans"))

        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        return F.when(F.size(found) == 0, none).otherwise(
            F.aggregate(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), F.coalesce(m, F.lit("")).alias("hit"))), start, step, lambda a: a["spans"])
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _guarded(text: Column, needs: Column, pattern: str) -> Column:
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(needs, find(text, pattern)).otherwise(none)


def _windows(m: Column, kind: str) -> Column:
    """Every window of the digit groups of a match that has the digits of the kind."""
    least, most = DIGITS[kind]
    value = m["value"]

    def of(groups: Column) -> Column:
        def window(i: Column, j: Column) -> Column:
            first = groups[i]["start"]
            # a group's opening parenthesis is part of it
            begin = first - F.when((first > 0) & (F.substring(value, first, F.lit(1)) == "("), 1).otherwise(0)
            end = groups[j]["end"]
            return F.struct((m["start"] + begin).alias("start"), (m["start"] + end).alias("end"), F.substring(value, begin + 1, end - begin).alias("value"))

        def from_group(i: Column) -> Column:
            ends = F.sequence(i, F.least(i + most - 1, F.size(groups) - 1))
            return F.filter(F.transform(ends, lambda j: window(i, j)), lambda w: F.length(digits(w["value"])).between(least, most))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(groups) - 1), from_group))

    return let(find(value, "[0-9]++"), of)


def _ends(m: Column) -> Column:
    """A spelled-out address with every end that leaves it one."""
    cut = F.transform(
        find(m["value"], PART),
        lambda p: F.struct(m["start"].alias("start"), (m["start"] + p["end"]).alias("end"), F.substring(m["value"], F.lit(1), p["end"]).alias("value")),
    )
    return F.array_union(F.filter(cut, lambda x: x["value"].rlike(f"^{WIDE['email']}$")), F.array(F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))))


def proposals(text: Column, kind: str) -> Column:
    """Proposed spans (start, end, value) of a kind, which may overlap."""
    found = _guarded(text, WIDE_NEEDS[kind](text), WIDE[kind])
    if kind == "email":
        return F.flatten(F.transform(found, _ends))
    if kind not in DIGITS:
        return found
    least = DIGITS[kind][0]
    some = F.flatten(F.transform(F.filter(found, lambda m: F.length(m["value"]) >= least), lambda m: _windows(m, kind)))
    if kind == "phone":  # a part of a signed or dotted number is none
        some = F.filter(some, lambda w: (w["start"] == 0) | ~F.substring(text, w["start"], F.lit(1)).isin("+", "."))
    return some


# --------------------------------------------------------------------------- features

def features(kind: Column, value: Column, before: Column, after: Column) -> dict[str, Column]:
    """Format and context of a proposal as numbers; the same at training and scoring."""
    d = digits(value)
    size = F.greatest(F.length(value), F.lit(1))
    return {
        "n_digits": F.length(d).cast("double"),
        "n_chars": F.length(value).cast("double"),
        "digit_share": F.length(d) / size,
        "n_separators": F.length(F.regexp_replace(value, r"[^\x20()./-]", "")).cast("double"),
        "n_groups": F.size(F.filter(F.split(value, r"[^0-9A-Za-z]+"), lambda x: x != "")).cast("double"),
        "has_parens": value.contains("(").cast("double"),
        "first_digit": F.coalesce(F.left(d, F.lit(1)).try_cast("double"), F.lit(-1.0)),
        "luhn": F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)).cast("double"),
        "distinct_digits": F.size(F.array_distinct(F.filter(F.split(d, ""), lambda x: x != ""))).cast("double"),
        "date_like": value.rlike(r"^(?:[12][0-9]{3}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][12]?[0-9]{1,3})").cast("double"),
        "quad": value.rlike(r"^[0-9]+(?:\.[0-9]+){3}$").cast("double"),
        "hex_groups": F.size(F.filter(F.split(value, ":"), lambda x: x != "")).cast("double"),
        "colons": (F.length(value) - F.length(F.replace(value, F.lit(":"), F.lit("")))).cast("double"),
        "dot_word": value.rlike(r"(?i)(?:\.|dot[\])]?\x20?)[a-z]{2,}$").cast("double"),
        "bracketed": value.rlike(r"[(\[](?:at|dot)[)\]]").cast("double"),
        "cue_for": before.rlike(CUES_FOR).cast("double"),
        "cue_against": before.rlike(CUES_AGAINST).cast("double"),
        "glued": (before.rlike(r"[\p{L}\p{N}_#/=$€-]$") | after.rlike(r"^[\p{L}\p{N}_/=%€$-]")).cast("double"),
    }


FEATURES = (
    "n_digits", "n_chars", "digit_share", "n_separators", "n_groups", "has_parens", "first_digit", "luhn", "distinct_digits",
    "date_like", "quad", "hex_groups", "colons", "dot_word", "bracketed", "cue_for", "cue_against", "glued",
)


# --------------------------------------------------------------------------- training

def _luhn_number(prefix: str, size: int, salt: int) -> str:
    body = prefix + "".join(str((salt * 7919 + i * i * 31 + salt // (i + 1)) % 10) for i in range(size - len(prefix) - 1))
    total = sum(int(c) if i % 2 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(body)))
    return body + str(-total % 10)


def examples(n: int) -> list[tuple[str, str, str, str, int]]:
    """(kind, before, value, after, label), generated by rule; positives and look-alikes."""
    out = []
    names, hosts = ("anna", "j.doe", "info", "max_9", "k-lee"), ("example", "mail", "uni-x", "post")
    near = ("call me at ", "phone: ", "reach us on ", "my card is ", "server ", "", "and then ", "the ", "tel ")
    far = ("version ", "order no ", "isbn ", "page ", "invoice ", "id ", "between ", "of ", "ratio ")
    for i in range(n):
        a, b, c = 200 + i * 37 % 800, 200 + i * 53 % 800, 1000 + i * 7919 % 9000
        pos, neg = near[i % len(near)], far[i % len(far)]
        name, host = names[i % len(names)], hosts[i % len(hosts)]
        out += [
            ("phone", pos, (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a % 90 + 10} {b}{c}", f"00{a % 90 + 10} {b} {c}")[i % 5], (" ", ".", ",", "")[i % 4], 1),
            ("phone", (neg, pos)[i % 8 > 5], (f"20{i % 30:02d}-{i % 12 + 1:02d}-{i % 28 + 1:02d}", f"{a}{b}{c}", f"{i % 28 + 1:02d}.{i % 12 + 1:02d}.20{i % 30:02d}", f"{a}{b}{c}{a}", f"{c}/{a}/{b}", f"19{a % 90 + 10}-20{b % 90 + 10}", f"{a % 255}.{b % 255}.{c % 255}.{i}", f"1{b % 99}.{c % 99}.{a % 255}.{i}")[i % 8], (" ", "%", "", "kg")[i % 4], 0),
            ("card", pos, (_luhn_number("34", 15, i), _luhn_number("4", 13, i), _luhn_number("37", 15, i + 5))[i % 3], (" ", ".", "")[i % 3], 1),
            ("card", neg, f"{c}{a}{b}{c % 997}{i % 10}{a % 100:02d}"[: 13 + i % 3], (" ", "", "_")[i % 3], 0),
            ("ip", pos, (f"2001:db8:{i:x}:{a:x}::{b:x}", f"fe80::{a:x}:{b:x}:{c:x}:{i + 16:x}", f"2a02:{a:x}:{b:x}:{c:x}:{i:x}:1:2:{a:x}")[i % 3], (" ", ".", "")[i % 3], 1),
            ("ip", neg, (f"{i % 24:02d}:{i % 60:02d}:{a % 60:02d}", f"{a % 9}:{b % 9}:{c % 9}", "::", f":{i % 9}:{a % 10}")[i % 4], (" ", ".", "")[i % 3], 0),
            ("email", ("mail ", "", "write to ", "contact: ")[i % 4], (f"{name}(at){host}.com", f"{name} [at] {host} [dot] org", f"{name} [at] {host}.net", f"{name} (at) {host} (dot) de")[i % 4], (" ", ".", "")[i % 3], 1),
            ("email", ("we were ", "look ", "", "he is ")[i % 4], (f"{name} at {host}.Then", f"room at {host}.9{i}", f"arrived at noon.{host}", f"sold at {a}.{b}")[i % 4], (" ", ".", "")[i % 3], 0),
        ]
    return out


@dataclass(frozen=True)
class Tree:
    """Depth-two regression tree: a split, and a split with two values on either side."""

    split: tuple[int, float]
    sides: tuple[tuple[tuple[int, float], float, float], ...]

    def value(self, x: list[float]) -> float:
        (f, t), low, high = self.sides[x[self.split[0]] > self.split[1]]
        return high if x[f] > t else low

    def column(self, x: Column) -> Column:
        def side(s):
            (f, t), low, high = s
            return F.when(x[FEATURES[f]] > t, F.lit(high)).otherwise(F.lit(low))

        f, t = self.split
        return F.when(x[FEATURES[f]] > t, side(self.sides[1])).otherwise(side(self.sides[0]))


def _best_split(rows: list[int], xs: list[list[float]], g: list[float], h: list[float], cuts: list[list[float]]) -> tuple[int, float]:
    best, at = -1.0, (0, 0.0)
    for f, values in enumerate(cuts):
        for t in values:
            gl = hl = gr = hr = 0.0
            for i in rows:
                if xs[i][f] > t:
                    gr, hr = gr + g[i], hr + h[i]
                else:
                    gl, hl = gl + g[i], hl + h[i]
            gain = gl * gl / (hl + 1) + gr * gr / (hr + 1)
            if gain > best + 1e-12:
                best, at = gain, (f, t)
    return at


def boost(xs: list[list[float]], ys: list[int], rounds: int, rate: float) -> tuple[Tree, ...]:
    """Newton boosting of the logistic loss with depth-two trees; deterministic."""
    cuts = []
    for f in range(len(FEATURES)):
        values = sorted({x[f] for x in xs})
        step = max(1, len(values) // 12)
        cuts.append([(a + b) / 2 for a, b in zip(values[::step], values[1::step])])
    score, trees = [0.0] * len(xs), []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g, h = [y - q for y, q in zip(ys, p)], [q * (1 - q) for q in p]
        f, t = root = _best_split(list(range(len(xs))), xs, g, h, cuts)
        sides = []
        for upper in (False, True):
            own = [i for i in range(len(xs)) if (xs[i][f] > t) == upper]
            f2, t2 = split = _best_split(own, xs, g, h, cuts)
            leaf = []
            for top in (False, True):
                part = [i for i in own if (xs[i][f2] > t2) == top]
                leaf.append(round(rate * sum(g[i] for i in part) / (sum(h[i] for i in part) + 1), 6))
            sides.append((split, *leaf))
        tree = Tree(root, tuple(sides))
        trees.append(tree)
        score = [s + tree.value(x) for s, x in zip(score, xs)]
    return tuple(trees)


@dataclass(frozen=True)
class Model:
    """Trees and a score threshold for each kind."""

    trees: dict[str, tuple[Tree, ...]]
    threshold: dict[str, float]


def train(spark: SparkSession, n_examples: int = 60, rounds: int = 12, rate: float = 0.4, precision: float = 0.98) -> Model:
    """Fits the trees on generated examples; every third example is held out for the threshold.

    The threshold of a kind is the lowest score at which the held-out precision reaches
    ``precision``; a kind that never reaches it accepts no proposal.
    """
    rows = spark.createDataFrame([(i, *e) for i, e in enumerate(examples(n_examples))], "i int, kind string, before string, value string, after string, label int").coalesce(1)
    f = features(F.col("kind"), F.col("value"), F.col("before"), F.col("after"))
    found = rows.select("i", "kind", "label", *[f[k].alias(k) for k in FEATURES]).orderBy("i").collect()  # n_examples * 8 rows
    trees, threshold = {}, {}
    for kind in KINDS:
        own = [r for r in found if r["kind"] == kind]
        data = [([float(r[k]) for k in FEATURES], r["label"]) for r in own]
        fit, held = [d for k, d in enumerate(data) if k % 6 < 4], [d for k, d in enumerate(data) if k % 6 >= 4]
        trees[kind] = boost([x for x, _ in fit], [y for _, y in fit], rounds, rate)
        scored = sorted(((sum(t.value(x) for t in trees[kind]), y) for x, y in held), reverse=True)
        best = math.inf
        for k, (s, _) in enumerate(scored):
            chosen = [y for v, y in scored if v >= s]
            if sum(chosen) >= precision * len(chosen):
                best = min(best, s)
        threshold[kind] = max(best, 0.0)
    return Model(trees, threshold)


# --------------------------------------------------------------------------- redaction

def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def base_spans(text: Column, kind: str) -> Column:
    """The base spans of a kind as (start, end)."""
    good = F.filter(_guarded(text, NEEDS[kind](text), BASE[kind]), lambda m: CHECKS[kind](m["value"]))
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


def added_spans(text: Column, model: Model, taken: Column) -> Column:
    """The proposals of all kinds that the model accepts, as (rank, start, end) with the rank of the kind: best first,
    none that overlaps one of ``taken`` or a better one of any kind."""

    def scored(kind: str) -> Column:
        def of(m: Column) -> Column:
            before = F.substring(text, F.greatest(m["start"] - CONTEXT, F.lit(0)) + 1, F.least(m["start"], F.lit(CONTEXT)))
            after = F.substring(text, m["end"] + 1, F.lit(2))
            x = F.struct(*[v.alias(k) for k, v in features(F.lit(kind), m["value"], before, after).items()])
            score = let(x, lambda x: sum((t.column(x) for t in model.trees[kind]), F.lit(0.0)))
            # of equal scores the longer span is the better one, then the earlier, then the earlier kind
            return F.struct((-score).alias("loss"), (m["start"] - m["end"]).alias("back"), m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"))

        free = F.filter(proposals(text, kind), lambda m: ~F.exists(taken, lambda k: _overlaps(k, m)))
        return F.filter(F.transform(free, of), lambda s: s["loss"] <= -model.threshold[kind])

    return F.aggregate(
        F.sort_array(F.concat(*map(scored, KINDS))),
        F.array().cast("array<struct<rank:int,start:int,end:int>>"),
        lambda a, s: F.when(F.exists(a, lambda k: _overlaps(k, s)), a).otherwise(F.concat(a, F.array(F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"))))),
    )


def spans_of(text: Column, model: Model) -> Column:
    """A struct of kinds, each with its base and its added spans. Base spans are found once."""

    def both(base: Column) -> Column:
        def of_kind(added: Column, rank: int) -> Column:
            own = F.filter(added, lambda s: s["rank"] == rank)
            return F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

        taken = F.concat(*[base[k] for k in KINDS])
        added = let(taken, lambda all_base: added_spans(text, model, all_base))
        return let(added, lambda all_added: F.struct(*[F.struct(base[k].alias("base"), of_kind(all_added, rank).alias("added")).alias(k) for rank, k in enumerate(KINDS)]))

    return let(F.struct(*[base_spans(text, k).alias(k) for k in KINDS]), both)


def detect(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, and for each kind a struct of its base and its added spans)."""
    found = spans_of(F.coalesce(F.col(text), F.lit("")), model)
    return docs.select(F.col(key), found.alias("__found")).select(key, "__found.*")


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with every span in ``text`` replaced by ``[KIND]``; other columns as they are.

    Of base spans that overlap, the one that starts first is replaced (the longer, then the
    earlier kind, of those that start together), and the rest of the others is cut as well.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def ranked(found: Column) -> Column:
        def of(rank: int) -> Column:
            own = found[KINDS[rank]]
            return F.transform(F.concat(own["base"], own["added"]), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(rank).alias("rank")))

        return F.sort_array(F.concat(*map(of, range(len(KINDS)))))

    def cut(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(a: Column, s: Column) -> Column:
            fresh = s["start"] >= a["at"]
            piece = F.when(fresh, F.concat(F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["rank"]))).otherwise(F.lit(""))
            return F.struct(F.greatest(a["at"], -s["back"]).alias("at"), F.concat(a["out"], F.array(piece)).alias("out"))

        return F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.length(t))))

    def clean(spans: Column) -> Column:
        return F.when(F.size(spans) == 0, F.col(text)).otherwise(cut(spans))

    return docs.withColumn(text, let(let(spans_of(t, model), ranked), clean))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the hash of the base spans and all spans as text, per document."""

    def listed(part) -> Column:
        def of(k: str) -> Column:
            return F.transform(F.sort_array(part(k)), lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")))

        return F.concat(*map(of, KINDS))

    return found.select(
        F.col(key),
        *[F.size(F.col(k)["base"]).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(listed(lambda k: F.col(k)["base"]), ","), 256).alias("base_sha256"),
        F.array_join(listed(lambda k: F.concat(F.col(k)["base"], F.col(k)["added"])), ",").alias("spans"),
    )
