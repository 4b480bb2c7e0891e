"""The lab library and project settings; library import and additive merge."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insertframe.functions.seq import CLASS_OF
from insertframe.operators.naming import DEFAULT, Profile
from insertframe.sources.json5 import parse as parse_json5


@dataclass(frozen=True)
class Alignment:
    protein_gap_open: int = -11
    protein_gap_extend: int = -1
    nt_match: int = 2
    nt_mismatch: int = -3
    nt_gap_open: int = -5
    nt_gap_extend: int = -1
    backbone_identity_min: float = 0.97
    overhang_max_mismatch: int = 1


@dataclass(frozen=True)
class Checks:
    gc_max_global: float = 0.56
    gc_max_window: float = 0.64
    gc_window: int = 60
    rare_codon_min_frequency: float = 0.05
    species: str = "h_sapiens"
    enabled: bool = True


@dataclass(frozen=True)
class Vector:
    id: str
    chain_class: str
    sequence: str
    oh5_end: int
    oh3_start: int
    constant_anchor_aa: str
    display_name: str = ""
    isotype: str = ""
    topology: str = "circular"
    features: dict = field(default_factory=dict)
    overhang_set: str = ""
    overhang_locus: str = ""
    provenance: dict = field(default_factory=dict)

    @property
    def clean(self) -> str:
        return re.sub("[^A-Za-z]", "", self.sequence).upper()

    def landmark(self) -> str:
        """200 letters from the constant region, else from the insert's 3' end."""
        region = self.features.get("constant_region")
        start = max(region["start"] - 1, 0) if region else self.oh3_start
        return self.clean[start : start + 200]

    def leader(self) -> str:
        return self.clean[: self.oh5_end]


@dataclass
class Library:
    vectors: list[Vector] = field(default_factory=list)
    overhang_sets: dict[str, dict[str, tuple[str | None, str | None]]] = field(default_factory=dict)
    profiles: dict[str, Profile] = field(default_factory=dict)
    alignment: Alignment = field(default_factory=Alignment)
    checks: Checks = field(default_factory=Checks)
    schema_version: int = 1

    def vector(self, id: str | None) -> Vector | None:
        return next((v for v in self.vectors if v.id == id), None)

    def merge_from(self, other: Library) -> list[str]:
        """Adds another library's vectors, overhang sets and profiles; what is there stays. The settings
        stay as well. Says which vectors came in under another id than the first of their sequence."""
        conflicts = []
        for v in list(other.vectors):
            first = next((e for e in self.vectors if e.clean == v.clean), None)
            if first is not None and first.id == v.id:
                continue
            if first is not None:
                conflicts.append(f"vector '{v.id}' has the same sequence as existing '{first.id}'; kept both")
            self.vectors.append(v)
        for id, own in other.overhang_sets.items():
            self.overhang_sets.setdefault(id, own)
        for id, own in other.profiles.items():
            self.profiles.setdefault(id, own)
        return conflicts

    @classmethod
    def from_json5(cls, text: str) -> Library:
        raw = parse_json5(text)
        vectors = []
        for v in raw.get("vectors", []):
            site = v.get("insertion_site", {})
            vectors.append(Vector(v["id"], v["chain_class"], v.get("sequence", ""), site.get("oh5_end", 0), site.get("oh3_start", 0), v.get("constant_anchor_aa", ""), v.get("display_name", ""), v.get("isotype", ""), v.get("topology", "circular"), v.get("features", {}), v.get("overhang_set", ""), v.get("overhang_locus", ""), v.get("provenance", {})))
        sets: dict = {}
        for s in raw.get("overhang_sets", []):
            loci = [x for x in CLASS_OF if x in s.get("oh_5", {}) or x in s.get("oh_3", {})]
            sets.setdefault(s["id"], {x: (s.get("oh_5", {}).get(x), s.get("oh_3", {}).get(x)) for x in loci})
        profiles: dict = {}
        for p in raw.get("naming_profiles", []):
            own = {k: tuple(v) for k, v in p.get("chain_synonyms", {}).items()}
            profiles.setdefault(p["id"], Profile(own, tuple(p.get("separators", DEFAULT.separators)), p.get("id_regex") is not None))
        known = set(Alignment.__dataclass_fields__)
        checks = raw.get("optimization_checks")
        return cls(
            vectors, sets, profiles,
            Alignment(**{k: v for k, v in raw.get("alignment", {}).items() if k in known}),
            # a section without the switch is off; without the section, on
            Checks() if checks is None else Checks(**{"enabled": False} | {k: v for k, v in checks.items() if k in Checks.__dataclass_fields__}),
            raw.get("schema_version", 1),
        )

    def to_json(self) -> str:
        vectors = [
            {"id": v.id, "display_name": v.display_name, "chain_class": v.chain_class, "isotype": v.isotype, "topology": v.topology, "length": len(v.clean), "features": v.features, "insertion_site": {"oh5_end": v.oh5_end, "oh3_start": v.oh3_start}, "constant_anchor_aa": v.constant_anchor_aa, "overhang_set": v.overhang_set, "overhang_locus": v.overhang_locus, "provenance": v.provenance, "sequence": v.sequence}
            for v in self.vectors
        ]
        sets = [{"id": k, "oh_5": {x: a for x, (a, _) in s.items() if a is not None}, "oh_3": {x: b for x, (_, b) in s.items() if b is not None}} for k, s in self.overhang_sets.items()]
        profiles = [{"id": k, "chain_synonyms": p.synonyms, "separators": p.separators} | ({"id_regex": "suffix"} if p.fallback else {}) for k, p in self.profiles.items()]
        return json.dumps({"schema_version": self.schema_version, "vectors": vectors, "overhang_sets": sets, "naming_profiles": profiles, "alignment": self.alignment.__dict__, "optimization_checks": self.checks.__dict__}, indent=2, ensure_ascii=False)


@dataclass
class Project:
    """A campaign: a vector for each chain class, an overhang set, a naming profile, its files, and
    names that override parsed ones, as {record: (ab_id, chain_class)}."""

    assignments: dict[str, str] = field(default_factory=dict)
    overhang_set: str = ""
    profile: str = ""
    name: str = ""
    created: str = ""
    description: str = ""
    ground_truth: dict | None = None
    order: dict | None = None
    sequencing: dict | None = None
    overrides: dict[str, tuple[str, str]] = field(default_factory=dict)
    schema_version: int = 1

    @classmethod
    def from_json5(cls, text: str) -> Project:
        """``name``, ``overhang_set`` and ``vector_assignments`` must be there; the rest has defaults."""
        raw = parse_json5(text)
        missing = [k for k in ("name", "overhang_set", "vector_assignments") if k not in raw]
        if missing:
            raise ValueError(f"project: no {', '.join(missing)}")
        files = {"ground_truth": {"format": "", "columns": {}}, "order": {"format": "", "has_overhangs": True}, "sequencing": {"mode": "", "inputs": []}}
        specs = {k: default | raw[k] if raw.get(k) is not None else None for k, default in files.items()}
        own = {k: (v["ab_id"], v["chain_class"]) for k, v in raw.get("name_overrides", {}).items()}
        return cls(dict(raw["vector_assignments"]), raw["overhang_set"], raw.get("naming_profile", "default"), raw["name"], raw.get("created", ""), raw.get("description", ""), *specs.values(), own, raw.get("schema_version", 1))

    def to_json(self) -> str:
        specs = {k: v for k, v in (("ground_truth", self.ground_truth), ("order", self.order), ("sequencing", self.sequencing)) if v is not None}
        own = {k: {"ab_id": a, "chain_class": c} for k, (a, c) in sorted(self.overrides.items())}
        head = {"schema_version": self.schema_version, "name": self.name, "created": self.created, "description": self.description, "naming_profile": self.profile, "overhang_set": self.overhang_set, "vector_assignments": dict(sorted(self.assignments.items()))}
        return json.dumps(head | specs | {"name_overrides": own}, indent=2, ensure_ascii=False)

    def overrides_frame(self, spark: SparkSession) -> DataFrame:
        """Rows (record_id, ab_id, chain_class), as ``naming.with_names`` takes them."""
        return spark.createDataFrame([(k, a, c) for k, (a, c) in self.overrides.items()], "record_id string, ab_id string, chain_class string")

    @classmethod
    def ad_hoc(cls, library: Library, heavy_vector: str | None = None, overhang_set: str | None = None) -> Project:
        """The first vector of each class, the first overhang set and the first profile."""
        own: dict[str, str] = {}
        for v in library.vectors:
            own.setdefault(v.chain_class, v.id)
        if heavy_vector:
            own["heavy"] = heavy_vector
        return cls(own, overhang_set or next(iter(library.overhang_sets), ""), next(iter(library.profiles), ""))

    def candidates(self, library: Library) -> list[Vector]:
        """Assigned vectors by class name, then the rest of the library, each once."""
        ids = [self.assignments[c] for c in sorted(self.assignments)] + [v.id for v in library.vectors]
        return [v for v in (library.vector(i) for i in dict.fromkeys(ids)) if v is not None]


def last_wins(rows: DataFrame, keys: list[str], idx: str, values: list[str]) -> DataFrame:
    """One row per key, the last by ``idx``; partial maxima are taken before the shuffle."""
    best = F.max_by(F.struct(*values), idx)
    return rows.groupBy(*keys).agg(best.alias("__v")).select(*keys, "__v.*")


def first_wins(rows: DataFrame, keys: list[str], idx: str, values: list[str]) -> DataFrame:
    best = F.min_by(F.struct(*values), idx)
    return rows.groupBy(*keys).agg(best.alias("__v")).select(*keys, "__v.*")


def merge(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Additive merge of (id, sha256, idx, ...): rows to append, and conflicts (id, sha256, existing_id).

    Each incoming row is held against the first entry of its hash, incoming ones counting for those
    after them: under the same id it is skipped, under another it is kept and reported; of a new
    hash it is appended. A first entry is a partial minimum, so no hash gathers its rows.
    """
    side = lambda df, new: df.select("sha256", F.struct(F.lit(new).alias("new"), F.col("idx").cast("long").alias("idx"), "id").alias("e"))
    firsts = side(existing, 0).union(side(incoming, 1)).groupBy("sha256").agg(F.min("e").alias("first"))
    own = (F.col("first.new") == 1) & (F.col("first.idx") == F.col("idx")) & (F.col("first.id") == F.col("id"))
    rows = incoming.join(firsts, "sha256").withColumn("own", own).filter(F.col("own") | (F.col("first.id") != F.col("id")))
    return rows.select(*incoming.columns), rows.filter("not own").select("id", "sha256", F.col("first.id").alias("existing_id"))


def load(spark: SparkSession, path: str, kind: type[Library] | type[Project]) -> Library | Project:
    """A library or a project from a JSON5 file, wherever Spark reads."""
    return kind.from_json5("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def save(spark: SparkSession, path: str, what: Library | Project) -> None:
    """Writes a library or a project as one JSON file, wherever Spark writes."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(what.to_json(), "utf-8"))
    out.close()


def vectors_frame(spark: SparkSession, vectors: list[Vector]) -> DataFrame:
    rows = [(i, v.id, v.display_name, v.chain_class, v.clean, v.oh5_end, v.oh3_start, v.constant_anchor_aa) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "ord int, vector_id string, display_name string, vector_class string, vector_seq string, oh5_end int, oh3_start int, anchor string")


def vector_from_genbank(record: dict, id: str, display_name: str, chain_class: str, isotype: str, overhangs: tuple[str | None, str | None], overhang_set: str, locus: str, added_by: str) -> Vector:
    """A vector from a parsed GenBank record: insertion ends from the overhangs, else from features."""
    from insertframe.sources.genbank import roles
    from insertframe.sources.plain import translate_to_stop

    sequence = re.sub("[^A-Za-z]", "", record["sequence"]).upper()
    found = roles(record["features"])
    oh5, oh3 = (x or "" for x in overhangs)
    at5, at3 = (sequence.find(x) if x else -1 for x in (oh5, oh3))
    signal, constant = found.get("signal_peptide"), found.get("constant_region")
    oh5_end = at5 + len(oh5) if at5 >= 0 else signal["end"] if signal else 0
    oh3_start = at3 if at3 >= 0 else max(constant["start"] - 1, 0) if constant else oh5_end
    anchor = translate_to_stop(sequence[oh3_start:])[:8]
    topology = "circular" if record["circular"] else "linear"
    return Vector(id, chain_class, sequence, oh5_end, oh3_start, anchor, display_name, isotype, topology, found, overhang_set, locus, {"added_by": added_by, "added": "", "source_file": record["name"]})
