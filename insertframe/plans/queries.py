"""Registered queries of the construct-verification engine, with their DuckDB SQL.

The driver's tables hold no sequences: nucleotides are made from whole texts, letter by letter,
by the same rule in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from insertframe.functions import kernels, seq
from insertframe.operators import coverage, library, naming, order_qc, rollup, sequencing_qc

ALPHABET, DEALT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"

# Overhangs of the planted constructs, and a small vector that holds them: letters of our own.
OH = {"IGH": ("TCGGACTGCATAAGGAACCT", "GATCCGAACTACGTTTGGCA"), "IGK": ("CTAGAACCTTGGAACGTCAT", "TTCAGGACCCATGATCGTAC"), "IGL": ("CTAGAACCTTGGAACGTCAT", "AAGCTCTGGTACCCGATGAA")}
LEADER = "ATGGCTCAAACCGATT" + OH["IGH"][0]
CONSTANT = OH["IGH"][1] + "TACCAAAGGCTCTCTGGCATAA"
ANCHOR = "DPNYVWHT"
LANDMARKS = {f"v{i}": ends[1] for i, ends in enumerate(OH.values())}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nt(text: Column) -> Column:
    return F.translate(seq.clean(F.coalesce(text, F.lit(""))), ALPHABET, DEALT)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", nt(F.col("text")).alias("nt"))


# ---- SQL pieces -----------------------------------------------------------------------------

CLEAN = "upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))"
NT = f"translate({CLEAN}, '{ALPHABET}', '{DEALT}')"


def _sql_translate(s: str) -> str:
    at = lambda i: f"(instr('TCAG', substr(c, {i}, 1)) - 1)"
    return f"array_to_string(list_transform(regexp_extract_all({s}, '...'), lambda c: substr('{seq.AMINO_ACIDS}', {at(1)} * 16 + {at(2)} * 4 + {at(3)} + 1, 1)), '')"


def _sql_hamming(a: str, b: str, n: int) -> str:
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: (substr({a}, i, 1) <> substr({b}, i, 1))::int))"


def _sql_gc_windows(s: str, w: int) -> str:
    count = lambda x: f"length(regexp_replace({x}, '[^GC]', '', 'g'))"
    whole = f"CASE WHEN length({s}) = 0 THEN 0.0 ELSE {count(s)} / length({s})::double END"
    return f"CASE WHEN length({s}) <= {w} THEN {whole} ELSE list_max(list_transform(range(1, length({s}) - {w} + 2), lambda i: {count(f'substr({s}, i, {w})')})) / {w}.0 END"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- scalar functions -----------------------------------------------------------------------

@query(f"SELECT doc_id, {CLEAN} AS cleaned FROM documents")
def seq_clean(spark, d):
    return _table(spark, d, "documents").select("doc_id", seq.clean(F.coalesce("text", F.lit(""))).alias("cleaned"))


@query(f"SELECT doc_id, CASE WHEN length(c) > 0 AND 10 * length(regexp_replace(c, '[^ACGTUN]', '', 'g')) >= 9 * length(c) THEN 'nt' ELSE 'aa' END AS kind FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {NT} ELSE {CLEAN} END AS c FROM documents)")
def seq_detect_type(spark, d):
    t = _table(spark, d, "documents")
    return t.select("doc_id", seq.detect_type(F.when(F.col("doc_id") % 3 == 0, nt(F.col("text"))).otherwise(F.coalesce("text", F.lit("")))).alias("kind"))


@query(f"SELECT doc_id, reverse(translate({NT}, 'ATGC', 'TACG')) AS revcomp FROM documents")
def seq_revcomp(spark, d):
    return _docs(spark, d).select("doc_id", seq.revcomp(F.col("nt")).alias("revcomp"))


@query(f"SELECT doc_id, sha256({CLEAN}) AS sha256 FROM documents")
def seq_sha256(spark, d):
    return _table(spark, d, "documents").select("doc_id", seq.sha256_hex(F.coalesce("text", F.lit(""))).alias("sha256"))


@query(f"SELECT doc_id, {_sql_translate(NT)} AS protein FROM documents")
def seq_translate(spark, d):
    return _docs(spark, d).select("doc_id", seq.translate(F.col("nt")).alias("protein"))


@query(f"SELECT doc_id, split_part({_sql_translate(NT)}, '*', 1) AS protein FROM documents")
def seq_translate_to_stop(spark, d):
    return _docs(spark, d).select("doc_id", seq.translate_to_stop(F.col("nt")).alias("protein"))


@query(f"SELECT doc_id, length(s) AS n, CASE WHEN length(s) = 0 THEN 0.0::double ELSE round(length(regexp_replace(s, '[^GC]', '', 'g')) / length(s)::double, 6) END AS gc FROM (SELECT doc_id, {NT} AS s FROM documents)")
def seq_gc(spark, d):
    return _docs(spark, d).select("doc_id", F.length("nt").cast("long").alias("n"), F.round(seq.gc_fraction(F.col("nt")), 6).alias("gc"))


@query(f"SELECT doc_id, round(({_sql_gc_windows('s', 60)})::double, 6) AS max_gc FROM (SELECT doc_id, {NT} AS s FROM documents)")
def seq_max_window_gc(spark, d):
    return _docs(spark, d).select("doc_id", F.round(seq.max_windowed_gc(F.col("nt"), 60), 6).alias("max_gc"))


@query(f"""WITH p AS (SELECT item_id, unnest(range(1, length(s) + 1)) AS pos, s FROM (SELECT item_id, {NT} AS s FROM benchmark)),
w AS (SELECT item_id, pos, sum((substr(s, pos, 1) IN ('G', 'C'))::int) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS hits FROM p)
SELECT item_id, max(hits)::bigint AS hits FROM w WHERE pos >= 60 GROUP BY item_id""")
def window_gc_rows_frame(spark, d):
    from pyspark.sql import Window

    s = _table(spark, d, "benchmark").select("item_id", nt(F.col("text")).alias("s"))
    p = s.select("item_id", F.posexplode(F.split("s", "")).alias("pos", "c")).filter("c <> ''")
    w = Window.partitionBy("item_id").orderBy("pos").rowsBetween(-59, 0)
    hits = p.withColumn("hits", F.sum(F.col("c").isin("G", "C").cast("int")).over(w))
    return hits.filter("pos >= 59").groupBy("item_id").agg(F.max("hits").alias("hits"))


@query(f"SELECT doc_id, CASE WHEN length(s) = 0 THEN '' ELSE substr(s, k + 1) || substr(s, 1, k) END AS rotated FROM (SELECT doc_id, s, CASE WHEN length(s) = 0 THEN 0 ELSE (doc_id * 7) % length(s) END AS k FROM (SELECT doc_id, {NT} AS s FROM documents))")
def seq_rotate(spark, d):
    return _docs(spark, d).select("doc_id", seq.rotate(F.col("nt"), (F.col("doc_id") * 7).cast("int")).alias("rotated"))


# ---- names ----------------------------------------------------------------------------------

_CHAINS = ("heavy", "LIGHT", "hc", "k", "Lambda", "vl", "none", "xheavy")


def _named(spark, d) -> DataFrame:
    chain = F.get(F.array(*[F.lit(c) for c in _CHAINS]), (F.col("doc_id") % 8).cast("int"))
    sep = F.get(F.array(F.lit("_"), F.lit("-"), F.lit(" "), F.lit("__")), (F.col("doc_id") % 4).cast("int"))
    return _table(spark, d, "documents").select("doc_id", F.concat(F.lit("mAb-"), F.col("doc_id").cast("string"), sep, chain).alias("record_id"))


@query("""SELECT doc_id, record_id,
CASE m WHEN 6 THEN record_id WHEN 7 THEN 'mAb-' || doc_id || sep || 'x' ELSE 'mAb-' || doc_id END AS ab_id,
['heavy','light','heavy','kappa','lambda','lambda','unknown','heavy'][m + 1] AS chain_class,
['High','High','High','Low','High','High','None','High'][m + 1] AS confidence, m IN (3, 6) AS needs_confirmation
FROM (SELECT doc_id, doc_id % 8 AS m, ['_','-',' ','__'][doc_id % 4 + 1] AS sep,
'mAb-' || doc_id || ['_','-',' ','__'][doc_id % 4 + 1] || ['heavy','LIGHT','hc','k','Lambda','vl','none','xheavy'][doc_id % 8 + 1] AS record_id FROM documents)""")
def name_parse(spark, d):
    return _named(spark, d).select("doc_id", "record_id", naming.parse_name(F.col("record_id")).alias("p")).select("doc_id", "record_id", "p.*")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'override-' || d.doc_id WHEN d.doc_id % 8 = 7 THEN 'mAb-' || d.doc_id || ['_','-',' ','__'][d.doc_id % 4 + 1] || 'x'
WHEN d.doc_id % 8 = 6 THEN 'mAb-' || d.doc_id || ' none' ELSE 'mAb-' || d.doc_id END AS ab_id
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id""")
def override_left_join(spark, d):
    records = _named(spark, d)
    own = _table(spark, d, "labels").filter("toxic = 1").select("doc_id").distinct()
    overrides = records.join(own, "doc_id", "left_semi").select("record_id", F.concat(F.lit("override-"), F.col("doc_id").cast("string")).alias("ab_id"), F.lit("heavy").alias("chain_class"))
    return naming.with_names(records, overrides=overrides).select("doc_id", "ab_id")


@query("SELECT conv_id, count(*)::int AS expected FROM conversations GROUP BY conv_id")
def expected_chains(spark, d):
    return naming.expected_chain_counts(_table(spark, d, "conversations").select(F.col("conv_id").alias("ab_id"))).select(F.col("ab_id").alias("conv_id"), "expected")


# ---- constructs -----------------------------------------------------------------------------

_OH_SQL = {x: (f"'{a}'", f"'{b}'") for x, (a, b) in OH.items()}


def _fragment(kind: Column, core: Column) -> Column:
    """0: IGH, 1: IGK, 2: IGL, 3: IGH with a mistyped 5' letter, 4: only the 3' overhang of IGK."""
    h, k, g = OH["IGH"], OH["IGK"], OH["IGL"]
    typo = "A" + h[0][1:]
    return (
        F.when(kind == 0, F.concat(F.lit(h[0]), core, F.lit(h[1])))
        .when(kind == 1, F.concat(F.lit(k[0]), core, F.lit(k[1])))
        .when(kind == 2, F.concat(F.lit(g[0]), core, F.lit(g[1])))
        .when(kind == 3, F.concat(F.lit(typo), core, F.lit(h[1])))
        .otherwise(F.concat(core, F.lit(k[1])))
    )


def _fragments(spark, d) -> DataFrame:
    return _docs(spark, d).select("doc_id", "nt", _fragment(F.col("doc_id") % 5, F.col("nt")).alias("fragment"))


_FRAGMENT_SQL = f"""(SELECT doc_id, s AS nt, CASE doc_id % 5 WHEN 0 THEN '{OH['IGH'][0]}' || s || '{OH['IGH'][1]}' WHEN 1 THEN '{OH['IGK'][0]}' || s || '{OH['IGK'][1]}'
WHEN 2 THEN '{OH['IGL'][0]}' || s || '{OH['IGL'][1]}' WHEN 3 THEN 'A{OH['IGH'][0][1:]}' || s || '{OH['IGH'][1]}' ELSE s || '{OH['IGK'][1]}' END AS f
FROM (SELECT doc_id, {NT} AS s FROM documents))"""
_M5, _M3 = ({x: f"(CASE WHEN length(f) >= 20 THEN {_sql_hamming('substr(f, 1, 20)' if i == 0 else 'substr(f, length(f) - 19)', _OH_SQL[x][i], 20)} ELSE 99 END)" for x in OH} for i in (0, 1))


@query(f"SELECT doc_id, CASE WHEN {_M3['IGH']} <= 1 THEN 'IGH' WHEN {_M3['IGK']} <= 1 THEN 'IGK' WHEN {_M3['IGL']} <= 1 THEN 'IGL' WHEN {_M5['IGH']} <= 1 THEN 'IGH' WHEN {_M5['IGK']} <= 1 THEN 'IGK' END AS locus FROM {_FRAGMENT_SQL}")
def locus_detect(spark, d):
    return _fragments(spark, d).select("doc_id", seq.locus_from_overhangs(F.col("fragment"), OH, 1).alias("locus"))


@query(f"""SELECT doc_id, m5 <= 1 AS oh5_present, m3 <= 1 AS oh3_present,
CASE WHEN length(f) - CASE WHEN m3 <= 1 THEN 20 ELSE 0 END > CASE WHEN m5 <= 1 THEN 20 ELSE 0 END
THEN substr(f, CASE WHEN m5 <= 1 THEN 21 ELSE 1 END, length(f) - CASE WHEN m3 <= 1 THEN 20 ELSE 0 END - CASE WHEN m5 <= 1 THEN 20 ELSE 0 END) ELSE '' END AS core
FROM (SELECT doc_id, f, {_M5['IGH']} AS m5, {_M3['IGH']} AS m3 FROM {_FRAGMENT_SQL})""")
def overhang_strip(spark, d):
    st = seq.strip_overhangs(F.col("fragment"), F.lit(OH["IGH"][0]), F.lit(OH["IGH"][1]), 1)
    return _fragments(spark, d).select("doc_id", st.alias("st")).select("doc_id", "st.oh5_present", "st.oh3_present", "st.core")


@query(f"SELECT doc_id, CASE WHEN p LIKE '%ASTKGP%' OR p LIKE '%VTVSS%' THEN 'IGH' WHEN p LIKE '%TKVEIK%' OR p LIKE '%RTVAAP%' THEN 'IGK' WHEN p LIKE '%GQPKAAP%' OR p LIKE '%QPKAAPSV%' THEN 'IGL' END AS locus FROM (SELECT doc_id, {_sql_translate('f')} AS p FROM {_FRAGMENT_SQL})")
def locus_protein(spark, d):
    return _fragments(spark, d).select("doc_id", seq.locus_from_protein(seq.translate(F.col("fragment"))).alias("locus"))


_ORF_SQL = f"(SELECT doc_id, {_sql_translate(f'a')} AS p FROM (SELECT doc_id, '{LEADER}' || {NT} || '{CONSTANT}' AS a FROM documents))"


@query(f"SELECT doc_id, CASE WHEN instr(p, '*') > 0 THEN instr(p, '*') - 1 END AS stop_aa, contains(split_part(p, '*', 1), '{ANCHOR}') AS reads_through FROM {_ORF_SQL}")
def assemble_orf_readthrough(spark, d):
    n = len(LEADER)
    built = seq.translate(seq.assemble(F.lit(LEADER + CONSTANT), F.col("nt"), F.lit(n), F.lit(n)))
    df = _docs(spark, d).select("doc_id", built.alias("p"))
    return df.select("doc_id", seq.first_stop(F.col("p")).cast("long").alias("stop_aa"), seq.to_stop(F.col("p")).contains(ANCHOR).alias("reads_through"))


_FRAMES = [f"split_part({_sql_translate(f'substr(s, {i + 1})')}, '*', 1)" for i in range(3)]


@query(f"SELECT doc_id, CASE WHEN length(a) >= length(b) AND length(a) >= length(c) THEN a WHEN length(b) >= length(c) THEN b ELSE c END AS protein FROM (SELECT doc_id, {_FRAMES[0]} AS a, {_FRAMES[1]} AS b, {_FRAMES[2]} AS c FROM (SELECT doc_id, {NT} AS s FROM documents))")
def three_frame_best(spark, d):
    return _docs(spark, d).select("doc_id", seq.best_frame_protein(F.col("nt")).alias("protein"))


_SHIFTED = f"(SELECT doc_id, substr('ACG', 1, (doc_id % 3)::int) || '{LEADER}' || {NT} AS r FROM documents)"


@query(f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {_sql_translate('r')} WHEN 1 THEN {_sql_translate('substr(r, 2)')} ELSE {_sql_translate('substr(r, 3)')} END AS orf FROM {_SHIFTED}""")
def three_frame_orf(spark, d):
    shifted = F.concat(F.left(F.lit("ACG"), (F.col("doc_id") % 3).cast("int")), F.lit(LEADER), F.col("nt"))
    return _docs(spark, d).select("doc_id", seq.locate_orf(shifted, seq.translate(F.lit(LEADER))).alias("orf"))


@query(f"SELECT doc_id, CASE WHEN length(r) >= (doc_id % 3) + {len(LEADER)} + 30 THEN substr(r, (doc_id % 3)::int + {len(LEADER)} + 1, 30) END AS insert_nt FROM {_SHIFTED}")
def extract_insert(spark, d):
    shifted = F.concat(F.left(F.lit("ACG"), (F.col("doc_id") % 3).cast("int")), F.lit(LEADER), F.col("nt"))
    return _docs(spark, d).select("doc_id", seq.extract_insert(shifted, F.lit(LEADER + CONSTANT), F.lit(len(LEADER)), F.lit(30)).alias("insert_nt"))


# ---- joins, last and first wins, merge ------------------------------------------------------

@query("""SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def last_wins(spark, d):
    e = _table(spark, d, "events")
    return library.last_wins(e, ["user_id", "event_type"], "event_id", ["event_id", "value"]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("SELECT conv_id, role, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations) WHERE r = 1")
def first_wins(spark, d):
    c = _table(spark, d, "conversations")
    return library.first_wins(c, ["conv_id", "role"], "turn", ["turn", "text"])


@query("""WITH t AS (SELECT upper('ab' || c_custkey) AS k, arg_max(o_orderkey, o_orderkey) AS last_order FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT o_orderkey, last_order FROM orders LEFT JOIN t ON k = 'AB' || o_custkey""")
def truth_lookup(spark, d):
    o = _table(spark, d, "orders")
    panel = order_qc.panel(o.select(F.concat(F.lit("ab"), F.col("o_custkey").cast("string")).alias("ab_id"), F.col("o_orderkey").alias("idx"), F.col("o_orderkey").cast("string").alias("heavy"), F.lit(None).cast("string").alias("light")))
    return o.join(panel, naming.upper_col(F.concat(F.lit("Ab"), F.col("o_custkey").cast("string"))) == F.col("ab_key"), "left").select("o_orderkey", F.col("heavy").cast("long").alias("last_order"))


@query(f"""WITH f AS {_FRAGMENT_SQL}, c AS (SELECT 'AB' || doc_id // 3 AS ab_key, CASE doc_id % 5 WHEN 1 THEN 'kappa' WHEN 2 THEN 'lambda' ELSE 'heavy' END AS core_class, nt, doc_id FROM f WHERE doc_id % 5 < 4)
SELECT ab_key, core_class, arg_max(nt, doc_id) AS core FROM c GROUP BY 1, 2""")
def core_lookup(spark, d):
    named = F.when(F.col("doc_id") % 5 == 1, "_kappa").when(F.col("doc_id") % 5 == 2, "_lambda").when(F.col("doc_id") % 5 == 4, "_kappa").otherwise("_heavy")
    recs = _fragments(spark, d).select(F.concat(F.lit("ab"), F.floor(F.col("doc_id") / 3).cast("string"), named).alias("record_id"), F.col("fragment").alias("sequence"), F.col("doc_id").alias("record_idx"))
    lib = library.Library([], {"s": OH}, {})
    return order_qc.order_cores(recs, lib, library.Project({}, "s", ""))


@query("""WITH e AS (SELECT 'P' || p_partkey % 700 AS id, sha256(p_brand || p_size) AS h, 0 AS new, p_partkey AS idx FROM part WHERE p_partkey % 2 = 0),
i AS (SELECT 'P' || p_partkey % 900 AS id, sha256(p_brand || p_size) AS h, 1 AS new, p_partkey AS idx FROM part WHERE p_partkey % 2 = 1),
f AS (SELECT h, min((new, idx, id)) AS first FROM (SELECT * FROM e UNION ALL SELECT * FROM i) GROUP BY h)
SELECT i.id, i.h AS sha256, i.idx, CASE WHEN first[3] <> i.id THEN first[3] END AS existing_id FROM i JOIN f USING (h) WHERE first[3] <> i.id OR (first[1] = 1 AND first[2] = i.idx)""")
def library_merge(spark, d):
    p = _table(spark, d, "part")

    def side(odd: int, ids: int) -> DataFrame:
        return p.filter(F.col("p_partkey") % 2 == odd).select(F.concat(F.lit("P"), (F.col("p_partkey") % ids).cast("string")).alias("id"), F.sha2(F.concat(F.col("p_brand"), F.col("p_size").cast("string")), 256).alias("sha256"), F.col("p_partkey").alias("idx"))

    appended, conflicts = library.merge(side(0, 700), side(1, 900))
    return appended.join(conflicts.distinct(), ["id", "sha256"], "left").select("id", "sha256", "idx", "existing_id")


# ---- rollups --------------------------------------------------------------------------------

_KIND = ("PASS", "NO_GROUND_TRUTH", "TRANSLATION_DRIFT", "OVERHANG_MISSING", "PASS")


def _verdicts(spark, d, kinds) -> DataFrame:
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("o_orderkey") % 5).cast("int"))
    return _table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("ab_id"), F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_orderkey").alias("record_idx"), kind.alias("kind"))


def _kind_sql(kinds) -> str:
    return "[" + ",".join(f"'{k}'" for k in kinds) + "][o_orderkey % 5 + 1]"


@query(f"""SELECT o_custkey::varchar AS ab_id, bool_and(k IN ('PASS', 'NO_GROUND_TRUTH')) AS passed,
CASE WHEN bool_and(k IN ('PASS', 'NO_GROUND_TRUTH')) THEN count(*) || ' chain(s) pass' ELSE 'flagged: ' || string_agg(k, ', ' ORDER BY o_orderkey) FILTER (k NOT IN ('PASS', 'NO_GROUND_TRUTH')) END AS note,
string_agg(o_orderkey::varchar, ',' ORDER BY o_orderkey) AS chains FROM (SELECT *, {_kind_sql(_KIND)} AS k FROM orders) GROUP BY o_custkey""")
def rollup_order(spark, d):
    return rollup.rollup_order(_verdicts(spark, d, _KIND)).withColumn("chains", F.array_join("chains", ","))


_READ_KIND = ("PASS", "SILENT_VARIANT", "PASS", "POINT_MUTATION", "PASS")


@query(f"""SELECT ab_id, passed AND n >= e AS passed, CASE WHEN n < e THEN 'INCOMPLETE_PAIR (' || n || ' of ' || e || ' chains present)' WHEN passed THEN n || ' chain(s) pass' ELSE note END AS note
FROM (SELECT o_custkey::varchar AS ab_id, bool_and(k IN ('PASS', 'SILENT_VARIANT')) AS passed, count(*) AS n, CASE WHEN o_custkey % 3 = 0 THEN 12 ELSE count(*) END AS e,
'flagged: ' || string_agg(k, ', ' ORDER BY o_orderkey) FILTER (k NOT IN ('PASS', 'SILENT_VARIANT')) AS note FROM (SELECT *, {_kind_sql(_READ_KIND)} AS k FROM orders) GROUP BY o_custkey)""")
def rollup_reads(spark, d):
    v = _verdicts(spark, d, _READ_KIND)
    expected = v.select("ab_id").distinct().filter(F.col("ab_id").cast("long") % 3 == 0).withColumn("expected", F.lit(12))
    return rollup.rollup_reads(v, expected).drop("chains")


@query(f"SELECT k AS kind, count(*) AS n, CASE WHEN k = 'PASS' THEN 'Pass' WHEN k = 'NO_GROUND_TRUTH' THEN 'Advisory' ELSE 'Fail' END AS severity FROM (SELECT {_kind_sql(_KIND)} AS k FROM orders) GROUP BY k")
def verdict_summary(spark, d):
    return rollup.summary(_verdicts(spark, d, _KIND)).withColumn("severity", rollup.severity(F.col("kind")))


@query(f"""SELECT o_orderkey AS record_idx, o_orderkey || ',' || o_custkey || ',' || k || ',' || CASE WHEN k = 'PASS' THEN 'Pass' WHEN k = 'NO_GROUND_TRUTH' THEN 'Advisory' ELSE 'Fail' END || ',"said ""' || o_orderpriority || '"", so"' AS line FROM (SELECT *, {_kind_sql(_KIND)} AS k FROM orders)""")
def report_csv(spark, d):
    o = _table(spark, d, "orders").select(F.col("o_orderkey").alias("record_idx"), F.concat(F.lit('said "'), F.col("o_orderpriority"), F.lit('", so')).alias("reason"))
    return rollup.csv_rows(_verdicts(spark, d, _KIND).join(o, "record_idx"), ("record_id", "ab_id", "verdict", "severity", "reason"))


# ---- searches, alignment, coverage ----------------------------------------------------------

def _items(spark, d) -> DataFrame:
    return _table(spark, d, "benchmark").select("item_id", nt(F.col("text")).alias("s"))


def _sql_hits(text: str, mark: str) -> str:
    n = len(mark)
    return f"list_transform(range(1, length({text}) + 1), lambda i: {n} - list_sum(list_transform(range(1, {n + 1}), lambda j: (substr({text} || {text}, i + j - 1, 1) <> substr('{mark}', j, 1))::int)))"


_ITEMS_SQL = f"(SELECT item_id, s, CASE item_id % 3 WHEN 0 THEN '{LANDMARKS['v0']}' WHEN 1 THEN '{LANDMARKS['v1']}' ELSE '{LANDMARKS['v2']}' END || s AS t FROM (SELECT item_id, {NT} AS s FROM benchmark))"
_BOTH = {v: f"greatest(list_max({_sql_hits('t', m)}), list_max({_sql_hits('rc', m)}))" for v, m in LANDMARKS.items()}


@query(f"""SELECT item_id, CASE WHEN a >= b AND a >= c THEN 'v0' WHEN b >= c THEN 'v1' ELSE 'v2' END AS vector_id, round(greatest(a, b, c) / 20.0::double, 6) AS identity
FROM (SELECT item_id, {_BOTH['v0']} AS a, {_BOTH['v1']} AS b, {_BOTH['v2']} AS c FROM (SELECT item_id, t, reverse(translate(t, 'ATGC', 'TACG')) AS rc FROM {_ITEMS_SQL}))""")
def backbone_argmax(spark, d):
    mark = F.get(F.array(*[F.lit(m) for m in LANDMARKS.values()]), (F.col("item_id") % 3).cast("int"))
    t = _items(spark, d).select("item_id", kernels.orient(F.concat(mark, F.col("s")), [(v, m, m) for v, m in LANDMARKS.items()]).alias("o"))
    return t.select("item_id", "o.vector_id", F.round("o.identity", 6).alias("identity"))


@query(f"""SELECT item_id, CASE WHEN item_id % 2 = 1 THEN 'reversed' ELSE 'forward' END AS strand, '{LANDMARKS['v0']}' || s AS sequence FROM (SELECT item_id, {NT} AS s FROM benchmark) WHERE length(s) > 0""")
def circular_normalize(spark, d):
    own = F.concat(F.lit(LANDMARKS["v0"]), F.col("s"))
    turned = seq.rotate(own, (F.col("item_id") * 13 % F.length(own)).cast("int"))
    read = F.when(F.col("item_id") % 2 == 1, seq.revcomp(turned)).otherwise(turned)
    n = _items(spark, d).filter("length(s) > 0").select("item_id", kernels.normalize_circular(read, F.lit(LANDMARKS["v0"])).alias("n"))
    return n.select("item_id", F.when(F.col("n.reverse_complemented"), "reversed").otherwise("forward").alias("strand"), "n.sequence")


@query()
def align_global(spark, d):
    """Proteins of neighbouring benchmark items, aligned; checked by a plain model in the tests."""
    p = _items(spark, d).select("item_id", seq.translate_to_stop(F.col("s")).alias("p"))
    q = p.select((F.col("item_id") - 1).alias("item_id"), F.col("p").alias("q"))
    return p.join(q, "item_id").select("item_id", kernels.align(F.col("p"), F.col("q"), kernels.protein_scoring()).alias("a")).select("item_id", "a.*")


@query(f"""WITH a AS (SELECT doc_id, e, CASE WHEN length(e) > 0 AND substr(e, k, 1) <> 'W' THEN substr(e, 1, k - 1) || 'W' || substr(e, k + 1) ELSE e END AS o, k FROM (SELECT doc_id, p AS e, greatest(length(p) // 2, 1)::int AS k FROM (SELECT doc_id, {_sql_translate(NT)} AS p FROM documents)))
SELECT doc_id, CASE WHEN e <> o AND k > 5 THEN (k - 5) || ':' || substr(e, k, 1) || '>W' ELSE '' END AS calls FROM a""")
def mutation_calls(spark, d):
    e = seq.translate(F.col("nt"))
    df = _docs(spark, d).select("doc_id", e.alias("e")).withColumn("k", F.greatest(F.floor(F.length("e") / 2), F.lit(1)).cast("int"))
    o = F.when(F.length("e") > 0, F.concat(F.left("e", F.col("k") - 1), F.lit("W"), F.substring(F.col("e"), F.col("k") + 1, F.length("e")))).otherwise(F.col("e"))
    m = df.withColumn("m", sequencing_qc.mutations(o, F.col("e"), F.lit(5)))
    return m.select("doc_id", F.array_join(F.transform("m", lambda x: F.concat(x["position_aa"].cast("string"), F.lit(":"), x["wt"], F.lit(">"), x["mut_aa"])), ",").alias("calls"))


_READS_SQL = f"""refs AS (SELECT item_id, {NT} AS s FROM benchmark), r0 AS (SELECT item_id, s, length(s) AS n, k FROM refs, (SELECT unnest(range(0, 6)) AS k) WHERE length(s) >= 40),
r1 AS (SELECT item_id, s, n, k, substr(s || s, ((k * 17) % n + 1)::int, least(n, 20 + 15 * k)::int) AS r FROM r0),
r2 AS (SELECT item_id, s, n, CASE WHEN k % 2 = 1 THEN reverse(translate(r, 'ATGC', 'TACG')) ELSE r END AS r FROM r1),
r3 AS (SELECT *, instr(s || s, substr(r, 1, 18)) AS f, instr(s || s, substr(reverse(translate(r, 'ATGC', 'TACG')), 1, 18)) AS b FROM r2 WHERE length(r) >= 18),
r4 AS (SELECT item_id, n, CASE WHEN f BETWEEN 1 AND n THEN f - 1 WHEN b BETWEEN 1 AND n THEN b - 1 END AS start, least(length(r), n) AS span FROM r3),
hit AS (SELECT item_id, (start + unnest(range(0, span))) % n AS pos FROM r4 WHERE start IS NOT NULL),
dep AS (SELECT item_id, pos, count(*) AS c FROM hit GROUP BY 1, 2),
depth AS (SELECT p.item_id, p.pos, coalesce(c, 0)::int AS depth FROM (SELECT item_id, unnest(range(0, length(s))) AS pos FROM refs) p LEFT JOIN dep USING (item_id, pos))"""


# the same over documents
_DOC_READS_SQL = _READS_SQL.replace("item_id", "doc_id").replace("FROM benchmark", "FROM documents")


def _depths(spark, d, refs: DataFrame | None = None, of=coverage.depth) -> DataFrame:
    refs = _items(spark, d).withColumnRenamed("s", "reference") if refs is None else refs
    n = F.length("reference")
    r = refs.filter(n >= 40).select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    read = F.substring(F.concat("reference", "reference"), (F.col("k") * 17) % n + 1, F.least(n, 20 + 15 * F.col("k")))
    reads = r.select("item_id", F.when(F.col("k") % 2 == 1, seq.revcomp(read)).otherwise(read).alias("read"))
    return of(reads, refs, "item_id")


@query(f"WITH {_READS_SQL} SELECT item_id, pos::int AS pos, depth FROM depth")
def coverage_depth(spark, d):
    return _depths(spark, d)


def _doc_depths(spark, d) -> DataFrame:
    """As stretches: a row for every position of whole documents is not made."""
    refs = _docs(spark, d).select(F.col("doc_id").alias("item_id"), F.col("nt").alias("reference"))
    return _depths(spark, d, refs, coverage.stretches)


@query(f"WITH {_DOC_READS_SQL} SELECT doc_id, count(*) AS length, sum(depth)::bigint AS total, max(depth) AS max, sum((depth > 0)::int)::bigint AS covered, round(avg(depth), 6) AS mean, round(avg((depth > 0)::int), 6) AS breadth FROM depth GROUP BY doc_id")
def coverage_stats(spark, d):
    """Six reads of each document of 40 letters or more; over all documents."""
    out = coverage.statistics(_doc_depths(spark, d), "item_id").withColumn("mean", F.round("mean", 6)).withColumn("breadth", F.round("breadth", 6))
    return out.withColumnRenamed("item_id", "doc_id")


@query(f"WITH {_DOC_READS_SQL}, m AS (SELECT doc_id, count(*) AS n FROM depth GROUP BY 1) SELECT doc_id, floor(pos * 20 / n)::int AS \"column\", max(depth) AS depth FROM depth JOIN m USING (doc_id) GROUP BY 1, 2")
def coverage_chart(spark, d):
    return coverage.chart(_doc_depths(spark, d), 20, "item_id").withColumnRenamed("item_id", "doc_id")


@query(f"""SELECT doc_id AS record_id, CASE WHEN s = '' THEN 0.0::double ELSE round(length(regexp_replace(s, '[^GC]', '', 'g')) / length(s)::double, 6) END AS gc, length(w) AS total_bp, length(s) AS insert_bp, length(split_part({_sql_translate('w')}, '*', 1)) AS orf_aa, substr(w, {len(LEADER) - 22 + 1}, 44) AS junction
FROM (SELECT doc_id, s, '{LEADER}' || s || '{CONSTANT}' AS w FROM (SELECT doc_id, {NT} AS s FROM documents))""")
def construct_facts(spark, d):
    n = len(LEADER)
    rows = _docs(spark, d).select(F.col("doc_id").alias("record_id"), F.lit(LEADER + CONSTANT).alias("vector_seq"), F.col("nt").alias("core"), F.lit(n).alias("oh5_end"), F.lit(n).alias("oh3_start"))
    out = coverage.construct(rows)
    return out.select("record_id", F.round("gc", 6).alias("gc"), *[F.col(c).cast("long").alias(c) for c in ("total_bp", "insert_bp", "orf_aa")], "junction")


# ---- whole gates ----------------------------------------------------------------------------

def _planted() -> tuple[library.Library, library.Project]:
    v = library.Vector("v0", "heavy", LEADER + CONSTANT + "ACGTTGCAAC" * 30, len(LEADER), len(LEADER), ANCHOR, "planted heavy", features={"constant_region": {"start": len(LEADER) + 1, "end": len(LEADER) + len(CONSTANT)}})
    lib = library.Library([v], {"s": OH}, {"default": naming.DEFAULT})
    return lib, library.Project.ad_hoc(lib)


def _order_records(spark, d) -> DataFrame:
    kind = F.col("doc_id") % 5
    chain = F.when(kind == 0, "_heavy").when(kind == 1, F.when(F.col("doc_id") % 2 == 0, "_light").otherwise("_heavy")).when(kind == 2, "_lambda").when(kind == 3, "_heavy").otherwise("_kappa")
    return _fragments(spark, d).select(F.col("doc_id").alias("record_idx"), F.concat(F.lit("AB"), F.col("doc_id").cast("string"), chain).alias("record_id"), F.col("fragment").alias("sequence"))


_TAIL = "ACGTTGCAAC" * 30
_ORDER_SQL = f"""WITH f AS {_FRAGMENT_SQL}, n AS (SELECT doc_id, f, nt AS core, CASE doc_id % 5 WHEN 0 THEN 'heavy' WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'light' ELSE 'heavy' END WHEN 2 THEN 'lambda' WHEN 3 THEN 'heavy' ELSE 'kappa' END AS chain FROM f),
t AS (SELECT *, {_sql_translate("'" + LEADER + "' || core || '" + CONSTANT + _TAIL + "'")} AS orf, {_sql_translate('core')} AS aa FROM n),
m AS (SELECT *, CASE WHEN chain = 'heavy' THEN 'IGH' WHEN chain = 'lambda' THEN 'IGL' ELSE 'IGK' END AS locus, {_M5['IGK']} AS mk5, doc_id % 5 AS kind FROM t),
e AS (SELECT *, CASE WHEN kind = 1 AND chain = 'heavy' THEN 'wrong' WHEN kind = 4 AND mk5 > 1 THEN 'missing' ELSE 'ok' END AS state, chain = 'heavy' AS vec, split_part(orf, '*', 1) LIKE '%{ANCHOR}%' AS through FROM m)
SELECT doc_id AS record_idx, CASE state WHEN 'wrong' THEN 'OVERHANG_WRONG_LOCUS' WHEN 'missing' THEN 'OVERHANG_MISSING' ELSE
CASE WHEN vec AND NOT through THEN 'FRAMESHIFT_AT_JUNCTION' WHEN NOT vec AND (length(core) % 3 <> 0 OR instr(aa, '*') > 0) THEN 'FRAMESHIFT_AT_JUNCTION' ELSE 'NO_GROUND_TRUTH' END END AS kind,
CASE WHEN state = 'ok' THEN length(core)::int END AS core_len,
CASE WHEN state = 'ok' AND vec AND instr(orf, '*') > 0 THEN (instr(orf, '*') - 1)::int WHEN state = 'ok' AND NOT vec AND length(core) % 3 = 0 AND instr(aa, '*') > 0 THEN (instr(aa, '*') - 1)::int END AS premature_stop_aa,
CASE WHEN state = 'ok' AND vec THEN through END AS reads_through FROM e"""


@query(_ORDER_SQL)
def order_qc_verdicts(spark, d):
    lib, project = _planted()
    out = order_qc.run(_order_records(spark, d), lib, project)
    return out.select("record_idx", "kind", "core_len", "premature_stop_aa", "reads_through")


_FULL_SQL = f"""WITH b AS ({_ORDER_SQL.replace('SELECT doc_id AS record_idx', 'SELECT doc_id, chain, kind AS dealt, core, state, through, vec, orf, aa, mk5, doc_id AS record_idx', 1)}),
v AS (SELECT *, split_part(aa, '*', 1) AS own, chain = 'heavy' AND state = 'ok' AND doc_id % 10 = 3 AS drift FROM b),
k AS (SELECT *, CASE WHEN drift THEN 'TRANSLATION_DRIFT' WHEN kind = 'NO_GROUND_TRUTH' AND chain = 'heavy' THEN 'PASS' ELSE kind END AS k2, CASE WHEN dealt = 3 AND state = 'ok' THEN 'overhang typo tolerated (5′ 1 mm, 3′ 0 mm); ' ELSE '' END AS note,
  (CASE WHEN length(core) = 0 THEN 0 ELSE length(regexp_replace(core, '[^GC]', '', 'g')) / length(core)::double END > 0.56 OR {_sql_gc_windows('core', 60)} > 0.64) AS hot FROM v)
SELECT record_idx, 'AB' || doc_id || '_' || chain AS record_id, 'AB' || doc_id AS ab_id, chain AS chain_class, k2 AS kind, CASE WHEN k2 IN ('PASS', 'NO_GROUND_TRUTH') AND hot THEN 'GC_WARNING' ELSE '' END AS advisories,
CASE k2 WHEN 'OVERHANG_WRONG_LOCUS' THEN 'name says heavy but the fragment carries IGK overhangs' WHEN 'OVERHANG_MISSING' THEN 'expected IGK overhangs not found at both ends (5′ absent, 3′ found)'
  WHEN 'TRANSLATION_DRIFT' THEN note || 'translated core differs from ground truth (0 mismatch(es), 1 gap(s); first at aa ' || greatest(length(regexp_replace(own, 'W+$', '')), 1) || ')'
  WHEN 'FRAMESHIFT_AT_JUNCTION' THEN CASE WHEN vec THEN note || 'V-domain translates but the assembled ORF hits a premature stop at aa ' || coalesce(premature_stop_aa::varchar, '?') || ' and does not read through into the constant region ({ANCHOR} absent)'
    WHEN length(core) % 3 <> 0 THEN 'core length ' || length(core) || ' is not a multiple of 3 (frameshift at junction)' ELSE 'premature stop at aa ' || premature_stop_aa || ' within the translated core' END
  WHEN 'PASS' THEN CASE WHEN note = '' THEN 'core translates identically to ground truth; assembled construct is productive (reads through into the constant region)' ELSE note || 'core matches ground truth; construct productive' END
  ELSE 'no vector assigned for this locus; productivity checked structurally onlyconstruct productive; no ground-truth entry (advisory)' END AS reason,
core_len, CASE WHEN drift THEN NULL ELSE premature_stop_aa END AS premature_stop_aa, CASE WHEN drift THEN NULL ELSE reads_through END AS reads_through FROM k"""


@query(_FULL_SQL)
def order_qc_full(spark, d):
    """All verdict columns, with a panel: every antibody has its own protein, some drifted."""
    lib, project = _planted()
    # given as nucleotides, so that a short protein isn't taken for such; every tenth has a W more at its end
    coding = F.left("nt", 3 * F.length(seq.translate_to_stop(F.col("nt"))))
    heavy = F.when(F.col("doc_id") % 10 == 3, F.concat(coding, F.lit("TGG"))).otherwise(F.col("nt"))
    truth = _docs(spark, d).select(F.concat(F.lit("ab"), F.col("doc_id").cast("string")).alias("ab_id"), heavy.alias("heavy"), F.lit(None).cast("string").alias("light"), F.lit(0).alias("idx"))
    return order_qc.run(_order_records(spark, d), lib, project, truth).withColumn("advisories", F.array_join("advisories", ","))


def _reads(spark, d) -> tuple[DataFrame, DataFrame]:
    """Plasmids with benchmark-derived inserts: as they are, turned, mutated, cut or empty."""
    lib, _ = _planted()
    v = lib.vectors[0]
    # inserts without stops: a codon C.C for every letter of the text
    items = _table(spark, d, "benchmark").select("item_id", F.regexp_replace(nt(F.col("text")), "(.)", "C$1C").alias("core")).filter("length(core) >= 60")
    cores = items.select(F.concat(F.lit("AB"), F.col("item_id").cast("string")).alias("ab_key"), F.lit("heavy").alias("core_class"), "core")
    kind = F.col("item_id") % 6
    changed = F.concat(F.left("core", F.lit(30)), F.lit("TGG"), F.substring(F.col("core"), 34, F.length("core")))
    core = F.when(kind == 2, changed).when(kind == 3, F.left("core", F.length("core") - 1)).when(kind == 4, F.lit("")).otherwise(F.col("core"))
    whole = seq.assemble(F.lit(v.clean), core, F.lit(v.oh5_end), F.lit(v.oh3_start))
    read = F.when(kind == 1, seq.revcomp(seq.rotate(whole, F.lit(150)))).when(kind == 5, F.left(whole, F.lit(40))).otherwise(whole)
    reads = items.select(F.col("item_id").alias("record_idx"), F.concat(F.lit("ab"), F.col("item_id").cast("string"), F.lit("_heavy")).alias("record_id"), read.alias("sequence"))
    return reads, cores


@query(f"""SELECT item_id AS record_idx, CASE item_id % 6 WHEN 5 THEN 'INSUFFICIENT_READ' WHEN 4 THEN 'EMPTY_VECTOR' WHEN 3 THEN 'JUNCTION_FRAMESHIFT' WHEN 2 THEN 'POINT_MUTATION' ELSE 'PASS' END AS kind
FROM benchmark WHERE length({NT}) >= 20""")
def sequencing_qc_verdicts(spark, d):
    lib, project = _planted()
    reads, cores = _reads(spark, d)
    return sequencing_qc.run(reads, lib, project, cores).select("record_idx", "kind")


_CORES = f"(SELECT item_id, regexp_replace({NT}, '(.)', 'C\\1C', 'g') AS core FROM benchmark WHERE length({NT}) >= 20)"


@query(f"""SELECT i.item_id AS record_idx, 'ab' || (i.item_id + 6) AS ab_id,
CASE WHEN i.item_id % 6 = 5 OR e.core IS NULL THEN 'INSUFFICIENT_READ' WHEN i.item_id % 6 = 4 THEN 'EMPTY_VECTOR' WHEN i.item_id % 6 = 3 THEN 'JUNCTION_FRAMESHIFT'
  WHEN e.core <> i.core THEN 'WRONG_INSERT_SWAP' WHEN i.item_id % 6 = 2 THEN 'POINT_MUTATION' ELSE 'PASS' END AS kind,
CASE WHEN i.item_id % 6 IN (0, 1, 2) AND e.core <> i.core THEN f.first END AS suspected_identity
FROM {_CORES} i LEFT JOIN {_CORES} e ON e.item_id = i.item_id + 6 JOIN (SELECT core, min('AB' || item_id) AS first FROM {_CORES} GROUP BY core) f ON f.core = i.core""")
def panel_swap(spark, d):
    """Reads that carry another antibody's insert, told by the panel."""
    lib, project = _planted()
    reads, cores = _reads(spark, d)
    truth = cores.select(F.col("ab_key").alias("ab_id"), seq.translate_to_stop(F.col("core")).alias("heavy"), F.lit(None).cast("string").alias("light"), F.lit(0).alias("idx"))
    moved = reads.withColumn("record_id", F.concat(F.lit("ab"), (F.col("record_idx") + 6).cast("string"), F.lit("_heavy")))
    return sequencing_qc.run(moved, lib, project, cores, truth).select("record_idx", "ab_id", "kind", "suspected_identity")


def _spread(letters: Column) -> Column:
    """A codon C.C for every nucleotide that ``nt`` makes of cleaned letters: one translation, and no regular expression."""
    out = F.translate(letters, ALPHABET, "".join("0123"["ACGT".index(c)] for c in DEALT))
    for digit, c in enumerate("ACGT"):
        out = F.replace(out, F.lit(str(digit)), F.lit(f"C{c}C"))
    return out


# a second vector, with a constant region and a backbone of its own
_KAPPA = "ATGGCTCAAACCGATT" + OH["IGK"][0], OH["IGK"][1] + "GTACCGGATGACTCTAACTGA"
_KINDS = ("PASS", "WRONG_VECTOR", "EMPTY_VECTOR", "INSUFFICIENT_READ")


@query(f"""SELECT doc_id AS record_idx, kind, CASE WHEN kind = 'INSUFFICIENT_READ' THEN NULL WHEN kind = 'WRONG_VECTOR' THEN 'v1' ELSE 'v0' END AS backbone_vector
FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 2 AND length({NT}) <= 10 THEN CASE WHEN length({NT}) = 0 THEN 'PASS' ELSE 'SILENT_VARIANT' END ELSE ['{"', '".join(_KINDS)}'][doc_id % 4 + 1] END AS kind FROM documents)""")
def sequencing_qc_vectors(spark, d):
    """Reads of whole documents' inserts: right ones, ones in the other vector, empty ones, short ones.

    The vector without an insert of up to ten residues isn't told to be empty: its residues that aren't
    there are gaps and no mutations.
    """
    lib, project = _planted()
    leader, constant = _KAPPA
    other = library.Vector("v1", "kappa", leader + constant + "GGATTACATC" * 30, len(leader), len(leader), "YRMTLT", "planted kappa", features={"constant_region": {"start": len(leader) + 1, "end": len(leader) + len(constant)}})
    lib = library.Library([lib.vectors[0], other], lib.overhang_sets, lib.profiles)
    rows = _table(spark, d, "documents").select("doc_id", seq.clean(F.coalesce("text", F.lit(""))).alias("letters"))
    kind = F.col("doc_id") % 4
    # what a read shows of its insert: nothing, its beginning or all
    shown = F.when(kind == 2, F.lit("")).when(kind == 3, F.left("letters", F.lit(59))).otherwise(F.col("letters"))
    build = lambda v, core: seq.assemble(F.lit(v.clean), core, F.lit(v.oh5_end), F.lit(v.oh3_start))
    own = lib.vectors[0]
    read = F.when(kind == 1, build(other, F.col("core"))).when(kind == 2, build(own, F.lit(""))).when(kind == 3, F.left(build(own, F.col("core")), F.lit(59))).otherwise(seq.revcomp_of(seq.rotate(build(own, F.col("core")), F.lit(77))))
    reads = rows.select("doc_id", _spread(shown).alias("core")).select(F.col("doc_id").alias("record_idx"), F.concat(F.lit("ab"), F.col("doc_id").cast("string"), F.lit("_heavy")).alias("record_id"), read.alias("sequence"))
    cores = rows.select(F.concat(F.lit("AB"), F.col("doc_id").cast("string")).alias("ab_key"), F.lit("heavy").alias("core_class"), _spread(F.col("letters")).alias("core"))
    return sequencing_qc.run(reads, lib, project, cores).select("record_idx", "kind", "backbone_vector")


@query(f"""SELECT item_id AS record_idx, CASE item_id % 2 WHEN 0 THEN 'SILENT_VARIANT' ELSE 'PASS' END AS kind, CASE item_id % 2 WHEN 0 THEN 'protein identical to expected; 1 synonymous nt change(s) in the insert (silent)' ELSE 'insert matches the expected antibody and reads in-frame through the constant region' END AS reason FROM {_CORES}""")
def sequencing_qc_silent(spark, d):
    """Every second read has its 11th codon written another way: any C.C means the same as C.T."""
    lib, project = _planted()
    v = lib.vectors[0]
    _, cores = _reads(spark, d)
    id = F.substring("ab_key", 3, 20).cast("long")
    core = F.when(id % 2 == 0, F.concat(F.left("core", F.lit(32)), F.lit("T"), F.substring(F.col("core"), 34, F.length("core")))).otherwise(F.col("core"))
    reads = cores.select(id.alias("record_idx"), F.concat(F.lower("ab_key"), F.lit("_heavy")).alias("record_id"), seq.assemble(F.lit(v.clean), core, F.lit(v.oh5_end), F.lit(v.oh3_start)).alias("sequence"))
    return sequencing_qc.run(reads, lib, project, cores).select("record_idx", "kind", "reason")
