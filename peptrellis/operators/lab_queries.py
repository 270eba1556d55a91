"""Queries of synthesis (H10-H12, D35-D38, X8), structure (C22, C23, E12, D19, D20), libraries (L, C15-C18) and scorers (K)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import descriptors as D
from ..functions import scales as S
from ..functions.sql import WIDE
from ..registry import query, r6, sql_r6
from ..sources.shared import stage
from ..sources.views import values, with_
from . import gates as G
from . import library as L
from . import synthesis as Y
from .lineage import ancestry, edges_of
from .neighbours import nearest
from .pareto import dominators
from .scorers import from_scalar, score_distinct, scorer

_BLOCK_AT = {"d_amino_acid": 4, "lipid_tail": 6, "peg_chain": 11, "cyclic": 9}
_DRIVERS = """drv AS (SELECT id, pos, aa AS motif, CASE aa WHEN 'R' THEN 0.03 ELSE 0.01 END AS penalty FROM residues WHERE aa IN ('R', 'M', 'W')
    UNION ALL SELECT a.id, a.pos, a.aa || b.aa, 0.05 FROM residues a JOIN residues b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.aa || b.aa IN ('DG', 'NG')
    UNION ALL SELECT id, min(pos), string_agg(aa, '' ORDER BY pos), 0.04 * count(*) FROM (SELECT *, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS g FROM residues WHERE aa IN ('V', 'I', 'T')) GROUP BY id, g HAVING count(*) >= 3)"""
_ASSESSED = (
    with_("residues", more=_DRIVERS)
    + """, base AS (SELECT id, sequence, length(sequence) AS n, (length(sequence) - length(replace(sequence, 'C', ''))) // 2 AS pairs, (id % 4 = 0)::int + (id % 6 = 0)::int + (id % 11 = 0)::int + (id % 9 = 0)::int AS blocks,
    (CASE WHEN id % 4 = 0 THEN 1.5 ELSE 1 END)::double * (CASE WHEN id % 6 = 0 THEN 2 ELSE 1 END) * (CASE WHEN id % 11 = 0 THEN 1.6 ELSE 1 END)::double * (CASE WHEN id % 9 = 0 THEN 1.8 ELSE 1 END)::double AS cost FROM peptides),
pen AS (SELECT r.id, r.pos, coalesce(sum(penalty), 0)::double AS p FROM residues r LEFT JOIN drv d ON d.id = r.id AND d.pos = r.pos GROUP BY r.id, r.pos),
pur AS (SELECT id, product(greatest(0.0, 0.99 - p)) AS purity FROM pen JOIN base USING (id) WHERE pos < n - 1 GROUP BY id),
cnt AS (SELECT id, count(*) AS k, count(*) FILTER (motif IN ('DG', 'NG')) AS iso FROM drv GROUP BY id),
x AS (SELECT b.*, coalesce(purity, 1.0) AS crude, coalesce(k, 0) AS k, coalesce(iso, 0) AS iso, n - 1 + 2 * pairs + CASE WHEN id % 9 = 0 THEN 3 ELSE 0 END + blocks AS steps, coalesce(k, 0) + CASE WHEN pairs >= 3 THEN 3 WHEN pairs >= 2 THEN 1 ELSE 0 END + 2 * blocks AS score FROM base b LEFT JOIN pur USING (id) LEFT JOIN cnt USING (id)),
y AS (SELECT *, CASE WHEN score >= 5 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS difficulty, round(steps * cost * CASE WHEN score >= 5 THEN 2.0 WHEN score >= 2 THEN 1.4 ELSE 1.0 END, 9) AS small, round(steps * cost * CASE WHEN pairs >= 3 THEN 2.5 WHEN pairs >= 2 THEN 1.5 ELSE 1.0 END * (1 + 0.5 * blocks), 9) AS large FROM x)
"""
)
_BAND = lambda x: f"CASE WHEN {x} < 30 THEN 'low' WHEN {x} < 60 THEN 'medium' WHEN {x} < 120 THEN 'high' ELSE 'very_high' END"
_CEILING = sql_r6("crude * greatest(0.95 - greatest(pairs - 1, 0) * 0.05 - iso * 0.08 - blocks * 0.05, 0.0)")


def _assessed(v):
    return Y.assessed(v.peptides.select("id", "sequence", *((F.col("id") % m == 0).alias(n) for n, m in _BLOCK_AT.items())))


@query("H10_penalty_drivers", with_("residues", more=_DRIVERS) + f"SELECT id, pos AS position, motif, {sql_r6('penalty')} AS penalty FROM drv")
def h10(v):
    return Y.with_drivers(v.peptides).select("id", F.explode("drivers").alias("d")).select("id", "d.position", "d.motif", r6("d.penalty").alias("penalty"))


@query("K6_row_to_many", with_("residues", more=_DRIVERS) + "SELECT id, count(*) AS n FROM drv GROUP BY id")
def k6(v):
    return Y.with_drivers(v.peptides).select("id", F.explode("drivers").alias("d")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("F4_sorted_drivers", with_("residues", more=_DRIVERS) + "SELECT id, string_agg(pos || ':' || motif, ',' ORDER BY pos, motif) AS drivers FROM drv GROUP BY id")
def f4(v):
    return Y.with_drivers(v.peptides).select("id", F.col("drivers").alias("d")).where("size(d) > 0").select("id", F.array_join(F.transform("d", lambda d: F.concat(d["position"].cast("string"), F.lit(":"), d["motif"])), ",").alias("drivers"))


@query("H11_synthesis_flags", with_("residues") + "SELECT p.id, d.at AS dg_at, m.at AS oxidation_at FROM peptides p LEFT JOIN (SELECT a.id, string_agg(a.pos, ',' ORDER BY a.pos) AS at FROM residues a JOIN residues b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.aa || b.aa = 'DG' GROUP BY a.id) d USING (id) LEFT JOIN (SELECT id, string_agg(pos, ',' ORDER BY pos) AS at FROM residues WHERE aa IN ('M', 'W') GROUP BY id) m USING (id)")
def h11(v):
    text = lambda c: F.nullif(F.array_join(F.transform(c, lambda i: i.cast("string")), ","), F.lit(""))
    return v.peptides.select("id", text(D.motif_positions(("DG",))).alias("dg_at"), text(D.motif_positions(("M", "W"))).alias("oxidation_at"))


@query("H12_nonstandard_blocks", with_("peptides") + f"SELECT id, block, cost FROM peptides JOIN {values([(n, c, _BLOCK_AT[n]) for n, c in Y.BLOCKS], 'block, cost, m')} b ON id % m = 0")
def h12(v):
    table = v.rows(Y.BLOCKS, "block string, cost double")
    have = F.array_compact(F.array(*(F.when(F.col("id") % m == 0, n) for n, m in _BLOCK_AT.items())))
    return v.peptides.select("id", F.explode(have).alias("block")).join(F.broadcast(table), "block").select("id", "block", "cost")


@query("D35_crude_purity_product", _ASSESSED + f"SELECT id, {sql_r6('crude')} AS crude_purity FROM y")
def d35(v):
    return _assessed(v).select("id", r6("crude_purity").alias("crude_purity"))


@query("D36_difficulty_class", _ASSESSED + "SELECT id, difficulty FROM y")
def d36(v):
    return _assessed(v).select("id", "difficulty")


@query("D37_cost_bands", _ASSESSED + f"SELECT id, steps AS n_steps, {_BAND('small')} AS cost_100mg, {_BAND('large')} AS cost_10g FROM y")
def d37(v):
    return _assessed(v).select("id", "n_steps", "cost_100mg", "cost_10g")


@query("D38_purity_ceiling", _ASSESSED + f"SELECT id, {_CEILING} AS purity_ceiling FROM y")
def d38(v):
    return _assessed(v).select("id", r6("purity_ceiling").alias("purity_ceiling"))


@query("B20_synthesis_verdict", _ASSESSED + "SELECT id, CASE WHEN difficulty IN ('high') THEN 'reject' ELSE 'pass' END AS verdict FROM y")
def b20(v):
    return _assessed(v).select("id", F.when(F.col("difficulty").isin("high"), "reject").otherwise("pass").alias("verdict"))


@query("X8_synthesis_assessment", _ASSESSED + f"SELECT id, k AS n_drivers, {sql_r6('crude')} AS crude_purity, steps AS n_steps, difficulty, {_BAND('small')} AS cost_100mg, {_BAND('large')} AS cost_10g, {_CEILING} AS purity_ceiling, difficulty = 'high' AS rejected FROM y")
def x8(v):
    return _assessed(v).select("id", F.size("drivers").cast("long").alias("n_drivers"), r6("crude_purity").alias("crude_purity"), "n_steps", "difficulty", "cost_100mg", "cost_10g", r6("purity_ceiling").alias("purity_ceiling"), (F.col("difficulty") == "high").alias("rejected"))


@query("C22_structure_pair_distance", with_("atoms") + f"SELECT a.structure_id, a.residue_idx AS i, b.residue_idx AS j, {sql_r6('sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))')} AS distance FROM atoms a JOIN atoms b USING (structure_id) WHERE a.atom = 'CA' AND b.atom = 'CA'")
def c22(v):
    ca = v.atoms.where("atom = 'CA'")
    a, b = ca.alias("a"), ca.alias("b")
    gap = F.sqrt(sum(F.pow(F.col(f"a.{c}") - F.col(f"b.{c}"), 2) for c in "xyz"))
    return a.join(b, F.col("a.structure_id") == F.col("b.structure_id")).select("a.structure_id", F.col("a.residue_idx").alias("i"), F.col("b.residue_idx").alias("j"), r6(gap).alias("distance"))


@query("C23_idealized_chain_fallback", with_("seed_residues", "atoms") + f"SELECT a.id, a.pos AS i, b.pos AS j, CASE WHEN c.x IS NULL OR d.x IS NULL THEN {sql_r6('3.8 * abs(a.pos - b.pos)')} ELSE {sql_r6('sqrt(pow(c.x - d.x, 2) + pow(c.y - d.y, 2) + pow(c.z - d.z, 2))')} END AS distance FROM seed_residues a JOIN seed_residues b USING (id) LEFT JOIN atoms c ON c.structure_id = a.id AND c.residue_idx = a.pos AND c.atom = 'CA' AND a.id % 3 <> 0 LEFT JOIN atoms d ON d.structure_id = b.id AND d.residue_idx = b.pos AND d.atom = 'CA' AND b.id % 3 <> 0")
def c23(v):
    """Distances from the atoms; candidates without a structure (here id % 3 = 0) stand on an idealised chain."""
    have = v.atoms.where("atom = 'CA' and structure_id % 3 <> 0").select("structure_id", "residue_idx", "x", "y", "z")
    res = v.seeds.select("id", F.posexplode(F.split("sequence", "")).alias("pos", "aa")).drop("aa")
    put = res.join(have, (F.col("id") == F.col("structure_id")) & (F.col("pos") == F.col("residue_idx")), "left").select("id", "pos", "x", "y", "z")
    a, b = put.alias("a"), put.alias("b")
    gap = F.sqrt(sum(F.pow(F.col(f"a.{c}") - F.col(f"b.{c}"), 2) for c in "xyz"))
    return a.join(b, "id").select("id", F.col("a.pos").alias("i"), F.col("b.pos").alias("j"), r6(F.coalesce(gap, 3.8 * F.abs(F.col("a.pos") - F.col("b.pos")))).alias("distance"))


def _cross(u, w):
    return [f"({u[1]} * {w[2]} - {u[2]} * {w[1]})", f"({u[2]} * {w[0]} - {u[0]} * {w[2]})", f"({u[0]} * {w[1]} - {u[1]} * {w[0]})"]


def _dot(u, w):
    return "(" + " + ".join(f"{a} * {b}" for a, b in zip(u, w, strict=True)) + ")"


def dihedral(*points: str) -> str:
    """Angle in degrees of four points, as an expression over columns {point}x, {point}y, {point}z."""
    way = lambda a, b: [f"({b}{c} - {a}{c})" for c in "xyz"]
    b1, b2, b3 = (way(a, b) for a, b in zip(points[:-1], points[1:], strict=True))
    n1, n2 = _cross(b1, b2), _cross(b2, b3)
    angle = f"round(degrees(atan2(round({_dot(b1, n2)} * sqrt({_dot(b2, b2)}), 9) + 0.0, round({_dot(n1, n2)}, 9) + 0.0)), 6)"
    return f"CASE WHEN {angle} <= -180 THEN 180.0 ELSE {angle} END"


_PHI, _PSI = dihedral("pc_", "n_", "ca_", "c_"), dihedral("n_", "ca_", "c_", "nn_")
_SS = "CASE WHEN phi BETWEEN -100 AND -30 AND psi BETWEEN -77 AND -5 THEN 'H' WHEN phi BETWEEN -180 AND -45 AND psi BETWEEN 90 AND 180 THEN 'E' ELSE 'C' END"
_WIDE_ATOMS = ", ".join(f"max({c}) FILTER (atom = '{a}') AS {a.lower()}_{c}" for a in ("N", "CA", "C") for c in "xyz")
_NEXT = ", ".join(f"lag(c_{c}) OVER w AS pc_{c}, lead(n_{c}) OVER w AS nn_{c}" for c in "xyz")


@query("E12_neighbour_dihedral", with_("atoms", more=f"b AS (SELECT structure_id, residue_idx, {_WIDE_ATOMS} FROM atoms GROUP BY ALL), l AS (SELECT *, {_NEXT} FROM b WINDOW w AS (PARTITION BY structure_id ORDER BY residue_idx)), a AS (SELECT structure_id, residue_idx, round({_PHI}, 6) AS phi, round({_PSI}, 6) AS psi FROM l)") + f"SELECT structure_id, residue_idx, {sql_r6('phi')} AS phi, {sql_r6('psi')} AS psi, {_SS} AS ss FROM a")
def e12(v):
    """Backbone angles from the neighbours' atoms; ends have none and are coil."""
    flat = v.atoms.groupBy("structure_id", "residue_idx").agg(*(F.max(F.when(F.col("atom") == a, F.col(c))).alias(f"{a.lower()}_{c}") for a in ("N", "CA", "C") for c in "xyz"))
    w = Window.partitionBy("structure_id").orderBy("residue_idx")
    near = flat.select("*", *(F.lag(f"c_{c}").over(w).alias(f"pc_{c}") for c in "xyz"), *(F.lead(f"n_{c}").over(w).alias(f"nn_{c}") for c in "xyz"))
    angles = near.select("structure_id", "residue_idx", F.round(F.expr(_PHI), 6).alias("phi"), F.round(F.expr(_PSI), 6).alias("psi"))
    return angles.select("structure_id", "residue_idx", r6("phi").alias("phi"), r6("psi").alias("psi"), F.expr(_SS).alias("ss"))


@query("D19_structural_confidence", with_("exposure") + f"SELECT id, {sql_r6('avg(exposure)')} AS mean, count(*) FILTER (exposure < 0.5) AS n_low, coalesce(string_agg(CASE WHEN exposure < 0.5 THEN pos END, ',' ORDER BY pos), '') AS low_at FROM exposure GROUP BY id")
def d19(v):
    per = v.exposure.groupBy("id").agg(F.avg("exposure").alias("mean"), F.count_if(F.col("exposure") < 0.5).alias("n_low"), F.sort_array(F.collect_list(F.when(F.col("exposure") < 0.5, F.col("pos")))).alias("at"))
    return per.select("id", r6("mean").alias("mean"), "n_low", F.array_join(F.transform("at", lambda p: p.cast("string")), ",").alias("low_at"))


@query("D20_ss_composition", with_("residues", more="s AS (SELECT id, CASE (id + pos * pos) % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'E' ELSE 'C' END AS ss FROM residues), c AS (SELECT id, avg((ss = 'H')::int) AS h, avg((ss = 'E')::int) AS e, avg((ss = 'C')::int) AS c FROM s GROUP BY id)") + f"SELECT id, {sql_r6('h')} AS helix, {sql_r6('e')} AS strand, {sql_r6('c')} AS coil, CASE WHEN h >= e AND h >= c THEN 'H' WHEN e >= c THEN 'E' ELSE 'C' END AS dominant FROM c")
def d20(v):
    ss = v.residues.selectExpr("id", "case (id + pos * pos) % 3 when 0 then 'H' when 1 then 'E' else 'C' end as ss")
    c = ss.groupBy("id").agg(*((F.count_if(F.col("ss") == k) / F.count(F.lit(1))).alias(n) for k, n in (("H", "h"), ("E", "e"), ("C", "c"))))
    return c.select("id", r6("h").alias("helix"), r6("e").alias("strand"), r6("c").alias("coil"), F.expr("case when h >= e and h >= c then 'H' when e >= c then 'E' else 'C' end").alias("dominant"))


# Libraries: parents are the reference panel.
_A = f"'{S.ALPHABET}'"


@query("L1_substitution_scan", with_("seed_residues") + f"SELECT s.id, pos, n.aa AS new, substr(sequence, 1, pos) || n.aa || substr(sequence, pos + 2) AS variant FROM seeds s JOIN seed_residues r USING (id) JOIN (SELECT unnest(string_split({_A}, '')) AS aa) n ON n.aa <> r.aa")
def l1(v):
    each = v.seeds.select("id", "sequence", F.posexplode(F.split("sequence", "")).alias("pos", "aa")).withColumn("new", F.explode(F.split(F.lit(S.ALPHABET), "")))
    return each.where("new <> aa").select("id", "pos", "new", F.overlay("sequence", "new", F.col("pos") + 1, F.lit(1)).alias("variant"))


@query("L2_indel_scan", with_("seed_residues", more=f"e AS (SELECT s.id, pos, sequence, substr({_A}, cast((s.id + pos) % 20 + 1 AS bigint), 1) AS x FROM seeds s JOIN seed_residues USING (id))") + "SELECT id, 'del@' || pos AS edit, substr(sequence, 1, pos) || substr(sequence, pos + 2) AS variant FROM e UNION ALL SELECT id, 'ins@' || pos || ':' || x, substr(sequence, 1, pos) || x || substr(sequence, pos + 1) FROM e UNION ALL SELECT id, 'sub@' || pos || ':' || x, substr(sequence, 1, pos) || x || substr(sequence, pos + 2) FROM e")
def l2(v):
    e = v.seeds.select("id", "sequence", F.posexplode(F.split("sequence", "")).alias("pos", "aa")).withColumn("x", F.expr(f"substr({_A}, cast((id + pos) % 20 + 1 as int), 1)"))
    ways = F.expr("array(struct(concat('del@', pos) as edit, concat(substr(sequence, 1, pos), substr(sequence, pos + 2)) as variant), struct(concat('ins@', pos, ':', x) as edit, concat(substr(sequence, 1, pos), x, substr(sequence, pos + 1)) as variant), struct(concat('sub@', pos, ':', x) as edit, concat(substr(sequence, 1, pos), x, substr(sequence, pos + 2)) as variant))")
    return e.select("id", F.explode(ways).alias("w")).select("id", "w.edit", "w.variant")


@query("L3_truncation_scan", with_("seeds", more="k AS (SELECT id, sequence, unnest(range(1, length(sequence) - 5)) AS k FROM seeds WHERE length(sequence) > 6)") + "SELECT id, k, 'N' AS side, substr(sequence, k + 1) AS variant FROM k UNION ALL SELECT id, k, 'C', substr(sequence, 1, length(sequence) - k) FROM k")
def l3(v):
    k = v.seeds.where("length(sequence) > 6").select("id", "sequence", F.expr("explode(sequence(1, length(sequence) - 6))").alias("k"))
    return k.select("id", "k", F.expr("explode(array(struct('N' as side, substr(sequence, k + 1) as variant), struct('C' as side, left(sequence, length(sequence) - k) as variant)))").alias("w")).selectExpr("id", "cast(k as bigint) as k", "w.side", "w.variant")


@query("L4_length_repair", with_("peptides") + f"SELECT id, rpad(left(sequence, 30), greatest(12, least(30, length(sequence)))::int, substr({_A}, cast(id % 20 + 1 AS bigint), 1)) AS repaired FROM peptides")
def l4(v):
    """Drop what is no residue, cut to 30, pad to 12 with a residue chosen by the id."""
    kept = F.substring(F.regexp_replace("sequence", f"[^{S.ALPHABET}]", ""), 1, 30)
    return v.peptides.select("id", F.rpad(kept, F.greatest(F.lit(12), F.length(kept)), F.expr(f"substr({_A}, cast(id % 20 + 1 as int), 1)")).alias("repaired"))


_CUT = "cast(({0}.item * 31 + {0}.slot * 17 + {1}) % greatest(length({0}.sequence) - 1, 1) + 1 as int)"


@query(
    "L5_crossover_pairs",
    with_("seeds", more="p AS (SELECT id // 1000000 AS item, id % 1000000 AS slot, sequence FROM seeds)")
    + f"""SELECT a.item, a.slot, left(a.sequence, {_CUT.format('a', 5)}) || substr(b.sequence, {_CUT.format('b', 3)} + 1) AS one,
left(b.sequence, {_CUT.format('b', 3)}) || substr(a.sequence, {_CUT.format('a', 5)} + 1) AS two FROM p a JOIN p b ON a.slot = b.slot AND b.item = a.item + 1""",
)
def l5(v):
    """Two children of each pair, cut at a point of each parent's own."""
    p = v.seeds.selectExpr("id div 1000000 as item", "id % 1000000 as slot", "sequence")
    a, b = p.alias("a"), p.alias("b")
    pairs = a.join(b, (F.col("a.slot") == F.col("b.slot")) & (F.col("b.item") == F.col("a.item") + 1))
    one, two = _CUT.format("a", 5), _CUT.format("b", 3)
    return pairs.selectExpr("a.item", "a.slot", f"concat(left(a.sequence, {one}), substr(b.sequence, {two} + 1)) as one", f"concat(left(b.sequence, {two}), substr(a.sequence, {one} + 1)) as two")


@query("L6_tournament_select", with_("predictions", more="p AS (SELECT id // 1000000 AS pop, row_number() OVER (PARTITION BY id // 1000000 ORDER BY id) - 1 AS k, id, coalesce(amp, -10) AS fit FROM predictions), n AS (SELECT pop, count(*) AS n FROM p GROUP BY pop), d AS (SELECT pop, slot, draw, (pop * 7919 + slot * 104729 + draw * 1299709) % n AS k FROM n CROSS JOIN (SELECT unnest(range(0, 4)) AS slot) CROSS JOIN (SELECT unnest(range(0, 3)) AS draw))") + "SELECT pop, slot, arg_max(id, fit * 1e9 - id % 1000000) AS winner FROM d JOIN p USING (pop, k) GROUP BY pop, slot")
def l6(v):
    """Per population four winners, each the best of three draws by a hash of slot and draw."""
    w = Window.partitionBy("pop")
    p = v.predictions.selectExpr("id div 1000000 as pop", "id", "coalesce(amp, -10) as fit").withColumn("k", F.row_number().over(w.orderBy("id")) - 1)
    n = p.groupBy("pop").agg(F.count(F.lit(1)).alias("n"))
    draws = n.select("pop", "n", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("slot")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("draw"))
    d = draws.selectExpr("pop", "cast(slot as bigint) as slot", "cast((pop * 7919 + slot * 104729 + draw * 1299709) % n as int) as k")
    return d.join(p, ["pop", "k"]).groupBy("pop", "slot").agg(F.max_by("id", F.expr("fit * 1e9 - id % 1000000")).alias("winner"))


_TRY_SQL = f"t AS (SELECT id, a, sequence, substr(sequence, 1, (id + a * 7) % length(sequence)) || substr({_A}, cast((id * 3 + a) % 20 + 1 AS bigint), 1) || substr(sequence, (id + a * 7) % length(sequence) + 2) AS variant FROM seeds CROSS JOIN (SELECT unnest(range(0, 25)) AS a)), u AS (SELECT *, (length(variant) - length(translate(variant, 'KR', ''))) > (length(variant) - length(translate(variant, 'DE', ''))) AS pass FROM t)"


def _tries(v):
    t = v.seeds.select("id", "sequence", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("a"))
    at = F.expr("cast((id + a * 7) % length(sequence) as int)")
    t = t.select("id", F.col("a").cast("long").alias("a"), F.overlay(F.col("sequence"), F.expr(f"substr({_A}, cast((id * 3 + a) % 20 + 1 as int), 1)"), at + 1, F.lit(1)).alias("variant"))
    return t.withColumn("pass", D.count_of("KR", "variant") > D.count_of("DE", "variant"))


@query("L7_constrained_retry_to_set", with_("seeds", more=_TRY_SQL) + "SELECT id, coalesce(min(a) FILTER (pass), 24) AS attempt, coalesce(arg_min(variant, a) FILTER (pass), arg_max(variant, a)) AS variant FROM u GROUP BY id")
def l7(v):
    """The first of 25 attempts that meets the constraint (net positive); else the last."""
    order = F.when(F.col("pass"), F.col("a")).otherwise(100 - F.col("a"))
    return _tries(v).groupBy("id").agg(F.min_by(F.struct("a", "variant"), order).alias("x")).select("id", F.col("x.a").alias("attempt"), "x.variant")


@query("L8_unique_variant_pool", with_("seeds", more=_TRY_SQL + ", f AS (SELECT id, variant, min(a) AS a FROM u GROUP BY id, variant), g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY a) AS k FROM f)") + "SELECT id, variant, k FROM g WHERE k <= 5")
def l8(v):
    first = _tries(v).groupBy("id", "variant").agg(F.min("a").alias("a"))
    return first.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("a")).cast("long")).where("k <= 5").select("id", "variant", "k")


@query("L9_evaluate_unseen_distinct", with_("residues", "seeds") + f", d AS (SELECT DISTINCT sequence FROM peptides WHERE sequence NOT IN (SELECT sequence FROM seeds)), h AS (SELECT sequence, avg(kd) AS h FROM (SELECT DISTINCT p.sequence, r.pos, r.aa FROM peptides p JOIN residues r USING (id)) JOIN {WIDE} w USING (aa) GROUP BY sequence) SELECT sequence, CASE WHEN length(sequence) BETWEEN 8 AND 35 THEN {sql_r6('h')} ELSE -10.0 END AS fitness FROM d JOIN h USING (sequence)")
def l9(v):
    """Distinct sequences that the cache lacks; only those that pass the filter are scored, others get the floor."""
    new = v.peptides.select("sequence").distinct().join(v.seeds.select("sequence").distinct(), "sequence", "left_anti")
    return new.select("sequence", F.when(F.length("sequence").between(8, 35), r6(D.mean_of(S.KYTE_DOOLITTLE))).otherwise(F.lit(-10.0)).alias("fitness"))


_ROUNDS = 3


@query("L10_generation_round", with_("seeds", more="start AS (SELECT id // 1000000 AS family, sequence FROM seeds),\n" + L.generations_sql("start", _ROUNDS)) + " UNION ALL ".join(f"SELECT {k} AS round, pop, family, generation, sequence, {sql_r6('fitness')} AS fitness, class FROM p{k}" for k in range(1, _ROUNDS + 1)))
def l10(v):
    """Three rounds of generation from the reference panel: who survives each."""
    start = v.seeds.selectExpr("id div 1000000 as family", "sequence")
    return L.generations(start, _ROUNDS, stage).withColumn("fitness", r6("fitness"))


_SHUFFLED = "(id % 1000003 * 7919 + copy * 104729 + i * 1299709) % 1000003"


@query(
    "L11_scrambled_controls",
    with_("seeds", "seed_residues", "peptides", more=f"""k AS (SELECT unnest(range(1, 4)) AS copy),
m AS (SELECT id, copy, pos AS i, aa, {_SHUFFLED.replace(" i ", " pos ")} AS h FROM seed_residues CROSS JOIN k),
w AS (SELECT id, length(sequence) AS n FROM seeds),
d AS (SELECT length(sequence) AS n, id AS decoy, sequence, row_number() OVER (PARTITION BY length(sequence) ORDER BY id % 1000003 * 7919 % 1000003, id) AS k FROM peptides),
s AS (SELECT id, n, row_number() OVER (PARTITION BY n ORDER BY id) AS k FROM w),
t AS (SELECT n, max(k) AS many FROM d GROUP BY n)""")
    + """SELECT id, 'scrambled' AS kind, copy, string_agg(aa, '' ORDER BY h, i) AS sequence FROM m GROUP BY id, copy
UNION ALL SELECT s.id, 'decoy', 0, d.sequence FROM s JOIN t USING (n) JOIN d ON d.n = s.n AND d.k = (s.k - 1) % many + 1""",
)
def l11(v):
    """Three copies of each parent with residues in the order of a hash, and one random candidate of the parent's length."""
    each = v.seeds.select("id", "sequence", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("copy"))
    order = (F.col("id") % 1000003 * 7919 + F.col("copy") * 104729)
    mixed = F.array_sort(F.transform(F.split("sequence", ""), lambda a, i: F.struct(((order + i * 1299709) % 1000003).alias("h"), i.alias("i"), a.alias("a"))))
    scrambled = each.select("id", F.lit("scrambled").alias("kind"), F.col("copy").cast("long").alias("copy"), F.array_join(F.transform(mixed, lambda x: x["a"]), "").alias("sequence"))
    return scrambled.unionByName(L.decoys(v.seeds, v.peptides).withColumn("kind", F.lit("decoy")).withColumn("copy", F.lit(0).cast("long")))


@query("L12_window_library", "WITH c AS (SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS c FROM documents), w AS (SELECT doc_id, substr(c, p, 12) AS s FROM (SELECT doc_id, c, unnest(range(1, length(c) - 10)) AS p FROM c)) SELECT doc_id, count(*) AS windows, count(DISTINCT s) AS distinct_windows FROM w GROUP BY doc_id")
def l12(v):
    """Every window of twelve residues of every whole text, counted; distinct ones are found inside each text."""
    per = L.window_runs(v.table("documents"), "doc_id", counts=True)
    return per.select("doc_id", "windows", "distinct_windows")


@query("L12_windows", "WITH c AS (SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS c FROM documents), w AS (SELECT doc_id, p, substr(c, p, 12) AS sequence FROM (SELECT doc_id, c, unnest(range(1, length(c) - 10)) AS p FROM c)) SELECT doc_id, sequence, min(p) - 1 AS first_at, count(*) AS n FROM w GROUP BY doc_id, sequence")
def l12_windows(v):
    """The windows themselves: each document's distinct ones, where each stands first and how often."""
    return L.window_runs(v.table("documents"), "doc_id")


@query("C15_pareto_dominance_join", with_("seeds", more="s AS (SELECT id, cast(id * 7919 % 101 AS double) / 100 AS a, cast(id * 104729 % 103 AS double) / 100 AS b FROM seeds)") + "SELECT x.id, count(*) AS dominated_by FROM s x JOIN s y ON y.a >= x.a AND y.b >= x.b AND (y.a > x.a OR y.b > x.b) GROUP BY x.id")
def c15(v):
    """How many of the panel dominate each member."""
    s = v.seeds.selectExpr("id", "cast(id * 7919 % 101 as double) / 100 as a", "cast(id * 104729 % 103 as double) / 100 as b")
    return dominators(s, "a", "b", stage).where("dominated_by > 0").select("id", "dominated_by")


@query("C16_nearest_neighbour_distance", with_("seeds") + f"SELECT a.id, {sql_r6('coalesce(min(levenshtein(a.sequence, b.sequence) * 1.0 / greatest(length(a.sequence), length(b.sequence))), 0.0)')} AS distance FROM seeds a LEFT JOIN seeds b ON a.sequence <> b.sequence GROUP BY a.id")
def c16(v):
    """Each member's distance to the nearest other one of the reference panel; 0 without another."""
    return v.seeds.join(nearest(v.seeds, stage), "sequence", "left").select("id", r6(F.coalesce("distance", F.lit(0.0))).alias("distance"))


_PARENTS = "concat_ws(',', cast({d} AS {s}), case when doc_id % 3 <> 0 then cast({t} AS {s}) end)"


@query("C18_lineage_join", f"WITH RECURSIVE history AS (SELECT doc_id, source, {_PARENTS.format(d='doc_id // 2', t='doc_id // 3', s='varchar')} AS parents FROM documents WHERE doc_id > 0), edges AS (SELECT doc_id, cast(unnest(string_split(parents, ',')) AS bigint) AS ancestor FROM history), up AS (SELECT doc_id, ancestor, 1 AS depth FROM edges UNION SELECT up.doc_id, e.ancestor, depth + 1 FROM up JOIN edges e ON up.ancestor = e.doc_id), least AS (SELECT doc_id, ancestor, min(depth) AS depth FROM up GROUP BY ALL) SELECT doc_id, ancestor, depth, source AS ancestor_source FROM least LEFT JOIN (SELECT doc_id AS ancestor, source FROM documents) USING (ancestor)")
def c18(v):
    """All ancestors of each variant at their least depth, with where they come from. Here variant n was crossed from n div 2 and n div
    3, or only mutated from the former, so most have two parents and many meet an ancestor on several ways."""
    history = v.table("documents").where("doc_id > 0").select("doc_id", F.expr(_PARENTS.format(d="doc_id div 2", t="doc_id div 3", s="string")).alias("parents"))
    up = ancestry(edges_of(history, "doc_id", "parents"), stage)
    up = up.select(F.col("child").cast("long").alias("doc_id"), F.col("ancestor").cast("long").alias("ancestor"), "depth")
    return up.join(v.table("documents").select(F.col("doc_id").alias("ancestor"), F.col("source").alias("ancestor_source")), "ancestor", "left")


# Scorers.
def _load_toy():
    """A stand-in for a predictor: share of cationic residues, squashed."""
    return from_scalar(lambda s: sum(map(s.count, "KR")) / max(len(s), 1) * 0.8 + 0.1)


_toy = scorer("cationic share", _load_toy)


_TOY_SQL = "(length({0}) - length(translate({0}, 'KR', ''))) * 1.0 / greatest(length({0}), 1) * 0.8 + 0.1"


@query("K1_batch_scorer", with_("peptides") + f"SELECT id, {sql_r6(_TOY_SQL.format('sequence'))} AS score FROM peptides")
def k1(v):
    return score_distinct(v.peptides, _toy).select("id", r6("score").alias("score"))


_SHARE_SQL = "5 + (length(sequence) - length(translate(sequence, '{0}', ''))) * 1.0 / greatest(length(sequence), 1)"


@query("K2_multi_output_scorer", with_("peptides") + f"SELECT id, {sql_r6(_SHARE_SQL.format('KR'))} AS glp1r, {sql_r6(_SHARE_SQL.format('DE'))} AS gipr FROM peptides")
def k2(v):
    """Two outputs of one sequence, both from its counts: column functions do."""
    share = lambda letters: 5 + D.count_of(letters) / F.greatest(F.length("sequence"), F.lit(1))
    return v.peptides.select("id", r6(share("KR")).alias("glp1r"), r6(share("DE")).alias("gipr"))


@query("K3_pair_scorer", with_("peptides", "seeds") + f"SELECT p.id, s.id AS target, {sql_r6('(' + _TOY_SQL.format('p.sequence') + ') * (' + _TOY_SQL.format('s.sequence') + ')')} AS score FROM peptides p JOIN seeds s ON right(p.sequence, 3) = right(s.sequence, 3)")
def k3(v):
    """(target, binder) pairs of a pair table (here whatever ends alike): each distinct side is encoded once, then two equi joins."""
    end = lambda c: F.expr(f"right({c}, 3)")
    targets = v.seeds.select(F.col("id").alias("target"), F.col("sequence").alias("t"), end("sequence").alias("k"))
    pairs = v.peptides.select("id", "sequence", end("sequence").alias("k")).join(targets, "k").drop("k")
    one = v.peptides.select("sequence").distinct().withColumn("b_q", _toy("sequence"))
    two = v.seeds.select(F.col("sequence").alias("t")).distinct().withColumn("a_q", _toy("t"))
    return pairs.join(one, "sequence").join(two, "t").select("id", "target", r6(F.col("b_q") * F.col("a_q")).alias("score"))


@query("K4_linear_scorer", f"SELECT vec_id, {sql_r6('1 / (1 + exp(-(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::double - 0.01) / 0.5 * (0.1 - 0.001 * i))) + 0.2)))')} AS p FROM embeddings")
def k4(v):
    """Scale, weigh and squash, inside the row."""
    z = F.aggregate(F.transform("embedding", lambda x, i: (x.cast("double") - 0.01) / 0.5 * (0.1 - 0.001 * (i + 1))), F.lit(0.0), lambda a, x: a + x) + 0.2
    return v.table("embeddings").select("vec_id", r6(1 / (1 + F.exp(-z))).alias("p"))


@query("K5_masked_mean_pool", f"WITH e AS (SELECT vec_id, unnest(embedding)::double AS x, unnest(range(1, len(embedding) + 1)) AS i, len(embedding) AS n FROM embeddings) SELECT vec_id, {sql_r6('avg(x)')} AS with_ends, {sql_r6('avg(x) FILTER (i > 1 AND i < n)')} AS without_ends FROM e GROUP BY vec_id")
def k5(v):
    mean = lambda a: F.aggregate(F.transform(a, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return v.table("embeddings").select("vec_id", r6(mean(F.col("embedding"))).alias("with_ends"), r6(mean(F.slice("embedding", F.lit(2), F.size("embedding") - 2))).alias("without_ends"))


@query("K7_pca_scaler_fit_eval", with_("predictions", more="f AS (SELECT id // 1000000 % 5 AS fold, amp AS y, (amp + migration) / 2 AS p FROM predictions WHERE amp IS NOT NULL AND migration IS NOT NULL)") + f"SELECT fold, count(*) AS n, {sql_r6('corr(p, y)')} AS pearson, {sql_r6('sqrt(avg(pow(p - y, 2)))')} AS rmse, {sql_r6('avg(abs(p - y))')} AS mae, {sql_r6('1 - sum(pow(p - y, 2)) / (var_pop(y) * count(*))')} AS r2 FROM f GROUP BY fold")
def k7(v):
    """Whole clusters (parents) go to one fold."""
    f = v.predictions.where("amp is not null and migration is not null").selectExpr("(id div 1000000) % 5 as fold", "amp as y", "(amp + migration) / 2 as p")
    sq = F.sum(F.pow(F.col("p") - F.col("y"), 2))
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), r6(F.corr("p", "y")).alias("pearson"), r6(F.sqrt(sq / F.count(F.lit(1)))).alias("rmse"), r6(F.avg(F.abs(F.col("p") - F.col("y")))).alias("mae"), r6(1 - sq / (F.var_pop("y") * F.count(F.lit(1)))).alias("r2"))


# Tokens of modified peptides: residues, D-residues (lower case) and bracketed blocks.
_TOKEN = r"\[[^\]]*\]|[A-Za-z]"


def notated(v):
    """Candidates in bracket notation."""
    return v.peptides.select("id", F.concat(F.when(F.col("id") % 3 == 0, "[Aib]").otherwise(""), F.when(F.col("id") % 5 == 0, F.lower(F.substring("sequence", 1, 3))).otherwise(F.substring("sequence", 1, 3)), F.when(F.col("id") % 4 == 0, "[K(yE-C16)]").otherwise(""), F.expr("substr(sequence, 4)"), F.when(F.col("id") % 7 == 0, "?").otherwise("")).alias("notation"))


_NOTATED = "notated AS (SELECT id, CASE WHEN id % 3 = 0 THEN '[Aib]' ELSE '' END || CASE WHEN id % 5 = 0 THEN lower(left(sequence, 3)) ELSE left(sequence, 3) END || CASE WHEN id % 4 = 0 THEN '[K(yE-C16)]' ELSE '' END || substr(sequence, 4) || CASE WHEN id % 7 = 0 THEN '?' ELSE '' END AS notation FROM peptides), tok AS (SELECT id, notation, regexp_extract_all(notation, '\\[[^\\]]*\\]|[A-Za-z]') AS t FROM notated)"


@query("H32_tokenise_modified", with_("peptides", more=_NOTATED) + "SELECT id, len(t) AS n_tokens, array_to_string(t, '') = notation AS covered FROM tok")
def h32(v):
    t = notated(v).withColumn("t", F.regexp_extract_all("notation", F.lit(_TOKEN), F.lit(0)))
    return t.select("id", F.size("t").cast("long").alias("n_tokens"), (F.array_join("t", "") == F.col("notation")).alias("covered"))


_PLAIN = "CASE WHEN x = '[Aib]' THEN 'A' WHEN x = '[Sar]' THEN 'G' WHEN x = '[Nle]' THEN 'L' WHEN x LIKE '[%(%' THEN upper(substr(x, 2, 1)) WHEN x LIKE '[%' THEN 'X' ELSE upper(x) END"


@query("H33_canonical_sequence", with_("peptides", more=_NOTATED) + f"SELECT id, array_to_string(list_transform(t, lambda x: {_PLAIN}), '') AS plain FROM tok")
def h33(v):
    t = notated(v).select("id", F.regexp_extract_all("notation", F.lit(_TOKEN), F.lit(0)).alias("t"))
    return t.select("id", F.expr(f"array_join(transform(t, x -> {_PLAIN}), '')").alias("plain"))


@query("H34_token_features", with_("peptides", more=_NOTATED + ", e AS (SELECT id, unnest(t) AS x, unnest(range(0, len(t))) AS pos, len(t) AS n FROM tok)") + f"SELECT id, pos, x AS token, {sql_r6('coalesce(kd, 0)')} AS hydropathy, regexp_full_match(x, '[a-z]') AS is_d, contains(x, '-C') AS is_lipid, coalesce(try_cast(nullif(regexp_extract(x, 'C([0-9]+)', 1), '') AS int), 0) * 14.03 AS lipid_mass, {sql_r6('sin(pi() * pos / n)')} AS s FROM e LEFT JOIN {WIDE} w ON w.aa = upper(x)")
def h34(v):
    t = notated(v).select("id", F.regexp_extract_all("notation", F.lit(_TOKEN), F.lit(0)).alias("t")).select("id", F.size("t").alias("n"), F.posexplode("t").alias("pos", "token"))
    table = v.rows(sorted(S.KYTE_DOOLITTLE.items()), "aa string, kd double")
    carbons = F.coalesce(F.expr("try_cast(nullif(regexp_extract(token, 'C([0-9]+)', 1), '') as int)"), F.lit(0))
    return t.join(F.broadcast(table), F.upper("token") == F.col("aa"), "left").select("id", F.col("pos").cast("long").alias("pos"), "token", r6(F.coalesce("kd", F.lit(0.0))).alias("hydropathy"), F.col("token").rlike("^[a-z]$").alias("is_d"), F.contains("token", F.lit("-C")).alias("is_lipid"), (carbons * 14.03).alias("lipid_mass"), r6(F.sin(F.pi() * F.col("pos") / F.col("n"))).alias("s"))


@query("H39_unit_transforms", with_("predictions") + f"SELECT id, {sql_r6('ln(pow(10, 9 - (5 + 5 * nfkb)))')} AS ln_ec50_nm, pow(10, 9 - (5 + 5 * nfkb)) < 1.0 AS clamped, {sql_r6('pow(10, 6 - (3 + 2 * hemolysis))')} AS hc50_um, {sql_r6('pow(10, half_life * 4) / 60')} AS minutes FROM predictions")
def h39(v):
    return v.predictions.select("id", r6(F.expr("ln(pow(10, 9 - (5 + 5 * nfkb)))")).alias("ln_ec50_nm"), F.expr("pow(10, 9 - (5 + 5 * nfkb)) < 1.0").alias("clamped"), r6(F.expr("pow(10, 6 - (3 + 2 * hemolysis))")).alias("hc50_um"), r6(F.expr("pow(10, half_life * 4) / 60")).alias("minutes"))


@query("H40_potency_score", with_("predictions") + f"SELECT id, CASE WHEN nfkb IS NOT NULL THEN {sql_r6('least(1.0, greatest(0.0, ((5 + 8 * nfkb) - 6) / 6))')} END AS potency FROM predictions")
def h40(v):
    """Linear in pEC50 between the gate (6: 1000 nM) and the floor (12: 0.001 nM)."""
    p = 5 + 8 * F.col("nfkb")
    return v.predictions.select("id", F.when(p.isNotNull(), r6(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (p - 6) / 6)))).alias("potency"))


@query("H41_halflife_hemolysis_scores", with_("predictions") + f"SELECT id, CASE WHEN half_life > 0 THEN {sql_r6('greatest(0.0, least(1.0, 0.5 + 0.5 * log10(half_life * 600 / 60)))')} END AS half_life_score, CASE WHEN hemolysis IS NOT NULL THEN {sql_r6('greatest(0.0, least(1.0, 1 - hemolysis * 6 / 8))')} END AS hemolysis_score FROM predictions")
def h41(v):
    return v.predictions.select("id", r6(F.expr("case when half_life > 0 then greatest(0.0, least(1.0, 0.5 + 0.5 * log10(half_life * 600 / 60))) end")).alias("half_life_score"), r6(F.expr("case when hemolysis is not null then greatest(0.0, least(1.0, 1 - hemolysis * 6 / 8)) end")).alias("hemolysis_score"))


@query("H42_hemolysis_safety_factor", with_("predictions") + f"SELECT id, CASE WHEN amp IS NULL OR hemolysis IS NULL THEN -10.0 ELSE {sql_r6('amp * pow(10, 6 - (3 + 2 * hemolysis)) / (pow(10, 6 - (3 + 2 * hemolysis)) + 100)')} END AS fitness FROM predictions")
def h42(v):
    um = F.expr("pow(10, 6 - (3 + 2 * hemolysis))")
    return v.predictions.select("id", F.coalesce(r6(F.col("amp") * um / (um + 100)), F.lit(-10.0)).alias("fitness"))


@query("H43_inverse_distance", with_("atoms") + f"SELECT structure_id, residue_idx, atom, {sql_r6('1 / (x + 1)')} AS near FROM atoms")
def h43(v):
    return v.atoms.select("structure_id", "residue_idx", "atom", r6(1 / (F.nanvl("x", F.lit(0.0)) + 1)).alias("near"))


_RAW = "'<|endoftext|>\\n' || left(text, 12) || '\\n' || 'ACDEFGHIK' || (CASE doc_id % 3 WHEN 0 THEN 'LMNPQ' WHEN 1 THEN 'BZ' ELSE '' END) || '<|endoftext|>x'"


@query("H45_clean_generated_text", "WITH r AS (SELECT doc_id, '<s>' || upper(lang) || chr(10) || 'ACDEFGHIK' || (CASE doc_id % 3 WHEN 0 THEN 'LMNPQ' WHEN 1 THEN 'BZ' ELSE '' END) || '<end>' || source AS raw FROM documents), c AS (SELECT min(doc_id) AS first_id, regexp_replace(regexp_replace(split_part(raw, '<end>', 1), '<[^>]*>', '', 'g'), '\\s+', '', 'g') AS sequence FROM r GROUP BY 2) SELECT first_id, sequence FROM c WHERE regexp_full_match(sequence, '[ACDEFGHIKLMNPQRSTVWY]{6,40}')")
def h45(v):
    """The text before the end mark, without tags and white space; only whole standard sequences of a fit length, each once."""
    raw = v.table("documents").select("doc_id", F.concat(F.lit("<s>"), F.upper("lang"), F.lit("\nACDEFGHIK"), F.expr("case doc_id % 3 when 0 then 'LMNPQ' when 1 then 'BZ' else '' end"), F.lit("<end>"), "source").alias("raw"))
    text = F.regexp_replace(F.regexp_replace(F.split_part("raw", F.lit("<end>"), F.lit(1)), "<[^>]*>", ""), r"\s+", "")
    return raw.select("doc_id", text.alias("sequence")).where(G.is_standard() & F.length("sequence").between(6, 40)).groupBy("sequence").agg(F.min("doc_id").alias("first_id")).select("first_id", "sequence")


del _RAW
