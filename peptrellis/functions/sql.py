"""DuckDB forms of the descriptors, over a relation of residues: what the value checks compare with."""

from __future__ import annotations

from . import scales as S
from ..sources.views import values


def scale(name: dict) -> str:
    return values([(a, float(v)) for a, v in name.items()], "aa, v")


def _wide() -> str:
    rows = [(a, S.MASS[a], S.EISENBERG[a], S.KYTE_DOOLITTLE[a], S.BOMAN[a], S.PK_POSITIVE.get(a), S.PK_NEGATIVE.get(a)) for a in S.ALPHABET]
    return values(rows, "aa, mass, eis, kd, boman, pk_pos, pk_neg")


WIDE = _wide()
_CASE = lambda x, table, default: "CASE " + " ".join(f"WHEN {x} = '{a}' THEN {v}" for a, v in table.items()) + f" ELSE {default} END"


def physchem(table: str = "peptides", residues: str = "residues", name: str = "physchem", ph: float = 7.4) -> str:
    """CTEs {name}_sums, {name}_pairs and {name}: id, sequence and the columns of descriptors.physchem."""
    diwv = values(sorted(S.DIWV.items()), "pair, w")
    return f"""{name}_sums AS (SELECT id, count(*) AS n, sum(mass) AS mass, avg(eis) AS h, avg(abs(eis)) AS ah,
    sum(eis * sin(radians(100.0 * pos))) AS s, sum(eis * cos(radians(100.0 * pos))) AS c,
    sum(CASE WHEN pk_pos IS NULL THEN 0 ELSE 1 / (1 + pow(10, {ph} - pk_pos)) END) - sum(CASE WHEN pk_neg IS NULL THEN 0 ELSE 1 / (1 + pow(10, pk_neg - {ph})) END) AS q
    FROM {residues} JOIN {WIDE} w USING (aa) GROUP BY id),
{name}_pairs AS (SELECT a.id, sum(coalesce(w, {S.DIWV_DEFAULT})) AS w, count(*) FILTER (a.aa = 'N' AND b.aa IN ('G', 'S')) AS deam
    FROM {residues} a JOIN {residues} b ON a.id = b.id AND b.pos = a.pos + 1 LEFT JOIN {diwv} d ON d.pair = a.aa || b.aa GROUP BY a.id),
{name} AS (SELECT p.id, p.sequence, n AS length, round(mass - (n - 1) * {S.WATER}, 9) AS molecular_weight,
    round(q + 1 / (1 + pow(10, {ph} - ({_CASE("left(sequence, 1)", S.PK_N_TERM_OF, S.PK_N_TERM)}))) - 1 / (1 + pow(10, ({_CASE("right(sequence, 1)", S.PK_C_TERM_OF, S.PK_C_TERM)}) - {ph})), 9) AS net_charge,
    round(h, 9) AS hydrophobicity, round(sqrt(s * s + c * c) / n, 9) AS hydrophobic_moment,
    round(CASE WHEN ah > 0 THEN least(1.0, greatest(0.0, sqrt(s * s + c * c) / n / ah)) ELSE 0.0 END, 9) AS amphipathicity,
    round(CASE WHEN n < 2 THEN 0.0 ELSE coalesce(x.w, 0) * 10.0 / n END, 9) AS instability_index,
    length(sequence) - length(translate(sequence, 'MCW', '')) AS n_oxidation, coalesce(deam, 0) AS n_deamidation,
    length(sequence) - length(replace(sequence, 'C', '')) AS cys,
    CASE WHEN cys = 0 THEN 'none' WHEN cys % 2 = 1 THEN 'flag' WHEN cys = 2 THEN 'low' WHEN cys = 4 THEN 'medium' ELSE 'high' END AS disulfide_category
    FROM {table} p JOIN {name}_sums s USING (id) LEFT JOIN {name}_pairs x USING (id))"""


def risk(n: str, low: int = 0, medium: int = 2) -> str:
    return f"CASE WHEN {n} <= {low} THEN 'low' WHEN {n} <= {medium} THEN 'medium' ELSE 'high' END"
