"""Gates: three-valued checks that become pass, flag, reject or not_screened. A missing value never passes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET = "ACDEFGHIKLMNPQRSTVWY"


@dataclass(frozen=True)
class Check:
    """One check: `bad` (a SQL predicate) gives `outcome`; a NULL predicate means that the check did not run."""

    name: str
    bad: str
    outcome: str = "flag"

    def column(self) -> Column:
        return F.expr(f"case when ({self.bad}) is null then 'not_screened' when {self.bad} then '{self.outcome}' else 'pass' end").alias(self.name)

    def sql(self) -> str:
        return f"CASE WHEN ({self.bad}) IS NULL THEN 'not_screened' WHEN {self.bad} THEN '{self.outcome}' ELSE 'pass' END AS {self.name}"


def verdicts(df: DataFrame, checks: list[Check]) -> DataFrame:
    """df with a column for each check, overall, and not_screened (names, sorted)."""
    return rolled_up(df.select("*", *(c.column() for c in checks)), [c.name for c in checks])


def rolled_up(df: DataFrame, names: list[str]) -> DataFrame:
    """overall: reject if any check rejects, else flag if any flags or did not run, else pass."""
    every = F.array(*names)
    overall = F.when(F.array_contains(every, "reject"), "reject").when(F.array_contains(every, "flag") | F.array_contains(every, "not_screened"), "flag").otherwise("pass")
    unscreened = F.array_sort(F.array_compact(F.array(*(F.when(F.col(n) == "not_screened", n) for n in names))))
    return df.withColumn("overall", overall).withColumn("not_screened", unscreened)


def rollup_sql(names: list[str]) -> str:
    """The roll-up in DuckDB: overall, and not_screened as text."""
    every = ", ".join(names)
    missing = " || ".join(f"CASE WHEN {n} = 'not_screened' THEN '{n},' ELSE '' END" for n in sorted(names))
    return f"CASE WHEN 'reject' IN ({every}) THEN 'reject' WHEN 'flag' IN ({every}) OR 'not_screened' IN ({every}) THEN 'flag' ELSE 'pass' END AS overall, {missing} AS not_screened"


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The texts whose condition holds, in order (an unknown condition does not)."""
    return F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in pairs)))


def is_standard(seq: str = "sequence") -> Column:
    return F.coalesce(F.col(seq).rlike(f"^[{ALPHABET}]+$"), F.lit(False))


def valid_sequence(least: int, most: int, seq: str = "sequence") -> Column:
    """Standard residues and a length strictly between the bounds."""
    n = F.length(F.trim(seq))
    return is_standard(seq) & (n > least) & (n < most)


def first_of(*pairs: tuple[Column, str]) -> Column:
    """The first text whose condition holds; null if none does."""
    return F.coalesce(*(F.when(c, F.lit(r)) for c, r in pairs))


def either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


#: Checks of the wound screen (a condition names the columns that descriptors.physchem and the model outputs have).
WOUND = [
    Check("molecular_weight_check", "molecular_weight > 5000", "reject"),
    Check("length_check", "length > 30"),
    Check("net_charge_check", "net_charge < -5 or net_charge > 9"),
    Check("hydrophobicity_check", "hydrophobicity > 0.5", "reject"),
    Check("hydrophobic_moment_check", "hydrophobic_moment > 0.5"),
    Check("amphipathicity_check", "amphipathicity > 0.8"),
    Check("solubility_check", "solubility < 0.4"),
    Check("aggregation_check", "aggregation > 0.6"),
    Check("disulfide_check", "disulfide_category in ('flag', 'high')"),
    Check("instability_check", "instability_index > 40"),
    Check("oxidation_check", "n_oxidation > 2"),
    Check("deamidation_check", "n_deamidation > 2"),
]
METABOLIC = [
    Check("length_check", "length < 5 or length > 50", "reject"),
    Check("molecular_weight_check", "molecular_weight > 5000", "reject"),
    Check("molecular_weight_tier", "molecular_weight > 4577.6"),
    Check("hydrophobicity_check", "hydrophobicity > 0.3", "reject"),
    Check("net_charge_check", "net_charge < -3.02 or net_charge > 1.03"),
    Check("hydrophobic_moment_check", "hydrophobic_moment > 0.189"),
    Check("amphipathicity_check", "amphipathicity > 0.245"),
    Check("instability_check", "instability_index > 70.5"),
    Check("solubility_check", "solubility < 0.173"),
    Check("aggregation_check", "aggregation > 0.47"),
    Check("oxidation_check", "n_oxidation > 3"),
    Check("deamidation_check", "n_deamidation > 1"),
]
SAFETY = [
    Check("hemolysis_check", "hemolysis * 6 > 4", "reject"),
    Check("cytotoxicity_check", "cytotoxicity > 0.5", "reject"),
    Check("aggregation_check", "aggregation > 0.7", "reject"),
    Check("solubility_check", "solubility < 0.3"),
    Check("cleavage_check", "cleavage_stability < 0.3", "reject"),
]


def safety_metabolic(hemolysis: bool = True) -> list[Check]:
    """With hemolysis off its check is `disabled` and does not count."""
    first = Check("hemolysis_check", "hemolysis > 0.5", "reject") if hemolysis else Check("hemolysis_check", "true", "disabled")
    return [first, *SAFETY[1:3], Check("solubility_check", "solubility < 0.173"), SAFETY[4], Check("half_life_check", "half_life * 600 < 60", "reject")]


def cosmetic_rejects(band: bool = True) -> Column:
    """Reasons to reject by the cosmetic rules; the seed band's columns (hydrophobicity_low, hydrophobicity_high, moment_high) are
    null where there are fewer than two seeds, and are then skipped."""
    c = F.col
    return reasons(
        (c("molecular_weight") > 3000, "molecular_weight_too_high"),
        (~c("net_charge").between(-1, 2), "net_charge_out_of_range"),
        (~c("hydrophobicity").between(c("hydrophobicity_low"), c("hydrophobicity_high")), "hydrophobicity_outside_seed_range"),
        ((c("hydrophobic_moment") > c("moment_high")) & (c("net_charge") >= 2), "membrane_active_profile"),
        (c("sequence").rlike(r"(.)\1{2,}"), "repeated_residues"),
    )


def cosmetic_flags() -> Column:
    """Names of flags that never reject."""
    s = F.col("sequence")
    cys = F.length(s) - F.length(F.translate(s, "C", ""))
    return reasons((s.rlike("[CMW]"), "oxidation"), (s.contains("NG"), "deamidation"), (s.contains("DP"), "hydrolysis"), (s.startswith("Q"), "terminal_gln"), (cys > 0, "unpaired_cys"), (F.col("molecular_weight").between(1000, 1500), "mw_high"))


def modification_reasons(least: int = 6, most: int = 40) -> Column:
    """What is wrong with a sequence and its modifications: columns acetyl_at, amide_at (text), lipid_at (text or number as text),
    d_positions (array of int); all nullable."""
    c, n = F.col, F.length("sequence")
    lipid = F.expr("try_cast(lipid_at as int)")
    bad_lipid = (c("lipid_at") != "n_terminus") & (lipid.isNull() | (lipid < 0) | (lipid >= n))
    off_lysine = lipid.isNotNull() & ~bad_lipid & (F.substr("sequence", lipid + 1, F.lit(1)) != "K")
    return reasons(
        (F.coalesce(n, F.lit(0)) == 0, "empty_sequence"),
        ((n > 0) & ~is_standard(), "non_standard_alphabet"),
        (~n.between(least, most), "length_out_of_range"),
        (c("acetyl_at") != "n_terminus", "n_acetyl_not_at_terminus"),
        (c("amide_at") != "c_terminus", "c_amide_not_at_terminus"),
        (c("acetyl_at").isNotNull() & (c("lipid_at").isin("n_terminus", "0")), "n_acetyl_n_terminus_not_free"),
        (bad_lipid, "lipid_tail_position_invalid"),
        (off_lysine, "lipid_tail_not_on_lys"),
        (F.exists("d_positions", lambda p: (p < 0) | (p >= n)), "d_amino_acid_position_out_of_range"),
    )


def constraint_reasons(least: int = 10, most: int = 35) -> Column:
    """Hard bounds of the generator: length, charge, hydrophobicity, the worst five-residue window, solubility."""
    c = F.col
    return F.when(~is_standard(), F.array(F.lit("invalid_sequence"))).otherwise(
        reasons(
            (~c("length").between(least, most), "length_out_of_range"),
            (~c("net_charge").between(-3, 8), "charge_out_of_range"),
            (~c("hydrophobicity").between(-1, 1), "hydrophobicity_out_of_range"),
            (c("window_max") > 3, "aggregation_score_too_high"),
            (solubility_flag() == "very_low", "solubility_very_low"),
        )
    )


def solubility_flag() -> Column:
    q, h = F.abs("net_charge"), F.col("hydrophobicity")
    return F.when((q < 1) & (h > 0.5), "very_low").when((q < 2) & (h > 0.2), "low").when((q >= 3) | (h <= 0), "high").otherwise("moderate")


def irritation_score() -> Column:
    return F.col("hydrophobic_moment") * F.greatest(F.col("net_charge"), F.lit(0.0))


def irritation_tier(score: Column, lipid: Column) -> Column:
    """low, medium, high by the seeds' percentiles (medium_min, high_min); nothing at or under 0 is above low; a lipid tail adds one."""
    tier = F.when((score <= 0) | (score < F.col("medium_min")), 0).when(score <= F.col("high_min"), 1).otherwise(2)
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.least(tier + F.when(lipid, 1).otherwise(0), F.lit(2)) + 1)


def run_state(worker: Column, platform: Column) -> Column:
    """What a run is, from the worker's own report and the platform's state; the order is the rule."""
    ended = platform.isin("JOB_STATE_SUCCEEDED", "JOB_STATE_FAILED", "JOB_STATE_CANCELLED", "JOB_STATE_EXPIRED", "JOB_STATE_PARTIALLY_SUCCEEDED")
    return (
        F.when(worker == "success", "succeeded").when(worker.isin("failed", "fail"), "failed").when(platform == "JOB_STATE_CANCELLED", "cancelled")
        .when(platform.isin("JOB_STATE_FAILED", "JOB_STATE_EXPIRED"), "failed").when(ended, "abandoned").when(worker == "running", "running").otherwise("submitted")
    )
