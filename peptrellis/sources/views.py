"""Candidate tables cut from the given tables: whole texts become peptides, residues and scores.

Each view is a DataFrame of the engine's input contracts (candidates, residues, member scores, cleavage sites, atoms, run events).
Values that stand for model outputs are arithmetic on ids.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scales import ALPHABET

#: Ranking modules: number, name, group.
MODULES = [
    (1, "wound_closure", "objective"),
    (2, "antimicrobial", "objective"),
    (3, "anti_inflammatory", "objective"),
    (4, "immunomodulation", "objective"),
    (5, "angiogenesis", "objective"),
    (6, "collagen_ecm", "objective"),
    (7, "safety", "always_on"),
    (8, "stability", "always_on"),
    (9, "synthesis_feasibility", "always_on"),
    (10, "mechanistic_confidence", "always_on"),
]
#: The enzyme panel: accessions of four proteases, and where they act.
ENZYMES = [(1, "P08246", "skin"), (2, "P14780", "skin"), (3, "P00750", "dermis"), (4, "Q99895", "gut")]


def values(rows: list[tuple], columns: str) -> str:
    """A VALUES relation that Spark and DuckDB both read."""
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"cast({x} AS double)" if isinstance(x, float) else str(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({columns}))"


#: Bytes that are residues in upper case, and what is left out of a text.
_UPPER = bytes(range(256)).upper()
_DROPPED = bytes(b for b in range(256) if chr(b).upper() not in ALPHABET or b > 127)
#: Rows of a batch of peptides.
_ROWS = 16_384
#: Ids of documents that are broadcast; more are joined by a shuffle.
SENT_IDS = 100_000


def residues_of(text: str | None) -> bytes:
    """A text's residues: its letters in upper case that stand for one."""
    return (text or "").encode().translate(_UPPER, _DROPPED)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Peptides of texts (k, text). A text's residues lie side by side; only the places where peptides begin are computed."""
    ids, parts, sizes, rows = [], [], [], 0

    def batch():
        places = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
        sequences = pa.StringArray.from_buffers(rows, pa.py_buffer(places), pa.py_buffer(b"".join(parts)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), sequences], ["id", "sequence"])

    for given in batches:
        for k, text in zip(given.column(0), given.column(1), strict=True):
            k = k.as_py()
            width = 0 if k is None else 8 + int(math.fmod(k, 33))
            clean = residues_of(text.as_py()) if width > 0 else b""
            n = -(-len(clean) // width) if clean else 0
            for first in range(0, n, _ROWS):
                last = min(n, first + _ROWS)
                parts.append(clean[first * width : last * width])
                ids.append(k * 1_000_000 + np.arange(first, last))
                sizes.append(np.full(last - first, width))
                sizes[-1][-1] = len(parts[-1]) - (last - first - 1) * width
                rows += last - first
                if rows >= _ROWS:
                    yield batch()
                    ids, parts, sizes, rows = [], [], [], 0
    if rows:
        yield batch()


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def rows(self, data: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(data, schema)

    def tiled(self, texts: DataFrame, key: str) -> DataFrame:
        """Every text's residues, cut into consecutive peptides of 8 to 40 residues (8 + key % 33; the last may be shorter)."""
        cores = self.spark.sparkContext.defaultParallelism
        if texts.rdd.getNumPartitions() < cores:
            # A few small files only: deal their texts out to all cores before each becomes hundreds of peptides.
            texts = texts.select(key, "text").repartition(cores, key)
        return texts.select(F.col(key).cast("long").alias("k"), "text").mapInArrow(_tiles, "id long, sequence string")

    def by_id(self, alone: Callable[[Views], DataFrame], shared: Callable[[Views], DataFrame]) -> DataFrame:
        """alone(candidates whose ids are theirs only), where all that is known of an id lies in one row, and shared(candidates of
        documents whose doc_id others have too), where rows must meet by id. doc_id is a key, so as a rule there are none of those."""
        docs = self.table("documents")
        often = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
        n = often.limit(SENT_IDS + 1).count()
        if not n:
            return alone(self)
        often = F.broadcast(often) if n <= SENT_IDS else often
        parts = []
        for f, how in ((alone, "left_anti"), (shared, "left_semi")):
            part = Views(self.spark, self.dir)
            part.peptides = self.tiled(docs.join(often, "doc_id", how), "doc_id")
            parts.append(f(part))
        return parts[0].unionByName(parts[1])

    @cached_property
    def peptides(self) -> DataFrame:
        """id, sequence: the candidates."""
        return self.tiled(self.table("documents"), "doc_id")

    @cached_property
    def seeds(self) -> DataFrame:
        """id, sequence: the reference panel."""
        return self.tiled(self.table("benchmark"), "item_id")

    @cached_property
    def residues(self) -> DataFrame:
        """id, pos (from 0), aa."""
        return self.peptides.select("id", F.posexplode(F.split("sequence", "")).alias("pos", "aa"))

    @cached_property
    def module_scores(self) -> DataFrame:
        """id, module, grp, score: ten modules, some without a score."""
        modules = self.rows(MODULES, "k int, module string, grp string")
        score = F.expr(_MODULE_SCORE.format(k="k"))
        return self.peptides.select("id").crossJoin(F.broadcast(modules)).select("id", "k", "module", "grp", score.alias("score"))

    def module_columns(self) -> dict[str, Column]:
        """The scores of module_scores as one expression on id for each module."""
        return {m: F.expr(_MODULE_SCORE.format(k=k)) for k, m, _ in MODULES}

    @cached_property
    def member_scores(self) -> DataFrame:
        """id, member, value: five members of an ensemble."""
        return self.peptides.select("id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("member")).withColumn("value", F.expr("cast((id * 6151 + member * 15485863) % 1013 as double) / 1012"))

    #: The enzymes that have sites: number and accession.
    site_enzymes = [e[:2] for e in ENZYMES if e[0] <= 3]

    @staticmethod
    def probability(pos: Column | str, k: Column | str) -> Column:
        """How likely enzyme k cuts candidate id at pos."""
        return ((F.col("id") * 31 + pos * 977 + k * 7) % 101).cast("double") / 100

    @staticmethod
    def exposed(pos: Column) -> Column:
        """How exposed the residue at pos of candidate id is; null for candidates without a structure (id % 4 = 3)."""
        return F.when(F.col("id") % 4 != 3, ((F.col("id") * 13 + pos * 17) % 21).cast("double") / 20)

    @cached_property
    def sites(self) -> DataFrame:
        """id, accession, pos, probability: cleavage sites of three enzymes at every residue."""
        enzymes = self.rows(self.site_enzymes, "k int, accession string")
        return self.residues.crossJoin(F.broadcast(enzymes)).select("id", "accession", "pos", self.probability(F.col("pos"), F.col("k")).alias("probability"))

    @cached_property
    def exposure(self) -> DataFrame:
        """id, pos, exposure: only for candidates with a structure."""
        return self.residues.where("id % 4 <> 3").select("id", "pos", self.exposed(F.col("pos")).alias("exposure"))

    @cached_property
    def atoms(self) -> DataFrame:
        """structure_id, residue_idx, atom, x, y, z: backbone atoms of the reference panel."""
        atoms = self.rows([(1, "N"), (2, "CA"), (3, "C")], "k int, atom string")
        panel = self.seeds.select("id", F.posexplode(F.split("sequence", "")).alias("pos", "aa"))
        at = {"x": "(id * k + pos * 37) % 97", "y": "(id * 3 + pos * k * 11) % 89", "z": "(id + pos * 5 + k * 29) % 83"}
        return panel.crossJoin(F.broadcast(atoms)).select(F.col("id").alias("structure_id"), F.col("pos").alias("residue_idx"), "atom", *(F.expr(f"cast({e} as double) / 10").alias(n) for n, e in at.items()))

    @cached_property
    def run_events(self) -> DataFrame:
        """event_id, ts, user_id, run_no, status, stage."""
        return self.table("events").select("event_id", "ts", "user_id", F.expr("user_id % 7").alias("run_no"), F.expr("case when event_type = 'view' then null else event_type end").alias("status"), F.expr("case when event_id % 3 = 0 then null else cast(event_id % 9 as string) end").alias("stage"))

    @cached_property
    def predictions(self) -> DataFrame:
        """id, sequence and one column for each stand-in model output; some are missing."""
        p = lambda m, a, miss: f"case when id % {miss} = 0 then null else cast((id % 1009 * {m} + {a}) % 1009 as double) / 1008 end"
        return self.peptides.select("id", "sequence", *(F.expr(p(*v)).alias(n) for n, v in PREDICTIONS.items()))


#: The stand-in score of module number k.
_MODULE_SCORE = "case when {k} = 6 or (id * 3 + {k}) % 11 = 0 then null else cast((id * 7919 + {k} * 104729) % 1009 as double) / 1008 end"
#: Stand-in model outputs in [0, 1]: multiplier, offset, and of how many ids one has none.
PREDICTIONS = {
    "solubility": (7919, 1, 13),
    "aggregation": (6151, 2, 17),
    "cytotoxicity": (104729, 3, 19),
    "hemolysis": (1299709, 4, 23),
    "cleavage_stability": (15485863, 5, 29),
    "amp": (86028121, 6, 31),
    "migration": (49979687, 7, 37),
    "angiogenic": (32452843, 8, 41),
    "anti_inflammatory": (67867967, 9, 43),
    "nfkb": (982451653, 10, 47),
    "cytokine": (57885161, 11, 53),
    "half_life": (24036583, 12, 59),
    "feasibility": (20996011, 13, 61),
    "confidence": (13466917, 14, 67),
}

_TILES = """{n}_clean AS (SELECT {key} AS k, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS c FROM {table}),
{n}_tiles AS (SELECT k, c, cast(8 + k % 33 AS bigint) AS w, unnest(range(0, cast(ceil(length(c) / (8.0 + k % 33)) AS bigint))) AS n FROM {n}_clean WHERE length(c) > 0),
{n} AS (SELECT k * 1000000 + n AS id, substr(c, n * w + 1, w) AS sequence FROM {n}_tiles)"""
#: The views as DuckDB common table expressions, by name; `with_` puts together those that a query names.
CTES = {
    "peptides": ((), _TILES.format(n="peptides", key="doc_id", table="documents")),
    "seeds": ((), _TILES.format(n="seeds", key="item_id", table="benchmark")),
    "residues": (("peptides",), "residues AS (SELECT id, cast(p - 1 AS int) AS pos, substr(sequence, p, 1) AS aa FROM (SELECT id, sequence, unnest(range(1, length(sequence) + 1)) AS p FROM peptides))"),
    "seed_residues": (("seeds",), "seed_residues AS (SELECT id, cast(p - 1 AS int) AS pos, substr(sequence, p, 1) AS aa FROM (SELECT id, sequence, unnest(range(1, length(sequence) + 1)) AS p FROM seeds))"),
    "module_scores": (("peptides",), f"module_scores AS (SELECT id, k, module, grp, CASE WHEN k = 6 OR (id * 3 + k) % 11 = 0 THEN NULL ELSE cast((id * 7919 + k * 104729) % 1009 AS double) / 1008 END AS score FROM peptides CROSS JOIN {values(MODULES, 'k, module, grp')} m)"),
    "member_scores": (("peptides",), "member_scores AS (SELECT id, member, cast((id * 6151 + member * 15485863) % 1013 AS double) / 1012 AS value FROM peptides CROSS JOIN (SELECT cast(unnest(range(0, 5)) AS int) AS member))"),
    "sites": (("residues",), f"sites AS (SELECT id, accession, pos, cast((id * 31 + pos * 977 + k * 7) % 101 AS double) / 100 AS probability FROM residues CROSS JOIN {values([e[:2] for e in ENZYMES if e[0] <= 3], 'k, accession')} e)"),
    "exposure": (("residues",), "exposure AS (SELECT id, pos, cast((id * 13 + pos * 17) % 21 AS double) / 20 AS exposure FROM residues WHERE id % 4 <> 3)"),
    "atoms": (("seed_residues",), "atoms AS (SELECT id AS structure_id, pos AS residue_idx, atom, cast((id * k + pos * 37) % 97 AS double) / 10 AS x, cast((id * 3 + pos * k * 11) % 89 AS double) / 10 AS y, cast((id + pos * 5 + k * 29) % 83 AS double) / 10 AS z FROM seed_residues CROSS JOIN (VALUES (1, 'N'), (2, 'CA'), (3, 'C')) AS a(k, atom))"),
    "run_events": ((), "run_events AS (SELECT event_id, ts, user_id, user_id % 7 AS run_no, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS status, CASE WHEN event_id % 3 = 0 THEN NULL ELSE cast(event_id % 9 AS varchar) END AS stage FROM events)"),
    "predictions": (("peptides",), "predictions AS (SELECT id, sequence, " + ", ".join(f"CASE WHEN id % {q} = 0 THEN NULL ELSE cast((id % 1009 * {m} + {a}) % 1009 AS double) / 1008 END AS {n}" for n, (m, a, q) in PREDICTIONS.items()) + " FROM peptides)"),
}


def with_(*names: str, more: str = "") -> str:
    """WITH ... of the named views and what they need, in order; more: further expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in CTES[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join([CTES[n][1] for n in order] + [more] * bool(more)) + "\n"
