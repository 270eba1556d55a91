"""Generating candidates: rounds of selection, crossover, mutation, repair and filtering, and controls for them.

Choices that a seeded generator would draw are arithmetic on family, generation and slot, so that every run makes the same variants.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import descriptors as D
from ..functions import scales as S
from ..sources.views import residues_of

#: Populations; children of one in a round, draws of a tournament, attempts at a mutation.
POPULATIONS, CHILDREN, DRAWS, ATTEMPTS = 17, 24, 3, 25
#: A population's elites, places that a family has before others are short of them, and size.
ELITES, FAMILY_CAP, SIZE = 4, 3, 40
#: Parts of a population that cut their own candidates for survival first.
DEALS = 64
SHORTEST, LONGEST = 12, 30
FLOOR = -10.0


def fitness() -> Column:
    """Hydrophobicity, less the distance of the charge from 3."""
    return D.hydrophobicity() - F.abs(D.net_charge() - 3) / 10


def _pick(*terms: str, among: str) -> Column:
    return F.expr(f"cast(({' + '.join(terms)}) % ({among}) as int)")


def scored(sequences: DataFrame) -> DataFrame:
    """sequences with fitness; what fails the filter (net positive) has the floor's."""
    return sequences.withColumn("fitness", F.when(D.count_of("KR") > D.count_of("DE"), F.round(fitness(), 9)).otherwise(F.lit(FLOOR)))


def survivors(rows: DataFrame, tie: str = "sequence") -> DataFrame:
    """The rows (pop, family, fitness, tie) that survive, with class: per population the elites (0), then the fittest with at most
    FAMILY_CAP of a family, elites included (1), then whoever is fittest (2), up to SIZE.

    Whoever can survive is among the ELITES + SIZE fittest of its population, or of those with a place in their family: each of DEALS
    parts keeps so many, and only they meet.
    """
    fit = [F.desc("fitness"), F.col(tie)]
    slot = rows.withColumn("_slot", F.row_number().over(Window.partitionBy("pop", "family").orderBy(*fit)))
    deal = Window.partitionBy("pop", F.pmod(F.hash(tie), F.lit(DEALS)), F.col("_slot") <= FAMILY_CAP).orderBy(*fit)
    near = slot.withColumn("_near", F.row_number().over(deal)).where(F.col("_near") <= ELITES + SIZE).drop("_near")
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy("pop").orderBy(*fit)))
    classed = ranked.withColumn("class", F.when(F.col("_rank") <= ELITES, 0).when(F.col("_slot") <= FAMILY_CAP, 1).otherwise(2))
    place = F.row_number().over(Window.partitionBy("pop").orderBy("class", *fit))
    return classed.withColumn("_place", place).where(F.col("_place") <= SIZE).drop("_slot", "_rank", "_place")


def _parents(population: DataFrame, generation: int) -> DataFrame:
    """pop, slot, mother, father (sequence, family): two tournaments for each slot, each won by the fittest of DRAWS members (then by
    sequence). A population has SIZE members at most."""
    members = population.groupBy("pop").agg(F.array_sort(F.collect_list(F.struct((-F.col("fitness")).alias("loss"), "sequence", "family"))).alias("members"))
    slots = members.select("pop", "members", F.size("members").cast("long").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(CHILDREN - 1))).alias("slot"))
    # Members are sorted: the least of the drawn places wins.
    draw = lambda side: F.array_min(F.array(*(_pick("pop * 7919", "slot * 104729", f"{side * DRAWS + d} * 1299709", f"{generation} * 15485863", among="n") for d in range(DRAWS))))
    return slots.select("pop", "slot", F.get("members", draw(0)).alias("mother"), F.get("members", draw(1)).alias("father"))


def _crossed(parents: DataFrame, generation: int) -> DataFrame:
    """pop, slot, family (the mother's), child: the mother's head and the father's tail, cut at a point of each one's own."""
    at = lambda c, k: F.expr(f"cast((pop * 31 + slot * 17 + {k + generation}) % greatest(length({c}.sequence) - 1, 1) + 1 as int)")
    return parents.select("pop", "slot", "mother.family", F.concat(F.substr("mother.sequence", F.lit(1), at("mother", 5)), F.substr("father.sequence", at("father", 3) + 1)).alias("child"))


def _mutants(children: DataFrame, generation: int) -> DataFrame:
    """pop, slot, family, attempt, sequence: ATTEMPTS variants of each child, in turn a substitution, a truncation at the end and at the
    start; each repaired to the allowed lengths."""
    each = children.select("pop", "slot", "family", "child", F.explode(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1))).alias("attempt"))
    at = F.expr(f"cast((pop + slot * 3 + attempt * 7 + {generation}) % length(child) as int)")
    new = F.expr(f"substr('{S.ALPHABET}', cast((pop * 3 + slot + attempt + {generation}) % 20 + 1 as int), 1)")
    changed = F.overlay("child", new, at + 1, F.lit(1))
    cut = F.greatest(F.length("child") - 1, F.lit(1))
    variant = F.when(F.col("attempt") % 3 == 0, changed).when(F.col("attempt") % 3 == 1, F.substr("child", F.lit(1), cut)).otherwise(F.substr("child", F.length("child") - cut + 1))
    kept = F.substring(variant, 1, LONGEST)
    repaired = F.rpad(kept, F.greatest(F.lit(SHORTEST), F.length(kept)), new)
    return each.select("pop", "slot", "family", "attempt", repaired.alias("sequence"))


def generations(start: DataFrame, rounds: int, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """round, pop, family, generation (of birth, 0: from start), sequence, fitness, class: who survives each of so many rounds, bred from
    start (family, sequence; a sequence of two families is the smaller one's).

    A round: tournaments choose parents in each population (families modulo POPULATIONS), which cross over; of a child's attempts the
    first that meets the constraint (net positive) is taken, else the last; sequences that the cache of scores lacks are scored and go
    into it, for all rounds to come; parents and new offspring meet, and elites, family places and backfill choose who survives. Each
    step is written to shared storage.
    """
    born = start.groupBy((F.col("family") % POPULATIONS).alias("pop"), "sequence").agg(F.min("family").alias("family"))
    cache = stage(scored(start.select("sequence").distinct()), "scores")
    population = stage(survivors(born.join(cache, "sequence").withColumn("generation", F.lit(0))), "population")
    out = []
    for k in range(1, rounds + 1):
        tried = _mutants(_crossed(_parents(population, k), k), k)
        met = D.count_of("KR") > D.count_of("DE")
        order = F.when(met, F.col("attempt")).otherwise(2 * ATTEMPTS - F.col("attempt"))
        made = tried.groupBy("pop", "slot", "family").agg(F.min_by("sequence", order).alias("sequence")).groupBy("pop", "sequence").agg(F.min("family").alias("family"))
        made = stage(made.join(population.select("pop", "sequence"), ["pop", "sequence"], "left_anti"), "made")
        unseen = made.select("sequence").distinct().join(cache.select("sequence"), "sequence", "left_anti")
        cache = cache.unionByName(stage(scored(unseen), "scores"))
        offspring = made.join(cache, "sequence").withColumn("generation", F.lit(k))
        population = stage(survivors(population.drop("class").unionByName(offspring)), "population")
        out.append(population.withColumn("round", F.lit(k)))
    return reduce(DataFrame.unionByName, out).select("round", "pop", "family", "generation", "sequence", "fitness", "class")


def fitness_sql(s: str) -> str:
    """The fitness of a sequence as a SQL expression, the filter included."""
    n = {a: f"(length({s}) - length(replace({s}, '{a}', '')))" for a in S.ALPHABET}
    end = lambda x, table, other: "CASE " + " ".join(f"WHEN {x} = '{a}' THEN {v}" for a, v in table.items()) + f" ELSE {other} END"
    h = " + ".join(f"{n[a]} * {float(v)!r}::double" for a, v in S.EISENBERG.items())
    plus = " + ".join(f"{n[a]} * {1 / (1 + 10 ** (7.4 - pk))!r}::double" for a, pk in S.PK_POSITIVE.items())
    minus = " + ".join(f"{n[a]} * {1 / (1 + 10 ** (pk - 7.4))!r}::double" for a, pk in S.PK_NEGATIVE.items())
    first = f"1 / (1 + pow(10.0::double, 7.4 - ({end(f'left({s}, 1)', S.PK_N_TERM_OF, S.PK_N_TERM)})))"
    last = f"1 / (1 + pow(10.0::double, ({end(f'right({s}, 1)', S.PK_C_TERM_OF, S.PK_C_TERM)}) - 7.4))"
    able = f"{n['K']} + {n['R']} > {n['D']} + {n['E']}"
    return f"CASE WHEN {able} THEN round(({h}) / length({s}) - abs({plus} - ({minus}) + {first} - {last} - 3) / 10, 9) ELSE {FLOOR} END"


def survivors_sql(name: str, source: str) -> str:
    """CTEs by which {name} holds what survives of {source} (pop, family, sequence, generation, fitness)."""
    fit = "fitness DESC, sequence"
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY pop ORDER BY {fit}) AS rn, row_number() OVER (PARTITION BY pop, family ORDER BY {fit}) AS slot FROM {source}),
{name}_c AS (SELECT *, CASE WHEN rn <= {ELITES} THEN 0 WHEN slot <= {FAMILY_CAP} THEN 1 ELSE 2 END AS class FROM {name}_r),
{name} AS MATERIALIZED (SELECT pop, family, sequence, generation, fitness, class FROM (SELECT *, row_number() OVER (PARTITION BY pop ORDER BY class, {fit}) AS place FROM {name}_c) WHERE place <= {SIZE})"""


def generations_sql(start: str, rounds: int) -> str:
    """The CTEs of generations, unrolled; population k is p{k}. start: a relation of family and sequence."""
    out = [f"b AS (SELECT family % {POPULATIONS} AS pop, sequence, min(family) AS family FROM {start} GROUP BY ALL)", f"s0 AS (SELECT pop, family, sequence, 0 AS generation, {fitness_sql('sequence')} AS fitness FROM b)", survivors_sql("p0", "s0")]
    for k in range(1, rounds + 1):
        draw = lambda side: "least(" + ", ".join(f"(pop * 7919 + slot * 104729 + {side * DRAWS + d} * 1299709 + {k} * 15485863) % n" for d in range(DRAWS)) + ") + 1"  # noqa: B023, E731
        at = lambda c, j: f"(pop * 31 + slot * 17 + {j + k}) % greatest(length({c}.sequence) - 1, 1) + 1"  # noqa: B023, E731
        place, new = f"(pop + slot * 3 + a * 7 + {k}) % length(child)", f"substr('{S.ALPHABET}', (pop * 3 + slot + a + {k}) % 20 + 1, 1)"
        net = "length(sequence) - length(translate(sequence, 'KR', '')) > length(sequence) - length(translate(sequence, 'DE', ''))"
        out += [
            f"m{k} AS (SELECT pop, list(struct_pack(sequence := sequence, family := family) ORDER BY fitness DESC, sequence) AS ms, count(*) AS n FROM p{k - 1} GROUP BY pop)",
            f"l{k} AS (SELECT pop, ms, n, unnest(range({CHILDREN})) AS slot FROM m{k})",
            f"c{k} AS (SELECT pop, slot, ms[{draw(0)}] AS mother, ms[{draw(1)}] AS father FROM l{k})",
            f"x{k} AS (SELECT pop, slot, mother.family AS family, substr(mother.sequence, 1, {at('mother', 5)}) || substr(father.sequence, {at('father', 3)} + 1) AS child FROM c{k})",
            f"a{k} AS (SELECT pop, slot, family, a, {new} AS letter, CASE a % 3 WHEN 0 THEN substr(child, 1, {place}) || {new} || substr(child, {place} + 2) WHEN 1 THEN substr(child, 1, greatest(length(child) - 1, 1)) ELSE substr(child, length(child) - greatest(length(child) - 1, 1) + 1) END AS variant FROM x{k} CROSS JOIN (SELECT unnest(range({ATTEMPTS})) AS a))",
            f"t{k} AS (SELECT pop, slot, family, a, rpad(left(variant, {LONGEST}), cast(greatest({SHORTEST}, length(left(variant, {LONGEST}))) AS int), letter) AS sequence FROM a{k})",
            f"d{k} AS (SELECT pop, slot, family, arg_min(sequence, CASE WHEN {net} THEN a ELSE {2 * ATTEMPTS} - a END) AS sequence FROM t{k} GROUP BY ALL)",
            f"o{k} AS (SELECT pop, min(family) AS family, sequence, {k} AS generation, {fitness_sql('sequence')} AS fitness FROM d{k} WHERE (pop, sequence) NOT IN (SELECT (pop, sequence) FROM p{k - 1}) GROUP BY pop, sequence)",
            f"s{k} AS (SELECT pop, family, sequence, generation, fitness FROM p{k - 1} UNION ALL SELECT pop, family, sequence, generation, fitness FROM o{k})",
            survivors_sql(f"p{k}", f"s{k}"),
        ]
    return ",\n".join(out)


#: Residues of a window.
WIDTH = 12


def _windows(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's distinct windows the residues (a row each), the first place and how many there are. A window is a number of five bits
    a residue."""
    each = np.frombuffer(residues_of(text), np.uint8)
    n = max(0, len(each) - WIDTH + 1)
    word = np.zeros(n, np.int64)
    for k in range(WIDTH):
        word = word << 5 | (each[k : k + n] - 64)
    _, first, count = np.unique(word, return_index=True, return_counts=True)
    return each[first[:, None] + np.arange(WIDTH)], first, count


def window_runs(texts: DataFrame, key: str, counts: bool = False) -> DataFrame:
    """(key, sequence, first_at, n): each key's distinct windows; counts: (key, windows, distinct_windows). A text's windows combine where
    they are cut, and are not shuffled; only the windows of keys that several texts share meet again."""
    schema = f"{key} long, sequence string, first_at long, n long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in zip(batch.column(0), batch.column(1), strict=True):
                letters, first, count = _windows(text.as_py())
                for at in range(0, len(first), 65_536):
                    part = slice(at, at + 65_536)
                    n = len(first[part])
                    sequence = pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, WIDTH * (n + 1), WIDTH, dtype=np.int32)), pa.py_buffer(letters[part].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * n, pa.int64()), sequence, pa.array(first[part], pa.int64()), pa.array(count[part], pa.int64())], [key, "sequence", "first_at", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [(int(n.sum()), len(n)) for _, _, n in map(_windows, batch.column(1).to_pylist())]
            out = pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array([s[k] for s in sizes], pa.int64()) for k in (0, 1))], [key, "windows", "distinct_windows"])
            yield out.filter(pa.array([s[0] > 0 for s in sizes], pa.bool_()))

    several = texts.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(key).alias("_several"))
    same = F.col(key).eqNullSafe(F.col("_several"))
    rows = texts.select(key, "text")
    cores = texts.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores, key)
    once, shared = rows.join(several, same, "left_anti"), rows.join(several, same, "left_semi").mapInArrow(cut, schema)
    met = shared.groupBy(key, "sequence").agg(F.min("first_at").alias("first_at"), F.sum("n").alias("n"))
    if counts:
        met = met.groupBy(key).agg(F.sum("n").alias("windows"), F.count(F.lit(1)).alias("distinct_windows"))
        return once.mapInArrow(count, f"{key} long, windows long, distinct_windows long").unionByName(met)
    return once.mapInArrow(cut, schema).unionByName(met)


def decoys(winners: DataFrame, candidates: DataFrame) -> DataFrame:
    """id (of a winner), sequence: a candidate of the same length, chosen by a hash of its id; winners of one length take the
    candidates of that length in turn, from the first again when there are too few. As many candidates of a length as winners have
    it are kept by each task before they meet."""
    seats = winners.select("id", F.length("sequence").alias("n")).withColumn("k", F.row_number().over(Window.partitionBy("n").orderBy("id")))
    wanted = F.broadcast(seats.groupBy("n").agg(F.max("k").alias("seats")))
    pool = candidates.select(F.length("sequence").alias("n"), "sequence", F.expr("id % 1000003 * 7919 % 1000003").alias("h"), "id").join(wanted, "n")
    dealt = pool.withColumn("deal", F.pmod(F.hash("id"), F.lit(64)))
    first = dealt.withColumn("r", F.row_number().over(Window.partitionBy("n", "deal").orderBy("h", "id"))).where(F.col("r") <= F.col("seats"))
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy("n").orderBy("h", "id"))).where(F.col("k") <= F.col("seats"))
    many = F.broadcast(ranked.groupBy("n").agg(F.max("k").alias("many")))
    seat = seats.join(many, "n").withColumn("k", ((F.col("k") - 1) % F.col("many") + 1).cast("int")).drop("many")
    return seat.join(ranked.select("n", "k", "sequence"), ["n", "k"]).select("id", "sequence")
