"""Repair of conversation structure by a grammar-compressed dynamic programme.

Each row of a conversation becomes a symbol: its role's initial (u, a, s, other), in upper case if the text is truncated, or X for a
row that must go (blank or duplicate). Editing a symbol moves between the states of `(s?(ua)+)?` (0 start, 1 after s, 2 after u, 3
after a) at a cost, so a symbol is a min-plus matrix over states whose entries are a cost and the least audit of that cost. Re-Pair
replaces frequent pairs of symbols of many conversations by rules; a rule's matrix is the product of its two, worked out once, bottom
up, for all conversations that use it. Audits are ropes: pairs of audits, flattened where a tie needs them and at the end.

Two audits of one entry, exit and cost are never prefixes of each other (both spell the same rows, and more insertions cost more), so
the least audit of a product is made of least ones.

Rows are sorted by (conv_id, turn, role, text digest) in ranges, so a conversation of any size is cut into pieces of at most PIECE
rows in many tasks; pieces of conversations that one task did not see whole are joined by their cost matrices, one row a piece. Only
the digest of repaired texts, which is sequential by definition, streams a conversation through one task, a row at a time.

Nulls in role and text are one space (a role that needs another name or deletion; a blank text), also in the damage key; a null turn
comes first; rows of a null conv_id are one conversation. Equal turns are ordered by role, then by text digest. A role that is empty
or begins otherwise is illegal until renamed. Other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, small_batches, staged

RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a piece; symbols that one grammar spans, its most rules, and how often a pair must stand to become one.
PIECE, GRAMMAR_SYMBOLS, RULES, OFTEN = 4096, 1 << 16, 500, 8
SYMBOLS = "XuasoUASO"
#: The state after a user or assistant row is put at a state, and the insertions that end a conversation there.
TURN, TAIL = (2, 2, 3, 2), ("", "II", "I", "")
NEVER = 1 << 40

Rope = str | tuple
Matrix = list  # sixteen of (cost, rope), by entry * 4 + exit; NEVER: no way


def text_of(rope: Rope) -> str:
    """The letters of a rope."""
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if isinstance(r, str):
            out.append(r)
        else:
            todo += [r[1], r[0]]
    return "".join(out)


def _better(a: tuple, b: tuple) -> bool:
    return a[0] < b[0] or a[0] == b[0] < NEVER and text_of(a[1]) < text_of(b[1])


def product(a: Matrix, b: Matrix) -> Matrix:
    """The matrix (or its first row, if a is one) of a, then b."""
    out = []
    for q in range(0, len(a), 4):
        for m in range(4):
            best = (NEVER, "")
            for p in range(4):
                left, right = a[q + p], b[4 * p + m]
                cost = left[0] + right[0]
                if cost < NEVER and cost <= best[0]:
                    if cost < best[0] or _better((cost, (left[1], right[1])), best):
                        best = (cost, (left[1], right[1]))
            out.append(best)
    return out


def symbol_matrix(symbol: str) -> Matrix:
    """Insertions, then one edit of the row."""
    out: Matrix = [(NEVER, "")] * 16
    extra = TRUNCATED if symbol in "UASO" else 0
    for q in range(4):
        p, inserted = q, 0
        for inserted in range(3):
            ways = [(DELETE, "D", p)]
            if symbol != "X":
                ways.append((RENAME + extra, "R", TURN[p]))
                to = {"s": 1 if p == 0 else None, "u": 2 if p != 2 else None, "a": 3 if p == 2 else None}.get(symbol.lower())
                ways += [(extra, "K", to)] * (to is not None)
            for cost, letter, m in ways:
                found = (INSERT * inserted + cost, "I" * inserted + letter)
                if _better(found, out[4 * q + m]):
                    out[4 * q + m] = found
            p = TURN[p]
    return out


def grammar(texts: list[str]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Re-Pair over all texts: rules (pairs of earlier symbols; rule i is symbol len(SYMBOLS) + i) and the compressed texts."""
    code = np.full(128, -1, np.int64)
    code[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))
    flat = code[np.frombuffer("".join(t + "|" for t in texts).encode(), np.uint8)]
    rules: list[tuple[int, int]] = []
    while len(rules) < RULES:
        size = len(SYMBOLS) + len(rules)
        inside = (flat[:-1] >= 0) & (flat[1:] >= 0)
        pairs = np.where(inside, flat[:-1] * size + flat[1:], size * size)
        counts = np.bincount(pairs, minlength=size * size + 1)[:-1]
        top = int(counts.argmax())
        if counts[top] < OFTEN:
            break
        at = np.flatnonzero(pairs == top)
        if top % (size + 1) == 0:
            # A pair of one symbol: every other place of a run.
            runs = np.concatenate([[0], np.flatnonzero(np.diff(at) > 1) + 1])
            at = at[(np.arange(len(at)) - np.repeat(runs, np.diff(np.append(runs, len(at))))) % 2 == 0]
        flat[at] = size
        flat = np.delete(flat, at + 1)
        rules.append(divmod(top, size))
    ends = np.flatnonzero(flat < 0)
    return rules, [flat[a:b].tolist() for a, b in zip(np.concatenate([[0], ends[:-1] + 1]), ends)]


_LEAVES = [symbol_matrix(s) for s in SYMBOLS]


def solved(texts: list[str], whole: list[bool]) -> list[tuple]:
    """Of each text that is a whole conversation (cost, audit); of others its matrix, flattened."""
    known = {key: n for n, key in enumerate(dict.fromkeys(zip(texts, whole)))}
    rules, short = grammar([t for t, _ in known])
    matrices = list(_LEAVES)
    for x, y in rules:
        matrices.append(product(matrices[x], matrices[y]))
    results = []
    for (_, all_), symbols in zip(known, short):
        found = matrices[symbols[0]][: 4 if all_ else 16]
        for s in symbols[1:]:
            found = product(found, matrices[s])
        found = [(c, text_of(r)) for c, r in found]
        results.append(min((c + INSERT * len(t), a + t) for (c, a), t in zip(found, TAIL) if c < NEVER) if all_ else tuple(found))
    return [results[known[key]] for key in zip(texts, whole)]


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage by crc32 of `conv_id:turn` modulo 20; nulls in role and text are one space."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return rows.where(kind != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


_KEY = ["conv_id", "turn", "role", "digest"]


def _digested(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, initial, blank, truncated, again) of rows without null roles and texts; again: role and text stand
    at an earlier turn (equal rows of one turn are told apart where they are sorted)."""
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    first = F.substring("role", 1, 1)
    slim = _digested(rows.withColumns({"initial": F.when(first.isin("u", "a", "s"), first).otherwise("o"), "blank": bare == "", "truncated": ~F.substring(bare, -1, 1).isin(".", "!", "?")})).drop("text")
    slim = staged(slim, "symbols")
    seen = slim.groupBy("conv_id", "role", "digest").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.max(F.col("turn").isNull()).alias("none"))
    seen = seen.where((F.col("low") < F.col("high")) | F.col("none") & F.col("low").isNotNull()).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "low", "none")
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    again = F.when(F.col("none"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("low"))
    return slim.join(seen, on, "left").select(*_KEY, "initial", "blank", "truncated", F.coalesce(again, F.lit(False)).alias("again"))


_PIECE_SCHEMA = "conv_id long, turn long, role string, digest binary, part int, no long, whole boolean, symbols string, first string, last string, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long"
_PIECE_NAMES = [f.split()[0] for f in _PIECE_SCHEMA.split(", ")]
_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
_PIECE_ARROW = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in _PIECE_SCHEMA.split(", ")])


def _pieces(most: int):
    """From sorted rows: pieces of at most `most` rows of a conversation, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, out, piece, letters, before, opening = TaskContext.get().partitionId(), 0, [], None, [], None, True

        def close(last: bool) -> None:
            piece["symbols"], piece["last"] = "".join(letters), before[4]
            piece["whole"] = piece["whole"] and last
            out.append(piece)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "initial", "blank", "truncated", "again"))):
                conv, turn, role, digest, initial, blank, truncated, again = row
                same = before is not None and before[0] == conv
                if piece is None or not same or len(letters) >= most:
                    if piece is not None:
                        close(not same)
                        no += 1
                    # A piece is whole if its conversation begins with it, after another one's row, and ends with it, before another's.
                    piece = dict.fromkeys(_PIECE_NAMES, 0) | {"conv_id": conv, "turn": turn, "role": role, "digest": digest, "part": part, "no": no, "whole": not same and not opening, "first": initial, "low": None, "high": None}
                    letters, fresh = [], True
                opening = False
                twin = same and before[:4] == row[:4]
                fault = "blank" if blank else "duplicate" if again or twin else "truncated" if truncated else None
                if fault:
                    piece[fault] += 1
                letters.append("X" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
                if not fresh and before[4] + initial not in ("su", "ua", "au"):
                    piece["illegal"] += 1
                if turn is not None and turn != piece["high"]:
                    piece["low"], piece["high"] = turn if piece["low"] is None else piece["low"], turn
                    piece["turns"] += 1
                fresh, before = False, row
            if len(out) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(out, _PIECE_ARROW)
                out = []
        if piece is not None:
            close(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, _PIECE_ARROW)

    return run


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, whole = batch.column("symbols").to_pylist(), batch.column("whole").to_pylist()
        at = 0
        while at < len(texts):
            end, total = at, 0
            while end < len(texts) and (end == at or total + len(texts[end]) <= GRAMMAR_SYMBOLS):
                total += len(texts[end])
                end += 1
            found = solved(texts[at:end], whole[at:end])
            part = batch.slice(at, end - at).drop_columns(["symbols"])
            costs, ranks, audits = [], [], []
            for all_, f in zip(whole[at:end], found):
                entries = () if all_ else f
                costs.append([c for c, _ in entries])
                audits.append([a for _, a in entries])
                # How the audits of one entry are ordered.
                ranks.append([sorted(a for _, a in entries[q - q % 4 : q - q % 4 + 4]).index(entries[q][1]) for q in range(len(entries))])
            more = {"cost": pa.array([f[0] if all_ else None for all_, f in zip(whole[at:end], found)], pa.int64()), "audit": pa.array([f[1] if all_ else None for all_, f in zip(whole[at:end], found)], pa.string()), "costs": pa.array(costs, pa.list_(pa.int64())), "ranks": pa.array(ranks, pa.list_(pa.int32())), "audits": pa.array(audits, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([*part.columns, *more.values()], names=[*part.schema.names, *more])
            at = end


_SOLVED_SCHEMA = _PIECE_SCHEMA.replace("symbols string, ", "") + ", cost long, audit string, costs array<long>, ranks array<int>, audits array<string>"


def _threaded(pieces: pa.Table) -> pa.Table:
    """The way through all pieces of one conversation: of each the entry and exit, its final insertions, and what its border adds."""
    rows = sorted(pieces.to_pylist(), key=lambda r: (r["part"], r["no"]))
    ahead = [[INSERT * len(t) for t in TAIL]]
    for r in reversed(rows):
        ahead.append([min(r["costs"][4 * q + m] + ahead[-1][m] for m in range(4)) for q in range(4)])
    ahead.reverse()
    out, q, before, high = [], 0, None, None
    for r, after in zip(rows, ahead[1:]):
        exit_ = min(range(4), key=lambda m: (r["costs"][4 * q + m] + after[m], r["ranks"][4 * q + m]))
        border = before is not None and before["last"] + r["first"] not in ("su", "ua", "au")
        out.append({"conv_id": r["conv_id"], "part": r["part"], "no": r["no"], "pick": 4 * q + exit_, "tail": TAIL[exit_] if len(out) == len(rows) - 1 else "", "border": int(border), "joint": int(high is not None and high == r["low"])})
        q, before, high = exit_, r, high if r["high"] is None else r["high"]
    return pa.Table.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("no", pa.int64()), ("pick", pa.int32()), ("tail", pa.string()), ("border", pa.int32()), ("joint", pa.int32())]))


def audited(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """The pieces of all conversations (rows without null roles and texts) with audit, cost and counts; the key of a piece is its first row's."""
    small_batches(rows.sparkSession)
    ordered = symbols(rows).repartitionByRange(*_KEY).sortWithinPartitions(*_KEY)
    pieces = staged(ordered.mapInArrow(_pieces(piece), _PIECE_SCHEMA), "pieces")
    done = staged(pieces.mapInArrow(_solve, _SOLVED_SCHEMA), "solved")
    cut = done.where("not whole")
    ways = cut.select("conv_id", "part", "no", "first", "last", "low", "high", "costs", "ranks").groupBy("conv_id").applyInArrow(_threaded, "conv_id long, part int, no long, pick int, tail string, border int, joint int").drop("conv_id")
    joined = cut.join(ways, ["part", "no"])
    columns = ["conv_id", "turn", "role", "digest", "part", "no", "blank", "duplicate", "truncated", "low", "high"]
    joined = joined.select(
        *columns, (F.col("illegal") + F.col("border")).alias("illegal"), (F.col("turns") - F.col("joint")).alias("turns"),
        (F.expr("costs[pick]") + INSERT * F.length("tail")).alias("cost"), F.concat(F.expr("audits[pick]"), "tail").alias("audit"),
    )
    return staged(done.where("whole").select(*columns, "illegal", "turns", "cost", "audit").unionByName(joined), "audited")


def _stream(rows_out: bool):
    """Reads sorted pieces and rows; gives the repaired rows, or a digest of each conversation's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, letters, state, place, sha, out = None, False, iter(()), 0, 0, None, []
        queue: list[str] = []

        def put(role: str, text: str) -> None:
            nonlocal place, state
            if rows_out:
                out.append((conv, place, role, text))
            else:
                sha.update(("\n" * (place > 0) + f"{role}:{text}").encode())
            state, place = {"u": 2, "a": 3}.get(role[:1], 1), place + 1

        def insert() -> None:
            put("assistant" if state == 2 else "user", "")

        def letter() -> str | None:
            nonlocal letters
            for x in letters:
                return x
            while queue:
                letters = iter(queue.pop(0))
                for x in letters:
                    return x
            return None

        def finish() -> None:
            while letter() is not None:
                insert()
            if not rows_out:
                out.append((conv, sha.hexdigest()))

        def given() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] if rows_out else [pa.int64(), pa.string()]
            columns = list(zip(*out))
            out.clear()
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "place", "role", "text"] if rows_out else ["conv_id", "repaired_sha256"])

        for batch in batches:
            for id_, role, audit, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "audit", "text"))):
                if not begun or id_ != conv:
                    if begun:
                        finish()
                    conv, begun, letters, state, place, sha = id_, True, iter(()), 0, 0, hashlib.sha256()
                    queue.clear()
                if audit is not None:
                    queue.append(audit)
                    continue
                while (x := letter()) == "I":
                    insert()
                if x == "K":
                    put(role, text)
                elif x == "R":
                    put("assistant" if state == 2 else "user", text)
            if out:
                yield given()
        if begun:
            finish()
        if out:
            yield given()

    return run


def _merged(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows, each piece's audit before the piece's first row."""
    none = F.lit(None).cast("string")
    texts = _digested(rows).select(*_KEY, F.lit(1).alias("kind"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("no"), none.alias("audit"), "text")
    pieces = audits.select(*_KEY, F.lit(0).alias("kind"), "part", "no", "audit", none.alias("text"))
    order: list[str | Column] = [*_KEY, "kind", "part", "no"]
    return texts.unionByName(pieces).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "audit", "text")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations."""
    return _merged(rows, audits).mapInArrow(_stream(True), "conv_id long, place long, role string, text string")


def digests(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """Every conv_id with its faults after damage, the cheapest repair and a digest of the repaired rows."""
    rows = damaged(conversations)
    audits = audited(rows, piece)
    sums = {c: F.sum(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")}
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("part", "no", "audit"))), lambda x: x["audit"])
    each = audits.groupBy("conv_id").agg(gaps.alias("gaps"), *(v.alias(k) for k, v in sums.items()), F.array_join(in_order, "").alias("audit"))
    hashes = _merged(rows, audits).mapInArrow(_stream(False), "conv_id long, repaired_sha256 string")
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = ids.join(each, ids.id.eqNullSafe(each.conv_id), "left").drop("conv_id")
    out = out.join(hashes, out.id.eqNullSafe(hashes.conv_id), "left")
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
