"""Importance draws, repeated spans and conversation repair against brute force, and on awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

pytest.importorskip("peptrellis.llm")
from peptrellis.llm import importance, repair, substrings  # noqa: E402

EXTRA = "doc_id long, text string, bucket string, edge string, row string, weight string, n string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in rows], EXTRA).repartition(3)


# Importance draws


def features(text, lengths):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(ws), [" ".join(ws[i : i + m]) for m in range(1, lengths + 1) for i in range(len(ws) - m + 1)]


def draw(docs, target, lengths, buckets, percent=10, least=20):
    b = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(b(f) for _, t in docs for f in features(t, lengths)[1])
    t = collections.Counter(b(f) for _, x in target for f in features(x, lengths)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        n, fs = features(text, lengths)
        gain = [math.floor(1000 * math.log((t[b(f)] + 1) * (big_s + buckets) / ((s[b(f)] + 1) * (big_t + buckets)))) for f in fs]
        weight = math.floor(sum(gain) / len(fs)) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for place, r in enumerate(able):
        r.append(place + 1 if place < len(able) * percent // 100 else None)
    return sorted((tuple(r[:4]) + (r[5] if len(r) > 5 else None,) for r in out), key=repr)


@pytest.mark.parametrize("lengths", [1, 3])
def test_draw_equals_brute_force(spark, lengths):
    rng = random.Random(lengths)
    words = [f"w{k}" for k in range(300)] + ["Été", "naïve", "x-y", "A1b", "ı", " ", "\x00z"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 19, 20, 60])))) for i in range(120)]
    docs += [(7, docs[3][1]), (7, docs[3][1]), (None, "one Two " * 30), (500, None), (501, ""), (502, "Long word " * 120_000), (-4, "x" * 1_200_000 + " " + " ".join(words))]
    target = [(i, " ".join(rng.choices(words[:40], k=50))) for i in range(10)] + [(99, None)]
    found = importance.resampled(table(spark, docs), table(spark, target), lengths=lengths, buckets=500)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=repr) == draw(docs, target, lengths, 500)


def test_slices_end_between_words():
    text = "ab Cd,é f" * 50 + "z" * 40 + " q"
    for most in (1, 2, 7, 1000):
        assert [w for ws in importance.word_lists(text.encode(), most) for w in ws] == text.lower().replace(",", " ").encode().split()


def test_draws_of_empty_tables(spark):
    none, some = table(spark, []), table(spark, [(1, "a b " * 20), (2, "c")])
    assert importance.resampled(none, some).collect() == []
    assert {r.doc_id: (r.n_features, r.rank) for r in importance.resampled(some, none, percent=100).collect()} == {1: (40, 1), 2: (1, None)}


# Repeated spans


def removed(docs, window=50):
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, ws in words:
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, ws in words:
        gone = set()
        for k in range(len(ws) - window + 1):
            if i is not None and first[tuple(ws[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(ws), len(gone), hashlib.sha256(" ".join(w for p, w in enumerate(ws) if p not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def passages(rng):
    """Texts with shared passages, edited copies, exact copies under other white space, repeats inside a text and few distinct words."""
    some = lambda n, size=5000: [f"w{rng.randrange(size)}" for _ in range(n)]
    shared, docs = [some(rng.choice([49, 50, 51, 60, 90, 200])) for _ in range(12)], []
    for i in range(160):
        ws = []
        for _ in range(rng.choice([1, 2, 4])):
            ws += some(rng.choice([0, 5, 80])) + rng.choice([[], rng.choice(shared), rng.choice(shared)[3:-2]])
        if i % 4 == 0 and docs:
            ws = list(rng.choice(docs)[1])
            for _ in range(rng.choice([0, 1, 3])):
                if ws:
                    ws[rng.randrange(len(ws))] = "edit"
        if i % 9 == 0:
            ws = rng.choice([["a"] * 70, ["a", "b"] * 60, some(60, 3), some(55) * 3])
        docs.append((i * 3 % 160, ws))
    return [(i, rng.choice([" ", "\n", " \t "]).join(ws)) for i, ws in docs]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = passages(rng)
    docs += [docs[5], docs[5], (docs[5][0], docs[8][1]), (None, docs[10][1]), (900, None), (901, " \n"), (902, docs[10][1] + " é x " + docs[11][1]), (-7, docs[20][1]), (903, "ab" * 700_000 + " " + docs[12][1])]
    found = substrings.digests(table(spark, docs))
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == removed(docs)


def test_spans_with_many_ties_and_small_windows(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices("ab", k=rng.choice([3, 12, 40])))) for i in range(60)]
    assert sorted(map(tuple, substrings.digests(table(spark, docs), window=8, k=3).collect()), key=repr) == removed(docs, 8)


def test_spans_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", 0)
    docs = passages(random.Random(4))
    assert sorted(map(tuple, substrings.digests(table(spark, docs)).collect()), key=repr) == removed(docs)


def test_spans_of_an_empty_table(spark):
    assert substrings.digests(table(spark, [])).collect() == []


def test_words_of_equal_polynomials_are_told_apart(spark):
    from peptrellis.llm.common import hash_words

    a = b = "a"
    for _ in range(11):
        a, b = a + a.translate({97: 98, 98: 97}), b
    twin = a.translate({97: 98, 98: 97})
    assert len(set(hash_words([a, twin]).tolist())) == 2


# Conversation repair


def edits(rows):
    """(cost, audit) of the cheapest repair of [(role, fault)], by a plain programme over rows and states."""
    turn, never = {0: 2, 1: 2, 2: 3, 3: 2}, (10**9, "")

    def inserted(best):
        for _ in range(4):
            for q in range(4):
                best[turn[q]] = min(best[turn[q]], (best[q][0] + 5, best[q][1] + "I"))
        return best

    best = inserted([(0, ""), never, never, never])
    for role, fault in rows:
        after = [never] * 4
        for q in range(4):
            c, a = best[q]
            after[q] = min(after[q], (c + 2, a + "D"))
            if fault not in ("blank", "duplicate"):
                c += 5 * (fault == "truncated")
                after[turn[q]] = min(after[turn[q]], (c + 1, a + "R"))
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], q))
                if to is not None:
                    after[to] = min(after[to], (c, a + "K"))
        best = inserted(after)
    return min(best[0], best[3])


def repairs(rows):
    out = []
    for conv in {r[0] for r in rows}:
        kept, none = [], lambda x: " " if x is None else x
        for c, turn, role, text in rows:
            if c != conv:
                continue
            kind, role, text = zlib.crc32(f"{none(c)}:{none(turn)}".encode()) % 20, none(role), none(text)
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in kept:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit = edits([(r, f) for (_, r, _), f in zip(kept, faults)])
        lines, state, at = [], None, 0
        for x in audit:
            new = "assistant" if lines and state == "u" else "user"
            if x == "I":
                lines.append(f"{new}:")
            else:
                role, text = kept[at][1:]
                at += 1
                if x == "D":
                    continue
                new = role if x == "K" else new
                lines.append(f"{new}:{text}")
            state = new[0]
        turns = [t for t, _, _ in kept if t is not None]
        initials = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        n = collections.Counter(faults)
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def talk(rng, n):
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.choice([0, 1, 2, 5, 9, 30])):
            role = rng.choice(["user", "assistant", "user" if turn % 2 == 0 else "assistant", "system", "tool", "unknown", "", None])
            text = rng.choice(["Hello there.", "so it goes", "  ", None, "Why?\n", f"Well {rng.random()}!", f"Fine {rng.random()}.", "é" * 9, "x" * 300_000 + "." if rng.random() < 0.01 else "Done."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None, -turn]), role, text))
    return rows


@pytest.mark.parametrize("piece", [1, 3, 4096])
def test_repairs_equal_brute_force(spark, piece):
    rows = talk(random.Random(piece), 60)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "conv_id long, turn long, role string, text string, digest string, kind string, again string").repartition(5)
    found = repair.digests(df, piece)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == repairs(rows)


def test_repaired_rows_are_legal(spark):
    rows = spark.createDataFrame(talk(random.Random(5), 40), "conv_id long, turn long, role string, text string")
    rows = repair.damaged(rows)
    found = collections.defaultdict(list)
    for r in repair.repaired(rows, repair.audited(rows, 7)).collect():
        found[r.conv_id].append((r.place, r.role))
    assert found
    for lines in found.values():
        assert [p for p, _ in sorted(lines)] == list(range(len(lines)))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role in sorted(lines)))


def test_rules_are_shared_and_change_nothing():
    rng = random.Random(1)
    texts = ["ua" * rng.randrange(1, 40) + rng.choice(["", "X", "suA", "oUXX"]) for _ in range(200)] + ["u" * 300, "X" * 77]
    rules, short = repair.grammar(texts)
    assert rules and sum(map(len, short)) < sum(map(len, texts)) / 4

    def spelt(s):
        return repair.SYMBOLS[s] if s < len(repair.SYMBOLS) else "".join(map(spelt, rules[s - len(repair.SYMBOLS)]))

    assert ["".join(map(spelt, s)) for s in short] == texts
    role, fault = dict(zip("uaso", ["user", "assistant", "system", "other"])), lambda x: "blank" if x == "X" else "truncated" if x.isupper() else None
    for text, found in zip(texts, repair.solved(texts, [True] * len(texts))):
        assert found == edits([(role.get(x.lower(), "user"), fault(x)) for x in text])


def test_repair_of_an_empty_table(spark):
    assert repair.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
