"""Clustering, SimHash groups and conversation repair against plain Python versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pactline.llm import clustering, queries, simhash, turn_repair
from pactline.llm.common import attached
from tests.llm.conftest import rows


def clashing(df, *names):
    for name in names:
        df = df.withColumn(name, F.lit("x"))
    return df


# 11 -------------------------------------------------------------------------------------------


def lloyd(vectors: list[tuple], rules: clustering.ClusterRules):
    """Every vector against every centroid, in Python integers."""
    kept = [(i, [int(np.floor(rules.scale * float(x))) for x in v]) for i, v in vectors
            if v is not None and len(v) == rules.components
            and all(x is not None and np.isfinite(x) for x in v)]

    def order(row):
        known = row[0] is not None
        return not known, hashlib.sha256(f"{rules.seed}:{row[0]}".encode()).hexdigest() if known else "", row[1]

    at = [v for _, v in sorted(kept, key=order)[:rules.clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))

    for _ in range(rules.rounds):
        mine = [nearest(v)[1] for _, v in kept]
        at = [[sum(x) // n for x in zip(*own)] if (n := len(own := [v for (_, v), m in zip(kept, mine) if m == j]))
              else c for j, c in enumerate(at)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, m in found if m == j) for j in range(len(at))}
    return sorted(((i, j, d, inertia[j], sum(inertia.values()),
                    hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, d, j in found), key=str)


def clustered(spark, vectors, rules):
    df = clashing(spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3),
                  "vector", "cluster", "second", "numbers")
    return sorted(map(tuple, clustering.cluster_vectors(df, rules).collect()), key=str)


def test_clusters_equal_those_of_comparing_all(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 6))
    made = [(i, [float(np.float32(x)) for x in middle[i % 12] + rng.normal(scale=0.4, size=6)]) for i in range(400)]
    hot = [(1000 + i, made[7][1]) for i in range(200)]  # a third of all rows, all alike
    odd = [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0, None] * 3), (2004, [float("nan")] * 6),
           (2005, [float("inf")] * 6), (None, [0.5] * 6), (1, made[1][1]), (1, made[2][1])]
    for clusters, rounds in ((11, 6), (1, 2)):
        rules = clustering.ClusterRules(components=6, clusters=clusters, rounds=rounds)
        assert clustered(spark, made + hot + odd, rules) == lloyd(made + hot + odd, rules)


def test_ties_and_few_vectors(spark):
    # A grid of small numbers: many vectors lie between centroids, several centroids are alike.
    grid = [(i, [x / 1024, y / 1024]) for i, (x, y) in enumerate(itertools.product(range(6), repeat=2))]
    for vectors, clusters in ((grid + grid, 9), (grid[:3], 8), ([(1, [0.0, 0.0])] * 5, 3)):
        rules = clustering.ClusterRules(components=2, clusters=clusters, rounds=3)
        assert clustered(spark, vectors, rules) == lloyd(vectors, rules)
    assert clustered(spark, [], clustering.ClusterRules()) == []
    with pytest.raises(Exception, match="a component is not below"):
        clustered(spark, [(1, [1e30, 0.0])], clustering.ClusterRules(components=2))


# 12 -------------------------------------------------------------------------------------------


def plain_fingerprint(text: str | None) -> int:
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = (text or "").translate(table).encode().split()
    some = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    values = [xxhash.xxh64(s, seed=42).intdigest() for s in some]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_groups(found: list[tuple]) -> list[tuple]:
    """All pairs of rows; rows are nodes, so a repeated doc_id links nothing."""
    head = list(range(len(found)))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, j in itertools.combinations(range(len(found)), 2):
        if (found[i][1] ^ found[j][1]).bit_count() <= 2:
            head[root(i)] = root(j)
    ids = {}
    for i, (doc, _) in enumerate(found):
        ids.setdefault(root(i), []).append(doc)
    least = {r: min((d for d in group if d is not None), default=None) for r, group in ids.items()}
    return sorted(((d, f"{fp:016x}", least[root(i)]) for i, (d, fp) in enumerate(found)), key=str)


def test_groups_equal_those_of_all_pairs(spark, docs):
    got = sorted(map(tuple, simhash.simhash_groups(docs).collect()), key=str)
    assert got == plain_groups([(r[0], plain_fingerprint(r[1])) for r in rows()])


def test_links_lose_no_pair_and_have_no_hot_group(spark):
    rng = random.Random(8)
    values = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(40):  # chains and clouds around common fingerprints, and strangers
        value = rng.getrandbits(64)
        for _ in range(25):
            values.add(value)
            for bit in rng.sample(range(64), rng.choice((1, 1, 2, 3, 4))):
                value ^= 1 << bit
    values |= {7 ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)}  # 2,016 of them share a key
    fps = sorted(values)
    df = spark.createDataFrame([(simhash._signed(v),) for v in fps], "fp long").repartition(4)
    found = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    assert len(found) < 65 * len(fps)
    head = {v: v for v in fps}

    def root(v):
        while head[v] != v:
            head[v] = head[head[v]]
            v = head[v]
        return v

    for a, b in found:
        head[root(a)] = root(b)
    array = np.array(fps, np.uint64)
    for v in fps:
        near = array[np.bitwise_count(array ^ np.uint64(v)) <= 2]
        assert {root(int(x)) for x in near} == {root(v)}


def test_every_pair_within_the_radius_shares_a_mask():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        for n in range(1, radius + 1):
            bits = itertools.combinations(range(64 if radius < 3 else 20), n)
            assert all(any(not m >> i & 1 for m in masks) if n == 1 else
                       any(all(not m >> i & 1 for i in some) for m in masks) for some in bits for i in some[:1])


def test_long_and_empty_texts(spark, empty):
    long = " ".join(f"w{i * i % 977}" for i in range(simhash._HELD + 5_000))
    assert simhash.fingerprint(long.encode()) == plain_fingerprint(long)
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n\x0b") == 0
    assert simhash.fingerprint("A B".encode()) == plain_fingerprint("a b")
    assert simhash.simhash_groups(empty).collect() == []


def test_attached_deals_a_frequent_key_over_all_parts(spark):
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    facts = spark.range(4000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN id ELSE 1 END AS k")
    lookup = spark.createDataFrame([(1, "a"), (20, "b")], "k long, name string")
    assert {(r.k, r.name) for r in attached(facts, lookup, ["k"], ["id"]).collect()} == {(1, "a"), (20, "b")}
    left = attached(facts, lookup, ["k"], ["id"], "left")
    assert left.count() == 4000 and left.where("name IS NULL").count() == 399
    assert number > 1 and "_part" not in left.columns


# 13 -------------------------------------------------------------------------------------------

COSTS = turn_repair.EditCosts()


def chart(codes: str, grammar: turn_repair.RepairGrammar):
    """The CYK chart over all splits of all spans."""
    cells = {(i, i + 1): grammar.known[c] for i, c in enumerate(codes)}
    for length in range(2, len(codes) + 1):
        for i in range(len(codes) - length + 1):
            best = {}
            for k in range(i + 1, i + length):
                for key, found in turn_repair.joined(cells[i, k], cells[k, i + length]).items():
                    turn_repair._least(best, key, found)
            cells[i, i + length] = best
    return cells[0, len(codes)]


def enumerated(codes: str):
    """The best of all repairs with up to two insertions in front of each turn and at the end."""
    best = None

    def legal(roles):
        body = roles[1:] if roles[:1] == "s" else roles
        return len(body) % 2 == 0 and all(r == "ua"[i % 2] for i, r in enumerate(body)) and (
            bool(body) or not roles)

    def go(i, roles, cost, audit):
        nonlocal best
        for inserted in ("", "u", "a", "ua", "au"):
            now, more, edits = roles + inserted, cost + 5 * len(inserted), audit + "I" * len(inserted)
            if i == len(codes):
                if legal(now) and (best is None or (more, edits) < best):
                    best = (more, edits)
                continue
            code, extra = codes[i], 5 if codes[i].isupper() else 0
            go(i + 1, now, more + 2, edits + "D")
            if code != "x":
                if code.lower() != "o":
                    go(i + 1, now + code.lower(), more + extra, edits + "K")
                for role in "ua":
                    go(i + 1, now + role, more + extra + 1, edits + "R")

    go(0, "", 0, "")
    return best


def test_cells_equal_the_whole_chart_and_all_repairs():
    rng = random.Random(4)
    grammar = turn_repair.RepairGrammar(COSTS)
    for _ in range(150):
        codes = "".join(rng.choice("suaoSUAOxuaua") for _ in range(rng.randint(1, 12)))
        assert grammar.cells(codes) == chart(codes, grammar)
    for codes in ("s", "a", "u", "x", "sa", "UA", "uu", "aS", "soa", "uxa", "AsU"):
        cells = grammar.cells(codes)
        assert min(cells[0, q] for q in (0, 3) if (0, q) in cells) == enumerated(codes)


def plain_repair(turns: list[tuple], costs=COSTS) -> dict:
    """conv_id to (gaps, blank, duplicate, truncated, illegal, cost, audit, hash), turn by turn: the
    cheapest way through states, without spans."""
    out = {}
    for conv in {t[0] for t in turns}:
        mine = sorted(((t[1], " " if t[2] is None else t[2], " " if t[3] is None else t[3])
                       for t in turns if t[0] == conv),
                      key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in mine:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else
                          "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
        moves = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

        def inserted(ways):
            for _ in range(3):
                for p, (c, a, r) in list(ways.items()):
                    for role in "ua":
                        if p in moves[role]:
                            found = (c + costs.insert, a + "I", r + [("user" if role == "u" else "assistant", "")])
                            q = moves[role][p]
                            ways[q] = min(ways.get(q, found), found, key=lambda x: x[:2])
            return ways

        ways = inserted({0: (0, "", [])})
        for (_, role, text), fault in zip(mine, faults):
            after = {}
            for p, (c, a, r) in ways.items():
                found = [(p, (c + costs.delete, a + "D", r))]
                if fault not in ("blank", "duplicate"):
                    more = c + (costs.truncated if fault else 0)
                    if p in moves.get(role[:1], {}):
                        found.append((moves[role[0]][p], (more, a + "K", r + [(role, text)])))
                    for new in "ua":
                        if p in moves[new]:
                            found.append((moves[new][p], (more + costs.rerole, a + "R", r + [
                                ("user" if new == "u" else "assistant", text)])))
                for q, way in found:
                    after[q] = min(after.get(q, way), way, key=lambda x: x[:2])
            ways = inserted(after)
        cost, audit, kept = min((ways[q] for q in (0, 3) if q in ways), key=lambda x: x[:2])
        numbers = [t[0] for t in mine if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        firsts = [t[1][:1] for t in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
        text = "\n".join(f"{role}:{text}" for role, text in kept)
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


def turn_rows() -> list[tuple]:
    rng = random.Random(6)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "What? ", "cut off", "", " \n", None, "Ünï.\x0b", "a", "Well.", "x" * 5000 + "."]
    out = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 9))]
    out += [(100, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(300)]  # the hot one
    out += [(101, 1, "user", "the same again.")] * 90
    out += [(102, None, "user", "no number."), (102, 3, "assistant", "three."), (102, None, "user", "no number."),
            (102, 9, "user", "no number."), (None, 1, "user", "no name."), (None, None, "assistant", "none.")]
    return out


TURNS = "conv_id long, turn long, role string, text string"


def repaired(spark, turns, costs=COSTS) -> dict:
    df = clashing(spark.createDataFrame(turns, TURNS).repartition(5), "segment", "fault", "copy", "cells", "conv")
    conversations, edits = turn_repair.repair_conversations(df, costs)
    digests = {r[0]: r[1] for r in turn_repair.repaired_digests(edits).collect()}
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit,
                        digests.get(r.conv_id, hashlib.sha256(b"").hexdigest())) for r in conversations.collect()}


@pytest.mark.parametrize("segment", [512, 3])
def test_repairs_equal_the_cheapest_way_turn_by_turn(spark, segment):
    costs = turn_repair.EditCosts(segment=segment)
    assert repaired(spark, turn_rows(), costs) == plain_repair(turn_rows())


def test_edits_say_what_became_of_each_turn(spark):
    turns = [(1, 0, "assistant", "Hello."), (1, 1, "user", ""), (1, 2, "user", "So?"), (1, 3, "assistant", "Yes.")]
    _, edits = turn_repair.repair_conversations(spark.createDataFrame(turns, TURNS))
    got = [(r.edit, r.turn, r.role, r.text) for r in edits.orderBy("conv_id", "segment", "place").collect()]
    assert got == [("D", 0, "assistant", None), ("D", 1, "user", None), ("K", 2, "user", "So?"),
                   ("K", 3, "assistant", "Yes.")]


def plain_damage(turns: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in turns:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code, role, text = zlib.crc32(key.encode()) % 20, role or (" " if role is None else ""), " " if text is None else text
        if code == 1:
            text = ""
        if code == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        out += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def test_query_damages_and_repairs_all_conversations(spark, tmp_path):
    lost = next(c for c in range(9000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    turns = turn_rows() + [(lost, 0, "user", "Gone.")]
    assert sorted(plain_damage(turns), key=str) == sorted(
        (tuple(r) for r in turn_repair.damaged(spark.createDataFrame(turns, TURNS)).collect()), key=str)
    spark.createDataFrame(turns, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in queries.op13_turn_repair(spark, str(tmp_path)).collect()}
    expected = plain_repair(plain_damage(turns))
    assert lost not in expected
    for gone in {t[0] for t in turns} - set(expected):
        expected[gone] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == expected


def test_no_conversations(spark):
    conversations, edits = turn_repair.repair_conversations(spark.createDataFrame([], TURNS))
    assert conversations.collect() == edits.collect() == []
