"""Conversation repair against a shortest path over whole conversations."""

import collections
import hashlib
import heapq
import itertools
import re
import zlib

import duckdb
import pytest

from starledger.llm import queries, structure

from .test_operators import SF, SF_MODEL, odd

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def plain_cheapest(rows):
    """Dijkstra over (cost, audit): the least audit of the cheapest."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit
        new = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 5, audit + "I", i, new))
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last))
            if fault not in ("1", "2"):
                more = 5 if fault == "3" else 0
                if (last == "" and role in "su") or (last, role) in (("s", "u"), ("u", "a"), ("a", "u")):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role))
                heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, new))


def plain_faults(rows):
    seen, faults = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(SPACE)
        faults.append("1" if not end else "2" if (role, text) in seen else "3" if end[-1] not in ".!?" else "0")
        seen.add((role, text))
    return faults


def plain_repair(rows, audit):
    out, i, last = [], 0, ""
    for c in audit:
        new = "a" if last == "u" else "u"
        if c == "I":
            out.append(("user" if new == "u" else "assistant", ""))
            last = new
            continue
        role, text = rows[i][2:]
        i += 1
        if c == "K":
            last = role[0]
            out.append((role, text))
        elif c == "R":
            last = new
            out.append(("user" if new == "u" else "assistant", text))
    assert i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:32], hashlib.sha256(r[3].encode()).digest()))


def plain_report(rows):
    by = collections.defaultdict(list)
    for r in plain_damage(rows):
        by[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = ordered(by[conv])
        faults = plain_faults(mine)
        cost, audit = plain_cheapest([(r[2][:1] if r[2][:1] in ("s", "u", "a") else "-", f) for r, f in zip(mine, faults, strict=True)])
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        text = "\n".join(f"{r}:{t}" for r, t in plain_repair(mine, audit))
        out[conv] = (gaps, faults.count("1"), faults.count("2"), faults.count("3"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def reported(df):
    names = [c.split()[0] for c in structure.REPORT.split(", ")]
    rows = df.collect()
    out = {r.conv_id: tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("sf", [SF, SF_MODEL])
def test_stored_conversations(spark, sf):
    rows = duckdb.sql(f"select conv_id, turn, role, text from read_parquet('{sf}/conversations.parquet')").fetchall()
    assert reported(queries.op13_structure_repair(spark, sf)) == plain_report(rows)


def test_odd_conversations(spark):
    """Nulls everywhere, unknown and empty roles, repeated rows and turns, blank and very long texts."""
    long = "word " * 1_000_000
    rows = [(None, None, None, None), (None, 1, "user", "hi."), (1, None, "user", "a."), (1, None, "user", "a."), (1, 5, "assistant", "b!"), (1, 5, "", "c?"), (1, 5, "tool", "c?")]
    rows += [(2, t, "system" if t % 3 == 0 else "user", "same.") for t in range(40)] + [(3, t, "assistant", " \n") for t in range(9)] + [(4, 7, "user", long), (4, 8, "assistant", long + ".")]
    rows += [(5, 3, "user", f"tie {k}.") for k in range(5)] + [(5, 3, "assistant", "tie.")] * 3 + [(6, -(1 << 62), "user", "x."), (6, 1 << 62, "assistant", "y."), (7, -(1 << 63), "user", "x."), (7, (1 << 63) - 1, "assistant", "y.")]
    rows += [(c, t, "user" if t % 2 else "assistant", f"{c} {t}.") for c in range(100, 160) for t in range(c % 7)]
    lone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((lone, 0, "user", "only row, dropped."))
    df = odd(spark.createDataFrame(rows, SCHEMA))
    want = plain_report(rows)
    want[7] = (0, *want[7][1:])  # such gaps fit no long
    assert reported(structure.report(df)) == want
    assert want[lone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert structure.report(df.where("false")).count() == 0


def test_conversations_of_many_blocks(spark):
    """Blocks of three rows, dealt over many tasks, give the way that whole conversations give."""
    roles = ["system", "user", "assistant", "tool", "user", "assistant"]
    texts = ["fine.", "cut", "", "what?", "same."]
    rows = [(c, t, roles[zlib.crc32(f"r{c}.{t}".encode()) % 6], texts[zlib.crc32(f"t{c}.{t}".encode()) % 5] + (f" {t}." if t % 4 else "")) for c in range(12) for t in range(5 * c)]
    assert reported(structure.report(spark.createDataFrame(rows, SCHEMA).repartition(5), block_rows=3)) == plain_report(rows)


def test_search_by_brute_force():
    for n in range(5):
        for kinds in itertools.product(("s0", "u0", "a0", "u3", "a1", "-0"), repeat=n):
            assert structure.cheapest(list(kinds)) == plain_cheapest(list(kinds))


def test_one_conversation_of_all_rows(spark):
    """A conversation that is the whole table is cut into blocks and gives the same report."""
    rows = [(1, t, "user" if (t + t // 50) % 2 == 0 else "assistant", f"turn {t}.") for t in range(3000)]
    got = reported(structure.report(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain_report(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "q."), (1, 1, "user", "q2."), (1, 2, "assistant", "a."), (2, 0, "assistant", "lone."), (3, 0, "user", ""), (None, 4, "system", "s."), (None, 5, "user", "u."), (None, 6, "assistant", "a.")]
    got = collections.defaultdict(list)
    for r in sorted(structure.repaired(odd(spark.createDataFrame(rows, SCHEMA))).collect(), key=lambda r: r.position):
        got[r.conv_id].append((r.role, r.text))
    want = {}
    for conv in (1, 2, 3, None):
        mine = ordered([r for r in rows if r[0] == conv])
        audit = plain_cheapest([(r[2][:1], f) for r, f in zip(mine, plain_faults(mine), strict=True)])[1]
        want[conv] = plain_repair(mine, audit)
    assert got == {k: v for k, v in want.items() if v}
