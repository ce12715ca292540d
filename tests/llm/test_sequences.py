"""Conversation repair, substring removal and periodic runs against plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from graphloom.llm import alignment as al
from graphloom.llm import repair, runs, substrings

SPACE = r"[^\x20\x09-\x0D]+"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# periodic runs


def all_runs(w):
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(6, 4 * q) and not any((a, b) == (start, i + q) for a, b, _ in out):
                out.add((start, i + q, q))
            i += i == start
    return sorted((a, b - a, q) for a, b, q in out)


def periodic(r, most):
    w = []
    while len(w) < most:
        w += [str(r.randint(0, 2)) for _ in range(r.randint(1, 9))] * r.randint(1, 7) if r.random() < 0.5 else [str(r.randint(0, 5)) for _ in range(r.randint(1, 12))]
    return w


def test_transform_is_exact():
    r = np.random.default_rng(5)
    for size in (1, 2, 8, 64):
        blocks, windows = r.integers(0, 4, (30, size)).astype(np.uint64), r.integers(0, 4, (30, 2 * size - 1)).astype(np.uint64)
        want = [[int(((b.astype(int) - w[t : t + size].astype(int)) ** 2).sum()) for t in range(size)] for b, w in zip(blocks, windows, strict=True)]
        assert runs.mismatches(blocks, windows).tolist() == want


def test_runs_of_many_texts_match_brute_force():
    r = random.Random(1)
    for _ in range(150):
        texts = [periodic(r, r.randint(0, 120)) for _ in range(3)]
        words = np.array([int(x) for t in texts for x in t], dtype=np.uint64)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        found = list(zip(*(x.tolist() for x in runs.find_runs(words, bounds)), strict=True))
        assert [[f[1:] for f in found if f[0] == k] for k in range(3)] == [all_runs(t) for t in texts]


def test_long_periods_and_one_word_texts():
    w = np.random.default_rng(0).integers(0, 3000, 60_000).astype(np.uint64)
    w[20_000:] = w[20_000 + np.arange(40_000) % 3500]
    assert [x.tolist() for x in runs.find_runs(w, np.array([0, len(w)]))] == [[0], [20_000], [40_000], [3500]]
    same = np.full(50_000, 7, dtype=np.uint64)
    assert [x.tolist() for x in runs.find_runs(same, np.array([0, 5, len(same)]))] == [[1], [0], [49_995], [1]]


def judged(doc_id, text):
    w = re.findall(SPACE, text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [*w[:a], *(w[a + (i - a) % p] for i in range(a, n))]
    found = all_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda f: (-f[1], f[0], f[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_judged_runs(spark):
    r = random.Random(8)
    rows = [(i, "\t ".join(periodic(r, r.randint(0, 60)))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, " \n"), (None, "a a a a a a a"), (93, "A a A a A a A a"), (93, "A a A a A a A a"), (94, "long " * 30_000), (95, "É é É é É é É é")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, period string").repartition(3)
    got = sorted(map(tuple, runs.judge_runs(docs, plant=True).collect()), key=str)
    short = [(i, t) for i, t in rows if i != 94]
    assert [g for g in got if g[0] != 94] == sorted((judged(i, t) for i, t in short), key=str)
    assert [g[1:6] for g in got if g[0] == 94] == [(1, 0, 30_000, 1, 30_000_000)]


# substrings


def cut(rows, width):
    windows = {}
    for i, t in rows:
        w = re.findall(SPACE, t or "")
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                windows[key] = min(windows.get(key, i), i)
    out = []
    for i, t in rows:
        w = re.findall(SPACE, t or "")
        gone = {p for k in range(len(w) - width + 1) if i is not None and windows[tuple(w[k : k + width])] < i for p in range(k, k + width)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("width, seed", [(13, 6), (5, 2), (8, 7)])
def test_substrings(spark, width, seed):
    r = random.Random(width)
    some = lambda n: [r.choice("ab cd Cd éf gh   kl".split(" ")) for _ in range(n)]
    shared = [some(r.randint(4, 40)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [r.choice(shared) if r.random() < 0.5 else some(r.randint(1, 15)) for _ in range(r.randint(0, 5))]
        rows.append((i, r.choice(["  ", " ", "\n"]).join(x for p in parts for x in p)))
    text = " ".join(some(40))
    rows += [(70, None), (71, ""), (72, " "), (None, text), (None, text), (80, text), (80, text), (80, "x " + text), (79, "y y y y y y y y " + text[5:]), (-3, "long " * 3000), (81, "long " * 2000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, place int").repartition(4)
    got = sorted(map(tuple, substrings.cut_repeats(docs, width=width, seed=seed).collect()), key=str)
    assert got == cut(rows, width)
    assert sorted(x.kept for x in substrings.cut_repeats(docs, width=width, seed=seed, digest=True).collect()) == sorted(sha(g[3]) for g in got)


def test_substrings_of_nothing(spark):
    assert substrings.cut_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        substrings.cut_repeats(spark.createDataFrame([], "doc_id long, text string"), width=5, seed=5)


# conversations


def cheapest(codes):
    """The least (cost, letters) of all edits, by a search that shares nothing with the operator but ``after``."""
    heap, seen = [(0, "", 0, al.NOTHING)], set()
    while heap:
        cost, letters, i, state = heapq.heappop(heap)
        if i == len(codes) and state in (al.NOTHING, al.ASSISTANT):
            return cost, letters
        if (cost, letters, i, state) in seen or len(letters) > 2 * len(codes) + 3:
            continue
        seen.add((cost, letters, i, state))
        if i < len(codes):
            kept = 5 if codes[i] & al.CUT_OFF else 0
            heapq.heappush(heap, (cost + 2, letters + "D", i + 1, state))
            if not codes[i] & al.MUST_GO:
                held = al.after(state, "K", codes[i] & 3)
                if held is not None:
                    heapq.heappush(heap, (cost + kept, letters + "K", i + 1, held))
                heapq.heappush(heap, (cost + 1 + kept, letters + "R", i + 1, al.after(state, "R")))
        heapq.heappush(heap, (cost + 5, letters + "I", i, al.after(state, "I")))


def options_of(codes):
    turns = al.Turns(codes)
    ways = [turns.forward(state, 0, len(turns)) for state in range(4)]
    return tuple(tuple((y, costs[y], ranks[y]) for y in range(4) if costs[y] < al.NEVER) for costs, ranks in ways)


def test_alignment_whole_and_in_pieces():
    r = random.Random(3)
    for _ in range(250):
        codes = bytes(r.choice([0, 1, 2, 3, 2, 3]) + r.choice([0, 0, 0, 4, 8]) for _ in range(r.randint(1, 6)))
        cost, end = al.finish(al.Turns(codes))
        tail = "I" * al.TAIL[end]
        assert (cost, "".join(tie for *_, tie in al.crossings(al.Turns(codes), 0, end)) + tail) == cheapest(codes)
        cuts = [0, *sorted(r.sample(range(1, len(codes)), r.randint(0, len(codes) - 1))), len(codes)]
        parts = [codes[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        steps = al.Stretches([options_of(p) for p in parts])
        assert al.finish(steps) == (cost, end)
        spelled = "".join(tie for p, (a, b, _) in zip(parts, al.crossings(steps, 0, end), strict=True) for *_, tie in al.crossings(al.Turns(p), a, b))
        assert spelled + tail == cheapest(codes)[1]


def mended(rows):
    """What ``repair_conversations`` says of one conversation's rows (turn, role, text), row by row."""
    rows = sorted([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    seen, codes, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        bare = text.rstrip(repair.BLANKS)
        mark = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if mark:
            counts[mark] += 1
        codes.append(al.INITIALS.get(role[:1], 0) + (al.MUST_GO if mark in ("blank", "duplicate") else al.CUT_OFF if mark else 0))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = cheapest(codes)
    left, out, state = list(rows), [], al.NOTHING
    for letter in audit:
        role, text = left.pop(0)[1:] if letter != "I" else ("", "")
        state = al.after(state, letter, al.INITIALS.get(role[:1], 0))
        if letter != "D":
            out.append(f"{role if letter == 'K' else 'user' if state == al.USER else 'assistant'}:{text}")
    return (gaps, *counts.values(), illegal, cost, audit, sha("\n".join(out)))


def test_repair(spark):
    r = random.Random(11)
    said = ["Yes.", "No!", "cut", "", " \t", "What? ", "é…", "Yes. and"]
    rows = [(c, r.choice([None, *range(6)]), r.choice(["system", "user", "assistant", "assistant", "user", None, "", "bot", "sum"]), r.choice([*said, None])) for c in range(60) for _ in range(r.randint(1, 6))]
    rows += [(None, 1, "user", "Hi."), (None, 0, "assistant", "Ho.")] + [(99, 3, "user", "Same.")] * 3
    frame = spark.createDataFrame([(*x, 0) for x in rows], "conv_id long, turn long, role string, text string, cost int").repartition(5)
    got = {x[0]: tuple(x)[1:] for x in repair.repair_conversations(frame).collect()}
    assert got == {c: mended([x[1:] for x in rows if x[0] == c]) for c in {x[0] for x in rows}}


def test_long_conversations_come_in_pieces(spark):
    """A conversation over many partitions: each row's place stays, and every piece fits its neighbours."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(2000)] + [(2, 0, "user", "One."), (2, 1, "assistant", "Two.")]
    rows[700] = (1, 700, "assistant", "Turn 700.")
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.conv_id: x for x in repair.repair_conversations(frame).collect()}
        assert repair.code_turns(repair.in_order(frame)).where("key = 1").select("piece").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (got[1].cost, got[1].audit, got[1].illegal) == (1, "K" * 700 + "R" + "K" * 1299, 2)
    fixed = [f"{'user' if i % 2 == 0 else 'assistant'}:Turn {i}." for i in range(2000)]
    assert got[1].repaired_sha256 == sha("\n".join(fixed)) and got[2].audit == "KK"


def test_damage_and_lost_conversations(spark):
    rows = [(c, t, "user", "One. Two!") for c in range(60) for t in range(3)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        row = (c, t, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
        want += [row] * {0: 0, 3: 2}.get(fault, 1)
    damaged = repair.damage(frame)
    assert sorted(map(tuple, damaged.collect()), key=str) == sorted(want, key=str)
    lost = repair.repair_conversations(frame, damaged.where("conv_id <> 7")).where("conv_id = 7").first()
    assert tuple(lost) == (7, 0, 0, 0, 0, 0, 0, "", sha(""))
