import hashlib
import random

import pandas as pd

from lakeleaf.llm import turns

ARRIVALS = "conv_id long, turn long, role string, text string, batch int"


def folded(rows, batches=12, idle=3):
    """Events by a plain fold, a batch and a conversation at a time."""
    convs = {r[0] for r in rows if r[1] is not None}
    first = {c: min(r[1] for r in rows if r[0] == c and r[1] is not None) for c in convs}
    kept, released, active, closed, out = {c: {} for c in convs}, {c: 0 for c in convs}, {}, set(), set()

    def close(c, batch):
        closed.add(c)
        have = kept[c]
        left = sorted(have)[released[c] :]
        breaks = sum(t - 1 in have and have[t - 1][0] == have[t][0] for t in have)
        out.add(("close", c, -1, batch, None, ",".join(map(str, left)), max(have) - first[c] + 1 - len(have), breaks))

    for batch in range(batches):
        best = {}
        for c, t, role, text, b in rows:
            if b == batch and t is not None:
                p = (f"{role or ''}|{text or ''}".encode(), role or "", text or "")
                best[c, t] = min(best.get((c, t), p), p)
        for (c, t), (_, role, text) in best.items():
            if c in closed:
                out.add(("reject", c, t, batch, role, text, None, None))
            else:
                active[c] = batch
                kept[c].setdefault(t, (role, text))
        for c in convs - closed:
            while (t := first[c] + released[c]) in kept[c]:
                out.add(("release", c, t, batch, *kept[c][t], None, None))
                released[c] += 1
            if c in active and active[c] <= batch - idle:
                close(c, batch)
    for c in convs - closed:
        close(c, batches)
    return out


def events(df):
    joined = lambda r: ",".join(map(str, r["turns"])) if r["event"] == "close" else r["text"]
    rows = [(r["event"], r["conv_id"], r["turn"], r["batch"], r["role"], joined(r), r["n_missing"], r["n_breaks"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some(seed, convs=25):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randrange(-2, 3), rng.choice([1, 4, 9, 14])):
            if rng.random() < 0.85:
                for _ in range(rng.choice([1, 1, 1, 2, 3])):
                    rows.append((c - 3, t, rng.choice(["user", "assistant", "user|x", None]), rng.choice(["a", "b|c", "", None, "é"]), rng.randrange(12)))
    return [r for r in rows if rng.random() < 0.8]


def test_equals_a_plain_fold(spark):
    rows = some(1)
    df = spark.createDataFrame(rows, ARRIVALS)
    assert events(turns.reassemble(df, bucket_rows=20)) == folded(rows)


def test_parts_of_a_conversation_are_settled(spark):
    rows = some(2, 15) + [(99, t, "user" if t % 3 else "assistant", f"t{t}", (t * 7) % 5 if t % 11 else 6) for t in range(40)]
    df = spark.createDataFrame(rows, ARRIVALS)
    assert events(turns.reassemble(df, span=3, bucket_rows=30)) == folded(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x", 0), (None, 0, "user", "x", 0), (None, 1, None, None, 11), (5, None, "user", "y", 3), (2**60 + 1, 7, "a", "z" * 300_000, 2), (2**60 + 1, 9, "a", "", 2)]
    df = spark.createDataFrame(rows, ARRIVALS).selectExpr("*", "1 as part", "2 as start", "'x' as kind")
    assert events(turns.reassemble(df)) == folded(rows)
    assert turns.reassemble(df.limit(0)).count() == 0


def test_state_round_trip():
    parts, waiting = turns.empty_state()
    rows = pd.DataFrame({"kind": [1, 1], "conv_id": [3, 3], "no_id": [False] * 2, "part": [0, 0], "start": [0, 0], "split": [False] * 2, "turn": [0, 2], "role": ["u", "v"], "text": ["a", "b"]})
    parts, waiting, _ = turns.advance(parts, waiting, rows, 0, False, 3, 10)
    again = turns.unpacked(turns.packed(parts, waiting))
    pd.testing.assert_frame_equal(again[0], parts, check_dtype=False)
    pd.testing.assert_frame_equal(again[1], waiting, check_dtype=False)
    assert list(waiting["turn"]) == [2] and parts["released"][0] == 1


def test_schedule(spark):
    rows = [(1, 0, "assistant", "x"), (1, 1, "user", "y"), (None, 3, None, None), (2, None, "user", "z")] + [(7, t, "assistant", "w") for t in range(30)]
    got = {tuple(r) for r in turns.scheduled(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = set()
    for c, t, role, text in rows:
        if t is not None:
            h = int(hashlib.sha256(f"{'' if c is None else c}:{t}".encode()).hexdigest()[:8], 16)
            want |= {(c, t, role, text, h % 12)} | ({(c, t, "user", text, (h + 3) % 12)} if h % 7 < 2 else set())
    assert got == want
