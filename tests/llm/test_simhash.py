import hashlib
import re

from pyspark.sql import functions as F

from lakeleaf.llm import simhash as sh

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rows(spark, df):
    """Fingerprints bit by bit, neighbours by a plain sort."""
    hashed = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()
    rows = sorted(hashed, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"] % sh.PARTS if r["doc_id"] is None else 0, r["h"], r["text"].encode()))
    rows = [(r["doc_id"], r["text"]) for r in rows]
    pairs = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        k = len(t) // 3
        pairs.append((d, t, t[: len(t) - k] + nxt[:k], nxt))
    words = {w for p in pairs for t in p[1:] for w in WORDS.findall(t.lower())} | {"x"}
    table = spark.createDataFrame([(w,) for w in words], "w string")
    hashes = {r["w"]: (r["a"] % 2**64, r["b"] % 2**64) for r in table.select("w", F.xxhash64("w").alias("a"), F.xxhash64("w", F.lit(1)).alias("b")).collect()}

    def mark(t):
        votes = [0] * 128
        for w in WORDS.findall(t.lower()):
            for half in (0, 1):
                for bit in range(64):
                    votes[64 * half + bit] += -(-(min(len(w), 8) ** 2) // 8) * (1 if hashes[w][half] >> bit & 1 else -1)
        return tuple(sum(1 << b for b in range(64) if votes[64 * h + b] > 0) for h in (0, 1))

    like = lambda x, y: 1 - sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True)) / 128
    text = lambda m: "".join(f"{h:016x}" for h in m)
    out, marks = [], [(d, mark(t)) for d, t, *_ in pairs]
    for d, t, e, nxt in pairs:
        own, changed = mark(t), mark(e)
        near = sum(like(own, m) >= 1 - 3 / 128 for _, m in marks) if d is not None and d % 100 == 0 else None
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), text(own), text(changed), round(like(own, changed), 9), round(like(own, mark(nxt)), 9), near))
    return sorted(out, key=repr)


def test_equals_brute_force(spark, small, odd, monkeypatch):
    monkeypatch.setattr(sh, "ROWS_A_BUCKET", 3)  # many buckets, so that neighbours cross their bounds
    for df in (small.limit(60), odd):
        df = df.cache()
        got = sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in sh.fingerprint_documents(df).collect()), key=repr)
        assert got == brute_rows(spark, df)


def test_counters_hold_the_longest_string():
    """The densest text is made of words of one length and single spaces; its weights stay below 2^31 in 2^31 bytes."""
    weight = lambda n: (min(n, sh.LONG_WORD) ** 2 + 7) // 8
    assert max(weight(n) / (n + 1) for n in range(1, 100)) * (2**31 + 1) < 2**31


def test_full_counters_neither_overflow_nor_mix(spark):
    """The hash aggregate's sums at the largest whole weight that a string can hold: no bit leaves its lane."""
    whole = 8 * (2**31 // 9)
    low, high = spark.sql(f"select shiftrightunsigned(s, 32), s & {0xFFFFFFFF}L from (select sum({0x0000000100000001}L * w) s from values ({whole - 8}L), (8L) t(w))").first()
    assert (low, high) == (whole, whole)


def test_no_rows_and_one_row(spark, none, odd):
    assert sh.fingerprint_documents(none).count() == 0
    one = sh.fingerprint_documents(odd.filter("doc_id = 1")).first()
    assert one["near_next"] == 1.0


def test_tables_find_all_within_the_radius(spark):
    marks = [(i, i * 0x9E3779B97F4A7C15 % 2**63, i * 0xBF58476D1CE4E5B9 % 2**63) for i in range(1, 40)]
    marks += [(100 + i, m[1] ^ (1 << i % 60), m[2] ^ (1 << (i * 7) % 60) ^ (1 << (i * 11 + 1) % 60)) for i, m in enumerate(marks)]
    df = spark.createDataFrame(marks, "id long, hi long, lo long").select("id", F.struct("hi", "lo").alias("mark"))
    got = {(tuple(r["query"]), tuple(r["mark"])) for r in sh.within_radius(df, df, 3).collect()}
    want = {(a[1:], b[1:]) for a in marks for b in marks if (a[1] ^ b[1]).bit_count() + (a[2] ^ b[2]).bit_count() <= 3}
    assert got == want and len(want) > len(marks)


def test_the_main_path_is_native(spark, small):
    plan = sh.with_next(small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_clustered_and_hot_ids_fill_even_buckets(spark, monkeypatch):
    """A third of the rows share an id, a third have clustered ids; every row is followed by the next one in order."""
    monkeypatch.setattr(sh, "ROWS_A_BUCKET", 20)
    rows = [(500, f"hot {i}") for i in range(400)] + [(10**12 + i, f"near {i}") for i in range(400)] + [(i * 10**9, f"far {i}") for i in range(-200, 200)] + [(None, f"none {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sh.with_next(df).collect()
    assert len(got) == len(rows) == len({r["rid"] for r in got})
    following = {r["text"]: r["next_text"] for r in got}
    seen, at = [], max(rows, key=lambda r: (r[0] is not None, r[0] or 0))[1]
    for _ in rows:
        seen.append(at)
        at = following[at]
    ids = {t: d for d, t in rows}
    assert at == seen[0] and len(set(seen)) == len(rows)
    order = [ids[t] for t in seen]
    assert order == sorted(order, key=lambda d: (d is None, -(d or 0)))
    sizes = [r["count"] for r in sh.with_next(df).groupBy((F.col("rid") / 2**34).cast("long")).count().collect()]
    assert max(sizes) <= 100
