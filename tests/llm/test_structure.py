"""Conversation repair, whitening and decontamination against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from walksieve.llm import decontaminate, queries, repair, spectrum, whitening

from .fixtures import docs, empty
from .fixtures import rows as doc_rows

CONV = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if hit == 1:
            x = ""
        if hit == 2:
            x = re.sub("[.!?]", "", x)
        if hit == 4:
            r = "user"
        out += [(c, t, r, x)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        bare = x.rstrip(" \t\n\x0b\x0c\r")
        out.append(1 if not bare else 2 if (r, x) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((r, x))
    return out


def plain_audit(roles, faults):
    """Cheapest and then least edits by a table of whole audits from the end, with loops of insertions relaxed to rest."""
    name = {"u": "user", "a": "assistant"}
    grow = {0: "su", 1: "u", 2: "a", 3: "u"}
    to = {"s": 1, "u": 2, "a": 3}

    def relaxed(best):
        for _ in range(4):
            for s in range(4):
                for c in grow[s]:
                    if c != "s" and best[to[c]] is not None:
                        cost, audit, lines = best[to[c]]
                        new = (cost + 3, "I" + audit, ((name[c], None),) + lines)
                        if best[s] is None or new[:2] < best[s][:2]:
                            best[s] = new
        return best

    best = relaxed([(0, "", ()), None, None, (0, "", ())])
    for i in range(len(roles) - 1, -1, -1):
        made = [None] * 4
        for s in range(4):
            tries = []
            if best[s] is not None:
                tries.append((best[s][0] + 4, "D" + best[s][1], best[s][2]))
            if faults[i] not in (1, 2):
                extra = 3 if faults[i] == 3 else 0
                for c in grow[s]:
                    nxt = best[to[c]]
                    if nxt is None:
                        continue
                    if roles[i][:1] == c:
                        tries.append((nxt[0] + extra, "K" + nxt[1], ((roles[i], i),) + nxt[2]))
                    if c != "s":
                        tries.append((nxt[0] + 3 + extra, "R" + nxt[1], ((name[c], i),) + nxt[2]))
            made[s] = min(tries, key=lambda t: t[:2]) if tries else None
        best = relaxed(made)
    return best[0]


def plain_repair(rows):
    """conv_id -> the contract's columns, for damaged rows."""
    out = {}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3][:16].encode()))
        faults = faults_of(own)
        cost, audit, lines = plain_audit([r[2] for r in own], faults)
        text = "\n".join(f"{r}:{'' if i is None else own[i][3]}" for r, i in lines)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines))
        turns = [r[1] for r in own if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit,
                  hashlib.sha256(text.encode()).hexdigest())
    return out


def conversations(seed=1, many=60, long=500):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Is it?", "cut", "", " \n", None, "same here.", "Étude x  ", "long " * 50 + ".", "tail. \t\n", "é? "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    rows = []
    for c in range(many):
        n = r.choice([1, 2, 3, 5, 8])
        rows += [(c, t, r.choice(roles) if r.random() < 0.4 else ("user", "assistant")[t % 2], r.choice(texts)) for t in range(n) if r.random() < 0.9]
    # one conversation has most rows; some rows have no turn, some stand twice
    rows += [(777, t if t % 7 else None, r.choice(roles), f"{r.choice(texts[:5])}{r.randrange(99)}{r.choice(['.', ''])}") for t in range(long)]
    rows += [(None, t, "user", "x.") for t in range(3)] + [(None, None, "assistant", "y.")]
    rows += [rows[0], rows[5], rows[-1]] + [(888, 5, "user", "again.")] * 40
    return rows


def test_repair_contract(spark):
    rows = conversations()
    table = spark.createDataFrame([(*x, "c", 1) for x in rows], CONV + ", seq string, kind int").repartition(5)
    broken = repair.damaged(table)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:  # pieces of a few rows: conversations lie in several
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        made = repair.edits(broken)
        got = {x.conv_id: tuple(x)[1:] for x in repair.digest(broken, made, table).collect()}
        assert made.where("conv_id = 777").select(F.shiftright("seq", 33)).distinct().count() > 5
        turns = repair.repaired(broken, made).orderBy("conv_id", "seq", "part").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {c: (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for c in {x[0] for x in rows}} | plain_repair(plain_damage(rows))
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], c
    # the rows themselves are what the digests are of
    for c, own in itertools.groupby(turns, key=lambda t: t.conv_id):
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in own).encode()).hexdigest() == want[c][-1]
    none = table.limit(0)
    assert repair.digest(repair.damaged(none), repair.edits(repair.damaged(none)), none).count() == 0


def test_repair_without_damage(spark):
    table = spark.createDataFrame([(1, 0, None, "hello."), (1, 1, "assistant", None), (1, 2, "assistant", "so.")], CONV)
    rows, made = repair.repair(table)
    assert [x.edit for x in made.orderBy("seq").collect()] == ["R", "D", "K"]
    assert [(x.role, x.text) for x in repair.repaired(rows, made).orderBy("seq", "part").collect()] == [("user", "hello."), ("assistant", "so.")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=30), st.integers(1, 7))
def test_division_finds_the_least_audit(rows, piece):
    want = plain_audit([r for r, _ in rows], [f for _, f in rows])
    parts = [rows[i:i + piece] for i in range(0, len(rows), piece)]
    flats = []
    for p in parts:
        t = repair.Table()
        for x in p:
            t.add(x)
        flats.append(t.flat())
    states = repair.piece_states(flats) if parts else []
    made = [e for p, ends in zip(parts, states) for e in repair.edits_between(p, *ends)]
    end = states[-1][1] if states else 0
    assert "".join(e for e, _ in made) + repair.ENDING[end][1] == want[1]


# ---- whitening -----------------------------------------------------------------


@pytest.mark.parametrize("values", [[5, 5, 5, 1, 1, 1, 1, 0, 0], [1] * 10, [0] * 9 + [1], [1e12, 1, 1e-3, 1e-3, 0, 0], [1 + 1e-7, 1, 1 - 1e-7, 0.9, 0.5, 0.5], [3.0], [-1, -2, -3]])
def test_spectrum(values):
    r = np.random.default_rng(3)
    q = np.linalg.qr(r.normal(size=(len(values),) * 2))[0]
    a = (q * np.array(values, float)) @ q.T
    e, v = spectrum.leading(a, 8)
    k, most = min(8, len(values)), max(map(abs, values))
    assert np.abs(e - np.sort(values)[::-1][:k]).max() < 1e-14 * len(values) * most
    assert np.abs(v.T @ v - np.eye(k)).max() < 1e-13
    assert np.abs(a @ v - v * e).max() < 1e-13 * most


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(0, 2**32 - 1))
def test_inertia(n, seed):
    r = np.random.default_rng(seed)
    a = r.integers(-3, 4, (n, n)).astype(float)
    a = a + a.T
    w = np.linalg.eigvalsh(a)
    for s in (-4.3, -0.7, 0.1, 2.9):
        if np.abs(w - s).min() > 1e-9:
            assert spectrum.inertia(a, s) == ((w > s).sum(), (w < s).sum(), 0)


def plain_whitening(vectors, k=8):
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    dev = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x.tolist()]
    centred = np.array([[float(Fraction(a) - Fraction(b, n)) for a, b in zip(row, s)] for row in x.tolist()])
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, dev, centred @ q / np.sqrt(e), e / np.trace(v)


def test_whitening(spark):
    r = np.random.default_rng(4)
    m = (r.normal(size=(300, 12)) * np.arange(1, 13)).astype(np.float32)
    m[7] = m[3]
    data = [(i, v.tolist(), 1) for i, v in enumerate(m)] + [(900, None, 1), (901, [1.0] * 11 + [None], 1), (902, [float("nan")] * 12, 1), (903, [float("inf")] * 12, 1), (904, [], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, n int").repartition(7)
    rows = whitening.whiten(df).orderBy("vec_id", "component").collect()
    n, dev, want, share = plain_whitening(m)
    assert [(x.vec_id, x.component) for x in rows] == [(i, c) for i in range(300) for c in range(1, 9)]
    got = np.array([x.whitened for x in rows]).reshape(300, 8)
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * sign).max() < 1e-9
    assert {x.n for x in rows} == {n} and [x.deviation for x in rows[::8]] == dev
    assert np.allclose([x.explained for x in rows[:8]], share, rtol=1e-10)
    assert len({x.identity_error for x in rows}) == 1 and rows[0].identity_error < 1e-9


def test_whitening_corners(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    # one vector: no variance; two lengths: a space each; a null id and a repeated row count
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect()
    assert [(x.component, x.n, x.deviation, x.whitened, x.explained, x.identity_error) for x in got] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    rows = [(1, [1.0, 0.0, 0.0]), (2, [-1.0, 0.0, 0.0]), (None, [3.0, 0.0, 0.0]), (2, [-1.0, 0.0, 0.0]), (5, [7.0]), (6, [9.0])]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 * 3 + 2 and {x.n for x in got if x.vec_id == 5} == {2} and {x.n for x in got if x.vec_id == 2} == {4}
    assert all((x.whitened is None) == (x.component > 1) for x in got if x.vec_id not in (5, 6))
    assert {x.explained for x in got if x.component == 1} == {1.0}
    # sums past 2**53 stay exact where they are reported, deviations past a long are null
    big = [(i, [2.0**40 + i, float(i)]) for i in range(4)]
    got = whitening.whiten(spark.createDataFrame(big, schema)).where("component = 1").collect()
    want = plain_whitening([v for _, v in big], 2)[1]
    assert sorted(x.deviation for x in got) == sorted(want)
    far = whitening.whiten(spark.createDataFrame([(0, [2.0**41, 0.0]), (1, [0.0, 1.0])], schema)).collect()
    assert {x.deviation for x in far} == {None}
    with pytest.raises(Exception, match="smaller than"):
        whitening.whiten(spark.createDataFrame([(0, [1e30])], schema)).collect()


# ---- decontamination -------------------------------------------------------------


def plain_words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(text, items, size):
    w = plain_words(text)
    hit, met = set(), set()
    for item, t in items:
        own = plain_words(t)
        for i in range(max(len(own) - size, 0) + 1 if own else 0):
            window = own[i:i + size]
            for j in range(len(w) - len(window) + 1):
                if w[j:j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    met.add("" if item is None else str(item))
    return len(w), sorted(hit), sorted(met)


def items_and_texts():
    r = random.Random(9)
    word = lambda: r.choice(["the", "Of", "été", "x1", "b", "c", "日本", "d-e"])
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 9, 10, 11, 25])))) for i in range(2, 24) if i % 5] + [(30, None), (31, " .,"), (32, "the of the of the of"), (None, "un id x1 b"), (2, "two b c")]
    items += [items[0], (10, items[1][1]), (9, items[1][1])]
    texts = [" ".join(word() for _ in range(n)) for n in (0, 1, 5, 40, 200)]
    for _, t in items:
        texts.append(f"İ_ start {t or ''}, end! {' '.join(word() for _ in range(6))} {(t or '').upper()}")
    return items, texts


@pytest.mark.parametrize("shard", [500_000, 40])
def test_decontamination(spark, shard):
    items, texts = items_and_texts()
    data = [(i, t, "en", None, 1) for i, t in enumerate(texts)] + doc_rows()[:12]
    data += [data[3], (999, None, None, None, None), (999, "", None, None, None)]
    table = docs(spark, data).withColumn("items", F.lit(1)).withColumn("spans", F.lit(1))
    bench = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, items int")
    found = decontaminate.matches(table, bench, size=10, shard_pairs=shard)
    got = sorted(tuple(x) for x in decontaminate.digest(found).collect())
    want = []
    for i, t, *_ in data:
        n, hit, met = plain_hits(t, items, 10)
        want.append((i, n, len(hit), len(met), hashlib.sha256(",".join(met).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want)
    none = bench.limit(0)
    assert decontaminate.matches(table, none, shard_pairs=shard).where("size(spans) > 0 or words is null").count() == 0
    assert decontaminate.matches(empty(spark), bench, shard_pairs=shard).count() == 0


def test_places_in_the_original(spark):
    items = spark.createDataFrame([(1, "Alpha beta gamma"), (2, "ünder 2 x")], "item_id long, text string")
    text = "İ  ALPHA, beta--GAMMA... Ünder ünder 2 X\talpha beta gamma"
    table = spark.createDataFrame([(5, text)], "doc_id long, text string")
    found = decontaminate.matches(table, items, size=10)
    [row] = decontaminate.contaminated_spans(table, found).collect()
    assert [text[a:b] for a, b in row.places] == ["ALPHA, beta--GAMMA", "ünder 2 X\talpha beta gamma"]
    assert found.collect()[0]["items"] == ["1", "2"]


def test_decontamination_sql(spark, tmp_path):
    items, texts = items_and_texts()
    data = [(i, t, "en", None, 1) for i, t in enumerate(texts) if t] + [(999, None, None, None, None)]
    docs(spark, data, extra=False).toPandas().to_parquet(tmp_path / "documents.parquet")
    bench = spark.createDataFrame([x for x in items if x[0] is not None], "item_id long, text string")
    bench.toPandas().to_parquet(tmp_path / "benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    cur = c.execute(queries.oracle_sql()["op13_aho_corasick"])
    names = [d[0] for d in cur.description]
    got = queries.queries()["op13_aho_corasick"](spark, str(tmp_path)).select(*names)
    assert sorted(tuple(x) for x in got.collect()) == sorted(cur.fetchall())
