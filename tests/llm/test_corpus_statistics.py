"""Whitening, suffix dedup and source divergence against brute force and awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import bwt, divergence, suffix_dedup, whitening

# ---- whitening


def spectra():
    rng = np.random.default_rng(3)
    for d in (1, 2, 7, 40):
        a = rng.standard_normal((d, d))
        yield a @ a.T
        q, _ = np.linalg.qr(a)
        for e in (np.r_[np.ones(d // 2), np.full(d - d // 2, 3.0)], 1 + 1e-9 * np.arange(d), 10.0 ** -np.arange(d)):
            m = (q * e) @ q.T
            yield (m + m.T) / 2
        yield np.diag(np.r_[np.zeros(d // 2), np.arange(1, d - d // 2 + 1.0)])


def test_slicing_against_dense_solver():
    for matrix in spectra():
        values, vectors = whitening.leading(matrix, 32)
        expected = np.linalg.eigvalsh(matrix)[::-1][: len(values)]
        scale = np.abs(matrix).sum(axis=1).max()
        assert np.abs(values - expected).max() < 1e-12 * scale
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * scale


def test_inertia_counts():
    rng = np.random.default_rng(4)
    for d in (1, 3, 12):
        m = rng.standard_normal((d, d))
        m = m + m.T
        for sigma in rng.standard_normal(20) * 2:
            assert whitening.inertia(m, sigma) == (np.linalg.eigvalsh(m) > sigma).sum()
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_whitened_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = whitening.whiten(table).toPandas().sort_values(["vec_id", "component"])
    c = np.stack(table.orderBy("vec_id").toPandas()["embedding"].to_numpy()).astype(float)
    x = np.floor(64 * c) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    e, q = np.linalg.eigh((x - total / n).T @ (x - total / n) / n)
    e, q = e[::-1], q[:, ::-1]
    k = got["component"].max()
    assert k == min(32, (e > 1e-9).sum())
    w = (x - total / n) @ q[:, :k] / np.sqrt(e[:k])
    mine = got["whitened"].to_numpy().reshape(n, k)
    signs = np.sign((mine * w).sum(axis=0))
    assert np.abs(mine * signs - w).max() < 1e-6
    assert (got["n"] == n).all() and (got["identity_error"] < 1e-9).all()
    assert np.allclose(got["explained"].to_numpy()[:k], e[:k] / e.sum(), rtol=1e-9)
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, total)) for row in x]
    assert got["deviation"].to_numpy().reshape(n, k)[:, 0].tolist() == exact


def test_awkward_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, []), (7, [1.0]), (8, [3.0, -1.0]), (None, [0.0, 1e30])]
    schema = "vec_id long, embedding array<double>, x string, n int, component string"
    df = spark.createDataFrame([(*r, "x", 1, "c") for r in rows], schema)
    got = whitening.whiten(df).collect()
    assert Counter(r.vec_id for r in got if r.component == 1) == {1: 2, 8: 1, None: 1}
    assert {r.n for r in got} == {4} and any(r.deviation is None for r in got)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 1")).count() == 0  # nothing varies
    few = df.where("vec_id = 1 or vec_id = 8").repartition(3)
    x = [(1_000_064, 1_000_128)] * 2 + [(1_000_192, 999_936)]
    sums = [sum(v) for v in zip(*x)]
    assert sorted(r.deviation for r in whitening.whiten(few).collect()) == sorted(sum((3 * v - s) ** 2 for v, s in zip(row, sums)) for row in x)


# ---- suffix dedup


def brute_cut(rows, length):
    seen, out = set(), defaultdict(list)
    for doc_id, text in sorted(rows):
        t = (text or "").encode()
        covered = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if t[s : s + length] in seen:
                covered[s : s + length] = b"\1" * length
            seen.add(t[s : s + length])
        kept = bytes(b for b, c in zip(t, covered) if not c)
        runs = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out[doc_id].append((len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def cut_rows(df, *args, **more):
    out = defaultdict(list)
    for r in suffix_dedup.cut(df, *args, **more).collect():
        out[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def passages():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdé漢") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(60):
        p = rng.choice(base)
        a = rng.randint(0, len(p) - 10)
        fill = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(2)]
        rows.append((i, fill[0] + p[a : a + rng.randint(10, 250)] + fill[1]))
    return rows + [
        (100, "a" * 1000), (101, "ab" * 700), (102, "a" * 150), (103, ""), (104, "x" * 99), (105, rows[3][1]), (105, rows[3][1]),
        (106, "abc" * 3000), (107, "b" + "a" * 120), (108, "\0" * 300), (109, base[0] + base[0]),
    ]


@pytest.mark.parametrize("settings", [{}, {"HOT": 3, "HEAVY": 2}, {"HOT": 3, "HEAVY": 4, "BUCKET_BYTES": 3000, "SHARD_BYTES": 700, "BLOCK": 2000, "LONGEST_RUN": 64}])
def test_cut_against_brute_force(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert cut_rows(df) == brute_cut(rows, 100)
    if settings:
        assert cut_rows(df, 40, 8) == brute_cut(rows, 40)


def test_cut_of_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert cut_rows(docs) == brute_cut(rows, 100)


def test_awkward_texts(spark):
    same = "é" * 80
    rows = [(None, same), (1, same), (1, same), (1, "other"), (2, None), (-(2**63), "z" * 120)]
    df = spark.createDataFrame([(i, t, "x", 1, b"k") for i, t in rows], "doc_id long, text string, has string, at int, spots binary")
    got = cut_rows(df)
    empty = hashlib.sha256(b"").hexdigest()
    assert got[None] == [(160, 158, 1, hashlib.sha256(same.encode()[:2]).hexdigest())]  # strings repeat two bytes further on
    assert got[1] == sorted([(5, 0, 0, hashlib.sha256(b"other").hexdigest()), (160, 160, 1, empty), (160, 160, 1, empty)])
    assert got[2] == [(0, 0, 0, empty)]
    assert got[-(2**63)][0][:3] == (120, 119, 1)
    assert suffix_dedup.cut(df.limit(0)).count() == 0


def test_merged_transforms_find_all_repeats():
    rng = random.Random(1)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))).encode() for _ in range(30)]
    shards = [bwt.Shard(strings[:10]), bwt.Shard(strings[10:11]), bwt.Shard(strings[11:])]
    for length in (1, 3, 8):
        owner, offset, interval = bwt.repeated_intervals(shards, length)
        got = defaultdict(set)
        for s, o, i in zip(owner.tolist(), offset.tolist(), interval.tolist()):
            got[i].add((s, o))
        places = defaultdict(set)
        for s, string in enumerate(strings):
            for o in range(len(string) - length + 1):
                places[string[o : o + length]].add((s, o))
        assert sorted(map(sorted, got.values())) == sorted(sorted(p) for p in places.values() if len(p) > 1)


def test_shard_is_the_transform():
    strings = [b"banana", b"ananas", b"", b"nab"]
    shard = bwt.Shard(strings)
    expected = sorted((strings[s][o:], s, o) for s in range(4) for o in range(len(strings[s]) + 1))
    assert [(s, o) for _, s, o in expected] == list(zip(shard.owner.tolist(), shard.offset.tolist()))


# ---- divergence


def brute_audit(rows, least):
    terms = lambda text: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        key = (lang or "", source or "")
        groups.add(key)
        counts[key].update(terms(text))
        docs[key[0]].update(set(terms(text)))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(g[1] for g in groups if g[0] == lang)
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            parts = {
                "pair": [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s],
                "term": [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]],
            }
            for part, found in parts.items():
                for rank, (value, item) in enumerate(sorted(found), 1):
                    if part == "pair" or rank <= 50:
                        out.add((lang, s, part, item.decode(), -value, rank))
    return out


def audited(df, **more):
    return {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(df, **more).collect()}


def test_audit_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in "abcdeé漢" for b in "QRSTuvwxyz" for c in "klMNOp"]
    rows = []
    for i in range(900):  # more sources than a block holds, more terms than a stripe
        words = [vocabulary[int(rng.expovariate(0.01)) % len(vocabulary)] for _ in range(rng.randint(0, 12))]
        rows.append((rng.choice(["en", "en", "de", None]), f"s{i % 290 if i % 3 else 7}", " 7,".join(words)))
    rows += [("en", None, None), ("xx", "a", "rare"), ("xx", "b", ""), ("yy", "only", None)] + [("en", "s0", "copy Copy COPY")] * 40
    df = spark.createDataFrame([(*r, 1, "r") for r in rows], "lang string, source string, text string, n int, row string").repartition(4)
    for least in (1, 30):
        assert audited(df, min_docs=least) == brute_audit(rows, least)
    assert divergence.audit(df.limit(0)).count() == 0


def test_walk_prices_empty_quadrants():
    rng = np.random.default_rng(2)
    side = divergence.SIDE
    for rows_a, rows_b, width, share in ((20, 20, side, 0.01), (3, 200, 37, 0.5), (side, 1, 100, 0.0)):
        tiles, floors = [], []
        for rows in (rows_a, rows_b):
            floor = np.full(side, -1, np.int64)
            floor[:rows] = rng.integers(1, 1000, rows)
            tile = np.zeros((side, side), np.int64)
            cells = rng.random((rows, width)) < share
            tile[:rows, :width][cells] = rng.integers(1000, 10**9, int(cells.sum()))
            tiles.append(tile)
            floors.append(floor)
        full = [np.where(t > 0, t, f[:, None])[:, :width] for t, f in zip(tiles, floors)]
        expected = np.abs(full[0][:rows_a, None, :] - full[1][None, :rows_b, :]).sum(axis=2)
        assert (divergence.walk(*tiles, *floors, width, False)[:rows_a, :rows_b] == expected).all()
