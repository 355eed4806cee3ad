"""Whitening and vector codes against plain numpy and whole numbers, with odd inputs."""

import hashlib
import math

import numpy as np
import pytest

from siltstone.llm import queries, vector_codes, whitening
from siltstone.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, n long, code string, x int, at int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "c", 2, 3) for i, v, lab in rows], SCHEMA)


def kept(rows):
    return [(i, v, lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def check_whitening(got, rows, components):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    d = n * x - sums
    cov = np.array([[v / n**3 for v in row] for row in (d.T @ d).tolist()])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == n * components
    by = {}
    for r in got:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    for k in range(components):
        flat = [(i, r) for i, rs in by[k + 1].items() for r in rs]
        assert len(flat) == n
        want = {}
        for (i, _, _), row, dev in zip(rows, d.tolist(), (d * d).sum(axis=1).tolist()):
            want.setdefault(i, []).append((float(np.array([v / n for v in row]) @ vectors[:, k] / math.sqrt(values[k])), dev))
        sign = None
        for i, rs in by[k + 1].items():
            for r, (w, dev) in zip(sorted(rs, key=lambda r: abs(r["whitened"])), sorted(want[i], key=lambda p: abs(p[0]))):
                if sign is None and abs(w) > 0.1:
                    sign = math.copysign(1, w) * math.copysign(1, r["whitened"])
                assert r["deviation"] == dev and r["n"] == n
                assert r["whitened"] == pytest.approx((sign or 1) * w, abs=1e-7) if sign else True
                assert r["explained"] == pytest.approx(values[k] / np.trace(cov), rel=1e-9)
                assert r["identity_error"] < 1e-9
    return by


def test_whitening_of_the_table(spark):
    t = table(spark, SF, "embeddings")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in t.collect()]
    check_whitening(queries.op11_embedding_whitening(spark, SF).collect(), rows, 32)


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 40, [float(c) for c in rng.normal(3, [1, 2, 3, 4, 5]).astype(np.float32)], None) for i in range(60)]
    rows += [(None, rows[0][1], 1), (100, None, 1), (101, [1.0, None, 1.0], 1), (102, [1.0, math.nan, 1.0, 1.0, 1.0], 2), (103, [1.0, math.inf, 1.0, 1.0, 1.0], 2), (104, [], 2), (105, [1.0, 2.0], 2)]
    good = [r for r in kept(rows) if len(r[1]) == 5]
    got = whitening.whiten(frame(spark, rows).repartition(5)).collect()
    check_whitening(got, good, 5)


def test_whitening_without_spread_and_without_rows(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    got = whitening.whiten(frame(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).collect()
    assert len(got) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in got)
    # one dimension without spread
    got = whitening.whiten(frame(spark, [(1, [1.0, 2.0], 1), (2, [3.0, 2.0], 1)])).collect()
    assert sorted((r["component"], r["whitened"] is None) for r in got) == [(1, False), (1, False), (2, True), (2, True)]
    assert {r["explained"] for r in got} == {1.0, 0.0}


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(10**k) * (i + 1) for k in (9, 3)], 0) for i in range(7)]
    got = whitening.whiten(frame(spark, rows)).collect()
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v, _ in rows], dtype=object)
    d = 7 * x - x.sum(axis=0)
    want = dict(zip(range(7), (d * d).sum(axis=1).tolist()))
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, v if v < 2**63 else None) for i, v in want.items()}


def test_remainders():
    for v in (0, 1, -1, 10**30, -(10**30) + 7):
        primes = whitening.primes_for(abs(v))
        assert whitening.remaindered([v % p for p in primes], primes) == v


def lloyd(rows, parts=16, entries=64, rounds=2):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(256 * c) for c in v] for _, v, _ in rows], dtype=np.int64)
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts))).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = ((x[:, :, None] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(rounds):
        code, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = x[code[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(axis=0) // len(own)
    code, err = assign()
    error = err.sum(axis=1)
    by = {}
    for (_, _, lab), e in zip(rows, error.tolist()):
        by[lab] = by.get(lab, 0) + e
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return sorted(((r[0], c.astype(np.uint8).tobytes().hex(), e, by[r[2]], sha) for r, c, e in zip(rows, code, error.tolist())), key=repr)


def as_rows(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=repr)


def test_codes_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, SF, "embeddings").collect()]
    assert as_rows(queries.op12_vector_codes(spark, SF)) == lloyd(rows)


@pytest.mark.parametrize("spread", [1, 400])
def test_codes_with_ties_and_odd_rows(spark, spread):
    rng = np.random.default_rng(spread)
    # a coarse grid: many equal distances, equal entries, unused entries
    rows = [(int(i), [float(c) / 256 * spread for c in rng.integers(-3, 4, 8)], [None, 1, 2][i % 3]) for i in rng.permutation(300)]
    rows += [(None, rows[3][1], None), (rows[5][0], rows[6][1], 1), (400, None, 1), (401, [math.nan] * 8, 1), (402, [None] * 8, None), (403, [1.0], 1), (404, [], 1)]
    good = [r for r in kept(rows) if len(r[1]) == 8]
    coded, books = vector_codes.encode(frame(spark, rows).repartition(4), parts=4, entries=20, rounds=3)
    assert as_rows(vector_codes.digests(coded, books)) == lloyd(good, 4, 20, 3)


def test_bounds_rule_entries_out(spark):
    """After the first round most distances are not measured, and codes are those of plain Lloyd."""
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 1, (10, 8))
    rows = [(i, [float(np.float32(c)) for c in centres[i % 10] + rng.normal(0, 0.02, 8)], 0) for i in range(400)]
    coded, books = vector_codes.encode(frame(spark, rows), parts=2, entries=10)
    assert as_rows(vector_codes.digests(coded, books)) == lloyd(rows, 2, 10)
    assert coded.groupBy().sum("measured").first()[0] < 400 * 2 * 3


def test_few_vectors_uneven_parts_and_none(spark):
    rows = [(2, [0.5, 0.25, -1.0], 1), (1, [0.5, 0.0, 1.0], None)]
    coded, books = vector_codes.encode(frame(spark, rows), parts=2)
    assert as_rows(vector_codes.digests(coded, books)) == lloyd(rows, 2)
    assert as_rows(vector_codes.digests(*vector_codes.encode(frame(spark, [])))) == []
