import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from siltstone.llm import packing, sharding, token_files, tokens
from siltstone.llm.common import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int"
ODD = [None, "", " ", "a. b", "<|endoftext|> x", "É's don't 1,234.5 ''s", "x" * 9000 + ".", "the cat " * 6000, "The.cat", "日本 語。", "\x1cfoo\x85bar", "the cat"]


def odd(spark):
    rows = [(i, t, None, "s", 1, 9) for i, t in enumerate(ODD)] + [(None, "the cat", "en", None, None, None), (3, "a. b", "en", "s", 1, 1), (3, "a. b", "en", "s", 1, 1)]
    return spark.createDataFrame(rows, SCHEMA), rows


def brute(text):
    return tokens.encoder(tokens.default_path()).library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab Éé.,'s\n\t|<>1İΣ́K\x85", max_size=30), max_size=5))
def test_encoder_equals_library(texts):
    ids, counts = tokens.encoder(tokens.default_path()).encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][: len(texts)] == [brute(t) for t in texts]


def test_token_files_round_trip(spark):
    docs, rows = odd(spark)
    path = scratch_path(spark, "t")
    token_files.write_tokens(docs, path, tokens.default_path())
    got = token_files.token_digests(spark, path).orderBy("start").collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for r in rows:
        ids = brute(r[1]) + [2]
        want[r[0]].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    start, last = 0, -1
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        assert (r.doc_id is None and last == -1) or r.doc_id >= last
        start, last = start + r.n_tokens, -1 if r.doc_id is None else r.doc_id
    assert token_files.read_tokens(spark, path, 3, 5).count() == 5
    assert [(r.start, r.n_tokens) for r in token_files.read_lengths(spark, path).orderBy("start").collect()] == [(r.start, r.n_tokens) for r in got]


@pytest.mark.parametrize("f", [lambda d: packing.pack(d, tokens.default_path()), sharding.lpt_shards])
def test_empty(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0


def check_packed(got, capacity):
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack(spark):
    docs, rows = odd(spark)
    got = packing.pack(docs, tokens.default_path(), 4096, 1).collect()
    check_packed(got, 4096)
    want = []
    for r in rows:
        ids = brute(r[1]) + [1]
        want += [(r[0], i, 4096 * i, zlib.crc32(np.array(ids[4096 * i : 4096 * i + 4096], "<u4").tobytes())) for i in range(-(-len(ids) // 4096))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan(counts):
    done = packing.plan(counts, 40)
    used = defaultdict(int)
    for combo, times in done:
        assert sum(combo) <= 40 and times > 0
        for x in combo:
            used[x] += times
    assert dict(used) == counts
    total = sum(a * b for a, b in counts.items())
    assert sum(t for _, t in done) <= max(-(-total * 11 // (40 * 6)) + 1, 0)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 400), max_size=12), st.integers(1, 9))
def test_schedule_is_lpt(sizes, shards):
    loads, want = [0] * shards, defaultdict(int)
    for size in sorted(sizes, reverse=True):
        for _ in range(sizes[size]):
            s = min(range(shards), key=lambda i: (loads[i], i))
            loads[s] += size
            want[size, s] += 1
    assert {(size, s): n for size, s, _, n in sharding.schedule(list(sizes.items()), shards)} == dict(want)


def test_shards(spark):
    docs, rows = odd(spark)
    got = sharding.lpt_shards(docs, 3).collect()
    assert len(got) == len(rows)
    slots, texts, loads = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        texts[r.size, r.text_crc32].add(r.shard)
        loads[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(v) == 1 for k, v in texts.items() if k[0] > 1)


def test_pieces_with_equal_hashes(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from siltstone.llm import tokens

    real = tokens.span_hashes
    monkeypatch.setattr(tokens, "span_hashes", lambda raw, a, b, seed=0: real(raw, a, b, seed) % np.uint64(5))
    enc = tokens.Encoder(tokens.default_path())
    texts = ["the cat sat on a mat", "dog eats a bone", "zebra", None, "", "a" * 400 + " " + "b" * 400, "the dog, the cat."] * 2
    ids, counts = enc.encode(pa.array(texts, pa.string()))
    for text, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert part.tolist() == enc.whole(text or "").tolist()


def test_swapped_words_have_their_own_ids():
    import numpy as np
    import pyarrow as pa

    from siltstone.llm import tokens

    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    enc = tokens.Encoder(tokens.default_path())
    ids, counts = enc.encode(pa.array([a, b]))
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [enc.whole(a).tolist(), enc.whole(b).tolist()]


def test_token_file_encodings(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from siltstone.llm import token_files, tokens

    docs = spark.range(4000).selectExpr("id as doc_id", "concat('some words of text number ', id, repeat(' and more', 20)) as text").coalesce(1)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, tokens.default_path(), row_group_bytes=8 << 10, page_bytes=2 << 10)
    meta = [pq.ParquetFile(f).metadata for f in glob.glob(path + "/*.parquet")]
    columns = {c.path_in_schema: c for m in meta for g in range(m.num_row_groups) for c in [m.row_group(g).column(i) for i in range(m.num_columns)]}
    assert any("DICTIONARY" in e for e in columns["tokens.list.element"].encodings) and any("DELTA" in e for e in columns["part_start"].encodings)
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    assert max(m.num_row_groups for m in meta) > 1
    some = token_files.read_tokens(spark, path, 1000, 1002)
    assert sorted(r.doc_id for r in some.collect()) == [1000, 1001, 1002]
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,1000)" in some._jdf.queryExecution().toString()
    assert "tokens:array" not in token_files.read_lengths(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert token_files.token_digests(spark, path).count() == 4000
