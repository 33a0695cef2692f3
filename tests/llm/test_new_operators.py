"""Packing along a curve, alignment of tokenizers, and divergence of sources: brute force, SQL and odd inputs."""

import functools
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridlume.llm import align, curvepack, divergence, queries
from gridlume.llm import textops as T

SYLLABLES = "ra lo mi ten dor el su ka pri vo é ß".split()
SCHEMA = "doc_id long, text string, lang string, source string, nr long, part int, term string, pairs string, `my.col` int"


def words(rng, n, pool=SYLLABLES):
    return " ".join("".join(rng.choices(pool, k=rng.randint(1, 3))) for _ in range(n))


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randint(1, 80)), rng.choice(["en", "de", "de"]), f"s{rng.randint(0, 3)}") for i in range(n)]
    rows += [(900 + k, rows[k][1], "de", "s0") for k in range(8)]
    rows += [(950, None, None, None), (951, "", None, "s1"), (952, "   ", "fr", "s1"), (953, "x  y\n\tz <|endoftext|></s> it's 12,5", "en", "s1"), (953, "again", "en", "s1"), (None, "no id ▁ here", "en", "s2"), (954, "a b c　d 漢字 かな " * 3, "de", "s2"), (-(2**63), "\x00 nul \x1c", "en", "s1"), (2**63 - 1, "Ärger ÄRGER ", "xx", "only")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "t", "p", 3) for r in rows], SCHEMA)


@functools.cache
def packer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file())


def ids_of(text):
    return [*packer().encode(text or "", add_special_tokens=False).ids, 1]


# ---- packing along a curve


@pytest.mark.parametrize("size", [16, 2048])
def test_curve_packing_is_a_round_trip_without_padding(spark, size):
    rows = corpus()
    got = curvepack.pack_along_curve(frame(spark, rows).repartition(3), queries.tokenizer_file(), size=size).toPandas()
    want = Counter((i, zlib.crc32(np.array(ids_of(t), "<u4").tobytes()), len(ids_of(t))) for i, t, *_ in rows)
    tokens = sum(len(ids_of(t)) for _, t, *_ in rows)
    by_row = defaultdict(list)
    for r in got.sort_values(["sequence_id", "offset"]).itertuples():
        by_row[(None if r.doc_id != r.doc_id else int(r.doc_id), r.doc_tokens)].append(r)
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i, len(ids_of(t))].append(np.array(ids_of(t), "<u4"))
    assert got["length"].sum() == tokens
    if got["doc_id"].notna().all():
        assert set(by_row) == set(texts)
    for (i, _), own in texts.items():
        if i is None or len(own) > 1 or abs(i) > 2**53:
            continue
        at = 0
        for r in by_row[i, len(own[0])]:
            assert r.start == at and r.ids_crc32 == zlib.crc32(own[0][at : at + r.length].tobytes())
            at += r.length
        assert at == len(own[0])
    assert len(want) == len({(r[0], zlib.crc32(np.array(ids_of(r[1]), "<u4").tobytes())) for r in rows})
    full, short = 0, []
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s["offset"].to_numpy() == np.append(0, np.cumsum(s["length"].to_numpy())[:-1])).all()
        total = int(s["length"].sum())
        full += total == size
        short += [total] * (total != size)
    assert full == tokens // size and sum(short) == tokens % size and all(n & (n - 1) == 0 for n in short) and len(short) == len(set(short))


def test_curve_order_puts_like_documents_together(spark):
    rng = random.Random(8)
    pools = [["".join(rng.choices("abcdefghijklm", k=3)) for _ in range(12)] for _ in range(6)]
    rows = [(i, words(rng, 60, pools[i % 6]), "en", "s") for i in range(240)]
    got = curvepack.pack_along_curve(frame(spark, rows), queries.tokenizer_file(), size=128).where("start = 0").orderBy("sequence_id", "offset").toPandas()
    topic = (got["doc_id"] % 6).to_numpy()
    assert (topic[1:] == topic[:-1]).mean() > 0.8  # by chance: 0.17
    assert (got["curve_key"].diff().dropna() >= 0).all()


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_hilbert_keys_walk_the_cube(dims, bits):
    points = np.stack([x.ravel() for x in np.indices((1 << bits,) * dims)], axis=1)
    keys = curvepack.hilbert_keys(points, bits)
    assert sorted(keys.tolist()) == list(range(len(points)))
    steps = np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_sequence_cuts():
    for n in (0, 1, 15, 16, 17, 100, 4096):
        full, rest = curvepack.sequence_cuts(n, 16)
        assert full == n // 16 * 16 and rest[0] == full and rest[-1] == n
        assert all(x & (x - 1) == 0 for x in np.diff(rest).tolist())


def test_curve_packing_of_nothing(spark):
    assert curvepack.pack_along_curve(frame(spark, []), queries.tokenizer_file()).count() == 0
    got = curvepack.pack_along_curve(frame(spark, [(1, None, None, None)]), queries.tokenizer_file()).collect()
    assert [(r["doc_id"], r["start"], r["length"], r["offset"], r["ids_crc32"]) for r in got] == [(1, 0, 1, 0, zlib.crc32(b"\x01\0\0\0"))]


# ---- alignment of tokenizers

A, B = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")


@functools.cache
def tokenizers():
    return align.Both(A, B)


def slow_tokens(text):
    """Byte strings and ids of both tokenizers over the whole text; none where they don't give it back."""
    both = tokenizers()
    if not text:
        return [], []
    raw = (" " + text).encode()
    a = both.a.encode(" " + text, add_special_tokens=False).ids
    b = both.b.encode(text)
    x, y = ([t.joined(np.array([i])).tobytes() for i in ids] for ids, t in ((a, both.a_bytes), (b, both.b_bytes)))
    if b"".join(x) != raw or b"".join(y) != raw:
        return [], []
    return list(zip(a, x, strict=True)), list(zip(b, y, strict=True))


def slow_alignment(texts):
    rows, counts = [], Counter()
    for text in texts:
        a, b = slow_tokens(text)
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, s in side:
                own.append((at, at + len(s), i))
                at += len(s)
            spans.append(own)
        links = [(p[2], q[2]) for p in spans[0] for q in spans[1] if p[0] < q[1] and q[0] < p[1]]
        counts.update(links)
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, last = [], 0
        for e in common:
            groups.append("|".join(",".join(str(i) for s, t, i in side if last <= s and t <= e) for side in spans))
            last = e
        rows.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(na, nb, len(g), len(li), sum(counts[x] == most[x[1]] for x in li), sum(counts[x] for x in li), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for na, nb, g, li in rows]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_alignment_against_brute_force(spark, most):
    rows = [*corpus(), (77, "x" * 3000 + " " + "ab " * 500, "en", "s0")]
    got = align.align_tokenizers(frame(spark, rows).repartition(3), A, B, most_broadcast=most).select("doc_id", *COLUMNS).collect()
    want = [(r[0], *x) for r, x in zip(rows, slow_alignment([r[1] for r in rows]), strict=True)]
    assert Counter(tuple(r) for r in got) == Counter(want)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=" \n\n\r\t\x00a'sB\u00e9\u00d7\xa0\u2003\u3000\x85\u6f22\u01521,.<0xA>\u00bb", max_size=40))
def test_units_are_the_tokens_of_whole_texts(text):
    both = tokenizers()
    if not text:
        return
    part = next(T.slices(pa.array([text])))
    buf, start, end, _ = align.spaced_units(part)
    assert buf.tobytes() == (" " + text).encode()
    units = [buf[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    own, other = both.encode(units)
    assert [i for x in own for i in x] == both.a.encode(" " + text, add_special_tokens=False).ids
    assert [i for x in other for i in x] == both.b.encode(text)
    order, x, good = both.aligned(units)
    assert sorted(order) == list(range(len(units))) and good.all()
    for n, k in enumerate(order):
        assert x.a[x.a_first[n] : x.a_first[n + 1]].tolist() == own[k] and x.b[x.b_first[n] : x.b_first[n + 1]].tolist() == other[k]


def test_gustavson_against_dense():
    rng = np.random.default_rng(5)
    x, y = (rng.integers(0, 2, s) for s in ((40, 30), (30, 25)))
    csr = [align.Csr(np.append(0, np.cumsum(m.sum(axis=1))), np.nonzero(m)[1], m.shape[1]) for m in (x, y)]
    got = np.zeros((40, 25), int)
    for i, j, v in csr[0].product(csr[1]):
        got[i, j] = v
    assert (got == x @ y).all()
    t = csr[0].transpose()
    assert (t.indptr == np.append(0, np.cumsum(x.sum(axis=0)))).all() and (t.indices == np.nonzero(x.T)[1]).all()


def test_links_of_both_kinds(spark):
    rows = [(1, "unbelievable tokenisation of 漢字", "en", "s"), (2, None, "en", "s")]
    a, b = slow_tokens(rows[0][1])
    ends = [np.cumsum([len(s) for _, s in x]) for x in (a, b)]
    begins = [e - [len(s) for _, s in x] for e, x in zip(ends, (a, b), strict=True)]
    shared = {(i, j): min(ends[0][i], ends[1][j]) - max(begins[0][i], begins[1][j]) for i in range(len(a)) for j in range(len(b))}
    got = align.alignment_links(frame(spark, rows), A, B).collect()
    assert {(r["a_index"], r["b_index"]): r["value"] for r in got} == {k: v for k, v in shared.items() if v > 0}
    groups = np.intersect1d(*ends)
    same = {(i, j) for i in range(len(a)) for j in range(len(b)) if np.searchsorted(groups, ends[0][i]) == np.searchsorted(groups, ends[1][j])}
    assert {(r["a_index"], r["b_index"]) for r in align.alignment_links(frame(spark, rows), A, B, kind="group").collect()} == same
    assert align.align_tokenizers(frame(spark, rows), A, B).where("doc_id = 1").first()["n_shared"] == len(same)


def test_alignment_of_nothing_and_with_a_full_table(spark, monkeypatch):
    assert align.align_tokenizers(frame(spark, []), A, B).count() == 0
    monkeypatch.setattr(align, "MOST_UNITS", 20)
    texts = [r[1] for r in corpus()]
    table = align.UnitTable(A, B, None, True)
    total = Counter()
    for t in texts:
        part = next(T.slices(pa.array([t], pa.string())))
        occurs = np.zeros(1 << 16, np.int64)

        def flush(occurs=occurs):
            pass

        p = align._parts(table, part, flush)
        occurs[: table.n] = np.bincount(p.unit[np.repeat(p.good, np.diff(p.first))], minlength=table.n)
        code, n = table.pairs(occurs[: table.n])
        total.update(dict(zip(code.tolist(), n.tolist(), strict=True)))
    assert sum(total.values()) == sum(x[3] for x in slow_alignment(texts))


# ---- divergence of sources


def duck_rows(rows):
    con = duckdb.connect()
    con.register("documents", pa.table([pa.array([r[k] for r in rows]) for k in range(4)], ["doc_id", "text", "lang", "source"]))
    return con


@pytest.mark.parametrize("shard_rows", [200_000, 7])
def test_divergence_against_sql(spark, shard_rows):
    rows = corpus(n=200)
    want = duck_rows(rows).sql(queries.OP13_SQL).fetchall()
    got = divergence.source_divergence(frame(spark, rows).repartition(3), shard_rows=shard_rows).collect()
    assert any(r[2] == "term" for r in want) and any(r[0] == "" for r in want)
    assert sorted(map(tuple, got)) == sorted(want)


def test_divergence_hands_counts_on_when_there_are_many(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_SLICE", 200)
    rows = corpus(n=80)
    whole = divergence._merged([divergence._slice_counts(*(pa.array([r[k] or "" for r in rows], pa.large_string()) for k in (2, 3, 1)))]).to_pylist()
    cut = divergence._merged([divergence._slice_counts(*(pa.array([r[k] or ""], pa.large_string()) for k in (2, 3, 1))) for r in rows if any(c.isalpha() for c in r[1] or "")]).to_pylist()
    key = lambda r: tuple(r.values())
    assert sorted(whole, key=key) == sorted(cut, key=key)
    seen = Counter(x for r in rows for x in {(r[2] or "", r[3] or "", w) for w in ["ra"] if "ra" in (r[1] or "").split()})
    assert all(any(x["lang"] == la and x["source"] == so and x["term"] == w and x["df"] == n for x in whole) for (la, so, w), n in seen.items())


def test_divergence_of_huge_counts_is_exact():
    n, size = np.array([5 * 10**12, 3, 0]), 7 * 10**13 + 1
    assert divergence._share(n, size).tolist() == [1 + 10**9 * (x + 2) // size for x in n.tolist()]


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(frame(spark, [])).count() == 0
    got = divergence.source_divergence(frame(spark, [(1, None, None, None), (2, "a", None, "s")])).collect()
    assert sorted(map(tuple, got)) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]
