"""Operators 11 to 13 against brute force and on awkward tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rangeloom.llm import alignment, fill_middle, learned_partitions, queries

FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
LONG = " ".join(f"w{i % 977}" for i in range(40_000))
TEXTS = [None, "", " ", "Hello there  big\n\nworld", "a ▁ b", "<|endoftext|> <s> </s> <0x41>", "it's 12,345.67!  ", "\ttab\x0b and\x1c 　 wide​", "日本語 😀 é ﬁ", "a\x00b ﻿c", "x" * 5000, "line one\nline two", "▁", "a▁b c", "it'll 9,9 🇫🇷👩‍👩‍👧 ok", LONG, "café naïve", " a \xa0b \x85 c", "Hello there  big\n\nworld"]
ODD = "doc_id long, text string, row long, pair long, n int, key string, h1 int, form string, cut_1 int, links int, best int"


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward texts, repeated and missing ids, clashing column names."""
    ids = [*range(len(TEXTS) - 2), None, 3]
    return spark.createDataFrame([(i, t, 1, 2, 3, "k", 4, "f", 5, 6, 7) for i, t in zip(ids, TEXTS, strict=True)], ODD).repartition(3)


def brute_alignment(rows):
    """Rows of the alignment of (id, text) by whole encodings and plain loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    shown = alignment._byte_letters()
    to_byte = {c: i for i, c in enumerate(shown)}
    found, total = [], Counter()
    for i, text in rows:
        whole = (" " + (text or "")).encode()
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(to_byte[c] for c in a.id_to_token(x)) for x in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found.append((i, 0, 0, [], [], 0))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        shared, groups, la, lb = sorted(set(ends_a) & set(ends_b)), [], 0, 0
        for end in shared:
            ga = [x for x, e in zip(ids_a[la:], ends_a[la:], strict=True) if e <= end]
            gb = [x for x, e in zip(ids_b[lb:], ends_b[lb:], strict=True) if e <= end]
            groups.append((ga, gb))
            la, lb = la + len(ga), lb + len(gb)
        by_end = dict(zip(ends_b, ids_b, strict=True))
        links = [(x, by_end[e]) for x, e in zip(ids_a, ends_a, strict=True) if e in by_end]
        total.update(links)
        found.append((i, len(ids_a), len(ids_b), groups, links, len(set(ends_a) | set(ends_b))))
    most = Counter()
    for (_, y), n in total.items():
        most[y] = max(most[y], n)
    shown = lambda groups: hashlib.sha256(";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups).encode()).hexdigest() if groups else ""
    return Counter((i, na, nb, len(g), len(li), sum(total[x] == most[x[1]] for x in li), sum(total[x] for x in li), shown(g), n, sum(len(x) * len(y) for x, y in g)) for i, na, nb, g, li, n in found)


def aligned(df, **how):
    return Counter(tuple(r) for r in alignment.align_tokenizers(df, *FILES, **how).collect())


def small_brute(rows):
    """``brute_alignment`` without the quadratic slices of very long texts."""
    return brute_alignment([r for r in rows if len(r[1] or "") < 20_000])


@pytest.mark.parametrize("broadcast_pairs", [0, 10**6])
@pytest.mark.parametrize("memo", [0, 3, 10**6])
def test_alignment_of_odd_rows(odd, broadcast_pairs, memo, monkeypatch):
    monkeypatch.setattr(alignment, "_MEMO_ENTRIES", memo)
    table = odd.where(F.length("text").isNull() | (F.length("text") < 20_000))
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    assert aligned(table, broadcast_pairs=broadcast_pairs) == brute_alignment(rows)


def test_alignment_memo_keeps_its_bound():
    few, all_ = alignment.Aligner(*FILES, memo=5), alignment.Aligner(*FILES)
    for texts in (["one two three", "two  three", None], ["four five six seven eight", "one nine"], ["one two", "ten eleven \n twelve", "x ▁"]):
        for a, b in zip(few.align(texts), all_.align(texts), strict=True):
            assert a[:7] == b[:7] and a[7].tolist() == b[7].tolist() and a[8].tolist() == b[8].tolist()
        assert len(few.known) <= 5 and len(few.text) == len(few.numbers) == len(few.known) == len(few.bad) and len(few.pairs) == few.numbers[:, 2].sum()


def test_alignment_query_equals_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in queries.op11_token_alignment(spark, data).collect())
    assert got == brute_alignment(rows)


def test_alignment_of_long_and_empty_tables(odd):
    row = next(r for r in alignment.align_tokenizers(odd.where(F.length("text") > 20_000), *FILES).collect())
    assert row.n_groups >= 40_000 and row.n_links == row.n_groups <= row.n_overlaps and row.n_best <= row.n_links
    assert aligned(odd.limit(0)) == Counter()


def test_group_products_are_all_pairs_of_each_group():
    ends_a, ends_b = np.array([2, 5, 6, 9]), np.array([3, 5, 7, 8, 9])
    one, two = alignment.group_products(ends_a, ends_b)
    assert sorted(zip(one.tolist(), two.tolist(), strict=True)) == [(a, b) for a in (0, 1) for b in (0, 1)] + [(a, b) for a in (2, 3) for b in (2, 3, 4)]
    cuts, a, b, both = alignment.intervals(ends_a, ends_b)
    assert cuts.tolist() == [2, 3, 5, 6, 7, 8, 9] and a.tolist() == [0, 1, 1, 2, 3, 3, 3] and b.tolist() == [0, 0, 1, 2, 2, 3, 4] and both.tolist() == [False, False, True, False, False, False, True]


def brute_fill(i, text):
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    key = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(key[8 * j : 8 * j + 8], 16) for j in range(4)]
    n = len(tokens)
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (tokens[:one], tokens[one:two], tokens[two:]))
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk_bytes", [1, 2, 7, fill_middle.CHUNK_BYTES])
def test_fill_middle_equals_brute_force(spark, odd, chunk_bytes):
    texts = [*TEXTS, "a <P> b", "<<S", "x<M", "<P", " \t ", "end ", "\x1c\x1d", "é\x0bü  ö "] * 6
    if chunk_bytes < 7:
        texts = [t for t in texts if len(t or "") < 6000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id here at all"), (5, "again"), (-3, "less than none")]
    table = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, n int, form string").repartition(3)
    got = Counter(tuple(r) for r in fill_middle.fill_middle(table, chunk_bytes=chunk_bytes).collect())
    assert got == Counter((i, *brute_fill(i, t)) for i, t in rows)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(table.limit(0)).count() == 0


def test_fill_middle_query_equals_brute_force(spark, data):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    want = Counter((i, *(x := brute_fill(i, t))[:4], sha(x[4]), sha(t or "")) for i, t in rows)
    assert Counter(tuple(r) for r in queries.op13_fill_middle(spark, data).collect()) == want


def brute_nearest(rows, asked, k=20):
    """{id: [(id, score), ...]} by comparing every pair of the rows (id, vector)."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = {}
    for i in asked:
        score = x @ x[ids == i][0]
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def check_rows(rows, want):
    """Ranks and scores are right for what was found; gives the recall."""
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {q for q, w in want.items() if w}
    hit = all_ = 0
    for q, found in got.items():
        assert [r.rank for r in found] == list(range(1, len(want[q]) + 1))
        assert all((a.score, -a.vec_id) > (b.score, -b.vec_id) for a, b in zip(found, found[1:], strict=False))
        true = dict(want[q])
        assert all(r.score == pytest.approx(true[r.vec_id], abs=1e-12) for r in found if r.vec_id in true)
        hit, all_ = hit + sum(r.vec_id in true for r in found), all_ + len(found)
    return hit / all_


def test_nearest_query_recall(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = queries.op12_learned_partitions(spark, data).collect()
    assert check_rows(found, brute_nearest(rows, [i for i, _ in rows if i % 20 == 0])) >= 0.9


@pytest.mark.parametrize("block", [100, 8192])
def test_nearest_in_clusters_visits_few_parts(spark, block):
    rng = np.random.default_rng(3)
    middles = rng.standard_normal((12, 16)) * 3
    x = middles[rng.integers(0, 12, 3000)] + 0.3 * rng.standard_normal((3000, 16))
    x[7] *= 1.5
    x[2000:2900] = x[7]  # a group of copies with almost a third of the rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame([(i, v, 0, "p") for i, v in rows], "vec_id long, embedding array<double>, row int, part string").repartition(5)
    found = learned_partitions.nearest_by_partitions(table, F.col("id") % 20 == 0, part_rows=200, block=block).collect()
    assert check_rows(found, brute_nearest(rows, range(0, 3000, 20))) >= 0.9
    assert found[0].visits <= 8  # of 16
    of_copy = sorted((r for r in found if r.query_id == 2500), key=lambda r: r.rank)
    assert [r.vec_id for r in of_copy] == [7, *range(2000, 2019)]


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (20, [2.0, 0.0]), (1, [3.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [9.0, 9.0]), (40, None), (8, [-1.0, 5.0, 0.0])]
    table = spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, label string, id int, vector double")
    got = learned_partitions.nearest_by_partitions(table, F.col("id") % 20 == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == [(1, 1, 3.0), (2, 20, 2.0), (3, 20, 0.5), (4, 8, -1.0)]
    assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == 20) == [(1, 1, 6.0), (1, 8, 2.0), (2, 0, 2.0), (2, 1, 1.5), (3, 0, 0.5), (3, 8, -2.0)]
    assert {r.query_id for r in got} == {0, 20}
    for empty in (table.limit(0), table.where("vec_id in (2, 4)")):
        assert learned_partitions.nearest_by_partitions(empty, F.col("id") % 20 == 0).count() == 0
    assert learned_partitions.nearest_by_partitions(table.where("vec_id = 0"), F.col("id") % 20 == 0).count() == 0


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((8, 10))[np.arange(800) % 8] * 4 + 0.2 * rng.standard_normal((800, 10))
    graph = learned_partitions.neighbour_graph(x / np.linalg.norm(x, axis=1, keepdims=True))
    part = learned_partitions.balanced_parts(graph, 8)
    assert np.bincount(part, minlength=8).max() <= 105
    cut = (part[np.repeat(np.arange(800), graph.shape[1])] != part[graph.ravel()]).mean()
    assert cut < 0.25
