"""The numbered operators against brute force and on awkward tables."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from rangeloom.llm import images, language, mixing, packing, quality, queries, simhash, substring, token_output, urls, vectors

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Beside the columns of documents, names that operators use inside or give out.
CLASHING = ("_language", "_first", "mix_size", "_turn", "_cut", "_cut_size", "_lang", "_fits", "row", "c0", "tag", "runs", "_row")
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, id string, bin_id int, node int, " + ", ".join(f"{c} int" for c in CLASHING)
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names clash with working ones."""
    rest = (0.5, 1, "x", 2, 3, *range(70, 70 + len(CLASHING)))
    rows = [(1, "Hello there big world", "en", "a", 4), (1, "Hello there big world", "en", "a", 4), (1, "other words here", "fr", "b", 1), (2, None, None, None, None), (None, "no id at all", "en", "a", 3),
            (3, "", "en", "b", 0), (4, " \t\n", None, "b", 3), (5, LONG, "en", None, 9), (6, LONG + " tail", "en", "a", 9), (None, None, None, None, None), (7, "日本語 😀 \x1c x", "ja", "c", 2)]
    return spark.createDataFrame([(*r, *rest) for r in rows], DOC)


@pytest.fixture(scope="module")
def docs(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    return sorted(((r.doc_id, r.text, r.lang, r.source) for r in rows), key=lambda r: r[0])


def words(text):
    return WORDS.findall((text or "").encode())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(name, same_rows):
    same_rows(queries.queries()[name], queries.oracle_sql()[name])


def test_tokens_equal_whole_encoding(spark, data, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, {}
    for i, text, *_ in docs:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op1_token_output(spark, data).collect()} == want


def test_tokens_of_odd_rows(spark, odd, tmp_path):
    token_output.write_tokens(token_output.encode_documents(odd, public_tokenizers.path("word_bpe_49k.json"), 1), str(tmp_path / "t"))
    rows = token_output.read_tokens(spark, str(tmp_path / "t")).collect()
    assert len(rows) == odd.count()
    assert sorted(r.start for r in rows) == np.cumsum([0, *(r.n_tokens for r in sorted(rows, key=lambda r: r.start))])[:-1].tolist()
    assert Counter(len(r.tokens) for r in rows if r.doc_id in (2, 3, 4)) == {1: 3}
    token_output.write_tokens(token_output.encode_documents(odd.limit(0), public_tokenizers.path("word_bpe_49k.json"), 1), str(tmp_path / "e"))
    assert token_output.token_digest(token_output.read_tokens(spark, str(tmp_path / "e"))).count() == 0


def brute_simhash(rows):
    """{id: (fingerprint, smallest id reachable)} of rows (id, text)."""
    prints = {}
    for i, text in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[a : a + 3]), 42) for a in range(max(1, len(w) - 2))] if w else []
        prints[i] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    low = {i: i for i in prints}
    for _ in prints:
        new = {i: min(low[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2) for i in prints}
        if new == low:
            break
        low = new
    return {i: (f"{prints[i]:016x}", low[i]) for i in prints}


def test_simhash_equals_brute_force(spark, data, docs):
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash_pivots(spark, data).collect()} == brute_simhash([(i, t) for i, t, *_ in docs])


@pytest.mark.parametrize("bucket_rows", [1, 3, 1000])
@pytest.mark.parametrize("max_bits", [0, 2, 3])
def test_fingerprint_links_small_and_large_buckets(spark, bucket_rows, max_bits):
    from rangeloom.operators.components import connected_components

    rng = np.random.default_rng(5)
    base = rng.integers(-(2**62), 2**62, 4)
    prints = sorted({int(b ^ (1 << int(i)) ^ (1 << int(j))) for b in base for i, j in rng.integers(0, 62, (12, 2))} | {0})
    nodes = spark.createDataFrame(list(enumerate(prints)), "node long, fp long")
    got = {r.node: r.component for r in connected_components(simhash.fingerprint_links(nodes, max_bits, bucket_rows)).collect()}
    low = list(range(len(prints)))
    for _ in prints:
        low = [min(low[b] for b, q in enumerate(prints) if ((p ^ q) & (2**64 - 1)).bit_count() <= max_bits) for p in prints]
    assert [got.get(i, i) for i in range(len(prints))] == low


def test_reference_distances_are_stored_and_bound_the_bits(spark):
    rng = np.random.default_rng(12)
    prints = rng.integers(-(2**63), 2**63 - 1, 200)
    prints[100:] = prints[:100] ^ (1 << rng.integers(0, 63, 100)) ^ (1 << rng.integers(0, 63, 100))
    rows = simhash.with_distances(spark.createDataFrame([(i, int(p)) for i, p in enumerate(prints)], "node long, fp long")).orderBy("node").collect()
    stored = [np.array([r[f"d{b}"] for r in rows]) for b in range(simhash.BLOCKS)]
    for i, p in enumerate(simhash.reference_fingerprints()):
        whole = sum((d >> (5 * i)) & 31 for d in stored)
        assert whole.tolist() == [((int(x) ^ p) & (2**64 - 1)).bit_count() for x in prints]
    one, two = np.triu_indices(200, 1)
    apart = np.bitwise_count(prints[one].view(np.uint64) ^ prints[two].view(np.uint64))
    for most in (0, 1, 2, 3):
        got = simhash.close_pairs(prints, stored, one, two, most)
        assert set(zip(*map(np.ndarray.tolist, got), strict=True)) == {(int(a), int(b)) for a, b, n in zip(one, two, apart, strict=True) if n <= most}


def test_simhash_odd_rows(odd):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.doc_id in (2, 3, 4)} == {2}
    kept = simhash.one_of_each_group(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect())[1] == 1 and kept.where("doc_id is null").count() == 2
    assert simhash.one_of_each_group(odd.limit(0)).count() == 0


def test_substring_equals_brute_force(spark, data, docs):
    seen, want = set(), {}
    for i, text, *_ in docs:
        w = words(text)
        gone = set()
        for a in range(len(w) - 19):
            key = tuple(w[a : a + 20])
            if key in seen:
                gone.update(range(a, a + 20))
            seen.add(key)
        kept = [x for n, x in enumerate(w) if n not in gone]
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    assert sum(v[1] for v in want.values())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op9_substring_suffix_trees(spark, data).collect()} == want


def removed_by_brute_force(rows, window=20):
    """n_removed of each of the rows (id, text) in order."""
    seen, out = set(), []
    for _, text in rows:
        w, gone = words(text), set()
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            if key in seen:
                gone.update(range(a, a + window))
            seen.add(key)
        out.append(len(gone))
    return out


@pytest.mark.parametrize("group_rows", [1, 7, 100_000])
def test_substring_groups_of_any_size(spark, group_rows):
    rng = np.random.default_rng(8)
    line = "one very common line of some words that many texts begin with"
    few = [f"w{i}" for i in range(6)]
    texts = [" ".join([*rng.choice(few, 30), line, *rng.choice(few, rng.integers(0, 60)), line, "a " * 30]) for _ in range(40)]
    texts += [texts[3], texts[5] + " tail", "a " * 200, " ".join(rng.choice(few, 500))]
    rows = list(enumerate(texts))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.n_removed for r in substring.remove_repeats(table, group_rows=group_rows).collect()}
    assert [got[i] for i, _ in rows] == removed_by_brute_force(rows)


def test_substring_compares_words_and_not_hashes(spark):
    thue = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    morse = "".join("ba"[i.bit_count() % 2] for i in range(1024))
    shared = " ".join(f"word{i}" for i in range(19))
    rows = [(1, f"{shared} {thue}"), (2, f"{shared} {morse}"), (3, f"{shared} {thue}")]
    got = {r.doc_id: r.n_removed for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 20}
    # Equal routing keys must not matter either: one group of different words.
    n = np.zeros(3, np.int64)
    found = substring.repeats_of_group(np.arange(1, 4), n, n, n + 1, n, b" ".join(r[1].encode() for r in rows), 20, 6)
    assert [x.tolist() for x in found] == [[3], [0], [0]]


def test_substring_largest_id_is_not_null(spark):
    text = " ".join(f"x{i}" for i in range(25))
    rows = [(2**63 - 1, text), (None, text), (None, text + " y")]
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got.values()) == 50 and got[(2**63 - 1, 25)] == 0


def test_substring_odd_rows(odd):
    rows = substring.remove_repeats(odd, keep=["source", "id", "node"]).collect()
    assert len(rows) == odd.count() and all(r.id == "x" and r.node == 3 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[2].text is None and by[3].text == "" and by[1].n_removed == 0
    assert by[5].n_removed == 60_000 - 977 and by[6].n_removed == 60_000 and by[6].text == "tail"
    assert substring.remove_repeats(odd.limit(0)).count() == 0


def test_language_held_out_accuracy(spark, data, docs):
    rows = {r.doc_id: r for r in queries.op6_language_id(spark, data).collect()}
    truth = [(rows[i].lang_pred, lang) for i, _, lang, _ in docs if rows[i].held_out]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= rows[i].score <= 1 for i, *_ in docs)
    assert sum(a == b for a, b in truth) >= 0.95 * len(truth)


def brute_phrases(text, sample):
    """Phrases of a greedy parse, and those of them that are letters the sample lacks."""
    n = lacking = 0
    while text:
        k = 1
        while k < len(text) and text[: k + 1] in sample:
            k += 1
        lacking += text[0] not in sample
        text, n = text[k:], n + 1
    return n, lacking


def brute_letters(text):
    kinds = [unicodedata.category(c)[0] for c in text.lower()]
    return " ".join("".join(c if k in "LM" else " " for c, k in zip(text.lower(), kinds, strict=True)).split()) if "L" in kinds else ""


@pytest.mark.parametrize("dense", [0, language._DENSE])
@pytest.mark.parametrize("lanes", [3, 8192])
def test_phrases_equal_brute_force(dense, lanes, monkeypatch):
    monkeypatch.setattr(language, "_LANES", lanes)
    monkeypatch.setattr(language, "_STEP", 16)
    rng = np.random.default_rng(5)
    samples = (("aa", "abracadabra arba " + "".join(rng.choice(list("ab c"), 200))), ("bb", "banana bandana nab"), ("cc", "aaaa" * 30))
    parser = language.Parser(samples, dense)
    texts = ["abra nab", "zzz", "banana", "a" * 700, "".join(rng.choice(list("ab cd"), 900)).strip(), "".join(rng.choice(list("aab"), 333)), samples[0][1] * 3, ""]
    codes, sizes = language.cleaned(texts)
    assert codes.tobytes().decode("utf-32-le") == "".join(map(brute_letters, texts)) and sizes.tolist() == [len(brute_letters(t)) for t in texts]
    counts, unseen = parser.parsed(codes, sizes)
    for row, lacking, text in zip(counts, unseen, texts, strict=True):
        assert list(zip(row.tolist(), lacking.tolist(), strict=True)) == [brute_phrases(brute_letters(text), sample) for _, sample in samples]


def test_language_query_equals_brute_force(spark, data, docs):
    samples = language.labelled_samples(spark.read.parquet(f"{data}/documents.parquet"))
    rows = {r.doc_id: r for r in queries.op6_language_id(spark, data).collect()}
    some = sorted(docs, key=lambda d: len(d[1] or ""))
    for i, text, *_ in some[:90:2] + some[-1:]:
        clean, costs = brute_letters(text or ""), []
        for _, sample in samples:
            n, lacking = brute_phrases(clean[:4000], sample) if len(clean) <= 4000 else (None, None)
            costs.append(None if n is None else (n - lacking) * np.log2(len(sample)) + lacking * np.log2(0x110000))
        if None in costs:
            continue
        if not clean:
            assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
            continue
        best = int(np.argmin(costs))
        assert rows[i].lang_pred == samples[best][0] and rows[i].score == pytest.approx(1 - costs[best] / min(c for j, c in enumerate(costs) if j != best))


def test_numbers_are_no_letters():
    parser = language.Parser((("en", "one half of it"), ("fr", "une moitié")))
    assert parser.predict(["½ ²", "Ⅷ ①", "\u0301", None, "", "12 _"])[0] == ["und"] * 6 and parser.predict(["half"])[0] == ["en"]


def test_every_language_teaches_whatever_its_ids(spark):
    rng = np.random.default_rng(4)
    words_of = {f"l{k:03d}": ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(30)] for k in range(60)}
    rows = [(None if i % 3 else 7, " ".join(rng.choice(words_of[lang], 40)), lang) for lang in words_of for i in range(6)]
    rows += [(None, "the same text again and again", "l000")] * 3000
    samples = language.labelled_samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"), letters_in_all=6000)
    assert [lang for lang, _ in samples] == sorted(words_of) and all(100 <= len(t) <= language.LEAST_LETTERS for _, t in samples)
    held = spark.createDataFrame([(None, f"{lang} {i}", lang) for i in range(4000) for lang in ("aa", "bb")], "doc_id long, text string, lang string")
    assert sum(len(t) for _, t in language.labelled_samples(held, letters_in_all=8000)) <= 8000


def test_language_odd_rows(odd):
    rows = language.with_language(odd, language.labelled_samples(odd)).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (2, 3, 4)} == {"und"} and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in language.with_language(odd, ()).collect()} == {"und"}
    assert language.with_language(odd.limit(0), language.labelled_samples(odd.limit(0))).count() == 0


def test_mix_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.mix_times <= 3 for r in rows)
    assert sum(r.mix_size * r.mix_times for r in rows) <= 2 * sum(r.mix_size for r in rows)
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0


def clashing(rows):
    """Whether every row still has the values of the clashing columns."""
    return all([r[c] for c in CLASHING] == list(range(70, 70 + len(CLASHING))) for r in rows)


def test_clashing_columns_stay_as_they_are(spark, odd, data):
    import corpus_pipeline

    assert clashing(simhash.one_of_each_group(odd).collect()) and clashing(mixing.mixed_documents(odd).collect())
    assert clashing(language.with_language(odd, language.labelled_samples(odd)).collect())
    assert all([r[c] for c in CLASHING if c != "mix_size"] == [70 + i for i, c in enumerate(CLASHING) if c != "mix_size"] for r in mixing.mix(odd).collect())
    for _, step in corpus_pipeline.STAGES[:-1]:
        done = step(spark, odd, data)
        assert done.columns == odd.columns and clashing(done.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, odd, data).count()


def test_token_files_have_small_groups_pages_indexes_and_encodings(spark, data, tmp_path):
    import pyarrow.parquet as pq

    # The writer looks at the size of a row group every hundred rows.
    many = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").crossJoin(spark.range(5).select(F.col("id").alias("copy")))
    coded = token_output.encode_documents(many, public_tokenizers.path("word_bpe_49k.json"), 1, partitions=2)
    token_output.write_tokens(coded, str(tmp_path / "t"), row_group_bytes=1 << 18, page_bytes=1 << 12)
    files = sorted((tmp_path / "t").glob("*.parquet"))
    assert len(files) == 2
    for f in files:
        meta = pq.ParquetFile(f).metadata
        assert meta.num_row_groups > 1
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(meta.num_columns)}
            tokens = columns["tokens.list.element"]
            assert tokens.has_offset_index and columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
            assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(tokens.encodings) and columns["doc_id"].statistics.has_min_max
            assert sum(c.total_compressed_size for n, c in columns.items() if not n.startswith("tokens")) < tokens.total_compressed_size
    plan = token_output.read_tokens(spark, str(tmp_path / "t")).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "tokens:" not in plan.split("ReadSchema", 1)[1].replace("n_tokens:", "")


def brute_best_fit(sizes, capacities):
    """(used, final capacity) of every bin, by search through all bins and all pieces."""
    bins, stamp = [], 0
    for at, s in enumerate(sizes):
        open_bins = [b for b in bins if b[0] >= s]
        if open_bins:
            best = max((b for b in open_bins if b[0] == min(o[0] for o in open_bins)), key=lambda b: b[2])
        else:
            prices = []
            for capacity in capacities:
                if capacity >= s:
                    room = capacity - s
                    for piece in sizes[at + 1 :]:
                        room -= piece if piece <= room else 0
                    prices.append((capacity / (capacity - room), -capacity))
            best = [-min(prices)[1], 0, 0]
            bins.append(best)
        stamp += 1
        best[0], best[1], best[2] = best[0] - s, best[1] + s, stamp
    return sorted((b[1], min(c for c in capacities if c >= b[1])) for b in bins)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    sizes = sorted(rng.integers(1, 60, 120).tolist(), reverse=True)
    bins, _, caps = packing.best_fit(sizes, [16, 32, 64])
    used = Counter()
    for b, s in zip(bins, sizes, strict=True):
        used[b] += s
    assert sorted((used[b], c) for b, c in enumerate(caps)) == brute_best_fit(sizes, [16, 32, 64])


def test_packing_query_equals_brute_force(spark, data, docs):
    """Shards by hashed id, whole sequences first, then the rests by best fit."""
    rows = queries.op5_best_fit_packing(spark, data).collect()
    hashes = {r.doc_id: r.h for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    sizes = {i: len(words(t)) for i, t, *_ in docs}
    assert len(sizes) <= packing.SHARD_ROWS and sorted(hashes) == sorted(sizes)
    rests = sorted((n % 4096 for n in sizes.values() if n % 4096), reverse=True)
    want = brute_best_fit(rests, packing.CAPACITIES) + [(4096, 4096)] * sum(n // 4096 for n in sizes.values())
    used, caps = Counter(), {}
    for r in rows:
        if r.bin_id is not None:
            used[r.bin_id] += r.n_words
            caps[r.bin_id] = r.capacity
    assert sorted((used[b], caps[b]) for b in used) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.start, r.n_words))
    assert all(sum(n for _, n in by[i]) == n and [a for a, _ in sorted(by[i])] == list(range(0, max(1, n), 4096)) for i, n in sizes.items())


def test_packing_places_every_word(spark, data, odd):
    pieces = packing.pack(odd).collect()
    assert Counter(r.doc_id for r in pieces if r.n_words == 0) == {2: 1, 3: 1, 4: 1, None: 1}
    assert sum(r.n_words for r in pieces) == sum(len(words(r.text)) for r in odd.collect())
    bins = {}
    for r in pieces:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_words
        assert at <= parts[0].capacity and parts[0].capacity == min(c for c in packing.CAPACITIES if c >= at)
    assert packing.pack(odd.limit(0)).count() == 0
    packed = packing.sequences(packing.pack(spark.read.parquet(f"{data}/documents.parquet"))).agg(F.sum("n_words"), F.sum("capacity")).first()
    assert packed[0] >= 0.97 * packed[1]


def test_best_fit_by_hand():
    assert packing.best_fit([6, 5, 4, 3], [8, 10]) == ([0, 1, 0, 1], [0, 0, 6, 5], [10, 8])
    assert packing.best_fit([], [8]) == ([], [], [])


def test_vectors_odd_rows(spark):
    v = [1.0] + [0.0] * 63
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, v, 2), (4, None, 1), (5, [0.0] * 64, 1), (6, [float("nan")] * 64, 1), (7, [None] * 64, 1), (None, v, 1), (8, v, None), (9, [2.0] + [0.0] * 63, 1), (10, [1.0], 1), (11, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)).withColumn("keys", F.lit(1))
    got = vectors.vector_groups(table).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert all(by[i].n_links == 3 and by[i].component_id == 1 for i in (1, 2, 9)) and by[1].kept and not by[2].kept
    assert all(by[i].n_links == 0 and by[i].kept for i in (3, 4, 5, 6, 7, 8, 10, 11)) and by[None].component_id is None and not by[None].kept
    assert vectors.vector_groups(table.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, 256])
def test_vector_recall(spark, block):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 64))
    x = np.concatenate([base + rng.normal(size=(30, 64)) * s for s in (0, 0.1, 0.25, 0.35)])
    table = spark.createDataFrame([(i, [float(np.float32(a)) for a in row], i % 30 % 2) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    same = (u @ u.T >= 0.93) & (np.arange(120)[:, None] % 2 == np.arange(120) % 2)
    want = same.sum(1) - 1
    got = np.array([r.n_links for r in vectors.vector_groups(table, block=block).orderBy("vec_id").collect()])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum() > 0


def test_urls(spark):
    pages = [(1, "HTTP://Www.Example.COM/en/7?x"), (2, "http://a.example.com/en/9"), (3, "https://b.net/de/1"), (4, "https://x.example.net/de/8#t"), (5, None), (6, "no scheme"), (7, "s://h"), (7, "s://h"), (None, "http://xcom/en/1")]
    pages += [(100 + i, f"http://bad.test/spam/{i}.html") for i in range(60)] + [(200 + i, f"http://bad.test/news/{i}") for i in range(60)]
    table = spark.createDataFrame(pages, "page_id long, url string").withColumn("path", F.lit("clash")).withColumn("template", F.lit(1))
    labels = spark.createDataFrame([(i, 1) for i in range(0, 0)] + [(None, 1), (5, None)], "key long, bad int")
    judged = lambda t, lab: urls.judge_urls(t, lab, queries.URL_RULES, support=5).collect()
    got = judged(table, labels)
    assert len(got) == len(pages)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[1] == ("www.example.com", "/en/7", "example.com/en/7", "allow") and by[2][2:] == ("com/en/", "block") and by[3][2:] == ("net/de/", "allow") and by[4][2:] == ("example.net/de/8", "block")
    assert by[5][:3] == ("", "", None) and by[6][:2] == ("", "") and by[7][:2] == ("h", "") and by[None][2] is None
    mixed = spark.createDataFrame([(f"http://bad.test/{'spam' if i % 2 else 'news'}/{i}.html", i) for i in range(120)], "url string, page_id long")
    taught = spark.createDataFrame([(i, i % 2) for i in range(120)], "key long, bad int")
    verdicts = judged(mixed, taught)
    assert all((r.verdict == "block") == ("/spam/" in r.path) for r in verdicts) and {r.template for r in verdicts} == {"/spam/*", "/news/*"}
    assert judged(table.limit(0), labels) == []


def test_quality_odd_and_planted(spark, odd):
    rng = np.random.default_rng(2)
    vocabulary = [f"word{i}" for i in range(200)]
    text = lambda bad: " ".join([*rng.choice(vocabulary, 40), *(["awful", "vile"] if bad else [])])
    planted = spark.createDataFrame([(i, text(i % 5 == 0), "y") for i in range(1000)], "doc_id long, text string, prior string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(500)] + [(None, 1, 1), (600, None, None)], "doc_id long, quality int, toxic int")
    sites = spark.createDataFrame([(i, f"h{i % 7}", "p") for i in range(900)] + [(3, "a", None), (None, "z", "z")], "doc_id long, host string, path string")
    rows = quality.quality_scores(planted, labels, sites).collect()
    assert len(rows) == 1000 and all(r.keep == (r.doc_id % 5 != 0) and 0 <= r.score <= 1 for r in rows)
    assert len(quality.quality_scores(odd, labels, sites).collect()) == odd.count()
    assert len(quality.quality_scores(odd, labels.limit(0), sites.limit(0)).collect()) == odd.count()
    assert quality.quality_scores(odd.limit(0), labels.limit(0), sites.limit(0)).count() == 0


def test_quality_equals_brute_force(spark, data, docs):
    """Tokens, evidence and posteriors of every document, counted again in Python."""
    texts = {i: t for i, t, *_ in docs}
    labels = {r.doc_id: int(r.quality == 0 or r.toxic == 1) for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    sites = {}
    for r in sorted(spark.read.parquet(f"{data}/pages.parquet").collect(), key=lambda r: r.page_id):
        rest = r.url.partition("://")[2]
        host, path = re.split("[/?#]", rest)[0].lower(), re.match("[^/?#]*([^?#]*)", rest)[1]
        number = re.search(r"/([0-9]{1,18})(?:\.[A-Za-z]+)?(?:/|$)", path)
        if number:
            site = (host, path.split("/")[1])
            sites[int(number[1])] = min(site, sites.get(int(number[1]), site))
    known = {i: b for i, b in labels.items() if i in texts}
    first = {}
    for i, b in known.items():
        first.setdefault(quality._signature(texts[i]), []).append((texts[i], b))
    assert all(len({t for t, _ in rows}) == 1 or len({b for _, b in rows}) == 1 for rows in first.values())
    fitted = [rows[0] for rows in first.values()]
    n, n_bad = len(fitted), sum(b for _, b in fitted)
    counts = {}
    for text, b in fitted:
        for t in quality.tokens(text):
            counts.setdefault(t, [0, 0])[b] += 1
    term = lambda x, y: x * np.log(x / y) if x else 0.0
    weights = {}
    for t, (good, bad) in counts.items():
        seen = good + bad
        ratio = 2 * (term(bad, seen * n_bad / n) + term(good, seen * (n - n_bad) / n) + (term(n_bad - bad, (n - seen) * n_bad / n) + term(n - n_bad - good, (n - seen) * (n - n_bad) / n) if seen < n else 0))
        odds = np.log(((bad + 0.5) / (n_bad + 1)) / ((good + 0.5) / (n - n_bad + 1)))
        if ratio >= 5 and abs(odds) >= quality.LEAST_ODDS:
            weights[t] = odds
    of = {i: sites.get(i, (None, None)) for i in texts}
    paths, hosts = {}, {}
    for i, b in known.items():
        for table, key in ((paths, of[i]), (hosts, of[i][0])):
            c = table.setdefault(key, [0, 0])
            c[0], c[1] = c[0] + 1, c[1] + b

    def strength(rows):
        total, squares = sum(r[0] for r in rows), sum(r[0] ** 2 for r in rows)
        found, chance = sum(m * (b / m - p) ** 2 for m, b, p in rows), sum(p * (1 - p) for *_, p in rows)
        if len(rows) < 2:
            return 10.0
        room = (total - squares / total) * chance / len(rows)
        between = max(0.0, (found - chance) / room) if room > 0 else 0.0
        return min(1000.0, max(1.0, 1 / between - 1)) if between > 0 else 1000.0

    overall = (sum(known.values()) + 1) / (len(known) + 2)
    m = strength([(c, b, overall) for c, b in hosts.values()])
    host_prior = lambda h, b=0, c=0: (hosts[h][1] - b + m * overall) / (hosts[h][0] - c + m) if h in hosts else overall
    k = strength([(c, b, host_prior(h)) for (h, _), (c, b) in paths.items()])
    table = lambda name: spark.read.parquet(f"{data}/{name}.parquet")
    site_rows = spark.createDataFrame([(i, *s) for i, s in sites.items()], "doc_id long, host string, path string")
    got = {r.doc_id: r for r in quality.quality_scores(table("documents"), table("labels"), site_rows, least_evidence=5.0).collect()}
    assert len(weights) > 3 and set(got) == set(texts)
    for i, text in texts.items():
        b, c = (known[i], 1) if i in known else (0, 0)
        prior = host_prior(of[i][0], b, c)
        if of[i] in paths:
            prior = (paths[of[i]][1] - b + k * prior) / (paths[of[i]][0] - c + k)
        told = float(np.clip(sum(weights.get(t, 0.0) for t in quality.tokens(text)), -quality.EVIDENCE_LIMIT, quality.EVIDENCE_LIMIT))
        assert got[i].evidence == pytest.approx(told, abs=1e-9) and got[i].prior == pytest.approx(prior, abs=1e-9)
        assert got[i].score == pytest.approx(1 / (1 + np.exp(np.log(prior / (1 - prior)) + told)), abs=1e-9) and (got[i].host, got[i].path) == of[i]


def test_fit_draws_rows_and_not_texts(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("one text")).otherwise(F.concat(F.lit("text "), "id")).alias("text"), (F.col("id") % 2).cast("int").alias("bad"))
    drawn = F.pmod(F.xxhash64("text", "doc_id", F.lit("fit")), F.lit(1 << 40)) / float(1 << 40)
    assert 300 <= rows.where(drawn < 0.1).count() <= 500
    assert quality.fit_evidence(rows, id_col="doc_id", fit_rows=400) == {}


def test_images(spark):
    rng = np.random.default_rng(3)
    pic = lambda seed: np.clip(images._resize(np.random.default_rng(seed).uniform(0, 255, (15, 18)), 8), 0, 255)
    made = {i: pic(i) for i in range(8)} | {100: pic(0)[10:110, 20:130], 101: pic(1) * 0.8 + 20, 102: np.rot90(pic(2)), 103: pic(3) + rng.normal(0, 4, pic(3).shape), 104: images._resize(pic(4), 0.75), 105: pic(5)}
    rows = [(i, a.shape[1], np.rint(np.clip(a, 0, 255)).astype(np.uint8).tobytes()) for i, a in made.items()]
    rows += [(None, 10, b"x" * 100), (200, None, b"abc"), (201, 7, b"abc"), (202, 1, b""), (203, 0, b"q"), (204, 4, None), (205, 40, bytes(1600))]
    table = spark.createDataFrame(rows, "image_id long, width int, pixels binary").withColumn("node", F.lit(1))
    got = images.image_groups(table).collect()
    by = {r.image_id: (r.n_copies, r.component_id) for r in got}
    assert len(got) == len(rows) and all(by[100 + i] == (1, i) for i in range(6)) and by[6] == (0, 6) and by[205] == (0, 205) and by[None] == (0, None)
    assert images.image_groups(table.limit(0)).count() == 0


def test_pipeline_stages_equal_brute_force(spark, data, docs):
    """Each stage on what its predecessor kept: fit of a language, SimHash groups, repeated windows, DuckDB's mixture, every word packed."""
    import duckdb

    import corpus_pipeline

    table = spark.read.parquet(f"{data}/documents.parquet")
    kept = table
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = sorted(((r.doc_id, r.text, r.source) for r in kept.collect()), key=lambda r: r[0])
        kept = step(spark, kept, data).cache()
        after = sorted((r.doc_id, r.text, r.n_chars) for r in kept.collect())
        assert kept.columns == table.columns, name
        if name == "language_id":
            samples = language.labelled_samples(table)
            fits = language.Parser(samples).judge([t for _, t, _ in before], language.usual_bits(samples))[3]
            assert [i for i, *_ in after] == [i for (i, *_), ok in zip(before, fits, strict=True) if ok]
        elif name == "near_duplicates":
            groups = brute_simhash([(i, t) for i, t, _ in before])
            assert [i for i, *_ in after] == [i for i, (_, low) in groups.items() if i == low] and len(after) < len(before)
        elif name == "repeated_passages":
            gone = removed_by_brute_force([(i, t) for i, t, _ in before])
            assert sum(gone) and [len(words(t)) for _, t, _ in after] == [len(words(t)) - n for (_, t, _), n in zip(before, gone, strict=True)]
            assert all(n == len(t) for (_, t, n), cut in zip(after, gone, strict=True) if cut)
        elif name == "source_mix":
            import pandas as pd

            con = duckdb.connect()
            con.register("documents", pd.DataFrame(before, columns=["doc_id", "text", "source"]))
            want = {r[0]: r[4] for r in con.execute(queries.oracle_sql()["op7_weighted_fair_mix"]).fetchall()}
            taken = Counter()
            for i, t, _ in after:
                taken[i] += len(words(t))
            assert all(taken[i] == n for i, n in want.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, data)
    assert packed.agg(F.sum("n_words")).first()[0] == sum(len(words(r.text)) for r in kept.collect())
    assert corpus_pipeline.run(spark, data).count() == packed.count()


def test_descriptor_matches(spark):
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (20, 256)).astype(bool)[np.arange(120) % 20]
    for row in bits[:60]:
        row[rng.choice(256, rng.integers(0, 10), replace=False)] ^= True
    words = [[int(w) for w in np.packbits(row).view(">i8").astype(np.int64)] for row in bits]
    corners = spark.createDataFrame([(i // 2, i % 2, *w) for i, w in enumerate(words)], "node long, corner int, w0 long, w1 long, w2 long, w3 long")
    apart = (bits[:, None] != bits[None]).sum(2)
    for most in (0, 3, 7):
        want = sorted((int(i) // 2, int(i) % 2, int(j) // 2, int(j) % 2) for i, j in zip(*np.nonzero(apart <= most), strict=True) if i // 2 < j // 2)
        assert want and sorted(map(tuple, images.descriptor_matches(corners, most, 64).collect())) == want


def test_images_that_share_a_corner_set(spark):
    """Two hundred different images with one set of corners: every pair is linked, as in brute force over all pairs."""
    patch = np.clip(images._resize(np.random.default_rng(9).uniform(0, 255, (12, 12)), 8), 0, 255)
    rows = []
    for i in range(200):
        made = np.zeros((120, 120))
        made[4:100, 4:100] = patch
        made[118, i % 119] = 1 + i
        rows.append((i, 120, np.rint(made).astype(np.uint8).tobytes()))
    got = images.image_groups(spark.createDataFrame(rows, "image_id long, width int, pixels binary")).collect()
    assert [(r.n_copies, r.component_id) for r in got] == [(199, 0)] * 200


@pytest.mark.parametrize("block_images", [3, 16, 256])
def test_links_of_a_crowd_are_no_rows(spark, monkeypatch, block_images):
    """Near copies in blocks of any size have the links of all pairs, and rows for images and blocks only, not for pairs of images or corners."""
    rng, held, staged = np.random.default_rng(21), images.stage, {}

    def counted(df, label):
        out = held(df, label)
        staged[label] = out.count()
        return out

    patch = np.clip(images._resize(rng.uniform(0, 255, (9, 9)), 8), 0, 255)
    made = [np.clip(patch + rng.normal(0, 0.5, patch.shape), 0, 255) for _ in range(40)] + [np.clip(images._resize(rng.uniform(0, 255, (9, 9)), 8), 0, 255) for _ in range(4)]
    made.append(np.rot90(made[40]))
    pictures = [np.rint(a).astype(np.uint8) for a in made]
    want = brute_image_links(pictures)
    assert len(want) == 40 * 39 // 2 + 1
    table = spark.createDataFrame([(i, p.shape[1], p.tobytes()) for i, p in enumerate(pictures)], "image_id long, width int, pixels binary")
    monkeypatch.setattr(images, "stage", counted)
    monkeypatch.setattr(images.image_links, "__defaults__", (block_images,))
    got = {r.image_id: (r.n_copies, r.component_id) for r in images.image_groups(table).collect()}
    degree = Counter(i for pair in want for i in pair)
    assert got == {i: (degree[i], 0 if i < 40 else 40 if i in (40, 44) else i) for i in range(45)}
    assert staged["image-links"] <= 45 * -(-45 // block_images) < 780


@pytest.mark.parametrize("few", [2, 16])
def test_near_descriptors_of_a_crowd_are_no_rows(spark, monkeypatch, few):
    """Crowded buckets give rows for entries and blocks, not for their near pairs, and the links are those of all pairs."""
    rng, held, staged = np.random.default_rng(22), images.stage, {}

    def counted(df, label):
        out = held(df, label)
        staged[label] = out.count()
        return out

    patch = np.clip(images._resize(rng.uniform(0, 255, (9, 9)), 8), 0, 255)
    pictures = [np.rint(np.clip(patch + rng.normal(0, 0.5, patch.shape), 0, 255)).astype(np.uint8) for _ in range(60)]
    pictures += [np.rint(np.clip(images._resize(rng.uniform(0, 255, (9, 9)), 8), 0, 255)).astype(np.uint8) for _ in range(4)]
    want = brute_image_links(pictures)
    table = spark.createDataFrame([(i, p.shape[1], p.tobytes()) for i, p in enumerate(pictures)], "image_id long, width int, pixels binary")
    monkeypatch.setattr(images, "stage", counted)
    monkeypatch.setattr(images.image_links, "__defaults__", (20,))
    monkeypatch.setattr(images.image_links, "__kwdefaults__", {"few": few})
    got = {r.image_id: r.n_copies for r in images.image_groups(table).collect()}
    degree = Counter(i for pair in want for i in pair)
    assert got == {i: degree[i] for i in range(64)}
    # Each entry meets fewer than ``few`` others in each of the tables, however many images there are.
    assert staged["near-descriptors"] <= staged["descriptors"] * (few - 1) * images.PARTS / 2
    assert staged["near-descriptors"] + staged["near-some"] + staged["crowds"] < len(want) * 2


def test_only_buckets_of_several_blocks_are_dealt_to_pairs(spark):
    """Rows of a bucket that is one block go to the join as they are, so no generator's rows follow the number of crowded buckets."""
    words = [f"w{i}" for i in range(images.WORDS)]
    rows = [(0, 1, 5, 0, i, *[0] * len(words)) for i in range(5)] + [(0, 2, 8, i % 2, 10 + i, *[0] * len(words)) for i in range(8)]
    dealt = spark.createDataFrame(rows, "tab byte, part long, n long, own int, entry long, " + ", ".join(f"{w} long" for w in words))
    every = F.sequence(F.lit(0), images._split(5) - 1)
    a, b = (images._paired(dealt, 5, images._with_own(every, first)) for first in (True, False))
    got = Counter((r.part, r.i, r.j) for r in a.collect())
    assert got == {(1, 0, 0): 5, **{(2, i, j): 4 for i in (0, 1) for j in (0, 1)}}
    assert Counter((r.part, r.i, r.j) for r in b.collect()) == got
    near = images._near_some(dealt, 7, 5)
    assert "> 5" in near._jdf.queryExecution().optimizedPlan().toString().split("Generate")[1].split("Generate")[0]
    assert near.count() == 13


def brute_image_links(pictures):
    """Pairs of places of pictures that are linked, from all pairs of corners of all pictures."""
    seen = [images.describe(p) for p in pictures]
    want = set()
    for i in range(len(pictures)):
        for j in range(i + 1, len(pictures)):
            (ax, ay, ascale, aturn, abits), (bx, by, bscale, bturn, bbits) = ([c.astype(np.float32) if c.dtype != bool else c for c in s] for s in (seen[i], seen[j]))
            votes = {}
            for a, b in zip(*np.nonzero((abits[:, None] != bbits[None]).sum(2) <= 7), strict=True):
                turn, ratio = float(bturn[b]) - float(aturn[a]), float(ascale[a]) / float(bscale[b])
                key = (int(np.floor(turn / (np.pi / 6) + 0.5)) % 12, int(np.floor(2 * np.log2(ratio) + 0.5)))
                dx = np.floor((bx[b] - ratio * (np.cos(turn) * ax[a] - np.sin(turn) * ay[a])) / 12)
                dy = np.floor((by[b] - ratio * (np.cos(turn) * ay[a] + np.sin(turn) * ax[a])) / 12)
                for x in (dx, dx + 1):
                    for y in (dy, dy + 1):
                        votes.setdefault((*key, x, y), set()).add(a)
            if any(len(v) >= 6 for v in votes.values()):
                want.add((i, j))
    return want


def test_image_links_equal_brute_force(spark, data):
    """Links of drawn vectors and planted edits against all pairs of corners of all images."""
    rng = np.random.default_rng(10)
    made = [np.clip(images._resize(np.random.default_rng(i).uniform(0, 255, (9, 9)), 8), 0, 255) for i in range(12)]
    made += [np.rot90(made[0]), made[1] + rng.normal(0, 3, made[1].shape), made[2][5:, 4:], made[3] * 0.7 + 10]
    rows = [(i, a.shape[1], np.rint(np.clip(a, 0, 255)).astype(np.uint8)) for i, a in enumerate(made)]
    want = brute_image_links([p for _, _, p in rows])
    assert want >= {(0, 12), (1, 13), (2, 14), (3, 15)}
    table = spark.createDataFrame([(i, w, p.tobytes()) for i, w, p in rows], "image_id long, width int, pixels binary")
    degree = Counter(i for pair in want for i in pair)
    assert {r.image_id: r.n_copies for r in images.image_groups(table).collect()} == {i: degree[i] for i in range(len(rows))}


@pytest.mark.parametrize("bucket_rows", [1, 4, 4096])
def test_crowded_buckets_equal_brute_force(spark, bucket_rows):
    rng = np.random.default_rng(4)
    bits = np.tile(rng.integers(0, 2, 256).astype(bool), (60, 1))
    for row in bits[:50]:
        row[rng.choice(256, rng.integers(0, 8), replace=False)] ^= True
    words = [[int(w) for w in np.packbits(row).view(">i8").astype(np.int64)] for row in bits]
    corners = spark.createDataFrame([(i // 2, i, *w) for i, w in enumerate(words)], "node long, corner int, w0 long, w1 long, w2 long, w3 long")
    apart = (bits[:, None] != bits[None]).sum(2)
    want = sorted((int(i) // 2, int(i), int(j) // 2, int(j)) for i, j in zip(*np.nonzero(apart <= 7), strict=True) if i // 2 < j // 2)
    assert sorted(map(tuple, images.descriptor_matches(corners, 7, bucket_rows).collect())) == want


def test_shouting_counts_the_whole_text():
    assert "\x00shout" not in quality.tokens("This.") | quality.tokens("De.") | quality.tokens("Die tz.")
    assert "\x00shout" in quality.tokens("SHOUTS " * 50) and "\x00shout" in quality.tokens("ÉCOLE été É")
    assert "\x00shout" in quality.tokens("aBCDEFG" * 50)


@pytest.mark.parametrize("dense", [0, language._DENSE])
def test_languages_of_many_letters(dense):
    rng = np.random.default_rng(6)
    scripts = {"han": (0x4E00, 900), "hangul": (0xAC00, 900), "kana": (0x3041, 80), "cyrillic": (0x430, 32), "latin": (0x61, 26)}
    made = {name: ["".join(chr(first + int(i)) for i in rng.integers(0, n, 3)) for _ in range(300)] for name, (first, n) in scripts.items()}
    text = lambda name, n: " ".join(rng.choice(made[name], n))
    samples = tuple((name, text(name, 2000)) for name in sorted(made)) + (("zz", "e"),)
    parser = language.Parser(samples, dense)
    assert all((t.table is None) == (dense == 0) for t in parser.tables)
    assert parser.predict([text(name, 20) for name in made])[0] == list(made)
    texts = [text("han", 9), text("latin", 9), text("han", 3) + "e" + text("kana", 3)]
    for row, t in zip(parser.parsed(*language.cleaned(texts))[0], texts, strict=True):
        assert row.tolist() == [brute_phrases(t, sample)[0] for _, sample in samples]


def test_pipeline_drops_what_fits_no_language(spark, data):
    import corpus_pipeline

    table = spark.read.parquet(f"{data}/documents.parquet")
    junk = ["".join(np.random.default_rng(7).choice(list("abcdefghijklmnopqrstuvwxyz    "), 300)), "привет мир как дела", "7844 !!"]
    short = ["De.", "Avec."]
    rows = [(-1 - i, t, None, "x", len(t)) for i, t in enumerate(junk + short)]
    more = table.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(c).cast(t).alias(c) for c, t in table.dtypes]))
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, more, data).select("doc_id").collect()}
    assert not kept & {-1, -2, -3} and kept >= {-4, -5}
    assert sum(r.doc_id in kept for r in table.select("doc_id").collect()) >= 0.98 * table.count()
    unknown = more.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.identify_language(spark, unknown, data).count() == more.count()


def test_siblings_merge_by_their_counts(spark):
    """Two bad branches alike to each other and unlike two good ones are one branch, and so are the good ones; what has no labels is the wildcard."""
    parts = {"spam": 0.9, "ads": 0.9, "news": 0.05, "blog": 0.05, "plain": None}
    rows, taught, n = [], [], 0
    for name, share in parts.items():
        for i in range(100):
            n += 1
            rows.append((n, f"http://h.test/{name}/{n}.html"))
            if share is not None:
                taught.append((n, int(i < 100 * share)))
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(taught, "key long, bad int")).collect()
    templates = {r.path.split("/")[1]: r.template for r in got}
    assert templates["spam"] == templates["ads"] != templates["news"] == templates["blog"] and templates["plain"] == "/*/*"
    assert all((r.verdict == "block") == (r.path.split("/")[1] in ("spam", "ads")) for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_urls_equal_sql_on_deep_paths(spark, seed):
    import duckdb

    rng = np.random.default_rng(seed)
    rows = [(i, f"https://{rng.choice(['a.test', 'b.test', 'C.example.com'])}/" + "/".join(rng.choice(["x", "y", "zz", "q1", "w"], rng.integers(0, 5))) + f"/{i}") for i in range(3000)] + [(-1, None), (-2, "x")]
    bad = lambda u: int("/x" in u) ^ int(rng.random() < 0.1)
    labels = [(i, 1, bad(u)) for i, u in rows[:2000]]
    con = duckdb.connect()
    import pandas as pd

    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url"]))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]))
    want = con.execute(queries.oracle_sql()["op8_path_templates"]).fetchall()
    taught = spark.createDataFrame([(i, t) for i, _, t in labels], "key long, bad int")
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), taught, queries.URL_RULES).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({r.template for r in got}) > 10


def test_urls_split_at_any_depth(spark):
    rows = [(i, f"http://deep.test/2024/05/12/news/{'spam' if i % 2 else 'politics'}/{i}.html") for i in range(120)] + [(500, "http://deep.test"), (501, "http://deep.test/2024")]
    taught = spark.createDataFrame([(i, i % 2) for i in range(120)], "key long, bad int")
    pages = spark.createDataFrame(rows, "page_id long, url string")
    assert [r.number for r in pages.where("page_id < 500").withColumn("path", urls.url_path("url")).orderBy("page_id").select(queries.page_number().alias("number")).collect()] == list(range(120))
    got = urls.judge_urls(pages, taught, key=queries.page_number(), support=5).collect()
    assert len(got) == len(rows)
    assert all((r.verdict == "block") == ("/spam/" in r.path) for r in got if r.page_id < 500)
    assert {r.template for r in got} == {"/*/*/*/*/spam/*", "/*/*/*/*/politics/*", "", "/*"}
    cut = {r.template for r in urls.judge_urls(pages, taught, key=queries.page_number(), support=5, depth=4).collect()}
    assert cut == {"/*/*/*/*/*", "", "/*"}


@pytest.mark.parametrize("lanes", [1, 2, 3, 7])
def test_language_parse_goes_on_over_groups_of_stretches(monkeypatch, lanes):
    """A text of more stretches than are parsed together, whatever is left for the last group, even a single one."""
    parser = language.Parser((("a", "the quick brown fox jumps over the lazy dog " * 3), ("b", "der schnelle braune fuchs springt " * 3)))
    texts = ["the lazy fox jumps " * 300, "", "der fuchs " * 57, None, "quick springt dog " * 200, "x" * 513]
    want = parser.judge(texts)
    monkeypatch.setattr(language, "_LANES", lanes)
    got = parser.judge(texts)
    assert got[0] == want[0] and np.array_equal(got[1], want[1]) and np.array_equal(got[2], want[2])


def test_urls_without_labels_are_allowed(spark):
    pages = spark.createDataFrame([(i, f"http://a.test/{i % 3}/{i}") for i in range(50)] + [(50, "http://b.com/en/1")], "page_id long, url string")
    got = urls.judge_urls(pages, spark.createDataFrame([], "key long, bad int"), queries.URL_RULES).collect()
    assert Counter(r.verdict for r in got) == {"allow": 50, "block": 1} and {r.purity for r in got} == {0.0}


def test_dates_are_no_labels(spark):
    """The year in a path is not the number of its document."""
    rows = [(i, f"http://a.test/2024/{'spam' if i % 2 else 'news'}/{i}.html") for i in range(200)]
    taught = spark.createDataFrame([(i, i % 2) for i in range(200)], "key long, bad int")
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("page_id", F.col("page_id") + 7000), taught, key=queries.page_number()).collect()
    assert all((r.verdict == "block") == ("/spam/" in r.path) for r in got)


def test_row_groups_end_by_bytes_whatever_the_rows(spark, tmp_path):
    """Documents of many ids each fill a row group each, and rows without an id are dealt out."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(1)
    text = " ".join(f"w{i}" for i in rng.integers(0, 10**6, 30_000))
    docs = spark.createDataFrame([(i, text) for i in range(12)], "doc_id long, text string")
    token_output.write_tokens(token_output.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1, partitions=1), str(tmp_path / "t"), row_group_bytes=256 << 10)
    (file,) = (tmp_path / "t").glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_row_groups == 12
    none = spark.createDataFrame([(None, f"{i} text") for i in range(900)], "doc_id long, text string")
    parts = Counter(r.part for r in token_output.encode_documents(none, public_tokenizers.path("word_bpe_49k.json"), 1, partitions=4).collect())
    assert len(parts) == 4 and max(parts.values()) < 450


def test_simhash_keeps_rows_with_nested_maps(spark):
    rows = [(1, "a b c d", ({"k": 1}, [1])), (1, "a b c d", ({"k": 2}, [0])), (2, "a b c d", (None, None)), (3, "other words of a text", (None, None)), (None, "x", (None, None))]
    table = spark.createDataFrame(rows, "doc_id long, text string, more struct<m: map<string,int>, l: array<int>>")
    assert sorted((r.doc_id for r in simhash.one_of_each_group(table).collect()), key=str) == [1, 3, None]


def test_language_replaces_names_in_any_case(spark):
    table = spark.createDataFrame([(1, "the text", 5)], "doc_id long, text string, LANG_PRED int")
    out = language.with_language(table, (("en", "the text of a language"),))
    assert out.columns == ["doc_id", "text", "lang_pred", "score"] and out.collect()[0].lang_pred == "en"


def test_vectors_link_by_labels_of_any_kind(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, "x"), (2, [1.01, 2.0, 3.0], "x"), (3, v, "y"), (4, v, None), (5, v, "x ")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5)}


def test_vector_links_among_thousands_equal_all_pairs(spark):
    """Planted near copies in thousands of vectors: links, counts and groups against all pairs."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((3000, 32))
    for i in range(0, 900, 3):
        x[i + 1] = x[i] + rng.uniform(0.05, 0.3) * rng.standard_normal(32)
        x[i + 2] = x[i]
    label = rng.integers(0, 2, 3000)
    label[:900] = np.repeat(label[:900:3], 3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None]) & ~np.eye(3000, dtype=bool)
    got = sorted(vectors.vector_groups(spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")).collect())
    found, want = sum(r.n_links for r in got), int(near.sum())
    assert want > 1000 and 0.97 * want <= found <= want
    assert all(r.n_links <= near[r.vec_id].sum() for r in got)


def test_packing_in_several_shards(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(n))) for i, n in enumerate(rng.integers(0, 900, 700))]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), shard_rows=50).collect()
    assert sum(r.n_words for r in got) == sum(len(t.split()) for _, t in rows)
    filled = Counter()
    for r in got:
        filled[r.bin_id] += r.n_words
    capacity = {r.bin_id: r.capacity for r in got}
    assert all(filled[b] <= capacity[b] for b in filled)


def test_image_query_equals_brute_force(spark, tmp_path):
    """The query over vectors of which some are equal, nearly equal or scaled, against all pairs of their pictures."""
    rng = np.random.default_rng(13)
    x = rng.standard_normal((24, 64))
    x[20], x[21], x[22] = x[3], x[4] + 0.02 * rng.standard_normal(64), 0.5 * x[5]
    table = spark.createDataFrame([(100 + i, v.tolist(), 1) for i, v in enumerate(x)] + [(200, None, 1)], "vec_id long, embedding array<float>, label int")
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    drawn = {r.image_id: np.frombuffer(r.pixels, np.uint8).reshape(-1, r.width) for r in images.vector_images(table).collect() if r.pixels is not None}
    links = brute_image_links([drawn[100 + i] for i in range(24)]) | {(i, j) for i in range(24) for j in range(i + 1, 24) if np.array_equal(drawn[100 + i], drawn[100 + j])}
    assert links >= {(3, 20), (4, 21), (5, 22)}
    degree = Counter(i for pair in links for i in pair)
    got = {r.image_id: (r.n_copies, r.component_id) for r in queries.op3_image_copies(spark, str(tmp_path)).collect()}
    assert {i: n for i, (n, _) in got.items()} == {100 + i: degree[i] for i in range(24)} | {200: 0}
    assert (got[120][1], got[121][1], got[122][1], got[200][1]) == (103, 104, 105, 200)
