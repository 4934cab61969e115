"""Repeats, near duplicates and the pipeline against brute force."""

import hashlib
import os
import re
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline  # noqa: F401
from rangegrid.llm import near, packing, quality, repeats
from rangegrid.llm.components import components
from tests.llm.helpers import SMALL, docs_of, odd_documents, words


def repeats_by_hand(docs, least):
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + least] for _, b in texts for i in range(len(b) - least + 1))
    out = []
    for d, b in texts:
        mark = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                mark[i : i + least] = b"\1" * least
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out.append((d, len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("make, least, anchor", [(docs_of, 200, 40), (odd_documents, 200, 40), (odd_documents, 20, 5)])
def test_repeats(spark, make, least, anchor):
    docs = make(spark)
    got = repeats.dedup(docs, least=least, anchor=anchor).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == repeats_by_hand([(r.doc_id, r.text) for r in docs.collect()], least)
    assert repeats.dedup(docs.limit(0)).count() == 0


def overlapping_texts():
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abé"), 4000))
    rows = []
    for k in range(60):
        a, n = int(rng.integers(0, 3000)), int(rng.integers(0, 900))
        rows.append((k % 50, base[a : a + n] + "".join(rng.choice(list("xyz"), 30)) + base[: int(rng.integers(0, 300))]))
    return rows


@pytest.mark.parametrize("most, spread", [(8000, 200_000), (3, 200_000), (8000, 4), (2, 1)])
def test_repeats_random(spark, most, spread):
    """Whether an anchor's contexts meet in a task, are left over by it, or are spread from the start, results are the same."""
    rows = overlapping_texts()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = repeats.dedup(df, most=most, spread=spread).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == repeats_by_hand(rows, 200)


def places_of(texts, s):
    out = set()
    for d, b in texts.items():
        at = b.find(s)
        while at >= 0:
            out.add((d, at))
            at = b.find(s, at + 1)
    return out


def grouped(df, **how):
    out = defaultdict(list)
    for r in repeats.groups(df, **how).collect():
        out[r.group_id, r.length].append((r.doc_id, r.place))
    assert len({g for g, _ in out}) == len(out)
    return {k[1:] + (tuple(sorted(v)),) for k, v in out.items()}


@pytest.mark.parametrize("most, spread", [(8000, 200_000), (3, 200_000), (2, 1)])
def test_groups_have_all_occurrences_of_the_corpus(spark, most, spread):
    rows = [(k, t) for k, (_, t) in enumerate(overlapping_texts())]
    texts = {d: t.encode() for d, t in rows}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = grouped(df, most=most, spread=spread)
    cover = {d: bytearray(len(b)) for d, b in texts.items()}
    for length, at in found:
        assert length >= 200 and len(at) == len(set(at)) > 1
        d, p = at[0]
        assert set(at) == places_of(texts, texts[d][p : p + length])
        for d, p in at:
            cover[d][p : p + length] = b"\1" * length
    assert {r.doc_id: r.n_removed for r in repeats.dedup(df).collect()} == {d: sum(c) for d, c in cover.items()}
    assert repeats.groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("most, spread", [(8000, 200_000), (2, 1)])
def test_groups_of_passages_are_the_maximal_repeats(spark, most, spread):
    rng = np.random.default_rng(9)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    prose = lambda n: "".join(rng.choice(letters, n))
    passages = [prose(n) for n in (200, 203, 450, 2500, 9000)]
    texts, want = defaultdict(str), defaultdict(set)
    for k in range(40):
        for _ in range(3):
            p = int(rng.integers(0, 5))
            edge = chr(33 + len(want[p]))  # no two occurrences have the same letter before or after
            texts[k] += prose(int(rng.integers(5, 300))) + edge
            want[p].add((k, len(texts[k])))
            texts[k] += passages[p] + edge
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = grouped(df, most=most, spread=spread)
    assert found == {(len(passages[p]), tuple(sorted(at))) for p, at in want.items()}


def test_marks_follow_the_rows(spark):
    counts = []
    text = " ".join(f"w{k}" for k in range(2000))
    for n in (20, 80):
        df = spark.createDataFrame([(1, text)] * n, "doc_id bigint, text string")
        _, marked = repeats._prepared(df, "text", 200, 40, 200_000)
        counts.append(marked.selectExpr("sum(size(marks)) as n").first().n)
        assert all(r.n_removed == r.n_bytes and r.n_spans == 1 for r in repeats.dedup(df).collect())
    assert 0 < counts[1] == 4 * counts[0]


def test_long_texts_need_bounded_memory():
    """Texts of 50 MB: what a worker takes for anchors, contexts and shingles."""
    code = """
import resource, numpy as np, pyarrow as pa
from rangegrid.llm import near, repeats
text = " ".join(map(str, np.random.default_rng(1).integers(0, 10**9, 5_000_000).tolist()))
text += text[:100_000]
b = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1], pa.int64()), pa.array([2], pa.int64()), pa.array([text])], names=["doc_id", "r1", "r2", "text"])
at = [np.asarray(x.column(3)) for x in repeats._find(200, 40)([b])]
assert len(at[0]) > len(text) / 200
marks = pa.StructArray.from_arrays([pa.array(np.arange(len(at[0]))), pa.array(at[0]), pa.array(np.zeros(len(at[0]), bool))], names=["hash", "packed", "wide"])
b = b.append_column("marks", pa.ListArray.from_arrays(pa.array([0, len(at[0])], pa.int32()), marks))
assert sum(x.num_rows for x in repeats._contexts(200, False)([b])) == len(at[0])
print(len(text), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
s = near.shingles(b.column(3))
assert len(s[0]) > 4_900_000
print(len(text), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert out.returncode == 0, out.stderr[-2000:]
    (size, first), (_, second) = (map(int, x.split()) for x in out.stdout.splitlines())
    assert size > 48_000_000 and first < 1000 and second < 1500


def test_long_text_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcdefgh"), 9000))
    raw = np.frombuffer((text + text[1000:2500]).encode(), np.uint8)
    monkeypatch.setattr(repeats, "BLOCK", 500)
    windows = set()
    for _, shift, part, begin in repeats._blocks(raw, np.array([0, len(raw)]), 200):
        _, _, lo, hi = repeats._anchors(part, begin[:-1], 200, 40)
        for a, z in zip(lo, hi, strict=True):
            windows |= set(range(shift + a, shift + z + 1))
    assert windows == set(range(len(raw) - 199))


def test_maximal_repeats_have_all_occurrences():
    rng = np.random.default_rng(6)
    for _ in range(20):
        texts = [bytes(rng.choice(list(b"ab"), int(rng.integers(0, 40)))) for _ in range(4)]
        want = set()
        places = defaultdict(list)
        for t, b in enumerate(texts):
            for i in range(len(b)):
                for n in range(4, len(b) - i + 1):
                    places[b[i : i + n]].append((t, i))
        for s, at in places.items():
            n = len(s)
            left = {texts[t][i - 1] if i else (t, "begin") for t, i in at}
            right = {texts[t][i + n] if i + n < len(texts[t]) else (t, "end") for t, i in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.add((n, tuple(sorted(at))))
        assert {(n, tuple(at)) for n, at in repeats.groups_of(texts, 4)} == want


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def near_by_hand(rows):
    """rows (doc_id, text) -> rows (doc_id, class_id, n_links, n_copies)"""
    sets = [shingle_set(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 10 * len(a & b) >= 8 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, least.get(root(i)), links[i], 1 if not sets[i] else sum(s == sets[i] for s in sets)) for i, (d, _) in enumerate(rows)]


def edited(rng, text, n):
    w = text.split(" ")
    for k in rng.integers(0, len(w), n):
        w[k] = f"new{k}"
    return " ".join(w)


@pytest.mark.parametrize("block", [512, 7])
def test_near_join(spark, monkeypatch, block):
    rng = np.random.default_rng(8)
    text = " ".join(f"w{k}" for k in rng.integers(0, 4000, 120))
    rows = [(1000 + k, edited(rng, text, int(rng.integers(0, 6)))) for k in range(60)]
    rows += [(r.doc_id, r.text) for r in docs_of(spark).collect()] + [(r.doc_id, r.text) for r in odd_documents(spark).collect()]
    monkeypatch.setattr(near, "BLOCK", block)
    got = near.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted([tuple(r)[:4] for r in got], key=str) == sorted(near_by_hand(rows), key=str)


def test_many_links_use_matrices():
    rng = np.random.default_rng(2)
    base = near.mixed(np.arange(400, dtype=np.uint64))
    sets = [np.sort(np.concatenate([rng.choice(base, 380, replace=False), near.mixed(rng.integers(1000, 10**6, 4).astype(np.uint64))])) for _ in range(90)]
    sets = [np.unique(s) for s in sets]
    i, j = near.similar_pairs(near.signature(near.minhash(sets)), sets, near.signature(near.minhash(sets)), sets, True)
    assert len(i) > 2000
    want = {(a, b) for a in range(90) for b in range(a + 1, 90) if 10 * len(np.intersect1d(sets[a], sets[b])) >= 8 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_near_edges(spark):
    docs = odd_documents(spark)
    assert near.join(docs.limit(0)).count() == 0
    kept = near.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect())[3] == 1


def test_words_that_a_polynomial_confuses(spark):
    """Two words of 4096 letters that every polynomial modulo 2 ** 64 with an odd base gives one hash."""
    bits = [bin(k).count("1") & 1 for k in range(4096)]
    one, two = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    rest = " ".join(f"w{k}" for k in range(6))
    df = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, one), (4, two)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in near.join(df).collect()}
    assert all(r.n_copies == 1 and r.n_links == 0 and r.class_id == d for d, r in got.items())


def test_long_texts_are_cut_between_words(monkeypatch):
    import pyarrow as pa

    text = "".join(f"w{k}" + " \t\n"[k % 3] * (k % 4) for k in range(3000)) + "é" * 90
    whole = near.shingles(pa.array([text, None, text[5:]]))
    monkeypatch.setattr(near, "WORD_BLOCK", 50)
    for k in (0, 1, 2):
        assert np.array_equal(near.shingles(pa.array([text, None, text[5:]]).slice(k, 1))[0], whole[k])


def test_rows_are_kept_one_by_one(spark):
    """Rows without an id, or with a shared one, are decided by themselves."""
    prose = " ".join(f"w{k}" for k in range(100))
    rows = [(None, prose), (None, prose + " end"), (None, "another text that nothing else is like at all"), (None, None), (None, ""), (None, None), (7, "x " + prose), (7, "one more text that stands for itself alone here"), (7, "one more text that stands for itself alone here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as _r1", "2 as _row", "3 as r1", "map('a', 1) as m")
    kept = near.keep_first(df)
    assert kept.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == Counter([(7, "x " + prose), rows[2], (None, None), (None, ""), rows[7]])
    class_of = {r.text: r for r in near.join(df).join(df.select("doc_id", "text").distinct(), "doc_id").where("is_first").collect()}
    assert class_of["x " + prose].class_id == 7


def test_a_chain_of_chance_hits_makes_no_group(spark):
    """Texts of which each shares half with the next hit common bands, but no two are likely enough to be compared further."""
    rng = np.random.default_rng(12)
    words_ = [f"w{k}" for k in rng.integers(0, 10**6, 12_000)]
    rows = [(k, " ".join(words_[k * 40 : k * 40 + 120])) for k in range(290)]
    df = near.with_row_key(spark.createDataFrame(rows, "doc_id bigint, text string"))
    classes = near.sketches(df).withColumn("node", F.col("doc_id"))
    hits = classes.select("node", F.explode("bands").alias("band")).groupBy("band").count().where("count > 1").count()
    assert hits > 20 and near.candidate_groups(classes).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(k, k + 1) for k in range(50)] + [(int(a), int(b)) for a, b in rng.integers(100, 200, (60, 2))] + [(300, k) for k in range(301, 400)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        if p != q:
            parent[max(p, q)] = min(p, q)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in nodes}


def test_pipeline(spark):
    from tests.llm.test_native import spans_by_hand
    from tests.llm.test_tokens import check_packing

    docs, sf = docs_of(spark), SMALL
    rows = docs.collect()
    kept_by_rule = {(r.doc_id, r.text) for r in quality.judge(docs).where("kept").collect()}
    rows = [r for r in rows if (r.doc_id, r.text) in kept_by_rule]
    first = {d for d, c, _, _ in near_by_hand([(r.doc_id, r.text) for r in rows]) if d == c}
    stage = docs
    for k, (_, f) in enumerate(corpus_pipeline.STAGES[:4]):
        stage = f(spark, stage, sf).cache()
        assert stage.columns == docs.columns
        if k == 1:
            assert sorted(r.doc_id for r in stage.collect()) == sorted(first)
        if k == 2:
            assert all(not spans_by_hand(r.text)[0] and r.n_chars == len(r.text) for r in stage.collect())
    packed = corpus_pipeline.STAGES[4][1](spark, stage, sf).collect()
    check_packing(packed, stage.collect())
    whole = corpus_pipeline.run(spark, sf)
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed)
    assert packing.MOST == 2048


def test_pipeline_on_odd_documents(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, shared and missing ids, clashing names; and no document at all."""
    from tests.llm.test_native import quality_by_hand, spans_by_hand
    from tests.llm.test_tokens import check_packing

    rng = np.random.default_rng(2)
    prose = [" ".join(f"{w} of the" for w in rng.permutation(3000)[:400].astype(str)) for _ in range(6)]
    rows = [(r.doc_id, r.text, r.source) for r in odd_documents(spark).collect()]
    rows += [(40, prose[0], "a"), (40, prose[1], None), (40, prose[1], None), (None, prose[2], "b"), (None, prose[3], None), (None, None, None), (41, prose[0] + " end", "c"), (42, prose[4] + " password = 'Zx81kQ72mPl09'", "c"), (43, prose[5] * 60, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("doc_id", "text", "'en' as lang", "source", "cast(length(text) as bigint) as n_chars", "1 as _row", "2 as kept", "3 as spans", "4 as copies")
    df.write.parquet(f"{tmp_path}/odd/documents.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    stage = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    columns, kept = stage.columns, None
    for k, (_, f) in enumerate(corpus_pipeline.STAGES[:4]):
        stage = f(spark, stage, str(tmp_path)).cache()
        assert stage.columns == columns
        got = stage.collect()
        assert all((r["_row"], r.kept, r.spans, r.copies) == (1, 2, 3, 4) for r in got)
        if k == 0:
            assert got and all(not quality_by_hand(r.text)[5] for r in got)
            kept = got
        if k == 1:
            # of each group the row that comes first by id: 40 before 41; rows that share an id, or have none, by themselves
            want = Counter()
            for d, text in {(r.doc_id, r.text) for r in kept}:
                alike = [x for x, t in {(r.doc_id, r.text) for r in kept} if len(shingle_set(t) & shingle_set(text)) * 10 >= 8 * len(shingle_set(t) | shingle_set(text))]
                want[d, text] += d is None and all(x is None for x in alike) or d is not None and d == min(x for x in alike if x is not None)
            assert Counter((r.doc_id, r.text) for r in got) == +want
            assert (40, prose[0]) in want and not any(r.doc_id == 41 for r in got) and {r.text for r in got if r.doc_id is None} >= {prose[2], prose[3]}
        if k == 2:
            assert all(not spans_by_hand(r.text)[0] and r.n_chars == len(r.text) for r in got) and any("[SECRET]" in r.text for r in got)
    packed = corpus_pipeline.STAGES[4][1](spark, stage, str(tmp_path)).collect()
    check_packing(packed, stage.collect())
    whole = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed)
    none = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert none.count() == 0 and none.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]


def links_by_prefixes(rows):
    """All pairs of rows with a Jaccard index of 0.8 or more, exactly: two such sets share one of their rarest fifth."""
    sets = [shingle_set(t) for _, t in rows]
    often = Counter(x for s in sets for x in s)
    holders, out = defaultdict(list), set()
    for i, s in enumerate(sets):
        rare = sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-8 * len(s) // 10) + 1]
        for j in {j for x in rare for j in holders[x]}:
            if 10 * len(s & sets[j]) >= 8 * len(s | sets[j]):
                out.add((j, i))
        for x in rare:
            holders[x].append(i)
    return out


@pytest.mark.skipif(not os.environ.get("RANGEGRID_RECALL"), reason="compares whole tables; set RANGEGRID_RECALL to their folder")
def test_near_join_recall(spark):
    """Links that the join finds, out of all pairs of a whole table with a Jaccard index of 0.8 or more, copies included."""
    rows = [(r.doc_id, r.text) for r in docs_of(spark, os.environ["RANGEGRID_RECALL"]).collect()]
    there, got = links_by_prefixes(rows), {r.doc_id: r.n_links for r in near.join(docs_of(spark, os.environ["RANGEGRID_RECALL"])).collect()}
    want = Counter(rows[k][0] for pair in there for k in pair)
    different = sum(shingle_set(rows[i][1]) != shingle_set(rows[j][1]) for i, j in there)
    print(f"recall {sum(got.values()) / 2 / max(1, len(there)):.6f} of {len(there)} links, {different} of them between different sets, in {len(rows)} documents")
    assert len(got) == len(rows) and all(got[d] == want[d] for d in got)
