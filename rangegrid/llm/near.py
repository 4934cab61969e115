"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles (a text of fewer words is one shingle). Equal sets are one class, whatever
their number. Classes that share a band of MinHash values are candidates; within each bucket they are compared by MinHash
values step by step, and dropped as soon as the posterior probability that their Jaccard index reaches the threshold
falls below the tolerance. What is left connects classes into groups, whose pairs are pruned alike and then verified on
all shingles.

Words are told apart by a cryptographic digest of 128 bits and sets of shingles by one of both halves, so that no two
different texts are known to share one; two different shingles that count as one need equal numbers of 64 bits.

Buckets and groups are dealt into blocks and pairs of blocks: a task sees at most two blocks, whatever the size of a
group, and pairs stay inside it. It passes on counts and a spanning forest, a row or two a class.

Defined results: a null, empty or blank text has no shingle, links to nothing and is a class of its own; ties have no
say; repeated rows are documents of their own and link to each other; documents that share an id (or have none) but not
the text are told apart; an empty table gives an empty table; other columns are not carried, whatever their names; a
text of any length counts whole and is read in blocks of words, its shingles (16 bytes each) are held by one task.
"""

from __future__ import annotations

import math
import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangegrid.llm.common import text_batches, written
from rangegrid.llm.components import components

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
#: MinHash values in bands: a pair at the threshold misses all bands with a probability of 3e-6.
BANDS, ROWS, STEP, BLOCK = 42, 6, 42, 512
HASHES = BANDS * ROWS
#: Bytes of text that a worker looks at together.
PIECE = 1 << 20

_U = np.uint64
_FOLD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string or binary column; nulls are empty."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0]


#: Bytes of one text whose words are looked at together; a longer text is cut at white space.
WORD_BLOCK = 4 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _blocks(raw: np.ndarray, at: np.ndarray):
    """(string array, whether its first string goes on with the text before) of pieces of about WORD_BLOCK bytes."""
    if len(at) != 2 or at[1] <= WORD_BLOCK:
        yield pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(raw)), False
        return
    begin, whole = 0, memoryview(raw)
    while begin < len(raw):
        gap = _GAP.search(whole, min(begin + WORD_BLOCK, len(raw)))
        stop = gap.start() if gap else len(raw)
        yield pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, stop - begin])), pa.py_buffer(raw[begin:stop])), begin > 0
        begin = stop


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in turn, two numbers of 64 bits each, as rows; offsets by text). A hash is a cryptographic digest of the word."""
    raw, at = text_bytes(col)
    parts, counts = [np.zeros((0, 2), _U)], []
    for texts, goes_on in _blocks(raw, at):
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.dictionary_encode()
        known = coded.dictionary.cast(pa.large_binary()).to_pylist()
        digests = np.frombuffer(b"".join(blake2b(w, digest_size=16).digest() for w in known), "<u8").reshape(-1, 2).astype(_U)
        code = np.asarray(coded.indices)
        full = np.array([len(w) > 0 for w in known], bool)[code] if known else np.zeros(0, bool)
        before = np.concatenate([[0], np.cumsum(full)])
        n = np.diff(before[np.asarray(split.offsets, np.int64)])
        parts.append(digests[code[full]])
        if goes_on:
            counts[-1] += int(n[0])
        else:
            counts += n.tolist()
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)


def shingles(col: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: rows of two 64-bit numbers, of which the first tells shingles apart."""
    own, first = word_hashes(col)
    count = max(0, len(own) - n + 1)
    grams = own[:count].copy()
    for k in range(1, n):
        grams = grams * _FOLD + own[k : k + count]
    grams = mixed(grams)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= n:
            s = grams[a : z - n + 1]
            s = s[np.argsort(s[:, 0], kind="stable")]
            out.append(s[np.concatenate([[True], s[1:, 0] != s[:-1, 0]])])
        elif z > a:
            h = np.full(2, z - a, _U)
            for x in own[a:z]:
                h = h * _FOLD + x
            out.append(mixed(h)[None, :])
        else:
            out.append(np.zeros((0, 2), _U))
    return out


def set_key(s: np.ndarray) -> bytes:
    """16 bytes that stand for a set of shingles, by both numbers of each: a cryptographic digest."""
    return blake2b(np.ascontiguousarray(s.astype("<u8")).tobytes(), digest_size=16).digest()


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    return rng.integers(1, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


_A, _B = _coefficients()


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """One row of HASHES values for each (not empty) set."""
    out, at = np.empty((len(sets), HASHES), np.uint32), 0
    while at < len(sets):
        to, total = at, 0
        while to < len(sets) and (to == at or total + len(sets[to]) <= 60_000):
            total += len(sets[to])
            to += 1
        x = (np.concatenate(sets[at:to]) >> _U(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : to - 1]], dtype=np.int64)]).astype(np.int64)
        for k in range(HASHES):
            out[at:to, k] = np.minimum.reduceat(x * _A[k] + _B[k], starts)
        at = to
    return out


def bands(values: np.ndarray) -> np.ndarray:
    h = np.zeros((len(values), BANDS), _U)
    for k in range(ROWS):
        h = h * _U(0xD6E8FEB86659FD93) + values[:, k::ROWS].astype(_U) + _U(1)
    return mixed(h + (np.arange(BANDS, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))[None, :])


def signature(values: np.ndarray) -> np.ndarray:
    """One byte of each value: what incremental comparison looks at."""
    return ((values * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, least number of matches to go on) for each step.

    With a uniform prior and m of n one-byte values equal, the posterior probability that a value matches with
    probability p or more is P(Bin(n + 1, p) <= m); p is what the threshold gives, chance matches of bytes included.
    """
    p, out = threshold + (1 - threshold) / 256, []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        out.append((n, m))
    return out


def likely_pairs(sig_a, sig_b, same: bool, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of two blocks, or within one, that incremental comparison of MinHash values doesn't drop."""
    (n, least), *later = least_matches(threshold)
    seen = np.zeros((len(sig_a), len(sig_b)), np.uint16)
    for k in range(n):
        seen += sig_a[:, k][:, None] == sig_b[:, k][None, :]
    i, j = np.nonzero(seen >= least)
    if same:
        i, j = i[i < j], j[i < j]
    count, done = seen[i, j].astype(np.int64), n
    for n, least in later:
        for at in range(0, len(i), 100_000):
            part = slice(at, at + 100_000)
            count[part] += (sig_a[i[part], done:n] == sig_b[j[part], done:n]).sum(1)
        keep = count >= least
        i, j, count, done = i[keep], j[keep], count[keep], n
    return i, j


def similar_pairs(sig_a, sets_a, sig_b, sets_b, same: bool, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of two blocks, or within one, whose Jaccard index is the threshold or more."""
    i, j = likely_pairs(sig_a, sig_b, same, threshold)
    if not len(i):
        return i, j
    size_a, size_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    if len(i) <= 2000:
        shared = np.array([len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True)) for x, y in zip(i, j, strict=True)])
    else:
        shared = _shared_counts(sets_a, sets_b)[i, j]
    # |A & B| / |A | B| >= t, in whole numbers for the usual thresholds
    ok = shared * (1 + threshold) >= threshold * (size_a[i] + size_b[j]) - 1e-9
    return i[ok], j[ok]


def _shared_counts(sets_a, sets_b, columns: int = 4096) -> np.ndarray:
    """|A & B| for all pairs of two blocks: products of 0/1 matrices over shingles that both blocks have."""
    all_a, all_b = np.concatenate(sets_a), np.concatenate(sets_b)
    terms = np.intersect1d(all_a, all_b)
    row_a, row_b = np.repeat(np.arange(len(sets_a)), [len(s) for s in sets_a]), np.repeat(np.arange(len(sets_b)), [len(s) for s in sets_b])
    col_a, col_b = np.searchsorted(terms, all_a), np.searchsorted(terms, all_b)
    for col, values in ((col_a, all_a), (col_b, all_b)):
        col[(col >= len(terms)) | (terms[np.minimum(col, len(terms) - 1)] != values)] = -1
    out = np.zeros((len(sets_a), len(sets_b)), np.float32)
    for at in range(0, len(terms), columns):
        a, b = np.zeros((len(sets_a), columns), np.float32), np.zeros((len(sets_b), columns), np.float32)
        for m, row, col in ((a, row_a, col_a), (b, row_b, col_b)):
            own = (col >= at) & (col < at + columns)
            m[row[own], col[own] - at] = 1
        out += a @ b.T
    return out.astype(np.int64)


# ---- Spark ----


def with_row_key(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text, r1, r2): two hashes of 64 bits that rows share only if they repeat id and text."""
    rows = docs.select("doc_id", F.col(text).alias("text"))
    return rows.withColumns({"r1": F.xxhash64("doc_id", "text"), "r2": F.xxhash64(F.lit("row"), "text", "doc_id")})


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, r1, r2, key, bands, sig) of ``with_row_key``; key is null for a text without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in text_batches(batches, limit=PIECE):
            ids, sets = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "r1", "r2")], shingles(b.column(b.schema.get_field_index("text")))
            full = [s for s in sets if len(s)]
            values = minhash([s[:, 0] for s in full]) if full else np.zeros((0, HASHES), np.uint32)
            keyed, banded, signed = iter([set_key(s) for s in full]), iter(bands(values).view(np.int64)), iter(signature(values))
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array([next(keyed) if len(s) else None for s in sets], pa.binary()), pa.array([next(banded) if len(s) else None for s in sets], pa.list_(pa.int64())), pa.array([next(signed).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "r1", "r2", "key", "bands", "sig"],
            )

    return docs.select("doc_id", "r1", "r2", "text").mapInArrow(run, f"doc_id {kind}, r1 bigint, r2 bigint, key binary, bands array<bigint>, sig binary")


def _with_sets(rows: DataFrame) -> DataFrame:
    """rows with the shingles of their text in place of it; rows whose text isn't the one of their key go."""
    schema = rows.drop("text").schema.add("set", "binary")
    kept = rows.drop("text").columns

    def run(batches):
        for b in text_batches(batches, limit=PIECE):
            keys, sets = b.column(b.schema.get_field_index("key")).to_pylist(), shingles(b.column(b.schema.get_field_index("text")))
            own = pa.array([len(s) > 0 and set_key(s) == k for k, s in zip(keys, sets, strict=True)])
            out = [b.column(b.schema.get_field_index(c)) for c in kept] + [pa.array([np.ascontiguousarray(s[:, 0]).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, "set"]).filter(own)

    return rows.mapInArrow(run, schema)


def _likely(threshold: float):
    """Rows (band, i, j, node, block, sig) by (band, i, j) -> (u, v): a spanning forest of the likely pairs of each two blocks."""

    def forest(task: tuple, nodes: np.ndarray, block: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.flatnonzero(block == k) for k in task[1:])
        same = task[1] == task[2]
        i, j = likely_pairs(sig[a], sig[b], same, threshold)
        i, j = a[i], b[j]
        label = np.arange(len(nodes))
        while len(i):
            least = np.minimum(label[i], label[j])
            if (label[i] == least).all() and (label[j] == least).all():
                break
            np.minimum.at(label, label[i], least)
            np.minimum.at(label, label[j], least)
            label = label[label]
        child = np.flatnonzero(label != np.arange(len(nodes)))
        return nodes[child], nodes[label[child]]

    def run(batches):
        own, held = None, []

        def done():
            nodes, block, sig = (np.concatenate(x) for x in zip(*held, strict=True))
            u, v = forest(own, nodes, block, sig)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            get = lambda k, b=b: b.column(b.schema.get_field_index(k))
            task = np.stack([np.asarray(get(k)).astype(np.int64) for k in ("band", "i", "j")])
            sig = np.frombuffer(b"".join(get("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            cuts = [0, *(np.flatnonzero((task[:, 1:] != task[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                now = tuple(task[:, x].tolist())
                if now != own and own is not None:
                    yield done()
                    held = []
                own = now
                held.append((np.asarray(get("node"))[x:y], np.asarray(get("block"))[x:y], sig[x:y]))
        if held:
            yield done()

    return run


def _blocked(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (with node and n, the size of their group) dealt into pairs (i, j) of blocks; a row is in as many pairs as there are blocks."""
    rows = rows.withColumn("n_blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("n_blocks")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return rows.withColumns({"i": F.least("block", "_o"), "j": F.greatest("block", "_o")}).select(*keys, "i", "j", *[c for c in rows.columns if c not in (*keys, "n", "n_blocks", "_o")])


def candidate_groups(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, group) of the classes (node, bands, sig) that likely pairs connect.

    Members of a band's bucket are compared by MinHash values, in pairs of blocks, so that a chain of chance hits joins no
    groups; of buckets with the same members one is enough. Each pair of blocks passes on a row a class at most.
    """
    banded = classes.select("node", F.explode("bands").alias("band"))
    # two sums of hashes stand for the set of members
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in (1, 2)]
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("hub"), *marks).where("n > 1")
    chosen = buckets.groupBy("n", "hub", "x1", "x2").agg(F.min("band").alias("band")).select("band", "n")
    members = banded.join(chosen, "band").join(classes.select("node", "sig"), "node")
    tasks = _blocked(members.select("band", "n", "node", "sig"), "band")
    # few bytes and much work: as many tasks as the session has for a shuffle, not as few as the bytes ask for
    edges = tasks.repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_likely(threshold), "u bigint, v bigint")
    return components(written(edges.distinct(), "likely"), "u", "v").withColumnRenamed("root", "group")


def _verify(threshold: float):
    def compare(task: tuple, rows: list[tuple]) -> list[tuple]:
        """rows (key, block, n_docs, sig, set) of one pair of blocks -> (key, n_links, root)."""
        rows = list({r[0]: r for r in rows}.values())
        a, b = ([r for r in rows if r[1] == k] for k in task[1:])
        if not a or not b:
            return []
        sig = lambda x: np.array([np.frombuffer(r[3], np.uint8) for r in x]).reshape(len(x), HASHES)
        sets = lambda x: [np.frombuffer(r[4], _U) for r in x]
        links, parent = dict.fromkeys((r[0] for r in rows), 0), {}

        def root(x):
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        i, j = similar_pairs(sig(a), sets(a), sig(b), sets(b), task[1] == task[2], threshold)
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            links[a[x][0]] += b[y][2]
            links[b[y][0]] += a[x][2]
            p, q = root(a[x][0]), root(b[y][0])
            if p != q:
                parent[max(p, q)] = min(p, q)
        return [(k, n, root(k)) for k, n in links.items() if n]

    def run(batches):
        own, rows, done = None, [], []

        def out():
            keys, n, roots = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(roots, pa.binary())], names=["key", "n", "root"])

        for b in batches:
            get = lambda k, b=b: b.column(b.schema.get_field_index(k)).to_pylist()
            for task, row in zip(zip(get("group"), get("i"), get("j"), strict=True), zip(get("key"), get("block"), get("n_docs"), get("sig"), get("set"), strict=True), strict=True):
                if task != own:
                    done += compare(own, rows) if own else []
                    own, rows = task, []
                    if len(done) > 5000:
                        yield out()
                        done = []
                rows.append(row)
        done += compare(own, rows) if own else []
        if done:
            yield out()

    return run


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """For rows of ``with_row_key``: (their sketches; key, n_docs, n_links, root, least: the row by id, then row key, that comes first in its class)."""
    sketched = written(sketches(docs), "sketches")
    least = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("doc_id"), "r1", "r2")
    # one row a class, by partial sums
    classes = sketched.where("key is not null").groupBy("key").agg(F.count("*").alias("n_docs"), F.min(least).alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")).withColumn("node", F.xxhash64("key"))
    classes = written(classes, "classes")
    # candidates go by a 64-bit number; should two classes ever share one, their groups are compared together
    group = candidate_groups(classes, threshold)
    sizes = group.groupBy("group").agg(F.count("*").alias("n"))
    chosen = group.join(sizes, "group").join(classes.select("node", "key", "n_docs", F.col("rep.r1").alias("r1"), F.col("rep.r2").alias("r2"), "sig"), "node")
    # one row of each text: rows that repeat id and text lie in one partition already
    texts = chosen.join(docs.select("r1", "r2", "text"), ["r1", "r2"]).dropDuplicates(["r1", "r2"]).drop("r1", "r2")
    tasks = _blocked(_with_sets(texts), "group").select("group", "i", "j", "key", "block", "n_docs", "sig", "set")
    found = tasks.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(_verify(threshold), "key binary, n bigint, root binary")
    found = written(found, "links")
    links = found.groupBy("key").agg(F.sum("n").alias("n"))
    linked = components(found, "key", "root").withColumnsRenamed({"node": "key"})
    # a class without links is its own root
    rooted = classes.select("key", "n_docs", "rep").join(linked, "key", "left").join(links, "key", "left").withColumn("root", F.coalesce("root", "key"))
    first = rooted.groupBy("root").agg(F.min("rep").alias("least"))
    return sketched, rooted.join(first, "root").select("key", "n_docs", (F.coalesce("n", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"), "root", "least")


def join(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies, is_first) for every document.

    n_links: other documents whose Jaccard index with this one is the threshold or more, copies included; n_copies:
    documents of the same shingles, this one included; class_id: the least id of the documents that links connect;
    is_first: whether this is the document that ``keep_first`` keeps of its class.
    """
    sketched, known = _classes(with_row_key(docs, text), threshold)
    out = sketched.select("doc_id", "r1", "r2", "key").join(known, "key", "left")
    return out.select(
        "doc_id",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_docs", F.lit(1)).cast("long").alias("n_copies"),
        (F.col("key").isNull() | ((F.col("r1") == F.col("least.r1")) & (F.col("r2") == F.col("least.r2")))).alias("is_first"),
    )


def keep_first(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: the one with the least id (null ids come last; then by a hash of the text).

    Texts without words stay. Of rows that repeat id and text one stays. Decisions go by row, not by id, so that documents
    that share an id, or have none, are kept or dropped each by itself. Texts are shuffled once, by a hash of the row.
    """
    sketched, known = _classes(with_row_key(docs, text), threshold)
    firsts = known.select("least.r1", "least.r2").distinct().union(sketched.where("key is null").select("r1", "r2").distinct())
    repeated = sketched.groupBy("r1", "r2").agg(F.count("*").alias("_n")).where("_n > 1")
    kept = written(firsts.join(repeated, ["r1", "r2"], "left").select(F.col("r1").alias("_1"), F.col("r2").alias("_2"), F.col("_n").isNotNull().alias("_many")), "kept")
    names = docs.columns
    rows = docs.select(F.xxhash64("doc_id", text).alias("_r1"), F.xxhash64(F.lit("row"), text, "doc_id").alias("_r2"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    here = (F.col("_r1") == F.col("_1")) & (F.col("_r2") == F.col("_2"))
    once = rows.join(kept.where("not _many"), here, "left_semi")
    # row_number rather than a comparison of whole rows, which may hold columns of any kind
    many = rows.join(kept.where("_many"), here, "left_semi").withColumn("_k", F.row_number().over(W.partitionBy("_r1", "_r2").orderBy(F.lit(1)))).where("_k = 1")
    return once.select("_row.*").unionByName(many.select("_row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
