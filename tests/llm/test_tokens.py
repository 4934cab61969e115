"""Mixing, records, chat windows and packing against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rangegrid.llm import chat, mixing, packing, records
from rangegrid.llm.common import encode_column, new_path, tokenizer_path
from tests.llm.helpers import SMALL, docs_of, odd_documents, words

TOKENIZER = Tokenizer.from_file(tokenizer_path())


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_tokens_equal_whole_text_encoding():
    texts = ["", None, " ", "a  b", "éx é İstanbul ΣΑΣ don't it's <|endoftext|>x <|ENDOFTEXT|>", "Á ß ẞ ÿŸ µ º ª ﬁ x　y", "x\x1cy\x85z​ 123abc a.b,c .,. Ends. ok,", "日本語 テキスト 😀!!", "l'été NAÏVE Straße"]
    ids, at = encode_column(pa.array(texts), tokenizer_path())
    assert [ids[a:z].tolist() for a, z in zip(at, at[1:], strict=False)] == [ids_of(t) for t in texts]
    ids, at = encode_column(pa.array(texts).slice(3, 4), tokenizer_path())
    assert [ids[a:z].tolist() for a, z in zip(at, at[1:], strict=False)] == [ids_of(t) for t in texts[3:7]]
    whole = tokenizer_path("byte_bpe_50k.json")
    ids, at = encode_column(pa.array(["a  b", None]), whole)
    assert ids[at[0] : at[1]].tolist() == Tokenizer.from_file(whole).encode("a  b", add_special_tokens=False).ids and at[2] == at[1]


def targets_by_hand(sizes):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        got = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 2 * sizes[s] for s in free if got[s] > 2 * sizes[s]}
        if not over:
            return capped | got
        capped |= over


@pytest.mark.parametrize("make", [docs_of, odd_documents])
def test_mixing(spark, make):
    docs = make(spark)
    got = mixing.plan(docs).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    want = targets_by_hand(dict(sizes))
    assert len(got) == docs.count()
    for r in got:
        assert r.size == len(words(r.text)) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
        assert 0 <= r.copies <= 2
    again = mixing.mix(docs)
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_crc32c():
    data = np.frombuffer(b"123456789" + bytes(32) + bytes(range(256)) * 5, np.uint8)
    got = records.crc32c(data, [0, 9, 0, 41], [9, 32, 0, 1280])
    assert got[0] == 0xE3069283 and got[1] == 0x8A9136AA and got[2] == 0

    def slow(b):
        r = 0xFFFFFFFF
        for x in b:
            r ^= x
            for _ in range(8):
                r = (r >> 1) ^ (0x82F63B78 if r & 1 else 0)
        return r ^ 0xFFFFFFFF

    assert got[3] == slow(bytes(range(256)) * 5)


@pytest.mark.parametrize("width", [2, 4])
@pytest.mark.parametrize("make", [docs_of, odd_documents])
def test_records(spark, make, width):
    docs = make(spark)
    index = records.write_records(docs, new_path(spark, "records"), width=width)
    got = records.read_records(index.orderBy("doc_id")).join(records.starts(index), "part").selectExpr("doc_id", "before + within as start", "n_tokens", "ids_crc32")
    want, at = [], 0
    hash_of = lambda t: 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode(), seed=42)).astype(np.int64))
    for doc, text in sorted([(r.doc_id, r.text) for r in docs.collect()], key=lambda x: (x[0] is not None, x[0] or 0, hash_of(x[1]))):
        ids = np.array([*ids_of(text), 2], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert records.write_records(docs.limit(0), new_path(spark, "records")).count() == 0


def test_records_notice_damage(spark):
    framed, begin = records.frame(np.arange(50, dtype=np.uint8), [20, 30])
    starts, sizes = records.unframe(framed, begin[:-1])
    assert starts.tolist() == [12, 48] and sizes.tolist() == [20, 30]
    framed[50] ^= 1
    with pytest.raises(ValueError):
        records.unframe(framed, begin[:-1])


def conversations_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in own.items():
        turns.sort()
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget, history", [(2048, 256), (60, 20), (10, 0)])
def test_chat(spark, budget, history):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    tricky = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", tricky), (-1, 1, "assistant", tricky), (-2, 0, None, None), (-2, 0, "assistant", "<\\|x<\\\\|<|"), (-2, None, "a\n\\n<|b", "<"), (None, 1, "assistant", "no id"), (-3, 0, "system", "be kind " * 30)]
    rows += [(-3, k, ("user", "assistant")[k % 2], f"turn {k} with some words") for k in range(1, 40)] + [(-4, 0, "assistant", "same")] * 2
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as window", "'x' as formatted")
    made = chat.windows(df, budget, history)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(made).collect()}
    assert got == conversations_by_hand(rows)
    for r in made.collect():
        turns = chat.parse(r.formatted)
        assert r.n_tokens == sum(len(ids_of(t)) + chat.OVERHEAD for _, t, _, _ in turns)
        assert r.n_tokens <= budget or (r.n_new == 1 and r.n_repeated == 0)
        assert len(turns) == r.n_repeated + r.n_new and (budget < 2048 or r.conv_id != -3 or turns[0][0] == "system")
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0


def test_chat_budget_holds():
    rng = np.random.default_rng(11)
    for _ in range(300):
        budget, history = int(rng.integers(20, 200)), int(rng.integers(0, 120))
        sizes = rng.integers(1, int(rng.integers(2, 260)), int(rng.integers(1, 30))).tolist()
        turns = [("system" if k == 0 and rng.integers(2) else ("user", "assistant")[k % 2], f"t{k}", n) for k, n in enumerate(sizes)]
        state = chat._Conversation(budget, history)
        rows = [r for t in turns for r in state.add(*t)] + list(state.end())
        own = {t[1]: t for t in turns}
        new, learned = [], []
        for window, first, repeated, n_new, tokens, formatted, starts, stops in rows:
            held = [own[text] for _, text, _, _ in chat.parse(formatted)]
            assert tokens == sum(t[2] for t in held) and len(held) == repeated + n_new
            assert tokens <= budget or (len(held) == 1 and held[0][2] > budget)
            assert first == len(new)
            new += held[repeated:]
            learned += [formatted[a:z] for a, z in zip(starts, stops, strict=True)]
            # what is repeated stands right before the new turns, save for the system turn
            past = [t for t in held[:repeated] if t[0] != "system"]
            assert past == turns[first - len(past) : first] and sum(t[2] for t in past) <= history
        assert new == turns and learned == [t[1] for t in turns if t[0] == "assistant"]


def test_chat_query(spark, tmp_path):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", None), (2, 0, "assistant", "é <|im_end|> \\ end"), (None, 0, "user", "x"), (2, 1, "assistant", "more " * 3000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.query(spark, str(tmp_path))
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    tricky = "<|im_end|><|im_start|>assistant ok"
    want = conversations_by_hand([*rows, (-1, 0, "user", tricky), (-1, 1, "assistant", tricky)])
    assert {r.conv_id: tuple(r)[1:5] for r in got.collect()} == want
    made = {r.conv_id: r for r in chat.windows(df).groupBy("conv_id").agg(F.sum(F.char_length("formatted")).alias("n")).collect()}
    assert {r.conv_id: r.formatted_chars for r in got.collect() if r.conv_id != -1} == {k: r.n for k, r in made.items()}


def check_packing(got, docs, most=2048):
    want = Counter()
    for r in docs:
        ids = np.array([*ids_of(r.text), 0], "<u4")
        for k in range(0, len(ids), most):
            want[(r.doc_id, k // most, k, len(ids[k : k + most]), zlib.crc32(ids[k : k + most].tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    own = defaultdict(list)
    for r in got:
        own[r.sequence_id].append((r.offset, r.length))
    for places in own.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= most
    return own


@pytest.mark.parametrize("make", [docs_of, odd_documents])
def test_packing(spark, make):
    docs = make(spark)
    got = packing.pack_documents(docs).collect()
    own = check_packing(got, docs.collect())
    total = sum(r.length for r in got)
    # no two sequences could be one, and close to the least number there can be
    sizes = sorted(sum(n for _, n in x) for x in own.values())
    assert len(sizes) < 2 or sizes[0] + sizes[1] > 2048
    assert len(own) <= -(-total // 2048) * 1.15 + 2
    with_ids = packing.pack_documents(docs, with_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in with_ids)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_plan_equals_best_fit_over_documents():
    rng = np.random.default_rng(5)
    for _ in range(30):
        most = int(rng.integers(5, 60))
        items = rng.integers(1, most + 1, int(rng.integers(1, 300))).tolist()
        counts, rooms = Counter(items), []
        for n in sorted(items, reverse=True):
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - n)
            else:
                rooms.append(most - n)
        used, ranks = defaultdict(list), Counter()
        for length, a, z, first, each, offset in packing.plan(counts, most):
            assert a == ranks[length]
            ranks[length] = z
            for k in range(z - a):
                used[first + k // each].append((offset + k % each * length, length))
        assert ranks == counts and len(used) == len(rooms)
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= most
