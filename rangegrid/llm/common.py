"""What the operators of this subpackage share: folders, word pattern, tokenizing of whole Arrow columns."""

from __future__ import annotations

import os
import re
import uuid
from array import array
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run in one process may it be unset."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at or "file:///tmp/rangegrid-shared"


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call has got."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of a row group of tables in the shared folder: what a writing task holds.
ROW_GROUP = 16 << 20


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Within: jobs hand Python at most so many rows at a time. Memory depends on it, results don't."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, rows_a_batch: int = 1000) -> DataFrame:
    """df, computed once and reread from a table in the shared folder: cuts lineage, and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with arrow_rows(spark, rows_a_batch):
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hadoop_fs(spark: SparkSession, path: str):
    """(file system, path object) of the JVM's Hadoop client."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``new_path`` named."""
    fs, p = hadoop_fs(spark, path)
    fs.delete(p, True)


def columns_clear(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that would clash with the ones an operator adds."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def word_count(text):
    """Words of a text as long; null counts 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long"), F.lit(0).cast("long"))


# ---- tokenizing ----

#: Bytes of the words, and their ids, that a worker keeps, about; only memory and time depend on it, results don't.
CACHE_BYTES = 24 << 20
#: Letters that the vocabulary's normal form changes by case only, so that such a word may go straight to the model; and words
#: of these, with or without full stops and commas after them.
_PLAIN = re.compile(r"[A-Za-zß-öø-ÿÀ-ÖØ-Þ]+")
_PLAIN_WORD = r"^[A-Za-zß-öø-ÿÀ-ÖØ-Þ]+[.,]*$"
_TOKENIZERS: dict[str, tuple] = {}


def _stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of stretches of these sizes, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(starts.max(initial=0)) + total) < 2**31 else np.int64
    at = np.repeat((starts - ends + sizes).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return at


class _Words:
    """Words and their ids, as columns: word k has flat[starts[k] : starts[k] + sizes[k]]."""

    def __init__(self):
        self.words = pa.array([], pa.large_string())
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place of each word, whether it is there)."""
        at = pc.index_in(words, value_set=self.words)
        return np.asarray(pc.fill_null(at, 0), np.int64), np.asarray(at.is_valid().to_numpy(zero_copy_only=False), bool)

    def add(self, words: pa.Array, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, used: np.ndarray, most: int) -> None:
        """Take more words; if they are too many, those that weren't used just now go, then all."""
        if self.words.nbytes + self.flat.nbytes + words.nbytes + flat.nbytes > most:
            used = np.unique(used)
            self.words, self.flat = self.words.take(pa.array(used)), self.flat[_stretches(self.starts[used], self.sizes[used])]
            self.sizes = self.sizes[used]
            self.starts = np.cumsum(self.sizes) - self.sizes
            if self.words.nbytes + self.flat.nbytes + words.nbytes + flat.nbytes > most:
                self.__init__()
                return
        self.words = pa.concat_arrays([self.words, words])
        self.starts = np.concatenate([self.starts, starts + len(self.flat)])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The usual printable stand-ins of a byte-level vocabulary, for the characters of _PLAIN."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand, extra = {b: chr(b) for b in keep}, 256
    for b in range(256):
        if b not in stand:
            stand[b], extra = chr(extra), extra + 1
    return {c: "".join(stand[b] for b in chr(c).encode()) for c in range(0x41, 0x100)}


def _loaded(path: str) -> tuple:
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        probe = ["Zuerst", "l'été", "ÀÉô", "naïve", "Straße", "x"]
        letters = _byte_letters()
        direct = all([x.id for x in t.model.tokenize(w.lower().translate(letters))] == t.encode(w, add_special_tokens=False).ids for w in probe if _PLAIN.fullmatch(w))
        spaced = [t.encode(x, add_special_tokens=False).ids for x in ("ab cd", "ab", "cd")]
        _TOKENIZERS[path] = (t, _Words(), letters if direct else None, spaced[0] == spaced[1] + spaced[2])
    return _TOKENIZERS[path]


def _learn(path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat ids, starts, sizes) of words that the worker doesn't hold."""
    t, _, letters, _ = _loaded(path)
    starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    plain = np.asarray(pc.match_substring_regex(words, _PLAIN_WORD).to_numpy(zero_copy_only=False), bool) if letters is not None else np.zeros(len(words), bool)
    at, flat = np.flatnonzero(plain), array("I")
    if len(at):
        own = words.take(pa.array(at))
        body = pc.utf8_rtrim(own, ".,")
        size, ends, known = np.asarray(pc.utf8_length(body)), {}, {}
        for k in np.flatnonzero(np.asarray(pc.utf8_length(own)) > size).tolist():
            end = own[k].as_py()[size[k] :]
            if end not in known:
                known[end] = t.encode(end, add_special_tokens=False).ids
            ends[k] = known[end]
        # case and byte letters are changed in all words at once
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(body)], pa.int32()), body), pa.scalar("\n", body.type))[0].as_py()
        stops, tokenize = [0], t.model.tokenize
        for k, word in enumerate(whole.lower().translate(letters).split("\n")):
            for token in tokenize(word):
                flat.append(token.id)
            if k in ends:
                flat.extend(ends[k])
            stops.append(len(flat))
        starts[at], sizes[at] = stops[:-1], np.diff(stops)
    rest = np.flatnonzero(~plain)
    for begin in range(0, len(rest), 20_000):
        part = rest[begin : begin + 20_000]
        for k, e in zip(part.tolist(), t.encode_batch_fast(words.take(pa.array(part)).to_pylist(), add_special_tokens=False), strict=True):
            starts[k], sizes[k] = len(flat), len(e)
            flat.extend(e.ids)
    return np.frombuffer(flat, np.uint32) if len(flat) else np.zeros(0, np.uint32), starts, sizes


def encode_column(texts: pa.Array, path: str, cache_bytes: int = CACHE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in turn as uint32, offsets): whole texts, nulls as empty ones, by the tokenizers library.

    A vocabulary that drops white space is asked for each distinct word once: no token of it spans white space, so the
    ids of a text are those of its words in turn. Any other vocabulary gets whole texts.
    """
    t, cache, _, by_word = _loaded(path)
    texts = pc.fill_null(texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts, "")
    if not by_word:
        got = [np.array(e.ids, np.uint32) for e in t.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return (np.concatenate(got) if got else np.zeros(0, np.uint32)), np.concatenate([[0], np.cumsum([len(x) for x in got], dtype=np.int64)]).astype(np.int64)
    split = pc.ascii_split_whitespace(texts)
    bounds = np.asarray(split.offsets, np.int64)
    coded = split.values.dictionary_encode()
    code, words = np.asarray(coded.indices), coded.dictionary
    at, known = cache.find(words)
    starts, sizes, flat = cache.starts[at[known]], cache.sizes[at[known]], cache.flat
    if not known.all():
        lacking = words.take(pa.array(np.flatnonzero(~known)))
        fresh, begin, n = _learn(path, lacking)
        every_start, every_size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        every_start[known], every_size[known] = starts, sizes
        every_start[~known], every_size[~known] = begin + len(flat), n
        starts, sizes, flat = every_start, every_size, np.concatenate([flat, fresh])
        cache.add(lacking, fresh, begin, n, at[known], cache_bytes)
    each = sizes[code]
    ends = np.concatenate([[0], np.cumsum(each)]).astype(np.int64)
    return flat[_stretches(starts[code], each)], ends[bounds - bounds[0]]


def text_batches(batches, column: str = "text", limit: int = 8 << 20):
    """Arrow batches cut so that a piece holds about ``limit`` bytes of text, or one row if that is longer."""
    for b in batches:
        col = b.column(b.schema.get_field_index(column))
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64)
        ends, at = np.cumsum(size), 0
        while at < len(size):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield b.slice(at, to - at)
            at = to
