"""Token ids as flat binary files with 64-bit document offsets.

One range partition of the document ids makes one part:

    part-00000-<uuid>.ids   unsigned little-endian token ids, document after document, each with the end id
    part-00000-<uuid>.docs  int64 document ids, in order
    part-00000-<uuid>.offs  int64 offsets, n + 1 of them, in tokens from the start of the part

The id width is the least of 2 and 4 bytes that holds the vocabulary. A part's base, the number of ids in all parts
before it, is a prefix sum over the parts' totals, of which there is one number per part. Files are written under a
fresh name and only listed in the manifest when their task has succeeded, so retried or speculative tasks do no harm.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm._store import new_path
from parley.llm._text import give_back, prefix_hash, runs, slices, span_hash

#: Words whose ids a worker remembers; beyond, it starts anew.
REMEMBERED = 1_400_000
#: White space at which texts are cut into words: the common part of what all tokenizers call so.
APART = np.zeros(256, bool)
APART[[0x20, 0x09, 0x0A, 0x0D]] = True
PARTS = "part long, file string, n_docs long, n_ids long"


def vocabulary_size(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path).get_vocab_size()


def _filesystem(path: str):
    from parley.sources.files import filesystem

    return filesystem(path)


#: Steps of a tokenizer that drop white space between pieces, steps that work on one piece at a time, and normalizers that see no further than from one space to the next.
_DROPS = {"Whitespace", "WhitespaceSplit", "BertPreTokenizer"}
_CUTS = {*_DROPS, "Punctuation", "Digits", "ByteLevel"}
_BETWEEN_SPACES = {"Lowercase", "NFC", "NFD", "NFKC", "NFKD"}
#: One way to match in a pattern that takes no white space: letters and signs as they are, or a class that has none, once or more.
_NO_SPACE = re.compile(r"(?:[^\s\\\[\](){}.^$*+?|]|\[(?:\\p\{[LNM]\}|[^\s\\\[\]^-])+\][+*]?|\[\^\\s(?:\\p\{[LNM]\}|[^\s\\\[\]^-])*\][+*]?)+")


def _ways(pattern: str) -> list[str]:
    return re.split(r"\|(?![^\[]*\])", pattern)


def _drops_space(step: dict) -> bool:
    if step.get("type") == "Split" and step.get("behavior") == "Removed" and step.get("invert"):  # what the pattern matches is kept, the rest goes
        return all(_NO_SPACE.fullmatch(x) for x in _ways(step["pattern"].get("Regex", " ")))
    return step.get("type") in _DROPS


def _between_spaces(step: dict) -> bool:
    blanks = step.get("type") == "Replace" and step["pattern"].get("Regex") in (r"\s+", r"\s") and re.fullmatch(r"\s+", step.get("content") or "")
    return step.get("type") in _BETWEEN_SPACES or bool(blanks)


def parts_at_space(definition: dict) -> bool:
    """Does the definition of a tokenizer prove that the ids of a text are those of its words, parted by white space, one after another?"""
    steps = lambda x, of: [] if x is None else x[of] if x.get("type") == "Sequence" else [x]
    normal, pre = steps(definition.get("normalizer"), "normalizers"), steps(definition.get("pre_tokenizer"), "pretokenizers")
    if not all(map(_between_spaces, normal)) or not pre or not _drops_space(pre[0]):
        return False
    if any(s.get("type") not in _CUTS or s.get("add_prefix_space") for s in pre[1:]) or definition.get("truncation") or definition.get("padding"):
        return False
    # a token of its own may reach over white space
    return not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in definition.get("added_tokens") or [])


class Encoder:
    """The ids of texts. Where the tokenizer's definition shows that no piece reaches over white space, a text is encoded word by word, and a word
    that was met before is looked up; else whole. The words met are kept by 64-bit hash in an open-addressed table of numpy arrays; it starts
    anew when it holds REMEMBERED words."""

    SLOTS = 1 << 21
    #: Stands between words that are encoded in one call, if it is a token of its own that no other text gives; words that hold it are encoded apart.
    MARK = "\x01"

    def __init__(self, tokenizer_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's threads each keep memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.big = self.tokenizer.get_vocab_size() > 1 << 16
        with open(tokenizer_path, encoding="utf-8") as f:
            self.by_word = parts_at_space(json.load(f))
        if self.by_word:
            got, other = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in (self.MARK, "\x02"))
            self.mark = got[0] if len(got) == 1 and got != other else None
            self.keys = np.zeros(self.SLOTS, np.uint64)
            self.at = np.zeros(self.SLOTS, np.int32)
            self._reset()

    def _reset(self) -> None:
        self.keys[:] = 0
        self.n, self.n_ids = 0, 0
        self.starts, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32 if self.big else np.uint16)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the known words, -1 for others."""
        out, left, slot = np.full(len(h), -1, np.int64), np.arange(len(h)), (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(left):
            key = self.keys[slot[left]]
            hit = key == h[left]
            out[left[hit]] = self.at[slot[left[hit]]]
            left = left[~hit & (key != 0)]
            slot[left] = (slot[left] + 1) & (self.SLOTS - 1)
        return out

    def _put(self, h: np.ndarray, number: np.ndarray) -> None:
        left, slot = np.arange(len(h)), (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(left):
            free = self.keys[slot[left]] == 0
            self.keys[slot[left[free]]] = h[left[free]]
            won = free & (self.keys[slot[left]] == h[left])
            self.at[slot[left[won]]] = number[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & (self.SLOTS - 1)

    def _learn(self, words: list[str], h: np.ndarray) -> None:
        if self.n + len(words) > REMEMBERED:
            self._reset()
        plain = [i for i, w in enumerate(words) if self.MARK not in w] if self.mark is not None else []
        got: list = [None] * len(words)
        joined = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        for group, e in zip(joined, self.tokenizer.encode_batch_fast([f" {self.MARK} ".join([words[i] for i in g]) for g in joined], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            for i, x in zip(group, np.split(ids, np.flatnonzero(ids == self.mark)), strict=True):
                got[i] = x[1:] if i != group[0] else x
        for i in set(range(len(words))) - set(plain):
            got[i] = np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, np.uint32)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        n, m = self.n + len(words), self.n_ids + int(sizes.sum())
        while n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while m > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.starts[self.n : n], self.sizes[self.n : n] = self.n_ids + np.cumsum(sizes) - sizes, sizes
        self.ids[self.n_ids : m] = np.concatenate(got)
        self._put(h, np.arange(self.n, n))
        self.n, self.n_ids = n, m

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and n + 1 offsets."""
        ids, offs, base = [], [np.zeros(1, np.int64)], 0
        if not self.by_word:
            for _, _, data, o in slices(texts):
                raw = data.tobytes()
                for e in self.tokenizer.encode_batch_fast([raw[x:y].decode() for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)], add_special_tokens=False):
                    ids.append(np.array(e.ids, np.uint32 if self.big else np.uint16))
                    base += len(e.ids)
                    offs.append(np.array([base]))
            return np.concatenate(ids) if ids else np.zeros(0, np.uint16), np.concatenate(offs)
        for _, _, data, o in slices(texts):
            start, end, first = runs(~APART[data], o)
            if len(start) > REMEMBERED:  # one enormous text: some words at a time, without looking them up
                for k in range(len(o) - 1):
                    for i in range(first[k], first[k + 1], 100_000):
                        j = min(i + 100_000, first[k + 1]) - 1
                        got = self.tokenizer.encode(data[start[i] : end[j]].tobytes().decode(), add_special_tokens=False).ids
                        ids.append(np.array(got, self.ids.dtype))
                        base += len(got)
                    offs.append(np.array([base]))
                continue
            h = span_hash(prefix_hash(data), start, end) | np.uint64(1)
            which = self._find(h)
            if (which < 0).any():
                new, where = np.unique(h[which < 0], return_index=True)
                where = np.flatnonzero(which < 0)[where]
                raw = data.tobytes()
                self._learn([raw[s:e].decode() for s, e in zip(start[where].tolist(), end[where].tolist(), strict=True)], new)
                which = self._find(h)
                if (which < 0).any():  # the table started anew: the slice's words are learned together
                    new, where = np.unique(h, return_index=True)
                    self._reset()
                    self._learn([raw[s:e].decode() for s, e in zip(start[where].tolist(), end[where].tolist(), strict=True)], new)
                    which = self._find(h)
            sizes = self.sizes[which].astype(np.int64)
            at = np.zeros(len(h) + 1, np.int64)
            np.cumsum(sizes, out=at[1:])
            ids.append(self.ids[np.arange(at[-1]) + np.repeat(self.starts[which].astype(np.int64) - at[:-1], sizes)])
            offs.append(base + at[first[1:]])
            base += int(at[-1])
        return np.concatenate(ids) if ids else np.zeros(0, np.uint16), np.concatenate(offs)


_encoders: dict[str, Encoder] = {}


def encoder_of(tokenizer_path: str) -> Encoder:
    """This process's encoder, with the words it has met in earlier tasks."""
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = Encoder(tokenizer_path)
    return _encoders[tokenizer_path]


def forget_words() -> None:
    """Drops this process's encoders: once the files are written, their words are of no more use, and the worker lives on."""
    _encoders.clear()
    give_back()


def with_end(ids: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(offs) - 1
    out = np.empty(len(ids) + n, ids.dtype)
    new = offs + np.arange(n + 1)
    keep = np.ones(len(out), bool)
    keep[new[1:] - 1] = False
    out[keep], out[~keep] = ids, end_id
    return out, new


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, partitions: int | None = None) -> DataFrame:
    """Encode every text, in ascending order of id, into files under path. Returns the parts: part, file, base, n_docs, n_ids, dtype.

    Null texts count as empty: they hold the end id alone. Rows that share an id stay rows, in the order of their text.
    A null id sorts first and is stored as -2**63. No rows: no parts.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(text_col).alias("text")).repartitionByRange(n, "id").sortWithinPartitions("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, fs, total, names = TaskContext.get().partitionId(), None, None, 0, []
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        out, docs_n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                piece = batch.slice(lo, 1000)
                if not out:
                    encoder = encoder_of(tokenizer_path)
                    fs, at = _filesystem(path)
                    fs.create_dir(at, recursive=True)
                    out = [fs.open_output_stream(f"{at}/{name}.{x}") for x in ("ids", "docs", "offs")]
                ids, offs = with_end(*encoder.encode(piece.column(1)), end_id)
                out[0].write(ids.astype("<u4" if encoder.big else "<u2").tobytes())
                out[1].write(piece.column(0).to_numpy().astype("<i8").tobytes())
                out[2].write((offs[:-1] + total).astype("<i8").tobytes())
                total += len(ids)
                docs_n += piece.num_rows
        if out:
            out[2].write(np.array([total], "<i8").tobytes())
            for f in out:
                f.close()
            names = [(part, name, docs_n, total)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in names], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["part", "file", "n_docs", "n_ids"])

    found = sorted(tuple(r) for r in rows.mapInArrow(write, PARTS).collect())  # one short row for each file
    big = vocabulary_size(tokenizer_path) > 1 << 16
    base, parts = 0, []
    for part, file, n_docs, n_ids in found:
        parts.append((part, file, base, n_docs, n_ids, "<u4" if big else "<u2"))
        base += n_ids
    manifest = spark.createDataFrame(parts, "part long, file string, base long, n_docs long, n_ids long, dtype string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


class Stored:
    """A file of numbers of one kind: x[lo:hi] reads that range, memory-mapped where the file system is local."""

    def __init__(self, fs, name: str, kind: str):
        self.kind = np.dtype(kind)
        self.map = np.memmap(name, kind, "r") if fs.type_name == "local" else None
        self.file = None if self.map is not None else fs.open_input_file(name)
        self.n = len(self.map) if self.map is not None else self.file.size() // self.kind.itemsize

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.map is not None:
            return np.asarray(self.map[at])
        lo, hi, _ = at.indices(self.n)
        return np.frombuffer(self.file.read_at(max(0, hi - lo) * self.kind.itemsize, lo * self.kind.itemsize), self.kind)


def open_part(path: str, file: str, dtype: str) -> tuple[Stored, Stored, Stored]:
    """(ids, document ids, offsets) of a part."""
    fs, at = _filesystem(path)
    return tuple(Stored(fs, f"{at}/{file}.{kind}", t) for kind, t in (("ids", dtype), ("docs", "<i8"), ("offs", "<i8")))


def read_token_files(spark: SparkSession, path: str, parts: DataFrame | None = None) -> DataFrame:
    """One row per document, read from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian uint32)."""
    parts = spark.read.schema("part long, file string, base long, n_docs long, n_ids long, dtype string").json(f"{path}/manifest") if parts is None else parts
    files = parts.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        for batch in batches:
            for r in batch.to_pylist():
                ids, docs, offs = open_part(path, r["file"], r["dtype"])
                for lo in range(0, len(docs), 10_000):
                    o = offs[lo : lo + 10_001]
                    piece = np.ascontiguousarray(ids[o[0] : o[-1]]).astype("<u4")
                    raw, b = memoryview(piece).cast("B"), (o - o[0]) * 4
                    crc = [zlib.crc32(raw[s:e]) for s, e in zip(b[:-1].tolist(), b[1:].tolist(), strict=True)]
                    d = pa.array(docs[lo : lo + 10_000])
                    yield pa.RecordBatch.from_arrays([pc.if_else(pc.equal(d, -(1 << 63)), None, d), pa.array(o[:-1] + r["base"]), pa.array(np.diff(o)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return parts.repartition(max(1, files), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, tokenizer_path: str, path: str | None = None, **columns) -> DataFrame:
    """Write the files under path (a new folder in the shared directory if none is given) and return their document index."""
    path = path or new_path(docs.sparkSession, "token-files")
    return read_token_files(docs.sparkSession, path, write_token_files(docs, path, tokenizer_path, **columns))
