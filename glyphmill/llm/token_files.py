"""Token-ID files: flat unsigned integers plus 64-bit document offsets, memory-mapped.

Documents are range-partitioned and sorted by id; every task encodes its documents and streams three files into the shared
folder: `.bin` (ids as little-endian uint16, or uint32 when the vocabulary needs it), `.idx` (uint64 offsets in ids, one more
than documents) and `.ids` (an Arrow file of document ids). A manifest holds the counts per file; their prefix sums are the
bases that make local offsets global. Only one row per file reaches the driver.

Files are written under a name of their own per attempt and then renamed, so a retried or speculative task leaves whole files.

Encoding by distinct words: this byte-level BPE never merges across a single space (or line feed) between two visible
characters, so a text is the concatenation of its words, each with its leading space. A task encodes every distinct word of
about PIECE bytes of text once, many words in one call of the tokenizers library, and remembers nothing beyond them, so its memory
doesn't depend on how many words there are, or on how long they are. Texts with runs of white space are split only at the safe
places. Results equal whole-text encoding.

Cases: a null or empty text has only its end id; null ids come first; repeated rows are written each; an empty table gives no
file and an empty result; other columns are not read."""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words

#: Bytes of text whose distinct words are encoded together.
PIECE = 12 << 20
PARTS = "part int, n_docs long, n_tokens long"


class WordEncoder:
    """Encodes batches of texts with a `tokenizers` file, each distinct word of a batch once."""

    SAFE = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        # byte-level vocabularies write the space as U+0120
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.spaced = np.array([n.startswith("\u0120") for n in names], bool)
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def encode_strings(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, values: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word) for words that follow `before`, a space or a line feed (whose own
        ids belong to the word only if it is the space). Many words go into one call: the library finds the same ids as for
        one word alone, since it never merges across these two; where their number differs from the words', it is asked word by word."""
        if not len(values):
            return np.zeros(0, self.dtype), np.zeros(0, "int64")
        ends = np.append(np.arange(0, len(values), 1000), len(values))
        runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.scalar(before.encode(), values.type)).cast(pa.large_string()).to_pylist()
        out, sizes = [], []
        for run, a, b in zip(self.encode_strings([before + r for r in runs]), ends.tolist(), ends[1:].tolist()):
            cuts = np.flatnonzero(self.spaced[run] if before == " " else run == self.feed[0])
            if len(cuts) != b - a or cuts[0]:
                words_ = values.slice(a, b - a).cast(pa.large_string()).to_pylist()
                own = self.encode_strings([" " + w for w in words_] if before == " " else words_)
                out += own
                sizes.append([len(x) for x in own])
                continue
            size = np.diff(np.append(cuts, len(run)))
            if before != " ":
                keep = np.ones(len(run), bool)
                keep[cuts] = False
                run, size = run[keep], size - 1
            out.append(run)
            sizes.append(size)
        return np.concatenate(out), np.concatenate(sizes).astype("int64")

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of every text (null: none), as bytes."""
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n ").cast(pa.large_binary()), " ")
        flat = pc.dictionary_encode(lists.flatten())
        codes, starts = flat.indices.to_numpy(), lists.offsets.to_numpy().astype("int64")
        starts -= starts[0]
        named = flat.dictionary.cast(pa.large_string())
        feed_code = pc.index(flat.dictionary, pa.scalar(b"\n", flat.dictionary.type)).as_py()
        odd_word = pc.or_(pc.equal(named, ""), pc.and_(pc.not_equal(named, pc.utf8_trim_whitespace(named)), pc.not_equal(named, "\n"))).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(texts)), np.diff(starts))
        odd = np.bincount(doc[odd_word[codes]], minlength=len(texts)) > 0
        # a word follows a space unless it begins its text or line; the line feed is a word of its own
        feed = codes == feed_code
        bare = feed.copy()
        bare[1:] |= feed[:-1]
        bare[starts[:-1][np.diff(starts) > 0]] = True
        if odd.any():  # texts with runs of white space are encoded below
            plain = ~odd[doc]
            codes, bare, doc = codes[plain], bare[plain], doc[plain]
            starts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])
        both = codes.astype("int64") * 2 + bare
        keys = np.flatnonzero(np.bincount(both, minlength=2 * len(named)))
        number = np.zeros(2 * len(named), "int32")
        ids, lens = [], []
        for before, own in ((" ", keys[keys % 2 == 0]), ("\n", keys[(keys % 2 == 1) & (keys >> 1 != feed_code)])):
            number[own] = sum(map(len, lens)) + np.arange(len(own))
            got, n = self.encode_words(flat.dictionary.take(pa.array(own >> 1)), before)
            ids.append(got)
            lens.append(n)
        if feed_code >= 0:
            number[2 * feed_code + 1] = sum(map(len, lens))
            ids.append(np.array(self.feed, self.dtype))
            lens.append(np.array([len(self.feed)]))
        lens, at = np.concatenate(lens).astype("int64"), number[both]
        ends = np.concatenate([[0], np.cumsum(lens[at])])[starts].tolist()
        whole = words.gather(at, lens, np.concatenate(ids)).tobytes()
        w = np.dtype(self.dtype).itemsize
        out = [whole[a * w:b * w] for a, b in zip(ends, ends[1:])]
        self.encode_odd(texts, np.flatnonzero(odd).tolist(), out)
        return out

    def encode_odd(self, texts: pa.Array, which: list[int], out: list[bytes]) -> None:
        """Texts with runs of white space: cut at single spaces between visible characters only, each distinct piece once."""
        known: dict[str, bytes] = {}
        for at in range(0, len(which), 64):
            cut = []
            for i in which[at:at + 64]:
                first, *rest = self.SAFE.split(texts[i].as_py())
                cut.append([first, *[" " + r for r in rest]])
            new = [p for p in dict.fromkeys(p for ps in cut for p in ps) if p and p not in known]
            known.update(zip(new, (x.tobytes() for x in self.encode_strings(new))))
            for i, ps in zip(which[at:at + 64], cut):
                out[i] = b"".join([known[p] for p in ps if p])
            if sum(map(len, known)) > words.PIECE:
                known = {}


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _name(path: str, part: int, kind: str) -> str:
    return f"{path}/part-{part:06d}.{kind}"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, dtype: str = "uint16") -> list[tuple[int, int, int, int]]:
    """Write docs(doc_id, text) in ascending order of doc_id; returns the manifest (part, n_docs, n_tokens, base)."""
    end, width = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
    fs, path = _fs(folder)
    fs.create_dir(path, recursive=True)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    arrow_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(id_type, pa.string())

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(folder)
        part, tag = TaskContext.get().partitionId(), uuid.uuid4().hex
        encoder, offsets, ids, out = None, [0], [], None
        for batch in batches:
            for piece in words.pieces(batch, 1, PIECE):
                if encoder is None:
                    encoder = words.kept_in_worker(f"{tokenizer} {dtype}", lambda: WordEncoder(tokenizer, dtype))
                    out = fs.open_output_stream(_name(path, part, "bin") + tag)
                for got in encoder.encode(piece.column(1)):
                    out.write(got)
                    out.write(end)
                    offsets.append(offsets[-1] + len(got) // width + 1)
                ids.append(piece.column(0).cast(arrow_type))
        if out is None:
            return
        out.close()
        with fs.open_output_stream(_name(path, part, "idx") + tag) as f:
            f.write(np.array(offsets, "<u8").tobytes())
        with fs.open_output_stream(_name(path, part, "ids") + tag) as f:
            table = pa.table({"doc_id": pa.chunked_array(ids)})
            with pa.ipc.new_file(f, table.schema) as w:
                w.write_table(table)
        for kind in ("bin", "idx", "ids"):
            fs.move(_name(path, part, kind) + tag, _name(path, part, kind))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [len(offsets) - 1], "n_tokens": [offsets[-1]]})

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    parts = sorted(tuple(r) for r in ordered.mapInArrow(shard, PARTS).collect())
    bases = np.cumsum([0, *(n for *_, n in parts)]).tolist()
    manifest = [(*p, base) for p, base in zip(parts, bases)]
    with fs.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps({"dtype": dtype, "end_id": end_id, "id_type": id_type, "parts": manifest}).encode())
    return manifest


def _array(fs: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """Memory-mapped where the file is local to this machine's file system, read otherwise."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    fs, path = _fs(folder)
    with fs.open_input_stream(f"{path}/manifest.json") as f:
        meta = json.loads(f.read())
    dtype, parts = "<u2" if meta["dtype"] == "uint16" else "<u4", [tuple(p) for p in meta["parts"]]

    def documents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _fs(folder)
        for frame in frames:
            for part, base in zip(frame["part"], frame["base"]):
                ids, offsets = _array(fs, _name(path, part, "bin"), dtype), _array(fs, _name(path, part, "idx"), "<u8").astype("int64")
                with fs.open_input_file(_name(path, part, "ids")) as f:
                    doc_ids = pa.ipc.open_file(f).read_all().column(0)
                for at in range(0, len(offsets) - 1, 10_000):
                    cut = offsets[at:at + 10_001]
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                    yield pd.DataFrame({"doc_id": doc_ids.slice(at, len(cut) - 1).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get),
                                        "start": base + cut[:-1], "n_tokens": np.diff(cut), "ids_crc32": sums})

    todo = spark.createDataFrame(parts, "part int, n_docs long, n_tokens long, base long").select("part", "base")
    todo = todo.repartition(max(1, len(parts)), "part") if parts else todo
    return todo.mapInPandas(documents, f"doc_id {meta['id_type']}, start long, n_tokens long, ids_crc32 long")
