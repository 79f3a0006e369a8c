"""Token ids of all documents in ascending id order, as patched frame-of-reference files.

Documents are range-partitioned by id and sorted; each task encodes its texts as they stream by and
writes one file to the shared folder under a name of its own attempt.  The manifest (file, documents,
tokens) is a table of the attempts that succeeded, so a lost executor leaves at worst an unused file.
Running sums over the manifest give every file its first position; readers take a file each.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.pretokens import ODD, PLAIN
from weftgraph.llm.shared import documents, fresh_path, partitions, stored, text_or_empty
from weftgraph.llm.token_file import TokenFileReader, TokenFileWriter

#: Pieces whose ids a worker remembers; when full it starts anew.
REMEMBERED = 2_000_000
#: Texts that are encoded at a step, in characters, and new words that the library gets as one text.
STEP, TOGETHER = 500_000, 256
MANIFEST = "part int, path string, n_docs long, n_tokens long, n_bytes long"


class PieceEncoder:
    """Ids of whole texts by a tokenizer of the ``tokenizers`` library.

    Byte-level BPE never merges across pieces, so the library is asked once for each distinct piece.
    Texts with signs outside Latin letters, or with a special token's string, go to it as a whole.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, found: set[str]) -> None:
        """Remember the ids of new pieces.

        Words that begin with a space are handed over side by side, as a text whose pieces they are,
        and told apart by the word numbers that the library gives with the ids.
        """
        words, rest = [], []
        for piece in found:
            # A piece that begins with a space and a letter is all letters.
            (words if piece[0] == " " and piece[1:2].isalpha() else rest).append(piece)
        self.known.update(zip(rest, self._library(rest), strict=True))
        groups = [words[lo : lo + TOGETHER] for lo in range(0, len(words), TOGETHER)]
        for group, e in zip(groups, self.tokenizer.encode_batch(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = np.searchsorted(np.array(e.word_ids), np.arange(len(group) + 1))
            self.known.update((piece, ids[a:b].tobytes()) for piece, a, b in zip(group, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out: list[bytes | None] = []
        waiting: list[tuple[int, list[bytes | None], list[tuple[int, str]]]] = []
        missing: set[str] = set()
        for text in texts:
            if ODD.search(text) or any(s in text for s in self.special):
                out.append(self._library([text])[0])
                continue
            found = PLAIN.findall(text)
            # One look-up a piece; only pieces that aren't known yet are looked up again.
            got = [*map(self.known.get, found)]
            gaps = [(i, found[i]) for i, ids in enumerate(got) if ids is None]
            missing.update(piece for _, piece in gaps)
            waiting.append((len(out), got, gaps))
            out.append(None)
        self._learn(missing)
        for at, got, gaps in waiting:
            for i, piece in gaps:
                got[i] = self.known[piece]
            out[at] = b"".join(got)
        return out


@lru_cache(1)
def encoder(tokenizer_path: str) -> PieceEncoder:
    return PieceEncoder(tokenizer_path)


def filesystem(uri: str):
    """File system and path of a URI of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def steps(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch, some texts at a time."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        ids.append(doc_id)
        texts.append(text.as_py())
        size += len(texts[-1])
        if size > STEP:
            yield ids, texts
            ids, texts, size = [], [], 0
    yield ids, texts


def write_token_files(docs: DataFrame, tokenizer_path: str, *, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; returns the manifest with each file's first position.

    A null text has no ids but the end id.  Null document ids come first; rows with equal ids follow
    each other by text.  An empty table has an empty manifest.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids_of = encoder(tokenizer_path).encode
        end = np.array([] if end_id is None else [end_id], "<u4")
        system, base = filesystem(folder)
        path, writer, n = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.pfor", None, 0
        for batch in batches:
            if writer is None and batch.num_rows:
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(path)
                writer = TokenFileWriter(out)
            for ids, texts in steps(batch):
                for doc_id, found in zip(ids, ids_of(texts), strict=True):
                    writer.add(doc_id, np.concatenate([np.frombuffer(found, "<u4"), end]))
                n += len(ids)
        if writer is not None:
            size = writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_docs": n, "n_tokens": writer.n_tokens, "n_bytes": size}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).repartitionByRange(partitions(spark), "doc_id")
    manifest = stored(dealt.sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST), "token-manifest")
    # One row a file: the window runs over file names, never over documents.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).withColumn("folder", F.lit(folder))


def read_token_files(manifest: DataFrame, digest=None) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian u32), or what ``digest`` makes of them: (name, type, function)."""
    name, kind, function = digest or ("ids", "binary", bytes)
    arrow = {"binary": pa.binary(), "long": pa.int64()}[kind]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, _ = filesystem(row["folder"])
                with system.open_input_file(row["path"]) as file:

                    def read_at(start: int, length: int, file=file) -> bytes:
                        file.seek(start)
                        return file.read(length)

                    at, rows = row["first"], []
                    for doc_id, ids in TokenFileReader(read_at, file.size()).documents():
                        rows.append((doc_id, at, len(ids), function(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(rows) == 2000:
                            yield as_batch(rows)
                            rows = []
                    yield as_batch(rows)

    def as_batch(rows):
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.int64(), arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "n_tokens", name])

    spark = manifest.sparkSession
    return manifest.repartition(partitions(spark), "part").mapInArrow(read, f"doc_id long, start long, n_tokens long, {name} {kind}")


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(manifest, ("ids_crc32", "long", zlib.crc32))
