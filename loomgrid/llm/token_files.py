"""Token-ID output: flat files of unsigned integers plus 64-bit document offsets.

Documents are dealt to ranges of their id, so that file order is id order. Each task encodes its
range and writes two files, ``<name>.ids`` (token ids, little-endian, 16 bits if the vocabulary
fits, else 32) and ``<name>.idx`` (one little-endian int64 for each document, the end of its ids
in the file). A manifest row names the files of the attempt that committed; files of lost or
repeated attempts are never referred to. Prefix sums over the manifest give each file's base.

``read_documents`` maps the files into memory where they are local and streams them elsewhere.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.batches import text_batches
from loomgrid.scratch import scratch_path, settle

MANIFEST = "part int, name string, n_docs long, n_tokens long"
#: Latin letters and punctuation between which a byte-level BPE's pre-tokenizer always cuts. The
#: apostrophe is missing, since contractions may cross it.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = ".,;:!?|#&*%()"
#: Pieces of a text, each a whole number of pre-tokens.
PIECE = re.compile(rf" ?[{LETTERS}]+(?=[\s{MARKS}]|\Z)| ?[{MARKS}]+(?=[\s{LETTERS}]|\Z)| ?\S+|\s+(?!\S)|\s+")
#: Regex engines differ on whether these are white space.
UNSURE = re.compile(r"[\x1c-\x1f\x85]")
#: One pre-token whose first token is the only one that starts with a space.
WORD = re.compile(rf" [{LETTERS}]+")
MEMO = 500_000


class PieceCodes(dict):
    """Numbers pieces in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        code = self[piece] = len(self)
        self.fresh.append(piece)
        return code


class PieceEncoder:
    """Encodes whole texts with a byte-level BPE tokenizer, each distinct piece once.

    A text is cut where the tokenizer's pre-tokenizer always cuts too, so the ids of the pieces,
    joined, are the ids of the text. Texts with added tokens or doubtful white space are one piece.
    """

    def __init__(self, tokenizer_json: str, dtype: str, end_id: int):
        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.np = np
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        # Pieces come once, so remembering their merges would not help.
        self.tokenizer.model._resize_cache(0)
        self.dtype = dtype
        self.end_id = end_id
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.leads = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.leads[i] = token.startswith("Ġ")  # a space, as byte-level vocabularies write it
        self.forget()

    def forget(self) -> None:
        """Start anew; code 0 is the end of a document."""
        np = self.np
        self.codes = PieceCodes()
        self.codes[None] = 0
        self.ids = np.array([self.end_id], self.dtype)
        self.used = 1
        self.begins = np.zeros(1, np.int64)
        self.counts = np.ones(1, np.int64)

    def cut(self, text: str) -> list[str]:
        if UNSURE.search(text) or any(a in text for a in self.added):
            return [text]
        return PIECE.findall(text)

    def run(self, pieces: list[str]):
        """The ids of some pieces, joined, and how many each has."""
        np = self.np
        if all(map(WORD.fullmatch, pieces)):
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            starts = np.flatnonzero(self.leads[ids])
            if len(starts) == len(pieces):
                return ids, np.diff(np.append(starts, len(ids)))
        found = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, dtype=self.dtype), np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(pieces))

    def learn(self) -> None:
        """Encode the pieces that have been asked for since the last call."""
        np = self.np
        words = [bool(WORD.fullmatch(p)) for p in self.codes.fresh]
        ids, counts, order = [self.ids], [], []
        for kind in (True, False):
            some = [i for i, w in enumerate(words) if w == kind]
            for at in range(0, len(some), 20_000):
                part = some[at : at + 20_000]
                found, sizes = self.run([self.codes.fresh[i] for i in part])
                ids.append(found)
                counts.append(sizes)
                order += part
        if not order:
            return
        # Codes are in order of asking; their ids may lie in any order.
        counts = np.concatenate(counts)
        begins = self.used + np.cumsum(counts) - counts
        back = np.argsort(np.array(order))
        self.ids = np.concatenate(ids)
        self.begins = np.concatenate([self.begins, begins[back]])
        self.counts = np.concatenate([self.counts, counts[back]])
        self.used = len(self.ids)
        self.codes.fresh.clear()

    def encode(self, texts: list[str]):
        """The ids of all texts, each followed by the end id, and where each text ends."""
        np = self.np
        if len(self.codes) > MEMO:
            self.forget()
        code = self.codes.__getitem__
        coded = []
        for text in texts:
            pieces = self.cut(text)
            pieces.append(None)
            coded.append(np.fromiter(map(code, pieces), dtype=np.int32, count=len(pieces)))
        self.learn()
        last = np.cumsum([len(c) for c in coded]) - 1
        coded = np.concatenate(coded)
        counts = self.counts[coded]
        upto = np.cumsum(counts)
        place = np.arange(upto[-1]) + np.repeat(self.begins[coded] - (upto - counts), counts)
        return self.ids[place], upto[last]


_ENCODERS: dict[tuple[int, str, int], PieceEncoder] = {}


def encoder_of(tokenizer_json: str, dtype: str, end_id: int) -> PieceEncoder:
    """The encoder of this worker process, which outlives a task and is loaded once."""
    key = (zlib.crc32(tokenizer_json.encode()), dtype, end_id)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(tokenizer_json, dtype, end_id)
    return _ENCODERS[key]


def _batches(column: pa.Array, most_chars: int = 4_000_000, most_rows: int = 512) -> Iterator[list[str]]:
    texts: list[str] = []
    chars = 0
    for value in column:
        texts.append(value.as_py() or "")
        chars += len(texts[-1])
        if chars >= most_chars or len(texts) >= most_rows:
            yield texts
            texts, chars = [], 0
    if texts:
        yield texts


def _writer(tokenizer_json: str, dtype: str, folder: str, end_id: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        store, base = fs.FileSystem.from_uri(folder)
        docs = tokens = 0
        ids = idx = None
        for batch in batches:
            for texts in _batches(batch.column(0)):
                if ids is None:
                    store.create_dir(base, recursive=True)
                    ids = store.open_output_stream(f"{base}/{name}.ids")
                    idx = store.open_output_stream(f"{base}/{name}.idx")
                found, ends = encoder_of(tokenizer_json, dtype, end_id).encode(texts)
                ids.write(found.astype(dtype, copy=False).tobytes())
                idx.write((tokens + ends).astype("<i8").tobytes())
                docs += len(texts)
                tokens += len(found)
        if docs:
            ids.close()
            idx.close()
            # The worker goes on to other tasks; the pieces of this one must not stay in its memory.
            encoder_of(tokenizer_json, dtype, end_id).forget()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "name": name, "n_docs": docs, "n_tokens": tokens}],
                schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    return write


def _reader(dtype: str, folder: str, chunk_docs: int = 4096) -> Callable:
    schema = pa.schema(
        [("part", pa.int32()), ("place", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        width = np.dtype(dtype).itemsize

        def opened(path: str):
            return pa.memory_map(path, "r") if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)

        for batch in batches:
            for row in batch.to_pylist():
                with opened(f"{base}/{row['name']}.idx") as index, opened(f"{base}/{row['name']}.ids") as ids:
                    last = 0
                    for at in range(0, row["n_docs"], chunk_docs):
                        n = min(chunk_docs, row["n_docs"] - at)
                        ends = np.frombuffer(index.read_at(8 * n, 8 * at), dtype="<i8")
                        starts = np.concatenate([[last], ends[:-1]])
                        sums = [
                            zlib.crc32(np.frombuffer(ids.read_at(int(b - a) * width, int(a) * width), dtype=dtype).astype("<u4").tobytes())
                            for a, b in zip(starts, ends)
                        ]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([row["part"]] * n, pa.int32()),
                                pa.array(np.arange(at, at + n), pa.int64()),
                                pa.array(row["base"] + starts, pa.int64()),
                                pa.array(ends - starts, pa.int64()),
                                pa.array(sums, pa.int64()),
                            ],
                            schema=schema,
                        )
                        last = int(ends[-1])

    return read


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str | None = None,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_file: int = 16_000,
) -> tuple[DataFrame, DataFrame, str, str]:
    """Encode every whole text and write token files in ascending id order.

    Returns ``(manifest, keys, folder, dtype)``. The manifest has one row a file: ``part, name,
    n_docs, n_tokens, base`` with ``base`` the number of ids before the file. ``keys`` has
    ``part, place, id``: the document at each place of each file. ``end_id`` ends every document; a
    null text is empty and has this id only. Rows without an id come first; rows with equal ids are
    ordered by text. An empty table writes no files; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    from tokenizers import Tokenizer

    dtype = "<u2" if Tokenizer.from_str(tokenizer_json).get_vocab_size() <= 2**16 and end_id < 2**16 else "<u4"

    # Ranges of ids with about equal numbers of rows. Splitting by sampled quantiles reads ids only;
    # a range partitioning would sample the texts with them.
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    files = max(1, -(-ids.count() // rows_per_file))
    marks = ids.agg(F.percentile_approx("id", [(i + 1) / files for i in range(files - 1)], 100_000).alias("q")).head()["q"] if files > 1 else []
    marks = sorted(set(marks or []))
    part = F.lit(0)
    if marks:
        # Binary search by halving steps: the number of marks below the id.
        table = F.split(F.lit(",".join(map(str, marks))), ",").cast("array<bigint>")
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(marks).bit_length()))])
        advance = lambda low, step: F.when(F.get(table, low + step - 1) < F.col("id"), low + step).otherwise(low)
        part = F.coalesce(F.aggregate(steps, F.lit(0), advance), F.lit(0))
    placed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = placed.withColumn("part", part).repartitionById(len(marks) + 1, F.col("part"))
    placed = placed.sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    keyed = text_batches(placed).select("text").mapInArrow(_writer(tokenizer_json, dtype, folder, end_id), MANIFEST)
    manifest = settle(keyed, "token-manifest")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)))

    in_part = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first())
    keys = ids.withColumn("part", part).select("part", (F.row_number().over(in_part) - 1).cast("long").alias("place"), "id")
    return manifest, keys, folder, dtype


def read_documents(manifest: DataFrame, folder: str, dtype: str) -> DataFrame:
    """One row a document, from the files: ``part, place, start, n_tokens, ids_crc32``.

    ``place`` is the document's position in its file and ``start`` the number of ids before it in all
    files. ``ids_crc32`` is over its ids as little-endian unsigned 32-bit integers.
    """
    spread = manifest.repartition(F.col("part"))
    return spread.mapInArrow(_reader(dtype, folder), "part int, place long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write token files for ``docs`` and read them back: ``id, start, n_tokens, ids_crc32``.

    Null and empty texts are the end id alone; texts of any length are encoded whole. Rows without an id come first, and
    rows that share one stand by their texts. An empty table gives no rows; other columns are ignored.
    """
    manifest, keys, folder, dtype = write_token_files(docs, tokenizer_path, **options)
    # Spark takes the documents read for as few as the manifest's rows; they must not be broadcast.
    return read_documents(manifest, folder, dtype).join(keys.hint("merge"), ["part", "place"]).select("id", "start", "n_tokens", "ids_crc32")
