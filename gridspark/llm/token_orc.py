"""Token ids in ORC: one row per document in ascending doc_id order, written in range-partitioned shards.

ORC's integer run-length encoding stores the ids; row indexes and a Bloom filter on doc_id let readers skip
stripes and row groups, and stripes are read in parallel.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.llm.common import Scratch, one_thread

#: Pieces whose ids a worker remembers, about 200 bytes each, and their greatest length; beyond, the older half is forgotten. Of chunks the first ones met, about an eighth as many.
REMEMBERED, CHUNK_CHARS = 800_000, 64
#: Bytes of text that are encoded at a time, about.
BATCH_BYTES = 2 << 20
#: Bytes of text in a shard, about.
SHARD_BYTES = 256 << 20


def _pairs() -> tuple[np.ndarray, bytes]:
    """Classes of bytes, and of two classes in a row (8 * first + second): 1 where a cut falls between them, 2 where one falls before the first."""
    unsure, letter, digit, mark, other, white, space = range(7)
    classes = np.full(256, unsure, np.uint8)
    classes[0x21:0x7F] = mark
    classes[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = letter
    classes[0x30:0x3A] = digit
    classes[[9, 10, 11, 12, 13]] = white
    classes[0x20] = space
    # an apostrophe may begin a piece of the pattern with the letters behind it; of other scripts only that they are visible is used
    classes[[0x27, *range(0xCA, 0xF5)]] = other
    # first bytes of U+00C0 to U+027F and U+0400 to U+047F, all letters but two; white space and format characters begin with the last four
    classes[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = letter
    classes[[0xC2, 0xE1, 0xE2, 0xE3]] = unsure
    pairs, visible = bytearray(256), (letter, digit, mark, other)
    for a in range(7):
        for b in range(7):
            behind = a in visible and b in (white, space) or a == white and b in visible or a != b and {a, b} <= {letter, digit, mark}
            pairs[8 * a + b] = behind + 2 * (a in (white, space) and b in visible)
    return classes, bytes(pairs)


_CLASSES, _PAIRS = _pairs()


def _cuts(text: np.ndarray) -> np.ndarray:
    """For each byte of a UTF-8 text whether the pattern of byte-level BPE surely begins a piece there.

    That is before white space behind a visible character, before and behind the last of white space (before it only, if it is a space), and between ASCII and
    Latin letters, ASCII digits and ASCII marks; not beside an apostrophe, and nowhere that hangs on the version of Unicode.
    """
    classes = np.frombuffer(text.tobytes().translate(_CLASSES.tobytes()), np.uint8).copy()
    inner = np.flatnonzero((text & 0xC0) == 0x80)
    if len(inner):
        signs = np.flatnonzero((text[:-1] == 0xC3) & ((text[1:] == 0x97) | (text[1:] == 0xB7)))
        classes[signs] = 4
        for _ in range(3):
            classes[inner] = classes[inner - 1]
    pairs = np.frombuffer(((classes[:-1] << 3) | classes[1:]).tobytes().translate(_PAIRS), np.uint8)
    cut = np.zeros(len(text), bool)
    cut[:1] = True
    cut[1:] = pairs & 1
    cut[:-1] |= pairs > 1
    return cut


def _objects(values: pa.Array) -> list:
    """As to_pylist, which makes a scalar of each value first."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _parts(array: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of a large_binary array that starts at its buffers' beginning, where each value begins, and where the last one ends."""
    _, offsets, data = array.buffers()
    return data or pa.py_buffer(b""), np.frombuffer(offsets, np.int64)[: len(array) + 1]


def _binary(data: pa.Buffer, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), data])


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, all by the tokenizers library.

    Byte-level BPE with its own pattern never joins what stands on both sides of a single space between two visible
    characters, and gives the space to what follows. There, and only for tokenizers of that make, a text is cut; the chunks
    first met, common ones among them, are remembered. Others are cut again where the pattern surely does (``_cuts``), since words come back more often
    than words with their marks and lines; pieces are remembered too, and the new ones of a batch go to the library as the lines of one text,
    whose ids are cut again at the ids of line ends. Texts with other white space around a space, or with an added token's string, and all texts
    of other tokenizers, go to the library as they are.
    """

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        one_thread()
        self.tokenizer = Tokenizer.from_file(vocabulary)
        made = json.loads(self.tokenizer.to_str())
        cutter, model = made["pre_tokenizer"] or {}, made["model"]
        plain = (made["normalizer"], made["post_processor"], made["truncation"], made["padding"], model.get("dropout")) == (None,) * 5
        byte_level = cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space")
        #: The id of a line end: no piece of several characters with a line end inside is joined with others.
        self.line_end = self.tokenizer.token_to_id("Ċ")
        self.cuts = bool(plain and byte_level and model["type"] == "BPE" and self.line_end is not None)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Of a chunk met before, whose edges are places to cut: its ids.
        self.known: dict[str, bytes] = {}
        #: Of a piece of chunks met before, as UTF-8: its ids.
        self.pieces: dict[bytes, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each of the pieces, which hold no line end and begin, but for one space, and end with visible characters."""
        ids = np.frombuffer(self._library([b"\n".join(pieces).decode()])[0], "<u4")
        ends = np.flatnonzero(ids == self.line_end)
        if len(ends) != len(pieces) - 1:
            return self._library([p.decode() for p in pieces])
        made, starts = ids.tobytes(), [0, *((ends + 1) * 4).tolist()]
        return [made[a:b] for a, b in zip(starts, [*(ends * 4).tolist(), len(made)], strict=True)]

    def _of_pieces(self, names: list[bytes]) -> list[bytes]:
        """Ids of different pieces."""
        if len(self.pieces) > REMEMBERED:
            self.pieces = dict(islice(self.pieces.items(), len(self.pieces) - REMEMBERED // 2, None))
        found = list(map(self.pieces.get, names))
        new = [p for p, ids in zip(names, found, strict=True) if ids is None]
        if not new:
            return found
        lines = [p for p in new if p.lstrip(b" ").isalpha() or _line(p)]
        learnt = dict(zip(lines, self._lines(lines) if lines else (), strict=True))
        rest = [p for p in new if p not in learnt] if len(lines) < len(new) else []
        learnt.update(zip(rest, self._library([p.decode() for p in rest]), strict=True))
        self.pieces.update(learnt)
        for piece in [p for p in new if len(p) > CHUNK_CHARS]:
            del self.pieces[piece]
        return [learnt[p] if ids is None else ids for p, ids in zip(names, found, strict=True)]

    def _behind_space(self, chunks: list[str]) -> pa.Array:
        """Ids of each chunk, visible at both ends, with a space before it."""
        text = np.frombuffer((" " + " ".join(chunks)).encode(), np.uint8)
        starts = np.flatnonzero(_cuts(text) | (text == 0x20))
        cut = _binary(pa.py_buffer(text), np.append(starts, len(text))).dictionary_encode()
        made = pa.array(self._of_pieces(_objects(cut.dictionary)), pa.large_binary()).take(cut.indices)
        data, begin = _parts(made)
        return _binary(data, begin[np.append(np.flatnonzero(text[starts] == 0x20), len(starts))])

    def encode(self, texts: list[str]) -> list[bytes]:
        made, bounds = self.encode_column(pa.array(texts, pa.large_string()))
        return [made[a:b].to_pybytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode_column(self, texts: pa.Array, end: bytes = b"") -> tuple[pa.Buffer, np.ndarray]:
        """The ids of all texts, of which none is null, with ``end`` behind each; the bytes where they begin, and where the last one ends."""
        if not self.cuts:
            return _parts(pa.array([ids + end for ids in self._library(texts.to_pylist())], pa.large_binary()))
        cut = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(cut).to_numpy()
        heads = np.cumsum(counts) - counts
        chunks = cut.flatten().dictionary_encode()
        names, places = _objects(chunks.dictionary), chunks.indices.to_numpy()
        rest = np.ones(len(places), bool)
        rest[heads] = False
        # each chunk of the batch is looked up once among all that are remembered
        used = np.flatnonzero(np.bincount(places[rest], minlength=len(names)))
        batch = [names[i] for i in used.tolist()]
        found = list(map(self.known.get, batch))
        new = [i for i, ids in enumerate(found) if ids is None]
        good = [i for i in new if _visible(batch[i])]
        learnt = self._behind_space([batch[i] for i in good]) if good else pa.array([], pa.large_binary())
        if len(self.known) < REMEMBERED // 8:
            self.known.update((batch[i], ids) for i, ids in zip(good, _objects(learnt), strict=True) if len(batch[i]) <= CHUNK_CHARS)
        # a text goes to the library up to its first cut, or whole
        alone = [names[i] for i in places[heads].tolist()]
        whole = (counts > 1) & ~np.fromiter(map(_visible, alone), bool, len(alone))
        if len(good) < len(new):
            unsafe = np.zeros(len(names), bool)
            unsafe[used[new]] = True
            unsafe[used[good]] = False
            whole |= np.logical_or.reduceat(unsafe[places] & rest, heads)
        for content in self.added:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(whole).tolist():
            alone[i] = texts[i].as_py()
        # what was found, was learnt, goes alone, and the end, each at its place
        values = pa.concat_arrays([pa.array(found, pa.large_binary()), learnt, pa.array([*self._library(alone), end], pa.large_binary())])
        of = np.zeros(len(names), np.int64)
        of[used] = np.arange(len(used))
        of[used[good]] = len(used) + np.arange(len(good))
        kept = rest & np.repeat(~whole, counts)
        kept[heads] = True
        ends = np.cumsum(np.add.reduceat(kept, heads, dtype=np.int64) + 1) - 1
        places = of[places]
        places[heads] = len(used) + len(good) + np.arange(len(alone))
        order = np.full(ends[-1] + 1, len(values) - 1)
        inner = np.ones(len(order), bool)
        inner[ends] = False
        order[inner] = places[kept]
        made, begin = _parts(values.take(pa.array(order)))
        return made, begin[np.append(0, ends + 1)]


#: Visible characters of ASCII.
_PLAIN = frozenset(map(chr, range(0x21, 0x7F)))


def _visible(chunk: str) -> bool:
    """Whether the first and the last character are there and neither white space nor a format or control character."""
    if chunk and chunk[0] in _PLAIN and chunk[-1] in _PLAIN:
        return True
    return bool(chunk) and chunk[0].isprintable() and chunk[-1].isprintable() and not chunk[0].isspace() and not chunk[-1].isspace()


def _line(piece: bytes) -> bool:
    """Whether a piece can be a line among others."""
    text = piece.decode()
    return "\n" not in text and _visible(text.removeprefix(" "))


@lru_cache(maxsize=2)
def _encoder(vocabulary: str) -> Encoder:
    """One for each Python worker, so that what it remembers outlives a task."""
    return Encoder(vocabulary)


def encode(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """(doc_id, text) to (doc_id, ids): the ids of each whole text, null as empty, and ``end_id`` behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
            lo = 0
            while lo < batch.num_rows:
                # few texts at a time, so that what is held grows with the longest text only
                hi = max(lo + 1, int(np.searchsorted(sizes, BATCH_BYTES + (sizes[lo - 1] if lo else 0), "right")))
                part = batch.slice(lo, hi - lo)
                made, bounds = encoder.encode_column(pc.fill_null(part.column("text"), ""), end)
                ids = pa.ListArray.from_arrays(pa.array((bounds // 4).astype(np.int32)), pa.array(np.frombuffer(made, "<i4")))
                yield pa.record_batch([part.column("doc_id"), ids], ["doc_id", "ids"])
                lo = hi

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>"
    )


def write(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, shards: int | None = None, stride: int = 1000,
    stripe_bytes: int = 32 << 20,
) -> None:
    """Encode and write ``docs`` as ORC in ascending doc_id order (null first), shard after shard.

    Rows: shard int, place long (0, 1, … in the shard), doc_id long, ids array<int>. Without ``shards`` there are as many as the texts have SHARD_BYTES, and at
    least one for each core. Rows of one doc_id, or of none, are in the order of a hash of their texts; so many of them
    are no burden to one shard.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not shards:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = texts.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    (
        encode(ordered, vocabulary, end_id)
        .select(F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"), "doc_id", "ids")
        .write.option("compression", "lz4")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .orc(path)
    )


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(shard, place, doc_id, ids) of a written folder; of some documents, by the row indexes and Bloom filters."""
    rows = spark.read.schema("shard int, place long, doc_id long, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(*doc_ids))


def digest(stored: DataFrame, scratch: Scratch) -> DataFrame:
    """(shard, place, doc_id, ids) to (doc_id, start, n_tokens, ids_crc32), from the ids alone.

    ``start`` counts the ids of all documents before, in the order in which they lie in the files: a sum over shards (one row each) plus a running sum within the
    shard.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy().astype("<i4", copy=False)
            sums = [zlib.crc32(values[a:b].data) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch(
                [*[batch.column(c) for c in ("shard", "place", "doc_id")], pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
                ["shard", "place", "doc_id", "n_tokens", "ids_crc32"],
            )

    rows = stored.select("shard", "place", "doc_id", "ids").mapInArrow(check, "shard int, place long, doc_id long, n_tokens long, ids_crc32 long")
    rows = scratch.write(rows, "digest")
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    shards = rows.groupBy(F.col("shard").alias("s")).agg(F.sum("n_tokens").alias("n"))
    starts = shards.select("s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard").orderBy("place")
    run = F.sum("n_tokens").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return (
        rows.withColumn("run", run)
        .join(starts, F.col("shard") == F.col("s"))
        .select("doc_id", (F.col("first") + F.col("run")).alias("start"), "n_tokens", "ids_crc32")
    )


def encode_to_orc(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` to ``path`` and return the digest of what is read back, one row per row of ``docs``.

    A null text counts as empty and holds the end id alone; null doc_ids come first; repeated rows are all written;
    other columns are not read; an empty table gives an empty folder and no rows.
    """
    write(docs, path, vocabulary, end_id)
    return digest(read(docs.sparkSession, path), Scratch(docs.sparkSession, "tokens"))
