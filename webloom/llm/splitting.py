"""Items beyond a token limit, cut at natural boundaries into overlapping pieces.

Every text is handled in byte ranges. A range moves both its ends to the next place where the tokenizer
starts afresh whatever stands before (`fresh_start`; the halo it looks in grows until there is one), so it knows
its tokens without its neighbours. Token counts of ranges are stitched by prefix sums. The k-th cut is the best
boundary (paragraph, line, sentence, word, character; the last of the best) of the k-th cell of the token axis,
(k * stride - slack, k * stride], and so depends on no other cut: a range that knows the tokens before it names
the best boundary of each of its cells, and the best of a cell over the ranges that share it is the cut. A piece
is the text between two cuts, led by the last `overlap` tokens of the one before; it is emitted from its byte
offsets. The size of the ranges changes nothing in the result.

A text in a row is in one task's memory already, so its ranges follow one another there and nothing is shuffled
(`split_texts`). Files of any size are spread over tasks range by range and read only where a range or a
piece needs bytes (`split_files`): one pass counts, one pass over the counted ranges finds the cuts, and only
counts and one row a cell and range are exchanged.

No token is lost: without the overlaps the pieces are the text. Every piece encoded on its own has at most
`limit` tokens; the few that a fresh start inflates beyond it are halved. An overlap that would begin inside
a character begins before it.

Defined results: null, empty and short texts give no piece; a wall of text without any boundary is cut
between characters. Files must be UTF-8.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm import tokens as T
from webloom.session import stage_table

SLACK_FOR_RESTART = 16
HALO = 1024
RANGE_BYTES, FILE_RANGE_BYTES = 16 << 10, 256 << 10
BLOCK_RANGES = 4096
FLUSH_BYTES = 8 << 20
_BREAKS = (
    (4, re.compile(rb"\n[ \t\r]*\n\s*")),
    (3, re.compile(rb"\n")),
    (2, re.compile(rb"(?:[.!?]|\xe2\x80\xa6)(?:[\"')\]]|\xc2\xbb|\xe2\x80[\x99\x9d])*(?=\s)|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f")),
)
# places where the tokenizer's pattern ends a match whatever came before: white space after a sign, and changes of the
# kind of sign (an apostrophe may open a contraction with the letter after it)
_FRESH = regex.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}])(?=\p{N})|(?<=[^\s\p{L}\p{N}'])(?=\p{L})")

Read = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Plan:
    limit: int = 2048
    overlap: int = 128
    tokenizer: str = T.RANKS
    range_bytes: int = RANGE_BYTES

    @property
    def room(self) -> int:
        """New tokens a piece may bring."""
        room = self.limit - self.overlap - min(SLACK_FOR_RESTART, self.limit // 16)
        if room < 8:
            raise ValueError("the limit leaves no room beside the overlap")
        return room

    @property
    def slack(self) -> int:
        return max(1, self.room // 5)

    @property
    def stride(self) -> int:
        return self.room - self.slack

    def cuts(self, total: int) -> int:
        """How many cuts a text of so many tokens gets."""
        return 0 if total <= self.limit else -(-total // self.stride) - 1


def fresh_start(read: Read, at: int, size: int, halo: int = HALO) -> int:
    """The first byte >= at of a text of `size` bytes where tokenisation starts afresh. read(start, end) gives its bytes."""
    if at <= 0:
        return 0
    base = max(0, at - 8)
    while at < size:
        data = read(base, min(size, at + halo))
        skip = next(i for i in range(len(data)) if data[i] & 0xC0 != 0x80)
        text = data[skip:].decode("utf-8", "ignore")
        known = len(data[skip : at - base].decode("utf-8", "ignore"))
        for m in _FRESH.finditer(text, max(1, known)):
            found = base + skip + len(text[: m.start()].encode("utf-8"))
            if found >= at:
                return found
        if at + halo >= size:
            break
        halo *= 4
    return size


def counted(part: bytes, plan: Plan) -> int:
    return T.count(part.decode("utf-8"), plan.tokenizer)


def boundaries(part: bytes, follow: bytes, plan: Plan) -> tuple[int, np.ndarray, np.ndarray]:
    """Token count of a part, and of every token its end byte and the quality of a cut there: -1 inside a character, 0 between characters, up to 4 for a paragraph.

    follow: the byte after the part, none at the end of the text.
    """
    ids = T.encode(part.decode("utf-8"), plan.tokenizer)
    ends = np.cumsum(T.lengths(plan.tokenizer)[ids])
    if not len(ids):
        return 0, ends, np.empty(0, np.int8)
    seen = part + (follow or b" ")
    nxt = np.frombuffer(seen, np.uint8)[ends]
    whole = (nxt & 0xC0) != 0x80  # a token may end inside a character
    quality = np.where(whole, 0, -1).astype(np.int8)
    quality[whole & ((nxt == 32) | (nxt == 10))] = 1
    for level, rx in reversed(_BREAKS):
        at = np.fromiter((m.end() for m in rx.finditer(seen) if m.end() <= len(part)), np.int64)
        i = np.searchsorted(ends, at, "right") - 1
        i = i[i >= 0]
        i = i[whole[i]]
        quality[i] = np.maximum(quality[i], level)
    return len(ids), ends, quality


def best_of_cells(part: bytes, follow: bytes, base: int, before: int, plan: Plan) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Token count of a part that begins at byte `base` after `before` tokens, and (cell, quality, tokens, byte) of the best boundary of each cell in it."""
    n, ends, quality = boundaries(part, follow, plan)
    at = before + 1 + np.arange(n)
    cell = -(-at // plan.stride)
    i = np.flatnonzero((at > cell * plan.stride - plan.slack) & (quality >= 0))
    i = i[np.lexsort((at[i], quality[i], cell[i]))]
    last = i[np.append(cell[i][1:] != cell[i][:-1], True)] if len(i) else i
    return n, [(int(cell[j]), int(quality[j]), int(at[j]), base + int(ends[j])) for j in last]


def cuts_of(read: Read, size: int, plan: Plan) -> list[int]:
    """Byte offsets of the cuts of a text, range after range with the tokens summed up on the way."""
    best: dict[int, tuple[int, int, int]] = {}
    total, a = 0, 0
    for no in range(-(-size // plan.range_bytes)):
        b = max(a, fresh_start(read, min(size, (no + 1) * plan.range_bytes), size))
        n, found = best_of_cells(read(a, b), read(b, min(size, b + 1)), a, total, plan)
        for cell, *rest in found:
            best[cell] = max(best.get(cell, (-1, 0, 0)), tuple(rest))
        total, a = total + n, b
    return [best[c][2] for c in sorted(best) if c <= plan.cuts(total)]


def lead(body: bytes, plan: Plan) -> int:
    """Bytes of the last `overlap` tokens of a body, more where they begin inside a character."""
    if plan.overlap <= 0:
        return 0
    ends = np.cumsum(T.lengths(plan.tokenizer)[T.encode(body.decode("utf-8"), plan.tokenizer)])
    i = len(ends) - plan.overlap
    if i <= 0:
        return len(body)
    at = int(ends[i - 1])
    while at > 0 and body[at] & 0xC0 == 0x80:
        at -= 1
    return len(body) - at


def pieces_between(before: bytes, body: bytes, start: int, plan: Plan) -> list[tuple[int, int, str, int]]:
    """(start byte, end byte, text, tokens) of the piece made of `body` led by the end of `before`; halved while it is too long."""
    tail = lead(before, plan) if before else 0
    data = (before[len(before) - tail :] if tail else b"") + body
    text = data.decode("utf-8")
    n = T.count(text, plan.tokenizer)
    if n <= plan.limit or len(body) < 2:
        return [(start - tail, start + len(body), text, n)]
    ends = np.cumsum(T.lengths(plan.tokenizer)[T.encode(body.decode("utf-8"), plan.tokenizer)])
    at = int(ends[max(0, len(ends) // 2 - 1)])
    while at < len(body) and body[at] & 0xC0 == 0x80:
        at += 1
    return pieces_between(before, body[:at], start, plan) + pieces_between(body[:at], body[at:], start + at, plan)


_PIECE = pa.schema([("row_id", pa.int64()), ("cut_no", pa.int64()), ("half", pa.int32()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("n_tokens", pa.int32()), ("text", pa.string())])
_PIECE_DDL = "row_id long, cut_no long, half int, start_byte long, end_byte long, n_tokens int, text string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_PIECE), _PIECE, strict=True)], schema=_PIECE)


def _whole(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, held = [], 0
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = text.as_py().encode("utf-8")
            cuts = cuts_of(lambda a, b, data=data: data[a:b], len(data), plan)
            if not cuts:
                continue
            edges, no = [0, *cuts, len(data)], 0
            for k in range(len(edges) - 1):
                before = data[edges[k - 1] : edges[k]] if k else b""
                for a, b, piece, n in pieces_between(before, data[edges[k] : edges[k + 1]], edges[k], plan):
                    rows.append((row, no, 0, a, b, n, piece))
                    no, held = no + 1, held + b - a
                if held > FLUSH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        yield _batch(rows)


def read_bytes(uri: str, start: int, end: int) -> bytes:
    """Bytes [start, end) of a file, without reading the rest."""
    where, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    with where.open_input_file(path) as f:
        return f.read_at(end - start, start)


def _range(uri: str, no: int, size: int, plan: Plan) -> tuple[int, int]:
    read = lambda a, b: read_bytes(uri, a, b)
    return tuple(fresh_start(read, min(size, at * plan.range_bytes), size) for at in (no, no + 1))


def _count_ranges(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row, uri, no, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            a, b = _range(uri, no, size, plan)
            out.append((row, uri, no, size, a, b, counted(read_bytes(uri, a, b), plan)))
        types = [pa.int64(), pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names=["row_id", "uri", "range_no", "size", "a", "b", "n_tokens"])


def _cut_ranges(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row, uri, size, a, b, first in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            data = read_bytes(uri, a, min(size, b + 1))
            out += [(row, *x) for x in best_of_cells(data[: b - a], data[b - a :], a, first, plan)[1]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], names=["row_id", "cell", "quality", "at", "offset"])


def prefix_sums(rows: DataFrame, key: str, order: str, value: str, out: str, block: int = BLOCK_RANGES) -> DataFrame:
    """rows with `out`, the sum of value over the key's rows before: within blocks of the order, and over blocks; no window holds a whole key."""
    blocked = rows.withColumn("__block", F.floor(F.col(order) / block))
    sums = blocked.groupBy(key, "__block").agg(F.sum(value).alias("__s"))
    ahead = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "__block", F.coalesce(F.sum("__s").over(ahead), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(key, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = blocked.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, [key, "__block"])
    return summed.withColumn(out, F.col("__in") + F.col("__before")).drop("__in", "__before", "__block")


def file_cuts(ranges: DataFrame, plan: Plan) -> DataFrame:
    """(row_id, size, cut_no, offset): the cuts of files given as ranges (row_id, uri, range_no, size)."""
    spread = ranges.repartition("row_id", "range_no")
    counts = stage_table(spread.mapInArrow(lambda it: _count_ranges(it, plan), "row_id long, uri string, range_no long, size long, a long, b long, n_tokens long"), "range-counts")
    totals = counts.groupBy("row_id").agg(F.sum("n_tokens").alias("total"), F.max("size").alias("size")).where(F.col("total") > plan.limit)
    known = prefix_sums(counts.join(totals.select("row_id"), "row_id", "left_semi"), "row_id", "range_no", "n_tokens", "first")
    cells = known.repartition("row_id", "range_no").select("row_id", "uri", "size", "a", "b", "first").mapInArrow(lambda it: _cut_ranges(it, plan), "row_id long, cell long, quality long, at long, offset long")
    best = cells.groupBy("row_id", "cell").agg(F.max(F.struct("quality", "at", "offset")).alias("b"))
    cuts = best.join(totals, "row_id").where(F.col("cell") < F.ceil(F.col("total") / plan.stride))
    return cuts.select("row_id", "size", F.col("cell").alias("cut_no"), F.col("b.offset").alias("offset"))


def _edges(cuts: DataFrame) -> DataFrame:
    """(row_id, cut_no, e0, e1, e2): every piece with the cut before the one it starts at, its start and its end."""
    ends = cuts.groupBy("row_id").agg(F.first("size").alias("size"), F.max("cut_no").alias("last"))
    marks = cuts.select("row_id", "cut_no", "offset").unionByName(ends.select("row_id", F.lit(0).cast("long").alias("cut_no"), F.lit(0).cast("long").alias("offset")))
    marks = marks.unionByName(ends.select("row_id", (F.col("last") + 1).alias("cut_no"), F.col("size").alias("offset")))
    shift = lambda n, name: marks.select("row_id", (F.col("cut_no") + n).alias("cut_no"), F.col("offset").alias(name))
    piece = shift(0, "e1").join(shift(-1, "e2"), ["row_id", "cut_no"]).join(shift(1, "e0"), ["row_id", "cut_no"], "left")
    return piece.select("row_id", "cut_no", "e0", "e1", "e2")


def _emit_file(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, k, uri, e0, e1, e2 in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            first = e1 if e0 is None else e0
            data = read_bytes(uri, first, e2)
            rows = [(row, k, half, a, b, n, t) for half, (a, b, t, n) in enumerate(pieces_between(data[: e1 - first], data[e1 - first :], e1, plan))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)


def _numbered(pieces: DataFrame, id_col: str) -> DataFrame:
    """Pieces of files, which are emitted one by one, numbered from 0 within their file by (cut, half)."""
    # halves are rare: a piece's number is its cut's number plus the halves before it, those of earlier blocks summed, those of its own block listed
    block = F.floor(F.col("cut_no") / BLOCK_RANGES)
    extra = pieces.where("half > 0").groupBy("row_id", block.alias("k")).agg(F.collect_list("cut_no").alias("cs"), F.count(F.lit(1)).alias("n"))
    last = pieces.groupBy("row_id").agg(F.max("cut_no").alias("m"))
    every = last.select("row_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m") / BLOCK_RANGES))).alias("k")).join(extra, ["row_id", "k"], "left")
    ahead = Window.partitionBy("row_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    every = every.select(F.col("row_id").alias("__r"), F.col("k").alias("__k"), "cs", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    joined = pieces.join(every, (F.col("row_id") == F.col("__r")) & (block == F.col("__k")))
    own = F.coalesce(F.size(F.filter(F.coalesce("cs", F.array().cast("array<bigint>")), lambda c: c < F.col("cut_no"))), F.lit(0))
    return joined.select(F.col("row_id").alias(id_col), (F.col("cut_no") + F.col("before") + own + F.col("half")).alias("piece_no"), "start_byte", "end_byte", "n_tokens", "text")


def split_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan | None = None) -> DataFrame:
    """(id, piece_no, start_byte, end_byte, n_tokens, text): the pieces of every text beyond the limit."""
    plan = plan or Plan()
    # a token is one byte at least, so shorter texts can't pass the limit
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")).where(F.octet_length("text") > plan.limit)
    pieces = rows.mapInArrow(lambda it: _whole(it, plan), _PIECE_DDL)
    return pieces.select(F.col("row_id").alias(id_col), F.col("cut_no").alias("piece_no"), "start_byte", "end_byte", "n_tokens", "text")


def oversized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan | None = None) -> DataFrame:
    """The ids of the texts that are cut, from their first pieces."""
    return split_texts(docs, id_col, text_col, plan).where("piece_no = 0").select(id_col)


def split_files(spark: SparkSession, uris: list[str], plan: Plan | None = None) -> DataFrame:
    """(file_no, piece_no, ...) of text files of any size; each task reads only the bytes it needs. uris: read by every executor."""
    plan = plan or Plan(range_bytes=FILE_RANGE_BYTES)
    sizes = []
    for uri in uris:
        where, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
        sizes.append(where.get_file_info(path).size)
    files = spark.createDataFrame([(i, u, s) for i, (u, s) in enumerate(zip(uris, sizes, strict=True))], "row_id long, uri string, size long")
    ranges = files.where("size > 0").select("row_id", "uri", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / plan.range_bytes))).alias("range_no"), "size")
    edges = _edges(stage_table(file_cuts(ranges, plan), "file-cuts"))
    work = edges.join(files.select("row_id", "uri"), "row_id").select("row_id", "cut_no", "uri", "e0", "e1", "e2")
    pieces = stage_table(work.repartition("row_id", "cut_no").mapInArrow(lambda it: _emit_file(it, plan), _PIECE_DDL), "file-pieces")
    return _numbered(pieces, "file_no")
