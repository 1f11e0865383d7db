"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over eight bytes cuts each text into chunks, so that a passage gives equal chunks wherever it
stands. Chunks are counted by a 128-bit digest. A chunk that occurs more than once is encoded once, by the first
document that holds it, and its ids are joined to the other occurrences; a chunk that occurs once is encoded where
it stands. Chunks may begin and end inside a word, so each join is repaired: the text from the last safe place of
the left chunk to the first safe place of the right one is encoded anew, together with a wider window, and the
window grows until both agree on the ids they share.

The ids equal those of the tokenizers library on the whole text. Only digests of chunks, the ids of shared chunks
and each text once (compressed) are shuffled.

Cases: null texts count as empty and give no ids; equal rows are encoded alike and all kept; a text without any
safe place is encoded as a whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiline.llm import pieces
from lexiline.llm.common import small_batches, stored

MEAN_BITS = 10  # chunks of about 2**MEAN_BITS bytes
LEAST, MOST = 256, 8192
GEAR = np.uint64(0x9E3779B97F4A7C15)
SIGN = 1 << 63


def ends_of(data: bytes) -> list[int]:
    """Ends of the chunks of a text in UTF-8; all lie between characters."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    window = np.ndarray((n - 7,), dtype="<u8", buffer=data, strides=(1,))
    places = np.flatnonzero((window * GEAR) >> np.uint64(64 - MEAN_BITS) == 0) + 8
    raw = np.frombuffer(data, dtype=np.uint8)
    places = [int(p) for p in places if p < n and raw[p] & 0xC0 != 0x80]
    out, at = [], 0
    for p in [*places, n]:
        while p - at > MOST:
            at += MOST
            while raw[at] & 0xC0 == 0x80:
                at -= 1
            out.append(at)
        if p - at >= LEAST or p == n:
            if p > at:
                out.append(p)
            at = p
    return out


def signed(x: int) -> int:
    return x - 2 * SIGN if x >= SIGN else x


def digest(data: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(data)
    return signed(x >> 64), signed(x & (2 * SIGN - 1))


def prepare(docs: DataFrame) -> DataFrame:
    """One row per document: a key of the row, its text compressed, and the ends and digests of its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = text.encode()
                ends = ends_of(data)
                found = [digest(data[a:z]) for a, z in zip([0, *ends], ends)]
                key = digest(b"%s\0" % str(doc_id).encode() + data)
                rows.append((*key, doc_id, pack.compress(data), ends, [d[0] for d in found], [d[1] for d in found]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)],
                ["r1", "r2", "doc_id", "body", "ends", "k1", "k2"],
            ) if rows else b.slice(0, 0).select([])

    small_batches(docs.sparkSession, 500)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return source.mapInArrow(run, "r1 long, r2 long, doc_id long, body binary, ends array<int>, k1 array<long>, k2 array<long>")


def marks_of(parts: list[str], memo: dict[str, bytes]) -> tuple[bytes, list[int]]:
    """Packed ids of a chunk given as pieces, and eight marks: place and bytes of ids before it, for the first safe
    place and the one after it, then for the one before the last and the last. Without a safe place the first is -1."""
    ids = [memo[p] for p in parts]
    whole = b"".join(ids)
    n = len(parts)
    if n < 2:
        return whole, [-1] * 8
    length = sum(map(len, parts))
    second, before = min(2, n - 1), max(1, n - 2)

    def near(k: int) -> tuple[int, int]:
        if k <= 2:
            return sum(map(len, parts[:k])), sum(map(len, ids[:k]))
        return length - sum(map(len, parts[k:])), len(whole) - sum(map(len, ids[k:]))

    return whole, [*near(1), *near(second), *near(before), *near(n - 1)]


def chunks_of(body: bytes, ends: list[int], unpack) -> list[str]:
    data = unpack.decompress(body) if ends else b""
    return [data[a:z].decode() for a, z in zip([0, *ends], ends)]


def encode_shared(rows: DataFrame, path: str) -> DataFrame:
    """Encode the chunks that `todo` names: (k1, k2, ids, marks), the ids packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, unpack = pieces.encoder(path), zstandard.ZstdDecompressor()
        for b in batches:
            keys, texts = [], []
            for body, ends, todo in zip(*(b.column(c).to_pylist() for c in ("body", "ends", "todo")), strict=True):
                if todo:
                    chunks = chunks_of(body, ends, unpack)
                    keys += [(t["k1"], t["k2"]) for t in todo]
                    texts += [chunks[t["seq"]] for t in todo]
            parts = [pieces.cut(t) for t in texts]
            memo = enc.learn(parts)
            done = [marks_of(p, memo) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()),
                    pa.array([i for i, _ in done], pa.binary()),
                    pa.array([m for _, m in done], pa.list_(pa.int32())),
                ],
                ["k1", "k2", "ids", "marks"],
            )

    return rows.mapInArrow(run, "k1 long, k2 long, ids binary, marks array<int>")


def repaired(chunks: list[str], done: list[tuple[bytes, list[int]]]) -> list[list]:
    """What the joins of one text need: for each the left chunk, the right chunk, and the texts of the two windows.

    Chunks without a safe place in between belong to the join. The ends of the text are safe places.
    """
    joins = []
    left, carry = None, ""
    for i, (chunk, (_, m)) in enumerate(zip(chunks, done, strict=True)):
        if m[0] < 0:
            carry += chunk
            continue
        if i:
            before = chunks[left][done[left][1][4] : done[left][1][6]] if left is not None else ""
            joins.append([left, i, carry + chunk[: m[0]], before + carry + chunk[: m[2]]])
        left, carry = i, chunk[m[6] :]
    if left is None or left < len(chunks) - 1:
        before = chunks[left][done[left][1][4] : done[left][1][6]] if left is not None else ""
        joins.append([left, None, carry, before + carry])
    return joins


def joined(chunks: list[str], done: list, joins: list[list], narrow: list[bytes], wide: list[bytes], raw) -> bytes:
    """Ids of the whole text from those of its chunks and of the windows at its joins."""
    at_left = {j[0]: k for k, j in enumerate(joins)}
    at_right = {j[1]: k for k, j in enumerate(joins)}
    for k, (left, right, _, _) in enumerate(joins):
        head = done[left][0][done[left][1][5] : done[left][1][7]] if left is not None else b""
        tail = done[right][0][done[right][1][1] : done[right][1][3]] if right is not None else b""
        if wide[k] != head + narrow[k] + tail:
            return raw(["".join(chunks)])[0]  # no agreement at the next safe places: the window grows to the text
    out = [narrow[at_left[None]]] if None in at_left else []
    for i, (ids, m) in enumerate(done):
        if m[0] < 0:
            continue
        first = m[1] if i in at_right else 0
        last = m[7] if i in at_left else len(ids)
        out.append(ids[first:last])
        if i in at_left:
            out.append(narrow[at_left[i]])
    return b"".join(out)


def assemble(rows: DataFrame, path: str, finish: Callable, schema: str) -> DataFrame:
    """Ids of each whole document from `shared` ids and its own chunks; `finish(doc_ids, ids, tokenizer)` makes the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, unpack = pieces.encoder(path), zstandard.ZstdDecompressor()
        for b in batches:
            texts = [chunks_of(body, ends, unpack) for body, ends in zip(b.column("body").to_pylist(), b.column("ends").to_pylist(), strict=True)]
            given = [{s["seq"]: (s["ids"], s["marks"]) for s in got or ()} for got in b.column("shared").to_pylist()]
            own = [{i: pieces.cut(c) for i, c in enumerate(t) if i not in g} for t, g in zip(texts, given, strict=True)]
            memo = enc.learn([p for o in own for p in o.values()])
            done = [[g[i] if i in g else marks_of(o[i], memo) for i in range(len(t))] for t, g, o in zip(texts, given, own, strict=True)]
            joins = [repaired(t, d) if len(t) > 1 else [] for t, d in zip(texts, done, strict=True)]
            windows = enc.raw([w for js in joins for j in js for w in j[2:]])
            ids, at = [], 0
            for t, d, js in zip(texts, done, joins, strict=True):
                if len(t) < 2:
                    ids.append(d[0][0] if t else b"")
                    continue
                ws = windows[at : at + 2 * len(js)]
                at += 2 * len(js)
                ids.append(joined(t, d, js, ws[::2], ws[1::2], enc.raw))
            yield finish(b.column("doc_id"), [enc.unpack(i).tolist() for i in ids], enc.tokenizer)

    return rows.mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str, finish: Callable, schema: str) -> DataFrame:
    rows = prepare(docs)
    places = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("ends") - 1).alias("seq"), "k1", "k2"))
    manifest = stored(rows.filter(F.size("ends") > 0).select("r1", "r2", places.alias("c")).select("r1", "r2", "c.seq", "c.k1", "c.k2"))
    first = F.min(F.struct("r1", "r2", "seq")).alias("first")
    twice = manifest.groupBy("k1", "k2").agg(F.count("*").alias("n"), first).filter("n > 1")
    todo = twice.groupBy(F.col("first.r1").alias("t1"), F.col("first.r2").alias("t2")).agg(F.collect_list(F.struct("first.seq", "k1", "k2")).alias("todo"))
    # Both joins keep all rows of the left side, so that they share one exchange of the texts.
    work = rows.join(todo, (F.col("r1") == F.col("t1")) & (F.col("r2") == F.col("t2")), "left").drop("t1", "t2")
    once = encode_shared(work, path).groupBy("k1", "k2").agg(F.first(F.struct("ids", "marks")).alias("e"))
    attached = (
        manifest.join(once, ["k1", "k2"])
        .groupBy(F.col("r1").alias("t1"), F.col("r2").alias("t2"))
        .agg(F.collect_set(F.struct("seq", "e.ids", "e.marks")).alias("shared"))
    )
    ready = rows.join(attached, (F.col("r1") == F.col("t1")) & (F.col("r2") == F.col("t2")), "left").drop("t1", "t2")
    return assemble(ready, path, finish, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every document."""

    def finish(doc_ids, ids, tokenizer):
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return encoded(docs, path, finish, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of every row of ids, as the library decodes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = pieces.encoder(path).tokenizer
        for b in batches:
            texts = tokenizer.decode_batch([i or [] for i in b.column("ids").to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, encoded and decoded in one go."""

    def finish(doc_ids, ids, tokenizer):
        names = _NAMES or _NAMES.extend(str(i) for i in range(1 << 17)) or _NAMES
        texts = tokenizer.decode_batch(ids, skip_special_tokens=False)
        return pa.RecordBatch.from_arrays(
            [
                doc_ids,
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(" ".join([names[x] for x in i]).encode()).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return encoded(docs, path, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


_NAMES: list[str] = []
