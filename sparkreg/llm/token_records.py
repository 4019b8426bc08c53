"""Token ids in length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A record is framed as  length (u64) | masked CRC-32C of the length (u32) | payload | masked CRC-32C of the payload (u32),
all little-endian; the payload is the document's id as text (its length as u32, 2^32 - 1 for null, then UTF-8) and its token
ids with the end id, in u16 where the vocabulary fits and u32 otherwise. A mask rotates a checksum right by 15 bits and adds a constant, so that a checksum of data that
holds checksums stays sound. Beside every data file lies an index file of (byte offset, first token) pairs, two u64 a
record: any record can be read alone, in any order.

Documents are range-sorted by id into shards; files are committed through temporary names and a manifest.

Defined cases: null text is empty (the record then has the end id alone); texts of any length are encoded whole; ids of any
type come back in their type, ordered by number where they are integers and by code point otherwise; a null id sorts first;
rows that repeat an id are ordered by text and stay in one shard; other columns are ignored; an empty table gives no file and
an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkreg.functions.storage import materialise, new_folder
from sparkreg.llm.layout import NewFile, commit, file_tasks, rows_of, sorted_shards
from sparkreg.llm.tokens import encoder

MANIFEST = "name string, temp string, shard int, seq int, records long, tokens long, bytes long, width int"
_ARROW = pa.schema([("name", pa.string()), ("temp", pa.string()), ("shard", pa.int32()), ("seq", pa.int32()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64()), ("width", pa.int32())])
_POLY, _MASK = 0x82F63B78, 0xA282EAD8  # CRC-32C, reflected; the mask's constant
_CHUNK = 256  # bytes whose checksums are taken side by side


def _tables() -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Tables for four bytes at a time, and tables that carry a checksum over _CHUNK zero bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1).astype(np.uint32)
    by = [t]
    for _ in range(3):
        by.append((by[-1] >> 8) ^ t[by[-1] & 255])
    bits = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
    for _ in range(_CHUNK):
        bits = (bits >> 8) ^ t[bits & 255]
    over = []
    for byte in range(4):
        values = np.zeros(256, np.uint32)
        for bit in range(8):
            values[np.arange(256) >> bit & 1 == 1] ^= bits[8 * byte + bit]
        over.append(values)
    return by, over


def _halves(tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tables of two bytes each for the lower and the upper half of a word, from those of its four bytes."""
    low, high = np.arange(1 << 16) & 255, np.arange(1 << 16) >> 8
    return tables[0][low] ^ tables[1][high], tables[2][low] ^ tables[3][high]


def _step(c: np.ndarray, halves: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    both = c.view("<u2").reshape(-1, 2)
    return halves[0][both[:, 0]] ^ halves[1][both[:, 1]]


_BY, _OVER = _tables()
_WORD, _CARRY = _halves(_BY[::-1]), _halves(_OVER)


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each of parts (at least four bytes each)."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    chunks = -(-sizes // _CHUNK)
    ends = np.cumsum(chunks)
    block = np.zeros(int(ends[-1]) * _CHUNK if len(parts) else 0, np.uint8)
    for part, end, size in zip(parts, (ends * _CHUNK).tolist(), sizes.tolist(), strict=True):
        block[end - size : end] = np.frombuffer(part, np.uint8)  # zeros in front do not change a checksum that starts at 0
        block[end - size : end - size + 4] ^= 255
    words = np.ascontiguousarray(block.view("<u4").reshape(-1, _CHUNK // 4).T)
    state = np.zeros(words.shape[1], np.uint32)
    for word in words:
        state = _step(state ^ word, _WORD)
    out, order = np.zeros(len(parts), np.uint32), np.argsort(-chunks, kind="stable")
    first, counts = (ends - chunks)[order], chunks[order]
    for k in range(int(counts[0]) if len(parts) else 0):
        n = int(np.searchsorted(-counts, -k, side="left"))  # those with more than k chunks
        out[:n] = _step(out[:n], _CARRY) ^ state[first[:n] + k]
    back = np.empty_like(out)
    back[order] = out
    return back ^ np.uint32(0xFFFFFFFF)


def mask(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK)


def frame(payloads: list[bytes]) -> list[bytes]:
    """The framed record of each payload."""
    heads = [len(p).to_bytes(8, "little") for p in payloads]
    a, b = mask(crc32c(heads)).astype("<u4"), mask(crc32c(payloads)).astype("<u4")
    return [h + x.tobytes() + p + y.tobytes() for h, x, p, y in zip(heads, a, payloads, b, strict=True)]


def unframe(data: bytes, offsets: list[int]) -> list[bytes]:
    """The payloads of the records at offsets; raises ValueError if a checksum does not hold."""
    heads = [data[o : o + 8] for o in offsets]
    sizes = [int.from_bytes(h, "little") for h in heads]
    payloads = [data[o + 12 : o + 12 + n] for o, n in zip(offsets, sizes, strict=True)]
    stored = [(int.from_bytes(data[o + 8 : o + 12], "little"), int.from_bytes(data[o + 12 + n : o + 16 + n], "little")) for o, n in zip(offsets, sizes, strict=True)]
    if payloads and not ((mask(crc32c(heads)) == [x for x, _ in stored]).all() and (mask(crc32c(payloads)) == [y for _, y in stored]).all()):
        raise ValueError("a record's checksum does not hold")
    return payloads


_NULL = (1 << 32) - 1  # as the length of an id


def _packed_id(doc_id: str | None) -> bytes:
    own = b"" if doc_id is None else doc_id.encode("utf-8", "surrogatepass")
    return (_NULL if doc_id is None else len(own)).to_bytes(4, "little") + own


def _unpacked(payload: bytes, width: int) -> tuple[str | None, np.ndarray]:
    """The id and the token ids of a payload."""
    size = int.from_bytes(payload[:4], "little")
    start = 4 if size == _NULL else 4 + size
    return None if size == _NULL else payload[4:start].decode("utf-8", "surrogatepass"), np.frombuffer(payload, f"<u{width}", offset=start)


def write_records(
    docs: DataFrame, folder: str, vocabulary: str, *, end_id: int = 0, docs_per_shard: int = 10_000, roll_bytes: int = 64 << 20,
    id_col: str = "doc_id", text_col: str = "text", prefix: str = "tokens",
) -> DataFrame:
    """Encode docs and write them in ascending id order below folder; returns the manifest."""
    rows = sorted_shards(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "id", ["text"], docs_per_shard)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        end, width = np.array([end_id], tool.dtype).tobytes(), tool.dtype.itemsize
        done: list[dict] = []
        data = index = None
        shard = seq = records = tokens = 0

        def close() -> None:
            for f in (data, index):
                f.close()
                done.append({"name": f.name, "temp": f.temp, "shard": shard, "seq": seq, "records": records, "tokens": tokens, "bytes": f.size, "width": width})

        for batch in batches:
            ids, shards = [_packed_id(i) for i in batch.column(0).to_pylist()], batch.column(2).to_pylist()
            for lo in range(0, len(ids), 256):
                texts = batch.column(1).slice(lo, 256).to_pylist()
                packed = [x.tobytes() + end for x in tool.encode(texts)]
                framed = frame([i + x for i, x in zip(ids[lo:], packed, strict=False)])
                for at, x, record in zip(shards[lo:], packed, framed, strict=False):
                    if data is not None and (at != shard or data.size >= roll_bytes):
                        close()
                        seq = seq + 1 if at == shard else 0
                        data = None
                    if data is None:
                        seq = seq if at == shard else 0
                        shard, records, tokens = at, 0, 0
                        data, index = (NewFile(folder, f"{prefix}-{shard:06d}-{seq:04d}.{kind}") for kind in ("rec", "idx"))
                    index.write(data.size.to_bytes(8, "little") + tokens.to_bytes(8, "little"))
                    data.write(record)
                    records += 1
                    tokens += len(x) // width
        tool.settle()
        if data is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_ARROW)

    return commit(folder, materialise(rows.select(F.col("id").cast("string"), "text", "__shard").mapInArrow(write, MANIFEST), "token-files", 1000))


def _files(manifest: DataFrame) -> DataFrame:
    files = manifest.where(F.col("name").endswith(".rec")).select("name", "shard", "seq", "tokens", "bytes", "width")
    before = F.sum("tokens").over(Window.orderBy("shard", "seq")) - F.col("tokens")  # one row a file
    return file_tasks(files.select("name", before.alias("before"), "bytes", "width"))


def _opened(folder: str, name: str):
    """(index, open data file) of a file of records; the index has a row (offset, first token) for each."""
    system, root = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{root}/{name.removesuffix('.rec')}.idx", compression=None) as f:
        index = np.frombuffer(f.read(), "<u8").reshape(-1, 2).astype(np.int64)
    return index, system.open_input_file(f"{root}/{name}")


def read_records(folder: str, manifest: DataFrame, step: int = 8 << 20, id_type: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read through the index about ``step`` bytes at a time."""
    schema = pa.schema([("doc_id", pa.string()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, base, size, width in rows_of(batches):
            index, data = _opened(folder, name)
            ends, lo = np.append(index[1:, 0], size), 0
            with data:
                while lo < len(index):
                    hi = max(lo + 1, int(np.searchsorted(ends, index[lo, 0] + step, side="right")))
                    part = data.read_at(int(ends[hi - 1] - index[lo, 0]), int(index[lo, 0]))
                    found = [_unpacked(p, width) for p in unframe(part, (index[lo:hi, 0] - index[lo, 0]).tolist())]
                    ids = [x.astype("<u4") for _, x in found]
                    columns = [[i for i, _ in found], (index[lo:hi, 1] + base).tolist(), list(map(len, ids)), [zlib.crc32(x.tobytes()) for x in ids]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
                    lo = hi

    rows = _files(manifest).mapInArrow(read, "doc_id string, start long, n_tokens long, ids_crc32 long")
    return rows.withColumn("doc_id", F.col("doc_id").cast(id_type))


def read_shuffled(folder: str, manifest: DataFrame, seed: int, id_type: str = "long") -> DataFrame:
    """(doc_id, start, ids): records read one by one through the index, each file's in an order that the seed draws."""
    schema = pa.schema([("doc_id", pa.string()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, base, size, width in rows_of(batches):
            index, data = _opened(folder, name)
            ends = np.append(index[1:, 0], size)
            order = np.random.default_rng([seed, zlib.crc32(name.encode())]).permutation(len(index))
            with data:
                for lo in range(0, len(order), 64):
                    part = order[lo : lo + 64]
                    found = [_unpacked(unframe(data.read_at(int(ends[k] - index[k, 0]), int(index[k, 0])), [0])[0], width) for k in part.tolist()]
                    columns = [[i for i, _ in found], (index[part, 1] + base).tolist(), [x.astype(np.int64) for _, x in found]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return _files(manifest).mapInArrow(read, "doc_id string, start long, ids array<long>").withColumn("doc_id", F.col("doc_id").cast(id_type))


def round_trip(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", **settings) -> DataFrame:
    """Write docs to a new folder and read the files back."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_records(folder, write_records(docs, folder, vocabulary, id_col=id_col, **settings), id_type=dict(docs.dtypes)[id_col])
