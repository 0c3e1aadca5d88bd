"""Token-id files: zstandard frames under one shared dictionary, one frame per document, with an offset index.

A store is a folder of shards in ascending document order. A shard is

    magic (8 bytes) | SHA-256 of the dictionary (32) | bytes per id (1) | frames | index | index length (8) | magic (8)

and its index holds, per document, doc_id, end of its frame and number of its ids (little-endian 64-bit integers). The dictionary lies beside
the shards as ``dictionary.bin``. ``fetch`` reads one document by its index entry: two short reads and one frame.

The dictionary is trained on the ids of at most ``SAMPLE`` documents, the smallest by a hash of the id (the only bounded step). Texts are
encoded and compressed where they are read, so frames and not texts are shuffled. Shards are ranges of doc_id from
quantiles (at most ``MAX_SHARDS``, then shards grow); a task writes under a name of its own and renames, so a repeated task replaces and never doubles.

Encoding goes through the tokenizers library. Its pre-tokenizer never joins a character to the space behind it, so a text is cut at single
spaces between visible characters and each different piece is encoded once by a task's process, as long as its table (``CACHE`` pieces, by their
64-bit hashes) has room. New pieces go through the library many at a time, put end to end; the bytes that each id stands for tell where a piece ends.
"""

from __future__ import annotations

import functools
import hashlib
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import arrays as A
from quirefold.session import shared_dir

MAGIC = b"QFTOKEN1"
SAMPLE = 1000
DICTIONARY_BYTES = 112_640
SHARD_ROWS = 4096
MAX_SHARDS = 16_384
LEVEL = 3
CACHE = 800_000
JOINED = 64
SOLID = np.zeros(256, bool)
SOLID[33:127] = True


class _Known:
    """Ids of the pieces met so far, by ascending hash, and the number of bytes behind each id."""

    def __init__(self, model):
        vocab = model.get_vocab()
        self.width = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self.width[list(vocab.values())] = [len(t) for t in vocab]  # in byte-level pieces a character is a byte
        self.keys, self.at, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is known) of each hash."""
        place = np.searchsorted(self.keys, keys)
        hit = np.zeros(len(keys), bool)
        inside = np.flatnonzero(place < len(self.keys))
        hit[inside] = self.keys[place[inside]] == keys[inside]
        return place, hit

    def add(self, keys: np.ndarray, at: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Take in pieces; ``ids`` are the ids held so far and the new ones behind them."""
        self.ids = ids
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.count = (np.insert(*x) for x in ((self.keys, place, keys), (self.at, place, at), (self.count, place, count)))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one thread
    t = Tokenizer.from_file(path)
    return t, [a.content for a in t.get_added_tokens_decoder().values()], _Known(t)


def piece_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Starts of pieces whose encodings put end to end are the text's: spaces between visible characters, and text starts.

    Visible is told from the bytes: ASCII, or U+00C0 to U+00FF (first byte C3), none of which is white space.
    """
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 2:
        latin = data == 0xC3
        before = SOLID[data[:-2]]
        before[1:] |= latin[:-3]
        cut[1:-1] = (data[1:-1] == 32) & before & (SOLID[data[2:]] | latin[2:])
        last = starts[1:-1] - 1
        cut[last[last >= 0]] = False  # a space at a text's end has nothing behind it
    cut[starts[:-1][np.diff(starts) > 0]] = True
    return np.flatnonzero(cut)


def encode_pieces(model, special: list[bytes], width: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, count) of the ids of each piece, and these ids; up to ``JOINED`` pieces are encoded at once.

    Pieces that open with a space before a visible character and end in one can stand end to end, as they do in a text. All others, those with a control
    string, and joined ones whose ids do not part at the pieces' ends, go through the library by themselves.
    """
    size = end - begin
    fits = size > 1
    two, last = data[np.minimum(begin + 1, len(data) - 1)], data[end - 1]
    fits &= (data[begin] == 32) & (SOLID[two] | (two == 0xC3)) & (SOLID[last] | (data[end - 2] == 0xC3))
    body = data[A.ragged(begin, size)].tobytes()
    stop = np.cumsum(size)
    at, count, ids, n = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), [np.zeros(0, np.uint32)], 0
    alone = np.flatnonzero(~fits)
    fit = np.flatnonzero(fits)
    if len(alone):
        joined = data[A.ragged(begin[fit], size[fit])].tobytes()
        ends = np.cumsum(size[fit])
    else:
        joined, ends = body, stop
    cuts = [0, *ends[JOINED - 1 :: JOINED].tolist()]
    cuts += [len(joined)] if cuts[-1] < len(joined) else []
    texts = [joined[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for k, e in enumerate(model.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)):
        mine = fit[k * JOINED : (k + 1) * JOINED]
        got = np.array(e.ids, np.uint32)
        reach, wanted = np.cumsum(width[got]), np.cumsum(size[mine])
        upto = np.searchsorted(reach, wanted) + 1
        if not len(got) or reach[-1] != wanted[-1] or (reach[upto - 1] != wanted).any() or any(s in texts[k] for s in special):
            alone = np.concatenate((alone, mine))
            continue
        count[mine] = np.diff(upto, prepend=0)
        at[mine] = n + upto - count[mine]
        ids.append(got)
        n += len(got)
    texts = [body[a:b].decode("utf-8", "replace") for a, b in zip((stop - size)[alone].tolist(), stop[alone].tolist(), strict=True)]
    for k, e in zip(alone.tolist(), model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        ids.append(np.array(e.ids, np.uint32))
        at[k], count[k] = n, len(ids[-1])
        n += len(ids[-1])
    return at, count, np.concatenate(ids)


def encode(path: str, data: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of whole texts, each followed by ``end_id``."""
    model, special, known = tokenizer(path)
    begin = piece_starts(data, starts)
    end = np.concatenate((begin[1:], [len(data)])) if len(begin) else begin
    first = np.searchsorted(begin, starts)
    special = [s.encode() for s in special]
    raw = data.tobytes()
    whole = [i for i in range(len(starts) - 1) if any(s in raw[starts[i] : starts[i + 1]] for s in special)] if any(s in raw for s in special) else []
    keys, one, which = np.unique(A.spans_hash(A.prefix_hash(data), begin, end), return_index=True, return_inverse=True)
    place, hit = known.find(keys)
    new = np.flatnonzero(~hit)
    at, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    at[hit], count[hit] = known.at[place[hit]], known.count[place[hit]]
    flat = known.ids
    if len(new):
        at[new], count[new], more = encode_pieces(model, special, known.width, data, begin[one[new]], end[one[new]])
        at[new] += len(flat)
        flat = np.concatenate((flat, more))
        if len(known.keys) < CACHE:
            known.add(keys[new], at[new], count[new], flat)
    ids = flat[A.ragged(at[which], count[which])]
    ends = np.concatenate(([0], np.cumsum(count[which])))[first]
    parts = {i: model.encode(raw[starts[i] : starts[i + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids for i in whole}
    if parts:  # control strings in a text: the library sees the text whole
        pieces = [parts.get(i, ids[ends[i] : ends[i + 1]]) for i in range(len(starts) - 1)]
        ids, ends = np.concatenate([np.asarray(p, np.int64) for p in pieces]), np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
    return np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))


def _train(samples: list[bytes]):
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too small documents to learn from
        return b"".join(samples)[:DICTIONARY_BYTES]


def _frames(path: str, end_id: int, width: str, dictionary: bytes):
    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        for batch in batches:
            data, starts = A.text_bytes(batch.column("text"))
            for i, j in A.chunks(starts, 2 * A.CHUNK):
                ids, at = encode(path, data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], end_id)
                body = ids.astype(width)
                frames = [pack.compress(body[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("shard").slice(i, j - i), pa.array(frames, pa.binary()), pa.array(np.diff(at))], names=["doc_id", "shard", "frame", "n"]
                )

    return run


def _write_shards(folder: str, width: str, digest: bytes):
    def run(batches):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        size = np.dtype(width).itemsize
        state = {"shard": None}

        def close():
            index = np.array(state["index"], "<i8").tobytes()
            state["out"].write(index + struct.pack("<q", len(index)) + MAGIC)
            state["out"].close()
            name = f"{base}/shard-{state['shard']:09d}.bin"
            if files.get_file_info(name).type != fs.FileType.NotFound:
                files.delete_file(name)
            files.move(state["name"], name)
            return state["shard"], len(state["index"]), sum(r[2] for r in state["index"])

        done = []
        for batch in batches:
            for doc_id, shard, frame, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "shard", "frame", "n")), strict=True):
                if shard != state["shard"]:
                    if state["shard"] is not None:
                        done.append(close())
                    name = f"{base}/writing-{shard:09d}-{TaskContext.get().taskAttemptId()}"
                    state = {"shard": shard, "name": name, "out": files.open_output_stream(name), "index": [], "at": len(MAGIC) + 33}
                    state["out"].write(MAGIC + digest + bytes([size]))
                state["out"].write(frame)
                state["at"] += len(frame)
                state["index"].append((doc_id, state["at"], n))
        if state["shard"] is not None:
            done.append(close())
        columns = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shard", "n_docs", "n_ids"])

    return run


def write_store(docs: DataFrame, folder: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts of ``docs`` to ``folder`` (new, on a file system all executors reach); (shard, n_docs, n_ids, start) of every shard.

    Null texts are empty documents (the end id alone); rows with one id follow each other, by a hash of their text; rows with a null id are
    left out, since nothing could fetch them. An empty table gives a store without shards.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    from pyarrow import fs

    width = "<u2" if max(tokenizer(path)[0].get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    sample = texts.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(SAMPLE).select("text").toArrow()["text"].combine_chunks()
    data, starts = A.text_bytes(sample)
    samples = []
    for i, j in A.chunks(starts):
        ids, at = encode(path, data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], end_id)
        samples += [ids[a:b].astype(width).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    dictionary = _train(samples)
    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base}/dictionary.bin") as out:
        out.write(dictionary)
    digest = hashlib.sha256(dictionary).digest()

    rows = texts.count()
    n = min(max(1, -(-rows // SHARD_ROWS)), MAX_SHARDS)
    cuts = sorted(set(texts.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n))) if n > 1 else []
    shards = texts.withColumn("shard", A.range_of("doc_id", cuts).cast("long"))
    framed = shards.mapInArrow(_frames(path, end_id, width, dictionary), "doc_id long, shard long, frame binary, n long")
    placed = framed.repartition(max(1, len(cuts) + 1), "shard").sortWithinPartitions("shard", "doc_id", F.xxhash64("frame"))
    written = placed.mapInArrow(_write_shards(folder, width, digest), "shard long, n_docs long, n_ids long").toArrow().sort_by("shard")
    starts = np.cumsum(written["n_ids"].to_numpy()) - written["n_ids"].to_numpy()
    table = [(*(int(v) for v in row), int(s)) for row, s in zip(zip(*(written[c].to_pylist() for c in written.column_names), strict=True), starts, strict=True)]
    return spark.createDataFrame(table, "shard long, n_docs long, n_ids long, start long")


def _open(files, base: str, shard: int):
    file = files.open_input_file(f"{base}/shard-{shard:09d}.bin")
    size = file.size()
    length, magic = struct.unpack("<q8s", file.read_at(16, size - 16))
    head = file.read_at(len(MAGIC) + 33, 0)
    if magic != MAGIC or head[:8] != MAGIC:
        raise ValueError("not a token-id shard")
    index = np.frombuffer(file.read_at(length, size - 16 - length), "<i8").reshape(-1, 3)
    return file, head[8:40], {1: "u1", 2: "<u2", 4: "<u4"}[head[40]], index


def _dictionary(files, base: str, digest: bytes):
    import zstandard

    with files.open_input_file(f"{base}/dictionary.bin") as f:
        body = f.read()
    if hashlib.sha256(body).digest() != digest:
        raise ValueError("the dictionary is not the one that the shard was written with")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))


def fetch(folder: str, shard: int, doc_id: int) -> list[np.ndarray]:
    """The ids of one document, or of all rows with its id, without reading the rest of the shard."""
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(folder)
    file, digest, width, index = _open(files, base, shard)
    unpack = _dictionary(files, base, digest)
    first = len(MAGIC) + 33
    out = []
    for k in np.flatnonzero(index[:, 0] == doc_id):
        a = int(index[k - 1, 1]) if k else first
        out.append(np.frombuffer(unpack.decompress(file.read_at(int(index[k, 1]) - a, a)), width))
    return out


def _read(folder: str):
    def run(batches):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), strict=True):
                file, digest, width, index = _open(files, base, shard)
                unpack = _dictionary(files, base, digest)
                at, crc = len(MAGIC) + 33, []
                for end, n in index[:, 1:].tolist():
                    ids = np.frombuffer(unpack.decompress(file.read_at(end - at, at)), width)
                    if len(ids) != n:
                        raise ValueError("a frame does not hold as many ids as its index says")
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    at = end
                counts = index[:, 2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(index[:, 0].astype(np.int64)), pa.array(start + np.cumsum(counts) - counts), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_store(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; ``shards`` as write_store returns it."""
    shards = shards.select("shard", "start").repartition(max(1, shards.count()), "shard")
    return shards.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    """A fresh folder in the session's shared one, as a URI."""
    at = shared_dir(spark)
    return at if ":" in at else f"file://{os.path.abspath(at)}"
