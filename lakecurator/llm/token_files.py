"""Token ids in flat binary files with document offsets, written and read by shard.

A shard covers a range of doc_id and has two files: `.bin` holds the ids of
its documents, one after another, as little-endian unsigned integers of 16
bits, or 32 for vocabularies that need them; `.idx` holds three 64-bit counts
(documents, ids, bytes of an id), then the doc_ids and documents + 1 offsets,
in ids. manifest.json lists the shards and their bases, the prefix sums of
ids. Readers map the files, so a document is found without reading others.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, with_arrow
from .storage import NO_KEY, commit, dealt, key_ranges, new_folder, opened, write_json

#: Words whose ids a task remembers.
MEMO = 1_000_000
#: A mark that stands alone between a letter and white space, which is a part of its own.
_MARK = re.compile(r"(?<=[a-z])([.,])(?=[ \n]|$)")
_OTHER_SPACE = re.compile(r"[^\S \n]")


def encoder(description: str, end_id: int) -> Callable[[list[str]], Iterator[np.ndarray]]:
    """A function from texts to their ids followed by end_id, by the tokenizers library.

    Under byte-level pre-tokenization a single space goes with the characters
    after it, a single line break stands alone, and so does a point or comma
    between a letter and white space, so texts are cut there, and
    the library encodes each distinct part once: parts that aren't remembered
    are given to it together, a line apart, and its ids are cut at the line
    breaks again. Texts with other white space, or with the text of a special
    token, are encoded whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(description)
    special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    break_ids = tokenizer.encode("\n", add_special_tokens=False).ids
    parsed = json.loads(description)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    splits = {k: v for k, v in ({"use_regex": True} | (parsed.get("pre_tokenizer") or {})).items() if k != "trim_offsets"}
    parts_add_up = splits == plain and all(parsed.get(k) is None for k in ("normalizer", "truncation", "padding")) and len(break_ids) == 1
    memo: dict[str, bytes] = {"\n": np.array(break_ids, np.uint32).tobytes()}

    def learn(parts: list[str]) -> dict[str, bytes]:
        ids = np.array(tokenizer.encode_batch_fast(["\n".join(parts)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(ids == break_ids[0])
        raw, edges = ids.tobytes(), [-1, *cuts.tolist(), len(ids)]
        return {x: raw[4 * a + 4 : 4 * b] for x, a, b in zip(parts, edges, edges[1:])}

    def run(texts: list[str]) -> Iterator[np.ndarray]:
        known: list[list[bytes | None] | None] = []
        gaps: list[list[tuple[int, str]]] = []
        for text in texts:
            if not parts_add_up or not text or "\0" in text or not _even(text) or any(x in text for x in special):
                known.append(None)
                gaps.append([])
                continue
            parts = _MARK.sub("\0\\1", text).replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
            found = list(map(memo.get, parts))
            known.append(found)
            gaps.append([(i, parts[i]) for i in _places(found)])
        new = {x for gap in gaps for _, x in gap}
        learnt = learn(list(new)) if new else {}
        if len(memo) + len(learnt) <= MEMO:
            memo.update(learnt)
        for text, found, gap in zip(texts, known, gaps):
            if found is None:
                ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                for i, x in gap:
                    found[i] = learnt[x]
                ids = np.frombuffer(b"".join(found), np.uint32)
            yield np.append(ids, np.uint32(end_id))

    return run


def _even(text: str) -> bool:
    """Whether all white space is single spaces and line breaks between other characters."""
    return not (text[0].isspace() or text[-1].isspace() or any(x in text for x in ("  ", "\n\n", " \n", "\n ")) or _OTHER_SPACE.search(text))


def _places(found: list) -> Iterator[int]:
    """Where a list holds None."""
    at = -1
    while True:
        try:
            at = found.index(None, at + 1)
        except ValueError:
            return
        yield at


_encoders: dict[tuple[str, int], Callable[[list[str]], Iterator[np.ndarray]]] = {}


def kept_encoder(description: str, end_id: int) -> Callable[[list[str]], Iterator[np.ndarray]]:
    """The encoder that this Python process made before, with what it remembers."""
    key = (hashlib.sha256(description.encode()).hexdigest(), end_id)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = encoder(description, end_id)
    return _encoders[key]


def _in_groups(encode: Callable[[list[str]], Iterator[np.ndarray]], texts: Iterator[str]) -> Iterator[np.ndarray]:
    """Encode texts in groups of about a million characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > 1_000_000:
            yield from encode(held)
            held, size = [], 0
    yield from encode(held)


def write_token_files(docs: DataFrame, description: str, end_id: int, folder: str | None = None, shard_bytes: int = 16 << 20) -> str:
    """Write the ids of all rows in ascending doc_id order; returns the folder.

    Null texts are empty, so have end_id alone. A null doc_id is written as
    -2**63 and comes first; rows that repeat a doc_id follow each other by
    their text's hash, and where such rows, or null ids, fill several shards,
    they are dealt over them by it. Very long texts are one document each;
    other columns are ignored. An empty table gives a manifest without shards.
    Shards grow where there would be over RANGES of them.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or new_folder(spark, "tokens")
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_KEY)).alias("doc_id"), "text")
    bounds = key_ranges(source.select(F.nullif("doc_id", F.lit(NO_KEY)).alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("w")), "doc_id", "w", shard_bytes)
    system, path = opened(folder)
    system.create_dir(path, recursive=True)

    def pack(batch: pa.RecordBatch) -> Iterator[dict]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        texts = [(x or "").encode() for x in batch["text"].to_pylist()]
        ties = np.array([zlib.crc32(x) for x in texts], np.uint32)
        yield {"doc_id": batch["doc_id"], "shard": bounds.of(batch["doc_id"].to_numpy(), ties), "tie": ties.astype(np.int64), "z": [squeeze(x) for x in texts]}

    shared = spark.sparkContext.broadcast(description)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        system, path = opened(folder)
        expand = zstandard.ZstdDecompressor().decompress
        attempt = uuid.uuid4().hex
        shard, out, ids, sizes, width = None, None, [], [], np.uint16

        def close() -> pa.RecordBatch:
            out.close()
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
            with system.open_output_stream(f"{path}/.{shard:06d}.idx.{attempt}") as index:
                index.write(np.array([len(ids), offsets[-1], width().itemsize], "<i8").tobytes() + np.array(ids, "<i8").tobytes() + offsets.tobytes())
            for kind in ("bin", "idx"):
                commit(system, f"{path}/.{shard:06d}.{kind}.{attempt}", f"{path}/{shard:06d}.{kind}")
            return pa.RecordBatch.from_pylist([{"shard": shard, "documents": len(ids), "ids": int(offsets[-1])}], pa.schema([("shard", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64())]))

        for batch in batches:
            if encode is None:
                encode = kept_encoder(shared.value, end_id)
                width = np.uint16 if max(end_id, _vocabulary_size(shared.value)) < 1 << 16 else np.uint32
            texts = (expand(z).decode() for z in batch["z"].to_pylist())
            for doc_id, own, found in zip(batch["doc_id"].to_pylist(), batch["shard"].to_pylist(), _in_groups(encode, texts)):
                if own != shard:
                    if shard is not None:
                        yield close()
                    shard, ids, sizes = own, [], []
                    out = system.open_output_stream(f"{path}/.{shard:06d}.bin.{attempt}")
                out.write(found.astype(np.dtype(width).newbyteorder("<")).tobytes())
                ids.append(doc_id)
                sizes.append(len(found))
        if shard is not None:
            yield close()

    packed = with_arrow(source, pack, "doc_id long, shard int, tie long, z binary")
    rows = dealt(packed, len(bounds), "shard", "doc_id", "tie").mapInArrow(write, "shard int, documents long, ids long").collect()  # one row a shard, RANGES at most
    base, shards = 0, []
    for row in sorted(rows):
        shards.append({"shard": row.shard, "documents": row.documents, "ids": row.ids, "base": base})
        base += row.ids
    write_json(f"{folder}/manifest.json", {"version": 1, "end_id": end_id, "shards": shards})
    return folder


def _vocabulary_size(description: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(description).get_vocab_size(with_added_tokens=True)


def _mapped(system: fs.FileSystem, path: str) -> pa.Buffer:
    if isinstance(system, fs.LocalFileSystem):
        with pa.memory_map(path) as source:
            return source.read_buffer()
    with system.open_input_file(path) as source:
        return source.read_buffer()


def read_token_files(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document, from the files.

    Null doc_ids come back as null, rows that were repeated as often as they
    were written, null and empty texts with the end id alone. Very long texts
    are mapped, not copied, until their row is made. A manifest without shards
    gives an empty result.
    """
    prepare(spark)
    system, path = opened(folder)
    with system.open_input_stream(f"{path}/manifest.json") as source:
        shards = json.loads(source.read())["shards"]
    bases = [(x["shard"], x["base"]) for x in shards]

    def read(batch: pa.RecordBatch) -> Iterator[dict]:
        system, path = opened(folder)
        for i in batch["id"].to_pylist():
            shard, base = bases[i]
            index = _mapped(system, f"{path}/{shard:06d}.idx")
            count, _, width = np.frombuffer(index, "<i8", 3)
            ids = np.frombuffer(index, "<i8", count, 24)
            offsets = np.frombuffer(index, "<i8", count + 1, 24 + 8 * count)
            values = np.frombuffer(_mapped(system, f"{path}/{shard:06d}.bin"), f"<u{width}")
            for low in range(0, count, 256):
                part = range(low, min(low + 256, count))
                yield {
                    "doc_id": pa.array(ids[low : part.stop], mask=ids[low : part.stop] == NO_KEY),
                    "start": base + offsets[low : part.stop],
                    "n_tokens": np.diff(offsets[low : part.stop + 1]),
                    "ids": [values[offsets[j] : offsets[j + 1]].astype("<u4").tobytes() for j in part],
                }

    return with_arrow(spark.range(0, len(bases), 1, max(1, len(bases))), read, "doc_id long, start long, n_tokens long, ids binary")
