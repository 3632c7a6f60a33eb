"""Substring dedup by level-wise doubling.

Windows of a short length that occur once are dropped; two adjacent repeated windows make a
candidate of twice the length, level by level, until the wanted length is reached or no candidate
survives. Documents are dealt to chunks once. For each level a chunk sends its distinct candidate
hashes to buckets by hash range, and gets back one bit for each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.shingles import joined, windows, word_hashes, words_of
from passagework.session import ship_package

CHUNK_BYTES = 512 << 10
BUCKET_BYTES = 16 << 20  # text bytes per bucket of hashes
SENT = "_chunk int, _bucket int, _level int, _hashes binary, _docs binary"
BACK = "_chunk int, _bucket int, _level int, _bits binary"


class Chunk:
    """The documents of a chunk in order of id, their words and window hashes."""

    def __init__(self, frame: pd.DataFrame):
        frame = frame.assign(_key=[(0, 0) if pd.isna(d) else (1, int(d)) for d in frame["_doc"]], _text=[t or "" for t in frame["_text"]])
        frame = frame.sort_values(["_key", "_text"], kind="stable")
        self.ids = [None if pd.isna(d) else int(d) for d in frame["_doc"]]
        self.words = [words_of(t) for t in frame["_text"]]
        self.counts = np.array([len(w) for w in self.words], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.hashes = word_hashes([w for words in self.words for w in words])

    def fits(self, length: int) -> np.ndarray:
        """Positions at which a window of ``length`` words starts and ends in one document."""
        n = len(self.hashes)
        left = np.repeat(self.starts[1:], self.counts) - np.arange(n)
        return left >= length

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


class Level:
    """Distinct hashes of the candidate windows of one length in a chunk."""

    def __init__(self, hashes: np.ndarray, places: np.ndarray):
        self.places = places
        self.distinct, self.first, self.of, self.times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)


def climb(chunk: Chunk, replies: dict[int, np.ndarray], lengths: list[int]) -> tuple[Level, int]:
    """The first level without a reply, or the last one, and its number.

    ``replies`` has a flag per distinct hash of each level below: whether other chunks hold it.
    """
    whole = windows(chunk.hashes, lengths[0])
    places = np.flatnonzero(chunk.fits(lengths[0]))
    level = Level(whole[places], places)
    values = whole
    for k in range(len(lengths)):
        if k not in replies or k == len(lengths) - 1:
            return level, k
        again = (replies[k] | (level.times > 1))[level.of]
        repeated = np.zeros(len(chunk.hashes) + 1, dtype=bool)
        repeated[level.places] = again
        half, twice = lengths[k], lengths[k + 1]
        fits = np.flatnonzero(chunk.fits(twice))
        places = fits[repeated[fits] & repeated[fits + half]]
        nxt = np.zeros(len(chunk.hashes), dtype=np.uint64)
        nxt[places] = joined(values[places], values[places + half])
        values, level = nxt, Level(nxt[places], places)
    raise AssertionError("no level")


def flags_of(frame: pd.DataFrame, upto: int) -> dict[int, np.ndarray]:
    """The replies of a chunk by level: flags in the order of its distinct hashes."""
    out = {}
    for k in range(upto):
        part = frame[frame["_level"] == k].sort_values("_bucket")
        bits = []
        for data in part["_bits"]:
            n = int.from_bytes(data[:4], "little")
            bits.append(np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=4), count=n).astype(bool))
        out[k] = np.concatenate(bits) if bits else np.zeros(0, dtype=bool)
    return out


def planes(values: np.ndarray) -> bytes:
    """Bytes of integers by significance, which compress better than one after another."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def send(number: int, chunk: Chunk, level: Level, k: int, buckets: int, last: bool) -> pd.DataFrame:
    """A row per bucket that any of the level's distinct hashes falls in.

    Levels below the last send 32 bits behind the bucket's own: two windows taken for equal only
    cost a candidate more. The last sends whole hashes and the id of the first document.
    """
    bits = buckets.bit_length() - 1
    bucket = (level.distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(level.distinct), np.int64)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    if last:
        sent = level.distinct
        ids = np.array([np.iinfo(np.int64).min if d is None else d for d in chunk.ids] or [0], dtype=np.int64)
        docs = ids[chunk.doc_of(level.places[level.first])] if len(level.distinct) else np.zeros(0, np.int64)
    else:
        sent = ((level.distinct << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
        docs = None
    rows = []
    for b in np.unique(bucket):
        part = slice(cuts[b], cuts[b + 1])
        rows.append((number, int(b), k, sent[part].tobytes(), planes(docs[part]) if last else b""))
    return pd.DataFrame(rows, columns=["_chunk", "_bucket", "_level", "_hashes", "_docs"])


def answer(frame: pd.DataFrame) -> pd.DataFrame:
    """Flags for one bucket: held by another chunk too, or, with documents, held earlier by another chunk."""
    last = any(len(d) for d in frame["_docs"])
    kind = np.uint64 if last else np.uint32
    sent = [np.frombuffer(h, dtype=kind) for h in frame["_hashes"]]
    values = np.concatenate(sent)
    if last:
        docs = np.concatenate([from_planes(d, np.int64) for d in frame["_docs"]])
        order = np.lexsort((docs, values))
        ranked = values[order]
        later = np.zeros(len(values), dtype=bool)
        later[order[1:]] = ranked[1:] == ranked[:-1]
    else:
        ranked = np.sort(values)
        twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        spot = np.minimum(np.searchsorted(twice, values), max(len(twice) - 1, 0))
        later = twice[spot] == values if len(twice) else np.zeros(len(values), dtype=bool)
    ends = np.cumsum([len(s) for s in sent])
    bits = [len(f).to_bytes(4, "little") + np.packbits(f).tobytes() for f in np.split(later, ends[:-1])]
    return pd.DataFrame({"_chunk": frame["_chunk"], "_bucket": frame["_bucket"], "_level": frame["_level"], "_bits": bits})


def covered(chunk: Chunk, level: Level, later: np.ndarray, length: int) -> np.ndarray:
    """Words that some window covers whose sequence also starts earlier."""
    first = np.zeros(len(level.places), dtype=bool)
    first[level.first] = True
    drop = level.places[~first | later[level.of]] if len(level.places) else level.places
    change = np.zeros(len(chunk.hashes) + 1, dtype=np.int64)
    np.add.at(change, drop, 1)
    np.add.at(change, drop + length, -1)
    return np.cumsum(change)[:-1] > 0


def lengths_to(window: int, start: int) -> list[int]:
    """``window`` and its halves down to the smallest whole one that is at least ``start``."""
    out = [window]
    while out[0] % 2 == 0 and out[0] // 2 >= start:
        out.insert(0, out[0] // 2)
    return out


def remove_repeats(
    docs: DataFrame, window: int = 20, start: int = 5, doc: str = "doc_id", text: str = "text", with_text: bool = True
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_removed``, ``kept_sha256`` and, if wanted, ``kept_text``.

    A word is removed if a window of ``window`` words covers it whose word sequence also starts
    earlier: in a document with a smaller id, or before in the same one. Windows are judged on the
    input. Kept words are joined by one space. Levels go from ``start`` words or a little more by
    doubling to ``window``; windows are compared by 64-bit hashes of their words.

    Null, empty and blank texts have no words. Rows that share an id count in the order of their
    texts; a null id comes before all others. Other columns are ignored; an empty table gives no row.
    """
    ship_package(docs.sparkSession)
    lengths = lengths_to(window, start)
    top = len(lengths) - 1
    rows = docs.select(F.col(doc).cast("long").alias("_doc"), F.col(text).alias("_text"))
    volume = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    chunks = max(1, -(-volume // CHUNK_BYTES))
    buckets = 1 << max(0, int(volume // BUCKET_BYTES).bit_length())
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(chunks, -(-volume // (16 << 20))))
    dealt = rows.withColumn("_chunk", F.pmod(F.xxhash64("_doc"), F.lit(chunks)).cast("int")).repartition(parts, "_chunk")
    by_chunk = dealt.groupBy("_chunk")

    def begin(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(frame)
        level, k = climb(chunk, {}, lengths)
        return send(int(key[0]), chunk, level, k, buckets, k == top)

    def onward(k: int):
        def go_on(key: tuple, frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
            chunk = Chunk(frame)
            level, at = climb(chunk, flags_of(replies, k), lengths)
            return send(int(key[0]), chunk, level, at, buckets, at == top)

        return go_on

    def finish(key: tuple, frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(frame)
        flags = flags_of(replies, top + 1)
        level, _ = climb(chunk, flags, lengths)
        gone = covered(chunk, level, flags[top], window)
        out = []
        for i, (name, words) in enumerate(zip(chunk.ids, chunk.words, strict=True)):
            mask = gone[chunk.starts[i] : chunk.starts[i + 1]]
            kept = b" ".join([w for w, g in zip(words, mask.tolist(), strict=True) if not g] if mask.any() else words)
            data = (name, len(words), int(mask.sum()), hashlib.sha256(kept).hexdigest())
            out.append((*data, kept.decode("utf-8", "replace")) if with_text else data)
        columns = ["_doc", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]
        return pd.DataFrame(out, columns=columns).astype({"_doc": "Int64"})

    replies = by_chunk.applyInPandas(begin, SENT).groupBy("_bucket").applyInPandas(answer, BACK)
    for k in range(1, top + 1):
        sent = by_chunk.cogroup(replies.groupBy("_chunk")).applyInPandas(onward(k), SENT)
        replies = replies.union(sent.groupBy("_bucket").applyInPandas(answer, BACK))
    schema = "_doc long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return by_chunk.cogroup(replies.groupBy("_chunk")).applyInPandas(finish, schema).withColumnRenamed("_doc", doc)
