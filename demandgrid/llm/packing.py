"""Packing tokenised documents into sequences of a fixed length.

Shortest-pack-first over the length histogram: only counts of lengths reach the driver
(one per length, so ``size`` at most). Lengths are placed longest first, each into the
emptiest open packs that have room, by changing the counts of packing patterns. The
patterns are then joined back to the pieces by the rank of a piece among those of its
length. Ranks are counted where the piece is made and offset by counts per task and length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.llm.common import pick, stored

SIZE = 1024
#: The splitting rule of the vocabulary file (its byte-level pre-tokeniser), a fixed value.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters other than printable ones of the first two blocks of Latin.
ODD = r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]"


def byte_ranks(path: str) -> dict[bytes, int]:
    """Tokens of a byte-level vocabulary file as bytes, with their ids, which must follow the order of its merges."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, rule = content["model"], content["pre_tokenizer"]
    if model["type"] != "BPE" or rule["type"] != "ByteLevel" or rule["add_prefix_space"] or content["normalizer"]:
        raise ValueError(f"{path} is no plain byte-level vocabulary")
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    # Bytes without a sign of their own are written as the characters from 256 on.
    signs = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    special = {t["content"] for t in content["added_tokens"]}
    ranks = {bytes(signs[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    if ids != sorted(ids) or len(ids) + 256 != len(ranks):
        raise ValueError(f"the ids of {path} do not follow its merges")
    return ranks


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, equal to those of the tokenizer file.

    A faster encoder works on the file's own vocabulary. Texts with characters whose class could be
    seen differently, or with an added token of the file, go to the tokenizer of the file itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = tiktoken.Encoding("file", pat_str=WORD_PATTERN, mergeable_ranks=byte_ranks(path), special_tokens={})
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.odd = re.compile("|".join([ODD, *added])).search

    def __call__(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids if self.odd(text) else self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """Documents tokenised, ended with ``end_id`` and cut every ``size`` ids, the rest last.

    ``part`` and ``rank``: the task, and the number of the piece among its pieces of that length.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = Encoder(tokenizer), Counter()
        part, end = TaskContext.get().partitionId(), int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    piece = ids[4 * start : 4 * (start + size)]
                    length = len(piece) // 4
                    rows.append((doc_id, start, length, zlib.crc32(piece), total, part, seen[length]))
                    seen[length] += 1
            columns = zip(*rows) if rows else [[]] * 7
            kinds = (batch.schema.field(0).type, *[pa.int64()] * 4, pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=NAMES)

    kind = dict(docs.dtypes)["doc_id"]
    NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long"
    return docs.mapInArrow(cut, schema)


def shortest_pack_first(lengths: dict[int, int], size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, times), ...) with the number of packs of each."""
    open_packs: dict[int, Counter] = defaultdict(Counter)  # room left -> pattern -> packs
    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            room = max((r for r, packs in open_packs.items() if packs), default=-1)
            if room < length:
                fit = size // length
                for times, packs in ((fit, left // fit), (left % fit, 1)):
                    if times and packs:
                        open_packs[size - times * length][((length, times),)] += packs
                break
            pattern = min(open_packs[room])
            packs = open_packs[room].pop(pattern)
            used = min(packs, left)
            if packs > used:
                open_packs[room][pattern] = packs - used
            last, times = pattern[-1]
            grown = (*pattern[:-1], (last, times + 1)) if last == length else (*pattern, (length, 1))
            open_packs[room - length][grown] += used
            left -= used
    return sorted((p, n) for packs in open_packs.values() for p, n in packs.items())


def pack_pieces(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``. ``pieces`` must be a stored table of ``token_pieces``."""
    spark = pieces.sparkSession
    counts = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    first, entries, taken = 0, [], Counter()
    for pattern, packs in shortest_pack_first(histogram, size):
        at = 0
        for length, times in pattern:
            entries.append((length, taken[length], taken[length] + packs * times, times, first, at))
            taken[length] += packs * times
            at += length * times
        first += packs
    schema = "length long, rank_from long, rank_to long, times long, first_id long, at long"
    # Patterns differ in length counts only: their number is bounded by size, not by the data.
    places = F.broadcast(spark.createDataFrame(entries, schema))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("nth", F.col("base") + F.col("rank"))
    ranked = ranked.join(places, ["length"]).where("nth >= rank_from and nth < rank_to")
    inside = F.col("nth") - F.col("rank_from")
    return ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_id") + F.floor(inside / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("at") + (inside % F.col("times")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the one id ``end_id``; repeated rows are packed each; very long
    texts are cut like any other. An empty table gives no rows; other columns are ignored.
    Sequence ids run from 0 without gaps, as do the offsets inside a sequence.
    """
    return pack_pieces(stored(token_pieces(pick(docs, "doc_id", "text"), tokenizer, size, end_id), "pieces"), size)
