"""Phrase collocations by dynamic itemset counting.

The corpus is dealt to shards, which are scanned in a cycle. Words are counted from the first
scan on. A longer phrase is activated as soon as both its subphrases (without its last
word, without its first) have reached the threshold in the scans so far; it is counted from
the next scan until it has seen each shard once. Lengths are thus interleaved: one scan may
count words, pairs and triples. Scans end when no activated phrase is left incomplete.

A task needs to know which phrases are active. It gets a bit array of fixed largest size in which
the hashes of the phrases are set: a wrong hit costs a count that is discarded, nothing is
missed, and results come from the phrases themselves. The counts of a scan stay where they are.
A phrase that reaches the threshold within a cycle of S scans has 1/S of it in one scan, so only such
phrases (by another bit array, again without misses) are added up over the scans and held exactly
against their subphrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandgrid.llm.common import BITMAP, bits_for, bounded_batches, pick
from demandgrid.llm.shingling import BASE, mixed
from demandgrid.session import discard, materialise

#: Fixed values of the report.
SHORTEST, LONGEST, LEAST, COVERED, FIRST = 2, 5, 100, 100, 2000
SHARDS = 2
#: Up to so many rows, phrases that reach the threshold are broadcast, and their hashes sent to the driver; with more, they are shuffled.
SMALL = 200_000
NO_LANG = "und"
#: A-Z in lower case, tab as space, and `.` for all that ends a piece.
LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 10)
#: Text of a language that a task counts at once; of a longer text, all of it.
BLOCK_BYTES = 8 << 20
#: A word that is at least one in so many is followed by many others: its phrases are dealt to parts.
HOT_SHARE, HOT_PARTS, WORD_PARTS = 1000, 64, 1024
#: Tasks that add up the counts of a scan, per task that counts.
SUMS_EACH = 2


def bit_array(rows: DataFrame, hash_: str, bits: int, few: bool = False) -> np.ndarray:
    """The hashes of the rows as set bits. ``bits`` / 8 bytes reach the driver, whatever the number of rows, or of ``few`` rows the hashes."""
    at = rows.select(F.col(hash_).bitwiseAND(bits - 1).alias("p"))
    if few:
        out = np.zeros(bits // 8, np.uint8)
        p = at.toArrow()["p"].to_numpy()
        np.bitwise_or.at(out, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))
        return out
    maps = at.groupBy(F.expr(f"p div {BITMAP}").alias("b")).agg(F.expr(f"bitmap_construct_agg(p % {BITMAP})").alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for row in maps.toLocalIterator():
        out[row["b"] * (BITMAP // 8) : (row["b"] + 1) * (BITMAP // 8)] = np.frombuffer(row["m"], np.uint8)
    return out


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.astype(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def longer(hashes: np.ndarray, next_words: np.ndarray) -> np.ndarray:
    """Hashes of phrases, each extended by a word."""
    return mixed(hashes * np.uint64(BASE) + next_words)


def phrase_hash(lang: bytes, phrase: bytes) -> int:
    h = word_hashes([lang])
    for word in word_hashes(phrase.split(b" ")):
        h = longer(h, word.reshape(1))
    return int(h.view(np.int64)[0])


def _phrases(names: pa.Array, lang: bytes, ids: np.ndarray, at: np.ndarray, length: int) -> pa.Array:
    """The keys (language, line feed, phrase) of ``length`` words each, from ``at`` on."""
    words = [names.take(pa.array(ids[at + j])) for j in range(length)]
    phrase = words[0] if length == 1 else pc.binary_join_element_wise(*words, pa.scalar(" ", names.type))
    return pc.binary_join_element_wise(pa.scalar(lang.decode(), names.type), phrase, pa.scalar("\n", names.type))


def _grouped(group: np.ndarray, lasts: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(order, last words, counts) of each group of rows: where its first row is, its last words with blanks between, and their counts."""
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    ends = pa.array(np.append(first, len(order)), pa.int32())
    joined = pc.binary_join(pa.ListArray.from_arrays(ends, lasts.take(pa.array(order)).cast(pa.string())), " ")
    return order[first], joined, pa.ListArray.from_arrays(ends, pa.array(counts[order], pa.int64()))


def count_block(
    lang: bytes, text: bytes, words_too: bool, reached: np.ndarray | None, recent: np.ndarray | None, longest: int, hot: tuple[str, ...] = ()
) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array, pa.Array]]:
    """(heads, parts, last words, counts) of the words (if wanted) and active phrases of a text: those with both subphrases in
    ``reached``, and one of them in ``recent``. A head and one of its last words make a key; a key is always in the same part,
    which is 0 unless the head is a language or one of the ``hot`` words."""
    # The first word is the end of a piece, so that it has number 0.
    plain = (b". " + text.translate(LETTERS).replace(b".", b" . ")).rstrip(b" ")
    words = pc.ascii_split_whitespace(pa.array([plain], pa.large_binary()).cast(pa.large_string())).flatten().dictionary_encode()
    ids, names = words.indices.to_numpy().astype(np.int64), words.dictionary
    own = word_hashes(names.cast(pa.large_binary()).to_pylist())
    parts = np.zeros(len(names), np.int64)
    parts[pc.index_in(pa.array(hot, names.type), value_set=names).drop_null().to_numpy()] = HOT_PARTS
    if words_too:
        counts = np.bincount(ids, minlength=len(names))
        counts[0] = 0
        some = np.flatnonzero(counts)
        part = (own[some] % np.uint64(WORD_PARTS)).astype(np.int64)
        first, lasts, each = _grouped(part, names.take(pa.array(some)), counts[some])
        yield pa.array([lang.decode() + "\n"] * len(first), names.type), part[first], lasts, each
    if reached is None:
        return
    # Of words, the bits are looked up once per name; of longer phrases, where both subphrases stand.
    hashes = longer(np.repeat(word_hashes([lang]), len(names)), own)
    known_names = holds(reached, hashes)
    known_names[0] = False
    known, late = known_names[ids], holds(recent, hashes)[ids]
    at, hashes = np.flatnonzero(known), hashes[ids[known]]
    for length in range(2, longest + 1):
        # ``at``: where known phrases of one word less begin.
        after = known[np.minimum(at + 1, len(ids) - 1)] & (at + 1 < len(ids))
        at, hashes = at[after], hashes[after]
        new = at[late[at] | late[at + 1]]
        code = ids[new]
        for j in range(1, length):
            # Numbered anew before each step, a code and a word fit 64 bits.
            code = np.unique(code, return_inverse=True)[1] * len(names) + ids[new + j]
        code, first, counts = np.unique(code, return_index=True, return_counts=True)
        # Equal heads, all but the last word, follow each other.
        begin, last = new[first], ids[new[first] + length - 1]
        part = np.zeros(len(begin), np.int64)
        if length == 2:
            some = parts[ids[begin]] > 0
            part[some] = 1 + (own[last[some]] % np.uint64(HOT_PARTS)).astype(np.int64)
        group = np.cumsum(np.diff(code // len(names), prepend=-1) > 0) * (HOT_PARTS + 1) + part
        chosen, lasts, each = _grouped(group, names.take(pa.array(last)), counts)
        heads = _phrases(names, lang, ids, begin[chosen], length - 1)
        yield pc.binary_join_element_wise(heads, pa.scalar("", names.type), pa.scalar(" ", names.type)), part[chosen], lasts, each
        if not len(at) or length == longest:
            return
        hashes = longer(hashes, own[ids[at + length - 1]])
        here = holds(reached, hashes)
        at, hashes = at[here], hashes[here]
        known, late = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        known[at], late[at] = True, holds(recent, hashes)


def scan(texts: DataFrame, words_too: bool, reached: np.ndarray | None, recent: np.ndarray | None, longest: int, hot: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(key, c): language, line feed and phrase, with the count in these texts (lang, text).

    The phrases of a block move as their head, once, and all its last words. ``hot``: (lang, word) of words with very many.
    """
    bits = texts.sparkSession.sparkContext.broadcast((reached, recent))
    hot_words: dict[bytes, tuple[str, ...]] = {}
    for lang, word in hot:
        hot_words[lang.encode()] = (*hot_words.get(lang.encode(), ()), word)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[bytes]] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                for heads, part, lasts, counts in count_block(lang, b".".join(parts), words_too, *bits.value, longest, hot_words.get(lang, ())):
                    arrays = [heads.cast(pa.string()), pa.array(part, pa.int64()), lasts, counts]
                    yield pa.RecordBatch.from_arrays(arrays, names=["head", "part", "lasts", "counts"])
            held.clear()

        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                data = text.as_buffer().to_pybytes()
                held.setdefault(lang.as_py().encode(), []).append(data)
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield from counted()
                    size = 0
        yield from counted()

    made = texts.mapInArrow(count, "head string, part long, lasts string, counts array<long>")
    # Tasks are sized by the corpus: by compressed bytes, AQE would give too many phrases to one.
    made = made.repartition(max(1, SUMS_EACH * texts.rdd.getNumPartitions()), "head", "part")
    each = made.select("head", "part", F.explode(F.arrays_zip(F.split("lasts", " ").alias("last"), F.col("counts").alias("c"))).alias("e"))
    summed = each.groupBy("head", "part", F.col("e.last").alias("last")).agg(F.sum("e.c").alias("c"))
    return summed.select(F.concat("head", "last").alias("key"), "c")


def _phrase(key: Column) -> Column:
    return F.substring_index(key, "\n", -1)


def _without_last(key: Column) -> Column:
    return F.left(key, F.length(key) - F.length(F.substring_index(key, " ", -1)) - 1)


def _without_first(key: Column) -> Column:
    phrase = _phrase(key)
    language = F.left(key, F.length(key) - F.length(phrase))
    return F.concat(language, F.substring(phrase, F.instr(phrase, " ") + 1, F.length(phrase)))


def _words(key: Column) -> Column:
    return F.size(F.split(_phrase(key), " "))


@F.arrow_udf(T.LongType())
def key_hash(keys: pa.Array) -> pa.Array:
    return pa.array([phrase_hash(*k.as_py().encode().rsplit(b"\n", 1)) for k in keys], pa.int64())


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of up to ``longest`` words that occur ``least`` times, and (lang, n), all words.

    ``docs`` has text and lang; a null language is ``und``, a null text is empty. Runs a few jobs per scan.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = pick(docs, "lang", "text").where(F.length("text") > 0)
    dealt = rows.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"))
    corpus = materialise(dealt, "llm-shards", ["shard"])
    counted: list[DataFrame] = []
    complete, totals = [], []
    reached = spark.createDataFrame([], "key string, reach int, words int, h long")
    at, bits, active, hot = 0, (None, None), 0, ()
    while True:
        texts = corpus.where(F.col("shard") == at % shards).select("lang", "text")
        table = scan(texts, at < shards, *bits, longest, hot).withColumn("x", F.xxhash64("key"))
        counted.append(materialise(table, "llm-scan"))
        if len(counted) > shards:
            # No phrase that is still counted has counts as old as these.
            discard(counted.pop(0))
        if at < shards:
            words = counted[-1].where(F.instr(_phrase(F.col("key")), " ") == 0)
            sums = words.groupBy(F.expr("left(key, length(key) - length(substring_index(key, '\\n', -1)) - 1)").alias("lang")).agg(F.sum("c").alias("n"))
            totals.append(materialise(sums, "llm-totals"))
        summed = _summed(counted, least, shards)
        known = F.broadcast(reached) if active <= SMALL else reached
        started = _started(summed, known, at, shards, least)
        now = materialise(started, "llm-reached")
        if at == 0:
            # At most HOT_SHARE words, whatever the table.
            all_words = totals[0].agg(F.sum("n")).first()[0] or 0
            often = now.where((F.col("words") == 1) & (F.col("f") * HOT_SHARE >= all_words)).select("key").collect()
            hot = tuple(tuple(r["key"].rsplit("\n", 1)) for r in often)
        # A phrase whose cycle ends with this scan has its count.
        complete.append(now.where(F.col("start") == at - shards + 1).select("key", "words", "f"))
        new = now.join(known, "key", "left_anti").select("key", F.lit(at).alias("reach"), "words", key_hash("key").alias("h"))
        reached = materialise(reached.unionByName(new), "llm-active")
        active = reached.count()
        at += 1
        # Only phrases reached within the last cycle can have extensions that are still counted.
        extended = reached.where(F.col("words") < longest)
        late = extended.where(F.col("reach") >= at - shards)
        if at >= shards and late.isEmpty():
            break
        bits = tuple(bit_array(some, "h", bits_for(active), active <= SMALL) for some in (extended, late))
    for table in (corpus, *counted):
        discard(table)
    whole = complete[0]
    for part in complete[1:]:
        whole = whole.unionByName(part)
    total = totals[0]
    for part in totals[1:]:
        total = total.unionByName(part)
    lang = F.expr("left(key, length(key) - length(substring_index(key, '\\n', -1)) - 1)").alias("lang")
    return whole.select(lang, _phrase(F.col("key")).alias("phrase"), "words", "f"), total.groupBy("lang").agg(F.sum("n").alias("n"))


def _summed(counted: list[DataFrame], least: int, shards: int) -> DataFrame:
    """(key, by_scan): of the phrases with ``least`` counts in these scans, the counts of each, the last scan first."""
    share = -(-least // shards)
    tables = [t.withColumn("ago", F.lit(len(counted) - 1 - i)) for i, t in enumerate(counted)]
    all_ = tables[0]
    for t in tables[1:]:
        all_ = all_.unionByName(t)
    likely = all_.where(F.col("c") >= share).select("x")
    rows = likely.count()
    if rows <= SMALL:
        kept = all_.join(F.broadcast(likely), "x", "left_semi")
    else:
        bits = all_.sparkSession.sparkContext.broadcast(bit_array(likely, "x", bits_for(rows)))

        @F.arrow_udf(T.BooleanType())
        def is_likely(x: pa.Array) -> pa.Array:
            return pa.array(holds(bits.value, x.to_numpy().view(np.uint64)))

        kept = all_.where(is_likely("x"))
    per_scan = [F.sum(F.when(F.col("ago") == i, F.col("c")).otherwise(0)) for i in range(len(counted))]
    return kept.groupBy("key").agg(F.array(*per_scan).alias("by_scan"), F.sum("c").alias("total")).where(F.col("total") >= least)


def _started(summed: DataFrame, reached: DataFrame, at: int, shards: int, least: int) -> DataFrame:
    """(key, words, start, f): phrases that are active, with the scan they started with, and ``least`` counts since."""
    sized = summed.withColumn("words", _words(F.col("key")))
    words = sized.where("words = 1").withColumn("start", F.lit(0))
    rest = sized.where("words > 1").withColumns({"head": _without_last(F.col("key")), "tail": _without_first(F.col("key"))})
    rest = rest.join(reached.select(F.col("key").alias("head"), F.col("reach").alias("_head")), "head")
    rest = rest.join(reached.select(F.col("key").alias("tail"), F.col("reach").alias("_tail")), "tail")
    rest = rest.withColumn("start", F.greatest("_head", "_tail") + 1).select(*words.columns)
    known = words.unionByName(rest).where((F.col("start") <= at) & (F.col("start") > at - shards))
    since = F.slice("by_scan", F.lit(1), F.lit(at) - F.col("start") + 1)
    f = F.aggregate(since, F.lit(0).cast("long"), lambda total, c: total + c)
    return known.select("key", "words", "start", f.alias("f")).where(F.col("f") >= least)


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, first: int = FIRST, shards: int = SHARDS
) -> DataFrame:
    """The ``first`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Phrases of 2 to ``longest`` words with a = f >= ``least``; cut after its first words into parts that occur l and r times,
    a phrase scores floor(1000 a n / (l r)), n being the words of the language; the lowest-scoring cut counts, of equal ones the
    first. A phrase inside a longer one that occurs in at least ``covered`` percent of its places is left out. Ranked by score, a
    and phrase (by bytes).

    Whole texts are counted, however long; phrases do not cross texts, so repeated rows count each and their order does not
    matter. A null language is ``und``; null, empty and blank texts have no words; an empty table gives no rows; other
    columns are ignored. Scores are exact up to 38 digits of 1000 a n.
    """
    phrases, totals = frequent_phrases(docs, least, longest, shards)
    phrases = materialise(phrases, "llm-phrases")
    several = phrases.where(f"words >= {SHORTEST}").withColumnRenamed("f", "a")
    # What is inside a phrase of two more words is inside one of one more, which occurs no less often.
    outer = several.where(f"words > {SHORTEST}").withColumn(
        "phrase", F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring(phrase, instr(phrase, ' ') + 1)")))
    )
    around = outer.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = several.join(around, ["lang", "phrase"], "left").where(F.coalesce(F.col("around"), F.lit(0)) * 100 < F.col("a") * covered)
    cuts = kept.select("lang", "phrase", "words", "a", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumns({"head": F.expr("substring_index(phrase, ' ', k)"), "tail": F.expr("substring_index(phrase, ' ', k - words)")})
    f = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(f.withColumnsRenamed({"phrase": "head", "f": "l"}), ["lang", "head"])
    cuts = cuts.join(f.withColumnsRenamed({"phrase": "tail", "f": "r"}), ["lang", "tail"]).join(totals, "lang")
    exact = "cast(1000 * cast(a as decimal(18, 0)) * cast(n as decimal(16, 0)) as decimal(38, 0)) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))"
    scored = cuts.withColumn("score", F.expr(exact).cast("long"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    flat = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = flat.withColumn("rank", rank).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
