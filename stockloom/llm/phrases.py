"""Phrase collocations: phrases of two to four words that occur together more than apart, for each language.

A text is split once: a task numbers the words of a chunk of texts as they come, and hands on the arrays of numbers
and the chunk's words with their counts. Words get ids by falling frequency, and those of a chunk's words
meet its arrays in a join; a text becomes an array of ids, -1 for words that are too rare and
-2 between pieces. Pairs of neighbours are counted in tiles of the table of all pairs: a tile is a square
of ids, and ids of frequent words are small, so a few tiles hold most pairs. A task counts its pairs by sorting them
and deals the distinct ones to tiles; the tasks' counts
of a tile are added up (in a dense table where it can be full) in groups of ``FAN`` tasks, and those again, so that no task holds more than that many copies of a tile. Frequent pairs are ranked again and stand as ids in the place of their
first word, and pairs of such an id with the word after it are phrases of three words; once more gives four.

Nothing that grows with the corpus is whole in one process: a chunk has a bounded number of words, and phrases are looked up
in blocks of at most ``block`` entries, where a further block is a further pass over the id arrays. The arrays are written to the
shared folder, as are the ranked tables.

Nulls: a null text is empty, a null language is ``und`` (and joins a language of that name). Repeated rows
count as often as they stand there; ties are broken as the contract says, by least cut and by the phrase's bytes. An empty table, or
one without phrases, gives no rows. Columns other than ``text`` and ``lang`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.common import ARROW_ROWS, removed, shared_dir, shuffle_partitions, slices, text_or_empty, written

#: Entries of a list of phrases that a process holds at a time, twelve bytes each.
BLOCK = 1 << 22
#: Ids below SIDE are one block; every further doubling of ids is SPLIT blocks, so that ranked ids fill tiles of pairs about evenly.
#: A tile of up to DENSE_CELLS cells is counted densely where a DENSE-th of them can be full.
SIDE, SPLIT, DENSE_CELLS, DENSE = 512, 8, 1 << 22, 16
#: Pairs that a task gathers before it counts them; distinct words and words in all that it numbers before it hands them on; tasks whose tiles meet.
GATHER, HELD_WORDS, HELD_PLACES, FAN = 1 << 19, 1 << 18, 1 << 21, 64
#: Pairs that a task has counted when it adds them up; it hands them on where half as many are distinct.
HELD_PAIRS = 3 << 19
#: Bytes of counts in a batch that a task hands on, unless one tile has more.
PART_BYTES = 1 << 21
#: Bytes of text whose ids are in one array, unless one text is longer; rows of a batch of such arrays.
ARRAY_BYTES, ARRAY_ROWS = 1 << 18, 16
#: A pair of ids as one number: so many bits are for the word, the rest (35) for the phrase before it.
WORD_BITS = 28
RARE, GAP = -1, -2
LEAST, LONGEST, TOP = 30, 4, 2000

#: What ends a piece, and what else separates words.
_STOPS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"


def _plain() -> bytes:
    table = bytearray(bytes(range(256)).lower())
    for byte in _STOPS:
        table[byte] = ord(_GAP)
    for byte in _BLANKS:
        table[byte] = ord(" ")
    return bytes(table)


#: What stands for the end of a piece; no word has it.
_GAP = b"."
_PLAIN = _plain()


def words(text: bytes) -> list[bytes]:
    """Words in order, a stop between pieces; A-Z alone are lowered."""
    return text.translate(_PLAIN).replace(_GAP, b" . ").split()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The words of the batch's texts, the texts of a language together."""
    together: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
        together.setdefault(lang, []).append(text)
    for lang, texts in together.items():
        yield lang, words(b"\n".join(texts))


class _Numbers(dict):
    """The words of a chunk and their numbers, the next one where a word is new; 0 is the gap between pieces."""

    def __init__(self) -> None:
        super().__init__({_GAP: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


_CHUNKS = pa.schema([("chunk", pa.int64()), ("words", pa.binary()), ("lang", pa.string()), ("word", pa.string()), ("at", pa.int32()), ("f", pa.int64())])


def _chunk(chunk: int, lang: str, numbers: _Numbers, arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The arrays of a chunk, and its words with their numbers and counts."""

    def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
        columns["chunk"] = pa.array(np.full(n, chunk, np.int64))
        return pa.record_batch([columns[c.name] if c.name in columns else pa.nulls(n, c.type) for c in _CHUNKS], schema=_CHUNKS)

    yield rows(len(arrays), words=pa.array([a.tobytes() for a in arrays], pa.binary()))
    n, f = len(numbers) - 1, np.bincount(np.concatenate(arrays), minlength=len(numbers))
    named = pa.array(list(numbers)[1:], pa.binary()).cast(pa.string())
    yield rows(n, lang=pa.array([lang] * n, pa.string()), word=named, at=pa.array(np.arange(1, n + 1, dtype=np.int32)), f=pa.array(f[1:].astype(np.int64)))


def chunked(docs: DataFrame) -> DataFrame:
    """Rows of two kinds, for chunks of texts of one language.

    ``chunk, words``: several texts as an array of the numbers of their words in the chunk (four bytes each), 0 between pieces.
    ``chunk, lang, word, at, f``: a word of the chunk, its number there and its count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        serial, places = TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches, 1, ARRAY_BYTES):
            for lang, found in _by_language(batch):
                numbers, arrays = held.setdefault(lang, (_Numbers(), []))
                arrays.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                places += len(found)
            if places > HELD_PLACES or sum(len(n) for n, _ in held.values()) > HELD_WORDS:
                for serial, (lang, own) in enumerate(held.items(), serial + 1):
                    yield from _chunk(serial, lang, *own)
                held.clear()
                places = 0
        for serial, (lang, own) in enumerate(held.items(), serial + 1):
            yield from _chunk(serial, lang, *own)

    return _texts(docs).mapInArrow(run, "chunk long, words binary, lang string, word string, at int, f long")


def ranked(rows: DataFrame, keys: list[str], path: str, most_bits: int = 63 - WORD_BITS) -> tuple[DataFrame, int]:
    """The rows with ``id``: their place by falling ``f``, then by the keys, from 0; and how many there are.

    A sort over ranges: a place within a range, and the sizes of the ranges before it (one number for each range).
    """
    spark = rows.sparkSession
    order = [F.desc("f"), *keys]
    ranges = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    placed = written(ranges.withColumn("_at", F.monotonically_increasing_id()), f"{path}-ranges")
    of_range, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(placed.groupBy(of_range.alias("p")).count().collect())
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    if total >> most_bits:
        raise ValueError(f"{total} entries have ids of more than {most_bits} bits")
    starts = spark.createDataFrame(before, "_p long, _before long")
    numbered = placed.withColumn("_p", of_range.cast("long")).join(F.broadcast(starts), "_p")
    out = written(numbered.select(*rows.columns, (F.col("_before") + within).alias("id")), path)
    removed(spark, f"{path}-ranges")
    return out, total


def _blocks(listed: DataFrame, total: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of ids, as numbers in order, and the ids that they have as phrases: in blocks of bounded size, on the driver one at a time."""
    pair = F.shiftleft("a", WORD_BITS).bitwiseOR(F.col("b")).alias("pair")
    for low in range(0, max(total, 1), block):
        found = listed.filter((F.col("id") >= low) & (F.col("id") < low + block)).select(pair, "id").toArrow()
        pairs, numbers = found["pair"].to_numpy(), found["id"].to_numpy()
        order = np.argsort(pairs)
        yield pairs[order], numbers[order].astype(_id_type(total))


def _id_type(total: int) -> type:
    return np.int32 if total < 1 << 31 else np.int64


def _renamed(arrays: pa.Table, numbers: pa.Table) -> pa.Table:
    """The arrays of a chunk with ids in the place of its own numbers; words without an id are too rare."""
    given = [np.frombuffer(x.as_buffer(), np.int32) for x in arrays["words"]]
    ids = np.full(1 + max((int(g.max()) for g in given if len(g)), default=0), RARE, np.int32)
    ids[0] = GAP
    ids[numbers["at"].to_numpy()] = numbers["id"].to_numpy()
    return pa.table({"words": pa.array([ids[g].tobytes() for g in given], pa.binary())})


def encoded(chunks: DataFrame, listed: DataFrame, path: str) -> DataFrame:
    """``words``: the texts as arrays of word ids (bytes, four to an id); several texts of a language share an array, a gap between them."""
    ids = listed.select("word", "lang", F.col("id").cast("int").alias("id")).hint("shuffle_hash")
    numbers = chunks.filter("word IS NOT NULL").join(ids, ["word", "lang"]).select(F.col("chunk").alias("of"), "at", "id")
    arrays = chunks.filter("words IS NOT NULL").select("chunk", "words")
    return written(arrays.groupBy("chunk").cogroup(numbers.groupBy("of")).applyInArrow(_renamed, "words binary"), path)


def block_of(ids: np.ndarray) -> np.ndarray:
    """The block of each id: wider the rarer."""
    octave = np.frexp(np.maximum(ids, SIDE) / SIDE)[1] - 1
    within = ((ids >> octave) - SIDE) * SPLIT // SIDE
    return np.where(ids < SIDE, 0, 1 + octave * SPLIT + within)


def bounds_of(block: int) -> tuple[int, int]:
    """The first id of a block and how many it has."""
    if block == 0:
        return 0, SIDE
    octave, within = divmod(block - 1, SPLIT)
    low = (SIDE + within * SIDE // SPLIT) << octave
    return low, (SIDE // SPLIT) << octave


def _area(tile: int) -> tuple[int, int, int, int]:
    """First row, rows, first column and columns of a tile."""
    return *bounds_of(tile >> 16), *bounds_of(tile & 0xFFFF)


def _width(tile: int) -> type:
    _, rows, _, columns = _area(tile)
    return np.int32 if rows * columns < 1 << 31 else np.int64


def counted(tile: int, cells: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of a tile in order and their counts: added up densely where the tile can be full, else by sorted coordinates."""
    _, rows, _, columns = _area(tile)
    if rows * columns <= DENSE_CELLS and sum(map(len, cells)) * DENSE >= rows * columns:
        total = np.zeros(rows * columns, np.int64)
        for at, n in zip(cells, counts):
            total[at] += n  # the cells of one part are distinct
        at = np.flatnonzero(total)
        return at.astype(_width(tile)), total[at]
    cell = np.concatenate(cells)
    order = np.argsort(cell, kind="stable")
    at, starts = np.unique(cell[order], return_index=True)
    return at, np.add.reduceat(np.concatenate(counts)[order], starts)


def tiles(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Every tile with its distinct cells and their counts."""
    yield from _dealt(*np.unique(first << WORD_BITS | second, return_counts=True))


def _dealt(pairs: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Every tile with its cells and their counts, of distinct pairs in order."""
    begin = 0
    while begin < len(pairs):
        # The pairs of a block of first ids stand together.
        block = int(block_of(pairs[begin : begin + 1] >> WORD_BITS)[0])
        row, rows = bounds_of(block)
        end = begin + int(np.searchsorted(pairs[begin:], (row + rows) << WORD_BITS)) if (row + rows) >> (63 - WORD_BITS) == 0 else len(pairs)
        first, second = (pairs[begin:end] >> WORD_BITS) - row, pairs[begin:end] & ((1 << WORD_BITS) - 1)
        column = block_of(second).astype(np.uint16)
        order = np.argsort(column, kind="stable")
        column, first, second, count = column[order], first[order], second[order], counts[begin:end][order]
        starts = np.flatnonzero(np.diff(column.astype(np.int32), prepend=-1))
        for low, high in zip(starts.tolist(), np.append(starts[1:], len(order)).tolist()):
            own = block << 16 | int(column[low])
            _, _, left, columns = _area(own)
            yield own, (first[low:high] * columns + (second[low:high] - left)).astype(_width(own)), count[low:high]
        begin = end


def _added(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order and their counts, of several such lists, which are not kept."""
    if len(runs) == 1:
        return runs[0]
    pairs, counts = (np.concatenate(x) for x in zip(*runs))
    runs.clear()
    order = np.argsort(pairs)
    pairs, counts = pairs[order], counts[order]
    del order
    starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    return pairs[starts], np.add.reduceat(counts, starts)


_PARTS = "tile long, part long, cells binary, counts binary"


def _parts(found: dict[int, tuple[np.ndarray, np.ndarray]] | Iterator[tuple[int, np.ndarray, np.ndarray]], part: int) -> Iterator[pa.RecordBatch]:
    """The tiles with their cells and counts as bytes; a count has four bytes where all of the tile's fit."""
    rows, size = [], 0
    for tile, cell, count in ((t, *x) for t, x in found.items()) if isinstance(found, dict) else found:
        rows.append((tile, part, cell.tobytes(), count.astype(np.int32 if count.max() < 1 << 31 else np.int64).tobytes()))
        size += len(rows[-1][2]) + len(rows[-1][3])
        if size >= PART_BYTES:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["tile", "part", "cells", "counts"])


def _merged(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    tile = table["tile"][0].as_py()
    cells = [np.frombuffer(x.as_buffer(), _width(tile)) for x in table["cells"]]
    counts = [np.frombuffer(x.as_buffer(), np.int32 if len(x.as_buffer()) == 4 * len(c) else np.int64) for x, c in zip(table["counts"], cells)]
    return tile, *counted(tile, cells, [n.astype(np.int64) for n in counts])


def _fewer(table: pa.Table) -> pa.Table:
    """The parts of a tile that a group of tasks has made, as one."""
    tile, cell, count = _merged(table)
    return pa.Table.from_batches(_parts({tile: (cell, count)}, table["part"][0].as_py()))


def _frequent(table: pa.Table) -> pa.Table:
    """All counts of a tile; the pairs that are frequent enough."""
    tile, cell, count = _merged(table)
    row, _, column, columns = _area(tile)
    a, b = np.divmod(cell[count >= LEAST].astype(np.int64), columns)
    return pa.table({"a": pa.array(a + row, pa.int64()), "b": pa.array(b + column, pa.int64()), "f": pa.array(count[count >= LEAST], pa.int64())})


def pair_counts(arrays: DataFrame, head: str, length: int) -> DataFrame:
    """``a, b, f``: counts of the id in ``head`` with the word ``length - 1`` places after it, both in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        runs: list[tuple[np.ndarray, np.ndarray]] = []
        part, size = TaskContext.get().partitionId(), 0

        def handed(least: int = 0) -> Iterator[pa.RecordBatch]:
            """Adds up what was gathered; hands it on if there are so many distinct pairs."""
            runs[:] = [_added(runs)]
            if len(runs[0][0]) >= least:
                yield from _parts(_dealt(*runs.pop()), part)

        for batch in batches:
            for i in range(batch.num_rows):
                _, own, word = _places(batch.column(0)[i].as_py(), batch.column(batch.num_columns - 1)[i].as_py(), length)
                gathered.append(own.astype(np.int64) << WORD_BITS | word)
                size += len(own)
                if size >= GATHER:
                    runs.append(np.unique(np.concatenate(gathered), return_counts=True))
                    gathered.clear()
                    size = 0
                    if sum(len(pairs) for pairs, _ in runs) >= HELD_PAIRS:
                        yield from handed(HELD_PAIRS // 2)
        if size:
            runs.append(np.unique(np.concatenate(gathered), return_counts=True))
        if runs:
            yield from handed()

    width = arrays.rdd.getNumPartitions()
    rows = arrays.select(head, *(["words"] if head != "words" else [])).mapInArrow(run, _PARTS)
    while width > FAN:
        width = -(-width // FAN)
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("tile", "part").applyInArrow(_fewer, _PARTS)
    return rows.groupBy("tile").applyInArrow(_frequent, "a long, b long, f long")


def _places(head: bytes, words_: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a frequent phrase of so many words can begin, the id of its head there, and its last word.

    A head has one word less and stands only where its own words are in one piece. The phrase is frequent only where the head at the
    next place, which is all of it but the first word, is so too.
    """
    word, own = np.frombuffer(words_, np.int32), np.frombuffer(head, np.int32 if len(head) == len(words_) else np.int64)
    at = np.flatnonzero((own[:-1] >= 0) & (own[1:] >= 0))
    return at, own[at], word[at + length - 1]


def heads(arrays: DataFrame, head: str, length: int, listed: DataFrame, total: int, path: str, block: int = BLOCK) -> tuple[DataFrame, str]:
    """``words`` and ``head``: at every place the id (four bytes, or eight) of the listed phrase of so many words that begins there, or -1; and the path of the arrays."""
    spark, last = arrays.sparkSession, max(total - 1, 0) // block
    rows = arrays.select(F.col(head).alias("own"), F.col("words"), F.lit(None).cast("binary").alias("head"))
    for step, entries in enumerate(_blocks(listed, total, block)):
        sent = spark.sparkContext.broadcast(entries)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, ends=step == last) -> Iterator[pa.RecordBatch]:
            keys, numbers = sent.value
            for batch in batches:
                given = list(zip(*(c.to_pylist() for c in batch.columns)))
                places = [_places(own, words_, length) for own, words_, _ in given]
                # Each pair once and in order: a search in order stays near the entries that it has just read.
                pairs, of = np.unique(np.concatenate([own.astype(np.int64) << WORD_BITS | word for _, own, word in places]), return_inverse=True)
                place = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                numbered = np.where(keys[place] == pairs, numbers[place], RARE)[of]
                for (own_bytes, words_, before), (at, _, _), ids in zip(given, places, np.split(numbered, np.cumsum([len(at) for at, _, _ in places])[:-1])):
                    found = np.full(len(words_) // 4, RARE, numbers.dtype) if before is None else np.frombuffer(before, numbers.dtype).copy()
                    found[at[ids >= 0]] = ids[ids >= 0]
                    # The pass before is needed only by a further one.
                    yield pa.record_batch([pa.array([None if ends else own_bytes], pa.binary()), pa.array([words_], pa.binary()), pa.array([found.tobytes()], pa.binary())], names=["own", "words", "head"])

        rows = written(rows.mapInArrow(run, "own binary, words binary, head binary"), f"{path}-{step}", ARRAY_ROWS)
        if step:
            removed(spark, f"{path}-{step - 1}")
    return rows.select("head", "words"), f"{path}-{last}"


def frequent(docs: DataFrame, name: str = "phrases", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``lang, n`` of every language, and ``lang, phrase, parts, f``: words and phrases that occur often enough.

    ``parts`` holds the word ids, which name a phrase in all languages.
    """
    spark = docs.sparkSession
    base = shared_dir(spark, name)
    chunks = written(chunked(docs), f"{base}/chunks", ARROW_ROWS)
    counts = written(chunks.filter("word IS NOT NULL").groupBy("lang", "word").agg(F.sum("f").alias("f")), f"{base}/counts")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    listed, total = ranked(counts.filter(F.col("f") >= LEAST), ["lang", "word"], f"{base}/words", WORD_BITS)
    arrays, head, path = encoded(chunks, listed, f"{base}/texts"), "words", f"{base}/texts"
    removed(spark, f"{base}/chunks")
    grams = listed.select("lang", F.col("word").alias("phrase"), F.array("id").alias("parts"), "f", "id")
    every, word = [grams], listed.select(F.col("id").alias("b"), "word")
    for length in range(2, LONGEST + 1):
        found = written(pair_counts(arrays, head, length), f"{base}/counts-{length}", ARRAY_ROWS)
        pairs, total = ranked(found, ["a", "b"], f"{base}/{length}")
        firsts = every[-1].select("lang", "phrase", "parts", F.col("id").alias("a"))
        grown = pairs.join(firsts, "a").join(word, "b")
        grown = grown.select("lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), F.concat("parts", F.array("b")).alias("parts"), "f", "id")
        every.append(written(grown, f"{base}/grams-{length}"))
        if not total:
            break
        if length < LONGEST:
            (arrays, further), head = heads(arrays, head, length, pairs, total, f"{base}/heads-{length}", block), "head"
            removed(spark, path)  # nothing reads the arrays before any more
            path = further
    out = every[0].unionByName(every[1])
    for more in every[2:]:
        out = out.unionByName(more)
    return totals, out.drop("id")


def scored(grams: DataFrame) -> DataFrame:
    """``lang, phrase, parts, a, l, r, score`` of the phrases that no longer one covers, at their lowest-scoring cut."""
    phrases = grams.filter(F.size("parts") > 1).select("lang", "phrase", "parts", F.col("f").alias("a"))
    # What is inside a longer phrase, with the largest count of such a phrase.
    inside = F.expr(
        "flatten(transform(sequence(2, size(parts) - 1), k -> transform(sequence(1, size(parts) - k + 1), i -> slice(parts, i, k))))"
    )
    covers = phrases.filter(F.size("parts") > 2).select(F.explode(inside).alias("parts"), F.col("a").alias("longer"))
    covers = covers.groupBy("parts").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    own = phrases.join(covers, "parts", "left").filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * 80)).drop("longer")
    cut = own.withColumn("k", F.explode(F.expr("sequence(1, size(parts) - 1)")))
    cut = cut.withColumns({"first": F.expr("slice(parts, 1, k)"), "rest": F.expr("slice(parts, k + 1, size(parts) - k)")})
    known = grams.select("parts", "f")
    cut = cut.join(known.toDF("first", "l"), "first").join(known.toDF("rest", "r"), "rest")
    cut = cut.withColumn("score", F.expr("CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(7,0)) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    least = F.min(F.struct("score", "k", "l", "r")).alias("at")
    return cut.groupBy("lang", "phrase", "parts", "a").agg(least).select("lang", "phrase", "parts", "a", "at.l", "at.r", "at.score")


def first_of_each(rows: DataFrame, top: int = TOP, spread: int = 64) -> DataFrame:
    """The first ``top`` phrases of each language with their ``rank``; a language is first thinned in ``spread`` parts."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parted = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(spread)))
    parted = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    return parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top).drop("part")


def op12_phrases(docs: DataFrame) -> DataFrame:
    """The phrases of the contract, of all texts."""
    totals, grams = frequent(docs)
    best = first_of_each(scored(grams)).join(F.broadcast(totals), "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


#: Words and their places, phrases up to four words by joins of neighbours, then the rules of the contract.
ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT lang, text, row_number() OVER () AS doc FROM documents)
), listed AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM listed, (VALUES (1), (2), (3), (4)) AS ks(k) WHERE len(ws) >= k
), totals AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
counted AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
inner_parts AS (
  SELECT lang, f, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))))) AS phrase
  FROM counted WHERE k > 2
), covers AS (SELECT lang, phrase, max(f) AS longer FROM inner_parts GROUP BY lang, phrase),
own AS (
  SELECT c.* FROM counted c LEFT JOIN covers v USING (lang, phrase) WHERE c.k > 1 AND (v.longer IS NULL OR 100 * v.longer::HUGEINT < 80 * c.f::HUGEINT)
), cuts AS (
  SELECT lang, phrase, f AS a, i, array_to_string(ws[1:i], ' ') AS head, array_to_string(ws[i + 1:k], ' ') AS tail
  FROM own, (VALUES (1), (2), (3)) AS cs(i) WHERE i < k
), priced AS (
  SELECT cuts.lang, cuts.phrase, a, i, h.f AS l, t.f AS r, (2000000 * a::HUGEINT) // (h.f + t.f)::HUGEINT AS score
  FROM cuts JOIN counted h ON h.lang = cuts.lang AND h.phrase = head JOIN counted t ON t.lang = cuts.lang AND t.phrase = tail
), lowest AS (
  SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM lowest JOIN totals USING (lang) QUALIFY rank <= 2000
"""
