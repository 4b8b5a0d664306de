"""N-gram Jaccard join with Bayesian candidate pruning.

Words are runs of non-spaces, lower-cased; a document is its set of five-word shingles (a shorter
text is one shingle). Equal word sequences are one text. Texts that share a band of MinHash values
are candidates; bands link texts into blocks (connected components of the band graph), and a block is
compared in tiles of bounded size, so a large group of near copies is spread over tasks and only its
counts leave them. In a tile, all pairs are compared 20 MinHash values at a time, and a pair is
dropped when the posterior probability that its similarity reaches the threshold (uniform prior)
falls below the tolerance; the rest are verified exactly on their shingle sets. Texts with similarity s
that nothing else links share no band with probability (1 - s^4)^25, 1.9e-6 at 0.8.

Nulls: a null text is an empty one; texts without words are equal to each other. A null ``doc_id`` is
a row like any other, but never names a class unless the class has no other. Repeated rows are
documents of their own. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import ARROW_ROWS, as_row, removed, row_columns, row_key, shared_dir, slices, text_or_empty, written
from stockloom.llm.graphs import components


@dataclass(frozen=True)
class Settings:
    """bands * rows MinHash values; a pair is dropped below ``tolerance``; tiles hold about ``tile`` texts or ``tile_shingles``."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 25
    rows: int = 4
    step: int = 20
    tolerance: float = 1e-4
    tile: int = 768
    tile_shingles: int = 1_500_000
    seed: int = 11


def _word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    for w in words:
        if w not in known:
            known[w] = xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(words: list[str], n: int, known: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; one of all words where there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    h = _word_hashes(words, known)
    n = min(n, len(words))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def minhash(own: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least 32-bit hash for each factor, over all shingles in blocks."""
    best = np.full(len(factors), 0xFFFFFFFF, np.uint64)
    for low in range(0, len(own), 8192):
        best = np.minimum(best, ((factors * own[None, low : low + 8192]) >> np.uint64(32)).min(1))
    return best.astype(np.uint32)


def least_matches(settings: Settings) -> list[tuple[int, int]]:
    """(values compared, fewest equal ones that keep a pair): P(similarity >= threshold | matches) under a uniform prior."""
    out, t = [], settings.threshold
    for n in range(settings.step, settings.bands * settings.rows + 1, settings.step):
        # P(S >= t | m of n) = P(Binomial(n + 1, t) <= m)
        total, m = 0.0, 0
        while (total := total + comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < settings.tolerance:
            m += 1
        out.append((n, m))
    return out


TEXTS = "doc_id long, row_key long, text_key string, n_shingles long, signature binary, bands array<long>"


def signatures(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row per document: the key of its word sequence, its MinHash values and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_hexdigest

        factors = np.random.default_rng(settings.seed).integers(0, 1 << 64, (settings.bands * settings.rows, 1), np.uint64) | np.uint64(1)
        places = np.arange(settings.bands, dtype=np.uint64)
        known: dict[str, int] = {}
        for batch in slices(batches, 2):
            if len(known) > 400_000:
                known.clear()
            found = []
            for text in batch.column(2).to_pylist():
                words = text.lower().split()
                own = shingles(words, settings.words, known)
                values = minhash(_mix(own), factors)
                band = np.zeros(settings.bands, np.uint64)
                for column in values.reshape(settings.bands, settings.rows).T.astype(np.uint64):
                    band = _mix(band * np.uint64(0x9E3779B97F4A7C15) + column + np.uint64(1))
                key = xxh3_128_hexdigest(" ".join(words).encode("utf-8", "surrogatepass"))
                found.append((key, len(own), values.tobytes(), _mix(band + places).view(np.int64)))
            columns = list(zip(*found)) if found else [[]] * 4
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.list_(pa.int64()))],
                names=[x.split()[0] for x in TEXTS.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), text_or_empty().alias("text")).mapInArrow(run, TEXTS)


def _tiles(a: pd.DataFrame, b: pd.DataFrame | None, settings: Settings) -> tuple[list, np.ndarray, np.ndarray]:
    """Keys of the tile's texts, and the pairs (places in that list) that are links."""
    both = a if b is None else pd.concat([a, b], ignore_index=True)
    n, cut = len(both), len(a)
    values = np.stack([np.frombuffer(x, np.uint32) for x in both["signature"]])
    left, right = (np.arange(n), np.arange(n)) if b is None else (np.arange(cut), np.arange(cut, n))
    # Every pair of the tile: bands only bring texts into one block.
    near = np.ones((len(left), len(right)), bool)
    if b is None:
        near &= left[:, None] < right[None]
    x, y = np.nonzero(near)
    x, y = left[x], right[y]
    at = 0
    for upto, least in least_matches(settings):
        same = np.zeros(len(x), np.int32) if at == 0 else same
        for low in range(0, len(x), 100_000):
            part = slice(low, low + 100_000)
            same[part] += (values[x[part], at:upto] == values[y[part], at:upto]).sum(1, dtype=np.int32)
        keep = same >= least
        x, y, same, at = x[keep], y[keep], same[keep], upto
    # Exactly: mark one text's shingles, count the marked ones of each partner.
    sets = [np.frombuffer(s, np.uint64) for s in both["shingles"]]
    used = np.unique(np.concatenate((x, y)))
    if not len(used):
        return both["text_key"].tolist(), x, y
    number = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)[1]
    size = np.asarray([len(s) for s in sets])
    first = np.zeros(n, np.int64)
    first[used] = np.cumsum(size[used]) - size[used]
    mark = np.zeros(int(number.max(initial=-1)) + 1, bool)
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    link = np.zeros(len(x), bool)
    groups = np.flatnonzero(np.diff(x, prepend=-1))
    for low, high in zip(groups, np.append(groups[1:], len(x))):
        i = x[low]
        own = number[first[i] : first[i] + size[i]]
        mark[own] = True
        for part in range(low, high, 256):
            others = y[part : min(high, part + 256)]
            width = size[others]
            ends = np.cumsum(width)
            hits = mark[number[np.repeat(first[others] - ends + width, width) + np.arange(ends[-1])]]
            common = np.add.reduceat(hits, ends - width, dtype=np.int64)
            link[part : part + len(others)] = common >= settings.threshold * (size[i] + width - common) - 1e-9
        mark[own] = False
    return both["text_key"].tolist(), x[link], y[link]


def _tree(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Places of links that form a spanning forest."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    keep = []
    for at, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)
            keep.append(at)
    return np.asarray(keep, np.int64)


LINKS = "text_key string, other string, links long, linked_docs long"


def classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row per document: ``doc_id, row_key, class_id, n_links, n_text_links, n_copies, is_first``.

    ``class_id`` is the least ``doc_id`` of the class; ``n_links`` counts the other documents whose
    similarity reaches the threshold (copies included), ``n_text_links`` the different texts among
    them, ``n_copies`` the documents with the same words. ``is_first`` marks the rows of the class's
    first text (equal rows are all marked).
    """
    spark = docs.sparkSession
    base = shared_dir(spark, "ngram-join")
    rows = written(signatures(docs, settings), f"{base}/rows", ARROW_ROWS)
    texts = rows.groupBy("text_key").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first"),
        F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("bands").alias("bands"),
    )
    texts = written(texts, f"{base}/texts")
    banded = texts.filter("n_shingles > 0").select("text_key", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("text_key").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "a")
    starts = banded.join(written(heads, f"{base}/heads"), "band").select("a", F.col("text_key").alias("b")).filter("a <> b").distinct()
    blocks = written(components(starts, "blocks"), f"{base}/blocks")
    members = blocks.select(F.col("node").alias("text_key"), F.col("root").alias("block"))
    sized = texts.select("text_key", "first", "copies", "n_shingles", "signature").join(members, "text_key")
    sizes = sized.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    tiles = F.greatest(F.lit(1), F.ceil(F.col("n") / settings.tile), F.ceil(F.col("s") / settings.tile_shingles)).cast("int")
    # Only the blocks of several tiles are joined; written first, so that Spark may split the rows of a large one.
    large = written(sizes.select("block", tiles.alias("tiles")).filter("tiles > 1"), f"{base}/large")
    split = sized.join(large, "block", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    members = written(split.withColumn("tile", F.pmod(F.xxhash64("text_key"), F.col("tiles")).cast("int")), f"{base}/members")
    keys = members.select(F.col("first.doc_id").alias("first_id"), F.col("first.row_key").alias("first_key"), "text_key", "block", "tiles", "tile", "copies", "signature")
    n = settings.words

    def with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in slices(batches, 0):
            if len(known) > 400_000:
                known.clear()
            sets = [shingles(t.lower().split(), n, known).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.record_batch([*batch.columns[1:], pa.array(sets, pa.binary())], names=[*batch.schema.names[1:], "shingles"])

    # One document stands for each text; only documents in blocks are read again.
    own = docs.select(F.col("doc_id").cast("long").alias("first_id"), row_key().alias("first_key"), text_or_empty().alias("text"))
    met = own.join(keys, own["first_id"].eqNullSafe(keys["first_id"]) & (own["first_key"] == keys["first_key"]))
    met = met.select("text", "text_key", "block", "tiles", "tile", "copies", "signature")
    full = met.mapInArrow(with_shingles, "text_key string, block string, tiles int, tile int, copies long, signature binary, shingles binary")
    # A text meets every tile of its block: a pair of tiles is one task's work.
    spread = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.select("*", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iat[0], group["j"].iat[0]
        group = group.drop_duplicates("text_key")  # rows equal in id and text
        a = group[group["tile"] == i].reset_index(drop=True)
        b = None if i == j else group[group["tile"] == j].reset_index(drop=True)
        names, x, y = _tiles(a, b, settings)
        copies = np.concatenate((a["copies"].to_numpy(), b["copies"].to_numpy() if b is not None else np.empty(0, np.int64)))
        links = np.bincount(x, minlength=len(names)) + np.bincount(y, minlength=len(names))
        linked = np.bincount(x, copies[y], len(names)) + np.bincount(y, copies[x], len(names))
        some = np.flatnonzero(links)
        tree = _tree(x, y, len(names))
        names = np.asarray(names, object)
        counts = pd.DataFrame({"text_key": names[some], "other": None, "links": links[some], "linked_docs": linked[some].astype(np.int64)})
        edges = pd.DataFrame({"text_key": names[x[tree]], "other": names[y[tree]], "links": 0, "linked_docs": 0})
        return pd.concat([counts, edges], ignore_index=True) if len(edges) else counts.iloc[:0]

    links = written(spread.groupBy("block", "i", "j").applyInPandas(compare, LINKS), f"{base}/links", ARROW_ROWS)
    counts = links.groupBy("text_key").agg(F.sum("links").alias("n_text_links"), F.sum("linked_docs").alias("linked"))
    roots = components(links.filter("other IS NOT NULL").select(F.col("text_key").alias("a"), F.col("other").alias("b")), "classes")
    roots = roots.select(F.col("node").alias("text_key"), "root")
    grouped = texts.select("text_key", "copies", "first").join(roots, "text_key", "left").join(counts, "text_key", "left")
    grouped = grouped.withColumn("root", F.coalesce("root", "text_key"))
    grouped = written(grouped, f"{base}/grouped")
    firsts = written(grouped.groupBy("root").agg(F.min("first").alias("class_first")), f"{base}/firsts")
    named = grouped.join(firsts, "root").select(
        "text_key", "class_first", F.col("copies").alias("n_copies"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    named = written(named, f"{base}/named")
    for done in ("texts", "members", "blocks", "links", "large", "heads", "grouped", "firsts"):
        removed(spark, f"{base}/{done}")
    is_first = F.col("doc_id").eqNullSafe(F.col("class_first.doc_id")) & (F.col("row_key").eqNullSafe(F.col("class_first.row_key")))
    return rows.select("doc_id", "row_key", "text_key").join(named, "text_key").select(
        "doc_id", "row_key", F.col("class_first.doc_id").alias("class_id"), "n_links", "n_text_links", "n_copies", is_first.alias("is_first")
    )


def one_of_each_class(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents with the least id (then text) of each class; of equal rows one stays."""
    found = classes(docs, settings).groupBy("doc_id", "row_key").agg(F.first("is_first").alias("first"), F.count(F.lit(1)).alias("rows"))
    kept = found.filter("first").select("doc_id", F.col("row_key").alias("kept_key"), "rows")
    own = as_row(docs)
    met = own.join(kept, own["row.doc_id"].eqNullSafe(kept["doc_id"]) & own["row_key"].eqNullSafe(kept["kept_key"]))
    once = met.filter("rows = 1")
    equal = met.filter("rows > 1").dropDuplicates(["doc_id", "kept_key"])
    return once.unionAll(equal).select(*row_columns(docs))


def op1_ngram_join(docs: DataFrame) -> DataFrame:
    """Classes of all documents at five words and 0.8, with each document's number of links."""
    return classes(docs).select("doc_id", "class_id", "n_links", "n_text_links", "n_copies")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT array_to_string(ws, ' ') AS k, any_value(ws) AS ws, min(doc_id) AS f, count(*) AS c FROM w GROUP BY 1),
s AS (SELECT DISTINCT k, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [k]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM t),
n AS (SELECT k, count(*) AS z FROM s GROUP BY k),
p AS (SELECT a.k AS ka, b.k AS kb, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2),
l AS (SELECT ka, kb FROM p JOIN n x ON x.k = ka JOIN n y ON y.k = kb WHERE shared >= 0.8 * (x.z + y.z - shared) - 1e-9),
r(k, f) AS (SELECT k, f FROM t UNION SELECT l.kb, r.f FROM r JOIN l ON l.ka = r.k),
c AS (SELECT k, min(f) AS class_id FROM r GROUP BY k),
m AS (SELECT ka AS k, count(*) AS tl, sum(t.c) AS ld FROM l JOIN t ON t.k = kb GROUP BY ka)
SELECT w.doc_id, class_id, CAST(coalesce(ld, 0) + t.c - 1 AS BIGINT) AS n_links, CAST(coalesce(tl, 0) AS BIGINT) AS n_text_links, t.c AS n_copies
FROM w JOIN t ON t.k = array_to_string(w.ws, ' ') JOIN c ON c.k = t.k LEFT JOIN m ON m.k = t.k
"""
