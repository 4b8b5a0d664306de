"""Quality, phrases and divergence against brute force, held-out labels and odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from stockloom.llm import divergence, phrases, quality

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, score double, number int, count long, f long, block int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def _table(spark, rows):
    """Documents with columns that clash with the operators' own names."""
    return spark.createDataFrame([(i, t, lang, source, 0.5, 7, 7, 7, 7) for i, (t, lang, source) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def mixed(spark):
    """Few words, so that phrases repeat; null columns, empty texts, a very long text, copies, separators of all kinds."""
    r = random.Random(4)
    vocabulary = ["a", "B", "é", "É", "x\0y", "the", "of", "10%", "z"]
    rows = []
    for i in range(600):
        words = r.choices(vocabulary, weights=range(9, 0, -1), k=r.randrange(60))
        text = "".join(w + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ", " "]) for w in words)
        rows.append((text, r.choice(["en", "en", "fr", None, "und", ""]), r.choice(["s1", "s2", "s3", None])))
    rows += [(None, "en", "s1"), ("", "fr", "s2"), ("", "no words", "s1"), ("?!", "no words", "s2"), ("the of " * 4000, "en", "s2")]
    rows += [("B a the of z", "en", "s1")] * 40
    return rows


def _pieces(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(table)):
        yield [w for w in re.split("[ \t]+", piece) if w]


def _phrases(rows):
    n, f = Counter(), defaultdict(Counter)
    for text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for w in _pieces(text):
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        known = {p: c for p, c in counts.items() if c >= 30}
        parts = lambda p: {p[i : i + k] for k in range(2, len(p)) for i in range(len(p) - k + 1)}
        covered = {q for p, c in known.items() if len(p) > 2 for q in parts(p) if 100 * c >= 80 * known[q]}
        scored = []
        for p, a in known.items():
            if len(p) > 1 and p not in covered:
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:2000], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def test_phrases_against_brute_force(spark, mixed, monkeypatch):
    given, want = _table(spark, mixed), _phrases(mixed)
    assert len(want) > 20 and any(len(x[2].split(" ")) == 4 for x in want)
    assert {tuple(r) for r in phrases.op12_phrases(given).collect()} == want
    # Words and phrases in blocks of three, so that every list takes several passes; tiles that meet two at a time; many hand-overs.
    monkeypatch.setattr(phrases, "FAN", 2)
    monkeypatch.setattr(phrases, "GATHER", 50)
    totals, grams = phrases.frequent(given.repartition(5), block=3)
    best = phrases.first_of_each(phrases.scored(grams), spread=2).join(totals, "lang")
    assert {tuple(r) for r in best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == want
    assert phrases.op12_phrases(given.limit(0)).count() == 0


def test_texts_are_read_once_however_many_words(spark, mixed, monkeypatch):
    """Words are looked up in no blocks, so a larger vocabulary costs no further pass over the texts; chunks of few words; pairs handed on early."""
    made, given, want = [], _table(spark, mixed), _phrases(mixed)
    stored = phrases.written
    monkeypatch.setattr(phrases, "written", lambda rows, path, *more: made.append(path.rsplit("/", 1)[1]) or stored(rows, path, *more))
    for name, few in (("HELD_WORDS", 4), ("HELD_PLACES", 2000), ("ARRAY_BYTES", 2000), ("GATHER", 50), ("HELD_PAIRS", 20)):
        monkeypatch.setattr(phrases, name, few, raising=False)
    totals, grams = phrases.frequent(given.repartition(3), block=5)
    assert sum("texts" in name for name in made) == 1
    best = phrases.first_of_each(phrases.scored(grams)).join(totals, "lang")
    assert {tuple(r) for r in best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == want


def test_blocks_cover_all_ids_once():
    ids = np.unique(np.concatenate([np.arange(20_000), 2 ** np.arange(35), 2 ** np.arange(1, 35) - 1]))
    block = phrases.block_of(ids)
    assert (np.diff(block) >= 0).all() and block.max() < 1 << 16
    for i, b in zip(ids.tolist(), block.tolist()):
        low, size = phrases.bounds_of(b)
        assert low <= i < low + size
    ends = [sum(phrases.bounds_of(b)) for b in range(200)]
    assert [phrases.bounds_of(b)[0] for b in range(1, 200)] == ends[:-1]


def test_tiles_count_pairs_however_dense(monkeypatch):
    r = np.random.default_rng(2)
    a, b = r.integers(0, 3000, 200_000) ** 2 // 3000, r.integers(0, 3000, 200_000) ** 2 // 3000
    a[:5], b[:5] = (1 << 34) + 7, (1 << 27) + 3
    want = Counter(zip(a.tolist(), b.tolist()))
    monkeypatch.setattr(phrases, "LEAST", 1)
    for dense in (1 << 40, 16, 0):
        monkeypatch.setattr(phrases, "DENSE", dense)
        halves = [phrases._parts({t: (c, n) for t, c, n in phrases.tiles(a[i::2], b[i::2])}, i) for i in (0, 1)]
        both = pa.Table.from_batches(batch for half in halves for batch in half)
        got = Counter()
        for tile in set(both["tile"].to_pylist()):
            fewer = phrases._fewer(both.filter(pa.compute.equal(both["tile"], tile)))
            for row in phrases._frequent(fewer).to_pylist():
                got[row["a"], row["b"]] += row["f"]
        assert got == want


def test_large_counts_keep_their_bytes(monkeypatch):
    tile, cell = int(phrases.block_of(np.array([7]))[0]) << 16, np.array([3, 9], np.int32)
    given = [phrases._parts({tile: (cell, np.array(n))}, 0) for n in ([2**40, 1], [5, 2**31 - 1])]
    (row,) = phrases._fewer(pa.Table.from_batches(b for g in given for b in g)).to_pylist()
    assert np.frombuffer(row["counts"], np.int64).tolist() == [2**40 + 5, 2**31]


def test_scores_of_counts_beyond_64_bits(spark):
    a, left, right = 3 * 10**15, 4 * 10**15, 9 * 10**15 + 1
    grams = spark.createDataFrame([("en", "x", [0], left), ("en", "y", [1], right), ("en", "x y", [0, 1], a)], "lang string, phrase string, parts array<long>, f long")
    (row,) = phrases.scored(grams).collect()
    assert row["score"] == 2000000 * a // (left + right)


def _audit(rows, least=30):
    pattern = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, documents = defaultdict(lambda: defaultdict(Counter)), defaultdict(Counter)
    for text, lang, source in rows:
        found = pattern.findall((text or "").translate(table))
        groups[lang or ""][source or ""].update(found)
        documents[lang or ""].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, c in documents[lang].items() if c >= least]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1000000000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, p = shares(sum(sources.values(), Counter())), {s: shares(c) for s, c in sources.items()}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            more = sorted((q[t] - p[s][t], t.encode()) for t in kept if sources[s][t] > 0 and p[s][t] > q[t])[:50]
            for part, found in (("pair", pairs), ("term", more)):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)}
    return out


def test_divergence_against_brute_force(spark, mixed):
    r = random.Random(6)
    # Many terms and sources, so that languages take several blocks and sources lack most terms.
    many = [(" ".join(f"w{chr(97 + r.randrange(26))}{chr(97 + r.randrange(1 + i % 26))}" for _ in range(80)), "de", f"s{i % 7}") for i in range(400)]
    rows = mixed + many + [("only here", "it", "lone")]
    want, given = _audit(rows), _table(spark, rows)
    assert {tuple(x) for x in divergence.op13_divergence(given).collect()} == want
    assert {tuple(x) for x in divergence.audit(given, block=16).collect()} == want
    assert divergence.op13_divergence(given.limit(0)).count() == 0
    assert any(x[0] == "no words" and x[4] == 0 for x in want)


def test_shares_of_counts_beyond_64_bits(spark):
    count, total, kept = 7 * 10**14, 9 * 10**15, 10**6
    (row,) = spark.sql(f"SELECT {count}L AS c, {total}L AS n, {kept}L AS v").select(divergence.share("c", "n", "v").alias("p")).collect()
    assert row["p"] == 1 + 1000000000 * (count + 5) // (total + 5 * kept)


def test_quality_of_held_out_documents(spark, docs, labels):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = quality.op11_quality(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    held = got.merge(labels.toPandas(), on="doc_id").query("held_out")
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert len(bad) >= 10 and (good.predicted == 1).mean() >= 0.97 and (bad.predicted == 0).mean() >= 0.85


def test_quality_learns_nothing_from_held_out_rows(spark, docs, labels):
    held = docs.filter(quality.held_out()).select("doc_id")
    assert 0 < held.count() < docs.count()
    turned = labels.join(held.withColumn("held", held.doc_id), "doc_id", "left").selectExpr("doc_id", "IF(held IS NULL, quality, 1 - quality) AS quality")
    scores = lambda given: {r["doc_id"]: r["score"] for r in quality.op11_quality(docs, given).collect()}
    assert scores(labels) == scores(turned)


def test_quality_odd_rows(spark, labels):
    rows = [("", "en", "s"), (None, "en", "s"), ("word " * 30_000, None, None), ("w" * 200_000, "en", "s"), ("a\ud800b".encode("utf-8", "replace").decode(), "en", "s"), ("Same.", "en", "a"), ("Same.", "fr", "b")]
    given = _table(spark, rows)
    marks = spark.createDataFrame([(0, 1), (1, None), (2, 0), (2, 0), (3, 1), (None, 0), (4, 0), (5, 1)], "doc_id long, quality int")
    for used in (marks, marks.filter("quality = 1"), marks.limit(0)):
        got = {r["doc_id"]: r["score"] for r in quality.op11_quality(given, used).collect()}
        assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values()) and got[0] == got[1] and got[5] == got[6]
    assert set(got.values()) == {0.5}
    assert quality.op11_quality(given.limit(0), marks).count() == 0


def test_kinds_of_a_text():
    assert quality.kinds(b"The CAT sat sat sat 123 ***") == b"Aa A a = = 0 ***"
    assert quality.kinds("éà É".encode()) == b"a a" and len(quality.kinds(b"ab" * 500_000)) == 1


def test_blocks_of_sources():
    """One source without entries, one with all, one of a single term."""
    table = pa.table({"lang": ["x"] * 6, "place": [1, 2, 3, 2, 2, 3], "number": [-1, -1, -1, 4, 5, 4], "p": [10, 20, 30, 25, 50, 5]})
    got = {(r["a"], r["b"]): r["value"] for r in divergence.apart(table).to_pylist()}
    assert got == {(1, 2): 15 + 40, (1, 3): 5 + 20, (2, 3): 20 + 20}
