"""Neighbours, near-duplicates of vectors and of documents, components, and the pipeline."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glyphflow.llm import embedding_dedup, near_duplicates, nearest_neighbours, quality, secrets
from glyphflow.llm.common import materialise
from glyphflow.llm.components import connected_components
from glyphflow.llm.hyperminhash import band_keys, bands_for, estimate, registers

from ..conftest import DATA
from .conftest import documents


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(k, k + 1) for k in range(500, 560)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    groups = Groups()
    for a, b in edges:
        groups.join(a, b)
    got = {r["id"]: r["component"] for r in connected_components(df).collect()}
    assert got == {x: groups.find(x) for e in edges if e[0] != e[1] for x in e}
    assert connected_components(df.where("a < 0")).count() == 0


# ---- documents -----------------------------------------------------------------------------------------------


def shingles(text, words):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[i : i + words]) for i in range(len(own) - words + 1)} if len(own) >= words else ({tuple(own)} if own else set())


def brute_groups(rows, words, over, under):
    sets, groups = {i: shingles(t, words) for i, t in rows if i is not None}, Groups()
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and under * len(sets[a] & sets[b]) >= over * len(sets[a] | sets[b]):
                groups.join(a, b)
    return sets, groups


def near_copies(seed=0):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for size, copies, changes in ((12, 4, 1), (40, 30, 2), (150, 60, 4), (600, 6, 20), (9, 5, 0)):
        base = rng.integers(0, 500, size)
        for _ in range(copies):
            own = base.copy()
            own[rng.integers(0, size, rng.integers(0, changes + 1))] = rng.integers(0, 500)
            rows.append((n, " ".join(f"w{x}" for x in own)))
            n += 1
    return rows


@pytest.mark.parametrize(("words", "over", "block"), [(3, 85, 512), (5, 80, 512), (3, 85, 8)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, words, over, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    monkeypatch.setattr(near_duplicates, "MOST", 20 if block == 8 else 500_000)
    rows = [*near_copies(), (900, ""), (901, None), (902, "One"), (903, "one"), (904, "A b"), (905, "a\tB"), (906, " \n")]
    sets, groups = brute_groups(rows, words, over, 100)
    found = near_duplicates.near_duplicates(documents(spark, [*rows, (5, rows[5][1]), (None, rows[0][1])]), words, over, 100).collect()
    assert len(found) == len(rows) + 2
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        want = groups.find(r["doc_id"])
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want, want == r["doc_id"])


@pytest.mark.parametrize("block", [4, 1024])
def test_near_copies_led_by_unlike_documents(spark, monkeypatch, block):
    """Short copies that meet each other only through lines that unlike documents of smaller id hold, too."""
    monkeypatch.setattr(near_duplicates, "KEY_BLOCK", block)
    copies = [(1000 + 2 * i + k, " ".join([*(f"line{i}w{w}" for w in range(20)), *["end"] * k])) for i in range(10) for k in (0, 1)]
    # One unlike document per shingle of five words of a pair, with that shingle only.
    unlike = []
    for _, text in copies[::2]:
        words = text.split()
        for k in range(len(words) - 4):
            own = len(unlike)
            unlike.append((own, " ".join([*(f"o{own}x{m}" for m in range(30)), *words[k : k + 5], *(f"p{own}x{m}" for m in range(2))])))
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(documents(spark, [*unlike, *copies])).collect()}
    assert all(found[k] == k for k, _ in unlike)
    assert [found[1000 + n] for n in range(len(copies))] == [1000 + n - n % 2 for n in range(len(copies))]


def test_keys_with_rejected_members_join_all_alike():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(1, 1 << 63, 60, dtype=np.uint64)) for _ in range(3)]
    sets = [base[0], base[1], base[2], np.unique(np.append(base[1][2:], np.uint64(7))), np.unique(np.append(base[2][2:], np.uint64(9)))]
    n = np.array([len(x) for x in sets])
    regs = registers(np.concatenate(sets), n, 205)
    one = np.zeros((1, 5), int)
    assert sorted(near_duplicates.coarse_links(one, np.arange(5), np.full(5, -1), n, regs, 0.8)) == [(1, 3), (2, 4)]
    assert sorted(near_duplicates.coarse_links(one, np.arange(5), np.array([0, 0, 0, 1, 1]), n, regs, 0.8)) == [(1, 3), (2, 4)]
    assert near_duplicates.coarse_links(np.array([[0, 0, 0, 1, 1]]), np.arange(5), np.full(5, -1), n, regs, 0.8) == []


def test_near_duplicates_edges(spark, odd, nothing):
    assert near_duplicates.near_duplicates(odd).count() == odd.count()
    assert near_duplicates.near_duplicates(nothing).count() == 0
    kept = near_duplicates.keep_one(odd)
    assert kept.columns == odd.columns
    rows = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    for row, n in rows.items():
        assert n == (1 if shingles(row[1], 5) and row[0] is not None else sum((r["doc_id"], r["text"]) == row for r in odd.collect()))
    assert any(k is None for k, _ in rows)


def test_keep_one_judges_rows(spark):
    """Rows that repeat a key with other texts are judged each by their own; of equal rows one stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (5, b + " x"), (6, c), (6, c), (7, ""), (7, ""), (None, a), (None, a)]
    for given in (rows, rows[::-1]):
        kept = Counter((r["doc_id"], r["text"]) for r in near_duplicates.keep_one(documents(spark, given)).collect())
        b_rows = {k: n for k, n in kept.items() if k[0] == 5}
        assert sum(b_rows.values()) == 1 and next(iter(b_rows))[1].startswith(b)
        assert {k: n for k, n in kept.items() if k[0] != 5} == {(1, a): 1, (6, c): 1, (7, ""): 2, (None, a): 2}
    found = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates.near_duplicates(documents(spark, rows)).collect())
    assert found == Counter({(1, 1, True): 1, (5, 1, False): 1, (5, 5, True): 2, (6, 6, True): 2, (7, 7, True): 2, (None, None, True): 2})


def test_sketches():
    rng = np.random.default_rng(0)
    m = 5 * bands_for(0.85)
    for n in (40, 300, 5000):
        for share in (0.0, 0.5, 0.85):
            common = int(round(2 * n * share / (1 + share)))
            pool = rng.integers(0, 2**63, 2 * n - common, dtype=np.uint64)
            a, b = np.sort(pool[:n]), np.sort(pool[n - common :])
            regs = registers(np.concatenate([a, b]), np.array([len(a), len(b)]), m)
            got = estimate(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]))[0]
            assert abs(got - common / (2 * n - common)) < 0.2
    assert (band_keys(np.full((1, m), 0xFFFF, np.uint16)) == 0).all()


# ---- vectors -------------------------------------------------------------------------------------------------


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1):
        base = rng.standard_normal((40, 16))
        for k in range(240):
            v = base[k % 40] + rng.standard_normal(16) * (0.05 if k % 3 else 0.35)
            rows.append((len(rows), v.astype(np.float32).tolist(), label))
    rows += [(len(rows) + k, rows[3][1], 0) for k in range(3)]  # exact copies
    n = len(rows)
    bad = [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [1.0, None, *[0.0] * 14], 1), (n + 4, [1.0] * 7, 1), (n + 5, rows[0][1], None), (n + 6, [float("inf")] * 16, 1), (n + 7, [], 1)]
    return rows, bad


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("block", [2048, 32])
def test_vector_links_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows, bad = vectors()
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    groups = Groups()
    for a, b in zip(*np.nonzero(linked), strict=True):
        groups.join(int(a), int(b))
    df = spark.createDataFrame([*rows, *bad, (None, rows[0][1], 0)], VECTORS).withColumns({c: F.lit("own") for c in ("id", "k", "v", "h", "home", "weight", "n", "c", "salt")})
    found = {r["vec_id"]: r for r in embedding_dedup.embedding_near_duplicates(df).collect()}
    assert len(found) == len(rows) + len(bad) + 1
    assert tuple(found.pop(None)) == (None, 0, None, True)
    for i in range(len(rows)):
        want = groups.find(i)
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (linked[i].sum(), want, want == i)
    assert all(found[b[0]]["n_links"] == 0 and found[b[0]]["kept"] for b in bad)
    assert embedding_dedup.embedding_near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    assert embedding_dedup.embedding_near_duplicates(spark.createDataFrame(bad, VECTORS)).where("n_links > 0").count() == 0


def test_rows_that_repeat_a_key_are_judged_by_their_vectors(spark):
    a, b, c = [1.0] * 8, [1.0] * 7 + [0.9], [1.0, -1.0] * 4
    rows = [(5, a, 0), (5, c, 0), (6, c, 0), (7, b, 0), (7, b, 0), (4, b, 1)]
    found = Counter(tuple(r) for r in embedding_dedup.embedding_near_duplicates(spark.createDataFrame(rows, VECTORS)).collect())
    assert found == Counter({(5, 2, 5, True): 1, (5, 1, 5, True): 1, (6, 1, 5, False): 1, (7, 2, 5, False): 2, (4, 0, 4, True): 1})


def test_probes_spare_lists_and_lose_no_noise():
    """Near copies by noise in 64 dimensions: all are met, and half the lists are not probed."""
    rng = np.random.default_rng(10)
    x = embedding_dedup._unit(rng.standard_normal((20_000, 64)))
    noise = embedding_dedup._unit(rng.standard_normal((20_000, 64)))
    noise = embedding_dedup._unit(noise - (noise * x).sum(axis=1)[:, None] * x)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * noise
    for exact in (False, True):
        q = embedding_dedup.Quantiser.fit(x[:8000], 128, 0.93, exact)
        homes = [embedding_dedup.nearest(v, q.centres) for v in (x, y)]
        probed = [q.probes(v, home) for v, home in zip((x, y), homes, strict=True)]
        # The one with the larger list probes the other's.
        met = np.where(homes[0] >= homes[1], probed[0][np.arange(len(x)), homes[1]], probed[1][np.arange(len(x)), homes[0]])
        share = probed[0].sum() / (homes[0] + 1).sum()
        assert met.all() and share < (0.75 if not exact else 1.01), share


@pytest.mark.parametrize("block", [1 << 22, 1600, 900])
def test_neighbours(spark, monkeypatch, block):
    """In one cell, in several, and in cells of several blocks (which equal vectors' shares make)."""
    monkeypatch.setattr(nearest_neighbours, "BLOCK", block)
    monkeypatch.setattr(nearest_neighbours, "FINEST", 16)
    monkeypatch.setattr(nearest_neighbours, "LEAF", 16)
    rows, bad = vectors()
    df = spark.createDataFrame([*rows, *bad, (None, rows[0][1], 0)], VECTORS).withColumns({c: F.lit("own") for c in ("id", "v", "h", "ids", "cell", "q", "score", "rank", "query_id")})
    found: dict = {}
    got = nearest_neighbours.nearest_neighbours(df, df.where("vec_id % 10 = 0 or vec_id is null"))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    usable = [*rows, (bad[5][0], bad[5][1])]  # a null label doesn't matter here
    ids = np.array([r[0] for r in usable])
    x = np.array([r[1] for r in usable], np.float32).astype(float)
    hits = total = 0
    for i in np.flatnonzero(ids % 10 == 0):
        score = np.einsum("ij,j->i", x, x[i]) / np.sqrt(np.einsum("ij,ij->i", x, x) * (x[i] @ x[i]))
        score[i] = -9
        best = ids[np.lexsort((ids, -np.round(score, 12)))[:5]].tolist()
        got = found[int(ids[i])]
        assert [g[0] for g in got] == [1, 2, 3, 4, 5] and sorted((-g[2], g[1]) for g in got) == [(-g[2], g[1]) for g in got]
        assert all(abs(g[2] - score[np.flatnonzero(ids == g[1])[0]]) < 1e-12 for g in got)
        hits += len(set(best) & {g[1] for g in got})
        total += 5
    assert len(found) == (ids % 10 == 0).sum() and hits / total >= 0.9
    few = spark.createDataFrame(rows[:3], VECTORS)
    assert nearest_neighbours.nearest_neighbours(few, few.where("vec_id = 0")).count() == 2
    assert nearest_neighbours.nearest_neighbours(few.where("false"), few).count() == 0


def test_neighbours_among_equal_vectors_and_keys(spark):
    """Equal vectors go by key, however many there are; equal rows count once, and a query's own key never."""
    same, other = [1.0] * 8, [1.0] * 7 + [0.5]
    rows = [(i, same, 0) for i in range(400)] + [(7, same, 0), (500, other, 0), (500, other, 0), (501, other, 0)]
    df = spark.createDataFrame(rows, VECTORS)
    found: dict = {}
    for r in nearest_neighbours.nearest_neighbours(df, df.where("vec_id in (2, 7, 300, 500)")).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == {2: [0, 1, 3, 4, 5], 7: [0, 1, 2, 3, 4], 300: [0, 1, 2, 3, 4], 500: [501, 0, 1, 2, 3]}


def test_the_stop_spares_most_vectors():
    """In 64 dimensions without any structure, the hardest case: recall, and the share of vectors that are verified."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((30_000, 64))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    directions = rng.standard_normal((64, nearest_neighbours.PROJECTED))
    index = nearest_neighbours.Index(np.arange(len(x))[:, None], x, directions)
    most = nearest_neighbours.chi_square_quantile(nearest_neighbours.CONFIDENCE, nearest_neighbours.PROJECTED)
    hits = verified = 0
    for q in range(0, 30_000, 600):
        ids, _, n = index.search(x[q], 6, most)
        hits += len(set(ids[1:].tolist()) & set(np.argsort(-(unit @ unit[q]), kind="stable")[1:6].tolist()))
        verified += n
    assert hits / 250 >= 0.9 and verified / 50 / 30_000 < 0.35


def test_recall_of_the_query(spark, duck):
    """The contract query against exact SQL on a driver's table: same columns, scores to 1e-9, recall of 0.9 or more."""
    from glyphflow.llm import queries, sql

    got = queries.op1_nearest_neighbours(spark, DATA).toPandas()
    want = duck.sql(sql.nearest_neighbours(5, 50)).df()
    assert sorted(got) == sorted(want) and got[["query_id", "rank"]].drop_duplicates().shape == got[["query_id", "rank"]].shape
    both = got.merge(want, on=["query_id", "vec_id"])
    assert len(got) == len(want) and len(both) / len(want) >= 0.9
    assert (both["score_x"] - both["score_y"]).abs().max() < 1e-9


def test_cells_and_trees():
    rng = np.random.default_rng(9)
    points = rng.standard_normal((3000, nearest_neighbours.PROJECTED))
    cells = nearest_neighbours.Cells(points, 7)
    home, far = cells.home(points), cells.distances(points)
    assert len(cells) == 7 and set(home.tolist()) == set(range(7)) and (far[np.arange(3000), home] == 0).all()
    for c in range(7):  # a region's distance is never above that of a point in it
        own = points[home == c]
        assert (far[:50, c] <= ((points[:50, None] - own[None]) ** 2).sum(axis=2).min(axis=1) + 1e-9).all()
    tree = nearest_neighbours.Tree(points)
    d = ((points - points[0]) ** 2).sum(axis=1)
    last, seen = -1.0, []
    for rows, near, frontier in tree.nearer(points[0]):
        assert np.allclose(near, d[rows]) and near.min() >= last - 1e-9 and near.max() <= frontier
        last = near.max()
        seen += rows.tolist()
    assert sorted(seen) == list(range(3000))
    assert len(nearest_neighbours.Cells(np.ones((50, nearest_neighbours.PROJECTED)), 4)) == 1


def test_chi_square():
    q = nearest_neighbours.chi_square_quantile(0.95, 8)
    assert abs(q - 15.507) < 0.01


# ---- pipeline and queries --------------------------------------------------------------------------------------


def redacted(text):
    """Every match of every rule replaced by a mark, overlapping ones by one."""
    found = sorted((m.start(), m.end()) for r in secrets.REDACTED for m in re.finditer(r.pattern, text or "") if len(m[r.group]) >= r.least)
    out, at = [], 0
    for a, b in found:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return text if text is None else "".join([*out, text[at:]])


def pieces_by_library(docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in docs:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[r["doc_id"], piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    return want


def check_stages(spark, docs, sf_dir):
    """Each stage, on all that the one before kept, against brute force."""
    import corpus_pipeline as p

    want = docs.columns
    for name, stage in p.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == want, name
        docs = materialise(docs)
        rows = docs.collect()
        if name == "quality":
            report = quality.quality_report(spark.createDataFrame(before, docs.schema), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
            kept = Counter((r["doc_id"], r["lang"]) for r in report if r["threshold"] is None or not r["smoothed"] > r["threshold"] or r["perplexity"] is None)
            assert Counter((r["doc_id"], r["lang"]) for r in rows) == kept
        elif name == "near_duplicates":
            usable = [(i, (r["doc_id"], r["text"])) for i, r in enumerate(before) if r["doc_id"] is not None and shingles(r["text"], 5)]
            sets, groups = {i: shingles(t, 5) for i, (_, t) in usable}, Groups()
            for a in sets:
                for b in sets:
                    if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        groups.join(a, b)
            members = {}
            for i, (k, _) in usable:
                members.setdefault(groups.find(i), []).append(k)
            alone = Counter((r["doc_id"], r["text"]) for r in before if r["doc_id"] is None or not shingles(r["text"], 5))
            found = Counter((r["doc_id"], r["text"]) for r in rows)
            assert all(found[x] == n for x, n in alone.items())
            assert Counter({k: n for k, n in Counter(k for (k, t), n in found.items() for _ in range(n) if (k, t) not in alone).items()}) == Counter(min(m) for m in members.values())
        else:
            assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], redacted(r["text"])) for r in before)
            assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else r["n_chars"]) for r in rows)
    packed = p.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == pieces_by_library(docs.collect())
    places: dict = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["ids_crc32"]) for r in p.run(spark, sf_dir).collect()) == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["ids_crc32"]) for r in packed)
    return docs


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert 0 < check_stages(spark, docs, DATA).count() < docs.count()


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, repeated rows and keys, empty texts, no labels, and no documents at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    key = "token=abcdef12345 and " + " ".join(f"w{i}" for i in range(30))
    rows = [(1, key, "en", "s", len(key)), (1, key, "en", "s", len(key)), (1, "other words entirely here now", None, None, None), (None, key, "en", "s", 5), (2, None, "en", "s", None), (2, None, "en", "s", None), (3, "", "", "", 0), (4, " \n ", "de", "s", 3), (None, None, None, None, None)]
    for name, own in (("some", rows), ("none", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(own, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        docs = check_stages(spark, spark.read.parquet(f"{at}/documents.parquet"), at)
        assert docs.count() == (len(rows) - 1 if own else 0)


def test_helpers_of_pipeline_stages():
    assert redacted("a token=abcdef1 b") == "a [SECRET] b" and redacted(None) is None


def test_queries_with_sql(spark, duck):
    from glyphflow.llm.queries import QUERIES, SQL

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    for name, sql in SQL.items():
        a, b = QUERIES[name](spark, DATA).toPandas(), duck.sql(sql).df()
        columns = sorted(a.columns)
        assert sorted(map(tuple, a[columns].astype(str).values.tolist())) == sorted(map(tuple, b[columns].astype(str).values.tolist())), name
