"""Near-duplicate documents and vectors, and line dedup, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import connection, same_rows
from vecmill.llm import components as C
from vecmill.llm import embed_dedup as E
from vecmill.llm import jaccard_join as J
from vecmill.llm import queries as Q
from vecmill.llm.components import connected_components
from vecmill.llm.line_dedup import drop_boilerplate

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def brute_components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def shingle_set(text, width):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(lower))
    k = min(width, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def brute_jaccard(rows, width, num, den):
    sets = {i: shingle_set(t, width) for i, t in rows}
    ids = sorted(sets)
    links = []
    for n, a in enumerate(ids):
        for b in ids[:n]:
            same = len(sets[a] & sets[b])
            if same and den * same >= num * len(sets[a] | sets[b]):
                links.append((a, b))
    found = brute_components(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


def near_copies(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            base = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 3)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(words)
            text = " ".join(base)
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 30, 60, 200])))
        rows.append((i, rng.choice([text, text.upper()])))
    return rows


@pytest.mark.parametrize(("width", "num", "den"), [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_jaccard_against_brute_force(spark, width, num, den):
    rows = near_copies(width)
    found = J.jaccard_components(spark.createDataFrame(rows, DOCS), width, num, den).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_jaccard(rows, width, num, den)


@pytest.mark.parametrize("limit", ["order", "sketch"])
def test_jaccard_does_not_rest_on_its_tables(spark, limit, monkeypatch):
    """Full filters and missing counts change the work, not the result."""
    if limit == "order":
        monkeypatch.setattr(J, "SHARED_BITS", 6)
        monkeypatch.setattr(J, "BLOCK", 50)
        monkeypatch.setattr(J, "REPORTED", 1)
    rows = near_copies(9)
    if limit == "sketch":
        rows = [(i, " ".join([t] + [f"{t[:3]}{k}" for k in range(3000)])) for i, t in rows[:30]]
    found = J.jaccard_components(spark.createDataFrame(rows, DOCS), 3, 9, 10).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_jaccard(rows, 3, 9, 10)


def test_jaccard_links_members_that_are_no_heads(spark):
    """1 and 2 share prefix and size but not their frequent words; 3 is a copy of 2 and unlike 1."""
    rare, one, two = ([f"{c}{i}" for i in range(n)] for c, n in (("r", 60), ("f", 140), ("g", 140)))
    rows = [(1, " ".join(rare + one)), (2, " ".join(rare + two)), (3, " ".join(["x", "y", "z"] + rare[3:] + two))]
    rows += [(10 + i, " ".join((one if i % 2 else two) + [f"u{i}x{k}" for k in range(200)])) for i in range(40)]
    expected = brute_jaccard(rows, 1, 4, 5)
    assert expected[3][1] == 2 and expected[2][1] == 2 and expected[1][1] == 1
    found = J.jaccard_components(spark.createDataFrame(rows, DOCS), 1, 4, 5).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected


def test_jaccard_on_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = Q.op3_jaccard_join(spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_jaccard(rows, 3, 9, 10)


def test_jaccard_edges(spark):
    long = " ".join(f"x{i}" for i in range(400_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (None, "a b"), (6, long), (7, long + " y"), (8, "a b"), (8, "c d"), (9, "c d"), (4, "a b")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{DOCS}, component_id string, n long")
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df, 3, 9, 10).collect()), key=repr)
    # Both texts of document 8 are versions of one document, so 4, 5, 8 and 9 belong together.
    assert found == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4), (8, 1, 4), (8, 1, 4), (9, 1, 4), (None, 1, None), (6, 399_998, 6), (7, 399_999, 6)], key=repr)
    assert J.jaccard_components(df.limit(0), 3, 9, 10).count() == 0


def test_jaccard_makes_no_rows_of_the_pairs_of_a_family(spark, monkeypatch):
    """2000 texts, each a copy of the one before with one word changed: the rows that are made grow with the links, not with all pairs."""
    rng = random.Random(6)
    words = [f"a{k}" for k in range(60)]
    rows = []
    for i in range(2000):
        words[rng.randrange(60)] = f"b{i}"
        rows.append((i, " ".join(words)))
    made = {}
    write = J.materialize

    def counted(df, name):
        out = write(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(J, "materialize", counted)
    monkeypatch.setattr(J, "CELL", 64)  # lists are divided among cells
    found = J.jaccard_components(spark.createDataFrame(rows, DOCS), 1, 9, 10).collect()
    assert {r["component_id"] for r in found} == {0}
    assert max(made["pairs"], made["verified"], made["screened"]) < 10 * len(rows)


def test_rows_of_one_id_with_unlike_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(8, a, 1), (8, b, 2), (9, b + " x", 3), (7, a + " y", 4), (5, c, 5), (5, c, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long")
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df, 3, 9, 10).collect())
    assert found == [(5, 28, 5), (5, 28, 5), (7, 29, 7), (8, 28, 7), (8, 28, 7), (9, 29, 7)]
    # Without their common id the texts of 8 are two documents.
    kept = sorted((r["doc_id"], r["text"]) for r in J.keep_one(df, 3, 9, 10).collect())
    assert kept == sorted([(7, a + " y"), (8, b), (5, c)])


def test_one_of_each_group_stays(spark):
    rows = near_copies(4)
    df = spark.createDataFrame([(*r, "s") for r in rows], f"{DOCS}, class_id string")
    expected = {i for i, (_, c) in brute_jaccard(rows, 5, 4, 5).items() if i == c}
    kept = J.keep_one(df.union(df))
    assert kept.columns == df.columns
    counts = {r["doc_id"]: r["count"] for r in kept.groupBy("doc_id").count().collect()}
    assert set(counts) == expected
    assert all(n == 1 for i, n in counts.items() if dict(rows)[i].strip())
    none = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, None)], DOCS)
    assert J.keep_one(none).count() == 4


def test_components(spark):
    rng = random.Random(0)
    links = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(500, i) for i in range(501, 600)] + [(7, 7), (None, 1)]
    found = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    real = [x for x in links if None not in x and x[0] != x[1]]
    assert {r["id"]: r["component_id"] for r in found} == brute_components({i for x in real for i in x}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_links_take_no_rounds(spark, monkeypatch):
    """A chain of 2000 is joined by one task; with a lower bound rounds contract first, to the same result."""
    written, write = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, name: (written.append(name), write(df, name))[1])
    links = [(i, i + 1) for i in range(2000)] + [(5000 + i, 5000 + i * 7 % 100) for i in range(100)]
    df = spark.createDataFrame([links[i * 37 % 2100] for i in range(2100)], "a long, b long")
    real = [x for x in links if x[0] != x[1]]
    expected = brute_components({i for x in real for i in x}, real)
    assert {r["id"]: r["component_id"] for r in connected_components(df).collect()} == expected
    assert len(written) <= 3
    monkeypatch.setattr(C, "FEW", 500)
    assert {r["id"]: r["component_id"] for r in connected_components(df).collect()} == expected
    assert len(written) > 6


def test_counting_a_block_of_shingles_holds_little_more_than_the_block():
    import tracemalloc

    rng = np.random.default_rng(0)
    tracemalloc.start()
    block = [np.unique(rng.integers(0, 1 << 40, 300).astype(np.uint64)) for _ in range(4000)]
    block += [block[0]] * 4
    pool = [x[:75] for x in block]
    values, n = np.unique(np.concatenate(block), return_counts=True)
    keep = (n >= J.REPORTED) | np.isin(values, np.concatenate(pool))
    expected = dict(zip(values[keep].view(np.int64).tolist(), n[keep].tolist(), strict=True)) | {None: 7}
    size = sum(map(len, block)) * 8
    del values, n, keep
    before = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    found = J._report(block, pool, 7)
    assert tracemalloc.get_traced_memory()[1] - before < 3.5 * size
    tracemalloc.stop()
    assert dict(zip(found["h"].to_pylist(), found["n"].to_pylist(), strict=True)) == expected
    assert J._report([], [], 0).to_pylist() == [{"h": None, "n": 0}]


def brute_vectors(rows):
    def usable(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v, dtype=np.float64), label) for i, v, label in rows if usable(v, label)]
    links = [(a[0], b[0]) for n, a in enumerate(good) for b in good[:n] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / (np.linalg.norm(a[1]) * np.linalg.norm(b[1])) >= 0.98]
    found = brute_components([r[0] for r in rows], links)
    return {r[0]: (sum(r[0] in x for x in links), found[r[0]], found[r[0]] == r[0]) for r in rows}


VECTORS = "vec_id long, embedding array<float>, label int, n string, class_id long"


def test_vectors_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((6, 64))
    rows = [(i, (centres[i % 6] + rng.standard_normal(64) * rng.choice([0.0, 0.02, 0.1, 0.2])).astype(np.float32).tolist(), int(rng.integers(2)), "x", 1) for i in range(300)]
    rows += [(300, None, 0, "x", 1), (301, [0.0] * 64, 0, "x", 1), (302, [None] * 64, 0, "x", 1), (303, [float("nan")] * 64, 0, "x", 1), (304, [float("inf")] * 64, 0, "x", 1), (305, rows[0][1], None, "x", 1), (306, rows[0][1][:3], 0, "x", 1), (307, [], 0, "x", 1), (308, [2 * x for x in rows[0][1]], rows[0][2], "x", 1)]
    df = spark.createDataFrame(rows, VECTORS)
    expected = brute_vectors([r[:3] for r in rows])
    for block in (512, 16):  # with small blocks, buckets are divided among tasks
        monkeypatch.setattr(E, "BLOCK", block)
        found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(df).collect()}
        assert found == expected
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_extreme_magnitudes(spark):
    rows = [(1, [1e-200, 0.0], 1), (2, [1e-200, 1e-202], 1), (3, [1e200, 1.01e200], 1), (4, [1.0, 1.0], 1), (5, [1e308, 1e308], 1), (6, [5e-324, 0.0], 1), (7, [-1e200, 0.0], 1)]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 6: (2, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3), 7: (0, 7)}


def test_repeated_vectors(spark):
    rows = [(1, [1.0, 0.0], 1, "", 0), (1, [1.0, 0.0], 1, "", 0), (None, [1.0, 0.0], 1, "", 0), (2, [1.0, 0.01], 1, "", 0)]
    found = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in E.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()), key=repr)
    assert found == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 0, None)]


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((2000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.98 * a + np.sqrt(1 - 0.98**2) * b
    assert (E.bucket_keys(a) == E.bucket_keys(near)).any(axis=1).mean() > 0.999


def test_embeddings_query(spark):
    same_rows(Q.op2_embedding_dedup(spark, SF).toPandas(), connection(SF).execute(Q.oracle_sql()["op2_embedding_dedup"]).df())


def test_lines(spark):
    rows = [(i, f"menu \nline {i}\n\nmenu" if i < 6 else f"only {i}", "h") for i in range(10)] + [(10, None, "h"), (11, "", "h"), (12, "menu", None), (13, "menu", "g")]
    df = spark.createDataFrame([(*r, "k", "d") for r in rows], "doc_id long, text string, source string, kept string, drop string")
    found = {r["doc_id"]: r for r in drop_boilerplate(df, ratio=0.4, min_pages=3).collect()}
    assert (found[0]["text"], found[0]["n_lines"], found[0]["n_dropped"], found[0]["drop"]) == ("line 0\n", 4, 2, "d")
    assert found[7]["text"] == "only 7" and (found[10]["text"], found[10]["n_lines"]) == (None, 0) and (found[11]["text"], found[11]["n_lines"]) == ("", 1)
    assert found[12]["text"] == "menu" and found[13]["text"] == "menu"
    assert drop_boilerplate(df, ratio=0.4, min_pages=3, counts=False).columns == df.columns
    assert drop_boilerplate(df.limit(0)).count() == 0


def test_copied_pages_keep_their_lines(spark):
    rows = [(i, "a copied text\nof two lines", "h") for i in range(50)] + [(100 + i, f"menu\npage {i}", "h") for i in range(21)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r["text"] for r in drop_boilerplate(df, copies_once=True).collect()}
    assert found[3] == "a copied text\nof two lines" and found[103] == "page 3"
    # Else each row is a page of its host.
    found = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in drop_boilerplate(df).collect()}
    assert found[3] == ("", 2) and found[103] == ("page 3", 1)


def test_the_ratio_decides_on_hosts_of_all_sizes(spark):
    rows = [(100 * n + i, f"menu\npage {i}" if i < m else f"page {i}", f"h{n}") for n, m in ((4, 2), (7, 3), (60, 3), (61, 4), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r["text"] for r in drop_boilerplate(df, min_pages=2).collect()}
    menu = {n: "menu" in found[100 * n] for n in (4, 7, 60, 61, 3)}
    # Three of sixty pages are a twentieth, which is not exceeded; a line on one page is none of its host's.
    assert menu == {4: False, 7: False, 60: True, 61: False, 3: True}
    assert "menu" not in "".join(r["text"] for r in drop_boilerplate(df.where("source = 'h3'")).collect())


def test_long_texts_keep_other_lines(spark):
    long = "\n".join(["menu", *[f"line {i}" for i in range(200_000)], "menu"])
    df = spark.createDataFrame([(1, long, "h"), (1, long, "h"), (2, "menu", "h")], "doc_id long, text string, source string")
    found = drop_boilerplate(df, ratio=0.9, min_pages=2).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in found) == [(1, 200_002, 2), (1, 200_002, 2), (2, 1, 1)]


def test_lines_on_all_documents(spark):
    large = "/root/testdata/sf0.01"
    found = Q.op8_line_dedup(spark, large).toPandas()
    assert found["n_dropped"].sum() > 0
    same_rows(found, connection(large).execute(Q.oracle_sql()["op8_line_dedup"]).df())


def test_lines_broadcast_limit(spark, monkeypatch):
    import vecmill.llm.line_dedup as L

    monkeypatch.setattr(L, "BROADCAST_LINES", 0)
    df = spark.createDataFrame([(i, f"menu\nx{i}", "h") for i in range(9)], "doc_id long, text string, source string")
    assert {r["text"] for r in drop_boilerplate(df, min_pages=2).select(F.col("text")).collect()} == {f"x{i}" for i in range(9)}
