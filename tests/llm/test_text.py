"""BPE, packing, licenses, chat templates, language ID, URL filter and search."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.helpers import connection, same_rows
from vecmill.llm import bm25, bpe, chat, langid, licenses, packing, url_filter
from vecmill.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
PATH = Q.byte_vocabulary()
ALPHABETS = ["ab 'sr<|e\n\t\x1c\x85 é²٣Ⅷ́漢\U0001f600\U00010400_-.", "a ", "ab", "  \n'll re've", "<|endoftext|> a"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


def encode(vocabulary, text, chunk, window=None):
    e = bpe.Encoder(vocabulary)
    e.window = window or e.window
    return [t for i in range(0, len(text), chunk) for t in e.feed(text[i : i + chunk])] + e.close()


def random_texts(n, size):
    rng = random.Random(2)
    for _ in range(n):
        a = rng.choice(ALPHABETS)
        x = "".join(rng.choice(a) for _ in range(rng.randint(0, size)))
        yield x + "<|endoftext|>"[: rng.randint(1, 13)] + x if rng.random() < 0.3 else x


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_bpe_in_chunks(reference, vocabulary, chunk):
    for x in random_texts(400, 60):
        assert encode(vocabulary, x, chunk) == reference.encode(x, add_special_tokens=False).ids


def test_bpe_by_windows(reference, vocabulary):
    rng = random.Random(3)
    for a in ["ab", "theinr", "aeiousx", "=-_", "0123456789", "éèa", " ", "\n "]:
        x = "".join(rng.choice(a) for _ in range(4000))
        expected = reference.encode(x, add_special_tokens=False).ids
        for chunk in (50, 700, 100_000):
            assert encode(vocabulary, x, chunk, vocabulary.lookahead + 70) == expected


def test_lookahead_of_a_small_vocabulary():
    # (a b) waits for b's own merge with c, which waits for c's with d: ab 2, bc 1, cd 0.
    merges = {(2, 3): (0, 6), (1, 2): (1, 5), (0, 1): (2, 4)}
    assert bpe.sufficient_lookahead(merges, {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2}) == 3


def test_decoder_gives_text_as_it_becomes_whole(reference, vocabulary):
    for x in random_texts(300, 40):
        ids = reference.encode(x, add_special_tokens=False).ids
        d = bpe.Decoder(vocabulary)
        assert "".join(d.feed([i]) for i in ids) + d.close() == reference.decode(ids, skip_special_tokens=False)
    some = np.random.default_rng(0).integers(0, 50257, 500).tolist()
    d = bpe.Decoder(vocabulary)
    assert d.feed(some) + d.close() == reference.decode(some, skip_special_tokens=False)


def test_bpe_query_on_all_documents(spark, reference):
    found = {r["doc_id"]: r for r in Q.op6_bpe(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for i, text in rows:
        ids = reference.encode(text, add_special_tokens=False).ids
        assert found[i]["n_tokens"] == len(ids) and found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edges(spark, reference):
    long = "ab" * 200_000
    rows = [(1, None, "x"), (2, "", "x"), (None, "a", "x"), (3, long, "x"), (3, long, "x")]
    found = bpe.bpe_roundtrip(spark.createDataFrame(rows, f"{DOCS}, ids string"), PATH, with_values=True).collect()
    assert [r["n_tokens"] for r in found[:3]] == [0, 0, 1] and found[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert found[3]["ids"] == reference.encode(long, add_special_tokens=False).ids and found[3]["decoded"] == long
    assert bpe.bpe_roundtrip(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_fast_token_ids_are_those_of_the_library(reference):
    fast = packing.token_encoder(PATH)
    for x in random_texts(500, 60):
        assert fast(x).tolist() == reference.encode(x, add_special_tokens=False).ids


def check_packing(rows, texts, reference, window):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = [*reference.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            part = ids[at : at + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            if "ids" in p:
                assert p["ids"] == part
            at += p["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    total = sum(r["length"] for r in rows)
    return total / (len(by_sequence) * window)


def test_packing_query_on_all_documents(spark, reference):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check_packing([r.asDict() for r in Q.op10_packing(spark, SF).collect()], texts, reference, 2048) > 0.95


def test_packing_edges(spark, reference):
    rng = random.Random(1)
    texts = {i: None if i == 0 else "" if i == 1 else " ".join("abc"[rng.randrange(3)] * rng.randint(1, 3) for _ in range(rng.choice([1, 5, 40, 300]))) for i in range(200)}
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], f"{DOCS}, ids string, length long").repartition(5)
    packed = packing.pack_documents(df, PATH, window=64, open_windows=4, with_ids=True)
    assert check_packing([r.asDict() for r in packed.collect()], texts, reference, 64) > 0.9
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
    twice = packing.pack_documents(spark.createDataFrame([(None, "a"), (7, "b"), (7, "b")], DOCS), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in twice) == [(0, 2), (7, 2), (7, 2)]


def test_packing_holds_few_texts(spark, monkeypatch, tmp_path):
    """A task over many texts is handed a few at a time, whatever the session's batches; the setting is as it was afterwards."""

    def noting(run):
        def noted(batches):
            for batch in batches:
                if "text" in batch.schema.names:
                    with open(f"{tmp_path}/rows", "a") as f:
                        f.write(f"{batch.num_rows}\n")
                yield batch

        return lambda batches: run(noted(batches))

    monkeypatch.setattr(packing, "tidy", noting)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = packing.pack_documents(spark.range(3000).selectExpr("id AS doc_id", "repeat('word ', 100) AS text").coalesce(1), PATH).collect()
    assert {r["doc_id"] for r in rows} == set(range(3000)) and spark.conf.get(key) == before
    held = [int(x) for x in (tmp_path / "rows").read_text().split()]
    assert sum(held) == 3000 and max(held) <= 250


def test_packer_is_best_fit_in_bounded_space():
    p = packing.OnlinePacker(window=10, open_windows=2)
    add = lambda key, n: [(number, [x[0] for x in pieces]) for number, pieces in p.add(key, np.arange(n))]
    assert add("a", 6) == [] and add("b", 7) == [] and add("c", 3) == [(1, ["b", "c"])]
    assert add("d", 8) == [] and add("e", 5) == [(2, ["d"])] and len(p.content) == 2
    assert add("f", 25) == [(4, ["f"]), (5, ["f"]), (3, ["e", "f"])]


def brute_licenses(text, threshold=0.8):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    find = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().translate(lower))
    words, phrases, best, labels = find(text or ""), [], 0.0, set()
    for phrase, label in licenses.PHRASES.items():
        p = find(phrase)
        phrases += [(k, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    for label, t in licenses.TEMPLATES:
        own = find(t)
        for k in range(0, len(words), len(own)):
            share = len(set(words[k : k + 2 * len(own)]) & set(own)) / len(set(own))
            if share >= threshold - 1e-9:
                best, labels = max(best, share), labels | {label}
    places = [k for k, _ in phrases]
    base = {label for _, label in phrases}
    return (len(words), len(phrases), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if phrases else best)


def test_licenses_on_all_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in Q.op7_license_scan(spark, SF).collect()}
    assert found == {i: brute_licenses(t) for i, t in rows}


def test_license_edges(spark):
    filler = " ".join(f"w{i}" for i in range(300))
    bsd = next(words for label, words in licenses.TEMPLATES if label == "bsd")
    texts = [None, "", "MIT-License mit\nlicense", "mit licenses", f"{filler} {bsd} {filler}", bsd.replace("modification", "x").replace("conditions", "y"), "Permission is hereby granted", (filler + "\n") * 900 + "the apache license", "General  public\tLICENSE mit license", "licensed under CC BY-NC 4.0."]
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(None, "mit license", "x", 1.0)]
    df = spark.createDataFrame(rows, f"{DOCS}, labels string, score double")
    found = {r["doc_id"]: tuple(r)[1:] for r in licenses.license_digest(licenses.license_scan(df)).collect()}
    assert found == {r[0]: brute_licenses(r[1]) for r in rows}
    assert found[4][5] == "bsd" and found[9][5] == "cc-by-nc"
    twice = licenses.license_digest(licenses.license_scan(df.where("doc_id = 4").union(df.where("doc_id = 4")))).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_wrapped_licenses(spark):
    """A notice is found wherever its lines break, with or without comment signs, and not in scattered words."""
    filler = " ".join(f"w{i}" for i in range(300))
    rows, expected = [], {}
    for t, (label, notice) in enumerate(licenses.TEMPLATES):
        words = notice.split()
        for width in (1, 3, len(words) // 2 + 1):
            for sign in ("", " * ", "# "):
                body = "\n".join(sign + " ".join(words[i : i + width]) for i in range(0, len(words), width))
                expected[len(rows)] = label
                rows.append((len(rows), f"{filler}\n{body}\n{filler}" if width == 3 else body))
    scattered = "\n".join(f"{filler} {w}" for w in licenses.TEMPLATES[-1][1].split())
    rows.append((len(rows), scattered))
    found = {r["doc_id"]: r for r in licenses.license_digest(licenses.license_scan(spark.createDataFrame(rows, DOCS))).collect()}
    assert all(label in found[i]["labels"].split(",") and found[i]["score"] == 1.0 for i, label in expected.items())
    assert (found[len(rows) - 1]["labels"], found[len(rows) - 1]["score"]) == ("", 0.0)


def test_template_language():
    show = lambda source, **v: "".join(t for t, _ in chat.Template(source).render(**v))
    assert show("a{# no #}{{ 'b' + 'c' }}{{ 1 + 2 }}") == "abc3"
    assert show("{% for x in xs %}{% if x == 1 %}one{% elif x > 2 and not x == 3 %}many{% else %}{{ x }}{% endif %},{% endfor %}", xs=[1, 2, 3, 4]) == "one,2,3,many,"
    assert show("{% set y = x['k'] %}{{ y | upper }}{{ none }}", x={"k": "v"}) == "V"
    assert show("{{ '\\'' + \"\\n\" }}") == "'\n"
    assert list(chat.Template("a{% generation %}b{% endgeneration %}").render()) == [("a", False), ("b", True)]
    assert show("{{ 'a}}b' }}{% if '%}' == x %}c{% endif %}{{ \"{{\" }}{# don't #}", x="%}") == "a}}bc{{"
    for bad in ("{{ 1 | length }}", "{{ 'a' - 1 }}", "{{ 'a }}", "{% for x %}{% endfor %}", "{{ x.__class__() }}", "{{ x | open }}", "{% if x %}", "{% import os %}", "{{ 1 + }}", "{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)
    for reach in ("{{ x['a'] - 1 }}", "{{ x['a'] < 1 }}", "{{ x.__class__ }}", "{{ y }}", "{{ x['a'].b }}"):
        with pytest.raises(chat.TemplateError):
            show(reach, x={"a": "s"})


def test_constants_are_folded():
    t = chat.Template("a{{ 'b' | upper }}{% if 1 == 2 %}c{% elif true %}d{% else %}e{% endif %}{% if x or true %}f{% endif %}")
    assert t.tree[0] == ("text", "aBd") and len(t.tree) == 2


def test_conversations_read_back(spark):
    rng = random.Random(0)
    rows = [(c, t, rng.choice(["user", "assistant", "a\nb", "<|turn|>", None]), rng.choice([None, "", "x<|end|>\n[INST]\\", "\\l\\b\\n\\", "<|turn|>assistant\nno", "é" * 1000])) for c in range(20) for t in range(rng.randint(1, 9))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    expected = {}
    for c, _, role, text in sorted(rows, key=lambda r: r[:2]):
        expected.setdefault(c, []).append((role or "", text or ""))
    digests = {r["conv_id"]: r for r in chat.digest_conversations(df).collect()}
    for r in chat.format_conversations(df).collect():
        turns = expected[r["conv_id"]]
        assert [(a, b) for a, b, _ in chat.read_turns([(r["formatted"], False)])] == turns
        loss = "".join(b for a, b in turns if a == "assistant")
        assert "".join(chat.unescape(r["formatted"][s["start"] : s["stop"]]) for s in r["loss_spans"]) == loss
        d = digests[r["conv_id"]]
        assert (d["n_turns"], d["loss_chars"], d["formatted_chars"]) == (len(turns), len(loss), len(r["formatted"]))
        assert d["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert chat.digest_conversations(df.limit(0)).count() == 0
    none = spark.createDataFrame([(None, None, None, None), (None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert [r["n_turns"] for r in chat.digest_conversations(none).collect()] == [2]


@pytest.mark.parametrize("name", ["op3_jaccard_join", "op4_url_filter", "op5_bm25_topk", "op7_license_scan", "op9_chat_format"])
def test_query_matches_sql(spark, name):
    same_rows(Q.queries()[name](spark, SF).toPandas(), connection(SF).execute(Q.oracle_sql()[name]).df())


def test_url_edges(spark):
    urls = [None, "", "no address", "http://A.ORG/x", "https://example.org/es/1", "https://www.example.org/es", "http://xexample.org/es/1", "http://a.com/de/1?x", "http://a.com/fr/#y", "http://b.net", "ftp://b.net?q=://c/", "http://example.org/en/12", "http://é.com/de/ü", "http://" + "a" * 100_000]
    df = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(urls)] + [(None, "http://b.net", "x", 1.0), (3, "http://A.ORG/x", "x", 1.0)], "page_id long, url string, host string, score double")
    rows = url_filter.filter_urls(df).collect()
    found = {r["page_id"]: tuple(r)[1:5] for r in rows}
    assert len(rows) == 16
    assert found[0][:3] == ("", "", None) and found[2][:3] == ("", "", None) and found[0][3] == "allow"
    assert found[3] == ("a.org", "/x", "org/", "allow") and found[4][2:] == ("example.org/es/", "block") and found[5][2:] == ("org/", "allow")
    assert found[6][2:] == ("org/", "allow") and found[7] == ("a.com", "/de/1", "com/de/", "block") and found[8] == ("a.com", "/fr/", "com/fr/", "allow")
    assert found[9][:3] == ("b.net", "", None) and found[10][:3] == ("b.net", "", None) and found[11][2:] == ("example.org/en/1", "block")
    assert {r["verdict"] for r in url_filter.filter_urls(df, []).collect()} == {"allow"}
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_url_models_tell_sides_apart(spark):
    rng = random.Random(0)
    word = lambda a: "".join(rng.choice(a) for _ in range(12))
    rows = [(i, f"http://h{i}.{'com/fr' if i % 2 else 'com/de'}/{word('aeiou' if i % 2 else 'xyzqk')}") for i in range(200)]
    rows += [(1000 + i, f"http://h.net/{word('aeiou' if i % 2 else 'xyzqk')}") for i in range(100)]
    found = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert np.mean([found[1000 + i] == ("allow" if i % 2 else "block") for i in range(100)]) > 0.95


def brute_search(docs, queries, k):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    bag = lambda t: Counter(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(lower)))
    rows = [(i, bag(t)) for i, t in docs if i is not None and bag(t)]
    df = Counter(t for _, b in rows for t in b)
    mean = sum(sum(b.values()) for _, b in rows) / max(1, len(rows))
    out = []
    for q, text in queries:
        scores = []
        for i, b in rows:
            s = sum(n * np.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for t, n in bag(text).items() if t in b)
            if round(s, 6) > 0:
                scores.append((-round(s, 6), i))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_search_against_brute_force(spark, small, monkeypatch):
    if small:
        for name, value in (("SHARD_DOCS", 30), ("BLOCK", 4), ("FIRST", 2), ("QUERY_TERMS", 100), ("PACK_TERMS", 20), ("AHEAD", 3)):
            monkeypatch.setattr(bm25, name, value)
    rng = random.Random(5)
    words = [f"t{i}" for i in range(200)]
    docs = [(i, " ".join(rng.choice(words[: rng.choice([5, 50, 200])]) for _ in range(rng.choice([0, 1, 10, 60])))) for i in range(200)]
    docs += [(200, None), (None, "t1 t2"), (201, "t1"), (202, "T1"), (203, "t1 " * 100_000)]
    df = spark.createDataFrame([(*d, "c" if (d[0] or 0) % 2 else None, 1.0, 1) for d in docs], f"{DOCS}, lang string, score double, rank int").repartition(2)
    asked = [d for d in docs if d[0] is not None and d[0] % 20 == 0] + [(300, "t1 zz"), (301, "unknown")]
    queries = spark.createDataFrame([(*d, None) for d in asked], f"{DOCS}, lang string")
    found = sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in bm25.search(df, queries, 5, "lang").collect())
    expected = brute_search(docs, asked, 5)
    assert [f[:3] for f in found] == [e[:3] for e in expected] and np.allclose([f[3] for f in found], [e[3] for e in expected], atol=2e-6)
    assert bm25.search(df.limit(0), queries, 5).count() == 0 and bm25.search(df, queries.limit(0), 5).count() == 0


def test_search_sends_no_query_to_each_shard(spark, monkeypatch):
    """Queries and shards meet where they lie: what is shuffled and written doesn't grow with queries times shards."""
    plans, write = {}, bm25.materialize
    monkeypatch.setattr(bm25, "materialize", lambda df, name: (plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    monkeypatch.setattr(bm25, "SHARD_DOCS", 2)
    df = spark.createDataFrame([(i, f"w{i} w{i % 7}") for i in range(60)], DOCS)
    assert bm25.search(df, df, 1).count() == 60
    assert len(plans["results"]) == 2 and not any("Exchange" in p or "Broadcast" in p for p in plans["results"])


def test_search_hands_a_shard_once_to_all_packs(spark, monkeypatch, tmp_path):
    """A worker gets the bytes of a shard with the first pack of its group only, and numbers as narrow as they may be."""

    def noting(run):
        def noted(batches):
            from pyspark import TaskContext

            for batch in batches:
                if "queries" in batch.schema.names:
                    task = TaskContext.get().taskAttemptId()
                    with open(f"{tmp_path}/{task}", "a") as f:
                        f.writelines(f"{r['doc_ids'].hex() if r['doc_ids'] else '-'}\n" for r in batch.to_pylist())
                yield batch

        return lambda batches: run(noted(batches))

    for name, value in (("SHARD_DOCS", 10), ("PACK_TERMS", 10), ("AHEAD", 3)):
        monkeypatch.setattr(bm25, name, value)
    monkeypatch.setattr(bm25, "tidy", noting)
    df = spark.createDataFrame([(i, f"w{i} w{i % 7}") for i in range(60)], DOCS)
    assert bm25.search(df, df, 1).count() == 60
    tasks = [f.read_text().split() for f in tmp_path.iterdir()]
    sent = [[x for x in rows if x != "-"] for rows in tasks]
    assert all(rows[0] != "-" and len(own) == len(set(own)) for rows, own in zip(tasks, sent, strict=True))
    assert sum(map(len, tasks)) > 2 * sum(map(len, sent)) > 0
    assert {len(r["docs"]) / np.frombuffer(r["starts"], "<i8")[-1] for r in bm25.build_index(df).collect()} == {1.0}


def test_shard_is_built_in_little_memory():
    """Some 30 bytes a posting at the peak, whether numbers of postings are wide or narrow."""
    import tracemalloc

    rng = np.random.default_rng(0)
    n, lists = 4096, 2000
    docs = np.concatenate([np.sort(rng.choice(n, 500, replace=False)) for _ in range(lists)])
    parts = {"doc_ids": (np.arange(n), "<i8"), "lengths": (np.full(n, 100), "<i8"), "terms": (np.arange(lists), "<u8"), "starts": (np.arange(lists + 1) * 500, "<i8")}
    found = []
    for wide, narrow in (("<u4", "<u4"), ("<u2", "<u1")):
        row = {c: x.astype(kind).tobytes() for c, (x, kind) in (parts | {"docs": (docs, wide), "counts": (docs % 5 + 1, narrow)}).items()}
        tracemalloc.start()
        shard = bm25.Shard(row, 90.0)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40 * len(docs)
        found.append(shard.search(np.arange(50, dtype=np.uint64), np.ones(50), 10, 1e-6))
    assert np.array_equal(found[0][0], found[1][0]) and np.array_equal(found[0][1], found[1][1])


def test_search_skips_what_cannot_be_found():
    """Blocks and lists below the k-th score are not read, and ties at the k-th place all come back."""
    rng = np.random.default_rng(0)
    n, terms = 4096, np.arange(1, 41, dtype=np.uint64)
    lists = [np.flatnonzero(rng.random(n) < (0.5 if t < 30 else 0.01)) for t in range(40)]
    lengths, counts = np.full(n, 100), [rng.integers(1, 4, len(x)) for x in lists]
    starts = np.append(0, np.cumsum([len(x) for x in lists]))
    parts = {"doc_ids": (np.arange(n), "<i8"), "lengths": (lengths, "<i8"), "terms": (terms, "<u8"), "starts": (starts, "<i8"), "docs": (np.concatenate(lists), "<u4"), "counts": (np.concatenate(counts), "<u4")}
    shard = bm25.Shard({c: x.astype(kind).tobytes() for c, (x, kind) in parts.items()}, 100.0)
    read, sums = [], shard._sums
    shard._sums = lambda entries, weight: (read.append(int(shard.size[entries].sum())), sums(entries, weight))[1]
    weights = np.where(np.arange(40) < 30, 0.1, 5.0)
    whole = np.zeros(n)
    for x, c, w in zip(lists, counts, weights, strict=True):
        whole[x] += w * c * 2.2 / (c + 1.2)
    expected = np.round(whole, 6)
    least = np.sort(expected)[-10]
    scores, ids = shard.search(terms, weights, 10, 1e-6)
    assert sorted(ids.tolist()) == np.flatnonzero(expected >= least).tolist() and np.allclose(np.sort(scores), np.sort(expected)[-len(scores) :], atol=2e-6)
    first = sum(read)
    read.clear()
    assert sorted(shard.search(terms, weights, 10, least)[1].tolist()) == sorted(ids.tolist())
    assert sum(read) < 0.6 * len(np.concatenate(lists)) and sum(read) <= first


def test_search_of_a_text_of_many_words(spark):
    """400,000 distinct words, in a document and in a query: memory stays in proportion to them."""
    import tracemalloc

    long = " ".join(f"w{i}" for i in range(400_000))
    docs = [(0, long)] + [(i, f"w{i} w{2 * i} w{3 * i}") for i in range(1, 600)]
    df = spark.createDataFrame(docs, DOCS).coalesce(1)
    found = bm25.search(df, df, 3).collect()
    assert {r["query_id"]: r["doc_id"] for r in found if r["rank"] == 1} == {i: i for i, _ in docs}
    row = bm25.build_index(df).collect()[0].asDict()
    tracemalloc.start()
    shard = bm25.Shard(row, 1000.0)
    for _ in range(100):
        shard.search(shard.terms, np.ones(len(shard.terms)), 3, 1e-6)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def brute_languages(rows, threshold=0.5):
    """rows: id, text, host, domain, suffix, declared. All rows train the model."""
    n_buckets = 1 << 16

    def grams(text):
        raw = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").encode())
        raw = b" " + b" ".join(raw.split()) + b" "
        return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 0x9E3779B1 % (1 << 32)) >> 16 for i in range(len(raw) - 2)]

    own = [Counter(grams(r[1])) for r in rows]
    languages = sorted({r[5] for r, g in zip(rows, own, strict=True) if r[5] is not None and g})
    counts = {x: np.zeros(n_buckets) for x in languages}
    for r, g in zip(rows, own, strict=True):
        for b, n in g.items() if r[5] in counts else ():
            counts[r[5]][b] += n
    shared = sum(counts.values()) + 1
    shared /= shared.sum()
    logs = [np.log((counts[x] + 200 * shared) / (counts[x].sum() + 200)) for x in languages] + [np.full(n_buckets, -np.log(n_buckets))]
    scores = np.array([[sum(n * t[b] for b, n in g.items()) / 3 for t in logs] for g in own])
    posterior = lambda s: np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    alone = np.array([posterior(s) if sum(g.values()) else np.zeros(len(logs)) for s, g in zip(scores, own, strict=True)])
    out = []
    for r, g, s, a in zip(rows, own, scores, alone, strict=True):
        prior = np.full(len(logs), 1 / len(logs))
        for level in (None, 4, 3, 2):
            peers = [k for k, o in enumerate(rows) if level is None or o[level] == r[level] and (level != 2 or o[2:5] == r[2:5])]
            others = np.maximum(alone[peers].sum(axis=0) - a, 0)
            prior = (others + 10 * prior) / (others.sum() + 10)
        codes = {o[5] for o in rows if o[5] is not None}
        said = 0 if r[5] is None else np.log((alone[[k for k, o in enumerate(rows) if o[5] == r[5]]].sum(axis=0) + 0.5) / (alone.sum(axis=0) + 0.5 * (len(codes) + 1)))
        p = posterior(s + np.log(prior) + said)
        best = int(p.argmax())
        name = [*languages, "und"][best] if g else "und"
        out.append((r[0], name, round(float(p[best]), 5) if g else 0.0, bool(g) and name != "und" and p[best] >= threshold))
    return out


def test_languages_against_brute_force(spark):
    """Model, reliability, priors on all levels and posteriors, on all pages and with nulls."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    rows = []
    for r in pages[:120]:
        host = re.search(r"://([^/?#:]*)", r["url"] or "")
        host = host.group(1).lower() if host else None
        said = re.search(r"""<html\b[^<>]*?\blang\s*=\s*["']?\s*([a-zA-Z]{2,3})\b""", r["html"])
        rows.append((r["page_id"], langid.page_text(r["html"]), host, ".".join(host.split(".")[-2:]) if host else None, host.split(".")[-1] if host else None, said.group(1).lower() if said else None))
    rows += [(None, "the and of with", None, None, None, None), (900, None, "h.org", "h.org", "org", "en"), (901, "123", None, None, None, "xx"), (902, "", None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, host string, domain string, suffix string, declared string")
    found = [(r["id"], r["language"], round(r["posterior"], 5), r["accepted"]) for r in langid.identify(df, langid._plain_texts).collect()]
    expected = brute_languages(rows)
    assert len(found) == len(expected)
    for f, e in zip(sorted(found, key=repr), sorted(expected, key=repr), strict=True):
        assert (f[0], f[1], f[3]) == (e[0], e[1], e[3]) and abs(f[2] - e[2]) < 2e-5


def test_pages_that_never_close_their_markup():
    import time

    began = time.monotonic()
    for x in ("<!--" * 1_250_000, "<script " * 600_000, "<" * 5_000_000, "<!-- <script <style > " * 200_000):
        langid.page_text(x)
    assert time.monotonic() - began < 30
    assert langid.page_text("a<!-- b --c<p>d&amp;&#" + "9" * 5000 + ";<script>x</Script >e<b") == "a d&\ufffd e<b"


def test_declarations_that_never_close(spark):
    import time

    pages = ["<html " * 800_000, "<meta " + "content-language " * 300_000, "<html lang=" + " " * 3_000_000, "<html lang = 'FR'>", "<meta http-equiv=content-language content=de>", None]
    df = spark.createDataFrame([(x,) for x in pages], "html string")
    began = time.monotonic()
    found = [r[0] for r in df.select(langid.declared_language(F.col("html"))).collect()]
    assert found == [None, None, None, "fr", "de", None] and time.monotonic() - began < 30


def test_many_declared_codes(spark):
    """70 languages and 1100 codes: each has a model and a reliability of its own."""
    rng = random.Random(3)
    codes = [f"{a}{b}{c}" for a in "abcdefghijk" for b in "abcdefghij" for c in "abcdefghij"]
    word = lambda c: "".join(rng.choice(c * 2 + "e") for _ in range(6))
    rows = [(i, " ".join(word(c) for _ in range(30)), "h", c) for i, c in enumerate(codes[:70] * 3)]
    df = spark.createDataFrame(rows, f"{DOCS}, source string, lang string")
    found = {r["doc_id"]: r for r in langid.identify_documents(df).collect()}
    assert np.mean([found[r[0]]["language"] == r[3] for r in rows]) > 0.9
    rare = spark.createDataFrame([(i, f"{c} {c} word", "h", c) for i, c in enumerate(codes)], f"{DOCS}, source string, lang string")
    names = {r["language"] for r in langid.identify_documents(rare).collect()}
    assert len(names) > 1024


def test_long_runs_of_blanks(spark, reference):
    fast = packing.token_encoder(PATH)
    for n in (1_000_000, 3_000_000):
        for c in " \n":
            x = "a" + c * n + "b"
            assert fast(x).tolist() == reference.encode(x, add_special_tokens=False).ids
    df = spark.createDataFrame([(1, " " * 1_000_000), (2, "\n" * 1_000_000 + "x")], DOCS)
    assert {r[0]: r[1] for r in packing.pack_documents(df, PATH).groupBy("doc_id").agg(F.sum("length")).collect()} == {i: len(reference.encode(t).ids) + 1 for i, t in df.collect()}


def test_blanks_are_encoded_in_constant_memory(vocabulary):
    e = bpe.Encoder(vocabulary)
    for _ in range(64):
        e.feed(" " * bpe.CHUNK_CHARS)
        assert len(e.held) + len(e.rest) < 2 * e.window


def test_languages_of_pages(spark):
    found = {r["page_id"]: r for r in Q.op1_language_id(spark, SF).collect()}
    paths = {r["page_id"]: re.search(r"://[^/]*/(..)/", r["url"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    right = [found[i]["language"] == m.group(1) for i, m in paths.items() if m]
    assert len(found) == len(paths) and np.mean(right) > 0.95


def test_languages_of_held_out_texts(spark):
    """Half of the texts go without a declaration and a host, and with text alone are told apart."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    some = [(r["doc_id"], r["text"], "h", "x", r["lang"] if r["doc_id"] % 2 else None, "z", 1.0) for r in rows]
    df = spark.createDataFrame(some, f"{DOCS}, source string, language string, lang string, host string, posterior double")
    found = {r["doc_id"]: r["language"] for r in langid.identify_documents(df).collect()}
    held = [r for r in rows if not r["doc_id"] % 2]
    assert np.mean([found[r["doc_id"]] == r["lang"] for r in held]) > 0.95


def test_evidence_counts(spark):
    """With a text that tells little, the host's other pages and the declaration decide."""
    en, fr = "the and of with this that there ", "le la les des une dans pour avec "
    rows = [(i, en * 5, "en.example.com", "en") for i in range(50)] + [(100 + i, fr * 5, "fr.example.com", "fr") for i in range(50)]
    rows += [(200, "a", "fr.example.com", None), (201, "a", "en.example.com", None), (202, "a", None, "fr")]
    found = {r["doc_id"]: r["language"] for r in langid.identify_documents(spark.createDataFrame(rows, f"{DOCS}, source string, lang string")).collect()}
    assert (found[200], found[201], found[202]) == ("fr", "en", "fr")


def test_every_declared_language_has_a_model(spark, monkeypatch):
    """Of 70 languages in scripts of their own the last ten are rare; texts without a declaration are theirs too."""
    rng = random.Random(0)

    def text(i):
        return " ".join("".join(chr(0x4E00 + 40 * i + rng.randrange(40)) for _ in range(3)) for _ in range(60))

    rows = [(100 * i + k, text(i), None, f"l{i:02}" if k else None) for i in range(70) for k in range(6 if i < 60 else 4)]
    df = spark.createDataFrame(rows, f"{DOCS}, source string, lang string")
    found = {r["doc_id"]: r for r in langid.identify_documents(df).collect()}
    assert all(found[i]["language"] == f"l{i // 100:02}" and found[i]["accepted"] for i, *_ in rows)
    few = df.where("doc_id < 600")
    table = {r["doc_id"]: r for r in langid.identify_documents(few).collect()}
    monkeypatch.setattr(langid, "DENSE", 0)
    seen = {r["doc_id"]: r for r in langid.identify_documents(few).collect()}
    assert all(seen[i]["language"] == r["language"] and abs(seen[i]["posterior"] - r["posterior"]) < 1e-4 for i, r in table.items())


def test_language_edges(spark):
    rows = [(i, "the and of with this that there " * 3, "s", "en") for i in range(20)] + [(30, None, None, None), (31, "", "s", "en"), (32, "123 !!", "s", "en"), (None, "the and of", "s", "en"), (33, "the and of", "s", "zz")]
    df = spark.createDataFrame(rows, f"{DOCS}, source string, lang string")
    found = {r["doc_id"]: r for r in langid.identify_documents(df).collect()}
    assert all(found[i]["language"] == "und" and not found[i]["accepted"] and found[i]["posterior"] == 0 for i in (30, 31, 32))
    assert found[1]["accepted"]
    kept = langid.accepted_documents(df)
    assert kept.columns == df.columns and {30, 31, 32}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.count() >= 21
    assert langid.accepted_documents(df.limit(0)).count() == 0
    assert langid.accepted_documents(df.withColumn("lang", F.lit(None).cast("string"))).count() == 22
    pages = spark.createDataFrame([(1, None, None), (2, "x", "<html lang=en><body>the and of</body></html>")], "page_id long, url string, html string")
    assert langid.identify_pages(pages).count() == 2
    said = ['<HTML class="x" LANG = "de-AT">', "<html><meta http-equiv=Content-Language content='fr'>", "<html>", None]
    codes = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x string").select("i", langid.declared_language(F.col("x")).alias("c"))
    assert [r["c"] for r in codes.orderBy("i").collect()] == ["de", "fr", None, None]
    assert langid.page_text("a<script>b</script><p>c&amp;</p>").split() == ["a", "c&"]
