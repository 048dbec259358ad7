"""Operators of the engine, against small models in plain Python."""

import io
import math
import random
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from corvidex.functions import text as tx
from corvidex.functions.porter import stem
from corvidex.operators import catalog, chunking, filters, fts, fusion, vector
from corvidex.operators.packed import unpack
from corvidex.plans import search
from corvidex.sources import files
from corvidex.streaming.indexer import index_batch, start, windowed_counts

CHUNK = "chunk_id long, doc_id long, text string, heading string, heading_ancestry string, doc_path string, fts_path string"


def test_unpack_dialects(spark):
    many = [(1000 + i, t) for i in range(8) for t in ("runbook,on-call,q&a", "runbook; on-call; draft", "ci/cd | runbook", '"notes; misc",draft', "how to,c++", "what's new,draft", "a, b and c".replace(", ", "\\, "))]
    rows = [
        (1, 'runbook,"notes; misc",draft'), (2, '["on-call", "say \\"hi\\"", "caf\\u00e9"]'), (3, "[runbook, draft]"), (4, "- runbook\n* ci/cd\n  - draft"), (5, ",runbook,, ,draft,"),
        (6, '"12"" rack",draft'), (7, "price: 3\\,50,draft"), (8, "what's new; 'how to'"), (9, "runbook / ci/cd"), (10, None), (11, ""), (12, "  "), (13, "runbook,runbook"), (13, "runbook,runbook"), (14, "runbook\ndraft, q&a;c++"), (15, ",;|"),
    ]
    df = spark.createDataFrame(rows + many, "doc_id long, tags string").withColumn("id", F.lit("x")).withColumn("packed", F.lit(3)).withColumn("n", F.lit(1))
    got = {}
    for r in unpack(df, "doc_id", "tags").where("doc_id < 1000").orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["tag"])
        assert r["pos"] == len(got[r["doc_id"]]) - 1
    assert got == {
        1: ["runbook", "notes; misc", "draft"], 2: ["on-call", 'say "hi"', "café"], 3: ["runbook", "draft"], 4: ["runbook", "ci/cd", "draft"], 5: ["runbook", "draft"], 6: ['12" rack', "draft"],
        7: ["price: 3,50", "draft"], 8: ["what's new", "how to"], 9: ["runbook", "ci/cd"], 13: ["runbook", "runbook"], 14: ["runbook", "draft", "q&a", "c++"],
    }
    assert unpack(df.limit(0), "doc_id", "tags").count() == 0


def test_unpack_many_kinds_and_long_values(spark):
    kinds = ["x1,x2", "x2;x3", "x3|x4", "x4\nx5", "x5\tx6", "x6，x7", "x7、x8", "x8；x9", "x9 • y1"]
    mixed = "x1,x2;x3|x4\nx5\tx6，x7、x8；x9 • y1"
    long = ", ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    rows = [(i, k) for i, k in enumerate(kinds * 6)] + [(1000, mixed), (1001, f'"{long}";x1')] + [(1002 + i, f'"{long}";x{i % 9}') for i in range(60)]
    got = {}
    for r in unpack(spark.createDataFrame(rows, "doc_id long, tags string"), "doc_id", "tags").where("doc_id >= 1000").orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["tag"])
    assert got[1000] == [f"x{i}" for i in range(1, 10)] + ["y1"] and got[1001] == [long, "x1"]


def test_unpack_very_long_field(spark):
    df = spark.createDataFrame([(1, ",".join(f"tag{i % 50}" for i in range(5000)))], "doc_id long, tags string")
    assert unpack(df, "doc_id", "tags").count() == 5000


@pytest.mark.parametrize("word,want", [("ponies", "poni"), ("agreed", "agre"), ("its", "it"), ("generalizations", "gener"), ("running", "run"), ("as", "as"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("happy", "happi"), ("sky", "sky")])
def test_porter(word, want):
    assert stem(word) == want


def test_bm25_matches_sqlite(spark):
    random.seed(4)
    vocab = ["alpha", "alpine", "bravo", "brave", "charlie", "delta", "echo"]
    rows = [(i, 1, " ".join(random.choices(vocab, k=random.randint(3, 12))), random.choice(vocab), "", "d/x.md", "d/" + random.choice(vocab)) for i in range(1, 60)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(p, h, t, tokenize='unicode61')")
    db.executemany("insert into f(rowid, p, h, t) values (?, ?, ?, ?)", [(r[0], r[6], r[3], r[2]) for r in rows])
    want = dict(db.execute("select rowid, bm25(f, 10.0, 2.0, 1.0) from f where f match '\"alp\"* AND \"bra\"*'"))
    got = {r["chunk_id"]: r["fts_rank"] for r in fts.bm25(spark.createDataFrame(rows + rows[:5], CHUNK), "alp bra").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


@pytest.mark.parametrize("query", ["rec", "réc", "naïve cafe", "foo_bar", "foo_ba rec", "й", "Ærø", "_ rec", "Å_x"])
def test_bm25_folds_as_unicode61(spark, query):
    texts = ["réclame récit", "RECORD foo bar", "re\u0301cit foo_barn", "foo x bar", "bar foo", "naïve café", "NAIVE Cafeteria", "йод", "иод", "ærø ÆRØ", "ǽrø", "ångström x", "Å x", "rec", "ế e", "plain"] + ["filler word"] * 8
    rows = [(i, 1, t, "foo" if i % 5 == 0 else "récent" if i % 7 == 0 else "", "", "d/x.md", "d/bar" if i % 3 == 0 else "d/é") for i, t in enumerate(texts, 1)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(p, h, t, tokenize='unicode61')")
    db.executemany("insert into f(rowid, p, h, t) values (?, ?, ?, ?)", [(r[0], r[6], r[3], r[2]) for r in rows])
    match = " AND ".join(f'"{w}"*' for w in query.split())
    want = dict(db.execute("select rowid, bm25(f, 10.0, 2.0, 1.0) from f where f match ?", (match,)))
    got = {r["chunk_id"]: r["fts_rank"] for r in fts.bm25(spark.createDataFrame(rows, CHUNK), query).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_bm25_edges(spark):
    rows = spark.createDataFrame([(1, 1, None, None, None, None, None), (2, 1, "", "", "", "", "")], CHUNK)
    assert fts.bm25(rows, "alpha").count() == 0
    assert fts.bm25(rows, "?!").count() == 0
    assert fts.bm25(rows.limit(0), "alpha").count() == 0


def test_postings_stem_words(spark):
    df = spark.createDataFrame([(1, 1, "running runs", "Run", "", "a", "a/b")], CHUNK)
    assert {(r["term"], r["wtf"]) for r in fts.build_postings(df).collect()} == {("run", 4.0), ("a", 10.0), ("b", 10.0)}


def test_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0], "a"), (1, [1.0, 0.0, 0.0], "a"), (2, [0.0, 1.0, 0.0], "a"), (3, [0.7, 0.7, 0.0], "b"), (4, None, "b"), (5, [0.0, 0.0, 0.0], "c"), (6, [1.0], "c"), (7, [2.0, 0.0, 0.0], "d")]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, doc_path string")
    got = [(r[0], round(r[1], 6)) for r in vector.knn(df, [1.0, 0, 0]).orderBy("distance", "chunk_id").select("chunk_id", "distance").collect()]
    assert got == [(1, 0.0), (7, 0.0), (3, 0.292893), (2, 1.0)]
    assert [r[0] for r in vector.similar_documents(df, "a", 3).orderBy("distance").collect()] == ["b", "d"]
    assert vector.similar_documents(df, "nowhere", 3).count() == 0
    near, far = vector.knn(df, [1.0, 0, 0], k=1), vector.knn(df, [0, 0, 1.0], k=1)
    assert vector.better_of(far, near) is near and vector.better_of(near, far) is near and vector.better_of(near, near.limit(0)) is near


def test_fusion_numbers(spark):
    rows = [(0, "vec", 1.0, 10, 0, 0.8, 0.2, None), (1, "fts", 1.0, 20, 0, 0.6, None, -1.5), (0, "vec", 1.0, 30, 1, 0.7, 0.3, None), (1, "fts", 1.0, 30, 1, 0.5, None, -1.0)]
    df = spark.createDataFrame(rows, "list_idx int, kind string, weight double, chunk_id long, rank int, score double, distance double, fts_rank double")
    got = {r["chunk_id"]: r for r in fusion.fuse(df).collect()}
    assert math.isclose(got[10]["rrf_score"], 0.8 / 60 + 0.05) and math.isclose(got[20]["rrf_score"], 0.6 / 60 + 0.05)
    assert math.isclose(got[30]["rrf_score"], 1.2 / 61 + 0.02) and got[30]["in_vec"] and got[30]["in_fts"] and got[20]["similarity"] is None


def test_parse_filters():
    clean, f = filters.parse_filters('file:docs/*.md type:markdown tag:Python tag:x dt>"2026-01-15" dt<="2026-02-01" +"Async" -"wip" +"" two  words')
    assert clean == "two words"
    assert f == filters.Filters("docs/*.md", "markdown", ("python", "x"), "2026-01-15", "2026-02-01", ("async",), ("wip",))
    assert not filters.parse_filters("plain")[1].active


def test_apply_filters(spark):
    rows = [("docs/a.md", "markdown", "Python, x", "2026-02-14 10:00:00", "Async text"), ("docs/sub/b.pdf", None, None, None, None), ("c.md", "pdf", "x", "2025-01-01", "wip")]
    df = spark.createDataFrame(rows, "doc_path string, type string, tags string, indexed_at string, text string")
    run = lambda q: sorted(r[0] for r in df.where(filters.predicate(filters.parse_filters(q)[1])).select("doc_path").collect())
    assert run("file:docs/*") == ["docs/a.md", "docs/sub/b.pdf"]
    assert run("tag:python tag:x") == ["docs/a.md"]
    assert run('dt>"2026-02-14"') == ["docs/a.md"]
    assert run('dt<"2026-02-14"') == ["c.md", "docs/sub/b.pdf"]
    assert run('+"async"') == ["docs/a.md"] and run('-"wip"') == ["docs/a.md", "docs/sub/b.pdf"]
    assert run("type:[mp]*") == ["c.md", "docs/a.md"]


def pack_model(text, limit):
    import re

    if len(text) <= limit:
        return [text]
    out, now = [], ""
    for p in re.split(r"\n\n+", text):
        if len(now) + len(p) > limit:
            out += [now] if now else []
            now = p
        else:
            now = f"{now}\n\n{p}" if now else p
    return out + ([now] if now else [])


def test_pack_equals_model(spark):
    random.seed(1)
    texts = ["\n\n".join("x" * random.randint(1, 60) for _ in range(random.randint(1, 12))) for _ in range(60)] + ["", "y" * 5000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", chunking.pack(F.col("text"), 100).alias("p")).orderBy("i").collect()
    for r in got:
        assert r["p"] == pack_model(texts[r["i"]], 100)


def ancestry_model(text):
    import re

    stack, out = [], []
    for line in text.split("\n"):
        if m := re.match(r"^(#{1,6})\s+(.+?)$", line):
            stack = [x for x in stack if x[0] < len(m[1])] + [(len(m[1]), m[2].strip())]
            out.append(" > ".join(x[1] for x in stack))
    return out


def test_heading_paths_equal_model(spark):
    random.seed(2)
    texts = ["\n".join("#" * random.randint(1, 6) + f" h{k}" if random.random() < 0.7 else "body" for k in range(15)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "doc_id int, text string")
    got = {}
    for r in chunking.sections(df).where("heading is not null").orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append(r["heading_ancestry"])
    assert all(got.get(i, []) == ancestry_model(t) for i, t in enumerate(texts))
    assert chunking.chunk_markdown(df, 50, 1).count() > 0 and chunking.chunk_plain(df.limit(0)).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("a/b/c.md", "# Title \nx", "  x\n")], "path string, text string, s string")
    row = df.select(tx.last_parts(F.col("path")), tx.title(F.col("text"), F.col("path")), tx.strip(F.col("s")), tx.format_size(F.lit(12400)), tx.format_size(F.lit(2_500_000)), tx.format_size(F.lit(7))).first()
    assert list(row) == ["b/c.md", "Title", "x", "12.4 KB", "2.5 MB", "7 B"]
    tags = spark.createDataFrame([('---\ntags: [a, "b c"]\n---\nx',), ("---\ntags:\n  - x\n  - 'y'\n---\n",), ("no",)], "t string").select(chunking.frontmatter_tags(F.col("t"))).collect()
    assert [r[0] for r in tags] == [["a", "b c"], ["x", "y"], []]


def test_change_plan_keeps_repeated_chunks(spark):
    old = spark.createDataFrame([("p", 1, "h"), ("p", 2, "h"), ("p", 3, "z")], "path string, chunk_id long, content_hash string")
    new = spark.createDataFrame([("p", 0, "h"), ("p", 1, "h"), ("p", 2, "new")], "path string, chunk_index int, content_hash string")
    got = sorted((r["action"], r["chunk_id"], r["chunk_index"]) for r in catalog.change_plan(old, new).where("action = 'reuse'").collect())
    assert got == [("reuse", 1, 0), ("reuse", 2, 1)]
    assert {r["action"]: r["n"] for r in catalog.change_plan(old, new).groupBy("action").agg(F.count("*").alias("n")).collect()} == {"reuse": 2, "insert": 1, "delete": 1}


def test_tags(spark):
    docs = spark.createDataFrame([("a", "Rust,python"), ("b", None)], "path string, tags string")
    got = {r["path"]: r["tags"] for r in catalog.with_tags(docs, "a", ["New"], ["rust"]).collect()}
    assert got == {"a": "new,python", "b": None}


def test_catalog_and_stream(spark, tmp_path):
    cat = catalog.Catalog(spark, f"file://{tmp_path}/index")
    with pytest.raises(FileNotFoundError):
        cat.read("documents")
    long = "A paragraph that is long enough to stay a chunk of its own, at least fifty characters."
    batch = spark.createDataFrame([(1, "a.md", long), (2, "b.md", long + "!"), (3, "c.md", None)], "doc_id long, path string, text string")
    assert index_batch(cat, batch).commit == 1 and cat.read("chunks").count() == 2
    batch.where("doc_id = 1").withColumn("text", F.lit(long + "\n\n" + "z" * 60)).write.parquet(f"{tmp_path}/in")
    q = start(cat, spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert cat.current() == 2 and cat.read("documents").count() == 2
    assert {r["doc_path"] for r in cat.read("chunks").collect()} == {"a.md", "b.md"}
    cat.reset()
    assert cat.current() == 0


def test_windowed_counts(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0), (3, "2024-01-01 01:00:00", "a", 4.0)], "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["n"], r["total"]) for r in windowed_counts(df).collect()) == [(1, 4.0), (2, 3.0)]


def test_extractors(spark, tmp_path):
    assert files.html_text("<title>T</title><style>x</style><p>a &amp; b</p><!-- c --><div>d</div>") == "Ta & b\nd"
    cues = spark.createDataFrame([("WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\nHello\nNOTE x\n\u00a042 men\n",)], "t string")
    assert cues.select(files.subtitle_lines(F.col("t"))).first()[0] == "Hello\n42 men"
    assert files.extract(".eml", b"Subject: S\nFrom: a@b\n\nBody\n")[0] == "Subject: S\nFrom: a@b\n\nBody"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("content.xml", '<o xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><text:p>one</text:p><text:p> </text:p><text:p>two</text:p></o>')
    assert files.extract(".odt", buf.getvalue())[0] == "one\n\ntwo"
    assert files.extract(".odt", b"broken")[1].startswith("BadZipFile")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# A\r\nx")
    (tmp_path / "docs" / "b.draft.md").write_text("no")
    (tmp_path / "big.txt").write_text("y" * 2000)
    (tmp_path / "x.bin").write_text("no")
    got = {r["path"]: r["text"] for r in files.scan(spark, str(tmp_path), ["*.draft.md"], max_mb=0.001).collect()}
    assert got == {"docs/a.md": "# A\nx"}


def test_search_plans(spark):
    rows = [(i, i, f"alpha text number {i} " + "gamma " * i, f"H{i}", f"G > H{i}", f"d{i}.md", f"d{i}.md") for i in range(1, 8)]
    rows += [(100 + i, 100 + i, "nothing to see", "N", "", f"n{i}.md", f"n{i}.md") for i in range(20)]
    chunks = spark.createDataFrame(rows, CHUNK)
    docs = spark.createDataFrame([(r[1], r[5], "markdown", "x" if r[0] % 2 else "y", "2026-01-01", "t") for r in rows], "doc_id long, path string, type string, tags string, indexed_at string, title string")
    vecs = spark.createDataFrame([(r[0], [1.0, float(r[0])]) for r in rows], "chunk_id long, embedding array<float>")
    got = search.hybrid_search("alpha", [1.0, 1.0], chunks, vecs, docs, 5).orderBy("rank").collect()
    assert len(got) == 5 and got[0]["sources"] == "fts+vec" and [r["rank"] for r in got] == [1, 2, 3, 4, 5]
    tagged = search.hybrid_search("tag:x alpha", [1.0, 1.0], chunks, vecs, docs, 3).collect()
    assert {r["chunk_id"] % 2 for r in tagged} == {1}
    with pytest.raises(search.NoSearchTerms):
        search.keyword_search("file:*.md", chunks, docs)
    assert search.keyword_search("alpha", chunks, docs, 3).count() == 3
    out = search.ask("alpha", lambda q: [1.0, 1.0], lambda q, c: f"{q}|{c.count('[')}", chunks, vecs, docs, rerank=lambda q, ps: "3, 1, 99")
    assert out["answer"].startswith("alpha|") and out["sources"]
    assert search.parse_ranking("3, 1, 5, 99, 3", 6, 5) == [2, 0, 4, 1, 3]
    assert "G > H" in search.context(search.hybrid_search("alpha", [1.0, 1.0], chunks, vecs, docs, 2)).first()[0]


def test_hybrid_search_fuses_all_tagged_chunks(spark):
    rows = [(i, i, "alpha " * (40 - i) + "x " * i, "", "", f"d/{i}.md", f"d/{i}.md") for i in range(1, 31)]
    docs = spark.createDataFrame([(r[1], r[5], "pdf" if r[0] == 30 else "markdown", "x", "2026-01-01", "t") for r in rows], "doc_id long, path string, type string, tags string, indexed_at string, title string")
    vecs = spark.createDataFrame([(r[0], [1.0, float(r[0])]) for r in rows], "chunk_id long, embedding array<float>")
    run = lambda q, v, k, **how: [(r["chunk_id"], r["sources"]) for r in search.hybrid_search(q, v, spark.createDataFrame(rows, CHUNK), vecs, docs, k, **how).orderBy("rank").collect()]
    assert run("tag:x type:pdf alpha", [1.0, 0.0], 2) == [(30, "fts+vec")]  # last of both lists
    assert run("tag:x alpha", [0.0, 1.0], 2)[0] in {(1, "fts+vec"), (30, "fts+vec")}
    assert {s for _, s in run("tag:x alpha", [0.0, 1.0], 4)} == {"fts+vec"}
    assert {s for _, s in run("tag:x alpha", [0.0, 1.0], 4, prefilter=True)} == {"fts+vec"}
    assert run("type:pdf alpha", [1.0, 0.0], 2) == []  # without a tag the other filters act on 5k candidates


def test_history_compares_all_versions(spark, tmp_path):
    from corvidex import queries

    spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "b")], "doc_id long, path string").write.parquet(f"{tmp_path}/documents.parquet")
    hashes = {1: "pqq", 2: "pqr", 3: "pq", 4: "ps", 5: "p"}
    rows = [(10 * doc + i, doc, i, h) for doc, hs in hashes.items() for i, h in enumerate(hs)]
    spark.createDataFrame(rows + rows[:2], "chunk_id long, doc_id long, chunk_index long, content_hash string").write.parquet(f"{tmp_path}/chunks.parquet")
    run = lambda name: sorted(tuple(r) for r in queries.queries()[name](spark, str(tmp_path)).collect())
    assert run("incremental_diff_all") == [("delete", 3), ("insert", 6), ("reuse", 5)]
    assert run("orphan_chunks_all") == [(11,), (12,), (21,), (22,), (31,)]
    assert run("reused_chunks_all") == [(20,), (21,), (30,), (31,), (40,)]


def test_context_of_five_passages(spark, tmp_path):
    from hashlib import md5

    from corvidex import queries

    spark.createDataFrame([(q, p, f"d/{p}", f"t{p}") for q, n in ((1, 7), (2, 2)) for p in range(1, n + 1)], "query_id long, hit_pos long, doc_path string, text string").write.parquet(f"{tmp_path}/search_hits.parquet")
    got = {r["query_id"]: r["h"] for r in queries.queries()["context_assembly_full"](spark, str(tmp_path)).collect()}
    assert got == {q: md5("\n\n".join(f"[{p}] d/{p}\nt{p}" for p in range(1, n + 1)).encode()).hexdigest() for q, n in ((1, 5), (2, 2))}


def test_entry_runs_without_llm(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert {"hybrid_search", "p3_found"} <= names and set(e.oracle_sql()) <= names
    assert e.entry(spark).count() > 0
