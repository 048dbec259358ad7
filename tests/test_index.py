"""From files to answers: index, search the index, change it, index again."""

import json
import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from corvidex import api, cli, config, errors, tool_server
from corvidex.operators import catalog, fts
from corvidex.plans import search
from corvidex.streaming.indexer import index_batch, start

GUIDE = "---\ntags: [Howto, 'start']\n---\n# Guide\n\nInstall the engine with one command and read the café notes first.\n\n## Usage\n\nSearch your documents with words and running filters, as often as needed.\n"


def _embedder():
    def embed(texts):  # travels to the workers whole
        """Letter frequencies, so that like texts lie near each other."""
        return [[float(t.lower().count(c)) + 0.01 for c in "abcdefghijklmnop"] for t in texts]

    return embed


embed = _embedder()


@pytest.fixture()
def folder(tmp_path, monkeypatch):
    monkeypatch.setenv("CORVIDEX_HOME", str(tmp_path / "home"))
    docs = tmp_path / "proj" / "docs"
    docs.mkdir(parents=True)
    (docs / "guide.md").write_text(GUIDE)
    (docs / "notes.txt").write_text("Plain notes about the engine room, long enough to be kept as one chunk.\n\n" + "More about the gateway report and its runs. " * 60)
    (docs / "tiny.txt").write_text("too short")
    (docs / "skip.draft.md").write_text("# Draft\n\nThis is a draft that no index should ever hold, however long it is.")
    (docs / ".corvidexignore").write_text("# drafts\n*.draft.md\n")
    return tmp_path / "proj"


def test_index_search_and_index_again(spark, folder):
    c = config.with_source(config.create(True, folder), "docs")
    config.save(c)
    assert config.find(folder / "docs").sources == ("docs",)
    e = api.Engine(spark, c, api.Providers(embed, lambda q, text: f"{q}: {text[:3]}", rank=lambda q, p: "2, 1"))
    with pytest.raises(errors.NoIndex):
        e.fts("engine")
    run = e.index()
    assert (run.commit, run.indexed, run.skipped) == (1, 2, 1)
    chunks = e.catalog.read("chunks").collect()
    assert {(r["doc_path"], r["heading"], r["heading_ancestry"]) for r in chunks} >= {("docs/guide.md", "Usage", "Guide > Usage"), ("docs/notes.txt", None, "")}
    ids = {r["content_hash"]: r["chunk_id"] for r in chunks}
    assert e.catalog.read("vectors").count() == len(chunks) and len(ids) == len(chunks)
    # stems, diacritics and prefixes, from stored postings
    assert [r["doc_path"] for r in e.fts("run filter")["results"]] == ["docs/guide.md"] and e.fts("cafe")["results"] and not e.fts("nowhere")["results"]
    plan = e.tables().words("cafe")._jdf.queryExecution().toString()
    assert "StringStartsWith(term,cafe)" in plan
    found = e.search("engine", 3)
    assert found["results"][0]["sources"] and found["results"][0]["rank"] == 1 and set(found) >= {"query", "filters", "timing_ms", "candidates", "results"}
    assert {r["doc_path"] for r in e.search("tag:howto engine")["results"]} == {"docs/guide.md"}
    with pytest.raises(errors.NoSearchTerms):
        e.fts("file:*.md")
    assert e.ask("engine notes")["sources"] and e.similar("guide.md")["results"][0]["doc_path"] == "docs/notes.txt"
    # the second version keeps what is the same
    (folder / "docs" / "guide.md").write_text(GUIDE.replace("Install the engine", "Set up the engine"))
    run = e.index()
    assert (run.commit, run.indexed, run.unchanged, run.inserted, run.reused, run.deleted) == (2, 1, 1, 1, 1, 1)
    after = {r["content_hash"]: r["chunk_id"] for r in e.catalog.read("chunks").collect()}
    assert sum(ids.get(h) == i for h, i in after.items()) == len(after) - 1 and e.catalog.read("vectors").count() == len(after)
    assert not e.fts("install")["results"] and e.fts("set up")["results"]
    assert e.index().indexed == 0 and e.catalog.current() == 2
    assert e.tag("guide.md", ["New"], ["start"]) == "howto,new" and ("new", 1) in e.tags() and e.fts("set up")["results"]
    (folder / "docs" / "notes.txt").unlink()
    assert e.index(prune=True).pruned == 1 and e.list()["doc_count"] == 1 and e.stats()["chunk_count"] == e.stats()["vec_count"]
    e.catalog.vacuum()
    assert e.list()["documents"][0]["path"] == "docs/guide.md"
    with pytest.raises(errors.NotIndexed):
        e.similar("nothing.md")


def test_a_commit_that_fails_leaves_the_last_one(spark, tmp_path, monkeypatch):
    cat = catalog.Catalog(spark, f"file://{tmp_path}/i", 4)
    docs = spark.createDataFrame([("a.txt", "word " * 30), ("b.txt", "other " * 30)], "path string, text string")
    assert index_batch(cat, docs).commit == 1
    monkeypatch.setattr(catalog.Catalog, "_publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        index_batch(cat, docs.withColumn("text", F.concat("text", F.lit("more"))))
    monkeypatch.undo()
    assert cat.current() == 1 and cat.read("chunks").count() == 2
    before = cat._manifest(1)["tables"]["chunks"]
    index_batch(cat, docs.where("path = 'a.txt'").withColumn("text", F.concat("text", F.lit("more"))))
    after = cat._manifest(2)["tables"]["chunks"]
    assert sum(before[b] != after[b] for b in before) == 1  # only the bucket of the changed document
    with pytest.raises(RuntimeError):
        cat._publish(2, {})


def test_a_batch_played_again_commits_once(spark, tmp_path):
    cat = catalog.Catalog(spark, f"file://{tmp_path}/i", 4)
    docs = spark.createDataFrame([("a.txt", "word " * 30)], "path string, text string")
    docs.write.parquet(f"{tmp_path}/in")
    start(cat, spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/ck").awaitTermination(120)
    assert cat.current() == 1 and index_batch(cat, docs.withColumn("text", F.lit("changed " * 20)), number=(f"{tmp_path}/ck", 0)).commit == 1
    assert cat.read("chunks").first()["text"].startswith("word")


def test_missing_vectors_are_made_later(spark, tmp_path):
    cat = catalog.Catalog(spark, f"file://{tmp_path}/i", 4)
    docs = spark.createDataFrame([("a.txt", "word " * 30), ("a.txt", "word " * 30), ("b.txt", "wide " * 30), (None, "x"), ("c.txt", None)], "path string, text string").withColumn("term", F.lit("clash"))
    index_batch(cat, docs)
    assert cat.read("vectors").count() == 0
    run = index_batch(cat, docs, embed=embed)
    assert (run.indexed, run.unchanged) == (0, 2) and cat.read("vectors").count() == 2 and cat.read("chunks").count() == 2
    assert index_batch(cat, docs.limit(0)).indexed == 0


@pytest.mark.parametrize("query", ["running", "runn", "ponies cafe", "foo_bar", "generalizations", "the", "_", "naïve agreed"])
def test_postings_rank_as_sqlite(spark, query):
    r = random.Random(5)
    vocab = "run running runner ponies pony café cafe naïve naive agreed agree its foo bar generalization general theta the as".split()
    rows = [(i, " ".join(r.choices(vocab, k=r.randint(3, 14))), r.choice(vocab), "d/" + r.choice(vocab)) for i in range(1, 60)]
    rows += [(60, "so foo bars foo bar", "foo", "bar/x"), (61, "bar foo x bar", "foo bar", "foo/bar")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(p, h, t, tokenize='porter unicode61')")
    db.executemany("insert into f(rowid, p, h, t) values (?, ?, ?, ?)", [(i, p, h, t) for i, t, h, p in rows])
    match = " AND ".join(f'"{w}"*' for w in query.split())
    want = dict(db.execute("select rowid, bm25(f, 10.0, 2.0, 1.0) from f where f match ?", (match,)))
    postings = fts.build_postings(spark.createDataFrame(rows + rows[:3], "chunk_id long, text string, heading string, fts_path string"))
    got = {x["chunk_id"]: x["fts_rank"] for x in fts.search_postings(postings, query, *fts.lengths(postings)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_reranking_and_expansion():
    rows = [{"doc_path": f"{i}.md", "heading": None, "text": "x" * i} for i in range(1, 8)]
    assert [r["doc_path"] for r in search.reranked("q", rows, 3, listwise=lambda q, p: "3, 1, 99")] == ["3.md", "1.md", "2.md"]
    assert [len(r["text"]) for r in search.reranked("q", rows, 2, scorer=lambda pairs: [len(t) % 4 for _, t in pairs])] == [3, 7]
    assert search.reranked("q", rows[:2], 3, listwise=lambda q, p: 1 / 0) == rows[:2]
    assert search.parse_expansion('{"lex": ["Foo", "bar"], "vec": ["what is foo", 3]}', "foo ") == [("lex", "bar"), ("vec", "what is foo")]
    assert search.parse_expansion("no json", "q") == [] and search.parse_expansion("[1]", "q") == []
    assert search.guarded(lambda q: 1 / 0, "x") is None and search.guarded(lambda q: "  ", "x") is None


def test_variants_and_passage_join_the_fusion(spark, folder):
    c = config.with_source(config.create(True, folder), "docs")
    providers = api.Providers(embed, lambda q, t: "A", hyde=lambda q: "gateway report runs", expand=lambda q: json.dumps({"lex": ["gateway"], "vec": ["notes about runs"]}))
    e = api.Engine(spark, c, providers)
    e.index()
    found = e.search("install", 5, expand=True)
    assert found["expanded"] and {x["type"] for x in found["expansions"]} == {"lex", "vec"} and "docs/notes.txt" in {r["doc_path"] for r in found["results"]}
    assert e.ask("install report", expand=True)["expansions"] and e.ask("type:none engine")["answer"] is None


def test_command_line(spark, folder, monkeypatch, capsys):
    monkeypatch.chdir(folder)
    out = []

    def run(*args):
        out.clear()
        code = cli.App(lambda c: api.Engine(spark, c, api.Providers(embed, lambda q, t: "Yes.")), out.append).run(list(args))
        return code, "\n".join(out)

    assert run("init", "--project")[0] == 0 and run("init", "--project")[0] == 1
    assert run("add", "docs")[0] == 0 and run("sources")[1] == "docs" and run("add", "nowhere")[0] == 1
    assert run("stats")[0] == 1 and "2 indexed" in run("index")[1]
    assert json.loads(run("search", "engine", "2", "--json")[1])["results"][0]["rank"] == 1
    assert run("fts", "engine", "--csv")[1].splitlines()[0] == "rank,doc_path,heading,bm25,text"
    assert run("fts", "engine", "--md")[1].splitlines()[1].startswith("| --- |") and "[1] docs/" in run("fts", "engine")[1]
    assert "Yes." in run("ask", "engine")[1] and "notes.txt" in run("similar", "guide.md")[1]
    assert "tags: howto,new,start" == run("tag", "guide.md", "New")[1] and "tags: howto,start" == run("untag", "guide.md", "new")[1]
    assert "howto" in run("tags")[1] and "(all)" in run("list")[1] and "guide.md" in run("list", "--full")[1] and "doc_count: 2" in run("stats")[1]
    assert run("allow", "big.txt")[0] == 0 and config.find(folder).allowed_large_files == ("big.txt",)
    assert run("feedback", "it", "works", "--severity", "note")[0] == 0 and "it works" in run("feedback", "--list")[1] and run("feedback", "", "--severity", "bad")[0] == 1
    assert api.read_feedback(spark).count() == 1
    assert "search" in run("completion", "bash")[1] and run("completion", "x")[0] == 1 and run("nope")[0] == 1 and run("search")[0] == 1 and run("version")[0] == 0 and "FORMAT" in run()[1]
    assert run("remove", "docs")[0] == 0 and run("sources")[1] == "" and run("reset")[0] == 0 and run("fts", "x")[0] == 1


def test_tool_server(spark, folder):
    c = config.with_source(config.create(True, folder), "docs")
    e = api.Engine(spark, c)
    known = tool_server.tools(lambda: e)
    call = lambda method, **params: tool_server.handle({"id": 1, "method": method, "params": params}, known)
    assert len(call("tools/list")["result"]["tools"]) == 7 and call("initialize")["result"]["serverInfo"]["name"] and call("nope")["error"]["code"] == -32601
    assert call("tools/call", name="fts", arguments={"query": "x"})["result"]["isError"]
    e.index()
    got = call("tools/call", name="fts", arguments={"query": "engine"})["result"]
    assert not got["isError"] and json.loads(got["content"][0]["text"])["results"]
    assert call("tools/call", name="search", arguments={"query": "engine"})["result"]["isError"]  # there is no embedding provider
    assert tool_server.handle({"method": "notifications/initialized"}, known) is None
