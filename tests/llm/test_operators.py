"""Training-text operators, against brute force on small fixtures."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvidex.llm import encoding, knn, leakage, mixing, neardup, spans, splitting
from corvidex.llm.pairs import components, expand_pairs

NAMES = [f"{a}{b}{c}" for a in ("vra", "klu", "sto", "mei") for b in ("nd", "lt", "rk", "pr", "st") for c in ("us", "eim", "ova", "in", "ag")]


def sentence(r, n=14):
    return " ".join(r.choice(NAMES) for _ in range(n)) + "."


def cluttered(df):
    """Columns that clash with the operators' own names."""
    for name in ("id", "rep", "cls", "sig", "n", "h", "digest", "cell", "vec", "tab", "word", "pos", "key", "size", "tokens", "bucket"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("clash"))
    return df


# --- 1


def test_encoding_finds_and_repairs(spark):
    r = random.Random(3)
    words = ["réglage", "échéance", "tâche", "modèle", "général", "prüfen", "größer", "Übergabe", "résumé", "déjà", "naïve", "café", "année", "nächste", "können", "MÉMOIRE", "FAÇADE", "NÃO", "ключ", "записка", "таблица"]
    clean = [(i, " ".join(r.choice(words + ["the", "plan", "note"]) for _ in range(30))) for i in range(300)]
    bad = {
        1000: ("le réglage déjà fait", lambda s: s.encode().decode("cp1252", "replace")), 1001: ("können größer", lambda s: s.encode().decode("mac_roman")),
        1002: ("ключ записка таблица", lambda s: s.encode("koi8_r").decode("cp1251")), 1003: ("modèle général", lambda s: s.encode().decode("cp1252").encode().decode("cp1252")),
    }
    rows = clean + [(k, f(t)) for k, (t, f) in bad.items()] + [(1004, "caf� noir"), (1005, None), (1006, ""), (1007, "plain"), (1000, bad[1000][1](bad[1000][0]))]
    df = cluttered(spark.createDataFrame(rows, "chunk_id long, text string"))
    values = encoding._values([("chunks", df, "chunk_id", "text")])
    found = encoding.garbled_words(values)
    got = {x["row_id"]: x for x in encoding.repair(values, found).collect()}
    assert set(got) == {1000, 1001, 1002, 1003, 1004}
    for k in (1001, 1002, 1003):
        assert got[k]["repaired"] == bad[k][0]
    assert {x["row_id"]: x["repaired"] for x in encoding.repair(values, found, limit=0).collect()} == {k: x["repaired"] for k, x in got.items()}  # the joined way
    empty = values.limit(0)
    assert encoding.repair(empty, encoding.garbled_words(empty)).count() == 0


def test_encoding_finds_frequent_garbling(spark):
    words = ["открыть", "записка", "таблица", "ключ", "словарь"]
    passed = {v: k for k, v in reversed(list(encoding._page("cp1252").items()))}
    bad = {"".join(passed[b] for b in w.encode()): w for w in words}
    rows = list(enumerate(words * 200 + list(bad) * 200))
    values = encoding._values([("chunks", spark.createDataFrame(rows, "chunk_id long, text string"), "chunk_id", "text")])
    assert {x["word"]: x["reading"] for x in encoding.garbled_words(values).collect()} == bad


def test_repair_ways_cut_words_alike(spark):
    word = "хохот".encode().decode("latin-1")  # with two U+0085
    texts = [f"a {word} b", f"{word}\u2028{word}", f"x\x0b{word}\x0by"]
    values = encoding._values([("chunks", spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"), "chunk_id", "text")])
    found = spark.createDataFrame([("chunks", w, "c", "r") for w in (word, f"{word}\u2028{word}")], "tab string, word string, cipher string, reading string")
    want = {0: "a r b", 1: "r", 2: "x\x0br\x0by"}
    for limit in (10, 0):
        assert {x["row_id"]: x["repaired"] for x in encoding.repair(values, found, limit).collect()} == want


def test_encoding_learns_a_page_that_no_list_has(spark):
    """A source read through a permuted page: what its symbols stand for is learned from their neighbours."""
    r = random.Random(21)
    words = "bâtiment château gâteau réglage échéance tâche modèle général résumé déjà année répétée mémoire élève problème système première dernière très après même fenêtre hôpital forêt contrôle côté bientôt français leçon façade reçu garçon idée clé été protégé vérifié fermé café thé marché qualité santé sécurité activité réunion février téléphone énergie étape détail début".split()
    other = "für über können müssen größe ändern später nächste prüfen schließen Menü Gerät".split()
    page = dict(zip("éèêâôç", "¦¶Þþ§¤"))
    rows = [(i, f"s{i % 3}", " ".join(r.choice(words + other + ["the", "plan"]) for _ in range(40))) for i in range(240)]
    garbled = [(1000 + i, "Odd Source", " ".join(r.choice(words) for _ in range(12))) for i in range(60)]
    polish = [(2000 + i, "legal", " ".join(r.choice(["łódź", "żółty", "też", "już", "ręka", "święto", "książka", "dziękuję", "miesiąc", "wąż"]) for _ in range(12))) for i in range(60)]
    df = spark.createDataFrame(rows + polish + [(i, s, t.translate(str.maketrans(page))) for i, s, t in garbled], "chunk_id long, source string, text string")
    values = encoding._values([("chunks", cluttered(df), "chunk_id", "text", "source")])
    got = {x["row_id"]: x["repaired"] for x in encoding.repair(values, encoding.garbled_words(values)).collect()}
    assert got == {i: t for i, _, t in garbled if t.translate(str.maketrans(page)) != t}


def test_tables_and_bytes_read_alike():
    """Substitution of whole batches gives the readings that bytes give, word by word."""
    words = ["r‚glage", "Œ®áª¢ ", "öÔÏÔ", "naÃ¯ve", "žluť", "ŠŽ", "текст", "ÏÐÈÂÅÒ", "ﬁn", "abc¬"]
    for word in words:
        both = encoding.readings(word)
        rest = encoding.readings(word, tables=False)
        one = {y for z in encoding.TABLES.values() if not encoding._BAD.search(y := word.translate(encoding.table_of(z))) and all(ord(c) in encoding.table_of(z) for c in word)}
        assert set(both.values()) - set(rest.values()) <= one | {word}


def test_readings_round_trip():
    for page in ("cp1252", "cp1251", "mac_roman", "cp437"):
        text = "résumé" if page != "cp1251" else "réglé"
        garbled = "".join({v: k for k, v in reversed(list(encoding._page(page).items()))}[b] for b in text.encode())
        assert text in encoding.readings(garbled).values()


# --- 2


def brute_neighbours(rows, k):
    rows = {i: np.array(v, np.float32).astype(float) for i, v in rows if v is not None and len(v) == 8 and all(x is not None for x in v) and any(v)}
    out = {}
    for i, v in rows.items():
        sims = sorted(((-(v @ w) / (np.sqrt(v @ v) * np.sqrt(w @ w)), j) for j, w in rows.items() if j != i))
        out[i] = [j for _, j in sims[:k]]
    return out


def test_knn_recall_and_edges(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 8))
    rows = [(i, [float(x) for x in centres[i % 20] + 0.3 * r.normal(size=8)]) for i in range(1500)]
    odd = [(5000, None), (5001, [0.0] * 8), (5002, [1.0] * 7), (5003, [None] + [1.0] * 7), (5004, [float("nan")] + [1.0] * 7), rows[0], rows[0]]
    df = cluttered(spark.createDataFrame(rows + odd, "chunk_id long, embedding array<float>"))
    want = brute_neighbours(rows, 5)
    for cells in (8192, 64):  # a grid of cells must not change what is found
        got = {}
        for x in knn.most_similar(df, "chunk_id", "embedding", width=8, list_rows=64, cell_rows=cells).orderBy("id", "place").collect():
            got.setdefault(x["id"], []).append(x["other"])
        assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
        assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want]) > 0.95


def test_knn_copies_and_small_tables(spark):
    v = [[float(i == j) for j in range(8)] for i in range(8)]
    rows = [(i, v[0]) for i in range(100, 140)] + [(1, [1.0, 0.1] + [0.0] * 6), (2, [1.0, 0.2] + [0.0] * 6)] + [(10 + i, x) for i, x in enumerate(v[1:])]
    out = knn.most_similar(spark.createDataFrame(rows, "chunk_id long, embedding array<float>"), "chunk_id", "embedding", width=8)
    got = {}
    for x in out.orderBy("id", "place").collect():
        got.setdefault(x["id"], []).append(x["other"])
    assert got[139] == [100, 101, 102, 103, 104] and got[100] == [101, 102, 103, 104, 105]
    assert got[1][0] == 2 and got[1][1:] == [100, 101, 102, 103]
    few = spark.createDataFrame(rows[-2:], "chunk_id long, embedding array<float>")
    assert knn.most_similar(few, "chunk_id", "embedding", width=8).count() == 2
    assert knn.most_similar(few.limit(0), "chunk_id", "embedding", width=8).count() == 0


@pytest.mark.parametrize("k", [1, 2, 20, 700, 3000])
def test_centroid_graph_walk(k):
    r = np.random.default_rng(0)
    c = knn._unit(r.normal(size=(k, 8)))
    g = knn.CentroidGraph(c)
    x = knn._unit(c[:400] + 0.05 * r.normal(size=(len(c[:400]), 8)))
    ids, cos = g.search(x, 4)
    assert (ids[:, 0] == np.argmax(x @ c.T, 1)).mean() > 0.97 and ids.shape == cos.shape
    if k > 16:
        assert len(g.entry) < k  # the graph is used at every size


# --- 4


def jaccard_pairs(rows, n, t, least):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        if len(w) >= max(n, least):
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


@pytest.mark.parametrize("n,t,least", [(3, 0.5, 20), (5, 0.8, 1)])
def test_near_duplicates_equal_brute_force(spark, n, t, least):
    r = random.Random(5)
    rows = []
    for i in range(60):
        base = " ".join(sentence(r) for _ in range(r.randint(1, 6))).split()
        rows.append((10 * i, " ".join(base)))
        for k in range(r.randint(0, 4)):
            edited = base[:]
            for _ in range(r.randint(0, max(1, len(base) // 10))):
                edited[r.randrange(len(edited))] = r.choice(NAMES)
            rows.append((10 * i + 1 + k, " ".join(edited)))
    rows += [(2000, None), (2001, ""), (2002, "too short"), rows[0], rows[0], (2003, rows[5][1])]
    df = cluttered(spark.createDataFrame(rows, "chunk_id long, text string"))
    pairs, ids = neardup.similar_classes(df, "chunk_id", "text", n, t, least)
    named = {x["cls"]: set() for x in ids.collect()}
    for x in ids.collect():
        named[x["cls"]].add(x["id"])
    got = {tuple(sorted(p)) for x in pairs.collect() for p in itertools.product(named[x["cls_a"]], named[x["cls_b"]])}
    text = dict(rows)
    want = {p for p in jaccard_pairs(set(rows), n, t, least) if text[p[0]] != text[p[1]]}
    assert got == want
    none, _ = neardup.similar_classes(df.limit(0), "chunk_id", "text", n, t, least)
    assert none.count() == 0


@pytest.mark.parametrize("block", [20_000, 5])
def test_near_duplicates_of_few_words(spark, block, monkeypatch):
    """A vocabulary of four words ties many sequences to one word; hot bits are probed in blocks."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    r = random.Random(6)
    rows = []
    for i in range(60):
        base = [r.choice("abcd") for _ in range(60)]
        edited = base[:]
        edited[r.randrange(60)] = r.choice("abcd")
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited))]
    pairs, ids = neardup.similar_classes(spark.createDataFrame(rows, "chunk_id long, text string"), "chunk_id", "text")
    named = {x["cls"]: x["id"] for x in ids.collect()}
    text = dict(rows)
    got = {tuple(sorted((named[x["cls_a"]], named[x["cls_b"]]))) for x in pairs.collect()}
    assert got == {p for p in jaccard_pairs(rows, 5, 0.8, 1) if text[p[0]] != text[p[1]]}


def test_cheapest_units_are_the_programs_optimum():
    """Unequal thresholds by dynamic programming over partitions cost what the cheapest units in order cost."""
    r = random.Random(16)
    for _ in range(200):
        groups = [sorted(r.randint(0, 30) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 6))]
        bits = sorted(c for g in groups for c in g)
        units = r.randint(0, len(bits))
        best = {0: 0}
        for g in groups:  # r_g + 1 units of a partition cost its rarest bits
            best = {u: min(best[u - k] + sum(g[:k]) for k in range(len(g) + 1) if u - k in best) for u in range(units + 1) if any(u - k in best for k in range(len(g) + 1))}
        assert best[units] == sum(bits[:units])


def test_components(spark):
    r = random.Random(17)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(50)]
    root = {}
    for a, b in edges:
        for x in (a, b):
            root.setdefault(x, x)
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: y for x, y in root.items() if any(a != b and x in (a, b) for a, b in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_group_of_copies_is_a_star_beyond_the_limit(spark):
    members = spark.createDataFrame([(1, i, 6) for i in (1, 2, 3, 4, 5, 6)] + [(10, i, 2) for i in (10, 11)], "rep long, id long, n long")
    pairs = spark.createDataFrame([(1, 10)], "a long, b long")
    full = {tuple(x) for x in expand_pairs(pairs, members, "a", "b").collect()}
    assert len(full) == 15 + 1 + 12
    star = {tuple(x) for x in expand_pairs(pairs, members, "a", "b", class_limit=3).collect()}
    assert {(1, i) for i in range(2, 7)} | {(10, 11), (1, 10), (1, 11)} | {(i, 10) for i in range(2, 7)} == star


# --- 5


def test_pieces(spark):
    r = random.Random(7)
    long = "# Top\n\n" + "\n\n".join(("## Part %d\n\n" % k) + " ".join(sentence(r) for _ in range(6)) for k in range(8))
    rows = [(1, long, "Guide > Top"), (1, long, "Guide > Top"), (2, "x" * 7000, None), (3, "short", ""), (4, None, None), (5, "y" * 2000, ""), (6, "👩‍🔧" * 1200, ""), (7, "word " * 40_000, "A")]
    df = cluttered(spark.createDataFrame(rows, "chunk_id long, text string, heading_ancestry string"))
    got = {}
    for x in splitting.split_oversized(df).orderBy("chunk_id", "piece").collect():
        got.setdefault(x["chunk_id"], []).append(x)
    assert set(got) == {1, 2, 6, 7}
    texts = {i: t for i, t, _ in rows}
    for i, pieces in got.items():
        end = 0
        for p in pieces:
            assert len(p["text"]) == p["char_count"] <= 2000 and texts[i][p["start"] : p["start"] + p["char_count"]] == p["text"]
            assert p["start"] <= end and (p["piece"] == 0 or 150 <= end - p["start"] <= 300)
            end = p["start"] + p["char_count"]
        assert end == len(texts[i])
    assert got[1][0]["heading_ancestry"] == "Guide > Top" and all(p["heading_ancestry"].startswith("Guide > Top > Part") for p in got[1][1:])
    assert not any(p["text"].endswith("‍") for p in got[6])
    assert splitting.split_oversized(df.limit(0)).count() == 0


def test_an_edit_moves_neighbouring_cuts_only():
    r = random.Random(8)
    text = " ".join(sentence(r) for _ in range(400))
    a, b = set(splitting.cut_points(text, 2000, 285, 700, 250)), set(splitting.cut_points("new words. " + text, 2000, 285, 700, 250))
    assert len({x + 11 for x in a} & b) > 0.6 * len(a)


# --- 6


def test_leaks_equal_brute_force(spark):
    r = random.Random(9)
    items = [(i, sentence(r, 25)) for i in range(12)] + [(0, None), (20, ""), (21, "too short")]
    docs = [(i, " ".join(sentence(r) for _ in range(10))) for i in range(40)]
    for i in range(12):
        w = items[i][1].split()
        k = r.randint(0, 8)
        docs.append((100 + i, sentence(r) + "\n" + " -- ".join(w[k : k + 13 + i % 3]).upper() + " " + sentence(r)))
        docs.append((200 + i, sentence(r) + " " + " ".join(x if j % 9 else "zzz" for j, x in enumerate(w)) + " " + sentence(r)))
    docs += [(300, None), (301, ""), docs[45], docs[45]]
    d, e = cluttered(spark.createDataFrame(docs, "doc_id long, text string")), cluttered(spark.createDataFrame(items + items[:2], "item_id long, text string"))
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda t: {tuple(tok(t)[k : k + 13]) for k in range(len(tok(t)) - 12)}
    want = {(i, j) for i, t in docs for j, u in items if grams(t) & grams(u)}
    for block in (2_000_000, 100):
        rows = leakage.leaked_items(d, e, block_words=block).collect()
        assert {(x["doc_id"], x["item_id"]) for x in rows if x["run_words"] >= 13} == want
    edited = {(x["doc_id"], x["item_id"]) for x in rows if x["score"] >= 0.5}
    assert {(200 + i, i) for i in range(12)} <= edited
    assert leakage.leaked_items(d.limit(0), e).count() == 0 and leakage.leaked_items(d, e.limit(0)).count() == 0


# --- 7


def test_water_fill():
    assert mixing.water_fill({"a": 0.5, "b": 0.5}, {"a": 10, "b": 1000}, 100) == {"a": 10, "b": 90}
    assert mixing.water_fill({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 20, "c": 15}, 100) == {"a": 10, "b": 20, "c": 15}
    assert mixing.water_fill({"a": 0.0, "b": 1.0}, {"a": 10, "b": 200}, 100) == {"a": 0.0, "b": 100.0}
    assert mixing.water_fill({}, {}, 100) == {}


def test_mix(spark):
    pytest.importorskip("tiktoken")
    r = random.Random(11)
    docs = [(i, r.choice([" Big_Source", "big-source", "BIG source"]), sentence(r, r.randint(5, 40))) for i in range(300)] + [(1000 + i, "small", sentence(r, 20)) for i in range(10)]
    docs += [(2000, None, "x"), (2001, "small", None), (2002, "small", ""), (2003, "other", "y"), docs[0], docs[0]]
    targets = [("big-source", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2), (None, 0.3, 1)]
    d, t = cluttered(spark.createDataFrame(docs, "doc_id long, source string, text string")), cluttered(spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    chosen, report = mixing.mix(d, t)
    rows = chosen.collect()
    assert len({x["doc_id"] for x in rows}) == len(rows) and all(x["repeats"] <= (1 if x["source"] == "big-source" else 3) for x in rows)
    got = {x["source"]: x for x in report.collect()}
    assert set(got) == {"big-source", "small", "absent"} and got["absent"]["chosen_tokens"] == 0
    assert got["small"]["chosen_tokens"] == 3 * got["small"]["available_tokens"]
    assert abs(sum(x["actual_share"] for x in got.values()) - 1) < 1e-9
    again, half = mixing.mix(d, t, total_tokens=2000)
    assert sorted(map(tuple, mixing.mix(d, t, total_tokens=2000)[0].collect())) == sorted(map(tuple, again.collect()))
    shares = {x["source"]: x["actual_share"] for x in half.collect()}
    assert abs(shares["small"] - 0.44) < 0.06
    assert mixing.mix(d.limit(0), t)[0].count() == 0 and mixing.mix(d, t.limit(0))[1].count() == 0


# --- 8


def brute_runs(rows, n):
    seen = {}
    for i, t in rows:
        for k in range(len(t or "") - n + 1):
            seen.setdefault(t[k : k + n], set()).add(i)
    return {p for s in seen.values() for p in itertools.combinations(sorted(s), 2)}


@pytest.mark.parametrize("hot", [64, 2])
def test_spans_equal_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(spans, "HOT", hot)  # the way of hot keys must find the same
    r = random.Random(13)
    rows = [(i, " ".join(sentence(r) for _ in range(8))) for i in range(30)]
    for i in range(30):
        src = rows[r.randrange(30)][1]
        n = r.choice([280, 299, 300, 301, 340, 500])
        k = r.randrange(max(1, len(src) - n))
        rows.append((100 + i, sentence(r) + src[k : k + n] + "|" + sentence(r)))
    rows += [(200, "=" * 700), (201, "a" + "=" * 350), (202, None), (203, ""), rows[3], rows[3], (204, rows[4][1]), (205, "=" * 299)]
    df = cluttered(spark.createDataFrame(rows, "doc_id long, text string"))
    runs, members, _, sets = spans.shared_runs(df)
    got = {tuple(x) for x in expand_pairs(spans._pairs(runs, sets), members, "doc_a", "doc_b").collect()}
    assert got == brute_runs(set(rows), 300)
    text = dict(rows)
    for x in runs.collect():
        a, b, n = text[x["rep_a"]], text[x["rep_b"]], x["length"]
        assert a[x["start_a"] : x["start_a"] + n] == b[x["start_b"] : x["start_b"] + n] and n >= 300
    assert spans.shared_runs(df.limit(0))[0].count() == 0


def test_a_text_in_many_documents_stays_linear(spark, tmp_path):
    """2 000 documents with one licence of 400 characters, 2 000 with a phrase of 250: runs grow with the documents."""
    r = random.Random(18)
    licence, phrase = (" ".join(sentence(r) for _ in range(8))[:n] for n in (400, 250))
    rows = [(i, f"{sentence(r)} {licence if i % 2 else phrase} {sentence(r)} {sentence(r)}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs, _, _, sets = spans.shared_runs(df)
    found = runs.collect()
    # the words before and after make some ends of the run alike too, hence several sets a document; all pairs would be two million
    assert {x["rep_b"] for x in found} | {1} == {i for i in range(4000) if i % 2} and len(found) < 30 * 2000
    assert sets.count() < 30 * 2000
    df.write.parquet(f"{tmp_path}/documents.parquet")
    shares = {x["doc_id"]: x["shared_code_points"] for x in spans.p8_shares(spark, str(tmp_path)).collect()}
    assert all((shares[i] >= 400) == bool(i % 2) for i in range(4000))


def test_spans_and_classes_of_copies(spark, tmp_path):
    r = random.Random(15)
    a, b, c = (" ".join(sentence(r) for _ in range(6)) for _ in range(3))
    rows = [(3, a), (1, a), (7, a), (7, a), (2, b), (4, a[:310] + "#" + sentence(r)), (5, c), (6, c), (8, "z" * 20), (9, "z" * 20), (10, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(x) for x in spans.p8_spans(spark, str(tmp_path)).collect()}
    assert {(1, 3, 0, 0, len(a)), (1, 7, 0, 0, len(a)), (5, 6, 0, 0, len(c))} < got and {x[:2] for x in got} == {(1, 3), (1, 7), (5, 6), (1, 4)}
    classes = [tuple(x) for x in spans.p8_classes(spark, str(tmp_path)).collect()]
    assert sorted(classes) == [(1, 1, 3), (2, 2, 1), (3, 1, 3), (4, 4, 1), (5, 5, 2), (6, 5, 2), (7, 1, 3)]


def test_shares(spark, tmp_path):
    r = random.Random(14)
    a = " ".join(sentence(r) for _ in range(6))
    rows = [(1, a), (2, a[:310] + "#" + sentence(r)), (3, "z" * 20), (4, None), (5, a)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in spans.p8_shares(spark, str(tmp_path)).collect()}
    assert got[1]["shared_code_points"] == len(a) and got[5]["shared_share"] == 1.0
    assert got[2]["shared_code_points"] in (310, 311) and got[3]["shared_code_points"] == 0 and got[4]["n_code_points"] == 0
