"""Build, enhancement, communities, plug-ins and files on small fixtures, with nulls, empty tables and single members."""

import json
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docuweave import plugins
from docuweave.functions import text as T
from docuweave.operators import build as B
from docuweave.operators import community as K
from docuweave.operators import evaluation as E
from docuweave.operators import graph as G
from docuweave.operators import retrieval as R
from docuweave.operators import views as W
from docuweave.sources import documents as D
from docuweave.sources import graphs as S


def test_relation_types_look_at_the_target(spark):
    types = spark.createDataFrame([(1, "Person"), (2, "concept"), (3, "component"), (4, "model"), (5, "dataset"), (6, None)], "id long, type string")
    edges = spark.createDataFrame([(1, 2, None, ["x"]), (2, 1, None, []), (3, 2, "related_to", []), (2, 3, "semantically_related", []), (4, 5, None, []), (4, 6, "semantically_related", []), (4, 5, "cites", [])], "src long, dst long, relation string, relations array<string>")
    got = [tuple(r) for r in G.relation_types(edges, types).select("src", "dst", "relation").collect()]
    assert sorted(got) == sorted([(1, 2, "related_to"), (2, 1, "authored_by"), (3, 2, "related_to"), (2, 3, "part_of"), (4, 5, "trained_on"), (4, 6, "semantically_related"), (4, 5, "cites")])
    loose = {(r["src"], r["dst"]): r["relation"] for r in G.relation_types(edges, types, strict_reference=False).collect()}
    assert loose[1, 2] == "x"


def test_empty_single_and_weightless(spark):
    nodes, edges = spark.createDataFrame([], "id long"), spark.createDataFrame([], "src long, dst long, weight double")
    assert G.pagerank(nodes, edges).collect() == []
    three = spark.createDataFrame([(1, 0), (2, 0), (3, -1)], "id long, cluster long")
    assert G.modularity(edges, three).first()[0] == 0
    none = spark.createDataFrame([(1, 2, 0.0)], "src long, dst long, weight double")
    assert G.modularity(none, three).first()[0] == 0
    both = spark.createDataFrame([(1, 2, 1.0), (2, 1, 5.0), (2, 3, 1.0)], "src long, dst long, weight double")
    assert G.modularity(both, three, noise=False).first()[0] == pytest.approx(0.0)
    lost = G.pagerank(three.select("id"), spark.createDataFrame([(1, 2), (2, 9)], "src long, dst long"))
    assert sum(r["pagerank"] for r in lost.collect()) == pytest.approx(1)
    members = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 1, [2.0, 0.0]), ("b", 2, [0.0, 3.0]), ("b", 11, [1.0, 1.0])], "topic string, rank int, vector array<double>")
    assert [tuple(r) for r in E.topic_coherence(members).collect()] == [("b", pytest.approx(0))]
    assert E.topic_coherence(members.limit(0)).collect() == []


def test_louvain_finds_cliques(spark):
    rows = [(c * 4 + i, c * 4 + j) for c in range(3) for i in range(4) for j in range(i)] + [(0, 4), (4, 8)]
    got = {r["id"]: r["cluster"] for r in K.louvain(spark.range(14), spark.createDataFrame(rows, "src long, dst long"), rounds=4, levels=1).collect()}
    assert len({got[i] for i in range(12)}) == 3 and all(got[4 * c] == got[4 * c + k] for c in range(3) for k in range(4)) and got[12] == got[13] == -1


def test_fuzzy_ratio_and_embedder(spark):
    def lcs(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    pairs = [("transformer", "transformers"), ("bert", "gpt"), ("", ""), ("", "a"), (None, "a"), ("abc", "abc")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", B.fuzzy_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r["r"] for r in got] == [round(200 * lcs(a or "", b) / len((a or "") + b)) if (a or "") + b else 100 for a, b in pairs]
    known = spark.createDataFrame([("Transformer", "m", 0), ("transformers", "m", 1), ("transformer", "x", 2)], "name string, type string, ord long")
    found = B.resolve_fuzzy(spark.createDataFrame([("TRANSFORMER", "m"), ("zzz", "m")], "name string, type string"), known)
    assert {(r["name"], r["canonical"]) for r in found.collect()} == {("TRANSFORMER", "Transformer"), ("zzz", "zzz")}

    def brute(t, size=16):
        out = np.zeros(size)
        for w in (t or "").lower().split():
            for g in [w, *("#" + w[i : i + 3] for i in range(len(w) - 2))]:
                out[xxhash.xxh64_intdigest(g.encode(), seed=42) % size] += 1
        return out / (np.linalg.norm(out) or 1)

    texts = ["one two three", "A bc", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(plugins.hash_embedder(F.col("t"), 16).alias("v")).collect()
    for t, r in zip(texts, rows, strict=True):
        assert r["v"] == pytest.approx(brute(t))


def test_fuzzy_resolution_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aabBc") for _ in range(rng.choice([1, 4, 6, 7, 8, 9, 10, 12, 13, 14, 15, 16, 20, 30])))
    known = [(word(), rng.choice("xy"), i) for i in range(60)] + [("", "x", 60)]
    edit = lambda w: "".join(rng.choice(["", c + c, c.upper(), c, c, c, c, c, c]) for c in w)
    names = [(edit(rng.choice(known)[0]), rng.choice("xy")) for _ in range(150)] + [(word(), "x") for _ in range(30)] + [("", "x"), (None, "x")]

    def want(name, kind, threshold):
        found = []
        for other, t, at in known:
            a, b = (name or "").lower(), other.lower()
            r = round(200 * B._lcs(a, b) / (len(a) + len(b))) if a or b else 100
            if name is not None and t == kind and r >= threshold:
                found.append((-r, at, other))
        return (min(found)[2], -min(found)[0]) if found else (name, None)

    made = []
    monkeypatch.setattr(B, "fuzzy_ratio", lambda a, b, f=B.fuzzy_ratio: made.append(1) or f(a, b))
    ours, theirs = spark.createDataFrame(names, "name string, type string"), spark.createDataFrame(known, "name string, type string, ord long")
    for threshold in (85, 93):
        got = [tuple(r) for r in B.resolve_fuzzy(ours, theirs, threshold).collect()]
        key = lambda r: tuple(map(str, r))
        assert sorted(got, key=key) == sorted(((n, *want(n, t, threshold)) for n, t in set(names)), key=key)
    assert B.short_length(85) == 14 and sum(w == 1 for w in made) == 4  # only pairs with a long name are compared sign by sign


def test_replies(spark):
    reply = "a:1, b:c:2, none, c:x, d:-1"
    row = spark.createDataFrame([(reply, "Uses|0.9\nodd|\nextends")], "a string, b string").select(T.name_numbers(F.col("a")).alias("n"), T.type_lines(F.col("b")).alias("t")).first()
    assert [(x["name"], x["number"]) for x in row["n"]] == [("a", 1), ("b:c", 2), ("d", -1)]
    assert [(x["type"], x["confidence"]) for x in row["t"]] == [("uses", 0.9), ("odd", 0.7), ("extends", 0.7)]
    edges = spark.createDataFrame([(1, 2, "related_to", None, 0), (1, 3, None, 0.2, 1), (1, 4, "related_to", None, 2), (1, 5, "uses", None, None)], "src long, dst long, relation string, confidence double, ord long")
    out = plugins.typed_by_reply(edges, spark.createDataFrame([(0, "uses|0.5\nwrong|0.9"), (1, None)], "batch long, reply string"), batch=2)
    assert {(r["dst"], r["relation"], r["confidence"]) for r in out.collect()} == {(2, "uses", 0.5), (3, None, 0.2), (4, "related_to", 0.3)}
    got = spark.createDataFrame([('{"entities": [{"name": "x"}]}',), ("no json",), (None,)], "j string").select(plugins.parsed(F.col("j")).alias("p")).collect()
    assert [len(r["p"]["entities"]) for r in got] == [1, 0, 0] and got[1]["p"]["topics"] == []
    assert plugins.valid_key("k") and not plugins.valid_key(" ") and not plugins.valid_key(None)


def test_context_and_listed_relations(spark):
    edges = spark.createDataFrame([(1, 2, "uses", 0), (3, 1, "is_a", 1), (1, 4, None, 2), (2, 4, "x", 3), (1, 1, "y", 4)], "src long, dst long, relation string, ord long")
    seeds = spark.createDataFrame([(9, 1, 0.9, 1)], "query long, id long, sim double, rank int")
    reached = R.expand(seeds, edges, 1)
    listed = R.neighbour_relations(reached, edges)
    assert {(r["id"], r["way"], r["other"], r["relation"]) for r in listed.collect()} == {(1, "out", 2, "uses"), (1, "out", 4, "related_to"), (1, "in", 3, "is_a"), (2, "out", 4, "x")}
    best = spark.createDataFrame([(9, 1, 1, 0.5), (9, 2, 2, 0.25)], "query long, id long, rank int, score double")
    nodes = spark.createDataFrame([(1, "first"), (2, None)], "id long, description string")
    text = R.context(best, R.chains_of(best, listed), nodes).first()["text"]
    assert text == "## Retrieved Knowledge Context\n\n### Key Entities (ranked by relevance)\n1. **1** (score: 0.50)\n   - first\n2. **2** (score: 0.25)\n\n### Relationships\n- 1 → *uses* → 2\n- 1 → *related_to* → 4\n- 2 → *x* → 4"
    tree = spark.createDataFrame([("a", "A", ["e1", "e2"], 0)], "id string, name string, key_entities array<string>, ord int")
    path = spark.createDataFrame([(9, 0, "a", 0, 0.5)], "query long, step int, id string, level int, sim double")
    asked = spark.createDataFrame([(9, "why"), (8, "how")], "id long, asked string")
    summary = R.traversal_summary(path, asked, tree)
    said = {r["query"]: r["text"] for r in R.explain(path, summary, tree, asked.withColumnRenamed("id", "query")).collect()}
    assert said[8] == "No traversal path available." and said[9] == 'Query: "why"\n\nRetrieval Path:\n  Level 0: A (similarity: 0.50)\n\nRetrieved 2 entities from 1 topics\nAverage similarity: 0.50'


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"page one|page two")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.PDF").write_bytes(b"x")

    def pages(data):
        if data == b"bad":
            raise ValueError("no pages")
        return data.decode().split("|")

    files = D.read_files(spark, str(tmp_path))
    assert sorted(r["filename"] for r in files.collect()) == ["a.pdf", "b.pdf"]
    read = {r["filename"]: (r["t"], r["t_error"]) for r in D.page_text(files, pages, "t").collect()}
    assert read == {"a.pdf": ("page one\n\npage two\n\n", None), "b.pdf": ("", "ValueError: no pages")}
    got = D.extract(files, pages, lambda data: ["long " * 50], describe=lambda data: {"title": "T"}).collect()
    assert {r["filename"]: r["text"] for r in got} == {"a.pdf": ("long " * 50).strip(), "b.pdf": ("long " * 50).strip()}
    assert got[0]["metadata"]["title"] == "T" and got[0]["metadata"]["author"] == "Unknown" and got[0]["metadata"]["num_pages"] == 0
    nodes = spark.createDataFrame([("x & y", "m", ["d1", "d2"], 2), ("z", None, [], 1)], "id string, type string, documents array<string>, mentions long")
    edges = spark.createDataFrame([("x & y", "z", ["uses"], 1, 0.5)], "src string, dst string, relations array<string>, mentions long, confidence double")
    lines = [r["line"] for r in S.gml_lines(nodes, edges).orderBy("part", "ord").collect()]
    assert lines[0] == "graph [\n  directed 1" and lines[-1] == "]" and "  edge [\n    source 0\n    target 1\n" in lines[3] and 'label "x &amp; y"' in lines[1]
    doc = tmp_path / "g.json"
    doc.write_text(S.graph_document(nodes, edges).first()["json"])
    n, e = S.read_graph_json(spark, str(doc))
    assert {r["id"] for r in n.collect()} == {"x & y", "z"} and e.first()["confidence"] == 0.5 and json.loads(doc.read_text())["statistics"]["num_edges"] == 1
    (tmp_path / "e.txt").write_text("# head\na b {'w': 1}\nthe name c {}\n")
    assert [tuple(r) for r in S.read_edge_list(spark, str(tmp_path / "e.txt")).collect()] == [("a", "b", "{'w': 1}"), (None, None, "{}")]
    tree = spark.createDataFrame([("l1", 0, "r", 0, "leaf", "A", "", 1), ("l2", 0, "r", 1, "leaf", "B", "", 2), ("r", 1, None, 2, "root", "R", "s", 3)], "id string, level int, parent string, ord int, kind string, name string, summary string, size long")
    top = json.loads(S.tree_document(tree).where("id = 'r'").first()["json"])
    assert [c["name"] for c in top["children"]] == ["A", "B"] and top["children"][0]["children"] == []
    assert {r["id"]: r["value"] for r in W.sunburst(tree).collect()} == {"l1": 1, "l2": 2, "r": 6}
    assert W.sunburst(tree.limit(0)).collect() == []
