"""Loops and formats against brute force on small fixtures."""

import itertools
import random

import pytest

from docuweave.operators import centrality as C
from docuweave.operators import retrieval as R
from docuweave.operators import topics as P
from docuweave.plans import model as M
from docuweave.plans import queries as Q
from docuweave.sources import graphs as S


def test_leaders_equal_the_scan(spark):
    rng = random.Random(5)
    pairs = [(i, j) for i, j in itertools.combinations(range(30), 2) if rng.random() < 0.12]
    want = {}
    for i in range(30):
        if i not in want:
            want[i] = i
            want |= {j: i for j in range(i + 1, 30) if j not in want and (i, j) in pairs}
    ids = spark.createDataFrame([(i,) for i in range(30)], "id long")
    got = {r["id"]: r["leader"] for r in C.leaders(ids, spark.createDataFrame(pairs, "i long, j long")).collect()}
    assert got == want


def test_betweenness(spark):
    rng = random.Random(2)
    n = 9
    edges = {(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < 0.25}

    def paths(s, t):
        front = [[s]]
        seen = {s}
        while front and not any(p[-1] == t for p in front):
            front = [[*p, b] for p in front for a, b in edges if a == p[-1] and b not in seen]
            seen |= {p[-1] for p in front}
        return [p for p in front if p[-1] == t]

    want = dict.fromkeys(range(n), 0.0)
    for s, t in itertools.permutations(range(n), 2):
        all_paths = paths(s, t)
        for p in all_paths:
            for v in p[1:-1]:
                want[v] += 1 / len(all_paths) / ((n - 1) * (n - 2))
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    got = {r["id"]: r["betweenness"] for r in C.betweenness(nodes, spark.createDataFrame(sorted(edges), "src long, dst long")).collect()}
    assert got == pytest.approx(want)


def test_betweenness_of_a_held_graph_equals_the_joins(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(C.held, "PACK", 40)
    monkeypatch.setattr(C.held, "SORTED", 30)
    chain = [(1000 + i, 1001 + i) for i in range(20)]
    for spread in (1, 10**15):  # ids side by side, and far apart
        rows = [(rng.randrange(60) * spread, rng.randrange(60) * spread) for _ in range(220)] + chain
        rows += rows[:30] + [(7 * spread, 7 * spread)]
        nodes = spark.createDataFrame([(x,) for x in sorted({v for e in rows for v in e} | {-5})], "id long")
        edges = spark.createDataFrame(rows, "src long, dst long")
        for sources in (None, nodes.where("id % 3 = 0")):
            got = {r["id"]: r["betweenness"] for r in C.betweenness(nodes, edges, sources).collect()}
            want = {r["id"]: r["betweenness"] for r in C.betweenness_joined(nodes, edges, sources).collect()}
            assert got == pytest.approx(want) and max(want.values()) > 0
    none = C.betweenness(nodes, edges.limit(0)).collect()
    assert {r["betweenness"] for r in none} == {0.0}


def test_betweenness_query_starts_from_all_nodes_and_shuffles_no_links(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [float(rng.choice([-1, 0, 1])) for _ in range(6)], i % 3) for i in range(70)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {r["id"]: r["betweenness"] for r in C.betweenness_joined(Q.nodes_emb(spark, str(tmp_path)), Q.pairs_emb(spark, str(tmp_path))).collect()}
    assert sum(x > 0 for x in want.values()) > 20
    plans = []
    deal = C.held.deal
    monkeypatch.setattr(C.held, "deal", lambda *a: plans.append(deal(*a)) or plans[-1])
    for single, row in ((20, 3000), (10**9, 0), (1, 10**9)):  # as it costs, whole rows, single links
        monkeypatch.setattr(C.held, "LINK", single)
        monkeypatch.setattr(C.held, "ROW", row)
        got = {r["id"]: r["betweenness"] for r in M.betweenness_centrality(spark, str(tmp_path)).collect()}
        assert got == pytest.approx(want, abs=1e-8)
    assert all(p.rdd.getNumPartitions() >= 4 for p in plans)  # a task for each core
    assert len(plans) == 3 and all("Exchange" not in p._jdf.queryExecution().executedPlan().toString() for p in plans)


def test_eigenvector_of_a_star(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id long")
    edges = spark.createDataFrame([(0, i) for i in range(1, 5)], "src long, dst long")
    got = {r["id"]: r["eigenvector"] for r in C.eigenvector(nodes, edges).collect()}
    assert got[0] == pytest.approx(2**-0.5, abs=1e-4)
    assert got[1] == pytest.approx(8**-0.5, abs=1e-4)


def test_expansion_compounds_decay_and_keeps_the_first_path(spark):
    edges = spark.createDataFrame([(1, 2, "uses", 0), (3, 1, "is_a", 1), (2, 4, None, 2), (4, 3, "x", 3), (4, 5, "x", 4)], "src long, dst long, relation string, ord long")
    seeds = spark.createDataFrame([(7, 1, 0.8, 1)], "query long, id long, sim double, rank int")
    got = {r["id"]: r for r in R.expand(seeds, edges).collect()}
    assert {k: r["hop"] for k, r in got.items()} == {1: 0, 2: 1, 3: 1, 4: 2}
    assert got[4]["sim"] == pytest.approx(0.8 * 0.7**3)
    assert [tuple(p) for p in got[4]["path"]] == [(1, "uses", 2), (2, "related_to", 4)]
    assert [tuple(p) for p in got[3]["path"]] == [(3, "is_a", 1)]


def test_best_rows_equal_the_whole_expansion(spark):
    rng = random.Random(5)
    pick = lambda: rng.randrange(80)
    vectors = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)], rng.choice([None, 0.5, 0.1]), rng.choice([None, 0.001])) for i in range(75)]  # few values, so ties
    rows = [(pick(), pick(), rng.choice(["uses", None]), rng.randrange(40)) for _ in range(260)] + [(3, 3, "x", 1)]
    nodes = spark.createDataFrame(vectors, "id long, vector array<double>, importance double, pagerank double")
    edges = spark.createDataFrame(rows, "src long, dst long, relation string, ord long")
    queries = spark.createDataFrame([(i, [1.0, 0.5 * i, -0.25]) for i in range(9)], "id long, vector array<double>")
    seeds = spark.createDataFrame([(q, i, 0.9 - 0.1 * r, r) for q in range(9) for r, i in enumerate(rng.sample(range(80), 1 + q % 4), 1)], "query long, id long, sim double, rank int")
    cols = ["query", "id", "hop", "sim", "key", "path", "score", "rank"]
    for hops, limit in ((1, 3), (2, 5), (2, 20), (3, 100)):
        best = lambda r: sorted(map(repr, R.score(r, queries, nodes, limit).select(cols).collect()))
        few = R.expand_best(seeds, edges, queries, nodes, hops, limit)
        whole = R.expand(seeds, edges, hops)
        assert best(few) == best(whole)
        assert limit > 5 or few.count() < whole.count()


def test_chains_list_relations_of_the_best_entities_only(spark, monkeypatch):
    rng = random.Random(9)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(3)], None, None, None) for i in range(60)]
    nodes = spark.createDataFrame(vectors, "id long, vector array<double>, importance double, pagerank double, description string")
    edges = spark.createDataFrame([(rng.randrange(60), rng.randrange(60), "uses", i) for i in range(200)], "src long, dst long, relation string, ord long")
    queries = spark.createDataFrame([(q, vectors[q][1]) for q in range(4)], "id long, vector array<double>")
    asked = []
    whole = R.neighbour_relations
    monkeypatch.setattr(R, "neighbour_relations", lambda *a: asked.append(a[2:]) or whole(*a))
    found = R.graph_retrieve(queries, nodes, edges, nodes)
    assert [len(x) for x in asked] == [1, 0]  # chains ask for some rows; all are listed only for who reads them
    listed = R.chains_of(found["entities"], whole(R.expand(found["seeds"], edges, 2), edges))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(found["chains"]) == rows(listed) and rows(listed)
    assert found["relations"].count() > 10 * len(rows(listed)) / 3
    assert R.answer_context(found).count() == 4


def test_chains_of_a_held_graph_equal_those_of_the_whole_expansion(spark, monkeypatch):
    rng = random.Random(12)
    pick = lambda: rng.choice([0, 1, 2, rng.randrange(50)])  # noqa: E731  # three nodes of many edges
    rows = [(pick(), pick(), rng.choice(["uses", "has", None]), i) for i in range(240)]
    rng.shuffle(rows)
    edges = spark.createDataFrame(rows, "src long, dst long, relation string, ord long")
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(3)], None, None, None) for i in range(50)]
    nodes = spark.createDataFrame(vectors, "id long, vector array<double>, importance double, pagerank double, description string")
    queries = spark.createDataFrame([(q, vectors[q][1]) for q in range(6)], "id long, vector array<double>")
    whole, ways = R.expand, []
    rows = lambda df: sorted(map(tuple, df.collect()))
    monkeypatch.setattr(R, "expand", lambda *a, **k: ways.append(k) or whole(*a, **k))
    for first, hops in ((1, 2), (2, 1), (8, 3)):
        monkeypatch.setattr(R, "FIRST", first)
        ways.clear()
        found = R.graph_retrieve(queries, nodes, edges, nodes, hops)
        assert len(ways) == 1 and "keep" in ways[0]  # nothing is expanded as a whole, but for who reads all relations
        reached = whole(found["seeds"], edges, hops)
        want = rows(R.chains_of(found["entities"], R.neighbour_relations(reached, edges)))
        assert rows(found["chains"]) == want and len(want) > 40
    assert rows(found["relations"]) == rows(R.neighbour_relations(reached, edges))


def test_steps_are_joined_to_sieved_edges_of_a_packed_checkpoint(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    all_ = {(r["src"], r["dst"]) for r in Q.pairs_emb(spark, str(tmp_path)).collect()}
    assert {tuple(r) for r in R.held.kept(Q.pairs_emb(spark, str(tmp_path))).collect()} == all_
    sieved, sieve = [], R.held.sieve
    monkeypatch.setattr(R.held, "sieve", lambda *a: sieved.append((sieve(*a), a[1])) or sieved[-1][0])
    monkeypatch.setattr(Q, "edges_emb", None)  # no edges as rows on the disk
    assert Q.QUERIES["retrieve_graph"](spark, str(tmp_path)).count() == 20 * 15
    kept, wanted = ({(r["_x"], r["_y"]) for r in df.collect()} for df in sieved[0])
    assert wanted <= kept <= all_ and len(kept) < len(wanted) + 0.2 * len(all_ - wanted) and len(wanted) < len(all_)


def test_tree_and_its_retrieval(spark):
    vectors = [[1.0, 0.02 * i] if i < 4 else [0.02 * i, 1.0] for i in range(8)]
    topics = spark.createDataFrame([(f"t{i}", f"name {i}", v, 2) for i, v in enumerate(vectors)], "id string, name string, vector array<double>, size long")
    tree = P.build_tree(topics).persist()
    rows = {r["id"]: r for r in tree.collect()}
    assert [sum(r["level"] == k for r in rows.values()) for k in range(4)] == [8, 4, 2, 1]
    assert rows["root"]["size"] == 16 and rows["root"]["parent"] is None
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, -1.0])], "id long, vector array<double>")
    walked = R.traverse(asked, tree).collect()
    assert {r["query"] for r in walked} == {1}
    assert any(r["id"] in ("t0", "t1", "t2", "t3") for r in walked)
    assert R.collapsed(asked, tree).where("query = 1").count() == 8  # four leaves, two parents, one above, the root
    between = spark.createDataFrame([(3, [1.0, 1.0])], "id long, vector array<double>")  # the root fits best; the best leaf has 0.75
    got = R.adaptive(asked.unionByName(between), tree, sure=0.8).collect()
    assert {(r["query"], r["mode"]) for r in got} == {(1, "narrow"), (3, "broad")}  # 2: the leaves fit best, but the root fails
    assert [r["id"] for r in got if r["query"] == 3] == ["root"]


def test_graph_formats(spark, tmp_path):
    nodes = spark.createDataFrame([("a & b", "method", ["d1", "d2"], 2), ("c", None, [], 1)], "id string, type string, documents array<string>, mentions long")
    edges = spark.createDataFrame([("a & b", "c", ["uses", "is_a"], 0.5)], "src string, dst string, relations array<string>, confidence double")
    text = "\n".join(r["line"] for r in S.graphml_lines(nodes, edges).orderBy("part").collect())
    path = tmp_path / "g.graphml"
    path.write_text(text)
    n, e = S.read_graphml(spark, str(path))
    got = {r["id"]: r["attributes"] for r in n.collect()}
    assert got["a & b"]["documents"] == "d1,d2" and got["a & b"]["mentions"] == "2" and "type" not in got["c"]
    assert [(r["src"], r["dst"], r["attributes"]["relations"]) for r in e.collect()] == [("a & b", "c", "uses,is_a")]
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "x", "type": "a"}, {"id": "x", "type": "b"}], "edges": [{"source": "x", "target": "x", "relations": ["r1", "r2"]}, {"source": "x", "target": "y", "relations": []}]}')
    n, e = S.read_graph_json(spark, S.first_existing(spark, str(tmp_path / "none.json"), str(tmp_path / "g.json")))
    assert [(r["id"], r["type"]) for r in n.collect()] == [("x", "b")]
    assert {(r["dst"], r["relation"]) for r in S.with_relation(e).collect()} == {("x", "r1"), ("y", "related_to")}


def test_pagerank_reaches_its_tolerance_and_k_hop_its_query_set(spark):
    from docuweave.operators import graph
    from docuweave.plans import queries

    sf = "/root/testdata/sf0.001"
    ids = [r["id"] for r in queries.nodes_emb(spark, sf).select("id").collect()]
    edges = {(r["src"], r["dst"]) for r in queries.edges_emb(spark, sf).collect()}

    def brute(ids, edges, tolerance=1e-6):
        out = {i: [b for a, b in edges if a == i] for i in ids}
        rank, n = dict.fromkeys(ids, 1 / len(ids)), len(ids)
        for k in range(100):
            new = dict.fromkeys(ids, 0.15 / n + 0.85 * sum(rank[i] for i in ids if not out[i]) / n)
            for i in ids:
                for j in out[i]:
                    new[j] += 0.85 * rank[i] / len(out[i])
            change, rank = sum(abs(new[i] - rank[i]) for i in ids), new
            if change < n * tolerance:
                return rank, k + 1
        raise AssertionError

    got = {r["id"]: r["pagerank"] for r in queries.pagerank(spark, sf).collect()}
    want, _ = brute(ids, edges)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-9 for i in want)
    ring = {(0, 1), (1, 2), (2, 0), (2, 3), (3, 2), (4, 0)}
    want, rounds = brute(range(5), ring)
    nodes, links = spark.createDataFrame([(i,) for i in range(5)], "id long"), spark.createDataFrame(list(ring), "src long, dst long")
    got = {r["id"]: r["pagerank"] for r in graph.pagerank(nodes, links, 100, tolerance=1e-6).collect()}
    assert rounds > 20 and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    near = {i: set() for i in ids}
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    hop = {i: 0 for i in ids if i % 20 == 0}
    for h in (1, 2):
        hop |= dict.fromkeys({j for i, g in hop.items() if g == h - 1 for j in near[i]} - hop.keys(), h)
    assert {r["id"]: r["hop"] for r in queries.k_hop(spark, sf).collect()} == hop
