import pytest
from pyspark.sql import functions as F

from tarnweave.operators import graph
from tarnweave.operators.pagerank import pagerank, rank_report, top_ranks
from tarnweave.sources import files

FOUR_A = [(0, 1), (0, 2), (1, 2), (2, 0), (2, 3), (3, 0)]
FOUR_B = [(0, 1), (0, 2), (1, 0), (2, 0), (2, 3), (3, 2)]
GAPS = [(0, 1), (0, 1), (0, 3), (1, 0), (4, 4)]


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def ranks(result):
    return [r["rank"] for r in result.ranks.orderBy("id").collect()]


def test_cycle(spark):
    out = pagerank(edges(spark, [(0, 1), (1, 2), (2, 0)]))
    assert ranks(out) == pytest.approx([1 / 3] * 3, abs=1e-10)
    assert out.iterations == 1


@pytest.mark.parametrize("rows", [FOUR_A, FOUR_B])
def test_four_nodes(spark, rows):
    assert ranks(pagerank(edges(spark, rows))) == pytest.approx([0.3245614030, 0.1754385970, 0.3245614030, 0.1754385970], abs=5e-9)


def test_gaps_multi_edges_and_loops(spark):
    got = ranks(pagerank(edges(spark, GAPS)))
    assert got == pytest.approx([0.2193748221, 0.1857768763, 0.0614644761, 0.1236206762, 0.4097631494], abs=5e-8)
    assert sum(got) == pytest.approx(1.0)


def test_hand_made_dialect(spark):
    e = edges(spark, [(0, 1), (0, 2), (1, 2)])
    leak = pagerank(e, tol=1e-4, norm="linf", dangling="leak", normalize=False)
    assert ranks(leak) == pytest.approx([0.05, 0.07125, 0.1318125], abs=1e-9)
    assert leak.iterations == 4
    spread = pagerank(e, tol=1e-4, norm="linf", normalize=False)
    assert ranks(spread) == pytest.approx([0.1975705855, 0.2815730186, 0.5208563959], abs=1e-9)
    assert spread.iterations == 8


def test_doubling_every_edge_changes_nothing(spark):
    once, twice = (ranks(pagerank(edges(spark, rows), max_iter=8, tol=0.0)) for rows in (FOUR_A, FOUR_A * 2))
    assert once == pytest.approx(twice)


def test_edge_cases(spark):
    assert pagerank(edges(spark, [])).ranks.count() == 0
    with pytest.raises(ValueError):
        pagerank(edges(spark, [(-1, 0)]))
    assert pagerank(edges(spark, [(0, None), (0, 1)]), max_iter=3).ranks.count() == 2


def test_report_round_trip(spark, tmp_path):
    e = edges(spark, FOUR_A)
    r = pagerank(e).ranks
    rank_report(e, r, 3).write.text(str(tmp_path / "report"))
    read = files.read_report(spark, str(tmp_path / "report"), anchored=True)
    assert sorted((x.id, round(x.score, 6)) for x in read.collect()) == sorted((x.id, round(x["rank"], 6)) for x in top_ranks(r, 3).collect())


def test_prefix_sum_and_summary(spark):
    e = edges(spark, GAPS)
    rows = {r.id: (r.in_degree, r.row_offset) for r in graph.in_degree_prefix_sum(e, 5, blocks=2).collect()}
    assert rows == {0: (1, 0), 1: (2, 1), 2: (0, 3), 3: (1, 3), 4: (1, 4)}
    assert graph.summary(e).first().asDict() == {"nodes": 5, "edges": 5, "dangling": 2}


def test_random_graph(spark):
    for n, m in ((10, 90), (50, 60)):
        rows = graph.random_graph(spark, n, m, 3).collect()
        assert len({tuple(r) for r in rows}) == m == len(rows)
        assert all(r.src != r.dst and 0 <= r.src < n and 0 <= r.dst < n for r in rows)
    with pytest.raises(ValueError):
        graph.random_graph(spark, 3, 7)


def test_editing(spark):
    nodes = spark.createDataFrame([("0", "a"), ("1", "b")], "id string, name string")
    assert {r.id for r in graph.add_node(nodes, " c ").collect()} == {"0", "1", "2"}
    assert graph.add_node(nodes, "  ").count() == 2
    e = graph.add_edge(graph.add_edge(spark.createDataFrame([], "src string, dst string"), "0", "1"), "0", "1")
    assert e.count() == 2
    assert graph.add_edge(e, "0", "0").count() == 2
    assert graph.remove_edge(e, "0", "1").count() == 0
    left, kept = graph.remove_node(nodes, e, "1")
    assert (left.count(), kept.count()) == (1, 0)
    shown = graph.labelled(spark.createDataFrame([("0", 0.5), ("7", None)], "id string, rank double"), nodes)
    assert {tuple(r) for r in shown.collect()} == {("0", "a", 0.5, 210.0), ("7", "Node 7", 0.0, 10.0)}
    assert graph.adjacency_rows(nodes, e).orderBy("src").first()["row"] == [0, 1]


def test_edge_files(spark, tmp_path):
    from tarnweave.sources import sinks

    sinks.write_edges(edges(spark, [(0, 1), (0, 1), (2, None)]), str(tmp_path / "e"), dedup=True)
    assert [tuple(r) for r in files.read_edges(spark, str(tmp_path / "e")).collect()] == [(0, 1)]
    (tmp_path / "bad.txt").write_text("0 1\n\n0,1\n-1 2\n 3\t4 \n")
    path = str(tmp_path / "bad.txt")
    assert [tuple(r) for r in files.read_edges(spark, path, "skip").collect()] == [(0, 1), (3, 4)]
    assert {r.bad for r in files.read_bad_edges(spark, path).collect()} == {"0,1", "-1 2"}
    with pytest.raises(Exception, match="not an edge"):
        files.read_edges(spark, path).collect()
    assert files.read_pagerank(spark, str(tmp_path / "none.json")).count() == 0
