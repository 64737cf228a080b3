"""Queries that once left out part of their job, against plain Python."""

import re
from itertools import combinations

import pyarrow as pa
import pyarrow.parquet as pq

from folioforge.plans.catalogue import QUERIES


def _rows(spark, name, sf):
    return [tuple(r) for r in QUERIES[name][0](spark, str(sf)).collect()]


def _pages(tmp_path, links):
    html = ["<title>t</title>" + "".join(f'<a href="{h}">x</a>' for h in hrefs) for hrefs in links.values()]
    table = pa.table({"page_id": pa.array(links, pa.int64()), "url": ["http://a.b/c"] * len(links), "html": html})
    pq.write_table(table, tmp_path / "pages.parquet")
    return tmp_path


def _groups(links):
    out = {}
    for page, hrefs in sorted(links.items()):
        for h in dict.fromkeys(hrefs):
            out.setdefault(h, []).append(page)
    return out


def _communities(links):
    root = {p: p for p in links}
    for pages in _groups(links).values():
        merged = {root[p] for p in pages}
        root = {p: min(merged) if r in merged else r for p, r in root.items()}
    place = {r: i for i, r in enumerate(sorted(set(root.values())))}
    return sorted((p, place[r]) for p, r in root.items())


def _check_hrefs(spark, sf, links):
    shared, merged = {}, {}
    for h, pages in _groups(links).items():
        for pair in combinations(pages[:4], 2):
            shared[pair] = shared.get(pair, 0) + 1
            merged.setdefault(pair, []).extend([h] if len(h) % 2 else [h, "~" + h])
    degree = {}
    for pair in shared:
        for p in pair:
            degree[p] = degree.get(p, 0) + 1
    assert sorted(_rows(spark, "shared_href_edges", sf)) == sorted((a, b, n, 3 * n) for (a, b), n in shared.items())
    assert sorted(_rows(spark, "edge_merge", sf)) == sorted((a, b, 3 * len(r), len(set(r))) for (a, b), r in merged.items())
    assert sorted(_rows(spark, "node_degree", sf)) == sorted(degree.items())
    assert sorted(_rows(spark, "graph_components", sf)) == _communities(links)
    return shared


def test_href_edges_of_large_groups(spark, tmp_path):
    # /all is on seven pages, /two on two, /five on five others, 30 stands alone.
    links = {i: ["/all"] for i in range(1, 8)} | {20 + i: ["/five", "/five"] for i in range(5)} | {7: ["/all", "/two"], 8: ["/two"], 30: ["/own"]}
    shared = _check_hrefs(spark, _pages(tmp_path, links), links)
    assert len(shared) == 13 and (5, 6) not in shared
    assert dict(_communities(links)) == {i: 0 for i in range(1, 9)} | {20 + i: 1 for i in range(5)} | {30: 2}


def test_href_edges_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    links = {r.page_id: re.findall(r'(?i)href="([^"]*)"', r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert max(map(len, _groups(links).values())) > 4
    _check_hrefs(spark, sf, links)


def test_pages_by_section_gives_three_hundred_each(spark, tmp_path):
    sizes = {"a": 305, "b": 40, "c": 1}
    source = [s for s, n in sizes.items() for _ in range(n)]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(source)), pa.int64()), "source": source}), tmp_path / "documents.parquet")
    want = []
    for s in sizes:
        ids = sorted((i for i, x in enumerate(source) if x == s), key=str)
        want += [("p" + s, i, place) for place, i in enumerate(ids[:300], 1)]
    assert sorted(_rows(spark, "pages_by_section", tmp_path)) == sorted(want) and len(want) == 341
