import base64
import gzip
import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import embedding, oracles, queries, warc


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    rows = [(i, f"http://h{i % 7}.example.com/p/{i}?q={i}", f"<html>{i % 40}</html>") for i in range(100)]
    rows += [(200, None, None), (201, "https://www.Example.org:8080/a b#x", ""), (202, "no url", "é"), (203, "http://h1.example.com/p/1?q=1", "again"), (None, "http://null.example/", "<html>3</html>"), (5, "http://h5.example.com/p/5?q=5", "another row of page 5")]
    folder = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("x")).repartition(3).write.parquet(f"{folder}/pages.parquet")
    return folder, rows


def test_op3(spark, pages):
    folder, rows = pages
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    found = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in queries.queries()["op3_warc"](spark, folder).collect())
    wanted = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = first[h or ""] != i
        wanted.append((str(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert found == sorted(wanted)


def test_op3_sql(spark, pages):
    import duckdb

    folder, rows = pages
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    wanted = Counter(db.execute(f"SELECT {', '.join(columns)} FROM ({oracles.SQL['op3_warc']})").fetchall())
    assert wanted == Counter(tuple(r[c] for c in columns) for r in queries.queries()["op3_warc"](spark, folder).collect())


def test_lookup_and_files(spark, pages, tmp_path):
    folder, rows = pages
    archives = warc.write(spark.read.parquet(f"{folder}/pages.parquet"), file_bytes=2000)
    blocks = warc.index(archives)
    asked = spark.createDataFrame([("http://h1.example.com/p/1?q=1",), ("http://H3.example.com/p/3?q=3#frag",), ("http://none.example.com/",)], "url string")
    found = warc.lookup(asked, blocks)
    assert sorted((r["key"], r["page_id"]) for r in found.collect()) == [("com,example,h1)/p/1?q=1", 1), ("com,example,h1)/p/1?q=1", 203), ("com,example,h3)/p/3?q=3", 3)]
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read(found, archives).collect() if r["payload"] is not None}
    assert got[203] == b"again" and got[1] == b"<html>1</html>"
    names = warc.export(archives, str(tmp_path))
    assert len(names) > 3
    records = sum(gzip.open(tmp_path / n).read().count(b"WARC/1.1\r\n") for n in names)
    assert records == len(rows)


def test_op3_searches_the_directory(spark, pages, monkeypatch):
    """op3 finds its captures by the sparse directory; here over blocks of two lines, and each capture once."""
    folder, rows = pages
    asked, index, search = [], warc.index, warc.search
    monkeypatch.setattr(warc, "index", lambda archives: index(archives, 2))
    monkeypatch.setattr(warc, "search", lambda keys, blocks: (asked.append(blocks.count()), search(keys, blocks))[1])
    found = queries.queries()["op3_warc"](spark, folder).collect()
    assert asked and asked[0] >= len(rows) / 2
    # the key of "no url" and of a null are found as well; URLs of one key don't multiply its captures
    assert Counter((r["page_id"], r["url"]) for r in found) == Counter((i, u) for i, u, _ in rows)


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_search_by_runs_of_blocks(spark, pages, monkeypatch, most):
    """The same captures whatever the length of the sparse directory."""
    archives = warc.write(spark.read.parquet(f"{pages[0]}/pages.parquet"))
    blocks = warc.index(archives, 2)
    monkeypatch.setattr(warc, "DIRECTORY_ROWS", most)
    keys = warc.keyed(spark.createDataFrame([(u,) for _, u, _ in pages[1][::3]] + [("http://none.example.com/",)], "url string"))
    wanted = {r["key"] for r in keys.collect()}
    found = Counter((r["key"], r["page_id"]) for r in warc.search(keys, blocks).collect())
    assert found == Counter((r["key"], r["page_id"]) for r in warc.captures(blocks).collect() if r["key"] in wanted) and found


def test_surt():
    assert warc.surt("http://www.A.b.com/x?y#z") == "com,b,a)/x?y"
    assert warc.surt("https://u:p@a.com:443") == "com,a)/"
    assert warc.surt("http://a.com:8080/") == "com,a:8080)/"
    assert warc.surt(None) == "" and warc.surt("odd thing") == "odd%20thing"


def test_empty_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.queries()["op3_warc"](spark, str(tmp_path)).count() == 0


def brute(rows, cosine=0.95):
    ok = [(i, np.array(e, float)) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e) and len(e) == 16]
    n = np.zeros(len(ok), int)
    top = list(range(len(ok)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            x, y = ok[a][1], ok[b][1]
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                n[a] += 1
                n[b] += 1
                p, q = find(a), find(b)
                top[p] = top[q] = min(p, q, key=lambda k: ok[k][0])
    return {i: (int(n[k]), ok[find(k)][0]) for k, (i, _) in enumerate(ok)}


def test_op5(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(700)]
    centre = rng.normal(size=16)
    rows += [(1000 + i, (centre + rng.normal(size=16) * 0.18).astype(np.float32).tolist()) for i in range(250)]  # one hot group
    rows += [(2000 + i, rows[i % 5][1]) for i in range(50)]  # copies
    rows += [(3000 + i, [2 * x for x in rows[700 + i][1]]) for i in range(5)]  # the same direction
    rows += [(4000, None), (4001, [0.0] * 16), (4002, [1.0, None] + [0.0] * 14), (4003, [float("nan")] + [1.0] * 15), (4004, [float("inf")] + [1.0] * 15), (4005, [1.0]), (4006, []), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit(1)).withColumn("e", F.lit(1))
    old = embedding.BLOCK_ROWS, embedding.BLOCK_VISITS, embedding.CELL_ROWS
    embedding.BLOCK_ROWS, embedding.BLOCK_VISITS, embedding.CELL_ROWS = 64, 128, 30
    try:
        df.write.parquet(f"{tmp_path}/embeddings.parquet")
        found = queries.queries()["op5_multi_index"](spark, str(tmp_path)).collect()
    finally:
        embedding.BLOCK_ROWS, embedding.BLOCK_VISITS, embedding.CELL_ROWS = old
    assert len(found) == len(rows)
    wanted = brute([r for r in rows if r[0] is not None])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found if r["vec_id"] is not None}
    links, all_links = sum(got[i][0] for i in wanted), sum(n for n, _ in wanted.values())
    assert all(got[i][0] <= wanted[i][0] for i in wanted) and links >= 0.97 * all_links
    assert np.mean([got[i][1] == wanted[i][1] for i in wanted]) > 0.99
    for i in range(4000, 4007):
        assert got[i] == (0, i)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found if r["vec_id"] is not None)


def test_op5_traversal():
    """Cells in strictly ascending order up to the row's reach, no cell twice, and the recall that was aimed at, in 64 dimensions."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = embedding.Index(64, 32, (embedding._means(x[:, :32], 12), embedding._means(x[:, 32:], 12)), (0.1 / 64) ** 0.5, 0.95)
    q = x[:1500]
    cells, reach, rows, found = index.visits(q)
    _, one, two = index.margins(q)
    for i in range(0, 1500, 50):
        cost = one[i][:, None] + two[i]
        mine = found[rows == i]
        assert mine[0] == cells[i] and len(set(mine)) == len(mine)
        assert (np.diff(cost.ravel()[mine]) >= -1e-12).all()
        assert sorted(mine) == np.flatnonzero(cost.ravel() <= reach[i]).tolist()
    move = rng.normal(size=q.shape)
    move -= (move * q).sum(1)[:, None] * q
    near = 0.95 * q + np.sqrt(1 - 0.95**2) * move / np.linalg.norm(move, axis=1)[:, None]
    there = index.visited(q, reach, index.margins(near)[0])
    assert there.mean() > 0.98 and index.recall(q, near) > 0.998
    assert len(rows) < 0.4 * 144 * len(q)


def test_op5_perturbed_copies(spark, tmp_path):
    """64 dimensions: every link of perturbed copies, also of components whose squares leave the range of doubles."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 64))
    x[600:] = x[:300] + rng.normal(size=(300, 64)) * 0.25
    rows = [(i, (v * (1e200 if i % 3 == 1 else 1e-200 if i % 3 == 2 else 1)).tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.queries()["op5_multi_index"](spark, str(tmp_path)).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.95
    assert 200 < linked.sum() - 900 <= 600
    for i in range(900):
        assert found[i] == (linked[i].sum() - 1, np.flatnonzero(linked[i]).min())


def test_op5_nothing(spark, tmp_path):
    spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/a/embeddings.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert [tuple(r) for r in queries.queries()["op5_multi_index"](spark, f"{tmp_path}/a").collect()] == [(1, 0, 1, True)]
    assert queries.queries()["op5_multi_index"](spark, f"{tmp_path}/b").count() == 0
