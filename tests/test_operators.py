"""Core operators against brute force and known answers."""

import io
import json
import random
import zipfile
from math import comb

import pytest
from pyspark.sql import functions as F

from plumbline.functions import code, keys
from plumbline.operators import diffs, findings, geometry, graphs, joins, rank, rules, statistics
from plumbline.sources import archives, tools
from plumbline.streaming import counts


def test_keys(spark):
    df = spark.createDataFrame([(" Foo_Bar.V3.6.3\t", "\\A\\b.PHP/", "N/A", "{A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11}"), ("foo bar", "a/b.php", "Two-Words.", "urn:uuid:a0eebc999c0b4ef8bb6d6bb9bd380a11"), ("1.2", None, "  ", "xyz"), (None, "", None, None)], "slug string, path string, author string, uid string")
    out = df.select(keys.slug_key("slug"), keys.path_key("path"), keys.author_key("author"), keys.uuid_hex("uid")).collect()
    h = "a0eebc999c0b4ef8bb6d6bb9bd380a11"
    assert [tuple(r) for r in out] == [("foo-bar", "a/b.php", None, h), ("foo-bar", "a/b.php", "twowords", h), ("1-2", None, None, None), (None, "", None, None)]


def test_uuids_with_any_white_space(spark):
    h = "a0eebc999c0b4ef8bb6d6bb9bd380a11"
    texts = [f"\t{h}", f"{h}\r\n", "a0eebc99 9c0b4ef8\tbb6d 6bb9bd380a11", "\f{ a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11 }\f", f" urn:uuid:{h.upper()}\n"]
    df = spark.createDataFrame([(x,) for x in texts], "u string")
    assert [r[0] for r in df.select(keys.uuid_hex("u")).collect()] == [h] * len(texts)


def test_spread_rank_numbers_each_group(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), "id")
    got = rank.spread_rank(df, ["g"], F.xxhash64("id"), "n", buckets=8).collect()
    for g in (0, 1):
        assert sorted(r.n for r in got if r.g == g) == list(range(1, 251))
    assert rank.spread_rank(df.limit(0), ["g"], F.xxhash64("id"), "n").count() == 0


def test_even_rank_and_mid_ranks(spark):
    r = random.Random(4)
    rows = [(r.choice("aaab") if r.random() < 0.9 else None, r.randrange(20) or None, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, id long")
    got = {x.id: x.n for x in rank.even_rank(df, ["g"], [F.col("v").desc(), F.col("id")], "n", parts=7).collect()}
    for g in ("a", "b", None):
        ordered = sorted((x for x in rows if x[0] == g), key=lambda x: (-(x[1] or -1), x[2]))
        assert [got[x[2]] for x in ordered] == list(range(1, len(ordered) + 1))
    mids = {x.id: x.m for x in rank.mid_ranks(df, ["g"], "v", "m").collect()}
    for g, v, i in rows:
        same = sorted((x[1] or -1) for x in rows if x[0] == g)
        at = [k + 1 for k, x in enumerate(same) if x == (v or -1)]
        assert mids[i] == sum(at) / len(at)
    assert rank.even_rank(df.limit(0), [], [F.col("id")], "n").count() == 0


def test_salted_lookup(spark):
    left = spark.range(100).select(F.when(F.col("id") < 90, "hot").when(F.col("id") < 95, "cold").alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("cold", 2), ("none", 3)], "k string, v int")
    got = joins.salted_lookup(left, right, "k", F.xxhash64("id")).groupBy("k", "v").count().collect()
    assert {(r.k, r.v, r["count"]) for r in got} == {("hot", 1, 90), ("cold", 2, 5), (None, None, 5)}


def test_geometry(spark):
    g = spark.createDataFrame([(1, "p", "C", "a.php", True, "modified", 9, 9, [10, 11], [30], [(9, 14, "replace")], [(1, 20), (8, 12)], [])], "gid long, slug string, cve string, path string, is_php boolean, status string, vuln_lines int, patched_lines int, changed_vuln_lines array<int>, insertion_boundaries array<int>, hunks array<struct<start:int,end:int,kind:string>>, callable_ranges array<struct<s:int,e:int>>, top_level_changed_lines array<int>")
    f = spark.createDataFrame([(1, "P", "C", "a.php", 10), (2, "p", "C", "a.php", 15), (3, "p", "C", "a.php", 33), (4, "p", "C", "b.php", 10), (5, "p", None, "a.php", 10), (6, "p", "C", "a.php", None)], "finding_id long, slug string, cve string, path string, line int")
    out = {r.finding_id: r for r in geometry.geometry(f, g).collect()}
    assert out[1].exact and out[1].same_callable and out[1].in_hunk and out[1].distance == 0
    assert out[2].distance == 4 and out[2].within5 and not out[2].within2 and not out[2].same_callable
    assert out[3].near_boundary and out[3].at_top and not out[3].in_hunk
    assert not out[4].in_file and not out[5].in_file and out[6].in_file and out[6].distance is None
    assert geometry.violations(geometry.geometry(f, g)).count() == 0


def test_exact_tests(spark):
    cases = [(b, c) for b in range(0, 13, 3) for c in range(0, 14, 4)]
    got = spark.createDataFrame(cases, "b int, c int").select("b", "c", statistics.binomial_two_sided(F.col("b"), F.col("c")).alias("p")).collect()
    for r in got:
        n, k = r.b + r.c, min(r.b, r.c)
        assert r.p == pytest.approx(min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0)
    d = [3, -1, 2, 2, 0]
    signs = [sum(x if m >> i & 1 else -x for i, x in enumerate(d[:4])) for m in range(16)]
    expected = sum(abs(s) >= abs(sum(d)) for s in signs) / 16
    assert statistics.sign_flip(spark.createDataFrame([(x,) for x in d], "d int")).first().p == pytest.approx(expected)
    assert statistics.sign_flip(spark.createDataFrame([], "d int")).first().p == 1
    h = statistics.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")).collect()
    assert {r.k: round(r.holm, 6) for r in h} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_exact_tests_of_many_records(spark):
    cases = [(600, 600), (560, 640), (2000, 2000), (1900, 2100), (0, 1100)]
    got = spark.createDataFrame(cases, "b int, c int").select("b", "c", statistics.binomial_two_sided(F.col("b"), F.col("c")).alias("p")).collect()
    for r in got:
        n, k = r.b + r.c, min(r.b, r.c)
        assert r.p == pytest.approx(min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n), rel=1e-9, abs=1e-300)
    assert got[0].p == got[2].p == 1


def test_allocation(spark):
    got = {r.k: r.take for r in statistics.allocate(spark.createDataFrame([("a", 90), ("b", 9), ("c", 1)], "k string, size long"), "size", 20, ["k"]).collect()}
    assert got["c"] == 1 and sum(got.values()) == 20


def test_closure_and_reach_equal_search(spark):
    r = random.Random(3)
    edges = {(f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(18)}
    df = spark.createDataFrame(sorted(edges), "child string, parent string")
    expected = set()
    for start in {a for a, _ in edges}:
        seen, todo = set(), [(start, 0)]
        while todo:
            x, d = todo.pop(0)
            for a, b in edges:
                if a == x and b not in seen and b != start:
                    seen.add(b)
                    expected.add((start, b, d + 1))
                    todo.append((b, d + 1))
    closed, told = graphs.closure(df)
    assert {tuple(x) for x in closed.collect()} == expected and told["converged"]
    assert graphs.closure(spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(9)], "child string, parent string"), rounds=3)[1]["converged"] is False
    calls = df.select(F.col("child").alias("caller"), F.col("parent").alias("callee"))
    best = {x.node: x.priority for x in graphs.reach(calls, spark.createDataFrame([("n1", 3), ("n2", 1)], "node string, priority int")).collect()}
    want = {}
    for s, p in (("n1", 3), ("n2", 1)):
        layer = {s}
        for _ in range(7):
            for x in layer:
                want[x] = min(p, want.get(x, 9))
            layer = {b for a, b in edges if a in layer}
    assert best == want
    near = graphs.nearest(closed, spark.createDataFrame([("n3", "m"), ("n5", "m")], "owner string, key string"))
    assert near.where("node = owner").count() == 2


def test_diffs(spark):
    old = spark.createDataFrame([("a", "1\n2\n3\n4"), ("b", "x"), ("c", "same")], "path string, content string")
    new = spark.createDataFrame([("a", "1\nX\n3\nnew\n4"), ("d", "y"), ("c", "same")], "path string, content string")
    got = {r.path: r for r in diffs.patch_map(old, new).collect()}
    assert set(got) == {"a", "b", "d"} and got["b"].status == "deleted" and got["d"].status == "added"
    assert got["a"].changed == [2] and got["a"].patched == [2, 4] and got["a"].boundaries == [3]


def test_code_functions(spark):
    assert code.call_arguments("x(1); add(a, 'b)', f(2)); $o->add(9)", "add") == ["a, 'b)', f(2)"]
    assert code.split_arguments("a, array(1, 2), 'x,y', $b[1, 2]") == ["a", "array(1, 2)", "'x,y'", "$b[1, 2]"]
    assert code.key_value("'a' => 1, 'cb' => array($this, 'm'), 'z' => 2", "cb") == "array($this, 'm')"
    assert [code.callback_name(x) for x in ("'f'", "array($this, 'm')", "'A::b'", "function () {}", "$x")] == ["f", "m", "b", None, None]
    text = "a\nfunction f() {\n  x;\n}\nb"
    assert code.enclosing(text.split("\n"), 3) == (2, 4) and code.enclosing(text.split("\n"), 5) is None
    assert code.excerpt(text, 3) == "function f() {\n  x;\n}"
    assert json.loads(code.last_json('noise {"is_vulnerable": true} {"b": 1} {bad')) == {"is_vulnerable": True} and code.last_json("none") is None
    df = spark.createDataFrame([(text, 3), (None, 1)], "t string, n int")
    assert [r[0] for r in df.select(code.excerpt_udf("t", "n")).collect()] == ["function f() {\n  x;\n}", None]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "my-plugin.1.2.zip", "w") as z:
        z.writestr("my-plugin/main.php", "<?php\n/*\nPlugin Name: Mine \nVersion: 1.2\n*/")
        z.writestr("my-plugin/readme.txt", "x")
    (tmp_path / "broken.zip").write_bytes(b"PK nothing")
    files = archives.read_archives(spark, str(tmp_path))
    assert files.where("fault IS NOT NULL").count() == 1 and files.where("path IS NOT NULL").count() == 2
    p = archives.plugins(files).first()
    assert (p.slug, p.name, p.version, p.php_files) == ("my-plugin", "Mine", "1.2", 1)


def test_manifest(spark):
    rec = spark.createDataFrame([("a", "1", "old")], "slug string, cve string, zip string")
    assert archives.with_manifest(rec, spark.createDataFrame([("a", "1", "new")], "slug string, cve string, zip string")).first().zip == "new"
    for bad in ([("b", "1", "x")], [("a", "1", "x"), ("a", "1", "y")]):
        with pytest.raises(ValueError):
            archives.with_manifest(rec, spark.createDataFrame(bad, "slug string, cve string, zip string"))


def test_tool_readers(spark):
    pattern = json.dumps({"results": [{"check_id": "php.sql", "path": "top/a.php", "start": {"line": 3}, "extra": {"severity": "INFO"}}, {"check_id": "x-xss", "path": "top/b.php", "start": {"line": 4}, "extra": {"severity": "ERROR"}}]})
    raw = spark.createDataFrame([("r", pattern), ("bad", "oops")], "record string, body string")
    rows = tools.pattern_scanner(raw).collect()
    assert [(r.path, r.cls) for r in sorted(rows, key=lambda r: r["rank"]) if r.record == "r"] == [("b.php", "xss"), ("a.php", "sqli")]
    assert any(r.fault for r in rows if r.record == "bad")
    listed = spark.createDataFrame([("r", 'prose [{"vuln_name": "sql_injection", "sink_file": "t/c.php", "sink_line": 7}]')], "record string, body string")
    assert tools.list_scanner(listed).first().line == 7
    traced = json.dumps({"results": [{"check_id": "a-surface", "path": "t/a.php", "start": {"line": 1}, "extra": {"context": {"access": "nonce_only"}}}, {"check_id": "sql", "path": "t/a.php", "start": {"line": 1}, "extra": {"context": {"access": "unknown"}, "stored_write_context": {"access": "unauthenticated"}, "dataflow_trace": {"sink": {"path": "t/s.php", "line": 9}}}}]})
    first = tools.access_scorer(spark.createDataFrame([("r", traced)], "record string, body string")).orderBy("rank").collect()
    assert (first[0].path, first[0].line, first[0].score) == ("s.php", 9, 1000) and first[1].score == 450


def test_rules(spark):
    made = {r.cls: json.loads(r.rule) for r in rules.compiled(rules.vocabulary(spark)).collect()}
    assert set(made) == {"xss", "sqli", "lfi", "upload", "ssrf", "rce", "deserial", "other"}
    assert "esc_html" in made["xss"]["sanitizers"] and "esc_html" not in made["sqli"]["sanitizers"] and "query" in made["sqli"]["sinks"]


def test_stream_of_deliveries(spark, small, tmp_path):
    table = spark.read.parquet(f"{small}/findings.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = counts.deduplicated(counts.read_deliveries(spark, str(tmp_path / "in"), table.schema, 10), "3000 days")
    q = stream.select("finding_id").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("firsts")
    assert got.count() == got.distinct().count() == table.select("finding_id").distinct().count()


def test_findings_table_is_one_row_each(spark, small):
    f = findings.findings(spark, small)
    assert f.count() == f.select("finding_id").distinct().count()
