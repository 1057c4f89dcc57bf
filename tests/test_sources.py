"""Datasets, targets, writers, and functions on code for readers."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.__main__ import main
from plumbline.engine.target import files_of, scan_target
from plumbline.functions import code
from plumbline.operators.diffs import unified
from plumbline.operators.statistics import allocate, sign_flip, unique
from plumbline.sources import archives, datasets, sinks

PHP = "<?php\n/* Plugin Name: One\nVersion: 2.0\n*/\necho $_GET['a'];\n"


@pytest.fixture
def target(tmp_path):
    folder = tmp_path / "shop"
    (folder / "inc").mkdir(parents=True)
    (folder / "shop.php").write_text(PHP)
    (folder / "inc" / "b.php").write_text("<?php function s($v){ print $v; } s($_POST['x']);")
    (folder / "readme.txt").write_text("<?php echo $_GET['no'];")
    with zipfile.ZipFile(tmp_path / "shop.1.2.zip", "w") as z:
        for p in folder.rglob("*.*"):
            z.write(p, f"shop/{p.relative_to(folder)}")
    (tmp_path / "broken.zip").write_text("no archive")
    return tmp_path


def test_targets(spark, target):
    found = lambda name: [(r.vuln_class, r.file) for r in scan_target(spark, str(target / name)).orderBy("rank").collect()]
    assert found("shop") == [("xss", "inc/b.php"), ("xss", "shop.php")]
    assert found("shop.1.2.zip") == [("xss", "shop/inc/b.php"), ("xss", "shop/shop.php")]
    assert found("shop/shop.php") == [("xss", "shop.php")]
    assert files_of(spark, str(target / "broken.zip")).count() == 0


def test_command_line(target, capsys):
    assert main([str(target / "shop"), "--out", str(target / "out")]) == 0
    assert "2 findings" in capsys.readouterr().out
    told = [json.loads(x) for p in (target / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert len(told) == 1 and told[0]["n_findings"] == 2 and [f["rank"] for f in told[0]["findings"]] == [1, 2]


def test_enumeration_counts_loadable_archives(spark, target):
    rows = archives.enumerated(archives.read_archives(spark, str(target)), 1).collect()
    assert [(r.n, r.slug, r.version, r.php_files) for r in rows] == [(1, "shop", "2.0", 2)]


def test_csv_and_first_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('slug,cve,archive\na,1,"x ""y"".zip"\n a ,1,"x ""y"".zip"\nb, ,z.zip\n')
    rows = datasets.read_csv(spark, str(tmp_path / "a.csv"), ["slug", "cve", "archive"])
    assert sorted((r.slug, r.cve or "", r.archive) for r in rows.collect()) == [("a", "1", 'x "y".zip')] * 2 + [("b", "", "z.zip")]
    with pytest.raises(ValueError, match="missing"):
        datasets.read_csv(spark, str(tmp_path / "a.csv"), ["slug", "no"])
    many = spark.createDataFrame([("a", "1", "p", "q", 2), ("a", "1", "p", "q", 1), ("b", "1", None, "q", 3)], "slug string, cve string, old string, new string, n int")
    assert {(r.slug, r.n) for r in datasets.first_of_each(many, ["slug", "cve"], ["old", "new"], "n").collect()} == {("a", 1), ("b", 3)}
    assert datasets.first_of_each(many.limit(0), ["slug", "cve"], ["old", "new"], "n").count() == 0
    for row, why in ((("a", "1", "other", "q", 4), "archives"), (("", "1", "p", "q", 4), "blank")):
        with pytest.raises(ValueError, match=why):
            datasets.first_of_each(many.union(spark.createDataFrame([row], many.schema)), ["slug", "cve"], ["old", "new"], "n")


def test_places_in_order(spark):
    listing = spark.createDataFrame([("public", "a.zip", "p/a"), ("plugins2", "a.zip", "q/a"), ("public", "b.zip", "p/b"), ("else", "c.zip", "e/c")], "place string, archive string, path string")
    names = spark.createDataFrame([("a.zip",), ("b.zip",), ("c.zip",), (None,)], "archive string")
    assert {r.archive: r.found for r in datasets.resolved(names, listing, ["plugins", "public"]).collect()} == {"a.zip": "q/a", "b.zip": "p/b", "c.zip": None, None: None}


def test_writers_and_versions(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b"', ["x", "y"], None), (2, None, [], 0.5)], "id long, t string, l array<string>, d double")
    sinks.write_population(rows, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).where("id = 1 AND d IS NULL").count() == 1 and '"d":null' in "".join(p.read_text() for p in (tmp_path / "p").glob("*.json"))
    sinks.write_sheet(rows, str(tmp_path / "s"))
    assert datasets.read_csv(spark, str(tmp_path / "s"), ["id", "t", "l"]).where("id = 1").first().asDict() == {"id": "1", "t": 'a "b"', "l": "x; y"}
    words = spark.createDataFrame([("sink", "f", "xss"), ("sink", "f", "xss"), ("source", "g", None)], "kind string, name string, cls string")
    folder = str(tmp_path / "words")
    assert sinks.read_words(spark, folder) is None and sinks.append_words(words, folder) == 1
    assert sinks.append_words(words.withColumn("cls", F.lit("lfi")), folder) == 2
    assert sinks.read_words(spark, folder).count() == 4 and sinks.read_words(spark, folder, 1).count() == 2 and sinks.append_words(words, folder) == 3
    assert sinks.read_words(spark, folder).count() == 4


def test_excerpts_and_verdicts(spark):
    text = "\n".join(f"l{i}" for i in range(1, 401))
    assert code.wide_excerpt(text, 50, [(40, 60), (1, 200)]).startswith("    40: l40") and code.wide_excerpt(text, 300, []).count("\n") == 50
    long_ = code.wide_excerpt(text, 150, [(1, 200)])
    assert "... 130 lines omitted within the same function ..." in long_ and "   144: l144" in long_ and "   157: l157" not in long_
    assert code.array_value("array( // 'callback' => 'no',\n 'callback' => array($this, 'go'), 'x' => 1)", "callback") == "array($this, 'go')"
    assert code.coerced({"confidence": "x", "safe_function": "\\esc_html($v)", "is_vulnerable": 1}) == {**code.VERDICT, "safe_function": "esc_html", "is_vulnerable": True}
    got = spark.createDataFrame([('a {"is_vulnerable": true, "confidence": 0.7}',), (None,), ("none",)], "t string").select(code.verdict_udf("t").alias("v")).select("v.*").collect()
    assert [(r.is_vulnerable, r.confidence, r.vuln_class) for r in got] == [(True, 0.7, "none"), (False, 0.0, "none"), (False, 0.0, "none")]
    assert unified("a\nb\nc", "a\nx\nc") == "@@ -1,3 +1,3 @@\n a\n-b\n+x\n c" and unified("a", "a") == "(file unchanged by the patch)"


def test_allocation_and_exact_flips(spark):
    sizes = lambda *n: spark.createDataFrame(list(enumerate(n)), "id int, size long")
    take = lambda total, *n: {r.id: r["take"] for r in allocate(sizes(*n), "size", total, ["id"]).collect()}
    assert take(10, 1, 1, 98) == {0: 1, 1: 1, 2: 8} and take(100, 3, 4, 0) == {0: 3, 1: 4} and sum(take(50, 17, 29, 400, 2).values()) == 50
    with pytest.raises(ValueError):
        take(2, 1, 1, 1)
    d = [3, -1, 1, 2, 0, 1]
    sums = [0]
    for x in d:
        if x:
            sums = [s + x * k for s in sums for k in (-1, 1)]
    r = sign_flip(spark.createDataFrame([(x,) for x in d], "d long")).first()
    assert (r.n, r.observed) == (5, 6) and r.p == pytest.approx(sum(abs(s) >= 6 for s in sums) / len(sums))
    assert sign_flip(spark.createDataFrame([(0,)], "d long")).first().p == 1.0
    with pytest.raises(ValueError):
        unique(sizes(1).union(sizes(2)), "id")


def test_access_scores_with_their_points(spark):
    from plumbline.sources import tools

    def one(rule, access, source="", sink="", paths=("", "")):
        return {"check_id": rule, "path": "t/a.php", "start": {"line": 3}, "extra": {"context": {"access": access}, "dataflow_trace": {"source": {"path": paths[0], "line": 1, "snippet": source}, "sink": {"path": paths[1] or "t/a.php", "line": 9, "snippet": sink}}}}

    cases = [
        (one("render-callback-execution", "unknown", "apply_filters( apply_filters_deprecated( prepare_post_data("), 200 + 160 + 48, ["rce"]),
        (one("render-callback-execution", "", "x apply_filters_deprecated("), 100 + 80, ["rce"]),
        (one("wp-stored-xss-persistent-read-to-output", "authenticated", "", 'href="<?php echo $x'), 400 + 112 + 48, ["xss"]),
        (one("path-transversal", "nonce_only", "$_GET['file_path']", "", ("t/b.php", "t/a.php")), 600 + 96 + 40 + 32, ["lfi"]),
        (one("unsafe-deserialization", "unauthenticated", " Function f("), 1000 - 128, ["deserial"]),
        (one("upload-api-surface", "capability_checked"), 50 - 150, ["upload"]), (one("wp-request-file-upload-without-cap-check", "unknown"), 200, ["auth", "upload"]), (one("some-exec-rule", "unknown"), 200, ["rce"]),
    ]
    raw = spark.createDataFrame([("r", json.dumps({"results": [c[0] for c in cases]}))], "record string, body string")
    rows = tools.access_scorer(raw).collect()
    assert sorted((r.score, r.classes) for r in rows) == sorted((s, k) for _, s, k in cases)
    assert [r.score for r in sorted(rows, key=lambda r: r["rank"])] == sorted((s for _, s, _ in cases), reverse=True) and all(r.line == 9 for r in rows)
