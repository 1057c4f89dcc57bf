"""Queries whose results are told by hand or by brute force."""

import hashlib

from pyspark.sql import functions as F

from plumbline.plans import frames
from plumbline.plans.catalogue import QUERIES


def test_permutation_places_every_finding(spark, small):
    uids = {}
    for r in spark.read.parquet(f"{small}/findings.parquet").select("finding_id", "finding_uid").collect():
        uids[r.finding_id] = min(r.finding_uid, uids.get(r.finding_id, r.finding_uid))
    order = sorted(uids, key=lambda i: (hashlib.sha256(f"20260717|{uids[i]}".encode()).hexdigest(), i))
    got = {r.place: r.finding_id for r in QUERIES["f29_permutation"](spark, small).collect()}
    assert len(uids) > 500 and [got.get(n) for n in range(1, len(order) + 1)] == order


def test_fingerprint_notices_any_change(spark, small, tmp_path):
    mark = lambda df: [df.write.mode("overwrite").parquet(f"{tmp_path}/findings.parquet"), QUERIES["q12_fingerprint"](spark, str(tmp_path)).first()][1]
    spark.read.parquet(f"{small}/class_aliases.parquet").write.parquet(f"{tmp_path}/class_aliases.parquet")
    rows = spark.read.parquet(f"{small}/findings.parquet").limit(100)
    first = mark(rows)
    assert first.n == rows.select("finding_id").distinct().count() and first.n_topk == rows.where("rank <= 3").select("finding_id").distinct().count()
    assert mark(rows.orderBy(F.desc("finding_uid")).repartition(3)).mark == first.mark
    assert mark(rows.union(rows.limit(1))).mark != first.mark
    new = {"line": F.lit(123456), "confidence": F.lit(0.123), "scanned_at": F.expr("scanned_at + INTERVAL 1 MICROSECOND"), "trace": F.array(F.lit("x"), F.lit(None)), "file": F.lit("new"), "vuln_class": F.lit("new")}
    for column, value in new.items():
        one = F.col("finding_id") == rows.where(f"{column} IS NOT NULL").agg(F.max("finding_id")).first()[0]
        assert mark(rows.withColumn(column, F.when(one, value).otherwise(F.col(column)))).mark != first.mark


def test_types_report_every_label(spark, small):
    rows = spark.read.parquet(f"{small}/findings.parquet")
    got = {r.label: (r.n, r.cls) for r in QUERIES["s10_types"](spark, small).collect()}
    assert set(got) == {r[0] for r in rows.select("vuln_class").where("vuln_class IS NOT NULL").distinct().collect()}
    assert got["Broken Access Control"] == (rows.where("vuln_class = 'Broken Access Control'").count(), "auth")


def test_random_order_draws_whole_lists(spark, small):
    """Lists in one part and in several, no identifier, no tool, no record; seeds without a hit stay, and draws are never sorted or sent on one by one."""
    rows = [(i, None if i % 17 == 0 else f"u{i % 900}", None if i % 90 == 7 else f"r{i % 5 if i % 3 else i}|-", None if i % 11 == 0 else "ab"[i % 2], i % 37 == 0) for i in range(1, 1200)]
    df = spark.createDataFrame(rows, "finding_id long, finding_uid string, rkey string, tool string, hit boolean")
    lists = {}
    for i, uid, rkey, tool, hit in rows:
        lists.setdefault((rkey, tool), []).append((i, uid, hit))
    draw = lambda s, x: (x[1] is None, x[1] and hashlib.md5(f"{s}|{x[1]}".encode()).hexdigest(), x[0])
    want = {s: len({r for (r, _), xs in lists.items() if r and any(x[2] for x in sorted(xs, key=lambda x: draw(s, x))[:3])}) for s in range(1, 71)}
    sizes = df.groupBy("rkey", "tool").agg(F.count(F.lit(1)).alias("n"))
    for most in (30, 1 << 15):
        assert {r.seed: r.hits for r in frames.drawn_hits(df, sizes, 70, 3, most).collect()} == want
    assert max(map(len, lists.values())) > 60 and len(set(want.values())) > 1
    none = df.where("NOT hit")
    assert [tuple(r) for r in frames.drawn_hits(none, sizes, 2, 3, 40).orderBy("seed").collect()] == [(1, 0), (2, 0)] and not frames.drawn_hits(df.limit(0), sizes, 2).count()
    plan = QUERIES["k12_random_order"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "seed" in x and any(f"{n} " in x for n in ("Sort", "Window", "WindowGroupLimit"))]
