"""``python -m plumbline TARGET [--out FOLDER] [--top N]``: analyses a file, an archive or a folder."""

from __future__ import annotations

import argparse

from plumbline.engine.target import scan_target
from plumbline.session import local_session, ship
from plumbline.sources.sinks import write_report


def main(arguments: list[str] | None = None) -> int:
    known = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    known.add_argument("target")
    known.add_argument("--out", help="folder for the report as JSON")
    known.add_argument("--top", type=int, default=20, help="findings to print")
    told = known.parse_args(arguments)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    found = scan_target(spark, told.target).persist()
    for r in found.orderBy("rank").limit(told.top).collect():
        print(f"{r['rank']:4} {r.score:6.3f} {r.vuln_class:8} {r.file}:{r.line} {r.message} [{r.entry_point}]")
    if told.out:
        write_report(found, told.out)
    n = found.count()
    print(f"{n} findings")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
