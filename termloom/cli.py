"""python -m termloom.cli build | append | update | query | evaluate | merge | list | delete | rename"""

from __future__ import annotations

import argparse
import logging
import time
from dataclasses import replace

from pyspark.sql import functions as F

from .catalog import Catalog
from .config import CODECS, DEFAULT_INDEX, DEFAULT_ROWS, METHODS, SCORINGS, SEARCHES, IndexConfig, QueryConfig
from .operators import metrics
from .operators.search import search, search_one
from .operators.timing import Stages
from .session import local_session
from .sources import collections

log = logging.getLogger("termloom")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="termloom")
    out.add_argument("--base", default="indexes", help="folder of the indexes")
    out.add_argument("--verbose", action="store_true")
    todo = out.add_subparsers(dest="command", required=True)
    b = todo.add_parser("build")
    b.add_argument("--limit", type=int, default=DEFAULT_ROWS, help="rows to read; 0: all")
    a = todo.add_parser("append")
    a.add_argument("--limit", type=int, default=0)
    for p in (b, a):
        p.add_argument("name")
        p.add_argument("path")
    u = todo.add_parser("update", help="change stored options; those of the index need --path")
    u.add_argument("name")
    u.add_argument("--path")
    for p, default in ((b, DEFAULT_INDEX), (u, None)):
        p.add_argument("--stem", action=argparse.BooleanOptionalAction, default=default and default.stem)
        p.add_argument("--stop", action=argparse.BooleanOptionalAction, default=default and default.keep_stop, help="keep stop words")
        p.add_argument("--codec", choices=CODECS, default=default and default.codec)
    q = todo.add_parser("query")
    q.add_argument("name")
    q.add_argument("text")
    e = todo.add_parser("evaluate")
    e.add_argument("name")
    e.add_argument("topics")
    e.add_argument("qrels")
    for p in (b, u, q, e):  # where nothing is said, what the index stores
        p.add_argument("--method", choices=METHODS)
        p.add_argument("--scoring", choices=SCORINGS)
        p.add_argument("--search", choices=SEARCHES)
        p.add_argument("-k", type=int)
    m = todo.add_parser("merge")
    m.add_argument("name")
    m.add_argument("parts", nargs="+")
    todo.add_parser("list")
    d = todo.add_parser("delete")
    d.add_argument("name")
    r = todo.add_parser("rename")
    r.add_argument("name")
    r.add_argument("new")
    return out


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING)
    spark = spark or local_session()
    catalog = Catalog(spark, a.base)
    began = time.perf_counter()
    said = {k: v for k in ("method", "scoring", "search", "k") if (v := getattr(a, k, None)) is not None}
    if a.command == "build":
        rows, bad = collections.read_collection(spark, a.path, a.limit)
        built = catalog.build(rows, IndexConfig(a.name, a.stem, a.stop, a.codec), QueryConfig(**said))
        log.info("%d rows rejected", bad.count())
        print(f"{a.name}: {built.n_docs} documents")
    elif a.command == "append":
        print(f"{a.name}: {catalog.append(a.name, collections.read_collection(spark, a.path, a.limit)[0])} documents more")
    elif a.command == "update":
        found = catalog.load(a.name)
        if found is None:
            print(f"no index {a.name!r}")
            return 1
        new = {k: v for k, v in {"stem": a.stem, "keep_stop": a.stop, "codec": a.codec}.items() if v is not None}
        rows = collections.read_collection(spark, a.path)[0] if a.path else None
        try:
            catalog.update(a.name, replace(found[1], **said), replace(found[0].config, **new), rows)
        except ValueError as error:
            print(error)
            return 1
    elif a.command in ("query", "evaluate"):
        stages = Stages()
        with stages("load"):
            found = catalog.load(a.name)
        if found is None:
            print(f"no index {a.name!r}")
            return 1
        built, config = found[0], replace(found[1], **said)
        if a.command == "query":
            top = search_one(spark, built, a.text, config, stages)
            with stages("score"):
                rows = top.orderBy("rank").collect()
            for r in rows:
                print(f"{r['rank']}\t{r['docid']}\t{r['docno']}\t{r['score']}")
        else:
            run = search(built, collections.topics(spark, a.topics), config).withColumn("docid", F.col("docno"))
            with stages("evaluate"):
                metrics.mean(metrics.per_topic(run, collections.qrels(spark, a.qrels))).show(vertical=True)
        log.info("%s", stages)
    elif a.command == "merge":
        built = catalog.merge(a.parts, _options(catalog, a.parts[0], a.name))
        print(f"{a.name}: {built.n_docs} documents")
    elif a.command == "list":
        print("\n".join(catalog.names()))
    elif a.command == "delete":
        catalog.delete(a.name)
    else:
        catalog.rename(a.name, a.new)
    log.info("%.3f s", time.perf_counter() - began)
    return 0


def _options(catalog: Catalog, like: str, name: str) -> IndexConfig:
    m = catalog.metadata(like)
    if m is None:
        raise SystemExit(f"no index {like!r}")
    return IndexConfig(name, m["stem"], m["keep_stop"], m["codec"])


if __name__ == "__main__":
    raise SystemExit(main())
