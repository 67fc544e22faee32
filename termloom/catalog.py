"""Named indexes under one folder: batches of documents beside versions of a one-row metadata table, through Spark's file systems.

An index is a folder with a folder of tables for each batch and one of metadata for each version. A change writes new
batches first and then renames a new version into place, which alone makes it seen: what a failed change left is not read.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import IndexConfig, QueryConfig, rebuild_needed
from .operators import index as ix
from .operators.merge import same_options
from .operators.order import ordinals
from .sources.collections import each_docno

SCHEMA = (
    "name string, stem boolean, keep_stop boolean, codec string, content string, k int, method string, scoring string, search string, "
    "batches array<string>, lexicons array<string>, n_docs long, n_postings long, n_terms long"
)
#: Ranges of docnos that the metadata spell out; more are found in the index.
SPELT = 1000
#: Documents of a batch whose numbers go to all tasks; the texts of larger batches are shuffled to theirs.
FEW = 200_000


class Catalog:
    def __init__(self, spark: SparkSession, base: str, compact: int = 8):
        """compact: lexicons of batches that are joined into one once there are so many."""
        self.spark, self.base, self.compact = spark, base.rstrip("/"), compact
        self._kept: dict[str, ix.Index] = {}

    def _path(self, name: str) -> str:
        if not name or "/" in name:
            raise ValueError("an index needs a name without slashes")
        return f"{self.base}/{name}"

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _children(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _versions(self, name: str) -> list[int]:
        return sorted(int(v) for v in self._children(f"{self._path(name)}/meta") if v.isdigit())

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def names(self) -> list[str]:
        return [n for n in self._children(self.base) if self.exists(n)]

    # ---- metadata ----
    def metadata(self, name: str) -> dict | None:
        """The newest version's row, None if there is no such index."""
        versions = self._versions(name)
        if not versions:
            return None
        return self.spark.read.schema(SCHEMA).json(f"{self._path(name)}/meta/{versions[-1]:08d}").first().asDict() | {"name": name}

    def _commit(self, name: str, row: dict) -> None:
        """Make row the newest version: it is written aside and renamed into place, then folders that it doesn't name go."""
        versions, path = self._versions(name), self._path(name)
        aside, place = f"{path}/new-{uuid.uuid4().hex}", f"{path}/meta/{(versions or [0])[-1] + 1:08d}"
        row = row | {"name": name}
        kinds = self.spark.createDataFrame([], SCHEMA).schema
        self.spark.createDataFrame([tuple(row[f] for f in kinds.fieldNames())], kinds).coalesce(1).write.json(aside)
        fs, to = self._fs(place)
        fs.mkdirs(to.getParent())
        if fs.exists(to) or not fs.rename(self._fs(aside)[1], to):
            raise RuntimeError(f"another change of {name!r} came first")
        self.flush(name)
        for old in self._children(path):
            if old != "meta" and old not in row["batches"] and old not in row["lexicons"]:
                fs.delete(self._fs(f"{path}/{old}")[1], True)
        for v in versions[:-1]:
            fs.delete(self._fs(f"{path}/meta/{v:08d}")[1], True)

    def _row(self, config: IndexConfig, query: QueryConfig, batches: list[str], lexicons: list[str]) -> dict:
        """Options, defaults of queries, covered ranges and counts, from the batches' narrow tables."""
        built = self._index(config, batches, lexicons)
        ranges = [(r["lo"], r["hi"]) for r in ix.content_ranges(built.docs).orderBy("lo").limit(SPELT + 1).collect()]
        content = ix.ranges_to_text(ranges) if len(ranges) <= SPELT else f"{ranges[0][0]},...: over {SPELT} ranges"
        n_terms, n_postings = built.lexicon.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
        return {
            "stem": config.stem, "keep_stop": config.keep_stop, "codec": config.codec, "content": content, "k": query.k, "method": query.method, "scoring": query.scoring,
            "search": query.search, "batches": batches, "lexicons": lexicons, "n_docs": built.n_docs, "n_postings": int(n_postings), "n_terms": int(n_terms),
        }

    def _index(self, config: IndexConfig, batches: list[str], lexicons: list[str]) -> ix.Index:
        path = self._path(config.name)
        return ix.load(self.spark, config, [f"{path}/{b}" for b in batches], [f"{path}/{x}/lexicon" for x in lexicons])

    @staticmethod
    def _options(m: dict) -> tuple[IndexConfig, QueryConfig]:
        return IndexConfig(m["name"], m["stem"], m["keep_stop"], m["codec"]), QueryConfig(m["method"], m["scoring"], m["k"], m["search"])

    # ---- whole indexes ----
    def build(self, rows: DataFrame, config: IndexConfig, query: QueryConfig = QueryConfig()) -> ix.Index:
        """Index rows(docid, docno, text), of each docno the first, under config.name; what was there is replaced at once, when the
        new tables are whole."""
        batch = f"batch-{uuid.uuid4().hex[:12]}"
        ix.build(self.spark, each_docno(rows), config, f"{self._path(config.name)}/{batch}")
        self._commit(config.name, self._row(config, query, [batch], [batch]))
        return self._index(config, [batch], [batch])

    def load(self, name: str, keep: bool = False) -> tuple[ix.Index, QueryConfig] | None:
        """The index and its defaults of queries; None if there is none. `keep` persists its tables on the executors until
        it is loaded, changed or flushed again."""
        self.flush(name)
        m = self.metadata(name)
        if m is None:
            return None
        config, query = self._options(m)
        found = self._index(config, m["batches"], m["lexicons"])
        if keep:
            self._kept[name] = found.persist()
        return found, query

    def flush(self, name: str | None = None) -> None:
        """Let go of the tables that load() keeps, of one index or all."""
        for n in [name] if name is not None else list(self._kept):
            if n in self._kept:
                self._kept.pop(n).unpersist()

    def get_or_build(self, rows: DataFrame, config: IndexConfig) -> ix.Index:
        """The index of that name if its options are the same and it covers all rows, else a new one."""
        found = self.load(config.name)
        if found and not rebuild_needed(found[0].config, config) and rows.select("docno").join(found[0].docs.select("docno"), "docno", "left_anti").isEmpty():
            return found[0]
        return self.build(rows, config)

    def update(self, name: str, query: QueryConfig | None = None, config: IndexConfig | None = None, rows: DataFrame | None = None) -> None:
        """Change stored options. Those of queries take effect at once; those of the index, where its terms or lists would
        differ, need the rows to build it again, else a ValueError."""
        m = self.metadata(name)
        if m is None:
            raise ValueError(f"no index {name!r}")
        old, was = self._options(m)
        query, config = query or was, replace(config, name=name) if config else old
        if rebuild_needed(old, config):
            if rows is None:
                raise ValueError("these options need the rows to build the index again")
            self.build(rows, config, query)
        else:
            self._commit(name, m | {"k": query.k, "method": query.method, "scoring": query.scoring, "search": query.search})

    def append(self, name: str, rows: DataFrame) -> int:
        """Add the rows whose docno the index lacks, under docids that follow its largest; the number added. Run again, it adds nothing.

        The new documents are a batch of their own with its part of the lexicon; nothing that is there is written again but,
        now and then, the lexicon."""
        m = self.metadata(name)
        if m is None:
            raise ValueError(f"no index {name!r}")
        config, query = self._options(m)
        built = self._index(config, m["batches"], m["lexicons"])
        each = each_docno(rows)
        batch = f"batch-{uuid.uuid4().hex[:12]}"
        path = f"{self._path(name)}/{batch}"
        ix.document_table(each, config).join(built.docs.select("docno"), "docno", "left_anti").write.parquet(f"{path}/added")
        names = self.spark.read.parquet(f"{path}/added")
        added = names.count()
        if not added:
            self._fs(path)[0].delete(self._fs(path)[1], True)
            return 0
        first = int(built.docs.agg(F.coalesce(F.max("docid"), F.lit(-1))).first()[0]) + 1
        ordinals(names, "docid", "place", ties=("docno",)).select("docno", (F.col("place") + first).alias("docid"), "len").write.parquet(f"{path}/names")
        names = self.spark.read.parquet(f"{path}/names")
        # Texts meet the numbers of the new documents alone, and are neither sorted nor, for a small batch, shuffled for it.
        given = lambda part: each.select("docno", "text").join(part.select("docno", "docid"), "docno")
        numbered = given(F.broadcast(names) if added <= FEW else names.hint("shuffle_hash"))
        few = lambda part: given(F.broadcast(names.sample(part, 1)))
        ix.write(self.spark, ix.sorted_terms(numbered, names, config, few), names, config, path)
        batches, lexicons = [*m["batches"], batch], [*m["lexicons"], batch]
        if len(lexicons) >= self.compact:
            one = f"lexicon-{uuid.uuid4().hex[:12]}"
            whole = self._index(config, batches, lexicons).lexicon
            whole.repartitionByRange("tok").sortWithinPartitions("tok").write.parquet(f"{self._path(name)}/{one}/lexicon")
            lexicons = [one]
        self._commit(name, self._row(config, query, batches, lexicons))
        return added

    def rename(self, old: str, new: str) -> None:
        if self.exists(new):
            raise ValueError(f"index {new!r} is there already")
        if not self.exists(old):
            raise ValueError(f"no index {old!r}")
        self.flush(old)
        fs, where = self._fs(self._path(old))
        fs.rename(where, self._fs(self._path(new))[1])
        self._commit(new, self.metadata(new))

    def delete(self, name: str) -> bool:
        self.flush(name)
        fs, where = self._fs(self._path(name))
        return bool(fs.delete(where, True))

    def merge(self, names: list[str], into: IndexConfig) -> ix.Index:
        """One index of several with the same options and docnos of their own; docid is docno. Of a docno that several
        have, the first index's document counts. The lists' codec is the new index's own."""
        found = [self.load(n) for n in names]
        if not all(found):
            raise ValueError("not all indexes are there")
        same_options([f[0].config for f in found] + [into])
        docs, posts = None, None
        for part, (built, _) in enumerate(found):
            d = built.docs.withColumn("part_id", F.lit(part))
            p = built.postings.withColumn("part_id", F.lit(part))
            docs, posts = (d, p) if docs is None else (docs.unionByName(d), posts.unionByName(p))
        keep = docs.groupBy("docno").agg(F.min(F.struct("part_id", "docid", "len")).alias("at")).select("docno", "at.*")
        whole = posts.join(keep.select("part_id", "docid", "docno").hint("shuffle_hash"), ["part_id", "docid"]).select("tok", F.col("docno").alias("docid"), "tf", "len")
        batch = f"batch-{uuid.uuid4().hex[:12]}"
        ix.write(self.spark, ix.sorted_counts(whole, into), keep.select(F.col("docno").alias("docid"), "docno", "len"), into, f"{self._path(into.name)}/{batch}")
        self._commit(into.name, self._row(into, QueryConfig(), [batch], [batch]))
        return self._index(into, [batch], [batch])
