"""Removal of repeated multi-line chunks, with chunk boundaries chosen by content. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import Cut, packed

BASE = 8191


def _line_hashes(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long"))


def _starts(hashes: Column, divisor: int) -> Column:
    """Indices of lines at which a chunk starts: the first, and each after two lines whose rolling hash is 0 mod divisor."""
    rolling = lambda i: (F.get(hashes, i - 2) * BASE + F.get(hashes, i - 1)) % divisor
    return F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: (i == 0) | ((i >= 2) & (rolling(i) == 0)))


def _chunks(starts: Column, n: Column, min_lines: int) -> Column:
    """(start, end) of the chunks of at least min_lines lines."""
    every = F.transform(starts, lambda s, k: F.struct(s.alias("s"), F.coalesce(F.get(starts, k + 1), n).alias("e")))
    return F.filter(every, lambda c: c.e - c.s >= min_lines)


def deduplicate(
    spark: SparkSession,
    docs: DataFrame,
    divisor: int = 3,
    min_lines: int = 2,
    digits: int = 32,
) -> DataFrame:
    """(row, text, n_lines, n_removed) for each row of docs(doc_id, text, ...): its text without repeated chunks.

    Lines are hashed; a chunk ends where the rolling hash of two line hashes is 0 modulo `divisor`, so that the same
    passage is cut alike wherever it stands. A chunk of at least min_lines lines, however short, that
    occurs more than once, compared byte by byte, stays at its first place (smallest doc_id, then line) alone. Places are
    found by fingerprints of `digits` hexadecimal digits; those of fingerprints that different chunks share, by the chunks themselves.

    Null text stays null with 0 lines; empty text is one line; rows equal in doc_id and text are one document and get
    the same result; an empty table gives an empty result; extra columns come back untouched in `row`.
    """
    cut = Cut(spark)
    keyed = packed(docs, doc_id=F.coalesce(docs["doc_id"], F.lit(-(2**63) + 1)), text=docs["text"], key=F.xxhash64(docs["text"]))
    lines = keyed.where("text is not null").select("doc_id", "key", "text", _line_hashes(F.col("text")).alias("hashes"))
    chunks = lines.select("doc_id", "key", "text", F.explode(_chunks(_starts(F.col("hashes"), divisor), F.size("hashes"), min_lines)).alias("c"))
    chunks = chunks.select("doc_id", "key", "c.s", "c.e", F.array_join(F.slice(F.split("text", "\n", -1), F.col("c.s") + 1, F.col("c.e") - F.col("c.s")), "\n").alias("chunk"))
    chunks = chunks.withColumn("print", F.unhex(F.substring(F.md5("chunk"), 1, digits)))
    # Grouping by the chunk itself is the byte comparison; copies meet within a task before anything is shuffled.
    same = lambda df: df.groupBy("print", "chunk").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "s")).alias("at"))
    prints = cut(same(chunks).groupBy("print").agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.min("at").alias("at")).where("n > 1"))
    places = chunks.select("doc_id", "key", "s", "e", "print").join(prints.where("texts = 1").select("print", "at"), "print").drop("print")
    shared = prints.where("texts > 1").select("print")
    if not shared.isEmpty():
        bytes_ = chunks.join(shared, "print", "left_semi")
        places = places.union(bytes_.join(same(bytes_).where("n > 1"), ["print", "chunk"]).select("doc_id", "key", "s", "e", "at"))
    places = places.where((F.col("doc_id") != F.col("at.doc_id")) | (F.col("s") != F.col("at.s")))
    removed = places.groupBy("doc_id", "key").agg(F.collect_set(F.struct("s", "e")).alias("gone"))
    found = keyed.join(removed, ["doc_id", "key"], "left")
    kept = F.flatten(
        F.transform(
            F.array_sort(F.concat("gone", F.array(F.struct(F.size("all").alias("s"), F.size("all").alias("e"))))),
            lambda c, k: F.slice(F.col("all"), F.coalesce(F.get(F.col("ends"), k - 1), F.lit(0)) + 1, c.s - F.coalesce(F.get(F.col("ends"), k - 1), F.lit(0))),
        )
    )
    found = found.withColumn("all", F.split("text", "\n", -1)).withColumn("ends", F.transform(F.array_sort("gone"), lambda c: c.e))
    return found.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.coalesce(F.size("all"), F.lit(0)).alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.aggregate("gone", F.lit(0), lambda a, c: a + c.e - c.s)).alias("n_removed"),
    )


def _windows(lines: Column, min_lines: int, min_chars: int) -> Column:
    """(s, e, print) of the shortest run of at least min_lines lines and min_chars characters from each line on, and of
    the shortest up to each line. Any longer run is covered by those inside it."""

    def shortest(sizes: Column, i: Column, step: int) -> Column:
        """The number of lines from line i on (step 1) or backwards (step -1); null where the text is too short."""
        n = F.size(sizes)
        reach = max(min_lines, min_chars + 1) - 1  # a line adds a character at least
        last = F.least(i + reach, n - 1) if step > 0 else F.greatest(i - reach, F.lit(0))

        def add(a: Column, k: Column) -> Column:
            chars, count = a.chars + F.get(sizes, k) + 1, a.n + 1
            more = F.struct(chars.alias("chars"), count.alias("n"), ((count >= min_lines) & (chars >= min_chars)).alias("full"))
            return F.when(a.full, a).otherwise(more)

        def over(end: Column) -> Column:
            return F.aggregate(F.sequence(i, end, F.lit(step)), F.struct(F.lit(-1).alias("chars"), F.lit(0).alias("n"), F.lit(False).alias("full")), add, lambda a: F.when(a.full, a.n))

        near = F.least(i + min_lines - 1, n - 1) if step > 0 else F.greatest(i - min_lines + 1, F.lit(0))
        return F.coalesce(over(near), over(last))

    place = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))

    def both(sizes: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(sizes) - 1)
        onward = F.transform(every, lambda i: place(i, i + shortest(sizes, i, 1)))
        back = F.transform(every, lambda i: place(i + 1 - shortest(sizes, i, -1), i + 1))
        return F.flatten(F.transform(F.array(onward), lambda o: F.concat(o, F.filter(back, lambda b: b.s.isNotNull() & ~F.get(o, b.s).e.eqNullSafe(b.e)))))

    found = F.flatten(F.transform(F.array(F.transform(lines, lambda x: F.length(x))), both))
    run = lambda c: F.array_join(F.slice(lines, c.s + 1, c.e - c.s), "\n")
    return F.transform(F.filter(found, lambda c: c.e.isNotNull()), lambda c: F.struct(c.s.alias("s"), c.e.alias("e"), F.unhex(F.sha2(run(c), 256)).alias("print")))


def remove_repeats(spark: SparkSession, docs: DataFrame, min_lines: int = 2, min_chars: int = 80) -> DataFrame:
    """(row, text, n_lines, n_removed) as deduplicate gives, without any repeated run of lines, wherever it stands.

    A line goes if it lies in a run of at least min_lines lines and min_chars characters that stands at an earlier
    place too (by doc_id, hash of the text, line), not overlapping it; so the first place of every line stays. Runs
    are equal by their SHA-256. Odd rows are treated as by deduplicate; rows equal in doc_id alone are different documents.
    """
    keyed = packed(docs, doc_id=F.coalesce(docs["doc_id"], F.lit(-(2**63) + 1)), text=docs["text"], key=F.xxhash64(docs["text"]))
    lines = keyed.where("text is not null").select("doc_id", "key", F.split("text", "\n", -1).alias("all"))
    windows = Cut(spark)(lines.select("doc_id", "key", F.inline(_windows(F.col("all"), min_lines, min_chars))))
    place = F.struct("doc_id", "key", "s")
    repeated = windows.groupBy("print").agg(F.min(place).alias("at"), F.max(place).alias("last")).where("at <> last").select("print", "at")
    places = windows.join(repeated, "print").where("doc_id <> at.doc_id or key <> at.key or s - at.s >= e - s")
    removed = places.groupBy("doc_id", "key").agg(F.flatten(F.collect_set(F.sequence("s", F.col("e") - 1))).alias("gone"))
    found = keyed.join(removed, ["doc_id", "key"], "left").withColumn("all", F.split("text", "\n", -1))
    found = found.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size("all") - 1), "gone"))
    return found.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("kept", lambda i: F.get("all", i)), "\n")).alias("text"),
        F.coalesce(F.size("all"), F.lit(0)).alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("all") - F.size("kept")).alias("n_removed"),
    )


ORACLE = r"""
with l as (select doc_id, text, string_split(text, chr(10)) as ls from documents where text is not null),
h as (select doc_id, text, ls, [('0x' || substr(md5(x), 1, 7))::bigint for x in ls] as hs from l),
b as (select doc_id, text, ls, [i for i in range(len(ls)) if i = 0 or (i >= 2 and (hs[i - 1] * 8191 + hs[i]) % 3 = 0)] as st from h),
c as (select doc_id, text, ls, unnest([{'s': st[k], 'e': coalesce(st[k + 1], len(ls))} for k in range(1, len(st) + 1)]) as c from b),
d as (select doc_id, c.s as s, c.e as e, array_to_string(ls[c.s + 1 : c.e], chr(10)) as chunk from c where c.e - c.s >= 2),
g as (select chunk, count(*) as n, min({'d': doc_id, 's': s}) as first from d group by chunk having count(*) > 1),
x as (select d.doc_id, d.s, d.e from d join g using (chunk) where d.doc_id <> g.first.d or d.s <> g.first.s),
p as (select doc_id, s, e, unnest(range(s, e)) as i from x),
r as (select doc_id, list(i) as gone from p group by doc_id)
select o.doc_id, coalesce(len(string_split(o.text, chr(10))), 0)::integer as n_lines, coalesce(len(r.gone), 0)::integer as n_removed,
  md5(case when o.text is null then null when r.gone is null then o.text
    else array_to_string([string_split(o.text, chr(10))[i + 1] for i in range(len(string_split(o.text, chr(10)))) if not list_contains(r.gone, i)], chr(10)) end) as kept_md5
from documents o left join r on o.doc_id = r.doc_id
"""
