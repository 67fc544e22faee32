"""Queries of the retrieval engine over the documents table, by name, and the DuckDB SQL of each where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..config import IndexConfig, QueryConfig
from ..functions.charts import distinct_color
from ..functions.codec import decode_blocks, decode_udf, encode_blocks, from_gaps_udf, gamma, gaps, pack_udf, unary
from ..functions.porter import stem_udf
from ..functions.text import STOP_WORDS, clean, typed_key
from ..operators import index as ix
from ..operators import evaluate, lookup, merge, metrics
from ..operators.order import BITS
from ..operators.search import candidates, pruned_search, search, search_one
from ..sources import collections
from ..sources.pairs import read_pairs
from ..streaming.incremental import follow
from . import corpus
from .porter_sql import stems

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOPICS = [(1, "anat ouen"), (2, "the of in"), (3, "adoci aielle the"), (4, "anat zzzz"), (5, "la de que"), (6, "anat anat ouen")]
ONE = "adoci aielle the"
BOTH = "anat ouen"

# ---- pieces of SQL ----
TOKENS = "toks as (select doc_id, unnest(string_split(trim(lower(regexp_replace(text, '[^a-zA-Z0-9]+', ' ', 'g'))), ' ')) as tok from documents where text <> '' and doc_id is not null)"
POSTINGS = f"{TOKENS}, post as (select tok, doc_id, count(*)::integer as tf from toks group by tok, doc_id)"
DOCS = f"{POSTINGS}, docs as (select doc_id, count(*)::integer as len from toks group by doc_id), lex as (select tok, count(*)::bigint as df, sum(tf)::bigint as cf from post group by tok), st as (select count(*)::bigint as n_docs, sum(len)::bigint as total_len, avg(len)::double as avg_len from docs)"
WEIGHTS = {
    "TFIDF": "(1 + ln(tf::double)) * idf",
    "BM25": "idf * tf / (tf + 1.2::double * (0.25::double + 0.75::double * len / avg_len))",
    "BM11": "idf * tf / (tf + 1.2::double * len / avg_len)",
    "BM15": "idf / 1.2::double",
}


def scored_sql(scoring: str, method: str, topics: str) -> str:
    """CTEs up to scored(qid, doc_id, score, pos); topics: a SELECT of qid and query."""
    out = f"""with {DOCS}, topic as ({topics}),
qt as (select qid, generate_subscripts(string_split(trim(lower(regexp_replace(query, '[^a-zA-Z0-9]+', ' ', 'g'))), ' '), 1) as pos,
  unnest(string_split(trim(lower(regexp_replace(query, '[^a-zA-Z0-9]+', ' ', 'g'))), ' ')) as tok from topic),
q as (select qid, tok, min(pos) as pos from qt group by qid, tok),
nq as (select qid, count(*) as n_terms from q group by qid),
hit as (select q.qid, post.doc_id, q.pos, post.tf, docs.len, st.avg_len, ln(st.n_docs::double / lex.df) as idf
  from q join post using (tok) join lex using (tok) join docs using (doc_id) cross join st),
per as (select qid, doc_id, sum({WEIGHTS[scoring]} order by pos) as score, min(pos) as pos, count(*) as matched from hit group by qid, doc_id)"""
    if method == "conjunctive":
        return out + """,
scored as (select qid, doc_id, round(case when matched = n_terms then score else 0 end, 6) as score, pos from per join nq using (qid)
  where qid in (select qid from per join nq using (qid) where matched = n_terms))"""
    return out + ",\nscored as (select qid, doc_id, round(score, 6) as score, pos from per)"


def topk_sql(scoring: str, method: str, topics: str, k: int) -> str:
    return f"""{scored_sql(scoring, method, topics)},
ranked as (select qid, row_number() over (partition by qid order by score desc, pos, doc_id) as rank, doc_id, score from scored)
select qid::bigint as qid, rank::integer as rank, doc_id, doc_id as docno, score from ranked where rank <= {k}"""


TOPIC_SQL = "select * from (values " + ", ".join(f"({i}, '{q}')" for i, q in TOPICS) + ") t(qid, query)"
BENCH_SQL = "select item_id as qid, text as query from benchmark"
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
QREL_SQL = "select t.qid::bigint as qid, l.doc_id, (l.quality * (1 + (case when l.doc_id % 3 = t.qid % 3 then 1 else 0 end)))::integer as rel from labels l cross join (" + TOPIC_SQL + ") t"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOPICS, "qid long, query string")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded stand-ins from labels, for each of the few topics."""
    judged = spark.read.parquet(f"{sf_dir}/labels.parquet")
    qid = F.explode(F.array(*[F.lit(i).cast("long") for i, _ in TOPICS])).alias("qid")
    rel = F.col("quality") * (1 + F.when(F.col("doc_id") % 3 == F.col("qid") % 3, 1).otherwise(0))
    return judged.select("*", qid).select("qid", F.col("doc_id").alias("docid"), rel.cast("int").alias("rel"))


# ---- text and build ----
@query("select doc_id, md5(trim(lower(regexp_replace(text, '[^a-zA-Z0-9]+', ' ', 'g')))) as clean_md5, length(trim(lower(regexp_replace(text, '[^a-zA-Z0-9]+', ' ', 'g'))))::integer as clean_len from documents where text <> ''")
def clean_text(spark, sf_dir):
    return corpus.rows(spark, sf_dir).select(F.col("docid").alias("doc_id"), F.md5(clean(F.col("text"))).alias("clean_md5"), F.length(clean(F.col("text"))).alias("clean_len"))


@query(f"with {POSTINGS} select tok, doc_id, tf from post")
def token_counts(spark, sf_dir):
    return ix.term_counts(corpus.rows(spark, sf_dir), IndexConfig()).withColumnRenamed("docid", "doc_id")


@query(f"with {POSTINGS} select count(*)::bigint as postings, count(distinct tok)::bigint as terms, sum(tf)::bigint as occurrences from post")
def index_build(spark, sf_dir):
    """A whole build: analyse, count, sort, write, read back."""
    built = ix.build(spark, corpus.rows(spark, sf_dir), IndexConfig("fresh"), f"{corpus.work_dir(spark)}/fresh")
    return built.postings.agg(F.count("*").alias("postings"), F.sum("tf").cast("long").alias("occurrences")).crossJoin(built.lexicon.agg(F.count("*").alias("terms")))


@query(f"with {POSTINGS} select tok, doc_id, tf from post")
def postings(spark, sf_dir):
    return corpus.index(spark, sf_dir).postings.select("tok", F.col("docid").alias("doc_id"), "tf")


@query(f"with {DOCS} select doc_id, len from docs")
def doc_table(spark, sf_dir):
    return corpus.index(spark, sf_dir).docs.select(F.col("docid").alias("doc_id"), "len")


@query(f"with {DOCS} select tok, df, cf from lex")
def lexicon(spark, sf_dir):
    return corpus.index(spark, sf_dir).lexicon.select("tok", "df", "cf")


@query(f"with {DOCS} select tok, max(tf)::integer as max_tf, min(len)::integer as min_len from post join docs using (doc_id) group by tok")
def term_bounds(spark, sf_dir):
    return corpus.index(spark, sf_dir).lexicon.select("tok", "max_tf", "min_len")


@query(f"with {DOCS} select n_docs, total_len, round(avg_len, 6) as avg_len, (select count(*) from lex)::bigint as n_terms from st")
def collection_stats(spark, sf_dir):
    built = corpus.index(spark, sf_dir)
    return ix.statistics(built.docs, built.lexicon).withColumn("avg_len", F.round("avg_len", 6))


@query(f"with {TOKENS} select tok, doc_id, count(*)::integer as tf from toks where tok not in {STOP_SQL} group by tok, doc_id")
def stopword_postings(spark, sf_dir):
    return ix.term_counts(corpus.rows(spark, sf_dir), IndexConfig(keep_stop=False)).withColumnRenamed("docid", "doc_id")


@query(f"with {TOKENS}, kept as (select doc_id, count(*)::integer as len from toks where tok not in {STOP_SQL} group by doc_id) select d.doc_id, coalesce(kept.len, 0)::integer as len from (select doc_id from documents where text <> '') d left join kept using (doc_id)")
def stopword_doc_table(spark, sf_dir):
    return ix.document_table(corpus.rows(spark, sf_dir), IndexConfig(keep_stop=False)).select(F.col("docid").alias("doc_id"), "len")


STEMS = f"{DOCS}, stems as ({stems('(select tok from lex)')})"


@query(f"with {STEMS}, sp as (select stem, doc_id, sum(tf) as tf from post join stems using (tok) group by stem, doc_id) select stem as tok, count(*)::bigint as df, sum(tf)::bigint as cf from sp group by stem")
def stemmed_lexicon(spark, sf_dir):
    return corpus.index(spark, sf_dir, IndexConfig("stemmed", stem=True)).lexicon.select("tok", "df", "cf")


@query(f"with {STEMS} select tok, stem from stems")
def stemmed_terms(spark, sf_dir):
    return corpus.index(spark, sf_dir).lexicon.select("tok", stem_udf()("tok").alias("stem"))


@query(f"with {STEMS}, sp as (select stem, doc_id, sum(tf) as tf from post join stems using (tok) where tok not in {STOP_SQL} group by stem, doc_id) select stem as tok, doc_id, tf::integer as tf from sp")
def stop_stem_postings(spark, sf_dir):
    """Stop words are left out before stemming."""
    return ix.term_counts(corpus.rows(spark, sf_dir), IndexConfig(stem=True, keep_stop=False)).withColumnRenamed("docid", "doc_id")


@query("select min(doc_id)::bigint as docid, n_chars::bigint as docno, md5(arg_min(text, doc_id)) as text_md5 from documents where text <> '' group by n_chars")
def dedup_first(spark, sf_dir):
    """Documents that share a docno, here their length: the first of each stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text <> ''")
    rows = docs.select(F.col("doc_id").cast("long").alias("docid"), F.col("n_chars").cast("long").alias("docno"), "text")
    return collections.first_by_docno(rows).select("docid", "docno", F.md5("text").alias("text_md5"))


@query("select doc_id, md5(text) as text_md5 from (select * from documents order by doc_id nulls last, text limit 50) where text <> '' and doc_id is not null")
def limit_rows(spark, sf_dir):
    """The row limit of a collection: bad rows count."""
    rows, _ = collections.from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), 50)
    return rows.select(F.col("docno").alias("doc_id"), F.md5("text").alias("text_md5"))


# ---- files ----
LINE_SQL = r"trim(regexp_replace(text, '[\t\n\x0B\f\r ]+', ' ', 'g'))"
LINES_SQL = f"lines as (select doc_id, {LINE_SQL} as line, row_number() over (order by doc_id) - 1 as docid from documents where text is not null and doc_id is not null)"


def _lines(spark, sf_dir, path: str, **options) -> str:
    """The collection as files of numbered lines, in order of doc_id over all files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null and doc_id is not null")
    line = F.trim(F.regexp_replace("text", "[\\t\\n\\x0B\\f\\r ]+", " "))
    docs.select("doc_id", F.concat_ws("\t", "doc_id", line).alias("value")).repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("value").write.options(**options).text(path)
    return path


def _read(spark, sf_dir, kind: str, **options):
    rows, bad = collections.read_collection(spark, _lines(spark, sf_dir, corpus.fresh(spark, kind), **options))
    return rows.select("docid", "docno", F.md5("text").alias("text_md5")), bad


@query(f"with {LINES_SQL} select docid, doc_id as docno, md5(line) as text_md5 from lines where line <> ''")
def read_tsv(spark, sf_dir):
    """Lines of many files, written and read back; ordinals go on over files and splits."""
    return _read(spark, sf_dir, "tsv")[0]


@query(f"with {LINES_SQL} select docid, doc_id as docno, md5(line) as text_md5 from lines where line <> ''")
def read_gz(spark, sf_dir):
    return _read(spark, sf_dir, "gz", compression="gzip")[0]


@query(f"with {LINES_SQL} select docid, doc_id::varchar as line from lines where line = ''")
def rejected_lines(spark, sf_dir):
    """Lines that are their number alone: what follows it, a tab and blanks, is not shown."""
    return _read(spark, sf_dir, "bad")[1].withColumn("line", F.regexp_replace("line", r"\s+$", ""))


@query("select doc_id::varchar as key, n_chars::bigint as a, (n_chars % 7)::bigint as b from documents where doc_id is not null")
def pairs_file(spark, sf_dir):
    """A key to two numbers, each key written twice: the last line counts, and no number is 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    both = docs.select("doc_id", "n_chars", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    second = F.when(F.col("n_chars") % 7 == 0, F.lit("")).otherwise((F.col("n_chars") % 7).cast("string"))
    value = F.concat_ws(",", "doc_id", F.when(F.col("again") == 1, F.col("n_chars")).otherwise(F.lit(-1)), F.when(F.col("again") == 1, second).otherwise(F.lit("5")))
    path = corpus.fresh(spark, "pairs")
    both.repartitionByRange("again", "doc_id").sortWithinPartitions("again", "doc_id").select(value.alias("value")).write.text(path)
    return read_pairs(spark, path)


@query("select doc_id, coalesce(try_cast(regexp_replace(source, '[^0-9]', '', 'g') as bigint), 0) as key from documents where source is not null")
def typed_keys(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source is not null")
    return docs.select("doc_id", typed_key(F.regexp_replace("source", "[^0-9]", "")).alias("key"))


@query(r"select item_id::bigint as qid, md5(regexp_replace(text, '[\t\n\r ]', ' ', 'g')) as query_md5 from benchmark")
def topics_file(spark, sf_dir):
    """Topics written with their blanks as tabs and read back joined by blanks."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    path = corpus.fresh(spark, "topics")
    items.select(F.concat_ws("\t", "item_id", F.regexp_replace("text", "[\\t\\n\\r ]", "\t")).alias("value")).write.text(path)
    return collections.topics(spark, path).select("qid", F.md5("query").alias("query_md5"))


@query("select (doc_id % 4)::bigint as qid, doc_id::bigint as docid, (quality + toxic)::integer as rel from labels")
def qrels_file(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    path = corpus.fresh(spark, "qrels")
    labels.select(F.concat_ws(" ", (F.col("doc_id") % 4).cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), (F.col("quality") + F.col("toxic")).cast("string")).alias("value")).write.text(path)
    return collections.qrels(spark, path)


@query("select doc_id, n_chars from documents where doc_id >= 100 and doc_id < 200")
def row_fetch_range(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("docno", F.col("doc_id"))
    return collections.fetch(rows, 100, 200).select("doc_id", "n_chars")


@query("select doc_id, md5(text) as text_md5 from documents where doc_id = 126")
def row_fetch(spark, sf_dir):
    return collections.fetch(corpus.rows(spark, sf_dir), 126).select(F.col("docno").alias("doc_id"), F.md5("text").alias("text_md5"))


# ---- lookups ----
@query(f"with {DOCS} select tok, df from lex where tok in ('anat', 'the', 'zzzz')")
def lexicon_lookup(spark, sf_dir):
    return lookup.any_of(corpus.index(spark, sf_dir).lexicon, "tok", ["anat", "the", "zzzz"]).select("tok", "df")


@query(f"with {DOCS} select tok, df from lex where tok >= 'anau' order by tok limit 1")
def next_geq_term(spark, sf_dir):
    return lookup.next_geq(corpus.index(spark, sf_dir).lexicon, "tok", "anau").select("tok", "df")


@query(f"with {DOCS} select tok, df from lex order by tok desc limit 1")
def last_term(spark, sf_dir):
    return lookup.last_row(corpus.index(spark, sf_dir).lexicon, "tok").select("tok", "df")


@query(f"with {DOCS} select doc_id, len from docs where len > 0")
def length_lookup(spark, sf_dir):
    """Lengths of all documents, asked for by id."""
    wanted = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("docid"))
    return lookup.document_lengths(corpus.index(spark, sf_dir).docs, wanted).withColumnRenamed("docid", "doc_id")


@query(f"with {POSTINGS} select tok, min(doc_id)::bigint as doc_id from post where doc_id >= 500 group by tok")
def posting_next_geq(spark, sf_dir):
    return lookup.next_posting(corpus.index(spark, sf_dir).postings, 500).withColumnRenamed("docid", "doc_id")


@query(f"with {POSTINGS}, b as (select tok, doc_id >> 16 as block, list(doc_id order by doc_id) as d, list(tf order by doc_id) as f from post group by all), c as (select tok, block, d, f, unnest(range(1, least(len(d), 2) + 1)) as k from b) select tok, block::bigint as block, (k - 1)::integer as at, d[k] as doc_id, f[k]::integer as freq from c")
def posting_cursor(spark, sf_dir):
    """The first places of each block's list, reached by a cursor that moves on."""
    lists = ix.posting_blocks(corpus.index(spark, sf_dir).postings)
    first = lookup.cursor(F.col("docids"), F.col("freqs"), 0)
    both = lists.withColumn("first", first).withColumn("second", lookup.cursor(F.col("docids"), F.col("freqs"), F.col("first.next")))
    places = both.select("tok", "block", F.posexplode(F.array("first", "second")).alias("at", "c"))
    return places.where("c is not null").select("tok", "block", "at", F.col("c.docid").alias("doc_id"), F.col("c.freq").alias("freq"))


# ---- posting lists and codecs ----
BLOCKS_SQL = f"{POSTINGS}, blocks as (select tok, doc_id >> {BITS} as block, list(doc_id order by doc_id) as d, list(tf order by doc_id) as f from post group by all)"


@query(f"with {BLOCKS_SQL} select tok, block::bigint as block, array_to_string(d, ',') as docids, array_to_string(f, ',') as freqs from blocks")
def posting_lists(spark, sf_dir):
    """Lists in blocks of ids, so that none grows with the collection."""
    lists = ix.posting_blocks(corpus.index(spark, sf_dir).postings)
    return lists.select("tok", "block", F.array_join(F.col("docids").cast("array<string>"), ",").alias("docids"), F.array_join(F.col("freqs").cast("array<string>"), ",").alias("freqs"))


@query(f"with {POSTINGS} select tok, doc_id, (doc_id - lag(doc_id, 1, 0) over (partition by tok order by doc_id))::bigint as gap from post")
def posting_gaps(spark, sf_dir):
    return ix.posting_gaps(corpus.index(spark, sf_dir).postings.select("tok", "docid")).withColumnRenamed("docid", "doc_id")


@query(f"with {POSTINGS} select tok, doc_id from post")
def gap_decode(spark, sf_dir):
    gapped = ix.posting_gaps(corpus.index(spark, sf_dir).postings.select("tok", "docid")).withColumnRenamed("docid", "at")
    return ix.gap_decode(gapped).select("tok", F.col("docid").alias("doc_id"))


NUMBERS = "(select distinct tf as n from post)"


@query(f"with {POSTINGS} select n, repeat('1', n - 1) || '0' as bits from {NUMBERS}")
def unary_bits(spark, sf_dir):
    return corpus.index(spark, sf_dir).postings.select(F.col("tf").alias("n")).distinct().select("n", unary(F.col("n")).alias("bits"))


@query(f"with {POSTINGS} select n, repeat('1', length(bin(n)) - 1) || '0' || substr(bin(n), 2) as bits from {NUMBERS}")
def gamma_bits(spark, sf_dir):
    return corpus.index(spark, sf_dir).postings.select(F.col("tf").alias("n")).distinct().select("n", gamma(F.col("n")).alias("bits"))


@query(
    f"with {POSTINGS}, g as (select tok, tf, doc_id - lag(doc_id, 1, -1) over (partition by tok order by doc_id) as gap from post), b as (select tok, sum(gap + tf)::bigint as unary_bits, sum(2 * (length(bin(gap)) - 1) + 1 + 2 * (length(bin(tf)) - 1) + 1)::bigint as gamma_bits from g group by tok) select tok, unary_bits, gamma_bits, ceil(gamma_bits / 8)::bigint as gamma_bytes from b"
)
def compressed_size(spark, sf_dir):
    """Sizes from code lengths alone; no list is gathered."""
    gapped = ix.posting_gaps(corpus.index(spark, sf_dir).postings.select("tok", "docid", "tf"), -1)
    bits = lambda c: 2 * (F.length(F.bin(c)) - 1) + 1
    out = gapped.groupBy("tok").agg(F.sum(F.col("gap") + F.col("tf")).cast("long").alias("unary_bits"), F.sum(bits(F.col("gap")) + bits(F.col("tf"))).cast("long").alias("gamma_bits"))
    return out.withColumn("gamma_bytes", F.ceil(F.col("gamma_bits") / 8).cast("long"))


NIBBLE_SQL = "substr('0123456789ABCDEF', (8 * (substr(bits, 4 * i + 1, 1) = '1')::int + 4 * (substr(bits, 4 * i + 2, 1) = '1')::int + 2 * (substr(bits, 4 * i + 3, 1) = '1')::int + (substr(bits, 4 * i + 4, 1) = '1')::int + 1)::int, 1)"


def packed_sql(values: str, code: str) -> str:
    """CTEs after `blocks`: packed(tok, block, n, hex) of each list of `values` of a block, by the code of a number v."""
    return f"""bits as (select tok, block, len(d) as n, array_to_string([{code} for v in {values}], '') as raw from blocks),
full_ as (select tok, block, n, rpad(raw, (8 * ceil(length(raw) / 8.0))::int, '1') as bits from bits),
packed as (select tok, block, n, array_to_string([{NIBBLE_SQL} for i in range(0, (length(bits) // 4)::int)], '') as hex from full_)"""


UNARY_SQL = "repeat('1', (v - 1)::int) || '0'"
GAMMA_SQL = "repeat('1', length(bin(v)) - 1) || '0' || substr(bin(v), 2)"
CODED_SQL = f"list_concat([(case when k = 1 then d[1] - (block << {BITS}) + 1 else d[k] - d[k - 1] end)::bigint for k in range(1, len(d) + 1)], f::bigint[])"


@query(f"with {BLOCKS_SQL}, {packed_sql(CODED_SQL, GAMMA_SQL)} select tok, block::bigint as block, n::integer as n, md5(hex) as code_md5, true as ok from packed")
def codec_roundtrip(spark, sf_dir):
    """The bytes of each block's gaps and frequencies, and whether they decode to what they were."""
    lists = ix.posting_blocks(corpus.index(spark, sf_dir).postings)
    start = F.shiftleft("block", BITS)
    out = lists.withColumn("code", encode_blocks("gamma")(F.col("docids"), F.col("freqs"), start)).withColumn("back", decode_blocks("gamma")(F.col("code"), start))
    return out.select("tok", "block", F.size("docids").alias("n"), F.md5(F.hex("code")).alias("code_md5"), ((F.col("back.docids") == F.col("docids")) & (F.col("back.freqs") == F.col("freqs"))).alias("ok"))


@query(f"with {BLOCKS_SQL}, {packed_sql('f', UNARY_SQL)} select p.tok, p.block::bigint as block, p.n::integer as n, md5(hex) as code_md5, list_sum(b.f)::bigint as total from packed p join blocks b using (tok, block)")
def unary_frequencies(spark, sf_dir):
    """Frequencies packed by the unary code and read back."""
    lists = ix.posting_blocks(corpus.index(spark, sf_dir).postings)
    code = lists.withColumn("code", pack_udf("unary")(F.col("freqs").cast("array<bigint>"))).withColumn("back", decode_udf("unary")("code"))
    return code.select("tok", "block", F.size("docids").alias("n"), F.md5(F.hex("code")).alias("code_md5"), F.aggregate("back", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"with {BLOCKS_SQL} select tok, block::bigint as block, array_to_string(d, ',') as docids from blocks")
def list_gap_decode(spark, sf_dir):
    lists = ix.posting_blocks(corpus.index(spark, sf_dir).postings)
    return lists.select("tok", "block", F.array_join(from_gaps_udf()(gaps(F.col("docids"))).cast("array<string>"), ",").alias("docids"))


# ---- queries ----
def _one(method: str, scoring: str, text: str, k: int = 10):
    def run(spark, sf_dir):
        return search_one(spark, corpus.index(spark, sf_dir), text, QueryConfig(method, scoring, k))

    return run


for _short, _method in (("and", "conjunctive"), ("or", "disjunctive")):
    for _scoring in WEIGHTS:
        _text = BOTH if _short == "and" else ONE
        _name = f"{_short}_{_scoring.lower()}_topk"
        QUERIES[_name] = _one(_method, _scoring, _text)
        ORACLES[_name] = f"select rank, doc_id as docid, docno, score from ({topk_sql(_scoring, _method, f'''select 0 as qid, '{_text}' as query''', 10)})"
QUERIES["and_unknown_term"] = _one("conjunctive", "BM25", "anat zzzz")
ORACLES["and_unknown_term"] = f"select rank, doc_id as docid, docno, score from ({topk_sql('BM25', 'conjunctive', '''select 0 as qid, 'anat zzzz' as query''', 10)})"
QUERIES["empty_query"] = _one("disjunctive", "TFIDF", "?!")
ORACLES["empty_query"] = f"select rank, doc_id as docid, docno, score from ({topk_sql('TFIDF', 'disjunctive', '''select 0 as qid, '?!' as query''', 10)})"


@query(f"{scored_sql('BM25', 'conjunctive', TOPIC_SQL)} select qid::bigint as qid, doc_id from per join nq using (qid) where matched = n_terms")
def and_candidates(spark, sf_dir):
    return candidates(corpus.index(spark, sf_dir), topics(spark), "conjunctive").withColumnRenamed("docid", "doc_id")


@query(f"{scored_sql('BM25', 'disjunctive', TOPIC_SQL)} select qid::bigint as qid, doc_id from per")
def or_candidates(spark, sf_dir):
    return candidates(corpus.index(spark, sf_dir), topics(spark), "disjunctive").withColumnRenamed("docid", "doc_id")


def _batch(method: str, scoring: str, k: int):
    def run(spark, sf_dir):
        asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
        return search(corpus.index(spark, sf_dir), asked, QueryConfig(method, scoring, k)).withColumnRenamed("docid", "doc_id")

    return run


for _name, _args in {"batch_bm25_topk": ("disjunctive", "BM25", 10), "batch_and_tfidf_topk": ("conjunctive", "TFIDF", 20), "batch_bm11_topk": ("disjunctive", "BM11", 10)}.items():
    QUERIES[_name] = _batch(*_args)
    ORACLES[_name] = topk_sql(_args[1], _args[0], BENCH_SQL, _args[2])


@query(f"select rank, doc_id as docid, docno, score from ({topk_sql('BM25', 'disjunctive', f'''select 0 as qid, '{ONE}' as query''', 10)})")
def pruned_bm25_topk(spark, sf_dir):
    return pruned_search(spark, corpus.index(spark, sf_dir), ONE, QueryConfig())


@query(f"select rank, doc_id as docid, docno, score from ({topk_sql('BM25', 'disjunctive', f'''select 0 as qid, '{ONE}' as query''', 10)})")
def always_pruned_bm25_topk(spark, sf_dir):
    """With a threshold sought whatever it saves."""
    return pruned_search(spark, corpus.index(spark, sf_dir), ONE, QueryConfig(), worth=0)


# ---- ranges and partitions ----
def _labelled(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("docno"))


RANGES_SQL = "v as (select distinct doc_id as v from documents where text <> '' and doc_id is not null), g as (select v, v - row_number() over (order by v) as island from v), ranges as (select min(v)::bigint as lo, max(v)::bigint as hi from g group by island)"


@query(f"with {RANGES_SQL} select lo, hi from ranges")
def content_ranges(spark, sf_dir):
    return ix.content_ranges(corpus.rows(spark, sf_dir))


@query(f"with {RANGES_SQL} select string_agg(lo::varchar || ',' || hi::varchar, ';' order by lo) as content, count(*)::bigint as n from ranges")
def ranges_text(spark, sf_dir):
    """The ranges as text and how many it reads back as."""
    ranges = ix.content_ranges(corpus.rows(spark, sf_dir)).orderBy("lo").collect()
    text = ix.ranges_to_text([(r["lo"], r["hi"]) for r in ranges])
    return spark.createDataFrame([(text, len(ix.ranges_from_text(text)))], "content string, n long")


@query("with v as (select distinct doc_id as v from labels), g as (select v, v - row_number() over (order by v) as island from v) select min(v)::bigint as lo, max(v)::bigint as hi from g group by island")
def judged_ranges(spark, sf_dir):
    """Of the labelled documents, which leave many gaps."""
    return ix.content_ranges(_labelled(spark, sf_dir))


@query("select i as docno from (select unnest(range(0, (select max(doc_id) + 1 from documents where text <> ''))) as i) where i not in (select doc_id from documents where text <> '' and doc_id is not null)")
def missing_ids(spark, sf_dir):
    return ix.missing_ids(corpus.rows(spark, sf_dir), spark)


@query("select i as docno from (select unnest(range(0, (select max(doc_id) + 1 from labels))) as i) where i not in (select doc_id from labels)")
def unjudged_ids(spark, sf_dir):
    return ix.missing_ids(_labelled(spark, sf_dir), spark)


@query(f"with {DOCS} select tok, df, cf from lex")
def partition_merge_lexicon(spark, sf_dir):
    docs, posts = merge.partitioned(corpus.rows(spark, sf_dir), IndexConfig(), 4)
    return merge.merged(docs, posts)[2]


@query("select doc_id as docno, row_number() over (order by doc_id) - 1 as global_id from documents where text <> ''")
def partition_renumber(spark, sf_dir):
    return merge.renumber(merge.split(corpus.rows(spark, sf_dir), 4)).select("docno", "global_id")


@query("select doc_id as docno, md5(text) as text_md5 from documents where text <> ''")
def partition_repair(spark, sf_dir):
    rows = corpus.rows(spark, sf_dir).select("docid", "docno", "text")
    last = int(rows.agg(F.max("docno")).first()[0])
    return merge.repaired(spark, rows.join(_labelled(spark, sf_dir), "docno", "left_semi"), rows, last).select("docno", F.md5("text").alias("text_md5"))


# ---- evaluation ----
RUN_SQL = topk_sql("TFIDF", "conjunctive", TOPIC_SQL, 20)
CUTS = (5, 10, 20)


def _run(spark, sf_dir):
    return search(corpus.index(spark, sf_dir), topics(spark), QueryConfig("conjunctive", "TFIDF", 20))


@query(f"select qid as query, 'q0' as q0, docno::varchar as docid, (rank - 1)::bigint as rank, score, 'main' as system from ({RUN_SQL})")
def trec_run(spark, sf_dir):
    return metrics.run_table(_run(spark, sf_dir), "main")



def metric_sql(run: str, cuts: tuple[int, ...]) -> str:
    """CTEs up to m, a row of measures for each judged topic of a run."""
    return f"""run as ({run}), qr as ({QREL_SQL}),
j as (select run.qid, run.rank, qr.rel, sum(case when rel > 0 then 1 else 0 end) over w as hits, sum(case when rel <= 0 then 1 else 0 end) over w as wrong
  from run left join qr on run.qid = qr.qid and run.docno = qr.doc_id window w as (partition by run.qid order by rank rows unbounded preceding)),
need as (select qid, sum(case when rel > 0 then 1 else 0 end) as r, sum(case when rel <= 0 then 1 else 0 end) as n from qr group by qid),
idl as (select qid, rel, row_number() over (partition by qid order by rel desc, doc_id) as place from qr where rel > 0),
best as (select qid, {", ".join(f"sum(case when place <= {k} then rel / log2(place + 1) else 0 end) as i{k}" for k in cuts)} from idl group by qid),
m as (select j.qid, count(*)::bigint as num_ret, any_value(r)::bigint as num_rel, sum(case when rel > 0 then 1 else 0 end)::bigint as num_rel_ret,
  sum(case when rel > 0 then hits / rank else 0 end) / any_value(r) as map, sum(case when rel > 0 and rank <= r then 1 else 0 end) / any_value(r) as rprec,
  coalesce(max(case when rel > 0 then 1 / rank end), 0) as recip_rank,
  sum(case when rel > 0 then (case when wrong = 0 then 1 else 1 - least(wrong, r) / least(r, n) end) else 0 end) / any_value(r) as bpref,
  {", ".join(f'sum(case when rel > 0 and rank <= {k} then 1 else 0 end) / {k} as p{k}, sum(case when rel > 0 and rank <= {k} then rel / log2(rank + 1) else 0 end) / any_value(i{k}) as ndcg{k}' for k in cuts)}
  from j join need using (qid) left join best using (qid) group by j.qid)"""


METRIC_SQL = metric_sql(RUN_SQL, CUTS)
METRIC_COLUMNS = {"map": "map", "Rprec": "rprec", "recip_rank": "recip_rank", "bpref": "bpref"} | {f"P@{k}": f"p{k}" for k in CUTS} | {f"NDCG@{k}": f"ndcg{k}" for k in CUTS}
ROUNDED = ", ".join(f"round({v}::double, 6) as {v}" for v in METRIC_COLUMNS.values())


def _per_topic(spark, sf_dir):
    return metrics.per_topic(_run(spark, sf_dir), qrels(spark, sf_dir), CUTS)


def _rounded(df, *first):
    return df.select(*first, *[F.round(F.col(f"`{k}`"), 6).alias(v) for k, v in METRIC_COLUMNS.items()])


@query(f"with {METRIC_SQL} select qid, num_ret, num_rel, num_rel_ret, {ROUNDED} from m")
def metrics_per_topic(spark, sf_dir):
    return _rounded(_per_topic(spark, sf_dir), "qid", "num_ret", "num_rel", "num_rel_ret")


@query(f"with {METRIC_SQL} select count(*)::bigint as num_q, sum(num_ret)::bigint as num_ret, round(exp(avg(ln(greatest(map, 1e-5::double)))), 6) as gm_map, {', '.join(f'round(avg({v}), 6) as {v}' for v in METRIC_COLUMNS.values())} from m")
def metrics_mean(spark, sf_dir):
    return _rounded(metrics.mean(_per_topic(spark, sf_dir), CUTS), "num_q", "num_ret", F.round("gm_map", 6).alias("gm_map"))


@query(f"with {METRIC_SQL}, t as ({TOPIC_SQL}) select t.qid::bigint as qid, m.num_ret is null as empty, round(m.map, 6) as map from t left join m on t.qid = m.qid")
def run_records(spark, sf_dir):
    out = metrics.records(topics(spark), _per_topic(spark, sf_dir), "main")
    return out.select("qid", "empty", F.round("map", 6).alias("map"))


@query(f"with {METRIC_SQL}, t as ({TOPIC_SQL}), r as (select t.qid, coalesce(m.map, 0) as map from t left join m on t.qid = m.qid) select 'main' as name, {', '.join(f'round(max(case when qid = {i} then map end), 6) as q{i}' for i, _ in TOPICS)} from r")
def metrics_pivot(spark, sf_dir):
    out = metrics.pivoted(metrics.records(topics(spark), _per_topic(spark, sf_dir), "main"), "map", [i for i, _ in TOPICS])
    return out.select("name", *[F.round(F.col(f"`{i}`"), 6).alias(f"q{i}") for i, _ in TOPICS])


NAMES = [QueryConfig(m, s, k, a).run_name("main") for m in ("conjunctive", "disjunctive") for s in WEIGHTS for k in (10, 20) for a in ("ternary", "skipping")]


@query(f"with t as ({TOPIC_SQL}), n as (select unnest([{', '.join(repr(n) for n in NAMES)}]) as name) select n.name, t.qid::bigint as qid from t cross join n where not (n.name like '%TFIDF%' and t.qid <= 3)")
def pending_runs(spark, sf_dir):
    """The grid of configurations by topics, less what was evaluated before."""
    grid = topics(spark).select("qid", F.explode(F.array(*[F.lit(n) for n in NAMES])).alias("name"))
    return metrics.pending(grid, grid.where("name like '%TFIDF%' and qid <= 3")).select("name", "qid")


def _all_columns(cuts):
    return {"map": "map", "Rprec": "rprec", "recip_rank": "recip_rank", "bpref": "bpref"} | {f"P@{k}": f"p{k}" for k in cuts} | {f"NDCG@{k}": f"ndcg{k}" for k in cuts}


@query(f"with {metric_sql(topk_sql('BM25', 'disjunctive', TOPIC_SQL, 1000), metrics.CUTS)} select qid, num_ret, num_rel, num_rel_ret, {', '.join(f'round({v}::double, 6) as {v}' for v in _all_columns(metrics.CUTS).values())} from m")
def metrics_all_cuts(spark, sf_dir):
    """Runs of 1,000 documents at every cut."""
    run = search(corpus.index(spark, sf_dir), topics(spark), QueryConfig("disjunctive", "BM25", 1000))
    per = metrics.per_topic(run, qrels(spark, sf_dir))
    return per.select("qid", "num_ret", "num_rel", "num_rel_ret", *[F.round(F.col(f"`{k}`"), 6).alias(v) for k, v in _all_columns(metrics.CUTS).items()])


GRID = evaluate.grid(scorings=("TFIDF", "BM25"), ks=(10,), searches=("ternary",))
GRID_SQL = " union all ".join(
    f"select '{c.run_name('main')}' as name, t.qid::bigint as qid, m.num_ret is null as empty, round(m.map, 6) as map from ({TOPIC_SQL}) t left join (with {metric_sql(topk_sql(c.scoring, c.method, TOPIC_SQL, c.k), (5,))} select * from m) m on t.qid = m.qid" for c in GRID
)


@query(GRID_SQL)
def grid_records(spark, sf_dir):
    """Records of several configurations."""
    built, asked, judged = corpus.index(spark, sf_dir), topics(spark), qrels(spark, sf_dir)
    out = None
    for config in GRID:
        one = evaluate.evaluate(spark, built, asked, judged, config).select("name", "qid", "empty", F.round("map", 6).alias("map"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"select name, qid, empty, map, case when qid <= 2 then 1 else 2 end as round from ({GRID_SQL})")
def grid_resumed(spark, sf_dir):
    """Records appended to a table of results in two rounds, the second of which leaves out what is there, and a third that adds nothing."""
    built, asked, judged, path = corpus.index(spark, sf_dir), topics(spark), qrels(spark, sf_dir), corpus.fresh(spark, "results")
    added = [evaluate.evaluate_grid(spark, built, some, judged, GRID, path) for some in (asked.where("qid <= 2"), asked, asked)]
    if added != [2 * len(GRID), (len(TOPICS) - 2) * len(GRID), 0]:
        raise AssertionError(added)
    out = spark.read.parquet(path)
    return out.select("name", "qid", "empty", F.round("map", 6).alias("map"), F.when(F.col("qid") <= 2, 1).otherwise(2).alias("round"))


# ---- named indexes ----
def _catalog(spark) -> Catalog:
    return Catalog(spark, corpus.fresh(spark, "catalog"))


@query(f"with {DOCS}, {RANGES_SQL} select 'main' as name, true as stem, false as keep_stop, 'gamma' as codec, (select string_agg(lo::varchar || ',' || hi::varchar, ';' order by lo) from ranges) as content, 20 as k, 'conjunctive' as method, 'BM11' as scoring, n_docs from st")
def catalog_metadata(spark, sf_dir):
    """An index built, saved and found again by name, with its options."""
    catalog = _catalog(spark)
    catalog.build(corpus.rows(spark, sf_dir), IndexConfig("main", True, False, "gamma"), QueryConfig("conjunctive", "BM11", 20))
    m = Catalog(spark, catalog.base).metadata("main")
    names = ("name", "stem", "keep_stop", "codec", "content", "k", "method", "scoring", "n_docs")
    return spark.createDataFrame([tuple(m[n] for n in names)], "name string, stem boolean, keep_stop boolean, codec string, content string, k int, method string, scoring string, n_docs long")


@query(f"with {BLOCKS_SQL} select tok, block::bigint as block, len(d)::integer as n, array_to_string(d, ',') as docids, array_to_string(f, ',') as freqs from blocks")
def compressed_index(spark, sf_dir):
    """The lists that an index with a codec keeps, decoded."""
    catalog = _catalog(spark)
    catalog.build(corpus.rows(spark, sf_dir), IndexConfig("main", codec="gamma"))
    lists = spark.read.parquet(f"{catalog.base}/main/{catalog.metadata('main')['batches'][0]}/lists")
    back = lists.withColumn("back", decode_blocks("gamma")(F.col("code"), F.shiftleft("block", BITS)))
    return back.select("tok", "block", "n", *[F.array_join(F.col(f"back.{c}").cast("array<string>"), ",").alias(c) for c in ("docids", "freqs")])


@query("select unnest(['a', 'c', 'd']) as name")
def catalog_names(spark, sf_dir):
    """Indexes found by their folders after a deletion, a renaming and an index that came of asking for it."""
    catalog = _catalog(spark)
    items = collections.from_table(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_="item_id")[0]
    for name in ("a", "b", "x"):
        catalog.build(items, IndexConfig(name))
    catalog.rename("b", "c")
    catalog.delete("x")
    for _ in range(2):
        catalog.get_or_build(items, IndexConfig("d"))
    return spark.createDataFrame([(n,) for n in catalog.names()], "name string")


@query(f"with {DOCS} select tok, df, cf from lex")
def append_lexicon(spark, sf_dir):
    """The labelled documents first, then all, of which those that are there are left out."""
    return _appended(spark, sf_dir).lexicon.select("tok", "df", "cf")


@query(f"with {DOCS}, d as (select d.*, l.doc_id is null as later from docs d left join (select distinct doc_id from labels) l using (doc_id)) select doc_id as docno, len, case when later then (select max(doc_id) from d where not later) + row_number() over (partition by later order by doc_id) else doc_id end as docid from d")
def append_documents(spark, sf_dir):
    """Documents that come later are numbered after the largest that was there."""
    return _appended(spark, sf_dir).docs.select("docno", "len", "docid")


@query(f"select rank, docno, score from ({topk_sql('BM25', 'disjunctive', f'''select 0 as qid, '{ONE}' as query''', 10)})")
def append_topk(spark, sf_dir):
    return search_one(spark, _appended(spark, sf_dir), ONE, QueryConfig()).select("rank", "docno", "score")


def _appended(spark, sf_dir):
    catalog, rows = _catalog(spark), corpus.rows(spark, sf_dir)
    first = _labelled(spark, sf_dir).distinct()
    catalog.build(rows.join(first, "docno", "left_semi"), IndexConfig("main"))
    catalog.append("main", rows)
    catalog.append("main", rows)
    return catalog.load("main")[0]


@query(f"with {DOCS} select tok, df, cf from lex")
def stream_lexicon(spark, sf_dir):
    """An index that follows a folder of files, started from none of its documents."""
    catalog, rows = _catalog(spark), corpus.rows(spark, sf_dir)
    catalog.build(rows.limit(0), IndexConfig("main"))
    inbox = corpus.fresh(spark, "inbox")
    rows.select(F.col("docno").alias("doc_id"), "text").repartition(3).write.parquet(inbox)
    follow(spark, inbox, "doc_id long, text string", catalog, "main", corpus.fresh(spark, "progress")).awaitTermination()
    return catalog.load("main")[0].lexicon.select("tok", "df", "cf")


@query(f"with {DOCS} select tok, df, cf from lex")
def merged_index(spark, sf_dir):
    """Two indexes that share documents, merged into one with a codec of its own."""
    catalog, rows = _catalog(spark), corpus.rows(spark, sf_dir)
    catalog.build(rows.join(_labelled(spark, sf_dir).distinct(), "docno", "left_semi"), IndexConfig("judged"))
    catalog.build(rows, IndexConfig("whole"))
    return catalog.merge(["judged", "whole"], IndexConfig("both", codec="gamma")).lexicon.select("tok", "df", "cf")


@query(f"select rank, doc_id as docid, docno, score from ({topk_sql('BM11', 'conjunctive', f'''select 0 as qid, '{BOTH}' as query''', 20)})")
def stored_options(spark, sf_dir):
    """A query under the options that an index stores, after they were changed in place."""
    catalog = _catalog(spark)
    catalog.build(corpus.rows(spark, sf_dir), IndexConfig("main"))
    catalog.update("main", QueryConfig("conjunctive", "BM11", 20))
    built, stored = catalog.load("main")
    return search_one(spark, built, BOTH, stored)


@query(f"with {STEMS}, sp as (select stem, doc_id, sum(tf) as tf from post join stems using (tok) group by stem, doc_id) select count(*)::bigint as n_postings, count(distinct stem)::bigint as n_terms from sp")
def rebuilt_index(spark, sf_dir):
    """An index whose own options were changed, which builds it again."""
    catalog, rows = _catalog(spark), corpus.rows(spark, sf_dir)
    catalog.build(rows, IndexConfig("main"))
    catalog.update("main", config=IndexConfig("main", stem=True), rows=rows)
    m = catalog.metadata("main")
    return spark.createDataFrame([(m["n_postings"], m["n_terms"])], "n_postings long, n_terms long")


@query(f"with {DOCS} select r as round, tok, df from lex cross join (select unnest([1, 2, 3]) as r) where tok in ('anat', 'the')")
def kept_lookup(spark, sf_dir):
    """Lookups in an index kept on the executors, twice, and after it was let go."""
    catalog = _catalog(spark)
    catalog.build(corpus.rows(spark, sf_dir), IndexConfig("main"))
    found = []
    for r in (1, 2, 3):
        if r != 2:
            built, _ = catalog.load("main", keep=r == 1)
        found += [(r, x["tok"], x["df"]) for x in lookup.any_of(built.lexicon, "tok", ["anat", "the"]).collect()]
    return spark.createDataFrame(found, "round int, tok string, df long")


@query(f"select rank, docno, score from (with documents as (select * from main.documents where {LINE_SQL} <> ''), {topk_sql('BM25', 'disjunctive', f'''select 0 as qid, '{ONE}' as query''', 10).removeprefix('with ')})")
def command_line(spark, sf_dir):
    """build and query as a shell runs them, over the collection's files."""
    import contextlib
    import io

    from ..cli import main

    path, base = _lines(spark, sf_dir, corpus.fresh(spark, "lines")), ["--base", corpus.fresh(spark, "catalog")]
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        main([*base, "build", "main", path, "--limit", "0", "--no-stem"], spark)
        main([*base, "query", "main", ONE], spark)
    rows = [x.split("\t") for x in out.getvalue().splitlines()[1:]]
    return spark.createDataFrame([(int(a), int(c), float(d)) for a, _, c, d in rows], "rank int, docno long, score double")


HUE_SQL = "value - value * saturation * greatest(0::double, least(place, 4 - place, 1::double))"


@query(
    "with i as (select unnest(range(0, 60)) as i), p as (select i, (i % 12) / 12::double as hue, greatest(0.5::double, 0.9::double - 0.05::double * (i // 12)) as saturation, greatest(0.5::double, 0.9::double - 0.05::double * (i // 24)) as value from i), "
    "c as (select i, n, saturation, value, (n + hue * 6) % 6 as place from p cross join (select unnest([5, 3, 1]) as n)) "
    f"select i::bigint as i, round(max(case when n = 5 then {HUE_SQL} end), 6) as r, round(max(case when n = 3 then {HUE_SQL} end), 6) as g, round(max(case when n = 1 then {HUE_SQL} end), 6) as b from c group by i"
)
def chart_colors(spark, sf_dir):
    out = spark.range(60).select(F.col("id").alias("i"), distinct_color(F.col("id")).alias("c"))
    return out.select("i", *[F.round(F.col(f"c.{x}"), 6).alias(x) for x in "rgb"])
