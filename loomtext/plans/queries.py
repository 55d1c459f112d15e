"""Queries over the test tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.catalog import table
from loomtext.functions import encodings, hashing, images, language, markup, sentences, stem, text, tokens_jwt, transform, urls
from loomtext.operators import fuzzy, layout, search
from loomtext.plans import golden
from loomtext.sources import archives, csv, filetype

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(golden.QUERIES)
ORACLE_SQL: dict[str, str] = dict(golden.ORACLE_SQL)

#: Tokens of a text in DuckDB.
_TOKENS = r"list_filter(list_transform(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda t: lower(t)), lambda t: t <> '')"
_STOP = ", ".join(f"'{w}'" for w in text.SEARCH_STOPWORDS)


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


# --- tokens, filters, aggregates


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS term FROM documents) GROUP BY term")
def term_counts(spark, d):
    return table(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term")
def document_frequency(spark, d):
    return search.build_index(table(spark, d, "documents")).postings.groupBy("term").agg(F.count("*").alias("df"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY doc_id, term")
def term_frequency(spark, d):
    return search.build_index(table(spark, d, "documents")).postings.select(F.col("doc_key").alias("doc_id"), "term", "tf")


@query(f"SELECT count(*) AS n, round(coalesce(avg(len({_TOKENS})), 0), 6) AS avgdl FROM documents")
def corpus_stats(spark, d):
    return search.build_index(table(spark, d, "documents")).corpus.select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"SELECT doc_id, len(list_filter({_TOKENS}, lambda t: t NOT IN ({_STOP}))) AS kept FROM documents")
def stopword_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.tokens_with_stopwords(F.col("text"))).cast("long").alias("kept"))


@query(f"SELECT doc_id, len(list_filter({_TOKENS}, lambda t: strlen(t) >= 5)) AS kept FROM documents")
def min_token_length(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.longer_than(text.tokens(F.col("text")), 5)).cast("long").alias("kept"))


@query("SELECT doc_id, length(text) AS chars FROM documents")
def count_chars(spark, d):
    return table(spark, d, "documents").select("doc_id", text.count_chars(F.col("text")).alias("chars"))


@query("SELECT doc_id, i AS chunk, substr(text, CAST(i * 450 + 1 AS BIGINT), 500) AS piece FROM (SELECT doc_id, text, unnest(range(0, CAST(floor(greatest(length(text) - 50 - 1, 0) / 450.0) AS BIGINT) + 1)) AS i FROM documents WHERE text <> '')")
def fixed_chunks(spark, d):
    pieces = F.posexplode(text.fixed_chunks(F.col("text"), 500, 50))
    return table(spark, d, "documents").select("doc_id", pieces.alias("chunk", "piece")).withColumn("chunk", F.col("chunk").cast("long"))


# --- search

_INDEX = f"""t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents),
p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL),
dl AS (SELECT doc_id, len({_TOKENS}) AS dl FROM documents),
c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""


def _bm25(queries: str, limit: int, having: str = "", terms: str = f"SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOKENS}) AS term FROM q0) GROUP BY ALL") -> str:
    return f"""WITH {_INDEX}, q0 AS ({queries}), q AS ({terms}), w AS (SELECT query_id, count(*) AS wanted FROM q GROUP BY query_id),
s AS (SELECT q.query_id, p.doc_id AS id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score, count(*) AS have
  FROM q JOIN p USING (term) JOIN df USING (term) JOIN dl USING (doc_id), c GROUP BY ALL),
r AS (SELECT s.*, wanted, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s JOIN w USING (query_id) {having})
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {limit}"""


_saved: dict[tuple[str, str], str] = {}


def _saved_index(spark: SparkSession, d: str) -> search.Index:
    """The index of documents, built and saved once for a session and a folder of tables; searches read what they need of it."""
    from loomtext.session import workspace

    at = spark.sparkContext.applicationId, d
    if at not in _saved:
        path = workspace(spark, "index")
        search.build_index(table(spark, d, "documents")).save(path)
        _saved[at] = path
    return search.Index.load(spark, _saved[at])


@query(f"WITH {_INDEX} SELECT (SELECT count(*) FROM p) AS postings, (SELECT count(*) FROM df) AS terms, (SELECT CAST(sum(tf) AS BIGINT) FROM p) AS tokens, (SELECT count(*) FROM dl) AS docs")
def bm25_build(spark, d):
    """Builds and saves an index each time, and reads it back."""
    from loomtext.session import workspace

    path = workspace(spark, "index-built")
    search.build_index(table(spark, d, "documents")).save(path)
    i = search.Index.load(spark, path)
    p = i.postings.agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"))
    return p.join(i.dictionary.agg(F.count("*").alias("terms"))).join(i.docs.agg(F.count("*").alias("docs"))).select("postings", "terms", "tokens", "docs")


def _queries(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, text string")


@query(_bm25("SELECT CAST(0 AS BIGINT) AS query_id, 'the theory of heat and the tion' AS text", 10))
def bm25_search(spark, d):
    return search.search(_saved_index(spark, d), _queries(spark, "the theory of heat and the tion"))


@query(_bm25("SELECT item_id AS query_id, text FROM benchmark", 5))
def bm25_many(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.search(_saved_index(spark, d), queries, limit=5)


@query(_bm25("SELECT CAST(0 AS BIGINT) AS query_id, 'thing that ering' AS text UNION ALL SELECT 1, 'der die und'", 10, "WHERE have = wanted"))
def search_and(spark, d):
    return search.search(_saved_index(spark, d), _queries(spark, "thing that ering", "der die und"), operator="AND")


@query(_bm25("SELECT 1", 10, terms="SELECT CAST(0 AS BIGINT) AS query_id, term, CAST(1 AS BIGINT) AS qtf FROM (SELECT 'the' AS term UNION SELECT DISTINCT term FROM p WHERE starts_with(term, 'thing'))"))
def search_prefix(spark, d):
    return search.search(_saved_index(spark, d), _queries(spark, "the thing"), prefix=True)


@query(f"WITH {_INDEX} SELECT term, df FROM df WHERE starts_with(term, 'th') ORDER BY df DESC, term LIMIT 10")
def auto_suggest(spark, d):
    return search.auto_suggest(_saved_index(spark, d), "TH")


@query("SELECT p_partkey, levenshtein(p_name, 'goldenrod lavender') AS distance FROM part")
def edit_distance(spark, d):
    return table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", F.lit("goldenrod lavender")).cast("long").alias("distance"))


@query()
def fuzzy_search(spark, d):
    records = table(spark, d, "part").select(F.col("p_partkey").alias("ref_index"), F.to_json(F.struct("p_name")).alias("record"))
    queries = spark.createDataFrame([(0, "gldn"), (1, "lav")], "query_id long, query string")
    return fuzzy.search(records, queries, keys=[("p_name", 1.0)], threshold=0.8, limit=20)


# --- sentences, language, stems, chunks, slugs, links, diffs


@query()
def sentence_list(spark, d):
    s = F.posexplode(sentences.sentence_list(F.col("text"), newline_boundaries=True)).alias("n", "span")
    return table(spark, d, "documents").select("doc_id", s).select("doc_id", "n", "span.start", "span.end", "span.sentence")


@query("SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS chars FROM documents")
def sentence_cover(spark, d):
    """Sentences hold all characters of a text but white space between them."""
    own = F.transform(sentences.sentence_list(F.col("text"), newline_boundaries=True), lambda s: s["sentence"])
    return table(spark, d, "documents").select("doc_id", F.length(F.regexp_replace(F.array_join(own, ""), r"\s", "")).cast("long").alias("chars"))


_WORDS = ", ".join(f"('{c}', '{w}')" for c, ws in language.WORDS.items() for w in dict.fromkeys(ws.split()))
_MARKS = ", ".join(f"('{c}', '[{language.LETTERS.get(c, chr(0x10FFFF))}]')" for c in language.WORDS)


# All texts of the table are in Latin letters, so words and letters decide.
@query(rf"""WITH w(code, word) AS (VALUES {_WORDS}), m(code, marks) AS (VALUES {_MARKS}), t AS (SELECT doc_id, text, lower(text) AS low FROM documents),
n AS (SELECT doc_id, low, greatest(1, len(regexp_extract_all(low, '\p{{L}}+'))) AS words, len(regexp_extract_all(text, '\p{{L}}')) AS letters, strlen(text) AS bytes FROM t),
k AS (SELECT doc_id, code, count(*) AS known FROM (SELECT doc_id, unnest(regexp_extract_all(low, '\p{{L}}+')) AS word FROM t) JOIN w USING (word) GROUP BY ALL),
s AS (SELECT n.doc_id, m.code, CAST(coalesce(known, 0) AS DOUBLE) / words + CAST(0.5 AS DOUBLE) * len(regexp_extract_all(low, marks)) / letters AS score
  FROM n CROSS JOIN m LEFT JOIN k ON k.doc_id = n.doc_id AND k.code = m.code WHERE letters > 0 AND bytes >= 10),
b AS (SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code) AS r FROM s WHERE score > 0)
SELECT doc_id, coalesce(code, 'und') AS code FROM documents LEFT JOIN (SELECT * FROM b WHERE r = 1) USING (doc_id)""")
def language_of_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", language.detect(F.col("text")).alias("code"))


@query()
def stems(spark, d):
    return stem.stem_counts(table(spark, d, "documents"), "text", "english", stopwords_en=True)


_STEM_STOP = ", ".join(f"'{w}'" for w in text.STEM_STOPWORDS)


@query(f"SELECT doc_id, len(list_filter({_TOKENS}, lambda t: strlen(t) >= 2 AND t NOT IN ({_STEM_STOP}))) AS stems FROM documents")
def stems_of_documents(spark, d):
    """Each token that counts has a stem."""
    s = stem.tokenize_and_stem(F.col("text"), "english", stopwords_en=True)
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(s, lambda x: x.isNotNull())).cast("long").alias("stems"))


@query()
def text_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(transform.split_text(F.col("text"), 1000, 100)).alias("n", "chunk"))


@query("SELECT doc_id, md5(regexp_replace(text, '\\s', '', 'g')) AS chars_md5, true AS short_enough FROM documents")
def chunk_cover(spark, d):
    """Chunks hold all characters of a text but white space at their edges, and are no longer than asked for."""
    chunks = transform.split_text(F.col("text"), 1000)
    c = table(spark, d, "documents").select("doc_id", chunks.alias("c"))
    return c.select("doc_id", F.md5(F.regexp_replace(F.array_join("c", ""), r"\s", "")).alias("chars_md5"), F.forall("c", lambda x: F.length(x) <= 1000).alias("short_enough"))


@query(r"SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda t: t <> ''), '-') AS slug FROM part")
def ascii_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", text.ascii_slug(F.col("p_name")).alias("slug"))


@query(r"SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda t: t <> ''), '_') AS slug FROM part")
def slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", transform.slugify(F.col("p_name"), "_").alias("slug"))


_LINK = text.LINK.replace("(?i)", "").replace("'", "''")


@query(f"SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(url || ' ' || html, '{_LINK}', 0, 'i')) AS link FROM pages) GROUP BY ALL")
def links(spark, d):
    found = text.links(F.concat("url", F.lit(" "), "html"))
    return table(spark, d, "pages").select("page_id", F.explode(found).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, regexp_matches(html, '{_LINK}', 'i') AS in_html, regexp_matches(url, '{_LINK}', 'i') AS in_url FROM pages")
def has_link(spark, d):
    return table(spark, d, "pages").select("page_id", text.has_link(F.col("html")).alias("in_html"), text.has_link(F.col("url")).alias("in_url"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, d, "conversations").withColumn("old", F.lag("text").over(w)).where("old is not null")
    # A diff costs far more than its bytes: few bytes, but all cores.
    return turns.repartition(spark.sparkContext.defaultParallelism * 2)


@query("SELECT conv_id, turn, md5(old) AS old_md5, md5(text) AS new_md5 FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM conversations) WHERE old IS NOT NULL")
def diff_words(spark, d):
    """Hunks without insertions join to the old text, those without deletions to the new one."""
    h = _turns(spark, d).select("conv_id", "turn", transform.diff(F.col("old"), F.col("text"), "words").alias("h"))
    part = lambda gone: F.md5(F.array_join(F.transform(F.filter("h", lambda x: ~x[gone]), lambda x: x["value"]), ""))
    return h.select("conv_id", "turn", part("added").alias("old_md5"), part("removed").alias("new_md5"))


_PAIRS = "(SELECT * FROM (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a, text AS b FROM conversations) WHERE a IS NOT NULL)"


# No two turns that follow one another share a line, so that a changed one is all deleted and all inserted.
def _lines(x: str, sign: str) -> str:
    return f"""'{sign}' || replace({x}, chr(10), chr(10) || '{sign}') || chr(10) || '\\ No newline at end of file' || chr(10)"""


def _span(x: str) -> str:
    return f"CASE WHEN contains({x}, chr(10)) THEN '1,' || (strlen({x}) - strlen(replace({x}, chr(10), '')) + 1) ELSE '1' END"


@query(f"""SELECT conv_id, turn, '--- turn.txt' || chr(10) || '+++ turn.txt' || chr(10) || CASE WHEN a = b THEN '' ELSE '@@ -' || {_span('a')} || ' +' || {_span('b')} || ' @@' || chr(10) || {_lines('a', '-')} || {_lines('b', '+')} END AS patch FROM {_PAIRS}""")
def diff_patch(spark, d):
    return _turns(spark, d).select("conv_id", "turn", transform.create_patch(F.col("old"), F.col("text"), "turn.txt").alias("patch"))


@query(f"""SELECT conv_id, turn, CAST(k AS INTEGER) AS kind, CAST(CASE k WHEN 1 THEN strlen(a) ELSE 0 END AS INTEGER) AS old_start, CAST(strlen(a) AS INTEGER) AS old_end,
CAST(0 AS INTEGER) AS new_start, CAST(CASE k WHEN 2 THEN 0 ELSE strlen(b) END AS INTEGER) AS new_end FROM (SELECT *, unnest(CASE WHEN a = b THEN [0] ELSE [2, 1] END) AS k FROM {_PAIRS})""")
def diff_line_offsets(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.inline(transform.diff_offsets(F.col("old"), F.col("text"), "lines")))


# --- web


@query(r"""SELECT page_id, h AS hostname, list_extract(l, -1) AS public_suffix, l[-2] || '.' || l[-1] AS domain, array_to_string(l[1:-3], '.') AS subdomain
FROM (SELECT page_id, h, string_split(h, '.') AS l FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS h FROM pages))""")
def url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", urls.parse(F.col("url")).alias("u")).select("page_id", "u.hostname", "u.public_suffix", "u.domain", "u.subdomain")


@query()
def page_markdown(spark, d):
    return table(spark, d, "pages").select("page_id", markup.turndown(F.col("html"), gfm=True).alias("markdown"))


@query()
def page_sanitized(spark, d):
    return table(spark, d, "pages").select("page_id", markup.sanitize(F.col("html")).alias("html"), markup.is_clean(F.col("html")).alias("was_clean"))


@query()
def rendered_markdown(spark, d):
    return table(spark, d, "pages").select("page_id", markup.render_markdown(markup.turndown(F.col("html"))).alias("html"))


_SVG = '<svg xmlns="http://www.w3.org/2000/svg"><!-- c --><g><rect x="%.6f" y="0.000001" width="10.50" height="2" fill="#ffcc00"/></g><title>t</title></svg>'


@query(f"""SELECT p_partkey, printf('{_SVG}', p_retailprice) AS svg, '<svg xmlns="http://www.w3.org/2000/svg"><rect x="' || rtrim(rtrim(printf('%.3f', p_retailprice), '0'), '.') || '" y="0" width="10.5" height="2" fill="#fc0"/></svg>' AS optimized FROM part""")
def svg_optimized(spark, d):
    svg = F.format_string(_SVG, F.col("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", svg.alias("svg")).select("p_partkey", "svg", markup.optimize(F.col("svg")).alias("optimized"))


# --- CSV, archives, codecs

_LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_comment"]


@query("SELECT count(*) AS n, sum(l_orderkey) AS orders, sum(l_linenumber) AS lines FROM lineitem")
def csv_round_trip(spark, d):
    from loomtext.session import workspace

    path = workspace(spark, "csv")
    csv.write(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), path)
    back = csv.read(spark, path)
    return back.agg(F.count("*").alias("n"), F.sum(F.col("l_orderkey").cast("long")).alias("orders"), F.sum(F.col("l_linenumber").cast("long")).alias("lines"))


@query("""SELECT conv_id, turn, '"' || replace(role, '"', '""') || '"' AS role, md5(CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS field FROM conversations""".replace("\\\\", "\\"))
def csv_fields(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.concat(F.lit('"'), F.replace("role", F.lit('"'), F.lit('""')), F.lit('"')).alias("role"), F.md5(text.csv_field(F.col("text"))).alias("field"))


@query("SELECT doc_id, CAST(2 AS BIGINT) AS n_rows, md5(text) AS text_md5 FROM documents")
def csv_column(spark, d):
    """Texts of any content as a field of CSV, parsed back."""
    made = csv.stringify(F.array(F.array(F.lit("id"), F.lit("text")), F.array(F.col("doc_id").cast("string"), F.col("text")), F.array(F.lit("x"), F.lit("y"))))
    rows = table(spark, d, "documents").select("doc_id", csv.parse(made).alias("r"))
    return rows.select("doc_id", F.size("r").cast("long").alias("n_rows"), F.md5(F.get(F.get("r", 0), 1)).alias("text_md5"))


@query("SELECT doc_id, md5(text) AS gzip, md5(text) AS zlib, md5(text) AS raw, md5(text) AS zstd FROM documents")
def codecs_round_trip(spark, d):
    t = F.col("text").cast("binary")
    return table(spark, d, "documents").select(
        "doc_id", F.md5(archives.ungzip(archives.gzip(t))).alias("gzip"), F.md5(archives.inflate(archives.deflate(t))).alias("zlib"),
        F.md5(archives.inflate_raw(archives.deflate_raw(t))).alias("raw"), F.md5(archives.zstd_decompress(archives.zstd_compress(t))).alias("zstd"),
    )


@query("SELECT CAST(doc_id AS VARCHAR) || '.txt' AS name, md5(text) AS data_md5, strlen(text) AS size FROM documents")
def zip_round_trip(spark, d):
    docs = table(spark, d, "documents").select(F.pmod("doc_id", F.lit(40)).alias("archive"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").alias("data"))
    back = archives.extract_all(archives.zip_write(docs, "archive", "name", "data"), "data")
    return back.select("name", F.md5("data").alias("data_md5"), F.octet_length("data").cast("long").alias("size"))


@query("SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS DOUBLE) AS region FROM nation")
def xlsx_round_trip(spark, d):
    n = table(spark, d, "nation").select(F.lit("book").alias("book"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("sheet"), F.col("n_nationkey").alias("at"), F.col("n_nationkey").alias("key"), "n_name", "n_regionkey")
    cells = archives.xlsx_cells(archives.xlsx_write(n, "book", "sheet", "at"), "data").where("row_idx > 0")
    cell = lambda i, f: F.max(F.when(F.col("col_idx") == i, F.col(f"cell.{f}")))
    rows = cells.groupBy("sheet", "row_idx").agg(cell(0, "number").cast("long").alias("n_nationkey"), cell(1, "text").alias("name"), cell(2, "number").alias("region"))
    return rows.select(F.col("n_nationkey").cast(table(spark, d, "nation").schema["n_nationkey"].dataType), "name", "region")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'pdf' WHEN 2 THEN 'gz' END AS ext, CASE doc_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'application/gzip' END AS mime FROM documents")
def file_types(spark, d):
    k = F.col("doc_id") % 4
    magic = F.when(k == 0, F.unhex(F.lit("89504E470D0A1A0A"))).when(k == 1, F.lit("%PDF-1.7").cast("binary")).when(k == 2, archives.gzip(F.col("text"))).otherwise(F.lit("plain ").cast("binary"))
    t = table(spark, d, "documents").select("doc_id", F.concat(magic, F.col("text").cast("binary")).alias("b"))
    return t.select("doc_id", filetype.file_type(F.col("b")).alias("t")).select("doc_id", "t.ext", "t.mime")


@query("SELECT doc_id, md5(text) AS utf8, md5(text) AS utf16, md5(regexp_replace(text, '[^\\x00-\\xff]', '?', 'g')) AS latin1, true AS known FROM documents")
def encodings_round_trip(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.md5(encodings.decode(encodings.encode(t, "utf8"), "utf-8")).alias("utf8"), F.md5(encodings.decode(encodings.encode(t, "utf-16le"), "ucs2")).alias("utf16"),
        F.md5(encodings.decode(encodings.encode(t, "latin1"), "latin1")).alias("latin1"), encodings.exists(F.lit("Shift_JIS")).alias("known"),
    )


# --- JSON, hashes, tokens


@query("""SELECT event_id, '{"k":' || (props->>'k') || ',"type":"' || event_type || '"}' AS merged FROM events""")
def json_merge(spark, d):
    other = F.to_json(F.struct(F.col("event_type").alias("type")))
    return table(spark, d, "events").select("event_id", transform.merge_json(F.col("props"), other).alias("merged"))


@query("SELECT user_id, count(*) AS n, max(CAST(props->>'k' AS BIGINT)) AS largest FROM events GROUP BY user_id")
def json_merge_all(spark, d):
    """Props of a user folded in order of event; arrays add up, so the length counts the events."""
    one = F.concat(F.lit('{"all":['), F.get_json_object("props", "$.k"), F.lit("]}"))
    rows = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", one.alias("j")))), lambda x: x["j"]).alias("js"))
    merged = rows.select("user_id", F.from_json(transform.merge_all_json(F.col("js")), "all array<long>").alias("m"))
    return merged.select("user_id", F.size("m.all").cast("long").alias("n"), F.array_max("m.all").alias("largest"))


@query()
def xxhash_digests(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", hashing.xxh32(t).alias("xxh32"), hashing.xxh64(t).alias("xxh64"), hashing.xxh3_64(t).alias("xxh3_64"), hashing.xxh3_128(t).alias("xxh3_128"))


@query("SELECT doc_id, i AS chunk FROM (SELECT doc_id, unnest(range(0, CAST(ceil(strlen(text) / 1024.0) AS BIGINT))) AS i FROM documents)")
def xxhash_chunks(spark, d):
    rows = hashing.hash_chunks(table(spark, d, "documents").select("doc_id", "text"), "text", 1024)
    return rows.where("digest is not null").select("doc_id", F.col("chunk").cast("long").alias("chunk"))


@query()
def xxhash_stream(spark, d):
    return hashing.hash_stream(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("""SELECT c_custkey, 'HS256' AS alg, c_name AS name, CAST(1700003600 AS BIGINT) AS exp, true AS valid FROM customer""")
def jwt_round_trip(spark, d):
    token = tokens_jwt.sign(F.to_json(F.struct(F.col("c_name").alias("name"))), "secret", now=1_700_000_000, expires_in="1h")
    c = table(spark, d, "customer").select("c_custkey", token.alias("t"))
    p = c.select("c_custkey", tokens_jwt.decode(F.col("t")).alias("p"), tokens_jwt.verify(F.col("t"), "secret", 1_700_000_000).isNotNull().alias("valid"))
    get = F.get_json_object
    return p.select("c_custkey", get("p.header", "$.alg").alias("alg"), get("p.payload", "$.name").alias("name"), get("p.payload", "$.exp").cast("long").alias("exp"), "valid")


@query("""SELECT c_custkey, translate(to_base64(unhex(sha256('{"k":"' || c_name || '","kty":"oct"}'))), '+/=', '-_') AS thumbprint FROM customer""")
def jwk_thumbprint(spark, d):
    return table(spark, d, "customer").select("c_custkey", tokens_jwt.thumbprint(F.to_json(F.struct(F.lit("oct").alias("kty"), F.col("c_name").alias("k")))).alias("thumbprint"))


# --- images, graphs


def _rasters(spark: SparkSession, d: str, partitions: int | None = None) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    part = part.repartition(partitions) if partitions else part
    bytes_of = F.unhex(F.concat(F.sha2("p_name", 512), F.sha2("p_brand", 512), F.sha2("p_type", 512), F.sha2("p_name", 512)))
    return part.select("p_partkey", F.struct(F.lit(8).alias("width"), F.lit(8).alias("height"), bytes_of.alias("rgba")).alias("image"))


@query("SELECT p_partkey, CAST(8 AS INTEGER) AS width, CAST(8 AS INTEGER) AS height, true AS same FROM part")
def png_round_trip(spark, d):
    back = images.png_decode(images.png_encode(F.col("image")))
    return _rasters(spark, d).select("p_partkey", "image", back.alias("b")).select("p_partkey", "b.width", "b.height", (F.col("b.rgba") == F.col("image.rgba")).alias("same"))


@query()
def image_edits(spark, d):
    i = F.col("image")
    edited = images.greyscale(images.rotate(images.crop(images.resize(i, 6, 6), 1, 1, 4, 3), 90))
    # An image costs far more than the row it is made from: few bytes, but all cores.
    rows = _rasters(spark, d, spark.sparkContext.defaultParallelism * 2)
    return rows.select("p_partkey", F.sha2(edited["rgba"], 256).alias("sha256"), images.count_diff(i, images.invert(i)).alias("differing"), images.count_diff(i, i).alias("same"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All orders, one graph for each customer: graphs get more as the table grows, not larger."""
    nodes = table(spark, d, "orders").select(F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").alias("id"), F.lit(40.0).alias("width"), F.lit(20.0).alias("height"), F.lit(None).cast("int").alias("rank"))
    w = Window.partitionBy("graph_id").orderBy("id")
    edges = nodes.select("graph_id", F.lag("id", 2).over(w).alias("source"), F.col("id").alias("target")).where("source is not null").withColumn("minlen", F.lit(1))
    return nodes, edges


# Edges go to the order after the next, so each layer has two orders; they keep their places, 90 apart, layers are 70 apart.
@query("""SELECT o_custkey AS graph_id, o_orderkey AS id, CAST(20 + 90 * (n % 2) AS DOUBLE) AS x, CAST(10 + 70 * (n // 2) AS DOUBLE) AS y, CAST(n // 2 AS INTEGER) AS rank
FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)""")
def graph_layout(spark, d):
    return layout.layered_layout(*_graph(spark, d))


@query()
def force_layout(spark, d):
    nodes, edges = _graph(spark, d)
    none = F.lit(None).cast("double")
    nodes = nodes.select("graph_id", "id", none.alias("x"), none.alias("y"), F.lit(False).alias("fixed"))
    return layout.force_layout(nodes, edges.select("graph_id", "source", "target", none.alias("distance"), none.alias("strength")))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    from loomtext.streaming.index import windowed_counts as counts

    return counts(table(spark, d, "events"))
