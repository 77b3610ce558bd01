"""Text functions, index and search over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import paths as P
from ..functions import text as X
from ..functions.lexemes import lexemes
from ..operators import gram_index as GI
from ..operators import index as I
from ..operators import search as S
from ..operators import tree as T
from ..session import durable, scratch_path
from ..sources import corpus as C
from .base import (
    CANDIDATES, DIRS, FILES, LINES, SEARCH, SUMMARIES, SUMMARY_POSTINGS, TERMS, TEXT_POSTINGS,
    benchmark_queries, files, first_texts, query,
)

# --- text functions ---------------------------------------------------------------


def headed_documents(spark, sf) -> DataFrame:
    """Documents with a metadata header made from their columns: good ones, ones that break
    a rule, ones that are not closed, and ones without a header."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    lang = F.col("lang")
    header = (
        F.when(lang == "fr", F.concat(F.lit("---\r\ntitle: "), q(F.col("source")), F.lit("\r\ntags: [fr, "), F.col("source"), F.lit("]\r\nid: "), F.col("doc_id").cast("string"), F.lit("\r\n---\r\n")))
        .when(lang == "de", F.concat(F.lit("---\ntitle: "), F.col("doc_id").cast("string"), F.lit("\n---\n")))
        .when(lang == "es", F.when(F.col("doc_id") % 2 == 0, F.lit("---\nstatus: ready\n---\n")).otherwise(F.lit("---\ntitle: x\n")))
        .otherwise(F.lit(""))
    )
    return C.read_table(spark, sf, "documents").select(
        F.concat(F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".MD")).alias("path"),
        F.concat(header, "text").alias("content"),
    )


HEADED = """headed AS (SELECT doc_id, lang, source, '/' || lang || '/' || doc_id || '.MD' AS path, text, CASE lang
    WHEN 'fr' THEN '---' || chr(13) || chr(10) || 'title: "' || source || '"' || chr(13) || chr(10) || 'tags: [fr, ' || source || ']' || chr(13) || chr(10) || 'id: ' || doc_id || chr(13) || chr(10) || '---' || chr(13) || chr(10)
    WHEN 'de' THEN '---' || chr(10) || 'title: ' || doc_id || chr(10) || '---' || chr(10)
    WHEN 'es' THEN CASE WHEN doc_id % 2 = 0 THEN '---' || chr(10) || 'status: ready' || chr(10) || '---' || chr(10) ELSE '---' || chr(10) || 'title: x' || chr(10) END
    ELSE '' END AS header FROM documents)"""


@query(
    "text_body",
    f"""WITH {HEADED} SELECT path, CASE WHEN lang = 'es' AND doc_id % 2 = 1 THEN header || text ELSE text END AS body FROM headed""",
)
def _(spark, sf):
    return headed_documents(spark, sf).select("path", H.body("path", "content").alias("body"))


@query(
    "text_metadata",
    f"""WITH {HEADED} SELECT path, CASE WHEN lang = 'fr' THEN '{{"id":' || doc_id || ',"tags":["fr","' || source || '"],"title":"' || source || '"}}' END AS metadata,
        CASE lang WHEN 'de' THEN 'RULE: title must be a string' WHEN 'es' THEN CASE WHEN doc_id % 2 = 0 THEN 'RULE: status is reserved' ELSE 'UNCLOSED: header has no closing line' END END AS metadata_error,
        sha256(CASE WHEN lang IN ('fr', 'en') THEN text ELSE header || text END) AS body_hash FROM headed""",
)
def _(spark, sf):
    return H.parse_headers(headed_documents(spark, sf)).select(
        "path", "metadata", "metadata_error", F.sha2("body", 256).alias("body_hash")
    )


@query(
    "text_quarantine",
    f"""WITH {HEADED} SELECT lang, count(*) AS documents, count(*) FILTER (lang IN ('de', 'es')) AS rejected FROM headed GROUP BY lang""",
)
def _(spark, sf):
    parsed = H.parse_headers(headed_documents(spark, sf)).select("path", "metadata_error")
    lang = F.split("path", "/")[1].alias("lang")
    return parsed.groupBy(lang).agg(
        F.count(F.lit(1)).alias("documents"), F.count("metadata_error").alias("rejected")
    )


@query(
    "text_variant_fields",
    f"""WITH {HEADED} SELECT path, source AS title, 'fr,' || source AS tags, doc_id AS id FROM headed WHERE lang = 'fr'""",
)
def _(spark, sf):
    parsed = H.parse_headers(headed_documents(spark, sf)).filter("metadata is not null")
    data = F.parse_json("metadata")
    return parsed.select(
        "path",
        F.variant_get(data, "$.title", "string").alias("title"),
        F.array_join(F.variant_get(data, "$.tags", "array<string>"), ",").alias("tags"),
        F.variant_get(data, "$.id", "bigint").alias("id"),
    )


@query(
    "text_tokens",
    rf"""WITH {FILES} SELECT path, len(t) AS tokens, sha256(array_to_string(t, ' ')) AS token_hash
         FROM (SELECT path, regexp_extract_all(lower(content), '[\p{{L}}\p{{Nd}}]+') AS t FROM files)""",
)
def _(spark, sf):
    rows = files(spark, sf).select("path", X.tokens("content").alias("t"))
    return rows.select("path", F.size("t").alias("tokens"), F.sha2(F.array_join("t", " "), 256).alias("token_hash"))


@query("text_query_terms", f"WITH {TERMS} SELECT query_id, term FROM terms")
def _(spark, sf):
    return benchmark_queries(spark, sf).select("query_id", F.explode(X.query_terms("query")).alias("term"))


@query("text_english_lexemes")
def _(spark, sf):
    rows = files(spark, sf).select("path", lexemes(X.token_bag("content"), "en").alias("lexemes"))
    return rows.select("path", F.explode(F.array_distinct("lexemes")).alias("lexeme")).groupBy("lexeme").agg(
        F.count(F.lit(1)).alias("documents")
    )


PASSAGES = r"""raw AS (SELECT path, line, trim(text, ' ' || chr(9) || chr(13)) AS text FROM lines),
  cut AS (SELECT path, line, text, regexp_extract_all(text, '(?s)(?:.{1,480}$|.{241,480}\s|.{480})\s*') AS parts, regexp_extract(text, '^(.{0,38}?: )', 1) AS label FROM raw WHERE text <> '' AND length(text) > 480),
  passages AS (
    SELECT path, line, 1 AS part, text AS passage FROM raw WHERE text <> '' AND length(text) <= 480
    UNION ALL
    SELECT path, line, i, CASE WHEN i > 1 THEN label || '... ' ELSE '' END || rtrim(parts[i], ' ' || chr(9) || chr(13)) || CASE WHEN i < len(parts) THEN ' ...' ELSE '' END
    FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM cut))"""


@query(
    "text_passages",
    f"""WITH {FILES}, {LINES}, {PASSAGES} SELECT path, row_number() OVER (PARTITION BY path ORDER BY line, part) AS n, passage FROM passages""",
)
def _(spark, sf):
    return files(spark, sf).select("path", F.posexplode(X.passages("content")).alias("n", "passage")).withColumn(
        "n", F.col("n") + 1
    )


@query(
    "text_line_labels",
    f"""WITH {FILES}, {LINES} SELECT path, line, regexp_extract(text, '^(.{{0,38}}?: )', 1) AS label FROM lines WHERE regexp_matches(text, '^.{{0,38}}?: ')""",
)
def _(spark, sf):
    rows = files(spark, sf).select("path", F.posexplode(X.lines("content")).alias("pos", "text"))
    return rows.select("path", (F.col("pos") + 1).alias("line"), X.line_label("text").alias("label")).filter(
        "label <> ''"
    )


@query(
    "text_cut_bytes",
    f"""WITH {FILES} SELECT path, left(content, list_max(list_filter(range(0, 102), lambda k: strlen(left(content, k)) <= 101))::INTEGER) AS cut FROM files""",
)
def _(spark, sf):
    return files(spark, sf).select("path", X.cut_bytes("content", 101).alias("cut"))


@query("text_cut_characters", f"WITH {FILES} SELECT path, left(content, 256) AS cut FROM files")
def _(spark, sf):
    return files(spark, sf).select("path", X.cut_chars("content", 256).alias("cut"))


@query(
    "text_replace",
    f"""WITH {FILES} SELECT path, (length(content) - length(replace(content, 'the', ''))) // 3 AS times, sha256(replace(content, 'the', 'THE!')) AS every_hash,
        sha256(CASE WHEN position('the' IN content) = 0 THEN content ELSE left(content, position('the' IN content) - 1) || 'THE!' || substr(content, position('the' IN content) + 3) END) AS first_hash FROM files""",
)
def _(spark, sf):
    old, new = F.lit("the"), F.lit("THE!")
    return files(spark, sf).select(
        "path",
        X.occurrences("content", old).alias("times"),
        F.sha2(F.replace("content", old, new), 256).alias("every_hash"),
        F.sha2(X.replace_first("content", old, new), 256).alias("first_hash"),
    )


# --- index ------------------------------------------------------------------------


@query("index_text", f"WITH {FILES}, {TEXT_POSTINGS} SELECT path, source, lexeme, tf FROM text_postings")
def _(spark, sf):
    return I.text_postings(files(spark, sf), "zh").select("path", "source", "lexeme", "tf")


@query(
    "index_summaries",
    f"WITH {FILES}, {SUMMARIES}, {SUMMARY_POSTINGS} SELECT path, kind, lexeme, tf FROM summary_postings",
)
def _(spark, sf):
    return I.summary_postings(first_texts(files(spark, sf)), "zh").select("path", "kind", "lexeme", "tf")


@query(
    "index_rebuild",
    f"""WITH {FILES}, {SUMMARIES}, {TEXT_POSTINGS}, {SUMMARY_POSTINGS}
        SELECT source, kind, lexeme, count(*) AS documents, sum(tf)::BIGINT AS tf FROM (SELECT * FROM text_postings UNION ALL SELECT * FROM summary_postings) GROUP BY ALL""",
)
def _(spark, sf):
    corpus = files(spark, sf)
    folder = scratch_path(spark, "index")
    I.write_index(I.build_index(corpus, "zh", first_texts(corpus)), folder)
    return I.read_index(spark, folder).groupBy("source", "kind", "lexeme").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("tf")
    )


@query(
    "index_heavy_lexemes",
    f"WITH {FILES}, {TEXT_POSTINGS} SELECT lexeme, count(*) AS n FROM text_postings GROUP BY lexeme HAVING count(*) > 300",
)
def _(spark, sf):
    return I.heavy_lexemes(durable(I.text_postings(files(spark, sf), "zh"), "postings"), 300)


@query(
    "index_update",
    f"""WITH {FILES}, {TEXT_POSTINGS} SELECT path, lexeme, tf FROM text_postings WHERE path NOT LIKE '%7.md'
        UNION ALL SELECT path, lexeme, count(*) FROM (SELECT path, unnest(regexp_extract_all(lower(path), '[a-z0-9]+') || ['short', 'new', 'text', 'new']) AS lexeme FROM files WHERE path LIKE '%7.md' AND path NOT LIKE '%17.md') GROUP BY ALL""",
)
def _(spark, sf):
    corpus = files(spark, sf)
    touched = corpus.filter(F.col("path").endswith("7.md"))
    replaced = touched.filter(~F.col("path").endswith("17.md")).withColumn("content", F.lit("short new text new"))
    after = corpus.filter(~F.col("path").endswith("7.md")).unionByName(replaced)
    updated = I.update_index(I.text_postings(corpus, "zh"), touched, after, "zh")
    return updated.select("path", "lexeme", "tf")


@query(
    "index_status",
    f"""WITH {FILES} SELECT count(*) AS total, count(*) FILTER (size % 5 = 0 OR size % 5 = 1) AS stale, 2::BIGINT AS orphans FROM files""",
)
def _(spark, sf):
    corpus = files(spark, sf)
    covered = I.manifest(corpus.filter("size % 5 <> 0"), "zh").join(corpus.select("path", "size"), "path")
    other = covered.withColumn("language", F.when(F.col("size") % 5 == 1, F.lit("en")).otherwise(F.col("language")))
    gone = spark.createDataFrame([("/gone/a.md", "zh"), ("/gone/b.md", "zh")], "path string, language string")
    return I.index_status(corpus, other.select("path", "language").unionByName(gone), "zh")


@query("index_settings", f"WITH {FILES} SELECT 'zh' AS language, true AS summary_enabled, count(*) AS total, 0::BIGINT AS stale FROM files")
def _(spark, sf):
    corpus = files(spark, sf)
    return I.settings(corpus, I.manifest(corpus, "zh"), "zh", True)


# --- search -----------------------------------------------------------------------


def _postings(spark, sf):
    corpus = files(spark, sf)
    return I.text_postings(corpus, "zh").unionByName(I.summary_postings(first_texts(corpus), "zh"))


def _matched(spark, sf):
    return S.matches(_postings(spark, sf), S.query_lexemes(benchmark_queries(spark, sf), "zh"))


def _page_matched(spark, sf, **page):
    """Matches of the documents that can be on a page, from the text alone."""
    corpus = files(spark, sf)
    rows = durable(S.query_lexemes(benchmark_queries(spark, sf), "zh"), "queries")
    return S.page_matches(S.relevant(I.text_postings(corpus, "zh"), rows), corpus, rows, **page)


TOP_TEXT = f"""WITH {FILES}, {TERMS}, {TEXT_POSTINGS}, m AS (
      SELECT query_id, path, count(DISTINCT lexeme) AS matched, sum(tf) AS n FROM text_postings JOIN terms ON lexeme = term GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, n DESC, path) AS place FROM m)"""


@query(
    "search_top_documents",
    f"{TOP_TEXT} SELECT query_id, place, path, matched, round(n / (n + 10.0), 9) AS rank FROM placed WHERE place <= 10",
)
def _(spark, sf):
    found = S.found_documents(_page_matched(spark, sf))
    return S.top_page(found).select("query_id", "place", "path", "matched", F.round("score", 9).alias("rank"))


@query(
    "search_page",
    f"{TOP_TEXT} SELECT query_id, place, path FROM placed WHERE place > 7 AND place <= 507",
)
def _(spark, sf):
    found = S.found_documents(_page_matched(spark, sf, limit=500, offset=7))
    return S.top_page(found, limit=500, offset=7).select("query_id", "place", "path")


@query(
    "search_stored_index",
    f"{TOP_TEXT} SELECT query_id, place, path, matched FROM placed WHERE place <= 10",
)
def _(spark, sf):
    folder = scratch_path(spark, "index")
    corpus = files(spark, sf)
    I.write_index(I.text_postings(corpus, "zh"), folder)
    rows = durable(S.query_lexemes(benchmark_queries(spark, sf), "zh"), "queries")
    matched = S.page_matches(S.relevant(I.read_index(spark, folder), rows), corpus, rows)
    return S.top_page(S.found_documents(matched)).select("query_id", "place", "path", "matched")


@query(
    "search_in_scope",
    f"""WITH {FILES}, {TERMS}, {TEXT_POSTINGS}, m AS (
      SELECT query_id, path, count(DISTINCT lexeme) AS matched, sum(tf)::BIGINT AS n FROM text_postings JOIN terms ON lexeme = term
      WHERE starts_with(path, '/corpus/src' || (query_id % 5) || '/') GROUP BY ALL)
      SELECT query_id, path, matched, n FROM m""",
)
def _(spark, sf):
    queries = benchmark_queries(spark, sf).withColumn(
        "scope", F.concat(F.lit("corpus//src"), (F.col("query_id") % 5).cast("string"))
    )
    matched = S.matches(I.text_postings(files(spark, sf), "zh"), S.query_lexemes(queries, "zh"))
    return matched.select("query_id", "path", "matched", F.col("text_positions").alias("n"))


@query("search_term_matches", f"WITH {FILES}, {TERMS}, {TEXT_POSTINGS} SELECT query_id, path, lexeme, tf FROM text_postings JOIN terms ON lexeme = term")
def _(spark, sf):
    rows = S.query_lexemes(benchmark_queries(spark, sf), "zh").select("query_id", F.explode("lexemes").alias("lexeme"))
    postings = I.text_postings(files(spark, sf), "zh")
    return postings.join(S.broadcast_if_small(rows), "lexeme").select("query_id", "path", "lexeme", "tf")


@query("search_candidates", f"WITH {SEARCH} SELECT query_id, path, matched, round(score, 9) AS score FROM found")
def _(spark, sf):
    found = S.candidate_documents(_postings(spark, sf), S.query_lexemes(benchmark_queries(spark, sf), "zh"))
    return found.select("query_id", "path", "matched", F.round("score", 9).alias("score"))


@query("search_directory_candidates", f"WITH {SEARCH} SELECT query_id, place, path, matched, round(rank, 9) AS rank FROM candidates")
def _(spark, sf):
    return S.directory_candidates(_matched(spark, sf)).select(
        "query_id", "place", "path", "matched", F.round("rank", 9).alias("rank")
    )


@query(
    "search_directories",
    f"""WITH {SEARCH} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n, c.path, CASE WHEN s.status = 'ready' THEN s.abstract ELSE '' END AS abstract
        FROM candidates c JOIN summaries s ON s.path = c.path AND s.kind = 'dir' WHERE EXISTS (SELECT 1 FROM files f WHERE starts_with(f.path, c.path || '/')) QUALIFY n <= 3""",
)
def _(spark, sf):
    corpus = files(spark, sf)
    return S.result_directories(S.directory_candidates(_matched(spark, sf)), corpus, first_texts(corpus))


PAGE = """page AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, score DESC, path) AS place FROM found QUALIFY place <= 10)"""


@query(
    "search_totals",
    f"""WITH {SEARCH} SELECT item_id AS query_id, 'OK' AS status, count(f.path) AS total FROM benchmark b LEFT JOIN found f ON f.query_id = b.item_id GROUP BY item_id""",
)
def _(spark, sf):
    found = S.found_documents(_matched(spark, sf))
    return S.result_totals(found, benchmark_queries(spark, sf))


SHOWN = f"""WITH {SEARCH}, {PAGE}, {LINES}, {PASSAGES},
  numbered AS (SELECT path, passage, row_number() OVER (PARTITION BY path ORDER BY line, part) AS n FROM passages WHERE path IN (SELECT path FROM page)),
  wanted AS (SELECT query_id, list(term) AS terms FROM terms GROUP BY query_id),
  scored AS (SELECT p.query_id, p.path, n AS k, passage, list_filter(regexp_extract_all(lower(passage), '[\\p{{L}}\\p{{Nd}}]+'), lambda t: list_contains(terms, t)) AS hits
     FROM page p JOIN wanted w ON w.query_id = p.query_id JOIN numbered l ON l.path = p.path),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY len(list_distinct(hits)) DESC, len(hits) DESC, k) AS best, count(*) OVER (PARTITION BY query_id, path) AS found_lines FROM scored WHERE len(hits) > 0),
  shown AS (SELECT query_id, path, string_agg(passage, chr(10) ORDER BY k) AS snippet, any_value(found_lines) - count(*) AS more_lines FROM ranked WHERE best <= 3 GROUP BY ALL)"""


@query(
    "search_passages",
    f"""{SHOWN} SELECT p.query_id, p.place, p.path, coalesce(s.snippet, '') AS snippet, coalesce(s.more_lines, 0) AS more_lines, false AS more_lines_min
        FROM page p LEFT JOIN shown s ON s.query_id = p.query_id AND s.path = p.path""",
)
def _(spark, sf):
    result = full_search(spark, sf)
    return result.hits.select("query_id", "place", "path", "snippet", "more_lines", "more_lines_min")


@query(
    "search_results",
    f"""WITH {SEARCH}, {PAGE} SELECT p.query_id, p.place, p.path, p.matched, round(p.score, 9) AS rank, CASE WHEN s.status = 'ready' THEN s.abstract ELSE '' END AS abstract, f.size, epoch(f.mtime)::BIGINT AS mtime_s
        FROM page p JOIN files f ON f.path = p.path JOIN summaries s ON s.path = p.path""",
)
def _(spark, sf):
    return full_search(spark, sf).hits.select(
        "query_id", "place", "path", "matched", F.round("rank", 9).alias("rank"), "abstract", "size",
        F.unix_seconds("mtime").alias("mtime_s"),
    )


def full_search(spark, sf, **options) -> S.SearchResult:
    corpus = files(spark, sf)
    summaries = first_texts(corpus)
    postings = I.text_postings(corpus, "zh").unionByName(I.summary_postings(summaries, "zh"))
    return S.search(postings, corpus, benchmark_queries(spark, sf), "zh", summaries=summaries, **options)


@query(
    "search_after_delete",
    f"""WITH {FILES}, {TERMS}, {TEXT_POSTINGS}, m AS (
      SELECT query_id, path, count(DISTINCT lexeme) AS matched, sum(tf) AS n FROM text_postings JOIN terms ON lexeme = term WHERE path NOT LIKE '%2.md' AND path NOT LIKE '%5.md' GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, n DESC, path) AS place, count(*) OVER (PARTITION BY query_id) AS total FROM m)
    SELECT query_id, place, path, matched, total FROM placed WHERE place <= 10""",
)
def _(spark, sf):
    corpus = files(spark, sf)
    left = corpus.filter(~F.col("path").endswith("2.md") & ~F.col("path").endswith("5.md"))
    result = S.search(I.text_postings(corpus, "zh"), left, benchmark_queries(spark, sf), "zh")
    totals = result.totals.select("query_id", "total")
    return result.hits.select("query_id", "place", "path", "matched").join(totals, "query_id")


@query("search_english")
def _(spark, sf):
    corpus = files(spark, sf)
    result = S.search(I.text_postings(corpus, "en"), corpus, benchmark_queries(spark, sf), "en")
    return result.hits.select("query_id", "place", "path", "matched", "rank", "snippet", "more_lines")


@query(
    "search_substrings",
    f"""WITH {FILES}, {TERMS}, m AS (SELECT query_id, path, count(*) AS matched, (SELECT count(*) FROM terms t2 WHERE t2.query_id = t.query_id) AS n
          FROM terms t JOIN files f ON contains(lower(content), term) GROUP BY query_id, path)
        SELECT query_id, path, matched, round(matched / n, 9) AS rank FROM m""",
)
def _(spark, sf):
    found = S.substring_found(files(spark, sf), benchmark_queries(spark, sf))
    return found.select("query_id", "path", "matched", F.round("rank", 9).alias("rank"))


@query(
    "search_stored_grams",
    f"""WITH {FILES}, {TERMS}, m AS (SELECT query_id, path, count(*) AS matched, (SELECT count(*) FROM terms t2 WHERE t2.query_id = t.query_id) AS n
          FROM terms t JOIN files f ON contains(lower(content), term) GROUP BY query_id, path)
        SELECT query_id, path, matched, round(matched / n, 9) AS rank FROM m""",
)
def _(spark, sf):
    """An index of an earlier state of the corpus (other contents, missing and later deleted documents), brought up to date."""
    corpus, folder = files(spark, sf), scratch_path(spark, "gram-index")
    kind = F.col("size") % 8
    other = F.when(kind == 1, F.reverse("content")).otherwise(F.col("content"))
    gone = corpus.filter(kind == 3).withColumn("path", F.concat("path", F.lit(".gone")))
    GI.write_gram_index(corpus.filter(kind != 2).withColumn("content", other).unionByName(gone), folder)
    touched = corpus.filter(kind.isin(1, 2)).select("path")
    GI.update_gram_index(corpus, touched, folder)
    GI.update_gram_index(corpus, gone.select("path"), folder)
    found = GI.stored_substring_found(folder, corpus, benchmark_queries(spark, sf))
    return found.select("query_id", "path", "matched", F.round("rank", 9).alias("rank"))


@query(
    "search_substring_page",
    f"""WITH {FILES}, {LINES}, {TERMS}, {PASSAGES}, m AS (SELECT query_id, path, count(*) AS matched FROM terms t JOIN files f ON contains(lower(content), term) GROUP BY query_id, path),
        page AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, path) AS place FROM m QUALIFY place <= 10),
        hit AS (SELECT p.query_id, p.path, passage, row_number() OVER (PARTITION BY p.query_id, p.path ORDER BY line, part) AS k FROM page p JOIN passages l ON l.path = p.path
          WHERE EXISTS (SELECT 1 FROM terms t WHERE t.query_id = p.query_id AND contains(lower(passage), t.term)))
        SELECT p.query_id, p.place, p.path, coalesce(string_agg(passage, chr(10) ORDER BY k) FILTER (k <= 3), '') AS snippet, count(k) FILTER (k > 3) AS more_lines
        FROM page p LEFT JOIN hit h ON h.query_id = p.query_id AND h.path = p.path GROUP BY ALL""",
)
def _(spark, sf):
    page = S.substring_search(files(spark, sf), benchmark_queries(spark, sf))
    return page.select("query_id", "place", "path", "snippet", "more_lines")


# --- joins, windows and sets of the search statement --------------------------------


@query(
    "join_own_summary",
    f"""WITH {FILES}, {SUMMARIES} SELECT f.path, CASE WHEN s.status = 'ready' THEN s.abstract ELSE '' END AS abstract
        FROM files f LEFT JOIN summaries s ON s.path = f.path AND f.size % 2 = 0""",
)
def _(spark, sf):
    corpus = files(spark, sf)
    known = first_texts(corpus.filter("size % 2 = 0")).filter("kind = 'file'")
    return corpus.select("path").join(S._abstracts(known), "path", "left").select(
        "path", F.coalesce("abstract", F.lit("")).alias("abstract")
    )


@query("join_directory_summaries", f"WITH {FILES}, {SUMMARIES} SELECT path, abstract FROM summaries WHERE path NOT IN (SELECT path FROM files)")
def _(spark, sf):
    corpus = files(spark, sf)
    return first_texts(corpus).join(corpus.select("path"), "path", "left_anti").select("path", "abstract")


@query("join_inhabited", f"WITH {FILES}, {SUMMARIES} SELECT s.path FROM summaries s WHERE kind = 'dir' AND EXISTS (SELECT 1 FROM files f WHERE starts_with(f.path, s.path || '/') AND f.size % 3 = 0)")
def _(spark, sf):
    corpus = files(spark, sf)
    dirs = first_texts(corpus).filter("kind = 'dir'").select("path")
    return T.inhabited(dirs, corpus.filter("size % 3 = 0"))


@query("join_positions", f"WITH {FILES}, {LINES} SELECT path, line AS n, length(text) AS characters FROM lines")
def _(spark, sf):
    rows = files(spark, sf).select("path", X.lines("content").alias("lines"))
    zipped = F.arrays_zip("lines", F.transform("lines", F.length).alias("sizes"))
    return rows.select("path", F.posexplode(zipped).alias("pos", "pair")).select(
        "path", (F.col("pos") + 1).alias("n"), F.col("pair")["sizes"].alias("characters")
    )


@query(
    "window_best_lines",
    f"""WITH {FILES}, {LINES} SELECT path, line, count(*) OVER (PARTITION BY path) AS found, row_number() OVER (PARTITION BY path ORDER BY length(text) DESC, line) AS place FROM lines WHERE contains(text, 'the') QUALIFY place <= 3""",
)
def _(spark, sf):
    from ..operators.grep import grep

    by_path = Window.partitionBy("path")
    rows = grep(files(spark, sf), "the").select("path", "line", F.length("text").alias("size"))
    return (
        rows.withColumn("place", F.row_number().over(by_path.orderBy(F.desc("size"), "line")))
        .withColumn("found", F.count(F.lit(1)).over(by_path))
        .filter("place <= 3")
        .select("path", "line", "found", "place")
    )


@query(
    "set_union_of_hits",
    f"""WITH {FILES}, {SUMMARIES}, {TERMS}, {TEXT_POSTINGS}, {SUMMARY_POSTINGS}
        SELECT query_id, path FROM text_postings JOIN terms ON lexeme = term UNION SELECT query_id, path FROM summary_postings JOIN terms ON lexeme = term WHERE kind = 'file'""",
)
def _(spark, sf):
    return _matched(spark, sf).filter("kind = 'file'").select("query_id", "path")


@query("set_union_of_nodes", f"WITH {FILES}, {DIRS} SELECT path FROM files UNION SELECT '/' UNION SELECT path FROM dirs")
def _(spark, sf):
    corpus = files(spark, sf)
    return corpus.select("path").union(T.directories(corpus).select("path")).distinct()


@query(
    "aggregate_ordered_arrays",
    f"""WITH {FILES} SELECT parent, string_agg(name, ',' ORDER BY size DESC, path) AS names FROM files GROUP BY parent""",
)
def _(spark, sf):
    rows = files(spark, sf).select(P.parent("path").alias("parent"), P.name("path").alias("name"), "size", "path")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("less"), "path", "name")))
    return rows.groupBy("parent").agg(F.array_join(F.transform(ordered, lambda r: r["name"]), ",").alias("names"))
