"""Queries of chunking, markdown and the small text functions.

The driver's documents hold no headings, tables or tags, so pages of markdown are written from the
nation, region and supplier tables, in Spark and in SQL alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import chunking
from tidemark.plans.tables import table
from tidemark.sources import files


def _suppliers(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page per nation: front matter, headings, a table of its suppliers, a note with tags and links."""
    row = F.concat(F.lit("| "), F.col("s_name"), F.lit(" | "), F.col("s_suppkey").cast("string"), F.lit(" |"))
    rows = _suppliers(spark, sf).groupBy("n_nationkey", "n_name", "r_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"))
    text = F.concat(
        F.lit("---\ntags: ["), F.col("r_name"), F.lit(", trade]\n---\n# "), F.col("r_name"), F.lit("\n\nAbout [[regions|the region]] of #"), F.col("r_name"), F.lit(" and #fff.\n\n## "),
        F.col("n_name"), F.lit("\n\n%%draft%%| a | b |\n| Supplier | Key |\n|---|:-:|\n"), F.col("rows"), F.lit("\n\n> [!note] See [["), F.col("n_name"), F.lit("]] ^b-1\n![[map.png]]\nEnd #"), F.col("n_name"), F.lit("\n"),
    )
    return rows.select(F.col("n_nationkey").cast("long").alias("page_id"), text.alias("text"))


PAGES = """
pages as (
  select n_nationkey::bigint as page_id, n_name, r_name, string_agg('| ' || s_name || ' | ' || s_suppkey || ' |', chr(10) order by s_suppkey) as rows, count(*) as n_rows
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all)"""


def split_tables(spark, sf):
    return chunking.segments(pages(spark, sf)).select("page_id", "kind", T.strip(F.col("content")).alias("content"))


def table_summary(spark, sf):
    parts = chunking.segments(pages(spark, sf)).where("kind = 'table'")
    return parts.select("page_id", chunking.table_summary(F.col("content"), F.lit("")).alias("summary"))


def header_sections(spark, sf):
    return chunking.sections(pages(spark, sf)).select("page_id", "section_no", "heading", "crumbs", F.length("body").alias("body_chars"))


def breadcrumbs(spark, sf):
    n = table(spark, sf, "nation")
    heads = F.array(F.lit("# Top"), F.concat(F.lit("## "), F.col("n_name")), F.lit("#### Deep"), F.concat(F.lit("## "), F.col("n_nationkey").cast("string")))
    return n.select("n_nationkey", chunking.breadcrumb(F.slice(heads, F.lit(1), F.col("n_nationkey").cast("int") % 4 + 1)).alias("path"))


def hard_split_chunks(spark, sf):
    cut = table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.hard_split(F.col("text"))).alias("position", "chunk"))
    return cut.select("doc_id", "position", F.md5("chunk").alias("md5"), F.length("chunk").alias("char_count"))


def recursive_chunks(spark, sf):
    rows = chunking.page_chunks(table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "text"))
    return rows.select(F.col("page_id").alias("doc_id"), "position", "char_count", F.md5("text").alias("md5"))


def chunk_page(spark, sf):
    return chunking.page_chunks(pages(spark, sf))


def markdown_clean(spark, sf):
    return pages(spark, sf).select("page_id", T.clean_markdown(T.body(F.col("text"))).alias("text"))


def frontmatter_tags(spark, sf):
    return pages(spark, sf).select("page_id", F.array_join(T.front_matter_tags(F.col("text")), ",").alias("tags"))


def inline_tags(spark, sf):
    return pages(spark, sf).select("page_id", F.array_join(T.inline_tags(T.body(F.col("text"))), ",").alias("tags"))


def merged_tags(spark, sf):
    return pages(spark, sf).select("page_id", F.array_join(T.merged_tags(F.col("text")), ",").alias("tags"))


IDEOGRAPHS = "数据统计报"


def cjk_ratio(spark, sf):
    """Whole texts with their vowels written as ideographs."""
    mixed = F.translate(F.col("text"), "aeiou", IDEOGRAPHS)
    return table(spark, sf, "documents").select("doc_id", F.round(T.cjk_share(mixed), 6).alias("share"), T.is_cjk(mixed).alias("is_cjk"))


def scanned_detector(spark, sf):
    """Documents as files whose lines are pages: scanned if the first three hold under 20 visible characters."""
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    found = files.is_scanned(lines.select("path", (F.col("pos") + 1).alias("page_num"), "text"))
    return found.select(F.col("path").alias("doc_id"), "is_scanned")


def ocr_headings(spark, sf):
    return pages(spark, sf).select("page_id", F.array_join(T.marked_headings(F.col("text")), "|").alias("headings"))


def median_font_headers(spark, sf):
    """Suppliers as lines of a page per nation, in two spans each: their balance is the font size, every seventh is
    bold, and names come again."""
    s = table(spark, sf, "supplier")
    name = F.concat(F.lit("Line "), (F.col("s_suppkey") % 10).cast("string"))
    spans = s.select(F.col("s_nationkey").alias("page_id"), F.col("s_suppkey").alias("line_no"), F.posexplode(F.array(F.substring(name, 1, 5), F.substring(name, 6, 9))).alias("span_no", "text"), F.col("s_acctbal").cast("double").alias("size"), (F.col("s_suppkey") % 7 == 0).alias("bold"))
    return files.font_headings(spans).select("page_id", F.array_join("headings", "|").alias("headings"))


def extension_dispatch(spark, sf):
    kinds = F.element_at(F.array(*map(F.lit, (".pdf", ".MD", ".txt", ".docx", ".py", ""))), (F.col("page_id") % 6 + 1).cast("int"))
    path = F.concat(F.lit("/a.b/f"), F.col("page_id").cast("string"), kinds)
    known = T.suffix(path).isin(*files.supported())
    return table(spark, sf, "pages").select("page_id", T.suffix(path).alias("suffix"), F.when(known, "supported").otherwise("unsupported").alias("status"), T.media_type(path).alias("media_type"))


def excluded_paths(spark, sf):
    folder = F.element_at(F.array(*map(F.lit, ("notes", ".obsidian", ".git", ".trash", ".github"))), (F.col("page_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("/vault/"), folder, F.lit("/f"), F.col("page_id").cast("string"), F.lit(".md"))
    return table(spark, sf, "pages").select("page_id", T.excluded(path).alias("is_excluded"))


QUERIES = {
    f.__name__: f
    for f in (
        split_tables, table_summary, header_sections, breadcrumbs, hard_split_chunks, recursive_chunks, chunk_page, markdown_clean, frontmatter_tags,
        inline_tags, merged_tags, cjk_ratio, scanned_detector, ocr_headings, median_font_headers, extension_dispatch, excluded_paths,
    )
}

NL = "chr(10)"
ORACLE_SQL = {
    "split_tables": f"""with {PAGES}
select page_id, 'table' as kind, '| Supplier | Key |' || {NL} || '|---|:-:|' || {NL} || rows as content from pages
union all select page_id, 'text', '---' || {NL} || 'tags: [' || r_name || ', trade]' || {NL} || '---' || {NL} || '# ' || r_name || {NL} || {NL} || 'About [[regions|the region]] of #' || r_name || ' and #fff.' || {NL} || {NL} || '## ' || n_name || {NL} || {NL} || '%%draft%%| a | b |' from pages
union all select page_id, 'text', '> [!note] See [[' || n_name || ']] ^b-1' || {NL} || '![[map.png]]' || {NL} || 'End #' || n_name from pages""",
    "table_summary": f"with {PAGES} select page_id, '[表格] 文档 包含 ' || n_rows || ' 行数据，列：Supplier、Key' as summary from pages",
    "header_sections": f"""with {PAGES}
select page_id, 0::bigint as section_no, '' as heading, '' as crumbs, length('---' || {NL} || 'tags: [' || r_name || ', trade]' || {NL} || '---')::int as body_chars from pages
union all select page_id, 1, '# ' || r_name, r_name, length('About [[regions|the region]] of #' || r_name || ' and #fff.') from pages
union all select page_id, 2, '## ' || n_name, r_name || ' > ' || n_name, length('%%draft%%| a | b |' || {NL} || '| Supplier | Key |' || {NL} || '|---|:-:|' || {NL} || rows || {NL} || {NL} || '> [!note] See [[' || n_name || ']] ^b-1' || {NL} || '![[map.png]]' || {NL} || 'End #' || n_name) from pages""",
    "breadcrumbs": """select n_nationkey, case n_nationkey % 4 when 0 then 'Top' when 1 then 'Top > ' || n_name when 2 then 'Top > ' || n_name || ' > Deep' else 'Top > ' || n_nationkey end as path from nation""",
    "hard_split_chunks": """select doc_id, (s // 922)::int as position, md5(substr(text, s + 1, 1024)) as md5, length(substr(text, s + 1, 1024))::int as char_count
from (select doc_id, text, unnest(range(0, length(text), 922)) as s from documents) where trim(substr(text, s + 1, 1024), ' ' || chr(9) || chr(10) || chr(13)) <> ''""",
    "markdown_clean": f"""with {PAGES}
select page_id, '# ' || r_name || {NL} || {NL} || 'About the region of #' || r_name || ' and #fff.' || {NL} || {NL} || '## ' || n_name || {NL} || {NL} || '| a | b |' || {NL} || '| Supplier | Key |' || {NL} || '|---|:-:|' || {NL} || rows || {NL} || {NL} || '> See ' || n_name || {NL} || 'End #' || n_name as text from pages""",
    "frontmatter_tags": f"with {PAGES} select page_id, r_name || ',trade' as tags from pages",
    "inline_tags": f"with {PAGES} select page_id, regexp_extract(r_name, '^\\w+') || ',' || regexp_extract(n_name, '^\\w+') as tags from pages",
    "merged_tags": f"with {PAGES} select page_id, array_to_string(list_concat([r_name, 'trade'], list_filter(list_distinct([regexp_extract(r_name, '^\\w+')]), lambda x: x <> r_name), list_filter([regexp_extract(n_name, '^\\w+')], lambda x: x not in (r_name, 'trade', regexp_extract(r_name, '^\\w+')))), ',') as tags from pages",
    "cjk_ratio": f"""select doc_id, round(share, 6) as share, share > 0.2 as is_cjk from (
select doc_id, case when text = '' then 0 else length(regexp_replace(translate(text, 'aeiou', '{IDEOGRAPHS}'), '[^\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}]', '', 'g'))::double / length(text) end as share from documents)""",
    "scanned_detector": "select doc_id, sum(length(regexp_replace(line, '\\s', '', 'g'))) < 20 as is_scanned from (select doc_id, unnest(string_split(text, chr(10))[1:3]) as line from documents) group by doc_id",
    "ocr_headings": f"with {PAGES} select page_id, r_name || '|' || n_name as headings from pages",
    "median_font_headers": """with b as (select s_nationkey, list_sort(list(s_acctbal::double))[count(*) // 2 + 1] as body from supplier group by 1),
h as (select s.s_nationkey as page_id, 'Line ' || (s_suppkey % 10) as line, min(s_suppkey) filter (s_suppkey % 7 = 0 or s_acctbal::double >= 1.2::double * body) as seen
  from supplier s join b using (s_nationkey) group by all)
select page_id, coalesce(string_agg(line, '|' order by seen) filter (seen is not null), '') as headings from h group by page_id""",
    "extension_dispatch": """select page_id, ['.pdf', '.md', '.txt', '.docx', '.py', ''][page_id % 6 + 1] as suffix, case when page_id % 6 < 4 then 'supported' else 'unsupported' end as status,
['application/pdf', 'text/markdown; charset=utf-8', 'text/plain; charset=utf-8', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'application/octet-stream', 'application/octet-stream'][page_id % 6 + 1] as media_type from pages""",
    "excluded_paths": "select page_id, page_id % 5 in (1, 2, 3) as is_excluded from pages",
}
