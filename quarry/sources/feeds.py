"""The parsing half of each connector: a payload column becomes document rows. Fetching is another system's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import dates, text, urls

ATOM = "struct<entry:array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>>>>"
RSS = "struct<channel:struct<item:array<struct<title:string,link:string,description:string,pubDate:string,source:string>>>>"
_DAY = "struct<Year:string,Month:string,Day:string>"
PUBMED = (
    "struct<PubmedArticle:array<struct<MedlineCitation:struct<PMID:string,DateCompleted:" + _DAY + ",DateCreated:" + _DAY + ",Article:struct<ArticleTitle:string,"
    "Abstract:struct<AbstractText:array<string>>,AuthorList:struct<Author:array<struct<LastName:string,ForeName:string>>>,ArticleDate:array<" + _DAY + ">,"
    "Journal:struct<JournalIssue:struct<PubDate:struct<Year:string,Month:string,Day:string,MedlineDate:string>>>>>>>>"
)
WIKI = "struct<query:struct<pages:map<string,struct<pageid:long,title:string,extract:string,timestamp:string>>>>"
GDELT = "struct<articles:array<struct<url:string,title:string,seendate:string,domain:string>>>"
CROSSREF = "struct<message:struct<items:array<struct<DOI:string,URL:string,title:array<string>,abstract:string,`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>,created:struct<`date-parts`:array<array<int>>>>>>>"


def _xml(c: Column, schema: str) -> Column:
    return F.from_xml(c, schema, {"mode": "PERMISSIVE"})


def arxiv(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, id, title, text, publication_date, url, pdf_url, author) of Atom feeds."""
    rows = payloads.select(key, F.explode(_xml(F.col(payload), ATOM)["entry"]).alias("e"))
    pdf = F.regexp_replace("e.id", "/abs/", "/pdf/")
    return rows.select(key, F.col("e.id").alias("id"), text.collapse(F.col("e.title")).alias("title"), text.collapse(F.col("e.summary")).alias("text"), F.col("e.published").alias("publication_date"), F.col("e.id").alias("url"), F.concat(pdf, F.lit(".pdf")).alias("pdf_url"), F.array_join(F.transform("e.author", lambda a: a["name"]), ", ").alias("author"))


def rss(payloads: DataFrame, key: str, payload: str, size: int) -> DataFrame:
    """(key, title, text, publication_date, url, source_name) of RSS feeds, the first clamp(size, 5, 80) items of each; text is the description, else the title."""
    items = F.slice(_xml(F.col(payload), RSS)["channel"]["item"], 1, min(max(size, 5), 80))
    rows = payloads.select(key, F.explode(items).alias("i"))
    return rows.select(key, F.col("i.title").alias("title"), text.filled(text.clean_text(F.col("i.description")), F.col("i.title")).alias("text"), F.col("i.pubDate").alias("publication_date"), F.col("i.link").alias("url"), F.col("i.source").alias("source_name"))


def pubmed(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, id, title, text, publication_date, url, author) of fetched article sets.

    Abstract parts that are not blank are joined by a space; authors are first and last names. The date is that
    of publication, of the electronic article, or in free text, else that of completion or creation, else a year.
    """
    rows = payloads.select(key, F.explode(_xml(F.col(payload), PUBMED)["PubmedArticle"]["MedlineCitation"]).alias("a"))
    day = lambda d: F.when(text.text_or_empty(d["Year"]) != "", F.concat_ws("-", F.trim(d["Year"]), dates.month_number(d["Month"]), dates.day_number(d["Day"])))
    article, issue = F.col("a.Article"), F.col("a.Article.Journal.JournalIssue.PubDate")
    date = F.coalesce(day(issue), day(F.get(article["ArticleDate"], F.lit(0))), F.nullif(dates.medline_date(issue["MedlineDate"]), F.lit("")), day(F.col("a.DateCompleted")), day(F.col("a.DateCreated")), F.lit(""))
    parts = F.filter(F.transform(article["Abstract"]["AbstractText"], lambda p: F.trim(p)), lambda p: p != "")
    names = F.filter(F.transform(article["AuthorList"]["Author"], lambda p: F.trim(F.concat_ws(" ", p["ForeName"], p["LastName"]))), lambda p: p != "")
    number = text.text_or_empty(F.col("a.PMID"))
    return rows.select(
        key, number.alias("id"), text.text_or_empty(article["ArticleTitle"]).alias("title"), F.coalesce(F.array_join(parts, " "), F.lit("")).alias("text"), date.alias("publication_date"),
        F.when(number != "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), number, F.lit("/"))).otherwise("").alias("url"), F.nullif(F.array_join(names, ", "), F.lit("")).alias("author"),
    )


def wikipedia(payloads: DataFrame, key: str, payload: str, summaries: DataFrame | None = None) -> DataFrame:
    """(key, id, title, text, publication_date, url); a missing date is 2000-01-01.

    A page without an extract takes its text from summaries(title, summary), where these are given; collections of
    history and academic sources give none.
    """
    rows = payloads.select(key, F.explode(F.map_values(F.from_json(F.col(payload), WIKI)["query"]["pages"])).alias("p"))
    body = F.col("p.extract")
    if summaries is not None:
        known = summaries.groupBy(F.col("title").alias("__title")).agg(F.min("summary").alias("__summary"))
        rows = rows.join(known, F.col("p.title") == F.col("__title"), "left")
        body = text.filled(body, F.col("__summary"))
    return rows.select(key, F.col("p.pageid").cast("string").alias("id"), F.col("p.title").alias("title"), body.alias("text"), text.filled(F.col("p.timestamp"), F.lit("2000-01-01")).alias("publication_date"), F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(F.col("p.title"), F.lit(" "), F.lit("_"))).alias("url"))


def gdelt(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, title, text, publication_date, url, source_name); the text is the title."""
    rows = payloads.select(key, F.explode(F.from_json(F.col(payload), GDELT)["articles"]).alias("a"))
    return rows.select(key, F.col("a.title").alias("title"), F.col("a.title").alias("text"), F.col("a.seendate").alias("publication_date"), F.col("a.url").alias("url"), F.col("a.domain").alias("source_name"))


def gdelt_query(keyword: Column, domain: Column) -> Column:
    """Tokens of four characters or more, then the domain."""
    tokens = F.filter(F.split(F.lower(keyword), "[^a-z0-9]+"), lambda t: F.char_length(t) >= 4)
    return F.array_join(F.array_append(tokens, domain), " ")


def crossref(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, id, title, text, publication_date, url): the date in print, else online, else of creation; the address, else the DOI's."""
    rows = payloads.select(key, F.explode(F.from_json(F.col(payload), CROSSREF)["message"]["items"]).alias("i"))
    first = lambda c: F.get(F.col("i")[c]["date-parts"], 0)
    parts = F.coalesce(first("published-print"), first("published-online"), first("created"))
    return rows.select(key, F.col("i.DOI").alias("id"), F.get("i.title", 0).alias("title"), text.clean_text(F.col("i.abstract")).alias("text"), dates.date_from_parts(F.get(parts, 0), F.get(parts, 1), F.get(parts, 2)).alias("publication_date"), text.filled(F.col("i.URL"), F.concat(F.lit("https://doi.org/"), F.col("i.DOI"))).alias("url"))


def links(html: Column, base: Column) -> Column:
    """Absolute addresses of a page's links without fragments, in order, each once."""
    found = F.regexp_extract_all(text.text_or_empty(html), F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)
    p = urls.parts(base)
    root = F.concat(p["scheme"], F.lit("://"), p["host"])
    whole = F.transform(found, lambda x: F.regexp_replace(F.when(F.startswith(x, F.lit("/")), F.concat(root, x)).otherwise(x), "#.*$", ""))
    return F.array_distinct(F.filter(whole, lambda x: x.rlike("^https?://")))


def child_links(html: Column, base: Column, excluded: Column, most: int) -> Column:
    """links() that are no article to skip and not excluded, the first ones."""
    return F.slice(F.filter(F.array_except(links(html, base), excluded), lambda x: ~F.exists(F.array(*[F.lit(s) for s in urls.SKIPPED]), lambda s: F.contains(F.lower(x), s))), 1, most)


def article(pages: DataFrame, url: str, html: str, least: int = 120) -> DataFrame:
    """Adds title, publication_date and text of a page; a text under least characters is empty."""
    tag = lambda p: F.regexp_extract(text.text_or_empty(F.col(html)), p, 1)
    meta = [tag(rf'(?i)<meta[^>]*(?:name|property)="{n}"[^>]*content="([^"]*)"') for n in ("article:published_time", "pubdate", "date")] + [tag(r'(?i)<time[^>]*datetime="([^"]*)"')]
    body = text.clean_text(F.col(html))
    return pages.withColumns({"title": text.collapse(tag(r"(?is)<title[^>]*>(.*?)</title>")), "publication_date": F.coalesce(*[F.nullif(m, F.lit("")) for m in meta], F.lit("")), "text": F.when(F.char_length(body) >= least, body).otherwise("")})


def reply_json(c: Column) -> Column:
    """The JSON object in a model's reply: inside a code fence, else the outermost braces; '' if there is none."""
    return F.regexp_extract(text.text_or_empty(c), r"(?s)(\{.*\})", 1)


def json_rows(spark, path: str, schema: str) -> DataFrame:
    """Records of JSON array files: a missing path and a file that is no array have none, and entries that are no records are left out."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place):
        return spark.createDataFrame([], schema)
    # entries come out as their own JSON text
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("e"))
    return entries.where(F.startswith(F.ltrim("e"), F.lit("{"))).select(F.from_json("e", schema).alias("r")).select("r.*")


def human_queries(rows: DataFrame, known: list[str], seq: str = "seq") -> DataFrame:
    """Query records of a table read from CSV: unknown domains and empty texts are left out, ids count by domain in order of seq, which names a row. Domains are numbered over many tasks."""
    from quarry.operators.order import positions

    kind = F.lower(F.trim("query_type"))
    flag = F.lower(F.trim(text.text_or_empty(F.col("time_sensitive")))).isin("true", "1", "yes")
    filled = (F.trim(text.text_or_empty(F.col("question"))) != "") & (F.trim(text.text_or_empty(F.col("reference_answer"))) != "")
    picked = rows.where(F.lower(F.trim("domain")).isin(known) & filled).select(
        F.lower(F.trim("domain")).alias("domain"), F.when(kind.isin("factual", "analytical", "comparative"), kind).otherwise("factual").alias("query_type"), F.trim("question").alias("question"), flag.alias("time_sensitive"), F.col(seq).alias("seq")
    )
    placed = positions(picked, ["domain"], ["seq"], "place")
    number = F.lpad((F.col("place") + 1).cast("string"), 6, "0")
    return placed.select(F.concat(F.col("domain"), F.lit("_h"), number).alias("query_id"), "domain", "query_type", "question", "time_sensitive", F.col("seq").alias(seq))


def pdf_columns(docs: DataFrame, collection: str, present: DataFrame | None = None) -> DataFrame:
    """docs(id, url, pdf_url) with pdf_url filled from an abstract's address, pdf_file_name, pdf_file_path and pdf_available.

    A file is named by the paper's id, else by the record's, with other signs as underscores. present(name) are
    the files that there are, such as the listing of a folder by the binaryFile source, and is joined by name; without it none
    is available. Records without a paper have nulls.
    """
    paper = lambda c, pattern: F.nullif(F.regexp_extract(text.text_or_empty(c), pattern, 1), F.lit(""))
    of_page = paper(F.col("url"), r"arxiv\.org/abs/([^/?#]+)")
    link = F.coalesce(F.nullif(F.trim(text.text_or_empty(F.col("pdf_url"))), F.lit("")), F.concat(F.lit("https://arxiv.org/pdf/"), of_page, F.lit(".pdf")))
    of_file = F.nullif(F.replace(paper(link, r"arxiv\.org/(?:pdf|abs)/([^/?#]+)"), F.lit(".pdf"), F.lit("")), F.lit(""))
    stem = F.regexp_replace(F.coalesce(of_file, of_page, F.col("id"), F.lit("arxiv_doc")), r"[^A-Za-z0-9._-]", "_")
    named = docs.withColumn("pdf_url", link).withColumn("pdf_file_name", F.when(F.col("pdf_url").isNotNull(), F.concat(stem, F.lit(".pdf"))))
    named = named.withColumn("pdf_file_path", F.concat(F.lit(f"raw/pdfs/{collection}/"), "pdf_file_name"))
    if present is None:
        return named.withColumn("pdf_available", F.when(F.col("pdf_url").isNotNull(), False))
    there = present.select(F.col("name").alias("__file")).distinct()
    both = named.join(there, F.col("pdf_file_name") == F.col("__file"), "left")
    return both.withColumn("pdf_available", F.when(F.col("pdf_url").isNotNull(), F.col("__file").isNotNull())).drop("__file")


def folder_files(spark, path: str) -> DataFrame:
    """(name, length) of the files of a folder, without reading what they hold."""
    found = spark.read.format("binaryFile").load(path).select("path", "length")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
