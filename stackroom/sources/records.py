"""Sources and sinks of nested records: parser JSON in two dialects, stored records, archives, exports.

Schemas are explicit; corrupt or missing records are absent, not errors. All readers are lazy and distributed.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import spans as SP
from ..functions import text as T
from ..operators.shared import stored
from ..shipping import ship
from . import trees

# Layout classes of the kinds of blocks; bodies, captions and footnotes of the visual kinds; furniture of a page.
LAYOUT = {
    "doc_title": "title", "heading": "title", "text": "plain text", "ref": "plain text", "equation": "isolate_formula", "figure": "figure", "figure_caption": "figure_caption",
    "table": "table", "table_caption": "table_caption", "table_footnote": "table_footnote", "code": "code", "abandon": "abandon",
}
VISUAL = {"image": ("figure", "figure_caption", "figure_caption"), "chart": ("figure", "figure_caption", "figure_caption"), "table": ("table", "table_caption", "table_footnote"), "code": ("code", "figure_caption", "figure_caption")}
FURNITURE = ("header", "footer", "page_number", "aside_text", "page_footnote", "index")

_COLUMNS = ["id", "page", "pos", "kind", "layout", "level", "bbox", "text", "runs", "html", "image_path", "visual", "is_body", "continues"]


def _of(names: dict, key):
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def _visual_kind(block, child):
    """Body, caption or footnote of a visual block, by the end of its child's type; null for any other child."""
    role = lambda k: _of({n: v[k] for n, v in VISUAL.items()}, block)
    return F.when(F.endswith(child, F.lit("_body")), role(0)).when(F.endswith(child, F.lit("_caption")), role(1)).when(F.endswith(child, F.lit("_footnote")), role(2))


def _units(rows: DataFrame, text) -> DataFrame:
    """Units in order, from rows of (id, page, path, kind, own box or that of the block, ...)."""
    w = Window.partitionBy("id", "page").orderBy("path")
    out = rows.withColumns({"pos": F.row_number().over(w) - 1, "layout": _of(LAYOUT, F.col("kind"))})
    return out.withColumns(text).select(*_COLUMNS)


def blocks_v4(raw: DataFrame, column: str = "value", width: float = 612.0, height: float = 792.0) -> DataFrame:
    """Units of the page-and-block dialect (columns as `_COLUMNS`); boxes are in the unit square.

    Lists are replaced by what they hold, however deep; visual blocks by their bodies, captions and footnotes, which
    share `visual` (page and place of the block); blocks of unknown types are left out. Only the first unit of a block
    that continues the one before continues it.
    """
    get = trees.get
    doc = raw.select("id", F.try_parse_json(column).alias("doc"))
    page = trees.items(doc.select("id", get("doc", "$.pages", "variant").alias("pages")), F.col("pages"), "o", "p").select("id", F.coalesce(get("p", "$.page_idx", "int"), F.lit(0)).alias("page_idx"), get("p", "$.blocks", "variant").alias("blocks"))
    b = trees.items(page.where("page_idx >= 0"), F.col("blocks"), "at", "node").where(trees.kind_of("node") == "OBJECT")
    kind = get("node", "$.type", "string")
    box = lambda n: get(n, "$.bbox", "array<double>")
    b = b.select("id", (F.col("page_idx") + 1).alias("page"), F.array("at").alias("path"), "node", box("node").alias("outer"), (get("node", "$.sub_type", "string") == "ref_text").alias("refs"), F.coalesce(get("node", "$.continues_prev", "boolean"), F.lit(False)).alias("continues"))
    keep = ["id", "page", "path", "node", "outer", "refs", "continues"]

    def below(lists: DataFrame) -> DataFrame:
        inside = trees.items(lists, get("node", "$.content", "variant"), "k", "child").where(trees.kind_of("child") == "OBJECT")
        return inside.withColumns({"path": F.concat("path", F.array("k")), "node": F.col("child")}).select(*keep)

    is_list = lambda n: F.coalesce(get(n, "$.type", "string") == "list", F.lit(False))
    flat = trees.expanded(b, "node", "path", is_list, below)
    in_list = F.size("path") > 1
    # the first of what a list holds stands for the list
    first = F.row_number().over(Window.partitionBy("id", "page", F.col("path")[0]).orderBy("path")) == 1
    flat = flat.withColumn("continues", F.col("continues") & first)
    own = lambda n: F.when(F.size(box(n)) > 0, box(n)).otherwise(F.col("outer"))
    prose = F.when(in_list, F.when(F.coalesce("refs", F.lit(False)) | (F.coalesce(kind, F.lit("")) == "ref_text"), "ref").otherwise("text"))
    plain = flat.withColumn("type", kind).withColumn("kind", F.coalesce(prose, F.when(F.col("type").isin("text"), "text").when(F.col("type") == "ref_text", "ref").when(F.col("type") == "doc_title", "doc_title").when(F.col("type") == "paragraph_title", "heading").when(F.col("type") == "equation", "equation").when(F.col("type").isin(*FURNITURE), "abandon")))
    level = get("node", "$.level", "int")
    plain = plain.where("kind is not null").select(
        "id", "page", "path", "kind", own("node").alias("box"), "continues", F.when(F.col("kind") == "doc_title", 1).when((F.col("kind") == "heading") & level.isNotNull(), F.greatest(F.lit(1), level - 1)).alias("level"),
        F.when(~((F.col("kind") == "abandon") & (F.col("type") == "index")), get("node", "$.content", "variant")).alias("content"), F.lit(None).cast("string").alias("visual"), F.lit(False).alias("is_body"), F.when(F.col("kind") == "equation", get("node", "$.image_path", "string")).alias("image_path"), F.lit(False).alias("html"), F.lit(None).cast("string").alias("child"),
    )
    shown = trees.items(flat.where(~in_list).withColumn("type", kind).where(F.col("type").isin(*VISUAL)), get("node", "$.content", "variant"), "k", "c").where(trees.kind_of("c") == "OBJECT").withColumn("child", F.coalesce(get("c", "$.type", "string"), F.lit("")))
    shown = shown.withColumn("kind", _visual_kind(F.col("type"), F.col("child"))).where("kind is not null")
    body = F.endswith("child", F.lit("_body"))
    shown = shown.select(
        "id", "page", F.concat("path", F.array("k")).alias("path"), "kind", own("c").alias("box"), F.lit(False).alias("continues"), F.lit(None).cast("int").alias("level"),
        get("c", "$.content", "variant").alias("content"), F.concat(F.col("page").cast("string"), F.lit("-"), F.col("path")[0].cast("string")).alias("visual"), body.alias("is_body"), F.when(body, get("c", "$.image_path", "string")).alias("image_path"), (body & (F.col("kind") == "table")).alias("html"), "child",
    )
    string = F.when(trees.kind_of("content") == "STRING", F.col("content").cast("string"))
    raw_text = (F.col("kind") == "equation") | (F.col("is_body") & (F.col("kind") == "code"))
    silent = F.col("is_body") & ~raw_text & (F.col("child") != "algorithm_body")
    s = F.col("s")
    styled = plain.unionByName(shown).withColumn("s", SP.styled(F.when((~raw_text | (F.coalesce("child", F.lit("")) == "algorithm_body")) & ~F.coalesce(silent, F.lit(False)), F.to_json("content"))))
    inline = F.coalesce(s["text"], F.lit(""))
    # of a code body that isn't one string, only an algorithm is read as spans
    spoken = F.when(raw_text, F.coalesce(string, F.when(F.col("child") == "algorithm_body", inline), F.lit(""))).when(silent, "").otherwise(inline)
    return _units(styled, {"bbox": T.scale_box(F.col("box"), F.lit(width), F.lit(height)), "text": spoken, "runs": F.when(F.col("kind").isin("text", "ref"), s["runs"]), "html": F.when(F.col("html"), string)})


def blocks_legacy(raw: DataFrame, column: str = "value", width: float = 612.0, height: float = 792.0) -> DataFrame:
    """The same columns from the dialect of lines and spans; boxes are scaled from the page's own size, which is in points if not given."""
    get = trees.get
    doc = raw.select("id", F.try_parse_json(column).alias("doc"))
    page = trees.items(doc.select("id", get("doc", "$.pdf_info", "variant").alias("pages")), F.col("pages"), "o", "p")
    page = page.select("id", F.coalesce(get("p", "$.page_idx", "int"), F.lit(0)).alias("page_idx"), get("p", "$.page_size", "array<double>").alias("size"), F.array(F.struct(F.lit(0).alias("part"), get("p", "$.para_blocks", "variant").alias("blocks")), F.struct(F.lit(1).alias("part"), get("p", "$.discarded_blocks", "variant").alias("blocks"))).alias("parts"))
    b = page.where("page_idx >= 0").select("id", "page_idx", "size", F.explode("parts").alias("x")).select("id", "page_idx", "size", "x.part", "x.blocks")
    b = trees.items(b, F.col("blocks"), "at", "node").where(trees.kind_of("node") == "OBJECT").withColumn("type", get("node", "$.type", "string"))
    some = lambda n, k: F.coalesce(F.size(get(n, k, "array<variant>")), F.lit(0)) > 0
    merged = F.coalesce(get("node", "$.lines_deleted", "boolean"), F.lit(False)) & ~some("node", "$.lines")
    b = b.where((F.col("part") == 1) | ~merged)
    nested = (F.col("part") == 0) & (F.col("type").isin(*VISUAL) | ((F.col("type") == "list") & some("node", "$.blocks")))
    inside = trees.items(b.where(nested), get("node", "$.blocks", "variant"), "k", "c").where(trees.kind_of("c") == "OBJECT").withColumn("child", F.coalesce(get("c", "$.type", "string"), F.lit("")))
    inside = inside.select("id", "page_idx", "size", F.array("part", "at", "k").alias("path"), F.col("c").alias("node"), F.when(F.col("type") == "list", "text").otherwise(_visual_kind(F.col("type"), F.col("child"))).alias("kind"), ((F.col("type") != "list") & F.endswith("child", F.lit("_body"))).alias("is_body"), F.when(F.col("type") != "list", F.concat((F.col("page_idx") + 1).cast("string"), F.lit("-"), F.col("at").cast("string"))).alias("visual"))
    kinds = {"title": "heading", "text": "text", "ref_text": "ref", "list": "text", "interline_equation": "equation", "index": "abandon"}
    outside = b.where(~F.coalesce(nested, F.lit(False))).select("id", "page_idx", "size", F.array("part", "at").alias("path"), "node", F.when(F.col("part") == 1, "abandon").otherwise(_of(kinds, F.col("type"))).alias("kind"), F.lit(False).alias("is_body"), F.lit(None).cast("string").alias("visual"))
    rows = outside.unionByName(inside).where("kind is not null").withColumn("type", get("node", "$.type", "string"))
    # of a line its spans of text and formulas; the first formula, picture and table of all its spans
    spans = F.flatten(F.transform(F.coalesce(get("node", "$.lines", "array<variant>"), F.array().cast("array<variant>")), lambda l: F.coalesce(F.try_variant_get(l, "$.spans", "array<variant>"), F.array().cast("array<variant>"))))
    first = lambda name, kind=None: F.try_element_at(F.filter(F.transform(spans, lambda s: F.when(F.lit(True) if kind is None else F.try_variant_get(s, "$.type", "string") == kind, F.try_variant_get(s, name, "string"))), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(1))
    get_one = lambda s, name: F.try_variant_get(s, name, "string")
    known = lambda s: F.coalesce(get_one(s, "$.type"), F.lit("text")).isin("text", "inline_equation")
    lines = F.transform(F.coalesce(get("node", "$.lines", "array<variant>"), F.array().cast("array<variant>")), lambda l: F.transform(F.filter(F.coalesce(F.try_variant_get(l, "$.spans", "array<variant>"), F.array().cast("array<variant>")), known), lambda s: F.struct(F.when(get_one(s, "$.type") == "inline_equation", "equation_inline").otherwise("text").alias("type"), get_one(s, "$.content").alias("content"))))
    index = (F.col("type") == "index") & (F.col("path")[0] == 0)
    quiet = F.col("is_body") | (F.col("kind") == "equation") | F.coalesce(index, F.lit(False))
    each = F.transform(SP.styled_each(F.when(~quiet, F.to_json(lines))), lambda x: x["text"])
    text = F.when(F.col("kind") == "equation", F.coalesce(first("$.content", "interline_equation"), F.lit(""))).otherwise(F.coalesce(T.join_printed_lines(F.col("each")), F.lit("")))
    ratio = lambda k, whole: F.when((F.size("size") == 2) & (F.col("size")[0] > 0) & (F.col("size")[1] > 0), F.lit(whole) / F.col("size")[k]).otherwise(1.0)
    rows = rows.withColumn("each", each).withColumns({"page": F.col("page_idx") + 1, "level": F.when(F.col("kind") == "heading", get("node", "$.level", "int"))})
    return _units(rows, {
        "bbox": T.scale_box_by(get("node", "$.bbox", "array<double>"), ratio(0, width), ratio(1, height), F.lit(width), F.lit(height)), "text": text, "runs": F.lit(None).cast("array<struct<start:int,stop:int,styles:array<string>>>"),
        "html": F.when(F.col("is_body"), first("$.html")), "image_path": F.when(F.col("is_body"), first("$.image_path")).when(F.col("kind") == "equation", first("$.image_path", "interline_equation")), "continues": F.lit(False),
    })


def blocks(raw: DataFrame, column: str = "value") -> DataFrame:
    """Units of either dialect; what is in none of them is absent."""
    legacy = trees.get(F.try_parse_json(column), "$.pages", "array<variant>").isNull()
    # both dialects read their texts several times
    raw = stored(raw.select("id", column, legacy.alias("legacy")), "raw")
    return blocks_v4(raw.where("not legacy"), column).unionByName(blocks_legacy(raw.where("legacy"), column))


def collected_urls(raw: DataFrame, column: str = "value") -> DataFrame:
    """(id, urls): every http address under a key `url`, `uri` or `link` anywhere in a JSON tree, sorted, each once."""
    found = trees.leaves(raw, column).where(F.col("key").isin("url", "uri", "link") & (trees.kind_of("leaf") == "STRING")).select("id", F.col("leaf").cast("string").alias("u")).where(F.startswith("u", F.lit("http")))
    return raw.select("id").distinct().join(found.groupBy("id").agg(F.array_sort(F.collect_set("u")).alias("urls")), "id", "left").withColumn("urls", F.coalesce("urls", F.array().cast("array<string>")))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under an explicit schema; lines that don't parse are left out."""
    df = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.where("_corrupt is null").drop("_corrupt")


def read_archives(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(path, member, value) of the zip files at a path."""
    return archive_members(spark.read.format("binaryFile").load(path), suffix)


def archive_members(files: DataFrame, suffix: str = ".json") -> DataFrame:
    """(path, member, value): the first safe member of each zip file (path, content) with that suffix; files that aren't archives are absent."""
    ship(files.sparkSession)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(c or b"")) as z:
                        safe = [n for n in sorted(z.namelist()) if n.endswith(suffix) and not n.startswith("/") and "\\" not in n and ".." not in n.split("/")]
                        if safe:
                            rows.append((p, safe[0], z.read(safe[0]).decode("utf-8", "replace")))
                except zipfile.BadZipFile:
                    continue
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], ["path", "member", "value"])

    return files.select("path", "content").mapInArrow(members, "path string, member string, value string")


def archived(members: DataFrame) -> DataFrame:
    """(path, content): a zip file of each row's members (path, names, values)."""
    ship(members.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for names, values in zip(b.column("names").to_pylist(), b.column("values").to_pylist(), strict=True):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    for n, v in zip(names, values, strict=True):
                        z.writestr(n, v)
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.binary())], ["path", "content"])

    return members.select("path", "names", "values").mapInArrow(pack, "path string, content binary")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length, modificationTime) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length", "modificationTime")


def work_of(raw: DataFrame, column: str = "value") -> DataFrame:
    """Flat literature records from nested JSON; the abstract comes from its inverted index."""
    schema = "id string, display_name string, publication_year int, doi string, cited_by_count int, referenced_works array<string>, abstract_inverted_index map<string, array<int>>"
    r = raw.select(F.from_json(column, schema).alias("r")).select("r.*")
    words = F.flatten(F.transform(F.map_entries("abstract_inverted_index"), lambda e: F.transform(e.value, lambda p: F.struct(p.alias("p"), e.key.alias("w")))))
    return r.select(F.regexp_extract("id", "([^/]+)$", 1).alias("key"), F.col("display_name").alias("title"), F.col("publication_year").alias("year"), F.regexp_replace(F.lower("doi"), "^https?://(dx[.])?doi[.]org/", "").alias("doi"), F.col("cited_by_count").alias("cited_by"), F.col("referenced_works").alias("reference_keys"), F.array_join(F.transform(F.array_sort(words), lambda x: x.w), " ").alias("abstract"))


SECOND = "paperId string, title string, authors array<struct<name:string>>, year int, venue string, externalIds struct<DOI:string>, abstract string, citationCount int, openAccessPdf struct<url:string>, url string"


def second_work_of(raw: DataFrame, column: str = "value") -> DataFrame:
    """Flat literature records of the second provider."""
    r = raw.select(F.from_json(column, SECOND).alias("r")).select("r.*")
    some = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    names = F.filter(F.transform(F.coalesce("authors", F.array().cast("array<struct<name:string>>")), lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    return r.select(F.coalesce("paperId", F.lit("")).alias("key"), F.coalesce("title", F.lit("")).alias("title"), names.alias("authors"), "year", some(F.col("venue")).alias("venue"), F.col("externalIds.DOI").alias("doi"), "url", "abstract", F.col("citationCount").alias("cited_by"), some(F.col("openAccessPdf.url")).alias("oa_pdf_url"))


FOUND = "title string, doi string, url string, authors string, year string, venue string, abstract string, cited_by string"


def found_work_of(raw: DataFrame, seen: list[str], column: str = "value") -> DataFrame:
    """Works that a search reported as JSON, cleaned; the key is a digest of the identifier or title. Records without a usable title are left out.

    A work is verified if its address or identifier is among those that the search has really `seen`.
    """
    r = raw.select(F.from_json(column, FOUND).alias("r")).select("r.*")
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    some = lambda c: F.nullif(text(c), F.lit(""))
    number = lambda c: F.when(F.col(c).rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).cast("int"))
    plain = T.normalize_title(text(F.col("title")))
    doi = F.regexp_replace(F.regexp_replace(text(F.col("doi")), "^https://doi\\.org/", ""), "^doi:", "")
    r = r.withColumn("plain", plain).where(F.length("plain") >= 4).withColumn("doi", F.when(doi.rlike(r"^10\.\d{4,9}/\S+$"), doi))
    url = F.coalesce(F.when(text(F.col("url")).rlike("^https?://"), text(F.col("url"))), F.when(F.col("doi").isNotNull(), F.concat(F.lit("https://doi.org/"), "doi")))
    people = F.when(F.startswith(F.trim("authors"), F.lit("[")), F.from_json("authors", "array<string>")).otherwise(F.transform(F.split(text(F.col("authors")), ",|;| and "), lambda a: F.trim(a)))
    people = F.slice(F.filter(F.coalesce(people, F.array().cast("array<string>")), lambda a: F.trim(F.coalesce(a, F.lit(""))) != ""), 1, 30)
    key = F.concat(F.lit("web_"), F.substring(F.sha1(F.lower(F.coalesce("doi", "plain"))), 1, 12))
    out = r.select(key.alias("key"), text(F.col("title")).alias("title"), people.alias("authors"), number("year").alias("year"), some(F.col("venue")).alias("venue"), "doi", url.alias("url"), F.nullif(F.substring(text(F.col("abstract")), 1, 600), F.lit("")).alias("abstract"), number("cited_by").alias("cited_by"))
    known = T.strings(seen)
    there = F.exists(known, lambda u: T.norm_url(u) == T.norm_url(F.col("url"))) | F.exists(known, lambda u: F.contains(F.lower(u), F.lower(F.col("doi"))))
    return out.withColumn("verified", F.coalesce(there, F.lit(False)))


def markdown_notes(notes: DataFrame, title: str) -> DataFrame:
    """(doc, value): one Markdown text of a document's notes (doc, page, top, id, quote, comment), in reading order."""
    one = F.concat(F.lit("## p. "), F.col("page").cast("string"), F.lit("\n\n"), T.markdown_quote(F.col("quote")), F.when(F.coalesce("comment", F.lit("")) != "", F.concat(F.lit("\n\n"), T.escape_block(F.col("comment")))).otherwise(""))
    g = notes.select("doc", F.struct("page", "top", "id", one.alias("md")).alias("n")).groupBy("doc").agg(F.array_sort(F.collect_list("n")).alias("n"))
    return g.select("doc", F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform("n", lambda x: x.md), "\n\n"), F.lit("\n")).alias("value"))


def json_notes(notes: DataFrame) -> DataFrame:
    """(doc, value): the same notes as one JSON object."""
    g = notes.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "top", "id", "quote", "comment"))).alias("notes"))
    return g.select("doc", F.to_json(F.struct("doc", "notes")).alias("value"))


def write_keyed(df: DataFrame, path: str, key: str) -> None:
    """Replace only the partitions of the keys that `df` holds; the commit protocol makes the write atomic."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def dump(obj) -> str:
    return json.dumps(obj, ensure_ascii=False)
