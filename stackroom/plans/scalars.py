"""Scalar functions and predicates (groups B and H of the inventory) over documents, lines and inline rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import python as py
from ..functions import text as T
from .base import LINES, case_of, case_table, cases, expected, literal, paragraphs, query, table

SP = r"[\t \x{00A0}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}]+"
WORDS = r"list_filter(list_transform(string_split_regex({x}, '[^\p{{L}}\p{{N}}_\-.]+'), lambda w: lower(regexp_replace(w, '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g'))), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]'))"
STOP = literal(T.STOP_WORDS)


def words_sql(x: str) -> str:
    return WORDS.format(x=x)


def content_sql(x: str) -> str:
    return f"list_filter({words_sql(x)}, lambda w: not list_contains({STOP}, w) and (length(w) > 1 or regexp_matches(w, '^[0-9]$')))"


@query("b02_looks_like_prose", f"with {LINES} select doc_id, pos, length(trim(text)) >= 2 and regexp_matches(text, '\\p{{L}}') prose from para")
def _(spark, d):
    return paragraphs(spark, d).select("doc_id", "pos", T.looks_like_prose(F.col("text")).alias("prose"))


@query("b03_ends_sentence", f"with {LINES} select doc_id, pos, regexp_matches(text, '[.!?。！？:;…]\\s*$') ended from para")
def _(spark, d):
    return paragraphs(spark, d).select("doc_id", "pos", T.ends_sentence(F.col("text")).alias("ended"))


CONT = r"(trim(p) <> '' and not regexp_matches(trim(p), '[.!?。！？:;…]\s*$') and regexp_matches(text, '^\s*[\p{Ll}(\[]'))"


@query("b04_continues", f"with {LINES} select doc_id, pos, coalesce({CONT}, false) goes_on from (select *, lag(text) over (partition by doc_id order by pos) p from para)")
def _(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos")
    return paragraphs(spark, d).withColumn("p", F.lag("text").over(w)).select("doc_id", "pos", F.coalesce(T.continues(F.col("p"), F.col("text")), F.lit(False)).alias("goes_on"))


TITLES = ["1. Introduction", "Abstract", "References", "Appendix A: @n", "Acknowledgements", "Table of Contents", "3. @n", "Funding", "摘要", "参考文献", "Keywords", "IV. BACKGROUND", "附录", "Related  Work", "Results of @n", "12) Works Cited", "Abstraction layers", "Preliminaries: @n"]
TV = f"t as {cases(TITLES, 'k, title')}"


def _titles(spark, d):
    return case_table(spark, d, TITLES).withColumnRenamed("s", "title")


@query(
    "b06_classify_section",
    f"""with {TV} select k, title, case when regexp_matches(title, '{T.ACKNOWLEDGEMENTS}') or regexp_matches(title, '{T.APPENDIX}') or regexp_matches(title, '{T.BIBLIOGRAPHY}') then 'excluded'
    when regexp_matches(title, '{T.FRONT_MATTER}') then case when regexp_matches(title, '{T.ABSTRACT_ROLE}') then 'abstract' else 'excluded' end else 'substantive' end as role from t""",
)
def _(spark, d):
    return _titles(spark, d).select("k", "title", T.classify_section(F.col("title"), F.lit(False)).alias("role"))


@query("b19_front_matter_heading", f"with {TV} select k, title, regexp_matches(title, '{T.READING_FRONT}') or regexp_matches(title, '^(?:摘要|引言|绪论|背景|相关工作|预备知识)\\s*(?:[:：].*)?$') front from t")
def _(spark, d):
    return _titles(spark, d).select("k", "title", T.is_front_matter(F.col("title")).alias("front"))


HOSTS = ["http://localhost/x", "http://10.0.0.1", "https://192.168.1.5:80/y", "ftp://a.org", "https://172.16.3.4/", "http://127.0.0.1", "https://172.40.3.4/", "http://11.0.0.1/z", ""]


@query("b17_public_http_url", f"select page_id, k, regexp_matches(u, '^https?://[^/]') and not regexp_matches(u, '^https?://(localhost|127\\.|10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)') public_url from (select page_id, k, case when k = 0 then url else {literal(HOSTS)}[k] end u from pages, range(0, {len(HOSTS) + 1}) r(k))")
def _(spark, d):
    p = table(spark, d, "pages").select("page_id", F.posexplode(F.concat(F.array("url"), T.strings(HOSTS))).alias("k", "u"))
    return p.select("page_id", F.col("k").cast("long").alias("k"), T.public_http_url(F.col("u")).alias("public_url"))


@query("b18_name_contains", "select doc_id, source from documents where contains(lower(source), lower('SRC1'))")
def _(spark, d):
    return table(spark, d, "documents").where(F.contains(F.lower("source"), F.lower(F.lit("SRC1")))).select("doc_id", "source")


@query("b21_known_ids", "select conv_id, list_filter(list_distinct_first, lambda x: x in (0, 2, 4)) ids from (select conv_id, list(turn order by turn) list_distinct_first from conversations group by 1)")
def _(spark, d):
    ids = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    return ids.select("conv_id", F.array_distinct(F.filter("t", lambda x: F.array_contains(F.array(*[F.lit(i).cast("long") for i in (0, 2, 4)]), x))).alias("ids"))


@query("b22_snippet_supported", "select item_id, count(*)::bigint n_docs from benchmark b join documents d on length(b.text) >= 8 and contains(d.text, b.text) group by 1")
def _(spark, d):
    # word-bounded candidates first: a snippet's first words, as an equi-join; then the containment itself
    from ..operators.linking import contained_in

    return contained_in(table(spark, d, "benchmark"), "item_id", table(spark, d, "documents"), "doc_id").groupBy("item_id").agg(F.count("*").alias("n_docs"))


@query("b27_vocabulary_phrase", "select doc_id, regexp_matches(lower(text), 'license|licensed|released under') found from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.exists(T.strings(["license", "licensed", "released under"]), lambda p: F.contains(F.lower("text"), p)).alias("found"))


ANSWERS = [
    "We use ResNet-50 [E1]. It reaches @z.1% top-1 accuracy [E2][E3]. See Fig. 3 for more details of the @n.",
    "The loss is 0.05 e.g. in Table 2. [E1] Claim two has a number 1,000 and cites [E@z]. Ok.",
    "No markers here but a long enough sentence to be a claim about the @n, i.e. a problem.",
    "[E2] starts with a marker. And Smith et al. show @z things [E1]! Is that so? Yes it is so, indeed.",
    "我们采用残差学习。结果很好 [E1]。GPT-4 outperforms V100 baselines by 3.5 points [E2] [E1] @n.",
    "",
]
AV = f"a as {cases(ANSWERS, 'id, answer')}"


def _answers(spark, d):
    return case_table(spark, d, ANSWERS).withColumnsRenamed({"k": "id", "s": "answer"})


@query("h22_extract_markers", f"with {AV} select id, regexp_extract_all(answer, '\\[(E[0-9]+)\\]', 1) markers from a")
def _(spark, d):
    return _answers(spark, d).select("id", T.extract_markers(F.col("answer")).alias("markers"))


@query("b23_unknown_markers", f"with {AV} select id, list_filter(m, lambda x: x not in ('E1', 'E2')) unknown from (select id, regexp_extract_all(answer, '\\[(E[0-9]+)\\]', 1) m from a)")
def _(spark, d):
    return _answers(spark, d).select("id", T.unknown_markers(F.col("answer"), T.strings(["E1", "E2"])).alias("unknown"))


@query("h23_claim_weight", f"with {AV} select id, length(regexp_replace(answer, '[^{T.CJK}]', '', 'g')) * 3.0::double + (length(answer) - length(regexp_replace(answer, '[^{T.CJK}]', '', 'g'))) weight from a")
def _(spark, d):
    return _answers(spark, d).select("id", T.claim_weight(F.col("answer")).alias("weight"))


@query("h26_anchors", f"with {AV} select id, list_concat(regexp_extract_all(b, '{T.NUMBER}'), regexp_extract_all(b, '{T.IDENTIFIER}')) anchors from (select id, regexp_replace(answer, '\\[(E[0-9]+)\\]', ' ', 'g') b from a)")
def _(spark, d):
    return _answers(spark, d).select("id", T.anchors(F.col("answer")).alias("anchors"))


@query("h24_split_sentences")
def _(spark, d):
    return _answers(spark, d).select("id", T.split_sentences(F.col("answer")).alias("sentences"))


@query("h25_claim_sentences")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.claim_sentences(F.col("text"))).alias("claims"))


@query("h10_tokens", f"select doc_id, len({words_sql('text')})::int n, list_sort({words_sql('text')}) words from documents")
def _(spark, d):
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n"), F.array_sort(t).alias("words"))


@query("h11_content_terms", f"select doc_id, {content_sql('text')} terms from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_terms(F.col("text")).alias("terms"))


ASKED = "What is the thing of the ing and ResNet-50 in 2 tion edble"


@query("h12_coverage", f"select doc_id, len(list_intersect(q, {words_sql('text')}))::double / len(q) coverage from documents, (select list_distinct({content_sql(literal(ASKED))}) q)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.coverage(F.lit(ASKED), F.col("text")).alias("coverage"))


QUERIES_ = ["ResNet-@z", "F(@n)", "p < 0.05", "AND NOT", "", "残差 网络", "?!", "state_of the-art. @n", '"@n" term', "  @n  "]
QV = f"q as {cases(QUERIES_, 'k, q')}"


@query("h13_normalize_terms", f"""with {QV} select k, q, list_transform(list_filter(list_transform(string_split_regex(q, '[^\\p{{L}}\\p{{N}}_\\-.]+'), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g')), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]')), lambda w: '"' || w || '"') terms from q""")
def _(spark, d):
    return case_table(spark, d, QUERIES_).withColumnRenamed("s", "q").select("k", "q", T.normalize_terms(F.col("q")).alias("terms"))


@query("h14_phrase", f"""with {QV} select k, q, case when trim(q) = '' then '' else '"' || trim(q) || '"' end phrase from q""")
def _(spark, d):
    return case_table(spark, d, QUERIES_).withColumnRenamed("s", "q").select("k", "q", T.phrase(F.col("q")).alias("phrase"))


WIDTHS, NARROW = ["ﬁ @n", "ＡＢ@z", "①@z", "e\u0301", None], ["fi @n", "AB@z", "1@z", "é", None]


@query("h01_nfkc", f"select p_partkey k, {expected(NARROW)} n from part")
def _(spark, d):
    return case_table(spark, d, WIDTHS).select("k", py.nfkc("s").alias("n"))


@query("h02_normalize_line", f"with {LINES} select doc_id, pos, trim(regexp_replace(text, '{SP}', ' ', 'g')) line from para")
def _(spark, d):
    return paragraphs(spark, d).select("doc_id", "pos", T.collapse(F.col("text")).alias("line"))


WRAPPED = ["a self-\ncontaining @n", "deep learn-\ning works\nwell-\nknown", "End-\nUpper @z", "  two  \n\nwords ", "", "@n", "multi-\nmodal in-\nput", "@n-\n@n"]
WV = f"w as (select id, string_split(s, chr(10)) lines from {cases(WRAPPED, 'id, s')})"
JOIN_SQL = f"""trim(list_reduce(list_filter(list_transform(lines, lambda x: trim(regexp_replace(x, '{SP}', ' ', 'g'))), lambda x: x <> ''), lambda o, l: case when regexp_matches(o, '\\S-$') and regexp_matches(l, '^\\p{{Ll}}') then
 case when list_contains({literal(T.COMPOUND_PREFIXES)}, lower(regexp_extract(o, '(\\S+?)-$', 1))) then o || l else o[:-2] || l end else concat_ws(' ', nullif(o, ''), l) end, ''))"""


@query("h03_join_wrapped_lines", f"with {WV} select id, {JOIN_SQL} as text from w")
def _(spark, d):
    return case_table(spark, d, WRAPPED).select(F.col("k").alias("id"), T.join_wrapped_lines(F.split("s", "\n", -1)).alias("text"))


@query("h05_canonical_text", f"with w as (select doc_id id, string_split(replace(text, chr(173), ''), chr(10)) lines from documents) select id, {JOIN_SQL} as text from w")
def _(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.canonical_source_text(F.col("text")).alias("text"))


CITED = ["as in [1, 2] and (Smith et al., 2020) or [3–7] of @n", "no citation (see 2020) @n", "(Li and Wu, 1999a) [@z]", "[ 4 ; @z ]"]


@query("h04_citations_in", f"with c as {cases(CITED, 'id, s')} select id, regexp_extract_all(s, '{T.CITATION.replace(chr(39), chr(39) * 2)}') found from c")
def _(spark, d):
    return case_table(spark, d, CITED).select(F.col("k").alias("id"), T.citations_in(F.col("s")).alias("found"))


@query("h06_quantize", "select p_partkey, round_even(round_even(p_retailprice / 2, 0) * 2, 4)::double q from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", T.quantize(F.col("p_retailprice")).alias("q"))


PAYLOAD = "concat_ws('|', 'v1', source, page::varchar, (round_even(pos * 1.5 / 2, 0) * 2)::double::varchar, (round_even(pos * 2.5 / 2, 0) * 2)::double::varchar, (round_even((pos + 9) * 1.5 / 2, 0) * 2)::double::varchar, (round_even((pos + 7) * 2.5 / 2, 0) * 2)::double::varchar, trim(regexp_replace(text, '" + SP + "', ' ', 'g')))"


def _payload(p, layout=None):
    box = F.struct((F.col("pos") * 1.5).alias("x0"), (F.col("pos") * 2.5).alias("y0"), ((F.col("pos") + 9) * 1.5).alias("x1"), ((F.col("pos") + 7) * 2.5).alias("y1"))
    return T.anchor_payload(F.lit("v1"), F.col("source"), F.col("page"), box, F.col("text"), layout)


@query("h07_anchor_payload", f"with {LINES} select doc_id, pos, {PAYLOAD} payload from para")
def _(spark, d):
    p = paragraphs(spark, d)
    return p.select("doc_id", "pos", _payload(p).alias("payload"))


@query("h08_source_anchor", f"with {LINES} select doc_id, pos, sha256({PAYLOAD}) anchor from para")
def _(spark, d):
    p = paragraphs(spark, d)
    return p.select("doc_id", "pos", T.digest(_payload(p)).alias("anchor"))


@query("h09_block_anchor", f"with {LINES} select doc_id, pos, sha256({PAYLOAD.replace('page::varchar', 'page::varchar, lang')}) anchor from para")
def _(spark, d):
    p = paragraphs(spark, d)
    return p.select("doc_id", "pos", T.digest(_payload(p, F.col("lang"))).alias("anchor"))


@query("h69_describe_anchor", f"with {LINES} select doc_id, pos, substr(sha256({PAYLOAD}), 1, 12) short, substr(text, 1, 40) prefix, length(text)::int n_chars from para")
def _(spark, d):
    p = paragraphs(spark, d)
    return p.select("doc_id", "pos", F.substring(T.digest(_payload(p)), 1, 12).alias("short"), F.substring("text", 1, 40).alias("prefix"), F.length("text").alias("n_chars"))


TOK = f"ceil(length(regexp_replace(text, '[^{T.CJK}]', '', 'g')) * 1.5 + (length(text) - length(regexp_replace(text, '[^{T.CJK}]', '', 'g'))) / 3.5)::bigint"


@query("h18_estimate_tokens", f"select doc_id, {TOK} tokens from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


def cut_sql(window: str, least: str, trim: str) -> str:
    ladder = " ".join(f"when length({window}) - length(regexp_extract({window}, '(?s)^.*{b if b.strip() else ' '}', 0)) < length({window}) and length(regexp_extract({window}, '(?s)^.*{'[' + b[0] + ']' + b[1:] if b.strip() else ' '}', 0)) - {len(b)} > {least} then {trim}(regexp_extract({window}, '(?s)^.*{'[' + b[0] + ']' + b[1:] if b.strip() else ' '}', 0))" for b in T.BOUNDARIES)
    return f"case {ladder} else {trim}({window}) end"


@query("h19_truncate_to_tokens", f"select doc_id, case when {TOK} <= 60 then text else {cut_sql('substr(text, 1, 180)', 'length(substr(text, 1, 180)) // 2', 'rtrim')} end cut from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate_to_tokens(F.col("text"), F.lit(60)).alias("cut"))


@query("h28_snippet", f"select doc_id, case when length(trim(text)) <= 400 then trim(text) else {cut_sql('substr(trim(text), 1, 400)', '200', 'trim')} end snippet from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.snippet_of(F.col("text")).alias("snippet"))


NORM = r"lower(trim(regexp_replace(regexp_replace({x}, '\{{v[0-9]+\}}', ' ', 'g'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')))"


@query("h20_normalize_unit", f"with {LINES} select doc_id, pos, {NORM.format(x='text')} unit from para")
def _(spark, d):
    return paragraphs(spark, d).select("doc_id", "pos", T.normalize_unit(F.col("text")).alias("unit"))


@query(
    "h21_unit_score",
    f"with {LINES} select doc_id, pos, case when contains(p, u) then 1.0 when contains(u, p) then length(p)::double / length(u) else len(list_intersect(list_distinct(string_split(u, ' ')), string_split(p, ' ')))::double / len(list_distinct(string_split(u, ' '))) end::double score from (select doc_id, pos, {NORM.format(x='text')} u, {NORM.format(x='lag(text, 1) over (partition by doc_id order by pos)')} p from para) where p is not null",
)
def _(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos")
    p = paragraphs(spark, d).withColumn("p", T.normalize_unit(F.lag("text").over(w))).withColumn("u", T.normalize_unit(F.col("text"))).where("p is not null")
    return p.select("doc_id", "pos", T.unit_score(F.col("u"), F.col("p")).alias("score"))


@query("h17_normalize_for_matching")
def _(spark, d):
    # folding a case makes no blank or dash, so both functions stand together and share a worker
    s = T.squeeze(F.translate(py.casefold(py.nfkc("text")), "‐‑‒–—−", "------"))
    return table(spark, d, "documents").select("doc_id", s.alias("folded"))


@query("h44_normalize_for_search")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.squeeze(F.lower(py.nfkc("text"))).alias("folded"))


@query("h29_normalize_title", "select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) title from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", T.normalize_title(F.col("p_name")).alias("title"))


@query("h30_title_similarity")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", T.normalize_title(F.col("p_name")).alias("a"), T.normalize_title(F.col("p_type")).alias("b"))
    return p.select("p_partkey", F.round(py.title_ratio("a", "b"), 6).alias("ratio"))


TT = "list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 2)"


@query("h31_title_overlap", f"select p_partkey, coalesce(round(len(list_filter(a, lambda w: list_contains(b, w)))::double / nullif(len(a), 0), 6), 0) share from (select p_partkey, {TT.format(x='p_name')} a, string_split(trim(regexp_replace(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' ') b from part)")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(T.overlap(F.col("p_name"), F.concat_ws(" ", "p_name", "p_brand", "p_type")), 6).alias("share"))


MARKS = ["9@z, 5–7", "9@z", "4-2", "1 2,9@z", "7-90", "x @n"]


@query("h32_expand_marker", "select p_partkey k, case p_partkey % 6 when 0 then [5, 6, 7, ('9' || p_size)::int] when 1 then [('9' || p_size)::int] when 3 then [1, 2, ('9' || p_size)::int] else [] end numbers from part")
def _(spark, d):
    return case_table(spark, d, MARKS).select("k", T.expand_marker(F.col("s")).alias("numbers"))


IDS = ['see doi:10.1000/xyz@z. ok', 'arXiv: 1512.03385v@z', 'nothing of @n', '10.5555/1234@z and arXiv:2001.00001']
IDS_OUT = ['10.1000/xyz@z', '10.48550/arXiv.1512.03385', None, '10.5555/1234@z']


@query("h33_find_identifier", f"select p_partkey k, {expected(IDS_OUT)} identifier from part")
def _(spark, d):
    return case_table(spark, d, IDS).select("k", T.find_identifier(F.col("s")).alias("identifier"))


URLS = ['https://www.arxiv.org/abs/1512.03385v@z', 'http://arxiv.org/pdf/1512.03385.pdf', 'https://Example.com/A/@z/', 'https://x.org/p@z.pdf?x=1']
URLS_OUT = ['arxiv.org/abs/1512.03385', 'arxiv.org/abs/1512.03385', 'example.com/a/@z', 'x.org/p@z']


@query("h34_norm_url", f"select p_partkey k, {expected(URLS_OUT)} norm from part")
def _(spark, d):
    return case_table(spark, d, URLS).select("k", T.norm_url(F.col("s")).alias("norm"))


@query("h35_inverted_abstract", "select doc_id, list_sum([length(w) for w in string_split_regex(trim(text), '\\s+')])::bigint + len(string_split_regex(trim(text), '\\s+')) - 1 n_chars from documents")
def _(spark, d):
    # text -> {word: [positions]} -> text again
    # dealt by document before the words are rows, so that no grouping below shuffles them again
    w = table(spark, d, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("p", "w"))
    index = w.groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    back = index.select("doc_id", F.explode("m").alias("w", "ps")).select("doc_id", "w", F.explode("ps").alias("p"))
    text = back.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("p", "w"))).alias("x")).select("doc_id", F.array_join(F.expr("x.w"), " ").alias("t"))
    return text.select("doc_id", F.length("t").cast("long").alias("n_chars"))


TERMS = ["gate", "gate", "top-1", "3×3 conv", "@n", "F(@z)", "", "@n", "@n"]
HOLDS = ["the @n gates open", "@n aggregate", "Top-1 error @z", "a 3×3  conv layer", "of @ns, @z", "let F(@z) be", "x @n", "un@n", "(@n)"]
HIT = [True, False, True, True, True, True, False, False, True]


@query("h37_term_pattern", f"select p_partkey k, {literal(HIT)}[p_partkey % {len(HIT)} + 1] hit from part")
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), T.term_occurs(case_of(TERMS), case_of(HOLDS)).alias("hit"))


@query("h68_term_in_documents", "select doc_id, regexp_matches(text, '(?i)(^|[^A-Za-z0-9])tion(e?s)?($|[^A-Za-z0-9])') hit from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.term_occurs(F.lit("tion"), F.col("text")).alias("hit"))


MATH = ["@n $x^@z$ and $y$ b", "costs \\$@z and $$z$$", "no math @n", "$@z$"]
MARKED = ["@n ⟦m1⟧ and ⟦m2⟧ b", "costs \\$@z and $$z$$", "no math @n", "⟦m1⟧"]


@query("h38_protect_math", f"select p_partkey k, {expected(MARKED)} as text, case p_partkey % 4 when 0 then ['$x^' || p_size || '$', '$y$'] when 3 then ['$' || p_size || '$'] else [] end formulas from part")
def _(spark, d):
    text, found = T.protect(F.col("s"))
    return case_table(spark, d, MATH).select("k", text.alias("text"), found.alias("formulas"))


BACK = ["⟦m2⟧ vor ⟦ m1 ⟧ @n", "⟦m1⟧ ⟦m1⟧ @n", "x @n", "⟦m1⟧ @n"]
FORMULAS, WHOLE = ["$a$|$@z$", "$a$|$b$", "", ""], ["$@z$ vor $a$ @n", None, "x @n", None]


@query("h39_restore_math", f"select p_partkey k, {expected(WHOLE)} back from part")
def _(spark, d):
    found = F.filter(F.split(case_of(FORMULAS), "[|]"), lambda x: x != "")
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), T.restore(case_of(BACK), found).alias("back"))


@query("h40_max_translation_chars", "select doc_id, greatest(2000, 4 * length(text))::bigint most from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.greatest(F.lit(2000), 4 * F.length("text")).cast("long").alias("most"))


@query("h41_redact", "select doc_id, regexp_replace(regexp_replace(text, '(?i)\\b(bearer)\\s+[A-Za-z0-9._~+/=-]+', '\\1 ***', 'g'), '(?i)\\b(api[_-]?key|token|secret|password|authorization)\\b\\s*[=:]\\s*[^\\s,;&]+', '\\1=***', 'g') redacted from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.redact(F.col("text")).alias("redacted"))


STEMS = ['A paper@z.PDF', '  a/b:c?  "d" @z', '深度学习@z.pdf', '???', '']
STEMS_OUT = ['A_paper@z', 'a_b_c___d__@z', '深度学习@z', 'document', 'document']


@query("h42_sanitize_stem", f"select p_partkey k, {expected(STEMS_OUT)} stem from part")
def _(spark, d):
    return case_table(spark, d, STEMS).select("k", T.sanitize_stem(F.col("s")).alias("stem"))


BLOCKS = ['# @n\ntext # no', '> @n\n- a\n1. b\n-x', 'plain @n', '  * @n\n```']
BLOCKS_OUT = ['\\# @n\ntext # no', '\\> @n\n\\- a\n\\1. b\n-x', 'plain @n', '  \\* @n\n\\```']


@query("h43_escape_block", f"select p_partkey k, {expected(BLOCKS_OUT)} escaped from part")
def _(spark, d):
    return case_table(spark, d, BLOCKS).select("k", T.escape_block(F.col("s")).alias("escaped"))


@query("h73_markdown_quote", "select doc_id, '> ' || replace(text, chr(10), chr(10) || '> ') quoted from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.markdown_quote(F.col("text")).alias("quoted"))


@query("h45_phrase_then_terms", "with p as (select doc_id from documents where contains(lower(text), 'of the thing')), t as (select doc_id from documents where contains(lower(text), 'of') and contains(lower(text), 'the') and contains(lower(text), 'thing')) select doc_id from p union select doc_id from t where not exists (select 1 from p)")
def _(spark, d):
    from ..operators.search import phrase_then_terms

    return phrase_then_terms(table(spark, d, "documents"), "text", "of the  Thing").select("doc_id")


SUPPORT = f"with {LINES}, p as (select doc_id, pos, trim(regexp_replace(lower(lag(text) over (partition by doc_id order by pos)), '\\s+', ' ', 'g')) a, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) b from para), w as (select *, list_filter(string_split_regex(a, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') wa, string_split_regex(b, '[^\\p{{L}}\\p{{N}}]+') wb, list_distinct(list_transform(range(1, length(a) - 1), lambda i: substr(a, i, 3))) ga, list_distinct(list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3))) gb from p where a is not null)"


@query("h46_text_supports", SUPPORT + " select doc_id, pos, case when a = '' then false when contains(b, a) then true when len(wa) <= 5 then false when len(list_filter(wa, lambda x: list_contains(wb, x)))::double / len(wa) >= 0.35 then true else coalesce(len(list_intersect(ga, gb))::double / nullif(len(ga), 0) >= 0.25, false) end ok from w")
def _(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos")
    p = paragraphs(spark, d).withColumn("before", F.lag("text").over(w)).where("before is not null")
    return p.select("doc_id", "pos", T.text_supports(F.col("before"), F.col("text")).alias("ok"))


@query("h49_numeric_columns", "select source, count(*) >= 2 and bool_and(regexp_matches(n_chars::varchar, '^[+-]?[0-9.,%]+$')) numeric from documents group by 1")
def _(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(((F.count("*") >= 2) & F.bool_and(F.col("n_chars").cast("string").rlike(r"^[+-]?[0-9.,%]+$"))).alias("numeric"))


@query("h51_clean_metadata", "select s_suppkey, case when lower(trim(s_name)) in ('untitled', 'unknown', 'latex with hyperref') then null else trim(s_name) end title, list_filter(list_transform(string_split_regex(s_name, '[#,;]'), lambda x: trim(x)), lambda x: x <> '') parts from supplier")
def _(spark, d):
    s = F.trim("s_name")
    return table(spark, d, "supplier").select("s_suppkey", F.when(~F.lower(s).isin("untitled", "unknown", "latex with hyperref"), s).alias("title"), F.filter(F.transform(F.split("s_name", "[#,;]"), lambda x: F.trim(x)), lambda x: x != "").alias("parts"))


REPLIES = ['```json\n{"a": @z}\n```', 'Sure: {"b": [1, "@n"]} done', 'none @n', '{broken @n', '{"a": }']
REPLIES_OUT = ['{"a": @z}', '{"b": [1, "@n"]}', None, None, None]


@query("h53_json_object", f"select p_partkey k, {expected(REPLIES_OUT)} j from part")
def _(spark, d):
    return case_table(spark, d, REPLIES).select("k", T.json_object(F.col("s")).alias("j"))


CUT_SHORT = ['{"works": [{"t": @z}, {"t": 2', 'x @n', 'so: {"a": [1, {"b": "@n"}, {"c"', '{"whole": "@n"} and more']
CUT_SHORT_OUT = ['{"works": [{"t": @z}]}', None, '{"a": [1, {"b": "@n"}]}', '{"whole": "@n"}']


@query("h55_close_truncated_json", f"select p_partkey k, {expected(CUT_SHORT_OUT)} j from part")
def _(spark, d):
    return case_table(spark, d, CUT_SHORT).select("k", py.recover_json("s").alias("j"))


@query("h56_occurs", "select b.item_id, d.doc_id from benchmark b, documents d where contains(trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g')))")
def _(spark, d):
    from ..operators.linking import contained_in

    fold = lambda t: t.withColumn("text", T.squeeze(F.lower("text")))
    return contained_in(fold(table(spark, d, "benchmark")), "item_id", fold(table(spark, d, "documents")), "doc_id").select("item_id", "doc_id")


ACRONYMS, LONG_FORMS = ["VLA", "CNN", "RL"], ["Vision-Language-Action", "convolutional neural network", "reinforcement learning"]
SAYING = ["the @n is a Vision Language Action (VLA) model", "CNN (Convolutional Neural Network) @z", "RL and learning of @n"]


@query("h57_attested_acronym", "select p_partkey k, p_partkey % 3 < 2 ok from part")
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), T.expansion_supported(case_of(ACRONYMS), case_of(LONG_FORMS), case_of(SAYING)).alias("ok"))


@query("h58_script_of_paper", f"with {LINES}, s as (select doc_id, string_agg(text, ' ' order by pos) t from para where pos < 12 group by 1) select doc_id, case when length(regexp_replace(t, '[^{T.CJK}]', '', 'g')) > length(t) * 0.2 then 'Chinese' else 'English' end script from s")
def _(spark, d):
    s = paragraphs(spark, d).where("pos < 12").groupBy("doc_id").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(pos, text))), x -> x.text)"), " ").alias("t"))
    wide = F.length(F.regexp_replace("t", f"[^{T.CJK}]", ""))
    return s.select("doc_id", F.when(wide > F.length("t") * 0.2, "Chinese").otherwise("English").alias("script"))


@query("h59_context_hash", "select doc_id, substr(sha256('v1' || chr(1) || lang || '|' || source || '|' || n_chars::varchar), 1, 32) h from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.concat(F.lit("v1\u0001"), F.concat_ws("|", "lang", "source", F.col("n_chars").cast("string"))), 256), 1, 32).alias("h"))


REWRITTEN = ["{v0} @n", "{{v0}} @n", "<b1>@n</b1>", ""]


@query("h60_looks_rewritten", "select p_partkey k, p_partkey % 4 in (1, 2) bad from part")
def _(spark, d):
    return case_table(spark, d, REWRITTEN).select("k", T.looks_rewritten(F.col("s")).alias("bad"))


FILLER = ['```\n@n\n```', 'Translation: @n', '@n', 'Here is the translation: Translation: @n']
FILLER_OUT = ['@n', '@n', '@n', 'Translation: @n']


@query("h61_strip_filler", f"select p_partkey k, {expected(FILLER_OUT)} body from part")
def _(spark, d):
    return case_table(spark, d, FILLER).select("k", T.strip_filler(F.col("s")).alias("body"))


@query("h62_passage_text", "select doc_id, concat_ws(chr(10), nullif(source, ''), text) passage from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat_ws("\n", F.nullif("source", F.lit("")), "text").alias("passage"))


@query("h63_fingerprint", "select source, sha256(concat_ws('|', source, string_agg(doc_id::varchar, ',' order by doc_id))) f from documents group by 1")
def _(spark, d):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return table(spark, d, "documents").groupBy("source").agg(ids.alias("ids")).select("source", F.sha2(F.concat_ws("|", "source", "ids"), 256).alias("f"))


@query("h64_canonical_token", "select o_orderkey, lower(replace(format('{:,}', o_orderkey) || 'A', ',', '')) t from orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.canonical_token(F.concat(F.format_number("o_orderkey", 0), F.lit("A"))).alias("t"))


@query("h65_evidence_block", "select conv_id, string_agg('[E' || (turn + 1) || '] ' || text, chr(10) order by turn) block from conversations group by 1")
def _(spark, d):
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.concat(F.lit("[E"), (x.turn + 1).cast("string"), F.lit("] "), x.text))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(items, "\n").alias("block"))


@query("h66_packet_text", f"with {LINES} select doc_id, string_agg('[E' || (pos + 1) || '] (' || source || ', p.' || page || ')' || chr(10) || text, chr(10) || chr(10) order by pos) packet from para group by 1")
def _(spark, d):
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", "source", "page", "text"))), lambda x: F.concat(F.lit("[E"), (x.pos + 1).cast("string"), F.lit("] ("), x.source, F.lit(", p."), x.page.cast("string"), F.lit(")\n"), x.text))
    return paragraphs(spark, d).groupBy("doc_id").agg(F.array_join(items, "\n\n").alias("packet"))


@query("h70_cache_key", "select doc_id, substr(sha256(source), 1, 8) || chr(1) || text k from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(F.substring(F.sha2("source", 256), 1, 8), F.lit("\u0001"), "text").alias("k"))


MEMBERS = ["a/@n.json", "/@n", "a/../@n", "@n/", "a\\@n", "", "..", "a..@n/c"]


@query("a24_safe_member", "select p_partkey k, p_partkey % 8 in (0, 7) ok from part")
def _(spark, d):
    return case_table(spark, d, MEMBERS).select("k", T.safe_member(F.col("s")).alias("ok"))


TABLES = ['<table><tr><th>@n</th><td> b  c</td></tr><tr><td><b>@z</b></td></tr></table>', '<p>none of @n</p>']
TABLES_OUT = ['@n\tb c\n@z', '']


@query("a16_table_to_text", f"select p_partkey k, {expected(TABLES_OUT)} tsv from part")
def _(spark, d):
    return case_table(spark, d, TABLES).select("k", T.table_to_text(F.col("s")).alias("tsv"))


@query("a22_scale_unit_box", "select p_partkey, [round(p_size / 100.0 * 612, 2), round(p_size / 80.0 * 792, 2), round(p_size / 60.0 * 612, 2), round(p_size / 50.0 * 792, 2)]::double[] box from part")
def _(spark, d):
    box = F.array(*[F.col("p_size") / x for x in (100.0, 80.0, 60.0, 50.0)])
    return table(spark, d, "part").select("p_partkey", T.scale_box(box, F.lit(612.0), F.lit(792.0)).alias("box"))


@query("a23_scale_source_box", "select p_partkey, [round(p_size * 0.5, 2), round(p_size * 2 * 0.25, 2), round(p_size * 3 * 0.5, 2), round(p_size * 4 * 0.25, 2)]::double[] box from part")
def _(spark, d):
    box = F.array(*[F.col("p_size") * float(x) for x in (1, 2, 3, 4)])
    return table(spark, d, "part").select("p_partkey", T.scale_box(box, F.lit(0.5), F.lit(0.25)).alias("box"))


SURE = ["0.@z", "@z", "x @n", None, "-@z"]


@query("d21_confidence", "select p_partkey k, case p_partkey % 5 when 0 then ('0.' || p_size)::double when 1 then 1.0 when 4 then 0.0 else 0.5 end::double c from part")
def _(spark, d):
    return case_table(spark, d, SURE).select("k", T.confidence(F.col("s")).alias("c"))


@query("d23_pages_per_minute", "select source, coalesce(count(*) / nullif(sum(n_chars) / 60, 0), 0)::double rate from documents group by 1")
def _(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.coalesce(F.try_divide(F.count("*"), F.sum("n_chars") / F.lit(60.0)), F.lit(0.0)).alias("rate"))


@query("d17_marker_multiset", f"with {AV} select m, count(*) n from (select unnest(regexp_extract_all(answer, '\\[(E[0-9]+)\\]', 1)) m from a) group by 1")
def _(spark, d):
    return _answers(spark, d).select(F.explode(T.extract_markers(F.col("answer"))).alias("m")).groupBy("m").agg(F.count("*").alias("n"))


@query("d12_distinct_in_order", f"with {AV} select id, list_transform(list_filter(list_zip(m, range(1, len(m) + 1)), lambda z: list_position(m, z[1]) = z[2]), lambda z: z[1]) m from (select id, regexp_extract_all(answer, '\\[(E[0-9]+)\\]', 1) m from a)")
def _(spark, d):
    return _answers(spark, d).select("id", F.array_distinct(T.extract_markers(F.col("answer"))).alias("m"))


@query("h16_singular_kinds", "select distinct event_type kind from events where event_type in ('view', 'click', 'purchase')")
def _(spark, d):
    asked = F.filter(T.tokens(F.lit("Which views, clicks and purchases")), lambda w: F.length(w) > 0)
    singular = F.concat(asked, F.transform(asked, lambda w: F.when(F.endswith(w, F.lit("s")) & (F.length(w) > 3), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)))
    return table(spark, d, "events").select(F.col("event_type").alias("kind")).distinct().where(F.array_contains(singular, F.col("kind")))
